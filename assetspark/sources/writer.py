"""Files assembled from pieces, as a Spark data source: `df.write.format("pieces").mode("append").save(folder)`.

A row is a piece of a file: target (the file, in the folder), rank (files of lower rank are renamed first), at, and
either payload or the range (size, source, source_at) of another file, which is copied in chunks. Pieces go straight to
their places in a temporary file beside the target, so the pieces of one file may come from any number of tasks and no
payload is moved to meet another. What lies between pieces is zero. Pieces with sequence true must come in order and
from one task, and may overlap: their temporary file is the attempt's own.

A piece is the same bytes at the same place in each attempt, so a task that is lost, or runs twice, does no harm. Files
get their names only in commit, once all tasks have ended, by rank and then by name; abort removes what was written.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

PIECES = "target string, rank int, sequence boolean, at long, size long, payload binary, source string, source_at long"
CHUNK = 1 << 20


@dataclass
class Written(WriterCommitMessage):
    """(rank, target, temporary file) of each file that a task wrote pieces of, and their bytes."""

    files: list[tuple[int, str, str]]
    bytes: int


def copy_pieces(source: int, source_at: int, size: int, target: int, at: int, chunk: int = CHUNK) -> None:
    """size bytes from one place of an open file to another place of another, a chunk at a time."""
    while size:
        part = os.pread(source, min(chunk, size), source_at)
        if not part:
            raise EOFError(f"a payload ends {size} bytes past its file")
        os.pwrite(target, part, at)
        source_at, at, size = source_at + len(part), at + len(part), size - len(part)


class PieceWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        own = uuid.uuid4().hex
        files: dict[str, tuple[int, str, str]] = {}
        held: dict[str, int] = {}
        total = 0

        def opened(path: str, flags: int) -> int:
            if path not in held:
                if len(held) >= 64:
                    os.close(held.pop(next(iter(held))))
                held[path] = os.open(path, flags, 0o644)
            return held[path]

        try:
            for batch in iterator:
                for piece in batch.to_pylist():
                    target = os.path.join(self.folder, piece["target"])
                    temporary = f"{target}.{self.job}.{own if piece['sequence'] else 'shared'}.tmp"
                    if temporary not in files:
                        os.makedirs(os.path.dirname(target), exist_ok=True)
                        files[temporary] = (piece["rank"], target, temporary)
                    out = opened(temporary, os.O_RDWR | os.O_CREAT)
                    if piece["payload"] is not None:
                        view, at = memoryview(piece["payload"]), piece["at"]
                        while view:
                            done = os.pwrite(out, view, at)
                            view, at = view[done:], at + done
                        total += len(piece["payload"])
                    elif piece["size"]:
                        copy_pieces(opened(piece["source"], os.O_RDONLY), piece["source_at"], piece["size"], out, piece["at"])
                        total += piece["size"]
            for path, number in held.items():
                if path in files:
                    os.fsync(number)
        finally:
            for number in held.values():
                os.close(number)
        return Written(list(files.values()), total)

    def commit(self, messages: list[Written | None]) -> None:
        done = sorted({f for m in messages if m for f in m.files})
        for _, target, temporary in done:
            os.replace(temporary, target)
        self._clear(os.path.dirname(target) for _, target, _ in done)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(folder for folder, _, _ in os.walk(self.folder))

    def _clear(self, folders) -> None:
        """Removes what is left of this job, such as files of attempts that were lost."""
        for folder in set(folders):
            for name in os.listdir(folder):
                if name.endswith(".tmp") and f".{self.job}." in name:
                    os.unlink(os.path.join(folder, name))


class PieceSink(DataSource):
    """spark.dataSource.register(PieceSink), then format("pieces")."""

    @classmethod
    def name(cls) -> str:
        return "pieces"

    def schema(self) -> str:
        return PIECES

    def writer(self, schema, overwrite: bool) -> PieceWriter:
        return PieceWriter(self.options["path"])
