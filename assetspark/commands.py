"""The commands analyze, optimize and verify over a bundle or a folder of them.

Codes: 0 done, 1 an error, 2 a verification with issues. `python -m assetspark.commands <command> <path> [options]`.
"""

from __future__ import annotations

import os
import sys
from typing import TextIO

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetspark.functions import encoders
from assetspark.operators import library, report
from assetspark.progress import Event, Progress
from assetspark.settings import Arguments, SettingError, parse
from assetspark.sources.container import ContainerError, backup_all

VERSION = "0.3.0"
DONE, ERROR, ISSUES = 0, 1, 2
#: Spellings of the commands.
SPELLINGS = {"analyze": "analyze", "analyse": "analyze", "optimize": "optimize", "optimise": "optimize", "verify": "verify"}
USAGE = """usage: assetspark analyze|optimize|verify <bundle or folder> [options]
  --strategy balanced|quality|smallest   --quality fast|balanced|best   --encoder auto|portable|<registered>
  --max-size N   --stream N   --mips keep|single   --add-mips   --no-collapse   --no-dedup
  --output FOLDER   --backup FOLDER   --original PATH   --threads N   --dry-run
  --version   --help"""


def version(full: str = VERSION) -> str:
    """The version without what a build appends to it."""
    return full.split("+")[0]


def _planned(spark: SparkSession, args: Arguments, out: TextIO) -> tuple[DataFrame, DataFrame, DataFrame]:
    entries = library.entries_of(spark, args.need_path())
    plan = library.plan_of(entries, args.settings.options())
    sizes = library.predicted(entries, plan, args.settings.share).cache()
    out.write(f"encoder: {encoders.status()}\n")
    report.stream(report.plan_lines(entries, plan, sizes), out)
    return entries, plan, sizes


def analyze(spark: SparkSession, args: Arguments, out: TextIO) -> int:
    _, _, sizes = _planned(spark, args, out)
    sizes.unpersist()
    return DONE


def optimize(spark: SparkSession, args: Arguments, out: TextIO) -> int:
    chosen = encoders.resolve(args.settings.encoder)  # an encoder asked for that isn't there is an error before anything else
    entries, plan, sizes = _planned(spark, args, out)
    worth = sizes.filter("worth_writing").select("bundle")
    nothing = worth.isEmpty()
    if nothing:
        out.write("nothing to do\n")
        return DONE
    if args.dry_run:
        out.write("dry run: nothing written\n")
        return DONE
    path = args.need_path()
    root = path if os.path.isdir(path) else os.path.dirname(path) or "."
    if args.output is None:
        saved = backup_all(worth, args.backup or "backup").agg(F.sum("n_files").alias("files"), F.count("*").alias("bundles")).first()
        out.write(f"backed up {saved['files']} files of {saved['bundles']} bundles\n")
    sizes.unpersist()
    out.write(f"encoding with {chosen.name}, {args.settings.quality} effort\n")
    steps: list[str] = []

    def tell(event: Event) -> None:
        if event.step not in steps:
            steps.append(event.step)
            out.write(f"  {event.step}...\n")

    applied = library.optimise(entries, plan, root, args.output or root, args.settings.share, args.settings.encoder, args.settings.quality, Progress(spark, tell))
    report.stream(report.applied_lines(applied), out)
    written = args.output or path
    return _verified(spark, written, None, out)


def verify(spark: SparkSession, args: Arguments, out: TextIO) -> int:
    return _verified(spark, args.need_path(), args.original, out)


def _verified(spark: SparkSession, path: str, original: str | None, out: TextIO) -> int:
    n = report.stream(report.issue_lines(library.verify_library(spark, path, original)), out)
    out.write("all checks passed\n" if n == 0 else f"{n} issues\n")
    return DONE if n == 0 else ISSUES


def run(spark: SparkSession, words: list[str], out: TextIO = sys.stdout, errors: TextIO = sys.stderr) -> int:
    """A command line without the program's name -> its code."""
    if not words:
        out.write(USAGE + "\n")
        return ERROR
    if words[0] in ("-h", "--help", "help"):
        out.write(USAGE + "\n")
        return DONE
    if words[0] in ("-V", "--version"):
        out.write(f"assetspark {version()}\nencoder: {encoders.status()}\n")
        return DONE
    try:
        args = parse(words[1:])
        if words[0] not in SPELLINGS:
            raise SettingError(f"no command is called '{words[0]}'; try --help")
        return {"analyze": analyze, "optimize": optimize, "verify": verify}[SPELLINGS[words[0]]](spark, args, out)
    except (SettingError, ContainerError, OSError, encoders.EncoderUnavailable, ValueError, PySparkException) as error:
        errors.write(f"error: {str(error).splitlines()[0]}\n")
        return ERROR


def main() -> int:
    threads = "*"
    if "--threads" in sys.argv[:-1]:
        threads = sys.argv[sys.argv.index("--threads") + 1]
    builder = SparkSession.builder.appName("assetspark")
    if "SPARK_MASTER" not in os.environ and threads.isdigit():
        builder = builder.master(f"local[{threads}]")
    return run(builder.getOrCreate(), sys.argv[1:])


if __name__ == "__main__":
    sys.exit(main())
