"""Settings and their couplings, encoders by name, progress, reports and commands."""

import io
import os
import threading
import time
from dataclasses import dataclass

import numpy as np
import pytest

from assetspark import commands, settings
from assetspark.functions import blocks, encoders
from assetspark.operators import library, report
from assetspark.progress import Cancelled, Progress
from assetspark.settings import Settings, changed, parse
from assetspark.sources import synthetic
from assetspark.sources.container import GPU

# --- settings ------------------------------------------------------------------------------------


def test_a_floor_turns_generation_on_and_off_again():
    s = changed(Settings(single=True), floor=512)
    assert s.generate and s.follows and not s.single and not s.may_choose_mips
    assert changed(s, floor=0) == Settings()
    assert changed(changed(Settings(generate=True), floor=512), floor=0).generate


def test_a_choice_by_hand_stands():
    s = changed(changed(Settings(), floor=512), chained=3, generate=False)
    assert not s.generate and s.floor == 512 and not changed(s, floor=0).generate
    assert changed(changed(Settings(), floor=512), chained=0, generate=False).floor == 0
    assert changed(changed(Settings(), floor=512), generate=False).floor == 512
    on = changed(changed(Settings(), floor=512), generate=True)
    assert changed(on, floor=0).generate


def test_a_cap_pulls_the_floor_below_it():
    s = changed(changed(Settings(), floor=2048), cap=1024)
    assert s.floor == 512 and s.generate and changed(s, cap=0).floor == 512
    assert all(0 in settings.floors_for(c) and all(f < c or not c for f in settings.floors_for(c)) for c in settings.CAPS)
    assert changed(changed(Settings(), floor=64), cap=64) == Settings(cap=64)  # no floor is left: generation goes with it


def test_what_needs_a_new_plan():
    assert Settings().replans == changed(Settings(), share=False, quality="best").replans != changed(Settings(), cap=512).replans


@pytest.mark.parametrize(("words", "found"), [
    (["--strategy", "MAX"], {"strategy": "quality"}), (["--strategy", "small"], {"strategy": "smallest"}), (["--strategy", "balanced"], {}), (["--quality", "Best"], {"quality": "best"}), (["--quality", "fast"], {"quality": "fast"}),
    (["--mips", "one"], {"single": True}), (["--mips", "drop-chain"], {"single": True}), (["--mips", "single"], {"single": True}), (["--mips", "keep-chain"], {}), (["--mips", "chain"], {}), (["--mips", "keep"], {}),
    (["--max-size", "1024", "--stream", "4"], {"cap": 1024, "floor": 4}), (["--no-collapse", "--no-dedup", "--add-mips"], {"collapse": False, "share": False, "generate": True}), (["--encoder", "Managed"], {"encoder": "managed"}),
])
def test_options(words, found):
    assert parse(words).settings == Settings(**found)


def test_arguments_and_errors():
    a = parse(["x", "--output", "o", "--backup", "b", "--original", "p", "--threads", "3", "--dry-run"])
    assert (a.path, a.output, a.backup, a.original, a.threads, a.dry_run) == ("x", "o", "b", "p", 3, True)
    for words in (["--max-size", "100"], ["--stream", "2"], ["--stream", "-8"], ["--threads", "0"], ["--threads", "x"], ["--strategy", "none"], ["--mips", "x"], ["--quality", "x"], ["--what"], ["a", "b"], ["--output"]):
        with pytest.raises(settings.SettingError):
            parse(words)
    with pytest.raises(settings.SettingError):
        parse([]).need_path()
    assert commands.version("1.2.3+abc") == "1.2.3"


# --- encoders ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Marking:
    """An encoder that marks what it makes, fails on some formats, or can't be used."""

    name: str = "marking"
    why: str | None = None

    def unavailable(self):
        return self.why

    def encode(self, surface, code, effort):
        if code == 77:
            raise RuntimeError("declined")
        return bytes([7]) * (blocks.surface_size(surface.shape[1], surface.shape[0], code) - (code == 80))


@pytest.fixture()
def registry():
    yield encoders
    for name in ("marking", "missing"):
        encoders.forget(name)


def test_encoders_are_resolved_by_name(registry):
    assert encoders.resolve().name == encoders.resolve("managed").name == encoders.resolve("portable").name == "portable"
    with pytest.raises(encoders.EncoderUnavailable, match="isn't registered"):
        encoders.resolve("marking")
    encoders.register(Marking("missing", "no library"))
    with pytest.raises(encoders.EncoderUnavailable, match="no library"):
        encoders.resolve("missing")
    assert encoders.resolve().name == "portable" and "no library" in encoders.status()
    encoders.register(Marking())
    auto, asked = encoders.resolve(), encoders.resolve("marking")
    s = np.zeros((8, 8, 4), np.uint8)
    assert auto.name == asked.name == "marking" and auto.encode(s, 71) == bytes([7]) * 32
    assert auto.encode(s, 77) == blocks.encode(s, 77)  # auto falls back
    for code, error in ((77, "declined"), (80, "made 31 bytes")):
        with pytest.raises(Exception, match=error):
            asked.encode(s, code)
    chain = asked.encode_chain(s, 71, 4)
    assert chain[:40] == bytes([7]) * 40 and chain[40:] == blocks.encode_chain(s, 71, 4)[40:]  # levels under a block are portable
    with pytest.raises(ValueError):
        encoders.register(Marking("auto"))
    with pytest.raises(TypeError):
        encoders.register("x")
    assert all(blocks.BLOCK_BYTES[c] for c in encoders.TARGETS)


# --- progress ------------------------------------------------------------------------------------


def test_progress_counts_tasks_and_stops(spark):
    seen = []
    progress = Progress(spark, seen.append, every=0.02)
    with progress.step("count"):
        spark.range(0, 4000, 1, 8).selectExpr("sum(id)").collect()
    assert seen[-1].step == "count" and seen[-1].done == seen[-1].total >= 8
    assert all(a.done <= b.done for a, b in zip(seen, seen[1:], strict=False))
    threading.Timer(1.0, progress.cancel).start()
    began = time.time()

    def slow(batches):
        for b in batches:
            time.sleep(30)
            yield b

    with pytest.raises(Cancelled), progress.step("slow"):
        spark.range(8).mapInArrow(slow, "id long").count()
    assert time.time() - began < 25
    with pytest.raises(Cancelled), progress.step("never"):
        raise AssertionError("a cancelled run begins no step")
    assert spark.range(5).count() == 5


# --- commands ------------------------------------------------------------------------------------


@pytest.fixture()
def root(tmp_path):
    (tmp_path / "in/Mod").mkdir(parents=True)
    plain = synthetic.plain_texture(32, 32, lambda x, y: (x * 8, y * 8, (x ^ y) * 8, 255))
    synthetic.write_bundle(tmp_path / "in/Mod/a", [synthetic.opaque(700, 1), plain, plain, synthetic.plain_texture(6, 6, lambda x, y: (x, y, 0, 255))], stream=None)
    return str(tmp_path / "in")


def command(spark, *words):
    out, errors = io.StringIO(), io.StringIO()
    return commands.run(spark, list(words), out, errors), out.getvalue(), errors.getvalue()


def test_analyze_reports_a_plan(spark, root):
    before = os.path.getsize(f"{root}/Mod/a{GPU}")
    code, out, _ = command(spark, "analyse", f"{root}/Mod/a", "--max-size", "16")
    lines = out.splitlines()
    assert code == 0 and os.path.getsize(f"{root}/Mod/a{GPU}") == before
    assert lines[0] == "encoder: portable" and lines[1].endswith("a: 4 entries, 2 types") and lines[2:4] == ["     1 x unit", "     3 x texture"] or lines[2:4] == ["     3 x texture", "     1 x unit"]
    rows = [x for x in lines if "->" in x and x.startswith("0000")]
    assert len(rows) == 2 and all("32x32->16x16" in r and "BC1_UNORM" in r and "4.0 KiB ->      128 B  opaque; halving" in r for r in rows)
    assert sum("skipped: dimensions" in x and "6x6 R8G8B8A8_UNORM" in x for x in lines) == 1
    assert "duplicates: 1 payloads are held again, 4.0 KiB" in lines and lines[-2].startswith("disk") and lines[-1].startswith("gpu")


def test_optimize_writes_verifies_and_then_has_nothing_to_do(spark, root, tmp_path):
    assert command(spark, "optimize", root, "--dry-run")[1].endswith("dry run: nothing written\n")
    code, out, errors = command(spark, "optimize", root)
    assert (code, errors) == (0, "") and "backed up 2 files" in out and "  encode...\n  write...\n" in out and out.endswith("all checks passed\n")
    assert os.path.exists(f"{root}/Mod/backup/a{GPU}")
    assert command(spark, "verify", f"{root}/Mod/a", "--original", f"{root}/Mod/backup/a")[0] == 0
    assert command(spark, "optimise", root)[1].endswith("nothing to do\n")
    os.truncate(f"{root}/Mod/a{GPU}", 100)
    code, out, _ = command(spark, "verify", root)
    assert code == 2 and "[bounds]" in out and out.splitlines()[-1].endswith("issues")
    code, _, errors = command(spark, "optimize", root, "--strategy", "smallest")
    assert code in (0, 1)


def test_codes_of_errors(spark, root, tmp_path):
    assert command(spark)[0] == 1 and command(spark, "--help")[0] == 0 and command(spark, "--version")[1].startswith("assetspark ")
    for words in (["dance", root], ["analyze"], ["analyze", root + "/none"], ["optimize", root, "--encoder", "nowhere"], ["verify", root, "--what"]):
        code, _, errors = command(spark, *words)
        assert code == 1 and errors.startswith("error: "), words
    (tmp_path / "bad").write_bytes(b"\x11\0\0\xf0" + bytes(90))
    (tmp_path / f"bad{GPU}").write_bytes(b"")
    assert command(spark, "analyze", str(tmp_path / "bad"))[0] in (0, 1)


def test_lines_are_saved_in_order(spark, root, tmp_path):
    entries = library.entries_of(spark, root)
    plan = library.plan_of(entries)
    lines = report.plan_lines(entries, plan, library.predicted(entries, plan))
    report.save(lines, str(tmp_path / "out"))
    streamed = io.StringIO()
    n = report.stream(lines, streamed)
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    assert "".join(p.read_text() for p in parts) == streamed.getvalue() and streamed.getvalue().count("\n") == n > 5
