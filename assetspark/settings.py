"""Settings of a run: what may be chosen, how the choices are spelled, and how one pulls others along."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from assetspark.operators.plan import Options

#: Choices offered for the cap and the floor, 0 for none.
CAPS = (0, 4096, 2048, 1024, 512)
FLOORS = (0, 2048, 1024, 512, 256, 128, 64)
#: Spellings of each choice, the first being its name.
STRATEGIES = {"balanced": ("balanced",), "quality": ("quality", "max"), "smallest": ("smallest", "small")}
QUALITIES = {"fast": ("fast",), "balanced": ("balanced",), "best": ("best",)}
MIPS = {"keep": ("keep", "chain", "keep-chain"), "single": ("single", "one", "drop-chain")}


class SettingError(ValueError):
    pass


@dataclass(frozen=True)
class Settings:
    """follows: that generate is on because of the floor, and goes off with it."""

    strategy: str = "balanced"
    quality: str = "balanced"
    encoder: str = "auto"
    collapse: bool = True
    share: bool = True
    cap: int = 0
    floor: int = 0
    single: bool = False
    generate: bool = False
    follows: bool = False

    def options(self) -> Options:
        return Options(strategy=self.strategy, collapse=self.collapse, cap=self.cap, single=self.single, floor=self.floor, generate=self.generate)

    @property
    def replans(self) -> tuple:
        """What a plan depends on: plans are kept while this is the same. Sharing is decided when a plan is applied."""
        return (self.strategy, self.collapse, self.cap, self.floor, self.single, self.generate)

    @property
    def may_choose_mips(self) -> bool:
        """A streamed chain is always kept."""
        return self.floor == 0


def floors_for(cap: int) -> tuple[int, ...]:
    """The floors that do something under a cap, and none."""
    return tuple(f for f in FLOORS if f == 0 or cap == 0 or f < cap)


# --- couplings -----------------------------------------------------------------------------------
# A coupling looks at settings one of which was changed, by hand or by another coupling, and says what changes with it.


def _floor_keeps_the_chain(s: Settings, by_hand: bool, chained: int | None) -> dict:
    return {"single": False} if s.floor else {}


def _floor_needs_chains(s: Settings, by_hand: bool, chained: int | None) -> dict:
    if s.floor and not s.generate:
        return {"generate": True, "follows": True}
    return {"generate": False, "follows": False} if not s.floor and s.follows else {}


def _cap_pulls_the_floor(s: Settings, by_hand: bool, chained: int | None) -> dict:
    if s.floor and s.cap and s.floor >= s.cap:
        return {"floor": next((f for f in floors_for(s.cap) if f), 0)}
    return {}


def _generating_by_hand(s: Settings, by_hand: bool, chained: int | None) -> dict:
    """A choice by hand stands from then on. Without it, and with nothing chained, a floor would reach nothing."""
    if not by_hand:
        return {}
    return {"follows": False} | ({"floor": 0} if not s.generate and s.floor and chained == 0 else {})


#: What each setting pulls along.
COUPLINGS: dict[str, tuple[Callable[[Settings, bool, int | None], dict], ...]] = {
    "floor": (_floor_keeps_the_chain, _floor_needs_chains),
    "cap": (_cap_pulls_the_floor,),
    "generate": (_generating_by_hand,),
}


def changed(settings: Settings, chained: int | None = None, **edits) -> Settings:
    """settings after edits by hand, one after the other, each with all that it pulls along, until nothing changes more.

    chained: textures with a chain in what is looked at, None if that isn't known.
    """
    for name, value in edits.items():
        settings = replace(settings, **{name: value})
        due = [(name, True)]
        while due:
            this, by_hand = due.pop(0)
            for coupling in COUPLINGS.get(this, ()):
                pulled = {k: v for k, v in coupling(settings, by_hand, chained).items() if getattr(settings, k) != v}
                settings = replace(settings, **pulled)
                due += [(k, False) for k in pulled]
    return settings


# --- arguments -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Arguments:
    path: str | None = None
    output: str | None = None
    backup: str | None = None
    original: str | None = None
    threads: int | None = None
    dry_run: bool = False
    settings: Settings = field(default_factory=Settings)

    def need_path(self) -> str:
        if self.path is None:
            raise SettingError("a path is needed")
        return self.path


def choice(value: str, choices: dict[str, tuple[str, ...]], what: str) -> str:
    found = next((name for name, spellings in choices.items() if value.lower() in spellings), None)
    if found is None:
        raise SettingError(f"no {what} is called '{value}'; there are {', '.join(choices)}")
    return found


def side(value: str, option: str) -> int:
    """A power of two of at least 4."""
    n = int(value) if value.isascii() and value.isdigit() else 0
    if n < 4 or n & (n - 1):
        raise SettingError(f"{option} needs a power of two of at least 4, not '{value}'")
    return n


def positive(value: str, option: str) -> int:
    n = int(value) if value.isascii() and value.isdigit() else 0
    if n < 1:
        raise SettingError(f"{option} needs a positive whole number, not '{value}'")
    return n


FLAGS = {"--dry-run": ("dry_run", True), "--no-collapse": ("collapse", False), "--no-dedup": ("share", False), "--add-mips": ("generate", True)}
VALUES: dict[str, tuple[str, Callable[[str], object]]] = {
    "--output": ("output", str), "--backup": ("backup", str), "--original": ("original", str), "--threads": ("threads", lambda v: positive(v, "--threads")), "--encoder": ("encoder", str.lower),
    "--max-size": ("cap", lambda v: side(v, "--max-size")), "--stream": ("floor", lambda v: side(v, "--stream")), "--mips": ("single", lambda v: choice(v, MIPS, "mip mode") == "single"),
    "--strategy": ("strategy", lambda v: choice(v, STRATEGIES, "strategy")), "--quality": ("quality", lambda v: choice(v, QUALITIES, "quality")),
}


def parse(words: list[str]) -> Arguments:
    """Arguments from a command line without its command. Options are taken as they stand, without couplings."""
    held: dict[str, object] = {}
    left = list(words)
    while left:
        word = left.pop(0)
        if word in FLAGS:
            name, value = FLAGS[word]
        elif word in VALUES:
            if not left:
                raise SettingError(f"{word} needs a value")
            name, read = VALUES[word]
            value = read(left.pop(0))
        elif word.startswith("-"):
            raise SettingError(f"no option is called '{word}'")
        elif "path" in held:
            raise SettingError("only one path may be given")
        else:
            name, value = "path", word
        held[name] = value
    own = {k: held.pop(k) for k in list(held) if k in Settings.__dataclass_fields__}
    return Arguments(**held, settings=Settings(**own))  # type: ignore[arg-type]
