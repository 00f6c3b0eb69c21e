"""Encoders of surfaces by name: a protocol, a registry on the driver, and how a preference is resolved.

The chosen encoder is an object that travels to the workers with the task that uses it, so it must be picklable. The
portable encoder is always there. "auto" takes the first available other one and falls back to the portable for a
surface that it fails on; any other name is a demand, and an error where it can't be met.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol, runtime_checkable

import numpy as np

from assetspark.functions import blocks

#: The targets offered where a choice of format is free.
TARGETS = (98, 77, 71, 83, 80)
#: Effort of an encoder by quality.
EFFORTS = {"fast": 0.05, "balanced": 0.80, "best": 1.00}


class EncoderUnavailable(RuntimeError):
    pass


@runtime_checkable
class Encoder(Protocol):
    name: str

    def unavailable(self) -> str | None:
        """Why it can't be used here, or None."""

    def encode(self, surface: np.ndarray, code: int, effort: float) -> bytes:
        """A surface, (h, w, 4) RGBA, in a format."""


@dataclass(frozen=True)
class Portable:
    """The encoder in numpy."""

    name: str = "portable"

    def unavailable(self) -> str | None:
        return None

    def encode(self, surface: np.ndarray, code: int, effort: float) -> bytes:
        return blocks.encode(surface, code)


PORTABLE = Portable()
_REGISTERED: dict[str, Encoder] = {}
#: Other names of encoders.
ALIASES = {"managed": "portable"}


def register(encoder: Encoder) -> None:
    """Makes an encoder known to this driver, in place of another of its name."""
    if not isinstance(encoder, Encoder):
        raise TypeError("an encoder has name, unavailable() and encode()")
    if encoder.name in ("auto", PORTABLE.name, *ALIASES):
        raise ValueError(f"{encoder.name} is taken")
    _REGISTERED[encoder.name] = encoder


def forget(name: str) -> None:
    _REGISTERED.pop(name, None)


def names() -> list[str]:
    return ["auto", PORTABLE.name, *_REGISTERED]


@dataclass(frozen=True)
class Choice:
    """An encoder that a preference was resolved to; spare: what takes over for a surface on which it fails."""

    first: Encoder
    spare: Encoder | None = None

    @property
    def name(self) -> str:
        return self.first.name

    def encode(self, surface: np.ndarray, code: int, effort: float = EFFORTS["balanced"]) -> bytes:
        """One level, of just the bytes that its format and size say. Levels under a block's side are the portable encoder's."""
        h, w = surface.shape[:2]
        encoder = PORTABLE if w < 4 or h < 4 else self.first
        try:
            made = encoder.encode(surface, code, effort)
        except Exception:
            if self.spare is None or encoder is PORTABLE:
                raise
            made = self.spare.encode(surface, code, effort)
        expected = blocks.surface_size(w, h, code)
        if len(made) != expected:
            raise blocks.UnsupportedFormat(f"{encoder.name} made {len(made)} bytes of {w}x{h}, format {code} has {expected}")
        return made

    def encode_chain(self, surface: np.ndarray, code: int, mips: int, effort: float = EFFORTS["balanced"]) -> bytes:
        """Every level of a chain, each from the one before, the largest first."""
        out = [self.encode(surface, code, effort)]
        for _ in range(1, mips):
            surface = blocks.resample(surface, max(1, surface.shape[1] // 2), max(1, surface.shape[0] // 2))
            out.append(self.encode(surface, code, effort))
        return b"".join(out)


def resolve(preference: str = "auto") -> Choice:
    if preference == "auto":
        found = next((e for e in _REGISTERED.values() if e.unavailable() is None), None)
        return Choice(found, PORTABLE) if found else Choice(PORTABLE)
    name = ALIASES.get(preference, preference)
    if name == PORTABLE.name:
        return Choice(PORTABLE)
    if name not in _REGISTERED:
        raise EncoderUnavailable(f"{preference} was asked for but isn't registered; there are {', '.join(names())}")
    if why := _REGISTERED[name].unavailable():
        raise EncoderUnavailable(f"{preference} was asked for but can't be used: {why}")
    return Choice(_REGISTERED[name])


def status() -> str:
    """What "auto" resolves to, and why not to another."""
    chosen = resolve()
    others = [f"{e.name}: {e.unavailable()}" for e in _REGISTERED.values() if e.unavailable()]
    return chosen.name + (f" ({'; '.join(others)})" if others else "")
