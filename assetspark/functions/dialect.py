"""The few spellings in which Spark SQL and the checking database differ, and scalar rules written over them."""

from __future__ import annotations

from dataclasses import dataclass

from assetspark import formats

ALIGNMENT = 64
PREFIX_LEVELS_AT, PREFIX_LEVEL_BYTES = 20, 12


@dataclass(frozen=True)
class Dialect:
    name: str
    string: str

    def div(self, a: str, b: str) -> str:
        return f"({a} div {b})" if self.name == "spark" else f"({a} // {b})"

    def shr(self, a: str, b: str) -> str:
        return f"shiftright({a}, CAST({b} AS INT))" if self.name == "spark" else f"({a} >> CAST({b} AS INT))"

    def each(self, lo: str, hi: str, var: str, body: str) -> str:
        """The list of body for var from lo to hi, both included; lo is never above hi."""
        if self.name == "spark":
            return f"transform(sequence(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT)), {var} -> {body})"
        return f"list_transform(range(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT) + 1), lambda {var}: {body})"

    def total(self, values: str) -> str:
        return f"aggregate({values}, 0L, (acc, x) -> acc + x)" if self.name == "spark" else f"CAST(coalesce(list_sum({values}), 0) AS BIGINT)"

    def cut(self, values: str, skip: str, take: str | None = None) -> str:
        """values without the first skip, take of the rest."""
        if self.name == "spark":
            return f"slice({values}, CAST({skip} AS INT) + 1, CAST({take or f'size({values})'} AS INT))"
        return f"list_slice({values}, {skip} + 1, {f'{skip} + {take}' if take else f'len({values})'})"

    def bits(self, a: str) -> str:
        """The number of binary digits of a positive integer."""
        return f"CAST(length(bin({a})) AS BIGINT)"

    def text(self, expression: str) -> str:
        return expression.replace("{string}", self.string)

    # --- rules -------------------------------------------------------------------------------

    def align(self, v: str) -> str:
        return f"({self.div(f'({v} + {ALIGNMENT - 1})', str(ALIGNMENT))} * {ALIGNMENT})"

    def surface(self, code: str, w: str, h: str) -> str:
        blocks = f"greatest(1, {self.div(f'({w} + 3)', '4')}) * greatest(1, {self.div(f'({h} + 3)', '4')})"
        return f"(CASE WHEN {formats.is_block(code)} THEN {blocks} * {formats.block_bytes(code)} WHEN {formats.pixel_bytes(code)} > 0 THEN {w} * {h} * {formats.pixel_bytes(code)} END)"

    def chain(self, code: str, w: str, h: str, mips: str) -> str:
        """Bytes of every level, the largest first."""
        return self.each("0", f"greatest({mips}, 1) - 1", "i", f"CAST({self.surface(code, f'greatest(1, {self.shr(w, "i")})', f'greatest(1, {self.shr(h, "i")})')} AS BIGINT)")

    def levels_to_drop(self, w: str, h: str, mips: str, cap: str) -> str:
        over = self.each("0", f"greatest({mips}, 1) - 1", "i", f"CASE WHEN greatest({self.shr(w, 'i')}, {self.shr(h, 'i')}) > {cap} THEN 1L ELSE 0L END" if self.name == "spark" else f"CASE WHEN greatest({self.shr(w, 'i')}, {self.shr(h, 'i')}) > {cap} THEN 1 ELSE 0 END")
        return f"(CASE WHEN {cap} <= 0 OR {mips} <= 1 THEN 0 ELSE least({mips} - 1, {self.total(over)}) END)"

    def halvings(self, w: str, h: str, cap: str) -> str:
        """How often both sides halve while the larger is over cap and both are even and over 4: they stop for good."""
        still = " AND ".join(f"{self.shr(x, 'i')} % 2 = 0 AND {self.shr(x, 'i')} > 4" for x in (w, h))
        stops = self.each("0", "16", "i", f"CASE WHEN greatest({self.shr(w, 'i')}, {self.shr(h, 'i')}) > {cap} AND {still} THEN 99 ELSE i END")
        least = f"array_min({stops})" if self.name == "spark" else f"list_min({stops})"
        return f"(CASE WHEN {cap} <= 0 THEN 0 ELSE {least} END)"

    def can_describe(self, prefix: str, mips: str) -> str:
        return f"({PREFIX_LEVELS_AT} + {PREFIX_LEVEL_BYTES} * {mips} <= {prefix})"

    def exact_565(self, r: str, g: str, b: str, a: str) -> str:
        five = lambda v: f"{self.div(v, '8')} * 8 + {self.div(v, '32')} = {v}"
        return f"({a} = 255 AND {five(r)} AND {self.div(g, '4')} * 4 + {self.div(g, '64')} = {g} AND {five(b)})"

    def verdict(self, db: str) -> str:
        """A code for a loss in dB: unknown where it isn't measured, exact where it has no finite value, then by falling quality."""
        return f"(CASE WHEN {db} IS NULL OR isnan({db}) THEN 'unknown' WHEN {db} = CAST('Infinity' AS DOUBLE) THEN 'exact' WHEN {db} >= 45 THEN 'band-45' WHEN {db} >= 36 THEN 'band-36' WHEN {db} >= 30 THEN 'band-30' ELSE 'below-30' END)"

    def human_bytes(self, v: str) -> str:
        """In the largest unit up to GiB of which it holds one, to a decimal; integer tenths, halves up."""
        tenth = lambda unit: self.div(f"(CAST({v} AS BIGINT) * 10 + {unit // 2})", str(unit))
        shown = lambda unit, name: f"concat(CAST({self.div(tenth(unit), '10')} AS {self.string}), '.', CAST({tenth(unit)} % 10 AS {self.string}), ' {name}')"
        return f"(CASE WHEN {v} < 1024 THEN concat(CAST({v} AS {self.string}), ' B') WHEN {v} < 1048576 THEN {shown(1 << 10, 'KiB')} WHEN {v} < 1073741824 THEN {shown(1 << 20, 'MiB')} ELSE {shown(1 << 30, 'GiB')} END)"


SPARK = Dialect("spark", "STRING")
DUCK = Dialect("duck", "VARCHAR")
