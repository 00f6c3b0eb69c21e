"""Personal data: regular expressions propose spans, checksums confirm them, words near them adjust a score.

A kind has a score of its own; a context word of the kind that stands within CONTEXT code points before or after the
span, up to the next match of the kind, adds NEAR. Spans of the added kinds stay where the score reaches `least`, so
account numbers, which a checksum confirms, stay anywhere, local phone numbers and secrets only near a context word.
Spans of the base kinds always stay; their score is reported.

Everything is a column expression, so a row is handled where it is read: no shuffle, no state, whole texts.
Null and empty texts have no spans. Rows are handled one by one: repeated rows, also those without doc_id, give
repeated results; other columns are left as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points on either side of a span in which context words count, and what one adds to the score.
CONTEXT, NEAR, LEAST = 40, 0.3, 0.5
SPAN = "array<struct<kind:string,rank:int,start:int,end:int,value:string,before:string,after:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of value pass the Luhn check."""
    d = F.reverse(_digits(value))
    doubled = lambda i: F.substring(d, i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), lambda a, i: a + F.when(doubled(i) > 9, doubled(i) - 9).otherwise(doubled(i)))
    return (F.length(d) > 0) & (total % 10 == 0)


def mod97(value: Column) -> Column:
    """Whether value, an international account number, leaves 1 when divided by 97."""
    v = F.regexp_replace(F.upper(value), "[^0-9A-Z]", "")
    turned = F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4))
    step = lambda a, i: F.ascii(F.substring(turned, i, 1)) - F.when(F.substring(turned, i, 1) >= "A", 55).otherwise(48)
    rest = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(turned), F.lit(1))), F.lit(0), lambda a, i: (a * F.when(step(a, i) > 9, 100).otherwise(10) + step(a, i)) % 97)
    return F.length(v).between(15, 34) & (rest == 1)


def _parts_below_256(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.lpad(F.regexp_replace(p, "^0+", ""), 3, "0") <= "255"))


@dataclass(frozen=True)
class Kind:
    """pattern proposes, valid confirms; guard tells cheaply that a text may hold any.

    Patterns start only where a run of their first characters starts or where the last match ended, and repeat
    possessively: the same leftmost matches as without, in a time linear in the text.
    """

    name: str
    pattern: str
    guard: str
    valid: object
    score: float
    context: tuple[str, ...] = field(default_factory=tuple)


PHONE_WORDS = ("phone", "telephone", "tel", "call", "mobile", "fax", "téléphone", "telefon", "teléfono")
#: The base kinds in their order, then what the operator adds.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda v: F.lit(True), 0.7, ("mail", "email", "e-mail", "contact", "courriel")),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", _parts_below_256, 0.5, ("ip", "host", "server", "address", "addr")),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+", "[0-9]", lambda v: F.length(_digits(v)).between(14, 19) & luhn(v), 0.6, ("card", "visa", "credit", "carte", "karte", "tarjeta")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", lambda v: F.length(_digits(v)).between(10, 15), 0.6, PHONE_WORDS),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", mod97, 0.7, ("iban", "account", "bank", "konto", "cuenta", "compte")),
    Kind("local_phone", r"(?<![0-9+)(\x20-]\x20)(?<![0-9+(])\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}(?![0-9-])", r"\([0-9]{3}\)", lambda v: F.lit(True), 0.4, PHONE_WORDS),
    Kind("secret", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+(?![A-Za-z0-9+/_-])", "[A-Za-z0-9+/_-]{20}", lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]"), 0.4, ("token", "secret", "password", "passwd", "pwd", "key", "api_key", "apikey", "credential", "bearer")),
)
BASE = ("email", "ip", "card", "phone")
#: Matches whose spans are gathered in one list, which is copied as it grows.
PART = 256


def _bound(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _proposed(text: Column, kind: Kind, rank: int) -> Column:
    """The confirmed spans of one kind in reading order. Places come from the pieces between the matches."""
    none = F.array().cast(SPAN)

    def add(acc, piece):
        start = acc["at"] + F.length(piece["gap"])
        end = start + F.coalesce(F.length(piece["hit"]), F.lit(0))
        sides = F.right(piece["gap"], F.lit(CONTEXT)).alias("before"), F.left(piece["next"], F.lit(CONTEXT)).alias("after")
        span = F.struct(F.lit(kind.name).alias("kind"), F.lit(rank).alias("rank"), start.alias("start"), end.alias("end"), piece["hit"].alias("value"), *sides)
        keep = F.coalesce(kind.valid(piece["hit"]), F.lit(False)) & piece["hit"].isNotNull()
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    def spans(gaps):
        """Pieces in parts of PART: a part starts where the parts before it end, so no list but a part's own grows by one at a time."""
        pieces = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hit"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next"))
        return _bound(pieces, lambda all_pieces: _bound(F.transform(F.sequence(F.lit(0), F.floor((F.size(all_pieces) - 1) / PART).cast("int")), lambda i: F.slice(all_pieces, i * PART + 1, F.lit(PART))), of_parts))

    def of_parts(parts):
        length = lambda piece: F.length(piece["gap"]) + F.coalesce(F.length(piece["hit"]), F.lit(0))
        lengths = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda acc, piece: acc + length(piece)))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(lengths, first, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])
        found = lambda part, at: F.aggregate(part, F.struct(at.alias("at"), none.alias("found")), add, lambda acc: acc["found"])
        return F.flatten(F.zip_with(parts, starts, found))

    guard = F.contains(text, F.lit("@")) if kind.guard == "@" else text.rlike(kind.guard)
    return F.when(guard, _bound(F.split(text, kind.pattern, -1), spans)).otherwise(none)


def near_word(kind: Kind, side: Column) -> Column:
    """Whether one of the kind's context words stands in side as a whole word."""
    return F.lower(side).rlike(r"(?<![\p{L}0-9])(?:" + "|".join(kind.context) + r")(?![\p{L}0-9])")


def _scored(spans: Column) -> Column:
    def score(s):
        total = F.lit(0.0)
        for kind in KINDS:
            near = near_word(kind, s["before"]) | F.coalesce(near_word(kind, s["after"]), F.lit(False))
            total = F.when(s["kind"] == kind.name, F.least(F.lit(1.0), F.lit(kind.score) + F.when(near, NEAR).otherwise(0.0))).otherwise(total)
        return F.round(total, 2)

    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), score(s).alias("score")))


def find_pii(df: DataFrame, text: str = "text", out: str = "pii", least: float = LEAST) -> DataFrame:
    """df with column out: array of (kind, rank, start, end, value, score), by start, then kind as listed in KINDS.

    Places count code points, ends are exclusive. Spans of the added kinds with a score under least are left out.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({f"__pii_{k.name}": _proposed(whole, k, i) for i, k in enumerate(KINDS)})
    every = F.concat(*(F.col(f"__pii_{k.name}") for k in KINDS))
    kept = F.filter(_scored(every), lambda s: s["kind"].isin(*BASE) | (s["score"] >= least))
    order = F.array_sort(kept, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]))
    return df.withColumn(out, order).drop(*(f"__pii_{k.name}" for k in KINDS))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """Per row of docs: counts of the base kinds, the digest of their spans, all spans as text, their number and scores."""
    found = find_pii(docs.select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    count = lambda name: F.size(F.filter("pii", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    scores = F.array_join(F.transform("pii", lambda s: s["score"].cast("decimal(3,2)").cast("string")), ",")
    return found.select("doc_id", *(count(name) for name in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"), scores.alias("scores"))
