"""A convolutional text classifier for toxicity, in numpy.

Words and their first four and five bytes are hashed into one embedding table; filters of several widths run over the
words of a whole text, each pooled by its maximum; a logistic layer weighs the maxima. The table starts from how far a
hashed feature's labelled documents depart from the rest, and everything is then trained by gradient steps.

Trained on the driver on a bounded sample: at most SAMPLE labelled rows and SAMPLE_BYTES of text, those of the lowest
hash of doc_id among the rows the caller offers. Scoring runs in Arrow batches on the executors, on all rows and whole texts. The language that
calibrates a threshold is guessed from the text's own function words, so scores depend on texts alone.

Null and empty texts have a score (no evidence). Every row is scored, repeated ones and those without doc_id alike. Without labels of both kinds every
score is 0. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from assetspark.llm.common import NOT_WORD, WordHasher, forget, in_slices, settle, utf8

SAMPLE, SAMPLE_BYTES = 6000, 64 << 20
THRESHOLD = 0.7
BITS, DIM, FILTERS, WIDTHS = 16, 8, 8, (1, 2, 3)
PADS = max(WIDTHS) - 1
CHUNK = 1 << 18
#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was on with as are be this by from at an".split(),
    "fr": "le la les de des et un une du en que qui dans pour par sur est au avec pas".split(),
    "de": "der die das und den von zu mit ist des im für auf nicht ein eine dem sich auch als".split(),
    "es": "el los las de que y en un por con su para al lo como más pero sus una del".split(),
}


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    out, size = [], 0
    for t in texts:
        if out and size + len(t) > CHUNK:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t)
    if out:
        yield out


class Features:
    """Texts as rows of hashed feature ids, a document's words followed by PADS empty rows."""

    def __init__(self):
        self.hasher = WordHasher(NOT_WORD)
        self.languages = [np.sort(self.hasher([" ".join(w).encode()])[0]) for w in FUNCTION_WORDS.values()]

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids: 3 columns, 0 in pads; number of words of each text; guessed language of each text)."""
        words, counts, five = self.hasher(texts, 5)
        _, _, four = self.hasher(texts, 4)
        mask = np.uint64((1 << BITS) - 1)
        ids = np.stack([words & mask, (four * np.uint64(3)) & mask, (five * np.uint64(5)) & mask], 1).astype(np.int64) + 1
        starts = np.cumsum(counts + PADS) - counts - PADS
        out = np.zeros((int(counts.sum()) + PADS * len(counts), 3), dtype=np.int64)
        where = np.arange(len(words)) + np.repeat(PADS * np.arange(len(counts)), counts)
        out[where] = ids
        doc = np.repeat(np.arange(len(counts)), counts)
        hits = np.stack([np.bincount(doc[_member(words, lang)], minlength=len(counts)) for lang in self.languages], 1)
        language = np.where(hits.max(1) > 0, hits.argmax(1), len(self.languages))
        return out, counts, language


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]
    shifts: list[np.ndarray]
    weights: np.ndarray
    bias: float
    cut: np.ndarray  # by guessed language

    def pooled(self, ids: np.ndarray, counts: np.ndarray):
        """Maxima of each filter over each text, and where they stand."""
        x = self.table[ids[:, 0]] + self.table[ids[:, 1]] + self.table[ids[:, 2]]
        starts = np.cumsum(counts + PADS) - counts - PADS
        pad = ids[:, 0] == 0
        best = []
        for width, filters, shift in zip(WIDTHS, self.filters, self.shifts, strict=True):
            y = x @ filters[0]
            for k in range(1, width):
                y[:-k] += x[k:] @ filters[k]
            y += shift
            np.maximum(y, 0, out=y)
            y[pad] = 0
            best.append(np.maximum.reduceat(y, starts, axis=0) if len(starts) else np.zeros((0, FILTERS), np.float32))
        return x, np.concatenate(best, 1)

    def logits(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.pooled(ids, counts)[1] @ self.weights + self.bias

    def scores(self, texts: list[bytes], features: Features) -> np.ndarray:
        out = []
        for chunk in _chunks(texts):
            ids, counts, language = features(chunk)
            z = self.logits(ids, counts) - self.cut[language] + np.log(THRESHOLD / (1 - THRESHOLD))
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def _evidence(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """For each hashed feature the signed root of the likelihood ratio of its documents' labels against all labels."""
    n, toxic = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for ids, y in zip(docs, labels, strict=True):
        u = np.unique(ids)
        n[u] += 1
        toxic[u] += y
    p = labels.mean()
    q = toxic / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = np.where(toxic > 0, toxic * np.log(q / p), 0) + np.where(n > toxic, (n - toxic) * np.log((1 - q) / (1 - p)), 0)
    out = np.where(q > p, 1, -1) * np.sqrt(np.maximum(g, 0))
    out[0] = 0
    return np.clip(out / 4, -2, 2)


def gradients(model: Model, ids: np.ndarray, counts: np.ndarray, labels: np.ndarray):
    """The slopes of the mean cross entropy of a batch: of filters, shifts and weights, of the bias, and the table's rows with theirs."""
    starts = np.cumsum(counts + PADS) - counts - PADS
    x, top = model.pooled(ids, counts)
    z = top @ model.weights + model.bias
    d = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - labels) / len(labels)
    by_filter, by_shift = [np.zeros_like(f) for f in model.filters], [np.zeros_like(s) for s in model.shifts]
    touched, pulled = [], []
    for w, width in enumerate(WIDTHS):
        cols = slice(w * FILTERS, (w + 1) * FILTERS)
        y = x @ model.filters[w][0]
        for k in range(1, width):
            y[:-k] += x[k:] @ model.filters[w][k]
        y += model.shifts[w]
        y[ids[:, 0] == 0] = -1
        for b in np.flatnonzero(counts):
            at = starts[b] + y[starts[b] : starts[b] + counts[b]].argmax(0)
            g = (d[b] * model.weights[cols] * (top[b, cols] > 0)).astype(np.float32)
            by_shift[w] += g
            for k in range(width):
                by_filter[w][k] += (x[at + k] * g[:, None]).T
                for c in range(3):
                    touched.append(ids[at + k, c])
                    pulled.append(model.filters[w][k].T * g[:, None])
    rows, inverse = np.unique(np.concatenate(touched), return_inverse=True) if touched else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    by_row = np.zeros((len(rows), DIM), np.float32)
    if touched:
        np.add.at(by_row, inverse, np.concatenate(pulled))
    by_row[rows == 0] = 0
    return [*by_filter, *by_shift, (top.T @ d).astype(np.float32)], float(d.sum()), rows, by_row


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, dtype=np.float64)
    features = Features()
    parts = [features([t]) for t in texts]
    order = rng.permutation(len(texts))
    kept, fit = order[: len(order) // 5], order[len(order) // 5 :]
    table = rng.normal(0, 0.05, ((1 << BITS) + 1, DIM)).astype(np.float32)
    table[:, 0] = _evidence([parts[i][0] for i in fit], labels[fit])
    table[0] = 0
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, 0, : FILTERS // 2] = 1.0
    shifts = [np.full(FILTERS, -0.3, np.float32) for _ in WIDTHS]
    weights = np.full(FILTERS * len(WIDTHS), 0.1, np.float32)
    model = Model(table, filters, shifts, weights, -2.0, np.zeros(len(FUNCTION_WORDS) + 1))
    slots = [table, *filters, *shifts, weights]
    squares = [np.full_like(s, 1e-4) for s in slots]
    bias_square = 1e-4
    for _ in range(epochs):
        rng.shuffle(fit)
        for i in range(0, len(fit), batch):
            chosen = fit[i : i + batch]
            ids, counts = np.concatenate([parts[j][0] for j in chosen]), np.concatenate([parts[j][1] for j in chosen])
            dense, by_bias, rows, by_row = gradients(model, ids, counts, labels[chosen])
            grads = [None, *dense]
            for s, (slot, square, g) in enumerate(zip(slots, squares, grads, strict=True)):
                if s:
                    square += g * g
                    slot -= rate * g / np.sqrt(square)
            squares[0][rows] += by_row * by_row
            table[rows] -= rate * by_row / np.sqrt(squares[0][rows])
            bias_square += by_bias**2
            model.bias -= rate * by_bias / np.sqrt(bias_square)
    model.cut = _calibrated(model, [parts[i] for i in kept], labels[kept])
    return model


def _calibrated(model: Model, parts: list, labels: np.ndarray) -> np.ndarray:
    """For each guessed language the logit above which the F1 of the kept rows is best, halfway to the next lower one.

    A language with few toxic rows among the kept ones takes the cut of all.
    """
    z = np.array([model.logits(p[0], p[1])[0] for p in parts])
    language = np.array([p[2][0] for p in parts])

    def best(z: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(-z)
        z, y = z[order], y[order]
        right = np.cumsum(y)
        f1 = 2 * right / (np.arange(1, len(y) + 1) + y.sum())
        k = int(np.argmax(f1))
        return float((z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 0.5)

    whole = best(z, labels) if labels.sum() else 0.0
    cut = np.full(len(model.cut), whole)
    for k in range(len(cut)):
        if labels[language == k].sum() >= 5:
            cut[k] = best(z[language == k], labels[language == k])
    return cut


def part_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> Model | None:
    """A model from labelled rows whose crc32(doc_id as text) mod 3 is not 1; None if they aren't of both kinds.

    At most `sample` rows of distinct (doc_id, text, label) and `most` bytes of text, in the order of a hash of doc_id,
    so that neither repeated doc_ids nor very long texts grow what the driver holds. A text of more than a hundredth of
    these bytes is no sample: it would stand in the place of many.
    """
    order = [F.xxhash64("doc_id"), "doc_id", "toxic"]
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (part_of(F.col("doc_id")) != 1)).select("doc_id", "toxic").distinct()
    first = usable.orderBy(*order).limit(sample)  # of bounded size, here and below
    tied = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    held = tied.select("doc_id", "tie", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(F.broadcast(first), "doc_id").filter(F.col("size") <= most // 100).distinct().orderBy(*order, "tie").limit(sample)
    upto = F.sum("size").over(Window.orderBy(*order, "tie"))
    chosen = settle(held.withColumn("upto", upto).filter(F.col("upto") <= most).select("doc_id", F.col("tie").alias("of"), "toxic"))
    texts = tied.join(F.broadcast(chosen.select("doc_id", "of").distinct()), ["doc_id"]).filter(F.col("tie").eqNullSafe(F.col("of"))).groupBy("doc_id", "of").agg(F.first("text").alias("text"))
    rows = texts.join(F.broadcast(chosen), ["doc_id", "of"]).select("doc_id", "of", "text", "toxic").toPandas()
    rows = rows.sort_values(["doc_id", "of", "toxic"], kind="stable").reset_index(drop=True)
    y = rows["toxic"].to_numpy() if len(rows) else np.zeros(0)
    if len(set(y)) < 2:
        return None
    return train([(t or "").encode() for t in rows["text"]], y)


def score(docs: DataFrame, model: Model | None, out: str = "toxicity") -> DataFrame:
    """docs with a score from 0 to 1 of each text; it replaces a column of its name."""
    docs = docs.drop(out)
    schema = StructType([*docs.schema.fields, StructField(out, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        features = Features()
        for rows in in_slices(batches):
            scores = model.scores(utf8(rows.column("text")), features) if model else np.zeros(rows.num_rows)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(scores, pa.float64())], [*rows.schema.names, out])

    return docs.mapInArrow(run, schema)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels), "score")
    return scored.select("doc_id", F.coalesce(part_of(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
