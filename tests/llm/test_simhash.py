"""SimHash near duplicates against every pair, and on the edges of their input."""

import re
from collections import Counter

import numpy as np
import xxhash

from assetspark.llm import simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    held = Counter(bit for h in hashes for bit in range(64) if h >> bit & 1)
    return sum(1 << bit for bit, n in held.items() if 2 * n > len(hashes))


def components(fps, most=3):
    """The place of the first of each fingerprint's component, by all pairs."""
    fps = np.array(fps, np.uint64)
    label = np.arange(len(fps))
    near = [np.flatnonzero(np.bitwise_count(fps ^ f) <= most) for f in fps]
    while True:
        now = np.array([label[n].min() for n in near])
        if (now == label).all():
            return label.tolist()
        label = now


def test_texts_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)] + ["É", " ", "ß", "İ", "\x1c"]
    base = [" ".join(rng.choice(words, int(n))) for n in rng.integers(1, 400, 60)]
    near = []
    for t in base * 3:
        w = t.split(" ")
        w[int(rng.integers(len(w)))] = "CHANGED" if rng.random() < 0.5 else "w1"
        near.append(" ".join(w))
    texts = [*base, *near, *base[:5], None, "", " \n\t ", "one", "One two", "a b c", "w " * 60_000, "x" * 300_000]
    rows = [(i, t, "fp", 7) for i, t in enumerate(texts)] + [(None, base[0], "x", 1), (None, "alone with no id", "x", 1), (3, "the id of another text", "x", 1), (3, base[3], "x", 2)]
    got = simhash.simhash_digest(spark.createDataFrame(rows, "doc_id long, text string, fp string, key int")).collect()
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    ids = [i for i, *_ in rows]
    of = components(fps)
    least = {c: min((i for i, x in zip(ids, of, strict=True) if x == c and i is not None), default=None) for c in set(of)}
    assert sorted(map(tuple, got), key=repr) == sorted(((i, f"{f:016x}", least[c]) for i, f, c in zip(ids, fps, of, strict=True)), key=repr)
    assert simhash.simhash_digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def clouds(rng, n):
    """Fingerprints about a few centres: many links, chains of links, and pairs just too far apart."""
    out = []
    for centre in rng.integers(0, 2**64, 12, dtype=np.uint64):
        at = int(centre)
        for _ in range(n):
            for bit in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                at ^= 1 << int(bit)
            out.append(at)
            if rng.random() < 0.3:
                at = int(centre)
    return out


def test_every_pair_has_a_key():
    """Random pairs of up to three differences share a key and pass its chain; no pair of four passes."""
    rng = np.random.default_rng(8)
    a = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    for d in range(5):
        b = a.copy()
        for i in range(len(b)):
            for bit in rng.choice(64, d, replace=False):
                b[i] ^= np.uint64(1) << np.uint64(bit)
        x, y = simhash.keys(a), simhash.keys(b)
        passes = np.zeros(len(a), bool)
        for kind in range(x.shape[1]):
            at = np.flatnonzero(x[:, kind] == y[:, kind])
            passes[at[simhash.passing(a[at], b[at], simhash.start_of(x[at, kind]))]] = True
        assert passes.all() if d <= 3 else not passes.any()


def of_fingerprints(spark, fps, monkeypatch):
    frame = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, k: docs)
    return [r["component_id"] for r in simhash.near_duplicates(frame).orderBy("doc_id").collect()]


def test_components_equal_all_pairs(spark, monkeypatch):
    fps = clouds(np.random.default_rng(3), 60)
    assert of_fingerprints(spark, fps, monkeypatch) == components(fps)


def test_long_lists(spark, monkeypatch):
    """Lists far longer than a block: blocks alone find too little, longer keys the rest."""
    monkeypatch.setattr(simhash, "BLOCK", 4)
    monkeypatch.setattr(simhash.jaccard, "BLOCK", 4)
    rng = np.random.default_rng(4)
    # All differ in the last four bytes only: each key of the first four holds them all.
    fps = sorted({int(x) for x in rng.integers(0, 2**32, 150)} | {x ^ (1 << int(rng.integers(32))) for x in rng.integers(0, 2**32, 60).tolist() for _ in range(2)})
    assert of_fingerprints(spark, fps, monkeypatch) == components(fps)
