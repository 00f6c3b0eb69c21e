"""The Merkle manifest against a plain tree, and on the edges of its input."""

import hashlib
import zlib

from assetspark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank string, hash int, root string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    n = r[4] if r[4] is None else r[4] + more
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], n, r[1])))


def climb(nodes):
    """The last node, and for each first one what stands before and after it on its way there."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            path.append((nodes[i - 1], "") if i % 2 else ("", nodes[i + 1] if i + 1 < len(nodes) else ""))
        at = [i // 2 for i in at]
        nodes = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def truth(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    trees = {}
    for lang in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = (own, *climb([leaf(r) for r in own]))
    root, tops = climb([t[1] for t in trees.values()])
    out = []
    for (own, subroot, paths), above in zip(trees.values(), tops, strict=True):
        for r, below in zip(own, paths, strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, 1 if hit else 0)
            for before, after in below + above:
                node = sha(before, node, after)
            out.append((r[0], leaf(r), subroot, root, sha(*(x for step in below + above for x in step)), node, node == root))
    return sorted(out, key=repr)


def digest(spark, rows):
    return sorted(map(tuple, merkle.manifest_digest(spark.createDataFrame([(*r, "clash", 1, None) for r in rows], SCHEMA)).collect()), key=repr)


ODD = [
    (1, "one", "en", "s", 3), (2, None, "en", None, None), (3, "", None, "s", 0), (None, "no id", "en", "s", 5), (None, "no id", "en", "s", 5), (None, None, None, None, None),
    (7, "same id", "fr", "s", 7), (7, "another text", "fr", "s", 12), (7, "same id", "fr", "s", 7), (8, "long " * 50_000, "", "s", 250_000), (9, "été \U0001f600", "é", "s", 5), (-5, "-", "en", "-", -1),
]


def test_odd_rows(spark):
    assert digest(spark, ODD) == truth(ODD)


def test_sizes_about_a_block(spark):
    """A language of each size; those of 257 rows and more have blocks of blocks."""
    sizes = (1, 2, 3, 5, 16, 17, 255, 256, 257, 700)
    rows = [(n * 1000 + i * 13 % 1009, f"text {i}", f"n{n}", f"s{i % 3}", i) for n in sizes for i in range(n)]
    assert digest(spark, rows) == truth(rows)


def test_many_blocks_and_languages(spark, monkeypatch):
    """Blocks of four leaves: five tiers, and more languages than a block holds."""
    monkeypatch.setattr(merkle, "BITS", 1)
    monkeypatch.setattr(merkle, "SPAN", 4)
    rows = [(i, f"text {i}", f"l{i % 37}" if i % 2 else "hot", "s", i) for i in range(600)]
    got = digest(spark, rows)
    assert got == truth(rows)
    assert {r[0] for r in got if not r[-1]} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 7 == 0}


def test_empty_and_single(spark):
    assert digest(spark, []) == []
    ((_, own, subroot, root, proof, back, verified),) = digest(spark, [(4, "x", "en", "s", 1)])
    assert own == subroot == root and proof == sha("") and verified == (back == root)


def test_equal_rows_spread_over_ranges(spark):
    """Ranks of rows that are equal in all their order are still dealt to several ranges, and are a permutation."""
    rows = spark.range(4000).selectExpr("'g' AS g", "1L AS doc_id", "'h' AS hash")
    ranks = merkle.ranked(rows, "g", "doc_id", "hash").select("rank", "n").collect()
    assert sorted(r["rank"] for r in ranks) == list(range(4000)) and {r["n"] for r in ranks} == {4000}
