"""Each corpus operator on small tables against plain statements of its result, and on the edges of its input."""

import hashlib
import math
import os
import pathlib
import re
import subprocess
import sys
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st

from assetspark.llm import htmltext, jaccard, licenses, linededup, mixing, packing, pii, spotsigs, topk, toxicity
from assetspark.llm.common import BLANK, NOT_WORD, WordHasher

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, label string"
LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(15000))
BASE = [
    (1, "All rights reserved. Mail a.b@c.de or call +1 (555) 123-4567 now.", "en", "s1"),
    (2, None, "en", "s1"),
    (3, "", None, None),
    (4, "   \n \t", "en", "s2"),
    (5, LONG, "en", "s2"),
    (6, LONG, "en", "s2"),
    (7, "the quick brown fox jumps over the lazy dog and the cat of the house " * 10, "en", "s3"),
    (8, "ALL rights  reserved cc by CC-BY general public license 4111 1111 1111 1111 10.0.0.256 10.0.0.255", "fr", "s3"),
    (9, "x", "de", None),
    (10, "été \u0000 \U0001f600 naïve", "fr", "s1"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", None) for i, t, lang, s in BASE], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_word_hasher_equals_words_one_by_one():
    for ends, pattern in ((BLANK, rb"[^\x20\x09-\x0d]+"), (NOT_WORD, rb"[0-9A-Za-z\x80-\xff]+")):
        texts = [(t or "").encode() for _, t, *_ in BASE]
        hasher = WordHasher(ends)
        words, counts, _ = hasher(texts)
        expected = [re.findall(pattern, t.lower()) for t in texts]
        assert counts.tolist() == [len(e) for e in expected]
        by_word = defaultdict(set)
        for h, w in zip(words.tolist(), (w for e in expected for w in e), strict=True):
            by_word[w].add(h)
        assert all(len(h) == 1 for h in by_word.values())
        assert len({next(iter(h)) for h in by_word.values()}) == len(by_word)


# --- licenses ------------------------------------------------------------------------------------

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def license_truth(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    found = sorted((i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    return len(words), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found}))


def test_licenses(docs, empty):
    got = rows(licenses.license_digest(docs))
    assert {i: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for i, r in got.items()} == {i: license_truth(t) for i, t, *_ in BASE}
    assert licenses.license_digest(empty).count() == 0
    twice = licenses.license_digest(docs.union(docs)).collect()
    assert len(twice) == 2 * len(BASE) and all((r.n_words, r.n_base, r.first_word) == (got[r.doc_id].n_words, got[r.doc_id].n_base, got[r.doc_id].first_word) for r in twice)
    odd = docs.sparkSession.createDataFrame([(None, "cc by", 1), (None, "cc by", 2), (None, None, 3), (4, "cc by", 4), (4, "x", 5)], "doc_id long, text string, template int")
    assert sorted((r.doc_id or 0, r.n_words, r.n_base) for r in licenses.license_digest(odd).collect()) == [(0, 0, 0), (0, 2, 1), (0, 2, 1), (4, 1, 0), (4, 2, 1)]


def coverage_truth(text, template):
    """The best share of a template's words in runs that a text holds within the slack of one place, by plain search."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    k, want = licenses.grams(template)
    held = defaultdict(set)
    for i in range(len(words) - k + 1):
        for j in range(len(want) - k + 1):
            if words[i : i + k] == want[j : j + k]:
                held[i - j].add(j)
    best, group, last = 0, set(), None
    for d in sorted(held):
        group = group | held[d] if last is not None and template.slack and d - last <= template.slack else held[d]
        last = d
        best = max(best, len({x for j in group for x in range(j, j + k)}) / len(want))
    return best


def test_license_spans_equal_plain_search(spark):
    rng = np.random.default_rng(12)
    texts = []
    for t in licenses.TEMPLATES * 2:
        w = t.words.split()
        for _ in range(int(rng.integers(0, 1 + len(w) // 12))):
            at = int(rng.integers(0, len(w)))
            w[at : at + int(rng.integers(0, 2))] = ["changed"] * int(rng.integers(0, 3))
        texts.append("Some words before. " + " ".join(w) + " and after.")
    got = rows(licenses.license_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, text in enumerate(texts):
        shares = [(coverage_truth(text, t), t) for t in licenses.TEMPLATES]
        found = [(c, t.label) for c, t in shares if c >= t.least]
        assert got[i].labels == ",".join(sorted({label for _, label in found})) and math.isclose(got[i].score, max((c for c, _ in found), default=0.0))
    assert any(0 < r.score < 1 for r in got.values())


def test_license_wordings_survive_a_changed_word(spark):
    texts = ["x y Released under the MIT License. z", "Redistribution and use in source or binary forms, with or without any modification, are permitted provided that the following conditions are met", "under the sun"]
    got = rows(licenses.license_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i].labels for i in range(3)] == ["mit", "bsd", ""]
    assert got[0].score == 1.0 and 0.75 <= got[1].score < 1 and got[2].score == 0


# --- personal data -------------------------------------------------------------------------------

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def pii_truth(text):
    return sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(KINDS.items()) for m in re.finditer(p, text or "") if valid(kind, m[0]))


def base_spans(spans):
    return [s for s in spans.split(",") if s.split(":")[0] in KINDS]


def test_pii(docs, empty):
    for i, r in rows(pii.pii_digest(docs)).items():
        expected = [f"{kind}:{s}:{e}" for s, _, e, kind in pii_truth(dict((a, b) for a, b, *_ in BASE)[i])]
        assert base_spans(r.spans) == expected
        assert r.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest()
    assert pii.pii_digest(empty).count() == 0


TRICKY = st.lists(st.sampled_from(["a", "b1", "@", ".", "-", "_", "%", " ", "1", "23", "255", "256", "4111111111111111", "+", "(", ")", "x@y.z", "1.2.3.4", "😀", "é", "\n", "+44 20 7946 0958", "DE89 3704 0044 0532 0130 00"]), max_size=30).map("".join)


@settings(max_examples=2, deadline=None, phases=[Phase.generate])
@given(st.lists(TRICKY, min_size=60, max_size=60))
def test_pii_spans_equal_plain_matching(spark, texts):
    got = rows(pii.pii_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, text in enumerate(texts):
        assert base_spans(got[i].spans) == [f"{kind}:{s}:{e}" for s, _, e, kind in pii_truth(text)], repr(text)


def test_pii_long_runs_stay_linear(spark):
    texts = ["a" * 200_000, "1" * 200_000, "1 " * 100_000, "+" + "1" * 50_000, "a." * 50_000 + "@"]
    assert [r.spans for r in pii.pii_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()] == [""] * 5


def test_pii_many_spans_stay_linear(spark):
    """100,000 matches in one text: the places of a part start where the parts before it end."""
    n = 100_000
    began = time.time()
    (got,) = pii.pii_digest(spark.createDataFrame([(1, "é 1.2.3.4" * n)], "doc_id long, text string")).collect()
    assert time.time() - began < 60
    assert got.n_ip == n and got.spans == ",".join(f"ip:{9 * i + 2}:{9 * i + 9}" for i in range(n))


def added_truth(text):
    """The added kinds, by plain matching, with the context rule."""
    context = {"iban": pii.KINDS[4].context, "local_phone": pii.KINDS[5].context, "secret": pii.KINDS[6].context}
    patterns = {"iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", "local_phone": r"(?<![0-9+)(\x20-]\x20)(?<![0-9+(])\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}(?![0-9-])", "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+(?![A-Za-z0-9+/_-])"}
    out = []
    for kind, p in patterns.items():
        hits = list(re.finditer(p, text))
        for k, m in enumerate(hits):
            v = m[0].replace(" ", "")
            if kind == "iban" and not (15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1):
                continue
            if kind == "secret" and not (re.search("[0-9]", v) and re.search("[A-Za-z]", v)):
                continue
            before = text[max(hits[k - 1].end() if k else 0, m.start() - 40) : m.start()]
            after = text[m.end() : min(hits[k + 1].start() if k + 1 < len(hits) else len(text), m.end() + 40)]
            near = any(re.search(rf"(?<![^\W_])(?:{w})(?![^\W_])", side.lower()) for w in context[kind] for side in (before, after))
            if kind == "iban" or near:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return sorted(out)


def test_added_kinds_and_context(spark):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    cases = [
        ("pay to IBAN DE89 3704 0044 0532 0130 00 or DE89 3704 0044 0532 0130 01", ["iban"], [1.0]),
        (f'x token = "{key}" y', ["secret"], [0.7]),
        (f"commit {key} y", [], []),
        (f"{key} is the password", ["secret"], [0.7]),
        (f"monkeys {key} tokenised", [], []),
        (f"token {'.' * 60} {key}", [], []),
        ("token abcdefghijklmnopqrstuvwxyz", [], []),
        ("call (499) 555-6503 now", ["local_phone"], [0.7]),
        ("(499) 555-6503", [], []),
        ("a ship 10.0.0.1", ["ip"], [0.5]),
        ("the ip: 10.0.0.1", ["ip"], [0.8]),
    ]
    frame = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(cases)], "doc_id long, text string")
    got = rows(pii.find_pii(frame))
    assert [([s.kind for s in got[i].pii], [s.score for s in got[i].pii]) for i in range(len(cases))] == [(k, s) for _, k, s in cases]
    digest = rows(pii.pii_digest(frame))
    assert digest[1].n_spans == 1 and digest[1].scores == "0.70" and digest[1].spans.startswith("secret:")
    repeated = pii.pii_digest(spark.createDataFrame([(None, "a@b.c"), (None, "a@b.c"), (1, None)], "doc_id long, text string").withColumn("pii", pii.F.lit(1)))
    assert sorted(r.n_email for r in repeated.collect()) == [0, 1, 1]


ADDED = st.lists(st.sampled_from(["token", " ", "key", ": ", "24be64439e3e49cf46b2d7c9", "(499) 555-6503", "call", "monkey", "é", ", ", "DE89 3704 0044 0532 0130 00", "abcdefghijklmnopqrstuvw", "x", "\n", "=", '"', "tel", "......................................."]), max_size=16).map("".join)


@settings(max_examples=2, deadline=None, phases=[Phase.generate])
@given(st.lists(ADDED, min_size=80, max_size=80))
def test_added_spans_equal_plain_matching(spark, texts):
    got = rows(pii.pii_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, text in enumerate(texts):
        assert sorted(s for s in got[i].spans.split(",") if s and s.split(":")[0] not in KINDS) == added_truth(text), repr(text)


# --- pages ---------------------------------------------------------------------------------------


def test_main_text():
    page = """<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy</div>
    <article><h1>Head &amp; line</h1><p>First&nbsp;part <b>bold<br>next<p>Second   paragraph, long enough to matter in a page.</p><div class="comments"><p>me too</p></div></article><footer>&copy; x</footer></body></html>"""
    assert htmltext.main_text(page) == "Head & line First part bold next Second paragraph, long enough to matter in a page."
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<html><body></body></html>") == ""
    plain = "<div id=wrap><div class=menu><a href=x>one</a><a href=y>two</a></div><div class=post><p>" + "Real text here. " * 20 + "</p><p>" + "More of it. " * 20 + "</p></div><div class=sidebar>side</div></div>"
    assert htmltext.main_text(plain) == ("Real text here. " * 20).strip() + " " + ("More of it. " * 20).strip()
    assert htmltext.main_text("<p>" * 3000 + "deep") == "deep"


def test_density_finds_the_article_without_tags_and_names(spark, sf_dir):
    """With article and main renamed nothing changes; with all lists of noise off, nine pages in ten keep their text."""
    pages = [r.html or "" for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    found = [htmltext.main_text(p) for p in pages]
    assert [htmltext.main_text(re.sub(r"(</?)(article|main)\b", r"\1div", p)) for p in pages] == found
    assert sum(htmltext.main_text(p, names=False) == t for p, t in zip(pages, found, strict=True)) >= 0.9 * len(pages)


SENTENCES = "This is a paragraph of an article and says something at some length. "


def test_plain_divs_without_telling_names():
    """Menus, side columns, adverts and footers are divs like all else; the article may lie in several."""
    menu = "<div>" + "".join(f'<div><a href="/{i}">Entry {i}</a></div>' for i in range(12)) + "</div>"
    side = "<div>" + "".join(f'<p><a href="/s{i}">Some other story {i}</a> today</p>' for i in range(8)) + "</div>"
    advert, footer = "<div>Buy these shoes, they are cheap.</div>", "<div>All rights reserved by the owners of this site, who wrote it.</div>"
    parts = [[f"{k}{i} " + SENTENCES * (2 + i % 3) for i in range(8)] for k in "ab"]
    article = "".join("<div>" + "".join(f"<p>{p}</p>" for p in part) + "</div>" for part in parts)
    page = f"<html><body>{menu}<div>{side}<div>{article}</div></div>{advert}{footer}</body></html>"
    expected = " ".join(p.strip() for part in parts for p in part)
    assert htmltext.main_text(page, names=False) == htmltext.main_text(page) == expected


def test_comments_longer_than_the_article():
    article = "".join(f"<p>{i} {SENTENCES}</p>" for i in range(3))
    comments = "".join(f"<p>{i} {SENTENCES * 3}</p>" for i in range(20))
    page = f'<body><div class="post">{article}</div><div class="comments">{comments}</div></body>'
    assert htmltext.main_text(page) == " ".join(f"{i} {SENTENCES}".strip() for i in range(3))


def plain_content(root, names):
    """Densities, sums, thresholds and choice straight from their definitions, each counted from the whole subtree anew."""
    kids = lambda n: [x for x in n.children() if not (x.hidden or names and x.noise)]
    under = lambda n: [n] + [y for x in kids(n) for y in under(x)]
    nodes = under(root)
    parent = {x: n for n in nodes for x in kids(n)}

    def up(n):
        return [n] + (up(parent[n]) if n in parent else [])

    def measures(n):
        inside = under(n)
        text = [(len(x.strip()), any(u.tag == "a" for u in up(m)[: up(m).index(n) + 1])) for m in inside for x in m.parts if isinstance(x, str)]
        return sum(k for k, _ in text), sum(k for k, linked in text if linked), len(inside) - 1, sum(m.tag == "a" and m is not n for m in inside)

    whole = measures(root)
    density, held = {}, {}
    for n in nodes:
        c, lc, t, lt = held[n] = measures(n)
        if n.tag == "a":
            lt = t
        t, plain = max(1, t), max(1, c - lc)
        base = math.log(c / plain * lc + whole[1] / max(1, whole[0]) * c + math.e)
        density[n] = c / t * max(0.0, math.log(max(1.0, c / max(1, lc) * t / max(1, lt))) / base) if c else 0.0
    total = {n: sum(density[x] for x in kids(n) if x.tag in htmltext.BLOCK) if any(x.tag in htmltext.BLOCK for x in kids(n)) else density[n] for n in nodes}
    body = next((n for n in nodes if n.tag == "body"), root)
    candidates = [n for n in nodes if n.tag in htmltext.BLOCK or n in (root, body)]
    top = max(total[n] for n in candidates)
    path = up(next(n for n in candidates if total[n] == top))
    path = path[: path.index(body) + 1] if body in path else path
    return density, total, body, min(density[n] for n in path), min(total[n] for n in path)


def test_density_and_choice_equal_plain_counts(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").limit(25).collect():
        root = htmltext.parse(r.html)
        found = htmltext.content(root)
        density, total, body, least_density, least_total = plain_content(root, False)
        assert all(math.isclose(n.density, d) and math.isclose(n.total, total[n]) for n, d in density.items())
        below = lambda n: [x for x in n.children() if not x.hidden]
        blocks_in = lambda n: ([n] if n is body or n.tag in htmltext.BLOCK else []) + [y for x in below(n) for y in blocks_in(x)]
        expected, reached = set(), [body]
        while reached:
            n = reached.pop()
            held = [x for x in blocks_in(n) if x is n or x.chars]
            if density[n] < least_density or not held or max(total[x] for x in held) < least_total:
                continue
            best = max((total[x], x.chars) for x in held)
            expected.add(next(x for x in held if (total[x], x.chars) == best))
            reached += below(n)
        assert {(total[n], n.chars) for n in found} == {(total[n], n.chars) for n in expected} and found


@pytest.mark.parametrize("part", ['<a b="', "<a b='", "<b>", "<p>", "<div>", "<td>", "<!", "<main>", "x<", "<script>", "<a class ", "</p>", "<li>", "&amp"])
def test_hostile_pages_take_linear_time(part):
    began = time.process_time()
    htmltext.main_text("<div>" * 1000 + part * (1_000_000 // len(part)) + "</section>" * 1000)
    assert time.process_time() - began < 20


def test_unclosed_marks():
    assert htmltext.main_text('<p>one</p><p title="x>two</p><p>three') == "one two three"
    assert htmltext.main_text("<p>1 < 2 and 3 > 2 <") == "1 < 2 and 3 > 2 <"
    assert htmltext.main_text("<p>a<!-- b") == "a" and htmltext.main_text("<p>it's <b title=\"a > b\">bold") == "it's bold"
    assert htmltext.main_text("<p>kept<script>var a = 1;</script> text<style>p{}") == "kept text"


def test_main_text_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "x"), (2, None, None, "y"), (None, "v", "", "z")], "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in htmltext.extract_main_text(pages).collect()}
    assert got == {(1, "u"): ("a", 1), (2, None): ("", 0), (None, "v"): ("", 0)}
    assert htmltext.extract_main_text(pages.limit(0)).count() == 0


# --- mixing --------------------------------------------------------------------------------------


def mix_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    full, left = set(), sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        rest = left - sum(3 * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else share[s] for s in order}
        full |= over


def rate_truth(sizes, target, most=3):
    """By bisection: the multiplier at which the bounded exponential rates of a source's documents give its target."""
    held = [z for z in sizes if z]
    mean = sum(held) / len(held)
    rates = lambda m: {z: min(most, math.exp(min(50, m * z / mean))) for z in set(held)}
    low, high = -60.0, 60.0
    for _ in range(200):
        m = (low + high) / 2
        low, high = (m, high) if sum(z * rates(m)[z] for z in held) < target else (low, m)
    return rates((low + high) / 2) | {0: 0.0}


def test_rates_and_copies_equal_plain_ones(spark):
    """Rates against bisection, copies of each size against rounding from the largest size on, those of its documents apart by one at most."""
    rng = np.random.default_rng(17)
    data = [(i if i % 50 else None, " ".join(["w"] * int(rng.choice([1, 5, 40, 41, 300]))), (None, "a", "b", "c")[int(rng.choice(4, p=[0.1, 0.1, 0.2, 0.6]))]) for i in range(700)]
    data += data[:40] + [(9000, None, "a"), (9001, "", "b"), (9002, "w " * 5000, "a")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in data], "doc_id long, text string, source string, copies int, size string")
    got = mixing.mix_digest(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in data)
    named = mixing.mixed(docs.withColumn("origin", docs["source"]), keep=("origin",)).collect()
    sizes = defaultdict(list)
    for _, t, source in data:
        sizes[source].append(len((t or "").split()))
    targets = mix_targets({k: sum(v) for k, v in sizes.items()})
    by_size = defaultdict(lambda: defaultdict(list))
    for r in named:
        by_size[r.origin][r["size"]].append((r.copies, r.rate))
    for source, own in sizes.items():
        rates, carried = rate_truth(own, targets[source]), 0.0
        for z in sorted(set(own), reverse=True):
            held = by_size[source][z]
            assert len(held) == own.count(z) and all(math.isclose(rate, rates[z], rel_tol=1e-6, abs_tol=1e-12) for _, rate in held)
            wanted = z * len(held) * rates[z] + carried
            n = min(3 * len(held), max(0, round(wanted / z))) if z else 0
            carried = wanted - n * z
            copies = [c for c, _ in held]
            assert abs(sum(copies) - n) <= (abs(wanted / z % 1 - 0.5) < 1e-4 if z else 0) and max(copies) - min(copies) <= 1 and max(copies) <= 3


def test_mixing(spark, empty):
    rng = np.random.default_rng(3)
    data = [(i, " ".join(["w"] * int(rng.integers(1, 400))), None if i % 11 == 0 else f"s{i % 4}") for i in range(400)] + [(1000, None, "s1"), (1001, "tiny", "zz")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix_digest(docs).collect()
    assert len(got) == len(data) and sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mixing.mix_digest(docs.repartition(7)).collect())
    source = {i: s for i, _, s in data}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        s = source[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken <= 3 * r.size
    expected = mix_targets(sizes)
    for s in sizes:
        assert math.isclose(target[s], expected[s], rel_tol=1e-9) and abs(taken[s] - target[s]) <= max(3, 0.01 * target[s])
    assert mixing.mix_digest(empty).count() == 0


def test_mixing_nothing_but_empty_texts(spark):
    got = mixing.mix_digest(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


# --- packing -------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None, phases=[Phase.generate])
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_uses_all_pieces_and_fills_bins(counts):
    plan = packing.minimum_slack_plan(dict(counts), 64)
    used = defaultdict(int)
    for times, held in plan:
        assert sum(s * m for s, m in held) <= 64
        for s, m in held:
            used[s] += times * m
    assert used == counts
    n, total, best_fit = sum(t for t, _ in plan), sum(s * c for s, c in counts.items()), []
    for s in sorted((s for s, c in counts.items() for _ in range(c)), reverse=True):
        fit = [b for b in best_fit if b >= s]
        if fit:
            best_fit.remove(min(fit))
            best_fit.append(min(fit) - s)
        else:
            best_fit.append(64 - s)
    assert -(-total // 64) <= n <= 1.2 * len(best_fit) + 1


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    odd = [(11, "a\x1cb  c\n\n d <|endoftext|> it's 12 don't x y \r\n"), (12, "tab\t\ttwo   three")]
    both = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(odd, "doc_id long, text string"))
    texts = dict([(i, t) for i, t, *_ in BASE] + odd)
    pieces = defaultdict(list)
    bins = defaultdict(list)
    for r in packing.pack_documents(both).collect():
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids = (tokenizer.encode(text, add_special_tokens=False).ids if text else []) + [2]
        at = 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (r.length == 1024 or k == 0)
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(empty).count() == 0


def test_packing_repeated_rows(docs):
    twice = packing.pack_documents(docs.union(docs))
    assert twice.count() == 2 * packing.pack_documents(docs).count()
    assert twice.groupBy("sequence_id", "offset").count().filter("count > 1").count() == 0


@pytest.mark.parametrize("run", [" ", "\n", "\u00a0", "\u3000", "a"])
@pytest.mark.parametrize("n", [5_000, 1_000_000])
def test_long_runs_have_the_tokenizers_ids(run, n):
    text = "a" + n * run + "x"
    enc = packing.encoder(packing.tokenizer_path())
    assert enc.encode(text) == np.asarray(enc.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


PIECES = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "bc", "'s", "12", "!!", "\u00a0", "\u3000", "\u2009", "é", "<|endoftext|>", "\x1c", "\x85", "-", "the", "😀", " \n ", " x"]), max_size=14).map("".join)


@settings(max_examples=40, deadline=None, phases=[Phase.generate])
@given(st.lists(PIECES, min_size=50, max_size=50))
def test_ids_are_those_of_whole_texts(texts):
    enc = packing.encoder(packing.tokenizer_path())
    assert enc.encode_batch(texts) == [np.asarray(enc.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def test_a_known_stretch_is_looked_up_once():
    """Lookups are what texts of known words cost; also cut at spaces as by the pattern, with and without NUL."""
    looked = Counter()

    class Known(dict):
        def get(self, x):
            looked[x] += 1
            return super().get(x)

        def __getitem__(self, x):
            looked[x] += 1
            return super().__getitem__(x)

        def __contains__(self, x):
            looked[x] += 1
            return super().__contains__(x)

    enc = packing.Encoder(packing.tokenizer_path())
    enc.known = Known()
    text = "first" + "".join(f" w{i}" for i in range(500))
    ids = enc.encode(text)
    looked.clear()
    assert enc.encode(text) == ids == np.asarray(enc.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert {looked[f" w{i}"] for i in range(500)} == {1}
    for t in ("", " ", " a", "a b", "a\x00b c", "a  b", "\x00 a", "a b\n c"):
        assert enc.stretches(t) == packing.LED.split(t)


def test_each_bin_is_the_fullest_there_is():
    """Against all subsets of the pieces left, for small plans."""
    rng = np.random.default_rng(8)
    for _ in range(40):
        left = [int(x) for x in rng.integers(1, 20, int(rng.integers(1, 12)))]
        counts = defaultdict(int)
        for x in left:
            counts[x] += 1
        for times, held in packing.minimum_slack_plan(dict(counts), 24):
            bin_ = [s for s, m in held for _ in range(m)]
            for _ in range(times):
                rest = list(left)
                rest.remove(max(rest))
                sums = {0}
                for x in rest:
                    sums |= {y + x for y in sums}
                assert sum(bin_) == max(y for y in (s + max(left) for s in sums) if y <= 24)
                for x in bin_:
                    left.remove(x)


def test_the_tokenizer_starts_no_threads():
    """In a new process, as a worker is: each thread would keep memory of its own."""
    code = "import os; from assetspark.llm import packing; e = packing.Encoder(packing.tokenizer_path()); n = len(os.listdir('/proc/self/task')); e.encode_batch([f'new{i} word{i}' for i in range(5000)]); print(len(os.listdir('/proc/self/task')) - n)"
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"} | {"PYTHONPATH": os.pathsep.join(sys.path)}
    assert int(subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, check=True).stdout.split()[-1]) == 0


def test_packing_a_million_blanks(spark):
    got = packing.pack_documents(spark.createDataFrame([(1, "a" + 1_000_000 * " " + "x"), (2, "b")], "doc_id long, text string")).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == 1_000_002


# --- shingle join --------------------------------------------------------------------------------


def join_truth(texts, words=3, num=9, den=10):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def near_copies(n=60):
    rng = np.random.default_rng(5)
    texts = {i: t for i, t, *_ in BASE}
    base = [f"v{k}" for k in range(150)]
    for i in range(n):
        w = list(base)
        for _ in range(int(rng.integers(0, 5))):
            w[int(rng.integers(0, len(w)))] = f"n{rng.integers(0, 9)}"
        texts[100 + i] = " ".join(w)
    for i in range(n // 2):
        texts[300 + i] = " ".join(base[:40] + [f"z{i}_{k}" for k in range(60)])
    texts[400] = "one two"
    texts[401] = "ONE\ttwo"
    texts[402] = "one two three"
    return texts


def test_shingle_join(spark, empty):
    texts = near_copies()
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(docs).collect()}
    assert got == join_truth(texts)
    assert jaccard.linked(empty).count() == 0
    large = [(2**62 + 5, "a b c d e"), (2**63 - 1, "a b c d e"), (None, "a b c d e"), (None, "p q r s"), (2**62, "no other text has these words")]
    found = jaccard.linked(docs.sparkSession.createDataFrame(large, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.component_id) for r in found) == Counter([(2**62 + 5,) * 2, (2**63 - 1, 2**62 + 5), (None, 2**62 + 5), (None, None), (2**62,) * 2])


def test_shingle_join_answers_every_row(spark):
    same = "a b c d e f g h i j k"
    docs = spark.createDataFrame([(None, same), (None, same), (4, same), (4, same), (4, "z y x w v"), (9, "z y x w v"), (None, "only here"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id or 0) for r in jaccard.linked(docs).collect())
    assert got == [(0, 0, 0), (0, 1, 0), (0, 9, 4), (0, 9, 4), (4, 3, 4), (4, 9, 4), (4, 9, 4), (9, 3, 4)]


def tables(spark):
    """Names of the tables in the shared folder, less what tells them apart."""
    return Counter(p.name.rsplit("-", 1)[0] for p in pathlib.Path(spark.conf.get("spark.checkpoint.dir"), "tables").glob("*"))


def test_shingle_join_and_line_dedup_leave_no_large_tables(spark):
    """Profiles, sets and windows go from the disk once nothing reads them, not when the driver ends."""
    docs = spark.createDataFrame([(i, f"{t}\nthe same line in every text") for i, t in near_copies(20).items()], "doc_id long, text string")
    before = tables(spark)
    assert jaccard.linked(docs).count() == linededup.dedup_lines(docs).count() == docs.count()
    assert set(tables(spark) - before) <= {"links", "members", "gone"}


def test_shingle_join_in_blocks(spark, monkeypatch):
    """Lists longer than a block are dealt in pairs of blocks and lose no link."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    texts = near_copies(40)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(docs).collect()} == join_truth(texts)


@pytest.mark.parametrize("large", [8, 1 << 12])
def test_passing_pairs_equal_all_pairs(monkeypatch, large):
    """Block skips and pivots rule out what the bounds do, pair by pair, and nothing else; with lists of over a block."""
    monkeypatch.setattr(jaccard, "LARGE", large)
    rng = np.random.default_rng(9)
    for trial in range(4):
        m = 1500 if trial == 0 else 300
        list_id = np.sort(rng.integers(0, 3, m))
        n, at = rng.integers(20, 30 + 10 * trial, m), rng.integers(0, 4, m)
        base = rng.integers(0, 2**63, (4, jaccard.BITS // 64), dtype=np.uint64) & rng.integers(0, 2**63, (4, jaccard.BITS // 64), dtype=np.uint64)
        bitmap = base[rng.integers(0, 4, m)] ^ (np.uint64(1) << rng.integers(0, 63, (m, jaccard.BITS // 64), dtype=np.uint64)) * (rng.random((m, 1)) < 0.5).astype(np.uint64)
        rid = rng.permutation(m)
        order = np.lexsort((rid, at, n, list_id))
        list_id, n, at, bitmap, rid = list_id[order], n[order], at[order], bitmap[order], rid[order]
        i, j, gap = jaccard._passing(list_id, n, at, bitmap, np.full(m, -1), rid, (9, 10))
        assert (i < j).all() and (gap == np.bitwise_count(bitmap[i] ^ bitmap[j]).sum(1)).all()
        x, y = np.triu_indices(m, 1)
        most = np.minimum(n[x] - at[x], n[y] - at[y]) + np.minimum(at[x], at[y])
        all_gap = np.bitwise_count(bitmap[x] ^ bitmap[y]).sum(1)
        ok = (list_id[x] == list_id[y]) & (10 * n[x] >= 9 * n[y]) & (19 * most >= 9 * (n[x] + n[y])) & (19 * (n[x] + n[y] - all_gap.astype(int)) >= 18 * (n[x] + n[y]))
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == list(zip(x[ok].tolist(), y[ok].tolist(), strict=True)) and ok.any()
        # Halves of a list meet each other alone, rows of one label never.
        side, label = np.where(list_id == 1, rid % 2, -1), rid % 7
        order = np.lexsort((rid, side, at, n, list_id))
        i, j, _ = jaccard._passing(list_id[order], n[order], at[order], bitmap[order], side[order], label[order], (9, 10))
        got = {frozenset(z) for z in zip(order[i].tolist(), order[j].tolist(), strict=True)}
        ok &= (label[x] != label[y]) & ((side[x] < 0) | (side[x] != side[y]))
        assert got == {frozenset(z) for z in zip(x[ok].tolist(), y[ok].tolist(), strict=True)} and len(got) == len(i)


def test_spanning_forest_is_the_least():
    rng = np.random.default_rng(3)
    for m, edges in ((1, 0), (6, 4), (40, 30), (40, 600)):
        i, j, weight = rng.integers(0, m, edges), rng.integers(0, m, edges), rng.integers(0, 9, edges)
        label, want = list(range(m)), []
        for k in np.argsort(weight, kind="stable").tolist():
            a, b = label[i[k]], label[j[k]]
            if a != b:
                label = [b if x == a else x for x in label]
                want.append(k)
        assert jaccard.spanning_forest(i, j, weight, m).tolist() == sorted(want)


def test_blocks_of_long_lists_meet_where_components_differ(spark, monkeypatch):
    """Every two sets of a list with different labels share one place, sets of a large component none of their own."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    label = {i: 0 if i < 40 else 40 if i < 70 else i for i in range(90)}
    sets = spark.createDataFrame([(i, 9, bytearray(64), [5, 7] if i < 90 else [6]) for i in range(120)], "doc_id long, n long, bitmap binary, prefix array<long>")
    labels = spark.createDataFrame([(i, x) for i, x in label.items() if i != x] + [(i, 90) for i in range(90, 120)], "id long, label long")
    long = jaccard.long_lists(sets)
    assert {r.token for r in long.collect()} == {5, 6, 7}
    places = {}
    for r in jaccard.block_pairs(sets, long, labels).collect():
        assert r.token in (5, 7) and r.b in (r.lo, r.hi)
        places.setdefault((r.token, r.lo, r.hi), []).append((r.rid, r.b, r.label))
    pairs = [(t, frozenset((a, x))) for (t, lo, hi), rows in places.items() for a, b, la in rows for x, y, lx in rows if a < x and la != lx and (b != y or lo == hi)]
    want = {(t, frozenset((a, x))) for t in (5, 7) for a in label for x in label if a < x and label[a] != label[x]}
    assert set(pairs) == want and len(pairs) == len(want)
    assert max(map(len, places.values())) < 60


def test_sketches_bound_differences_from_below():
    rng = np.random.default_rng(1)
    for n in (1, 5, 60, 1000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: len(a) // 2], rng.integers(0, 2**63, n, dtype=np.uint64))))
        assert jaccard.least_difference(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 300)], "a long, b long")
    got = {r.id: r.label for r in jaccard.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}


# --- line dedup ----------------------------------------------------------------------------------


def dedup_truth(texts, run):
    """A line goes if it lies in a run of at least `run` words that also stands at an earlier place."""
    lines = {i: [(k, len(x.encode().split()), x) for k, x in enumerate(t.split("\n")) if x.encode().split()] for i, t in sorted(texts.items()) if t is not None}
    places = [(i, a, b) for i, s in lines.items() for a in range(len(s)) for b in range(a, len(s)) if sum(x[1] for x in s[a : b + 1]) >= run]
    first = {}
    for i, a, b in places:
        first.setdefault(tuple(x[2] for x in lines[i][a : b + 1]), (i, a))
    gone = defaultdict(set)
    for i, a, b in places:
        if first[tuple(x[2] for x in lines[i][a : b + 1])] < (i, a):
            gone[i] |= set(range(a, b + 1))
    out = {}
    for i, t in texts.items():
        dead = {lines[i][k][0] for k in gone[i]} if t is not None else set()
        out[i] = t if not dead else "" if len(dead) == len(lines[i]) else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in dead)
    return out


@settings(max_examples=2, deadline=None, phases=[Phase.generate])
@given(st.lists(st.lists(st.sampled_from(["a b", "c d e", "f", "g h i j k l", "", "  ", "m n o"]), max_size=9), min_size=12, max_size=12))
def test_line_dedup_equals_plain_search(spark, drawn):
    texts = {i: "\n".join(x) for i, x in enumerate(drawn)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.dedup_lines(docs, run=6).collect()} == dedup_truth(texts, 6)


def test_many_short_lines_stay_linear(spark):
    """200,000 lines of a word: a window is three of them."""
    n = 200_000
    began = time.time()
    (got,) = linededup.dedup_digest(spark.createDataFrame([(1, "\n".join(f"w{i % 977}" for i in range(n)))], "doc_id long, text string")).collect()
    assert time.time() - began < 60 and (got.n_lines, got.n_deleted) == (n, n - 977)


def test_line_dedup_edges(docs, empty, spark):
    got = rows(linededup.dedup_lines(docs))
    assert got[2].text is None and got[3].text == "" and got[5].text == LONG and got[6].text == "" and got[6].n_deleted == 1 and got[1].extra == "x"
    assert set(linededup.dedup_lines(docs).columns) == {*docs.columns, "n_lines", "n_deleted"}
    assert linededup.dedup_lines(empty).count() == 0
    clash = linededup.dedup_lines(docs.withColumnRenamed("extra", "n_lines"))
    assert sorted(clash.columns) == sorted({*docs.columns, "n_lines", "n_deleted"} - {"extra"}) and clash.count() == len(BASE)
    same = spark.createDataFrame([(1, LONG), (1, LONG), (None, LONG), (2, LONG)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text == "") for r in linededup.dedup_lines(same).collect()) == [(0, False), (1, False), (1, False), (2, True)]


# --- fingerprints --------------------------------------------------------------------------------


def test_fingerprints(docs, empty):
    got = rows(spotsigs.fingerprint_digest(docs))
    texts = {i: t or "" for i, t, *_ in BASE}
    ids = sorted(texts)
    for k, i in enumerate(ids):
        t, following = texts[i], texts[ids[(k + 1) % len(ids)]]
        n = len(t) // 4
        edited = t[: len(t) - n] + following[:n]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and (edited != t or got[i].near_edited == 1)
    assert got[5].fingerprint == got[6].fingerprint and got[5].near_next == 1.0 and got[5].near_edited > 0.9
    assert got[7].near_next < 0.1 and got[2].fingerprint == got[3].fingerprint == ""
    assert spotsigs.fingerprint_digest(empty).count() == 0


def signature_truth(text):
    """The chains that follow common words, as tuples of words."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    found = set()
    for i, x in enumerate(w):
        if x in spotsigs.ANCHORS:
            chain = [y for y in w[i + 1 :] if y not in spotsigs.ANCHORS][: spotsigs.CHAIN]
            if chain:
                found.add(tuple(chain))
    content = [y for y in w if y not in spotsigs.ANCHORS]
    return found or {tuple(content[i : i + spotsigs.CHAIN]) for i in range(len(content))} or ({("whole", text)} if text else set())


def test_likeness_equals_that_of_plain_signature_sets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts)
    alike = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    floor = lambda x: x if x >= spotsigs.LEAST else 0.0
    got = rows(spotsigs.fingerprint_digest(docs))
    assert set(got) == set(ids)
    for k, i in enumerate(ids):
        t, following = texts[i], texts[ids[(k + 1) % len(ids)]]
        n = len(t) // 4
        edited = t[: len(t) - n] + following[:n]
        own = signature_truth(t)
        assert len(got[i].fingerprint) == spotsigs.DIGITS * len(own) and len(got[i].edited_fingerprint) == spotsigs.DIGITS * len(signature_truth(edited))
        assert math.isclose(got[i].near_edited, floor(alike(own, signature_truth(edited)))) and math.isclose(got[i].near_next, floor(alike(own, signature_truth(following))))


def test_fingerprint_of_one_document_and_repeats(spark):
    one = spark.createDataFrame([(5, "abcdefgh"), (5, "abcdefgh")], "doc_id long, text string")
    r = spotsigs.fingerprint_digest(one).collect()
    assert len(r) == 2 and r[0] == r[1] and r[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r[0].near_next == 1.0


def test_fingerprints_of_clashing_and_missing_ids(spark):
    odd = spark.createDataFrame([(5, "abcdefgh", 1), (None, "zz", 2), (5, "the quick brown fox runs", 3), (7, None, 4), (None, "zz", 5), (1, "12345678", 6)], "doc_id long, text string, id int")
    got = spotsigs.fingerprint_digest(odd).collect()
    fives = [r for r in got if r.doc_id == 5]
    assert len(got) == 6 and {r.n_chars for r in fives} == {8, 24}
    order = sorted(fives, key=lambda r: r.n_chars)
    texts = {8: "abcdefgh", 24: "the quick brown fox runs"}
    sums = {n: {hashlib.sha256((texts[n][: n - n // 4] + follow[: n // 4]).encode()).hexdigest() for follow in (texts[32 - n], "")} for n in texts}
    assert all(r.edited_sha256 in sums[r.n_chars] for r in order)
    missing = [r for r in got if r.doc_id is None]
    assert len(missing) == 2 and missing[0] == missing[1] and missing[0].n_chars == 2


def test_near_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = [str(w) for w in rng.choice(["the", "of", "and", "to", *(f"c{i}" for i in range(200))], 300)]
    texts = []
    for i in range(25):
        w = list(base)
        for _ in range(i % 6):
            w[int(rng.integers(0, 300))] = f"e{rng.integers(0, 50)}"
        texts.append((i, " ".join(w)))
    texts += [(100 + i, " ".join(str(w) for w in rng.choice(["the", "of", *(f"d{k}" for k in range(400))], 200))) for i in range(15)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.a, r.b) for r in spotsigs.near_pairs(docs, 0.8).collect()}
    sets = {r.doc_id: set(r.sigs) for r in spotsigs.classes(docs).filter("doc_id = representative").collect()}
    assert got == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert got


def test_near_pairs_of_a_hot_signature_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "BLOCK", 4)
    base = [f"c{i}" for i in range(120)]
    texts = [(i, " ".join(w if k not in (i, i + 60) else f"e{i}" for k, w in enumerate(base))) for i in range(48)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    classes = spotsigs.classes(docs).filter("doc_id = representative AND n > 0")
    groups = spotsigs.index_groups(classes, 0.8)
    whole = groups.groupBy("sig", "band").agg({"doc_id": "approx_count_distinct"}).agg({"approx_count_distinct(doc_id)": "max"}).first()[0]
    assert whole > 24 and groups.groupBy("sig", "band", "lo", "hi").count().agg({"count": "max"}).first()[0] <= 24
    sets = {r.doc_id: set(r.sigs) for r in classes.collect()}
    truth = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert truth and {(r.a, r.b) for r in spotsigs.near_pairs(docs, 0.8).collect()} == truth


# --- top k ---------------------------------------------------------------------------------------


def top_truth(vectors, every, k):
    out = defaultdict(list)
    for a, (q, v) in enumerate(vectors):
        if q % every == 0:
            scored = sorted((-int(v @ w), i) for b, (i, w) in enumerate(vectors) if a != b)[:k]
            out[q] += [(n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return {q: sorted(x) for q, x in out.items()}


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    data += [(1000 + i, data[0][1]) for i in range(20)] + [data[50], data[50], (50, data[51][1])]  # ties, repeated rows and ids
    bad = [(2000, None), (2050, [float("nan")] * 8), (2100, [float("inf")] + [0.0] * 7), (2150, [None] * 8), (None, [0.0] * 8)]
    short = [(2200, [1.0]), (2250, []), (2251, [2.0, -1.0])]  # count as if they ended in zeros
    df = spark.createDataFrame([(i, v, "x") for i, v in data + short + bad], "vec_id long, embedding array<float>, label string")
    exact = [(i, np.floor(np.asarray([*v, *[0.0] * (8 - len(v))], dtype=np.float32).astype(np.float64) * 256).astype(np.int64)) for i, v in data + short]
    for page in (1024, 16):  # one page, and a tree of several levels
        monkeypatch.setattr(topk, "PAGE", page)
        monkeypatch.setattr(topk.build, "__defaults__", (page,))
        got = defaultdict(list)
        for r in topk.top_k(df, 5, 50).collect():
            got[r.query_id].append((r.rank, r.vec_id, r.score))
        assert {q: sorted(x) for q, x in got.items()} == top_truth(exact, 50, 5)
    assert topk.top_k(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(few).orderBy("rank").collect()] == [(0, n, 1, 256 * 128 + 512 * 128) for n in (1, 2)]


def test_top_k_of_large_components(spark):
    """Scores past double precision are exact; sums past a long count as its ends and keep their order."""
    big = [(0, [1e5 + 1 / 256, 1.0, 0.0]), (1, [1e5 + 3 / 256, 0.5, 0.0]), (2, [1e5 + 2 / 256, 0.25, 1.0]), (3, [1e10, 0.0, 1.0]), (4, [1e300, 0.0, 0.0]), (5, [2e10, 1.0, 0.0]), (50, [-1e10, 1.0, 0.0]), (6, [-1e300, 0.0, 0.0])]
    got = defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>"), 5, 50).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ends = lambda x: min(max(x, topk.LEAST_LONG), topk.MOST_LONG)
    whole = {i: [ends(math.floor(x * 256)) for x in v] for i, v in big}
    for q in (0, 50):
        order = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, ends(-s)) for n, (s, i) in enumerate(order)]


def test_tree_covers_its_vectors():
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (2000, 6)).astype(np.float64)
    tree = topk.split(x[:400], 40)
    tree.radius, tree.norm = np.zeros(len(tree.centre)), np.zeros(len(tree.centre))
    leaf = np.zeros(len(x), int)
    for at, node, d in tree.route(x):
        assert np.allclose(d, np.sqrt(((x[at] - tree.centre[node]) ** 2).sum(1)), atol=1e-6)
        tree.radius[node], tree.norm[node], leaf[at] = d.max() * (1 + 1e-6), (x[at] ** 2).sum(1).max(), node
    assert max(len(c) for c in tree.children) <= topk.FAN and 40 <= sum(not c for c in tree.children) <= 40 + topk.FAN
    q = x[:50]
    scores = q @ x.T
    least = np.sort(scores, 1)[:, -5]
    alive = tree.reached(q, least)
    assert all(alive[i, leaf[j]] for i in range(50) for j in np.flatnonzero(scores[i] >= least[i])) and alive[:, [not c for c in tree.children]].mean() < 0.9


# --- toxicity ------------------------------------------------------------------------------------


def test_toxicity_learns_and_holds_out(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(300)]
    data = []
    for i in range(900):
        w = [str(x) for x in rng.choice(words, int(rng.integers(20, 80)))]
        if toxic := int(rng.random() < 0.2):
            w[int(rng.integers(0, len(w)))] = str(rng.choice(["vilest", "grossly", "vilefoo"]))
        data.append((i, " ".join(w), toxic))
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in data] + [(5000, None, "en"), (5001, "", "de")], "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(0, None)], "doc_id long, toxic int")
    got = rows(toxicity.toxicity_digest(docs, labels))
    assert len(got) == 902 and got[5000].predicted == got[5001].predicted == 0 and got[5000].score == got[5001].score
    held = [(got[i].predicted, y) for i, _, y in data if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    right = sum(p == y == 1 for p, y in held)
    assert right >= 0.9 * sum(y for _, y in held) and right >= 0.9 * sum(p for p, _ in held)
    none = toxicity.toxicity_digest(docs, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    assert toxicity.toxicity_digest(docs.limit(0), labels).count() == 0


def small_model(seed=1):
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.5, ((1 << toxicity.BITS) + 1, toxicity.DIM)).astype(np.float32)
    table[0] = 0
    filters = [rng.normal(0, 0.5, (w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS]
    shifts = [rng.normal(0, 0.3, toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS]
    return toxicity.Model(table, filters, shifts, rng.normal(0, 0.5, toxicity.FILTERS * len(toxicity.WIDTHS)).astype(np.float32), -0.2, np.zeros(5))


TEXTS = [b"a b c d e f g", b"", b"one", b"two words", b"a a a b " * 30]


def plain_logit(model, ids):
    """One text's logit by loops: ids of its words and pads."""
    x = [sum(model.table[i].astype(float) for i in row) for row in ids]
    words = len(ids) - toxicity.PADS
    best = []
    for width, filters, shift in zip(toxicity.WIDTHS, model.filters, model.shifts, strict=True):
        for f in range(toxicity.FILTERS):
            best.append(max([0.0] + [shift[f] + sum(float(x[t + k] @ filters[k][:, f]) for k in range(width)) for t in range(words)]))
    return float(np.dot(best, model.weights)) + model.bias


def test_forward_pass_equals_loops():
    model, features = small_model(), toxicity.Features()
    ids, counts, _ = features(TEXTS)
    got = model.logits(ids, counts)
    for t, z in zip(TEXTS, got, strict=True):
        assert math.isclose(z, plain_logit(model, features([t])[0]), abs_tol=1e-4)


def test_gradients_equal_differences():
    model, features = small_model(), toxicity.Features()
    ids, counts, _ = features(TEXTS)
    y = np.array([1, 0, 1, 0, 1.0])

    def loss():
        z = np.array([plain_logit(model, features([t])[0]) for t in TEXTS])
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    dense, by_bias, rows, by_row = toxicity.gradients(model, ids, counts, y)
    rng = np.random.default_rng(0)
    slots = [*model.filters, *model.shifts, model.weights]
    checks = [(s, g, tuple(int(rng.integers(0, n)) for n in s.shape)) for s, g in zip(slots, dense, strict=True) for _ in range(3)]
    checks += [(model.table, {(int(r), c): by_row[i, c] for i, r in enumerate(rows) for c in range(toxicity.DIM)}, (int(r), 1)) for r in rows[rows > 0][:4]]
    for slot, slope, at in checks:
        was = slot[at]
        slot[at] = was + 1e-3
        up = loss()
        slot[at] = was - 1e-3
        assert math.isclose((up - loss()) / 2e-3, slope[at], abs_tol=2e-3)
        slot[at] = was
    was, model.bias = model.bias, model.bias + 1e-3
    up = loss()
    model.bias = was - 1e-3
    assert math.isclose((up - loss()) / 2e-3, by_bias, abs_tol=2e-3)


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    """Repeated doc_ids, repeated rows and very long texts."""
    taken = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: taken.append((texts, labels)))
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids] + [(ids[0], f"other {k}") for k in range(300)] + [(ids[1], "text again")] * 300 + [(ids[2], "word " * 300_000), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(None, 1)], "doc_id long, toxic int")
    toxicity.fit(docs, labels, sample=50, most=1000)
    texts, y = taken[0]
    assert 5 < len(texts) <= 50 and sum(len(t) for t in texts) <= 1000 and len(set(y)) == 2
    scored = toxicity.score(docs, None).collect()
    assert len(scored) == docs.count() and {r.toxicity for r in scored} == {0.0}
