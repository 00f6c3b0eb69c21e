"""The pipeline's stages, one by one, against plain statements of what each keeps; queries with SQL against it."""

from collections import Counter, defaultdict

import pyarrow as pa
import pytest

import corpus_pipeline
import oracle
from assetspark.llm import packing, toxicity
from assetspark.llm.common import small_batches, stored
from assetspark.llm.queries import ORACLES, QUERIES
from test_corpus_operators import dedup_truth, join_truth, mix_targets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), "step")
        out.append(docs.collect())
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == COLUMNS
    return out


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]


def test_toxic_documents_go(spark, sf_dir, steps):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in toxicity.toxicity_digest(docs, labels).collect() if not r.predicted}
    assert {r.doc_id for r in steps[1]} == kept and len(steps[1]) < len(steps[0])


def test_later_runs_go(steps):
    """Repeated lines of three words or more, but for texts under 50 words that are nothing else."""
    before = {r.doc_id: r.text for r in steps[1]}
    truth = dedup_truth(before, 3)
    spared = {i: before[i] for i, t in truth.items() if t == "" and before[i] and len(before[i].encode().split()) < corpus_pipeline.PASSAGE}
    assert {r.doc_id: r.text for r in steps[2]} == {i: t for i, t in truth.items() if t or not before[i]} | spared
    assert all(r.n_chars == len(r.text) for r in steps[2])


def test_one_of_each_group_stays(steps):
    """Near copies at five words and a similarity of 0.8."""
    truth = join_truth({r.doc_id: r.text for r in steps[2]}, 5, 4, 5)
    assert {r.doc_id for r in steps[3]} == {i for i, (_, c) in truth.items() if i == c} and len(steps[3]) < len(steps[2])


@pytest.mark.parametrize("most", [0, corpus_pipeline.GONE_IDS])
def test_near_copies_go_without_a_shuffle_of_the_texts(spark, sf_dir, monkeypatch, most):
    """What a sort-merge join would shuffle are the whole texts; only beyond GONE_IDS is there one, with the same rows."""
    monkeypatch.setattr(corpus_pipeline, "GONE_IDS", most)
    words = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{words} end{i}" if i < 4 else f"text {i} stands alone here with words of its own", "en", "s", 9) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.keep_one_of_alike(spark, docs, sf_dir)
        assert ("SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()) == (most == 0)
        assert sorted(r.doc_id for r in out.collect()) == [0, 4, 5, 6, 7, 8]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


ODD = "doc_id long, text string, lang string, source string, n_chars long, copies string, n_lines string, n_deleted int, score string, rest string, tag int, id int, row string, size int, component_id int, `a.b` string"
LINE = "one line of words that is long enough to be a passage by itself "


def odd_rows(spark):
    extra = ("c", "l", 7, "s", "r", 3, 4, "w", 5, 6, "dot")
    texts = [(1, "alpha beta gamma delta epsilon"), (2, None), (None, None), (None, "lonely words without an id here"), (None, "lonely words without an id here"), (3, ""), (4, LINE * 6), (5, LINE * 6), (5, LINE * 6), (6, "first\n" + LINE * 6), (7, "x"), (7, "some other text of the same id")]
    return spark.createDataFrame([(i, t, "en", None if i == 6 else f"s{(i or 0) % 3}", len(t or ""), *extra) for i, t in texts], ODD)


@pytest.mark.parametrize("k", range(5))
def test_stages_keep_odd_rows_and_columns(spark, sf_dir, k):
    """Nulls, equal rows, clashing columns and empty tables, stage by stage."""
    docs, stage = odd_rows(spark), corpus_pipeline.STAGES[k][1]
    out = stage(spark, docs, sf_dir)
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
    if k == 4:
        assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in docs.collect())  # all are one piece
        return
    assert out.columns == docs.columns
    kept = out.collect()
    assert all((r.copies, r.n_lines, r.n_deleted, r.score, r.rest, r.tag, r["a.b"]) == ("c", "l", 7, "s", "r", 3, "dot") for r in kept)
    texts = sorted(((r.doc_id or 0), r.text or "") for r in kept)
    if k == 0:
        assert len(kept) == 12
    if k == 1:
        assert [t for i, t in texts if i in (4, 5)] == [LINE * 6] and [t for i, t in texts if i == 6] == ["first"] and len(kept) == 10
    if k == 2:
        assert [i for i, _ in texts] == [0, 0, 1, 2, 3, 4, 7, 7]  # equal rows once, both texts of one doc_id
    if k == 3:
        most = Counter((r.doc_id, r.text) for r in docs.collect())
        assert all(n <= 3 * most[key] for key, n in Counter((r.doc_id, r.text) for r in kept).items())


@pytest.mark.parametrize("k", [0, 2, 4])
def test_long_texts_travel_in_small_arrow_batches(spark, sf_dir, k):
    """After each stage with Python; a bound that the session set itself stays."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(bound)
    spark.conf.unset(bound)
    try:
        corpus_pipeline.STAGES[k][1](spark, odd_rows(spark), sf_dir)
        texts = spark.range(0, 24, 1, 1).selectExpr("repeat('x', 1000000) AS text")
        sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"rows": [b.num_rows], "size": [b.nbytes]}) for b in batches), "rows long, size long").collect()
        assert sum(r["rows"] for r in sizes) == 24 and max(r["size"] for r in sizes) < 6_000_000
        spark.conf.set(bound, "1m")
        small_batches(spark)
        assert spark.conf.get(bound) == "1m"
    finally:
        spark.conf.set(bound, was)


def test_mix_nears_its_targets(steps):
    words = lambda t: len((t or "").encode().split())
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in steps[3]:
        sizes[r.source] += words(r.text)
    for r in steps[4]:
        taken[r.source] += words(r.text)
    for s, target in mix_targets(sizes).items():
        assert abs(taken[s] - target) <= max(60, 0.02 * target)
    assert max(Counter(r.doc_id for r in steps[4]).values()) <= 3


def test_all_is_packed(steps):
    copies = Counter(r.doc_id for r in steps[4])
    enc = packing.encoder(packing.tokenizer_path())
    lengths = {r.doc_id: len(enc.encode(r.text)) // 4 + 1 if r.text else 1 for r in steps[4]}
    packed, bins = defaultdict(int), defaultdict(list)
    for r in steps[5]:
        packed[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert packed == {i: n * lengths[i] for i, n in copies.items()}
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = oracle.connect(sf_dir)
    assert oracle.rows_of_frame(QUERIES[name](spark, sf_dir)) == oracle.rows_of_sql(con, ORACLES[name])


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
