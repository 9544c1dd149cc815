"""The corpus pipeline, stage by stage, against what each stage is to do with its input."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from hearthpanel.llm import decontaminate, quality
from hearthpanel.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stage_list():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram jaccard join", "suffix-array dedup", "benchmark decontamination", "packing"]


def test_stages(spark):
    docs = table(spark, SF, "documents").withColumns({"score": F.lit("kept"), "n": F.lit(1), "names": F.lit("x")})
    extra = [(None, "a row without an id and with a clean text.", "en", "s", 1), (900, None, "en", "s", 0), (901, "", "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame([(*e, "kept", 1, "x") for e in extra], docs.schema))
    columns = docs.columns
    (_, classify), (_, near), (_, strings), (_, leaks), (_, pack) = corpus_pipeline.STAGES

    good = classify(spark, docs, SF)
    assert good.columns == columns and good.schema == docs.schema
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in good.collect()}
    clean = [d for d, q in labels.items() if q == 1]
    assert len(kept & set(clean)) >= 0.97 * len(clean) and not {d for d, q in labels.items() if q == 0} & kept
    assert {None, 900, 901} <= kept

    good = spark.createDataFrame(good.collect(), good.schema)
    one = near(spark, good, SF)
    assert one.columns == columns
    one = spark.createDataFrame(one.collect(), one.schema)
    sets = {}
    for r in good.collect():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode().lower() if (r.text or "").isascii() else re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r.text or "").encode()))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    left = {r.doc_id for r in one.collect()}
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b) and a
    for d in set(sets) - left:  # every document that went has a near duplicate with a smaller id
        assert any(x is not None and x < d and alike(sets[x], sets[d]) for x in sets)
    stay = [d for d in left if d is not None]
    assert not [(a, b) for a in stay for b in stay if a < b and alike(sets[a], sets[b])]
    assert {None, 900, 901} <= left

    cut = strings(spark, one, SF)
    assert cut.columns == columns
    cut = spark.createDataFrame(cut.collect(), cut.schema)
    assert cut.count() == one.count()
    seen = {}
    for r in sorted((r for r in cut.collect() if r.doc_id is not None), key=lambda r: r.doc_id):
        assert r.text is None or r.n_chars == len(r.text)
        seen[r.doc_id] = r.text
    assert seen[900] is None

    pure = leaks(spark, cut, SF)
    assert pure.columns == columns
    found = {r.doc_id for r in decontaminate.leaks(cut, table(spark, SF, "benchmark")).collect()}
    assert {r.doc_id for r in pure.collect()} == {r.doc_id for r in cut.collect()} - found

    pieces = pack(spark, pure, SF).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in pure.collect()}


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 4096


def test_stages_on_empty_tables(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
    assert quality.classify(docs, table(spark, SF, "labels")).count() == 0


def test_rows_that_repeat_an_id_are_judged_by_their_own_text(spark):
    schema = table(spark, SF, "documents").schema
    item = table(spark, SF, "benchmark").first().text
    one = "a plain text of some words that two rows of this small table hold alike and whole"
    other = "nothing of this sentence occurs in any other row of the table that the test builds"
    rows = [(1, one), (5, one), (5, other), (None, one), (None, None), (7, "before it " + item), (7, "of yet another kind are the words that this row has"), (None, item), (8, ""), (8, None), (9, other + " seven")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda name: sorted(((r.doc_id, r.text) for r in stages[name](spark, docs, SF).collect()), key=str)
    gone = [(5, one), (9, other + " seven")]
    assert kept("n-gram jaccard join") == sorted(([r for r in rows if r not in gone]), key=str)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in [(1, other), (5, other + " seven"), (5, one)]], schema)
    assert kept("n-gram jaccard join") == [(1, other), (5, one)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)
    assert kept("benchmark decontamination") == sorted([r for r in rows if item not in (r[1] or "")], key=str)


def test_stages_take_columns_of_any_name(spark):
    docs = table(spark, SF, "documents").limit(30)
    clash = ["quality", "_quality", "sha", "spans", "_spans", "_sha", "row", "name", "text_hash", "component_id", "k1", "n", "links", "item_id"]
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id")) for c in clash})
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        for r in kept.collect():
            assert all(r[c] == f"{c} of {r.doc_id}" for c in clash), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == docs.count()
