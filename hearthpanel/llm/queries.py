"""The registered queries of the training-data operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthpanel.llm import alignment, attribution, bpe, decontaminate, hilbert, jaccard, language_model, packing, quality, runs, suffixes
from hearthpanel.llm import oracles, token_files, url_filter
from hearthpanel.llm.common import store, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op3_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op4_ngram_jaccard": oracles.NGRAM_JACCARD,
    "url_rules": oracles.URL_RULES,
}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "start",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
        "frame",
    )


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    return packing.pack(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, sections = attribution.record_sections(F.col("source"), F.col("lang"), F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), sections.alias("sections"))
    counted = attribution.attribute(docs)
    return counted.select("doc_id", "section", F.col("tokens").cast("long").alias("tokens"), "crossing", "doc_tokens")


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


@query
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules alone say of every page; the trees judge those without one in ``op6_url_filter``."""
    host, path = url_filter.parts(F.col("url"))
    placed = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = url_filter.rule_of(F.col("host"), F.col("path"))
    return placed.withColumns({"rule": rule, "verdict": verdict})


@query
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = suffixes.repeated_spans(table(spark, sf_dir, "documents"))
    return spans.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"),
        "links",
    )
    return alignment.with_link_counts(store(aligned, "alignment")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


@query
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.code(table(spark, sf_dir, "documents")).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: One document in so many gets planted repeats, by the crc32 of its id.
REPEATS = 10


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapse(table(spark, sf_dir, "documents"), repeat_share=REPEATS)
    # The greatest exact length/period by cross multiplication; runs are in order of start and period, and ties stay with the first.
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    top = F.aggregate(
        "runs",
        none,
        lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("*", top.alias("top")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.expr("1000 * top.length div top.period").cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
