"""A training corpus from raw documents in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``, extra ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthpanel.llm import decontaminate, jaccard, quality, suffixes
from hearthpanel.llm.common import free_name, new_folder, table
from hearthpanel.llm.queries import packed

#: Word shingles and similarity of near duplicates.
SHINGLE = 5
PERCENT = 80
#: Parts in which the rows of a group of near duplicates are joined to it.
SALTS = 16
#: Labels of documents whose id leaves this are not learned from, as in the operator's own query.
FOLDS = 3


def identified(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` as one struct column ``row``, beside their id and a hash of the text that tells rows of one id apart."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.struct(*docs.columns).alias("row"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field does not reject.

    Rows with a null or empty text get the share of good documents; every row
    is judged by its own text, repeated ids and null ids too.
    """
    labels = table(spark, sf_dir, "labels").filter(~quality.held_out(F.col("doc_id"), FOLDS))
    score = free_name(docs, "quality")
    scored = quality.score_documents(docs, quality.fit(docs, labels), keep=docs.columns, score=score)
    return scored.filter(F.col(score) >= 0.5).select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Texts without words and rows with a null id stay. Rows that repeat an id
    are judged each by its own text; those of the group's smallest id stay.
    """
    rows = identified(docs)
    # The join tells texts apart by its ids, so each text of an id gets one of its own.
    own = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    named = rows.select(own.alias("doc_id"), "text", F.col("doc_id").alias("id"), "text_hash")
    joined = jaccard.jaccard_join(named, n=SHINGLE, percent=PERCENT, also=["id", "text_hash"]).filter("component_id is not null")
    groups = joined.groupBy("component_id").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    # A group may hold a third of all rows: they meet their group's first id in SALTS places.
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = joined.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    gone = salted.join(groups, ["component_id", "salt"]).filter("id > first").select(F.col("id").alias("doc_id"), "text_hash").distinct()
    return rows.join(gone, ["doc_id", "text_hash"], "left_anti").select("row.*")


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that start in a smaller id too; ``n_chars`` counts what is left.

    No row goes: a text of which nothing is left is empty, a null text stays
    null, and a row with a null id keeps its text. Rows that repeat an id and a
    text lose the same strings.
    """
    cut = suffixes.without_spans(docs, suffixes.repeated_spans(docs))
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none. Rows are judged each by its own text, also
    where they repeat an id or have none.
    """
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_hash").cast("string"))
    rows = identified(docs).withColumn("name", name)
    found = decontaminate.leaks(rows.select(F.col("name").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(found.select(F.col("doc_id").alias("name")).distinct(), "name", "left_anti").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of token ids. Null and empty texts give the end id alone; every row is packed."""
    return packed(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram jaccard join", jaccard_stage),
    ("suffix-array dedup", suffix_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# Neither the field, the packing nor look-behind patterns can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
