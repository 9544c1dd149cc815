"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled URLs train the trees, chosen by a hash of the URL.
SAMPLE = 20_000
#: Host endings with fewer labelled URLs than this have no statistics of their own.
SUFFIX_SUPPORT = 5
#: Labelled URLs are dealt into so many folds; the trees see a rate that the others of a URL's fold have no part in.
FOLDS = 5
TREES = 20
DEPTH = 4
# (verdict, host, path prefix)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
LEXICAL = [
    "url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "host_digit_ratio",
    "entropy", "host_entropy", "parameters", "hyphens", "secure", "longest_label", "suffix_rate", "suffix_known",
]


def parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path; both are empty for null and for a URL without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longer ones are tried first, so they wrap the others
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix))
        rule, verdict = F.when(fits, name + prefix).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits per character of a short text."""
    letters = F.split(text, "")
    size = F.greatest(F.char_length(text), F.lit(1))

    def bits(c: Column) -> Column:
        share = (F.char_length(text) - F.char_length(F.replace(text, c, F.lit("")))) / size
        return -share * F.log2(share)

    return F.when(F.char_length(text) > 0, F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda total, c: total + bits(c))).otherwise(0.0)


def _digits(text: Column) -> Column:
    return F.try_divide(F.char_length(F.regexp_replace(text, "[^0-9]", "")), F.char_length(text))


def lexical(pages: DataFrame) -> DataFrame:
    """Lexical features of ``url``, ``host`` and ``path``; null URLs count as empty."""
    url, host, path = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    # One URL of any length stays one row; the entropy looks at the characters of its host and path.
    return pages.withColumns(
        {
            "url_length": F.log1p(F.char_length(url)),
            "host_length": F.char_length(host),
            "path_length": F.log1p(F.char_length(path)),
            "host_depth": F.size(F.split(host, r"\.")),
            "path_depth": F.log1p(F.char_length(F.regexp_replace(path, "[^/]", ""))),
            "digit_ratio": F.coalesce(_digits(url), F.lit(0.0)),
            "host_digit_ratio": F.coalesce(_digits(host), F.lit(0.0)),
            "entropy": _entropy(path),
            "host_entropy": _entropy(host),
            "parameters": F.when(query == "", 0.0).otherwise(1.0 + F.char_length(F.regexp_replace(query, "[^&]", ""))),
            "hyphens": F.char_length(F.regexp_replace(host, "[^-]", "")),
            "secure": F.startswith(url, F.lit("https:")).cast("double"),
            "longest_label": F.array_max(F.transform(F.split(host, r"\."), lambda x: F.char_length(x))),
            "suffix": F.substring_index(host, ".", -1),
        }
    )


def suffix_statistics(labelled: DataFrame, support: int = SUFFIX_SUPPORT) -> DataFrame:
    """Share of allowed URLs of each host ending, over all labelled URLs, drawn towards the share of all."""
    counts = labelled.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good"))
    return counts.filter(F.col("n") >= support).select("suffix", ((F.col("good") + 1) / (F.col("n") + 2)).alias("suffix_rate"))


def out_of_fold(labelled: DataFrame, support: int = SUFFIX_SUPPORT, folds: int = FOLDS) -> DataFrame:
    """``labelled`` with the ``suffix_rate`` of its host ending over the labelled URLs of all other folds, null below ``support``.

    So no URL's own label is part of what the trees learn from. Folds follow a hash of the URL.
    """
    dealt = labelled.withColumn("fold", F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(folds)))
    counts = dealt.groupBy("suffix", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good"))
    whole = counts.groupBy("suffix").agg(F.sum("n").alias("all_n"), F.sum("good").alias("all_good"))
    n, good = F.col("all_n") - F.col("n"), F.col("all_good") - F.col("good")
    rates = counts.join(whole, "suffix").filter(n >= support).select("suffix", "fold", ((good + 1) / (n + 2)).alias("suffix_rate"))
    return dealt.join(rates, ["suffix", "fold"], "left").drop("fold")


def _vectors(features: DataFrame, rates: DataFrame) -> DataFrame:
    return _assembled(features.join(rates, "suffix", "left"))


def _assembled(known: DataFrame) -> DataFrame:
    known = known.withColumn("suffix_known", F.col("suffix_rate").isNotNull().cast("double")).fillna(0.5, ["suffix_rate"])
    return VectorAssembler(inputCols=LEXICAL, outputCol="features", handleInvalid="keep").transform(known)


def fit(labelled: DataFrame, *, sample: int = SAMPLE) -> tuple[DataFrame, GBTClassificationModel | float]:
    """Suffix statistics and trees from labelled URLs (url, host, path, label 0 or 1).

    With no or one label there is nothing to boost: the share of allowed URLs
    (0.5 if there are none) takes the trees' place.
    """
    features = lexical(labelled)
    rates = suffix_statistics(features)
    chosen = out_of_fold(features).orderBy(F.xxhash64("url"), "url").limit(sample)
    found = chosen.agg(F.count_distinct("label").alias("kinds"), F.avg("label").alias("share")).first()
    if found.kinds < 2:
        return rates, 0.5 if found.share is None else float(found.share)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, featuresCol="features", labelCol="label", checkpointInterval=-1)
    return rates, trees.fit(_assembled(chosen).select("features", F.col("label").cast("double").alias("label")).coalesce(1))


def filter_urls(pages: DataFrame, *, rules: list[tuple[str, str, str]] = RULES, keep: list[str] | None = None) -> DataFrame:
    """Host, path, rule, score and verdict of every row of (page_id, url).

    The rules label the URLs they fit; trees fitted on these judge the rest.
    Every row is judged, also repeated ones, null URLs (empty host and path)
    and null ids; an empty table gives none. Other columns are not read.
    """
    keep = keep or ["page_id"]
    host, path = parts(F.col("url"))
    placed = pages.select(*dict.fromkeys([*keep, "url"])).withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = placed.withColumns({"rule": rule, "ruled": verdict})
    labelled = ruled.filter("ruled is not null and url is not null").select("url", "host", "path", (F.col("ruled") == "allow").cast("int").alias("label"))
    rates, model = fit(labelled.distinct())
    if isinstance(model, float):
        scored = ruled.withColumn("score", F.lit(model))
    else:
        score = vector_to_array("probability")[1]
        scored = model.transform(_vectors(lexical(ruled), rates)).withColumn("score", score)
    verdict = F.coalesce(F.col("ruled"), F.when(F.col("score") >= 0.5, "allow").otherwise("block"))
    return scored.select(*keep, "host", "path", "rule", "score", verdict.alias("verdict"))
