"""Exploratory aggregates of entity tables and truth, and of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def row_counts(sources: DataFrame) -> DataFrame:
    return sources.groupBy("source").agg(F.count("*").alias("n"))


def country_share(sources: DataFrame) -> DataFrame:
    counts = sources.groupBy("source", "country").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("source")))


def text_lengths(sources: DataFrame) -> DataFrame:
    """Mean and largest number of characters and words of names and addresses."""
    size = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))
    cols = []
    for name, c in (("name", F.col("business_name")), ("address", F.col("business_address"))):
        cols += [F.avg(F.length(F.coalesce(c, F.lit("")))).alias(f"{name}_chars_avg"), F.max(F.length(F.coalesce(c, F.lit("")))).alias(f"{name}_chars_max"), F.avg(size(c)).alias(f"{name}_words_avg"), F.max(size(c)).alias(f"{name}_words_max")]
    return sources.groupBy("source").agg(*cols)


def top_tokens(sources: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The most frequent words of over one character; punctuation is deleted, not blanked; ties by word."""
    flat = F.regexp_replace(F.lower(F.col(column)), r"[^\w\s]", "")
    words = sources.where(F.col(column).isNotNull()).select(F.explode(F.split(flat, r"\s+")).alias("token")).where(F.length("token") > 1)
    return words.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(n)


def match_histogram(lists: DataFrame) -> DataFrame:
    """Records by number of matches, four and more together."""
    return lists.groupBy(F.least(F.size("ids"), F.lit(4)).alias("matches")).agg(F.count("*").alias("records"))


def singleton_share(lists: DataFrame) -> DataFrame:
    return lists.agg(F.count("*").alias("records"), F.count_if(F.size("ids") == 0).alias("singletons"), F.count_if(F.size("ids") > 0).alias("matched"))


def origin_split(lists: DataFrame) -> DataFrame:
    """Records by the pools that their matches come from."""
    has = lambda p: F.exists("ids", lambda x: x.startswith(p))
    kind = F.when(F.size("ids") == 0, "No Match").when(has("S2-") & has("S3-"), "Both").when(has("S2-"), "Only S2").when(has("S3-"), "Only S3").otherwise("Other")
    return lists.groupBy(kind.alias("origin")).agg(F.count("*").alias("records"))


def house_coverage(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.sum("has_house_number").alias("with_house"), F.avg("has_house_number").alias("share"))


def inspect_matches(s1: DataFrame, pool: DataFrame, truth: DataFrame) -> DataFrame:
    """True pairs side by side."""
    a = s1.select(F.col("entity_id").alias("s1_id"), F.col("business_name").alias("s1_name"), F.col("business_address").alias("s1_address"))
    b = pool.select(F.col("entity_id").alias("candidate_id"), "source", F.col("business_name").alias("candidate_name"), F.col("business_address").alias("candidate_address"))
    return truth.join(a, "s1_id").join(b, "candidate_id")


# ---- predictions -----------------------------------------------------------------------------------------------------


def match_lists(pairs: DataFrame) -> DataFrame:
    """s1_id, ids: distinct predicted ids, most probable first. pairs: s1_id, candidate_id, score."""
    best = pairs.groupBy("s1_id", "candidate_id").agg(F.max("score").alias("score"))
    gathered = best.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), F.col("candidate_id").alias("id")))).alias("x"))
    return gathered.select("s1_id", F.concat_ws(",", "x.id").alias("ids"))


def filled_lists(s1: DataFrame, lists: DataFrame) -> DataFrame:
    """A row for every record, blank where it has no list."""
    return s1.select(F.col("entity_id").alias("s1_id")).join(lists, "s1_id", "left").withColumn("ids", F.coalesce("ids", F.lit("")))


def prediction_totals(lists: DataFrame) -> DataFrame:
    n = F.when(F.col("ids") == "", 0).otherwise(F.size(F.split("ids", ",")))
    return lists.agg(F.count("*").alias("records"), F.sum(n).alias("matches"), F.count_if(n == 0).alias("singletons"), (100.0 * F.count_if(n == 0) / F.greatest(F.count("*"), F.lit(1))).alias("singleton_percent"))
