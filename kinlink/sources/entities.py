"""Readers: entity tables, truth, result lists; and the adapter from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from kinlink.functions import dictionaries as D
from kinlink.scratch import materialise

ENTITY = T.StructType([T.StructField("entity_id", T.StringType())] + [T.StructField(c, T.StringType()) for c in ("business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField("source1_entity_id", T.StringType()), T.StructField("matched_entity_ids", T.StringType())])


def na_to_null(column: Column) -> Column:
    """Texts that stand for a missing value become null."""
    return F.when(~column.isin(D.NA_STRINGS), column)


def read_entities(spark: SparkSession, path: str, na_strings: bool = True) -> DataFrame:
    """A tab-separated table with a header, by name, never by position."""
    header = spark.read.option("sep", "\t").option("header", True).csv(path).columns
    rows = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in header])).option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    value = na_to_null if na_strings else lambda c: c
    return rows.select(*[(value(F.col(c)) if c in header else F.lit(None).cast("string")).alias(c) for c in ENTITY.names])


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first of several places that holds data."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(", ".join(paths))


def cached(spark: SparkSession, path: str, build, needs: tuple[str, ...] = ("clean_name",)) -> DataFrame:
    """The Parquet table at path if it was written whole and has the needed columns; else built, written and read."""
    if exists(spark, f"{path}/_SUCCESS"):
        rows = spark.read.parquet(path)
        if set(needs) <= set(rows.columns):
            return rows
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def reload_features(spark: SparkSession, frame: DataFrame | None, parquet: str, csv: str) -> DataFrame:
    """Pair features from memory, else Parquet, else CSV."""
    if frame is not None:
        return frame
    if exists(spark, parquet):
        return spark.read.parquet(parquet)
    if exists(spark, csv):
        return spark.read.option("header", True).option("inferSchema", True).csv(csv)
    raise FileNotFoundError(f"{parquet}, {csv}")


def split_ids(column: Column, trim: bool = True) -> Column:
    """Ids of a comma list; null and blank lists are empty."""
    ids = F.split(F.coalesce(column, F.lit("")), ",")
    ids = F.transform(ids, lambda x: F.trim(x)) if trim else ids
    return F.filter(ids, lambda x: x != "")


def truth_lists(truth: DataFrame, trim: bool = True, strict_reference: bool = False) -> DataFrame:
    """s1_id, ids. strict_reference keeps the text "nan" that a missing list would turn into."""
    ids = split_ids(F.col("matched_entity_ids"), trim)
    if strict_reference:
        ids = F.when(F.col("matched_entity_ids").isNull(), F.array(F.lit("nan"))).otherwise(ids)
    return truth.select(F.col("source1_entity_id").alias("s1_id"), ids.alias("ids"))


def truth_pairs(truth: DataFrame, **how) -> DataFrame:
    return truth_lists(truth, **how).select("s1_id", F.explode("ids").alias("candidate_id")).distinct()


def required_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct first columns of a table, header and blank lines aside."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    first = lines.select(F.trim(F.split("value", "\t")[0]).alias("entity_id"))
    return first.where(~F.lower("entity_id").isin("entity_id", "source1_entity_id")).distinct()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value of a text file, or of a folder of parts that each start with the same header; malformed lines stay. A
    part's header counts once, for the first part. Lines are numbered by file and place: blocks of a file are counted,
    and their numbers carried over, in tables of a row for each block."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_at"))
    rows = materialise(raw, "lines")
    blocks = rows.groupBy("_f", "_b").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    first = F.row_number().over(W.partitionBy("_f").orderBy("_b")) == 1
    several = blocks.select("_f").distinct().count() > 1
    order = W.orderBy("_f", "_b").rowsBetween(W.unboundedPreceding, -1)
    leading = F.row_number().over(W.orderBy("_f", "_b")) == 1
    marked = blocks.withColumn("_head", first & ~leading & F.lit(several)).withColumn("_own", F.col("_n") - F.col("_head").cast("long"))
    before = marked.select("_f", "_b", "_first", "_head", F.coalesce(F.sum("_own").over(order), F.lit(0)).alias("_before"))
    numbered = rows.join(F.broadcast(before), ["_f", "_b"]).withColumn("_place", F.col("_at") - F.col("_first") + 1 - F.col("_head").cast("long"))
    return numbered.where("_place > 0").select((F.col("_before") + F.col("_place")).alias("line_no"), "value")


def parse_lists(lines: DataFrame) -> DataFrame:
    """line_no, s1_id, ids, malformed: rows of a result file after its header; the list starts after the first tab."""
    body = lines.where((F.col("line_no") > 1) & (F.trim("value") != ""))
    cut = F.split("value", "\t", 2)
    listed = F.get(cut, 1)
    ids = F.when(F.coalesce(F.trim(listed), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(listed, ","))
    return body.select("line_no", F.trim(cut[0]).alias("s1_id"), ids.alias("ids"), listed.isNull().alias("malformed"))


# ---- adapter from the driver's tables --------------------------------------------------------------------------------


def adapted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, entity_id, business_name, business_address, country made from documents: the id's last digit picks the
    source, the text's start is the name and what follows the address."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source = F.when(F.col("doc_id") % 10 == 0, "S1").when(F.col("doc_id") % 2 == 1, "S2").otherwise("S3")
    country = F.when(F.col("lang") == "en", "US").when(F.col("lang") == "fr", "France").otherwise("India")
    return docs.select(source.alias("source"), F.concat_ws("-", source, F.col("doc_id").cast("string")).alias("entity_id"), F.substring("text", 1, 40).alias("business_name"), F.substring("text", 41, 80).alias("business_address"), country.alias("country"))


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return adapted(spark, sf_dir).where(F.col("source") == name)


def adapted_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source1_entity_id, matched_entity_ids: other records whose name has the same lower-cased text."""
    rows = adapted(spark, sf_dir).withColumn("key", F.lower("business_name"))
    pool = rows.where("source <> 'S1'").groupBy("key").agg(F.concat_ws(",", F.array_sort(F.collect_list("entity_id"))).alias("matched_entity_ids"))
    return rows.where("source = 'S1'").join(pool, "key", "left").select(F.col("entity_id").alias("source1_entity_id"), "matched_entity_ids")


def adapted_keys(s1: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """s1_id, key and candidate_id, key: records whose keys are equal are the pairs of adapted_truth."""
    key = F.lower("business_name").alias("key")
    return s1.select(F.col("entity_id").alias("s1_id"), key), pool.select(F.col("entity_id").alias("candidate_id"), key)
