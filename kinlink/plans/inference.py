"""Entity tables in, result files out; and training from labelled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.operators import blocking, explore, features, learn, metrics
from kinlink.plans import linkage
from kinlink.profiles import PACKAGE, Profile
from kinlink.sources import entities, sinks


def prepared(spark: SparkSession, path: str, profile: Profile = PACKAGE, cache: str | None = None) -> DataFrame:
    """A normalised entity table, from its cache if there is one."""
    build = lambda: linkage.normalized(entities.read_entities(spark, path), profile)
    return entities.cached(spark, cache, build) if cache else build()


def train(spark: SparkSession, source1: str, source2: str, source3: str, truth: str, model_path: str, profile: Profile = PACKAGE, folds: int = 5, trees: int = learn.TREES) -> float:
    """Fits a model per fold, saves all of them with the held-out scores and each fold's number of trees, returns the
    threshold with the best macro F0.5 on held-out scores."""
    s1 = prepared(spark, source1, profile)
    pool = blocking.candidate_pool(prepared(spark, source2, profile), prepared(spark, source3, profile))
    pairs_of = entities.truth_pairs(spark.read.schema(entities.TRUTH).option("sep", "\t").option("header", True).csv(truth))
    models, scored = learn.train_folds(features.with_labels(linkage.linked_pairs(s1, pool, profile), pairs_of), folds, trees)
    learn.save(models, model_path)
    kept = scored.select("s1_id", "candidate_id", "source", "label", "score", "fold")
    sinks.write_table(kept, f"{model_path}/oof_scores")
    scored = spark.read.parquet(f"{model_path}/oof_scores")
    trees_of = list(enumerate(learn.best_iterations(models)))
    sinks.write_table(spark.createDataFrame(trees_of, "fold int, trees int"), f"{model_path}/best_iterations")
    best = metrics.macro_threshold(s1, pairs_of, scored).orderBy(F.desc("macro_f05"), "threshold").first()
    return best.threshold


def infer(spark: SparkSession, source1: str, source2: str, source3: str, model_path: str, out: str, profile: Profile = PACKAGE, threshold: float | None = None, folds: int = 5) -> None:
    """Writes matching_results and candidate_pairs under out, a row for every record of source 1. The scored pairs are
    written once, so both files come from one run of the plan."""
    s1 = prepared(spark, source1, profile)
    pool = blocking.candidate_pool(prepared(spark, source2, profile), prepared(spark, source3, profile))
    candidates = blocking.top_candidates(s1, pool, profile)
    scored = learn.ensemble(learn.load(model_path, folds), features.pair_features(s1, candidates, profile))
    sinks.write_table(scored.select("s1_id", "candidate_id", "source", "score", "blocking_score"), f"{out}/scored_pairs")
    pairs = spark.read.parquet(f"{out}/scored_pairs")
    matched = explore.match_lists(learn.decide(pairs, profile.threshold if threshold is None else threshold))
    listed = explore.match_lists(pairs.select("s1_id", "candidate_id", F.col("blocking_score").alias("score")))
    for name, lists, column in (("matching_results.tsv", matched, "matched_entity_ids"), ("candidate_pairs.tsv", listed, "candidate_entity_ids")):
        sinks.write_lists(explore.filled_lists(s1, lists).toDF("source1_entity_id", column), f"{out}/{name}")
