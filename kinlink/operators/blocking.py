"""Candidate generation: a token join inside each country, weighted scores, exact top-k.

Pairs are made tile by tile (`tiles`): each task counts the common tokens of the pairs of two cells of records, so pairs are
neither shuffled nor written, and only the k best of each record leave a tile where ranks are asked for. Names and
addresses are joined after the cut. Where token rows are joined instead (light tokens of `pruned_candidates`, `retrieved`),
a token with over HOT rows on either side is dealt over cells: its records are cut into groups of HOT, its candidates
likewise, and each pair of groups is a key of its own, so no task takes a token whole.

A token that many candidates share costs its list's length for every record that has it. `pruned_candidates` scores the
rare tokens of a record first; where its k-th best score beats all that frequent tokens and the state could add, pairs
that only frequent tokens would bring are left out, and frequent tokens are counted on the pairs at hand. The result is
the same, ties included, as ties are broken by id and pruning is strict.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinlink.functions import tokens
from kinlink.operators import tiles
from kinlink.profiles import PACKAGE, PROFILES, Profile
from kinlink.scratch import materialise

#: Rows of one token, on each side, that are joined under one key.
HOT = 20_000
CANDIDATE_COLUMNS = ["entity_id", "source", "country", "business_name", "clean_name", "business_address", "clean_address", "state", "house_number"]


def present(df: DataFrame, wanted: list[str]) -> list[str]:
    """Those of the wanted columns that df has."""
    return [c for c in wanted if c in df.columns]


def candidate_pool(source2: DataFrame, source3: DataFrame) -> DataFrame:
    """Both pools with their source's name."""
    return source2.withColumn("source", F.lit("S2")).unionByName(source3.withColumn("source", F.lit("S3")), allowMissingColumns=True)


def _classes(profile: Profile, query: bool) -> dict[str, Column]:
    """Token arrays by class. Only the query side has the joined name."""
    name, address = tokens.word_tokens(F.col("clean_name")), tokens.longer(tokens.word_tokens(F.col("clean_address")))
    extra = tokens.joined(tokens.words(F.col("clean_name"))) if query else F.array().cast("array<string>")
    kinds = profile.weights
    found = {"addr": address}
    if "name" in kinds:
        found["name"] = name
    elif "brand" in kinds:
        found["generic"] = tokens.generic(name)
        found["len1"] = tokens.brand(tokens.one_letter(name))
        found["brand"] = F.array_union(tokens.brand(tokens.longer(name)), tokens.brand(extra) if query else extra)
    else:
        found["len1"] = tokens.one_letter(name)
        found["gt1"] = F.array_union(tokens.longer(name), extra)
    return found


def token_rows(rows: DataFrame, profile: Profile = PACKAGE, query: bool = False) -> DataFrame:
    """entity_id, country, state, class, token: each token of a record once. States travel with tokens, of which there are
    far fewer than pairs, so pairs need no join to learn them."""
    lists = F.array(*[F.struct(F.lit(k).alias("class"), F.array_distinct(v).alias("tokens")) for k, v in _classes(profile, query).items()])
    each = rows.where("country is not null").select("entity_id", "country", "state", F.explode(lists).alias("x"))
    return each.select("entity_id", "country", "state", F.col("x.class").alias("class"), F.explode("x.tokens").alias("token"))


def query_rows(s1: DataFrame, profile: Profile = PACKAGE) -> DataFrame:
    return token_rows(s1, profile, query=True).withColumnsRenamed({"entity_id": "s1_entity_id", "state": "s1_state"})


def dealt_join(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str, hot: int | None = None) -> DataFrame:
    """Inner join on the given columns. A key of over `hot` rows on a side is cut into cells by hashes of the ids; the other
    side's rows are repeated for each cell. Keys that are not hot are joined as they are."""
    hot = HOT if hot is None else hot

    def cells(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(*on, F.ceil(F.col("_n") / hot).cast("int").alias(name))

    big = cells(left, "_cl").join(cells(right, "_cr"), on, "full").na.fill(1, ["_cl", "_cr"])

    def dealt(rows: DataFrame, by: str, own: str, other: str) -> DataFrame:
        mine, theirs = (F.coalesce(c, F.lit(1)) for c in (own, other))
        placed = rows.join(big, on, "left").withColumn(f"{own}_at", F.pmod(F.xxhash64(by), mine).cast("int"))
        return placed.withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), theirs - 1))).drop("_cl", "_cr")

    keys = [*on, "_cl_at", "_cr_at"]
    return dealt(left, left_id, "_cl", "_cr").join(dealt(right, right_id, "_cr", "_cl"), keys).drop("_cl_at", "_cr_at")


def _counts(hits: DataFrame, profile: Profile) -> DataFrame:
    """One row for each pair with the number of common tokens by class, and whether states are equal."""
    kinds = [k for k in profile.weights if k != "state"]
    match = F.max(F.coalesce(F.col("s1_state") == F.col("state"), F.lit(False)).cast("int")).alias("state_match")
    return hits.groupBy("s1_entity_id", "entity_id").agg(*[F.sum((F.col("class") == k).cast("int")).cast("int").alias(k) for k in kinds], match)


def _asked(s1: DataFrame, profile: Profile, tag: str = "queries") -> DataFrame:
    return materialise(tiles.lists(s1, _classes(profile, True), profile), tag)


def _held(pool: DataFrame, profile: Profile) -> DataFrame:
    return materialise(tiles.lists(pool, _classes(profile, False), profile), "index")


def token_overlap(s1: DataFrame, pool: DataFrame, profile: Profile = PACKAGE, by: tuple[str, ...] | None = None) -> DataFrame:
    """s1_entity_id, entity_id, common distinct tokens by class and state_match, for pairs of one country with any token. by:
    counters that the caller keeps, all unless given."""
    return tiles.pairs(_asked(s1, profile), _held(pool, profile), profile, by)


def gated(pairs: DataFrame, profile: Profile) -> DataFrame:
    """Pairs that share a token of a class that counts as a signal."""
    return pairs.where(reduce(lambda a, b: a | b, [F.col(k) > 0 for k in profile.gate]))


def scored(pairs: DataFrame, profile: Profile = PACKAGE) -> DataFrame:
    """pairs with matching_score."""
    score = reduce(lambda a, b: a + b, [F.lit(w) * F.col("state_match" if k == "state" else k) for k, w in profile.score])
    return pairs.withColumn("matching_score", score)


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each record with their rank; ties by id."""
    by = W.partitionBy("s1_entity_id").orderBy(F.desc("matching_score"), "entity_id")
    return pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _named(pairs: DataFrame, profile: Profile) -> DataFrame:
    """Counters under their reported names."""
    kinds = [k for k in profile.weights if k not in ("addr", "state")]
    names = {"len1": "name_overlap_len1", "gt1": "name_overlap_gt1", "generic": "prefix_suffix_overlap", "brand": "proper_brand_overlap", "name": "name_overlap"}
    total = reduce(lambda a, b: a + b, [F.col(k) for k in kinds])
    renamed = pairs.withColumn("name_overlap_count", total).withColumnRenamed("addr", "address_overlap_count")
    return reduce(lambda d, k: d.withColumnRenamed(k, names[k]), kinds, renamed)


def attached(pairs: DataFrame, pool: DataFrame, profile: Profile = PACKAGE) -> DataFrame:
    """Candidates' columns, after the cut."""
    keep = [c for c in present(pool, CANDIDATE_COLUMNS) if c != "house_number" or profile.candidate_house]
    return pairs.join(pool.select(*keep), "entity_id")


def scored_candidates(s1: DataFrame, pool: DataFrame, profile: Profile = PACKAGE, by: tuple[str, ...] | None = None) -> DataFrame:
    return scored(gated(token_overlap(s1, pool, profile, by), profile), profile)


def block_topk(s1: DataFrame, pool: DataFrame, profile: Profile = PACKAGE) -> DataFrame:
    """s1_entity_id, entity_id, rank, counters, state_match, matching_score."""
    return _named(ranked(scored(tiles.best(_asked(s1, profile), _held(pool, profile), profile, profile.top_k), profile), profile.top_k), profile)


def top_candidates(s1: DataFrame, pool: DataFrame, profile: Profile = PACKAGE) -> DataFrame:
    return attached(block_topk(s1, pool, profile), pool, profile)


def pruned_candidates(s1: DataFrame, pool: DataFrame, profile: Profile = PACKAGE, frequent: int = 1000) -> DataFrame:
    """As block_topk, without pairs that only tokens of more than `frequent` candidates bring and that cannot rank."""
    weights, k = profile.weights, profile.top_k
    index = materialise(token_rows(pool, profile), "index")
    q = query_rows(s1, profile)
    heavy = index.groupBy("country", "class", "token").agg(F.count("*").alias("df")).where(F.col("df") > frequent).select("country", "class", "token", F.lit(True).alias("heavy"))
    marked = materialise(q.join(heavy, ["country", "class", "token"], "left").withColumn("heavy", F.coalesce("heavy", F.lit(False))), "marked")
    worth = reduce(lambda c, kv: c.when(F.col("class") == kv[0], F.lit(kv[1])), list(weights.items())[1:], F.when(F.col("class") == list(weights)[0], F.lit(weights[list(weights)[0]])))
    bound = marked.groupBy("s1_entity_id").agg(F.sum(F.when(F.col("heavy"), worth).otherwise(0.0)).alias("extra"))
    light = materialise(_counts(dealt_join(marked.where("not heavy").drop("heavy"), index, ["country", "class", "token"], "s1_entity_id", "entity_id"), profile), "light")
    own = reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for c, w in weights.items() if c != "state"])
    least = ranked(light.withColumn("matching_score", own), k).where(F.col("rank") == k).select("s1_entity_id", F.col("matching_score").alias("kth"))
    # Strictly: a pair that could only tie may still win by its id. A gate must be passable by light tokens alone.
    safe = materialise(bound.join(least, "s1_entity_id").where(F.col("kth") > F.col("extra") + weights.get("state", 0.0)).select("s1_entity_id"), "safe")
    open_s1 = s1.join(safe.withColumnRenamed("s1_entity_id", "entity_id"), "entity_id", "left_anti")
    full = tiles.best(_asked(open_s1, profile), _held(pool, profile), profile, k, "full")
    few = light.join(safe, "s1_entity_id", "left_semi")
    more = marked.where("heavy").drop("heavy").join(safe, "s1_entity_id", "left_semi")
    pool_lists = index.join(heavy, ["country", "class", "token"], "left_semi").groupBy("entity_id").agg(F.collect_set(F.struct("class", "token")).alias("_c"))
    query_lists = more.groupBy("s1_entity_id").agg(F.collect_set(F.struct("class", "token")).alias("_q"))
    both = few.join(query_lists, "s1_entity_id", "left").join(pool_lists, "entity_id", "left")
    common = F.coalesce(F.array_intersect("_q", "_c"), F.array().cast("array<struct<class:string,token:string>>"))
    kinds = [c for c in weights if c != "state"]

    def extra(kind: str) -> Column:
        return (F.col(kind) + F.size(F.filter("_both", lambda x: x["class"] == kind))).cast("int").alias(kind)

    filled = both.withColumn("_both", common).select("s1_entity_id", "entity_id", *map(extra, kinds), "state_match")
    return _named(ranked(scored(gated(filled.unionByName(full), profile), profile), k), profile)


def retrieved(s1: DataFrame, pool: DataFrame, kind: str, limit: int | None = None) -> DataFrame:
    """Pairs that share a name word (of the first 12) or an address word (of the first `limit` by text order)."""
    if kind == "name":
        own = F.slice(tokens.words(F.col("clean_name")), 1, 12)
        q = F.array_distinct(F.concat(own, tokens.joined(own)))
        c = F.array_distinct(own)
    else:
        c = F.array_distinct(tokens.longer(tokens.words(F.col("clean_address"))))
        q = F.slice(F.array_sort(c), 1, limit) if limit else c
    left = s1.select(F.col("entity_id").alias("s1_entity_id"), "country", F.explode(q).alias("token"))
    right = pool.select("entity_id", "country", F.explode(c).alias("token"))
    return dealt_join(materialise(left, "asked"), materialise(right, "index"), ["country", "token"], "s1_entity_id", "entity_id").select("s1_entity_id", "entity_id").distinct()


def _asked_whole(s1: DataFrame, profile: Profile) -> DataFrame:
    """Queries with their joined name, which stands for all words of the name."""
    words = tokens.words(F.col("clean_name"))
    counted = s1.select("entity_id", F.size(words).alias("n"))
    return materialise(tiles.lists(s1, _classes(profile, True), profile, tokens.joined(words), F.size(words)), "queries")


def formula_a(s1: DataFrame, pool: DataFrame, profile: Profile = PROFILES["formula_a"]) -> DataFrame:
    """Name words count once; where only the joined name hits, it counts as all words of the name."""
    return scored(tiles.pairs(_asked_whole(s1, profile), _held(pool, profile), profile), profile)


def formula_a_topk(s1: DataFrame, pool: DataFrame, k: int, profile: Profile = PROFILES["formula_a"]) -> DataFrame:
    """The k best of formula_a with their rank."""
    return ranked(scored(tiles.best(_asked_whole(s1, profile), _held(pool, profile), profile, k), profile), k)


def blocking_summary(s1: DataFrame, candidates: DataFrame) -> DataFrame:
    """For every record of s1: number of candidates, best and mean score, state matches."""
    own = s1.select(F.col("entity_id").alias("s1_entity_id"), "business_name", "country", "state")
    agg = candidates.groupBy("s1_entity_id").agg(F.count("*").alias("total_candidates"), F.max("matching_score").alias("max_score"), F.bround(F.avg("matching_score"), 2).alias("avg_score"), F.sum("state_match").alias("state_matches"))
    zero = {"total_candidates": 0, "max_score": 0.0, "avg_score": 0.0, "state_matches": 0}
    return own.join(agg, "s1_entity_id", "left").na.fill(zero)
