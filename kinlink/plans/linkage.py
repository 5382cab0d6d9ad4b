"""Normalisation of entity tables and the whole linkage as lazy plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.functions import geo, text, tokens
from kinlink.operators import blocking, features
from kinlink.profiles import PACKAGE, Profile


def normalized(entities: DataFrame, profile: Profile = PACKAGE, other_scripts: bool = True) -> DataFrame:
    """entities with state, has_state, clean_name, clean_address, house_number, has_house_number."""
    name, address, country = F.col("business_name"), F.col("business_address"), F.col("country")
    rows = entities.withColumns(
        {
            "state": geo.state(address, country, profile.states),
            "clean_name": text.normalize_name(name, profile, other_scripts),
            "clean_address": text.normalize_address(address, country, profile, other_scripts),
            "house_number": geo.house_number(address, profile.house),
        }
    )
    return rows.withColumns({"has_state": F.col("state").isNotNull().cast("int"), "has_house_number": F.col("house_number").isNotNull().cast("int")})


def with_words(rows: DataFrame, limit: int = 12) -> DataFrame:
    """name_words, address_words and name_word_1 .. name_word_n; stale word columns go first."""
    rows = rows.drop(*[c for c in rows.columns if c.startswith("name_word_")])
    rows = rows.withColumns({"name_words": tokens.words(F.col("clean_name")), "address_words": tokens.words(F.col("clean_address"))})
    return rows.withColumns({f"name_word_{i + 1}": F.get("name_words", i) for i in range(limit)})


def distinct_columns(rows: DataFrame) -> DataFrame:
    """The first of columns that share a name."""
    seen: set[str] = set()
    names = [f"_again_{i}" if c in seen or seen.add(c) else c for i, c in enumerate(rows.columns)]
    return rows.toDF(*names).drop(*[n for n in names if n.startswith("_again_")])


def linked_pairs(s1: DataFrame, pool: DataFrame, profile: Profile = PACKAGE) -> DataFrame:
    """Pair features of every record's best candidates; s1 and pool are normalised."""
    return features.pair_features(s1, blocking.top_candidates(s1, pool, profile), profile)
