"""Benchmark decontamination by template windows.

Texts are canonicalised to templates: numbers, units after numbers and names become typed placeholders. A name is a run of
capitalised words with one blank between them, wherever it stands, so a sentence's first word is a slot like any other
(it fills it equally in a copy) and a name of two words is one slot. Windows of five template tokens are joined by hash
with those of the benchmark; a window that holds a name is hashed a second time with the name's own words, so a copy in
another case still meets its item. Matched windows that lie on one alignment of document and item must fill the item's
slots consistently: each slot value of the item stands for one value in the document, and every other token is equal. An
item whose tokens are covered by consistent windows for at least COVERAGE of them contaminates the document, so
re-parameterised questions are caught along with verbatim ones, and one changed word costs one token.

An item of fewer tokens than a window is one window of its own length and matches where its values are equal too, as a
template of one or two tokens would match nearly anything.

Everything is DataFrame expressions; windows of documents are generated, hashed and probed in one stage and leave it
only as matches. The benchmark's windows are broadcast if they are at most BROADCAST_ROWS (counted first) and met in a
salted join otherwise. Items with equal tokens are joined once and named together afterwards.

Defined results: null texts are empty; texts and items without tokens never match; items with a null id are ignored;
documents are told apart by id and text, so rows that share an id, or have none, are judged each; equal rows are reported
each; empty tables give no matches; extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import salted_lookup
from kinlink.llm.sanitise import keyed

WIDTH, COVERAGE, BROADCAST_ROWS = 5, 0.8, 200_000
# Units that make a placeholder after a number, and numbers that are written as words.
UNITS = """km kg cm mm mg ml kmh mph lb lbs oz ft mi min hour hours minute minutes second seconds day days week weeks month months
year years percent usd eur dollar dollars euro euros cent cents pound pounds inch inches foot feet mile miles meter meters
metre metres kilometer kilometers gram grams kilogram kilograms liter liters litre litres m g l s h""".split()
NUMBERS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen
eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million""".split()
_CAPITAL = r"\p{Lu}\p{Ll}[\p{L}\p{N}]*+"
TOKEN = rf"{_CAPITAL}(?: {_CAPITAL})*+|\p{{Nd}}++(?:[.,]\p{{Nd}}++)*+|\p{{L}}[\p{{L}}\p{{N}}]*+|\p{{N}}++"
_SLOT = "#(name|num|unit)_"


def canonical(text: Column) -> Column:
    """The text's tokens in lower case, a line each; slot tokens keep their value behind #name_, #num_ or #unit_."""
    lines = F.concat(F.lit("\n"), F.array_join(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), "\n"), F.lit("\n"))
    named = F.lower(F.regexp_replace(lines, r"\n(?=\p{Lu}\p{Ll})", "\n#name_"))
    numbered = F.regexp_replace(named, rf"\n(?=\p{{Nd}}|(?:{'|'.join(NUMBERS)})\n)", "\n#num_")
    measured = F.regexp_replace(numbered, rf"(\n#num_[^\n]*+\n)(?=(?:{'|'.join(UNITS)})\n)", "$1#unit_")
    return F.substr(measured, F.lit(2), F.length(measured) - 2)


def typed(tokens: Column) -> Column:
    """Without the values of slots."""
    return F.regexp_replace(tokens, rf"{_SLOT}[^\n]*+", "#$1")


def plain(tokens: Column) -> Column:
    """Without the values of numbers and units; names are words."""
    return F.regexp_replace(F.replace(tokens, F.lit("#name_"), F.lit("")), r"#(num|unit)_[^\n]*+", "#$1")


def valued(tokens: Column) -> Column:
    """The words as they are, in lower case."""
    return F.regexp_replace(tokens, _SLOT, "")


def windows(rows: DataFrame, keep: list[str], short: tuple[int, ...] = (), width: int = WIDTH) -> DataFrame:
    """keep, at, wh, words (tokens with values) for every window of column `text`, and for those of the short widths."""
    # Exploded, so that the optimiser does not write the template out once for each use.
    flat = rows.select(*keep, F.explode(F.array(canonical(F.coalesce(F.col("text").cast("string"), F.lit(""))))).alias("_flat"))
    split = flat.select(*keep, *[F.split(f(F.col("_flat")), "\n").alias(c) for c, f in (("_lit", lambda x: x), ("_typed", typed), ("_plain", plain), *([("_valued", valued)] if short else []))])
    least = min((width, *short))
    each = split.select(*keep, *split.columns[len(keep) :], F.explode(F.when((F.size("_lit") >= least) & (F.get("_lit", F.lit(0)) != ""), F.sequence(F.lit(0), F.size("_lit") - least))).alias("at"))
    mark = lambda c, n: F.xxhash64(*([F.lit(n)] if c == "_valued" else []), *[F.get(c, F.col("at") + k) for k in range(n)])
    marked = each.select(*keep, "_lit", "at", mark("_typed", width).alias("_one"), mark("_plain", width).alias("_two"), *[mark("_valued", n).alias(f"_v{n}") for n in short])
    marks = F.when(F.col("_one") == F.col("_two"), F.array("_one")).otherwise(F.array("_one", "_two"))
    if short:
        none = F.array().cast("array<bigint>")
        marks = F.concat(F.when(F.col("at") <= F.size("_lit") - width, marks).otherwise(none), *[F.when(F.col("at") <= F.size("_lit") - n, F.array(f"_v{n}")).otherwise(none) for n in short])
    return marked.select(*keep, "_lit", "at", F.explode(marks).alias("wh")).select(*keep, "at", "wh", F.slice("_lit", F.col("at") + 1, width).alias("words"))


def benchmark_windows(items: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame, tuple[int, ...]]:
    """Windows of each distinct item under its smallest id, the ids of each (group, item_id), and the lengths of items that
    are shorter than a window."""
    named = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id is not null")
    flat = named.select("item_id", "text", canonical(F.col("text")).alias("_flat")).where("_flat <> ''")
    group = flat.groupBy("_flat").agg(F.min("item_id").alias("item"), F.min("text").alias("text")).withColumn("n_tokens", F.size(F.split("_flat", "\n")))
    members = flat.join(group.select("_flat", "item"), "_flat").select("item", "item_id").distinct()
    lengths = tuple(sorted(r.n_tokens for r in group.where(F.col("n_tokens") < width).select("n_tokens").distinct().collect()))
    found = windows(group.where(F.col("n_tokens") >= width), ["item", "n_tokens"], (), width)
    for n in lengths:
        found = found.union(windows(group.where(F.col("n_tokens") == n), ["item", "n_tokens"], (n,), width))
    return found.select("item", F.col("at").alias("item_at"), "wh", F.col("words").alias("item_words"), "n_tokens"), members, lengths


def _found(docs: DataFrame, bench: DataFrame, short: tuple[int, ...], width: int, coverage: float) -> DataFrame:
    """key, item, coverage for every text and item group that reaches the coverage."""
    small = bench.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    every = windows(keyed(docs).select("key", "text"), ["key"], short, width)
    hit = every.join(F.broadcast(bench), "wh") if small else salted_lookup(every, bench, "wh", "key", how="inner")
    pairs = F.arrays_zip(F.slice("words", F.lit(1), F.size("item_words")).alias("d"), F.col("item_words").alias("i"))
    slot = lambda w: F.regexp_extract(w, f"^{_SLOT}", 1)
    alike = lambda p: (plain(p["d"]) == plain(p["i"])) | ((slot(p["i"]) != "") & (slot(p["d"]) == slot(p["i"])))
    fits = F.when(F.col("n_tokens") < width, F.forall(pairs, lambda p: valued(p["d"]) == valued(p["i"]))).otherwise(F.forall(pairs, alike))
    filled = F.transform(F.filter(pairs, lambda p: slot(p["i"]) != ""), lambda p: F.struct(p["i"].alias("i"), valued(p["d"]).alias("d")))
    rows = hit.where(fits).select("key", "item", "n_tokens", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), filled.alias("slots"))
    # One alignment pairs each token of the item with one token, so what is gathered here is as long as the item.
    aligned = rows.groupBy("key", "item", "n_tokens", "shift").agg(F.collect_set("item_at").alias("covered"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    consistent = F.size(F.array_distinct(F.transform("slots", lambda s: s["i"]))) == F.size("slots")
    tokens = F.sequence(F.col("from"), F.col("from") + F.least(F.lit(width), F.col("n_tokens")) - 1)
    places = aligned.where(consistent).select("key", "item", "n_tokens", F.explode("covered").alias("from")).distinct().select("key", "item", "n_tokens", F.explode(tokens).alias("place")).distinct()
    share = places.groupBy("key", "item", "n_tokens").agg(F.count("*").alias("n"))
    return share.select("key", "item", (F.col("n") / F.col("n_tokens")).alias("coverage")).where(F.col("coverage") >= coverage)


def matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, coverage: float = COVERAGE) -> DataFrame:
    """key (names a document's id and text), item_id, coverage for every document and item that reaches the coverage."""
    bench, members, short = benchmark_windows(items, width)
    return _found(docs, bench, short, width, coverage).join(members, "item").select("key", "item_id", "coverage")


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, contaminated, coverage (the best), items (ids in order) for every document."""
    best = matches(docs, items, width, coverage).groupBy("key").agg(F.max("coverage").alias("coverage"), F.array_sort(F.collect_set("item_id")).alias("items"))
    found = keyed(docs).select("doc_id", "key").join(best, "key", "left")
    return found.select("doc_id", F.col("coverage").isNotNull().alias("contaminated"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH, coverage: float = COVERAGE) -> DataFrame:
    """Rows of docs that hold no item, with all their columns."""
    bench, _, short = benchmark_windows(items, width)
    gone = _found(docs, bench, short, width, coverage).select(F.col("key").alias("__key")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex(F.xxhash64(text)))
    return docs.withColumn("__key", key).join(gone, "__key", "left_anti").select(*docs.columns)
