"""Personal data: rule-based spans, and terms that disclose them.

Rules find emails, IP addresses, payment cards and phone numbers. Each found value is a protected entity. Terms beside
it can reveal it even when it is masked; how much is estimated from co-occurrence over the whole corpus. The unit of all
counts is a position: one word of one text, outside the found values. With M positions, c(t) of them holding term t,
n(e) lying within WINDOW words of a value of e, and c(t, e) doing both,

    disclosure(t -> e) = PMI(t, e) / IC(e) = ln(M c(t, e) / (c(t) n(e))) / ln(M / n(e)) = 1 + ln(c(t, e) / c(t)) / ln(M / n(e)),

the share of the information "a value of e is here" that seeing t gives away (1: t stands nowhere else). In a large corpus
the share alone is lenient: with M = 10^8 positions and n(e) = 20, a term that stands beside e once in 20 times reaches
0.8. So a term must also leave at most RESIDUAL bits open, log2(c(t) / c(t, e)). Terms that reach both thresholds with
SUPPORT texts are marked wherever they occur in the corpus, as spans of kind "term"; sanitising replaces rule spans by
their kind (generalisation) and removes disclosing terms.

Everything is DataFrame expressions. A word is a letter and the letters and digits after it, on all sides; WINDOW words
are taken whatever their length. Texts are scanned once for the rules, once for term counts and once for marked terms.
Words are numbered in texts with found values only, by a running count; values meet the words beside them by (text,
number), so the work grows with words and values, not with their product. Counts use partial aggregates; marked terms are
broadcast after a count, or met in a salted join.

Defined results: null text is empty and has no spans; equal rows get equal spans and count as often as they occur; rows
with a null doc_id are scanned like others; an empty table gives an empty result; extra columns are never read. Offsets
count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinlink.llm.common import materialise, salted_lookup

WINDOW, THRESHOLD, RESIDUAL, SUPPORT = 5, 0.8, 1.0, 2
#: Disclosing terms up to this many are sent to all tasks, more are met in a shuffle.
BROADCAST_ROWS = 200_000
#: Possessive forms of the rules: the same matches without backtracking or recursion. A run that failed from its first
#: character fails from any later one, so only a run's start and the end of the match before are tried.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a rule to match at all.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WORD = r"\p{L}[\p{L}\p{N}]*+"
#: Characters of a text that are looked through for marked terms at a time (a bound on rows, not on what is read).
PIECE = 2048
_BLOCK = 256


def located(text: Column, rule: str) -> Column:
    """array<struct<start, end, value>> of a rule's matches. Lengths of what lies between matches add up to the starts;
    sums go by blocks, so that the work stays near-linear in the number of matches."""
    values = F.regexp_extract_all(text, F.lit(rule), F.lit(0))
    gaps = F.split(text, rule, -1)
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def build(found: Column) -> Column:
        steps = F.transform(F.arrays_zip(found["v"].alias("v"), F.slice(found["g"], 1, F.size(found["v"])).alias("g")), lambda x: F.length(x["v"]) + F.length(x["g"]))
        return F.transform(F.array(F.struct(found["v"].alias("v"), found["g"].alias("g"), steps.alias("s"))), with_blocks)[0]

    def with_blocks(x: Column) -> Column:
        count = F.floor((F.size(x["s"]) + (_BLOCK - 1)) / F.lit(_BLOCK)).cast("int")
        sums = F.transform(F.sequence(F.lit(0), count - 1), lambda b: total(F.slice(x["s"], b * _BLOCK + 1, F.lit(_BLOCK))))
        return F.transform(F.array(F.struct(x.alias("x"), sums.alias("b"))), spans)[0]

    def spans(y: Column) -> Column:
        def one(value: Column, i: Column) -> Column:
            block = F.floor(i / F.lit(_BLOCK)).cast("int")
            start = total(F.slice(y["b"], F.lit(1), block)) + total(F.slice(y["x"]["s"], block * _BLOCK + 1, i - block * _BLOCK)) + F.length(F.get(y["x"]["g"], i))
            return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))

        return F.transform(y["x"]["v"], one)

    some = F.transform(F.array(F.struct(values.alias("v"), gaps.alias("g"))), build)[0]
    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,value:string>>")
    return F.when(F.size(values) > 0, some).otherwise(none)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.lpad(part(p), 3, "0") <= "255"))
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<rank, kind, start, end, value>> of the rules' valid matches, by kind and start."""
    none = F.from_json(F.lit("[]"), "array<struct<rank:int,kind:string,start:int,end:int,value:string>>")

    def one(rank: int, kind: str) -> Column:
        valid = F.filter(located(text, RULES[kind]), lambda s: _valid(kind, s["value"]))
        own = F.transform(valid, lambda s: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
        return F.when(F.contains(text, F.lit(HINTS[kind])), own).otherwise(none) if HINTS[kind] else own

    return F.concat(*[one(rank, kind) for rank, kind in enumerate(RULES)])


def entity_of(kind: Column, value: Column) -> Column:
    """A found value without its way of writing."""
    return F.concat_ws(":", kind, F.when(kind == "email", F.lower(value)).otherwise(F.regexp_replace(value, "[^0-9.]", "")))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key (names the row's id and text), text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex(F.xxhash64(text)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), text.alias("text"))


def find_base(docs: DataFrame) -> DataFrame:
    """doc_id, key, base: the rules' spans; text: of rows that have such spans."""
    found = keyed(docs).withColumn("base", base_spans(F.col("text")))
    return found.select("doc_id", "key", "base", F.when(F.size("base") > 0, F.col("text")).alias("text"))


def located_words(rows: DataFrame) -> DataFrame:
    """rows (key, text and others) with start, end, term for every word of the text instead of the text."""
    rest = [c for c in rows.columns if c != "text"]
    pieces = F.arrays_zip(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("v"), F.split("text", WORD, -1).alias("g"))
    each = rows.select(*rest, F.posexplode(pieces).alias("i", "p")).where("p.v is not null")
    end = F.sum(F.length("p.g") + F.length("p.v")).over(W.partitionBy("key").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    return each.withColumn("end", end).select(*rest, (F.col("end") - F.length("p.v")).alias("start"), "end", F.lower("p.v").alias("term"))


def numbered(found: DataFrame) -> DataFrame:
    """For every text with found values, once: key, rows (its number of occurrences), start, end, term of its words and
    start, end, entity of its values; inside: the word overlaps a value; number: words outside values before this place."""
    texts = found.where(F.size("base") > 0).groupBy("key").agg(F.count("*").alias("rows"), F.first("text").alias("text"), F.first("base").alias("base"))
    words = located_words(texts.select("key", "rows", "text")).withColumn("entity", F.lit(None).cast("string"))
    values = texts.select("key", "rows", F.explode("base").alias("s")).select("key", "rows", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), F.lit(None).cast("string").alias("term"), entity_of(F.col("s.kind"), F.col("s.value")).alias("entity"))
    word = F.col("entity").isNull()
    order = W.partitionBy("key").orderBy("start", word)
    far = F.max(F.when(~word, F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    # Words do not overlap, so a value that starts inside a word is the next row.
    next_at, next_value = F.lead("start").over(order), F.lead("entity").over(order)
    inside = word & (F.coalesce(far > F.col("start"), F.lit(False)) | F.coalesce(next_value.isNotNull() & (next_at < F.col("end")), F.lit(False)))
    marked = words.unionByName(values).withColumn("inside", inside)
    number = F.sum((word & ~F.col("inside")).cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)) - (word & ~F.col("inside")).cast("long")
    return marked.withColumn("number", number)


def neighbours(places: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, rows, entity, term, start: words outside values that are within `window` words of a value, once for an entity."""
    words = places.where("entity is null and not inside").select("key", "number", "rows", "term", "start")
    reach = F.explode(F.sequence(F.col("number") - window, F.col("number") + (window - 1)))
    asked = places.where("entity is not null").select("key", "entity", "number").distinct().select("key", "entity", reach.alias("number")).where("number >= 0").distinct()
    return words.join(asked, ["key", "number"]).select("key", "rows", "entity", "term", "start")


def disclosing(docs: DataFrame, places: DataFrame, near: DataFrame, threshold: float = THRESHOLD, residual: float = RESIDUAL, support: int = SUPPORT) -> DataFrame:
    """entity, term, disclosure of the pairs that reach the thresholds."""
    texts = near.groupBy("entity", "term", "key", "rows").agg((F.count("*") * F.col("rows")).alias("n"))
    pairs = texts.groupBy("entity", "term").agg(F.sum("n").alias("both"), F.sum("rows").alias("texts"))
    beside = pairs.groupBy("entity").agg(F.sum("both").alias("n_e"))
    every = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD), F.lit(0))).alias("w")).groupBy(F.lower("w").alias("term")).agg(F.count("*").alias("n"))
    hidden = places.where("inside").groupBy("term").agg((-F.sum("rows")).alias("n"))
    counts = materialise(every.union(hidden).groupBy("term").agg(F.sum("n").alias("c_t")), "pii-counts")
    total = F.lit(counts.agg(F.coalesce(F.sum("c_t"), F.lit(0)).alias("m")).first().m)
    joined = pairs.where(F.col("texts") >= support).join(beside, "entity").join(counts, "term").where((F.col("n_e") < total) & (F.col("both") * 2.0**residual >= F.col("c_t")))
    share = 1 + F.ln(F.col("both") / F.col("c_t")) / F.ln(total / F.col("n_e"))
    return joined.select("entity", "term", share.alias("disclosure")).where(F.col("disclosure") >= threshold)


def pieces(rows: DataFrame) -> DataFrame:
    """key, first (offset), piece: texts cut where no word is, into pieces of about PIECE characters."""
    cut = rows.select("key", F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{PIECE}}}[\p{{L}}\p{{N}}]*+"), F.lit(0)).alias("parts"))
    sized = cut.select("key", "parts", F.transform("parts", F.length).alias("sizes"))
    each = sized.select("key", "sizes", F.posexplode("parts").alias("i", "piece"))
    return each.select("key", F.aggregate(F.slice("sizes", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda s, x: s + x).alias("first"), "piece")


def marked_words(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """key, start, end of the terms in the texts, from one pass: words meet the broadcast terms where they are read, and
    only those that are terms learn their place in their piece of the text."""
    words = pieces(rows).select("key", "first", F.regexp_extract_all("piece", F.lit(WORD), F.lit(0)).alias("v"), F.split("piece", WORD, -1).alias("g"))
    sized = words.select("key", "first", "v", F.transform(F.arrays_zip("v", F.slice("g", F.lit(1), F.size("v")).alias("g")), lambda x: F.length(x["v"]) + F.length(x["g"])).alias("steps"))
    each = sized.select("key", "first", "steps", F.posexplode("v").alias("i", "w")).withColumn("term", F.lower("w"))
    hits = each.join(F.broadcast(terms), "term")
    end = F.aggregate(F.slice("steps", F.lit(1), F.col("i") + 1), F.col("first"), lambda s, x: s + x)
    return hits.select("key", end.alias("end"), "w").select("key", (F.col("end") - F.length("w")).alias("start"), "end")


def occurrences(docs: DataFrame, places: DataFrame, terms: DataFrame) -> DataFrame:
    """key, terms: the places of the terms in every text, outside the rules' spans."""
    rows = keyed(docs).select("key", "text")
    if terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        placed = marked_words(rows, terms)
    else:  # only texts that hold a term are looked through for places
        words = rows.select("key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("w")).select("key", F.lower("w").alias("term"))
        held = materialise(salted_lookup(words, terms, "term", "key", how="inner").select("key").distinct(), "pii-held")
        placed = salted_lookup(located_words(rows.join(held, "key").groupBy("key").agg(F.first("text").alias("text"))), terms, "term", "key", how="inner").select("key", "start", "end")
    inside = places.where("inside").select("key", "start")
    return placed.distinct().join(inside, ["key", "start"], "left_anti").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("terms"))


def find_spans(docs: DataFrame, window: int = WINDOW, threshold: float = THRESHOLD, residual: float = RESIDUAL, support: int = SUPPORT) -> DataFrame:
    """doc_id, key, base, terms: for every row the rules' spans and the spans of disclosing terms."""
    found = materialise(find_base(docs), "pii-base")
    places = materialise(numbered(found), "pii-places")
    hits = materialise(disclosing(docs, places, materialise(neighbours(places, window), "pii-near"), threshold, residual, support), "pii-pairs")
    placed = materialise(occurrences(docs, places, hits.select("term").distinct()), "pii-terms")
    none = F.from_json(F.lit("[]"), "array<struct<start:bigint,end:bigint>>")
    return found.drop("text").join(placed, "key", "left").withColumn("terms", F.coalesce("terms", none))


def spans_report(spans: DataFrame) -> DataFrame:
    """Counts, the digest of the rules' spans and all spans as text, for every row."""
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.transform("base", name)
    terms = F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string")))
    return spans.select("doc_id", *map(count, RULES), F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"), F.concat_ws(",", F.concat(base, terms)).alias("spans"), F.size("terms").cast("long").alias("n_term"))


def sanitised(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with rule spans generalised to [KIND] and disclosing terms removed; overlapping spans go as the first one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex(F.xxhash64(text)))
    tag = F.transform("base", lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("tag")))
    cut = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("tag")))
    plan = spans.select("key", F.array_sort(F.concat(tag, cut)).alias("__pii_cuts")).where(F.size("__pii_cuts") > 0).distinct()
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    upto = lambda a, b: F.substr(F.col("__pii_text"), (a + 1).cast("int"), (b - a).cast("int"))

    def step(acc: Column, s: Column) -> Column:
        ahead = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.when(ahead, F.concat(upto(acc["at"], s["start"]), s["tag"])).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), piece.alias("out"))

    done = F.aggregate("__pii_cuts", start, step, lambda acc: F.concat(acc["out"], upto(acc["at"], F.length("__pii_text"))))
    rows = docs.withColumns({"__pii_text": text, "__pii_key": key}).join(plan.withColumnRenamed("key", "__pii_key"), "__pii_key", "left")
    return rows.withColumn("text", F.when(F.col("__pii_cuts").isNull(), F.col("text")).otherwise(done)).select(*docs.columns)
