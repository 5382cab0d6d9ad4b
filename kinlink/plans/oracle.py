"""SQL for another engine that gives the rows of the registered queries. Rule tables are shared, the logic is not."""

from __future__ import annotations

import re

from kinlink.functions import dictionaries as D
from kinlink.functions.text import _WIDE, _plain_letters
from kinlink.plans.golden import values_sql


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rr(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def squeeze(x: str) -> str:
    return f"trim({rr(x, '[ \\t\\n\\r\\f\\v]+', ' ')})"


def latin(x: str) -> str:
    for a, b in _WIDE.items():
        x = f"replace({x}, {q(a)}, {q(b)})"
    plain = _plain_letters()
    return f"translate({x}, {q(''.join(plain))}, {q(''.join(plain.values()))})"


def empty(x: str) -> str:
    return f"coalesce({x}, '')"


def plain(x: str) -> str:
    return squeeze(rr(f"lower({latin(empty(x))})", r"[^\w\s]", " "))


def urls(x: str) -> str:
    return rr(rr(x, "(?i)" + D.URL_TAIL, ""), "(?i)" + D.URL, "")


def words_rule(alternatives: str) -> str:
    return rf"\b({alternatives})\b"


def name_package(x: str) -> str:
    x = plain(x)
    for words in (D.LEGAL_WORDS, D.STOPWORDS):
        x = rr(x, words_rule("|".join(words)), "")
    return squeeze(x)


def address(x: str, general, french, at: str) -> str:
    for a, b in general:
        x = rr(x, words_rule(a), b)
    y = x
    for a, b in french:
        y = rr(y, words_rule(a), b)
    return squeeze(f"CASE WHEN {at} = 'France' THEN {y} ELSE {x} END" if french else x)


def strip(x: str) -> str:
    return rr(x, r"^\s+|\s+$", "")


def parts(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, ','), lambda p: {strip('p')}), lambda p: p <> '')"


def tail(items: str, n: int) -> str:
    return f"list_reverse({items})[1:{n}]"


def table(pairs) -> str:
    seen = dict(pairs)
    return f"MAP([{', '.join(map(q, seen))}], [{', '.join(map(q, seen.values()))}])"


def first_known(items: str, pairs) -> str:
    return f"list_filter(list_transform({items}, lambda t: ({table(pairs)})[t]), lambda s: s IS NOT NULL)[1]"


def anywhere(x: str, pairs, whole: bool = True) -> str:
    test = (lambda k: f"regexp_matches({x}, {q(chr(92) + 'b' + re.escape(k) + chr(92) + 'b')})") if whole else (lambda k: f"contains({x}, {q(k)})")
    return "CASE " + " ".join(f"WHEN {test(k)} THEN {q(v)}" for k, v in pairs) + " END"


def low(names) -> list[tuple[str, str]]:
    return [(n.lower(), n) for n in names]


A = "coalesce(business_address, '')"
US = f"""coalesce({first_known(f"list_transform(flatten(list_transform({tail(parts(A), 3)}, lambda p: string_split_regex(p, '\\s+'))), lambda w: lower(regexp_replace(w, '[^a-zA-Z]', '', 'g')))", D.US_CODES)}, {anywhere(f"lower({A})", low(D.US_52))})"""
INDIA = f"""coalesce({first_known(f"list_transform({tail(parts(f'lower({A})'), 2)}, lambda p: {strip(rr('p', '[^a-z ]', ''))})", low(D.INDIA_STATES))}, {anywhere(f"lower({A})", low(D.INDIA_STATES))})"""
FL = f"lower({latin(A)})"


def france(places) -> str:
    return f"""coalesce({anywhere(FL, low(D.FRANCE_REGIONS), False)}, {first_known(f"list_transform({tail(parts(FL), 2)}, lambda p: {strip(rr('p', '[^a-z -]', ''))})", places)}, {anywhere(FL, [x for x in places if len(x[0]) > 3])})"""


FRANCE = france(D.FRANCE_PLACES)
STATE = f"CASE WHEN {strip(A)} = '' THEN NULL WHEN trim(country) = 'US' THEN {US} WHEN trim(country) = 'India' THEN {INDIA} WHEN trim(country) = 'France' THEN {FRANCE} END"


def whole_parts(x: str, pairs) -> str:
    own = parts(x)
    candidates = f"list_concat({tail(own, 2)}, CASE WHEN len({own}) >= 3 THEN {own}[1:1] ELSE [] END)"
    return f"""coalesce({first_known(f"list_transform({candidates}, lambda p: lower({strip(rr('p', '[^a-zA-Z ]', ''))}))", pairs)}, {anywhere(f"lower({x})", [p for p in pairs if len(p[0]) > 2])})"""


def nb_states(kind: str) -> str:
    """The notebook's or the gated profile's states."""
    from kinlink.functions import geo

    gated = kind == "gated"
    us, india = geo._lookup_us(full=not gated), geo._lookup_india_gated() if gated else geo._lookup_india()
    us_sql = f"coalesce({whole_parts(A, us)}, ({table(us)})[lower(regexp_extract({A}, '\\b([A-Z]{{2}})\\b', 1))])"
    two = first_known(f"list_transform({parts(A)}, lambda p: lower(p))", [x for x in india if len(x[0]) == 2])
    india_sql = f"coalesce({'' if gated else anywhere(A, D.INDIA_NATIVE, False) + ', '}{whole_parts(A, india)}, {two})"
    france = anywhere(f"lower({A})", low(D.FRANCE_REGIONS if gated else D.FRANCE_REGIONS_ACCENTED), False)
    return f"CASE WHEN {strip(A)} = '' THEN NULL WHEN trim(country) = 'US' THEN {us_sql} WHEN trim(country) = 'India' THEN {india_sql} WHEN trim(country) = 'France' THEN {france} END"


def bulk_states() -> str:
    from kinlink.functions import geo

    def one(pairs):
        return f"""coalesce({first_known(f"list_transform({tail(parts(FL), 2)}, lambda p: {strip(rr('p', '[^a-z ]', ''))})", pairs)}, {anywhere(FL, [p for p in pairs if len(p[0]) > 2])})"""

    return f"CASE WHEN {strip(A)} = '' THEN NULL WHEN trim(country) = 'US' THEN {one(geo._lookup_us(rows=D.US_STATES))} WHEN trim(country) = 'India' THEN {one(geo._lookup_india_bulk())} WHEN trim(country) = 'France' THEN {france(D.FRANCE_PLACES_BULK)} END"


FIRST = strip(f"string_split({A}, ',')[1]")
NUMBER = f"lower(regexp_extract({FIRST}, '\\b(\\d{{1,6}}[a-zA-Z]?)\\b', 1))"
HOUSE = f"CASE WHEN {NUMBER} <> '' AND NOT regexp_matches({NUMBER}, '^\\d{{5,6}}$') THEN {NUMBER} END"
CASCADE = "lower(coalesce(" + ", ".join(f"nullif(regexp_extract({A}, {q(p)}, 1), '')" for p in (
    rf"(?i)\b(\d+[a-zA-Z]?(?:[-/]\d+)?)\s+(?:[a-zA-Z\.]+\s+)*(?:{D.STREET_WORDS})\b",
    rf"(?i){D.NUMBER_MARKS}\s*([0-9]+[a-zA-Z]?(?:[-/][0-9]+[a-zA-Z]?)?)",
    r"^\s*([0-9]+[a-zA-Z]?(?:[-/][0-9]+[a-zA-Z]?)?)\b",
    r"\b([0-9]{1,5}[a-zA-Z]?)\b",
)) + "))"

ADAPTED = """SELECT CASE WHEN doc_id % 10 = 0 THEN 'S1' WHEN doc_id % 2 = 1 THEN 'S2' ELSE 'S3' END AS source,
 CASE WHEN doc_id % 10 = 0 THEN 'S1' WHEN doc_id % 2 = 1 THEN 'S2' ELSE 'S3' END || '-' || doc_id AS entity_id,
 substr("text", 1, 40) AS business_name, substr("text", 41, 80) AS business_address,
 CASE WHEN lang = 'en' THEN 'US' WHEN lang = 'fr' THEN 'France' ELSE 'India' END AS country FROM documents"""
ENT = f"ent AS ({ADAPTED})"
GOLD = f"ent AS ({ADAPTED} UNION ALL SELECT * FROM (VALUES {values_sql()}) v(source, entity_id, business_name, business_address, country))"
NORM = f"""norm AS MATERIALIZED (SELECT *, {STATE} AS state, {name_package('business_name')} AS clean_name,
 {address(plain('business_address'), D.ADDRESS_PACKAGE, D.ADDRESS_FRANCE, 'trim(country)')} AS clean_address, {HOUSE} AS house_number FROM ent)"""
W_NAME, W_ADDR = "list_filter(string_split(clean_name, ' '), lambda w: w <> '')", "list_filter(string_split(clean_address, ' '), lambda w: w <> '')"


def over(x: str) -> str:
    return f"list_filter({x}, lambda w: length(w) > 1)"


def one(x: str) -> str:
    return f"list_filter({x}, lambda w: length(w) = 1)"


JOINED = f"CASE WHEN len({W_NAME}) >= 2 THEN [array_to_string({W_NAME}, '')] ELSE [] END"
TOK = f"""qt AS (SELECT DISTINCT entity_id AS s1, country, c AS class, unnest(t) AS token FROM (
   SELECT entity_id, country, 'len1' AS c, {one(W_NAME)} AS t FROM norm WHERE source = 'S1' UNION ALL
   SELECT entity_id, country, 'gt1', list_concat({over(W_NAME)}, {JOINED}) FROM norm WHERE source = 'S1' UNION ALL
   SELECT entity_id, country, 'addr', {over(W_ADDR)} FROM norm WHERE source = 'S1')),
 ct AS (SELECT DISTINCT entity_id, country, c AS class, unnest(t) AS token FROM (
   SELECT entity_id, country, 'len1' AS c, {one(W_NAME)} AS t FROM norm WHERE source IN ('S2', 'S3') UNION ALL
   SELECT entity_id, country, 'gt1', {over(W_NAME)} FROM norm WHERE source IN ('S2', 'S3') UNION ALL
   SELECT entity_id, country, 'addr', {over(W_ADDR)} FROM norm WHERE source IN ('S2', 'S3'))),
 ov AS (SELECT s1 AS s1_entity_id, entity_id, count(*) FILTER (class = 'len1')::INT AS len1, count(*) FILTER (class = 'gt1')::INT AS gt1, count(*) FILTER (class = 'addr')::INT AS addr
   FROM qt JOIN ct USING (country, class, token) GROUP BY ALL)"""
SCO = """sco AS (SELECT ov.*, coalesce(a.state = b.state, false)::INT AS state_match, 1.0::DOUBLE * len1 + 4 * gt1 + 2 * addr + 2 * coalesce(a.state = b.state, false)::INT AS matching_score
   FROM ov JOIN norm a ON a.entity_id = ov.s1_entity_id JOIN norm b ON b.entity_id = ov.entity_id)"""
TOP = """top AS MATERIALIZED (SELECT s1_entity_id, entity_id, len1 AS name_overlap_len1, gt1 AS name_overlap_gt1, len1 + gt1 AS name_overlap_count, addr AS address_overlap_count, state_match, matching_score, rank::INT AS rank
   FROM (SELECT *, row_number() OVER (PARTITION BY s1_entity_id ORDER BY matching_score DESC, entity_id) AS rank FROM sco) WHERE rank <= 15)"""
TRUTH = """truthl AS (SELECT a.entity_id AS s1_id, coalesce(list_sort(list(b.entity_id) FILTER (b.entity_id IS NOT NULL)), []) AS ids FROM (SELECT * FROM ent WHERE source = 'S1') a
   LEFT JOIN (SELECT * FROM ent WHERE source IN ('S2', 'S3')) b ON lower(a.business_name) = lower(b.business_name) GROUP BY a.entity_id),
 truth AS (SELECT s1_id, unnest(ids) AS candidate_id FROM truthl)"""
RANKS = "ranks AS (SELECT t.s1_id, t.candidate_id, top.rank FROM truth t LEFT JOIN top ON top.s1_entity_id = t.s1_id AND top.entity_id = t.candidate_id)"
BLOCK = ", ".join((ENT, NORM, TOK, SCO, TOP))
FEAT = f"""pr AS (SELECT top.*, a.clean_name AS an, b.clean_name AS bn, a.clean_address AS aa, b.clean_address AS ba, a.state AS ast, b.state AS bst, a.house_number AS ah, b.house_number AS bh, b.source
   FROM top JOIN norm a ON a.entity_id = top.s1_entity_id JOIN norm b ON b.entity_id = top.entity_id),
 wl AS (SELECT *, list_distinct({W_NAME.replace('clean_name', 'an')}) AS nw1, list_distinct({W_NAME.replace('clean_name', 'bn')}) AS nw2, list_distinct({W_ADDR.replace('clean_address', 'aa')}) AS aw1, list_distinct({W_ADDR.replace('clean_address', 'ba')}) AS aw2 FROM pr),
 cc AS (SELECT *, len(list_intersect(nw1, nw2))::INT AS common, len(list_distinct(list_concat(nw1, nw2))) AS un, len(list_intersect(aw1, aw2))::INT AS acommon, len(list_distinct(list_concat(aw1, aw2))) AS aun FROM wl),
 feat AS (SELECT s1_entity_id AS s1_id, entity_id AS candidate_id, source, matching_score AS blocking_score, common AS common_words_count,
   CASE WHEN un = 0 THEN 0.0 ELSE common / un END AS word_jaccard, (an = bn AND an <> '')::INT AS is_exact_core_match,
   (length(an) >= 3 AND length(bn) >= 3 AND (contains(an, bn) OR contains(bn, an)))::INT AS is_substring_match,
   (ast IS NOT NULL)::INT AS has_state_s1, (bst IS NOT NULL)::INT AS has_state_cand, (ast IS NOT NULL AND bst IS NOT NULL)::INT AS both_have_state, coalesce(lower(ast) = lower(bst), false)::INT AS state_match,
   (ah IS NOT NULL)::INT AS has_house_num_s1, (bh IS NOT NULL)::INT AS has_house_num_cand, (ah IS NOT NULL AND bh IS NOT NULL)::INT AS both_have_house_num, coalesce(ah = bh, false)::INT AS house_number_match,
   acommon AS address_common_words_count, CASE WHEN aun = 0 THEN 0.0 ELSE acommon / aun END AS address_word_jaccard, (source = 'S3')::INT AS source_is_s3,
   CASE WHEN un = 0 OR aun = 0 THEN 0.0 ELSE (common / un) * (acommon / aun) END AS name_x_addr_jaccard, (an = bn AND an <> '' AND coalesce(lower(ast) = lower(bst), false))::INT AS both_exact_and_state,
   matching_score / greatest(common, 1) AS score_per_word FROM cc)"""
SCORES = """sc AS (SELECT d.doc_id, l.quality AS label, round(d.n_chars / (d.n_chars + 5000.0::DOUBLE), 4) AS score FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0.0)"


def r6(**columns: str) -> str:
    return ", ".join(f"round({v}, 6) AS {k}" for k, v in columns.items())


def prf(tp: str, fp: str, fn: str) -> dict[str, str]:
    p, r = ratio(tp, f"{tp} + {fp}"), ratio(tp, f"{tp} + {fn}")
    return {"precision": p, "recall": r, "f1": ratio(f"2 * {p} * {r}", f"{p} + {r}"), "f05": ratio(f"1.25 * {p} * {r}", f"0.25 * {p} + {r}")}


def text_query(expression: str, ctes: str = GOLD) -> str:
    return f"WITH {ctes} SELECT entity_id, {expression} AS out FROM ent"


GRID = f"""cells AS (SELECT greatest(least(floor(score * 100 + 1e-9), 90), 9)::INT AS cell, sum(label) AS p, count(*) AS n FROM sc GROUP BY 1),
 g AS (SELECT t::INT AS cell, coalesce(p, 0)::BIGINT AS p, coalesce(n, 0)::BIGINT AS n FROM range(9, 91) r(t) LEFT JOIN cells ON cells.cell = t),
 s AS (SELECT cell, (sum(p) OVER (ORDER BY cell DESC))::BIGINT AS tp, (sum(n - p) OVER (ORDER BY cell DESC))::BIGINT AS fp, (sum(p) OVER () - sum(p) OVER (ORDER BY cell DESC))::BIGINT AS fn FROM g),
 tt AS (SELECT cell / 100.0::DOUBLE AS threshold, tp, fp, fn, {", ".join(f"{v} AS {k}" for k, v in prf("tp", "fp", "fn").items())} FROM s WHERE cell >= 10)"""


# ---- hygiene cleaning, script by script ------------------------------------------------------------------------------


def romanised(x: str) -> str:
    """x with letters that are still not ASCII replaced one by one; those of the nine Indic blocks by their names."""
    from kinlink.functions import text

    pairs = [(chr(c), r) for c in range(0x0900, 0x0D80) if (r := text._romanised(chr(c)))]
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE WHEN ascii(c) < 128 THEN c ELSE coalesce(({table(pairs)})[c], '') END), '')"


def ocr(x: str) -> str:
    """0 and 1 between letters, by walking over the characters."""
    letter = lambda i: f"coalesce(regexp_matches(({x})[{i}], '^[a-z]$'), false)"
    between = f"({letter('i - 1')} AND {letter('i + 1')} AND i > 1)"
    return f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN ({x})[i] = '0' AND {between} THEN 'o' WHEN ({x})[i] = '1' AND {between} THEN 'l' ELSE ({x})[i] END), '')"


def name_steps(source: str = "business_name") -> str:
    """CTEs that end in `named`: entity_id and a column for the name under each cleaning and each rule set."""
    raw = rr(rr(rr(urls(f"coalesce({source}, '')"), D.HANDLE, ""), "(?i)" + D.DOMAIN_END, " "), "(?i)" + D.POSSESSIVE, "")
    low = lambda x: f"lower({romanised(rr(latin(x), '[\u0300-\u036f]', ''))})"
    brackets = rr("fixed", r"[\(\[\{]([^\)\]\}]+)[\)\]\}]", r" \1 ")
    symbols = rr(rr(brackets, r"\s*&\s*", " and "), r"\s*\+\s*", " ")
    hyphens = rr(rr(rr("fixed", r"[\(\)]+", " "), "&", " and "), r"\+", " ")
    legal = "plain"
    for words in (D.LEGAL_WORDS, D.STOPWORDS):
        legal = rr(legal, words_rule("|".join(words)), "")
    harmony = "hygiene"
    for a, b in D.HARMONISED:
        harmony = rr(harmony, words_rule(a), b)
    bare = "harmony"
    for g in D.DESCRIPTORS:
        bare = rr(bare, words_rule(g), " ")
    return f"""n0 AS MATERIALIZED (SELECT entity_id, {low(raw)} AS low, {squeeze(rr(low("coalesce(" + source + ", '')"), r'[^\w\s]', ' '))} AS plain FROM ent),
 n1 AS MATERIALIZED (SELECT *, {ocr('low')} AS fixed FROM n0),
 n2 AS MATERIALIZED (SELECT *, {squeeze(rr(symbols, r'[^a-z0-9\s]', ' '))} AS hygiene, {squeeze(rr(hyphens, r'[^\w\s-]', ' '))} AS hyphened FROM n1),
 n3 AS MATERIALIZED (SELECT *, {harmony} AS harmony FROM n2),
 n4 AS MATERIALIZED (SELECT *, {squeeze('harmony')} AS harmonised, {squeeze(bare)} AS bare, {squeeze(legal)} AS legal FROM n3),
 named AS (SELECT entity_id, legal, hyphened, harmonised, CASE WHEN length(bare) >= 1 THEN bare ELSE hygiene END AS bare FROM n4)"""
