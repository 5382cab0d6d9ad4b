"""The operators as registered queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm import bpe_dropout, bradley_terry, chat, decontam, hpylm, media, sanitise, simhash_trie, suffix_dedup, warc_store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(_table(spark, sf_dir, "conversations"))


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(_table(spark, sf_dir, "documents"))


def op3_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bradley_terry.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_dropout.tokenise(_table(spark, sf_dir, "documents")).drop("pieces")


def op5_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.document_media(spark, _table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position")


def op6_disclosure_sanitiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.spans_report(sanitise.find_spans(_table(spark, sf_dir, "documents")))


def op7_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("items", F.array_join("items", ","))


def op8_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_store.archive_pages(spark, _table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(_table(spark, sf_dir, "documents"), outputs=False).drop("kept", "spans")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_snapshot_collapse, op2_pitman_yor, op3_bradley_terry, op4_merge_dropout, op5_interleaved_media, op6_disclosure_sanitiser, op7_template_windows, op8_simhash_trie, op9_warc_store, op10_suffix_dedup, pipeline)}


OP1_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce("text", '') AS "text",
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce("text", '')) AS position
           FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, position, count(*) OVER (PARTITION BY conv_id) AS n,
             list({'r': role, 't': "text"}) OVER (PARTITION BY conv_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS p FROM t),
f AS (SELECT p, min(conv_id) AS conv_id, count(*) AS n_copies FROM k WHERE position = n GROUP BY p),
g AS (SELECT f.conv_id, f.n_copies, len(f.p) AS n_turns FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.position < k.n AND k.p = f.p))
SELECT g.conv_id, g.n_turns, g.n_copies, string_agg('<|' || t.role || '|>' || chr(10) || t."text" || chr(10) || '<|end|>' || chr(10), '' ORDER BY t.position) AS rendered
FROM g JOIN t ON t.conv_id = g.conv_id GROUP BY ALL
"""

_HEX32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"

OP9_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT DISTINCT h FROM p),
b AS (SELECT h, string_agg(lpad(bin(('0x' || substr(h, i, 1))::INTEGER), 4, '0'), '' ORDER BY i) AS bits
      FROM d, range(1, 41) r(i) GROUP BY h),
e AS (SELECT h, string_agg(substr({_HEX32}, 1 + list_sum([CASE WHEN substr(bits, 5 * j + k, 1) = '1' THEN 1 << (5 - k) ELSE 0 END for k in [1, 2, 3, 4, 5]])::INTEGER, 1), '' ORDER BY j) AS b32
      FROM b, range(0, 32) r(j) GROUP BY h),
m AS (SELECT body, max(page_id) AS holder FROM p GROUP BY body)
SELECT p.page_id, strlen(p.body)::BIGINT AS payload_bytes, e.b32 AS payload_digest,
       CASE WHEN p.page_id = m.holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = m.holder THEN NULL ELSE m.holder END AS refers_to
FROM p JOIN m ON p.body = m.body JOIN e ON e.h = p.h
"""


_RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_AT = "(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0))::INT"
_WORD = r"\p{L}[\p{L}\p{N}]*"

OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce("text", '') AS t, coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce("text", '')) AS key FROM documents),
u AS (SELECT key, any_value(t) AS t, count(*) AS n FROM d GROUP BY key),
loc AS ({" UNION ALL ".join(f"SELECT key, {i} AS rank, '{k}' AS kind, regexp_extract_all(t, '{r}') AS v, string_split_regex(t, '{r}') AS g FROM u" for i, (k, r) in enumerate(_RULES.items()))}),
every AS (SELECT key, rank, kind, v[i] AS value, {_AT} AS s FROM loc, range(1, len(v) + 1) x(i)),
b AS (SELECT *, s + length(value)::INT AS e FROM every WHERE CASE kind WHEN 'email' THEN true
   WHEN 'ip' THEN len(list_filter(string_split(value, '.'), lambda p: coalesce(try_cast(p AS HUGEINT) <= 255, false))) = 4
   WHEN 'card' THEN length({_DIGITS}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(length({_DIGITS})), lambda j:
     CASE WHEN j % 2 = 0 THEN substr(reverse({_DIGITS}), j + 1, 1)::INT ELSE (substr(reverse({_DIGITS}), j + 1, 1)::INT * 2) % 10 + (substr(reverse({_DIGITS}), j + 1, 1)::INT * 2) // 10 END)) % 10 = 0
   ELSE length({_DIGITS}) BETWEEN 8 AND 15 END),
ent AS (SELECT key, kind || ':' || CASE WHEN kind = 'email' THEN lower(value) ELSE regexp_replace(value, '[^0-9.]', '', 'g') END AS entity, s, e FROM b),
wp AS (SELECT key, n, unnest(v) AS value, unnest(g[1:len(v)]) AS gap, generate_subscripts(v, 1) AS i FROM (SELECT key, n, regexp_extract_all(t, '{_WORD}') AS v, string_split_regex(t, '{_WORD}') AS g FROM u)),
w AS (SELECT key, n, lower(value) AS term, (sum(length(value) + length(gap)) OVER (PARTITION BY key ORDER BY i))::BIGINT AS e, e - length(value) AS s FROM wp),
free AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s) - 1 AS o FROM w WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.key = w.key AND w.s < b.e AND b.s < w.e)),
pl AS (SELECT ent.key, entity, ent.s, count(free.key) AS o FROM ent LEFT JOIN free ON free.key = ent.key AND free.s < ent.s GROUP BY ALL),
near AS (SELECT DISTINCT pl.key, entity, term, free.s, n FROM pl JOIN free ON free.key = pl.key AND free.o BETWEEN pl.o - 5 AND pl.o + 4),
pe AS (SELECT entity, term, sum(n) AS both_ FROM near GROUP BY ALL),
sup AS (SELECT entity, term FROM (SELECT DISTINCT key, entity, term, n FROM near) GROUP BY ALL HAVING sum(n) >= 2),
ne AS (SELECT entity, sum(both_) AS n_e FROM pe GROUP BY 1),
ct AS (SELECT term, sum(n) AS c_t FROM free GROUP BY 1),
m AS (SELECT sum(c_t) AS m FROM ct),
hit AS (SELECT DISTINCT term FROM pe JOIN sup USING (entity, term) JOIN ne USING (entity) JOIN ct USING (term), m WHERE n_e < m AND both_ * 2 >= c_t AND 1 + ln(both_::DOUBLE / c_t) / ln(m::DOUBLE / n_e) >= 0.8),
tm AS (SELECT key, s, e FROM free JOIN hit USING (term)),
ba AS (SELECT key, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY rank, s) AS x, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _RULES)} FROM b GROUP BY key),
ta AS (SELECT key, string_agg('term:' || s || ':' || e, ',' ORDER BY s, e) AS x, count(*) AS n_term FROM tm GROUP BY key)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _RULES)}, sha256(coalesce(ba.x, '')) AS base_sha256, concat_ws(',', ba.x, ta.x) AS spans, coalesce(n_term, 0) AS n_term
FROM d LEFT JOIN ba ON ba.key = d.key LEFT JOIN ta ON ta.key = d.key
"""

_LIST = lambda words: ", ".join(f"'{w}'" for w in words)
_RUN = lambda column, n: " || chr(10) || ".join([column, *[f"lead({column}, {k}) OVER o" for k in range(1, n)]])
_CAP = r"\p{Lu}\p{Ll}[\p{L}\p{N}]*"

OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce("text", '') AS t FROM documents),
x AS (SELECT 'd' AS src, k, t FROM d UNION ALL SELECT 'b', item_id, coalesce("text", '') FROM benchmark WHERE item_id IS NOT NULL),
l AS (SELECT src, k, regexp_extract_all(t, '{_CAP}(?: {_CAP})*|\\p{{Nd}}+(?:[.,]\\p{{Nd}}+)*|\\p{{L}}[\\p{{L}}\\p{{N}}]*|\\p{{N}}+') AS l FROM x),
u AS (SELECT src, k, len(l) AS n, unnest(l) AS tok, generate_subscripts(l, 1) AS i FROM l),
a AS (SELECT *, lower(tok) AS v, CASE WHEN regexp_matches(tok, '^\\p{{Lu}}\\p{{Ll}}') THEN 'name' WHEN regexp_matches(tok, '^\\p{{Nd}}') OR lower(tok) IN ({_LIST(decontam.NUMBERS)}) THEN 'num' ELSE '' END AS kind0 FROM u),
b AS (SELECT src, k, n, i, v, CASE WHEN kind0 = '' AND v IN ({_LIST(decontam.UNITS)}) AND lag(kind0) OVER (PARTITION BY src, k ORDER BY i) = 'num' THEN 'unit' ELSE kind0 END AS kind FROM a),
c AS (SELECT *, CASE kind WHEN '' THEN v ELSE '#' || kind END AS ty, CASE WHEN kind IN ('', 'name') THEN v ELSE '#' || kind END AS pl FROM b),
w AS (SELECT src, k, n, i, {_RUN("ty", 5)} AS ty5, {_RUN("pl", 5)} AS pl5, {", ".join(f"{_RUN('v', n)} AS v{n}" for n in range(1, 5))} FROM c WINDOW o AS (PARTITION BY src, k ORDER BY i)),
h AS (SELECT p.k, q.k AS item, p.i AS pa, q.i AS pb FROM w p JOIN w q ON p.src = 'd' AND q.src = 'b' AND p.ty5 = q.ty5
      UNION SELECT p.k, q.k, p.i, q.i FROM w p JOIN w q ON p.src = 'd' AND q.src = 'b' AND p.pl5 = q.pl5
      {" ".join(f"UNION SELECT p.k, q.k, p.i, q.i FROM w p JOIN w q ON p.src = 'd' AND q.src = 'b' AND q.n = {n} AND q.i = 1 AND p.v{n} = q.v{n}" for n in range(1, 5))}),
z AS (SELECT DISTINCT h.k, item, pa - pb AS shift, pb + j AS place FROM h, range(0, 5) r(j)),
f AS (SELECT z.k, item, shift, place, q.n, q.kind, q.v AS iv, p.v AS dv FROM z JOIN c q ON q.src = 'b' AND q.k = item AND q.i = place JOIN c p ON p.src = 'd' AND p.k = z.k AND p.i = place + shift),
bad AS (SELECT DISTINCT k, item, shift FROM (SELECT k, item, shift, kind, iv FROM f WHERE kind <> '' GROUP BY ALL HAVING count(DISTINCT dv) > 1)),
g AS (SELECT k, item, count(DISTINCT place) / any_value(n) AS coverage FROM f WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.k = f.k AND bad.item = f.item AND bad.shift = f.shift) GROUP BY k, item HAVING count(DISTINCT place) / any_value(n) >= 0.8),
s AS (SELECT k, max(coverage) AS coverage, string_agg(item::VARCHAR, ',' ORDER BY item) AS items FROM g GROUP BY k)
SELECT d.doc_id, s.k IS NOT NULL AS contaminated, coalesce(s.coverage, 0.0)::DOUBLE AS coverage, coalesce(s.items, '') AS items FROM d LEFT JOIN s ON s.k = d.k
"""

OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, encode(coalesce("text", '')) AS b FROM documents),
w AS (SELECT k, doc_id, i, array_slice(b, i, i + 49) AS s FROM d, range(1, octet_length(b) - 48) t(i)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
g AS (SELECT w.k, w.i, lag(w.i) OVER (PARTITION BY w.k ORDER BY w.i) AS p FROM w JOIN m ON w.s = m.s WHERE m.least < w.doc_id),
r AS (SELECT k, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS run FROM g),
sp AS (SELECT k, run, min(i) AS a, max(i) + 49 AS z FROM r GROUP BY k, run),
n AS (SELECT k, count(*) AS n_spans, sum(z - a + 1)::BIGINT AS n_removed, max(z) AS z FROM sp GROUP BY k),
cut AS (SELECT k, coalesce(lag(z) OVER (PARTITION BY k ORDER BY a), 0) + 1 AS f, a - 1 AS t FROM sp
        UNION ALL SELECT d.k, coalesce(n.z, 0) + 1, octet_length(d.b) FROM d LEFT JOIN n ON n.k = d.k),
h AS (SELECT d.k, string_agg(hex(array_slice(d.b, cut.f, cut.t)), '' ORDER BY cut.f) AS x FROM cut JOIN d ON d.k = cut.k WHERE cut.f <= cut.t GROUP BY d.k)
SELECT d.doc_id, octet_length(d.b)::BIGINT AS n_bytes, coalesce(n.n_removed, 0) AS n_removed, coalesce(n.n_spans, 0) AS n_spans, sha256(unhex(coalesce(h.x, ''))) AS kept_sha256
FROM d LEFT JOIN n ON n.k = d.k LEFT JOIN h ON h.k = d.k
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_snapshot_collapse": OP1_SQL, "op6_disclosure_sanitiser": OP6_SQL, "op7_template_windows": OP7_SQL, "op9_warc_store": OP9_SQL, "op10_suffix_dedup": OP10_SQL}
