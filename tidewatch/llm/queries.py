"""The operators as registered queries over whole tables, and the SQL that SQL can state."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontamination, exact_dedup, language, line_dedup, minhash_dedup, mixing, phrases, prefix_trie, quality,
               substring_dedup, toxicity, url_rules, vector_dedup)
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).drop("shards")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.url_verdicts(table(spark, sf_dir, "pages"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_decontamination, op3_substring_dedup, op4_mixing, op5_language, op6_exact_dedup,
                            op7_line_dedup, op8_url_rules, op9_near_dedup, op10_quality, op11_collocations, op12_vector_dedup,
                            op13_prefix_trie)}

_LOWER = "translate({0}, '" + string.ascii_uppercase + "', '" + string.ascii_lowercase + "')"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SQL: dict[str, str] = {
    "op2_decontamination": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         [x FOR x IN regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '{_NO_WORD}') IF x <> ''] AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         [x FOR x IN regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '{_NO_WORD}') IF x <> ''] AS w
  FROM benchmark),
iw AS (
  SELECT item, least(len(w), 10) AS n, w, unnest(range(0, greatest(len(w) - 9, 1))) AS s FROM i WHERE len(w) > 0),
ik AS (SELECT DISTINCT item, n, array_to_string(w[s + 1 : s + n], ' ') AS k FROM iw),
dw AS (
  SELECT r, n, w, unnest(range(0, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM ik) WHERE len(w) >= n),
h AS (
  SELECT r, s, dk.n, item FROM (SELECT r, s, n, array_to_string(w[s + 1 : s + n], ' ') AS k FROM dw) dk
  JOIN ik ON dk.n = ik.n AND dk.k = ik.k),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + n)) AS p FROM h) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)""",
    "op6_exact_dedup": f"""
WITH n AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)""",
    "op7_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, source, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, source, unnest(ls) AS raw, generate_subscripts(ls, 1) AS a FROM d WHERE text IS NOT NULL),
t AS (SELECT r, doc_id, source, a, raw, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM l),
b AS (SELECT line, min({{'d': doc_id, 'a': a}}) AS first FROM t WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}),
m AS (SELECT t.*, b.first IS NOT NULL AND NOT (t.doc_id IS NOT DISTINCT FROM b.first.d AND t.a = b.first.a) AS gone FROM t LEFT JOIN b USING (line)),
j AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY a) FILTER (NOT gone), '') AS left_text FROM m GROUP BY r)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN coalesce(n_removed, 0) = 0 THEN text ELSE left_text END AS text
FROM d LEFT JOIN j USING (r)""",
    "op8_url_rules": f"""
WITH RECURSIVE p AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT page_id, url, {_LOWER.format("regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1)")} AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p),
g(verdict, h, f) AS (VALUES {", ".join(str(r) for r in url_rules.RULES)}),
fit AS (
  SELECT url, h || f AS rule, verdict, row_number() OVER (PARTITION BY url ORDER BY length(h || f) DESC, length(h) DESC, h || f) AS k
  FROM (SELECT DISTINCT url, host, path FROM q) u, g WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f)),
r AS (SELECT url, rule, verdict FROM fit WHERE k = 1),
tok AS (
  SELECT DISTINCT url, unnest(list_concat(
    ['scheme:' || lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))],
    ['host:' || x FOR x IN string_split(host, '.') IF x <> ''],
    ['path:' || x FOR x IN regexp_split_to_array(path, '[/._-]+') IF x <> ''],
    ['query:' || x FOR x IN string_split(regexp_replace(regexp_extract(url, '\\?([^#]*)', 1), '=[^&]*', '', 'g'), '&') IF x <> ''],
    CASE WHEN contains(url, '#') THEN ['fragment'] ELSE [] END)) AS token
  FROM (SELECT DISTINCT url, host, path FROM q WHERE host <> '')),
lab AS (SELECT url, verdict = 'block' AS blocked FROM r),
lim AS (SELECT ceil({url_rules.MIN_SUPPORT} * count(*)) AS least FROM lab),
bt AS (SELECT url, token FROM tok JOIN lab USING (url) WHERE blocked QUALIFY count(*) OVER (PARTITION BY token) >= (SELECT least FROM lim)),
lev(url, items, top) AS (
  SELECT url, [token], token FROM bt
  UNION ALL SELECT * FROM (
    SELECT lev.url, list_append(items, token) AS items, token FROM lev JOIN bt ON bt.url = lev.url AND token > top
    QUALIFY count(*) OVER (PARTITION BY list_append(items, token)) >= (SELECT least FROM lim))),
has AS (SELECT url, list(token) AS toks FROM tok GROUP BY url),
supported AS (SELECT items, count(*) AS n FROM lev GROUP BY items),
mined AS (
  SELECT items FROM supported JOIN (SELECT toks FROM has JOIN lab USING (url)) l ON list_has_all(toks, items)
  GROUP BY items, n HAVING n * 1.0 / count(*) >= {url_rules.MIN_CONFIDENCE}),
hit AS (SELECT DISTINCT url FROM has JOIN mined ON list_has_all(toks, items))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN hit.url IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM q LEFT JOIN r ON q.url = r.url LEFT JOIN hit ON q.url = hit.url""",
    "op9_near_dedup": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[p] || ' ' || w[p + 1] END AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT documents.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, documents.doc_id = component_id AS kept
FROM documents JOIN c ON c.doc_id = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id""",
    "op11_collocations": f"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\\x20\\x09]+') IF x <> ''] AS w FROM t),
s AS (SELECT lang, m, w, unnest(range(0, len(w) - m + 1)) AS s FROM p, range(1, 5) r(m) WHERE len(w) >= m),
g AS (SELECT lang, m, array_to_string(w[s + 1 : s + m], ' ') AS phrase, count(*) AS f FROM s GROUP BY 1, 2, 3),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE m > 1 AND f >= {phrases.MIN_COUNT}),
cut AS (SELECT lang, phrase, a, m, k, array_to_string(w[1 : k], ' ') AS x, array_to_string(w[k + 1 : m], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
scored AS (
  SELECT cut.lang, cut.phrase, a, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * a) // (l.f + r.f) AS BIGINT) AS score, k
  FROM cut JOIN g l ON l.lang = cut.lang AND l.phrase = x JOIN g r ON r.lang = cut.lang AND r.phrase = y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT b.* FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM c WHERE c.lang = b.lang AND len(c.w) > len(string_split(b.phrase, ' '))
    AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100::HUGEINT * c.a >= {phrases.INSIDE}::HUGEINT * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= {phrases.TOP}""",
    "op12_vector_dedup": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
  AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {vector_dedup.THRESHOLD}),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
top AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM top LEFT JOIN n USING (vec_id)""",
    "op13_prefix_trie": f"""
WITH t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text)) AS k,
         {{'role': role, 'text': text}} AS s FROM t),
h AS (
  SELECT c, xor(list_reduce(list_concat([4294967295], [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(c AS VARCHAR), '')]),
      lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)),
        lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT h.c, k, s FROM h JOIN o ON o.c = h.c - h.c % {prefix_trie.FAMILY} AND k <= h
  UNION ALL SELECT h.c, k, s FROM h JOIN o ON o.c = h.c AND k > h),
f AS (SELECT h.c, coalesce(list(s ORDER BY k) FILTER (k IS NOT NULL), []) AS path FROM h LEFT JOIN r ON r.c = h.c GROUP BY h.c),
m AS (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM f),
node AS (
  SELECT path[1 : d] AS p, d, min(c) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(path) = d), '') AS ends,
  FROM m GROUP BY 1, 2),
kid AS (SELECT p[1 : d - 1] AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
val AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf,
         (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE len([x FOR x IN regexp_split_to_array(node.p[d].text, '[\\x20\\x09-\\x0D]+') IF x <> '']) END AS saved
  FROM node LEFT JOIN kid ON kid.p = node.p),
up AS (SELECT p[1 : a] AS p, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM val) GROUP BY 1)
SELECT val.conv_id, val.d AS depth, parent.conv_id AS parent_conv_id, val.n_convs, val.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(val.ends) AS ends_sha256
FROM val JOIN up ON up.p = val.p LEFT JOIN node parent ON val.d > 0 AND parent.p = val.p[1 : val.d - 1]""",
}
