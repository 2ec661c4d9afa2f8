"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vidspark.llm.bpe import digests
from vidspark.llm.common import table, vocabulary
from vidspark.llm.cuckoo import exact_dedup
from vidspark.llm.jaccard import jaccard_join
from vidspark.llm.packing import pack
from vidspark.llm.quality import classify
from vidspark.llm.rules import measure
from vidspark.llm.secrets import RULES, scan_documents
from vidspark.llm.spelling import spelling_variants
from vidspark.llm.substring import substring_dedup
from vidspark.llm.suffix import suffix_dedup
from vidspark.llm.tokenfiles import token_files
from vidspark.llm.urls import PAGE_RULES, rule_table, url_verdicts
from vidspark.llm.whiten import whitened_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _secret_kind(kind: str, pattern: str, ord_: int, group: int, least: int) -> str:
    # DuckDB's expressions have no possessive form and need none: they do not backtrack.
    p = re.sub(r"(?<=[*+}])\+", "", pattern).replace("'", "''")
    return f"""SELECT rid, '{kind}' AS kind, {ord_} AS ord, i, length(gap) AS gap, length(m) AS len, length(g) AS part, {least} AS least
FROM (SELECT rid, unnest(string_split_regex(text, '{p}')) AS gap, unnest(regexp_extract_all(text, '{p}', 0)) AS m,
        unnest(regexp_extract_all(text, '{p}', {group})) AS g,
        unnest(range(len(string_split_regex(text, '{p}')))) AS i
      FROM d WHERE regexp_matches(text, '{p}'))"""


def _secrets_sql() -> str:
    """Positions of matches: the pieces between them and the matches before them, added up."""
    parts = "\nUNION ALL ".join(_secret_kind(r.kind, r.pattern, n, r.group, r.least) for n, r in enumerate(RULES))
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT *, sum(gap + coalesce(len, 0)) OVER (PARTITION BY rid, kind ORDER BY i) AS stop FROM ({parts})),
f AS (SELECT rid, kind, ord, CAST(stop - len AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM m WHERE part >= least),
a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < 3) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans
  FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)"""


@query("op2_secret_scans", _secrets_sql())
def op2(spark, sf):
    return scan_documents(table(spark, sf, "documents"))


@query("op3_quality_classifier")
def op3(spark, sf):
    return classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op4_exact_dedup", """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)""")
def op4(spark, sf):
    return exact_dedup(table(spark, sf, "documents"))


@query("op5_url_filters", r"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages),
h AS (SELECT rid, page_id, translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(tail, length(regexp_extract(tail, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT rid, arg_max(rh || rp, length(rh) + length(rp)) AS rule, arg_max(v, length(rh) + length(rp)) AS v
  FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM h LEFT JOIN m USING (rid)""")
def op5(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return url_verdicts(pages, rule_table(spark, PAGE_RULES)).drop("url")


@query("op8_bpe_automaton")
def op8(spark, sf):
    return digests(table(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op9_quality_rules")
def op9(spark, sf):
    docs = table(spark, sf, "documents")
    return measure(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).drop("text", "lang", "source", "n_chars")


@query("op10_mixture_packing")
def op10(spark, sf):
    return pack(table(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op7_substring_dedup", r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT rid, ws, unnest(range(len(ws) - 34)) AS i FROM d WHERE len(ws) >= 35),
h AS MATERIALIZED (SELECT rid, i, md5(array_to_string(ws[i + 1:i + 35], ' ')) AS h FROM s),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
c AS (SELECT DISTINCT rid, i + k AS i FROM r, range(35) AS t(k)),
w AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
k AS (SELECT rid, count(c.i) AS n_removed, string_agg(word, ' ' ORDER BY w.i) FILTER (c.i IS NULL) AS kept
  FROM w LEFT JOIN c USING (rid, i) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)""")
def op7(spark, sf):
    return substring_dedup(table(spark, sf, "documents"))


@query("op6_suffix_dedup")
def op6(spark, sf):
    return suffix_dedup(table(spark, sf, "documents"))


@query("op1_jaccard_join")
def op1(spark, sf):
    return jaccard_join(table(spark, sf, "documents"))


@query("op11_embedding_whitening")
def op11(spark, sf):
    return whitened_rows(table(spark, sf, "embeddings"))


@query("op12_spelling_variants", r"""
WITH RECURSIVE t AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
o AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
p AS MATERIALIZED (SELECT doc, run, count(*) AS n FROM o GROUP BY doc, run),
b AS (SELECT run, n, flatten(list_transform(string_split(doc || ':' || run, ''),
    lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [192 + (ord(x) >> 6), 128 + (ord(x) & 63)] END)) AS bytes FROM p),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(bytes, lambda x: CAST(x AS BIGINT))),
    lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]))) AS h FROM b, t),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 199 = 0
    THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
e AS (SELECT DISTINCT d.word, d.n, w.word AS other, w.n AS other_n FROM d JOIN w ON d.rest = w.word),
l AS MATERIALIZED (SELECT * FROM e UNION SELECT other, other_n, word, n FROM e
  UNION SELECT a.word, a.n, z.word, z.n FROM d AS a JOIN d AS z ON a.i = z.i AND a.rest = z.rest AND a.word <> z.word),
f AS MATERIALIZED (SELECT word, count(*) AS n_near, CASE WHEN first(other_n ORDER BY other_n DESC, other) >= 5 * any_value(n) THEN first(other ORDER BY other_n DESC, other) END AS form,
    CASE WHEN max(other_n) >= 5 * any_value(n) THEN max(other_n) END AS form_n FROM l GROUP BY word),
r AS (SELECT word, word AS root, 0 AS step FROM w UNION ALL SELECT r.word, f.form, step + 1 FROM r JOIN f ON r.root = f.word WHERE f.form IS NOT NULL)
SELECT w.word, f.form, (SELECT arg_max(root, step) FROM r WHERE r.word = w.word) AS root, w.n, coalesce(f.n_near, 0) AS n_near, f.form_n FROM w LEFT JOIN f USING (word)""")
def op12(spark, sf):
    return spelling_variants(table(spark, sf, "documents"))


@query("op13_token_files")
def op13(spark, sf):
    return token_files(table(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"))
