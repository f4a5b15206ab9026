"""Queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, divergence, extraction, jaccard, merkle, mixing, packing, quality, sharding, substrings, suffixes, tokens, urls
from .common import read


def _over(table: str, digest: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: digest(read(spark, sf_dir, table))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": lambda spark, sf_dir: decontamination.digest(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    ),
    "op2_mix": _over("documents", mixing.digest),
    "op3_token_lengths": _over("documents", tokens.length_histogram),
    "op4_shards": _over("documents", sharding.digest),
    "op5_token_files": _over("documents", packing.digest),
    "op6_suffix_dedup": _over("documents", suffixes.digest),
    "op7_url_filter": _over("pages", urls.digest),
    "op8_word_dedup": _over("documents", substrings.digest),
    "op9_jaccard": _over("documents", jaccard.digest),
    "op10_quality": _over("documents", quality.digest),
    "op11_main_text": _over("pages", extraction.digest),
    "op12_divergence": _over("documents", divergence.digest),
    "op13_merkle": _over("documents", merkle.digest),
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Upper sizes of the partitions of items, to more than any text holds.
_LIMITS = [8]
while _LIMITS[-1] < 1 << 40:
    _LIMITS.append(_LIMITS[-1] + _LIMITS[-1] // 2)

#: The others hash by seed, fit a model or encode, which SQL cannot express; op6
#: is expressible but has a 400-byte string per byte, which is too slow.
ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents), b AS (SELECT item_id, {_WORDS.format(_LOWER)} AS ws FROM benchmark),
items AS (SELECT DISTINCT item_id, least(5, len(ws)) AS w, unnest(list_transform(range(1, len(ws) - least(5, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(5, len(ws)) - 1], ' '))) AS s FROM b WHERE len(ws) > 0),
sizes AS (SELECT item_id, any_value(w) AS w, count(*) AS n, list_min(list_filter({_LIMITS}, lambda x: x >= count(*))) AS step FROM items GROUP BY item_id),
runs AS (SELECT doc_id, w, unnest(range(0, len(ws) - w + 1)) AS pos, unnest(list_transform(range(1, len(ws) - w + 2), lambda i: array_to_string(ws[i:i + w - 1], ' '))) AS s FROM d, (SELECT DISTINCT w FROM items) WHERE len(ws) >= w),
hits AS (SELECT r.doc_id, i.item_id, r.s, unnest([pos // step, pos // step - 1]) AS win FROM runs r JOIN items i ON r.s = i.s AND r.w = i.w JOIN sizes z ON z.item_id = i.item_id),
best AS (SELECT doc_id, item_id, win, count(DISTINCT s) AS shared FROM hits WHERE win >= 0 GROUP BY ALL)
SELECT doc_id, item_id, max(shared) AS shared, any_value(n) AS item_shingles, max(shared) / any_value(n) AS containment FROM best JOIN sizes USING (item_id) GROUP BY doc_id, item_id HAVING max(shared) >= 0.8 * any_value(n)""",
    "op8_word_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
x AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
again AS (SELECT doc_id, i FROM x QUALIFY count(*) OVER (PARTITION BY s) > 1),
gone AS (SELECT doc_id, list(j) AS js FROM (SELECT DISTINCT doc_id, i + k AS j FROM again, range(35) r(k)) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(ws, lambda v, k: NOT coalesce(list_contains(js, k), false)), ' ')) AS kept_sha256 FROM w LEFT JOIN gone USING (doc_id)""",
    "op9_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
g AS (SELECT doc_id, unnest(sh) AS x FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, any_value(n.n) AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id""",
    "op12_divergence": divergence.ORACLE,
    "op13_merkle": merkle.oracle(),
}
