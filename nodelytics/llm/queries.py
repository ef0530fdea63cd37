"""The subpackage's queries for the driver, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language, lexical, lexicon, neighbours, quality, resample, shards, simhash, substrings, token_counts, token_files, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": shards.query,
    "op2_toxicity": toxicity.query,
    "op3_language_id": language.query,
    "op4_bpe": lexicon.query,
    "op5_suffix_array": substrings.query,
    "op6_token_files": token_files.query,
    "op7_quality_rules": quality.query,
    "op8_token_counts": token_counts.query,
    "op9_decontamination": decontaminate.query,
    "op10_simhash": simhash.query,
    "op11_resampling": resample.query,
    "op12_lexical_search": lexical.query,
    "op13_neighbours": neighbours.query,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op9_decontamination": f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT DISTINCT item, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS g FROM b, unnest(generate_series(1, greatest(1, len(w) - 9))) t(i) WHERE len(w) > 0),
d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
s AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g FROM d, (SELECT DISTINCT n FROM w), unnest(generate_series(1, len(w) - n + 1)) t(i)),
h AS (SELECT doc_id, i, s.n, item FROM s JOIN w ON s.n = w.n AND s.g = w.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(generate_series(i, i + n - 1)) t(p) GROUP BY 1),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)""",
    # CRC-32 of each different feature, a byte at a time over a table made of the polynomial
    "op11_resampling": rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents), b AS (SELECT coalesce({_WORDS}, []) AS w FROM benchmark),
f AS (SELECT doc_id, unnest(w) AS f FROM d UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d),
g AS (SELECT unnest(w) AS f FROM b UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM b),
t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))),
u AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM f UNION SELECT f FROM g)),
h AS (SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, v: xor(c // 256, t[xor(c, v) % 256 + 1])), 4294967295) % 10000 AS k FROM u, t),
s AS (SELECT k, count(*) AS s FROM f JOIN h USING (f) GROUP BY 1), q AS (SELECT k, count(*) AS t FROM g JOIN h USING (f) GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM f) AS s_all, (SELECT count(*) FROM g) AS t_all),
a AS (SELECT k, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN q USING (k), n),
w AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS gains FROM f JOIN h USING (f) JOIN a USING (k) GROUP BY 1),
m AS (SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, CASE WHEN n_features IS NULL THEN 0 WHEN gains % n_features < 0 THEN gains // n_features - 1 ELSE gains // n_features END AS weight, CAST('0x' || substr(sha256('7:' || d.doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (doc_id)),
z AS (SELECT doc_id, n_words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM z)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN n_words >= 20 AND r <= 25 * n // 100 THEN r END AS rank FROM r""",
    "op12_lexical_search": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents), b AS (SELECT item_id, unnest(list_distinct(coalesce({_WORDS}, []))) AS term FROM benchmark),
k AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w)) AS l FROM d),
f AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM b) GROUP BY 1, 2),
t AS (SELECT term, CAST(floor(1000 * ln((2 * k.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, k GROUP BY term, k.n),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * f.n * k.n) // CAST(k.l AS BIGINT))))) AS BIGINT) AS score FROM b JOIN t USING (term) JOIN f USING (term), k GROUP BY 1, 2),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
}
