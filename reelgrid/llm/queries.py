"""The queries of this subpackage, one per operator over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, gnat, html_text, mixing, packing, quality, repair, rule_ensemble, simhash, substring, token_files, toxicity, url_filter

#: The rules that op2 is asked to apply.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "word", 1, 4096)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(_table(spark, sf_dir, "pages"), URL_RULES)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), unit="space", end_id=2)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(_table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(_table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(_table(spark, sf_dir, "documents")).select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"), ["doc_id"])


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.reported(_table(spark, sf_dir, "conversations"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gnat.coded(_table(spark, sf_dir, "embeddings")).drop("label")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_best_fit_packing, op2_url_filter, op3_token_files, op4_source_mixing, op5_nearest_neighbours, op6_quality_classifier, op7_substring_dedup, op8_html_extraction, op9_simhash_near_dedup, op10_quality_rules, op11_conversation_repair, op12_toxicity, op13_vector_codes]
    return {f.__name__: f for f in own}


_WORD = r"[^\x20\x09-\x0D]+"

OP7_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM w)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM later),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


def _op10_sql() -> str:
    #: count, of what, added to both for the quartiles, has a lower limit
    rules = {"symbol_share": ("n_symbols", "word_chars", 1, False), "mean_word": ("word_chars", "n_words", 0, True), "dup_line_share": ("n_dup_lines", "n_lines", 1, False), "repeat_share": ("n_repeat_words", "n_words", 8, False)}
    values = ", ".join(f"CAST({x} AS DOUBLE) / greatest({y}, 1) AS {m}, CAST({x} + {k} AS DOUBLE) / greatest({y} + {k}, 1) AS p_{m}" for m, (x, y, k, _) in rules.items())
    quantiles = lambda prefix: ", ".join(f"quantile_disc(p_{m}, [0.25, 0.75]) AS {prefix}{m}" for m in rules)
    pick = lambda m: f"(CASE WHEN n >= 30 THEN g_{m} WHEN ln >= 30 THEN l_{m} ELSE c_{m} END)"
    tests = []
    for m, (_, _, _, low) in rules.items():
        q = pick(m)
        if low:
            tests.append(f"coalesce({m} >= {q}[1] - ({q}[2] - {q}[1]) * 5.0, true)")
        tests.append(f"coalesce({m} <= {q}[2] + ({q}[2] - {q}[1]) * 5.0, true)")
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS p FROM w)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS i FROM again) GROUP BY 1),
s AS (SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {values} FROM s), ok AS (SELECT * FROM m WHERE NOT base_failed),
g AS (SELECT lang, source, count(*) AS n, {quantiles("g_")} FROM ok GROUP BY ALL), l AS (SELECT lang, count(*) AS ln, {quantiles("l_")} FROM ok GROUP BY ALL), c AS (SELECT {quantiles("c_")} FROM ok)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(tests)} AS kept
FROM m LEFT JOIN g ON m.lang IS NOT DISTINCT FROM g.lang AND m.source IS NOT DISTINCT FROM g.source LEFT JOIN l ON m.lang IS NOT DISTINCT FROM l.lang CROSS JOIN c"""


OP10_SQL = _op10_sql()


_BLANK = r"[\x20\x09-\x0D]"


def _op11_sql() -> str:
    """The edits by dynamic programming from each conversation's end: v holds, for each state of the grammar, cost and audit as one text, so that the least text is the least cost and then the least audit."""
    more = lambda k, letter, v: f"lpad(CAST(CAST({v}[1:9] AS BIGINT) + {k} AS VARCHAR), 9, '0') || '{letter}' || {v}[10:]"

    def taken(q: int, to: dict[str, int], new: int) -> str:
        keep = " ".join(f"WHEN i = '{i}' THEN {more('cut', 'K', f'v[{t + 1}]')}" for i, t in to.items())
        return f"least({more(3, 'D', f'v[{q + 1}]')}, CASE WHEN gone THEN NULL {keep} END, CASE WHEN NOT gone THEN {more('2 + cut', 'R', f'v[{new + 1}]')} END)"

    grammar = [({"s": 1, "u": 2}, 2), ({"u": 2}, 2), ({"a": 3}, 3), ({"u": 2}, 2)]
    return rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
hit AS (SELECT raw.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(key) + 1), lambda j: CAST(ascii(key[j]) AS BIGINT))), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS k FROM raw, crc),
dam AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n FROM dam),
fault AS (SELECT *, regexp_replace(text, '{_BLANK}', '', 'g') AS solid, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again FROM num),
sym AS (SELECT *, CASE WHEN role[1:1] IN ('s', 'u', 'a') THEN role[1:1] ELSE 'x' END AS i, CASE WHEN solid = '' THEN 'b' WHEN again THEN 'd' WHEN solid[-1:] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f FROM fault),
seq AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS m, lag(i) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM sym),
dp(conv_id, n, v) AS (SELECT DISTINCT conv_id, m + 1, ['000000000', '000000004II', '000000002I', '000000000'] FROM seq UNION ALL
SELECT conv_id, n, [least(b[1], {more(2, 'I', 'u')}), least(b[2], {more(2, 'I', 'u')}), u, a] FROM (SELECT *, least(b[3], {more(2, 'I', 'b[4]')}) AS u, least(b[4], {more(2, 'I', 'b[3]')}) AS a FROM (SELECT conv_id, n, [{", ".join(taken(q, *g) for q, g in enumerate(grammar))}] AS b
FROM (SELECT s.conv_id, s.n, s.i, s.f IN ('b', 'd') AS gone, CASE WHEN s.f = 't' THEN 1 ELSE 0 END AS cut, v FROM dp JOIN seq s ON s.conv_id IS NOT DISTINCT FROM dp.conv_id AND s.n = dp.n - 1)))),
best AS (SELECT conv_id, CAST(v[1][1:9] AS BIGINT) AS cost, v[1][10:] AS audit FROM dp WHERE n = 1),
step AS (SELECT conv_id, audit[p:p] AS e, p FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM best)),
took AS (SELECT *, count(*) FILTER (e <> 'I') OVER w AS n, count(*) FILTER (e <> 'D') OVER w AS o FROM step WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
rows_ AS (SELECT t.conv_id, t.p, t.e, t.o, CASE WHEN t.e <> 'I' THEN s.role END AS own, CASE WHEN t.e = 'I' THEN '' ELSE s.text END AS text FROM took t LEFT JOIN seq s ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND s.n = t.n WHERE t.e <> 'D'),
lead_ AS (SELECT *, coalesce(bool_or(o = 1 AND e = 'K' AND own[1:1] = 's') OVER (PARTITION BY conv_id), false) AS s FROM rows_),
done AS (SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN own WHEN (o + CASE WHEN s THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p)) AS h FROM lead_ GROUP BY 1),
cnt AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM seq GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id"""


def _op13_sql(rounds: int = 4, entries: int = 256, parts: int = 4) -> str:
    """Rounds written out one after another; squared distances of whole numbers are exact in double precision."""
    near = lambda r: f"n{r} AS (SELECT id, part, x, arg_min(i, (d, i)) AS i, min(d) AS d FROM (SELECT p.id, p.part, p.x, b.i, list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x) AS d FROM p JOIN b{r} b USING (part)) GROUP BY id, part, x)"
    steps = []
    for r in range(rounds):
        steps += [near(r), f"s{r} AS (SELECT part, i, list(m ORDER BY pos) AS x FROM (SELECT part, i, pos, floor(sum(v) / count(*)) AS m FROM (SELECT part, i, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM n{r}) GROUP BY ALL) GROUP BY ALL)",
                  f"b{r + 1} AS (SELECT b.part, b.i, coalesce(s.x, b.x) AS x FROM b{r} b LEFT JOIN s{r} s USING (part, i))"]
    return f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS id, vec_id, label, list_transform(embedding, lambda v: floor(CAST(v AS DOUBLE) * 1024)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
p AS (SELECT id, part, x[len(x) // {parts} * part + 1:len(x) // {parts} * (part + 1)] AS x FROM k, range({parts}) t(part)),
b0 AS (SELECT part, id AS i, x FROM p WHERE id < {entries}), {", ".join(steps)}, {near(rounds)},
c AS (SELECT id, string_agg(format('{{:02x}}', i), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{rounds} GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, i)) AS h FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM k JOIN c USING (id), h"""


OP11_SQL, OP13_SQL = _op11_sql(), _op13_sql()


def oracle_sql() -> dict[str, str]:
    """SQL has no SimHash words, tokenizers or trained models: the other queries are tested against brute force, exact round trips or held-out labels."""
    return {"op7_substring_dedup": OP7_SQL, "op10_quality_rules": OP10_SQL, "op11_conversation_repair": OP11_SQL, "op13_vector_codes": OP13_SQL}
