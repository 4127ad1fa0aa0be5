"""The thin opN queries: each applies one operator to its whole table and returns the digest columns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, exact_dedup, html_extract, lm_scoring, minhash, mixing, packing, quality, token_counts, toxicity, warc


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    counted = quality.with_counts(docs, out="").drop("text")
    judged = quality.judged(common.stored(counted, "quality-counts"), out="")
    return judged.select("doc_id", *quality.STATS, "base_failed", "kept")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assigned(common.table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP6_SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS h FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
"""


WORDS_SQL = "list_filter(regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP7_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {minhash.PERCENT} * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, y FROM r JOIN both_ways ON r.b = x),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN c ON a = doc_id
"""


def op8_sql() -> str:
    """Counts by windows of words; quantiles by ranks of log bins; valleys by sums over doublings; small groups fall back."""
    gamma = (1 + quality.ACCURACY) / (1 - quality.ACCURACY)
    value = lambda b: f"CASE WHEN {b} < 0 THEN 0.0::DOUBLE ELSE pow({gamma!r}::DOUBLE, {b}) END"

    def limits(keys: str, tag: str) -> str:
        near, far = f"({value('b90')} - {value('b50')})", f"({value('b95')} - {value('b50')})"
        points = ", ".join(f"min(bin) FILTER (100 * k >= {q} * total) AS b{q}" for q in (50, 90, 95))
        return f"""
{tag}q AS (SELECT {keys}rate, max(total) AS total, {points} FROM (SELECT *, row_number() OVER (PARTITION BY {keys}rate ORDER BY bin) AS k, count(*) OVER (PARTITION BY {keys}rate) AS total FROM b) GROUP BY ALL),
{tag}f AS (SELECT {keys}rate, total, CASE WHEN b90 > b50 THEN {value('b50')} + {near} * pow({far} / {near}, {quality.REACH}) END AS fence FROM {tag}q),
{tag}d AS (SELECT {keys}rate, floor(bin / {quality.DOUBLING})::INTEGER AS d, count(*) AS n FROM b GROUP BY ALL),
{tag}v AS (SELECT {keys}rate, pow({gamma!r}::DOUBLE, min(d) * {quality.DOUBLING} - 1) AS valley FROM (
 SELECT *, sum(n) OVER (PARTITION BY {keys}rate) AS total, coalesce(sum(n) OVER (PARTITION BY {keys}rate ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
 coalesce(sum(n) OVER (PARTITION BY {keys}rate ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND {quality.VALLEY + 1} PRECEDING), 0) AS bulk FROM {tag}d) WHERE {quality.EMPTY} * (below - bulk) < total - below AND 100 * bulk >= {quality.BULK} * total GROUP BY ALL),
{tag} AS (SELECT f.*, least(fence, valley) AS top FROM {tag}f f LEFT JOIN {tag}v v ON {" AND ".join(f"f.{k} IS NOT DISTINCT FROM v.{k}" for k in [*keys.replace(",", " ").split(), "rate"])}),"""

    rates = ", ".join(f"('{r}', {c})" for r, c in quality.RATES.items())
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {WORDS_SQL.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM d WHERE len(w) >= 5),
twice AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, sum(fresh)::BIGINT AS n_repeat_words FROM (SELECT doc_id, least(5, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p), 5)) AS fresh FROM twice) GROUP BY doc_id),
c AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
 len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))::BIGINT - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
x AS (SELECT f.doc_id, lang, source, base_failed, x.rate, 1000 * x.n // greatest(n_words, 1) AS v FROM f, LATERAL (VALUES {rates}) x(rate, n)),
b AS (SELECT lang, source, rate, CASE WHEN v <= 0 THEN -1 ELSE ceil(ln(v::DOUBLE) / {math.log(gamma)!r})::INTEGER END AS bin FROM x WHERE NOT base_failed),
{limits("lang, source, ", "o")}{limits("lang, ", "l")}{limits("", "a")}
q AS (SELECT o.lang, o.source, o.rate, CASE WHEN o.total >= {quality.MIN_GROUP} THEN o.top WHEN l.total >= {quality.MIN_GROUP} THEN l.top ELSE a.top END AS top FROM o LEFT JOIN l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rate = l.rate LEFT JOIN a ON o.rate = a.rate),
over AS (SELECT x.doc_id, bool_or(v > coalesce(top, 'inf'::DOUBLE)) AS over FROM x LEFT JOIN q ON x.lang IS NOT DISTINCT FROM q.lang AND x.source IS NOT DISTINCT FROM q.source AND x.rate = q.rate GROUP BY x.doc_id)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT over AS kept FROM f JOIN over USING (doc_id)
"""


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.word_sizes(common.table(spark, sf_dir, "documents"), "text", ["doc_id", "source"])
    return mixing.mix(sized, ["doc_id"]).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(common.table(spark, sf_dir, "documents"), words=4).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_extract.extract(common.table(spark, sf_dir, "pages"))
    return text.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = warc.derivatives(warc.responses(common.table(spark, sf_dir, "pages")), key="page_id")
    kept = derived.select("page_id", "record_id", "kind", "refers_to", "target_uri", "status", "digest_ok", F.col("headers")["WARC-Payload-Digest"].alias("payload_digest"), "block_digest", "n_bytes", F.when(F.col("kind") == "conversion", F.decode("block", "UTF-8")).alias("text"))
    return kept


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    held_out = common.id_bucket_column(F.col("id"), toxicity.FOLDS) == toxicity.HELD_OUT
    return toxicity.score(docs, model).select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op1_lm_scoring": op1_lm_scoring, "op2_source_mixing": op2_source_mixing, "op3_best_fit_packing": op3_best_fit_packing, "op4_token_counts": op4_token_counts, "op5_toxicity": op5_toxicity, "op6_exact_dedup": op6_exact_dedup, "op7_minhash_near_dedup": op7_minhash_near_dedup, "op8_quality_rules": op8_quality_rules, "op9_html_extraction": op9_html_extraction, "op10_warc_derivatives": op10_warc_derivatives}
ORACLES: dict[str, str] = {"op6_exact_dedup": OP6_SQL, "op7_minhash_near_dedup": OP7_SQL, "op8_quality_rules": op8_sql()}
