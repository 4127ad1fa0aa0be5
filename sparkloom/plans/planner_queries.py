"""Planner, selection and verification queries over the relational driver tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..config import Rule
from ..errors import ConfigError, PlanError
from ..sinks.sharded import Entry, assign
from . import compare, planner, selection, verify
from .catalogue import query
from .resolve import Resolver, with_dims

#: The driver tables' part types as storage types.
TYPES = {"ECONOMY": "Q5_K", "STANDARD": "Q6_K", "LARGE": "Q3_K", "PROMO": "IQ3_S", "SMALL": "F32", "MEDIUM": "Q4_K"}
QTYPE_SQL = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items()) + " END"
NAME_SQL = "'blk.' || replace(p_brand, 'Brand#', '') || '.' || replace(p_name, ' ', '_') || '.weight'"

RULES = (
    Rule(r"blk\.{i}\..*", "late_blocks", drop=True, block_range=(24, 26)),
    Rule(r"blk\.(?P<n>\d+)\.red_(?P<what>\w+)\.weight", "red", "model.layers.{n}.red.{what}.weight", bits=8, group_size=32),
    Rule(r"blk\.(?P<n>\d+)\.(?P<what>\w+_widget)\.weight", "widgets", "model.layers.{n}.{what}.weight"),
    Rule(r"blk\.(?P<n>[1-9])\..*", "low_blocks", "model.low.{n}.{size}.weight", quantize=False),
    Rule(r"token_embd\.weight", "embeddings", "model.embed_tokens.weight"),
    Rule(r"rope_.*", "rope", drop=True),
    Rule(r"output\.weight", "head", "lm_head.weight", optional=True),
)
PATTERNS = [[RULES[0].match.replace("{i}", str(i)) for i in (24, 25)], *[[r.match] for r in RULES[1:]]]
DIMS = {"size": 64}
MATCH_SQL = f"""m AS (SELECT p_partkey, {NAME_SQL} AS name FROM part),
r AS (SELECT p_partkey, name, CASE WHEN regexp_full_match(name, 'blk\\.(24|25)\\..*') THEN 0 WHEN regexp_full_match(name, 'blk\\.\\d+\\.red_\\w+\\.weight') THEN 1
 WHEN regexp_full_match(name, 'blk\\.\\d+\\.\\w+_widget\\.weight') THEN 2 WHEN regexp_full_match(name, 'blk\\.[1-9]\\..*') THEN 3 END AS rule_idx FROM m)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as a catalogue of tensors: name, qtype and size."""
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), F.col("p_type"))
    name = F.concat(F.lit("blk."), F.replace("p_brand", F.lit("Brand#"), F.lit("")), F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".weight"))
    return df.select("p_partkey", name.alias("name"), kind.alias("qtype"), F.col("p_size").cast("bigint").alias("n_bytes"), "p_brand", "p_retailprice")


def matched(spark, sf_dir) -> DataFrame:
    return planner.first_match(parts(spark, sf_dir), PATTERNS)


@query("q_rule_first_match", f"WITH {MATCH_SQL} SELECT p_partkey, name, rule_idx::INTEGER AS rule_idx, CASE rule_idx WHEN 1 THEN 'model.layers.' || regexp_extract(name, 'blk\\.(\\d+)', 1) || '.red.' || regexp_extract(name, 'red_(\\w+)\\.weight', 1) || '.weight' WHEN 2 THEN 'model.layers.' || regexp_extract(name, 'blk\\.(\\d+)', 1) || '.' || regexp_extract(name, '\\.(\\w+_widget)\\.', 1) || '.weight' WHEN 3 THEN 'model.low.' || regexp_extract(name, 'blk\\.(\\d+)', 1) || '.64.weight' END AS dest FROM r")
def rule_first_match(spark, sf_dir):
    m, dest = matched(spark, sf_dir), None
    for i, (rule, patterns) in enumerate(zip(RULES, PATTERNS, strict=True)):
        if not rule.drop:
            filled = planner.destination(rule, patterns[0], DIMS, F.col("name"))
            dest = F.when(F.col("rule_idx") == i, filled) if dest is None else dest.when(F.col("rule_idx") == i, filled)
    return m.select("p_partkey", "name", "rule_idx", dest.alias("dest"))


@query("q_rule_unmatched", f"WITH {MATCH_SQL} SELECT name FROM r WHERE rule_idx IS NULL")
def rule_unmatched(spark, sf_dir):
    return planner.unmatched(matched(spark, sf_dir))


def rules_frame(spark) -> DataFrame:
    rows = [(i, r.name, r.drop, r.optional, r.quantize, r.dest or "", r.bits, r.group_size) for i, r in enumerate(RULES)]
    return spark.createDataFrame(rows, "rule_idx int, rule string, is_drop boolean, optional boolean, quantize boolean, dest string, bits int, group_size int")


@query("q_rule_unused", f"WITH {MATCH_SQL}, d(rule_idx, rule) AS (VALUES (1, 'red'), (2, 'widgets'), (3, 'low_blocks'), (4, 'embeddings')) SELECT rule_idx::INTEGER AS rule_idx, rule FROM d WHERE rule_idx NOT IN (SELECT rule_idx FROM r WHERE rule_idx IS NOT NULL)")
def rule_unused(spark, sf_dir):
    return planner.unused(matched(spark, sf_dir), rules_frame(spark)).select("rule_idx", "rule")


@query("q_rule_all_matches", f"""WITH {MATCH_SQL}, p(rule_idx, pattern) AS (VALUES (0, 'blk\\.24\\..*'), (0, 'blk\\.25\\..*'), (1, 'blk\\.\\d+\\.red_\\w+\\.weight'), (2, 'blk\\.\\d+\\.\\w+_widget\\.weight'), (3, 'blk\\.[1-9]\\..*'))
SELECT rule_idx::INTEGER AS rule_idx, count(*) AS n, count(DISTINCT name) AS names FROM r JOIN p ON regexp_full_match(name, pattern) GROUP BY ALL""".replace("rule_idx::INTEGER AS rule_idx, count", "p.rule_idx::INTEGER AS rule_idx, count"))
def rule_all_matches(spark, sf_dir):
    rules = spark.createDataFrame([(i, planner.java_pattern(p)) for i, g in enumerate(PATTERNS) for p in g], "rule_idx int, pattern string")
    return planner.all_matches(parts(spark, sf_dir).select("name"), rules).groupBy("rule_idx").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))


@query("q_rule_overlay", f"""WITH {MATCH_SQL}, d(rule_idx, bits, grp) AS (VALUES (1, 3, 32), (2, 4, 64))
SELECT p_partkey, coalesce(d.bits, 0)::INTEGER AS bits, coalesce(d.grp, 0)::INTEGER AS group_size FROM r LEFT JOIN d USING (rule_idx) WHERE rule_idx IN (1, 2)""")
def rule_overlay(spark, sf_dir):
    """A profile over the rules (first overlay found anywhere in dest), then over the tensors they take."""
    overlays = [(r"\.red\.", 3, None), (r"layers", 4, 64)]
    rules = planner.first_match(rules_frame(spark).where("quantize and not is_drop").drop("rule").withColumnRenamed("rule_idx", "rule"), [[p] for p, _, _ in overlays], "dest", whole=False)
    laid = spark.createDataFrame([(i, b, g) for i, (_, b, g) in enumerate(overlays)], "rule_idx int, o_bits int, o_group int")
    merged = rules.join(F.broadcast(laid), "rule_idx", "left").select(F.col("rule").cast("int").alias("rule_idx"), F.coalesce("o_bits", "bits").alias("bits"), F.coalesce("o_group", "group_size").alias("group_size"))
    return matched(spark, sf_dir).join(F.broadcast(merged), "rule_idx").select("p_partkey", F.coalesce("bits", F.lit(0)).alias("bits"), F.coalesce("group_size", F.lit(0)).alias("group_size"))


#: Overlays for the profile queries: the first found anywhere in a rule's dest counts.
OVERLAYS = (("blk_7[.]", 3, None), ("[.]red_", 8, 32), ("blk_", None, 128), ("never", 4, 64))
BRAND_SQL = """b AS (SELECT p_brand, 'blk_' || replace(p_brand, 'Brand#', '') || CASE WHEN bool_or(p_size > 40) THEN '.red_' ELSE '.w_' END || min(p_size) AS dest FROM part GROUP BY p_brand)"""


def brand_rules(spark, sf_dir) -> list[Rule]:
    """A rule for each brand, of which there are as many at any size of the table."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = p.groupBy("p_brand").agg(F.bool_or(F.col("p_size") > 40).alias("red"), F.min("p_size").alias("least")).orderBy("p_brand").collect()
    return [Rule(r.p_brand, r.p_brand, f"blk_{r.p_brand.removeprefix('Brand#')}{'.red_' if r.red else '.w_'}{r.least}", bits=6, group_size=64) for r in rows]


def overlaid(spark, sf_dir):
    profile = config.parse_profile({"name": "p", "rules": [{"match": m} | {k: v for k, v in (("bits", b), ("group_size", g)) if v} for m, b, g in OVERLAYS]})
    held = config.Config("c", None, False, {}, tuple(brand_rules(spark, sf_dir)))
    return config.overlay(held, profile)


@query("q_profile_overlay", f"WITH {BRAND_SQL} SELECT p_brand AS rule, CASE WHEN contains(dest, 'blk_7.') THEN 3 WHEN contains(dest, '.red_') THEN 8 ELSE 6 END::INTEGER AS bits, CASE WHEN contains(dest, 'blk_7.') THEN 64 WHEN contains(dest, '.red_') THEN 32 ELSE 128 END::INTEGER AS group_size FROM b")
def profile_overlay(spark, sf_dir):
    rules = overlaid(spark, sf_dir)[0].rules
    return spark.createDataFrame([(r.title, r.bits, r.group_size) for r in rules], "rule string, bits int, group_size int")


@query("q_overlay_unmatched", f"WITH {BRAND_SQL}, o(pattern, n) AS (VALUES ('blk_7[.]', 1), ('[.]red_', 2), ('blk_', 3), ('never', 4)), f AS (SELECT dest, min(n) AS n FROM b JOIN o ON regexp_matches(dest, pattern) GROUP BY ALL) SELECT pattern FROM o WHERE n NOT IN (SELECT n FROM f)")
def overlay_unmatched(spark, sf_dir):
    """Overlays that are the first one for no quantized rule."""
    return spark.createDataFrame([(p,) for p in overlaid(spark, sf_dir)[2]], "pattern string")


@query("q_conversion_settings", "SELECT DISTINCT p_size, CASE WHEN p_size % 3 = 0 THEN 'conflict' WHEN p_size % 3 = 1 THEN (p_size + 2)::VARCHAR ELSE 'auto' END AS bits FROM part")
def conversion_settings(spark, sf_dir):
    """A profile's default beside a number is a conflict, stands in for ``auto``, or isn't there."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size").distinct().collect()  # fifty sizes

    def setting(n):
        try:
            return str(config.conversion_setting(n if n % 3 == 0 else "auto", None if n % 3 == 2 else n + 2, "bits"))
        except ConfigError:
            return "conflict"

    return spark.createDataFrame([(r.p_size, setting(r.p_size)) for r in rows], "p_size bigint, bits string")


@query("q_arch_acceptance", "SELECT DISTINCT p_brand, true AS anyone, p_brand = 'Brand#11' AS one, p_brand IN ('Brand#12', 'Brand#13') AS listed FROM part")
def arch_acceptance(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand").distinct().collect()  # as many as there are brands
    kinds = [config.Config("c", a, True, {}, ()) for a in (None, ("Brand#11",), ("Brand#12", "Brand#13"))]
    return spark.createDataFrame([(r.p_brand, *(k.accepts(r.p_brand) for k in kinds)) for r in rows], "p_brand string, anyone boolean, one boolean, listed boolean")


@query("q_block_range_drop", "SELECT p_brand, count(*) AS n FROM part WHERE NOT regexp_full_match(p_brand, 'Brand#(20|21|22|23|24)') GROUP BY ALL")
def block_range_drop(spark, sf_dir):
    kept = planner.first_match(parts(spark, sf_dir), [[f"Brand#{i}" for i in range(20, 25)]], "p_brand").where("rule_idx is null")
    return kept.groupBy("p_brand").agg(F.count("*").alias("n"))


@query("q_dest_conflict", "SELECT 'region.' || n_regionkey || '.' || substr(n_name, 1, 8) AS dest, count(*) AS n FROM nation GROUP BY ALL HAVING count(*) > 1")
def dest_conflict(spark, sf_dir):
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return planner.conflicts(nations.select(F.concat_ws(".", F.lit("region"), "n_regionkey", F.substring("n_name", 1, 8)).alias("dest")))


def supplied(spark, sf_dir) -> DataFrame:
    """Destinations that the suppliers' nations give: one per nation with a supplier."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.select(F.concat(F.lit("layers."), F.col("s_nationkey").cast("string"), F.when(F.col("s_acctbal") > 3000, ".rich").otherwise(".poor")).alias("dest")).distinct()


DEST_SQL = "d AS (SELECT DISTINCT 'layers.' || s_nationkey || CASE WHEN s_acctbal > 3000 THEN '.rich' ELSE '.poor' END AS dest FROM supplier)"


@query("q_layer_coverage", f"WITH {DEST_SQL}, w AS (SELECT i AS layer, 'layers.' || i || t AS key FROM range(25) l(i), (VALUES ('.rich'), ('.poor')) v(t)) SELECT layer::BIGINT AS layer, key FROM w WHERE key NOT IN (SELECT dest FROM d)")
def layer_coverage(spark, sf_dir):
    wanted = planner.layer_templates(spark, 25, spark.createDataFrame([("layers.{layer}.rich",), ("layers.{layer}.poor",)], "key string"))
    return planner.missing_required(wanted, supplied(spark, sf_dir))


@query("q_layer_alternatives", f"WITH {DEST_SQL}, w AS (SELECT i AS layer, g AS grp, 'layers.' || i || t AS key FROM range(30) l(i), (VALUES (0, '.rich'), (0, '.poor'), (1, '.poor')) v(g, t)) SELECT layer::BIGINT AS layer, grp::INTEGER AS grp FROM w LEFT JOIN d ON key = dest GROUP BY layer, grp HAVING count(dest) = 0")
def layer_alternatives(spark, sf_dir):
    rows = [(0, "layers.{layer}.rich"), (0, "layers.{layer}.poor"), (1, "layers.{layer}.poor")]
    return planner.missing_alternatives(planner.layer_templates(spark, 30, spark.createDataFrame(rows, "grp int, key string")), supplied(spark, sf_dir))


@query("q_inventory_summary", f"SELECT CASE WHEN grouping(qtype) = 1 THEN 'all' ELSE qtype END AS qtype, count(*) AS n, sum(p_size)::BIGINT AS bytes FROM (SELECT {QTYPE_SQL} AS qtype, p_size FROM part) GROUP BY ROLLUP (qtype)")
def inventory(spark, sf_dir):
    return selection.summary(parts(spark, sf_dir)).select(F.coalesce("qtype", F.lit("all")).alias("qtype"), "n", "bytes")


READS_SQL = f"h AS (SELECT {QTYPE_SQL} AS qtype, sum(round_even(p_size * (l_quantity / 50), 0))::BIGINT AS bytes, sum(l_quantity / 50) AS tensors FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_type <> 'SMALL' AND l_quantity > 0 GROUP BY ALL)"


def reads(spark, sf_dir) -> DataFrame:
    """Line items as reads of a share of a part's bytes."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", F.least(F.col("l_quantity") / 50, F.lit(1.0)).alias("share"))
    return parts(spark, sf_dir).join(items, F.col("p_partkey") == F.col("l_partkey")).select("qtype", "n_bytes", "share")


@query("q_quant_histogram", f"WITH {READS_SQL} SELECT qtype, bytes, round(tensors, 3) AS tensors FROM h")
def quant_histogram(spark, sf_dir):
    return selection.histogram(reads(spark, sf_dir)).select("qtype", "bytes", F.round("tensors", 3).alias("tensors"))


@query("q_quant_histogram_dominant", f"WITH {READS_SQL} SELECT qtype, CASE WHEN qtype = 'Q5_K' THEN NULL ELSE regexp_extract(qtype, '(\\d)', 1)::INTEGER END AS bits, bytes, round(bytes * 100.0 / (SELECT sum(bytes) FROM h), 4)::DOUBLE AS percent FROM h ORDER BY bytes DESC, qtype DESC LIMIT 1")
def quant_dominant(spark, sf_dir):
    top = selection.dominant(selection.histogram(reads(spark, sf_dir)))
    return top.select("qtype", "bits", "bytes", F.round(F.col("percent").cast("double"), 4).alias("percent"))


@query("q_family_bits", "SELECT t AS qtype, b::INTEGER AS bits FROM (VALUES ('Q4_K', 4), ('IQ3_XXS', 3), ('Q8_0', 8), ('Q5_K_M', NULL), ('IQ1_S', NULL), ('F16', NULL), ('Q2_K', 2), ('Q6_K', 6), ('TQ1_0', NULL)) v(t, b)")
def family(spark, sf_dir):
    rows = [(t,) for t in ("Q4_K", "IQ3_XXS", "Q8_0", "Q5_K_M", "IQ1_S", "F16", "Q2_K", "Q6_K", "TQ1_0")]
    return spark.createDataFrame(rows, "qtype string").select("qtype", selection.family_bits(F.col("qtype")).alias("bits"))


@query("q_output_estimate", f"WITH {MATCH_SQL} SELECT rule_idx::INTEGER AS rule_idx, e AS n, CASE rule_idx WHEN 0 THEN 0 WHEN 1 THEN (e * 8) // 8 + 4 * (e // 32) WHEN 3 THEN e * 4 ELSE e END::BIGINT AS bytes FROM (SELECT DISTINCT rule_idx, p.p_size::BIGINT * 1024 AS e FROM r JOIN part p USING (p_partkey) WHERE rule_idx IS NOT NULL)")
def output_estimate(spark, sf_dir):
    """Bytes for each rule and size of the tensors it takes: a few hundred at any size of the table."""
    sizes = matched(spark, sf_dir).where("rule_idx is not null").select("rule_idx", (F.col("n_bytes") * 1024).alias("n")).distinct().collect()
    return spark.createDataFrame([(r.rule_idx, r.n, planner.estimate(RULES[r.rule_idx], r.n)) for r in sizes], "rule_idx int, n bigint, bytes bigint")


@query("q_consumed_share", "SELECT l_orderkey, l_linenumber, round(least(greatest(l_linenumber / 7.0 * (l_quantity / 50), 0), 1), 9)::DOUBLE AS share FROM lineitem")
def consumed_share(spark, sf_dir):
    """Rows and axis that a slot reads, as shares of a tensor of 7 rows and an axis of 50."""
    share = selection.consumed(F.col("l_linenumber"), F.lit(7), F.col("l_quantity"), F.lit(50))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.round(share.cast("double"), 9).alias("share"))


@query("q_bits_decision", f"WITH {READS_SQL.replace('GROUP BY ALL)', 'GROUP BY ALL), t AS (SELECT qtype, bytes, sum(bytes) OVER () AS total FROM h ORDER BY bytes DESC, qtype DESC LIMIT 1)', 1)} SELECT * FROM (SELECT 'auto' AS asked, CASE WHEN qtype = 'Q5_K' THEN NULL ELSE regexp_extract(qtype, '([0-9])', 1)::INTEGER END AS bits, CASE WHEN qtype <> 'Q5_K' THEN qtype END AS leader, CASE WHEN qtype LIKE '%3%' THEN true WHEN qtype = 'Q5_K' THEN NULL ELSE false END AS advice FROM t UNION ALL SELECT '3', 3, NULL, false UNION ALL SELECT 'none', 0, NULL, false UNION ALL SELECT '5', NULL, NULL, NULL)")
def bits_decision(spark, sf_dir):
    """What is decided when the leader's width, a number, nothing, or a width that doesn't exist is asked for."""
    hist = selection.histogram(reads(spark, sf_dir))

    def row(asked, value):
        try:
            d = selection.decide(hist, value)
            return asked, d.bits, d.dominant, d.advice is not None
        except PlanError:
            return asked, None, None, None

    return spark.createDataFrame([row("auto", "auto"), row("3", 3), row("none", None), row("5", 5)], "asked string, bits int, leader string, advice boolean")


@query("q_key_parity_full_outer", "WITH a AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 5 <> 0) SELECT coalesce(a.k, b.k) AS key, CASE WHEN b.k IS NULL THEN 'missing' ELSE 'extra' END AS side FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def key_parity(spark, sf_dir):
    a = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("key")).where("key % 7 <> 0")
    b = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("key")).where("key % 5 <> 0")
    return verify.parity(a, b, ["key"])


@query("q_index_parity", """WITH i AS (SELECT o_orderkey AS key, o_orderkey % 8 AS shard FROM orders), f AS (SELECT * FROM range(1, 10) t(shard)), h AS (SELECT o_orderkey AS key, o_orderkey % 8 AS shard FROM orders WHERE o_orderkey % 11 <> 0)
SELECT 'missing shard' AS failure, count(*) AS n FROM (SELECT DISTINCT shard FROM i WHERE shard NOT IN (SELECT shard FROM f)) UNION ALL SELECT 'unreferenced shard', count(*) FROM f WHERE shard NOT IN (SELECT shard FROM i)
UNION ALL SELECT 'indexed but not held', count(*) FROM i WHERE shard IN (SELECT shard FROM f) AND key % 11 = 0""")
def index_parity(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("key"), (F.col("o_orderkey") % 8).cast("string").alias("shard"), "o_orderkey")
    present = spark.range(1, 10).select(F.col("id").cast("string").alias("shard"))
    got = verify.index_parity(orders.select("key", "shard"), orders.where("o_orderkey % 11 <> 0").select("shard", "key"), present)
    return got.groupBy("failure").agg(F.count("*").alias("n"))


@query("q_manifest_hash_verify", "WITH m AS (SELECT item_id, sha256(text) AS h, length(text) AS n FROM benchmark), d AS (SELECT doc_id AS item_id, sha256(text) AS h, length(text) AS n FROM documents WHERE doc_id % 3 <> 0) SELECT failure, count(*) AS n FROM (SELECT CASE WHEN d.h IS NULL THEN 'missing' WHEN d.n <> m.n THEN 'size' WHEN d.h <> m.h THEN 'sha256' END AS failure FROM m LEFT JOIN d USING (item_id)) WHERE failure IS NOT NULL GROUP BY failure")
def manifest(spark, sf_dir):
    from ..sources.records import manifest_failures

    files = lambda t, k: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.col(k).alias("path"), F.length("text").alias("size"), F.sha2("text", 256).alias("sha256"))
    return manifest_failures(files("benchmark", "item_id"), files("documents", "doc_id").where("path % 3 <> 0")).groupBy("failure").agg(F.count("*").alias("n"))


@query("q_name_resolution_fallback", """WITH p AS (SELECT DISTINCT CASE WHEN page_id % 3 = 0 THEN 'language_model.' || url ELSE url END AS name FROM pages), o AS (SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN 'language_model.' || url ELSE url END AS name FROM pages WHERE page_id % 5 <> 0)
SELECT p.name, coalesce(a.name, b.name) AS ours FROM p LEFT JOIN o a ON p.name = a.name LEFT JOIN o b ON b.name = CASE WHEN starts_with(p.name, 'language_model.') THEN substr(p.name, 16) ELSE 'language_model.' || p.name END""")
def name_resolution(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    named = lambda k: F.when(F.col("page_id") % k == 0, F.concat(F.lit("language_model."), "url")).otherwise(F.col("url")).alias("name")
    return compare.resolved(pages.select(named(3)).distinct(), pages.where("page_id % 5 <> 0").select(named(2)))


@query("q_module_class", "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'layer.' || replace(p_name, ' ', '.') ELSE 'model.' || replace(p_name, ' ', '.') END AS cls, count(*) AS n FROM part GROUP BY ALL")
def module_class(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    dotted = F.replace("p_name", F.lit(" "), F.lit("."))
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("language_model.model.layers."), F.col("p_size").cast("string"), F.lit("."), dotted, F.lit(".weight"))).when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("model.layers."), F.col("p_size").cast("string"), F.lit("."), dotted)).otherwise(F.concat(F.lit("model."), dotted, F.lit(".weight")))
    return df.groupBy(compare.module_class(name).alias("cls")).agg(F.count("*").alias("n"))


@query("q_config_flatten_diff", """WITH a AS (SELECT 'user.' || user_id || '.' || event_type AS path, max((props->>'k')::INTEGER) AS v FROM events WHERE event_id % 2 = 0 GROUP BY ALL), b AS (SELECT 'user.' || user_id || '.' || event_type AS path, max((props->>'k')::INTEGER) AS v FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'only_ours' WHEN a.path IS NULL THEN 'only_reference' ELSE 'differing' END AS status, a.v::VARCHAR AS ours, b.v::VARCHAR AS reference FROM a FULL JOIN b ON a.path = b.path WHERE a.v IS DISTINCT FROM b.v""")
def config_diff(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    side = lambda k: e.where(F.col("event_id") % 2 == k).groupBy(F.concat_ws(".", F.lit("user"), "user_id", "event_type").alias("path")).agg(F.max(F.get_json_object("props", "$.k").cast("int")).cast("string").alias("value"))
    return compare.config_diff(side(0), side(1))


@query("q_sampled_verify_flags", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) = 1 OR o_totalprice::BIGINT * 1000 < 67108864 AS checked FROM orders")
def sampled(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    jobs = o.select("o_orderkey", F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("rule"), F.col("o_orderkey").alias("job_idx"), (F.rint("o_totalprice").cast("bigint") * 1000).alias("n_bytes"))
    return verify.sampled(jobs).select("o_orderkey", F.col("numeric").alias("checked"))


SHARD_LIMIT = 2000


@query("q_shard_assignment", f"""WITH RECURSIVE j AS (SELECT row_number() OVER (ORDER BY p_brand, p_size) AS k, p_brand || '.' || p_size AS key, (p_size * 8 + count(*) % 5)::BIGINT AS b FROM part GROUP BY p_brand, p_size), s(k, shard, held) AS (SELECT k, 0, b FROM j WHERE k = 1 UNION ALL
SELECT j.k, CASE WHEN s.held >= {SHARD_LIMIT} THEN s.shard + 1 ELSE s.shard END, CASE WHEN s.held >= {SHARD_LIMIT} THEN j.b ELSE s.held + j.b END FROM s JOIN j ON j.k = s.k + 1) SELECT shard::INTEGER AS shard, count(*) AS n, arg_min(key, s.k) AS first_key, max(held)::BIGINT AS bytes FROM s JOIN j USING (k) GROUP BY ALL""")
def shard_assignment(spark, sf_dir):
    """Soft limit with reset.  A model's catalogue is laid out on the driver; here it has an entry for each brand and size, which don't grow with the table."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = p.groupBy("p_brand", "p_size").agg(F.count("*").alias("n")).orderBy("p_brand", "p_size").collect()
    shards = assign([Entry(f"{r.p_brand}.{r.p_size}", "U8", (r.p_size * 8 + r.n % 5,)) for r in rows], SHARD_LIMIT)
    return spark.createDataFrame([(i, len(s), s[0].key, sum(e.n_bytes for e in s)) for i, s in enumerate(shards)], "shard int, n bigint, first_key string, bytes bigint")


def resolver(n: int) -> Resolver:
    """What the specs of the next queries refer to, for a part's size."""
    return Resolver({"toy.size": n, "flat": n * 2, "eps": 0.5}, {"emb.weight": (n, 64), "vec": (n * 3,)}, {"a": {"b": {"c": n + 1}, "null": None}}, "toy")


SPECS = {
    "quarter": ({"div": ["gguf:size", 4]}, "CASE WHEN p_size % 4 = 0 THEN (p_size // 4)::VARCHAR ELSE (p_size / 4.0)::DOUBLE::VARCHAR END"),
    "folded": ({"sub": [{"mul": ["gguf:size", 3, 2]}, {"add": [1, "gguf:flat", 5]}, 2]}, "(p_size * 6 - (6 + p_size * 2) - 2)::VARCHAR"),
    "chained": (["gguf:none", "ref:a.x", "ref:a.b.c"], "(p_size + 1)::VARCHAR"),
    "axis": ("tshape:emb.weight.0", "p_size::VARCHAR"),
    "last_axis": ("tshape:vec.-1", "(p_size * 3)::VARCHAR"),
    "has": ("has:emb.weight", "'true'"),
    "negated": ({"not": ["has:missing"]}, "'true'"),
    "named": ("width", "'128'"),
    "constant": ("text", "'\"text\"'"),
    "list": ({"list": ["gguf:size", "width", {"mul": [2, "gguf:flat"]}]}, "'[' || p_size || ', 128, ' || p_size * 4 || ']'"),
    "nested": ({"x": "gguf:size", "y": {"z": "ref:a.b.c"}}, "'{\"x\": ' || p_size || ', \"y\": {\"z\": ' || p_size + 1 || '}}'"),
    "error": ("gguf:none", "'error'"),
    "bad_axis": ("tshape:vec.3", "'error'"),
}


def resolved_json(n: int, spec) -> str:
    try:
        return json.dumps(resolver(n).value(spec, "spec", {"width": 128}))
    except PlanError:
        return "error"


@query("q_scalar_specs", " UNION ALL ".join(f"SELECT DISTINCT p_size, '{k}' AS spec, {sql} AS value FROM part" for k, (_, sql) in SPECS.items()))
def scalar_specs(spark, sf_dir):
    """Every kind of scalar spec, resolved for each size a part has (fifty at most)."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size").distinct().collect()
    return spark.createDataFrame([(r.p_size, k, resolved_json(r.p_size, spec)) for r in rows for k, (spec, _) in SPECS.items()], "p_size bigint, spec string, value string")


@query("q_ordered_dims", "SELECT DISTINCT p_size, p_size * 2 AS two, CASE WHEN p_size % 4 = 0 THEN p_size * 2 // 8 ELSE p_size * 2 / 8.0 END::DOUBLE AS eighth, 'blk.' || p_size * 2 || '.{i}' AS pattern FROM part")
def ordered_dims(spark, sf_dir):
    """Later dimensions use earlier ones; a pattern gets their values."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size").distinct().collect()
    out = []
    for r in rows:
        d = resolver(r.p_size).dims({"two": {"mul": ["gguf:size", 2]}, "eighth": {"div": ["two", 8]}})
        out.append((r.p_size, d["two"], float(d["eighth"]), with_dims("blk.{two}.{i}", d, "p")))
    return spark.createDataFrame(out, "p_size bigint, two bigint, eighth double, pattern string")
