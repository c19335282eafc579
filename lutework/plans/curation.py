"""Corpus curation queries: joins, set operations, filters, splits and patches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import curation
from .adapters import NOTES, notes, table
from .registry import Registry

REGISTRY = query = Registry()


@query("""WITH p AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_quantity > 40 THEN 'direct' END AS direct, CASE WHEN l_discount > 0.05 THEN 'single' END AS single, CASE WHEN l_tax > 0.04 THEN 'guq' END AS guq, 'base' AS base FROM lineitem)
SELECT coalesce(direct, single, guq, base) AS stage, count(*) AS n FROM p GROUP BY 1""")
def p1_stage_precedence(spark, sf_dir):
    """The final actions come from the first stage that has any."""
    x = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_quantity") > 40, "direct").alias("direct"), F.when(F.col("l_discount") > 0.05, "single").alias("single"), F.when(F.col("l_tax") > 0.04, "guq").alias("guq"), F.lit("base").alias("base")
    )
    return x.groupBy(curation.coalesced_stages(["direct", "single", "guq", "base"]).alias("stage")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0 UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def p6_p7_blacklist(spark, sf_dir):
    """Rows whose key is on none of several lists."""
    c = table(spark, sf_dir, "customer")
    bad = c.where("c_acctbal < 0").select("c_custkey").unionByName(c.where("c_mktsegment = 'BUILDING'").select("c_custkey")).distinct()
    return table(spark, sf_dir, "orders").join(bad, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey")


@query("""SELECT l_orderkey AS score, count(*) AS parseable, count(*) FILTER (l_discount <= 0.05) AS matched FROM lineitem GROUP BY 1 HAVING count(*) > 0 AND (count(*) FILTER (l_discount <= 0.05) >= 2 OR 2 * count(*) FILTER (l_discount <= 0.05) >= count(*))""")
def p8_p11_eligibility(spark, sf_dir):
    """Scores of which enough is matched."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("score")).agg(F.count("*").alias("parseable"), F.count_if(F.col("l_discount") <= 0.05).alias("matched"))
    return s.where("parseable > 0 AND (matched >= 2 OR 2 * matched >= parseable)")


@query("""WITH a AS (SELECT o_custkey AS score, o_orderkey AS phrase, o_orderdate AS s FROM orders), c AS (SELECT c_custkey AS score, CASE WHEN c_acctbal < 0 THEN TIMESTAMP '1900-01-01' WHEN c_acctbal < 3000 THEN TIMESTAMP '1995-01-01' END AS cutoff FROM customer)
SELECT phrase, CASE WHEN cutoff IS NULL THEN 'keep' WHEN cutoff < TIMESTAMP '1950-01-01' THEN 'drop_score' WHEN s > cutoff THEN 'drop_phrase' ELSE 'replace' END AS verdict FROM a JOIN c USING (score)""")
def p10_apply_audit(spark, sf_dir):
    """P10: what an audit's cutoffs do to each phrase."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.expr("CASE WHEN c_acctbal < 0 THEN TIMESTAMP '1900-01-01' WHEN c_acctbal < 3000 THEN TIMESTAMP '1995-01-01' END").alias("cutoff"))
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    verdict = F.when(F.col("cutoff").isNull(), "keep").when(F.col("cutoff") < F.lit("1950-01-01").cast("timestamp"), "drop_score").when(F.col("o_orderdate") > F.col("cutoff"), "drop_phrase").otherwise("replace")
    return o.select(F.col("o_orderkey").alias("phrase"), verdict.alias("verdict"))


@query("""WITH t AS (SELECT s_suppkey, list_transform(range(1, 8), lambda i: 48 + 2 * i + (s_suppkey * i) % 3) AS o FROM supplier)
SELECT s_suppkey, len(list_filter(range(1, 7), lambda i: o[i + 1] <= o[i]))::BIGINT AS descending, list_max(list_transform(range(1, 7), lambda i: o[i + 1] - o[i]))::BIGINT AS widest, o[1] BETWEEN 48 AND 51 AS low_ok, o = [50, 52, 54, 56, 58, 60, 62] AS in_catalog FROM t""")
def p12_p14_tuning_audit(spark, sf_dir):
    """A tuning's order, gaps, range and whether the catalogue has it."""
    t = table(spark, sf_dir, "supplier").select("s_suppkey", F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: 48 + 2 * i + (F.col("s_suppkey") * i) % 3).alias("o"))
    gaps = F.zip_with(F.slice("o", 2, 6), F.slice("o", 1, 6), lambda b, a: b - a)
    catalog = F.array(*[F.lit(x) for x in (50, 52, 54, 56, 58, 60, 62)])
    known = F.forall(F.zip_with("o", catalog, lambda a, b: F.abs(a - b) < 0.01), lambda x: x)
    return t.select(
        "s_suppkey", F.size(F.filter(gaps, lambda g: g <= 0)).cast("long").alias("descending"), F.array_max(gaps).cast("long").alias("widest"), F.get("o", 0).between(48, 51).alias("low_ok"), known.alias("in_catalog")
    )


@query("""SELECT count(*) AS matched, (SELECT count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)) AS only_left FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""")
def j1_matched_pairs(spark, sf_dir):
    """Matched keys and those without a partner."""
    keys = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    o = table(spark, sf_dir, "orders").join(keys, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.agg(F.count("l_orderkey").alias("matched"), F.count_if(F.col("l_orderkey").isNull()).alias("only_left"))


@query("""SELECT o_orderkey, coalesce(l.l_returnflag, '') AS predicted, coalesce(c.c_mktsegment, '') AS reference FROM orders LEFT JOIN (SELECT l_orderkey, max(l_returnflag) AS l_returnflag FROM lineitem WHERE l_linenumber = 7 GROUP BY 1) l ON l_orderkey = o_orderkey
LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_custkey""")
def j2_two_sided_left(spark, sf_dir):
    """Both sides of a row looked up, nothing as an empty text."""
    p = table(spark, sf_dir, "lineitem").where("l_linenumber = 7").groupBy("l_orderkey").agg(F.max("l_returnflag").alias("p"))
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    o = table(spark, sf_dir, "orders").join(p, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.select("o_orderkey", F.coalesce("p", F.lit("")).alias("predicted"), F.coalesce("c_mktsegment", F.lit("")).alias("reference"))


@query("""WITH a AS (SELECT l_suppkey AS p, l_linenumber AS e, avg(l_discount) AS x FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2), b AS (SELECT l_suppkey AS p, l_linenumber AS e, avg(l_discount) AS x FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2)
SELECT count(*) AS common, round(avg(a.x), 6) AS arm_a, round(avg(b.x), 6) AS arm_b FROM a JOIN b USING (p, e)""")
def j4_common_events(spark, sf_dir):
    """Two arms over the events that both have."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber", "l_linestatus").agg(F.avg("l_discount").alias("x"))
    a, b = l.where("l_linestatus = 'F'").drop("l_linestatus"), l.where("l_linestatus = 'O'").drop("l_linestatus").withColumnRenamed("x", "y")
    return a.join(b, ["l_suppkey", "l_linenumber"]).agg(F.count("*").alias("common"), F.round(F.avg("x"), 6).alias("arm_a"), F.round(F.avg("y"), 6).alias("arm_b"))


@query("""SELECT c_nationkey AS family, count(DISTINCT c_mktsegment) AS n_splits, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS splits FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1""")
def j18_leaks(spark, sf_dir):
    """Families in more than one split."""
    found = curation.leaking(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")
    return found.select(F.col("c_nationkey").alias("family"), "n_splits", F.array_join("splits", ",").alias("splits"))


@query("""WITH u AS (SELECT c_custkey, c_nationkey, ('0x' || substr(sha256('5:' || c_nationkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM customer)
SELECT CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'dev' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT c_nationkey) AS n_families FROM u GROUP BY 1""")
def k5_c2_split(spark, sf_dir):
    """A split of whole families."""
    rows = curation.hashed_split(table(spark, sf_dir, "customer"), "c_nationkey", {"train": 8, "dev": 1, "test": 1}, 5)
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("c_nationkey").alias("n_families"))


@query("""WITH s AS (SELECT c_nationkey AS k, count(*) AS w FROM customer GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY w DESC, k) - 1 AS r FROM s)
SELECT CASE WHEN (r // 4) % 2 = 0 THEN r % 4 ELSE 3 - r % 4 END::INT AS shard, sum(w)::BIGINT AS weight, count(*) AS n_keys FROM r GROUP BY 1""")
def k4_shards(spark, sf_dir):
    """K4: whole keys in balanced shards."""
    s = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("w"))
    return curation.balanced_shards(s, "k", "w", 4).groupBy("shard").agg(F.sum("w").alias("weight"), F.count("*").alias("n_keys"))


@query("""SELECT count(*) AS n, count(*) FILTER (src = 0) AS from_first FROM (SELECT k, min(src) AS src FROM (SELECT l_orderkey AS k, 0 AS src FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT o_orderkey, 1 FROM orders) GROUP BY k)""")
def u1_first_wins(spark, sf_dir):
    """A union of shards in which the first one's row stays."""
    a = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.lit(0).alias("src"))
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("src"))
    return curation.first_wins([a, b], ["k"]).agg(F.count("*").alias("n"), F.count_if(F.col("src") == 0).alias("from_first"))


@query("""SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1""")
def u2_u8_checked_union(spark, sf_dir):
    """Parts that must be disjoint, put together again."""
    o = table(spark, sf_dir, "orders")
    parts = [o.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")] + [o.where(~F.col("o_orderstatus").isin("F", "O", "P"))]
    return curation.checked_union(parts, "o_orderkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("""SELECT 'both' AS part, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'missing', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)""")
def u3_u4_intersect_except(spark, sf_dir):
    """Keys in both tables, and keys without a row."""
    o, c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer")
    both = o.intersect(c.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))).agg(F.lit("both").alias("part"), F.count("*").alias("n"))
    return both.unionByName(c.select(F.col("c_custkey").alias("k")).subtract(o).agg(F.lit("missing").alias("part"), F.count("*").alias("n")))


@query("""WITH ch AS (SELECT o_orderkey, o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderpriority = '2-HIGH' UNION ALL SELECT -p_partkey, 'N', 1.0 FROM part),
u AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ch) UNION ALL SELECT * FROM ch) SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM u WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50) GROUP BY 1""")
def u9_upsert(spark, sf_dir):
    """Replace or append, with exclusions."""
    o = table(spark, sf_dir, "orders")
    base = o.select("o_orderkey", "o_orderstatus", "o_totalprice")
    changes = o.where("o_orderpriority = '2-HIGH'").select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    changes = changes.unionByName(table(spark, sf_dir, "part").select((-F.col("p_partkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice")))
    excluded = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return curation.upsert(base, changes, ["o_orderkey"], excluded).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH p AS (SELECT user_id, event_type AS field, event_id, round(value, 3) AS v FROM events) SELECT user_id, field, arg_max(v, event_id) AS value FROM p GROUP BY 1, 2""")
def f5_f7_last_targets(spark, sf_dir):
    """F5, F7 and F-map: what each field is after all patches, the last write winning."""
    p = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("field"), "event_id", F.round("value", 3).alias("value"))
    return curation.last_targets(p, ["user_id"], "event_id").select("user_id", "field", "value")


@query("""WITH a AS (SELECT c_custkey AS k, c_mktsegment AS segment, c_nationkey AS nation FROM customer), b AS (SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS segment, CASE WHEN c_acctbal > 9000 THEN 0 ELSE c_nationkey END AS nation FROM customer)
SELECT k, 'segment' AS field, a.segment AS before, b.segment AS after FROM a JOIN b USING (k) WHERE a.segment IS DISTINCT FROM b.segment UNION ALL SELECT k, 'nation', a.nation::VARCHAR, b.nation::VARCHAR FROM a JOIN b USING (k) WHERE a.nation IS DISTINCT FROM b.nation""")
def f6_minimal_patches(spark, sf_dir):
    """The fields in which two versions differ."""
    c = table(spark, sf_dir, "customer")
    a = c.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    b = c.select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_acctbal") > 9000, F.lit(0)).otherwise(F.col("c_nationkey")).alias("nation"))
    return curation.minimal_patches(a, b, "k", ["segment", "nation"])


@query("""WITH p AS (SELECT o_custkey AS g, o_orderkey AS k, o_orderstatus AS value FROM orders), e AS (SELECT o_custkey AS g, o_orderkey AS k, CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS expected, 'Z' AS new FROM orders WHERE o_orderpriority = '1-URGENT'),
ok AS (SELECT g FROM e JOIN p USING (g, k) GROUP BY g HAVING bool_and(expected = value)) SELECT g, k, CASE WHEN e.new IS NOT NULL AND g IN (SELECT g FROM ok) THEN e.new ELSE value END AS value FROM p LEFT JOIN e USING (g, k)""")
def f8_plan_edits(spark, sf_dir):
    """F8: a plan's edits apply only together."""
    o = table(spark, sf_dir, "orders")
    plan = o.select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("value"))
    edits = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("k"), F.when(F.col("o_totalprice") > 400000, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("expected"), F.lit("Z").alias("new"))
    return curation.applied_edits(plan, edits, "g", "k")


@query("""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, sum((role IS DISTINCT FROM prev OR n = 1)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations))
SELECT conv_id, position::BIGINT AS position, any_value(role) AS role, sha256(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM t GROUP BY conv_id, position""")
def c9_merged_turns(spark, sf_dir):
    """Messages flattened, neighbours of one role merged and hashed."""
    found = curation.merged_turns(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")
    return found.select("conv_id", "position", "role", F.sha2("text", 256).alias("digest"))


@query("""WITH o AS (SELECT user_id, event_id, event_type, ts, max(CASE WHEN event_type = 'signup' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS marker FROM events)
SELECT user_id, count(*) FILTER (marker IS NOT NULL AND event_type = 'error') AS repeated, count(*) AS n FROM o GROUP BY user_id""")
def w9_after_marker(spark, sf_dir):
    """Rows of one kind that a marker stands before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    marker = F.last(F.when(F.col("event_type") == "signup", F.col("ts")), ignorenulls=True).over(w)
    rows = table(spark, sf_dir, "events").withColumn("marker", marker)
    return rows.groupBy("user_id").agg(F.count_if(F.col("marker").isNotNull() & (F.col("event_type") == "error")).alias("repeated"), F.count("*").alias("n"))
