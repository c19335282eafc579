"""Ordered analytics, joins and top-k queries over notes and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ordered
from .adapters import NOTES, notes, table
from .registry import Registry

REGISTRY = query = Registry()
BY_SCORE = ["score"]


@query(f"WITH {NOTES} SELECT score, idx, CASE WHEN NOT structural THEN sum((NOT structural)::INT) OVER (PARTITION BY score ORDER BY idx) - 1 END::BIGINT AS event_index FROM notes")
def w1_event_ordinals(spark, sf_dir):
    """Dense ordinals that skip structural rows."""
    return ordered.event_ordinals(notes(spark, sf_dir), BY_SCORE, ["idx"], F.col("structural")).select("score", "idx", "event_index")


@query(f"WITH {NOTES} SELECT score, flag, coalesce(min(idx), -1)::INT AS phrase_order, row_number() OVER (PARTITION BY score ORDER BY min(idx))::INT AS phrase_rank FROM notes GROUP BY score, flag")
def w2_phrase_order(spark, sf_dir):
    """The order of phrases by their first note."""
    first = notes(spark, sf_dir).groupBy("score", "flag").agg(F.coalesce(F.min("idx"), F.lit(-1)).alias("phrase_order"))
    return first.withColumn("phrase_rank", F.row_number().over(Window.partitionBy("score").orderBy("phrase_order")))


@query(f"WITH {NOTES} SELECT score, idx FROM (SELECT *, lag(midi) OVER (PARTITION BY score ORDER BY idx) AS before FROM notes WHERE NOT structural) WHERE before = midi")
def w4_reattacks(spark, sf_dir):
    """Notes that repeat the pitch of the note before, bars left out."""
    w = Window.partitionBy("score").orderBy("idx")
    return notes(spark, sf_dir).where("NOT structural").withColumn("before", F.lag("midi").over(w)).where("before = midi").select("score", "idx")


_RUNS = """r AS (SELECT user_id, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)"""


@query(f"WITH {_RUNS} SELECT user_id, event_type AS value, min(ts) AS start, max(ts) AS stop, count(*) AS length FROM r GROUP BY user_id, event_type, g")
def w5_w8_runs(spark, sf_dir):
    """Runs of equal values, first and last place and length."""
    return ordered.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type"))


@query("""WITH t AS (SELECT user_id, value < 20 AS blank, min((value < 20)::INT) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS tail FROM events),
s AS (SELECT user_id, count(*) AS n_rows, count(*) FILTER (blank) AS n_blank, sum(tail)::BIGINT AS trailing_blank FROM t GROUP BY user_id)
SELECT *, CASE WHEN (n_rows - n_blank) / n_rows < 0.5 THEN 'drop' WHEN trailing_blank >= 2 THEN 'trim' ELSE 'keep' END AS verdict FROM s""")
def w6_p9_coverage(spark, sf_dir):
    """Trailing blanks, and dropping, trimming or keeping by coverage."""
    found = ordered.trailing_run(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") < 20)
    share = (F.col("n_rows") - F.col("n_blank")) / F.col("n_rows")
    return found.withColumn("verdict", F.when(share < 0.5, "drop").when(F.col("trailing_blank") >= 2, "trim").otherwise("keep"))


@query(f"""WITH {NOTES} SELECT score, idx FROM (SELECT *, lead(d = 0, 1) OVER w AND lead(d = 0, 2) OVER w AS b FROM notes WHERE NOT structural WINDOW w AS (PARTITION BY score ORDER BY idx)) WHERE b AND d > 0""")
def w7_attack_then_blanks(spark, sf_dir):
    """An attack that two blanks follow, structural rows left out before."""
    w = Window.partitionBy("score").orderBy("idx")
    rows = notes(spark, sf_dir).where("NOT structural")
    return rows.withColumn("b", (F.lead("d", 1).over(w) == 0) & (F.lead("d", 2).over(w) == 0)).where("b AND d > 0").select("score", "idx")


@query("""SELECT user_id, event_id, last_value(CASE WHEN event_type IN ('purchase', 'signup') THEN event_type END IGNORE NULLS) OVER w AS section,
  coalesce(last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_type END IGNORE NULLS) OVER w = 'signup', false) AS in_scope FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def w9_w10_scopes(spark, sf_dir):
    """Sections filled forward, and the scope that the last marker leaves open."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = lambda *names: F.when(F.col("event_type").isin(*names), F.col("event_type"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", ordered.filled_forward(kind("purchase", "signup"), w).alias("section"), ordered.scope_open(kind("signup", "error"), "signup", w).alias("in_scope"))


@query("""WITH p AS (SELECT o_custkey AS score, o_orderkey AS phrase, o_orderdate AS day, o_orderstatus AS exit FROM orders)
SELECT score, phrase, lag(phrase) OVER w AS previous, lead(phrase) OVER w AS next, lag(exit) OVER w AS entry FROM p WINDOW w AS (PARTITION BY score ORDER BY day, phrase)""")
def w13_handoffs(spark, sf_dir):
    """Neighbours of a phrase and the state that it takes over."""
    w = Window.partitionBy("score").orderBy("at", "phrase")
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("score"), F.col("o_orderkey").alias("phrase"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("exit"))
    return p.select("score", "phrase", F.lag("phrase").over(w).alias("previous"), F.lead("phrase").over(w).alias("next"), F.lag("exit").over(w).alias("entry"))


@query("""WITH v AS (SELECT c_mktsegment AS pool, c_custkey AS k, c_acctbal AS x, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) - 1 AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
c AS (SELECT pool, max(x) FILTER (r = n // 3) AS a, max(x) FILTER (r = 2 * n // 3) AS b FROM v GROUP BY pool) SELECT pool, k, CASE WHEN x < a THEN 0 WHEN x < b THEN 1 ELSE 2 END AS tercile FROM v JOIN c USING (pool)""")
def w16_terciles(spark, sf_dir):
    """Terciles by the values at a third and two thirds of the pool."""
    w = Window.partitionBy("pool").orderBy("x", "k")
    v = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("pool"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"))
    r = v.withColumn("r", F.row_number().over(w) - 1).join(v.groupBy("pool").agg(F.count("*").alias("n")), "pool")
    cut = lambda m: F.max(F.when(F.col("r") == F.floor(m * F.col("n") / 3), F.col("x")))
    cuts = r.groupBy("pool").agg(cut(1).alias("a"), cut(2).alias("b"))
    return v.join(cuts, "pool").select("pool", "k", F.when(F.col("x") < F.col("a"), 0).when(F.col("x") < F.col("b"), 1).otherwise(2).alias("tercile"))


@query("""SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM events""")
def j9_j10_nearest_anchor(spark, sf_dir):
    """The nearest earlier anchor of each row, an as-of lookup by one window."""
    anchor = ordered.nearest_before(None, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", anchor.alias("anchor"))


@query("""WITH s AS (SELECT l_suppkey AS prog, avg(l_discount) AS a, avg(l_tax) AS b FROM lineitem GROUP BY 1), r AS (SELECT prog, round(a, 9) AS a, round(b, 9) AS b FROM s)
SELECT prog, a, b FROM r x WHERE NOT EXISTS (SELECT 1 FROM r y WHERE y.a >= x.a AND y.b >= x.b AND (y.a > x.a OR y.b > x.b))""")
def k11_two_objectives(spark, sf_dir):
    """Candidates that no other one dominates in two objectives, by a running maximum and not by pairs."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("prog")).agg(F.round(F.avg("l_discount"), 9).alias("a"), F.round(F.avg("l_tax"), 9).alias("b"))
    return ordered.undominated_pairs(s, "a", "b").select("prog", "a", "b")


@query("""WITH s AS (SELECT o_orderpriority AS arm, o_custkey AS id, avg(o_totalprice) AS score FROM orders GROUP BY 1, 2), b AS (SELECT id, score AS base FROM s WHERE arm = '1-URGENT')
SELECT arm, id, round(score - base, 4) AS gain FROM s JOIN b USING (id) WHERE arm <> '1-URGENT' AND score > base QUALIFY row_number() OVER (PARTITION BY arm ORDER BY score - base DESC, id) <= 5""")
def k14_k15_improvements(spark, sf_dir):
    """The five greatest improvements of each arm over the baseline arm."""
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("arm"), F.col("o_custkey").alias("id")).agg(F.avg("o_totalprice").alias("score"))
    base = s.where("arm = '1-URGENT'").select("id", F.col("score").alias("base"))
    gains = s.where("arm <> '1-URGENT'").join(base, "id").withColumn("gain", F.col("score") - F.col("base")).where("gain > 0")
    return ordered.top_k(gains, ["arm"], [F.desc("gain"), F.col("id")], 5).select("arm", "id", F.round("gain", 4).alias("gain"))


@query("""SELECT c_mktsegment AS stratum, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('11:' || c_custkey), c_custkey) <= 20""")
def k7_k8_seeded_quota(spark, sf_dir):
    """K7 and K8: a quota of each stratum in the order of a seeded hash."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("stratum"), "c_custkey")
    order = [F.sha2(F.concat(F.lit("11:"), F.col("c_custkey").cast("string")), 256), F.col("c_custkey")]
    return ordered.top_k(rows, ["stratum"], order, 20).drop("rank")


@query("""SELECT part_name AS name, p_partkey FROM (SELECT p_name AS part_name, p_partkey, p_brand FROM part) QUALIFY row_number() OVER (PARTITION BY part_name ORDER BY p_brand, p_partkey) = 1""")
def k9_u1_first_category(spark, sf_dir):
    """Of rows with one key the one of the first category."""
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), "p_brand", "p_partkey")
    return rows.groupBy("name").agg(F.min_by("p_partkey", F.struct("p_brand", "p_partkey")).alias("p_partkey"))


@query("""WITH RECURSIVE up AS (SELECT p_partkey AS c, p_partkey // 2 AS a FROM part WHERE p_partkey > 1 UNION ALL SELECT c, a // 2 FROM up WHERE a > 1)
SELECT c, count(*) AS n_ancestors, sum(a)::BIGINT AS ancestor_sum FROM up GROUP BY c""")
def j15_ancestors(spark, sf_dir):
    """All ancestors of every candidate in a lineage, by doubled self-joins."""
    part = table(spark, sf_dir, "part").where("p_partkey > 1").groupBy(F.col("p_partkey").cast("long").alias("c"), F.col("p_partkey").alias("key")).agg(F.count("*").alias("times"))
    # the lineage holds the ancestors that are no candidates, too: a number has fewer than 63
    nodes = part.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda k: F.call_function("shiftright", F.col("c"), k))).alias("node"))
    lineage = nodes.where("node > 1").distinct().select("node", F.expr("node DIV 2").alias("up"))
    found = part.join(ordered.ancestor_sums(lineage), F.col("c") == F.col("node"))
    return found.select(F.col("key").alias("c"), (F.col("times") * F.col("n_ancestors")).alias("n_ancestors"), (F.col("times") * F.col("ancestor_sum")).alias("ancestor_sum"))


@query("WITH e AS (SELECT user_id, event_id, ts, min((value < 90)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ok FROM events) SELECT user_id, count(*) AS kept, max(event_id) AS last_event FROM e WHERE ok = 1 GROUP BY user_id")
def w3_valid_prefix(spark, sf_dir):
    """The contiguous valid prefix of each sequence."""
    kept = ordered.valid_prefix(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") < 90)
    return kept.groupBy("user_id").agg(F.count("*").alias("kept"), F.max("event_id").alias("last_event"))


@query(f"""WITH {_RUNS}, n AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type, g ORDER BY ts, event_id) AS k FROM r) SELECT user_id, event_id, event_type FROM n WHERE k = 3""")
def w11_consecutive(spark, sf_dir):
    """The third event of a run of equal ones, once a run."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = (~F.col("event_type").eqNullSafe(F.lag("event_type").over(w))).cast("int")
    rows = table(spark, sf_dir, "events").withColumn("new", new).withColumn("run", F.sum("new").over(w))
    inside = Window.partitionBy("user_id", "run").orderBy("ts", "event_id")
    return rows.withColumn("k", F.row_number().over(inside)).where("k = 3").select("user_id", "event_id", "event_type")


@query(f"""WITH {NOTES}, s AS (SELECT score, idx, midi, lead(midi, 1) OVER w AS m2, lead(midi, 2) OVER w AS m3 FROM notes WINDOW w AS (PARTITION BY score ORDER BY idx)),
p AS (SELECT a.score, a.idx AS i, b.idx AS j FROM s a JOIN s b ON a.score = b.score AND a.midi = b.midi AND a.m2 = b.m2 AND b.idx > a.idx)
SELECT score, j - i AS shift, count(*) AS n, min(i) AS first FROM (SELECT *, i - row_number() OVER (PARTITION BY score, j - i ORDER BY i) AS g FROM p) GROUP BY score, j - i, g""")
def w12_common_runs(spark, sf_dir):
    """Stretches that come again later in a score, by pairs of notes, diagonals and their runs."""
    w = Window.partitionBy("score").orderBy("idx")
    s = notes(spark, sf_dir).select("score", "idx", "midi", F.lead("midi").over(w).alias("m2")).where("m2 IS NOT NULL")
    a, b = s.select("score", "midi", "m2", F.col("idx").alias("i")), s.select("score", "midi", "m2", F.col("idx").alias("j"))
    p = a.join(b, ["score", "midi", "m2"]).where("j > i").withColumn("shift", F.col("j") - F.col("i"))
    g = F.col("i") - F.row_number().over(Window.partitionBy("score", "shift").orderBy("i"))
    return p.withColumn("g", g).groupBy("score", "shift", "g").agg(F.count("*").alias("n"), F.min("i").alias("first")).drop("g")


@query("""WITH s AS (SELECT l_suppkey AS prog, l_linenumber AS val, avg(l_discount) AS score FROM lineitem GROUP BY 1, 2) SELECT val, prog, round(score, 9) AS score FROM s QUALIFY rank() OVER (PARTITION BY val ORDER BY round(score, 9) DESC) = 1""")
def k11_instance_frontier(spark, sf_dir):
    """The best programs of each instance, ties kept."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("val"), F.col("l_suppkey").alias("prog")).agg(F.round(F.avg("l_discount"), 9).alias("score"))
    best = s.groupBy("val").agg(F.max("score").alias("score"))
    return s.join(best, ["val", "score"]).select("val", "prog", "score")
