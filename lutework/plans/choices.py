"""Queries that choose: merged routes, frontiers, lineages and their merges, gates, samples, rankers and patches."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..operators import curation, ordered, ranking
from .adapters import table
from .registry import Registry

REGISTRY = query = Registry()

_ROUTES = "list_transform([1, 2, 3], lambda r: {'c': 100 * ((o_orderkey * r * 31) % 97), 'entry': (o_orderkey + r) % 7 + 1, 'leave': (o_orderkey * r) % 7 + 1})"


@query(f"""WITH RECURSIVE p AS (SELECT o_custkey AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, {_ROUTES} AS routes FROM orders),
e AS (SELECT score, n, r, routes[r].c AS c, routes[r].entry AS entry, routes[r].leave AS leave FROM p, (SELECT unnest([1, 2, 3]) AS r)),
d AS (SELECT score, n, leave, {{'c': c, 'path': [r]}} AS s FROM e WHERE n = 1
  UNION ALL SELECT e.score, e.n, any_value(e.leave), min({{'c': d.s.c + e.c + 75 * abs(e.entry - d.leave) + 30 * greatest(0, abs(e.entry - d.leave) - 1), 'path': list_append(d.s.path, e.r)}}) FROM d JOIN e ON e.score = d.score AND e.n = d.n + 1 GROUP BY e.score, e.n, e.r),
b AS (SELECT score, n, min(s) AS s FROM d GROUP BY score, n QUALIFY row_number() OVER (PARTITION BY score ORDER BY n DESC) = 1) SELECT score, s.c::BIGINT AS cost, array_to_string(s.path, ',') AS ranks FROM b""")
def k3_merged_routes(spark, sf_dir):
    """K3: of each phrase of a score one of its routes, so that routes and the moves between them cost least, exactly; ties go to the smaller ranks."""
    k = F.col("o_orderkey")
    route = lambda r: F.struct((100 * ((k * r * 31) % 97)).alias("cost"), ((k + r) % 7 + 1).alias("entry"), ((k * r) % 7 + 1).alias("leave"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("score"), F.struct("o_orderdate", "o_orderkey").alias("at"), F.array(*[route(r) for r in (1, 2, 3)]).alias("routes"))

    def move(leave: Column, entry: Column) -> Column:
        far = F.abs(entry - leave)
        return 75 * far + 30 * F.greatest(F.lit(0).cast("long"), far - 1)

    found = ranking.merged_routes(rows, "score", "at", "routes", move)
    return found.select("score", "cost", F.array_join(F.col("ranks").cast("array<string>"), ",").alias("ranks"))


_SCORES = "s AS (SELECT l_suppkey AS prog, l_linenumber AS val, round(avg(l_discount), 9) AS a, round(avg(l_tax), 9) AS b, round(avg(l_discount + l_tax), 9) AS t FROM lineitem GROUP BY 1, 2), g AS (SELECT l_suppkey AS prog, round(avg(l_discount), 9) AS a, round(avg(l_tax), 9) AS b FROM lineitem GROUP BY 1)"


@query(f"""WITH {_SCORES}, i AS (SELECT val::VARCHAR AS key, prog FROM s QUALIFY rank() OVER (PARTITION BY val ORDER BY t DESC) = 1),
o AS (SELECT o AS key, prog FROM (SELECT prog, 'a' AS o, a AS x FROM g UNION ALL SELECT prog, 'b', b FROM g) QUALIFY rank() OVER (PARTITION BY o ORDER BY x DESC) = 1),
c AS (SELECT val || '/' || o AS key, prog FROM (SELECT prog, val, 'a' AS o, a AS x FROM s UNION ALL SELECT prog, val, 'b', b FROM s) QUALIFY rank() OVER (PARTITION BY val, o ORDER BY x DESC) = 1)
SELECT 'instance' AS kind, * FROM i UNION ALL SELECT 'objective', * FROM o UNION ALL SELECT 'hybrid', * FROM i UNION ALL SELECT 'hybrid', * FROM o UNION ALL SELECT 'cartesian', * FROM c""")
def k11_frontiers(spark, sf_dir):
    """Who leads each instance, each objective, either of them, and each objective of each instance; ties stay."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("prog"), F.col("l_linenumber").alias("val"), "l_discount", "l_tax")
    mean = lambda c: F.round(F.avg(c), 9)
    s = l.groupBy("prog", "val").agg(mean("l_discount").alias("a"), mean("l_tax").alias("b"), mean(F.col("l_discount") + F.col("l_tax")).alias("t"))
    g = l.groupBy("prog").agg(mean("l_discount").alias("a"), mean("l_tax").alias("b"))
    long = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.col(o).alias("x")) for o in ("a", "b")])).alias("e")
    instance = ranking.leaders(s.select("prog", F.col("val").cast("string").alias("key"), F.col("t").alias("score")))
    objective = ranking.leaders(g.select("prog", long).select("prog", F.col("e.o").alias("key"), F.col("e.x").alias("score")))
    both = ranking.leaders(s.select("prog", "val", long).select("prog", F.concat_ws("/", F.col("val").cast("string"), "e.o").alias("key"), F.col("e.x").alias("score")))
    kinds = [("instance", instance), ("objective", objective), ("hybrid", instance), ("hybrid", objective), ("cartesian", both)]
    out = None
    for kind, found in kinds:
        part = found.select(F.lit(kind).alias("kind"), "key", "prog")
        out = part if out is None else out.unionByName(part)
    return out


@query("""WITH RECURSIVE s AS (SELECT l_suppkey AS prog, l_linenumber AS val, round(avg(l_discount), 2) AS x FROM lineitem GROUP BY 1, 2), f AS (SELECT val, list(prog ORDER BY prog) AS front FROM (SELECT * FROM s QUALIFY rank() OVER (PARTITION BY val ORDER BY x DESC) = 1) GROUP BY val),
g AS (SELECT l_suppkey AS prog, round(avg(l_discount), 9) AS score FROM lineitem WHERE l_suppkey IN (SELECT unnest(front) FROM f) GROUP BY 1), r AS (SELECT prog, row_number() OVER (ORDER BY score, prog) AS n FROM g),
w AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS out UNION ALL
  SELECT r.n, CASE WHEN NOT EXISTS (SELECT 1 FROM f WHERE list_contains(front, r.prog) AND len(list_filter(front, lambda p: p <> r.prog AND NOT list_contains(w.out, p))) = 0) THEN list_append(w.out, r.prog::BIGINT) ELSE w.out END FROM w JOIN r ON r.n = w.n + 1)
SELECT val, array_to_string(list_filter(front, lambda p: NOT list_contains(gone, p)), ',') AS front FROM f, (SELECT arg_max(out, n) AS gone FROM w)""")
def k12_undominated(spark, sf_dir):
    """Fronts without the candidates that others replace on every front, the lowest score being tried first."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("prog"), F.col("l_linenumber").cast("string").alias("key"), "l_discount")
    s = l.groupBy("prog", "key").agg(F.round(F.avg("l_discount"), 2).alias("score"))
    scores = l.groupBy("prog").agg(F.round(F.avg("l_discount"), 9).alias("score"))
    found = ranking.undominated(ranking.leaders(s), scores)
    return found.select(F.col("key").cast("int").alias("val"), F.array_join(F.sort_array("front").cast("array<string>"), ",").alias("front"))


_ARMS = """a AS (SELECT o_orderpriority AS arm, count(*) AS n, count(*) FILTER (o_orderstatus <> 'P') AS ok, avg(o_totalprice) AS score, count(*) FILTER (o_orderkey % 5 = 0) AS bad,
  avg(o_totalprice % 1000) FILTER (o_orderstatus <> 'P') AS pitch, avg(o_custkey % 10) FILTER (o_orderstatus <> 'P') AS string FROM orders GROUP BY 1)"""


@query(f"""WITH {_ARMS}, b AS (SELECT * FROM a WHERE arm = '3-MEDIUM'), d AS (SELECT a.arm, a.ok >= b.ok AS g1, a.pitch + 1e-9 >= b.pitch AS g2, a.bad <= b.bad AS g3, a.pitch > b.pitch + 1e-9 AS p, a.string > b.string + 1e-9 AS s, a.score > b.score + 1e-9 AS better FROM a, b WHERE a.arm <> b.arm)
SELECT arm, g1 AS protocol_gate, g2 AS pitch_gate, g3 AS violations_gate, CASE WHEN g1 AND g2 AND g3 THEN concat_ws(',', CASE WHEN p THEN 'pitch' END, CASE WHEN s THEN 'string' END) ELSE '' END AS specialist_for, g1 AND g2 AND g3 AND better AS parent_eligible, g1 AND g2 AND g3 AND (better OR p OR s) AS retained FROM d""")
def k14_decisions(spark, sf_dir):
    """Arms summarised and held against the baseline arm: gates, components in which they are better, and what may be kept."""
    ok = F.col("o_orderstatus") != "P"
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("arm")).agg(
        F.count_if(ok).alias("ok"), F.avg("o_totalprice").alias("score"), F.count_if(F.col("o_orderkey") % 5 == 0).alias("bad"), F.avg(F.when(ok, F.col("o_totalprice") % 1000)).alias("pitch"), F.avg(F.when(ok, F.col("o_custkey") % 10)).alias("string")
    )
    base = a.where("arm = '3-MEDIUM'").select(*[F.col(c).alias(f"b_{c}") for c in a.columns])  # one row
    d = a.where("arm <> '3-MEDIUM'").join(F.broadcast(base), F.lit(True))
    over = lambda c: F.col(c) > F.col(f"b_{c}") + 1e-9
    gates = {"protocol_gate": F.col("ok") >= F.col("b_ok"), "pitch_gate": F.col("pitch") + 1e-9 >= F.col("b_pitch"), "violations_gate": F.col("bad") <= F.col("b_bad")}
    safe = gates["protocol_gate"] & gates["pitch_gate"] & gates["violations_gate"]
    gains = F.concat_ws(",", *[F.when(over(c), F.lit(c)) for c in ("pitch", "string")])
    return d.select(
        "arm", *[c.alias(k) for k, c in gates.items()], F.when(safe, gains).otherwise("").alias("specialist_for"), (safe & over("score")).alias("parent_eligible"), (safe & (over("score") | (gains != ""))).alias("retained")
    )


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS node, p_partkey // 2 AS up FROM part WHERE p_partkey >= 2 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey >= 3), c AS (SELECT node, up FROM e UNION SELECT c.node, e.up FROM c JOIN e ON c.up = e.node),
p AS (SELECT p_partkey AS i, p_partkey + 1 AS j FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part) AND (p_partkey + 1, p_partkey) NOT IN (SELECT node, up FROM c)),
x AS (SELECT i, j, a.up AS ancestor, (a.up * 37) % 101 AS s FROM p JOIN c a ON a.node = i JOIN c b ON b.node = j AND b.up = a.up WHERE (a.up * 37) % 101 <= least((i * 37) % 101, (j * 37) % 101)),
y AS (SELECT i, j, arg_max(ancestor, (s, ancestor)) AS ancestor FROM x GROUP BY i, j)
SELECT i, j, ancestor, array_to_string(list_transform([1, 2, 3], lambda k: CASE WHEN (ancestor * k // 2) % 3 = (i * k // 2) % 3 THEN (j * k // 2) % 3 WHEN (ancestor * k // 2) % 3 = (j * k // 2) % 3 OR (i * 37) % 101 >= (j * 37) % 101 THEN (i * k // 2) % 3 ELSE (j * k // 2) % 3 END), ',') AS parts FROM y""")
def j15_c10_merges(spark, sf_dir):
    """Pairs of candidates neither of which descends from the other, the best common ancestor that neither falls behind, and what they make
    together: each part as the one that changed it has it, or as the better one where both did."""
    n = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey")
    up = F.explode(F.filter(F.array(F.expr("p_partkey DIV 2"), F.expr("p_partkey DIV 3")), lambda u: u > 0))
    closed = ordered.lineage(part.select(n.cast("long").alias("node"), up.alias("up")).distinct())
    pairs = part.select(n.cast("long").alias("i"), (n + 1).cast("long").alias("j")).join(part.select(n.cast("long").alias("j")), "j")
    pairs = pairs.join(closed, (F.col("j") == F.col("node")) & (F.col("i") == F.col("up")), "left_anti")
    score = lambda c: (c * 37) % 101
    of = lambda k: closed.select(F.col("node").alias(k), F.col("up").alias("ancestor"))
    shared = pairs.join(of("i"), "i").join(of("j"), ["j", "ancestor"]).where(score(F.col("ancestor")) <= F.least(score(F.col("i")), score(F.col("j"))))
    best = shared.groupBy("i", "j").agg(F.max_by("ancestor", F.struct(score(F.col("ancestor")), F.col("ancestor"))).alias("ancestor"))

    def part_of(c: str, k: int) -> Column:
        return F.floor(F.col(c) * k / 2) % 3

    def merged(k: int) -> Column:
        a, i, j = (part_of(c, k) for c in ("ancestor", "i", "j"))
        return F.when(a == i, j).when((a == j) | (score(F.col("i")) >= score(F.col("j"))), i).otherwise(j)

    return best.select("i", "j", "ancestor", F.concat_ws(",", *[merged(k).cast("string") for k in (1, 2, 3)]).alias("parts"))


@query("""WITH o AS (SELECT o_orderkey % 1000 AS id, o_custkey AS score, o_custkey % 40 AS family, CASE WHEN o_custkey % 40 < 20 THEN 'train' WHEN o_orderpriority < '2' THEN 'test' ELSE 'train' END AS split FROM orders)
SELECT 'family' AS kind, family AS key, count(DISTINCT split) AS n FROM o GROUP BY family HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'score', score, count(DISTINCT split) FROM o GROUP BY score HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'id', id, count(*) FROM o GROUP BY id HAVING count(*) > 1""")
def j18_leak_report(spark, sf_dir):
    """Families and scores in more than one split, and repeated ids."""
    family = F.col("o_custkey") % 40
    split = F.when(family < 20, "train").when(F.col("o_orderpriority") < "2", "test").otherwise("train")
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 1000).alias("id"), F.col("o_custkey").alias("score"), family.alias("family"), split.alias("split"))
    several = lambda c: curation.leaking(o, c, "split").select(F.lit(c).alias("kind"), F.col(c).alias("key"), F.col("n_splits").alias("n"))
    again = o.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("id").alias("kind"), F.col("id").alias("key"), "n")
    return several("family").unionByName(several("score")).unionByName(again)


_PAIRS = "p AS (SELECT l_orderkey, l_linenumber, 48.0::DOUBLE + trunc(l_quantity)::INT % 24 AS t1, 48.0::DOUBLE + (trunc(l_quantity)::INT * 5) % 24 AS t2, 48.0::DOUBLE + (trunc(l_quantity)::INT * 5) % 24 + l_discount AS a1, 48.0::DOUBLE + trunc(l_quantity)::INT % 24 - l_tax AS a2 FROM lineitem)"


@query(f"""WITH {_PAIRS} SELECT l_orderkey, l_linenumber, round(100 * least(abs(t1 - a1) + abs(t2 - a2), abs(t1 - a2) + abs(t2 - a1)), 3) AS error, (abs(t1 - a1) <= 0.05 OR abs(t2 - a1) <= 0.05) AND (abs(t1 - a2) <= 0.05 OR abs(t2 - a2) <= 0.05) AS resolved FROM p""")
def j16_j17_pairings(spark, sf_dir):
    """Actual and expected pitches paired so that the total error is least, and whether each actual one is near an expected one."""
    q = F.col("l_quantity").cast("int")
    t = F.array((48.0 + q % 24).cast("double"), (48.0 + (q * 5) % 24).cast("double"))
    a = F.array(48.0 + (q * 5) % 24 + F.col("l_discount"), 48.0 + q % 24 - F.col("l_tax"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", t.alias("t"), a.alias("a"))
    total = F.aggregate(F.zip_with(F.array_sort("t"), F.array_sort("a"), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    near = F.forall("a", lambda x: F.exists("t", lambda y: F.abs(x - y) <= 0.05))
    return rows.select("l_orderkey", "l_linenumber", F.round(100 * total, 3).alias("error"), near.alias("resolved"))


@query("""WITH f AS (SELECT c_custkey AS k, c_mktsegment AS pool, c_nationkey AS family, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3),
v AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY n, k) - 1 AS r, count(*) OVER (PARTITION BY pool) AS m FROM f), c AS (SELECT pool, max(n) FILTER (r = m // 3) AS a, max(n) FILTER (r = 2 * m // 3) AS b FROM v GROUP BY pool),
t AS (SELECT v.*, CASE WHEN n < a THEN 0 WHEN n < b THEN 1 ELSE 2 END AS tercile, sha256('17:' || k) AS h FROM v JOIN c USING (pool)), one AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY pool, tercile, family ORDER BY h, k) <= 2)
SELECT pool, tercile, k FROM one QUALIFY row_number() OVER (PARTITION BY pool, tercile ORDER BY h, k) <= 6""")
def c3_pilot(spark, sf_dir):
    """A pilot sample: features of every candidate, terciles within its pool, two of a family at most and a quota of each cell, in the order of a
    seeded hash."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("pool"), F.col("c_nationkey").alias("family"))
    f = c.join(orders, "k", "left").select("k", "pool", "family", F.coalesce("n", F.lit(0)).alias("n"))
    v = f.withColumn("r", F.row_number().over(Window.partitionBy("pool").orderBy("n", "k")) - 1).join(f.groupBy("pool").agg(F.count("*").alias("m")), "pool")
    cut = lambda x: F.max(F.when(F.col("r") == F.floor(x * F.col("m") / 3), F.col("n")))
    t = f.join(v.groupBy("pool").agg(cut(1).alias("a"), cut(2).alias("b")), "pool")
    t = t.withColumn("tercile", F.when(F.col("n") < F.col("a"), 0).when(F.col("n") < F.col("b"), 1).otherwise(2)).withColumn("h", F.sha2(F.concat(F.lit("17:"), F.col("k").cast("string")), 256))
    one = ordered.top_k(t, ["pool", "tercile", "family"], ["h", "k"], 2).drop("rank")
    return ordered.top_k(one, ["pool", "tercile"], ["h", "k"], 6).select("pool", "tercile", "k")


@query()
def c5_tuning_ranker(spark, sf_dir):
    """A ranker of tunings: trajectories against a fixed catalogue, a weighted logistic regression fitted without each fold of families in turn, and how
    often the true tuning comes first or among the first three."""
    from .more import CATALOG

    k = F.col("c_custkey")
    noise = lambda i: (k * (i + 3) + F.floor(k / 7)) % 5 - 2
    catalog = F.array(*[F.array(*[F.lit(x) for x in row]) for row in CATALOG])
    truth = (k % len(CATALOG)).cast("int")
    own = F.array(*[F.get(F.get(catalog, truth), i) + noise(i) for i in range(7)])
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_nationkey").alias("family"), truth.alias("truth"), own.alias("own"), F.posexplode(catalog).alias("k", "entry"))
    far = F.zip_with("own", "entry", lambda a, b: F.abs(a - b).cast("double"))
    rows = rows.select("id", "family", "k", (F.col("k") == F.col("truth")).cast("double").alias("label"), far.alias("features"))
    found = ranking.folded_ranks(rows, 5)
    return found.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg((F.col("rank") == 1).cast("int")), 6).alias("top1"), F.round(F.avg((F.col("rank") <= 3).cast("int")), 6).alias("top3"))


_PATCHES = """a AS (SELECT o_orderkey AS k, o_orderkey % 7 + 1 AS string, CASE WHEN o_orderkey % 2 = 0 THEN ['yin'] ELSE []::VARCHAR[] END AS t FROM orders WHERE o_orderkey % 11 <> 0),
p AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, ['REPOSITION', 'ADD', 'REMOVE', 'NO_OP', 'OTHER'][1 + trunc(l_quantity)::INT % 5] AS kind,
  CASE WHEN trunc(l_quantity)::INT % 2 = 0 THEN l_partkey % 7 + 1 END AS wanted, l_suppkey % 7 + 1 AS new, ['yin', 'nao', 'zhuang'][1 + l_partkey % 3] AS tech FROM lineitem)"""


@query(f"""WITH RECURSIVE {_PATCHES}, s AS (SELECT k, 0::BIGINT AS n, string, t, 0 AS applied, []::VARCHAR[] AS errors, there FROM (SELECT x.k, a.string, coalesce(a.t, []) AS t, a.k IS NOT NULL AS there FROM (SELECT DISTINCT k FROM p) x LEFT JOIN a ON a.k = x.k)
  UNION ALL SELECT k, n, CASE WHEN error IS NULL AND kind = 'REPOSITION' THEN new ELSE string END, CASE WHEN error IS NOT NULL THEN t WHEN kind = 'ADD' AND NOT list_contains(t, tech) THEN list_append(t, tech) WHEN kind = 'REMOVE' THEN list_filter(t, lambda x: x <> tech) ELSE t END,
    applied + (error IS NULL)::INT, CASE WHEN error IS NULL THEN errors ELSE list_append(errors, error) END, there OR kind = 'ADD' FROM
    (SELECT s.*, p.n AS m, kind, wanted, new, tech, CASE WHEN NOT there AND kind <> 'ADD' THEN 'missing' WHEN kind = 'REPOSITION' AND wanted IS NOT NULL AND wanted IS DISTINCT FROM string THEN 'before' WHEN kind = 'REMOVE' AND NOT list_contains(t, tech) THEN 'absent' WHEN kind = 'OTHER' THEN 'unknown' END AS error
     FROM s JOIN p ON p.k = s.k AND p.n = s.n + 1) x(k, m0, string, t, applied, errors, there, n, kind, wanted, new, tech, error))
SELECT k, string, array_to_string(t, ',') AS techniques, applied::BIGINT AS applied, array_to_string(errors, ',') AS errors FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC) = 1""")
def f5_replayed_patches(spark, sf_dir):
    """patches applied to a plan in their order, each only where it finds what it expects; the others are errors."""
    q = F.col("l_quantity").cast("int")
    k = F.col("o_orderkey")
    plan = table(spark, sf_dir, "orders").where("o_orderkey % 11 <> 0").select(k.alias("k"), (k % 7 + 1).alias("string"), F.when(k % 2 == 0, F.array(F.lit("yin"))).otherwise(F.array().cast("array<string>")).alias("techniques"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    patches = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), order.alias("order"), F.get(F.array(*[F.lit(x) for x in curation.PATCHES]), q % 5).alias("kind"), F.when(q % 2 == 0, F.col("l_partkey") % 7 + 1).alias("before"), (F.col("l_suppkey") % 7 + 1).alias("after"),
        F.get(F.array(F.lit("yin"), F.lit("nao"), F.lit("zhuang")), (F.col("l_partkey") % 3).cast("int")).alias("technique"),
    )
    found = curation.replayed_patches(plan, patches, "k")
    return found.select("k", "string", F.array_join("techniques", ",").alias("techniques"), F.col("applied").cast("long").alias("applied"), F.array_join("errors", ",").alias("errors"))


@query("""WITH RECURSIVE t AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN value > 40 THEN [event_id % 6, event_id % 4] ELSE []::BIGINT[] END AS cur, CASE WHEN event_type = 'purchase' THEN [event_id % 3, event_id % 5] ELSE []::BIGINT[] END AS informed FROM events),
s AS (SELECT DISTINCT u, 0::BIGINT AS n, []::BIGINT[] AS pending, []::BIGINT[] AS attempted FROM t UNION ALL
  SELECT u, n, list_filter(list_distinct(pending || cur), lambda x: NOT (list_contains(informed, x) AND list_contains(pending, x) AND NOT list_contains(cur, x))), list_distinct(attempted || list_filter(informed, lambda x: list_contains(pending, x))) FROM
    (SELECT s.u, t.n, s.pending, s.attempted, t.cur, t.informed FROM s JOIN t ON t.u = s.u AND t.n = s.n + 1) x)
SELECT u AS user_id, array_to_string(list_sort(list_filter(pending, lambda x: NOT list_contains(attempted, x))), ',') AS waiting, array_to_string(list_sort(attempted), ',') AS attempted FROM s QUALIFY row_number() OVER (PARTITION BY u ORDER BY n DESC) = 1""")
def f12_warning_lifecycle(spark, sf_dir):
    """warnings that still need a turn: each turn adds its own; an edit that knew the candidates counts for a warning only if it was pending before
    that turn, and takes it away only if the turn doesn't bring it again."""
    e = F.col("event_id")
    none = F.array().cast("array<bigint>")
    turns = table(spark, sf_dir, "events").select(
        "user_id", F.struct("ts", "event_id").alias("order"), F.when(F.col("value") > 40, F.array(e % 6, e % 4)).otherwise(none).alias("current"),
        F.when(F.col("event_type") == "purchase", F.array(e % 3, e % 5)).otherwise(none).alias("informed"),
    )
    found = curation.warning_lifecycle(turns, "user_id", "order")
    text = lambda c: F.array_join(F.array_sort(c).cast("array<string>"), ",")
    return found.select("user_id", text(F.array_except("pending", "attempted")).alias("waiting"), text(F.col("attempted")).alias("attempted"))


@query("""SELECT event_type AS kind, count(*) AS n, true AS complete, true AS unchanged, min(event_id) AS first_id FROM events GROUP BY 1""")
def u8_keyed_merge(spark, sf_dir):
    """U8: workers' outputs merged by kind and id: a repeated or missing key fails, kept fields must be those of the source, and rows come in its order."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.round("value", 3).alias("value"))
    done = e.withColumn("reasoning", F.concat(F.lit("r"), F.col("id").cast("string")))
    merged = curation.keyed_merge(e, [done.where(F.col("id") % 3 == r) for r in range(3)], ["kind", "id"], ["value"])
    return merged.groupBy("kind").agg(F.count("*").alias("n"), F.bool_and(F.col("reasoning").isNotNull()).alias("complete"), F.bool_and("unchanged").alias("unchanged"), F.min_by("id", "at").alias("first_id"))
