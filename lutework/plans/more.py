"""Further metric, join, sampling and scalar queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import music
from ..operators import metrics
from ..operators.candidates import near_positions, position_grid
from ..sources.readers import letter_midi
from .adapters import LABELLED, labelled, table
from .pitch import GRID
from .registry import Registry

REGISTRY = query = Registry()


@query("""WITH e AS (SELECT trunc(l_quantity)::INT AS q, round(l_discount * 100)::INT AS d FROM lineitem),
p AS (SELECT CASE WHEN q % 4 = 0 THEN (q % 7 + 1) || '|OPEN' WHEN q % 3 > 0 THEN (q % 7 + 1) || '|' || (q % 12 + 1) END AS r, CASE WHEN d % 4 = 0 THEN (q % 7 + 1) || '|OPEN' WHEN d % 5 > 0 THEN (q % 7 + 1) || '|' || (q % 12 + 1 - d % 2) END AS p FROM e)
SELECT count(*) FILTER (r IS NULL) AS unresolved, count(*) FILTER (r IS NOT NULL AND p = r) AS tp, count(*) FILTER (r IS NOT NULL AND p IS NOT NULL AND p <> r) AS fp, count(*) FILTER (r IS NOT NULL AND p IS DISTINCT FROM r) AS fn,
  round(2.0::DOUBLE * count(*) FILTER (p = r) / nullif(2 * count(*) FILTER (p = r) + count(*) FILTER (r IS NOT NULL AND p IS NOT NULL AND p <> r) + count(*) FILTER (r IS NOT NULL AND p IS DISTINCT FROM r), 0), 6) AS f1 FROM p""")
def a5_string_hui(spark, sf_dir):
    """A5: string and stud sets, open strings under a label of their own; a reference without a stud is unresolved and not counted."""
    q, d = F.col("l_quantity").cast("int"), F.round(F.col("l_discount") * 100).cast("int")
    place = lambda opened, known, hui: F.when(opened, F.array(F.struct((q % 7 + 1).alias("s"), F.lit("OPEN").alias("h")))).when(known, F.array(F.struct((q % 7 + 1).alias("s"), hui.cast("string").alias("h"))))
    e = table(spark, sf_dir, "lineitem").select(place(q % 4 == 0, q % 3 > 0, q % 12 + 1).alias("r"), place(d % 4 == 0, d % 5 > 0, q % 12 + 1 - d % 2).alias("p"))
    nothing = F.array().cast("array<struct<s:int,h:string>>")
    sets = e.select("r", F.coalesce("p", nothing).alias("p")).withColumn("both", F.size(F.array_intersect("r", "p")))
    n = sets.where("r IS NOT NULL").agg(F.sum("both").alias("tp"), F.sum(F.size("p") - F.col("both")).alias("fp"), F.sum(F.size("r") - F.col("both")).alias("fn"))
    f1 = F.round(F.try_divide(F.lit(2.0) * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6)
    return n.join(F.broadcast(sets.agg(F.count_if(F.col("r").isNull()).alias("unresolved"))), F.lit(True)).select("unresolved", "tp", "fp", "fn", f1.alias("f1"))  # one row each


@query("""SELECT event_type AS stage, count(*) AS calls, count(*) FILTER (value >= 150) AS failed, round(count(*) FILTER (value >= 150) / count(*)::DOUBLE, 6) AS failure_rate,
  count(DISTINCT user_id) FILTER (value >= 150) AS users_failed FROM events GROUP BY GROUPING SETS ((event_type), ())""")
def a15_a21_a22_calls(spark, sf_dir):
    """Calls and failures by stage and over all, in one pass."""
    bad = F.col("value") >= 150
    e = table(spark, sf_dir, "events").withColumn("stage", F.col("event_type"))
    return e.groupingSets([["stage"], []], "stage").agg(
        F.count("*").alias("calls"), F.count_if(bad).alias("failed"), F.round(F.count_if(bad) / F.count("*"), 6).alias("failure_rate"), F.countDistinct(F.when(bad, F.col("user_id"))).alias("users_failed")
    ).select("stage", "calls", "failed", "failure_rate", "users_failed")


@query(f"WITH {LABELLED} SELECT prediction AS label, count(*) AS n, count(*) FILTER (cents <= 50) AS near FROM labelled WHERE NOT warned AND prediction IS NOT NULL GROUP BY 1")
def j5_unwarned(spark, sf_dir):
    """Predictions without those events that carry a warning."""
    rows = labelled(spark, sf_dir)
    return rows.where("NOT warned AND prediction IS NOT NULL").groupBy(F.col("prediction").alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("cents") <= 50).alias("near"))


@query("SELECT o_orderkey, sha256(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority) AS digest FROM orders")
def p15_compact(spark, sf_dir):
    """Retained fields and the digest by which they are checked later."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"), 256).alias("digest"))


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('purchase', 'signup', 'error')")
def p16_vocabulary(spark, sf_dir):
    """Patches whose type is outside the vocabulary."""
    return table(spark, sf_dir, "events").where(~F.col("event_type").isin("purchase", "signup", "error")).select("event_id", "event_type")


@query("SELECT c_mktsegment AS split, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def j11_j12_checked(spark, sf_dir):
    """Rows looked up in a manifest; a key that it lacks fails the job."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    split = F.coalesce("c_mktsegment", F.raise_error(F.concat(F.lit("no manifest row for "), F.col("o_custkey").cast("string"))).cast("string"))
    return o.groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


CATALOG = [[50, 52, 54, 56, 58, 60, 62], [51, 54, 54, 57, 60, 60, 63], [52, 53, 56, 58, 59, 62, 63], [48, 50, 53, 55, 57, 60, 62]]


@query(f"""WITH t AS (SELECT s_suppkey, s_suppkey % 4 AS truth, list_transform(range(1, 8), lambda i: 48 + 2 * i + (s_suppkey * i) % 3) AS o FROM supplier),
c AS (SELECT s_suppkey, truth, k, list_sum(list_transform(range(1, 8), lambda i: abs(o[i] - {CATALOG}[k + 1][i])))::BIGINT AS far FROM t, (SELECT unnest(range(4)) AS k)),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY far, k) AS rank FROM c) SELECT s_suppkey, max(rank) FILTER (k = truth)::INT AS true_rank, max(k) FILTER (rank = 1)::INT AS best, bool_or(k = truth AND rank <= 3) AS in_top3 FROM r GROUP BY 1""")
def j13_w15_tuning_rank(spark, sf_dir):
    """Every trajectory against the tunings of a fixed catalogue, and the rank of the true one."""
    o = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: 48 + 2 * i + (F.col("s_suppkey") * i) % 3)
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*[F.lit(x) for x in c]).alias("c")) for k, c in enumerate(CATALOG)])
    t = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 4).alias("truth"), o.alias("o"), F.explode(entries).alias("e"))
    far = F.aggregate(F.zip_with("o", "e.c", lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda a, x: a + x)
    r = t.select("s_suppkey", "truth", "e.k", far.alias("far")).withColumn("rank", F.row_number().over(Window.partitionBy("s_suppkey").orderBy("far", "k")))
    hit = F.col("k") == F.col("truth")
    return r.groupBy("s_suppkey").agg(
        F.max(F.when(hit, F.col("rank"))).alias("true_rank"), F.max(F.when(F.col("rank") == 1, F.col("k"))).alias("best"), F.bool_or(hit & (F.col("rank") <= 3)).alias("in_top3")
    )


@query("""WITH s AS (SELECT l_suppkey AS prog, l_linenumber AS val, round(avg(l_discount), 9) AS score FROM lineitem GROUP BY 1, 2), f AS (SELECT prog FROM s QUALIFY rank() OVER (PARTITION BY val ORDER BY score DESC) = 1),
n AS (SELECT prog, count(*) AS n FROM f GROUP BY prog) SELECT prog, n, round(n / sum(n) OVER (), 9) AS share, row_number() OVER (ORDER BY -ln((('0x' || substr(sha256('3:' || prog), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / n, prog)::INT AS drawn FROM n""")
def k13_parent_choice(spark, sf_dir):
    """Parents by how many instances they lead, drawn in the order of a seeded exponential key. At most as many as lead."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("val"), F.col("l_suppkey").alias("prog")).agg(F.round(F.avg("l_discount"), 9).alias("score"))
    n = s.join(s.groupBy("val").agg(F.max("score").alias("score")), ["val", "score"]).groupBy("prog").agg(F.count("*").alias("n"))
    u = (F.conv(F.substring(F.sha2(F.concat(F.lit("3:"), F.col("prog").cast("string")), 256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(2**32))
    everything = Window.partitionBy(F.lit(0))  # the leaders of a handful of instances
    return n.select(
        "prog", "n", F.round(F.col("n") / F.sum("n").over(everything), 9).alias("share"), F.row_number().over(everything.orderBy(-F.log(u) / F.col("n"), "prog")).alias("drawn")
    )


@query("""WITH r AS (SELECT c_custkey % 16 AS shard, c_custkey AS id, row_number() OVER (PARTITION BY c_custkey % 16 ORDER BY sha256('1:' || c_custkey), c_custkey) - 1 AS r, count(*) OVER (PARTITION BY c_custkey % 16) AS n FROM customer),
a AS (SELECT shard, id, r, false AS padded FROM r UNION ALL SELECT shard, id, n + r, true FROM r WHERE r < (8 - n % 8) % 8) SELECT shard, r // 8 AS batch, id, padded FROM a""")
def k16_minibatches(spark, sf_dir):
    """Batches of eight in the order of a seeded hash, shard by shard, the last one filled with the rows that came first."""
    shard = (F.col("c_custkey") % 16).alias("shard")
    w = Window.partitionBy("shard").orderBy(F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256), "id")
    rows = table(spark, sf_dir, "customer").select(shard, F.col("c_custkey").alias("id"))
    r = rows.withColumn("r", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("shard")))
    again = F.when(F.col("r") < (8 - F.col("n") % 8) % 8, F.array(F.col("r"), F.col("n") + F.col("r"))).otherwise(F.array(F.col("r").cast("long")))
    at = r.select("shard", "id", "n", F.explode(again).alias("at"))
    return at.select("shard", F.floor(F.col("at") / 8).alias("batch"), "id", (F.col("at") >= F.col("n")).alias("padded"))


@query(f"""WITH {GRID}, t AS (SELECT (l_suppkey % 7 + 1)::INT AS held, (45 + trunc(l_quantity)::INT)::DOUBLE AS target, count(*) AS n_notes FROM lineitem GROUP BY ALL)
SELECT held AS string, target, n_notes, hui, label, round((midi - target) * 100, 3) AS cents FROM t JOIN grid ON string = held AND mode = 'stopped' AND abs((midi - target) * 100) <= 35""")
def f13_feasible_endpoints(spark, sf_dir):
    """where on the held string a walk may end, for each string and pitch of the line items."""
    notes_ = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 7 + 1).cast("int").alias("held"), (45 + F.col("l_quantity").cast("int")).cast("double").alias("target")).agg(F.count("*").alias("n_notes"))
    found = near_positions(notes_.select("target").distinct(), position_grid(spark, music.STANDARD_TUNING, ("stopped",)))
    met = notes_.join(found, "target").where(F.col("string") == F.col("held"))
    return met.select("string", "target", "n_notes", "hui", "label", F.round("cents", 3).alias("cents"))


@query(f"""WITH {GRID}, k AS (SELECT (p_partkey % 12)::INT AS tonic, count(*) AS n_parts FROM part GROUP BY 1), s AS (SELECT tonic, n_parts, d AS degree, (48 + tonic + {music.MAJOR}[d] + 12 * o)::DOUBLE AS target FROM k, (SELECT unnest(range(1, 8)) AS d), (SELECT unnest(range(3)) AS o))
SELECT tonic, degree, n_parts, count(*) FILTER (mode = 'open') AS n_open, count(*) FILTER (mode = 'harmonic') AS n_harmonic, count(*) FILTER (mode = 'stopped') AS n_stopped FROM s JOIN grid ON abs((midi - target) * 100) <= 35 GROUP BY 1, 2, 3""")
def c6_scale_resources(spark, sf_dir):
    """How many positions of each kind a tuning gives for the degrees of the parts' scales, and how many parts have each scale."""
    one = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 12).cast("int").alias("tonic")).agg(F.count("*").alias("n_parts")).select("tonic", "n_parts", F.posexplode(F.array(*[F.lit(m) for m in music.MAJOR])).alias("p", "m"))
    s = one.select("tonic", "n_parts", (F.col("p") + 1).cast("long").alias("degree"), F.explode(F.transform(F.array(F.lit(0), F.lit(12), F.lit(24)), lambda o: (48 + F.col("tonic") + F.col("m") + o).cast("double"))).alias("target"))
    found = near_positions(s.select("target").distinct(), position_grid(spark, music.STANDARD_TUNING))
    n = lambda m: F.count_if(F.col("mode") == m).alias(f"n_{m}")
    return s.join(found, "target").groupBy("tonic", "degree", "n_parts").agg(n("open"), n("harmonic"), n("stopped"))


@query(f"""WITH g AS (SELECT d, o FROM (SELECT unnest(range(1, 8)) AS d), (SELECT unnest(range(-4, 5)) AS o)), p AS (SELECT p_partkey, p_partkey % 60 - 24 AS s FROM part),
c AS (SELECT p_partkey, s - {music.MAJOR}[d] - 12 * o AS acc, o, d FROM p, g), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(acc), abs(o), d) AS r FROM c) SELECT p_partkey, acc::BIGINT AS accidental, o::INT AS octave, d::INT AS degree FROM r WHERE r = 1""")
def fmus7_display(spark, sf_dir):
    """F-mus7: a pitch as the degree with the least accidental, then the least octave, then the least degree."""
    grid = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(d).alias("d"), F.lit(m + 12 * o).alias("at")) for d, m in enumerate(music.MAJOR, 1) for o in range(-4, 5)])
    s = F.col("p_partkey") % 60 - 24
    best = F.array_min(F.transform(grid, lambda g: F.struct(F.abs(s - g["at"]).alias("a"), F.abs(g["o"]).alias("b"), g["d"].alias("d"), g["o"].alias("o"), (s - g["at"]).alias("acc"))))
    return table(spark, sf_dir, "part").select("p_partkey", best.alias("x")).select("p_partkey", F.col("x.acc").alias("accidental"), F.col("x.o").alias("octave"), F.col("x.d").alias("degree"))


@query(f"""SELECT s_suppkey, array_to_string(list_transform(range(1, 8), lambda i: {[int(x) for x in music.STANDARD_TUNING]}[i] + CASE WHEN s_suppkey % i = 0 THEN 1 ELSE 0 END), ',') AS open_midi, round(s_suppkey / nullif(s_suppkey % 3, 0)::DOUBLE, 6) AS ratio, CASE WHEN s_suppkey < 3 THEN 'low' WHEN s_suppkey < 7 THEN 'mid' ELSE 'high' END AS bucket FROM supplier""")
def fmus6_fnum(spark, sf_dir):
    """F-mus6, F-num1 and F-num2: open strings by offsets, ratios without a zero denominator, half-open buckets."""
    base = F.array(*[F.lit(int(x)) for x in music.STANDARD_TUNING])
    offsets = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.when(F.col("s_suppkey") % i == 0, 1).otherwise(0))
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.array_join(F.zip_with(base, offsets, lambda a, b: a + b).cast("array<string>"), ",").alias("open_midi"),
        F.round(F.try_divide(k.cast("double"), (k % 3).cast("double")), 6).alias("ratio"), F.when(k < 3, "low").when(k < 7, "mid").otherwise("high").alias("bucket"),
    )


ZH = list(music.ZH_NUMBERS)


@query(f"""SELECT p_partkey, {ZH}[1 + p_partkey % 13] || '徽' || CASE WHEN p_partkey % 10 > 0 THEN {ZH}[p_partkey % 10] || '分' ELSE '' END AS rendered, '从' || (p_partkey % 9) || '再作' AS anchor FROM part""")
def fstr12_fstr15_render(spark, sf_dir):
    """F-str12 and F-str15: studs written out, and anchors without blanks and brackets."""
    k = F.col("p_partkey")
    names = F.array(*[F.lit(z) for z in ZH])
    tenth = (k % 10).cast("int")
    rendered = F.concat(F.get(names, (k % 13).cast("int")), F.lit("徽"), F.when(tenth > 0, F.concat(F.get(names, tenth - 1), F.lit("分"))).otherwise(""))
    raw = F.concat(F.lit("「从 "), (k % 9).cast("string"), F.lit(" 再作」"))
    return table(spark, sf_dir, "part").select("p_partkey", rendered.alias("rendered"), F.regexp_replace(raw, r"[\s「」()（）\[\]]", "").alias("anchor"))


CHORDS = ["[CE]", "c", "z", "^F,", "[_Bd']", ""]


@query("""SELECT p_partkey, ['60,64', '72', '', '54', '70,86', ''][1 + p_partkey % 6] AS tones, CASE WHEN p_partkey % 4 = 0 THEN '60,67' WHEN p_partkey % 6 IN (0, 4) THEN ['60,64', '', '', '', '70,86', ''][1 + p_partkey % 6] ELSE '60' END AS targets FROM part""")
def fmus10_fmus11_targets(spark, sf_dir):
    """F-mus10 and F-mus11: the tones of chords in letter notation; targets are the numbered pair if both are there, else the chord, else the one number."""
    token = F.get(F.array(*[F.lit(c) for c in CHORDS]), (F.col("p_partkey") % len(CHORDS)).cast("int"))
    tones = F.transform(F.regexp_extract_all(token, F.lit(r"((?:\^\^|\^|__|_|=)?[A-Ga-g][,']*)"), F.lit(1)), lambda x: letter_midi(x))
    rows = table(spark, sf_dir, "part").select("p_partkey", tones.alias("tones"))
    pair = F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit(60), F.lit(67)))
    targets = F.coalesce(pair, F.when(F.size("tones") > 1, F.col("tones")), F.array(F.lit(60)))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return rows.select("p_partkey", text(F.col("tones")).alias("tones"), text(targets).alias("targets"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN user_id END AS found FROM events")
def f_json(spark, sf_dir):
    """F-json: the first JSON object of a text, fenced or not; null where it does not parse."""
    body = F.to_json(F.struct("user_id"))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("so:\n```json\n"), body, F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("it is "), body, F.lit(" then"))).otherwise(F.concat(body.substr(F.lit(1), F.lit(8)), F.lit("}")))
    value = F.try_parse_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(value, "$.user_id", "long").alias("found"))


@query(f"WITH {LABELLED} SELECT piece, count(*) FILTER (cents <= 50) AS matched, round(count(*) FILTER (cents <= 50) / count(*)::DOUBLE, 6) AS accuracy, sha256(string_agg(DISTINCT coalesce(prediction, '-'), ',' ORDER BY coalesce(prediction, '-'))) AS guard FROM labelled GROUP BY piece")
def c7_refresh(spark, sf_dir):
    """Metrics counted anew from stored events, with a hash over what must not have changed."""
    rows = labelled(spark, sf_dir).withColumn("p", F.coalesce("prediction", F.lit("-")))
    guard = F.sha2(F.array_join(F.sort_array(F.collect_set("p")), ","), 256)
    near = F.count_if(F.col("cents") <= 50)
    return rows.groupBy("piece").agg(near.alias("matched"), F.round(near / F.count("*"), 6).alias("accuracy"), guard.alias("guard"))


@query("""WITH r AS (SELECT o_custkey AS score, o_orderkey AS phrase, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, o_totalprice AS cost FROM orders)
SELECT score, count(*) AS phrases, round(sum(cost), 2) AS total, max(n)::BIGINT AS last FROM r GROUP BY score""")
def a14_phrase_totals(spark, sf_dir):
    """A score's phrases numbered and summed."""
    w = Window.partitionBy("score").orderBy("day", "phrase")
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("score"), F.col("o_orderkey").alias("phrase"), F.col("o_orderdate").alias("day"), F.col("o_totalprice").alias("cost"))
    return r.withColumn("n", F.row_number().over(w)).groupBy("score").agg(F.count("*").alias("phrases"), F.round(F.sum("cost"), 2).alias("total"), F.max("n").cast("long").alias("last"))


@query("""WITH p AS (SELECT user_id, event_type, ts, event_id, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS after FROM events)
SELECT user_id, coalesce(array_to_string(list_sort(list(DISTINCT event_type) FILTER (after = 0 AND event_type IN ('error', 'signup'))), ','), '') AS pending, count(*) FILTER (event_type = 'purchase') AS attempts FROM p GROUP BY user_id""")
def w6_pending_after_attempt(spark, sf_dir):
    """Warnings pending after each user's turns: new ones join the set, an attempt settles all that were there. A fold over the
    turns as a window: only what came after the last attempt counts."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = table(spark, sf_dir, "events").withColumn("after", F.count_if(F.col("event_type") == "purchase").over(w))
    pending = F.collect_set(F.when((F.col("after") == 0) & F.col("event_type").isin("error", "signup"), F.col("event_type")))
    return e.groupBy("user_id").agg(F.array_join(F.sort_array(pending), ",").alias("pending"), F.count_if(F.col("event_type") == "purchase").alias("attempts"))
