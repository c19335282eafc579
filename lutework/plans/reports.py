"""Reports over scored events: tone, techniques, pitch, warnings, lengths, melodies and searches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics
from .adapters import LABELLED, NOTES, labelled, notes, table
from .registry import Registry

REGISTRY = query = Registry()


@query(f"""WITH {LABELLED}, t AS (SELECT reference AS r, prediction AS p FROM labelled WHERE reference IN ('A', 'N', 'R')), c AS (SELECT v, count(*) FILTER (s = 0) AS r, count(*) FILTER (s = 1) AS p FROM (SELECT r AS v, 0 AS s FROM t UNION ALL SELECT p, 1 FROM t) WHERE v IN ('A', 'N', 'R') GROUP BY v)
SELECT (SELECT count(*) FROM t) AS n, (SELECT count(*) FILTER (r = p) FROM t) AS correct, round((SELECT count(*) FILTER (r = p) / count(*)::DOUBLE FROM t), 6) AS accuracy, round(1 - 0.5 * sum(abs(r / (SELECT sum(r) FROM c) - p / (SELECT sum(p) FROM c))), 6) AS similarity FROM c""")
def a6_tone_types(spark, sf_dir):
    """How often the manner of sounding is right where the reference has one, and how alike both sides' shares of manners are."""
    rows = labelled(spark, sf_dir).where(F.col("reference").isin("A", "N", "R"))
    right = F.count_if(F.col("reference") == F.col("prediction"))
    exact = rows.agg(F.count("*").alias("n"), right.alias("correct"), F.round(right / F.count("*"), 6).alias("accuracy"))
    alike = metrics.distribution_similarity(rows.select("reference", F.when(F.col("prediction").isin("A", "N", "R"), F.col("prediction")).alias("prediction")), "reference", "prediction")
    return exact.join(F.broadcast(alike.select(F.round("similarity", 6).alias("similarity"))), F.lit(True))  # one row each


@query(f"""WITH {LABELLED}, n AS (SELECT count(*) AS n FROM labelled), e AS (SELECT v, count(*) FILTER (s = 'p') AS p, count(*) FILTER (s = 'r') AS r FROM (SELECT unnest(list_distinct(prediction_set)) AS v, 'p' AS s FROM labelled UNION ALL SELECT unnest(list_distinct(reference_set)), 'r' FROM labelled) GROUP BY v
UNION ALL SELECT 'any', count(*) FILTER (len(prediction_set) > 0), count(*) FILTER (len(reference_set) > 0) FROM labelled) SELECT v AS technique, p AS prediction_events, r AS reference_events, round(p / n::DOUBLE, 6) AS prediction_rate, round(r / n::DOUBLE, 6) AS reference_rate, round((p - r) / n::DOUBLE, 6) AS rate_delta FROM e, n""")
def a7_incidence(spark, sf_dir):
    """How many events have each technique on either side, the rates and their differences, and the same for any technique at all."""
    rows = labelled(spark, sf_dir)
    counts, density = metrics.incidence(rows, "prediction_set", "reference_set")
    n = rows.agg(F.count("*").alias("n"))
    found = counts.unionByName(density).join(F.broadcast(n), F.lit(True))  # one row
    rate = lambda c: F.round(c / F.col("n"), 6)
    p, r = F.col("prediction_events"), F.col("reference_events")
    return found.select("technique", p, r, rate(p).alias("prediction_rate"), rate(r).alias("reference_rate"), rate(p - r).alias("rate_delta"))


@query(f"""WITH {LABELLED}, e AS (SELECT piece, CASE WHEN prediction IS NULL THEN NULL WHEN event % 2 = 0 THEN [cents, (cents * 7) % 90] ELSE [cents] END AS pairs FROM labelled),
x AS (SELECT piece, count(pairs) AS events, count(*) FILTER (list_max(pairs) <= 50) AS matched FROM e GROUP BY piece), y AS (SELECT piece, count(*) AS pairs, avg(c) AS mae FROM (SELECT piece, unnest(pairs) AS c FROM e) GROUP BY piece)
SELECT piece, events AS evaluable_events, coalesce(pairs, 0) AS evaluable_pairs, round(matched / nullif(events, 0)::DOUBLE, 6) AS accuracy, round(mae, 6) AS mae FROM x LEFT JOIN y USING (piece)""")
def a10_events_and_pairs(spark, sf_dir):
    """A10: accuracy over events, each matched if all its pairs are within 50 cents, and mean error over pairs."""
    pairs = F.when(F.col("prediction").isNotNull(), F.when(F.col("event") % 2 == 0, F.array("cents", (F.col("cents") * 7) % 90)).otherwise(F.array("cents")))
    rows = labelled(spark, sf_dir).select("piece", pairs.alias("pairs"))
    sums = F.aggregate(F.coalesce("pairs", F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, x: a + x)
    g = rows.groupBy("piece").agg(
        F.count("pairs").alias("evaluable_events"), F.coalesce(F.sum(F.when(F.col("pairs").isNotNull(), F.size("pairs"))), F.lit(0)).alias("evaluable_pairs"),
        F.count_if(F.array_max("pairs") <= 50).alias("matched"), F.sum(sums).alias("cents"),
    )
    return g.select("piece", "evaluable_events", "evaluable_pairs", F.round(metrics.ratio(F.col("matched"), F.col("evaluable_events")), 6).alias("accuracy"), F.round(metrics.ratio(F.col("cents"), F.col("evaluable_pairs")), 6).alias("mae"))


@query("""WITH l AS (SELECT user_id, arg_max(value > 50, (ts, event_id)) FILTER (event_type = 'purchase') AS warned FROM events GROUP BY user_id) SELECT count(*) AS phrases, count(*) FILTER (warned) AS warning_phrases, round(count(*) FILTER (warned) / count(*)::DOUBLE, 6) AS warning_rate FROM l""")
def a12_receipts(spark, sf_dir):
    """Phrases whose trace's last edit receipt holds a warning."""
    receipt = F.when(F.col("value") > 50, "plan :warning: pitch").otherwise("plan ok")
    name = F.when(F.col("event_type") == "purchase", "edit_plan").otherwise(F.col("event_type"))
    traces = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.struct("ts", "event_id", name.alias("name"), receipt.alias("text"))).alias("trace"))
    each = traces.select("user_id", F.explode_outer("trace").alias("t"))
    last = each.groupBy("user_id").agg(F.max_by(F.when(F.col("t.name") == "edit_plan", F.col("t.text")), F.when(F.col("t.name") == "edit_plan", F.struct("t.ts", "t.event_id"))).alias("text"))
    warned = F.count_if(F.coalesce(F.col("text").contains(":warning:"), F.lit(False)))
    return last.agg(F.count("*").alias("phrases"), warned.alias("warning_phrases"), F.round(warned / F.count("*"), 6).alias("warning_rate"))


@query(f"""WITH {LABELLED} SELECT piece, phrase, (piece IS NOT NULL)::BIGINT AS level, count(*) AS events, count(*) FILTER (reference = prediction) AS field_tp, sum(len(list_intersect(reference_set, prediction_set)))::BIGINT AS set_tp, count(*) FILTER (prediction IS NOT NULL AND cents <= 50) AS matched,
  count(prediction) AS evaluable, count(*) FILTER (warned) AS warnings, round(avg((len(list_filter(reference_set, lambda v: v <> 'yin')) > 0)::INT), 6) AS nonbasic FROM labelled GROUP BY GROUPING SETS ((), (piece, phrase))""")
def a13_levels(spark, sf_dir):
    """Field, set, pitch, warning and technique measures of the whole and of each phrase in one pass."""
    rich = F.exists("reference_set", lambda v: v != "yin").cast("int")
    measures = [
        F.count("*").alias("events"), F.count_if(F.col("reference") == F.col("prediction")).alias("field_tp"), F.sum(F.size(F.array_intersect("reference_set", "prediction_set"))).alias("set_tp"),
        F.count_if(F.col("prediction").isNotNull() & (F.col("cents") <= 50)).alias("matched"), F.count("prediction").alias("evaluable"), F.count_if("warned").alias("warnings"), F.round(F.avg(rich), 6).alias("nonbasic"),
    ]
    return metrics.by_levels(labelled(spark, sf_dir), ["piece", "phrase"], measures)


@query("""WITH t AS (SELECT lang, len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS n FROM documents), r AS (SELECT lang, n, row_number() OVER (PARTITION BY lang ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY lang) AS m FROM t),
p AS (SELECT lang, max(n) FILTER (i = round_even((m - 1) * 0.95::DOUBLE, 0)) AS preflight FROM r GROUP BY lang)
SELECT lang, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99, max(n)::BIGINT AS longest, any_value(preflight)::BIGINT AS preflight_p95,
  count(*) FILTER (n <= 128) AS upto_128, count(*) FILTER (n > 128 AND n <= 512) AS upto_512, count(*) FILTER (n > 512 AND n <= 2048) AS upto_2048, count(*) FILTER (n > 2048) AS longer FROM t JOIN p USING (lang) GROUP BY lang""")
def a17_length_report(spark, sf_dir):
    """Lengths in words: interpolated percentiles, fixed bins, and the percentile of the preflight, which is a value that stands there. Percentiles are
    taken from the counts of each length, so that a language's rows needn't meet in one task."""
    n = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\S+"), F.lit(0))).cast("long")
    counts = table(spark, sf_dir, "documents").select("lang", n.alias("n")).groupBy("lang", "n").agg(F.count("*").alias("c"))
    w = Window.partitionBy("lang").orderBy("n")
    total = F.sum("c").over(Window.partitionBy("lang"))
    r = counts.withColumn("below", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).withColumn("m", total)
    at = F.rint((F.col("m") - 1) * 0.95)
    q = F.percentile("n", [0.5, 0.9, 0.95, 0.99], F.col("c"))
    within = lambda low, high: F.sum(F.when((F.col("n") > low) & (F.col("n") <= high), F.col("c")).otherwise(0))
    g = r.groupBy("lang").agg(
        q.alias("q"), F.max("n").alias("longest"), F.max(F.when((F.col("below") <= at) & (at < F.col("below") + F.col("c")), F.col("n"))).alias("preflight_p95"),
        within(-1, 128).alias("upto_128"), within(128, 512).alias("upto_512"), within(512, 2048).alias("upto_2048"), within(2048, 1 << 40).alias("longer"),
    )
    return g.select("lang", *[F.round(F.col("q")[i], 6).alias(x) for i, x in enumerate(("p50", "p90", "p95", "p99"))], "longest", "preflight_p95", "upto_128", "upto_512", "upto_2048", "longer")


@query(f"""WITH {NOTES}, d AS (SELECT score, midi % 7 + 1 AS degree, count(*) AS n FROM notes WHERE NOT structural GROUP BY 1, 2)
SELECT score, (SELECT max(midi) - min(midi) FROM notes x WHERE x.score = d.score AND NOT structural)::INT AS pitch_range, sum(n)::BIGINT AS n_notes, '{{' || string_agg(degree || '=' || n, ', ' ORDER BY degree) || '}}' AS degrees FROM d GROUP BY score""")
def a18_melody(spark, sf_dir):
    """Range, notes and degrees of each melody."""
    n = notes(spark, sf_dir).where("NOT structural").select("score", "midi", (F.col("midi") % 7 + 1).alias("degree"))
    d = n.groupBy("score", "degree").agg(F.count("*").alias("n"), F.min("midi").alias("low"), F.max("midi").alias("high"))
    entries = F.sort_array(F.collect_list(F.struct("degree", "n")))
    told = F.concat(F.lit("{"), F.array_join(F.transform("e", lambda x: F.concat(x["degree"].cast("string"), F.lit("="), x["n"].cast("string"))), ", "), F.lit("}"))
    g = d.groupBy("score").agg((F.max("high") - F.min("low")).alias("pitch_range"), F.sum("n").alias("n_notes"), entries.alias("e"))
    return g.select("score", "pitch_range", "n_notes", told.alias("degrees"))


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type AS stage, CASE WHEN value > 60 THEN 'span' WHEN value > 30 THEN 'pitch' END AS code, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1 AS accepted FROM events)
SELECT stage, code, count(*) AS warnings, count(*) FILTER (accepted) AS in_accepted, count(DISTINCT user_id) AS scores FROM e WHERE code IS NOT NULL GROUP BY 1, 2""")
def a21_warning_distribution(spark, sf_dir):
    """Warnings by stage and code, and those of the plans that were accepted in the end."""
    code = F.when(F.col("value") > 60, "span").when(F.col("value") > 30, "pitch")
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("stage"), code.alias("code"))
    last = e.groupBy("user_id", "stage").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    marked = e.join(last, ["user_id", "stage"]).where("code IS NOT NULL")
    accepted = F.struct("ts", "event_id") == F.col("last")
    return marked.groupBy("stage", "code").agg(F.count("*").alias("warnings"), F.count_if(accepted).alias("in_accepted"), F.countDistinct("user_id").alias("scores"))


_SIM = "round(list_dot_product(q.e, a.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(a.e, a.e))), 9)"
_ALL = "a AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS query_id, label, e FROM a WHERE vec_id % 100 = 0)"


@query(f"""WITH {_ALL}, s AS (SELECT q.query_id, a.vec_id, {_SIM} AS sim, q.label = a.label AS hit FROM q JOIN a ON q.query_id <> a.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s),
f AS (SELECT query_id, count(*) FILTER (hit AND rank <= 10) AS tp, count(*) FILTER (hit) AS relevant, min(rank) FILTER (hit AND rank <= 10) AS first FROM r GROUP BY query_id)
SELECT query_id, round(tp / 10.0::DOUBLE, 6) AS precision, round(coalesce(tp / nullif(relevant, 0)::DOUBLE, 0), 6) AS recall, round(2.0::DOUBLE * tp / (10 + relevant), 6) AS f1, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr FROM f""")
def a24_retrieval(spark, sf_dir):
    """Precision, recall, F1 and reciprocal rank of the ten nearest vectors of each stated query (ids divisible by 100), its own label's being relevant."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    best = metrics.nearest(rows, "vec_id", "label", "embedding", 10)
    relevant = rows.groupBy("label").agg((F.count("*") - 1).alias("relevant"))
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    hit = F.col("same")
    g = best.join(asked, "query_id").groupBy("query_id", "wanted").agg(F.count_if(hit).alias("tp"), F.min(F.when(hit, F.col("rank"))).alias("first")).join(relevant.withColumnRenamed("label", "wanted"), "wanted")
    return g.select(
        "query_id", F.round(F.col("tp") / 10.0, 6).alias("precision"), F.round(F.coalesce(metrics.ratio(F.col("tp"), F.col("relevant")), F.lit(0.0)), 6).alias("recall"),
        F.round(2.0 * F.col("tp") / (10 + F.col("relevant")), 6).alias("f1"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
    )


@query(f"""WITH {_ALL}, s AS (SELECT q.query_id, a.vec_id, {_SIM} AS sim FROM q JOIN a ON q.query_id <> a.vec_id AND q.label = a.label), f AS (SELECT query_id, 'filtered' AS kind, vec_id, sim AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 5),
h AS (SELECT q.query_id, a.vec_id, round(0.7::DOUBLE * {_SIM} + CASE WHEN q.label = a.label THEN 0.3::DOUBLE ELSE 0 END, 9) AS score FROM q JOIN a ON q.query_id <> a.vec_id)
SELECT * FROM f UNION ALL SELECT query_id, 'hybrid', vec_id, score FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""")
def s14_filtered_hybrid(spark, sf_dir):
    """The five nearest vectors of each stated query among those of its label, the filter coming first, and the five best by similarity and label together."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    five = lambda kind: metrics.nearest(rows, "vec_id", "label", "embedding", 5, kind).select("query_id", F.lit(kind).alias("kind"), "vec_id", "score")
    return five("filtered").unionByName(five("hybrid"))
