"""Scoring queries: predictions against references, corpus-wide and by piece."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.ordered import latest
from .adapters import LABELLED, labelled, table
from .registry import Registry

REGISTRY = query = Registry()
BASIC = ["yin"]
_R6 = "round({}, 6)".format

FIELD = """count(*) FILTER (reference IS NOT NULL) AS n, count(*) FILTER (reference = prediction) AS correct, count(*) FILTER (reference = prediction) AS tp,
  count(*) FILTER (reference <> prediction) AS fp, count(*) FILTER (reference IS NOT NULL AND (prediction IS NULL OR reference <> prediction)) AS fn"""
RATES = """round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1"""


def _rounded(df, names=("precision", "recall", "f1")):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


@query(f"WITH {LABELLED}, c AS (SELECT piece, {FIELD} FROM labelled GROUP BY piece) SELECT *, {RATES} FROM c")
def a2_field_rates(spark, sf_dir):
    """A2 and A3: counts and rates of a field, by piece."""
    counts = labelled(spark, sf_dir).groupBy("piece").agg(*metrics.field_counts(F.col("reference"), F.col("prediction")))
    return _rounded(metrics.rates(counts))


_SETS = """count(*) FILTER (len(reference_set) > 0 OR len(prediction_set) > 0) AS n, sum(len(list_intersect(reference_set, prediction_set)))::BIGINT AS tp,
  sum(len(list_filter(prediction_set, lambda v: NOT list_contains(reference_set, v))))::BIGINT AS fp, sum(len(list_filter(reference_set, lambda v: NOT list_contains(prediction_set, v))))::BIGINT AS fn"""


@query(f"WITH {LABELLED}, c AS (SELECT piece, phrase, {_SETS} FROM labelled GROUP BY GROUPING SETS ((), (piece, phrase))) SELECT piece, phrase, (piece IS NOT NULL)::BIGINT AS level, n, tp, fp, fn, {RATES} FROM c")
def a4_a13_set_rates(spark, sf_dir):
    """Label-set scores of the whole and of each phrase, in one pass of grouping sets."""
    found = metrics.by_levels(labelled(spark, sf_dir), ["piece", "phrase"], metrics.set_counts(F.col("reference_set"), F.col("prediction_set")))
    return _rounded(metrics.rates(found))


@query(f"""WITH {LABELLED}, e AS (SELECT piece, count(*) AS n_events FROM labelled GROUP BY piece),
c AS (SELECT piece, v, count(*) AS n FROM (SELECT piece, unnest(prediction_set) AS v FROM labelled) GROUP BY piece, v),
m AS (SELECT piece, sum(n) AS mass, count(*) AS n_labels, sum(n * ln(n)) AS nlogn, sum(n * n) AS nn FROM c GROUP BY piece)
SELECT piece, n_events, coalesce(mass, 0)::BIGINT AS mass, coalesce(n_labels, 0) AS n_labels, round(ln(mass) - nlogn / mass, 6) AS entropy, round(exp(ln(mass) - nlogn / mass), 6) AS effective_labels, round(1 - nn / (mass * mass), 6) AS simpson FROM e LEFT JOIN m USING (piece)""")
def a7_technique_usage(spark, sf_dir):
    """Label usage, entropy and diversity, by piece."""
    return _rounded(metrics.label_usage(labelled(spark, sf_dir), "prediction_set", ["piece"]), ("entropy", "effective_labels", "simpson"))


@query(f"""WITH {LABELLED} SELECT piece, round(avg((len(list_filter(reference_set, lambda v: v <> 'yin')) > 0)::INT), 6) AS reference_rate,
  round(avg((len(list_filter(prediction_set, lambda v: v <> 'yin')) > 0)::INT) FILTER (NOT warned), 6) AS prediction_rate FROM labelled GROUP BY piece""")
def a8_nonbasic_rate(spark, sf_dir):
    """Rate of events with more than basic labels, warned events left out on the prediction side."""
    rich = lambda c: F.exists(c, lambda v: ~v.isin(*BASIC)).cast("int")
    rows = labelled(spark, sf_dir).groupBy("piece").agg(F.avg(rich("reference_set")).alias("reference_rate"), F.avg(F.when(~F.col("warned"), rich("prediction_set"))).alias("prediction_rate"))
    return _rounded(rows, ("reference_rate", "prediction_rate"))


@query(f"""WITH {LABELLED}, x AS (SELECT piece, v, sum(1.0::DOUBLE / len(prediction_set)) AS m FROM (SELECT piece, prediction_set, unnest(prediction_set) AS v FROM labelled) GROUP BY piece, v),
d AS (SELECT piece, 1 - sum(m * m) / (sum(m) * sum(m)) AS simpson FROM x GROUP BY piece), n AS (SELECT piece, count(*) AS n, avg((len(list_filter(prediction_set, lambda v: v <> 'yin')) > 0)::INT) AS rate FROM labelled GROUP BY piece)
SELECT round(sum(n * rate * coalesce(simpson, 0)) / sum(n), 6) AS adjusted, sum(n)::BIGINT AS n_events, count(*) AS n_pieces FROM n LEFT JOIN d USING (piece)""")
def a9_adjusted_rate(spark, sf_dir):
    """The non-basic rate weighted by each piece's diversity of fractional label mass."""
    rows = labelled(spark, sf_dir)
    mass = rows.select("piece", (F.lit(1.0) / F.size("prediction_set")).alias("w"), F.explode("prediction_set").alias("v")).groupBy("piece", "v").agg(F.sum("w").alias("m"))
    simpson = mass.groupBy("piece").agg((1 - F.sum(F.col("m") * F.col("m")) / (F.sum("m") * F.sum("m"))).alias("simpson"))
    rate = F.avg(F.exists("prediction_set", lambda v: ~v.isin(*BASIC)).cast("int"))
    each = rows.groupBy("piece").agg(F.count("*").alias("n"), rate.alias("rate")).join(simpson, "piece", "left")
    return each.agg(F.round(F.sum(F.col("n") * F.col("rate") * F.coalesce("simpson", F.lit(0.0))) / F.sum("n"), 6).alias("adjusted"), F.sum("n").alias("n_events"), F.count("*").alias("n_pieces"))


@query(f"WITH {LABELLED} SELECT reference AS code, count(*) AS n, count(DISTINCT (piece, phrase)) AS n_phrases, count(DISTINCT piece) AS n_pieces FROM labelled WHERE warned GROUP BY reference")
def a11_warning_stats(spark, sf_dir):
    """Warnings by code, and the phrases and pieces that have them."""
    rows = labelled(spark, sf_dir).where("warned").groupBy(F.col("reference").alias("code"))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("piece", "phrase").alias("n_phrases"), F.countDistinct("piece").alias("n_pieces"))


@query("""WITH s AS (SELECT o_custkey AS k, count(*) AS n, sum(o_totalprice) AS total, avg((o_orderstatus = 'F')::INT) AS done FROM orders GROUP BY o_custkey)
SELECT k, n, round(total, 2) AS total, round(done, 6) AS done, round(coalesce((0.5::DOUBLE * done + 0.3::DOUBLE * (n / 20.0::DOUBLE) + CASE WHEN total > 1000000 THEN 0.2::DOUBLE ELSE 0 END) / (0.8::DOUBLE + CASE WHEN total > 1000000 THEN 0.2::DOUBLE ELSE 0 END), 0.5), 6) AS composite FROM s""")
def a14_a25_composite(spark, sf_dir):
    """Metrics of a score and their mean over the weights that apply."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("done"))
    rows = rows.withColumn("size", F.col("n") / 20.0).withColumn("large", F.when(F.col("total") > 1000000, F.lit(1.0)))
    return rows.select("k", "n", F.round("total", 2).alias("total"), F.round("done", 6).alias("done"), F.round(metrics.composite({"done": 0.5, "size": 0.3, "large": 0.2}), 6).alias("composite"))


@query("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS median,
  round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type""")
def a16_distribution(spark, sf_dir):
    """Exact linearly interpolated quantiles."""
    return _rounded(metrics.distribution(table(spark, sf_dir, "events"), "value", ["event_type"]), ("mean", "p10", "p25", "median", "p75", "p90"))


@query("""SELECT o_orderpriority AS arm, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS protocol_ok, round(avg(o_totalprice), 4) AS mean_score, round(count(*) FILTER (o_totalprice > 100000) / count(*), 6) AS coverage FROM orders GROUP BY o_orderpriority""")
def a19_arm_summary(spark, sf_dir):
    """What each arm reached."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("arm"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("protocol_ok"), F.round(F.avg("o_totalprice"), 4).alias("mean_score"), F.round(F.count_if(F.col("o_totalprice") > 100000) / F.count("*"), 6).alias("coverage"))


@query("""WITH r AS (SELECT l_orderkey AS k, max(l_returnflag) AS r FROM lineitem WHERE l_linenumber >= 5 GROUP BY 1), p AS (SELECT o_orderkey AS k, max(CASE o_orderstatus WHEN 'F' THEN 'R' ELSE 'N' END) AS p FROM orders GROUP BY 1)
SELECT count(*) AS n_cells, count(*) FILTER (coalesce(r, '') = coalesce(p, '')) AS exact, count(*) FILTER (r IS NULL) AS only_prediction, count(*) FILTER (p IS NULL) AS only_reference, round(count(*) FILTER (coalesce(r, '') = coalesce(p, '')) / count(*), 6) AS rate FROM r FULL JOIN p USING (k)""")
def j3_a20_exact_cells(spark, sf_dir):
    """Exact cells over the union of both sides' keys."""
    r = table(spark, sf_dir, "lineitem").where("l_linenumber >= 5").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_returnflag").alias("r"))
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("k")).agg(F.max(F.when(F.col("o_orderstatus") == "F", "R").otherwise("N")).alias("p"))
    same = F.coalesce("r", F.lit("")) == F.coalesce("p", F.lit(""))
    both = r.join(p, "k", "outer")
    return both.agg(F.count("*").alias("n_cells"), F.count_if(same).alias("exact"), F.count_if(F.col("r").isNull()).alias("only_prediction"), F.count_if(F.col("p").isNull()).alias("only_reference"), F.round(F.count_if(same) / F.count("*"), 6).alias("rate"))


@query("""WITH x AS (SELECT c_mktsegment AS split, CASE WHEN c_acctbal < 0 THEN '<0' WHEN c_acctbal < 2500 THEN '0-2500' WHEN c_acctbal < 5000 THEN '2500-5000' ELSE '>=5000' END AS bucket FROM customer)
SELECT split, bucket, count(*) AS n FROM x GROUP BY split, bucket""")
def a23_histogram(spark, sf_dir):
    """A23 and F-num2: half-open buckets by split."""
    b = F.col("c_acctbal")
    bucket = F.when(b < 0, "<0").when(b < 2500, "0-2500").when(b < 5000, "2500-5000").otherwise(">=5000")
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("split"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, map_from_entries(list((event_type, n) ORDER BY event_type))::VARCHAR AS codes FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id""")
def a18_a27_histogram_map(spark, sf_dir):
    """Counts by code as one map, in the order of the codes."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    entries = F.sort_array(F.collect_list(F.struct("event_type", "n")))
    text = F.concat(F.lit("{"), F.array_join(F.transform("e", lambda x: F.concat(x["event_type"], F.lit("="), x["n"].cast("string"))), ", "), F.lit("}"))
    return counts.groupBy("user_id").agg(entries.alias("e")).select("user_id", text.alias("codes"))


@query("""SELECT o_orderpriority AS arm, round(100 * (sum(o_totalprice) * 0.0003::DOUBLE + count(*) * 0.02::DOUBLE) / count(DISTINCT o_custkey), 4) AS cost_per_100 FROM orders GROUP BY 1""")
def a26_cost(spark, sf_dir):
    """Cost of 100 units from sums and rates."""
    cost = 100 * (F.sum("o_totalprice") * 0.0003 + F.count("*") * 0.02) / F.countDistinct("o_custkey")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("arm")).agg(F.round(cost, 4).alias("cost_per_100"))


@query("""WITH q AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), a AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, a.vec_id, q.label = a.label AS hit, round(list_dot_product(q.e, a.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(a.e, a.e))), 9) AS sim FROM q JOIN a ON q.vec_id <> a.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s)
SELECT query_id, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / 10.0::DOUBLE, 6) AS precision, round(coalesce(1.0::DOUBLE / min(rank) FILTER (hit), 0), 6) AS mrr, round(max(sim), 6) AS best FROM r WHERE rank <= 10 GROUP BY query_id""")
def k10_a24_vector_search(spark, sf_dir):
    """The ten nearest vectors of each stated query (ids divisible by 100) among all, and how well they hit."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    best = metrics.nearest(rows, "vec_id", "label", "embedding", 10).withColumnsRenamed({"same": "hit", "score": "sim"})
    return best.groupBy("query_id").agg(
        F.count_if("hit").alias("hits"), F.round(F.count_if("hit") / 10.0, 6).alias("precision"), F.round(F.coalesce(1.0 / F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0.0)), 6).alias("mrr"), F.round(F.max("sim"), 6).alias("best")
    )


@query("""SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def a1_latest(spark, sf_dir):
    """The last row of each key wins."""
    return latest(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query(f"""WITH {LABELLED}, c AS (SELECT v, count(*) FILTER (s = 0) AS r, count(*) FILTER (s = 1) AS p FROM (SELECT reference AS v, 0 AS s FROM labelled UNION ALL SELECT prediction, 1 FROM labelled) WHERE v IS NOT NULL GROUP BY v)
SELECT sum(r)::BIGINT AS n_reference, sum(p)::BIGINT AS n_prediction, round(1 - 0.5 * sum(abs(r / (SELECT sum(r) FROM c) - p / (SELECT sum(p) FROM c))), 6) AS similarity FROM c""")
def a6_tone_similarity(spark, sf_dir):
    """Similarity of the label distributions."""
    return _rounded(metrics.distribution_similarity(labelled(spark, sf_dir), "reference", "prediction"), ("similarity",))


@query(f"""WITH {LABELLED} SELECT piece, count(*) AS n_pairs, count(*) FILTER (cents <= 50) AS matched, round(count(*) FILTER (cents <= 50) / count(*), 6) AS accuracy, round(avg(cents), 6) AS mae FROM labelled WHERE prediction IS NOT NULL GROUP BY piece""")
def a10_pitch_accuracy(spark, sf_dir):
    """A10: accuracy at 50 cents and mean error over resolvable events."""
    rows = labelled(spark, sf_dir).where("prediction IS NOT NULL").groupBy("piece")
    return rows.agg(
        F.count("*").alias("n_pairs"), F.count_if(F.col("cents") <= 50).alias("matched"), F.round(F.count_if(F.col("cents") <= 50) / F.count("*"), 6).alias("accuracy"), F.round(F.avg("cents"), 6).alias("mae")
    )


@query("""WITH t AS (SELECT lang, len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS n FROM documents)
SELECT lang, count(*) AS n, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.95), 6) AS p95, max(n)::BIGINT AS longest, count(*) FILTER (n < 128) AS under_128, count(*) FILTER (n >= 128 AND n < 512) AS under_512, count(*) FILTER (n >= 512) AS longer FROM t GROUP BY lang""")
def a17_token_lengths(spark, sf_dir):
    """Token-length percentiles and fixed bins."""
    n = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\S+"), F.lit(0)))
    rows = table(spark, sf_dir, "documents").select("lang", n.alias("n")).groupBy("lang")
    return rows.agg(
        F.count("*").alias("n"), F.round(F.percentile("n", 0.5), 6).alias("p50"), F.round(F.percentile("n", 0.95), 6).alias("p95"), F.max("n").cast("long").alias("longest"),
        F.count_if(F.col("n") < 128).alias("under_128"), F.count_if(F.col("n").between(128, 511)).alias("under_512"), F.count_if(F.col("n") >= 512).alias("longer"),
    )


@query("""WITH l AS (SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT event_type, count(*) AS n_traces, count(*) FILTER (value > 50) AS warned FROM l GROUP BY event_type""")
def a12_last_receipts(spark, sf_dir):
    """What each trace's last receipt says."""
    last = latest(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"])
    return last.groupBy("event_type").agg(F.count("*").alias("n_traces"), F.count_if(F.col("value") > 50).alias("warned"))
