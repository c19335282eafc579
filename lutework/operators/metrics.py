"""Scoring of predicted against reference annotations, corpus-wide and by any keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def field_counts(reference: Column, prediction: Column) -> list[Column]:
    """n, correct, tp, fp, fn over rows with a reference: a wrong prediction counts as fp and fn, a missing one as fn only."""
    given, said = F.coalesce(reference, F.lit("")) != "", F.coalesce(prediction, F.lit("")) != ""
    right = given & said & (reference == prediction)
    return [
        F.count_if(given).alias("n"), F.count_if(right).alias("correct"), F.count_if(right).alias("tp"),
        F.count_if(given & said & ~right).alias("fp"), F.count_if(given & ~F.coalesce(right, F.lit(False))).alias("fn"),
    ]


def set_counts(reference: Column, prediction: Column) -> list[Column]:
    """tp, fp, fn of label sets; events without labels on both sides aren't counted."""
    r, p = F.array_distinct(reference), F.array_distinct(prediction)
    return [
        F.count_if((F.size(r) > 0) | (F.size(p) > 0)).alias("n"),
        F.sum(F.size(F.array_intersect(r, p))).alias("tp"), F.sum(F.size(F.array_except(p, r))).alias("fp"), F.sum(F.size(F.array_except(r, p))).alias("fn"),
    ]


def rates(df: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to counts tp, fp, fn; each null where it has no denominator."""
    return (
        df.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
        .withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
        .withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    )


def by_levels(df: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """The same aggregates over all rows and by the keys, in one pass of grouping sets; level is 0 for the whole."""
    grouped = df.groupingSets([[], [F.col(k) for k in keys]], *[F.col(k) for k in keys]).agg((F.lit(1) - F.grouping(keys[0])).cast("long").alias("level"), *aggregates)
    return grouped


def distribution_similarity(df: DataFrame, reference: str, prediction: str) -> DataFrame:
    """1 - half the summed difference of the two columns' value distributions."""
    both = df.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(reference).alias("v")), F.struct(F.lit(1).alias("side"), F.col(prediction).alias("v")))).alias("x"))
    counts = both.where("x.v IS NOT NULL").groupBy("x.v").agg(F.count_if(F.col("x.side") == 0).alias("r"), F.count_if(F.col("x.side") == 1).alias("p"))
    # a row per label of the vocabulary
    sums = counts.agg(F.collect_list(F.struct("r", "p")).alias("rows"), F.sum("r").alias("nr"), F.sum("p").alias("np"))
    gap = F.aggregate("rows", F.lit(0.0), lambda a, x: a + F.abs(x["r"] / F.col("nr") - x["p"] / F.col("np")))
    return sums.select(F.col("nr").alias("n_reference"), F.col("np").alias("n_prediction"), (1 - 0.5 * gap).alias("similarity"))


def label_usage(df: DataFrame, labels: str, keys: list[str]) -> DataFrame:
    """Of exploded distinct labels, per key: events, mass, labels in use, entropy and its exponential, Simpson diversity."""
    events = df.groupBy(*keys).agg(F.count("*").alias("n_events"))
    counts = df.select(*keys, F.explode(F.array_distinct(labels)).alias("label")).groupBy(*keys, "label").agg(F.count("*").alias("n"))
    mass = counts.groupBy(*keys).agg(F.sum("n").alias("mass"), F.count("*").alias("n_labels"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    out = events.join(mass, keys, "left")
    entropy = F.log(F.col("mass")) - F.col("nlogn") / F.col("mass")
    return out.select(
        *keys, "n_events", F.coalesce("mass", F.lit(0)).alias("mass"), F.coalesce("n_labels", F.lit(0)).alias("n_labels"),
        entropy.alias("entropy"), F.exp(entropy).alias("effective_labels"), (1 - F.col("nn") / (F.col("mass") * F.col("mass"))).alias("simpson"),
    )


def distribution(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Count, mean and exact linearly interpolated quantiles."""
    q = F.percentile(value, [0.1, 0.25, 0.5, 0.75, 0.9])
    names = ["p10", "p25", "median", "p75", "p90"]
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), q.alias("q")).select(*keys, "n", "mean", *[F.col("q")[i].alias(x) for i, x in enumerate(names)])


def composite(parts: dict[str, float], neutral: float = 0.5) -> Column:
    """The weighted mean of the parts that aren't null; neutral where none is."""
    total = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in parts.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in parts.items()), F.lit(0.0))
    return F.coalesce(F.try_divide(value, total), F.lit(neutral))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def incidence(df: DataFrame, prediction: str, reference: str) -> tuple[DataFrame, DataFrame]:
    """technique, prediction_events and reference_events: events that have a label, once each, on either side; and the same for any label."""
    sides = F.explode(F.array(F.struct(F.lit(1).alias("p"), F.array_distinct(prediction).alias("labels")), F.struct(F.lit(0).alias("p"), F.array_distinct(reference).alias("labels")))).alias("s")
    each = df.select(sides).select("s.p", F.explode("s.labels").alias("technique"))
    counts = each.groupBy("technique").agg(F.count_if(F.col("p") == 1).alias("prediction_events"), F.count_if(F.col("p") == 0).alias("reference_events"))
    some = lambda c: F.count_if(F.size(c) > 0)
    return counts, df.agg(F.lit("any").alias("technique"), some(prediction).alias("prediction_events"), some(reference).alias("reference_events"))


#: Bytes of a block of stated queries, which goes to where the rows are.
BLOCK_BYTES = 16 << 20
#: Scores that a task holds at a time, of some queries and so many rows of a batch at most.
TILE_SCORES, TILE_ROWS = 1 << 19, 1024


def nearest(rows: DataFrame, key: str, label: str, vector: str, k: int, kind: str = "all") -> DataFrame:
    """Of each stated query, a row whose key is divisible by 100, its k best other rows: query_id, key, score (nine digits), same (whether their labels are equal) and rank, ties to the smaller key.
    The score is the cosine; of kind filtered only rows of the query's label are looked at, and of kind hybrid it is 0.7 of the cosine and 0.3 for an equal label.

    The queries are taken in blocks of BLOCK_BYTES, each broadcast; a task multiplies its batches with a block and keeps k rows a query, so that no row is copied or moved, and what meets for a query is k
    rows from each task. Every query meets every row. Rows without a vector, or with one of zeros, are in no result; null labels are equal to none."""
    spark = rows.sparkSession
    asked = rows.where((F.col(key) % 100 == 0) & F.col(vector).isNotNull()).select(F.col(key).alias("q"), F.col(label).cast("string").alias("l"), F.col(vector).cast("array<double>").alias("v"))
    size = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    n_blocks = max(1, -(-size[0] * 8 * (size[1] or 1) // BLOCK_BYTES))
    narrow = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(label).cast("string").alias("l"), F.col(vector).cast("array<double>").alias("v"))
    found = None
    for b in range(n_blocks):
        block = asked.where(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == b).collect()  # BLOCK_BYTES of vectors, or so
        if block:
            sent = spark.sparkContext.broadcast(([x["q"] for x in block], [x["l"] for x in block], np.array([x["v"] for x in block])))
            own = narrow.mapInArrow(_met(sent, k, kind), "query_id bigint, key bigint, score double, same boolean")
            found = own if found is None else found.unionByName(own)
    if found is None:
        return spark.createDataFrame([], f"query_id bigint, `{key}` bigint, score double, same boolean, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.withColumnRenamed("key", key)


def _met(sent, k: int, kind: str):
    """Of rows (key, l, v), the k best of each query of a block, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, labels, matrix = sent.value
        queries, labels = np.array(queries, np.int64), np.array(labels, object)
        norms = np.linalg.norm(matrix, axis=1)
        score = np.full((len(queries), k), -np.inf)
        keys, same = np.full((len(queries), k), np.iinfo(np.int64).max), np.zeros((len(queries), k), bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            own, names = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object)
            for at in range(0, batch.num_rows, TILE_ROWS):
                some = slice(at, at + TILE_ROWS)
                part, called = own[some], names[some]
                vectors = np.array(batch.column(2)[some].to_pylist(), float)
                lengths = np.linalg.norm(vectors, axis=1)[None]
                step = max(1, TILE_SCORES // len(part))
                for first in range(0, len(queries), step):
                    q = slice(first, first + step)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        cosine_ = np.round(matrix[q] @ vectors.T / (norms[q, None] * lengths), 9)
                    equal = (labels[q, None] == called[None]) & (called != None)[None]  # noqa: E711
                    value = np.round(0.7 * cosine_ + 0.3 * equal, 9) if kind == "hybrid" else cosine_
                    value[np.isnan(cosine_) | (queries[q, None] == part[None]) | (~equal if kind == "filtered" else False)] = -np.inf
                    both, whose, hit = (np.concatenate(x, axis=1) for x in ((score[q], value), (keys[q], np.broadcast_to(part, value.shape)), (same[q], equal)))
                    order = np.lexsort((whose, -both), axis=1)[:, :k]
                    score[q], keys[q], same[q] = (np.take_along_axis(x, order, axis=1) for x in (both, whose, hit))
        q, at = np.nonzero(np.isfinite(score))
        yield pa.RecordBatch.from_arrays([pa.array(queries[q]), pa.array(keys[q, at]), pa.array(score[q, at]), pa.array(same[q, at])], ["query_id", "key", "score", "same"])

    return run
