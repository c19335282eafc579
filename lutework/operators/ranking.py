"""Choices among candidates: routes merged over phrases, frontiers, and rankers that are fitted without what they rank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import written


def merged_routes(phrases: DataFrame, key: str, order: str, routes: str, move: Callable[[Column, Column], Column]) -> DataFrame:
    """Of phrases (key, order, routes: an array of (cost, entry, leave)), per key the ranks (from 1) of the routes, one of each phrase, that cost least
    together with the moves between them, and the cost: a fold over the phrases that keeps the best way to each route of the last one. Of ways of
    equal cost the one with the smaller ranks stays. A key's phrases are one row; their number bounds it."""
    whole = phrases.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(routes).alias("r")))).alias("p"))
    first = F.transform(F.get("p", 0)["r"], lambda r, i: F.struct(r["cost"].alias("cost"), F.array(i + 1).alias("ranks"), r["leave"].alias("leave")))

    def step(states: Column, phrase: Column) -> Column:
        def best(r: Column, i: Column) -> Column:
            ways = F.transform(states, lambda s: F.struct((s["cost"] + r["cost"] + move(s["leave"], r["entry"])).alias("cost"), F.concat(s["ranks"], F.array(i + 1)).alias("ranks")))
            way = F.array_min(ways)
            return F.struct(way["cost"].alias("cost"), way["ranks"].alias("ranks"), r["leave"].alias("leave"))

        return F.transform(phrase["r"], best)

    last = F.aggregate(F.slice("p", F.lit(2), F.size("p")), first, step)
    found = whole.select(key, F.array_min(F.transform(last, lambda s: F.struct(s["cost"].alias("cost"), s["ranks"].alias("ranks")))).alias("x"))
    return found.select(key, "x.cost", "x.ranks")


def leaders(scores: DataFrame) -> DataFrame:
    """Of (prog, key, score) the candidates with the greatest score of each key, ties kept."""
    best = scores.groupBy("key").agg(F.max("score").alias("score"))
    return scores.join(best, ["key", "score"]).select("key", "prog")


def undominated(fronts: DataFrame, scores: DataFrame) -> DataFrame:
    """Of fronts (key, prog) and scores (prog, score), each key's front without dominated candidates: those for whom every front that they stand on has
    another one that is left. The lowest score is tried first, then the smaller prog. Whoever isn't dominated stays so when others go, so that one
    pass does; it needs all fronts at once, the candidates that lead anything, which the choice is made among anyway."""
    grouped = fronts.groupBy("key").agg(F.collect_set("prog").alias("progs"))
    order = fronts.select("prog").distinct().join(scores, "prog")
    everything = grouped.agg(F.collect_list("progs").alias("fronts")).join(order.agg(F.sort_array(F.collect_list(F.struct("score", "prog"))).alias("order")), F.lit(True))

    def step(out: Column, x: Column) -> Column:
        with_it = F.array_append(out, x["prog"])
        own = F.filter("fronts", lambda f: F.array_contains(f, x["prog"]))
        return F.when(F.forall(own, lambda f: F.size(F.array_except(f, with_it)) > 0), with_it).otherwise(out)

    removed = everything.select(F.aggregate("order", F.array().cast("array<bigint>"), step).alias("gone"))
    return grouped.join(removed, F.lit(True)).select("key", F.array_except("progs", "gone").alias("front"))


def folded_ranks(rows: DataFrame, folds: int, seed: int = 0) -> DataFrame:
    """Of rows (id, family, k, label, features) the fold and rank of each id's true candidate, scored by a logistic regression over standardised features,
    classes weighted alike, that was fitted without the fold of the id's family. Rows alike are fitted as one with the weight of all; the scales are those of
    the rows one by one, which weights would change."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = rows.withColumn("fold", F.pmod(F.xxhash64("family", F.lit(seed)), F.lit(folds)).cast("int"))
    alike = written(rows.groupBy("fold", "label", "features").agg(F.count("*").alias("n")), "alike")
    models = []
    for fold in range(folds):
        train = alike.where(F.col("fold") != fold)
        share = train.agg(F.sum(F.col("label") * F.col("n")) / F.sum("n")).first()[0] or 0.5
        w = F.when(F.col("label") == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9))
        # mean and deviation of each feature, and its deviation among weighted rows, in which the penalty is measured
        each = train.withColumn("w", w).select("n", "w", F.posexplode("features").alias("i", "x"))
        n, x, total = F.col("n"), F.col("x"), F.sum(F.col("w") * F.col("n"))
        means = each.groupBy("i").agg(F.sum(n).alias("rows"), (F.sum(n * x) / F.sum(n)).alias("mean"), (F.sum(F.col("w") * n * x) / total).alias("wmean"))
        off = lambda m: (x - F.col(m)) * (x - F.col(m))
        spread = each.join(F.broadcast(means), "i").groupBy("i", "mean").agg(
            F.sqrt(F.try_divide(F.sum(n * off("mean")), F.max("rows") - 1)).alias("sd"),
            F.sqrt(F.try_divide(F.sum(F.col("w") * n * off("wmean")), total - F.sum(F.col("w") * F.col("w") * n) / total)).alias("wsd"),
        )
        scales = [(r["mean"], r["wsd"] if r["sd"] and r["wsd"] else 0.0) for r in spread.orderBy("i").collect()]  # a row per feature
        scaled = F.array(*[(F.get("features", i) - m) / d if d else F.lit(0.0) for i, (m, d) in enumerate(scales)])
        weighted = train.select("label", (w * n).alias("w"), array_to_vector(scaled).alias("x"))
        model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", maxIter=10, regParam=0.01, standardization=False).fit(weighted)
        slopes = [float(c) / d if d else 0.0 for c, (_, d) in zip(model.coefficients, scales, strict=True)]
        models.append((float(model.intercept) - sum(c * m for c, (m, _) in zip(slopes, scales, strict=True)), slopes))
    found = F.get(F.array(*[F.struct(F.lit(b).alias("b"), F.array(*[F.lit(c) for c in slopes]).alias("c")) for b, slopes in models]), F.col("fold"))
    margin = F.aggregate(F.zip_with("features", found["c"], lambda x, c: x * c), found["b"], lambda a, y: a + y)
    scored = rows.withColumn("p", 1 / (1 + F.exp(-margin)))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("fold", "id").orderBy(F.desc("p"), "k"))).where("label = 1").select("fold", "id", "rank")
