"""Positions on the strings whose pitch lies near a target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import music
from .ordered import top_k


def position_grid(spark: SparkSession, open_midi: list[float], modes: tuple[str, ...] = ("open", "stopped", "harmonic")) -> DataFrame:
    """Every position of the instrument: string, mode, hui, label and midi. A few hundred rows whatever the data."""
    strings = spark.range(1, len(open_midi) + 1).select(F.col("id").cast("int").alias("string"), F.get(F.array(*[F.lit(float(x)) for x in open_midi]), F.col("id").cast("int") - 1).alias("opened"))
    none, word = F.lit(None).cast("double"), F.lit(None).cast("string")
    place = lambda mode, hui, label: F.struct(F.lit(mode).alias("mode"), hui.alias("hui"), label.alias("label"))
    kinds = {
        "open": F.array(place("open", none, word)),
        "harmonic": F.transform(F.sequence(F.lit(1), F.lit(13)), lambda h: place("harmonic", h.cast("double"), word)),
        "stopped": F.concat(
            F.transform(F.sequence(F.lit(10), F.lit(130)), lambda h: place("stopped", h / 10, word)),
            F.array(*[place("stopped", F.lit(music.OUTSIDE_ANCHOR), F.lit(x)) for x in music.OUTSIDE_DROP]),
        ),
    }
    grid = strings.select("string", "opened", F.explode(F.concat(*[kinds[m] for m in modes])).alias("p")).select("string", "opened", "p.*")
    return grid.withColumn("midi", music.position_pitch(F.col("opened"), F.col("hui"), F.col("label"), F.col("mode"))).drop("opened")


def near_positions(targets: DataFrame, grid: DataFrame, cents: float = 35.0) -> DataFrame:
    """Of distinct targets (target), the grid's positions within so many cents: an equi-join on semitone buckets, the grid, which is of
    fixed size, being broadcast into the buckets that its tolerance touches."""
    wide = cents / 100
    buckets = F.array_distinct(F.array(F.floor(F.col("midi") - wide), F.floor(F.col("midi") + wide)))
    placed = grid.select("*", F.explode(buckets).alias("bucket"))
    joined = targets.withColumn("bucket", F.floor("target")).join(F.broadcast(placed), "bucket").drop("bucket")
    error = (F.col("midi") - F.col("target")) * 100
    return joined.withColumn("cents", error).where(F.abs("cents") <= cents)


def ranked_positions(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best positions: nearest first, open strings first among equals, then the mildest region, string and stud."""
    cost = music.tone_region_cost(F.col("hui"), F.col("mode"))
    order = [F.round(F.abs("cents"), 3), F.when(F.col("mode") == "open", 0).otherwise(1), F.col("region_cost"), F.col("string"), F.coalesce("hui", F.lit(0.0)), F.coalesce("label", F.lit(""))]
    return top_k(found.withColumn("region_cost", cost), keys, order, k)


def best_positions(notes: DataFrame, target: Column, grid: DataFrame, k: int = 3, cents: float = 35.0) -> DataFrame:
    """notes with their k best positions. Candidates are sought once for each distinct target."""
    marked = notes.withColumn("target", target.cast("double"))
    distinct = marked.select("target").where("target IS NOT NULL").distinct()
    return marked.join(ranked_positions(near_positions(distinct, grid, cents), ["target"], k), "target")
