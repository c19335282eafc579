"""Notation tables derived from the star schema, and the same derivations as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score, idx, midi, structural, mark and duration of each line item, its order being the score."""
    w = Window.partitionBy("score").orderBy(*LINE_ORDER)  # by the name that the queries group by, so that rows are dealt once
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "score").select(
        "score", (F.row_number().over(w) - 1).alias("idx"), (48 + F.col("l_quantity").cast("int") % 24).alias("midi"), F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"), (F.col("l_discount") * 100).cast("int").alias("d"),
    )
    return rows.withColumn("structural", (F.col("flag") == "A") & (F.col("idx") % 4 == 3))


NOTES = """notes AS (SELECT *, flag = 'A' AND idx % 4 = 3 AS structural FROM (SELECT l_orderkey AS score, (row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1)::INT AS idx, (48 + trunc(l_quantity)::INT % 24)::INT AS midi, l_returnflag AS flag,
  l_linestatus AS status, trunc(l_discount * 100)::INT AS d FROM lineitem))"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference and prediction of each line item: a label and a set of labels on either side, by piece and phrase."""
    q = F.col("l_quantity").cast("int")
    d, t = F.round(F.col("l_discount") * 100).cast("int"), F.round(F.col("l_tax") * 100).cast("int")
    sets = lambda *cases: F.filter(F.array(*[F.when(c, F.lit(x)) for c, x in cases]), lambda v: v.isNotNull())
    status = F.when(F.col("l_linestatus") == "F", "A").otherwise("N")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("piece"), F.col("l_linenumber").alias("phrase"), F.col("l_orderkey").alias("event"),
        F.when(q % 11 != 0, F.col("l_returnflag")).alias("reference"), F.when(q % 7 != 0, status).alias("prediction"),
        sets((q % 2 == 0, "yin"), (q % 3 == 0, "nao"), (q % 5 == 0, "zhuang")).alias("reference_set"), sets((d % 2 == 0, "yin"), (t % 3 == 0, "nao"), (d % 5 == 0, "zhuang")).alias("prediction_set"),
        (F.col("l_tax") * 1000).cast("int").alias("cents"), (q % 13 == 0).alias("warned"),
    )


LABELLED = """labelled AS (SELECT l_suppkey AS piece, l_linenumber AS phrase, l_orderkey AS event,
  CASE WHEN trunc(l_quantity)::INT % 11 <> 0 THEN l_returnflag END AS reference, CASE WHEN trunc(l_quantity)::INT % 7 <> 0 THEN CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'N' END END AS prediction,
  list_filter([CASE WHEN trunc(l_quantity)::INT % 2 = 0 THEN 'yin' END, CASE WHEN trunc(l_quantity)::INT % 3 = 0 THEN 'nao' END, CASE WHEN trunc(l_quantity)::INT % 5 = 0 THEN 'zhuang' END], lambda v: v IS NOT NULL) AS reference_set,
  list_filter([CASE WHEN round(l_discount * 100)::INT % 2 = 0 THEN 'yin' END, CASE WHEN round(l_tax * 100)::INT % 3 = 0 THEN 'nao' END, CASE WHEN round(l_discount * 100)::INT % 5 = 0 THEN 'zhuang' END], lambda v: v IS NOT NULL) AS prediction_set,
  trunc(l_tax * 1000)::INT AS cents, trunc(l_quantity)::INT % 13 = 0 AS warned FROM lineitem)"""
