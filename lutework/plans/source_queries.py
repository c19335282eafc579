"""Source, sink and stream queries: tables are written in the formats of exports and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import readers
from ..sources.folders import scratch
from ..streaming import stream
from .adapters import table
from .registry import Registry

REGISTRY = query = Registry()


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(round(value, 3), event_id) AS value FROM events GROUP BY user_id")
def s1_s11_latest_lines(spark, sf_dir):
    """JSON lines written in the order of events; of each user the last line wins."""
    path = scratch(spark, "lines")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.round("value", 3).alias("value"))
    rows.repartitionByRange("event_id").sortWithinPartitions("event_id").write.json(path)
    return readers.latest_json_lines(spark, path, "user_id long, event_id long, event_type string, value double", "user_id").select("user_id", "event_type", "value")


@query("SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderkey % 10 <> 0")
def s2_torn_lines(spark, sf_dir):
    """Lines that were cut off are left out, the others stay."""
    path = scratch(spark, "torn")
    line = F.to_json(F.struct("o_orderkey", "o_orderstatus"))
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 10 == 0, F.expr("substring(to_json(struct(o_orderkey, o_orderstatus)), 1, 12)")).otherwise(line).alias("value"))
    rows.write.text(path)
    return readers.json_lines(spark, path, "o_orderkey long, o_orderstatus string").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def s4_csv(spark, sf_dir):
    """A CSV with a header, columns cast explicitly."""
    path = scratch(spark, "csv")
    table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("﻿n_nationkey"), "n_name").write.option("header", True).csv(path)
    return readers.csv_table(spark, path).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


@query("SELECT p_partkey AS number, p_brand AS brand FROM part")
def s5_markdown(spark, sf_dir):
    """Rows of a Markdown table."""
    path = scratch(spark, "markdown")
    line = F.concat(F.lit("| "), F.col("p_partkey").cast("string"), F.lit(" | "), F.col("p_brand"), F.lit(" |"))
    table(spark, sf_dir, "part").select(F.explode(F.array(F.lit("| --- | --- |"), line)).alias("value")).write.text(path)
    found = readers.markdown_rows(spark, path, 2)
    return found.select("number", F.col("cells")[1].alias("brand"))


@query("SELECT o_custkey AS c, count(*) AS n, count(DISTINCT o_orderkey)::BIGINT AS ids FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def s8_sniffed(spark, sf_dir):
    """Records of whatever list a document keeps them in; those without a name are no records."""
    name = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    records = F.collect_list(F.struct(F.col("o_orderkey").alias("id"), name.alias("name")))
    docs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c")).agg(records.alias("r"))
    body = F.when(F.col("c") % 3 == 0, F.to_json(F.struct(F.col("r").alias("items")))).when(F.col("c") % 3 == 1, F.to_json(F.struct(F.struct(F.col("r").alias("list")).alias("data")))).otherwise(F.to_json("r"))
    found = readers.sniffed_records(docs.select("c", body.alias("body")), "body", "id", "name")
    return found.groupBy("c").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query("""WITH w AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
SELECT CASE WHEN r = 1 THEN 'start' WHEN r <= 4 THEN 'extends' ELSE 'slides' END AS step, count(*) AS n, count(*)::BIGINT AS added FROM w GROUP BY 1""")
def s12_growth(spark, sf_dir):
    """Windows of the last four events, each held against the one before by the hashes of its events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", readers.event_hash(F.struct("event_id", "event_type")).alias("h"))
    windows = events.select("user_id", F.row_number().over(w).alias("r"), F.collect_list("h").over(w.rowsBetween(-3, 0)).alias("hashes"))
    return readers.growth_joins(windows, "user_id", "r", "hashes").groupBy("step").agg(F.count("*").alias("n"), F.sum(F.size("new")).alias("added"))


@query("""WITH e AS (SELECT p_name AS term, p_partkey % 5 AS category, unnest([p_name, p_brand, p_name || '-' || p_brand]) AS alias FROM part),
b AS (SELECT alias, min({'c': category, 't': term}) AS x FROM e GROUP BY alias) SELECT alias, x.t AS term, x.c AS category, length(alias)::INT AS length FROM b""")
def s13_lexicon(spark, sf_dir):
    """A lexicon's aliases, the first category's entry winning."""
    aliases = F.concat_ws("/", "p_brand", F.concat_ws("-", "p_name", "p_brand"))
    entries = table(spark, sf_dir, "part").select(F.col("p_name").alias("term"), aliases.alias("aliases"), (F.col("p_partkey") % 5).alias("category"))
    return readers.lexicon(entries, "term", "aliases", "category")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def st_latest_upsert(spark, sf_dir):
    """A file stream appended batch by batch; the latest row of each user wins."""
    path = scratch(spark, "stream")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    rows.repartitionByRange(4, "event_id").write.parquet(f"{path}/in")
    found = stream.file_stream(spark, f"{path}/in", "user_id long, event_id long, event_type string", 2)
    stream.append_batches(found, f"{path}/history", f"{path}/state").awaitTermination()
    return stream.latest_view(spark.read.parquet(f"{path}/history").drop("batch"), ["user_id"], ["event_id"])
