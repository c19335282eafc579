"""Queries over records: documents, reports, captured calls, views and checks, and streams that run to their end."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import curation
from ..sources import readers, score_text, tunes
from ..sources.folders import scratch
from ..streaming import stream
from .adapters import LABELLED, labelled, table
from .registry import Registry

REGISTRY = query = Registry()


@query("SELECT r_regionkey::BIGINT AS region, r_name AS name, count(n_nationkey) AS n_nations, max(n_name) AS last FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2")
def s3_documents(spark, sf_dir):
    """S3: whole documents, one of many lines in a file of its own each."""
    path = scratch(spark, "documents")
    nations = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sort_array(F.collect_list("n_name")).alias("nations"))
    docs = table(spark, sf_dir, "region").join(nations, "r_regionkey", "left")
    body = F.to_json(F.struct(F.col("r_regionkey").alias("region"), F.col("r_name").alias("name"), F.struct("nations").alias("members")), {"pretty": "true"})
    docs.select(body.alias("value"), F.col("r_regionkey").alias("part")).repartition("part").write.partitionBy("part").text(path)
    found = readers.json_documents(spark, path, "region long, name string, members struct<nations:array<string>>")
    return found.select("region", "name", F.size("members.nations").cast("long").alias("n_nations"), F.array_max("members.nations").alias("last"))


@query(f"""WITH {LABELLED} SELECT 'events' AS part, count(*) AS n, count(*) FILTER (warned) AS warned FROM labelled UNION ALL SELECT 'pieces', count(*), sum(w)::BIGINT FROM (SELECT piece, count(*) FILTER (warned) AS w FROM labelled GROUP BY piece)
UNION ALL SELECT 'violations', count(*), count(*) FROM labelled WHERE warned""")
def s9_s10_report(spark, sf_dir):
    """Results written as a report, events as Parquet, pieces as CSV and violations as JSON lines, and read back."""
    path = scratch(spark, "report")
    rows = labelled(spark, sf_dir)
    pieces = rows.groupBy("piece").agg(F.count_if("warned").alias("warnings"))
    readers.write_report(rows, pieces, rows.where("warned").select("piece", "phrase", "event", F.lit("pitch").alias("code")), path)
    events = spark.read.parquet(f"{path}/per_event").agg(F.lit("events").alias("part"), F.count("*").alias("n"), F.count_if("warned").alias("warned"))
    back = readers.csv_table(spark, f"{path}/per_piece").agg(F.lit("pieces").alias("part"), F.count("*").alias("n"), F.sum(F.col("warnings").cast("long")).alias("warned"))
    lines = spark.read.schema("piece long, phrase long, event long, code string").json(f"{path}/violations").agg(F.lit("violations").alias("part"), F.count("piece").alias("n"), F.count("code").alias("warned"))
    return events.unionByName(back).unionByName(lines)


@query("""WITH c AS (SELECT user_id, event_type AS note, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k, event_id FROM events),
w AS (SELECT user_id, event_type AS note, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k, event_id AS window_id FROM events WHERE event_id % 3 = 0)
SELECT user_id, event_id, window_id, window_id IS NULL AS note_only FROM c LEFT JOIN w USING (user_id, note, k)""")
def s12_note_merge(spark, sf_dir):
    """A stream of note calls merged with the events of captured windows: equal notes are matched by hash, the k-th call with the k-th event; calls
    without one stay as notes alone."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.struct(F.col("event_type").alias("note")).alias("note"))
    windows = e.where("event_id % 3 = 0").withColumnRenamed("event_id", "window_id")
    return readers.merged_calls(e, windows, ["user_id"], "note", ["ts", "event_id"], ["ts", "window_id"]).select("user_id", "event_id", "window_id", F.col("window_id").isNull().alias("note_only"))


@query(f"""WITH {LABELLED}, e AS (SELECT piece, reference_set || CASE WHEN warned THEN ['泛起'] ELSE [] END || CASE WHEN cents % 2 = 0 THEN ['泛止'] ELSE [] END AS t FROM labelled)
SELECT piece, array_to_string(list_filter(t, lambda x: x NOT IN ('泛起', '泛止')), '+') AS techniques, count(*) AS n FROM e GROUP BY 1, 2""")
def p2_event_view(spark, sf_dir):
    """Events as they are scored, without markers of state."""
    mark = lambda c, x: F.when(c, F.array(F.lit(x))).otherwise(F.array().cast("array<string>"))
    e = labelled(spark, sf_dir).select("piece", F.concat("reference_set", mark(F.col("warned"), "泛起"), mark(F.col("cents") % 2 == 0, "泛止")).alias("t"))
    return e.groupBy("piece", F.array_join(curation.without_markers(F.col("t")), "+").alias("techniques")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, array_to_string(list_transform(range(1, 8), lambda i: 48 + 2 * i + (s_suppkey * i) % 3), ',') AS open_midi FROM supplier")
def p12_same_tuning(spark, sf_dir):
    """A tuning stated twice, which fails the job where any of the seven strings differs or is missing."""
    own = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: 48 + 2 * i + (F.col("s_suppkey") * i) % 3)
    stated = F.zip_with(F.array(*[F.lit(x) for x in (48, 50, 53, 55, 57, 60, 62)]), F.zip_with(own, F.array(*[F.lit(x) for x in (48, 50, 53, 55, 57, 60, 62)]), lambda a, b: a - b), lambda a, b: a + b)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", own.alias("own"), stated.alias("stated"))
    sure = curation.same_tuning(rows, "s_suppkey", "own", "stated")
    return sure.select("s_suppkey", F.array_join(F.col("own").cast("array<string>"), ",").alias("open_midi"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st_windowed_counts(spark, sf_dir):
    """Hourly counts by kind, from a stream of files that is read to its end."""
    path = scratch(spark, "hours")
    table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value").repartitionByRange(4, "event_id").write.parquet(f"{path}/in")
    rows = stream.file_stream(spark, f"{path}/in", "event_id long, event_type string, ts timestamp, value double", 2)
    found = stream.run_to_end(stream.windowed_counts(rows, "ts", "event_type", "1 hour", "2 hours"), f"{path}/out", f"{path}/state")
    return found.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '1 day')::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '1 day' AS stop, count(*) AS n FROM s GROUP BY user_id, s""")
def st_sessions(spark, sf_dir):
    """Sessions of users, a day's pause ending one, from a stream of files that is read to its end."""
    path = scratch(spark, "sessions")
    table(spark, sf_dir, "events").select("event_id", "user_id", "ts").repartitionByRange(4, "event_id").write.parquet(f"{path}/in")
    rows = stream.file_stream(spark, f"{path}/in", "event_id long, user_id long, ts timestamp", 2)
    return stream.run_to_end(stream.sessions(rows, "ts", "user_id", "1 day", "1 day"), f"{path}/out", f"{path}/state")


@query("""SELECT user_id, CASE WHEN bool_and(value < 90) THEN count(*) ELSE count(*) FILTER (before = 0) END AS length, NOT bool_and(value < 90) AS closed FROM (SELECT *, sum((value >= 90)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY user_id""")
def st_valid_prefixes(spark, sf_dir):
    """W3 as a stream: the contiguous valid prefix of each user's events, which arrive in any order, kept as state."""
    path = scratch(spark, "prefixes")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).cast("long").alias("number"), (F.col("value") < 90).alias("valid"))
    e.repartition(4, F.xxhash64("user_id", "number")).write.parquet(f"{path}/in")
    rows = stream.file_stream(spark, f"{path}/in", "user_id long, number long, valid boolean", 2)
    stream.append_batches(stream.valid_prefixes(rows, "user_id", "number", "valid"), f"{path}/history", f"{path}/state", "update").awaitTermination()
    return stream.latest_view(spark.read.parquet(f"{path}/history"), ["user_id"], ["batch"]).select("user_id", "length", "closed")


_ABC = ["C", "^d", "[CE]", "|", "z", "||", "|]"]
_SCORE_ROWS = """r AS (SELECT l_suppkey::VARCHAR AS score, (row_number() OVER w - 1)::INT AS pos, l_orderkey AS o, l_linenumber AS l, trunc(l_quantity)::INT AS q FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice)),
s AS (SELECT *, q % 7 IN (3, 5, 6) AS structural, CASE WHEN q % 7 = 5 THEN '||' WHEN q % 7 = 6 THEN '|]' END AS token, pos // 40 AS part FROM r)"""


@query(f"""WITH {_SCORE_ROWS}, f AS (SELECT *, CASE WHEN o % 9 = 0 THEN pos * 2 ELSE pos END AS _i, CASE WHEN q % 7 = 3 THEN '|' WHEN structural THEN '|' ELSE CASE WHEN l % 3 = 0 THEN NULL ELSE l || '"' || chr(10) END END AS jianpu, CASE WHEN q % 7 = 3 THEN '|' WHEN structural THEN token ELSE {_ABC}[1 + q % 7] END AS abc FROM s)
SELECT score, count(*) AS n_rows, count(*) FILTER (structural) AS n_bars, count(DISTINCT part) FILTER (part % 3 <> 2) AS n_sections,
  sha256(string_agg(concat_ws('|', pos::VARCHAR, CASE WHEN score::INT % 4 = 0 THEN pos * 2 ELSE pos + 5 END, coalesce(jianpu, '~'), coalesce(abc, '~'), coalesce(token, '~'), CASE WHEN part % 3 = 2 THEN '~' ELSE '第' || part || '段' END), ';' ORDER BY pos)) AS digest FROM f GROUP BY score""")
def s6_score_text(spark, sf_dir):
    """Each supplier's line items as a score, written as text files, read back, and digested row by row; the SQL digests the rows themselves."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice")
    q = F.col("l_quantity").cast("int")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("score"), (F.row_number().over(w) - 1).alias("pos"), F.col("l_linenumber").alias("l"), q.alias("q"))
    structural, token, part = (F.col("q") % 7).isin(3, 5, 6), F.when(F.col("q") % 7 == 5, "||").when(F.col("q") % 7 == 6, "|]"), F.floor(F.col("pos") / 40)
    own = F.when(F.col("l") % 3 != 0, F.concat(F.col("l").cast("string"), F.lit('"\n')))
    section = F.struct((part + 1).cast("int").alias("number"), F.concat(F.lit("第"), part.cast("string"), F.lit("段")).alias("label"), F.lit("题").alias("title"), F.lit(None).cast("string").alias("marker"), (F.col("pos") % 40 == 0).alias("start"))
    word = lambda x: F.lit(x).cast("string")
    index = F.when(F.col("score").cast("int") % 4 == 0, F.col("pos") * 2).otherwise(F.col("pos") + 5)
    plain = F.col("q") % 7 == 3
    notes = rows.select(
        "score", "pos", index.cast("int").alias("index"), structural.alias("structural"), token.alias("structure_token"), F.when(part % 3 != 2, section).alias("section"), F.when(structural, "|").otherwise(own).alias("jianpu"), word(None).alias("jianpu_alt"),
        F.when(plain, "|").when(structural, token).otherwise(F.get(F.array(*[F.lit(x) for x in _ABC]), F.col("q") % 7)).alias("abc"), F.when(plain, "小节线").otherwise("四分").alias("duration"), F.lit("").alias("lyric"), F.lit("").alias("jianzi"), word(None).alias("jianzi_text"),
    )
    titles = rows.select("score").distinct().select("score", F.concat(F.lit("谱"), F.col("score")).alias("title"), F.to_json(F.struct(F.col("score").alias("score_title"))).alias("metadata"))
    path = scratch(spark, "scores")
    score_text.write(score_text.texts(notes, titles), path)
    back = score_text.rows_of(score_text.read(spark, path))
    some = lambda c: F.coalesce(c, F.lit("~"))
    line = F.concat_ws("|", F.col("pos").cast("string"), F.col("index").cast("string"), some("jianpu"), some("abc"), some("structure_token"), some(F.col("section.label")))
    found = back.groupBy("score").agg(F.count("*").alias("n_rows"), F.count_if("structural").alias("n_bars"), F.countDistinct("section.label").alias("n_sections"), F.array_sort(F.collect_list(F.struct("pos", line.alias("x")))).alias("r"))
    return found.select("score", "n_rows", "n_bars", "n_sections", F.sha2(F.array_join(F.transform("r", lambda x: x["x"]), ";"), 256).alias("digest"))


_TUNE_TOKENS = ["z2", "^F", "F", "B", "|", "F2-", "[CE]", "c/2"]


@query("""WITH r AS (SELECT l_suppkey AS score, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice) - 1 AS pos, trunc(l_quantity)::INT % 8 AS k FROM lineitem),
t AS (SELECT *, [960, 480, 480, 480, 0, 960, 480, 240][1 + k] AS ticks, count(*) FILTER (k = 4) OVER w AS scope, k <> 4 AS timed, k NOT IN (0, 4) AS heard, sum([960, 480, 480, 480, 0, 960, 480, 240][1 + k]) OVER w - [960, 480, 480, 480, 0, 960, 480, 240][1 + k] AS onset FROM r WINDOW w AS (PARTITION BY score ORDER BY pos)),
m AS (SELECT *, CASE WHEN k IN (1, 2, 5) THEN [65 + CASE WHEN score % 3 = 1 OR count(*) FILTER (k = 1) OVER (PARTITION BY score, scope ORDER BY pos) > 0 THEN 1 ELSE 0 END] WHEN k = 3 THEN [71 - CASE WHEN score % 3 = 2 THEN 1 ELSE 0 END] WHEN k = 6 THEN [60, 64] WHEN k = 7 THEN [72] ELSE [] END AS midis,
  k = 4 AND onset > coalesce(max(CASE WHEN k = 4 THEN onset END) OVER (PARTITION BY score ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS counts, timed AND ((pos % 16 = 0 AND pos // 16 % 5 = 0) OR count(*) FILTER (timed) OVER (PARTITION BY score ORDER BY pos) = 1) AS begins FROM t),
b AS (SELECT *, last_value(CASE WHEN heard THEN {'m': midis, 'k': k} END IGNORE NULLS) OVER (PARTITION BY score ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, count(*) FILTER (counts) OVER w + 1 AS bar, count(*) FILTER (begins) OVER w AS section FROM m WINDOW w AS (PARTITION BY score ORDER BY pos)),
g AS (SELECT *, heard AND coalesce(before.k = 5 AND before.m = midis, FALSE) AS merged FROM b WHERE timed),
h AS (SELECT *, CASE WHEN heard THEN sum((heard AND NOT merged)::INT) OVER (PARTITION BY score ORDER BY pos) ELSE -pos - 1 END AS grp FROM g)
SELECT score, row_number() OVER (PARTITION BY score ORDER BY min(pos)) AS n, CASE WHEN len(first(midis ORDER BY pos)) = 0 THEN 'rest' WHEN len(first(midis ORDER BY pos)) = 2 THEN 'chord' ELSE 'note' END AS kind, array_to_string(first(midis ORDER BY pos), ',') AS midis, min(onset)::INT AS onset, sum(ticks)::INT AS duration, first(bar ORDER BY pos) AS bar, first(section ORDER BY pos) AS section, count(*) AS n_tied FROM h GROUP BY score, grp""")
def s7_tune_events(spark, sf_dir):
    """Each supplier's line items as a tune of letters with a key, bars, accidentals, ties and sections, read back as events; the SQL makes the events of the numbers."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("score"), (F.row_number().over(w) - 1).alias("pos"), (F.col("l_quantity").cast("int") % 8).alias("k"))
    token = F.get(F.array(*[F.lit(x) for x in _TUNE_TOKENS]), F.col("k"))
    line = F.floor(F.col("pos") / 16)
    mark = F.when(line % 5 == 0, F.concat(F.lit("\n%<"), (line / 5).cast("int").cast("string"), F.lit(">"))).otherwise("")
    part = F.concat(F.when(F.col("pos") % 16 == 0, F.concat(mark, F.lit("\n"))).otherwise(" "), token)
    bodies = rows.groupBy("score").agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("t")))).alias("x"))
    key = F.when(F.col("score") % 3 == 0, "C").when(F.col("score") % 3 == 1, "G").otherwise("F")
    made = bodies.select("score", F.concat(F.lit("T: tune\nL: 1/8\nK: "), key, F.array_join(F.transform("x", lambda x: x["t"]), "")).alias("text"))
    found = tunes.events(tunes.headers(made, "score", "text"), "score")
    return found.select("score", "n", "kind", F.array_join(F.col("midis").cast("array<string>"), ",").alias("midis"), "onset", "duration", "bar", "section", "n_tied")
