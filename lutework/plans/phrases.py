"""Queries over phrases of a score: prefixes, runs, repeats, ranges, anchors, and what is composed of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ordered
from .adapters import NOTES, notes, table
from .registry import Registry

REGISTRY = query = Registry()


@query("""WITH e AS (SELECT user_id, event_id, value < 90 AS ok, value < 95 AS present, min((value < 90)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prefix FROM events)
SELECT user_id, count(*) FILTER (prefix = 1) AS kept, count(*) FILTER (prefix = 0 AND present) - count(*) FILTER (prefix = 0 AND present AND NOT ok) AS after_gap, count(*) FILTER (NOT present) AS missing FROM e GROUP BY user_id""")
def w3_causal_prefix(spark, sf_dir):
    """The contiguous valid prefix of each sequence, and the valid predictions that follow a gap, each of which is an error."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    ok, present = F.col("value") < 90, F.col("value") < 95
    e = table(spark, sf_dir, "events").select("user_id", ok.alias("ok"), present.alias("present"), F.min(ok.cast("int")).over(w).alias("prefix"))
    return e.groupBy("user_id").agg(
        F.count_if(F.col("prefix") == 1).alias("kept"), F.count_if((F.col("prefix") == 0) & F.col("ok")).alias("after_gap"), F.count_if(~F.col("present")).alias("missing")
    )


#: Cells whose stroke is a single plain one or blank, and others.
PLAIN_CELLS = ["大指九徽勾三弦", "", "散挑七弦", "勾", "泛起中指七徽勾二弦", "名指十徽八分挑四弦", "按音托一弦", "散吟挑一弦", "抹徽外六弦", "", "挑", "剔五弦"]
BASIC = "^[抹挑勾剔托擘打摘搓劈]$"
MODES, PLACES = "泛起|泛止|按音|泛音|散音|散|大指|中指|名指|食指|跪指", "(?:[一二三四五六七八九十百0-9.]+徽(?:[一二三四五六七八九0-9]+分)?|徽外|[一二三四五六七1-7]弦)"


@query(f"""WITH e AS (SELECT user_id, ts, event_id, event_id % 17 = 0 AS structural, CASE WHEN value > 85 THEN NULL ELSE (event_id // 7) % 2 END AS pitch, {PLAIN_CELLS}[1 + event_id % {len(PLAIN_CELLS)}] AS cell FROM events),
b AS (SELECT *, cell = '' OR regexp_matches(regexp_replace(regexp_replace(cell, '{MODES}', '', 'g'), '{PLACES}', '', 'g'), '{BASIC}') AS basic FROM e WHERE NOT structural),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, pitch ORDER BY ts, event_id) AS g FROM b)
SELECT user_id, min(event_id) AS first_event, count(*) AS length, bool_and(basic) AS hinted FROM r WHERE pitch IS NOT NULL GROUP BY user_id, pitch, g HAVING count(*) >= 5""")
def w5_repeated_pitches(spark, sf_dir):
    """Runs of five equal pitches or more, bars left out, rests ending one; a hint is due where all strokes are single plain ones or blank."""
    cell = F.get(F.array(*[F.lit(c) for c in PLAIN_CELLS]), (F.col("event_id") % len(PLAIN_CELLS)).cast("int"))
    stroke = F.regexp_replace(F.regexp_replace(cell, MODES, ""), PLACES, "")
    e = table(spark, sf_dir, "events").where("event_id % 17 <> 0").select(
        "user_id", "ts", "event_id", F.when(F.col("value") <= 85, F.floor(F.col("event_id") / 7) % 2).alias("pitch"), ((cell == "") | stroke.rlike(BASIC)).alias("basic")
    )
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = (~F.col("pitch").eqNullSafe(F.lag("pitch").over(w)) | F.row_number().over(w).eqNullSafe(1)).cast("int")
    runs = e.withColumn("new", new).withColumn("run", F.sum("new").over(w)).where("pitch IS NOT NULL")
    return runs.groupBy("user_id", "run").agg(F.min("event_id").alias("first_event"), F.count("*").alias("length"), F.bool_and("basic").alias("hinted")).where("length >= 5").drop("run")


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE WHEN value < 8 THEN 'other' WHEN value < 50 THEN 'walk' WHEN value < 58 THEN 'wanglai' ELSE 'blank' END AS kind FROM events),
s AS (SELECT *, sum((kind = 'other')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stretch FROM e),
b AS (SELECT *, max((kind IN ('walk', 'wanglai'))::INT) OVER (PARTITION BY user_id, stretch ORDER BY ts, event_id) AS begun FROM s WHERE kind <> 'other'),
c AS (SELECT *, sum(begun) OVER (PARTITION BY user_id, stretch ORDER BY ts, event_id) AS run, max((kind = 'wanglai')::INT) OVER (PARTITION BY user_id, stretch ORDER BY ts, event_id) AS wide FROM b)
SELECT user_id, event_id, run::BIGINT AS count FROM c WHERE begun = 1 AND run = CASE WHEN wide = 1 THEN 6 ELSE 4 END""")
def w11_walk_runs(spark, sf_dir):
    """Events that sound without a new attack, blanks that a walk covers among them: a warning at the fourth, or at the sixth in a
    run that goes to and fro."""
    v = F.col("value")
    kind = F.when(v < 8, "other").when(v < 50, "walk").when(v < 58, "wanglai").otherwise("blank")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", kind.alias("kind"))
    e = e.withColumn("stretch", F.sum((F.col("kind") == "other").cast("int")).over(w)).where("kind <> 'other'")
    inside = Window.partitionBy("user_id", "stretch").orderBy("ts", "event_id")
    e = e.withColumn("begun", F.max(F.col("kind").isin("walk", "wanglai").cast("int")).over(inside))
    e = e.withColumn("count", F.sum("begun").over(inside)).withColumn("wide", F.max((F.col("kind") == "wanglai").cast("int")).over(inside))
    return e.where((F.col("begun") == 1) & (F.col("count") == F.when(F.col("wide") == 1, 6).otherwise(4))).select("user_id", "event_id", "count")


@query("""WITH e AS (SELECT user_id, row_number() OVER w - 1 AS i, CASE WHEN value > 50 THEN '1' ELSE '0' END AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, i, i // 16 AS phrase, string_agg(v, '') OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS s FROM e),
p AS (SELECT b.user_id, b.phrase, a.phrase AS earlier, b.i, b.i - a.i AS shift FROM g a JOIN g b ON a.user_id = b.user_id AND a.s = b.s AND a.phrase < b.phrase WHERE length(a.s) = 9),
d AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, phrase, earlier, shift ORDER BY i) AS run FROM p), l AS (SELECT user_id, phrase, earlier, count(*) + 8 AS length FROM d GROUP BY user_id, phrase, earlier, shift, run)
SELECT user_id, phrase::BIGINT AS phrase, earlier::BIGINT AS earlier, max(length)::BIGINT AS length FROM l GROUP BY 1, 2, 3""")
def w12_related_phrases(spark, sf_dir):
    """Of each phrase, the earlier phrases of its score that share nine notes in a row or more, and the longest such stretch: places with
    equal runs of nine are joined, and runs of such places along one shift are stretches."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).alias("i"), F.when(F.col("value") > 50, "1").otherwise("0").alias("v"))
    ahead = Window.partitionBy("user_id").orderBy("i").rowsBetween(0, 8)
    g = e.select("user_id", "i", F.floor(F.col("i") / 16).alias("phrase"), F.array_join(F.collect_list("v").over(ahead), "").alias("s")).where(F.length("s") == 9)
    a = g.select("user_id", "s", F.col("phrase").alias("earlier"), F.col("i").alias("j"))
    p = g.join(a, ["user_id", "s"]).where("earlier < phrase").withColumn("shift", F.col("i") - F.col("j"))
    run = F.col("i") - F.row_number().over(Window.partitionBy("user_id", "phrase", "earlier", "shift").orderBy("i"))
    lengths = p.withColumn("run", run).groupBy("user_id", "phrase", "earlier", "shift", "run").agg((F.count("*") + 8).alias("length"))
    return lengths.groupBy("user_id", "phrase", "earlier").agg(F.max("length").alias("length"))


LIMIT, SLACK = 3, 2
_NEW = "(f.full OR (r.section IS NOT NULL AND r.section IS DISTINCT FROM f.section))"
_RANGES = f"""r AS MATERIALIZED (SELECT score, idx, NOT structural AS sounding, structural AS is_bar, CASE WHEN d > 3 THEN status END AS section FROM notes),
f AS (SELECT score, idx, 0 AS start, sounding::INT AS n, section, sounding AND 1 >= {LIMIT + SLACK} AS full FROM r WHERE idx = 0
  UNION ALL SELECT score, idx, start, n + sounding::INT, coalesce(section, current), (sounding AND n + 1 >= {LIMIT + SLACK}) OR (is_bar AND n > {LIMIT}) FROM
    (SELECT r.score, r.idx, r.sounding, r.is_bar, r.section, CASE WHEN {_NEW} THEN r.idx ELSE f.start END AS start, CASE WHEN {_NEW} THEN 0 ELSE f.n END AS n, CASE WHEN NOT {_NEW} THEN f.section END AS current FROM f JOIN r ON r.score = f.score AND r.idx = f.idx + 1)),
ranges AS (SELECT score, start::INT AS start, (max(idx) + 1)::INT AS stop, max(n)::INT AS n FROM f GROUP BY score, start)"""


def phrase_ranges(spark, sf_dir):
    rows = notes(spark, sf_dir).groupBy("score").agg(
        F.sort_array(F.collect_list(F.struct("idx", (~F.col("structural")).alias("sounding"), F.col("structural").alias("is_bar"), F.when(F.col("d") > 3, F.col("status")).alias("section")))).alias("rows")
    )
    found = rows.select("score", F.explode(ordered.split_ranges(LIMIT, SLACK)(F.col("rows"))).alias("x"))
    return found.select("score", "x.start", "x.stop", "x.n")


@query(f"WITH RECURSIVE {NOTES}, {_RANGES} SELECT * FROM ranges")
def w14_phrase_ranges(spark, sf_dir):
    """Phrases of a score by the resetting fold: at a new section, at the next bar after LIMIT sounding notes, or SLACK notes later."""
    return phrase_ranges(spark, sf_dir)


@query(f"""WITH RECURSIVE {NOTES}, {_RANGES}, o AS (SELECT *, CASE WHEN NOT structural THEN sum((NOT structural)::INT) OVER (PARTITION BY score ORDER BY idx) - 1 END AS event FROM notes),
p AS (SELECT ranges.score, start, stop, count(event) AS n_events, min(event)::BIGINT AS first_event, count(*) FILTER (d = 0) AS blanks, count(*) FILTER (event IS NOT NULL AND midi % 5 < 3) AS matched, arg_max(midi, idx) FILTER (event IS NOT NULL) AS exit
  FROM ranges JOIN o ON o.score = ranges.score AND idx >= start AND idx < stop GROUP BY ranges.score, start, stop)
SELECT score, (row_number() OVER w)::INT AS phrase, start, stop, n_events, first_event, blanks, matched, CASE WHEN blanks = stop - start THEN 'blank' WHEN 2 * matched >= n_events THEN 'verified' ELSE 'weak' END AS trust, lag(start) OVER w AS previous, lead(start) OVER w AS next, lag(exit) OVER w AS entry
FROM p WINDOW w AS (PARTITION BY score ORDER BY start)""")
def c1_trajectories(spark, sf_dir):
    """A score's phrases as trajectories: ranges (W14), event ordinals (W1), how much is matched and blank, the phrases beside each one and the state
    that it takes over (W13)."""
    rows = ordered.event_ordinals(notes(spark, sf_dir), ["score"], ["idx"], F.col("structural"))
    marked = rows.join(phrase_ranges(spark, sf_dir).select(F.col("score").alias("s"), "start", "stop"), (F.col("score") == F.col("s")) & (F.col("idx") >= F.col("start")) & (F.col("idx") < F.col("stop")))
    sounds = F.col("event_index").isNotNull()
    p = marked.groupBy("score", "start", "stop").agg(
        F.count("event_index").alias("n_events"), F.min("event_index").alias("first_event"), F.count_if(F.col("d") == 0).alias("blanks"), F.count_if(sounds & (F.col("midi") % 5 < 3)).alias("matched"),
        F.max_by(F.when(sounds, F.col("midi")), F.when(sounds, F.col("idx"))).alias("exit"),
    )
    w = Window.partitionBy("score").orderBy("start")
    trust = F.when(F.col("blanks") == F.col("stop") - F.col("start"), "blank").when(2 * F.col("matched") >= F.col("n_events"), "verified").otherwise("weak")
    return p.select(
        "score", F.row_number().over(w).alias("phrase"), "start", "stop", "n_events", "first_event", "blanks", "matched", trust.alias("trust"),
        F.lag("start").over(w).alias("previous"), F.lead("start").over(w).alias("next"), F.lag("exit").over(w).alias("entry"),
    )


#: Cells with markers of repeats, and with none.
REPEAT_CELLS = ["", "", "", "〔再作标记ㄱ〕勾三弦", "", "再作", "从ㄱ再作", "", "挑六弦", "从头再作", "再作二声。再作", "", "再作起点，再作", ""]
_COPIES = r"(从头再作|从ㄱ再作|再作三声|再作二声|再[作做](?:标记|起点)ㄱ?|再作)"
_MARKED = f"""c AS (SELECT score, idx, {REPEAT_CELLS}[1 + (score * 5 + idx * 3 + midi) % {len(REPEAT_CELLS)}] AS t FROM notes),
m AS (SELECT *, regexp_extract_all(t, '{_COPIES}', 1) AS ms FROM c),
a AS (SELECT *, last_value(CASE WHEN len(list_filter(ms, lambda x: regexp_matches(x, '标记|起点'))) > 0 THEN idx END IGNORE NULLS) OVER (PARTITION BY score ORDER BY idx) AS anchor FROM m),
k AS (SELECT *, list_filter(ms, lambda x: NOT regexp_matches(x, '标记|起点') AND (x <> '从ㄱ再作' OR anchor IS NOT NULL))[-1] AS copy, len(list_filter(ms, lambda x: NOT regexp_matches(x, '标记|起点') AND x <> '再作' AND (x <> '从ㄱ再作' OR anchor IS NOT NULL))) > 0 AS own FROM a)"""


@query(f"""WITH {NOTES}, {_MARKED}, b AS (SELECT *, last_value(CASE WHEN t <> '' THEN {{'c': coalesce(copy, ''), 'a': anchor}} END IGNORE NULLS) OVER (PARTITION BY score ORDER BY idx) AS before FROM k)
SELECT score, idx, CASE WHEN t <> '' THEN own ELSE coalesce(before.c, '') <> '' END AS omitted, CASE WHEN t <> '' THEN CASE WHEN own THEN list_filter(ms, lambda x: NOT regexp_matches(x, '标记|起点') AND x <> '再作' AND (x <> '从ㄱ再作' OR anchor IS NOT NULL))[-1] END WHEN coalesce(before.c, '') <> '' THEN before.c END AS marker,
  CASE WHEN t <> '' THEN CASE WHEN own THEN anchor END WHEN coalesce(before.c, '') <> '' THEN before.a END AS anchor FROM b""")
def f4_repeats(spark, sf_dir):
    """F4, J9 and F-str11: the rows that a marker of a repeat leaves out, none being added: blanks after a copy marker, and its own row where the marker
    isn't the plain one; with the nearest anchor before it."""
    cell = F.get(F.array(*[F.lit(c) for c in REPEAT_CELLS]), ((F.col("score") * 5 + F.col("idx") * 3 + F.col("midi")) % len(REPEAT_CELLS)).cast("int"))
    return ordered.repeats(notes(spark, sf_dir).select("score", "idx", cell.alias("t")), ["score"], "idx", "t").select("score", "idx", "omitted", "marker", "anchor")


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type, value, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS n FROM events)
SELECT c.user_id, c.event_id, (c.event_id % 3 + 1)::BIGINT AS wanted, arg_max(a.event_id, (a.ts, a.event_id)) AS target FROM e c LEFT JOIN e a ON a.user_id = c.user_id AND a.n = c.event_id % 3 + 1 AND (a.ts, a.event_id) < (c.ts, c.event_id)
WHERE c.event_type = 'purchase' GROUP BY 1, 2, 3""")
def j10_numbered_targets(spark, sf_dir):
    """Of each command that names an ordinal, the latest row before it that has it: rows and commands in one order, the last row's value carried on."""
    day = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", F.row_number().over(day).cast("long").alias("n"))
    rows = e.select("user_id", "n", "ts", "event_id", F.lit(True).alias("is_row"))
    commands = e.where("event_type = 'purchase'").select("user_id", (F.col("event_id") % 3 + 1).alias("n"), "ts", "event_id", F.lit(False).alias("is_row"))
    w = Window.partitionBy("user_id", "n").orderBy("ts", "event_id", "is_row").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.when(F.col("is_row"), F.col("event_id")), ignorenulls=True).over(w)
    both = rows.unionByName(commands).withColumn("target", carried)
    return both.where("NOT is_row").select("user_id", "event_id", F.col("n").alias("wanted"), "target")


@query(f"""WITH {NOTES}, p AS (SELECT score, idx // 3 AS phrase, min(idx) AS first, count(*) AS n, count(*) FILTER (d > 2) AS filled, count(*) FILTER (flag = 'A') AS omitted, count(*) FILTER (NOT structural AND midi % 5 < 3) AS matched, count(*) FILTER (NOT structural) AS parseable FROM notes GROUP BY 1, 2),
s AS (SELECT score, sum(matched) >= 2 OR 2 * sum(matched) >= sum(parseable) AS eligible FROM p GROUP BY score HAVING sum(parseable) > 0)
SELECT p.score, p.phrase::BIGINT AS phrase, filled = 0 AND omitted = 0 AS all_empty, eligible AND NOT (filled = 0 AND omitted = 0) AS exported FROM p JOIN s USING (score)""")
def c4_p11_exported(spark, sf_dir):
    """Phrases that go into an export: of scores of which enough is matched, those with a filled row or an omission marker."""
    n = notes(spark, sf_dir).withColumn("phrase", F.floor(F.col("idx") / 3))
    p = n.groupBy("score", "phrase").agg(
        F.count_if(F.col("d") > 2).alias("filled"), F.count_if(F.col("flag") == "A").alias("omitted"), F.count_if(~F.col("structural") & (F.col("midi") % 5 < 3)).alias("matched"), F.count_if(~F.col("structural")).alias("parseable")
    )
    s = p.groupBy("score").agg(F.sum("matched").alias("m"), F.sum("parseable").alias("k")).where("k > 0").select("score", ((F.col("m") >= 2) | (2 * F.col("m") >= F.col("k"))).alias("eligible"))
    empty = (F.col("filled") == 0) & (F.col("omitted") == 0)
    return p.join(s, "score").select("score", "phrase", empty.alias("all_empty"), (F.col("eligible") & ~empty).alias("exported"))
