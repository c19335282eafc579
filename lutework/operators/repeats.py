"""Lint of repeats and of gestures that cover a fixed number of notes, as windows and joins over the rows of a score.

A command of a repeat stands for the rows after it whose text is left out: its tail, which ends before another command, before a row of another section
and before a row that sounds by a text of its own. The tail's pitches are held against the pitches of the rows that the command names: from a
numbered row, from the last anchor, or from the head of the section or score. Pitched rows are numbered by score, so that the k-th row of a
tail meets the k-th row of its source by an equi-join.

Rows: score, idx (without gaps), text, midi (null where a row doesn't sound), structural, section, event_index (null on structural rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.folders import written

# The words of repeats, and what stands where a repeat is left out.
COMMAND = "(从[0-9]+再[作做]|从头再[作做]|从ㄱ再[作做]|再[作做](?:[二三]声)?)"
ANCHOR, OMITTED = "再[作做](?:起点|标记)ㄱ?", "无（由于是再作部分，省略）"
AROUND = "〔〕【】[]()（） 。；;：:、\t\n"
HEAD_PROBE = 5
PAIRS, SWEEPS, ENDPOINT = "勾剔|抹挑|抹勾|挑勾|涓", "滚|拂|历|歷", "^至[一二三四五六七1-7]弦([（(]散音[）)])?$"


def commanded(rows: DataFrame) -> DataFrame:
    """rows with what they are to a repeat: command, bare (nothing stands beside it), seg (the number of the last command, 0 before the first), and whether
    they belong to its tail, as the k-th row."""
    t = F.trim(F.coalesce(F.col("text"), F.lit("")))
    plain = F.regexp_replace(t, ANCHOR, "")
    command = F.when(t != OMITTED, F.nullif(F.regexp_extract(plain, COMMAND, 1), F.lit("")))
    w = Window.partitionBy("score").orderBy("idx")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({"t": t, "command": command, "bare": F.btrim(F.regexp_replace(plain, COMMAND, ""), F.lit(AROUND)) == ""})
    out = out.withColumn("seg", F.count("command").over(upto))
    inside = Window.partitionBy("score", "seg").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    first = lambda c: F.first(c).over(inside)
    out = out.withColumns({"at": first("idx"), "of": first("command"), "own_section": first("section"), "lone": first("bare")})
    authored = (F.col("t") != "") & (F.col("t") != OMITTED) & F.col("midi").isNotNull()
    ends = (F.col("idx") > F.col("at")) & (~F.col("section").eqNullSafe(F.col("own_section")) | authored)
    out = out.withColumn("over", F.max(ends.cast("int")).over(inside))
    tail = (F.col("seg") > 0) & (F.col("over") == 0) & ~F.col("structural") & F.col("midi").isNotNull() & ((F.col("idx") > F.col("at")) | F.col("lone"))
    out = out.withColumn("tail", tail)
    return out.withColumn("k", F.when(tail, F.sum(tail.cast("int")).over(inside)))


def merged(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left.join(right, on, how), by shuffling both: files of a few numbers over and over are small while their rows are not, so that their size would have Spark
    broadcast them through the driver."""
    return left.join(right.hint("merge"), on, how)


def repeat_warnings(rows: DataFrame) -> DataFrame:
    """score, idx and code of the repeats that don't hold."""
    c = commanded(rows).withColumn("anchor", F.col("t").rlike("再[作做](起点|标记)"))
    w = Window.partitionBy("score").orderBy("idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    p = F.when(F.col("midi").isNotNull(), F.count("midi").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumns({"p": p, "heard": F.count("midi").over(before)})  # pitched rows before this one
    head = F.first("heard").over(Window.partitionBy("score", "section").orderBy("idx"))
    anchored = F.last(F.when(F.col("anchor"), F.struct("idx", "heard")), ignorenulls=True).over(before)
    c = c.withColumns({"x": anchored, "head_heard": head}).withColumns({"anchored": F.col("x.idx"), "anchor_heard": F.col("x.heard")}).drop("x")
    c = written(c, "repeats")  # read by every rule
    pitched = c.where("midi IS NOT NULL").select("score", F.col("idx").alias("i2"), "p", F.col("midi").alias("m2"), F.col("event_index").alias("e2"))
    own = c.where("command IS NOT NULL").select(
        "score", "seg", "at", "command", "heard", "anchor_heard", "head_heard", F.regexp_extract("command", "^从([0-9]+)", 1).try_cast("long").alias("number"), F.col("event_index").alias("e")
    )
    # the ordinal of the first pitched row of each source: numbered, at or after the anchor, of the section and of the score. All but the first are the ordinal
    # after those of the pitched rows before the source, if a pitched row stands between there and the command
    numbered = merged(own.where("number IS NOT NULL").withColumn("e2", F.col("number")), pitched.where("e2 IS NOT NULL"), ["score", "e2"]).where("i2 < at")
    starts = numbered.groupBy("score", "seg").agg(F.max_by("p", "i2").alias("start")).withColumn("kind", F.lit("numbered"))
    of_head = F.col("command").rlike("头")
    sources = [(F.col("command").rlike("ㄱ"), F.col("anchor_heard"), "anchor"), (of_head, F.col("head_heard"), "section"), (of_head, F.lit(0).cast("long"), "score")]
    listed = F.array(*[F.when(rule & (x < F.col("heard")), F.struct((x + 1).alias("start"), F.lit(kind).alias("kind"))) for rule, x, kind in sources])
    starts = starts.unionByName(own.select("score", "seg", F.explode(F.filter(listed, lambda x: x.isNotNull())).alias("x")).select("score", "seg", "x.*"))
    starts = written(starts, "repeat-starts")
    tails = c.where("tail").select("score", "seg", "idx", "k", "midi", "t")
    sizes = tails.groupBy("score", "seg").agg(F.count("*").alias("n"))
    met = merged(merged(tails, starts, ["score", "seg"]), own.select("score", "seg", "at"), ["score", "seg"]).withColumn("p", F.col("start") + F.col("k") - 1)
    met = merged(met, pitched.where("m2 IS NOT NULL"), ["score", "p"], "left").withColumn("source", F.when(F.col("i2") < F.col("at"), F.col("m2")))
    report = lambda df, code: df.select("score", "idx", F.lit(code).alias("code"))
    at = F.col("at").alias("idx")
    started = starts.where("kind = 'numbered'").select("score", "seg", "start")
    lacking = merged(own.where("number IS NOT NULL"), started, ["score", "seg"], "left_anti").select("score", at)
    wrongs = met.where("kind = 'numbered'").groupBy("score", "seg").agg(F.count_if(~F.col("midi").eqNullSafe(F.col("source"))).alias("wrong"))
    judged = merged(merged(merged(own, sizes, ["score", "seg"], "left"), wrongs, ["score", "seg"], "left"), started, ["score", "seg"])
    differs = judged.where(F.col("n").isNull() | (F.col("wrong") > 0)).select("score", at)
    anchors = met.where(F.col("kind").eqNullSafe("anchor") & ~F.col("midi").eqNullSafe(F.col("source")))
    probes = met.where(F.col("kind").isin("section", "score") & (F.col("k") <= HEAD_PROBE)).groupBy("score", "seg", "at", "kind").agg(
        F.count_if(F.col("midi") != F.col("source")).alias("wrong"), F.count_if(F.col("source").isNull()).alias("unknown")
    )
    from_head = probes.groupBy("score", "seg", "at").agg(F.count_if(F.col("unknown") > 0).alias("unknown"), F.count_if(F.col("wrong") == 0).alias("right"), F.count("*").alias("n")).where("unknown = 0 AND right = 0 AND n = 2").select("score", at)
    wrong = [
        report(lacking, "repeat_numbered_start_missing"), report(differs, "repeat_numbered_pitch_mismatch"), report(anchors, "repeat_anchor_pitch_mismatch"),
        report(from_head, "repeat_from_head_pitch_mismatch"),
    ]
    found = wrong[0]
    for x in wrong[1:]:
        found = found.unionByName(x)
    found = written(found, "repeat-warnings")
    # rows by themselves and by what was said before
    told = F.last(F.when((F.col("t") != "") & ~F.col("structural"), F.struct("t", "idx")), ignorenulls=True).over(before)
    said = F.last(F.when((F.col("t") != "") & (F.col("t") != OMITTED) & ~F.col("structural"), F.col("t")), ignorenulls=True).over(before)
    c = c.withColumns({"told": told, "said": F.coalesce(said, F.lit(""))})
    without = lambda x: F.regexp_replace(x, "再[作做](起点|标记)", "")
    again = "再[作做]"
    rules = {
        "repeat_anchor_instruction_overlap": F.col("anchor") & without(F.col("t")).rlike(again),
        "compound_repeat_instruction_overlap": F.col("t").contains("掐撮三声") & without(F.col("t")).rlike(again),
        "missing_repeat_anchor": F.col("t").contains("从ㄱ再作") & F.col("anchored").isNull(),
        "missing_repeat_instruction": (F.col("t") == OMITTED) & ~F.col("structural") & ~F.coalesce(F.col("told.t") == OMITTED, F.lit(False)) & ~without(F.col("said")).rlike(again),
    }
    codes = F.filter(F.array(*[F.when(r, F.lit(k)) for k, r in rules.items()]), lambda x: x.isNotNull())
    local = c.select("score", "idx", F.explode_outer(codes).alias("code")).where("code IS NOT NULL")
    # a tail's first blank row, where the command itself holds
    bad_rows = found.unionByName(local.where("code <> 'missing_repeat_instruction'"))
    bad_segs = merged(bad_rows, c.select("score", "idx", "seg"), ["score", "idx"]).select("score", "seg").distinct()
    missing = merged(tails.where("t = ''").groupBy("score", "seg").agg(F.min("idx").alias("idx")), bad_segs, ["score", "seg"], "left_anti")
    return found.unionByName(local).unionByName(report(missing, "repeat_omission_marker_missing")).unionByName(anchors_without_music(c))


def anchors_without_music(rows: DataFrame) -> DataFrame:
    """Anchors that stand alone and that two blank notes follow: an anchor is no instruction that covers what comes after it. rows as commanded() gives them."""
    alone = F.col("t").rlike("再[作做](起点|标记)") & (F.btrim(F.regexp_replace("t", r"再[作做](?:起点|标记)\s*ㄱ?", ""), F.lit(" []【】〔〕（）()")) == "")
    w = Window.partitionBy("score").orderBy("idx")
    rows = rows.where("NOT structural").withColumn("alone", alone)
    blank = F.col("t").isin("", OMITTED) & F.col("midi").isNotNull()
    stretch = F.sum((~blank).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("blank", blank).withColumn("stretch", stretch)
    runs = rows.groupBy("score", "stretch").agg(F.count_if("blank").alias("n"), F.min(F.when(~F.col("blank"), F.col("idx"))).alias("idx"), F.bool_or(~F.col("blank") & F.col("alone")).alias("alone"))
    return runs.where("alone AND n >= 2").select("score", "idx", F.lit("repeat_anchor_followed_by_blanks").alias("code"))


def covered(t: Column) -> Column:
    """How many notes a finite gesture sounds: as many as its sweep has strings, two for a pair of strokes on one string, and those from one string to
    another for a roll or sweep; null for any other cell."""
    swept, named = text.sweep_strings(t), text.string_numbers(t)
    ends = F.regexp_extract_all(t, F.lit(r"([一二三四五六七1-7])弦"), F.lit(1))
    last = F.regexp_extract(t, r"至([一二三四五六七1-7])弦", 1)
    between = F.abs(text.number(F.get(ends, 0)) - text.number(last)) + 1
    n = F.when(F.size(swept) > 0, F.size(swept)).when(t.rlike(PAIRS) & (F.size(named) == 1), 2).when(t.rlike(SWEEPS) & (last != ""), between)
    return F.when(n >= 2, n)


def uncovered_notes(rows: DataFrame) -> DataFrame:
    """score, idx and code of the first note that a finite gesture doesn't cover any more: blank notes, and endpoints of the gesture, follow it without a
    rest or tie, and there are more of them than it sounds."""
    t = F.trim(F.coalesce(F.col("text"), F.lit("")))
    w = Window.partitionBy("score").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.where("NOT structural").withColumn("t", t)
    on = (F.col("t") == "") | F.col("t").rlike(ENDPOINT)
    starts = ~on | F.col("midi").isNull()
    rows = rows.withColumn("stretch", F.sum(starts.cast("int")).over(w)).withColumn("count", F.when(starts & F.col("midi").isNotNull(), covered(F.col("t"))))
    inside = Window.partitionBy("score", "stretch").orderBy("idx")
    rows = rows.withColumn("covers", F.first("count").over(inside)).withColumn("used", F.row_number().over(inside))
    return rows.where("used = covers + 1").select("score", "idx", F.lit("finite_gesture_uncovered_note").alias("code"))
