"""Tunes in letter notation as timed events: header fields, key signature, accidentals that hold to the bar's end, chords, rests, ties, sections and phrases.

A tune's text is cut into tokens by one pattern; everything that depends on what came before is a window over the tune's tokens: the accidental last stated for a letter and octave in the bar, the time
that has passed, the bars that have any, the tie that is open. Tied notes of equal pitch become one event. Repeats, grace notes and fields within the body are kept apart and neither expanded nor timed.

Defined results: null and empty texts have a header of defaults and no events; a tune with a token, key, meter or unit that isn't known has none but its error; texts may hold comments and blank
lines anywhere; several tunes with the same key would be read as one, so keys are distinct; an empty table gives no rows. A tune's tokens are one window's rows, so that the longest tune bounds a task.

A letter of text becomes a hundred times as many bytes of sorted rows, while Spark sizes tasks by what is shuffled; so the texts are written once and dealt by their length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.music import _lookup
from .folders import written

QUARTER = 960
#: Bytes of text that a task reads, about.
TASK_BYTES = 1 << 19
# Letters, sharps (flats below zero) of major keys, the order of sharps, and the semitones from a minor key to its major one, in fifths.
LETTERS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
MAJOR = {"C": 0, "G": 1, "D": 2, "A": 3, "E": 4, "B": 5, "F#": 6, "C#": 7, "F": -1, "BB": -2, "EB": -3, "AB": -4, "DB": -5, "GB": -6, "CB": -7}
SHARPS, MINOR_FIFTHS = "FCGDAEB", {"A": 0, "E": 1, "B": 2, "F#": 3, "C#": 4, "G#": 5, "D#": 6, "A#": 7, "D": -1, "G": -2, "C": -3, "F": -4, "BB": -5, "EB": -6, "AB": -7}
DEFAULTS = {"K": "C", "M": "4/4", "L": "1/8", "T": "Untitled", "Q": ""}

_NOTE = r"[\^_]*=?[A-Ga-gzZxX][',]*[0-9/]*-?"
TOKEN = rf"[|:][|:\[\]1-9]*|-|\{{[^}}]*\}}|\[[A-Za-z]:[^\]]*\]|\[[^\]]*\][0-9/]*-?|{_NOTE}|[()<>.!+~\s]|%.*|[\s\S]"
PITCHED = r"([\^_]*=?)([A-Ga-g])([',]*)"


def dealt(tunes: DataFrame, key: str, body: str) -> DataFrame:
    """key and body of tunes, written, in as many partitions by key as keep a task's texts near TASK_BYTES."""
    texts = written(tunes.select(key, body), "tunes")
    total = texts.agg(F.sum(F.octet_length(body))).first()[0] or 0
    return texts.repartition(1 + total // TASK_BYTES, key)


def headers(tunes: DataFrame, key: str, body: str) -> DataFrame:
    """key, fields (a map of header letters to values), lines (of the body, with the section mark before each) and, of unknown values, error."""
    text = F.coalesce(F.when(F.col(key).isNotNull(), F.col(body)), F.lit(""))
    rows = dealt(tunes, key, body).select(key, F.posexplode(F.split(text, r"\r\n|[\r\n]")).alias("i", "x")).withColumn("x", F.trim("x"))
    w = Window.partitionBy(key).orderBy("i")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    x = F.col("x")
    field, comment = x.rlike("^[A-Za-z]:"), x.startswith("%") | (x == "")  # a blank line says nothing either
    # the body begins behind the key field, or at the first line that is neither field nor comment
    begun = F.coalesce(F.max(x.rlike("^[Kk]:") | (~field & ~comment)).over(before), F.lit(False))
    rows = rows.withColumns({"head": field & ~begun, "sung": ~comment & (begun | ~field), "said": F.when(x.rlike(r"^%+\s*<[^>]+>\s*$"), F.trim(F.regexp_extract(x, "<([^>]+)>", 1)))})
    rows = rows.withColumn("earlier", F.coalesce(F.count_if("sung").over(before), F.lit(0)))
    rows = rows.withColumn("mark", F.last("said", ignorenulls=True).over(Window.partitionBy(key, "earlier").orderBy("i")))
    last = lambda k: F.max_by(F.when(F.col("head") & (F.upper(F.substring(x, 1, 1)) == k), F.trim(F.substring(x, 3, 1 << 20))), F.when(F.col("head") & (F.upper(F.substring(x, 1, 1)) == k), F.col("i")))
    kept = F.array_sort(F.collect_list(F.when(F.col("sung"), F.struct("i", x.alias("line"), "mark"))))  # a tune's lines
    per = rows.groupBy(key).agg(kept.alias("lines"), *[last(k).alias(f"field_{k}") for k in DEFAULTS])
    fields = F.create_map(*[y for k, v in DEFAULTS.items() for y in (F.lit(k), F.coalesce(f"field_{k}", F.lit(v)))])
    rows = per.select(key, fields.alias("fields"), F.transform("lines", lambda y: F.struct(y["line"].alias("line"), y["mark"].alias("mark"))).alias("lines"))
    f = lambda k: F.col("fields")[k]
    root = F.regexp_replace(F.regexp_replace(f("K"), "♭", "b"), "♯", "#")
    name, minor = F.upper(F.regexp_extract(root, "^([A-Ga-g][#b]?)", 1)), F.lower(F.trim(F.regexp_extract(root, "^[A-Ga-g][#b]?(.*)$", 1))).rlike("^(m|min|aeo)")
    sharps = F.when(minor, _lookup(MINOR_FIFTHS)[name]).otherwise(_lookup(MAJOR)[name])
    unit = F.try_divide(F.regexp_extract(f("L"), r"^(\d+)(?:/(\d+))?$", 1).try_cast("double"), F.coalesce(F.nullif(F.regexp_extract(f("L"), r"^(\d+)/(\d+)$", 2), F.lit("")), F.lit("1")).try_cast("double"))
    error = F.when(sharps.isNull(), "unsupported key").when(~f("M").rlike(r"^(C\|?|\d+\s*/\s*\d+)$"), "unsupported meter").when(unit.isNull(), "invalid unit")
    tempo = F.nullif(F.regexp_extract(f("Q"), r"(\d+)\s*$", 1), F.lit("")).try_cast("int")
    return rows.select(key, "fields", "lines", sharps.alias("sharps"), unit.alias("unit"), tempo.alias("tempo"), error.alias("error"))


def _length(marks: Column) -> Column:
    """The factor that digits and a slash give: 3/2, /4, / (a half), 2, or 1."""
    over, under = F.regexp_extract(marks, r"^(\d*)(?:/(\d*))?$", 1), F.regexp_extract(marks, r"^(\d*)/(\d*)$", 2)
    top = F.when(over == "", 1.0).otherwise(over.try_cast("double"))
    return top / F.when(marks.contains("/"), F.when(under == "", 2.0).otherwise(under.try_cast("double"))).otherwise(1.0)


def events(read: DataFrame, key: str, phrase_bars: int = 8) -> DataFrame:
    """Of headers, an event for each note, chord and rest: key, n (from 1), kind, midis (sorted), onset and duration in ticks, bar and beat (from 1), section (from 1), mark, phrase (from 1) and the number
    of tokens tied into it. Of tunes with an error, one row with error."""
    lines = read.where("error IS NULL").select(key, "sharps", "unit", F.posexplode("lines").alias("at", "l"))
    tokens = lines.select(key, "sharps", "unit", "at", "l.mark", F.posexplode(F.regexp_extract_all("l.line", F.lit(f"({TOKEN})"), F.lit(1))).alias("k", "t"))
    t = F.col("t")
    tokens = tokens.where(~t.rlike(r"^([()<>.!+~\s]|%.*)$"))
    kind = (
        F.when(t.rlike(r"^[|:]"), "bar").when(t == "-", "tie").when(t.startswith("{") & t.endswith("}"), "grace").when(t.rlike(r"^\[[A-Za-z]:"), "field").when(t.rlike(rf"^\[(\s*({_NOTE}))*\s*\][0-9/]*-?$"), "chord")
        .when(t.rlike(r"^[\^_]*=?[zZxX]"), "rest").when(t.rlike(r"^[\^_]*=?[A-Ga-g]"), "note").otherwise("unknown")
    )
    # one number in the order of lines and tokens, so that one sort serves all windows
    tokens = tokens.withColumns({"kind": kind, "i": F.shiftleft(F.col("at").cast("long"), 32) + F.col("k")})
    in_order = Window.partitionBy(key).orderBy("i")
    tokens = tokens.withColumn("mark", F.when(~F.lag("at").over(in_order).eqNullSafe(F.col("at")), F.col("mark")))
    tokens = tokens.withColumn("unknown", F.max(F.col("kind") == "unknown").over(Window.partitionBy(key)))
    sounds = F.col("kind").isin("note", "chord")
    timed = sounds | (F.col("kind") == "rest")
    marks = F.regexp_extract(t, r"([0-9/]*)-?$", 1)
    tokens = tokens.where("NOT unknown").withColumns({"sounds": sounds, "timed": timed, "quarters": F.when(timed, F.col("unit") * 4 * _length(marks)).otherwise(0.0), "scope": F.count_if(F.col("kind") == "bar").over(in_order)})
    tokens = tokens.withColumn("onset", F.sum("quarters").over(in_order) - F.col("quarters"))
    # bars count if any time has passed since the last one
    previous = F.last(F.when(F.col("kind") == "bar", F.col("onset")), ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    tokens = tokens.withColumn("counts", (F.col("kind") == "bar") & (F.col("onset") > F.coalesce(previous, F.lit(0.0))))
    tokens = tokens.withColumns({"bar": F.count_if("counts").over(in_order) + 1, "bar_start": F.coalesce(F.last(F.when(F.col("counts"), F.col("onset")), ignorenulls=True).over(in_order), F.lit(0.0))})
    # pitches: an accidental holds for its letter and octave to the end of the bar
    parts = tokens.where("sounds").select(key, "i", "scope", "sharps", F.posexplode(F.regexp_extract_all("t", F.lit(f"({PITCHED})"), F.lit(1))).alias("j", "p"))
    p = F.col("p")
    letter, octaves = F.upper(F.regexp_extract(p, PITCHED, 2)), F.regexp_extract(p, PITCHED, 3)
    octave = F.when(F.regexp_extract(p, PITCHED, 2).rlike("[a-g]"), 5).otherwise(4) + F.length(F.replace(octaves, F.lit(","), F.lit(""))) - F.length(F.replace(octaves, F.lit("'"), F.lit("")))
    stated = F.regexp_extract(p, PITCHED, 1)
    sign = F.when(stated.endswith("="), 0).when(stated.startswith("^"), F.length(stated)).when(stated.startswith("_"), -F.length(stated))
    parts = parts.withColumns({"letter": letter, "octave": octave, "sign": sign})
    held = F.last("sign", ignorenulls=True).over(Window.partitionBy(key, "scope", "letter", "octave").orderBy("i", "j"))
    rank = _lookup({c: n + 1 for n, c in enumerate(SHARPS)})[F.col("letter")]
    by_key = F.when(F.col("sharps") >= rank, 1).when(-F.col("sharps") >= 8 - rank, -1).otherwise(0)
    pitched = parts.withColumn("midi", 12 * (F.col("octave") + 1) + _lookup(LETTERS)[F.col("letter")] + F.coalesce(held, by_key))
    midis = pitched.groupBy(key, "i").agg(F.array_sort(F.collect_set("midi")).alias("midis"))  # a chord's notes
    rows = tokens.join(midis, [key, "i"], "left").withColumn("midis", F.coalesce("midis", F.array().cast("array<int>")))
    # ties: of the pitched token before this one, or a stroke of its own with no rest between
    back = in_order.rowsBetween(Window.unboundedPreceding, -1)
    heard = F.size("midis") > 0
    state = F.last(F.when(heard, F.struct("midis", F.col("t").endswith("-").alias("tied"), F.col("i"))), ignorenulls=True).over(back)
    last_event = F.last(F.when(F.col("timed"), heard), ignorenulls=True).over(back)
    rows = rows.withColumns({"before": state, "stroke": F.when((F.col("kind") == "tie") & F.coalesce(last_event, F.lit(False)), F.col("i"))})
    stroke = F.last("stroke", ignorenulls=True).over(back)
    rows = rows.withColumn("merged", heard & F.coalesce((F.col("before.midis") == F.col("midis")) & (F.col("before.tied") | F.coalesce(stroke > F.col("before.i"), F.lit(False))), F.lit(False)))
    rows = rows.withColumn("starts", F.col("timed") & (F.col("mark").isNotNull() | (F.count_if("timed").over(in_order) == 1)))
    rows = rows.withColumns({"section": F.count_if("starts").over(in_order), "mark": F.last(F.when(F.col("starts"), F.coalesce("mark", F.lit("一"))), ignorenulls=True).over(in_order)})
    # a tied token belongs to the last event that was heard, whatever rests stand between
    rows = rows.where("timed").withColumn("group", F.when(heard, F.sum((heard & ~F.col("merged")).cast("int")).over(in_order)))
    own = Window.partitionBy(key, F.when(F.col("group").isNotNull(), F.col("group")).otherwise(-F.col("i"))).orderBy("i")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ticks = lambda c: F.round(F.col(c) * QUARTER).cast("int")
    rows = rows.withColumns({"duration": F.sum(ticks("quarters")).over(whole).cast("int"), "n_tied": F.count("*").over(whole)}).where("NOT merged")
    rows = rows.withColumns({"onset_ticks": ticks("onset"), "beat": F.col("onset") - F.col("bar_start") + 1, "long_rest": (F.col("kind") == "rest") & (F.col("duration") >= QUARTER)})
    return _phrased(rows, key, phrase_bars).unionByName(errors(read, key), allowMissingColumns=True)


def _phrased(rows: DataFrame, key: str, phrase_bars: int) -> DataFrame:
    """rows with n and phrase: a phrase ends with a section, with a long rest, and before the event that is phrase_bars bars behind its first one."""
    w = Window.partitionBy(key).orderBy("i")
    cut = (F.col("section") != F.lag("section").over(w)) | F.coalesce(F.lag("long_rest").over(w), F.lit(False)) | F.lag("i").over(w).isNull()
    rows = rows.withColumns({"n": F.row_number().over(w), "part": F.sum(F.coalesce(cut, F.lit(True)).cast("int")).over(w)})
    # within a part the first bars of its phrases: greedily, each from the one before
    firsts = rows.groupBy(key, "part").agg(F.array_sort(F.collect_set("bar")).alias("bars"))
    chosen = F.aggregate("bars", F.array().cast("array<bigint>"), lambda s, b: F.when((F.size(s) == 0) | (b - F.element_at(s, -1) >= phrase_bars), F.concat(s, F.array(b))).otherwise(s))
    firsts = firsts.select(key, "part", chosen.alias("firsts"))
    rows = rows.join(firsts, [key, "part"])
    begun = F.array_max(F.filter("firsts", lambda b: b <= F.col("bar")))
    new = F.row_number().over(Window.partitionBy(key, "part", "begun").orderBy("i")) == 1
    rows = rows.withColumn("begun", begun).withColumn("new", new).withColumn("phrase", F.count_if("new").over(w))
    return rows.select(key, "n", "kind", "midis", F.col("onset_ticks").alias("onset"), "duration", "bar", "beat", "section", "mark", "phrase", "n_tied")


def errors(read: DataFrame, key: str) -> DataFrame:
    """key and error of the tunes that can't be read: of their header, or the first token that isn't known."""
    lines = read.where("error IS NULL").select(key, F.posexplode("lines").alias("at", "l"))
    tokens = lines.select(key, "at", F.posexplode(F.regexp_extract_all("l.line", F.lit(f"({TOKEN})"), F.lit(1))).alias("k", "t"))
    known = [r"[|:][|:\[\]1-9]*", "-", r"\{[^}]*\}", r"\[[A-Za-z]:[^\]]*\]", rf"\[(\s*({_NOTE}))*\s*\][0-9/]*-?", _NOTE, r"[()<>.!+~\s]", "%.*"]
    bad = tokens.where(~reduce(lambda a, b: a | b, [F.col("t").rlike(f"^({x})$") for x in known]))
    first = bad.groupBy(key).agg(F.min_by("t", F.struct("at", "k")).alias("t")).select(key, F.concat(F.lit("unsupported token "), "t").alias("error"))
    return first.unionByName(read.where("error IS NOT NULL").select(key, "error"))
