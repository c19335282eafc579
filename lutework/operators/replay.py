"""Replay of reduced tablature: what each row sounds, and what the rows before it left under the fingers, as window functions per score.

A row states little and inherits the rest: its string, stud, finger and manner of sounding come from the last row that stated them, until
a rest, a harmonic region or an open pluck on the held string takes them away. Every one of these is the last value of a column over
the rows before, so that a score is replayed by a handful of windows over one partitioning and order, and no row needs Python.

State after a row: held (string, stud, label of the left hand's contact), finger, manner (open or stopped), scope (whether a harmonic
region is open) and origin (the contact that a walk left, to which 复 returns). Phrases don't reset it; a bare rest does.

A gesture that plucks two strings at once sounds both parts, each in its own manner, and leaves the stopped one held, or what both share. A gesture that lifts a
finger lets its string sound open beside what the cell plucks.

Bounds of the windows: of several returns in a row after one walk only the first moves the contact, and a walk that starts from a contact
which an earlier 复 restored is followed through one such return; deeper nests keep the contact that was last stated. A finger that is named to be lifted
is taken for the one that holds the contact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import music, text

# The words of the notation, in order of precedence.
FINGERS = ["大指", "食指", "中指", "名指", "跪指"]
PLUCKS = ["抹挑", "挑", "勾", "抹", "剔", "托", "擘", "劈", "打", "摘", "搓", "撮", "历", "拨", "泼", "剌", "轮", "锁", "罨"]
COMPOUNDS = ["掐撮三声", "历拂", "拨剌三声", "拂历"]
UP, DOWN = ["引上", "绰", "浒", "进", "上"], ["注", "淌", "退", "下"]
ORNAMENTS = ["吟", "猱", "撞"]
STANDALONE, LIFTS = ["绰上", "注下"], ["爪起", "抓起"]
#: How many texts' facts are sent to the tasks: some MB.
VOCABULARY = 8192

PLACE = "struct<string:int,hui:double,label:string>"


def _any(t: Column, words: list[str]) -> Column:
    return t.rlike("|".join(words))


def _walks(t: Column, words: list[str]) -> Column:
    return t.rlike(f"^(急|缓|少)?({'|'.join(words)})")


def paired(t: Column) -> Column:
    """The two parts of a gesture that plucks two strings at once, each with its string, stud, finger and manner; null for any other cell."""
    inner = F.regexp_extract(t, r"[撮泼剌]\s*[（(]([^）)]*)[）)]", 1)
    parts = F.filter(F.transform(F.split(inner, "[＋+、]"), lambda p: F.trim(p)), lambda p: p != "")

    def part(p: Column) -> Column:
        strings = text.string_numbers(p)
        mode = F.when(p.contains("泛音"), "harmonic").when(p.contains("散音"), "open").when(p.contains("按音"), "stopped")
        return F.struct(
            F.when(F.size(strings) == 1, F.get(strings, 0)).alias("string"), text.stud(p).cast("double").alias("hui"), text.stud_label(p).alias("label"), text.first_of(p, FINGERS).alias("finger"), mode.alias("mode")
        )

    return F.when(F.size(parts) == 2, F.transform(parts, part))


def pair_kind(pair: Column) -> Column:
    """harmonic, stopped or mixed (one part open, the other stopped); null where the parts don't say enough."""
    all_ = lambda f: F.forall(pair, f)
    placed = lambda p: p["hui"].isNotNull() | p["label"].isNotNull()
    strings = all_(lambda p: p["string"].isNotNull())
    opened = F.size(F.filter(pair, lambda p: p["mode"] == "open"))
    held = F.size(F.filter(pair, lambda p: placed(p) & F.coalesce(p["mode"] == "stopped", F.lit(True))))
    return (
        F.when(strings & all_(lambda p: (p["mode"] == "harmonic") & p["hui"].isNotNull()), "harmonic").when(strings & all_(lambda p: (p["mode"] == "stopped") & placed(p)), "stopped")
        .when(strings & (opened == 1) & (held == 1), "mixed")
    )


def _let(value: Column, then) -> Column:
    """then(value), value being worked out once."""
    return F.get(F.transform(F.array(value), then), 0)


def _marks(t: Column) -> Column:
    """What the lint asks of a cell's text by patterns."""
    open_pluck = "^(散音|散)?[抹挑勾剔擘托劈打摘搓][一二三四五六七1-7]弦$"
    return F.struct(
        _any(t, [f"^{x}" for x in STANDALONE]).alias("standalone"), t.rlike(open_pluck).alias("open_pluck"), _any(t, ORNAMENTS).alias("ornament"), _any(t, ["拨", "泼"]).alias("pair_pluck"), t.rlike(r"撮\s*[（(]").alias("cuo"),
        t.rlike("^(泛起|泛止|按音|泛音|急|缓|少)*[绰注]").alias("slide"), _any(t, ["换指", "替指", "滔起", "带起", "掐起", "抓起", "爪起", "罨"]).alias("changes"),
        t.rlike("^(散音|散)(吟|猱|撞)([一二三四五六七1-7]弦)?$").alias("open_ornament"), t.rlike("历[一二三四五六七1-7]+弦").alias("li"),
    )


def _facts(full: Column) -> Column:
    """What a cell's text says by itself."""
    starts, ends = F.locate("泛起", full), F.locate("泛止", full)
    # what is left of a cell beside the gesture that lifts a finger
    lifts = F.when(_any(full, LIFTS), "thumb").when(full.contains("带起"), "named")
    o = F.trim(F.regexp_replace(full, "|".join([*LIFTS, "带起", "同声", "同起"]), ""))
    opens = (starts > 0) & ((ends == 0) | (starts < ends) | (ends == 1))

    def rest(t: Column) -> Column:
        sweep, pluck = text.sweep_strings(t), text.first_of(t, PLUCKS)
        bad = F.filter(F.regexp_extract_all(t, F.lit(r"([0-9]+|十[一二三四五六七八九]?|[一二三四五六七八九])弦"), F.lit(1)), lambda x: x.rlike("^(十.?|[八九]|[089]|[0-9]{2,})$") & ~x.rlike("^[1-7]+$"))
        return F.struct(
            lifts.alias("lifts"), o.alias("o"), paired(t).alias("pair"), _let(paired(t), pair_kind).alias("pair_kind"), F.when(F.size(sweep) > 0, sweep).otherwise(text.string_numbers(t)).alias("strings"), (F.size(sweep) > 1).alias("swept"),
            pluck.alias("pluck"), text.first_of(t, FINGERS).alias("own_finger"), text.stud(t).cast("double").alias("own_hui"), text.stud_label(t).alias("own_label"), t.contains("散").alias("opened"), opens.alias("opens"), (ends == 1).alias("closes_first"),
            # what the row leaves of the region: the later marker counts
            F.when((starts > 0) | (ends > 0), starts > ends).alias("leaves"), (_any(t, COMPOUNDS) | (t == "拨")).alias("compound"), F.when(pluck.isNull() & _walks(t, UP), "up").when(pluck.isNull() & _walks(t, DOWN), "down").alias("walk"),
            (t == "复").alias("returns"), (F.size(bad) > 0).alias("bad_string"), _marks(full).alias("marks"),
        )

    return _let(F.when(lifts.isNotNull(), o).otherwise(full), rest)


def stated(notes: DataFrame) -> DataFrame:
    """What each row says by itself. notes: score, idx, text (null where nothing is filled in), structural, rest, targets. What the VOCABULARY commonest texts say is found once and joined; any other
    cell is read in its row."""
    t = F.trim(F.coalesce(F.col("text"), F.lit("")))
    rows = notes.withColumn("t", F.when(F.col("structural"), F.lit("")).otherwise(t))
    counts = rows.groupBy("t").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "t").limit(VOCABULARY)
    common = counts.select(F.col("t").alias("__t"), _facts(F.col("t")).alias("__common"))
    rows = rows.join(F.broadcast(common), F.col("t") == F.col("__t"), "left").withColumn("__f", F.coalesce("__common", _facts(F.col("t"))))
    closed = F.coalesce(F.col("rest"), F.lit(False)) & (F.col("t") == "")
    return rows.select(*notes.columns, "t", closed.alias("rest_here"), "__f.*").withColumn("leaves", F.when(F.col("rest_here"), F.lit(False)).otherwise(F.col("leaves")))


def replayed(notes: DataFrame, open_midi: list[float] = music.STANDARD_TUNING) -> DataFrame:
    """notes with what each row sounds: mode, string(s), hui, label, finger, pitches and reason (null where it sounds); and the state before
    it: before_string, before_hui, before_finger, before_mode, scope, origin."""
    w = Window.partitionBy("score").orderBy("idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(c, ignorenulls=True).over(before)
    none = F.lit(None)
    rows = stated(notes)
    scope = F.when(F.col("opens"), True).when(F.col("closes_first"), False).otherwise(F.coalesce(last(F.col("leaves")), F.lit(False)))
    rows = rows.withColumn("scope", scope)
    t, own = F.col("t"), F.col("own_hui").isNotNull() | F.col("own_label").isNotNull()
    attack = F.col("pluck").isNotNull() & ~F.col("compound") & ~F.col("bad_string")
    pair, kind = F.col("pair"), F.col("pair_kind")
    lifted = F.col("lifts").isNotNull()
    said = (
        F.when(kind.isNotNull(), kind).when(F.col("opened"), "open").when(t.contains("按音"), "stopped").when(t.contains("泛音") | F.col("scope"), "harmonic")
        .when(F.col("own_finger").isNotNull() | own | t.contains("就"), "stopped")
    )
    rows = rows.withColumn("said", F.when(attack, said))
    reset = F.col("rest_here") | F.col("opens")
    # a pair of an open and a stopped string leaves no manner, nor do harmonics; a lifted finger leaves an open string
    manner = F.when(reset, "").when(lifted, "open").when(kind.isin("mixed", "harmonic"), "").when(F.col("said").isin("open", "stopped"), F.col("said"))
    rows = rows.withColumn("before_mode", F.nullif(last(manner), F.lit("")))
    rows = rows.withColumn("mode", F.when(attack & ~F.coalesce(kind == "mixed", F.lit(False)), F.coalesce("said", "before_mode", F.lit("stopped"))))
    # the string that is held: of the last single stopped attack
    one = F.when((F.size("strings") == 1) & attack & (F.col("mode") == "stopped"), F.col("strings")[0])
    stopped_part = F.get(F.filter(pair, lambda p: ~F.coalesce(p["mode"] == "open", F.lit(False))), 0)
    both_hui = F.get(pair, 0)["hui"].eqNullSafe(F.get(pair, 1)["hui"]) & F.get(pair, 0)["label"].eqNullSafe(F.get(pair, 1)["label"])
    both_finger = F.get(pair, 0)["finger"] == F.get(pair, 1)["finger"]
    shared = F.coalesce((kind == "stopped") & both_hui & both_finger, F.lit(False))
    held = F.when(reset | lifted, F.lit(-1)).when(kind == "mixed", stopped_part["string"]).when(kind.isNotNull(), F.lit(-1)).when(one.isNotNull(), one)
    rows = rows.withColumn("held", F.nullif(last(held), F.lit(-1)))
    string = F.when(F.size("strings") > 0, F.when(F.size("strings") == 1, F.col("strings")[0])).when(attack & own & (F.col("mode") == "stopped"), F.col("held")).when(F.col("walk").isNotNull(), F.col("held"))
    rows = rows.withColumn("string", string)
    # the left hand's contact: stated by stopped attacks and walks, taken away by rests, regions and open plucks on the held string
    released = reset | (attack & (F.col("mode") == "open") & F.array_contains("strings", F.col("held")))
    place = lambda s, h, x: F.struct(s.cast("int").alias("string"), h.cast("double").alias("hui"), x.cast("string").alias("label"))
    touches = own & ((attack & (F.col("mode") == "stopped")) | F.col("walk").isNotNull())
    contact = (
        F.when(released | lifted, place(none, none, none)).when(kind == "mixed", place(stopped_part["string"], stopped_part["hui"], stopped_part["label"]))
        .when(shared, place(none, F.get(pair, 0)["hui"], F.get(pair, 0)["label"])).when(kind.isNotNull(), place(none, none, none))
        .when(touches, place(F.col("string"), F.col("own_hui"), F.col("own_label")))
    )
    rows = rows.withColumn("touch", contact).withColumn("contact0", last(F.col("touch")))
    gone = F.when(attack | reset, place(none, none, none))
    origin = lambda c: last(F.when(F.col("walk").isNotNull(), F.col(c)).otherwise(gone))
    rows = rows.withColumn("origin0", origin("contact0"))
    back = F.when(F.col("returns") & F.col("origin0.string").isNotNull(), F.col("origin0"))
    rows = rows.withColumn("contact", last(F.coalesce("touch", back))).withColumn("origin", origin("contact"))
    finger = (
        F.when(reset | lifted, "").when(kind == "mixed", stopped_part["finger"]).when(kind.isNotNull(), F.when(shared, F.get(pair, 0)["finger"]).otherwise(""))
        .when(F.col("own_finger").isNotNull() & ~F.col("scope"), F.col("own_finger"))
    )
    rows = rows.withColumn("before_finger", F.nullif(last(finger), F.lit(""))).withColumn("finger", F.coalesce("own_finger", "before_finger"))
    stopped = F.col("mode") == "stopped"
    hui = F.when(own, F.col("own_hui")).when(stopped, F.col("contact.hui"))
    label = F.when(own, F.col("own_label")).when(stopped, F.col("contact.label"))
    hui = F.when(F.col("returns"), F.col("origin.hui")).otherwise(hui)
    label = F.when(F.col("returns"), F.col("origin.label")).otherwise(label)
    rows = rows.withColumns({"hui": F.when(F.col("mode") == "open", None).otherwise(hui), "label": F.when(F.col("mode") == "open", None).otherwise(label)})
    tuning = F.array(*[F.lit(float(x)) for x in open_midi])
    sound = lambda s, mode: music.position_pitch(F.get(tuning, s - 1), F.col("hui"), F.col("label"), mode)
    each = F.transform(F.when(F.size("strings") > 0, F.col("strings")).otherwise(F.array(F.col("string"))), lambda s: sound(s, F.col("mode")))
    moved = F.when(F.col("returns"), F.array(sound(F.col("origin.string"), F.lit("stopped")))).when(F.col("walk").isNotNull() & own, F.array(sound(F.col("string"), F.lit("stopped"))))
    two = F.transform(pair, lambda p: music.position_pitch(F.get(tuning, p["string"] - 1), p["hui"], p["label"], F.coalesce(p["mode"], F.lit("stopped"))))
    pitches = F.filter(F.when(kind.isNotNull(), two).when(attack, each).otherwise(moved), lambda p: p.isNotNull())
    # the string that a lifted finger lets sound, beside what the cell plucks; a thumb must have held it
    free = F.get(tuning, F.col("contact.string") - 1)
    may = F.col("contact.string").isNotNull() & ((F.col("lifts") == "named") | F.coalesce(F.col("before_finger") == "大指", F.lit(False)))
    alone = F.col("o") == ""
    with_free = F.when(may & (alone | (F.size(pitches) > 0)), F.array_distinct(F.concat(F.coalesce(pitches, F.array().cast("array<double>")), F.array(free))))
    pitches = F.when(lifted, F.coalesce(with_free, F.array().cast("array<double>"))).otherwise(pitches)
    several = (F.size("strings") > 1) & ~F.col("swept") & own & ~F.col("pluck").isin("撮", "泼", "剌", "拨")
    reason = (
        F.when(F.col("bad_string"), "invalid_string_number").when(t == "", "empty_jianzi").when(F.col("compound"), "context_dependent_compound_gesture")
        .when(lifted & ~may, F.when(F.col("lifts") == "thumb", "zhuaqi_requires_previous_thumb_stopped_note").otherwise("daiqi_requires_previous_stopped_note"))
        .when(~attack & t.contains("至"), "context_dependent_transition")
        .when(~attack & (F.coalesce(F.size(pitches), F.lit(0)) == 0), F.when(F.col("walk").isNotNull(), "slide_without_position").otherwise("ornament_or_control"))
        .when(attack & several, "ambiguous_multiple_strings")
        .when(attack & (F.size("strings") == 0) & F.col("string").isNull(), "no_explicit_string")
        .when((F.col("mode") == "harmonic") & (F.col("hui") != F.floor("hui")), "fractional_hui_not_valid_for_harmonic")
        .when(F.coalesce(F.size(pitches), F.lit(0)) == 0, "unknown_position")
    )
    out = rows.withColumns({"reason": reason, "pitches": F.when(reason.isNull(), pitches).otherwise(F.array().cast("array<double>")), "attack": attack & reason.isNull()})
    return out.select(
        *notes.columns, "t", "rest_here", "strings", "swept", "pluck", "walk", "returns", "compound", "opened", "own_finger", "own_hui", "mode", "string", "hui", "label", "finger", "scope", "said",
        F.col("contact.string").alias("before_string"), F.col("contact.hui").alias("before_hui"), "before_finger", "before_mode", F.col("origin.string").alias("origin_string"), "pitches", "reason", "attack", "marks",
    )


def audited(rows: DataFrame, cents: float = 50.0) -> DataFrame:
    """Replayed rows with status (matched, mismatched or skipped) and error, the largest in cents. Pitches and targets, as many of
    one as of the other, are paired in the order of their height, which no other pairing beats in total. A sweep is held against the
    targets of as many rows as it has strings, the rows after it being blank."""
    w = Window.partitionBy("score").orderBy("idx")
    ahead = F.flatten(F.collect_list("targets").over(w.rowsBetween(0, 6)))
    wanted = F.when(F.col("swept"), F.slice(ahead, F.lit(1), F.size("pitches"))).otherwise(F.col("targets"))
    rows = rows.withColumn("wanted", wanted)
    order = lambda x: F.when(F.col("swept"), x).otherwise(F.array_sort(x))
    errors = F.zip_with(order(F.col("wanted")), order(F.col("pitches")), lambda a, b: F.abs(a - b) * 100)
    same = (F.size("pitches") > 0) & (F.size("wanted") == F.size("pitches"))
    worst = F.when(same, F.array_max(errors))
    status = F.when(~same | F.col("reason").isNotNull(), "skipped").when(worst <= cents, "matched").otherwise("mismatched")
    return rows.withColumn("error", F.round(worst, 3)).withColumn("status", status)


def warnings(rows: DataFrame, reach: float = 4.0, span: float = 501.0) -> DataFrame:
    """Lint codes of audited rows, one row each: score, idx, code. Structural rows neither warn nor come between others."""
    w = Window.partitionBy("score").orderBy("idx")
    rows = rows.where(~F.col("structural"))
    t = F.col("t")
    single = F.col("attack") & (F.size("pitches") == 1)
    kept = ["t", "marks", "mode", "string", "hui", "finger", "strings", "opened", "attack", "pluck", "pitches", "targets", "walk", "compound", "reason"]
    prev = F.lag(F.struct(*kept, single.alias("single"))).over(w)
    rows = rows.withColumn("single", single).withColumn("p", F.when(~F.col("rest_here"), prev))
    p = lambda c: F.col(f"p.{c}")
    # sounding rows without a new attack, walks and the blanks that they cover
    sounding = F.size("targets") > 0
    alone = F.col("pluck").isNull() & (F.col("marks.standalone") | t.isin("复", "进复", "退复"))
    goes_on = sounding & ((alone & F.col("reason").isNull()) | (F.col("pluck").isNull() & t.contains("往来")))
    # a blank goes on only what a walk began: the row that is neither blank nor walk ends the run
    ends = ~goes_on & ~((t == "") & sounding & ~F.col("rest_here"))
    rows = rows.withColumn("goes_on", goes_on).withColumn("stretch", F.sum(ends.cast("int")).over(w))
    inside = Window.partitionBy("score", "stretch").orderBy("idx")
    begun = F.max(F.col("goes_on").cast("int")).over(inside)
    rows = rows.withColumn("counted", F.when(ends, 0).otherwise(begun))
    rows = rows.withColumn("run", F.sum("counted").over(inside)).withColumn("wanglai", F.max((F.col("goes_on") & t.contains("往来")).cast("int")).over(inside))
    down = F.last(F.when(F.col("attack") | t.contains("复"), "").when(F.col("walk").isNotNull(), F.col("walk")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("led", down)
    tuning_span = F.abs(F.get("pitches", 0) - F.get(F.lag(F.when(F.size("pitches") == 1, F.col("pitches"))).over(w), 0)) * 100
    rows = rows.withColumn("moved", tuning_span)
    walk_here = F.col("walk").isNotNull() & F.col("marks.standalone") & F.col("own_hui").isNotNull() & F.col("before_hui").isNotNull()
    stopped = F.col("single") & (F.col("mode") == "stopped")
    was_stopped = p("single") & (p("mode") == "stopped")
    down_step, up_step = F.col("own_hui") > F.col("before_hui"), F.col("own_hui") < F.col("before_hui")
    strings = F.col("strings")
    plain_open = F.col("marks.open_pluck") & (F.col("mode") == "open")
    was_plain_open = p("marks.open_pluck") & (p("mode") == "open")
    ornament = F.col("marks.ornament")
    changed = lambda a, b: F.get(a, 0) != F.get(b, 0)
    rules = {
        "jianzi_pitch_mismatch": F.col("status") == "mismatched",
        "invalid_string_number": F.col("reason") == "invalid_string_number",
        "fractional_hui_in_harmonic": F.col("reason") == "fractional_hui_not_valid_for_harmonic",
        "walk_span_too_large": walk_here & (F.col("moved") >= span),
        "walk_endpoint_same_as_start": walk_here & (F.abs(F.col("own_hui") - F.col("before_hui")) < 1e-9),
        "walk_direction_reversed": walk_here & ((t.startswith("绰上") & down_step) | (t.startswith("注下") & up_step)),
        "consecutive_walks_without_attack": (F.col("counted") == 1) & (F.col("run") == F.when(F.col("wanglai") == 1, 6).otherwise(4)),
        "open_to_stopped_same_string": F.col("attack") & p("opened") & p("attack") & ~p("compound") & (F.col("mode") == "stopped") & F.col("own_hui").isNotNull() & ~t.contains("罨") & F.arrays_overlap(p("strings"), strings),
        "ordinary_open_same_string_reattack": F.col("single") & plain_open & was_plain_open & (F.col("string") == p("string")),
        "harmonic_to_same_string_attack": F.col("attack") & p("attack") & (p("mode") == "harmonic") & F.arrays_overlap(p("strings"), strings) & ~((F.col("mode") == "harmonic") & F.col("single") & p("single") & F.col("hui").eqNullSafe(p("hui"))),
        "walk_inside_harmonic_region": F.col("scope") & F.col("walk").isNotNull() & (F.size(strings) == 0),
        "nonadjacent_pluck_pair": F.col("marks.pair_pluck") & (F.size(F.array_distinct(strings)) == 2) & (F.abs(F.get(strings, 0) - F.get(F.array_distinct(strings), 1)) > 1),
        "same_string_cuo_pair": F.col("marks.cuo") & (F.size(strings) == 2) & (F.get(strings, 0) == F.get(strings, 1)),
        "same_finger_reach_too_large": stopped & was_stopped & (F.col("finger") == p("finger")) & (F.abs(F.col("hui") - p("hui")) + F.abs(F.col("string") - p("string")) / 2 >= reach),
        "low_hui_stopped_too_cramped": stopped & ((F.col("string").between(1, 4) & (F.col("hui") <= 4)) | ((F.col("string") == 5) & (F.col("hui") < 4))),
        "tiao_on_first_string": F.col("attack") & (F.col("pluck") == "挑") & (F.array_contains(strings, 1) | (F.col("string") == 1)),
        "slide_attack_missing_left_finger": F.col("pluck").isNotNull() & F.col("marks.slide") & F.col("own_finger").isNull(),
        "same_position_finger_change": stopped & was_stopped & (F.col("finger") != p("finger")) & (F.col("string") == p("string")) & (F.abs(F.col("hui") - p("hui")) < 1e-6) & ~F.col("marks.changes"),
        "jinfu_without_downward_walk": t.contains("进复") & F.col("before_string").isNotNull() & ~F.coalesce(F.col("led") == "down", F.lit(False)),
        "open_attack_ornament": (ornament & F.col("attack") & (F.col("mode") == "open")) | F.col("marks.open_ornament"),
        "li_nonadjacent_strings": F.col("marks.li") & F.exists(F.zip_with(strings, F.slice(strings, 2, 7), lambda a, b: F.abs(a - b) > 1), lambda x: x),
        "thumb_lower_left_position": stopped & was_stopped & (F.col("finger") == "大指") & p("finger").isin("中指", "名指") & (F.col("string") > p("string")) & (F.col("hui") > p("hui") + 1e-6),
        "open_string_unplayable_gesture": (F.col("before_mode") == "open") & F.col("before_string").isNull() & F.col("pluck").isNull() & (F.size(strings) == 0) & (F.col("walk").isNotNull() | t.isin("吟", "猱")),
        "kneeling_taoqi_below_seventh_hui": t.contains("滔起") & t.contains("跪指") & (F.coalesce("own_hui", "before_hui") > 7),
        "taoqi_without_thumb_origin": t.contains("滔起") & F.col("before_finger").isNotNull() & (F.col("before_finger") != "大指"),
        "repeated_fu_without_walk": (t == "复") & (p("t") == "复"),
        "fu_without_walk_origin": (t == "复") & ~F.coalesce(p("t") == "复", F.lit(False)) & (F.col("origin_string").isNull()),
        "harmonic_ornament_without_stopped": ornament & F.col("scope") & ~t.contains("按音") & ~F.coalesce(p("t").contains("按音"), F.lit(False)),
        "missing_independent_attack": (t == "") & sounding & p("single") & changed(F.col("targets"), p("targets")),
        "illegal_blank_after_walk": (t == "") & sounding & p("walk").isNotNull() & changed(F.col("targets"), p("targets")),
    }
    codes = F.array(*[F.when(F.coalesce(rule, F.lit(False)) & ~F.col("rest_here"), F.lit(code)) for code, rule in rules.items()])
    found = rows.select("score", "idx", F.explode_outer(F.filter(codes, lambda c: c.isNotNull())).alias("code"))
    return found.where("code IS NOT NULL")
