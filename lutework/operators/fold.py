"""Replay of reduced tablature as an ordered fold: each row is read by Spark's expressions, and a small state is carried from row to row of a score.

`read` turns each cell into facts (strings, stud, finger, markers, pairs, walks) by column expressions; cells that lift a finger also have the facts of what is left
beside that gesture. The facts of the VOCABULARY commonest texts are found once and sent to the tasks; any other cell is read in its row. `folded` sorts each score's rows within its partition and carries one Hand along, across the borders of batches; a new score begins a new
Hand, so that a task holds one row and one state at a time, however long a score is. Pitches and the audit against targets are column expressions over what it gives.

State: the place of each finger in the order of their last use, the contact (string and place) that abbreviated cells inherit, the finger, the manner of the last
sound, whether a harmonic region is open and where it is touched, the contact before the last walk, and whether an open string sounded before the last rest.
Bare rests end the manner, the region and the walk, and leave the hand where it is.

Defined results: null text is blank; what a structural row says is read like any other, and rests are rows with rest true and blank text; order within a score is by idx, and rows with
equal idx in any order; a place between studs beyond the thirteenth has no pitch (hui_out_of_range); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import music, text

# The words of the notation, in order of precedence.
FINGERS = ["大指", "名指", "中指", "食指", "跪指"]
PLUCKS = ["挑", "勾", "抹", "剔", "托", "擘", "打", "摘", "撮", "泼", "剌", "历", "歷", "厉", "轮", "輪"]
ORNAMENTS = ["吟", "猱", "撞", "逗", "往来", "复", "掐起", "带起", "抓起", "爪起", "滔起"]
DIRECTIONS = ["上", "下", "进", "退", "绰", "注", "浒", "淌", "引上"]
PAIRED_STROKES = "勾剔|抹挑|抹勾|挑勾|涓"
_N, _STUD = "[一二三四五六七1-7]", "(?:(?:十三|十二|十一|十|九|八|七|六|五|四|三|二|一)徽(?:[一二三四五六七八九]分)?|徽外半|徽外)"

Place = float | str
PLACE = "struct<string:int,hui:double,label:string,mode:string>"


# What a cell says


def _stud(t: Column) -> Column:
    return F.struct(text.stud(t).cast("double").alias("hui"), text.stud_label(t).alias("label"))


def _parts(t: Column) -> Column:
    """The parts of a bracketed pluck of two strings; null unless there are two."""
    inner = F.regexp_extract(t, r"[撮泼剌]\s*[（(]([^）)]*)[）)]", 1)
    parts = F.filter(F.transform(F.split(inner, "[＋+、]"), lambda p: F.trim(p)), lambda p: p != "")

    def part(p: Column) -> Column:
        return F.struct(
            text.string_numbers(p).alias("strings"), _stud(p).alias("at"), text.first_of(p, FINGERS).alias("finger"), p.contains("泛音").alias("harmonic"), p.contains("按音").alias("stopped"), p.contains("散音").alias("opened")
        )

    return F.when(F.size(parts) == 2, F.transform(parts, part))


def _mixed(t: Column) -> Column:
    """A bracketed pluck of a stopped and an open string, in any of four orders: its strings, place and finger; null for others."""
    head, by = r"[撮泼剌]（?（?[^）]*?", "[＋+、]"
    forms = [
        (f"{head}({_STUD})({_N})弦(?:按音)?{by}({_N})弦散音", 1, 2, 3), (f"{head}({_N})弦散音{by}[^）]*?({_STUD})({_N})弦(?:按音)?", 2, 3, 1),
        (f"{head}({_N})弦({_STUD})(?:按音)?{by}({_N})弦散音", 2, 1, 3), (f"{head}({_N})弦散音{by}[^）]*?({_N})弦({_STUD})(?:按音)?", 3, 2, 1),
    ]
    inner = F.regexp_extract(t, r"[撮泼剌]\s*[（(]([^）)]*)[）)]", 1)

    def found(form: tuple) -> Column:
        pattern, place, stopped, opened = form
        string = text.number(F.regexp_extract(t, pattern, stopped))
        own = F.get(F.filter(F.split(inner, "[＋+、]"), lambda p: ~p.contains("散音") & F.array_contains(text.string_numbers(p), string)), 0)
        side = F.when(inner != "", F.coalesce(own, F.lit(""))).otherwise(t)
        fields = F.struct(string.alias("stopped"), _stud(F.regexp_extract(t, pattern, place)).alias("at"), text.number(F.regexp_extract(t, pattern, opened)).alias("opened"), text.first_of(side, FINGERS).alias("finger"))
        return F.when(F.regexp_extract(t, pattern, 0) != "", fields)

    return F.coalesce(*[found(x) for x in forms])


def facts(t: Column) -> Column:
    """What a cell says by itself, as a struct."""
    starts, stops = F.locate("泛起", t), F.locate("泛止", t)
    sweep, numbers, pluck, label = text.sweep_strings(t), text.string_numbers(t), text.first_of(t, PLUCKS), text.stud_label(t)
    strings = F.when(F.size(sweep) > 0, sweep).otherwise(numbers)
    placed = text.stud(t).isNotNull() | label.isNotNull()
    taoqi = (F.size(strings) == 0) & (t.contains("掐起") | t.contains("滔起")) & placed
    bare = t.rlike("^(?:急|缓|少)?(?:进|退|上|下)$")
    heads = F.exists(F.array(*[F.lit(x) for x in DIRECTIONS]), lambda x: t.startswith(x))
    pluck_at = F.when(pluck.isNotNull(), F.position(pluck, t)).otherwise(0)
    suffix = F.regexp_extract(t, f"^(.*?)((?:绰上|注下){_STUD.replace('|徽外半|徽外', '')})", 2)
    embedded = F.regexp_instr(t, F.lit("绰上|注下|退|进|引上|淌下"))
    return F.struct(
        (t == "").alias("blank"), F.regexp_extract(t, "(?s)^.*(泛起|泛止)", 1).alias("last_marker"), (F.size(text.invalid_strings(t)) > 0).alias("bad"), text.gesture(t).isNotNull().alias("compound"), _parts(t).alias("parts"), _mixed(t).alias("mixed"),
        (t.contains("爪起") | t.contains("抓起")).alias("thumb_lifts"), t.contains("带起").alias("lifts"), text.first_of(t, FINGERS).alias("finger"), ((starts > 0) & ((stops == 0) | (starts < stops))).alias("opens"),
        (starts > 0).alias("names_start"), (stops > 0).alias("stops"), (stops == 1).alias("stops_first"), (t == "泛止").alias("only_stops"), strings.cast("array<int>").alias("strings"), (F.size(numbers) > 0).alias("names_string"), (F.size(sweep) > 0).alias("sweep"),
        text.number(F.nullif(F.regexp_extract(t, f"散如一\\s*({_N})弦", 1), F.lit(""))).alias("unison"), (t.startswith("至") & pluck.isNull()).alias("arrives"), pluck.isNotNull().alias("plucked"),
        ((F.size(strings) == 0) & (heads | bare | t.isin(ORNAMENTS) | taoqi)).alias("moves"), (t == "复").alias("returns"), bare.alias("bare"), taoqi.alias("taoqi"), t.isin(ORNAMENTS).alias("ornament"), _stud(t).alias("at"),
        t.contains("散").alias("opened"), t.contains("按音").alias("stopped"), t.contains("泛音").alias("harmonic"), t.contains("就").alias("here"),
        _stud(F.when((suffix != "") & (F.position(suffix, t) > pluck_at), suffix)).alias("onward"), ((embedded > 0) & (embedded < pluck_at)).alias("led"),
    )


def cells_of(t: Column) -> Column:
    """What a cell says and, of one that lifts fingers, what is said beside that."""
    without_thumb = F.trim(F.regexp_replace(t, "爪起|抓起", ""))
    beside = F.trim(F.regexp_replace(without_thumb, "带起|同声|同起", ""))
    thumb, named = t.rlike("爪起|抓起"), t.contains("带起")
    return F.transform(F.when(thumb & named, F.array(t, without_thumb, beside)).when(thumb, F.array(t, without_thumb)).when(named, F.array(t, beside)).otherwise(F.array(t)), facts)


#: What the audit asks of a cell.
MARKS = {
    "strings": pa.int32(), "paired": pa.bool_(), "swept": pa.bool_(), "led": pa.bool_(), "placed": pa.bool_(), "slides": pa.bool_(), "brushes": pa.bool_(), "yinghe": pa.bool_(), "fanghe": pa.bool_(),
}


def marks_of(t: Column) -> Column:
    """What the audit asks of a cell, by MARKS."""
    pluck, chuo = text.first_of(t, PLUCKS), F.locate("绰", t)
    slides = pluck.isNull() & F.exists(F.array(*[F.lit(x) for x in ["绰", "注", "淌", "浒", "引上", "上", "下", "进", "退"]]), lambda x: t.startswith(x))
    found = (
        F.size(text.string_numbers(t)), t.rlike(PAIRED_STROKES), F.size(text.sweep_strings(t)) > 0, pluck.isNotNull() & (chuo > 0) & (chuo < F.when(pluck.isNotNull(), F.position(pluck, t)).otherwise(0)),
        text.stud(t).isNotNull() | text.stud_label(t).isNotNull(), slides, t.contains("拂"), t.contains("应合"), t.contains("放合"),
    )
    return F.struct(*[c.alias(name) for c, name in zip(found, MARKS, strict=True)])


def read(notes: DataFrame) -> DataFrame:
    """notes (score, idx, text, rest, ...) with t, the cell's text, and cells."""
    return notes.withColumn("t", _plain("text")).withColumn("cells", cells_of(F.col("t")))


def _plain(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


#: How many texts' facts are sent to the tasks: some MB.
VOCABULARY = 8192


def _spoken(rows: DataFrame, names: dict[str, str]) -> tuple[DataFrame, Broadcast]:
    """The facts and marks of the VOCABULARY commonest texts of the columns that names has, by text; and rows with, by names, a column of the facts and marks of each text that isn't among them, null for
    those that are. Where fewer texts are found, they are all that there are, and no row needs a column of its own: it's null."""
    every = rows.select(F.explode(F.array(*names)).alias("t"))
    common = every.groupBy("t").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "t").limit(VOCABULARY)
    facts = {x["t"]: ([c.asDict(True) for c in x["cells"]], x["marks"].asDict()) for x in common.select("t", cells_of(F.col("t")).alias("cells"), marks_of(F.col("t")).alias("marks")).collect()}
    sent = rows.sparkSession.sparkContext.broadcast(facts)
    if len(facts) < VOCABULARY:
        return rows.withColumns({facts_of: F.lit(None).cast("int") for facts_of in names.values()}), sent
    known = rows.sparkSession.createDataFrame(pa.table({"t": pa.array(list(facts), pa.string())})).withColumn("__known", F.lit(True))
    for name, facts_of in names.items():
        own = F.struct(cells_of(F.col(name)).alias("cells"), marks_of(F.col(name)).alias("marks"))
        rows = rows.join(F.broadcast(known.withColumnRenamed("t", name)), name, "left").withColumn(facts_of, F.when(F.col("__known").isNull(), own)).drop("__known")
    return rows, sent


# The hand


@dataclass
class Hand:
    """The state between rows. Copies share `places` unless a copy gets its own."""

    places: dict[str, tuple[int, Place]] = field(default_factory=dict)
    string: int | None = None
    place: Place | None = None
    finger: str | None = None
    manner: str | None = None
    scope: bool = False
    touch: Place | None = None
    origin: tuple[int | None, Place] | None = None
    open_before_rest: bool = False

    def copy(self) -> Hand:
        """Another hand with fingers of its own."""
        return Hand(dict(self.places), self.string, self.place, self.finger, self.manner, self.scope, self.touch, self.origin, self.open_before_rest)

    def remember(self, string: int, place: Place | None, finger: str | None = None) -> None:
        own = finger or self.finger
        if place is not None and own is not None:
            self.places.pop(own, None)  # the last used comes last
            self.places[own] = (string, place)

    def let_go(self) -> None:
        self.string = self.place = None

    def lose_place(self) -> None:
        """After a move of unknown length."""
        self.place = None
        self.places = {f: x for f, x in self.places.items() if x[0] != self.string}

    def leave_region(self) -> None:
        self.scope, self.touch, self.manner = False, None, None

    def enter_region(self, place: Place | None) -> None:
        self.scope, self.manner = True, "harmonic"
        self.touch = self.touch if place is None else place
        self.let_go()

    def rest(self) -> None:
        self.open_before_rest = self.manner == "open" or self.manner is None and self.open_before_rest
        self.leave_region()
        self.origin = None

    def lifted(self, named: str | None) -> tuple[str, int] | None:
        """The finger that a lift releases, and its string: the named one, else the one in use, else the last one used."""
        if named:
            return (named, self.places[named][0]) if named in self.places else None
        if self.finger and self.string is not None:
            return self.finger, self.string
        last = self.finger if self.finger in self.places else next(reversed(self.places), None)
        return (last, self.places[last][0]) if last else None


Sound = tuple[int, Place | None, str]


@dataclass
class Said:
    """What a row sounds: strings with place and mode, a string freed beside them, and why nothing sounds; attacks are the sounds of its own plucks."""

    sounds: list[Sound] = field(default_factory=list)
    freed: int | None = None
    reason: str | None = None
    attacks: list[Sound] = field(default_factory=list)


def _place(at: dict) -> Place | None:
    return at["label"] if at["label"] is not None else at["hui"]


def _fault(place: Place | None, mode: str) -> str | None:
    """Why a place has no pitch in a mode."""
    if place == History.SEED:
        return None
    if isinstance(place, str):
        return "hui_outside_not_valid_for_harmonic" if mode == "harmonic" else None
    if place is not None and mode != "open" and not 1 <= place <= 13:
        return "hui_out_of_range"
    return "fractional_hui_not_valid_for_harmonic" if mode == "harmonic" and place is not None and place != int(place) else None


def _harmonic_pair(hand: Hand, parts: list[dict]) -> Said:
    sounds: list[Sound] = []
    for p in parts:
        place = _place(p["at"])
        if len(p["strings"]) != 1 or place is None:
            return Said(reason="double_harmonic_position_missing")
        if p["stopped"] or p["opened"]:
            return Said(reason="double_harmonic_mode_conflict")
        if fault := _fault(place, "harmonic"):
            return Said(reason=fault)
        sounds.append((p["strings"][0], place, "harmonic"))
    hand.manner, hand.finger = "harmonic", None
    hand.touch = sounds[0][1] if sounds[0][1] == sounds[1][1] else None
    hand.let_go()
    return Said(sounds, attacks=sounds)


def _stopped_pair(hand: Hand, parts: list[dict]) -> Said | None:
    """Two stopped strings leave none in use, but what they share."""
    sounds: list[Sound] = []
    for p in parts:
        place = _place(p["at"])
        if not p["stopped"] or len(p["strings"]) != 1 or place is None:
            return None
        if fault := _fault(place, "stopped"):
            return Said(reason=fault)
        sounds.append((p["strings"][0], place, "stopped"))
    hand.manner, hand.finger = "stopped", None
    hand.let_go()
    for (string, place, _), p in zip(sounds, parts, strict=True):
        hand.remember(string, place, p["finger"])
    shared, fingers = sounds[0][1] == sounds[1][1], {p["finger"] for p in parts} - {None}
    if shared and hand.scope:
        hand.touch = sounds[0][1]
    if shared and len(fingers) == 1:
        hand.place, hand.finger = sounds[0][1], fingers.pop()
    return Said(sounds)


def _mixed_pair(hand: Hand, pair: dict) -> Said:
    place = _place(pair["at"])
    if fault := _fault(place, "stopped"):
        return Said(reason=fault)
    hand.string, hand.place, hand.manner = pair["stopped"], place, None
    hand.finger = pair["finger"] or hand.finger
    hand.remember(hand.string, place, pair["finger"])
    sounds = [(pair["stopped"], place, "stopped"), (pair["opened"], None, "open")]
    return Said(sounds, attacks=sounds)


def _lift_thumb(hand: Hand, cells: list[dict]) -> Said:
    """The thumb plucks the string that it held while it leaves it; what else the cell says is done by a copy of the hand with the same fingers."""
    freed = hand.string
    if freed is None or hand.finger != "大指":
        return Said(reason="zhuaqi_requires_previous_thumb_stopped_note")
    beside = Said() if cells[1]["blank"] else said(replace(hand), cells[1:])
    if beside.reason:
        return Said(reason=beside.reason)
    hand.manner, hand.finger = "open", None
    hand.let_go()
    hand.places.pop("大指", None)
    return Said(beside.sounds, freed if beside.freed is None else beside.freed)


def _lift_finger(hand: Hand, cells: list[dict]) -> Said:
    """A finger leaves its string, which sounds beside what else the cell says, done by a copy of the hand with fingers of its own."""
    release = hand.lifted(cells[0]["finger"])
    if release is None:
        return Said(reason="daiqi_requires_previous_stopped_note")
    beside = Said() if cells[1]["blank"] else said(hand.copy(), cells[1:])
    if beside.reason:
        return Said(reason=beside.reason)
    finger, freed = release
    hand.places.pop(finger, None)
    if hand.finger == finger:
        hand.manner, hand.finger = "open", None
        hand.let_go()
    return Said(beside.sounds, freed)


def _moved(hand: Hand, cell: dict) -> Said:
    """A movement of the left hand alone."""
    place = _place(cell["at"])
    if cell["returns"]:
        if hand.origin is None or hand.string is None or hand.origin[0] != hand.string:
            hand.lose_place()
            return Said(reason="context_dependent_slide")
        place, hand.origin = hand.origin[1], None
    elif place is not None and hand.string is not None:
        hand.origin = (hand.string, hand.place) if hand.place is not None and not cell["taoqi"] else None
        hand.finger = cell["finger"] or hand.finger
    else:
        if cell["bare"]:
            hand.origin = hand.origin if hand.place is None else (hand.string, hand.place)
            hand.lose_place()
        return Said(reason="ornament_or_control" if cell["ornament"] else "context_dependent_slide")
    hand.place, hand.manner = place, "stopped"
    hand.remember(hand.string, place)
    fault = _fault(place, "stopped")
    return Said(reason=fault) if fault else Said([(hand.string, place, "stopped")])


def _mode(hand: Hand, cell: dict, strings: list[int]) -> str:
    """How a pluck sounds, and what that does to the hand."""
    if cell["opened"] and not cell["opens"] and cell["unison"] is None:
        elsewhere = hand.string is not None and hand.place is not None and hand.string not in strings
        hand.manner = "open"
        hand.places = {f: x for f, x in hand.places.items() if x[0] not in strings}
        hand.finger = hand.finger if hand.finger in hand.places else None
        if not elsewhere:
            hand.let_go()
        return "open"
    if cell["stopped"]:
        hand.manner = "stopped"
        return "stopped"
    if cell["harmonic"] or hand.scope:
        return "harmonic"
    if _place(cell["at"]) is not None or cell["finger"] or cell["here"]:
        return "stopped"
    if hand.manner == "open" or hand.manner is None and hand.open_before_rest:
        hand.manner, hand.open_before_rest = "open", False
        return "open"
    return "stopped"


def _plucked(hand: Hand, cell: dict, strings: list[int]) -> Said:
    place = _place(cell["at"])
    if place is not None and len(strings) != 1 and not cell["sweep"]:
        return Said(reason="ambiguous_multiple_strings")
    if cell["opens"]:
        hand.enter_region(place)
    hand.finger = cell["finger"] or hand.finger
    mode, out = _mode(hand, cell, strings), Said()
    for string in strings:
        own = "open" if string == cell["unison"] else mode
        at = None if own == "open" else place if place is not None else hand.touch if own == "harmonic" else hand.place
        if at is None and own != "open" and (own == "harmonic" or cell["here"]):
            return Said(reason="harmonic_hui_missing" if own == "harmonic" else "current_stopped_position_missing", attacks=out.attacks)
        if fault := _fault(at, own):
            return Said(reason=fault, attacks=out.attacks)
        out.sounds.append((string, at, own))
        out.attacks.append((string, at, own))
        if own == "harmonic":
            hand.touch = at
        elif at is not None:
            hand.manner, hand.string, hand.place = "stopped", string, at
            hand.remember(string, at)
    onward = _place(cell["onward"])
    if len(strings) == 1 and mode == "stopped" and cell["plucked"] and onward is not None:
        hand.origin = None if hand.place is None else (strings[0], hand.place)
        hand.place = onward
        hand.remember(strings[0], onward)
    return out


def _ruled(hand: Hand, cells: list[dict]) -> Said:
    """The first rule that fits."""
    cell = cells[0]
    if cell["blank"] or cell["compound"]:
        return Said(reason="empty_jianzi" if cell["blank"] else "context_dependent_compound_gesture")
    if cell["parts"]:
        if all(p["harmonic"] for p in cell["parts"]):
            return _harmonic_pair(hand, cell["parts"])
        if (both := _stopped_pair(hand, cell["parts"])) is not None:
            return both
    if cell["thumb_lifts"]:
        return _lift_thumb(hand, cells)
    if cell["lifts"]:
        return _lift_finger(hand, cells)
    if cell["stops_first"] and not cell["only_stops"]:
        hand.leave_region()
    if not cell["strings"] and (cell["stops"] or cell["opens"]):
        hand.leave_region() if cell["stops"] else hand.enter_region(_place(cell["at"]))
        return Said(reason="ornament_or_control")
    if cell["arrives"]:
        return Said(reason="context_dependent_transition")
    if cell["moves"]:
        return _moved(hand, cell)
    if cell["mixed"]:
        return _mixed_pair(hand, cell["mixed"])
    strings = cell["strings"]
    inherits = _place(cell["at"]) is not None and cell["plucked"] and hand.manner == "stopped" and hand.string is not None
    if not strings and inherits and not (cell["opened"] or cell["harmonic"] or cell["names_start"]):
        strings = [hand.string]
    return _plucked(hand, cell, strings) if strings else Said(reason="no_explicit_string")


def said(hand: Hand, cells: list[dict]) -> Said:
    """Reads one cell: what it sounds, and the hand after it. Markers of a region before the note apply before any rule, and those after it after."""
    cell = cells[0]
    if hand.scope:
        hand.manner = "harmonic"
    if cell["bad"]:
        return Said(reason="invalid_string_number")
    before, at = hand.origin, (hand.string, hand.place)
    if cell["names_string"] or cell["plucked"] or cell["names_start"] or cell["stops"]:
        hand.origin = None
    if cell["opens"]:
        hand.enter_region(_place(cell["at"]))
    out = _ruled(hand, cells)
    if before and cell["led"] and before[0] == at[0] and at[1] is not None and out.reason is None and len(out.attacks) == 1 and out.attacks[0][::2] == (at[0], "stopped"):
        hand.origin = at  # a pluck that a walk leads to goes on with the walk
    if hand.manner in ("stopped", "harmonic"):
        hand.open_before_rest = False
    if cell["stops"] and not cell["stops_first"]:
        hand.leave_region()
    return out


_SOUND = pa.struct([("string", pa.int32()), ("hui", pa.float64()), ("label", pa.string()), ("mode", pa.string())])
_OUT = {
    "sounds": pa.list_(_SOUND), "attacks": pa.list_(_SOUND), "stopped_sounds": pa.list_(_SOUND), "freed": pa.int32(), "reason": pa.string(), "scope": pa.bool_(), "scope_before": pa.bool_(), "string": pa.int32(), "hui": pa.float64(), "label": pa.string(),
    "finger": pa.string(), "manner": pa.string(), "origin_string": pa.int32(), "places": pa.map_(pa.string(), _SOUND),
}
_DDL = f"sounds array<{PLACE}>, attacks array<{PLACE}>, stopped_sounds array<{PLACE}>, freed int, reason string, scope boolean, scope_before boolean, string int, hui double, label string, finger string, manner string, origin_string int, places map<string,{PLACE}>"


def _sound(x: Sound) -> dict:
    string, place, mode = x
    return {"string": string, "hui": None if isinstance(place, str) else place, "label": place if isinstance(place, str) else None, "mode": mode}


def _advance(hand: Hand, cells: list[dict], rest: bool) -> Said:
    """Carries the hand over one row."""
    out = said(hand, cells)
    if rest and cells[0]["blank"]:
        hand.rest()
    return out


def _stepped(hand: Hand, cells: list[dict], rest: bool, beside: bool = True) -> tuple:
    """One row: what it sounds and the hand after it, as values in the order of _OUT that are hashed. stopped_sounds is what it would have sounded outside the region, of rows within one that state no manner;
    it isn't sought without beside."""
    scope_before, other = hand.scope, None
    cell = cells[0]
    if beside and scope_before and not (cell["stopped"] or cell["opened"] or cell["names_start"] or cell["stops"]):
        other = hand.copy()
        other.leave_region()
        other = said(other, cells)
    shown = hand.scope or cell["opens"]
    out = _advance(hand, cells, rest)
    place, named = hand.place, isinstance(hand.place, str)
    return (
        tuple(out.sounds) if out.reason is None else (), tuple(out.attacks), tuple(other.sounds) if other and other.reason is None else None, out.freed if out.reason is None else None, out.reason,
        shown and not cell["stops_first"], scope_before, hand.string, None if named else place, place if named else None, hand.finger, hand.manner, hand.origin[0] if hand.origin else None, tuple(hand.places.items()),
    )


def _sounds(some: tuple[Sound, ...] | None) -> list[dict] | None:
    return None if some is None else [_sound(x) for x in some]


def _places(some: tuple) -> list[tuple[str, dict]]:
    return [(f, _sound((s, p, "stopped"))) for f, (s, p) in some]


#: What the reference sounds, beside a prediction.
_OWN = {"own_sounds": pa.list_(_SOUND), "own_freed": pa.int32(), "own_reason": pa.string()}
_OWN_DDL = f"own_sounds array<{PLACE}>, own_freed int, own_reason string"
_NESTED = {"sounds": _sounds, "own_sounds": _sounds, "attacks": _sounds, "stopped_sounds": _sounds, "places": _places}


def step(hand: Hand, cells: list[dict], rest: bool) -> dict:
    """One row, by name."""
    return {k: _NESTED[k](v) if k in _NESTED else v for k, v in zip(_OUT, _stepped(hand, cells, rest), strict=True)}


def _column(name: str, values: tuple, kind: pa.DataType) -> pa.Array:
    """A column of the output: nested values are built once for all rows of a batch that share them."""
    if name not in _NESTED:
        return pa.array(values, kind)
    own: dict = {}
    at = [own.setdefault(v, len(own)) for v in values]
    return pa.array([_NESTED[name](v) for v in own], kind).take(pa.array(at, pa.int32()))


class Replay:
    """The fold of one score."""

    def __init__(self) -> None:
        self.hand = Hand()

    def row(self, cells: list[dict], rest: bool, beside: bool = True) -> tuple:
        return _stepped(self.hand, cells, rest, beside)


class History:
    """The fold of one score's predicted phrases, each after the reference of all that comes before it.

    The reference's hand goes through the whole score once; where a phrase begins, the prediction's hand is a copy of it. With seeds, a region may be forced at
    the border: of a phrase that begins in a harmonic region, by its own say or else by the markers before it, the copy is that of a second hand, which went through
    the reference as though it had begun within a region, touched where the reference last sounded a harmonic (SEED stands for that until then); any other phrase
    that has a history begins outside every region, as after a 泛止."""

    SEED = "seed"

    def __init__(self, seeds: bool) -> None:
        self.seeds, self.phrase, self.begun = seeds, None, False
        self.reference, self.prediction = Hand(), Hand()
        self.seeded = Hand(scope=True, manner="harmonic", touch=self.SEED)
        self.marked, self.touched = False, None

    def border(self, region: bool | None) -> Hand:
        allowed = self.marked if region is None else region
        seeded = self.seeds and allowed and self.touched is not None
        hand = self.seeded if seeded else self.reference
        hand = hand.copy()
        hand.touch = self.touched if hand.touch == self.SEED else hand.touch
        if self.seeds and self.begun and not allowed:
            hand.leave_region()
            hand.origin = None
        return hand

    def row(self, cells: list[dict], reference: list[dict], rest: bool, phrase: object, region: bool | None, beside: bool = True) -> tuple:
        """The prediction's row, as _stepped gives it, and then what the reference sounds there."""
        if not self.begun or phrase != self.phrase:
            self.prediction, self.phrase = self.border(region), phrase
        out = _stepped(self.prediction, cells, rest, beside)
        said_so = _advance(self.reference, reference, rest)
        if self.seeds:
            _advance(self.seeded, reference, rest)
            self.touched = next((place for _, place, mode in reversed(said_so.sounds) if mode == "harmonic"), self.touched) if said_so.reason is None else self.touched
            marker = reference[0]["last_marker"]
            self.marked = (marker == "泛起" if marker else self.marked) and not (rest and reference[0]["blank"])
        self.begun = True
        return (*out, *((tuple(said_so.sounds), said_so.freed) if said_so.reason is None else ((), None)), said_so.reason)


def _carried(rows: DataFrame, start: Callable[[], Replay | History], texts: dict[str, str], inputs: list[str], drop: list[str], out: dict[str, pa.DataType], ddl: str, leave: tuple[str, ...]) -> DataFrame:
    """rows without drop, and with out, what the fold gives, which takes the facts of texts and inputs of each row in the order of score and idx; and the marks of texts, by their names. Columns to leave are null.

    A window deals the rows by score, so that rows that are dealt so already aren't dealt again; the order is sorted after it, since other windows may be put above it."""
    kept, marks = [c for c in rows.columns if c not in drop], pa.struct(MARKS)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    said = ", ".join(f"`{c}` struct<{', '.join(f'{k}: {"int" if v == pa.int32() else "boolean"}' for k, v in MARKS.items())}>" for c in texts.values())
    facts_of = {c: f"__{c}_facts" for c in texts}
    rows, sent = _spoken(rows, facts_of)
    beside = "stopped_sounds" not in leave

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, score, known = None, None, sent.value

        def spoken(batch: pa.RecordBatch, name: str) -> tuple[list[int], list[tuple]]:
            """Which of the batch's texts each row has, and their facts and marks."""
            found = batch.column(name).dictionary_encode()
            at, facts = found.indices.to_pylist(), [known.get(t) for t in found.dictionary.to_pylist()]
            for i, n in enumerate(at):
                if facts[n] is None:
                    own = batch.column(facts_of[name])[i].as_py()
                    facts[n] = own["cells"], own["marks"]
            return at, facts

        for batch in batches:
            if not batch.num_rows:
                continue
            made = []
            own, *given = (batch.column(c).to_pylist() for c in ("score", *inputs))
            read = [spoken(batch, c) for c in texts]
            cells = [[facts[n][0] for n in at] for at, facts in read]
            for new, *values in zip(own, *cells, *given, strict=True):
                if state is None or new != score:
                    state, score = start(), new
                made.append(state.row(*values, beside))
            columns = [pa.nulls(len(own), kind) if name in leave else _column(name, values, kind) for (name, kind), values in zip(out.items(), zip(*made, strict=True), strict=True)]
            columns += [pa.array([x for _, x in facts], marks).take(pa.array(at, pa.int32())) for at, facts in read]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + columns, [*kept, *out, *texts.values()])

    ordered = rows.withColumn("__place", F.row_number().over(Window.partitionBy("score").orderBy("idx"))).sortWithinPartitions("score", "idx")
    return ordered.mapInArrow(run, f"{schema}, {ddl}, {said}")


def folded(notes: DataFrame, leave: tuple[str, ...] = ()) -> DataFrame:
    """notes (score, idx, text, rest, ...) with, of each row, sounds, attacks, freed, reason, the region, and the hand after it: string, hui, label, finger, manner,
    origin_string and places by finger, null of those to leave; and pitches are added by `sounded`."""
    return _carried(notes.withColumn("t", _plain("text")), Replay, {"t": "__marks"}, ["rest"], [], _OUT, _DDL, leave)


def after_history(notes: DataFrame, seeds: bool = False, leave: tuple[str, ...] = ()) -> DataFrame:
    """notes (score, idx, phrase, text (predicted), reference, rest, and with seeds region: whether the phrase begins in one, null if that isn't said), each predicted phrase folded after the
    reference of all rows before it, in time linear in the rows: the reference is gone through once, not once for each phrase. What the reference sounds is in own_sounds, own_freed and own_reason."""
    rows = notes.withColumns({"t": _plain("text"), "__said": _plain("reference")})
    if not seeds:
        rows = rows.withColumn("region", F.lit(None).cast("boolean"))
    return _carried(rows, lambda: History(seeds), {"t": "__marks", "__said": "__own_marks"}, ["rest", "phrase", "region"], [], _OUT | _OWN, f"{_DDL}, {_OWN_DDL}", leave)


def own_rows(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of after_history as `folded` gives those of their references, with what is to keep; the hand is not among it. Like `audited`, after `ahead`, it needs no other row."""
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("attacks", f"array<{PLACE}>"), ("stopped_sounds", f"array<{PLACE}>"), ("string", "int"), ("hui", "double"), ("label", "string"))]
    named = {"reference": "text", "__said": "t", "__own_next": "__next", "__own_coming": "__coming", "__own_marks": "__marks", "own_sounds": "sounds", "own_freed": "freed", "own_reason": "reason"}
    return rows.select("score", "idx", "structural", "rest", "targets", *keep, *none, *[F.col(a).alias(b) for a, b in named.items()])


# Pitches and the audit


def _pitches(sounds: Column, freed: Column, tuning: Column) -> Column:
    """Of sounds, and of the freed string if none of them is the same pitch. A stopped string of unknown place sounds as an open one."""

    def pitch(x: Column) -> Column:
        unknown = (x["mode"] == "stopped") & x["hui"].isNull() & x["label"].isNull()
        return music.position_pitch(F.get(tuning, x["string"] - 1), x["hui"], x["label"], F.when(unknown, "open").otherwise(x["mode"]))

    own, open_ = F.transform(sounds, pitch), F.get(tuning, freed - 1)
    return F.when(freed.isNotNull() & ~F.array_contains(own, open_), F.concat(own, F.array(open_))).otherwise(own)


def sounded(rows: DataFrame, open_midi: list[float] | Column = music.STANDARD_TUNING) -> DataFrame:
    """Folded rows with pitches, and stopped_pitches where stopped_sounds are. open_midi: the tuning, or a column of it."""
    tuning = open_midi if isinstance(open_midi, Column) else F.array(*[F.lit(float(x)) for x in open_midi])
    none = F.lit(None).cast("int")
    return rows.withColumns({"pitches": _pitches(F.col("sounds"), F.col("freed"), tuning), "stopped_pitches": _pitches(F.col("stopped_sounds"), none, tuning), "tuning": tuning})


def ahead(rows: DataFrame, keys: tuple[str, ...], name: str = "text", to: str = "__") -> DataFrame:
    """rows (keys, idx, structural, targets and the cells' text by name) with what `audited` takes of the rows that come: the next text, and idx and target of as many rows as a cell may sound; both null
    where the cell sounds no other row. It needs nothing of the fold, so that it can come before it, where rows are dealt by their scores."""
    order = Window.partitionBy(*keys, "structural").orderBy("idx")
    more = _plain(name).rlike(f"[历歷厉]|{PAIRED_STROKES}")
    coming = F.collect_list(F.struct("idx", F.get("targets", 0).alias("p"))).over(order.rowsBetween(0, 6))  # a cell names seven strings at most
    return rows.withColumns({f"{to}next": F.when(more, F.lead(_plain(name)).over(order)), f"{to}coming": F.when(more, coming)})


def audited(rows: DataFrame, cents: float = 50.0, keys: tuple[str, ...] = ("score",)) -> DataFrame:
    """Sounded rows (with structural and targets, the pitches that are wanted) with status (matched, mismatched or skipped), verdict (why), error and mean_error in cents,
    covered (the idx of the rows that a sweep or a double stroke sounds) and resolved (string, place and pitch of each sound that is known).

    Sweeps and double strokes are held against the targets of as many rows as they sound, in order, up to the first row without one; bars don't count. Other
    pitches are paired in the order of height, which no other pairing beats. A row with one target and several sounds matches by any of them. keys: what rows a sweep
    may go on to share."""
    if "__next" not in rows.columns:
        rows = ahead(rows, keys)
    if "__marks" not in rows.columns:
        rows = rows.withColumn("__marks", marks_of(F.col("t")))
    mark = {k: F.col("__marks")[k] for k in MARKS}
    clean = F.col("reason").isNull()
    twice = mark["paired"] & (mark["strings"] == 1) & (F.size("pitches") == 1) & clean & (F.col("__next") == "") & ~F.col("structural")
    rows = rows.withColumns({"twice": twice, "swept": mark["swept"], "coming": F.col("__coming")})
    proven = (mark["strings"] == 1) & mark["placed"] & (F.size("pitches") == 1) & clean
    unproven = mark["led"] & ~proven
    slide = mark["slides"] & (F.size("pitches") == 0)
    none = F.array().cast("array<double>")
    actual = F.when(unproven, none).when(F.col("twice"), F.concat("pitches", "pitches")).otherwise(F.col("pitches"))
    why = F.when(unproven, "context_dependent_pre_attack_technique").when(slide, F.coalesce("reason", F.lit("context_dependent_slide"))).otherwise(F.col("reason"))
    rows = rows.withColumns({"actual": actual, "why": why})
    sequential = (F.col("swept") | F.col("twice")) & (F.size("pitches") * F.when(F.col("twice"), 2).otherwise(1) > 1) & ~F.col("structural")
    run = F.slice("coming", F.lit(1), F.size("pitches") * F.when(F.col("twice"), 2).otherwise(1))
    gap = F.array_position(F.transform(run, lambda x: x["p"].isNull()), True)
    run = F.when(gap > 0, F.slice(run, F.lit(1), F.greatest(gap - 1, F.lit(0)).cast("int"))).otherwise(run)
    rows = rows.withColumns({"sequential": sequential, "run": F.when(sequential, run)})
    wanted = F.when(F.coalesce(F.size("run"), F.lit(0)) > 0, F.transform("run", lambda x: x["p"])).otherwise(F.col("targets"))
    rows = rows.withColumn("wanted", wanted)
    in_order = lambda x: F.when(F.col("sequential"), x).otherwise(F.array_sort(x))
    errors = F.zip_with(in_order(F.col("wanted")), in_order(F.col("actual")), lambda a, b: F.abs(a - b) * 100)
    n_wanted, n = F.size("wanted"), F.size("actual")
    joined = mark["yinghe"] | mark["fanghe"]
    least = F.array_min(F.transform("actual", lambda x: F.array_min(F.transform("wanted", lambda y: F.abs(x - y) * 100))))
    main = (n_wanted == 1) & (n > 1) & ~F.col("sequential") & (least <= cents)
    kind = (
        F.when(n_wanted == 0, "no_sounding_jianpu").when(mark["brushes"], "compound_sweep_pitch_ambiguous").when(F.col("why").isNotNull(), F.col("why"))
        .when(joined & (n_wanted == 2), F.concat(F.when(mark["yinghe"], "yinghe").otherwise("fanghe"), F.when(least <= cents, "_single_pitch_match").otherwise("_no_pitch_match")))
        .when((n_wanted != n) & main, "single_symbol_multivoice_main_note").when(n_wanted != n, F.when(F.col("swept"), "li_pitch_count_mismatch").otherwise("pitch_count_mismatch"))
    )
    skipped = (n_wanted == 0) | mark["brushes"] | F.col("why").isNotNull()
    rows = rows.withColumns({"verdict": kind, "errors": F.when(~skipped & (n_wanted == n) & ~(joined & (n_wanted == 2)), errors).when(~skipped & ((joined & (n_wanted == 2)) | main), F.array(least))})
    worst = F.array_max("errors")
    status = F.when(skipped, "skipped").when(F.coalesce(worst <= cents, F.lit(False)), "matched").otherwise("mismatched")
    close = lambda x: F.exists("actual", lambda y: F.abs(x["midi"] - y) < 1e-6)
    with_pitch = F.transform("attacks", lambda x: F.struct(x["string"].alias("string"), x["hui"].alias("hui"), x["label"].alias("label"), x["mode"].alias("mode"), F.get(_pitches(F.array(x), F.lit(None).cast("int"), F.col("tuning")), 0).alias("midi")))
    contact = F.struct("string", "hui", "label", F.lit("stopped").alias("mode"), F.get(_pitches(F.array(F.struct("string", "hui", "label", F.lit("stopped").alias("mode"))), F.lit(None).cast("int"), F.col("tuning")), 0).alias("midi"))
    own = F.filter(with_pitch, close)
    held = F.filter(F.array(contact), lambda x: (F.size("sounds") > 0) & x["string"].isNotNull() & (x["hui"].isNotNull() | x["label"].isNotNull()) & close(x))
    resolved = F.when(F.size(own) > 0, own).when((F.size("actual") == 1) & F.col("why").isNull(), held).otherwise(F.filter(own, lambda x: F.lit(False)))
    outside = F.zip_with(F.array_sort("wanted"), F.array_sort("stopped_pitches"), lambda a, b: F.abs(a - b) * 100)
    hint = F.col("verdict").isNull() & (F.size("stopped_pitches") == n_wanted) & (F.array_max(outside) <= cents)
    out = rows.withColumns({"status": status, "error": F.round(worst, 3), "mean_error": F.round(F.aggregate("errors", F.lit(0.0), lambda s, x: s + x) / F.size("errors"), 3), "covered": F.transform("run", lambda x: x["idx"]), "resolved": resolved})
    out = out.withColumn("stopped_would_match", (F.col("status") == "mismatched") & F.coalesce(hint, F.lit(False)))
    return out.drop("twice", "swept", "coming", "why", "sequential", "run", "errors", "tuning", "stopped_pitches", "stopped_sounds", "__next", "__coming", "__marks")


#: What the parts of a phrase's score weigh.
WEIGHTS = {"pitch": 0.45, "tone": 0.15, "playability": 0.15}


def phrase_report(both: DataFrame, keys: list[str], fails: list[str]) -> DataFrame:
    """Of rows (keys, own and tried, structs of status, reason, attacks, sounds and rest: what the reference and the prediction audit to), a row for each phrase: how many events,
    those that the reference itself fails (mismatched, or for one of the reasons fails), and of the others the share of matched pitches and of playable cells; the share of
    equal manners of all cells of one sound; and the mean of these parts, by WEIGHTS of those that can be judged."""
    broken = lambda side: (F.col(f"{side}.status") == "mismatched") | F.coalesce(F.col(f"{side}.reason").isin(fails), F.lit(False))

    def tone(side: str) -> Column:
        return F.when(F.col(f"{side}.reason").isNull() & (F.size(f"{side}.sounds") == 1), F.get(f"{side}.sounds", 0)["mode"])

    event, clean, status = ~F.coalesce(F.col("own.rest"), F.lit(False)), ~broken("own"), F.col("tried.status")
    counted = both.groupBy(*keys).agg(
        F.count_if(event).alias("n_events"), F.count_if(event & ~clean).alias("n_excluded"), F.count_if(event & clean & (status != "skipped")).alias("n_pitch"), F.count_if(event & clean & (status == "matched")).alias("n_matched"),
        F.count_if(event & clean & broken("tried")).alias("n_broken"), F.count_if(event & clean).alias("n_clean"), F.count_if(event & tone("own").isNotNull()).alias("n_tone"), F.count_if(event & (tone("own") == tone("tried"))).alias("n_same"),
    )
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    parts = counted.withColumns({"pitch": share("n_matched", "n_pitch"), "tone": share("n_same", "n_tone"), "playability": 1 - share("n_broken", "n_clean")})
    sums = [sum((F.coalesce(x, F.lit(0.0)) for x in some), F.lit(0.0)) for some in ([w * F.col(k) for k, w in WEIGHTS.items()], [F.when(F.col(k).isNotNull(), w) for k, w in WEIGHTS.items()])]
    shown = [F.round(F.try_divide(*sums), 6).alias("total"), *[F.round(k, 6).alias(k) for k in WEIGHTS]]
    return parts.select(*keys, "n_events", "n_excluded", "n_pitch", "n_broken", *shown)


def example(*cells: str) -> list[Row]:
    """Rows of one score for trying things out: a cell each, or None for a bare rest."""
    return [Row(score=1, idx=i, text=c or "", rest=c is None, structural=False, targets=[]) for i, c in enumerate(cells)]
