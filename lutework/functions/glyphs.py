"""Glyphs of tablature as trees of coded slots, decoded to cell texts by column expressions.

A glyph has a type and a map of slots. Each type is a row of parts, each part a slot and the table that its code is looked up in; what no type names is either a pluck of two strings, in one of three
layouts, or its slots one after another, each by the first table that knows it. Codes that no table has stand for themselves.

Defined results: null and empty slots aren't there; a null map is an empty glyph, whose text is empty but for the words that its type always has; other slots are ignored where a type names its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .music import _lookup
from .text import rendered_stud

# The codes of fingers, plucks, slides, leads and marks.
LEFT = {"d": "大指", "s": "食指", "z": "中指", "m": "名指", "g": "跪指"}
RIGHT = {
    "m": "抹", "t": "挑", "g": "勾", "q": "剔", "mt": "抹挑", "tm": "挑抹", "tg": "挑勾", "gt": "勾挑", "p": "劈", "tuo": "托", "l": "历", "bo": "拨", "c": "刺", "duo": "打", "z": "摘", "jia": "夹", "li": "历", "lj": "连涓", "o": "托",
    "csuo": "长锁", "gq": "勾剔", "b": "擘", "j": "涓", "lun": "轮", "gun": "滚", "qf": "全扶", "fu": "拂", "yl": "圆搂", "y": "罨", "d": "打", "xy": "虚罨", "bsuo": "背锁", "mg": "抹勾", "suo": "锁", "blun": "半轮", "dsuo": "短锁", "dz": "打摘", "yj": "摘涓",
}
SLIDES = {"d:": "注下", "u:": "绰上", "hu:": "浒上", "ed:": "退复", "eu:": "进复", "t:": "退", "j:": "进", "td:": "淌", "yu:": "引上", "zd:": "注下"}
OPENS, CLOSES, LIFTS = {"pc:": "撮[", "pp:": "泼[", "pl:": "剌[", "pfc:": "反撮[", "c:": ""}, {"s:": "散"}, {"tq:": "滔起"}
FRONTS, LEADS, ARRIVES = {"c:": "绰", "f:": "泛音", "sry:": "散如一"}, {"jiu:": "就", "s:": "散"}, {"zhi:": "至"}
PAIRS = {"pc:": "撮", "pp:": "泼", "pl:": "剌", "pt:": "弹", "pet:": "双弹", "pst:": "三弹", "ppl:": "泼剌", "pfc:": "反撮"}
MARKS = {
    ":yin": "吟", ":nao": "猱", ":yin:luo": "吟猱", ":yin:ding": "吟定", ":yin:hua": "吟滑", ":yin:ji": "急吟", ":yin:fei": "飞吟", ":yin:sua": "双吟", ":yin:xi": "细吟", ":yin:you": "游吟", ":yin:ca": "吟搯", ":yin:zhuang": "撞吟", ":yin:suax": "吟锁",
    ":nao:ca": "长猱", ":nao:da": "猱打", ":nao:dang": "荡猱", ":nao:fei": "飞猱", ":nao:hua": "猱滑", ":nao:ji": "急猱", ":nao:sua": "猱锁", ":nao:tui": "猱退", ":nao:zua": "走猱", ":za": "撞", ":za:fan": "撮泛", ":za:hua": "撮滑", ":za:sua": "撮锁",
    ":fqi": "泛起", ":fzhi": "泛止", ":fang": "放", ":fu": "复", ":tui": "退", ":tuifu": "退复", ":jin": "进", ":jinfu": "进复", ":dou": "逗", ":man": "慢", ":huan": "唤", ":ful": "拂", ":laful": "历拂", ":tfu": "拖拂", ":jfu": "进复", ":zz": "再作", ":dq": "带起",
    ":sx": "少息", ":fenk": "分开", ":wl": "往来", ":zq": "爪起", ":ts": "同声", ":bd": "不动", ":k": "[再作标记ㄱ]", ":zkez": "再作二声", ":zksz": "再作三声", ":ztzz": "从头再作", ":tcss": "掐撮三声",
}
#: One glyph of type zhtyx whose c: is no 绰.
PLAIN_C = {"z": "m", "h": "X", "t": "c:", "y": "d", "x": "2"}

#: By type: slots and what each is.
FORMS = {
    "zhyx": "a:left b:stud d:right e:string", "zhtyx": "t:front z:left h:stud y:right x:string", "zht": "a:left b:stud c:lift", "th": "t:slide h:stud", "tyx": "c:lead d:right e:string", "yx": "c:arrive d:right e:string", "tx": "c:arrive d:right e:string", "x": "c:arrive d:right e:string", "d": "d:mark",
}


def _studs() -> dict[str, str]:
    """The compact codes of studs and tenths, written out: 79 is the seventh stud and nine tenths, X the tenth, X1 to X3 the eleventh to the thirteenth, X23 the twelfth and three tenths."""
    digits = "〇一二三四五六七八九"
    names = {n: digits[n] if n < 10 else "十" + digits[n - 10] * (n > 10) for n in range(1, 14)}
    tenth = lambda t: f"{digits[t]}分" if t else ""
    out = {"X": "十徽", "Y": "徽外", "": ""}
    out |= {f"{n}": f"{names[n]}徽" for n in range(1, 10)} | {f"{n}{t}": f"{names[n]}徽{tenth(t)}" for n in range(1, 10) for t in range(10)}
    out |= {f"X{n - 10}": f"{names[n]}徽" for n in (11, 12, 13)} | {f"X{t}": f"十徽{tenth(t)}" for t in range(4, 10)} | {f"X{n - 10}{t}": f"{names[n]}徽{tenth(t)}" for n in (11, 12, 13) for t in range(10)}
    return out


def _word(code: Column, *tables: dict[str, str], other: Column | None = None) -> Column:
    """The code's word by the first table that has it; without any, other, or the code itself."""
    return F.coalesce(*[_lookup(t)[code] for t in tables], code if other is None else other)


def _stud(code: Column) -> Column:
    return F.coalesce(_lookup(_studs())[code], rendered_stud(code))


def decoded(df: DataFrame, kind: Column, slots: Column, raw: Column, name: str = "cell") -> DataFrame:
    """df with the cell text of each glyph: its type, its slots (a map, in order) and, where it was captured so, its raw slots (a map or null). What several parts need is a column of
    its own on the way, so that each code is looked up once."""
    none = F.create_map().cast("map<string,string>")
    own = df.columns
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), kind.alias("tp"), F.map_filter(F.coalesce(slots, none), lambda k, v: v.isNotNull() & (v != "")).alias("s"), F.coalesce(raw, none).alias("r"))
    s, r = lambda k: F.coalesce(F.col("s")[k], F.lit("")), lambda k: F.coalesce(F.col("r")[k], F.lit(""))

    # of a typed glyph, each role's code
    roles: dict[str, list[tuple[str, str]]] = {}
    for tp, form in FORMS.items():
        for slot, role in (x.split(":") for x in form.split()):
            roles.setdefault(role, []).append((tp, slot))

    def code(role: str) -> Column:
        out = F.lit("")
        for tp, slot in roles[role]:
            out = F.when(F.col("tp") == tp, s(slot)).otherwise(out)
        return out

    rows = rows.withColumns({f"{role}_code": code(role) for role in roles} | {"typed": F.coalesce(F.col("tp").isin(list(FORMS)), F.lit(False)), "pair": _lookup(PAIRS)[s("a")]})
    by_raw = r("off_8").isin(list(PAIRS)) & (r("off_c") != "") & (r("off_10") != "") & (r("off_14") != "")
    pick = lambda a, b: F.when(F.col("by_raw"), r(a)).otherwise(s(b))
    rows = rows.withColumn("by_raw", by_raw)
    # of a pair, the codes of either string; the compact layout names one finger only, in its own slot
    compact = _lookup(LEFT)[F.regexp_replace(s("e"), ":+$", "")].isNotNull() & (s("f") != "") & (s("g") != "") & (s("b") == "") & (s("c") == "")
    rows = rows.withColumn("compact", F.coalesce(compact, F.lit(False)))
    rows = rows.withColumns({
        "finger1": F.when(F.col("compact"), F.regexp_replace(s("e"), ":+$", "")).otherwise(pick("off_c", "b")), "stud1": F.when(F.col("compact"), s("f")).otherwise(pick("off_10", "c")), "string1": F.when(F.col("compact"), s("g")).otherwise(pick("off_14", "d")),
        "finger2": F.when(F.col("compact"), "").otherwise(pick("off_1c", "f")), "stud2": F.when(F.col("compact"), "").otherwise(pick("off_20", "c")), "string2": F.when(F.col("compact"), s("d")).otherwise(pick("off_24", "g")),
    })
    left, stud = F.when(F.col("typed"), F.col("left_code")).otherwise(F.col("finger1")), F.when(F.col("typed"), F.col("stud_code")).otherwise(F.col("stud1"))
    rows = rows.withColumn("studs", F.transform(F.array(stud, F.col("stud2")), _stud))  # one body for both
    rows = rows.withColumns({"left": _word(left, LEFT), "stud": F.get("studs", 0), "left2": _word(F.col("finger2"), LEFT), "stud_2": F.get("studs", 1)})
    plain = F.forall(F.array(*[s(k) == v for k, v in PLAIN_C.items()]), lambda x: x)
    empty = F.lit("")
    extra = F.concat(
        F.when(plain, empty).otherwise(_word(F.col("front_code"), FRONTS, OPENS, other=empty)), _word(F.col("slide_code"), SLIDES), _word(F.col("lead_code"), LEADS, other=empty), _word(F.col("arrive_code"), ARRIVES, FRONTS, other=empty), _word(F.col("mark_code"), MARKS)
    )
    string = F.when(F.col("tp").isin([tp for tp, _ in roles["string"]]), F.concat("string_code", F.lit("弦"))).otherwise("")
    form = F.concat(extra, "left", "stud", _word(F.col("right_code"), RIGHT), string, _word(F.col("lift_code"), LIFTS))
    stopped1 = F.concat("left", "stud", "string1", F.lit("弦"))
    full = (F.col("left") != "") & (F.col("stud") != "") & (F.col("string1") != "")
    first = F.when(full, F.concat(stopped1, F.lit("按音"))).when(F.col("string1") != "", F.concat("string1", F.lit("弦散音"))).otherwise("")
    second = F.when(F.col("string2") == "", "").when(F.col("left2") != "", F.concat("left2", "stud_2", "string2", F.lit("弦按音"))).otherwise(F.concat("string2", F.lit("弦散音")))
    rows = rows.withColumns({"form": F.when(F.col("typed"), form), "bare": F.when(full, stopped1).otherwise(first), "first": first, "second": second})
    both = (F.col("first") != "") & (F.col("second") != "")
    pair = (
        F.when(F.col("compact"), F.concat("pair", F.lit("（"), "second", F.lit("＋"), "first", F.lit("）"))).when(both & (s("a") == "pfc:"), F.concat("pair", F.lit("["), "bare", F.lit("+"), "second", F.lit("]")))
        .when(both, F.concat("pair", F.lit("（"), "first", F.lit("＋"), "second", F.lit("）"))).when((F.col("first") != "") | (F.col("second") != ""), F.concat("pair", F.lit("（"), "first", "second", F.lit("）"))).otherwise(F.col("pair"))
    )
    each = F.array_join(F.transform(F.map_values("s"), lambda v: _word(v, LEFT, RIGHT, SLIDES, MARKS, OPENS, CLOSES)), "")
    cell = F.when(F.col("typed"), F.col("form")).when(F.col("pair").isNotNull(), pair).otherwise(each)
    return rows.select(*[F.col(f"row.`{c}`") for c in own if c != name], cell.alias(name))
