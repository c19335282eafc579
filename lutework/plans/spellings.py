"""Queries over spellings: structure and numbered tokens, strings, gestures, studs, tunes and generated answers, over inputs that the tables' numbers generate."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import glyphs, music, text
from ..sources import readers
from .adapters import NOTES, notes, table
from .registry import Registry

REGISTRY = query = Registry()
BRACKETS = ["", "]"]
BASES = [*text.BARS, "||||", "x", ""]
ENDINGS = ["", "[1", "[2,3", "[10-12", "[0"]


def _dealt(values: list[str], by: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), by.cast("int"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _case(of: str, values: dict, otherwise: str = "NULL") -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {otherwise} END"


_KINDS, _LABELS = ({k: v[i] for k, v in text.BARS.items()} for i in (0, 1))
_PARTS = r"regexp_extract({t}, '^(\])?([|:]+)(?:\[([1-9][0-9,\-]*))?$', {k})"


def _kind_sql(t: str) -> str:
    closing, base, ending = (_PARTS.format(t=t, k=k) for k in (1, 2, 3))
    return f"coalesce({_case(t, _KINDS)}, CASE WHEN ({closing} <> '' OR {ending} <> '') AND {_case(base, _KINDS)} IS NOT NULL THEN CASE WHEN {ending} <> '' THEN 'repeat_ending' ELSE {_case(base, _KINDS)} END END)"


@query(f"""WITH t AS (SELECT DISTINCT {_list(BRACKETS)}[1 + p_partkey % 2] || {_list(BASES)}[1 + (p_partkey // 2) % {len(BASES)}] || {_list(ENDINGS)}[1 + (p_partkey // {2 * len(BASES)}) % {len(ENDINGS)}] AS t FROM part)
SELECT t AS token, {_kind_sql("t")} AS kind, CASE WHEN {_kind_sql("t")} IS NOT NULL THEN coalesce({_case("t", _LABELS)}, concat_ws('／', CASE WHEN {_PARTS.format(t="t", k=1)} <> '' THEN '反复结尾结束' END,
  {_case(_PARTS.format(t="t", k=2), _LABELS)}, CASE WHEN {_PARTS.format(t="t", k=3)} <> '' THEN '第' || array_to_string(list_transform(regexp_extract_all({_PARTS.format(t="t", k=3)}, '[0-9]+|[^0-9]+'), lambda x: {_case("x", text.ENDING_NUMBERS, "x")}), '') || '遍结尾' END)) END AS label FROM t""")
def p4_structure(spark, sf_dir):
    """Kinds and names of bars, repeats and endings."""
    k = F.col("p_partkey")
    token = F.concat(_dealt(BRACKETS, k % 2), _dealt(BASES, F.floor(k / 2) % len(BASES)), _dealt(ENDINGS, F.floor(k / (2 * len(BASES))) % len(ENDINGS)))
    tokens = table(spark, sf_dir, "part").select(token.alias("token")).distinct()
    return tokens.withColumn("x", text.structure(F.col("token"))).select("token", "x.kind", "x.label")


#: A row's numbered notation, by its place and pitch: ties, rests and degrees with dots and signs; and its second version.
NUMBERED = """CASE WHEN d = 0 THEN '休止' WHEN d = 1 THEN '延音' WHEN d = 2 THEN '' ELSE (midi % 7 + 1)::VARCHAR || CASE WHEN midi < 54 THEN chr(803) WHEN midi > 66 THEN chr(775) ELSE '' END || CASE WHEN idx % 3 = 0 THEN '♯' ELSE '' END END"""


@query(f"""WITH {NOTES}, n AS (SELECT *, {NUMBERED} AS jianpu, CASE WHEN idx % 2 = 0 THEN '5' ELSE '延音' END AS alt, CASE WHEN structural THEN '|:' ELSE 'c' END AS abc, CASE WHEN flag = 'R' THEN ' ' ELSE '勾' END AS jianzi FROM notes),
p AS (SELECT *, CASE WHEN d <= 2 THEN NULL ELSE 60 + {music.MAJOR}[1 + midi % 7] + CASE WHEN midi < 54 THEN -12 WHEN midi > 66 THEN 12 ELSE 0 END + CASE WHEN idx % 3 = 0 THEN 1 ELSE 0 END END AS pitch FROM n)
SELECT structural, d <= 1 AND d = 0 AND flag = 'R' AS bare_rest, pitch IS NOT NULL OR idx % 2 = 0 AS sounding, count(*) AS n, coalesce(sum(pitch), 0)::DOUBLE AS pitches FROM p GROUP BY 1, 2, 3""")
def p3_p5_predicates(spark, sf_dir):
    """P3, P4, P5 and F-mus1: sounding rows (either numbered column parses), structural rows and bare rests, by their notation."""
    n = notes(spark, sf_dir)
    m, d = F.col("midi"), F.col("d")
    dot = F.when(m < 54, "̣").when(m > 66, "̇").otherwise("")
    numbered = F.when(d == 0, "休止").when(d == 1, "延音").when(d == 2, "").otherwise(F.concat((m % 7 + 1).cast("string"), dot, F.when(F.col("idx") % 3 == 0, "♯").otherwise("")))
    n = n.select("*", numbered.alias("jianpu"), F.when(F.col("idx") % 2 == 0, "5").otherwise("延音").alias("alt"), F.when(F.col("structural"), "|:").otherwise("c").alias("abc"), F.when(F.col("flag") == "R", " ").otherwise("勾").alias("jianzi"))
    pitch = lambda c: music.degree_midi(F.col(c), F.lit(60.0))
    rest = F.col("jianpu").contains("休止") & (F.trim("jianzi") == "")
    by = [text.structure(F.col("abc")).isNotNull().alias("structural"), rest.alias("bare_rest"), (pitch("jianpu").isNotNull() | pitch("alt").isNotNull()).alias("sounding")]
    return n.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum(pitch("jianpu")), F.lit(0.0)).alias("pitches"))


STRINGS = ["三弦", "四七弦", "47弦", "八弦", "9弦", "十二弦", "二十弦", "百弦", "〇弦", "18弦", "一8弦", "九徽", "五弦勾十弦", "07弦", ""]
OUTSIDE = ["", "", "", "8", "9", "12", "20", "100", "0", "18", "8", "", "10", "", ""]


@query(f"SELECT p_partkey, {_list(OUTSIDE)}[1 + p_partkey % {len(STRINGS)}] || CASE WHEN p_partkey % 30 >= 20 AND {_list(OUTSIDE)}[1 + p_partkey % {len(STRINGS)}] <> '' THEN ',' ELSE '' END || CASE WHEN p_partkey % 30 >= 20 THEN '99' || p_partkey ELSE '' END AS strings FROM part")
def fstr2_invalid_strings(spark, sf_dir):
    """F-str2: strings that the instrument doesn't have."""
    k = F.col("p_partkey")
    cell = F.concat(_dealt(STRINGS, k % len(STRINGS)), F.when(k % 30 >= 20, F.concat(F.lit("挑99"), k.cast("string"), F.lit(" 弦"))).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.invalid_strings(cell).cast("array<string>"), ",").alias("strings"))


GESTURES = ["掐撮三声", "掐拨剌二声", "掐拂历一声", "历拂", "拂歷", "拨", "勾"]


@query(f"""WITH t AS (SELECT p_partkey, ['勾', '挑', ''][1 + p_partkey % 3] AS a, {_list(GESTURES)}[1 + (p_partkey // 3) % 7] AS g, {_list(GESTURES)}[1 + (p_partkey // 21) % 7] AS h, '勾' || (p_partkey % 7 + 1) AS tail FROM part)
SELECT p_partkey, CASE WHEN g <> '勾' THEN g WHEN h <> '勾' THEN h END AS gesture, a || CASE WHEN g <> '勾' THEN '' ELSE g END || '，' || CASE WHEN g = '勾' AND h <> '勾' THEN '' ELSE h END || tail AS rest,
  a || {_list([x.replace("一", "1").replace("二", "2").replace("三", "3") for x in GESTURES])}[1 + (p_partkey // 3) % 7] || '，' || {_list([x.replace("一", "1").replace("二", "2").replace("三", "3") for x in GESTURES])}[1 + (p_partkey // 21) % 7] || tail AS reviewed FROM t""")
def fstr9_fstr10_gestures(spark, sf_dir):
    """F-str9 and F-str10: the first gesture of several sounds, a cell without it, and cells as a review compares them."""
    k = F.col("p_partkey")
    cell = F.concat(_dealt(["勾", "挑", ""], k % 3), _dealt(GESTURES, F.floor(k / 3) % 7), F.lit("，"), _dealt(GESTURES, F.floor(k / 21) % 7), F.lit("勾"), (k % 7 + 1).cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", cell.alias("cell"))
    spaced = F.regexp_replace("cell", "([，勾])", " $1 ")
    return rows.select("p_partkey", text.gesture(F.col("cell")).alias("gesture"), text.without_gesture(F.col("cell")).alias("rest"), text.reviewed_cell(spaced).alias("reviewed"))


@query("""WITH t AS (SELECT p_partkey, p_partkey % 14 AS h, p_partkey % 10 AS f FROM part), z AS (SELECT *, ['〇','一','二','三','四','五','六','七','八','九','十','十一','十二','十三'] AS n FROM t)
SELECT p_partkey, CASE WHEN p_partkey % 31 = 0 THEN '徽外' WHEN p_partkey % 37 = 0 THEN 'abc' WHEN h < 10 AND f = 0 AND p_partkey % 2 = 0 THEN n[1 + h] || '徽' WHEN h < 10 THEN CASE WHEN h = 0 THEN '〇' ELSE n[1 + h] END || '徽' || CASE WHEN f > 0 THEN n[1 + f] || '分' ELSE '' END
  WHEN f = 0 AND h = 10 THEN '十徽' WHEN f = 0 THEN n[1 + h] || '徽' ELSE n[1 + h] || '徽' || n[1 + f] || '分' END AS rendered FROM z""")
def fstr15_studs(spark, sf_dir):
    """F-str15: compact studs written out, over every stud and tenth."""
    k = F.col("p_partkey")
    h, f = k % 14, k % 10
    high = F.when((f == 0) & (h == 10), "X").when(f == 0, F.concat(F.lit("X"), (h - 10).cast("string"))).otherwise(F.concat(F.lit("X"), (h - 10).cast("string"), f.cast("string")))
    low = F.when((f == 0) & (k % 2 == 0), h.cast("string")).otherwise(F.concat(h.cast("string"), f.cast("string")))
    compact = F.when(k % 31 == 0, "Y").when(k % 37 == 0, "abc").when(h < 10, low).otherwise(high)
    return table(spark, sf_dir, "part").select("p_partkey", text.rendered_stud(compact).alias("rendered"))


_MARKS = """CASE o WHEN 2 THEN repeat(chr(775), 2) WHEN 1 THEN chr(775) WHEN -1 THEN chr(803) WHEN -2 THEN repeat(chr(803), 2) ELSE '' END"""


@query(f"""WITH {NOTES}, t AS (SELECT score, idx, (midi + d) % 6 AS form, midi % 8 AS p, d % 5 - 2 AS o, ['', 'q', 's', 'd'][1 + d % 4] AS c FROM notes)
SELECT score, idx, CASE form WHEN 0 THEN 'bar' WHEN 1 THEN 'tie' WHEN 2 THEN 'run' WHEN 3 THEN 'grace' ELSE CASE WHEN p = 0 THEN 'rest' ELSE 'note' END END AS kind, CASE WHEN form < 2 THEN NULL WHEN form < 4 THEN 'y' ELSE c END AS code,
  CASE form WHEN 0 THEN '小节线' WHEN 1 THEN NULL WHEN 2 THEN '装饰音' WHEN 3 THEN '装饰音' ELSE {_case("c", text.DURATIONS)} END AS duration,
  CASE WHEN form < 2 THEN NULL WHEN form < 4 THEN p % 7 + 1 ELSE p END::INT AS pitch, CASE WHEN form < 2 OR (form > 3 AND p = 0) THEN NULL ELSE o END::INT AS octave, CASE WHEN form = 3 THEN 2 END::INT AS divisor,
  CASE form WHEN 0 THEN '|' WHEN 1 THEN '－（延音）' WHEN 2 THEN (p % 7 + 1) || {_MARKS} || ' 6 5' || chr(803) || '（饰）' WHEN 3 THEN (p % 7 + 1) || {_MARKS} || '（饰）' ELSE CASE WHEN p = 0 THEN '0（休止）' ELSE p || {_MARKS} END END AS name FROM t""")
def fmus8_numbered_tokens(spark, sf_dir):
    """F-mus8: raw tokens of numbered notation, over bars, ties, ornaments, rests and notes."""
    d, m = F.col("d"), F.col("midi")
    o = (d % 5 - 2).cast("int")
    marks = F.when(o > 0, F.repeat(F.lit("'"), o)).when(o < 0, F.repeat(F.lit(","), -o)).otherwise("")
    degree = (m % 8 % 7 + 1).cast("string")
    form, code = (m + d) % 6, _dealt(["", "q", "s", "d"], d % 4)
    token = (
        F.when(form == 0, ":|[2").when(form == 1, "-").when(form == 2, F.concat(F.lit("y:"), degree, marks, F.lit("/6/5,"))).when(form == 3, F.concat(F.lit("y:"), degree, marks, F.lit("/2'")))
        .otherwise(F.concat(code, (m % 8).cast("string"), F.when(m % 8 == 0, "").otherwise(marks), F.when(F.col("idx") % 2 == 0, ".").otherwise("")))
    )
    return notes(spark, sf_dir).select("score", "idx", text.numbered_token(token).alias("x")).select("score", "idx", "x.*")


LETTERS = ["C", "D", "E", "F", "G", "A", "B", "c", "d", "e", "f", "g", "a", "b"]
LENGTHS, TICKS = ["", "2", "/2", "3/2", "/"], [480, 960, 240, 720, 240]


@query(f"""WITH {NOTES}, t AS (SELECT score, idx AS i, CASE WHEN structural THEN 'bar' WHEN d = 0 THEN 'rest' WHEN d = 1 THEN 'chord' ELSE 'note' END AS kind, midi % 14 AS l, d % 5 AS len, idx % 3 AS acc FROM notes),
e AS (SELECT *, CASE WHEN kind = 'bar' THEN 0 ELSE {TICKS}[1 + len] END AS duration, 60 + [0, 2, 4, 5, 7, 9, 11][1 + l % 7] + CASE WHEN l >= 7 THEN 12 ELSE 0 END AS base FROM t)
SELECT score, (row_number() OVER w - 1)::INT AS idx, kind, sum((kind = 'bar')::INT) OVER w::BIGINT AS bar, (sum(duration) OVER w - duration)::BIGINT AS onset, duration::INT AS duration,
  CASE kind WHEN 'note' THEN (base + [0, 1, -1][1 + acc] - 12 * (l % 2))::VARCHAR WHEN 'chord' THEN (base + [0, 1, -1][1 + acc] - 12 * (l % 2)) || ',76' END AS midis FROM e WINDOW w AS (PARTITION BY score ORDER BY i)""")
def s7_tunes(spark, sf_dir):
    """Events of tunes in letter notation, each score's tune written from its notes."""
    d, m = F.col("d"), F.col("midi")
    pitch = F.concat(_dealt(["", "^", "_"], F.col("idx") % 3), _dealt(LETTERS, m % 14), F.when(m % 2 == 1, ",").otherwise(""))
    length = _dealt(LENGTHS, d % 5)
    token = F.when(F.col("structural"), "|").when(d == 0, F.concat(F.lit("z"), length)).when(d == 1, F.concat(F.lit("["), pitch, F.lit("e]"), length)).otherwise(F.concat(F.when(d == 2, '"Am"').otherwise(""), pitch, length))
    tunes = notes(spark, sf_dir).groupBy("score").agg(F.sort_array(F.collect_list(F.struct("idx", token.alias("t")))).alias("x"))
    tunes = tunes.select("score", F.array_join(F.transform("x", lambda x: x["t"]), " ").alias("body"))
    found = readers.tune_events(tunes, "score", "body")
    return found.select("score", "idx", "kind", "bar", "onset", "duration", F.array_join(F.col("midis").cast("array<string>"), ",").alias("midis"))


def _words_sql(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda x: x <> '')"


def _grams_sql(w: str, n: int) -> str:
    return f"list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i : i + {n - 1}], ' '))"


def _phrases_sql(w: str) -> str:
    return f"list_distinct(list_filter({w}, lambda x: length(x) > 3) || list_filter({_grams_sql(w, 2)} || {_grams_sql(w, 3)}, lambda x: length(x) > 5))"


@query(f"""WITH t AS (SELECT conv_id, turn, {_words_sql("text")} AS a, {_words_sql("lead(text) OVER w")} AS t, {_words_sql("lag(text) OVER w")} AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
x AS (SELECT conv_id, turn, a, t, c, len(list_distinct(a)) AS na, len(list_distinct(t)) AS nt, len(list_intersect(list_distinct(a), list_distinct(t))) AS common, {_phrases_sql("a")} AS pa, {_phrases_sql("c")} AS pc, list_distinct({_grams_sql("a", 2)}) AS ga, list_distinct({_grams_sql("t", 2)}) AS gt FROM t),
y AS (SELECT *, CASE WHEN na = 0 AND nt = 0 THEN 1.0::DOUBLE ELSE coalesce(2.0::DOUBLE * common / nullif(na + nt, 0), 0) END AS f1 FROM x)
SELECT conv_id, turn, round(f1, 6) AS token_f1, round(CASE WHEN len(a) < 2 OR len(t) < 2 THEN f1 ELSE len(list_intersect(ga, gt)) / len(ga)::DOUBLE END, 6) AS bigram_precision,
  round(coalesce(len(list_intersect(list_distinct(a), list_distinct(c))) / nullif(na, 0)::DOUBLE, 0), 6) AS relevance, round(CASE WHEN len(pa) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(pa, pc)) / len(pa)::DOUBLE END, 6) AS support FROM y""")
def fstr14_answers(spark, sf_dir):
    """F-str14: each turn held against the next one as truth and the one before as context."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lead("text").over(w).alias("truth"), F.lag("text").over(w).alias("context"))
    rows = rows.select("conv_id", "turn", *[text.plain_words(F.col(c)).alias(c) for c in ("text", "truth", "context")])
    found = text.answer_metrics(F.col("text"), F.col("truth"), F.col("context"))
    return rows.select("conv_id", "turn", *[F.round(c, 6).alias(k) for k, c in found.items()])


@query("""SELECT o_orderkey, sha256('{"custkey":' || o_custkey || ',"notes":[' || o_orderkey % 3 || ',"' || o_orderpriority || '"],"status":"' || o_orderstatus || '"}') AS digest FROM orders""")
def fhash_canonical(spark, sf_dir):
    """F-hash: the hash of a record's JSON with sorted keys and no blanks."""
    notes_ = F.concat(F.lit("["), (F.col("o_orderkey") % 3).cast("string"), F.lit(',"'), F.col("o_orderpriority"), F.lit('"]'))
    record = F.to_json(F.struct(F.col("o_custkey").alias("custkey"), F.parse_json(notes_).alias("notes"), F.col("o_orderstatus").alias("status")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(record, 256).alias("digest"))


@query(f"""WITH {NOTES}, g AS (SELECT score, list(midi ORDER BY idx) AS a, list(48 + (midi * 5 + d) % 24 ORDER BY idx) AS b FROM notes GROUP BY score)
SELECT score, len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i]))::INT AS n_differ, list_sort(a) = list_sort(b) AS same_bag, coalesce(list_min(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i])) - 1, -1)::INT AS first FROM g""")
def farr_differences(spark, sf_dir):
    """F-arr: two sequences place by place and as bags."""
    pair = F.sort_array(F.collect_list(F.struct("idx", "midi", (48 + (F.col("midi") * 5 + F.col("d")) % 24).alias("other"))))
    rows = notes(spark, sf_dir).groupBy("score").agg(pair.alias("x")).select("score", F.col("x.midi").alias("a"), F.col("x.other").alias("b"))
    differs = F.zip_with("a", "b", lambda p, q: p != q)
    return rows.select(
        "score", F.size(F.filter(differs, lambda x: x)).alias("n_differ"), (F.array_sort("a") == F.array_sort("b")).alias("same_bag"),
        (F.array_position(differs, True) - 1).cast("int").alias("first"),
    )


def _map(values: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}"


_GLYPH_TYPES = [*glyphs.FORMS, "", "pair", "raw", "compact"]
_CODES = {"left": [*glyphs.LEFT, "?"], "right": [*glyphs.RIGHT, ""], "slide": [*glyphs.SLIDES], "mark": [*glyphs.MARKS, ":new"], "stud": ["7", "79", "X", "X8", "X23", "X1", "Y", "", "96"], "front": [*glyphs.FRONTS, *glyphs.OPENS, "zhi:", "jiu:", "s:", ""], "pair": [*glyphs.PAIRS]}
_STUDS = {"7": "七徽", "79": "七徽九分", "X": "十徽", "X8": "十徽八分", "X23": "十二徽三分", "X1": "十一徽", "Y": "徽外", "": "", "96": "九徽六分"}
_CODED = ", ".join(f"{v}[1 + (n // {i * 2 + 1}) % {len(v)}] AS {k}_" for i, (k, v) in enumerate(_CODES.items()))
_EITHER = "coalesce({table}[{code}], {code})"


@query(f"""WITH r AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey + 3 * l_partkey + 7 * l_suppkey + trunc(l_quantity)::INT AS n, l_suppkey % 7 + 1 AS a, l_partkey % 8 AS b FROM lineitem),
c AS (SELECT DISTINCT id, {_GLYPH_TYPES}[1 + n % {len(_GLYPH_TYPES)}] AS tp, a::VARCHAR AS s1, CASE WHEN b = 0 THEN '' ELSE b::VARCHAR END AS s2, {_CODED} FROM r),
w AS (SELECT *, {_EITHER.format(table=_map(glyphs.LEFT), code="left_")} AS lw, {_EITHER.format(table=_map(glyphs.RIGHT), code="right_")} AS rw, {_map(_STUDS)}[stud_] AS hw, {_map(glyphs.PAIRS)}[pair_] AS pw, {_map(glyphs.FRONTS)}[front_] AS fw FROM c)
SELECT id, CASE tp WHEN 'zhyx' THEN lw || hw || rw || s1 || '弦' WHEN 'zhtyx' THEN CASE WHEN front_ = 'c:' AND left_ = 'm' AND stud_ = 'X' AND right_ = 'd' AND s1 = '2' THEN '' ELSE coalesce(fw, {_map(glyphs.OPENS)}[front_], '') END || lw || hw || rw || s1 || '弦'
  WHEN 'zht' THEN lw || hw || '滔起' WHEN 'th' THEN {_map(glyphs.SLIDES)}[slide_] || hw WHEN 'tyx' THEN CASE front_ WHEN 'jiu:' THEN '就' WHEN 's:' THEN '散' ELSE '' END || rw || s1 || '弦' WHEN 'd' THEN {_EITHER.format(table=_map(glyphs.MARKS), code="mark_")}
  WHEN '' THEN lw || {_map(glyphs.SLIDES)}[slide_] || {_EITHER.format(table=_map(glyphs.MARKS), code="mark_")} || s1
  WHEN 'pair' THEN CASE WHEN stud_ = '' AND s2 = '' THEN pw || '（' || s1 || '弦散音）' WHEN s2 = '' THEN pw || '（' || lw || hw || s1 || '弦按音）' WHEN pair_ = 'pfc:' THEN pw || '[' || CASE WHEN stud_ = '' THEN s1 || '弦散音' ELSE lw || hw || s1 || '弦' END || '+' || s2 || '弦散音]'
    ELSE pw || '（' || CASE WHEN stud_ = '' THEN s1 || '弦散音' ELSE lw || hw || s1 || '弦按音' END || '＋' || s2 || '弦散音）' END
  WHEN 'raw' THEN CASE WHEN stud_ = '' THEN pw WHEN s2 = '' THEN pw || '（' || lw || hw || s1 || '弦按音）' WHEN pair_ = 'pfc:' THEN pw || '[' || lw || hw || s1 || '弦+' || '大指' || hw || s2 || '弦按音]' ELSE pw || '（' || lw || hw || s1 || '弦按音＋大指' || hw || s2 || '弦按音）' END
  WHEN 'compact' THEN CASE WHEN left_ = '?' OR stud_ = '' THEN CASE WHEN s2 = '' THEN pw || '（' || CASE WHEN stud_ = '' OR left_ = '?' THEN s1 || '弦散音' END || '）' ELSE pw || '（' || s2 || '弦散音＋' || CASE WHEN stud_ <> '' THEN stud_ || s1 || '弦按音' ELSE s1 || '弦散音' END || '）' END
    ELSE pw || '（' || CASE WHEN s2 = '' THEN '' ELSE s2 || '弦散音' END || '＋' || lw || hw || s1 || '弦按音）' END
  ELSE CASE WHEN front_ = 'zhi:' THEN '至' ELSE coalesce(fw, '') END || rw || s1 || '弦' END AS cell FROM w WHERE NOT (tp = 'compact' AND (left_ = '?' OR stud_ = ''))""")
def fmus9_glyphs(spark, sf_dir):
    """F-mus9: glyphs of every type and layout, decoded to cell texts."""
    n = F.col("l_orderkey") + 3 * F.col("l_partkey") + 7 * F.col("l_suppkey") + F.col("l_quantity").cast("int")
    code = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), (F.floor(F.col("n") / (2 * i + 1)) % len(values)).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), n.alias("n"), (F.col("l_suppkey") % 7 + 1).cast("string").alias("s1"), F.when(F.col("l_partkey") % 8 == 0, "").otherwise((F.col("l_partkey") % 8).cast("string")).alias("s2"))
    rows = rows.withColumns({"tp": code(_GLYPH_TYPES, 0), **{k: code(v, i) for i, (k, v) in enumerate(_CODES.items())}}).drop("n").distinct()
    kinds = {"left": "left", "right": "right", "stud": "stud", "string": "s1", "front": "front", "lead": "front", "arrive": "front", "slide": "slide", "mark": "mark"}
    made = lambda *pairs: F.create_map(*[x for k, c in pairs for x in (F.lit(k), F.col(c) if isinstance(c, str) else c)])
    slots = F.when(F.col("tp") == "", made(("c", "left"), ("d", "slide"), ("e", "mark"), ("f", "s1"))).when(F.col("tp") == "pair", made(("a", "pair"), ("b", "left"), ("c", "stud"), ("d", "s1"), ("g", "s2"))).when(F.col("tp") == "raw", made(("a", "pair")))
    slots = slots.when(F.col("tp") == "compact", made(("a", "pair"), ("d", "s2"), ("e", F.concat("left", F.lit(":"))), ("f", "stud"), ("g", "s1")))
    for tp, form in glyphs.FORMS.items():
        parts = [x.split(":") for x in form.split()]
        slots = slots.when(F.col("tp") == tp, made(*[(slot, F.lit("tq:") if kind == "lift" else kinds[kind]) for slot, kind in parts]))
    raw = F.when(F.col("tp") == "raw", made(("off_8", "pair"), ("off_c", "left"), ("off_10", "stud"), ("off_14", "s1"), ("off_1c", F.lit("d")), ("off_20", "stud"), ("off_24", "s2")))
    whole = rows.where(~((F.col("tp") == "compact") & ((F.col("left") == "?") | (F.col("stud") == ""))))
    return glyphs.decoded(whole, F.col("tp"), slots, raw).select("id", "cell")
