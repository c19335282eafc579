"""Replay, audit, lint and route queries over cells dealt to the notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import music
from ..operators import ordered, repeats, replay
from ..operators.candidates import best_positions, position_grid
from ..operators.routes import baseline, candidate_steps, directed_routes
from .adapters import NOTES, notes, table
from .pitch import GRID, REGION
from .registry import Registry

REGISTRY = query = Registry()
#: Cells of tablature, dealt by score and place.
CELLS = [
    "大指九徽勾三弦", "散挑七弦", "名指十徽八分挑四弦", "", "绰上七徽六分", "复", "泛起中指七徽勾二弦", "挑七徽三弦", "泛止", "散勾一弦", "大指七徽勾一弦", "注下九徽", "复", "复", "散猱",
    "绰上七徽勾五弦", "历七六五弦", "撮（三弦＋三弦）", "拨一四弦", "跪指四徽勾二弦", "名指四徽勾二弦", "掐撮三声", "勾九弦", "挑四徽六分", "进复", "散勾一弦", "散挑一弦", "",
]


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score, idx, text, structural, rest and targets of each note."""
    n = notes(spark, sf_dir)
    rest = (F.col("flag") == "R") & (F.col("d") == 0)
    dealt = F.get(F.array(*[F.lit(c) for c in CELLS]), ((F.col("score") * 3 + F.col("idx")) % len(CELLS)).cast("int"))
    targets = F.when(F.col("structural") | rest, F.array().cast("array<double>")).otherwise(F.array(F.col("midi").cast("double")))
    return n.select("score", "idx", F.when(rest, "").otherwise(dealt).alias("text"), "structural", rest.alias("rest"), targets.alias("targets"))


@query()
def f3_reference_fields(spark, sf_dir):
    """which fields a row states and which it inherits, and how far it can be trusted."""
    rows = replay.audited(replay.replayed(cells(spark, sf_dir))).where("attack")
    fields = {"string": F.size("strings") > 0, "hui": F.col("own_hui").isNotNull(), "finger": F.col("own_finger").isNotNull(), "mode": F.col("said").isNotNull()}
    have = {"string": F.col("string").isNotNull(), "hui": F.col("hui").isNotNull(), "finger": F.col("finger").isNotNull(), "mode": F.col("mode").isNotNull()}
    named = lambda some: F.array_join(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in some.items()]), lambda x: x.isNotNull()), ",")
    trust = F.when(F.col("status") == "matched", "verified").when(F.col("status") == "mismatched", "conflicting").when(F.size("pitches") > 0, "weak").otherwise("unusable")
    return rows.select("score", "idx", named(fields).alias("explicit_fields"), named({k: have[k] & ~fields[k] for k in fields}).alias("inherited_fields"), trust.alias("confidence"))


@query()
def lint_warnings(spark, sf_dir):
    """Lint codes: how many rows and scores each one marks."""
    found = replay.warnings(replay.audited(replay.replayed(cells(spark, sf_dir))))
    return found.groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("score").alias("n_scores"))


_FORMS = """r AS (SELECT l_orderkey * 10 + l_linenumber AS id, trunc(l_quantity)::INT % 6 AS form, l_partkey % 7 + 1 AS a, l_suppkey % 7 + 1 AS b, (l_partkey + l_suppkey) % 7 + 1 AS c, trunc(l_quantity)::INT % 13 + 1 AS h FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1))"""


@query(f"""WITH {_FORMS} SELECT id, unnest(list_filter([CASE WHEN form = 0 AND abs(a - b) > 1 THEN 'nonadjacent_pluck_pair' END, CASE WHEN form = 1 AND a = b THEN 'same_string_cuo_pair' END,
  CASE WHEN form = 2 AND (abs(a - b) > 1 OR abs(b - c) > 1) THEN 'li_nonadjacent_strings' END, CASE WHEN form = 3 AND a = 1 THEN 'tiao_on_first_string' END,
  CASE WHEN form = 4 AND ((a <= 4 AND h <= 4) OR (a = 5 AND h < 4)) THEN 'low_hui_stopped_too_cramped' END, CASE WHEN form = 5 THEN 'invalid_string_number' END], lambda x: x IS NOT NULL)) AS code FROM r""")
def lint_rows(spark, sf_dir):
    """Lint codes that a row has by itself, over cells that its numbers generate."""
    q = F.col("l_quantity").cast("int")
    zh = lambda n: F.get(F.array(*[F.lit(z) for z in list(music.ZH_NUMBERS)]), (n - 1).cast("int"))
    numbers = {"a": F.col("l_partkey") % 7 + 1, "b": F.col("l_suppkey") % 7 + 1, "c": (F.col("l_partkey") + F.col("l_suppkey")) % 7 + 1}
    a, b, c = (zh(x) for x in numbers.values())
    forms = [
        F.concat(F.lit("拨"), a, b, F.lit("弦")), F.concat(F.lit("撮（"), a, F.lit("弦＋"), b, F.lit("弦）")), F.concat(F.lit("历"), a, b, c, F.lit("弦")), F.concat(F.lit("散挑"), a, F.lit("弦")),
        F.concat(F.lit("大指"), zh(q % 13 + 1), F.lit("徽勾"), a, F.lit("弦")), F.concat(F.lit("勾"), F.when(q % 4 < 2, "八").otherwise("十二"), F.lit("弦")),
    ]
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    rows = one.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("score"), F.lit(0).alias("idx"), F.get(F.array(*forms), q % 6).alias("text"), F.lit(False).alias("structural"), F.lit(False).alias("rest"), F.array().cast("array<double>").alias("targets"))
    return replay.warnings(replay.audited(replay.replayed(rows))).select(F.col("score").alias("id"), "code")


#: Cells with repeats' commands, anchors, omissions and finite gestures.
REPEATS = [
    "", "勾三弦", "", "〔再作标记ㄱ〕", "", "再作", "从ㄱ再作", "无（由于是再作部分，省略）", "", "", "从头再作", "", "从3再作", "", "", "挑六弦", "掐撮三声再作", "再作起点，再作", "", "历七六弦", "", "从9再作", "", "勾剔一弦", "滚一弦至三弦", "",
    "至三弦",
]
_C = "(从[0-9]+再[作做]|从头再[作做]|从ㄱ再[作做]|再[作做](?:[二三]声)?)"
_O = "无（由于是再作部分，省略）"
_REPEAT_ROWS = f"""b AS (SELECT user_id AS score, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_id, value FROM events),
r AS (SELECT score, idx, {REPEATS}[1 + (idx * 7 + event_id % 5) % {len(REPEATS)}] AS t, event_id % 13 = 0 AS structural, CASE WHEN event_id % 13 = 0 OR value > 88 THEN NULL ELSE 60 + event_id % 2 END AS midi, idx // 24 AS section FROM b),
e AS (SELECT *, CASE WHEN NOT structural THEN sum((NOT structural)::INT) OVER (PARTITION BY score ORDER BY idx) - 1 END AS e, CASE WHEN midi IS NOT NULL THEN count(midi) OVER (PARTITION BY score ORDER BY idx) END AS p, regexp_replace(t, '再[作做](?:起点|标记)ㄱ?', '', 'g') AS plain,
  max(CASE WHEN regexp_matches(t, '再[作做](起点|标记)') THEN idx END) OVER (PARTITION BY score ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchored FROM r),
c AS (SELECT *, CASE WHEN t <> '{_O}' THEN nullif(regexp_extract(plain, '{_C}', 1), '') END AS command, trim(regexp_replace(plain, '{_C}', '', 'g'), '〔〕【】[]()（） 。；;：:、' || chr(9) || chr(10)) = '' AS bare FROM e),
s AS (SELECT *, count(command) OVER (PARTITION BY score ORDER BY idx) AS seg FROM c),
f AS (SELECT *, first_value(idx) OVER w AS a, first_value(bare) OVER w AS lone, first_value(section) OVER w AS own FROM s WINDOW w AS (PARTITION BY score, seg ORDER BY idx)),
o AS (SELECT *, max((idx > a AND (section IS DISTINCT FROM own OR (t NOT IN ('', '{_O}') AND midi IS NOT NULL)))::INT) OVER (PARTITION BY score, seg ORDER BY idx) AS over FROM f),
tail AS (SELECT score, seg, a, idx, midi, t, row_number() OVER (PARTITION BY score, seg ORDER BY idx) AS k FROM o WHERE seg > 0 AND over = 0 AND NOT structural AND midi IS NOT NULL AND (idx > a OR lone)),
cmd AS (SELECT score, seg, a, command, anchored, TRY_CAST(regexp_extract(command, '^从([0-9]+)', 1) AS BIGINT) AS number, (SELECT min(x.idx) FROM e x WHERE x.score = o.score AND x.section = o.section) AS head FROM o WHERE command IS NOT NULL),
st AS (SELECT cmd.score, cmd.seg, 'numbered' AS kind, arg_max(e.p, e.idx) AS start FROM cmd JOIN e ON e.score = cmd.score AND e.e = cmd.number AND e.midi IS NOT NULL AND e.idx < cmd.a GROUP BY 1, 2
  UNION ALL SELECT cmd.score, cmd.seg, kind, min(e.p) FROM (SELECT *, 'anchor' AS kind, anchored AS b FROM cmd WHERE command LIKE '%ㄱ%' UNION ALL SELECT *, 'section', head FROM cmd WHERE command LIKE '%头%' UNION ALL SELECT *, 'score', 0 FROM cmd WHERE command LIKE '%头%') cmd
  JOIN e ON e.score = cmd.score AND e.midi IS NOT NULL AND e.idx >= b AND e.idx < cmd.a GROUP BY 1, 2, 3),
met AS (SELECT tail.score, tail.seg, tail.a, tail.idx, k, kind, tail.midi, CASE WHEN e.idx < tail.a THEN e.midi END AS src FROM tail JOIN st USING (score, seg) LEFT JOIN e ON e.score = tail.score AND e.p = start + k - 1),
bad AS (SELECT score, a AS idx, 'repeat_numbered_start_missing' AS code, seg FROM cmd WHERE number IS NOT NULL AND (score, seg) NOT IN (SELECT score, seg FROM st WHERE kind = 'numbered')
  UNION ALL SELECT score, a, 'repeat_numbered_pitch_mismatch', seg FROM cmd JOIN (SELECT score, seg FROM st WHERE kind = 'numbered') USING (score, seg) WHERE (score, seg) NOT IN (SELECT score, seg FROM tail) OR (score, seg) IN (SELECT score, seg FROM met WHERE kind = 'numbered' AND midi IS DISTINCT FROM src)
  UNION ALL SELECT score, idx, 'repeat_anchor_pitch_mismatch', seg FROM met WHERE kind = 'anchor' AND midi IS DISTINCT FROM src
  UNION ALL SELECT score, a, 'repeat_from_head_pitch_mismatch', seg FROM (SELECT score, seg, a, kind, count(*) FILTER (midi <> src) AS w, count(*) FILTER (src IS NULL) AS u FROM met WHERE kind IN ('section', 'score') AND k <= 5 GROUP BY ALL) GROUP BY score, seg, a HAVING count(*) FILTER (u > 0) = 0 AND count(*) FILTER (w = 0) = 0 AND count(*) = 2),
said AS (SELECT *, last_value(CASE WHEN t <> '' AND NOT structural THEN t END IGNORE NULLS) OVER w AS told, coalesce(last_value(CASE WHEN t NOT IN ('', '{_O}') AND NOT structural THEN t END IGNORE NULLS) OVER w, '') AS said FROM o WINDOW w AS (PARTITION BY score ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
own_ AS (SELECT score, idx, seg, regexp_replace(t, '再[作做](起点|标记)', '', 'g') AS w, regexp_replace(said, '再[作做](起点|标记)', '', 'g') AS sw, t, told, structural, anchored FROM said),
loc AS (SELECT score, idx, 'repeat_anchor_instruction_overlap' AS code, seg FROM own_ WHERE t <> w AND regexp_matches(w, '再[作做]') UNION ALL SELECT score, idx, 'compound_repeat_instruction_overlap', seg FROM own_ WHERE t LIKE '%掐撮三声%' AND regexp_matches(w, '再[作做]')
  UNION ALL SELECT score, idx, 'missing_repeat_anchor', seg FROM own_ WHERE t LIKE '%从ㄱ再作%' AND anchored IS NULL UNION ALL SELECT score, idx, 'missing_repeat_instruction', -1 FROM own_ WHERE t = '{_O}' AND NOT structural AND told IS DISTINCT FROM '{_O}' AND NOT regexp_matches(sw, '再[作做]')),
mis AS (SELECT score, min(idx) AS idx, 'repeat_omission_marker_missing' AS code FROM tail WHERE t = '' AND (score, seg) NOT IN (SELECT score, seg FROM bad) AND (score, seg) NOT IN (SELECT score, seg FROM loc) GROUP BY score, seg),
anc AS (SELECT score, min(idx) FILTER (NOT blank) AS idx, 'repeat_anchor_followed_by_blanks' AS code FROM (SELECT *, sum((NOT blank)::INT) OVER (PARTITION BY score ORDER BY idx) AS g FROM (SELECT *, t IN ('', '{_O}') AND midi IS NOT NULL AS blank FROM r WHERE NOT structural)) GROUP BY score, g
  HAVING bool_or(NOT blank AND t = '〔再作标记ㄱ〕') AND count(*) FILTER (blank) >= 2),
gest AS (SELECT score, idx, 'finite_gesture_uncovered_note' AS code FROM (SELECT *, row_number() OVER w AS used, first_value(CASE WHEN begins AND midi IS NOT NULL THEN CASE t WHEN '历七六弦' THEN 2 WHEN '勾剔一弦' THEN 2 WHEN '滚一弦至三弦' THEN 3 END END) OVER w AS covers FROM
  (SELECT *, sum(begins::INT) OVER (PARTITION BY score ORDER BY idx) AS g FROM (SELECT *, t NOT IN ('', '至三弦') OR midi IS NULL AS begins FROM r WHERE NOT structural)) WINDOW w AS (PARTITION BY score, g ORDER BY idx)) WHERE used = covers + 1)"""


@query(f"WITH {_REPEAT_ROWS} SELECT score, idx, code FROM bad UNION ALL SELECT score, idx, code FROM loc UNION ALL SELECT * FROM mis UNION ALL SELECT * FROM anc UNION ALL SELECT * FROM gest")
def lint_repeats(spark, sf_dir):
    """Lint codes of repeats, anchors, omissions and finite gestures, each user's events being a score."""
    w = Window.partitionBy("score").orderBy("ts", "event_id")
    b = table(spark, sf_dir, "events").select(F.col("user_id").alias("score"), "ts", "event_id", "value").withColumn("idx", F.row_number().over(w) - 1)
    e = F.col("event_id")
    cell = F.get(F.array(*[F.lit(x) for x in REPEATS]), ((F.col("idx") * 7 + e % 5) % len(REPEATS)).cast("int"))
    rows = b.select("score", "idx", cell.alias("text"), (e % 13 == 0).alias("structural"), F.when((e % 13 != 0) & (F.col("value") <= 88), 60 + e % 2).alias("midi"), F.floor(F.col("idx") / 24).alias("section"))
    rows = ordered.event_ordinals(rows, ["score"], ["idx"], F.col("structural"))
    return repeats.repeat_warnings(rows).unionByName(repeats.uncovered_notes(rows))


_LENGTH_NAMES = ["四分", "八分", "十六分", "三十二分", "附点八分", "二分", ""]
_TICKS = [960, 480, 240, 120, 480, 1920, 960]
_POSITIONS = f"""t AS (SELECT DISTINCT midi::DOUBLE AS target FROM notes),
near AS (SELECT target, string, hui, label, (g.midi - target) * 100 AS cents, {REGION} AS region FROM t JOIN grid g ON abs((g.midi - target) * 100) <= WIDE WHERE KIND),
pos AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(abs(cents), 3), CASE WHEN hui IS NULL THEN 0 ELSE 1 END, region, string, coalesce(hui, 0), coalesce(label, '')) AS rank FROM near),
frac AS (SELECT rank, target, string, hui, label, CASE WHEN hui IS NULL THEN 0 ELSE c[floor(hui)::INT] + (hui - floor(hui)) * (c[least(floor(hui)::INT + 1, 13)] - c[floor(hui)::INT]) END AS place, abs(round(cents, 3)) * 0.03::DOUBLE + region AS own FROM pos, fr WHERE rank <= MOST),
steps AS (SELECT score, idx // 5 AS phrase, idx, midi, row_number() OVER w AS n, count(*) OVER (PARTITION BY score, idx // 5) AS size, greatest(coalesce(lag({_TICKS}[1 + d % 7]) OVER w, 960) / 960.0::DOUBLE, 0.125::DOUBLE) AS beats FROM notes WHERE NOT structural WINDOW w AS (PARTITION BY score, idx // 5 ORDER BY idx))"""
_MOVE = """abs(f.string - w.string) * 0.75::DOUBLE + greatest(0, abs(f.string - w.string) - 1) * 0.3::DOUBLE + abs(f.place - w.place) * 8.0::DOUBLE + CASE WHEN s.beats < 0.5 THEN abs(f.place - w.place) * 4.0::DOUBLE / greatest(s.beats, 0.125::DOUBLE) ELSE 0 END
  + CASE WHEN coalesce(sign(f.hui - w.hui), 0) * w.dir < 0 THEN 0.35::DOUBLE ELSE 0 END"""


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score, phrase (five rows), idx, pitches and ticks of each sounding note."""
    n = notes(spark, sf_dir).where("NOT structural")
    name = F.get(F.array(*[F.lit(x) for x in _LENGTH_NAMES]), F.col("d") % 7)
    return n.select("score", F.floor(F.col("idx") / 5).cast("int").alias("phrase"), "idx", F.array(F.col("midi").cast("double")).alias("pitches"), music.ticks(name).alias("ticks"))


@query(f"""WITH RECURSIVE {NOTES}, {GRID}, {_POSITIONS.replace("WIDE", "35").replace("KIND", "TRUE").replace("MOST", "3")},
walks AS (SELECT score, phrase, 1 AS n, string, hui, place, 0 AS dir, own AS cost, own, 0::DOUBLE AS moved, [rank] AS cands FROM steps s JOIN frac f ON f.target = s.midi WHERE n = 1
  UNION ALL SELECT w.score, w.phrase, w.n + 1, f.string, f.hui, f.place, CASE WHEN coalesce(sign(f.hui - w.hui), 0) <> 0 THEN sign(f.hui - w.hui)::INT ELSE w.dir END, w.cost + f.own + ({_MOVE}), w.own + f.own, w.moved + ({_MOVE}), list_append(w.cands, f.rank)
  FROM walks w JOIN steps s ON s.score = w.score AND s.phrase = w.phrase AND s.n = w.n + 1 JOIN frac f ON f.target = s.midi),
ranked AS (SELECT w.*, row_number() OVER (PARTITION BY w.score, w.phrase ORDER BY round(cost, 9), cands) AS route FROM walks w JOIN (SELECT DISTINCT score, phrase, size FROM steps) z ON z.score = w.score AND z.phrase = w.phrase AND z.size = w.n)
SELECT score, phrase, route, round(cost, 6) AS cost, round(own, 6) AS own_cost, round(moved, 6) AS move_cost, list_aggregate(cands, 'string_agg', ',') AS cands FROM ranked WHERE route <= 3""")
def k2_routes(spark, sf_dir):
    """K2: the three cheapest routes over the candidates of each phrase of five rows, with the beats that the notes leave and the direction carried on; the SQL walks all of them."""
    heard = _phrases(spark, sf_dir).withColumn("note", F.get("pitches", 0))
    found = best_positions(heard, F.col("note"), position_grid(spark, music.STANDARD_TUNING))
    found = directed_routes(candidate_steps(heard, found, ["score", "phrase"]), ["score", "phrase"], 3)
    return found.select("score", "phrase", "route", *[F.round(c, 6).alias(c) for c in ("cost", "own_cost", "move_cost")], F.array_join("cands", ",").alias("cands"))


@query(f"""WITH RECURSIVE {NOTES}, {GRID}, {_POSITIONS.replace("WIDE", "50").replace("KIND", "mode = 'stopped'").replace("MOST", "14")},
walks AS (SELECT score, phrase, 1 AS n, string, hui, place, 0 AS dir, own AS cost, [rank] AS cands FROM steps s JOIN frac f ON f.target = s.midi WHERE n = 1
  UNION ALL SELECT * FROM (SELECT w.score, w.phrase, w.n + 1, f.string, f.hui, f.place, CASE WHEN coalesce(sign(f.hui - w.hui), 0) <> 0 THEN sign(f.hui - w.hui)::INT ELSE w.dir END AS dir, w.cost + f.own + ({_MOVE}) AS cost, list_append(w.cands, f.rank) AS cands
    FROM walks w JOIN steps s ON s.score = w.score AND s.phrase = w.phrase AND s.n = w.n + 1 JOIN frac f ON f.target = s.midi) QUALIFY row_number() OVER (PARTITION BY score, phrase, cands[-1], dir ORDER BY round(cost, 9), cands) = 1),
best AS (SELECT score, phrase, min_by(cost, (round(cost, 9), cands)) AS cost, arg_min(cands, (round(cost, 9), cands)) AS cands FROM (SELECT w.* FROM walks w JOIN (SELECT DISTINCT score, phrase, size FROM steps) z ON z.score = w.score AND z.phrase = w.phrase AND z.size = w.n) GROUP BY ALL)
SELECT s.score, s.phrase, s.idx, p.string, p.hui, p.label, round(b.cost, 6) AS cost, NOT EXISTS (SELECT 1 FROM frac x WHERE x.target = s.midi) AS missing FROM steps s LEFT JOIN best b ON b.score = s.score AND b.phrase = s.phrase LEFT JOIN frac p ON p.target = s.midi AND p.rank = b.cands[s.n]""")
def f9_baseline(spark, sf_dir):
    """the cheapest stopped route of each phrase, a position per sounding note, from the pitches alone."""
    return baseline(_phrases(spark, sf_dir), music.STANDARD_TUNING, ["score", "phrase"]).select("score", "phrase", "idx", "string", "hui", "label", F.round("cost", 6).alias("cost"), "missing")
