"""Queries of the fold over cells, with SQL that carries the same state from row to row by a recursive CTE."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import music
from ..operators import fold
from .adapters import table
from .registry import Registry

REGISTRY = query = Registry()

_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice"]
_HANDS = ["大指", "名指", "中指"]
_ZH = list(music.ZH_NUMBERS)


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's line items as a score of cells: score, idx, kind, text, structural, rest and targets; phrases of five rows, of which each row also has a predicted
    cell, dealt otherwise, and region, which says of some phrases whether they begin in a harmonic region."""
    w = Window.partitionBy("score").orderBy(*_ORDER)  # by the name that the fold deals by, so that rows are dealt once
    q = F.col("l_quantity").cast("int")
    named = lambda words, n: F.get(F.array(*[F.lit(x) for x in words]), n.cast("int"))
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "score").select(
        "score", (F.row_number().over(w) - 1).alias("idx"), ((F.col("l_orderkey") + 3 * F.col("l_linenumber") + q) % 16).cast("int").alias("kind"), (F.col("l_suppkey") % 7 + 1).cast("int").alias("a"),
        (F.col("l_orderkey") % 7 + 1).cast("int").alias("b"), (4 + q % 9).alias("h"), named(_HANDS, F.col("l_linenumber") % 3).alias("finger"), (48 + q % 24).cast("double").alias("midi"),
    )
    rows = rows.withColumn("g", F.when(F.col("h") > 4, F.col("h") - 1).otherwise(5))
    a, b, h, g = (named(_ZH, F.col(c) - 1) for c in "abhg")
    f = F.col("finger")
    placed = F.concat(f, h, F.lit("徽勾"), a, F.lit("弦"))
    forms: list[Column] = [
        placed, F.concat(F.lit("散挑"), a, F.lit("弦")), F.concat(F.lit("勾"), a, F.lit("弦")), F.concat(F.lit("挑"), h, F.lit("徽")), F.concat(F.lit("绰上"), h, F.lit("徽")), F.lit("复"), F.lit("退"), F.concat(F.lit("泛起"), placed),
        F.lit("泛止"), F.lit(""), F.lit("爪起"), F.lit("带起"), F.concat(F.lit("撮（"), f, h, F.lit("徽"), a, F.lit("弦按音＋"), b, F.lit("弦散音）")), F.concat(placed, F.lit("绰上"), g, F.lit("徽")), F.lit(""), F.concat(F.lit("就挑"), a, F.lit("弦")),
    ]
    rest = F.col("kind") == 9
    targets = F.when(rest, F.array().cast("array<double>")).otherwise(F.array("midi"))
    phrase, other = F.floor(F.col("idx") / 5), (F.col("kind") + 5 * ((F.col("score") % 3 + F.col("idx")) % 2)) % 16
    cell = lambda kind: reduce(lambda c, x: c.when(kind == x[0], x[1]), enumerate(forms), F)  # noqa: E731  # one form is made of a row's sixteen
    region = F.when((F.col("score") + phrase) % 5 == 0, True).when((F.col("score") + phrase) % 5 == 1, False)
    return rows.select(
        "score", "idx", "kind", cell(F.col("kind")).alias("text"), F.lit(False).alias("structural"), rest.alias("rest"), targets.alias("targets"), phrase.alias("phrase"), F.when(rest, "").otherwise(cell(other)).alias("predicted"), region.alias("region")
    )


#: In SQL, a row's state after it: str, plc, fin, man, oar, sco, tou, ors, orp, pls (finger, string and place, the last used last).
_STATE = "str, plc, fin, man, oar, sco, tou, ors, orp, pls"
_CELLS = f"""cells AS (
  SELECT *, CASE WHEN h > 4 THEN h - 1 ELSE 5 END AS g FROM (SELECT l_partkey AS score, (row_number() OVER (PARTITION BY l_partkey ORDER BY {', '.join(_ORDER)}) - 1)::INT AS idx, ((l_orderkey + 3 * l_linenumber + trunc(l_quantity)::INT) % 16)::INT AS kind,
  (l_suppkey % 7 + 1)::INT AS a, (l_orderkey % 7 + 1)::INT AS b, 4 + trunc(l_quantity)::INT % 9 AS h, {_HANDS}[1 + l_linenumber % 3] AS f, 48 + trunc(l_quantity)::INT % 24 AS midi FROM lineitem))"""


def _fold(name: str, cells: str, begun: str, phrases: bool = False) -> str:
    """A recursive CTE of that name over the cells, from the states begun (score, idx of the row before, state columns); with phrases it ends with the row's phrase."""
    first = "score, idx, 0 AS kind, NULL::VARCHAR AS reason, NULL::VARCHAR AS mode, NULL::INT AS own, NULL::DOUBLE AS sat, NULL::INT AS freed, 0 AS b, 0 AS midi, FALSE AS shown"
    inside = " AND (c.idx % 5 <> 0 OR s.kind = 0 AND s.mode IS NULL AND s.reason IS NULL)" if phrases else ""
    return f"""{name} AS (
  SELECT {first}, {_STATE} FROM ({begun})
  UNION ALL
  SELECT score, idx, kind, reason, mode, own, sat, CASE WHEN reason IS NULL THEN freed END, b, midi, sco AND kind <> 8,
    CASE WHEN gone THEN NULL WHEN kind = 1 AND NOT elsewhere THEN NULL WHEN moved THEN own ELSE str END,
    CASE WHEN gone OR lost THEN NULL WHEN kind = 1 AND NOT elsewhere THEN NULL WHEN moved AND kind = 13 THEN g WHEN moved THEN sat ELSE plc END,
    CASE WHEN gone THEN NULL WHEN kind = 1 AND NOT coalesce(list_contains(list_transform(kept, lambda v: v.f), fin), FALSE) THEN NULL ELSE fin END,
    CASE WHEN kind IN (8, 9) THEN NULL WHEN gone OR mode = 'open' THEN 'open' WHEN kind = 12 THEN NULL WHEN moved THEN 'stopped' ELSE man END,
    CASE WHEN kind = 9 THEN man = 'open' OR (man IS NULL AND oar) WHEN kind = 2 AND mode = 'open' THEN FALSE WHEN kind IN (8, 12) OR gone OR mode = 'open' THEN oar WHEN moved OR man IN ('stopped', 'harmonic') THEN FALSE ELSE oar END IS TRUE,
    sco AND kind NOT IN (8, 9), CASE WHEN kind IN (8, 9) THEN NULL WHEN mode = 'harmonic' AND reason IS NULL THEN sat ELSE tou END,
    CASE WHEN kind IN (5, 9) AND (kind = 9 OR mode IS NOT NULL) THEN NULL WHEN kind = 13 AND mode = 'stopped' THEN a WHEN kind = 4 AND mode IS NOT NULL THEN CASE WHEN plc IS NOT NULL THEN str END WHEN kind = 6 AND plc IS NOT NULL THEN str ELSE ors END,
    CASE WHEN kind IN (5, 9) AND (kind = 9 OR mode IS NOT NULL) THEN NULL WHEN kind = 13 AND mode = 'stopped' THEN h WHEN kind = 4 AND mode IS NOT NULL THEN plc WHEN kind = 6 AND plc IS NOT NULL THEN plc ELSE orp END,
    CASE WHEN moved AND fin IS NOT NULL THEN list_append(list_filter(kept, lambda v: v.f <> fin), {{'f': fin, 's': own, 'p': CASE WHEN kind = 13 THEN g ELSE sat END::DOUBLE}}) WHEN freed IS NOT NULL AND reason IS NULL THEN list_filter(kept, lambda v: v.f <> lift) ELSE kept END
  FROM (SELECT *, reason IS NULL AND mode = 'stopped' AND sat IS NOT NULL AS moved, reason IS NULL AND kind IN (10, 11) AND lift = fin AS gone, kind = 6 OR (kind = 5 AND mode IS NULL) AS lost, str IS NOT NULL AND plc IS NOT NULL AND str <> a AS elsewhere,
    CASE WHEN kind = 1 THEN list_filter(pls, lambda v: v.s <> a) WHEN kind = 6 OR (kind = 5 AND mode IS NULL) THEN list_filter(pls, lambda v: str IS NULL OR v.s <> str) ELSE pls END AS kept
  FROM (SELECT *, CASE WHEN kind IN (3, 4, 5) THEN str ELSE a END AS own, CASE kind WHEN 10 THEN str WHEN 11 THEN CASE WHEN fin = lift AND str IS NOT NULL THEN str ELSE list_filter(pls, lambda v: v.f = lift)[1].s END END AS freed,
    CASE WHEN kind = 8 THEN 'ornament_or_control' WHEN kind IN (9, 14) THEN 'empty_jianzi' WHEN kind = 3 AND mode IS NULL THEN 'no_explicit_string' WHEN kind = 6 OR (kind IN (4, 5) AND mode IS NULL) THEN 'context_dependent_slide'
      WHEN kind = 10 AND lift IS NULL THEN 'zhuaqi_requires_previous_thumb_stopped_note' WHEN kind = 11 AND lift IS NULL THEN 'daiqi_requires_previous_stopped_note' WHEN mode = 'harmonic' AND sat IS NULL THEN 'harmonic_hui_missing' WHEN kind = 15 AND sat IS NULL THEN 'current_stopped_position_missing' END AS reason
  FROM (SELECT *, CASE WHEN mode = 'harmonic' THEN CASE WHEN kind IN (0, 7, 13) THEN h ELSE tou END WHEN kind IN (2, 15) AND mode = 'stopped' THEN plc WHEN kind = 5 THEN orp WHEN mode = 'stopped' THEN h END::DOUBLE AS sat,
    CASE WHEN kind = 10 AND str IS NOT NULL AND fin = '大指' THEN fin WHEN kind = 11 THEN CASE WHEN fin IS NOT NULL AND str IS NOT NULL THEN fin WHEN list_contains(list_transform(pls, lambda v: v.f), fin) THEN fin ELSE pls[len(pls)].f END END AS lift
  FROM (SELECT *, CASE WHEN kind IN (0, 7, 13, 15) THEN CASE WHEN sco THEN 'harmonic' ELSE 'stopped' END WHEN kind = 1 THEN 'open' WHEN kind = 2 THEN CASE WHEN sco THEN 'harmonic' WHEN man = 'open' OR (man IS NULL AND oar) THEN 'open' ELSE 'stopped' END
      WHEN kind = 3 AND man = 'stopped' AND str IS NOT NULL THEN 'stopped' WHEN kind = 4 AND str IS NOT NULL THEN 'stopped' WHEN kind = 5 AND ors = str THEN 'stopped' WHEN kind = 12 THEN 'stopped' END AS mode
  FROM (SELECT c.score, c.idx, c.kind, c.a, c.b, c.h, c.g, c.f, c.midi, s.oar, s.pls, CASE WHEN c.kind IN (0, 7, 12, 13) THEN c.f ELSE s.fin END AS fin, CASE WHEN s.sco OR c.kind = 7 THEN 'harmonic' ELSE s.man END AS man, s.sco OR c.kind = 7 AS sco,
      CASE WHEN c.kind = 7 THEN c.h ELSE s.tou END AS tou, CASE WHEN c.kind <> 7 THEN s.str END AS str, CASE WHEN c.kind <> 7 THEN s.plc END AS plc, CASE WHEN c.kind NOT IN (0, 1, 2, 3, 7, 8, 12, 13, 15) THEN s.ors END AS ors, CASE WHEN c.kind NOT IN (0, 1, 2, 3, 7, 8, 12, 13, 15) THEN s.orp END AS orp
    FROM {name} s JOIN {cells} c ON c.score = s.score AND c.idx = s.idx + 1{inside}))))))"""


_PITCH = "(CASE WHEN {m} = 'harmonic' THEN o[{s}] + n[{p}::INT] WHEN {m} = 'open' OR {p} IS NULL THEN o[{s}] ELSE o[{s}] + 12 * log2(1 / x[{p}::INT]) END)"
_TUNED = f"""tuned AS (SELECT {music.STANDARD_TUNING} AS o, {music.HARMONIC_SEMITONES} AS n, [1/8, 1/6, 1/5, 1/4, 1/3, 2/5, 1/2, 3/5, 2/3, 3/4, 4/5, 5/6, 7/8] AS x)"""


def _sounded(name: str, of: str, more: str = "") -> str:
    return f"""{name} AS (SELECT *, CASE WHEN reason IS NOT NULL THEN [] WHEN freed IS NOT NULL THEN [o[freed]] WHEN kind = 12 THEN [{_PITCH.format(m="mode", s="own", p="sat")}, o[b]] ELSE [{_PITCH.format(m="mode", s="own", p="sat")}] END AS pitches FROM {of}, tuned WHERE idx >= 0{more})"""


#: The empty hand before each score.
_BEGUN = """SELECT DISTINCT score, -1 AS idx, NULL::INT AS str, NULL::DOUBLE AS plc, NULL::VARCHAR AS fin, NULL::VARCHAR AS man, FALSE AS oar, FALSE AS sco, NULL::DOUBLE AS tou, NULL::INT AS ors, NULL::DOUBLE AS orp, []::STRUCT(f VARCHAR, s INT, p DOUBLE)[] AS pls FROM cells"""
FOLD_SQL = ",\n".join([_CELLS, _fold("folded", "cells", _BEGUN), _TUNED, _sounded("sounded", "folded")])


def _cents(pitches: str) -> Column:
    return F.array_join(F.transform(pitches, lambda p: F.round(p * 100).cast("long").cast("string")), ",")


@query(f"""WITH RECURSIVE {FOLD_SQL} SELECT score, idx, reason, coalesce(list_aggregate(list_transform(pitches, lambda p: round(p * 100)::BIGINT), 'string_agg', ','), '') AS cents, shown AS scope, str AS string, plc AS hui, fin AS finger, man AS manner, ors AS origin_string,
  coalesce(list_aggregate(list_transform(pls, lambda v: v.f || v.s || '@' || v.p::INT), 'string_agg', ','), '') AS places FROM sounded""")
def f1_replay(spark, sf_dir):
    """what each row sounds, and the hand after it, by the fold."""
    rows = fold.sounded(fold.folded(dealt(spark, sf_dir)))
    places = F.array_join(F.transform(F.map_entries("places"), lambda e: F.concat(e["key"], e["value"]["string"].cast("string"), F.lit("@"), e["value"]["hui"].cast("int").cast("string"))), ",")
    return rows.select("score", "idx", "reason", _cents("pitches").alias("cents"), "scope", "string", "hui", "finger", "manner", "origin_string", places.alias("places"))


@query(f"""WITH RECURSIVE {FOLD_SQL}, held AS (SELECT *, CASE WHEN kind <> 9 AND reason IS NULL THEN list_min(list_transform(pitches, lambda p: abs(p - midi) * 100)) END AS miss FROM sounded)
SELECT score, idx, CASE WHEN kind = 9 OR reason IS NOT NULL THEN 'skipped' WHEN miss <= 50 THEN 'matched' ELSE 'mismatched' END AS status,
  CASE WHEN kind = 9 THEN 'no_sounding_jianpu' WHEN reason IS NOT NULL THEN reason WHEN kind = 12 THEN CASE WHEN miss <= 50 THEN 'single_symbol_multivoice_main_note' ELSE 'pitch_count_mismatch' END END AS verdict,
  CASE WHEN kind <> 12 OR miss <= 50 THEN round(miss)::BIGINT END AS error,
  CASE WHEN reason IS NOT NULL OR freed IS NOT NULL THEN 0 WHEN kind = 12 THEN 2 ELSE 1 END AS n_resolved FROM held""")
def f2_audit(spark, sf_dir):
    """Sounding pitches held against the targets."""
    rows = fold.audited(fold.sounded(fold.folded(dealt(spark, sf_dir))))
    return rows.select("score", "idx", "status", "verdict", F.round("error").cast("long").alias("error"), F.size("resolved").alias("n_resolved"))


# Reasons for which a cell counts as one that can't be played.
FAILS = ["string_out_of_range", "missing_hui", "harmonic_hui_missing", "hui_outside_not_valid_for_harmonic", "fractional_hui_not_valid_for_harmonic", "ambiguous_multiple_strings", "current_stopped_position_missing"]
_PREDICTED = "predicted AS (SELECT * REPLACE (CASE WHEN kind = 9 THEN 9 WHEN (kind + 5 * ((score % 3 + idx) % 2)) % 16 = 9 THEN 14 ELSE (kind + 5 * ((score % 3 + idx) % 2)) % 16 END AS kind) FROM cells)"
_STATUS = """CASE WHEN kind = 9 OR reason IS NOT NULL THEN 'skipped' WHEN list_min(list_transform(pitches, lambda p: abs(p - midi) * 100)) <= 50 THEN 'matched' ELSE 'mismatched' END"""
_ROWS_ONLY = " AND NOT (kind = 0 AND mode IS NULL AND reason IS NULL)"
_AFTER = ",\n".join([FOLD_SQL, _PREDICTED, _fold("tried", "predicted", f"SELECT score, idx, {_STATE} FROM folded WHERE (idx + 1) % 5 = 0", phrases=True), _sounded("attempt", "tried", _ROWS_ONLY)])


_PHRASE = ("score", "phrase")


def _tried(spark: SparkSession, sf_dir: str, seeds: bool) -> DataFrame:
    """Predicted phrases after their history, folded and with what the audit needs of the rows that come."""
    rows = fold.ahead(dealt(spark, sf_dir).drop("kind").withColumnRenamed("text", "reference").withColumnRenamed("predicted", "text"), _PHRASE)
    return fold.after_history(rows, seeds, ("attacks", "stopped_sounds", "places"))


@query(f"WITH RECURSIVE {_AFTER} SELECT score, idx, reason, {_STATUS} AS status, str AS string, plc AS hui, man AS manner, shown AS scope FROM attempt")
def f11_causal_replay(spark, sf_dir):
    """each predicted phrase after the reference of all rows before it, the reference being gone through once."""
    return fold.audited(fold.sounded(_tried(spark, sf_dir, False)), keys=_PHRASE).select("score", "idx", "reason", "status", "string", "hui", "manner", "scope")


_SEEDED = ",\n".join([
    FOLD_SQL, _PREDICTED, _fold("again", "cells", _BEGUN.replace("NULL::VARCHAR AS man", "'harmonic' AS man").replace("FALSE AS sco", "TRUE AS sco").replace("NULL::DOUBLE AS tou", "-1::DOUBLE AS tou")),
    """marks AS (SELECT score, idx, coalesce(last_value(CASE WHEN kind = 7 THEN TRUE WHEN kind IN (8, 9) THEN FALSE END IGNORE NULLS) OVER w, FALSE) AS marked, last_value(CASE WHEN mode = 'harmonic' AND reason IS NULL THEN sat END IGNORE NULLS) OVER w AS touched FROM folded WHERE idx >= 0 WINDOW w AS (PARTITION BY score ORDER BY idx))""",
    """borders AS (SELECT f.score, f.idx, coalesce(CASE WHEN (f.score + (f.idx + 1) // 5) % 5 = 0 THEN TRUE WHEN (f.score + (f.idx + 1) // 5) % 5 = 1 THEN FALSE END, marked, FALSE) AS allowed, touched FROM folded f LEFT JOIN marks m ON m.score = f.score AND m.idx = f.idx WHERE (f.idx + 1) % 5 = 0)""",
    """begun AS (SELECT score, idx, str, plc, fin, CASE WHEN idx >= 0 AND NOT allowed THEN NULL ELSE man END AS man, oar, sco AND (allowed OR idx < 0) AS sco, CASE WHEN idx >= 0 AND NOT allowed THEN NULL WHEN tou = -1 THEN touched ELSE tou END AS tou, CASE WHEN allowed OR idx < 0 THEN ors END AS ors,
      CASE WHEN allowed OR idx < 0 THEN orp END AS orp, pls FROM (SELECT f.*, allowed, touched FROM folded f JOIN borders b ON b.score = f.score AND b.idx = f.idx WHERE NOT (allowed AND touched IS NOT NULL) UNION ALL SELECT f.*, allowed, touched FROM again f JOIN borders b ON b.score = f.score AND b.idx = f.idx WHERE allowed AND touched IS NOT NULL))""",
    _fold("tried", "predicted", f"SELECT score, idx, {_STATE} FROM begun", phrases=True), _sounded("attempt", "tried", _ROWS_ONLY),
])


@query(f"WITH RECURSIVE {_SEEDED} SELECT score, idx, reason, {_STATUS} AS status, str AS string, plc AS hui, man AS manner, shown AS scope FROM attempt")
def f10_history_audit(spark, sf_dir):
    """the same with harmonic regions that are forced where a phrase begins: seeded by the last harmonic of its history, or ended."""
    return fold.audited(fold.sounded(_tried(spark, sf_dir, True)), keys=_PHRASE).select("score", "idx", "reason", "status", "string", "hui", "manner", "scope")


@query(f"""WITH RECURSIVE {_AFTER}, own AS (SELECT score, idx, {_STATUS} AS status, reason, kind, mode FROM sounded), pred AS (SELECT score, idx, {_STATUS} AS status, reason, kind, mode FROM attempt),
rows AS (SELECT p.score, p.idx // 5 AS phrase, p.kind <> 9 AS event, p.status, p.status = 'mismatched' OR coalesce(p.reason IN ({", ".join(f"'{x}'" for x in FAILS)}), FALSE) AS broken, o.status = 'mismatched' OR coalesce(o.reason IN ({", ".join(f"'{x}'" for x in FAILS)}), FALSE) AS excluded,
  CASE WHEN o.reason IS NULL AND o.kind NOT IN (10, 11, 12) THEN o.mode END AS tone, CASE WHEN p.reason IS NULL AND p.kind NOT IN (10, 11, 12) THEN p.mode END AS said FROM pred p JOIN own o USING (score, idx)),
agg AS (SELECT score, phrase, count(*) FILTER (event) AS n_events, count(*) FILTER (event AND excluded) AS n_excluded, count(*) FILTER (event AND NOT excluded AND status <> 'skipped') AS n_pitch, count(*) FILTER (event AND NOT excluded AND status = 'matched') AS n_matched,
  count(*) FILTER (event AND NOT excluded AND broken) AS n_broken, count(*) FILTER (event AND NOT excluded) AS n_clean, count(tone) FILTER (event) AS n_tone, count(*) FILTER (event AND tone = said) AS n_same FROM rows GROUP BY ALL),
parts AS (SELECT *, n_matched / nullif(n_pitch, 0) AS pitch, n_same / nullif(n_tone, 0) AS tone, 1 - n_broken / nullif(n_clean, 0) AS playability FROM agg)
SELECT score, phrase, n_events, n_excluded, n_pitch, n_broken, round(pitch, 6) AS pitch, round(tone, 6) AS tone, round(playability, 6) AS playability,
  round((coalesce(0.45 * pitch, 0) + coalesce(0.15 * tone, 0) + coalesce(0.15 * playability, 0)) / nullif(CASE WHEN pitch IS NULL THEN 0 ELSE 0.45 END + CASE WHEN tone IS NULL THEN 0 ELSE 0.15 END + CASE WHEN playability IS NULL THEN 0 ELSE 0.15 END, 0), 6) AS total FROM parts""")
def f11_phrase_report(spark, sf_dir):
    """each phrase's pitch, tone and playability, without the events that the reference itself fails, and their weighted mean over what can be judged."""
    judged = lambda df, name: fold.audited(fold.sounded(df), keys=_PHRASE).withColumn(name, F.struct("status", "reason", "sounds", "rest"))
    rows = fold.ahead(dealt(spark, sf_dir).drop("kind"), _PHRASE, "text", "__own_").withColumnRenamed("text", "reference").withColumnRenamed("predicted", "text")
    tried = judged(fold.after_history(fold.ahead(rows, _PHRASE), False, ("attacks", "stopped_sounds", "places")), "tried")
    return fold.phrase_report(judged(fold.own_rows(tried, ["phrase", "tried"]), "own"), list(_PHRASE), FAILS)
