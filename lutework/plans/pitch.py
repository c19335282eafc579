"""Pitch, position and cell-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import music, text
from ..operators.candidates import best_positions, near_positions, position_grid
from .adapters import NOTES, notes, table
from .registry import Registry

REGISTRY = query = Registry()
#: Cells of tablature, dealt over the line items by part key.
CELLS = ["大指九徽勾三弦", "散挑七弦", "名指十徽八分挑四七弦", "泛起中指七徽勾二弦", "历四至六弦", "历七、六弦", "撮三弦一弦", "徽外半按音勾五弦", "剔五弦散如一四弦", "绰上七徽六分猱", "(勾3弦) 吟", "掐撮三声", "进复退复", "徽外勾一弦"]
DEGREES = ["1", "5̇", "6̣", "♯4", "3b", "休止", "", "7̇̇", "2#", "延音"]
TONICS = ["1=F", "1=C", "1=B", "1=bE", "1=G", "1=♯F", None, "1=H"]

_FRACTIONS = str(music.STUD_FRACTIONS)
GRID = f"""fr AS (SELECT {_FRACTIONS} AS c), op AS (SELECT unnest(range(1, 8))::INT AS string, unnest({music.STANDARD_TUNING})::DOUBLE AS o),
st AS (SELECT string, 'stopped' AS mode, h AS hui, NULL AS label, o + 12 * log2(1.0::DOUBLE / (c[floor(h)::INT] + (h - floor(h)) * (c[least(floor(h)::INT + 1, 13)] - c[floor(h)::INT]))) AS midi
  FROM op, fr, (SELECT unnest(range(10, 131)) / 10.0::DOUBLE AS h)),
ou AS (SELECT string, 'stopped' AS mode, 12.3::DOUBLE AS hui, l AS label, o + 12 * log2(1.0::DOUBLE / (c[12] + 0.3::DOUBLE * (c[13] - c[12]))) - x AS midi FROM op, fr, (VALUES ('徽外', 1.0::DOUBLE), ('徽外半', 2.0::DOUBLE)) v(l, x)),
ha AS (SELECT string, 'harmonic' AS mode, n::DOUBLE AS hui, NULL AS label, o + {music.HARMONIC_SEMITONES}[n] AS midi FROM op, (SELECT unnest(range(1, 14))::INT AS n)),
grid AS (SELECT string, 'open' AS mode, NULL::DOUBLE AS hui, NULL AS label, o AS midi FROM op UNION ALL SELECT * FROM st UNION ALL SELECT * FROM ou UNION ALL SELECT * FROM ha)"""
REGION = """CASE WHEN mode = 'open' THEN 0.25::DOUBLE WHEN mode = 'harmonic' THEN 0.45::DOUBLE
  ELSE round(abs(hui - 7.5) * 0.12::DOUBLE + greatest(0, 4 - hui) * 0.8::DOUBLE + greatest(0, hui - 11) * 0.9::DOUBLE, 6) END"""


@query(f"""WITH {NOTES}, {GRID}, t AS (SELECT DISTINCT midi::DOUBLE AS target FROM notes WHERE NOT structural),
f AS (SELECT target, string, mode, hui, label, (g.midi - target) * 100 AS cents, {REGION} AS region FROM t JOIN grid g ON abs((g.midi - target) * 100) <= 35),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(abs(cents), 3), CASE WHEN mode = 'open' THEN 0 ELSE 1 END, region, string, coalesce(hui, 0), coalesce(label, '')) AS rank FROM f)
SELECT score, idx, rank, string, mode, hui, label, round(cents, 3) AS cents FROM notes JOIN r ON notes.midi = r.target WHERE rank <= 3 AND NOT structural""")
def k1_candidates_top3(spark, sf_dir):
    """The three best positions of each sounding note."""
    found = best_positions(notes(spark, sf_dir).where("NOT structural").withColumnRenamed("midi", "note"), F.col("note"), position_grid(spark, music.STANDARD_TUNING))
    return found.select("score", "idx", "rank", "string", "mode", "hui", "label", F.round("cents", 3).alias("cents"))


@query(f"""WITH {GRID}, t AS (SELECT (40 + trunc(l_quantity)::INT)::DOUBLE AS target, count(*) AS n_notes FROM lineitem GROUP BY 1)
SELECT target, n_notes, mode, count(*) AS n, round(min(abs((midi - target) * 100)), 3) AS nearest FROM t JOIN grid ON abs((midi - target) * 100) <= 35 GROUP BY target, n_notes, mode""")
def j7_reverse_lookup(spark, sf_dir):
    """Which kinds of position give the pitches of the line items, and how many notes have each."""
    targets = table(spark, sf_dir, "lineitem").groupBy((40 + F.col("l_quantity").cast("int")).cast("double").alias("target")).agg(F.count("*").alias("n_notes"))
    found = near_positions(targets, position_grid(spark, music.STANDARD_TUNING))
    return found.groupBy("target", "n_notes", "mode").agg(F.count("*").alias("n"), F.round(F.min(F.abs("cents")), 3).alias("nearest"))


@query(f"""WITH {GRID}, p AS (SELECT p_partkey, p_partkey % 7 + 1 AS s, ['open', 'stopped', 'harmonic'][1 + p_partkey % 3] AS m, CASE p_partkey % 3 WHEN 1 THEN (10 + p_partkey % 121) / 10.0::DOUBLE WHEN 2 THEN 1 + p_partkey % 13 END AS h FROM part)
SELECT p_partkey, string, mode, hui, round(midi, 6) AS midi, {REGION} AS region_cost FROM p JOIN grid ON string = s AND mode = m AND hui IS NOT DISTINCT FROM h AND label IS NULL""")
def fmus_position_grid(spark, sf_dir):
    """F-mus3, F-mus4 and F-mus12: the pitch and region cost of the position that each part names."""
    k = F.col("p_partkey")
    mode = F.get(F.array(F.lit("open"), F.lit("stopped"), F.lit("harmonic")), (k % 3).cast("int"))
    hui = F.when(k % 3 == 1, (10 + k % 121) / 10.0).when(k % 3 == 2, (1 + k % 13).cast("double"))
    rows = table(spark, sf_dir, "part").select(k, (k % 7 + 1).cast("int").alias("string"), mode.alias("mode"), hui.alias("hui"))
    opened = F.get(F.array(*[F.lit(x) for x in music.STANDARD_TUNING]), F.col("string") - 1)
    midi = music.position_pitch(opened, F.col("hui"), F.lit(None).cast("string"), F.col("mode"))
    return rows.select("p_partkey", "string", "mode", "hui", F.round(midi, 6).alias("midi"), music.tone_region_cost(F.col("hui"), F.col("mode")).alias("region_cost"))


@query(f"""WITH fr AS (SELECT {_FRACTIONS} AS c), m AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_suppkey % 7 + 1)::INT AS s1, (l_partkey % 7 + 1)::INT AS s2, trunc(l_quantity)::INT % 13 + 1 AS h1, CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 13 + 1 END AS h2, ([0.125, 0.25, 0.5, 1.0]::DOUBLE[])[1 + l_linenumber % 4] AS beats, l_orderkey % 3 - 1 AS dir FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, s1, h1, s2, h2, round(abs(s2 - s1) * 0.75::DOUBLE + greatest(0, abs(s2 - s1) - 1) * 0.3::DOUBLE + x * 8 + CASE WHEN beats < 0.5 THEN x * 4 / greatest(beats, 0.125::DOUBLE) ELSE 0 END + CASE WHEN sign(h2 - h1) * dir < 0 THEN 0.35::DOUBLE ELSE 0 END, 6) AS cost
FROM m, fr, LATERAL (SELECT abs(coalesce(c[h2], 0) - c[h1]) AS x) l""")
def fmus_transition_cost(spark, sf_dir):
    """F-mus12: the cost of the move that each line item names, in its beats and after its direction."""
    q = F.col("l_quantity").cast("int")
    beats = F.get(F.array(*[F.lit(x) for x in (0.125, 0.25, 0.5, 1.0)]), F.col("l_linenumber") % 4)
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 7 + 1).cast("int").alias("s1"), (q % 13 + 1).alias("h1"), (F.col("l_partkey") % 7 + 1).cast("int").alias("s2"), F.when(F.col("l_partkey") % 5 > 0, F.col("l_partkey") % 13 + 1).alias("h2"),
        beats.alias("beats"), (F.col("l_orderkey") % 3 - 1).alias("dir"),
    )
    cost = music.transition_cost(F.col("s2"), F.col("h2").cast("double"), F.col("s1"), F.col("h1").cast("double"), F.col("beats"), F.col("dir"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "s1", "h1", "s2", "h2", F.round(cost, 6).alias("cost"))


def _dealt(spark, sf_dir, values, name):
    column = F.get(F.array(*[F.lit(v) for v in values]), F.col("p_partkey").cast("int") % len(values))
    return table(spark, sf_dir, "part").select("p_partkey", column.alias(name))


def _sql_list(values):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


@query(f"""WITH x AS (SELECT p_partkey, {_sql_list(DEGREES)}[1 + p_partkey % {len(DEGREES)}] AS t, {_sql_list(TONICS)}[1 + (p_partkey // 3) % {len(TONICS)}] AS tonic FROM part),
k AS (SELECT *, CASE WHEN tonic IS NULL THEN 'C' ELSE string_split(tonic, '=')[2] END AS l0 FROM x),
k2 AS (SELECT *, replace(CASE WHEN regexp_matches(l0, '^b[A-Ga-g]$') THEN upper(l0[2]) || 'B' ELSE upper(l0) END, '♯', '#') AS l FROM k),
m AS (SELECT *, CASE l WHEN 'F' THEN 65 WHEN 'C' THEN 60 WHEN 'B' THEN 58 WHEN 'EB' THEN 63 WHEN 'G' THEN 67 END::DOUBLE AS tm FROM k2)
SELECT p_partkey, tm AS tonic_midi, CASE WHEN NOT contains(t, '休止') AND NOT contains(t, '延音') THEN tm + [0, 2, 4, 5, 7, 9, 11][try_cast(regexp_extract(t, '([1-7])', 1) AS INT)]
  + 12 * (length(t) - length(replace(t, chr(775), '')) - length(t) + length(replace(t, chr(803), ''))) + length(t) - length(translate(t, '♯#', '')) - length(t) + length(translate(t, '♭b', '')) END AS midi FROM m""")
def fmus_degrees(spark, sf_dir):
    """F-mus1 and F-mus2: numbered notation and tonics to MIDI."""
    rows = _dealt(spark, sf_dir, DEGREES, "t").withColumn("tonic", F.get(F.array(*[F.lit(v) for v in TONICS]), F.floor(F.col("p_partkey") / 3).cast("int") % len(TONICS)))
    tonic = music.tonic_midi(F.col("tonic"), F.lit(None))
    return rows.withColumn("tonic_midi", tonic).select("p_partkey", "tonic_midi", music.degree_midi(F.col("t"), F.col("tonic_midi")).alias("midi"))


_ZH = "{'一': 1, '二': 2, '三': 3, '四': 4, '五': 5, '六': 6, '七': 7, '八': 8, '九': 9, '十': 10, '十一': 11, '十二': 12, '十三': 13, '1': 1, '2': 2, '3': 3, '4': 4, '5': 5, '6': 6, '7': 7}"
_MAP = "MAP " + _ZH


@query(f"""WITH x AS (SELECT p_partkey, {_sql_list(CELLS)}[1 + p_partkey % {len(CELLS)}] AS t FROM part),
s AS (SELECT *, flatten(list_transform(regexp_extract_all(replace(t, '如一', ''), '([一二三四五六七1-7]{{2,}}|十[一二三]?|[一二三四五六七1-7])弦', 1), lambda v: CASE WHEN v[1] = '十' THEN [v] ELSE string_split(v, '') END)) AS tok FROM x)
SELECT p_partkey, array_to_string(list_filter(list_transform(tok, lambda v: ({_MAP})[v]), lambda n: n BETWEEN 1 AND 7), ',') AS strings,
  CASE WHEN contains(t, '徽外半') THEN '徽外半' WHEN contains(t, '徽外') THEN '徽外' END AS label,
  CASE WHEN NOT contains(t, '徽外') AND regexp_matches(t, '[一二三四五六七八九十]徽') THEN ({_MAP})[regexp_extract(t, '(十三|十二|十一|十|九|八|七|六|五|四|三|二|一)徽', 1)]
    + coalesce(({_MAP})[nullif(regexp_extract(t, '徽([一二三四五六七八九])分', 1), '')], 0) / 10.0::DOUBLE END AS hui,
  CASE WHEN contains(t, '挑') THEN '挑' WHEN contains(t, '勾') THEN '勾' WHEN contains(t, '剔') THEN '剔' WHEN contains(t, '撮') THEN '撮' WHEN contains(t, '历') THEN '历' END AS right_hand,
  CASE WHEN contains(t, '至') THEN '4,5,6' WHEN contains(t, '历七、六') THEN '7,6' ELSE '' END AS sweep
FROM s""")
def fstr_cells(spark, sf_dir):
    """F-str1, F-str3, F-str4 and F-str5: strings, sweep, stud and right hand of cells."""
    rows = _dealt(spark, sf_dir, CELLS, "t")
    t = F.col("t")
    return rows.select(
        "p_partkey", F.array_join(text.string_numbers(t).cast("array<string>"), ",").alias("strings"), text.stud_label(t).alias("label"), text.stud(t).alias("hui"),
        text.first_of(t, ["挑", "勾", "抹", "剔", "托", "擘", "打", "摘", "撮", "历"]).alias("right_hand"), F.array_join(text.sweep_strings(t).cast("array<string>"), ",").alias("sweep"),
    )


ORNAMENTS = {"吟": "yin", "猱": "nao", "绰上": "chuo", "进复": "jinfu", "退复": "tuifu", "复": "fu", "散": "open", "掐撮三声": "qiacuo", "撮": "cuo"}


@query(f"""WITH x AS (SELECT p_partkey, {_sql_list(CELLS)}[1 + p_partkey % {len(CELLS)}] AS t FROM part),
m AS (SELECT *, regexp_extract_all(t, '掐撮三声|绰上|进复|退复|吟|猱|复|散|撮') AS k FROM x)
SELECT p_partkey, array_to_string(list_transform(list_filter(k, lambda v, i: list_position(k, v) = i), lambda v: (MAP {{'吟': 'yin', '猱': 'nao', '绰上': 'chuo', '进复': 'jinfu', '退复': 'tuifu', '复': 'fu', '散': 'open', '掐撮三声': 'qiacuo', '撮': 'cuo'}})[v]), ',') AS terms,
  len(k)::BIGINT AS n_markers, regexp_replace(replace(translate(t, '()', ''), ' ', ''), '3弦', '三弦', 'g') AS canonical,
  ((length(t) - length(replace(t, '进复', ''))) // 2)::BIGINT AS n_jinfu, (length(replace(t, '进复', '')) - length(replace(replace(t, '进复', ''), '复', '')))::BIGINT AS n_fu FROM m""")
def fstr_lexer(spark, sf_dir):
    """F-str6 to F-str11: longest-match lexing, destructive counts, markers and canonical cells."""
    t = F.col("t")
    counts = text.token_counts(t, ["进复", "复"])
    return _dealt(spark, sf_dir, CELLS, "t").select(
        "p_partkey", F.array_join(text.lexed(t, ORNAMENTS), ",").alias("terms"), F.size(text.markers(t, list(ORNAMENTS))).cast("long").alias("n_markers"), text.canonical_cell(t).alias("canonical"),
        counts["进复"].alias("n_jinfu"), counts["复"].alias("n_fu"),
    )


COMPACT = ["76", "13", "X", "X1", "X3", "X5", "X25", "9.5", "散", "", "7", "abc", "徽外", "10.8"]


@query(f"""WITH x AS (SELECT p_partkey, {_sql_list(COMPACT)}[1 + p_partkey % {len(COMPACT)}] AS t FROM part)
SELECT p_partkey, CASE t WHEN '76' THEN 7.6::DOUBLE WHEN '13' THEN 13 WHEN 'X' THEN 10 WHEN 'X1' THEN 11 WHEN 'X3' THEN 13 WHEN 'X5' THEN 10.5 WHEN 'X25' THEN 12.5 WHEN '9.5' THEN 9.5 WHEN '7' THEN 7 WHEN '10.8' THEN 10.8 END AS hui,
  CASE WHEN p_partkey % 2 = 0 THEN ['C', 'C♯', 'D', 'E♭', 'E', 'F', 'F♯', 'G', 'A♭', 'A', 'B♭', 'B'][1 + p_partkey % 12] || ((p_partkey % 12 + 48) // 12 - 1)::VARCHAR END AS name FROM x""")
def fmus_compact(spark, sf_dir):
    """F-mus5 and F-mus13: compact stud spellings and note names."""
    name = F.when(F.col("p_partkey") % 2 == 0, music.midi_name((F.col("p_partkey") % 12 + 48).cast("double")))
    return _dealt(spark, sf_dir, COMPACT, "t").select("p_partkey", music.compact_stud(F.col("t")).alias("hui"), name.alias("name"))


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT a.doc_id, a.w AS a, b.w AS b FROM t a JOIN t b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, round(coalesce(2.0::DOUBLE * len(list_intersect(list_distinct(a), list_distinct(b))) / nullif(len(list_distinct(a)) + len(list_distinct(b)), 0), 0), 6) AS f1,
  len(list_intersect(list_distinct(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])), list_distinct(list_transform(range(1, len(b)), lambda i: b[i] || ' ' || b[i + 1]))))::BIGINT AS shared_bigrams FROM p""")
def fstr_token_f1(spark, sf_dir):
    """F-str14: token F1 and shared bigrams of each document and the one with the next id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    a, b = docs.withColumnRenamed("w", "a"), docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("b"))
    both = F.array_intersect(F.array_distinct(text.bigrams(F.col("a"))), F.array_distinct(text.bigrams(F.col("b"))))
    return a.join(b, "doc_id").select("doc_id", F.round(text.token_f1(F.col("a"), F.col("b")), 6).alias("f1"), F.size(both).cast("long").alias("shared_bigrams"))


@query("""SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '(?i)(the|and)', '*', 'g')) AS masked, round(('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE, 9) AS noise,
  len(list_distinct(regexp_extract_all(coalesce(text, ''), '\\d+(?:\\.\\d+)?')))::BIGINT AS n_numbers FROM documents""")
def fstr_redaction(spark, sf_dir):
    """F-str13 and F-hash: masked terms, numbers and stable noise."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(text.redacted(t, ["and", "the"], "*"), 256).alias("masked"), F.round(text.tie_noise(7, F.col("doc_id")), 9).alias("noise"),
        F.size(text.new_numbers(F.lit(""), t)).cast("long").alias("n_numbers"),
    )
