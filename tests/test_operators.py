"""Golden and property cases of the notation operators."""

import pytest
from pyspark.sql import functions as F

from lutework.functions import music, text
from lutework.operators import curation, metrics, ordered
from lutework.operators.candidates import position_grid
from lutework.plans import ordered_queries


def value(spark, column, **given):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in given.items()) or "x int"
    row = [tuple(given.values())] if given else [(1,)]
    return spark.createDataFrame(row, schema).select(column.alias("v")).first()["v"]


def test_golden_pitches(spark):
    at = lambda o, h: value(spark, music.stopped_pitch(F.lit(float(o)), F.lit(float(h))))
    assert abs(at(57, 9) - 64) < 0.03  # fifth string, ninth stud
    assert round(at(62, 7.6)) == 72 or abs(at(62, 7.6) - 72) < 0.5
    assert value(spark, music.harmonic_pitch(F.lit(48.0), F.lit(6.0))) == 76
    assert round(at(48, 6)) == 64
    assert value(spark, music.harmonic_pitch(F.lit(48.0), F.lit(6.5))) is None
    assert at(48, 14) is None


def test_compact_studs(spark):
    for given, wanted in {"76": 7.6, "13": 13.0, "X": 10.0, "X2": 12.0, "X7": 10.7, "散": None, "?": None}.items():
        assert value(spark, music.compact_stud(F.col("t")), t=given) == wanted


def test_degrees(spark):
    for given, wanted in {"1": 60.0, "5̇": 79.0, "6̣": 57.0, "♯4": 66.0, "休止": None, "": None}.items():
        assert value(spark, music.degree_midi(F.col("t"), F.lit(60.0)), t=given) == wanted
    for given, wanted in {"1=F": 65.0, "1=B": 58.0, "1=bE": 63.0, "1=H": None}.items():
        assert value(spark, music.tonic_midi(F.col("t"), F.lit(None)), t=given) == wanted
    assert value(spark, music.tonic_midi(F.lit("1=F"), F.lit(70))) == 70.0


def test_cells(spark):
    assert value(spark, text.string_numbers(F.col("t")), t="挑四七弦") == [4, 7]
    assert value(spark, text.string_numbers(F.col("t")), t="剔五弦散如一四弦") == [5, 4]
    assert value(spark, text.sweep_strings(F.col("t")), t="历六至四弦") == [6, 5, 4]
    assert value(spark, text.stud(F.col("t")), t="十徽八分") == 10.8
    assert value(spark, text.stud_label(F.col("t")), t="徽外半") == "徽外半"
    assert value(spark, text.first_of(F.col("t"), ["挑", "勾"]), t="勾挑") == "挑"
    assert value(spark, text.canonical_cell(F.col("t")), t="（３弦） 挑") == "三弦挑"


def test_grid_size(spark):
    assert position_grid(spark, music.STANDARD_TUNING).count() == 959


def test_set_scores(spark):
    rows = [(["a", "b"], ["a"]), (["a"], []), ([], [])]
    df = spark.createDataFrame(rows, "r array<string>, p array<string>")
    got = metrics.rates(df.agg(*metrics.set_counts(F.col("r"), F.col("p")))).first()
    assert (got["n"], got["tp"], got["fp"], got["fn"]) == (2, 1, 0, 2)
    empty = metrics.rates(df.where("false").agg(*metrics.set_counts(F.col("r"), F.col("p")))).first()
    assert empty["f1"] is None


def test_wrong_predictions_count_twice(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", None), ("", "c"), (None, "c")], "r string, p string")
    got = df.agg(*metrics.field_counts(F.col("r"), F.col("p"))).first().asDict()
    assert got == {"n": 3, "correct": 1, "tp": 1, "fp": 1, "fn": 2}


def plain_ranges(rows, limit, slack):
    out, start = [], 0
    while start < len(rows):
        section, n, end = None, 0, len(rows)
        for i in range(start, len(rows)):
            sounding, bar, own = rows[i]
            if i > start and own is not None and own != section:
                end = i
                break
            section = section if own is None else own
            n += sounding
            if sounding and n >= limit + slack or n > limit and bar:
                end = i + 1
                break
        out.append((start, end, sum(r[0] for r in rows[start:end])))
        start = end
    return out


@pytest.mark.parametrize(
    "rows,limit,slack",
    [
        ([(1, 0, "a")] * 10 + [(0, 1, "a")] + [(1, 0, "a")] * 60, 32, 8),
        ([(1, 0, "1"), (1, 0, "1"), (1, 0, "2")], 32, 8),
        ([(1, 0, "a"), (0, 1, "a")] * 9, 3, 2),
        ([(1, 0, None), (1, 0, "a"), (0, 1, None), (1, 0, None), (1, 0, "a"), (1, 0, "b")] * 3, 2, 8),
        ([], 3, 2),
    ],
)
def test_phrase_ranges(spark, rows, limit, slack):
    df = spark.createDataFrame([([(i, bool(s), bool(b), sec) for i, (s, b, sec) in enumerate(rows)],)], "r array<struct<idx:int,sounding:boolean,is_bar:boolean,section:string>>")
    got = df.select(ordered.split_ranges(limit, slack)(F.col("r")).alias("v")).first()["v"]
    assert [tuple(x) for x in got] == plain_ranges(rows, limit, slack)


def test_checked_union_fails_on_repeats(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="repeated key"):
        curation.checked_union([a, a], "k").collect()
    assert curation.checked_union([a], "k").count() == 1


def test_edits_are_all_or_nothing(spark):
    plan = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "g string, k int, value string")
    edits = spark.createDataFrame([("a", 1, "x", "n"), ("a", 2, "?", "n"), ("b", 1, "z", "n")], "g string, k int, expected string, new string")
    got = {(r["g"], r["k"]): r["value"] for r in curation.applied_edits(plan, edits, "g", "k").collect()}
    assert got == {("a", 1): "x", ("a", 2): "y", ("b", 1): "n"}


def test_ancestors_beyond_the_recursion_limit(spark, tmp_path):
    keys = [1, 2, 3, 3, 7, 1000, 65_537, 2**30 + 5]
    spark.createDataFrame([(k,) for k in keys], "p_partkey int").write.parquet(f"{tmp_path}/part.parquet")
    wanted = {}
    for k in keys:
        a, n, total = k // 2, *wanted.get(k, (0, 0))
        while a:
            a, n, total = a // 2, n + 1, total + a
        if n:
            wanted[k] = (n, total)
    spark.conf.set("spark.sql.cteRecursionRowLimit", 20)
    try:
        got = ordered_queries.j15_ancestors(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert {x["c"]: (x["n_ancestors"], x["ancestor_sum"]) for x in got} == wanted and len(got) == len(wanted)


def test_glyphs(spark):
    from lutework.functions import glyphs

    cases = [
        ("zhyx", {"a": "d", "b": "79", "d": "g", "e": "4"}, None, "大指七徽九分勾4弦"), ("zhyx", {"a": "d", "e": "4"}, None, "大指4弦"), ("zhtyx", {"z": "m", "h": "X", "t": "c:", "y": "d", "x": "2"}, None, "名指十徽打2弦"),
        ("zhtyx", {"z": "m", "h": "X", "t": "c:", "y": "d", "x": "3"}, None, "绰名指十徽打3弦"), ("zhtyx", {"z": "m", "h": "9", "t": "pc:", "y": "g", "x": "3"}, None, "撮[名指九徽勾3弦"), ("zht", {"a": "g", "b": "5", "c": "tq:"}, None, "跪指五徽滔起"), ("th", {"h": "X8", "t": "u:"}, None, "绰上十徽八分"),
        ("tyx", {"c": "s:", "d": "t", "e": "7"}, None, "散挑7弦"), ("tyx", {"c": "jiu:", "d": "q", "e": "4"}, None, "就剔4弦"), ("tx", {"c": "zhi:", "e": "5"}, None, "至5弦"), ("yx", {"c": "f:", "d": "g", "e": "5"}, None, "泛音勾5弦"), ("d", {"d": ":yin:fei"}, None, "飞吟"), ("d", {"d": ":none"}, None, ":none"),
        (None, {"a": "pc:", "b": "d", "c": "9", "d": "3", "g": "5"}, None, "撮（大指九徽3弦按音＋5弦散音）"), (None, {"a": "pc:", "d": "3", "g": "5"}, None, "撮（3弦散音＋5弦散音）"), (None, {"a": "pc:", "d": "4", "e": "s", "f": "9", "g": "6"}, None, "撮（4弦散音＋食指九徽6弦按音）"),
        (None, {"a": "pfc:", "b": "d", "c": "9", "d": "3", "g": "5"}, None, "反撮[大指九徽3弦+5弦散音]"), (None, {"a": "pl:"}, None, "剌"), (None, {"a": "pc:", "d": "3"}, None, "撮（3弦散音）"), (None, {"a": "pst:", "b": "d", "c": "9", "d": "3", "f": "m", "g": "5"}, None, "三弹（大指九徽3弦按音＋名指九徽5弦按音）"),
        (None, {"a": "pc:"}, {"off_8": "pc:", "off_c": "d", "off_10": "7", "off_14": "1", "off_1c": "m", "off_20": "77", "off_24": "4"}, "撮（大指七徽1弦按音＋名指七徽七分4弦按音）"), (None, {"x": "d", "y": ":fu", "z": "7", "w": None, "v": ""}, None, "大指复7"), (None, None, None, ""), ("x", None, None, "弦"),
        ("zhyx", {"a": "d", "b": "145", "d": "g", "e": "4"}, None, "大指十四徽五分勾4弦"),
    ]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, kind string, slots map<string,string>, raw map<string,string>, want string").withColumn("form", F.lit("clash"))
    got = {x["id"]: x for x in glyphs.decoded(frame, F.col("kind"), F.col("slots"), F.col("raw")).collect()}
    assert [(c, got[i]["cell"]) for i, c in enumerate(cases) if got[i]["cell"] != c[3]] == [] and got[0]["form"] == "clash"
    assert glyphs.decoded(frame.limit(0), F.col("kind"), F.col("slots"), F.col("raw")).count() == 0


def test_nearest_by_brute_force(spark, monkeypatch):
    import numpy as np

    from lutework.operators import metrics

    r = np.random.default_rng(3)
    rows = [(i, None if i % 17 == 0 else "ab"[i % 2], [float(x) for x in r.integers(-2, 3, 4)]) for i in range(0, 1200, 4)] + [(50, "a", None), (100, "a", [0.0] * 4), (7, "b", [1.0, 1.0, 0.0, 0.0]), (7, "b", [1.0, 1.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "id long, label string, v array<double>").withColumn("q", F.lit(1)).withColumn("score", F.lit("clash")).repartition(5)

    def plain(k, kind):
        out = []
        for q, ql, qv in rows:
            if q % 100 or qv is None or not any(qv):
                continue
            found = []
            for i, label, v in rows:
                if i == q or v is None or not any(v):
                    continue
                cos, same = round(float(np.dot(qv, v) / (np.linalg.norm(qv) * np.linalg.norm(v))), 9), label is not None and label == ql
                if kind != "filtered" or same:
                    found.append((round(0.7 * cos + 0.3 * same, 9) if kind == "hybrid" else cos, i))
            out += [(q, i, s) for s, i in sorted(found, key=lambda x: (-x[0], x[1]))[:k]]
        return sorted(out)

    for size in (16 << 20, 100):
        monkeypatch.setattr(metrics, "BLOCK_BYTES", size)
        for kind in ("all", "filtered", "hybrid"):
            got = metrics.nearest(frame, "id", "label", "v", 5, kind).collect()
            assert sorted((x["query_id"], x["id"], round(x["score"], 8)) for x in got) == [(q, i, round(s, 8)) for q, i, s in plain(5, kind)]
    assert metrics.nearest(frame.where("id % 100 <> 0"), "id", "label", "v", 5).count() == 0 and metrics.nearest(frame.limit(0), "id", "label", "v", 5).count() == 0


def test_vector_search_holds_tiles_of_scores_and_not_all(monkeypatch):
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    vectors, labels = rng.integers(-3, 4, (4000, 16)).astype(float), [None if i % 11 == 0 else f"l{i % 3}" for i in range(4000)]
    sent = SimpleNamespace(value=(list(range(2000)), labels[:2000], vectors[:2000]))
    rows = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(labels), pa.array(list(vectors))], ["key", "l", "v"])
    for kind in ("all", "filtered", "hybrid"):
        tracemalloc.start()
        found = [x.to_pydict() for x in metrics._met(sent, 5, kind)(iter([rows]))]
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
        tracemalloc.stop()
        monkeypatch.setattr(metrics, "TILE_ROWS", 4000)
        monkeypatch.setattr(metrics, "TILE_SCORES", 1 << 30)
        assert [x.to_pydict() for x in metrics._met(sent, 5, kind)(iter([rows]))] == found
        monkeypatch.undo()


def test_routes_of_many_phrases_are_those_of_each_and_take_less_time(monkeypatch):
    import random
    import time

    from lutework.operators import routes

    r = random.Random(3)
    studs = [None, *(x / 2 for x in range(2, 27))]
    one = lambda i: (i + 1, r.randint(1, 7), r.choice(studs), r.randint(0, 8) / 8, r.choice([0.25, 0.5, 1.0, round(r.random(), 3)]))
    phrase = lambda wide: [(r.choice([0.125, 0.25, 0.5, 2.0]), [one(i) for i in range(r.choice([0, *[wide] * 30, 1, 2]))]) for _ in range(r.choice([1, 2, 5, 5, 9]))]
    for wide, k in ((14, 1), (3, 3), (4, 5), (2, 20)):
        phrases, began = [*(phrase(wide) for _ in range(600)), []], time.process_time()
        plain, middle = [routes.k_best_directed(x, k) for x in phrases], time.process_time()
        assert routes.k_best_of_many(phrases, k) == plain
        if wide == 14:
            assert time.process_time() - middle < (middle - began) / 2
        monkeypatch.setattr(routes, "MOVES", 2000)
        assert routes.k_best_of_many(phrases, k) == plain
        monkeypatch.undo()
