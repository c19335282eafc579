"""Golden cases of replay and lint, of routes, sources and streams."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lutework.operators import replay
from lutework.operators.routes import baseline, k_best_directed
from lutework.sources import readers
from lutework.streaming import stream

SCHEMA = "score long, idx int, text string, structural boolean, rest boolean, targets array<double>"


def rows_of(spark, *cells):
    rows = []
    for i, c in enumerate(cells):
        text, targets, rest = (*c, False)[:3] if isinstance(c, tuple) else (c, [], False)
        rows.append((1, i, text, False, rest, [float(t) for t in targets]))
    return spark.createDataFrame(rows, SCHEMA)


def replayed(spark, *cells):
    return {r["idx"]: r for r in replay.audited(replay.replayed(rows_of(spark, *cells))).collect()}


def test_positioned_pluck_holds_its_string(spark):
    got = replayed(spark, "大指五徽勾六弦", "挑四徽六分", "挑三弦")
    assert (got[1]["string"], got[1]["hui"], got[1]["finger"]) == (6, 4.6, "大指")
    assert (got[2]["string"], got[2]["hui"]) == (3, 4.6)


def test_harmonic_region(spark):
    got = replayed(spark, "泛起大指七徽勾4弦", "3弦\n泛止", "名指十徽勾4弦")
    assert got[0]["mode"] == "harmonic" and got[0]["pitches"] == [67.0]
    assert got[2]["mode"] == "stopped" and not got[2]["scope"]
    assert got[1]["scope"]
    rest = replayed(spark, "泛起大指七徽勾4弦", ("", [], True), "勾三弦")
    assert rest[2]["mode"] == "stopped" and rest[2]["reason"] == "unknown_position"


def test_walk_and_return(spark):
    got = replayed(spark, "大指九徽勾三弦", "绰上七徽", "复")
    assert got[1]["pitches"][0] - got[0]["pitches"][0] == pytest.approx(12 - 7.0196, abs=0.01)
    assert got[2]["pitches"] == pytest.approx(got[0]["pitches"])
    assert replayed(spark, "散勾三弦")[0]["pitches"] == [53.0]


def test_pairs_and_lifted_fingers(spark):
    got = replayed(spark, "撮（大指九徽三弦按音＋五弦散音）", "挑七徽", "撮（二弦泛音七徽＋四弦泛音七徽）", "撮（大指七徽二弦按音＋大指七徽四弦按音）", "勾三弦")
    alone = replayed(spark, "大指九徽勾三弦")
    assert got[0]["pitches"] == pytest.approx([alone[0]["pitches"][0], 57.0]) and got[0]["mode"] is None
    assert (got[1]["string"], got[1]["hui"]) == (3, 7.0)
    assert got[2]["pitches"] == [62.0, 67.0] and got[2]["mode"] == "harmonic"
    assert got[3]["pitches"] == pytest.approx([62.0, 67.0]) and (got[4]["hui"], got[4]["finger"]) == (7.0, "大指")
    lifted = replayed(spark, "大指九徽勾三弦", "散挑七弦爪起", "勾三弦")
    assert lifted[1]["pitches"] == [62.0, 53.0] and lifted[2]["mode"] == "open"
    assert replayed(spark, "名指九徽勾三弦", "爪起")[1]["reason"] == "zhuaqi_requires_previous_thumb_stopped_note"
    assert replayed(spark, "名指九徽勾三弦", "带起")[1]["pitches"] == [53.0]
    assert replayed(spark, "散勾三弦", "带起")[1]["reason"] == "daiqi_requires_previous_stopped_note"


def test_status(spark):
    got = replayed(spark, ("散勾一弦", [48]), ("散勾一弦", [50]), ("历七六弦", [62]), ("", [60]), ("", [1]))
    assert [got[i]["status"] for i in range(5)] == ["matched", "mismatched", "matched", "skipped", "skipped"]
    swept = replayed(spark, ("散历七、六弦", [62]), ("", [60]))
    assert swept[0]["status"] == "matched"


CASES = [
    (["大指七徽勾三弦", "名指七徽勾二弦", "复"], {(2, "fu_without_walk_origin")}, set()),
    (["大指九徽勾三弦", "退", "复"], set(), {"fu_without_walk_origin", "repeated_fu_without_walk"}),
    (["大指九徽勾三弦", "退", "复", "复"], {(3, "repeated_fu_without_walk")}, {"fu_without_walk_origin"}),
    (["绰上七徽勾五弦"], {(0, "slide_attack_missing_left_finger")}, set()),
    (["绰大指上七徽勾五弦"], set(), {"slide_attack_missing_left_finger"}),
    (["散猱"], {(0, "open_attack_ornament")}, {"harmonic_ornament_without_stopped"}),
    ([("散勾一弦", [50])], {(0, "jianzi_pitch_mismatch")}, set()),
    (["勾九弦"], {(0, "invalid_string_number")}, set()),
    (["勾七弦"], set(), {"invalid_string_number"}),
    (["大指十二徽勾三弦", "绰上四徽"], {(1, "walk_span_too_large")}, {"walk_direction_reversed"}),
    (["大指九徽勾三弦", "绰上九徽"], {(1, "walk_endpoint_same_as_start")}, {"walk_span_too_large"}),
    (["大指九徽勾三弦", "绰上十徽"], {(1, "walk_direction_reversed")}, {"walk_endpoint_same_as_start"}),
    (["大指九徽勾三弦", *[(f"{w}徽", [60]) for w in ("绰上八", "绰上七", "注下八", "注下九")]], {(4, "consecutive_walks_without_attack")}, set()),
    (["大指九徽勾三弦", *[(f"{w}徽", [60]) for w in ("绰上八", "绰上七", "注下八")]], set(), {"consecutive_walks_without_attack"}),
    (["散勾三弦", "大指九徽勾三弦"], {(1, "open_to_stopped_same_string")}, set()),
    (["散勾三弦", "大指九徽勾四弦"], set(), {"open_to_stopped_same_string"}),
    (["散勾三弦", "散挑三弦"], {(1, "ordinary_open_same_string_reattack")}, set()),
    (["散勾三弦", "散挑四弦"], set(), {"ordinary_open_same_string_reattack"}),
    (["泛起大指七徽勾三弦", "大指九徽勾三弦"], {(1, "harmonic_to_same_string_attack")}, set()),
    (["泛起大指七徽勾三弦", "大指七徽勾三弦"], set(), {"harmonic_to_same_string_attack"}),
    (["泛起大指七徽勾三弦", "绰上"], {(1, "walk_inside_harmonic_region")}, set()),
    (["泛起大指七徽六分勾三弦"], {(0, "fractional_hui_in_harmonic")}, set()),
    (["拨一四弦"], {(0, "nonadjacent_pluck_pair")}, set()),
    (["泼一二弦"], set(), {"nonadjacent_pluck_pair"}),
    (["撮（三弦＋三弦）"], {(0, "same_string_cuo_pair")}, set()),
    (["大指五徽勾三弦", "大指十徽勾三弦"], {(1, "same_finger_reach_too_large")}, set()),
    (["大指五徽勾三弦", "名指十徽勾三弦"], set(), {"same_finger_reach_too_large"}),
    (["大指四徽勾三弦"], {(0, "low_hui_stopped_too_cramped")}, set()),
    (["大指四徽勾五弦"], set(), {"low_hui_stopped_too_cramped"}),
    (["散挑一弦"], {(0, "tiao_on_first_string")}, set()),
    (["大指九徽勾三弦", "名指九徽挑三弦"], {(1, "same_position_finger_change")}, set()),
    (["大指九徽勾三弦", "绰上七徽", "进复"], {(2, "jinfu_without_downward_walk")}, set()),
    (["大指九徽勾三弦", "退", "进复"], set(), {"jinfu_without_downward_walk"}),
    (["历一三弦"], {(0, "li_nonadjacent_strings")}, set()),
    (["历七六弦"], set(), {"li_nonadjacent_strings"}),
    (["名指九徽勾三弦", "大指十徽勾四弦"], {(1, "thumb_lower_left_position")}, set()),
    (["散勾三弦", "绰上"], {(1, "open_string_unplayable_gesture")}, set()),
    (["跪指九徽滔起"], {(0, "kneeling_taoqi_below_seventh_hui")}, set()),
    (["名指九徽勾三弦", "滔起"], {(1, "taoqi_without_thumb_origin")}, set()),
    (["大指九徽勾三弦", "滔起"], set(), {"taoqi_without_thumb_origin"}),
    (["泛起大指七徽勾三弦", "吟"], {(1, "harmonic_ornament_without_stopped")}, set()),
    ([("散勾一弦", [48]), ("", [50])], {(1, "missing_independent_attack")}, set()),
    ([("散勾一弦", [48]), ("", [48])], set(), {"missing_independent_attack"}),
    ([("大指九徽勾三弦", [60]), ("绰上七徽", [65]), ("", [60])], {(2, "illegal_blank_after_walk")}, set()),
]


def test_lint_cases(spark):
    """All cases in one job, each as a score of its own."""
    rows = []
    for k, (cells, _, _) in enumerate(CASES):
        for i, c in enumerate(cells):
            text, targets = c if isinstance(c, tuple) else (c, [])
            rows.append((k, i, text, False, False, [float(t) for t in targets]))
    found = replay.warnings(replay.audited(replay.replayed(spark.createDataFrame(rows, SCHEMA)))).collect()
    wrong = []
    for k, (cells, wanted, unwanted) in enumerate(CASES):
        got = {(r["idx"], r["code"]) for r in found if r["score"] == k}
        if not wanted <= got or {c for _, c in got} & unwanted:
            wrong.append((cells, sorted(got)))
    assert not wrong


def test_replay_of_nothing(spark):
    assert replay.warnings(replay.audited(replay.replayed(spark.createDataFrame([], SCHEMA)))).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_routes_are_the_cheapest(seed):
    """Against all sequences, the direction being carried over moves that have none."""
    r = random.Random(seed)
    steps = []
    for _ in range(5):
        found = [(n + 1, r.randint(1, 7), h, 0.0 if h is None else h / 14, r.choice([0.25, r.random()])) for n, h in enumerate(r.choice([None, 4.0, 7.0, 9.5]) for _ in range(r.randint(1, 4)))]
        steps.append((r.choice([0.125, 0.25, 0.5, 1.0, 2.0]), found))
    every = []
    for path in itertools.product(*(f for _, f in steps)):
        own, moved, total, direction = path[0][4], 0.0, path[0][4], 0
        for (beats, _), a, b in zip(steps[1:], path, path[1:], strict=False):
            cost = abs(a[1] - b[1]) * 0.75 + max(0, abs(a[1] - b[1]) - 1) * 0.3 + abs(a[3] - b[3]) * (8.0 + (4.0 / beats if beats < 0.5 else 0.0))
            turn = 0 if a[2] is None or b[2] is None else (b[2] > a[2]) - (b[2] < a[2])
            cost += 0.35 if turn * direction < 0 else 0.0
            direction = turn or direction
            own, moved, total = own + b[4], moved + cost, total + cost + b[4]
        every.append((round(total, 6), round(own, 6), round(moved, 6), tuple(c[0] for c in path)))
    for k in (1, 3, 7):
        got = [(*(round(x, 6) for x in costs), path) for *costs, path in k_best_directed(steps, k)]
        assert got == sorted(every, key=lambda x: (x[0], x[3]))[:k]
    assert k_best_directed([], 2) == [] and k_best_directed([*steps, (1.0, [])], 2) == []


def test_baseline_of_odd_phrases(spark):
    rows = [(1, 0, [60.0], 480), (1, 1, [], 480), (1, 2, [55.0, 62.4], None), (1, 3, None, 1), (2, 0, [60.0], 960), (2, 1, [130.0], 960), (None, 0, [60.0], 960), (3, 0, None, None)]
    frame = spark.createDataFrame(rows, "score long, idx int, pitches array<double>, ticks int").withColumn("string", F.lit("clash")).withColumn("cost", F.lit(1))
    got = {(x["score"], x["idx"]): x for x in baseline(frame, [48.0, 50.0, 53.0, 55.0, 57.0, 60.0, 62.0], ["score"]).collect()}
    assert set(got) == {(1, 0), (1, 2), (2, 0), (2, 1), (None, 0)}
    assert got[(1, 0)]["string"] and got[(1, 2)]["mode"] == "stopped" and not got[(1, 2)]["missing"]
    assert got[(2, 0)]["string"] is None and not got[(2, 0)]["missing"] and got[(2, 1)]["missing"]
    assert baseline(frame.limit(0), [48.0] * 7, ["score"]).count() == 0


def test_tunes(spark):
    df = spark.createDataFrame([("a", "C ^d2|[CE]/2 z")], "k string, body string")
    got = [(r["kind"], r["bar"], r["onset"], r["duration"], r["midis"]) for r in readers.tune_events(df, "k", "body").orderBy("idx").collect()]
    assert got == [("note", 0, 0, 480, [60]), ("note", 0, 480, 960, [75]), ("bar", 1, 1440, 0, None), ("chord", 1, 1440, 240, [60, 64]), ("rest", 1, 1680, 480, None)]


def test_report_round_trip(spark, tmp_path):
    e = spark.createDataFrame([(1, "a")], "id int, v string")
    readers.write_report(e, e, e, f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r/violations").collect()[0]["v"] == "a"
    assert readers.json_documents(spark, f"{tmp_path}/r/violations", "id int, v string").count() == 1


def test_valid_prefix_stream(spark, tmp_path):
    rows = [(1, 0, True), (1, 2, True), (2, 0, False), (1, 1, True), (1, 3, False), (1, 4, True)]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], "k int, n int, ok boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    found = stream.valid_prefixes(stream.file_stream(spark, f"{tmp_path}/in", "k int, n int, ok boolean", 2), "k", "n", "ok")
    run = found.writeStream.format("memory").queryName("prefixes").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r["k"]: (r["length"], r["closed"]) for r in spark.table("prefixes").groupBy("k").agg(F.max("length").alias("length"), F.bool_or("closed").alias("closed")).collect()}
    assert got == {1: (3, True), 2: (0, True)}
