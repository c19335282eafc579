"""The fold over cells: each rule by golden rows, generated sequences, audits, odd inputs."""

import random

import pytest
from pyspark.sql import functions as F

from lutework.functions import music
from lutework.operators import fold

SCHEMA = "score long, idx int, text string, structural boolean, rest boolean, targets array<double>"
OPEN = music.STANDARD_TUNING
REST = (None, [], True)


def rows_of(spark, scores):
    rows = []
    for k, cells in enumerate(scores):
        for i, c in enumerate(cells):
            text, targets, rest, structural = (*c, False, False)[:4] if isinstance(c, tuple) and len(c) < 4 else c if isinstance(c, tuple) else (c, [], False, False)
            rows.append((k, i, text, structural, rest, [float(x) for x in targets]))
    return spark.createDataFrame(rows, SCHEMA)


def run(spark, *scores, cents=50.0):
    """The audited rows of each score, in order."""
    found = fold.audited(fold.sounded(fold.folded(rows_of(spark, scores))), cents).orderBy("score", "idx").collect()
    return [[r for r in found if r["score"] == k] for k in range(len(scores))]


def at(string, hui):
    fractions = music.STUD_FRACTIONS
    low = int(hui)
    f = fractions[low - 1] + (hui - low) * (fractions[min(low, 12)] - fractions[low - 1])
    import math

    return OPEN[string - 1] + 12 * math.log2(1 / f)


#: By rule of the dispatch: cells, and of the last one its pitches or reason, then some of the hand after it.
GOLDEN = [
    (["勾九弦"], "invalid_string_number", {}),
    (["大指七徽勾三弦", "勾九弦", "挑六徽"], [at(3, 6)], {"string": 3}),  # a bad string changes nothing
    (["大指九徽勾三弦", "退", "泛止", "复"], "context_dependent_slide", {}),  # a marker takes the walk's origin
    (["大指九徽勾三弦", "泛起大指七徽勾四弦"], [OPEN[3] + 12], {"scope": True, "manner": "harmonic", "string": None}),
    (["散勾三弦", ""], "empty_jianzi", {"manner": "open"}),
    (["掐撮三声"], "context_dependent_compound_gesture", {}),
    (["历拂"], "context_dependent_compound_gesture", {}),
    (["拨一弦"], "context_dependent_compound_gesture", {}),
    (["大指九徽勾三弦", "撮（泛音七徽二弦＋泛音七徽四弦）"], [OPEN[1] + 12, OPEN[3] + 12], {"string": None, "finger": None, "manner": "harmonic"}),
    (["撮（泛音七徽二弦＋泛音四弦）"], "double_harmonic_position_missing", {}),
    (["撮（泛音七徽二弦＋泛音散音七徽四弦）"], "double_harmonic_mode_conflict", {}),
    (["撮（泛音七徽六分二弦＋泛音七徽四弦）"], "fractional_hui_not_valid_for_harmonic", {}),
    (["撮（大指七徽二弦按音＋大指七徽四弦按音）"], [at(2, 7), at(4, 7)], {"string": None, "hui": 7.0, "finger": "大指"}),
    (["撮（大指七徽二弦按音＋名指八徽四弦按音）", "勾一弦"], [OPEN[0]], {}),  # nothing shared: an unknown place sounds as an open string
    (["撮（大指七徽二弦按音＋名指八徽四弦按音）", "名指带起散挑七弦"], [OPEN[6], OPEN[3]], {}),  # but each finger is remembered
    (["大指九徽勾三弦", "爪起"], [OPEN[2]], {"string": None, "manner": "open", "finger": None}),
    (["大指九徽勾三弦", "散挑七弦爪起"], [OPEN[6], OPEN[2]], {"manner": "open"}),
    (["大指九徽勾三弦", "抓起散挑三弦"], [OPEN[2]], {}),  # the same pitch sounds once
    (["名指九徽勾三弦", "爪起"], "zhuaqi_requires_previous_thumb_stopped_note", {"string": 3}),
    (["大指九徽勾三弦", "勾九弦爪起"], "invalid_string_number", {}),
    (["大指九徽勾三弦", "名指九徽爪起"], "no_explicit_string", {"string": 3}),
    (["大指九徽勾三弦", "名指十徽勾四弦爪起", "名指带起"], "zhuaqi_requires_previous_thumb_stopped_note", None),  # shared fingers: see below
    (["名指九徽勾三弦", "带起"], [OPEN[2]], {"string": None, "manner": "open"}),
    (["大指九徽勾三弦", "名指十徽勾四弦", "大指带起散挑七弦"], [OPEN[6], OPEN[2]], {"string": 4, "finger": "名指"}),
    (["大指九徽勾三弦", "大指带起"], "no_explicit_string", {"string": 3}),  # a finger alone is a cell that says no string
    (["大指九徽勾三弦", "名指十徽勾四弦", "带起"], [OPEN[3]], {"string": None}),
    (["大指九徽勾三弦", "名指十徽勾四弦", "散勾四弦", "带起"], [OPEN[2]], {}),  # the last one used that still holds
    (["大指九徽勾三弦", "散勾四弦", "带起"], [OPEN[2]], {}),
    (["大指九徽勾三弦", "散挑七弦带起同声"], [OPEN[6], OPEN[2]], {}),
    (["大指九徽勾三弦", "名指带起"], "daiqi_requires_previous_stopped_note", {}),
    (["散勾三弦", "带起"], "daiqi_requires_previous_stopped_note", {}),
    (["泛起大指七徽勾四弦", "泛止名指九徽勾五弦"], [at(5, 9)], {"scope": False}),
    (["泛起大指七徽勾四弦", "停泛止"], "ornament_or_control", {"manner": None}),
    (["大指九徽勾三弦", "泛起七徽", "勾三弦"], [OPEN[2] + 12], {"scope": True}),
    (["至三弦"], "context_dependent_transition", {}),
    (["大指九徽勾三弦", "退", "复"], [at(3, 9)], {"hui": 9.0}),  # the end of a bare walk isn't known, but its origin is
    (["大指九徽勾三弦", "绰上七徽", "复"], [at(3, 9)], {"hui": 9.0, "origin_string": None}),
    (["大指九徽勾三弦", "绰上七徽", "复", "复"], "context_dependent_slide", {"hui": None}),
    (["大指九徽勾三弦", "绰上七徽六分"], [at(3, 7.6)], {"hui": 7.6, "origin_string": 3}),
    (["绰上七徽"], "context_dependent_slide", {}),
    (["大指九徽勾三弦", "跪指五徽滔起"], [at(3, 5)], {"finger": "跪指", "origin_string": None}),
    (["大指九徽勾三弦", "退", "挑三弦"], [OPEN[2]], {}),
    (["大指九徽勾三弦", "吟"], "ornament_or_control", {"hui": 9.0}),
    (["撮（大指九徽三弦按音＋五弦散音）"], [at(3, 9), OPEN[4]], {"string": 3, "hui": 9.0, "finger": "大指", "manner": None}),
    (["撮（五弦散音＋大指九徽三弦按音）"], [at(3, 9), OPEN[4]], {"finger": "大指"}),
    (["撮（三弦九徽按音＋五弦散音）"], [at(3, 9), OPEN[4]], {}),
    (["撮（五弦散音、名指三弦九徽按音）"], [at(3, 9), OPEN[4]], {"finger": "名指"}),
    (["撮（大指徽外三弦按音＋五弦散音）"], [at(3, 12.3) - 1, OPEN[4]], {"label": "徽外"}),
    (["大指五徽勾六弦", "挑四徽六分"], [at(6, 4.6)], {"string": 6, "hui": 4.6}),
    (["散勾六弦", "挑四徽六分"], "no_explicit_string", {}),
    (["勾"], "no_explicit_string", {}),
    (["大指九徽勾三弦四弦"], "ambiguous_multiple_strings", {}),
    (["散历七六弦"], [OPEN[6], OPEN[5]], {}),
    (["泛起大指七徽勾三弦", "散勾四弦", "勾五弦"], [OPEN[4] + 12], {"scope": True}),
    (["泛起大指七徽勾三弦", "按音大指九徽勾四弦"], [at(4, 9)], {"scope": True}),
    (["泛音勾三弦"], "harmonic_hui_missing", {}),
    (["泛起大指七徽六分勾三弦"], "fractional_hui_not_valid_for_harmonic", {}),
    (["大指九徽勾三弦", "就挑四弦"], [at(4, 9)], {"string": 4, "finger": "大指"}),
    (["就挑四弦"], "current_stopped_position_missing", {}),
    (["散勾三弦", "勾四弦"], [OPEN[3]], {"manner": "open"}),
    (["散勾三弦", REST, "勾四弦"], [OPEN[3]], {"manner": "open"}),
    (["大指九徽勾三弦", REST, "勾三弦"], [at(3, 9)], {}),  # a rest leaves the hand where it is
    (["大指九徽勾三弦", "散勾四弦", "绰上七徽"], [at(3, 7)], {}),  # and an open pluck of another string does so
    (["大指九徽勾三弦", "散勾三弦", "绰上七徽"], "context_dependent_slide", {}),
    (["大指九徽勾三弦", "剔五弦散如一四弦"], [at(5, 9), OPEN[3]], {}),
    (["名指十徽勾二弦绰上九徽"], [at(2, 10)], {"hui": 9.0, "origin_string": 2}),
    (["名指十徽勾二弦绰上九徽", "散挑五弦", "绰上八徽"], [at(2, 8)], {}),
    (["名指十徽勾二弦绰上九徽", "复"], [at(2, 10)], {"hui": 10.0}),
    (["大指九徽勾三弦", "绰上七徽", "注下大指八徽勾三弦", "复"], [at(3, 7)], {}),  # a pluck that a walk leads to goes on with it
    (["大指九徽勾三弦", "绰上七徽", "大指八徽勾三弦", "复"], "context_dependent_slide", {}),
    (["泛起大指七徽勾4弦", "3弦\n泛止", "名指十徽勾4弦"], [at(4, 10)], {"scope": False}),
    (["泛起撮（大指七徽二弦按音＋大指七徽四弦按音）", "挑三弦"], [OPEN[2] + 12], {}),
    (["大指十三徽五分勾三弦"], "hui_out_of_range", {}),
]


def test_each_rule(spark):
    wrong = []
    for (cells, want, hand), rows in zip(GOLDEN, run(spark, *[g[0] for g in GOLDEN]), strict=True):
        last = rows[-1]
        got = last["reason"] or [round(p, 6) for p in last["pitches"]]
        if hand is None:
            continue
        want = want if isinstance(want, str) else [round(p, 6) for p in want]
        if got != want or any(last[k] != v for k, v in hand.items()):
            wrong.append((cells, want, got, {k: last[k] for k in hand}))
    assert not wrong, wrong


def test_what_is_beside_a_lifted_thumb_uses_the_same_fingers(spark):
    """A plucking thumb's copy shares the fingers, so that a finger set beside it stays known; a lifted finger's copy has its own."""
    thumb, other = run(spark, ["大指九徽勾三弦", "名指十徽勾四弦爪起"], ["大指九徽勾三弦", "名指十徽勾四弦带起"])
    assert thumb[1]["pitches"] == pytest.approx([at(4, 10), OPEN[2]]) and set(thumb[1]["places"]) == {"名指"}
    assert other[1]["reason"] == "daiqi_requires_previous_stopped_note" and set(other[1]["places"]) == {"大指"}
    both = run(spark, ["大指九徽勾三弦", "散挑七弦带起爪起"])[0]
    assert both[1]["pitches"] == [OPEN[6], OPEN[2]] and both[1]["attacks"] == [] and both[1]["resolved"] == []


def test_statuses(spark):
    cases = [
        ([("散勾一弦", [48])], "matched", None), ([("散勾一弦", [50])], "mismatched", None), ([("散勾一弦", [])], "skipped", "no_sounding_jianpu"), ([("拂一至六弦", [60])], "skipped", "compound_sweep_pitch_ambiguous"),
        ([("散勾一弦散挑六弦", [48])], "matched", "single_symbol_multivoice_main_note"), ([("散勾一弦", [48, 60])], "mismatched", "pitch_count_mismatch"), ([("散勾一弦散挑六弦", [60, 48])], "matched", None),
        ([("散挑五弦应合", [57, 50])], "matched", "yinghe_single_pitch_match"), ([("散挑五弦放合", [56, 50])], "mismatched", "fanghe_no_pitch_match"), ([("绰勾一弦", [48])], "skipped", "context_dependent_pre_attack_technique"),
        ([("绰大指七徽勾一弦", [60])], "matched", None), ([("绰上", [48])], "skipped", "context_dependent_slide"), ([("散历七六弦", [62]), ("", [60])], "matched", None), ([("散历七六弦", [62]), ("", [59])], "mismatched", None),
        ([("散历七六弦", [62]), ("|", [], False, True), ("", [60])], "matched", None), ([("散历七六弦", [62]), ("", []), ("", [60])], "mismatched", "li_pitch_count_mismatch"), ([("散抹挑五弦", [57]), ("", [57])], "matched", None),
        ([("散抹挑五弦", [57]), ("散勾一弦", [57])], "matched", None), ([("泛起大指七徽勾三弦", [65]), ("九徽勾三弦", [60])], "matched", None),
    ]
    for (cells, status, verdict), rows in zip(cases, run(spark, *[c[0] for c in cases]), strict=True):
        assert (rows[0]["status"], rows[0]["verdict"]) == (status, verdict), (cells, rows[0])
    swept = run(spark, [("散历七六弦", [62]), ("|", [], False, True), ("", [60])], [("散抹挑五弦", [57]), ("", [57])])
    assert swept[0][0]["covered"] == [0, 2] and swept[1][0]["covered"] == [0, 1]
    held = run(spark, [("大指九徽勾三弦", [60]), ("绰上七徽", [65]), ("泛起大指七徽勾三弦", [65]), ("大指九徽勾三弦", [at(3, 9)])])[0]
    assert [(x["string"], x["hui"], x["mode"]) for x in held[1]["resolved"]] == [(3, 7.0, "stopped")]
    assert held[3]["status"] == "mismatched" and held[3]["stopped_would_match"] and not held[2]["stopped_would_match"]


def test_state_passes_borders_of_batches_and_not_of_scores(spark):
    r = random.Random(8)
    cells = ["大指九徽勾三弦", "名指十徽挑四弦", "勾一弦", "散挑七弦", "绰上七徽", "复", "退", "泛起中指七徽勾二弦", "泛止", "带起", "爪起", "", REST, "撮（大指九徽三弦按音＋五弦散音）", "名指十徽勾二弦绰上九徽", "挑六徽"]
    scores = [[r.choice(cells) for _ in range(r.randint(1, 120))] for _ in range(12)]
    frame = rows_of(spark, scores)
    names = ["score", "idx", "reason", "string", "hui", "finger", "manner", "scope", "origin_string", "sounds", "places"]
    read = fold.read(frame).orderBy("score", "idx").collect()
    want, hand, score = [], None, None
    for row in read:  # a plain fold over everything on the driver
        if row["score"] != score:
            hand, score = fold.Hand(), row["score"]
        found = fold.step(hand, [c.asDict(True) for c in row["cells"]], row["rest"])
        want.append((row["score"], row["idx"], *[found[k] for k in names[2:-2]], [tuple(x.values()) for x in found["sounds"]], {f: tuple(p.values()) for f, p in found["places"]}))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = fold.folded(frame.repartition(5)).select(*names).orderBy("score", "idx").collect()
            assert [(*x[:-2], [tuple(y) for y in x[-2]], {f: tuple(p) for f, p in x[-1].items()}) for x in got] == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_odd_inputs(spark):
    assert fold.audited(fold.sounded(fold.folded(spark.createDataFrame([], SCHEMA)))).count() == 0
    rows = spark.createDataFrame([(None, 0, None, None, None, None), (None, 1, "勾三弦" * 4000, False, False, [60.0]), (7, 0, "大指九徽勾三弦", False, False, [1.0])] * 2, SCHEMA)
    found = fold.audited(fold.sounded(fold.folded(rows.withColumn("t", F.lit("clash")).withColumn("pitch", F.lit(1)))))
    assert found.count() == 6 and found.where("score = 7 AND size(pitches) = 1").count() == 2
    named = spark.createDataFrame(fold.example("大指九徽勾三弦", None, "勾三弦"), SCHEMA)
    assert [x["hui"] for x in fold.folded(named).orderBy("idx").collect()] == [9.0, 9.0, 9.0]


@pytest.mark.parametrize("seeds", [False, True])
def test_phrases_after_their_history_are_as_the_whole_prefix_replayed(spark, seeds):
    """Against the plain way: for each phrase all reference rows before it are gone through again, with the synthetic rows that force or end a region."""
    r = random.Random(9)
    cells = ["大指九徽勾三弦", "名指十徽挑四弦", "勾一弦", "散挑七弦", "绰上七徽", "复", "退", "泛起中指七徽勾二弦", "泛止", "泛起五徽", "名指带起散挑七弦", "爪起", "", REST, "大指七徽勾二弦", "挑六徽"]
    zh, rows, want_rows = list(music.ZH_NUMBERS), [], []
    plain = []
    for k in range(10):
        own = [r.choice(cells) for _ in range(24)]
        tried = [c if isinstance(c, tuple) else r.choice([x for x in cells if not isinstance(x, tuple)]) for c in own]
        says = {p: r.choice([None, True, False]) for p in range(6)}
        for i, (a, b) in enumerate(zip(own, tried, strict=True)):
            rows.append((k, i, i // 4, b[0] if isinstance(b, tuple) else b, a[0] if isinstance(a, tuple) else a, isinstance(a, tuple), says[i // 4]))
        plain.append((own, tried, says))
    frame = spark.createDataFrame(rows, "score long, idx int, phrase int, text string, reference string, rest boolean, region boolean")
    names = ["reason", "string", "hui", "finger", "manner", "scope", "origin_string"]
    got = {(x["score"], x["idx"]): [*(x[n] for n in names), [tuple(y) for y in x["sounds"]]] for x in fold.after_history(frame, seeds).collect()}
    alone = fold.folded(rows_of(spark, [x[0] for x in plain])).orderBy("score", "idx").collect()
    harmonics = {k: [] for k in range(10)}
    for x in alone:
        harmonics[x["score"]].append(next((y["hui"] for y in reversed(x["sounds"]) if y["mode"] == "harmonic"), None))
    keys = []
    for k, (own, tried, says) in enumerate(plain):
        for p in range(6):
            history, marked, touched = own[: p * 4], False, None
            for c, h in zip(history, harmonics[k], strict=False):
                last = [m for m in ("泛起", "泛止") if not isinstance(c, tuple) and m in c]
                marked = False if isinstance(c, tuple) else last[-1] == "泛起" if last else marked
                touched = h if h is not None else touched
            allowed = marked if says[p] is None else says[p]
            before = [f"泛起勾1弦{zh[int(touched) - 1]}徽"] if seeds and allowed and touched is not None else []
            after = ["泛止"] if seeds and history and not allowed else []
            want_rows.append([*before, *history, *after, *tried[p * 4 : p * 4 + 4]])
            keys.append((k, p))
    found = {}
    for x in fold.folded(rows_of(spark, want_rows)).collect():
        found.setdefault(x["score"], []).append((x["idx"], [*(x[n] for n in names), [tuple(y) for y in x["sounds"]]]))
    for n, (k, p) in enumerate(keys):
        last = [x for _, x in sorted(found[n])][-4:]
        assert [got[(k, p * 4 + i)] for i in range(4)] == last, (k, p, want_rows[n])


def test_the_facts_of_common_texts_are_found_once_and_others_in_their_rows(spark, monkeypatch):
    frame = rows_of(spark, [["大指九徽勾三弦", "散挑七弦", "爪起", "复", "名指十徽勾一弦", "泛起中指七徽勾二弦", "挑一弦", "泛止"], ["大指九徽勾三弦", "大指九徽勾三弦", "退", "复"]])
    names = ["score", "idx", "sounds", "reason", "string", "hui", "finger", "manner", "places"]
    whole = fold.folded(frame).select(*names).orderBy("score", "idx").collect()
    monkeypatch.setattr(fold, "VOCABULARY", 2)
    rows, facts = fold._spoken(frame.withColumn("t", F.trim(F.coalesce("text", F.lit("")))), {"t": "own"})
    assert set(facts.value) == {"大指九徽勾三弦", "复"}
    assert {x["t"] for x in rows.where("own IS NULL").collect()} == set(facts.value)
    assert fold.folded(frame).select(*names).orderBy("score", "idx").collect() == whole


def test_a_string_set_free_is_not_the_contact_that_sounds_alike(spark):
    *_, last = run(spark, ["中指七徽勾六弦", "泛起名指七徽勾二弦", "撮（大指七徽一弦按音＋三弦散音）", "名指九徽勾四弦", "散挑三弦", "带起", ("带起", [60])])[0]
    assert (last["freed"], last["string"], last["hui"], last["status"]) == (6, 1, 7.0, "matched")
    assert last["resolved"] == []


def test_references_beside_predictions_audit_as_alone(spark):
    r = random.Random(4)
    cells = ["大指九徽勾三弦", "散历七六弦", "散抹挑五弦", "", "绰勾一弦", "绰上七徽", "泛起中指七徽勾二弦", "泛止", "散挑五弦应合", "爪起", "带起", "拂一至六弦", "散历三至五弦", "勾一弦", None]
    rows = [(k, i, i // 5, r.choice(cells), r.choice(cells), i % 7 == 6, i % 9 == 8, [] if i % 6 == 5 else [r.choice([48.0, 50.0, 57.0, 60.0, 62.0])]) for k in range(6) for i in range(40)]
    frame = spark.createDataFrame(rows, "score int, idx int, phrase int, text string, reference string, structural boolean, rest boolean, targets array<double>")
    keys, names = ("score", "phrase"), ["score", "idx", "reason", "status", "verdict", "error", "covered", "sounds", "pitches"]
    shown = lambda df: sorted(map(repr, df.select(*names).collect()))
    plain = frame.select("score", "idx", "phrase", F.col("reference").alias("text"), "structural", "rest", "targets")
    want = shown(fold.audited(fold.sounded(fold.folded(plain)), keys=keys))
    tried = fold.after_history(fold.ahead(fold.ahead(frame, keys, "reference", "__own_"), keys), False, ("attacks", "stopped_sounds", "places"))
    assert shown(fold.audited(fold.sounded(fold.own_rows(tried, ["phrase"])), keys=keys)) == want
    assert shown(fold.audited(fold.sounded(tried), keys=keys)) == shown(fold.audited(fold.sounded(fold.after_history(frame)), keys=keys))


def test_replays_deal_rows_once_and_go_through_a_reference_once(spark):
    from lutework.plans import replays

    for query, exchanges in ((replays.f11_causal_replay, 1), (replays.f10_history_audit, 1), (replays.f11_phrase_report, 2)):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == exchanges and plan.count("Exchange") == exchanges and plan.count("MapInArrow") == 1
