"""Work that must follow the input, and its results beside plain Python."""

import random

import pytest

from pyspark.sql import functions as F

from lutework.operators import ordered, ranking, repeats, replay


def shuffled(spark, work):
    """How many records the stages of work() shuffle, and what it returns."""
    gateway, context = spark.sparkContext._gateway, spark.sparkContext._jsc.sc()

    def by_stage():
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None).iterator()
        out = {}
        while stages.hasNext():
            s = stages.next()
            out[s.stageId(), s.attemptId()] = s.shuffleWriteRecords()
        return out

    before = by_stage()
    found = work()
    return sum(n for s, n in by_stage().items() if s not in before), found


def above(edges):
    """Every pair of a node and one above it, by walking."""
    ups = {}
    for node, up in edges:
        ups.setdefault(node, []).append(up)
    out = set()
    for node in ups:
        todo = [*ups[node]]
        while todo:
            if (node, u := todo.pop()) not in out:
                out.add((node, u))
                todo += ups.get(u, [])
    return out


@pytest.mark.parametrize("edges", [[(i, i - 1) for i in range(2, 60)], [(1, 2), (2, 3), (3, 1), (4, 1), (4, 5)], [(1, 1)], []])
def test_lineage_beside_walks(spark, edges):
    assert {tuple(r) for r in ordered.lineage(spark.createDataFrame(edges, "node long, up long")).collect()} == above(edges)
    rng = random.Random(5)
    more = [(i, rng.randrange(i)) for i in range(1, 40) for _ in range(2)]
    assert {tuple(r) for r in ordered.lineage(spark.createDataFrame(more, "node long, up long")).collect()} == above(more)


def test_lineage_of_many_parents_does_not_join_every_cut_of_a_path(spark):
    edges = [(n, n // k) for n in range(2, 4000) for k in (2, 3) if n // k]
    frame = spark.createDataFrame(edges, "node long, up long").distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # what is joined is shuffled
    try:
        n, found = shuffled(spark, lambda: ordered.lineage(frame).count())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == len(above(edges))
    assert n < 8 * found


def test_repeats_broadcast_no_rows_of_the_scores(spark):
    said = F.get(F.array(*[F.lit(x) for x in ("勾三弦", "", "从头再作", "", "从1再作", "再作标记ㄱ", "从ㄱ再作", "")]), (F.col("id") % 8).cast("int"))
    columns = {"score": F.col("id") % 3, "idx": F.floor(F.col("id") / 3), "text": said, "midi": F.when(F.col("id") % 5 > 0, 60 + F.col("id") % 2), "structural": F.col("id") % 11 == 0, "section": F.floor(F.col("id") / 90)}
    rows = spark.range(900).withColumns(columns).drop("id")
    rows = ordered.event_ordinals(rows, ["score"], ["idx"], F.col("structural"))
    plan = repeats.repeat_warnings(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert "Broadcast" not in plan


def test_replay_reads_rare_cells_like_common_ones(spark, monkeypatch):
    cells = ["大指九徽勾三弦", "散挑七弦", "", "绰上七徽六分", "复", "泛起中指七徽勾二弦", "泛止", "撮（三弦＋三弦）", "历七六五弦", "爪起", "带起勾三弦", "勾九弦", "撮（散音一弦＋按音大指九徽三弦）", "散猱", "拨一四弦"]
    text = F.get(F.array(*[F.lit(c) for c in cells]), ((F.col("id") * 7 + F.floor(F.col("id") / 40)) % len(cells)).cast("int"))
    columns = {"score": F.col("id") % 5, "idx": F.floor(F.col("id") / 5).cast("int"), "text": text, "structural": F.col("id") % 13 == 0, "rest": F.col("id") % 17 == 0, "targets": F.array(F.lit(60.0))}
    notes = spark.range(300).withColumns(columns).drop("id")
    read = lambda: sorted(map(repr, replay.warnings(replay.audited(replay.replayed(notes))).collect()))
    common = read()
    monkeypatch.setattr(replay, "VOCABULARY", 2)
    assert read() == common and common


def test_ranker_fits_rows_alike_as_one(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression

    fitted, fit = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, df, *a: fitted.append(df.count()) or fit(self, df, *a))
    k = F.col("id") % 3
    columns = {"family": F.col("id") % 25, "k": k, "label": (k == 1).cast("double"), "features": F.array((F.abs(k - 1) + F.col("id") % 2).cast("double"), (F.col("id") % 5).cast("double")), "id": F.floor(F.col("id") / 3)}
    found = ranking.folded_ranks(spark.range(3000).withColumns(columns), 2).collect()
    assert len(found) == 1000
    assert len(fitted) == 2 and max(fitted) <= 40


def test_a_baseline_shuffles_no_candidates(spark):
    from lutework.functions import music
    from lutework.operators import routes

    pitch = F.when(F.col("id") % 97 == 5, 12.0).when(F.col("id") % 31 == 0, None).otherwise(48.0 + F.col("id") * 7 % 24)
    columns = {"score": F.floor(F.col("id") / 40), "phrase": F.floor(F.col("id") / 5) % 8, "idx": (F.col("id") % 40).cast("int"), "ticks": F.when(F.col("id") % 3 > 0, 60 * (F.col("id") % 11)), "pitches": F.when(F.col("id") % 13 > 0, F.array(pitch, F.lit(20.0)))}
    notes = spark.range(4000).withColumns(columns).drop("id").repartition(4).localCheckpoint()
    n, got = shuffled(spark, lambda: routes.baseline(notes, music.STANDARD_TUNING, ["score", "phrase"]).collect())
    grid = routes.position_grid(spark, music.STANDARD_TUNING, ("stopped",)).selectExpr("*", "explode(sequence(0, 100)) AS t").where("abs(midi - t) <= 0.5")
    cost = F.round(F.abs((F.col("midi") - F.col("t")) * 100), 3)
    found = grid.withColumn("region", music.tone_region_cost(F.col("hui"), F.col("mode"))).select("t", "string", "hui", "label", cost.alias("cents"), "region", F.coalesce(music.stud_fraction(F.col("hui")), F.lit(0.0)).alias("place")).collect()
    options = {}
    for x in sorted(found, key=lambda x: (x["cents"], x["region"], x["string"], x["hui"] or 0.0, x["label"] or "")):
        options.setdefault(x["t"], []).append(x)
    phrases, want = {}, []
    for x in notes.collect():
        if x["pitches"]:
            phrases.setdefault((x["score"], x["phrase"]), []).append((x["idx"], 960 if x["ticks"] is None else x["ticks"], max(p for p in x["pitches"] if p is not None)))
    for key, own in phrases.items():
        own.sort()
        before = [960, *(t for _, t, _ in own)]
        steps = [(max(b / 960, 0.125), [(i + 1, o["string"], o["hui"], o["place"], abs(o["cents"]) * 0.03 + o["region"]) for i, o in enumerate(options.get(int(p), [])[:14])]) for (_, _, p), b in zip(own, before, strict=False)]
        best = routes.k_best_directed(steps, 1)
        for i, (idx, _, p) in enumerate(own):
            o = options[int(p)][best[0][3][i] - 1] if best else None
            want.append((*key, idx, *((o["string"], o["hui"], o["label"], round(best[0][0], 6)) if best else [None] * 4), int(p) not in options))
    assert sorted(((x["score"], x["phrase"], x["idx"], x["string"], x["hui"], x["label"], x["cost"] and round(x["cost"], 6), x["missing"]) for x in got), key=repr) == sorted(want, key=repr)
    assert any(x[-1] for x in want) and n < 4000
