"""Scores written as text and read back."""

import json

from pyspark.sql import functions as F

from lutework.sources import score_text

NOTES = f"score string, pos int, index int, structural boolean, structure_token string, section {score_text.SECTION}, " + ", ".join(f"{x} string" for x in score_text.FIELDS)
SECTION = (1, "一", "开指", None, True)


def sound(score, pos, index, *fields, section=None):
    return (score, pos, index, False, None, section, *fields)


ROWS = [
    sound("a/b c", 0, 10, "5̣", None, "G,", "四分", "", "大指九徽勾三弦", None, section=SECTION),
    ("a/b c", 1, 11, True, None, SECTION, "|", None, "|", "小节线", "", "", None),
    sound("a/b c", 2, 12, 'q"\\\n\t <x>', "", "[CE]", "八分", "词", "", "", section=SECTION),
    ("a/b c", 3, 13, True, "||", None, "|", None, "||", "小节线", "", "", "x"),
    sound("a/b c", 4, 14, None, None, None, None, None, None, None),
    sound("sparse", 0, 3, *"abcdefg", section=(2, "二", "", "<二 尾声>", False)),
    sound("sparse", 1, 7, *"abcdefg", section=(2, "二", "", "<二 尾声>", False)),
    ("sparse", 2, 8, True, None, None, "|", None, "|", "小节线", "", "", None),
    sound("sparse", 5, 20, *"hijklmn", section=(2, "二", "", "<二 尾声>", False)),
    sound("none+%", 0, None, *"abcdefg"),
]
HEADS = [("a/b c", "名\n字", '{"score_title": "x", "n": [1, null]}'), ("sparse", None, "{}"), ("none+%", "", None), ("empty", "空", '{"a":1}')]


def order(x):
    return (x["score"], x["pos"])


def test_round_trip(spark, tmp_path):
    notes = spark.createDataFrame(ROWS, NOTES).withColumn("line", F.lit("clash")).withColumn("n", F.lit(0)).withColumn("bar", F.lit(1))
    heads = spark.createDataFrame(HEADS, "score string, title string, metadata string")
    made = score_text.texts(notes, heads)
    score_text.write(made.repartition(3), f"{tmp_path}/scores")
    read = score_text.read(spark, f"{tmp_path}/scores")
    assert {tuple(x) for x in read.collect()} == {tuple(x) for x in made.collect()}
    got = sorted(score_text.rows_of(read).collect(), key=order)
    want, last, n = [], None, 0
    for x in sorted(ROWS, key=lambda x: x[:2]):  # positions are counted without gaps
        last, n = x[0], n + 1 if x[0] == last else 0
        want.append((x[0], n, *x[2:]))
    assert [tuple(tuple(v) if isinstance(v, tuple) else v for v in x) for x in got] == want
    assert {x["score"]: x["metadata"] and json.loads(x["metadata"]) for x in score_text.metadata_of(read).collect()} == {"a/b c": {"score_title": "x", "n": [1, None]}, "sparse": {}, "none+%": {}, "empty": {"a": 1}}
    assert score_text.texts(notes.limit(0), heads.limit(0)).count() == 0


def test_text_of_a_score(spark):
    notes, heads = spark.createDataFrame(ROWS[:5], NOTES), spark.createDataFrame(HEADS[:1], "score string, title string, metadata string")
    lines = score_text.texts(notes, heads).first()["text"].split("\n")
    assert lines[:3] == ["GQS｜teacher-gqs-1.2", "谱名｜名 字", '元数据｜{"score_title": "x", "n": [1, null]}']
    mapped = json.loads(lines[3].removeprefix("索引映射｜"))
    assert mapped["线"] == [11, 13] and mapped["音起点"] == 10 and mapped["节段"] == [[0, 3, 0], [3, 5, 1]] and mapped["节定义"] == [{"number": 1, "label": "一", "title": "开指", "marker": None, "start": True}, None] and len(mapped["线字段"]) == 2
    assert lines[4:8] == ["", "<一 开指>", "序号｜简谱｜ABC｜时值｜减字", '音｜[0,"5̣",null,"G,","四分","","大指九徽勾三弦",null]'] and lines[8] == "小节线" and lines[10].startswith("结构｜") and lines[11] == "音｜[2,null,null,null,null,null,null,null]"


def test_older_text(spark):
    rows = [[4, "1", None, "C", "四分", "", "勾三弦", None, {"number": 1, "label": "一", "title": "", "marker": None, "start": True}], [5, "|", None, "|", "小节线", "", "", None, None]]
    text = "\n".join(["GQS｜teacher-gqs-1.1", "元数据｜{}", "列｜index｜jianpu｜jianpu_alt｜abc｜duration｜lyric｜jianzi｜jianzi_text｜section", *(f"音｜{json.dumps(x, ensure_ascii=False)}" for x in rows)])
    got = score_text.rows_of(spark.createDataFrame([("s", text), ("t", "GQS｜unknown\n音｜[1]"), ("u", ""), ("v", None)], "score string, text string")).orderBy("pos").collect()
    assert [(x["index"], x["structural"], x["jianpu"], x["section"] and x["section"]["label"]) for x in got] == [(4, False, "1", "一"), (5, True, "|", None)]


def test_lines_are_read_within_their_text_and_carry_no_map(spark):
    plan = score_text.rows_of(spark.createDataFrame([("a", "")], "score string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
