"""Tunes against a plain reading token by token."""

import random
import re
from fractions import Fraction

from pyspark.sql import functions as F

from lutework.sources import tunes

SIGNATURES = {"C": "", "G": "F#", "D": "F#C#", "F": "Bb", "Eb": "BbEbAb", "Am": "", "Em": "F#", "Gm": "BbEb", "C#": "F#C#G#D#A#E#B#"}


def plain(text, phrase_bars=8):
    """Events by a loop over tokens, with its own state."""
    head, body, mark, started = {}, [], None, False
    for line in (x.strip() for x in text.split("\n")):
        if not line:
            continue
        if m := re.match(r"^%+\s*<([^>]+)>\s*$", line):
            mark = m[1].strip()
        elif not started and re.match("^[A-Za-z]:", line):
            head[line[0].upper()] = line[2:].strip()
            started = line[0].upper() == "K"
        elif not line.startswith("%"):
            started = True
            body.append((line, mark))
            mark = None
    signature = {x[0]: 1 if x[1] == "#" else -1 for x in re.findall("[A-G][#b]", SIGNATURES[head.get("K", "C")])}
    unit, now, bar, start, held, open_, events, sections, time_since = Fraction(head.get("L", "1/8")), Fraction(0), 1, Fraction(0), {}, None, [], 0, 0
    current = None
    for line, mark in body:
        for t in re.findall(r"[|:][|:\[\]1-9]*|-|\{[^}]*\}|\[[A-Za-z]:[^\]]*\]|\[[^\]]*\][0-9/]*-?|[\^_]*=?[A-Ga-gz][',]*[0-9/]*-?|%.*", line):
            if t[0] == "%":
                break
            own, mark = mark, None
            if t[0] in "|:":
                held = {}
                if now > start:
                    bar, start = bar + 1, now
                continue
            if t == "-":
                open_ = len(events) - 1 if events and events[-1]["midis"] else open_
                continue
            if t[0] == "{" or re.match(r"\[[A-Za-z]:", t):
                continue
            m = re.search(r"(\d*)(/?)(\d*)-?$", t)
            length = unit * (int(m[1]) if m[1] else 1) / ((int(m[3]) if m[3] else 2) if m[2] else 1)
            midis = set()
            for sign, letter, marks in re.findall(r"([\^_]*=?)([A-Ga-g])([',]*)", t):
                octave = (5 if letter.islower() else 4) + marks.count("'") - marks.count(",")
                k = (letter.upper(), octave)
                if sign:
                    held[k] = 0 if sign[-1] == "=" else len(sign) if sign[0] == "^" else -len(sign)
                midis.add(12 * (octave + 1) + {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}[k[0]] + held.get(k, signature.get(k[0], 0)))
            if own is not None or not sections:
                sections, current = sections + 1, own or "一"
            ticks = round(float(length * 4) * 960)
            if open_ is not None and midis:
                if events[open_]["midis"] == sorted(midis):
                    events[open_]["duration"] += ticks
                    events[open_]["n_tied"] += 1
                    open_ = open_ if t.endswith("-") else None
                    now += length * 4
                    continue
                open_ = None
            events.append({"midis": sorted(midis), "onset": round(float(now) * 960), "duration": ticks, "bar": bar, "beat": float(now - start) + 1, "section": sections, "mark": current, "n_tied": 1, "kind": "rest" if not midis else "chord" if t[0] == "[" else "note"})
            if t.endswith("-") and midis:
                open_ = len(events) - 1
            now += length * 4
    phrase, first, before = 0, None, None
    for e in events:
        if first is None or before["section"] != e["section"] or e["bar"] - first >= phrase_bars or before["kind"] == "rest" and before["duration"] >= 960:
            phrase, first = phrase + 1, e["bar"]
        e["phrase"], before = phrase, e
    return events


def test_tunes_by_a_plain_reading(spark):
    r = random.Random(4)
    texts = []
    for _ in range(60):
        lines = [f"T: {r.random()}", f"M: {r.choice(['4/4', 'C', '6/8'])}", f"L: {r.choice(['1/8', '1/4', '1/16'])}", f"K: {r.choice(list(SIGNATURES))}"]
        for _ in range(r.randint(0, 8)):
            if r.random() < 0.25:
                lines.append(f"%% <{r.choice('一二三')} 段>")
            if r.random() < 0.1:
                lines += ["% a comment", ""]
            note = lambda: r.choice(["", "", "", "^", "_", "=", "^^"]) + r.choice("CDEFGABcdefgab") + r.choice(["", "", ",", "'"])
            token = lambda: r.choice([note, note, note, note, lambda: "z", lambda: f"[{note()}{note()}]", lambda: f"[{note()} {note()}{note()}]"])() + r.choice(["", "2", "/", "3/2", "/4", "4"]) + r.choice(["", "", "", "-"])
            line = " ".join(r.choice([token, token, token, token, token, lambda: r.choice(["|", "||", ":|", "|:", "|1", "||"]), lambda: "-", lambda: "{abc}", lambda: "[M:3/4]", lambda: "(C)", lambda: token().rstrip("-") + "- "])() for _ in range(r.randint(1, 25)))
            if r.random() < 0.3:  # a note and the same again, tied
                n = note()
                line += f" {n}2-{n} {n} - {n}2-|{n}"
            lines.append(line + r.choice(["", "", " % the end"]))
        texts.append("\n".join(lines))
    texts += ["", "C D E", "K:C\nC2- z C | C", "L:1/4\nK:G\n%<尾>\n|: F2 z4 F :|"]
    frame = spark.createDataFrame(list(enumerate(texts)), "tune int, text string").withColumn("kind", F.lit("clash")).withColumn("i", F.lit(1))
    got = {}
    for x in tunes.events(tunes.headers(frame, "tune", "text"), "tune").orderBy("tune", "n").collect():
        assert x["error"] is None, (x, texts[x["tune"]])
        got.setdefault(x["tune"], []).append({k: x[k] for k in ("midis", "onset", "duration", "bar", "beat", "section", "mark", "n_tied", "kind", "phrase")})
    for i, text in enumerate(texts):
        assert got.get(i, []) == plain(text), text


def test_tunes_that_cannot_be_read(spark):
    rows = [(1, "K:H\nC"), (2, "M:x\nK:C\nC"), (3, "L:0/0\nK:C\nC"), (4, "K:C\nC D (3CDE | ?"), (5, None), (6, "T:Name\nQ:1/4=96\nL:1/16\nK:Bb\nB")]
    read = tunes.headers(spark.createDataFrame(rows, "tune int, text string"), "tune", "text")
    got = {x["tune"]: x["error"] for x in tunes.events(read, "tune").collect()}
    assert got == {1: "unsupported key", 2: "unsupported meter", 3: "invalid unit", 4: "unsupported token 3", 6: None}
    six = read.where("tune = 6").first()
    assert six["fields"]["T"] == "Name" and six["tempo"] == 96 and six["sharps"] == -2
    assert tunes.events(read.limit(0), "tune").count() == 0


def test_tunes_are_dealt_by_the_length_of_their_texts(spark, monkeypatch):
    monkeypatch.setattr(tunes, "TASK_BYTES", 2000, raising=False)
    frame = spark.range(60).select(F.col("id").alias("tune"), F.lit("K:C\n" + "C D E F | " * 40).alias("text"))
    found = tunes.events(tunes.headers(frame, "tune", "text"), "tune")
    rows = [x["count"] for x in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(rows) == 60 * 160
    assert max(rows) < 60 * 160 / 4  # of 24,000 bytes; four tasks would hold as many as that
