"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions throughout.

Two lines are near copies if their words (lower case) are equal, or if both have LEAST_WORDS words or more and one word was replaced,
added or taken away: the edit bound is one word, and none for shorter lines, of which a word is too large a part. A line goes if any earlier line, by (doc_id, line number), is a near copy of it.

Each distinct line emits its variants, the line with one word taken out, as hashes. Lines whose variants are equal with the word
taken from the same place differ by a replaced word; a line equal to another's variant lacks one of its words. Both are found by aggregating
the variants by their hash, earliest line first, so that a variant of very many lines makes one row and not pairs of lines. Before
that, lines that can't have a partner are put aside: within one edit one half of the shorter line's words must stand at the beginning
or at the end of both, so lines that share no such half with another line emit nothing. The partner found is verified word by word.

Defined results: lines without words are no lines; a null text has none; rows with equal ids are one document's, each occurrence a line
of its own, and of lines with equal (doc_id, line number) one counts as the earliest; null ids come first; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACES, hinted, row_of, sized_join, spread_join, written

LEAST_WORDS = 5


def _lines(docs: DataFrame) -> DataFrame:
    """Of docs (doc_id, text): doc_id, line_no from 0, the line in lower case without outer space, and its words."""
    split = docs.select("doc_id", F.posexplode_outer(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).alias("line_no", "line"))
    bare = F.btrim(F.lower(F.col("line")), F.lit(SPACE))
    return split.withColumn("line", bare).where("line <> ''").withColumn("w", F.split("line", SPACES))


def _halves() -> Column:
    """Keys of the halves of w at which a partner within one edit must agree with it: of the first and the last (n - 1) / 2 and n / 2 words,
    rounded up."""
    n = F.size("w")
    keys = []
    for k in (F.ceil((n - 1) / 2).cast("int"), F.ceil(n / 2).cast("int")):
        keys += [F.xxhash64(F.lit(0), k, F.slice("w", F.lit(1), k)), F.xxhash64(F.lit(1), k, F.slice("w", n - k + 1, k))]
    return F.when(n >= LEAST_WORDS - 1, F.array_distinct(F.array(*keys)))


def _variants(w: str) -> Column:
    """Of a column of word arrays: whole, the hash of all the words, and variants, for each place the hash of the words but the one there. A
    hash is the exclusive or of the hashes of the words with their places, so that one pass makes all of them: left of the word
    taken out the words keep their places, right of it they move up by one."""
    words = F.transform(w, lambda x, i: F.struct(F.xxhash64(x, i).alias("here"), F.xxhash64(x, i - 1).alias("moved")))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("left"), zero.alias("moved"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        moved = s["moved"].bitwiseXOR(x["moved"])
        return F.struct(s["left"].bitwiseXOR(x["here"]).alias("left"), moved.alias("moved"), F.concat(s["out"], F.array(s["left"].bitwiseXOR(moved))).alias("out"))

    def finish(s: Column) -> Column:
        return F.struct(s["left"].alias("whole"), F.transform(s["out"], lambda v: v.bitwiseXOR(s["moved"])).alias("variants"))

    return F.aggregate(words, start, step, finish)


def near_copy(a: Column, b: Column) -> Column:
    """Whether the word arrays a and b are within one edit."""
    n, m = F.size(a), F.size(b)
    short = F.least(n, m)
    same = lambda x, y: F.zip_with(x, y, lambda p, q: p == q)
    head = F.coalesce(F.array_position(same(F.slice(a, F.lit(1), short), F.slice(b, F.lit(1), short)), False), F.lit(0))
    head = F.when(head == 0, short).otherwise(head - 1)
    tail = F.array_position(same(F.slice(F.reverse(a), F.lit(1), short), F.slice(F.reverse(b), F.lit(1), short)), False)
    tail = F.when(tail == 0, short).otherwise(tail - 1)
    return (F.abs(n - m) <= 1) & (head + tail >= F.greatest(n, m) - 1)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """One row per line that goes: doc_id, line_no, kept_doc_id and kept_line_no of the earliest line of which it is a near copy, and
    edits, 0 or 1 between them."""
    lines = _lines(docs)
    named = lines.select("doc_id", "line_no", F.xxhash64("w").alias("h"), F.hash("w").alias("g"), _halves().alias("halves"))
    occurring = written(named, "line-occurrences")
    # a distinct line, its name two hashes of 96 bits together, is known by its first occurrence
    place = F.struct("doc_id", "line_no")
    each = occurring.groupBy("h", "g").agg(F.min(place).alias("first"), F.first("halves").alias("halves"), F.count("*").alias("n"))
    distinct = written(each, "line-distinct")
    keys = distinct.select("first", F.explode_outer("halves").alias("key")).where("key IS NOT NULL")
    shared = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "line-halves")
    near = written(spread_join(keys, shared, ["key"], "n").select("first").distinct(), "line-candidates")
    # the candidates' words, from their first occurrence
    wanted = near.select(F.col("first.doc_id").alias("d"), F.col("first.line_no").alias("l")).distinct()
    wanted = hinted(wanted, 48)
    at = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("line_no") == F.col("l"))
    texts = lines.drop("w").join(wanted, at, "left_semi").withColumn("w", F.split("line", SPACES))
    texts = written(texts.select(place.alias("first"), "line", F.xxhash64("w").alias("name")), "line-texts").dropDuplicates(["first", "name"])
    texts = texts.withColumn("w", F.split("line", SPACES)).where(F.size("w") >= LEAST_WORDS)
    # every variant: the line with the word at place i taken out, by a hash without and one with the place
    hashed = written(texts.select("first", _variants("w").alias("x")).select("first", "x.*"), "line-hashes")
    each = F.transform("variants", lambda v, i: F.struct(v.alias("v"), F.xxhash64(i, v).alias("vi")))
    variants = hashed.select("first", F.explode_outer(each).alias("x")).select("first", "x.*")
    replaced = written(variants.groupBy("vi").agg(F.min("first").alias("m"), F.count("*").alias("n")).where("n > 1"), "line-replaced")
    by_replacing = sized_join(variants.select("vi", "first"), replaced, ["vi"], "n", 96).select("first", "m")
    # each variant is one distinct line at most; of the lines that are longer by a word, the earliest is the shorter one's
    whole = hashed.select(F.col("whole").alias("v"), F.col("first").alias("shorter"))
    longer = variants.groupBy("v").agg(F.min("first").alias("m"), F.count("*").alias("n"))
    lacking = written(whole.join(longer, "v"), "line-lacking")
    by_lacking = lacking.select(F.col("shorter").alias("first"), "m")
    by_adding = sized_join(variants.select("v", "first"), lacking.select("v", "shorter", "n"), ["v"], "n", 96).select("first", F.col("shorter").alias("m"))
    best = by_replacing.unionByName(by_lacking).unionByName(by_adding).groupBy("first").agg(F.min("m").alias("m"))
    # the partner's words verify the edit
    found = best.where("m < first").join(texts.select("first", "w"), "first")
    partner = texts.select(F.col("first").alias("m"), F.col("w").alias("w2"))
    sure = written(found.join(partner, "m").where(near_copy(F.col("w"), F.col("w2"))).select("first", "m").groupBy("first").agg(F.min("m").alias("m")), "line-near")
    of_line = distinct.select("h", "g", "n", "first").join(sure, "first", "left").select(
        "h", "g", "n", "first", F.coalesce("m", "first").alias("kept"), F.col("m").isNotNull().cast("int").alias("edits")
    )
    # a line that comes once and has no near copy before it stays
    of_line = written(of_line.where("n > 1 OR edits = 1"), "line-verdicts")
    gone = spread_join(occurring.select("doc_id", "line_no", "h", "g"), of_line, ["h", "g"], "n")
    gone = gone.where((F.col("edits") == 1) | ~F.struct("doc_id", "line_no").eqNullSafe(F.col("first")))
    return gone.select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"),
        F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").cast("long").alias("kept_line_no"), F.col("edits").cast("long").alias("edits"),
    )


def without_repeated(docs: DataFrame) -> DataFrame:
    """docs with the lines that go taken out of their texts; other columns pass."""
    gone = repeated_lines(docs).groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    rows = docs.select(row_of(docs))
    joined = rows.join(gone, F.col("row.doc_id").eqNullSafe(gone["doc_id"]), "left")
    lines = F.split("row.text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1).cast("array<bigint>"), "gone")
    kept = F.transform(stay, lambda i: F.get(lines, i.cast("int")))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


ORACLE_SQL = r"""
WITH o AS (SELECT doc_id, unnest(range(len(lines))) AS line_no, unnest(lines) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
occ AS (SELECT doc_id, line_no, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS w FROM o WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
named AS (SELECT doc_id, line_no, array_to_string(w, ' ') AS s, w FROM occ),
lines AS (SELECT s, any_value(w) AS w, min({'d': doc_id, 'l': line_no}) AS f FROM named GROUP BY s),
v AS (SELECT s, f, i, array_to_string(w[1 : i] || w[i + 2 :], ' ') AS v FROM (SELECT *, unnest(range(len(w))) AS i FROM lines WHERE len(w) >= 5)),
m AS (SELECT s, min(f) OVER (PARTITION BY v, i) AS m FROM v
      UNION ALL SELECT v.s, l.f FROM v JOIN lines l ON l.s = v.v WHERE len(l.w) >= 5
      UNION ALL SELECT l.s, v.f FROM v JOIN lines l ON l.s = v.v WHERE len(l.w) >= 5),
best AS (SELECT s, min(m) AS m FROM m GROUP BY s),
near AS (SELECT lines.s, f, CASE WHEN best.m < f THEN best.m ELSE f END AS kept, coalesce(best.m < f, false)::BIGINT AS edits FROM lines LEFT JOIN best USING (s))
SELECT doc_id, line_no::BIGINT AS line_no, kept.d AS kept_doc_id, kept.l::BIGINT AS kept_line_no, edits
FROM named JOIN near USING (s) WHERE edits = 1 OR doc_id <> f.d OR line_no <> f.l
"""
