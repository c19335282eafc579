"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions throughout.

Fixed masks slide over the words of documents and benchmark items and hash the words at their marked places only, so that a replaced word
at an unmarked place leaves the hash as it is. Equal hashes are hits; around each hit item and document are laid on one another word
by word, and the longest stretch is sought in which at least four of five words agree: up to each point of it PENALTY matches outweigh a mismatch.

The masks miss nothing. A stretch begins with four matches at least where it has a mismatch, and its second mismatch has eight matches before it: of its
first nine places one at most differs, not among the first four. If that is the fifth, sixth or seventh place, or none, the first mask fits at the
stretch's beginning; if it is the eighth or ninth, or none of the first seven, the second one does. Items of five to eight words are sought by
four words in a row, shorter ones by all their words.

A bitmap over the benchmark's hashes, sized by their number up to a bound, lets nearly all of a document's places go before any row is made
of them. Hits are joined to the benchmark's hashes, made distinct by document, item and offset, and only then verified.

Defined results: words are runs of letters and digits (ASCII) or other characters, in lower case; null or empty texts have none and leak
nothing, and are in no text; rows with equal ids are one document or item, each row's text being looked at; null ids are ids like others; empty
tables give empty results; other columns are ignored or passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fenced, hinted, spread_join, within, written

#: Marked places of each mask, and the fewest and the most words of the items that it serves.
MASKS = (
    ((0, 1, 2, 3, 7, 8), 9, None),
    ((0, 1, 2, 4, 5, 6), 9, None),
    ((0, 1, 2, 3), 4, 8),
    ((0, 1, 2), 3, 3),
    ((0, 1), 2, 2),
    ((0,), 1, 1),
)
#: Words that must agree in a stretch, or four fifths of an item that is shorter.
LEAST, SHARE, PENALTY = 13, 0.8, 4
#: Longs of the bitmap: a power of two that has BITS bits for each hash, within these bounds.
BITS, LEAST_LONGS, MOST_LONGS = 16, 1 << 12, 1 << 18
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_hashes(text: Column) -> Column:
    """The xxHash64 of every word of a text, in order."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"^{APART}|{APART}$", "")
    found = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, APART))
    return F.transform(found, lambda w: F.xxhash64(w))


def _at(hashes: Column, i: Column, mask: tuple[int, ...]) -> Column:
    return F.xxhash64(*[F.get(hashes, i + k) for k in mask])


def _starts(hashes: Column, mask: tuple[int, ...]) -> Column:
    """The places, from 0, at which the mask fits."""
    last = F.size(hashes) - (mask[-1] + 1)
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def seeds(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items (item_id, k, item), item being the hashes of the words and k the hash of the text, and of every item and place at which a mask
    fits: mask, h, item_id, k, at."""
    items = benchmark.select("item_id", F.xxhash64("text").alias("k"), word_hashes(F.col("text")).alias("item")).where(F.size("item") > 0)
    items = written(items.dropDuplicates(["item_id", "k"]), "decontam-items")
    parts = None
    for number, (mask, least, most) in enumerate(MASKS):
        served = items.where(F.size("item").between(least, most) if most else F.size("item") >= least)
        part = served.select("item_id", "k", "item", F.explode(_starts(F.col("item"), mask)).alias("at")).select(
            F.lit(number).alias("mask"), _at(F.col("item"), F.col("at"), mask).alias("h"), "item_id", "k", "at"
        )
        parts = part if parts is None else parts.unionByName(part)
    return items, written(parts, "decontam-seeds")


def _bitmap(found: DataFrame, longs: int) -> list[int]:
    """longs longs, a bit for every hash modulo their number of bits."""
    word = F.shiftright("h", 6).bitwiseAND(F.lit(longs - 1)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    rows = found.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).collect()  # MOST_LONGS rows at most
    bits = [0] * longs
    for w, b in rows:
        bits[w] = b
    return bits


def agreement(item: Column, doc: Column, offset: Column) -> Column:
    """Laid on one another with the item's first word at the document's place offset: the most words that agree in a stretch that
    begins with a match and in which, up to each point, PENALTY matches outweigh a mismatch."""
    begin = F.greatest(F.lit(0), -offset)
    length = F.greatest(F.lit(0), F.least(F.size(item), F.size(doc) - offset) - begin)
    same = F.zip_with(F.slice(item, begin + 1, length), F.slice(doc, offset + begin + 1, length), lambda x, y: x == y)
    zero = F.struct(F.lit(0).alias("score"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, equal: Column) -> Column:
        score = F.when(equal, s["score"] + 1).otherwise(s["score"] - PENALTY)
        run = F.when(score < 0, F.lit(0)).otherwise(s["run"] + equal.cast("int"))
        return F.struct(F.greatest(score, F.lit(0)).alias("score"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(same, zero, step, lambda s: s["best"])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id, matched (words in the best stretch), item_words and
    place (the item's first word, counted from 0 among the document's words; negative where the item's beginning is missing)."""
    items, found = seeds(benchmark)
    per = found.groupBy("mask").count().collect()
    n, used = sum(r["count"] for r in per), sorted(r["mask"] for r in per)  # masks that serve no item cost nothing
    longs = LEAST_LONGS
    while longs < MOST_LONGS and longs * 64 < n * BITS:
        longs *= 2
    literal = F.split(F.lit(",".join(map(str, _bitmap(found, longs)))), ",").cast("array<long>")  # folded to one literal
    hashed = docs.select("doc_id", F.xxhash64("text").alias("t"), word_hashes(F.col("text")).alias("doc"))

    def marked(h: Column) -> Column:
        word = F.get(literal, F.shiftright(h, 6).bitwiseAND(F.lit(longs - 1)).cast("int"))
        return F.call_function("shiftright", word, h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    def hits(number: int) -> Column:
        mask = MASKS[number][0]
        places = F.filter(_starts(F.col("doc"), mask), lambda i: marked(_at(F.col("doc"), i, mask)))
        return F.transform(places, lambda i: F.struct(F.lit(number).alias("mask"), i.alias("place"), _at(F.col("doc"), i, mask).alias("h")))

    # explode_outer: for explode, Spark would infer a filter on the hits and compute them, with all that they need, once more below
    none = F.array().cast("array<struct<mask:int,place:int,h:bigint>>")
    found_at = hashed.withColumn("hits", F.concat(*[hits(k) for k in used]) if used else none)
    rows = found_at.select("doc_id", "t", F.explode_outer("hits").alias("x")).where("x.h IS NOT NULL").select("doc_id", "t", "x.*")
    if within(found, 64):
        laid = rows.join(F.broadcast(found), ["mask", "h"])
    else:  # a seed that very many places hold is spread; its items are one row
        rows = written(rows, "decontam-places")
        seeded = found.groupBy("mask", "h").agg(F.collect_list(F.struct("item_id", "k", "at")).alias("s"))
        seeded = seeded.join(rows.groupBy("mask", "h").count(), ["mask", "h"])
        laid = spread_join(rows, written(seeded, "decontam-seeded"), ["mask", "h"], "count").withColumn("s", F.explode("s")).select("*", "s.*")
    offsets = laid.select("doc_id", "t", "item_id", "k", (F.col("place") - F.col("at")).alias("offset")).distinct()
    offsets = written(offsets, "decontam-offsets")
    # the words of these documents and items, once more
    held = hinted(offsets.select(F.col("doc_id").alias("d"), F.col("t").alias("u")).distinct(), 48)
    texts = docs.select(F.col("doc_id").alias("x"), F.xxhash64("text").alias("y"), "text")
    texts = texts.join(held, F.col("x").eqNullSafe(F.col("d")) & (F.col("y") == F.col("u"))).select("d", "u", word_hashes(F.col("text")).alias("doc"))
    again = written(texts, "decontam-words").dropDuplicates(["d", "u"])
    worded = offsets.join(items.select(F.col("item_id").alias("i"), F.col("k").alias("l"), "item"), F.col("item_id").eqNullSafe(F.col("i")) & (F.col("k") == F.col("l")))
    worded = worded.join(again, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u")))
    laid = worded.select(
        "doc_id", "item_id", "offset", F.size("item").alias("item_words"), agreement(F.col("item"), F.col("doc"), F.col("offset")).alias("matched")
    )
    enough = F.col("matched") >= F.least(F.lit(LEAST), F.ceil(F.col("item_words") * F.lit(SHARE)))
    best = F.max(F.struct("matched", (-F.col("offset")).alias("back"), "item_words"))
    return (
        fenced(laid).where(enough)
        .groupBy("doc_id", "item_id")
        .agg(best.alias("x"))
        .select(
            "doc_id", "item_id", F.col("x.matched").cast("long").alias("matched"),
            F.col("x.item_words").cast("long").alias("item_words"), (-F.col("x.back")).cast("long").alias("place"),
        )
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose document holds no benchmark item. Spark broadcasts the leaking ids where their written size is small."""
    found = written(leaks(docs, benchmark).select(F.col("doc_id").alias("__id")).distinct(), "decontam-leaks")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__id"]), "left_anti")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
dp AS (SELECT doc_id, w, unnest(range(len(w))) AS p FROM d),
bp AS (SELECT item_id, w AS iw, least(4, len(w)) AS s, unnest(range(len(w) - least(4, len(w)) + 1)) AS p FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT s FROM bp),
ds AS (SELECT doc_id, w, p, s, array_to_string(w[p + 1 : p + s], ' ') AS h FROM dp JOIN sizes ON p + s <= len(w)),
bs AS (SELECT item_id, iw, p, s, array_to_string(iw[p + 1 : p + s], ' ') AS h FROM bp),
hit AS (SELECT DISTINCT doc_id, item_id, w, iw, ds.p - bs.p AS o FROM ds JOIN bs USING (s, h)),
laid AS (SELECT doc_id, item_id, o, len(iw) AS n,
         [iw[k + 1] = w[o + k + 1] FOR k IN range(greatest(0, -o), least(len(iw), len(w) - o))] AS same, row_number() OVER () AS id FROM hit),
walk AS (SELECT id, 0 AS k, 0 AS score, 0 AS run, 0 AS best, same FROM laid
         UNION ALL
         SELECT id, k + 1, greatest(0, score + CASE WHEN same[k + 1] THEN 1 ELSE -4 END),
                CASE WHEN score + CASE WHEN same[k + 1] THEN 1 ELSE -4 END < 0 THEN 0 ELSE run + same[k + 1]::INT END,
                greatest(best, CASE WHEN score + CASE WHEN same[k + 1] THEN 1 ELSE -4 END < 0 THEN 0 ELSE run + same[k + 1]::INT END), same
         FROM walk WHERE k < len(same)),
ended AS (SELECT id, max(best) AS best FROM walk GROUP BY id),
good AS (SELECT doc_id, item_id, o, n, best FROM laid JOIN ended USING (id) WHERE best >= least(13, ceil(n * 0.8::DOUBLE)))
SELECT doc_id, item_id, best::BIGINT AS matched, n::BIGINT AS item_words, o::BIGINT AS place
FROM good QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY best DESC, o) = 1
"""
