"""Near copies by the Gray-order SimHash index and, beyond its radius, by exact Jaccard similarity of five-word shingles.

Texts whose shingle sets have a Jaccard similarity of 0.8 or more are linked and the links' connected components are the groups of near
copies. The SimHash index of this package links fingerprints of five-word shingles within three bits; its links are verified. At a similarity
of 0.8 fingerprints differ in ten bits or so, more than any index of 64 bits can follow over many texts, so that the links that it can't see are
found by prefix filtering, all of them and none by chance:

1. Two such sets differ by a fifth of each at most. Of the first n // 5 + n // 10 + 1 shingles of a set, in the order of their hashes, some must be
   in the first ones of another set; sets with too few of those have no link and go.
2. Of the sets that are left all shingles are counted. A set of which over a fifth is in no other set has no link and goes.
3. Each set's shared shingles are ordered by how many sets hold them, the rarest first. Linked sets share one at least of the first ones, as
   many as exceed the common shingles that a link needs.
4. Among the sets with the same such shingle the most central one, whose shingles most other sets hold, is compared with each of the others.
5. Pairs that share such a shingle and aren't connected by then are compared by the parities of their shingles' cells, which bound the similarity from above,
   in blocks of BLOCK sets; what passes is verified. Shingles that the very same sets hold make the same pairs: one of them stands for all.

Defined results: words are runs without ASCII white space, A-Z in lower case; texts of fewer than five words have one shingle, all of the
text, and null, empty and blank texts one that is empty; shingles are told apart by 64-bit hashes; every row stands for itself,
whatever its id, but of rows with equal id and text one stays; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hinted, in_small_batches, one_of_each, spread_join, written
from .simhash import SPACES, components, links, majority

#: Words of a shingle. Similarity is 0.8 or more: 9 * common >= 4 * (size + size).
WORDS = 5
#: Cells whose parities are kept of a set, and sets that are compared with one another in one block.
CELLS, BLOCK = 4096, 4096


def digests(text: str | None, k: int = WORDS) -> np.ndarray:
    """The hashes of a text's shingles in order, repeats included."""
    import xxhash

    words = SPACES.sub(b" ", (text or "").encode("utf-8", "surrogatepass").lower()).strip(b" ").split(b" ")
    parts = zip(*[words[i:] for i in range(k)], strict=False) if len(words) > k else [words]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(x)) for x in parts), np.uint64)


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(digests(text, k)).view(np.int64)


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in found]), pa.int32()), pa.array(np.concatenate(found)))


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text, ...): the hash of the text's set, its size, its first shingles, the fingerprint of the text, and the other columns."""
    import xxhash

    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # bounded memory for batches of long texts
            part = batch.slice(at, 256)
            keys, sizes, first, prints = [], [], [], []
            for x in part.column(0):
                every = digests(x.as_py())
                own = np.unique(every)
                keys.append(xxhash.xxh128_digest(own.tobytes()))
                sizes.append(len(own))
                first.append(own[: len(own) // 5 + len(own) // 10 + 1].view(np.int64))
                prints.append(majority(every))
            arrays = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), _lists(first), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, *part.columns[1:]], ["key", "n", "first", "fp", *part.schema.names[1:]])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text, row): row, the size of the text's set, its cells' parities and the set."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [shingles(x.as_py()) for x in part.column(0)]
            cells = [np.packbits(np.bincount(x & (CELLS - 1), minlength=CELLS) & 1).tobytes() for x in found]
            sizes = pa.array([len(x) for x in found], pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(1), sizes, pa.array(cells, pa.binary()), _lists(found)], ["row", "n", "cells", "set"])


def lonely(sets: DataFrame, what: str) -> DataFrame:
    """Of (row, what: shingles) how many of the shingles of a row no other row has: (row, alone), without rows that have none such."""
    each = sets.select("row", F.explode(what).alias("h")).groupBy("h").agg(F.count("*").alias("c"), F.min("row").alias("row"))
    return each.where("c = 1").groupBy("row").agg(F.count("*").alias("alone"))


def _similar(common: Column, n: Column, m: Column) -> Column:
    return 9 * common >= 4 * (n + m)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows of sets (row, n, set) that are similar."""
    left = sets.select(F.col("row").alias("a"), F.col("n").alias("na"), F.col("set").alias("sa"))
    right = sets.select(F.col("row").alias("b"), F.col("n").alias("nb"), F.col("set").alias("sb"))
    near = _similar(F.least("na", "nb"), F.col("na"), F.col("nb"))  # no more can be common
    sizes = pairs.join(left.drop("sa"), "a").join(right.drop("sb"), "b").where(near).select("a", "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return sizes.join(left, "a").join(right, "b").where(_similar(common, F.col("na"), F.col("nb"))).select("a", "b")


def ordered_pairs(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, i, j, own, row, cls, n, cells) in the order of (h, i, j), own being i or j: pairs of rows of different classes in a block (h, i, j), one
    of own i and one of own j, whose sizes and parities allow a link: as many shingles at least are in one of them only as cells differ in parity."""
    held: list[pa.RecordBatch] = []

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        h, i, j, own, row, cls, n = (rows.column(k).to_numpy() for k in range(7))
        new = np.flatnonzero((h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        starts = [0, *new.tolist(), len(h)]
        whole = starts if last else starts[:-1]
        held[:] = [] if last else rows.slice(whole[-1]).to_batches()
        cells = np.frombuffer(b"".join(rows.column(7).slice(0, whole[-1]).to_pylist()), np.uint64).reshape(-1, CELLS // 64)
        for begin, end in zip(whole, whole[1:], strict=False):
            at = np.arange(begin, end)
            y = at if i[begin] == j[begin] else at[own[at] == j[begin]]
            xs = at if i[begin] == j[begin] else at[own[at] == i[begin]]
            step = max(1, (1 << 16) // max(1, len(y)))
            for k in range(0, len(xs), step):
                x = xs[k : k + step, None]
                apart = np.bitwise_count(cells[x] ^ cells[y][None]).sum(axis=2, dtype=np.int64)
                apart = np.maximum(apart, np.abs(n[x] - n[y]))
                near = (9 * apart <= n[x] + n[y]) & (cls[x] != cls[y]) & ((x < y) | (i[begin] != j[begin]))
                p, q = np.nonzero(near)
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(row[x[p, 0]]), pa.array(row[y[q]])], ["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= 1 << 15:
            yield from flush(False)
    if sum(x.num_rows for x in held):
        yield from flush(True)


def _unconnected(rare: DataFrame, linked: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows with a rare shingle h in common that linked (node, root) doesn't connect and whose parities allow a link."""
    classed = rare.join(linked.withColumnRenamed("node", "row"), "row", "left").select("h", "row", F.coalesce("root", "row").alias("cls"))
    classed = written(classed, "nearcopies-classes")
    members = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"rows_{k}") for k in (0, 1)]
    open_ = classed.groupBy("h").agg(F.min("cls").alias("x"), F.max("cls").alias("y"), F.count("*").alias("m"), *members).where("x <> y")
    open_ = open_.groupBy("m", "rows_0", "rows_1").agg(F.min("h").alias("h")).select("h", "m")  # one of the shingles that the same rows hold
    rows = spread_join(classed, written(open_, "nearcopies-open"), ["h"], "m").join(sets.select("row", "n", "cells"), "row")
    # a shingle of more than BLOCK sets: each part of them meets each other part in a task of its own
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("row"), parts).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    keys = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    dealt = dealt.select("h", *keys, "own", "row", "cls", F.col("n").cast("long").alias("n"), "cells").repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    return dealt.mapInArrow(_blocks, "a bigint, b bigint").select(*ordered_pairs(F.col("a"), F.col("b"))).distinct()


def similar(sets: DataFrame, known: DataFrame) -> DataFrame:
    """Of distinct sets (row, n, cells, set), links (a, b) that connect all that links of similarity 0.8 or more connect. known: pairs (a, b) that are
    verified first."""
    alone = lonely(sets.select("row", "set"), "set").where(F.col("alone") > 0)
    left = sets.select("row", "n").join(alone, "row", "left").where(F.coalesce("alone", F.lit(0)) <= F.floor(F.col("n") / 5)).select("row")
    left = written(left, "nearcopies-left")
    kept = sets.join(hinted(left, 16), "row", "left_semi")
    counts = sets.select(F.explode("set").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    shared = spread_join(kept.select("row", "n", F.explode("set").alias("h")), written(counts, "nearcopies-counts"), ["h"], "c")
    # as many of a row's rarest shared shingles as exceed what a link needs
    needs = F.size("l") - (F.col("n") - F.floor(F.col("n") / 5)) + 1
    listed = shared.groupBy("row").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "h"))).alias("l"), F.sum("c").alias("s"))
    rare = listed.where(needs > 0).select("row", (F.col("s") / F.col("n")).alias("central"), F.explode(F.slice("l", F.lit(1), needs.cast("int"))).alias("x"))
    rare = written(rare.select("row", "central", "x.h"), "nearcopies-rare")
    leaders = rare.groupBy("h").agg(F.max_by("row", F.struct("central", "row")).alias("leader"), F.count("*").alias("m")).where("m > 1")
    stars = spread_join(rare.select("h", "row"), written(leaders, "nearcopies-leaders"), ["h"], "m").where("row <> leader")
    pairs = stars.select(*ordered_pairs(F.col("row"), F.col("leader"))).unionByName(known).distinct()
    found = written(verified(written(pairs, "nearcopies-stars"), sets), "nearcopies-links")
    rest = _unconnected(rare.select("h", "row"), components(found), sets)
    return found.unionByName(written(verified(written(rest, "nearcopies-pairs"), sets), "nearcopies-links"))


def groups(docs: DataFrame) -> DataFrame:
    """Of docs (doc_id, text, ...), one row for each of its rows: id, h (the hash of the text), row (a number) and root, the same for all of a group."""
    text = docs.select("text", F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = in_small_batches(text).mapInArrow(_first, f"key binary, n int, first array<bigint>, fp bigint, row bigint, id {id_type}, h bigint")
    rows = written(rows, "nearcopies-rows")
    least = written(rows.groupBy("key").agg(F.min_by("row", F.struct(F.col("id").isNull(), "id", "h", "row")).alias("row"), F.count("*").alias("m")), "nearcopies-distinct")
    again = rows.select("key", "row").join(least.where("m > 1").select("key", F.col("row").alias("r")), "key").where("row <> r").select("row")
    distinct = rows.join(hinted(written(again, "nearcopies-again"), 16), "row", "left_anti")
    n = F.col("n")
    most = F.floor(n / 5) + F.floor(n / 10) - F.floor(F.floor(4 * n / 5) / 10)  # first shingles without those that a link needs
    alone = lonely(distinct.select("row", "first"), "first")
    able = distinct.select("row", "n", "id", "h", "fp").join(alone, "row", "left").where(F.coalesce("alone", F.lit(0)) <= most)
    able = written(able.select("row", "id", "h", "fp"), "nearcopies-able")
    # the texts of these, by id and the text's hash; equal ones give equal sets
    named = docs.select(F.col("doc_id").alias("i"), "text", F.xxhash64("text").alias("t")).join(
        hinted(able.select("row", "id", "h"), 48), F.col("i").eqNullSafe(F.col("id")) & (F.col("t") == F.col("h"))
    )
    sets = named.select("text", "row").mapInArrow(_whole, "row bigint, n int, cells binary, set array<bigint>")
    if not rows.groupBy("id", "h").count().where("count > 1").isEmpty():
        sets = sets.dropDuplicates(["row"])
    sets = written(sets, "nearcopies-sets")
    # what the SimHash index links: equal fingerprints, and those near to one another
    prints = written(able.groupBy("fp").agg(F.min("row").alias("least"), F.count("*").alias("m")), "nearcopies-prints")
    same = spread_join(able.select("fp", "row"), prints, ["fp"], "m").where("row <> least").select(*ordered_pairs(F.col("row"), F.col("least")))
    near = links(prints.select("fp"))
    near = near.join(prints.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    linked = components(similar(sets, same.unionByName(near.select(*ordered_pairs(F.col("x"), F.col("y"))))))
    roots = least.join(linked.withColumnRenamed("node", "row"), "row", "left").select("key", "m", F.coalesce("root", "row").alias("root"))
    return spread_join(rows.select("key", "row", "id", "h"), written(roots, "nearcopies-roots"), ["key"], "m").select("id", "h", "row", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each group one row, the one with the smallest doc_id and then text hash; a null id comes after others."""
    return one_of_each(docs, written(groups(docs), "nearcopies-groups"))
