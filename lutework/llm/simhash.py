"""SimHash near-duplicates by a Gray-order hierarchical index.

A fingerprint has a bit set where over half of the text's shingle hashes have it. Fingerprints that differ in few bits are linked and the
links' connected components are the groups of near copies.

Links are sought among distinct fingerprints only. Fingerprints within the radius agree in one block of bits at least, when there is one
block more than the radius: each fingerprint goes once to every block's value. Where more than REFINE fingerprints meet, the remaining
bits are cut into blocks in the same way, and again where far more do; nothing is dropped. A group's fingerprints are sorted by Gray
rank, which sets those that share leading bits side by side; nodes over runs of them hold the bits that all below share (a mask and a
pattern). Pairs of nodes are followed downwards: the shared bits in which two nodes differ are a lower bound that prunes both whole
groups, and nodes whose leaves can't differ by more than the radius are linked without looking further.

Defined results: null, empty and blank texts have fingerprint zero, linked like any other; rows with equal ids are rows of one document
with a fingerprint each; a null id takes part with the others and never names a group that has another id; empty tables give empty
results; other columns are ignored or passed on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MADE, discard, in_small_batches, one_of_each, spread_join, written

#: Fingerprints that may meet in one group before its remaining bits are cut into blocks again.
REFINE = 4096
#: Leaves of a node that is not divided further, and pairs of nodes that are looked at together.
LEAF, FRONTIER = 16, 1 << 12
SPACES = re.compile(rb"[\x20\x09-\x0D]+")


def majority(hashes: np.ndarray) -> int:
    """The bits, as a signed long, that are set in over half of the hashes (unsigned)."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):  # bounded memory for texts of any length
        raw = hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8)
        ones += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: str | None, k: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text, from all its k-word shingles."""
    import xxhash

    words = SPACES.sub(b" ", (text or "").encode("utf-8", "surrogatepass").lower()).strip(b" ").split(b" ")
    if words == [b""]:
        return 0
    if len(words) > k:
        parts = [b" ".join(x) for x in zip(*[words[i:] for i in range(k)], strict=False)]
    else:
        parts = [b" ".join(words)]
    digest = xxhash.xxh64_digest
    return majority(np.frombuffer(b"".join([digest(x, seed) for x in parts]), ">u8"))


def fingerprints(docs: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """Of docs (doc_id, text): doc_id, h, the hash of the text, and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), k, seed) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.int64())], ["doc_id", "h", "fp"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    return in_small_batches(narrow).mapInArrow(run, "doc_id bigint, h bigint, fp bigint")


# The index over the fingerprints of one task


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The position of each code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _nodes(codes: np.ndarray, groups: np.ndarray):
    """Levels over sorted codes, the finest first: each level's first leaf, end, shared mask and pattern of every node. A node never
    holds codes of two groups; the top level has a node for each group."""
    n = len(codes)
    edges = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if n else np.zeros(0, int)
    size = LEAF
    levels = []
    sizes = np.diff(np.r_[edges, n])
    while True:
        pieces = -(-sizes // size)
        starts = np.repeat(edges, pieces) + size * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        ends = np.minimum(starts + size, np.repeat(edges + sizes, pieces))
        both, either = np.bitwise_and.reduceat(codes, starts), np.bitwise_or.reduceat(codes, starts)
        levels.append((starts, ends, ~(both ^ either), both))
        if len(starts) == len(edges):
            return levels
        size *= 4


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        x = up


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]: roots point to smaller roots until all pairs agree."""
    while len(a):
        ra, rb = _find(parent, a), _find(parent, b)
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def link_groups(codes: np.ndarray, groups: np.ndarray, radius: int) -> np.ndarray:
    """Of codes within the radius in the same group, the smallest index reachable from each through such links. codes sorted by group
    and Gray rank."""
    parent = np.arange(len(codes))
    if not len(codes):
        return parent
    levels = _nodes(codes, groups)
    tops = np.arange(len(levels[-1][0]))
    busy = tops[levels[-1][1] - levels[-1][0] > 1]
    stack = [(len(levels) - 1, busy[k : k + FRONTIER], busy[k : k + FRONTIER]) for k in range(0, len(busy), FRONTIER)]
    while stack:
        level, a, b = stack.pop()
        starts, ends, masks, patterns = levels[level]
        apart = np.bitwise_count((patterns[a] ^ patterns[b]) & masks[a] & masks[b])
        near = apart <= radius
        a, b, apart = a[near], b[near], apart[near]
        loose = 64 - np.bitwise_count(masks[a] & masks[b])
        whole = apart + loose <= radius  # every leaf of one is within the radius of every leaf of the other
        if whole.any():
            for x in (a[whole], b[whole]):
                lengths = ends[x] - starts[x]
                first = np.repeat(starts[x], lengths)
                leaves = first + np.arange(len(first)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                _merge(parent, first, leaves)
            _merge(parent, starts[a[whole]], starts[b[whole]])
            a, b = a[~whole], b[~whole]
        if not len(a):
            continue
        if level == 0:
            i, j = np.meshgrid(np.arange(LEAF), np.arange(LEAF), indexing="ij")
            x, y = starts[a][:, None] + i.ravel(), starts[b][:, None] + j.ravel()
            fits = (x < ends[a][:, None]) & (y < ends[b][:, None]) & (x < y)
            x, y = x[fits], y[fits]
            close = np.bitwise_count(codes[x] ^ codes[y]) <= radius
            _merge(parent, x[close], y[close])
            continue
        below = levels[level - 1][0]
        first_child = np.searchsorted(below, starts)
        n_child = np.searchsorted(below, ends) - first_child
        ca, cb = n_child[a], n_child[b]
        total = ca * cb
        pair = np.repeat(np.arange(len(a)), total)
        k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        x, y = first_child[a][pair] + k // cb[pair], first_child[b][pair] + k % cb[pair]
        keep = x <= y
        x, y = x[keep], y[keep]
        stack += [(level - 1, x[k : k + FRONTIER], y[k : k + FRONTIER]) for k in range(0, len(x), FRONTIER)]
    return _find(parent, np.arange(len(codes)))


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, fp) in the order of key: links from each fingerprint to the root of its set within the group."""
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            keys = np.concatenate([x for x, _ in held])
            codes = np.concatenate([y for _, y in held])
            end = len(keys) if last else int(np.searchsorted(keys, keys[-1]))
            held[:] = [] if last else [(keys[end:], codes[end:])]
            keys, codes = keys[:end], codes[:end]
            order = np.lexsort((gray_rank(codes.view(np.uint64)), keys))
            keys, codes = keys[order], codes[order]
            roots = link_groups(codes.view(np.uint64), keys, radius)
            linked = roots != np.arange(len(roots))
            if linked.any():
                yield pa.RecordBatch.from_arrays([pa.array(codes[linked]), pa.array(codes[roots[linked]])], ["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(x) for x, _ in held) >= 1 << 17:
                yield from flush(False)
        if held:
            yield from flush(True)

    return run


def _cut(fixed: int, radius: int) -> list[int]:
    """Masks, as signed longs: the fixed bits and one of the radius + 1 blocks that make up the others."""
    free = [b for b in range(64) if not fixed >> b & 1]
    cuts = [len(free) * k // (radius + 1) for k in range(radius + 2)]
    masks = [(fixed & (2**64 - 1)) | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def links(distinct: DataFrame, radius: int = 3, refine: int = REFINE) -> DataFrame:
    """Of distinct fingerprints (fp), links (a, b) that connect just those that a chain of links within the radius connects."""
    spark = distinct.sparkSession
    placed = distinct.select("fp", F.explode(F.array(*[F.lit(m) for m in _cut(0, radius)])).alias("fixed"))
    # groups of equal fixed bits that are too large are cut again by the bits that aren't fixed. A cut multiplies a group's rows by radius + 1 at most, so that
    # the next one is worth its cost for much larger groups only; it ends, for f fixed bits leave 2 ** (64 - f) fingerprints at most
    found, limit = None, refine
    while True:
        key = F.xxhash64("fixed", F.col("fp").bitwiseAND(F.col("fixed")))
        placed = written(placed.withColumn("key", key), "simhash-blocks")
        counts = placed.groupBy("key", "fixed").count()
        large = written(counts.where((F.col("count") > limit) & (F.bit_count("fixed") < 64 - radius)).select("key", "fixed"), "simhash-large")
        masks = [r[0] for r in large.select("fixed").distinct().collect()]  # (radius + 1) ** cuts at most, whatever the input
        done = placed.join(large, ["key", "fixed"], "left_anti").select("key", "fp") if masks else placed.select("key", "fp")
        found = done if found is None else found.unionByName(done)
        if not masks:
            break
        finer = F.broadcast(spark.createDataFrame([(m, _cut(m, radius)) for m in masks], "fixed bigint, finer array<bigint>"))
        again = placed.join(large, ["key", "fixed"], "left_semi")
        placed, limit = again.join(finer, "fixed").select("fp", F.explode("finer").alias("fixed")), limit * (radius + 1) ** 2
    found = found.repartition("key").sortWithinPartitions("key")
    return found.mapInArrow(_links(radius), "a bigint, b bigint").distinct()


# Connected components


def components(edges: DataFrame) -> DataFrame:
    """Of links (a, b), the least node that each linked node reaches: (node, root). Large-star and small-star steps by turns, each an
    aggregation (pre-aggregated) and a join, until nothing moves; every round is written, so that its lineage is short."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "components")
        discard(edges.sparkSession, [MADE.pop(-2)])
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 31)), F.max("b")).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _classes(docs: DataFrame, k: int, radius: int, seed: int, refine: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, fp), one for each of docs, and of each fingerprint (fp, root, component_id, m): the least fingerprint and the least id that a
    chain of links reaches, and its number of rows."""
    prints = written(fingerprints(docs, k, seed), "simhash-prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("m")), "simhash-distinct")
    found = written(components(links(distinct.select("fp"), radius, refine)), "simhash-components")
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", "m", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints, written(rooted.join(named, "root").select("fp", "root", "component_id", "m"), "simhash-classes")


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 3, seed: int = 42, refine: int = REFINE) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that a chain of links reaches."""
    prints, classes = _classes(docs, k, radius, seed, refine)
    return spread_join(prints, classes, ["fp"], "m").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, k: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """docs without near copies: of each group, the row with the smallest doc_id and then text hash; null ids come last."""
    prints, classes = _classes(docs, k, radius, seed, REFINE)
    found = spread_join(prints, classes, ["fp"], "m").select(F.col("doc_id").alias("id"), "h", "root")
    return one_of_each(docs, written(found, "simhash-groups"))
