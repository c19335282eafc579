"""Resampling towards a target distribution by hashed word runs.

A document's features are all runs of one to three consecutive words, repeats counted, and a feature's bucket is the crc32 of its bytes modulo the number
of buckets. How often the target texts fall into a bucket, against how often all documents do, gives the bucket's gain; a document's weight is the sum of
the gains of its features, and the draw without replacement takes the highest sums of weight and Gumbel noise, which is made from the document's id.

The checksums are made for many features at once: the distinct features of a batch are grouped by the length of their bytes into matrices of bytes, one row
for each place and one column for each feature; all checksums of a matrix are updated place by place, and what a matrix gives is scattered back to wherever its features occur.
The counts of all documents are summed by bucket, so that a fixed number of rows leaves each task, whatever its texts. Documents are read twice: once
for the counts, once for the weights.

Defined results: null and blank texts have no words, no features and weight 0; a null id makes the noise of an empty one and comes last among ties; rows
with equal ids are scored and drawn each for itself, and only those of equal id and score are interchangeable; where the target or the documents are
empty, their counts are 0; the draw is of at least as many rows as there are, 0 for few; other columns are ignored or passed on.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from .common import CRC_SQL, UPPER, crc_sql, in_small_batches, row_of, written

BUCKETS, ORDERS, SEED = 10_000, 3, 42
#: Words, bytes of documents and cells of a matrix that a task looks at together.
WORDS_AT_ONCE, BYTES_AT_ONCE, CELLS = 1 << 17, 1 << 20, 1 << 21
#: Features of more bytes than this are few, each a matrix of one column; zlib gives the same checksum.
LONG = 1024


def _lowered() -> np.ndarray:
    """What each byte of a text becomes: letters, digits and all of non-ASCII characters stay, A-Z in lower case; others are a space."""
    out = np.full(256, 32, np.uint8)
    for x in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        out[x] = x
    out[0x41:0x5B] = np.arange(0x61, 0x7B)
    return out


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


LOWERED, CRC = _lowered(), _crc_table()


def crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The crc32 of data[start : start + length] for each start."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    edges = [*np.flatnonzero(np.diff(lengths[order], prepend=-1)).tolist(), len(order)]
    for at, end in zip(edges, edges[1:], strict=False):
        length = int(lengths[order[at]])
        step = max(1, CELLS // max(1, length))
        for k in range(at, end, step):
            own = order[k : min(end, k + step)]
            if length > LONG:
                out[own] = [zlib.crc32(data[s : s + length].tobytes()) for s in starts[own]]
                continue
            matrix = data[starts[own][None, :] + np.arange(length)[:, None]]
            crc = np.full(len(own), 0xFFFFFFFF, np.uint32)
            for column in matrix:
                crc = CRC[(crc ^ column) & 0xFF] ^ (crc >> 8)
            out[own] = ~crc
    return out


def _codes(values: pa.Array) -> tuple[np.ndarray, int]:
    """Numbers of equal values, from 0, and how many there are."""
    found = values.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), len(found.dictionary)


def hashed_features(texts: pa.Array, buckets: int, orders: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a batch's texts, in pieces: the text's place in the batch and the bucket, of each feature. The first piece has the texts' numbers of words."""
    nothing, end = (pa.scalar(x, pa.large_string()) for x in ("", "\n"))
    ended = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), nothing), nothing, end)  # a byte after each word
    offsets = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1]
    data = LOWERED[np.frombuffer(ended.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    word = data != 32
    before = np.r_[False, word[:-1]]
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(before & ~word)
    doc = np.searchsorted(offsets - offsets[0], starts, side="right") - 1
    yield np.bincount(doc, minlength=len(texts)), np.zeros(0, int)
    data = data[word | before]  # words, each with one space after it
    lengths = ends - starts
    starts = np.cumsum(lengths + 1) - lengths - 1
    for at in range(0, len(starts), WORDS_AT_ONCE):
        own, size, d = starts[at : at + WORDS_AT_ONCE + orders - 1], lengths[at : at + WORDS_AT_ONCE + orders - 1], doc[at : at + WORDS_AT_ONCE + orders - 1]
        edges = np.r_[own, own[-1] + size[-1] + 1]
        words, n = _codes(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)]))
        runs, n_runs = words, n
        for k in range(orders):
            if k:
                runs, n_runs = _codes(pa.array(runs[:-1] * n + words[k:]))
            fits = d[: len(runs)] == d[k:]
            fits[WORDS_AT_ONCE:] = False  # the next piece's
            some = np.zeros(n_runs, np.int64)
            some[runs] = np.arange(len(runs))  # one place of each
            bucket = (crcs(data, own[some], own[some + k] + size[some + k] - own[some]) % np.uint32(buckets)).astype(np.int64)
            yield d[: len(runs)][fits], bucket[runs[fits]]


def _pieces(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Parts of a batch of BYTES_AT_ONCE bytes, or of one text, with their first place."""
    sizes, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BYTES_AT_ONCE)))
        yield at, texts.slice(at, end - at)
        at = end


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, orders: int = ORDERS) -> list[int]:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in _pieces(batch.column(0)):
                for _, found in hashed_features(part, buckets, orders):
                    counts += np.bincount(found, minlength=buckets)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full])], ["bucket", "n"])

    out = [0] * buckets
    for bucket, n in in_small_batches(docs.select("text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect():  # buckets rows at most
        out[bucket] = n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """By bucket, 1000 times the logarithm of its share in the target over its share in the source, both smoothed by one a bucket."""
    S, T = float(sum(source) + len(source)), float(sum(target) + len(target))
    return [math.floor(1000 * math.log((t + 1.0) * S / ((s + 1.0) * T))) for s, t in zip(source, target, strict=True)]


def weighed(docs: DataFrame, by_bucket: list[int], orders: int = ORDERS) -> DataFrame:
    """Of docs (text, row): row, n_words, n_features and weight."""
    table = np.array(by_bucket, np.float64)  # sums of whole numbers under 2 ** 53 are exact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for at, part in _pieces(batch.column(0)):
                found = hashed_features(part, len(table), orders)
                size = len(part)
                n[at : at + size] = next(found)[0]
                for place, bucket in found:
                    features[at : at + size] += np.bincount(place, minlength=size)
                    weight[at : at + size] += np.bincount(place, weights=table[bucket], minlength=size).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n), pa.array(features), pa.array(weight)], ["row", "n_words", "n_features", "weight"])

    row = docs.schema["row"].dataType.simpleString()
    return in_small_batches(docs.select("text", "row")).mapInArrow(run, f"row {row}, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times Gumbel noise, made from the id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    return F.floor(-1000 * F.log(-F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, orders: int = ORDERS, seed: int = SEED, narrow: bool = False) -> DataFrame:
    """Of docs (doc_id, text, ...): row (all columns, or doc_id only), n_words, n_features, weight and score."""
    table = gains(bucket_counts(docs, buckets, orders), bucket_counts(target, buckets, orders))
    rows = docs.select("text", (F.struct("doc_id") if narrow else row_of(docs)).alias("row"))
    return weighed(rows, table, orders).withColumn("score", F.col("weight") + noise(F.col("row.doc_id"), seed))


def ranked(found: DataFrame, percent: int = 5, least_words: int = 20) -> DataFrame:
    """found (doc_id, n_words, score, ...) with rank, from 1, of those that are drawn: percent of a hundred of the rows with least_words words, those with the
    highest scores, ties to the smaller id."""
    # ties between rows of equal id are broken by their numbers, so that no range of the order is one value
    kept = written(found.withColumn("able", F.col("n_words") >= least_words).withColumn("tie", F.monotonically_increasing_id()), "importance-scores")
    most = percent * kept.where("able").count() // 100
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie")]
    rank = F.when(F.col("number") < most, F.col("number") + 1)
    return numbered(kept, order).withColumn("rank", rank.cast("long")).drop("able", "tie", "number")


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score and rank."""
    return ranked(scored(docs, target, narrow=True).select("row.doc_id", "n_words", "n_features", "weight", "score")).select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = SEED) -> DataFrame:
    """The documents that the draw takes, with all their columns: those up to the last one of its order. Rows that share that one's id and score come with it."""
    found = scored(docs, target, seed=seed)
    ids = scored(docs, target, seed=seed, narrow=True).select("row.doc_id", "n_words", "score")
    last = ranked(ids, percent, least_words).where("rank IS NOT NULL").orderBy(F.desc("rank")).select("score", "doc_id").first()
    if last is None:
        return docs.limit(0)
    same = (F.col("score") == last["score"]) & (F.lit(True) if last["doc_id"] is None else F.col("row.doc_id") <= last["doc_id"])
    return found.where((F.col("n_words") >= least_words) & ((F.col("score") > last["score"]) | same)).select("row.*")


ORACLE_SQL = rf"""
WITH {CRC_SQL},
rows AS (
    SELECT 0 AS side, doc_id AS id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS text FROM documents
    UNION ALL SELECT 1, item_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') FROM benchmark
), listed AS (
    SELECT side, id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM rows
), runs AS (
    SELECT side, id, unnest(list_concat(w,
        list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
        list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM listed
), held AS (SELECT side, id, f, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT f, {crc_sql("f")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT f FROM held), crc_table),
counted AS (
    SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM held JOIN hashed USING (f) GROUP BY bucket
), gained AS (
    SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counted) + {BUCKETS}) / ((s + 1) * ((SELECT sum(t) FROM counted) + {BUCKETS}))))::BIGINT AS gain FROM counted
), summed AS (
    SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM held JOIN hashed USING (f) JOIN gained USING (bucket) WHERE side = 0 GROUP BY id
), scored AS (
    SELECT l.id AS doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || l.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM listed l LEFT JOIN summed m ON l.id = m.id WHERE side = 0
), drawn AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_words >= 20
)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= (SELECT 5 * count(*) // 100 FROM drawn) THEN r END AS rank FROM scored s LEFT JOIN drawn USING (doc_id)
"""
