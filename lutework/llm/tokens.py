"""Token ids in patched frame-of-reference blocks.

Documents are encoded in ascending id order and their ids written as segments, rows of a Parquet table that Spark commits: runs of whole
documents of about SEGMENT ids, cut into blocks of BLOCK ids. A block keeps its least id, packs the differences at the width that holds
WIDTH_SHARE of them, and lists the rest as exceptions; each segment carries the byte offset at which every block starts.

Block layout (little endian): least u32, n u16, width u8, spare u8, n_exceptions u16, packed low bits (each value most significant bit
first, padded to a byte), exception positions u16, exception high parts u32.

Defined results: a null or empty text is the end id alone; null ids come first; equal ids are ordered by text; an empty table gives an
empty one; other columns are ignored. Strings of special tokens in a text are encoded as the library does by default.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.folders import scratch
from .common import in_small_batches

BLOCK, SEGMENT, WIDTH_SHARE = 1024, 1 << 16, 0.9
HEAD = np.dtype([("least", "<u4"), ("n", "<u2"), ("width", "u1"), ("spare", "u1"), ("n_exc", "<u2")])
SEGMENT_SCHEMA = "shard int, segment int, doc_ids array<bigint>, lengths array<bigint>, block_starts array<bigint>, payload binary"
#: Pieces whose ids a worker keeps, and those of them that came once so far; beyond it either table is begun again. The latter ends with its task.
CACHE_PIECES, YOUNG = 100_000, 60_000
#: The rules that WordEncoder's own cutting follows, as a tokenizer file states them.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
MODEL = {
    "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def pack(ids: np.ndarray) -> tuple[bytes, list[int]]:
    """The blocks of ids, and the byte offset of each."""
    out, starts, at = [], [], 0
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        return b"", []
    table = np.full(n_blocks * BLOCK, ids[-1], np.uint32)
    table[: len(ids)] = ids
    table = table.reshape(n_blocks, BLOCK)
    counts = np.full(n_blocks, BLOCK)
    counts[-1] = len(ids) - BLOCK * (n_blocks - 1)
    least = table.min(axis=1)
    rest = table - least[:, None]
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)
    width = np.partition(bits, int(BLOCK * WIDTH_SHARE), axis=1)[:, int(BLOCK * WIDTH_SHARE)]
    packed: list[bytes] = [b""] * n_blocks
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            low = (rest[rows] & np.uint32((1 << int(w)) - 1)).astype(">u4")
            flat = np.unpackbits(low.view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2)[:, :, 32 - int(w) :]
            for r, b in zip(rows, np.packbits(flat.reshape(len(rows), -1), axis=1), strict=True):
                packed[r] = b.tobytes()
    over = bits > width[:, None]
    for r in range(n_blocks):
        n, w = int(counts[r]), int(width[r])
        where = np.flatnonzero(over[r, :n])
        head = np.array([(least[r], n, w, 0, len(where))], HEAD).tobytes()
        block = head + packed[r][: -(-n * w // 8)] + where.astype("<u2").tobytes() + (rest[r, where] >> np.uint32(w)).astype("<u4").tobytes()
        starts.append(at)
        out.append(block)
        at += len(block)
    return b"".join(out), starts


def unpack(payload: bytes, starts: list[int]) -> np.ndarray:
    """The ids of the blocks that begin at the given byte offsets."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    heads = np.array([np.frombuffer(payload, HEAD, 1, s)[0] for s in starts], HEAD)
    out = np.zeros((len(starts), BLOCK), np.uint32)
    sizes = -(-heads["n"].astype(int) * heads["width"] // 8)
    for w in np.unique(heads["width"]):
        rows = np.flatnonzero(heads["width"] == w)
        if w:
            full = BLOCK * int(w) // 8
            raw = np.zeros((len(rows), full), np.uint8)
            for k, r in enumerate(rows):
                at = starts[r] + HEAD.itemsize
                raw[k, : sizes[r]] = np.frombuffer(payload, np.uint8, sizes[r], at)
            flat = np.zeros((len(rows), BLOCK, 32), np.uint8)
            flat[:, :, 32 - int(w) :] = np.unpackbits(raw, axis=1).reshape(len(rows), BLOCK, int(w))
            out[rows] = np.packbits(flat, axis=2).view(">u4")[:, :, 0]
    for r in np.flatnonzero(heads["n_exc"]):
        n, at = int(heads["n_exc"][r]), starts[r] + HEAD.itemsize + int(sizes[r])
        where = np.frombuffer(payload, "<u2", n, at)
        out[r, where] |= np.frombuffer(payload, "<u4", n, at + 2 * n) << np.uint32(heads["width"][r])
    out += heads["least"][:, None]
    return out.reshape(-1)[: BLOCK * (len(starts) - 1) + int(heads["n"][-1])]


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes a byte that prints as itself, the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Encodes texts as the library does, remembering pieces: for tokenizers with word_bpe_49k.json's rules (NFC, lower case, white space
    dropped, pieces of letters, single digits or other characters, byte letters). In texts of ASCII and Latin-1 letters without
    apostrophes those pieces are cut here and the library's model encodes each new one; words of any other kind the library
    encodes whole. Words parted by a blank, tab or line feed never influence each other. Of a tokenizer with other rules, which its file
    tells, the library encodes every text whole."""

    OTHER = re.compile("[^\t\n\\x20-&(-~À-ÖØ-öø-ÿ]")
    PIECE = re.compile("[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\\[-`{-~]+")

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.known: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        stated = json.loads(self.tokenizer.to_str())
        rules = stated["normalizer"] == NORMALIZER and stated["pre_tokenizer"] == PRE_TOKENIZER and stated["post_processor"] is None
        self.own_rules = rules and {k: v for k, v in stated["model"].items() if k not in ("vocab", "merges")} == MODEL and stated["truncation"] is None and stated["padding"] is None
        # a text that holds a special token's string goes to the library
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _new(self, piece: str) -> bytes:
        """The ids of a piece that isn't known for long. Most pieces of a large corpus come once: one that comes again while it is
        among the YOUNG latest new ones stays."""
        found = self.young.pop(piece, None)
        if found is not None:
            if len(self.known) >= CACHE_PIECES:
                self.known.clear()
            self.known[piece] = found
            return found
        written = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        ids = [t.id for t in self.model.tokenize(written)]
        if len(self.young) >= YOUNG:
            self.young.clear()
        found = self.young[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def _pieces(self, plain: str) -> bytes:
        get, new = self.known.get, self._new
        return b"".join([get(p) or new(p) for p in self.PIECE.findall(plain)])

    def __call__(self, text: str) -> np.ndarray:
        if not self.own_rules:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        low = text.lower()
        special = any(x in low for x in self.special)
        if not special and not self.OTHER.search(text):
            return np.frombuffer(self._pieces(low), "<u4")
        out, run = [], []
        for w in text.replace("\t", " ").replace("\n", " ").split(" "):
            if special or self.OTHER.search(w):
                if run:
                    out.append(self._pieces(" ".join(run).lower()))
                    run = []
                out.append(np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                run.append(w)
        out.append(self._pieces(" ".join(run).lower()))
        return np.frombuffer(b"".join(out), "<u4")


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    """One for each worker process: the words stay known from task to task."""
    return WordEncoder(path)


def _segments(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encode, number, held = TaskContext.get().partitionId(), _encoder(path), 0, 0
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        lengths: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            payload, starts = pack(np.concatenate(ids))
            row = [[shard], [number], [list(docs)], [list(lengths)], [starts], [payload]]
            types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["shard", "segment", "doc_ids", "lengths", "block_starts", "payload"]
            number, held = number + 1, 0
            ids.clear(), docs.clear(), lengths.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype(np.uint32)
                ids.append(own), docs.append(doc_id), lengths.append(len(own))
                held += len(own)
                if held >= SEGMENT:
                    yield flush()
        if docs:
            yield flush()
        encode.young.clear()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, shards: int | None = None) -> None:
    """Encodes docs (doc_id, text) and writes their segments to path, shards in ascending id order."""
    shards = shards or max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select("doc_id", "text").repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    in_small_batches(ordered).mapInArrow(_segments(tokenizer_path, end_id), SEGMENT_SCHEMA).write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["payload"], row["block_starts"]).astype("<u4")
            ends = np.cumsum(row["lengths"])
            begins = ends - row["lengths"]
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)]
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["shard"]] * n, pa.int32()),
                    pa.array([row["segment"]] * n, pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(begins, pa.int64()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                ["shard", "segment", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Of every document in the files: doc_id, start (ids of all documents before it), n_tokens and the crc32 of its ids."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    totals = segments.select("shard", "segment", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    in_shard = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    shards = totals.groupBy("shard").agg(F.sum("n").alias("n"))  # a row per shard, whatever the input's size
    earlier = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    starts = totals.select("shard", "segment", F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias("in_shard")).join(shards, "shard")
    schema = "shard int, segment int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"
    read = segments.mapInArrow(_documents, schema).join(starts, ["shard", "segment"])
    return read.select("doc_id", (F.col("base") + F.col("in_shard") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes docs to a folder of its own among the shared ones and returns what the files hold."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, end_id, path)
    return read_documents(docs.sparkSession, path)
