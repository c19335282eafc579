"""Spelling variants by composing a vocabulary's acceptor with a one-edit transducer and the acceptor again.

Two words are near if one inserted, deleted or replaced code point makes one of the other. The pairs are the paths of the machine that reads a first word
by the vocabulary's minimal acyclic acceptor, passes it through a transducer of exactly one edit, and writes a second word that the same acceptor accepts.

The machine is taken apart by its initial states: what has been read before the edit is the same in both words, so that words fall into partitions by their first
HEAD code points, each with an acceptor of its own, which finds the pairs that differ further on. Pairs that differ within the first HEAD code points agree in all that
follows, so that the reversed words' machine, taken apart in the same way, finds them. A partition of more than MOST words is taken apart again by
one more code point; the pairs that differ in just that one are joined on the rest, which a machine past its edit must read alike in both words. So each
partition is one bounded task's work, and no link is lost.

Within a partition the edits at a state depend on the state only: they are sought once for each of the minimal acceptor's states, however many prefixes lead
there. Words are numbered by the order of the acceptor's paths, so that a pair is two sums along its paths. A deleted code point is the last one of its run, so
that each pair has one path.

Defined results: null, empty and blank texts have no words; rows with equal ids are documents each; a null id counts as empty text; words are compared by code points;
an empty table gives no rows; other columns are ignored. An acceptor has up to one state for each code point of its words, so a very long word costs its length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CRC_SQL, MADE, UPPER, crc_sql, discard, in_small_batches, written

#: Code points and occurrences that a word has at least, and how many times as frequent its form is.
LEAST_LENGTH, LEAST_N, RATIO = 7, 2, 10
#: Of a word, the code points that name its partition, and words of a partition that is not taken apart again.
HEAD, MOST = 3, 1 << 14
#: Words that a task counts before it hands its counts on.
HELD = 1 << 17


def variant(doc_id: str, word: str, one_in: int = 31) -> str:
    """The word as it stands in a document: of one in so many, by a hash of both, a code point is deleted."""
    h = zlib.crc32(f"{doc_id}:{word}".encode("utf-8", "surrogatepass"))
    at = h % len(word)
    return word if h % one_in else word[:at] + word[at + 1 :]


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_n: int = LEAST_N) -> DataFrame:
    """Of docs (doc_id, text): word and n, how often it occurs in all texts."""
    run_of = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if text:
                    lowered = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only
                    for word, n in Counter(run_of.findall(lowered)).items():
                        word = variant(doc, word)
                        if len(word) >= least_length:
                            seen[word] += n
                if len(seen) >= HELD:
                    yield handed()
        yield handed()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    return in_small_batches(rows).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


class Acceptor:
    """The minimal acyclic acceptor of sorted distinct words, and its composition with one edit and itself.

    Of each state: edges, its successors by code point in order; final; count, how many words lead from it to an end; first, a mask of the code points it
    reads and of whether it is final; least, the length of the shortest of its words. Word i is the i-th path in order."""

    def __init__(self, words: list[str]) -> None:
        self.edges: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.count: list[int] = []
        self.first: list[int] = []
        self.least: list[int] = []
        self.known: dict[tuple, int] = {}
        open_: list[tuple[dict[str, int], bool]] = [({}, False)]  # the states along the last word, still to be closed
        last = ""
        for word in words:
            same = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                same += 1
            self._close(open_, last, same)
            open_ += [({}, False) for _ in range(len(word) - same)]
            open_[-1] = (open_[-1][0], True)
            last = word
        self._close(open_, last, 0)
        self.root = self._state(*open_[0])
        self.known.clear()
        self.common: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def _close(self, open_: list[tuple[dict[str, int], bool]], word: str, depth: int) -> None:
        while len(open_) > depth + 1:
            edges, final = open_.pop()
            open_[-1][0][word[len(open_) - 1]] = self._state(edges, final)

    def _state(self, edges: dict[str, int], final: bool) -> int:
        key = (final, *edges.items())
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.edges)
            self.edges.append(edges)
            self.final.append(final)
            self.count.append(final + sum(self.count[x] for x in edges.values()))
            mask = final
            for c in edges:
                mask |= 2 << ord(c) % 61
            self.first.append(mask)
            self.least.append(0 if final else 1 + min((self.least[x] for x in edges.values()), default=0))
        return found

    def both(self, p: int, q: int, without: str = "") -> list[tuple[int, int]]:
        """The words that both states read, by their numbers from either; of those that begin with the code point without, none."""
        key = (p, q, without)
        if key in self.common:
            return self.common[key]
        out, stack = [], [(p, q, 0, 0, without)]
        while stack:
            p, q, i, j, without = stack.pop()
            if p == q and not without:
                out += [(i + k, j + k) for k in range(self.count[p])]
                continue
            if not self.first[p] & self.first[q]:
                continue
            if self.final[p] and self.final[q]:
                out.append((i, j))
            at, others, place = i + self.final[p], self.edges[q], None
            for c, x in self.edges[p].items():
                if c in others and c != without:
                    if place is None:
                        place, k = {}, j + self.final[q]
                        for d, y in others.items():
                            place[d] = k
                            k += self.count[y]
                    stack.append((x, others[c], at, place[c], ""))
                at += self.count[x]
        self.common[key] = out
        return out

    def edited(self, state: int) -> list[tuple[int, int]]:
        """Pairs of the state's words that differ by an edit of their first code point: replaced, or deleted where another one follows."""
        out, at, placed = [], int(self.final[state]), []
        for c, x in self.edges[state].items():
            placed.append((c, x, at))
            at += self.count[x]
        for k, (c, x, i) in enumerate(placed):
            for _, y, j in placed[k + 1 :]:
                if self.first[x] & self.first[y]:
                    out += [(i + a, j + b) for a, b in self.both(x, y)]
            if self.first[x] & self.first[state]:
                out += [(i + a, b) for a, b in self.both(x, state, c)]
        return out

    def pairs(self, least: int | None = None) -> Iterator[tuple[int, int]]:
        """The numbers of all pairs of near words, each once; with least, edits only at states one of whose words has no more than so many code points left."""
        edits: dict[int, list[tuple[int, int]]] = {}
        stack = [(self.root, 0)]
        while stack:
            state, base = stack.pop()
            if least is None or self.least[state] <= least:
                if state not in edits:
                    edits[state] = self.edited(state)
                for a, b in edits[state]:
                    yield base + a, base + b
            at = base + self.final[state]
            for x in self.edges[state].values():
                if self.count[x] > 1:
                    stack.append((x, at))
                at += self.count[x]


def _better(n: int, word: str, than_n: int, than: str) -> bool:
    return n > than_n or n == than_n and word < than


def _near(head: int):
    """Of rows (key, back, depth, word, n) in the order of key and word, back if words are reversed: of each word with near ones in its partition, how many, and the
    most frequent of them."""

    def of(words: list[str], n: list[int], back: bool, depth: int) -> pa.RecordBatch:
        # the reversed machine's edits are those within a word's first code points, which the other one doesn't see
        machine = Acceptor([w[depth:] for w in words])
        true = [w[::-1] for w in words] if back else words
        seen, most, best = [0] * len(words), [0] * len(words), [""] * len(words)
        for i, j in machine.pairs(head + 1 if back else None):
            a, b = true[i], true[j]
            if back and a[:head] == b[:head]:
                continue
            for x, y, other in ((i, j, b), (j, i, a)):
                seen[x] += 1
                if _better(n[y], other, most[x], best[x]):
                    most[x], best[x] = n[y], other
        own = [i for i, k in enumerate(seen) if k]
        columns = [[true[i] for i in own], [seen[i] for i in own], [most[i] for i in own], [best[i] for i in own]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "near_n", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, n = None, [], []
        for batch in batches:
            for k, back, depth, word, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, back, depth) != key:
                    if len(words) > 1:
                        yield of(words, n, *key[1:])
                    key, words, n = (k, back, depth), [], []
                words.append(word)
                n.append(m)
        if len(words) > 1:
            yield of(words, n, *key[1:])

    return run


def _at_place(split: DataFrame, head: int) -> DataFrame:
    """Of rows (back, depth, word, n) whose partitions are taken apart after depth code points: the near words that differ in just that code point, of each word
    how many and the most frequent. Words are joined on what is left without it; those of equal rest are as many as there are code points, at most."""
    w, d = F.col("word"), F.col("depth")
    rest = F.concat(w.substr(F.lit(1), d), w.substr(d + 2, F.length("word")))
    without = split.where(F.length("word") > d).select("back", "depth", rest.alias("rest"), "word", "n", w.substr(d + 1, F.lit(1)).alias("c"))
    whole = split.select("back", "depth", F.col("word").alias("rest"), "word", "n", F.lit(None).cast("string").alias("c"))
    true = lambda x: F.when(F.col("back"), F.reverse(x)).otherwise(x)
    left = without.select("back", "depth", "rest", F.col("word").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"))
    right = without.unionByName(whole).select("back", "depth", "rest", F.col("word").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"))
    met = left.join(right, ["back", "depth", "rest"])
    # replaced: the smaller one first; deleted: the last of its run
    follows = F.col("b").substr(d + 1, F.lit(1))
    met = met.where((F.col("ca") < F.col("cb")) | (F.col("cb").isNull() & (F.col("ca") != follows)))
    met = met.select("back", true(F.col("a")).alias("a"), "na", true(F.col("b")).alias("b"), "nb")
    met = met.where(~F.col("back") | (F.substring("a", 1, head) != F.substring("b", 1, head)))
    each = met.select("a", F.col("nb").alias("m"), "b").unionByName(met.select(F.col("b").alias("a"), F.col("na").alias("m"), F.col("a").alias("b")))
    return each.select(F.col("a").alias("word"), F.lit(1).cast("long").alias("n_near"), F.col("m").alias("near_n"), F.col("b").alias("near"))


def near_words(words: DataFrame, head: int = HEAD, most: int = MOST) -> DataFrame:
    """Of distinct words (word, n), those that have near ones: word, n_near, and the near word of largest n, ties to the first in code-point order: near, near_n.
    Words are of 2 * head + 1 code points at least."""
    both = F.explode(F.array(F.struct(F.lit(False).alias("back"), "word"), F.struct(F.lit(True).alias("back"), F.reverse("word").alias("word"))))
    placed, depth, found, begun = words.select("n", both.alias("x")).select("n", "x.*"), head, None, len(MADE)
    while True:
        keyed = placed.withColumn("depth", F.lit(depth)).withColumn("key", F.substring("word", 1, depth))
        counts = keyed.groupBy("back", "key").agg(F.count("*").alias("m"))
        large = written(counts.where(F.col("m") > most).select("back", "key"), "spelling-large")
        last = large.isEmpty()
        small = keyed if last else keyed.join(large, ["back", "key"], "left_anti")
        done = small.repartition("back", "key").sortWithinPartitions("back", "key", "word").select("key", "back", "depth", "word", "n")
        own = done.mapInArrow(_near(head), "word string, n_near bigint, near_n bigint, near string")
        found = own if found is None else found.unionByName(own)
        if last:
            break
        again = written(keyed.join(large, ["back", "key"], "left_semi").select("back", "depth", "word", "n"), "spelling-split")
        found = found.unionByName(_at_place(again, head))
        placed, depth = again.drop("depth"), depth + 1
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")
    out = written(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best), "spelling-near")
    discard(words.sparkSession, MADE[begun:-1])
    del MADE[begun:-1]
    return out.select("word", "n_near", (-F.col("best.m")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """Of forms (word, form), each word's last form: (word, root). Self-joins, doubled; a form is RATIO times as frequent as its word, so that few rounds end it."""
    hops = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        above = hops.select(F.col("word").alias("root"), F.col("root").alias("over"))
        moved = written(hops.join(above, "root", "left").select("word", F.coalesce("over", "root").alias("root"), F.col("over").isNotNull().alias("moved")), "spelling-roots")
        discard(forms.sparkSession, [MADE.pop(-2)])
        hops = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return hops


def variants(docs: DataFrame) -> DataFrame:
    """One row per word of all texts: word, n, n_near, form, form_n and root."""
    words = written(vocabulary(docs), "spelling-words")
    near = words.join(near_words(words), "word", "left")
    formed: Column = F.col("near_n") >= RATIO * F.col("n")
    named = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")), "spelling-forms")
    last = roots(named.where("form IS NOT NULL"))
    return named.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE_SQL = rf"""
WITH RECURSIVE {CRC_SQL},
runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents
), counted AS (
    SELECT doc_id, w, doc_id || ':' || w AS f, count(*) AS n FROM runs WHERE length(w) >= 7 GROUP BY ALL
), hashed AS (
    SELECT w, n, {crc_sql("f")} AS h FROM counted, crc_table
), words AS MATERIALIZED (
    SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, sum(n)::BIGINT AS n
    FROM hashed GROUP BY 1 HAVING sum(n) >= 2 AND length(word) >= 7
), cut AS MATERIALIZED (
    SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS MATERIALIZED (
    SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS form FROM near GROUP BY word
), formed AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN form END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word
), walks AS (
    SELECT word, word AS root FROM formed UNION ALL SELECT w.word, f.form FROM walks w JOIN formed f ON w.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM formed f JOIN walks w ON f.word = w.word JOIN formed g ON w.root = g.word WHERE g.form IS NULL
"""
