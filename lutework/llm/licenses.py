"""Licence scans by a positional index of rare template words.

Document frequencies of the words of licence templates, over all documents, give their inverse document frequency. Of each template the words of
highest idf are posted with their places: as many that, whichever of its words a text with LEAST_SCORE of them has, MEETING different ones of the
posted ones are among them, so that no other word needs looking up. Of each text the posted words that it holds are looked up, the highest idf
first; each (word place minus template place) is a relative position at which the template may stand, and a template of which MEETING different
words meet at one relative position, within SLACK words, is laid there: its mandatory key phrases must stand near by, and the share of its words
that do gives the score. Set phrases, sought at every place, label by themselves.

Defined results: words are runs of letters a-z, digits and non-ASCII characters, A-Z lower-cased; null and empty texts have none, no label and
score 0; equal rows get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches
from .licence_texts import TEXTS

#: Phrases that label by themselves.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Words by which relative positions may differ; rare words that must meet.
SLACK, MEETING = 3, 2
#: The share of a template's words that must stand near its place.
LEAST_SCORE = 0.6

_OTHER = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90))
_TABLE = bytes.maketrans(_OTHER + bytes(range(65, 91)), b" " * len(_OTHER) + bytes(range(97, 123)))


def words(text: str | None) -> list[bytes]:
    """The words as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ")


def plain(text: str | None) -> list[bytes]:
    return [w for w in words(text) if w]


def posted_words(template: list[bytes], idf: dict[bytes, float]) -> set[bytes]:
    """The words of highest idf, as many that a text without MEETING different ones of them has less than LEAST_SCORE of the template's words."""
    counts, posted = Counter(template), []
    lacking = len(template) - math.ceil(LEAST_SCORE * len(template))
    for w in sorted(counts, key=lambda w: (-idf.get(w, 0.0), w)):
        posted.append(w)
        most = sorted((counts[x] for x in posted), reverse=True)[: MEETING - 1]
        if sum(counts[x] for x in posted) - sum(most) > lacking:
            break
    return set(posted)


@dataclass
class Index:
    """Postings of the templates' words and what a scan needs beside them."""

    idf: dict[bytes, float]
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    templates: list[tuple[str, list[bytes], list[list[bytes]]]] = field(default_factory=list)
    meeting: list[int] = field(default_factory=list)
    vocabulary: set[bytes] = field(default_factory=set)
    phrases: dict[bytes, list[tuple[list[bytes], str]]] = field(default_factory=lambda: defaultdict(list))

    @classmethod
    def build(cls, idf: dict[bytes, float]) -> Index:
        index = cls(idf)
        for number, (label, text, keys) in enumerate(TEXTS):
            template = plain(text)
            index.templates.append((label, template, [plain(k) for k in keys]))
            posted = posted_words(template, idf)
            index.meeting.append(min(MEETING, len(posted)))
            for at, w in enumerate(template):
                if w in posted:
                    index.postings[w].append((number, at))
        for phrase, label in PHRASES.items():
            index.phrases[plain(phrase)[0]].append((plain(phrase), label))
        index.vocabulary = {w for _, _, keys in index.templates for k in keys for w in k} | set(index.postings)
        index.vocabulary |= {w for some in index.phrases.values() for phrase, _ in some for w in phrase}
        return index

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, list[str], list[str], float]:
        """n_words, n_base, first and last base place, base labels, all labels, score."""
        found = plain(text)
        vocabulary = self.vocabulary & set(found)
        if not vocabulary:
            return len(found), 0, None, None, [], [], 0.0
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(found):
            if w in vocabulary:
                places[w].append(i)
        base, labels = [], set()
        for some in self.phrases.values():
            for phrase, label in some:
                rare = min(range(len(phrase)), key=lambda k: len(places.get(phrase[k], ())))
                for i in places.get(phrase[rare], ()):
                    if i >= rare and found[i - rare : i - rare + len(phrase)] == phrase:
                        base.append(i - rare)
                        labels.add(label)
        own, score = self._templates(found, places)
        return (
            len(found), len(base), min(base, default=None), max(base, default=None), sorted(labels), sorted(labels | own), 1.0 if base else score,
        )

    def _templates(self, found: list[bytes], places: dict[bytes, list[int]]) -> tuple[set[str], float]:
        labels, best = set(), 0.0
        able = {k for k, (_, _, keys) in enumerate(self.templates) if all(w in places for key in keys for w in key)}  # others can't stand
        if not able:
            return labels, best
        cells: dict[tuple[int, int], set[bytes]] = defaultdict(set)
        for w in sorted((w for w in places if w in self.postings), key=lambda w: (-self.idf.get(w, 0.0), w)):
            for number, at in self.postings[w]:
                if number in able:
                    for i in places[w]:
                        cells[number, (i - at) // SLACK].add(w)
        for (number, cell), some in cells.items():
            if len(some | cells.get((number, cell + 1), set())) >= self.meeting[number]:
                label, template, keys = self.templates[number]
                begin, end = cell * SLACK - SLACK, (cell + 2) * SLACK + len(template)
                if all(self._stands(k, found, places, begin, end) for k in keys):
                    near = Counter(found[max(0, begin) : max(0, end)])
                    share = sum((near & Counter(template)).values()) / len(template)
                    best = max(best, share)
                    if share >= LEAST_SCORE:
                        labels.add(label)
        return labels, best

    @staticmethod
    def _stands(phrase: list[bytes], found: list[bytes], places: dict[bytes, list[int]], begin: int, end: int) -> bool:
        rare = min(range(len(phrase)), key=lambda k: len(places.get(phrase[k], ())))
        return any(begin <= i - rare <= end and found[i - rare : i - rare + len(phrase)] == phrase for i in places.get(phrase[rare], ()) if i >= rare)


def document_frequencies(docs: DataFrame) -> tuple[dict[bytes, float], int]:
    """The idf of every template word over all documents, and their number. A row per template word comes back, whatever the input."""
    vocabulary = {w for _, text, _ in TEXTS for w in plain(text)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(vocabulary & set(words(text.as_py())))
                seen[b""] += 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    rows = in_small_batches(docs.select("text")).mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n")).collect()
    n = {w.encode(): c for w, c in rows}
    total = n.pop(b"", 0)
    return {w: math.log((total + 1) / (n.get(w, 0) + 1)) for w in vocabulary}, total


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score."""
    idf, _ = document_frequencies(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.build(idf)
        for batch in batches:
            rows = [index.scan(text.as_py()) for text in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            arrays = [batch.column(0), *[pa.array(columns[k], pa.int64()) for k in range(4)]]
            arrays += [pa.array([",".join(x) for x in columns[k]], pa.string()) for k in (4, 5)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(columns[6], pa.float64())], SCHEMA.replace(",", "").split()[::2])

    return in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, SCHEMA)
