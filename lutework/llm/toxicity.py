"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a text: densities of a fixed lexicon and of one learned from the labelled sample (words and word beginnings that toxic
texts hold far more often), second-person words near lexicon words, capitals, punctuation and obfuscated spellings. The trees are
fitted on a sample of the labelled documents, MAX_SAMPLE at most, taken by the hash of their ids. The calibration is cross-fitted: each half of the
sample is scored by a lexicon and trees that the other half taught, at every size.

Defined results: null and empty texts have all-zero features and are scored like others; a document with several labels is toxic if one is;
labels whose document isn't there and null labels are ignored; where the sample has one class or none, every score is the sample's
share of toxic documents (0 if it is empty); rows with equal ids are scored each by its own text; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_small_batches, row_of, written

#: The most labelled documents that are learned from, the learned lexicon's size and the lengths of word beginnings in it.
MAX_SAMPLE, LEXICON_SIZE, BEGINNINGS = 20_000, 400, (7, 6, 5)
#: Texts whose terms a task counts at a time.
PART = 64
#: General insults in four languages.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown fool freak jerk hate garbage ugly "
    "dummkopf blöd trottel abschaum müll wertlos widerlich versager hässlich arschloch imbécile idiote crétin stupide ordure nul "
    "dégoûtant minable abruti idiota imbécil estúpido basura asqueroso patético inútil tonto payaso".split()
)
SECOND_PERSON = frozenset("you your youre yours u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus usted ustedes".split())
LEET = str.maketrans("013457@$!", "oieastasi")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
MIXED = re.compile(r"[^\W\d_]+(?:[0-9@$!*.\-_]+[^\W\d_]+)+")
N_FEATURES = 14


def weights(found: list[str], lexicon: dict[str, float]) -> list[tuple[int, float]]:
    """The places of words that are in the lexicon, or of which a beginning is, and the greatest weight that applies."""
    heads = {t[: BEGINNINGS[-1]] for t in lexicon}
    out = []
    for i, w in enumerate(found):
        if w[: BEGINNINGS[-1]] in heads:
            x = max([lexicon.get(w, 0.0), *(lexicon.get(w[:k] + "*", 0.0) for k in BEGINNINGS)])
            if x:
                out.append((i, x))
    return out


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features(text: str | None, lexicons: list[dict[str, float]]) -> list[list[float]]:
    """The N_FEATURES measures of one text by each lexicon: weights of learned words, and of word beginnings, marked by a star."""
    if not text or not (found := tokens(text)):
        return [[0.0] * N_FEATURES for _ in lexicons]
    n = len(found)
    hits = [i for i, w in enumerate(found) if w in INSULTS]
    mixed = MIXED.findall(text.lower())
    plain = [(w.translate(LEET), re.sub(r"[^\w]|_", "", w)) for w in mixed]
    letters = sum(map(len, found))
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    before = [math.log1p(n), 100 * len(hits) / n, min(len(hits), 50)]
    after = [upper / letters, 100 * (text.count("!") + text.count("?")) / n, 100 * sum(text.count(x) for x in "!?.,;:") / n, 100 * len(mixed) / n]
    out = []
    for lexicon in lexicons:
        learned = weights(found, lexicon)
        places = {*hits, *(i for i, _ in learned)}
        near = sum(any(w in SECOND_PERSON for w in found[max(0, i - 3) : i + 4]) for i in places)
        hidden = sum(x in INSULTS or p in INSULTS or p in lexicon for x, p in plain)
        own = [
            100 * len(learned) / n, min(len(learned), 50), 100 * sum(x for _, x in learned) / n, max((x for _, x in learned), default=0.0),
            float(len({found[i] for i in places})), 100 * near / n,
        ]
        out.append([*before, *own, *after, float(hidden)])
    return out


def _terms(text: str | None) -> set[str]:
    found = set(tokens(text or ""))
    return found | {w[:k] + "*" for w in found for k in BEGINNINGS if len(w) > k}


def _counted(wanted: frozenset[str] | None):
    """Of (text, half): how many texts of each half hold each term, those of wanted only, if given, by PART texts, so that a task never holds many terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                seen: Counter[tuple[str, int]] = Counter()
                for text, half in zip(batch.column(0).slice(at, PART), batch.column(1).slice(at, PART).to_pylist(), strict=True):
                    terms = _terms(text.as_py())
                    seen.update((t, half) for t in (terms if wanted is None else terms & wanted))
                arrays = [pa.array([t for t, _ in seen], pa.string()), pa.array([h for _, h in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["term", "half", "n"])

    return run


def learn_lexicons(sample: DataFrame, counts: dict[tuple[int, int], int]) -> list[dict[str, float]]:
    """Of a sample (text, toxic, half) with so many rows by (toxic, half), the lexicons that the halves without half 0, without half 1, and the whole teach: the
    LEXICON_SIZE terms with the greatest log odds among those that one toxic text in 200 holds, three at least. These are 200 times the terms of a
    text at most, so that they fit the driver whatever the sample's size; only they are sought in the other texts."""
    sizes = [{t: sum(n for (x, h), n in counts.items() if x == t and h in halves) for t in (0, 1)} for halves in ((1,), (0,), (0, 1))]
    least = [max(3, n[1] // 200) for n in sizes]

    def held(toxic: int, wanted: frozenset[str] | None) -> DataFrame:
        each = sample.where(F.col("toxic") == toxic).select("text", "half").mapInArrow(_counted(wanted), "term string, half int, n bigint")
        part = lambda h: F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0))
        return each.groupBy("term").agg(part(1).alias("n0"), part(0).alias("n1"), F.sum("n").alias("n2"))

    frequent = F.lit(False)
    for k in range(3):
        frequent = frequent | (F.col(f"n{k}") >= least[k])
    bad = {r["term"]: r[1:] for r in held(1, None).where(frequent).collect()}
    good = {r["term"]: r[1:] for r in held(0, frozenset(bad)).collect()}
    out = []
    for k, n in enumerate(sizes):
        odds = {t: math.log((x[k] + 0.5) / (n[1] + 1.0)) - math.log((good.get(t, (0, 0, 0))[k] + 0.5) / (n[0] + 1.0)) for t, x in bad.items() if x[k] >= least[k]}
        out.append(dict(sorted(((t, x) for t, x in odds.items() if x > 2), key=lambda tx: (-tx[1], tx[0]))[:LEXICON_SIZE]))
    return out


def feature_columns(text: Column, lexicons: list[dict[str, float]]) -> Column:
    """An array of features for each lexicon."""

    @F.pandas_udf("array<array<double>>")
    def computed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(t, lexicons))

    return computed(text)


@dataclass
class ToxicityModel:
    """A fitted model; constant stands for it where nothing can be learned."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    constant: float

    def score(self, docs: DataFrame) -> DataFrame:
        """Of docs (text, ...): row, a struct of all its columns, and score from 0 to 1."""
        rows = in_small_batches(docs.select(row_of(docs)))
        if self.trees is None:
            return rows.withColumn("score", F.lit(self.constant))
        raw = self._raw(rows.withColumn("__f", feature_columns(F.col("row.text"), [self.lexicon])[0]))
        return self.calibration.transform(raw).select("row", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "__calibrated")).alias("score"))

    def _raw(self, rows: DataFrame) -> DataFrame:
        scored = self.trees.transform(rows.withColumn("__v", array_to_vector("__f")))
        return scored.withColumn("__raw_score", vector_to_array("__p")[1])


def held_out(doc_id: Column) -> Column:
    """Documents of which no label is learned: the crc32 of the id as text leaves 0 on division by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE, seed: int = 7) -> ToxicityModel:
    """Learns from the labels of documents that aren't held out."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = written(known.orderBy(F.xxhash64("__id", F.lit(seed)), "__id").limit(max_sample), "toxicity-labels")
    # halves, of either class alike; MAX_SAMPLE rows at most are numbered
    halves = chosen.withColumn("half", F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("__id", F.lit(seed + 1)), "__id")) % 2)
    texts = docs.select("doc_id", "text").join(F.broadcast(halves), F.col("doc_id").eqNullSafe(F.col("__id")))
    sample = in_small_batches(written(texts.select("text", "toxic", "half"), "toxicity-sample"))
    counts = {(r[0], r[1]): r[2] for r in sample.groupBy("toxic", "half").count().collect()}
    n_bad, n_good = (sum(n for (t, _), n in counts.items() if t == x) for x in (1, 0))
    if not n_bad or not n_good:
        return ToxicityModel({}, None, None, n_bad / max(1, n_bad + n_good))

    lexicons = learn_lexicons(sample, counts)
    label = F.col("toxic").cast("double").alias("label")
    rows = written(sample.select("half", label, feature_columns(F.col("text"), lexicons).alias("f")), "toxicity-features")

    def learned(part: DataFrame, k: int, bad: int, good: int) -> ToxicityModel:
        if not bad or not good:
            return ToxicityModel({}, None, None, bad / max(1, bad + good))
        known = part.select("label", array_to_vector(F.col("f")[k]).alias("__v"))
        gbt = GBTClassifier(featuresCol="__v", labelCol="label", predictionCol="__c", maxDepth=4, maxIter=20, stepSize=0.2, seed=seed, maxBins=64, checkpointInterval=-1)
        return ToxicityModel(lexicons[k], gbt.fit(known.coalesce(4)).setProbabilityCol("__p").setRawPredictionCol("__r"), None, 0.0)

    # one after another: a fit is hundreds of small jobs, and the driver holds a broadcast's buffer of 4 MB for each of them that is under way
    halves = [learned(rows.where(F.col("half") != h), h, counts.get((1, 1 - h), 0), counts.get((0, 1 - h), 0)) for h in (0, 1)]
    model = learned(rows, 2, n_bad, n_good)
    scored = None
    for h, taught in enumerate(halves):
        other = rows.where(F.col("half") == h).select("label", F.col("f")[h].alias("__f"))
        other = other.withColumn("__raw_score", F.lit(taught.constant)) if taught.trees is None else taught._raw(other)
        other = other.select("label", "__raw_score")
        scored = other if scored is None else scored.unionByName(other)
    isotonic = IsotonicRegression(featuresCol="__raw_score", labelCol="label", predictionCol="__calibrated")
    model.calibration = isotonic.fit(written(scored, "toxicity-scored"))
    return model


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted."""
    scored = fit(docs, labels).score(docs.select("doc_id", "text"))
    return scored.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below 0.5."""
    return fit(docs, labels).score(docs).where("score < 0.5").select("row.*")
