"""Rows that the corpus operators make on their way must follow the input."""

import random
import time
from itertools import combinations

from lutework.llm import nearcopies, toxicity


def test_pairs_of_unlike_texts_that_share_passages_are_told_apart_before_they_are_made(spark, monkeypatch):
    rng = random.Random(3)
    passages = [" ".join(str(rng.random()) for _ in range(120)) for _ in range(8)]
    texts = [" ".join(passages[k] for k in chosen) for chosen in combinations(range(8), 5)]  # three or four passages of five in common: a similarity of two thirds at most
    texts += [texts[0] + f" end {k}" for k in range(3)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made, blocks = spark.sparkContext.accumulator(0), nearcopies._blocks

    def counted(batches):
        for batch in blocks(batches):
            made.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(nearcopies, "_blocks", counted)
    assert {r.doc_id for r in nearcopies.keep_one(frame).collect()} == set(range(56))
    assert made.value < 1000


def test_toxicity_fits_one_model_at_a_time(spark, monkeypatch):
    now, most, fits, fit = [], [], [], toxicity.GBTClassifier.fit

    def watched(self, df):
        now.append(1)
        most.append(len(now))
        time.sleep(0.2)
        try:
            fits.append(fit(self.setMaxIter(2), df))
        finally:
            now.pop()
        return fits[-1]

    monkeypatch.setattr(toxicity.GBTClassifier, "fit", watched)
    texts = [(i, "you are an idiot and scum" if i % 2 else f"the meadow {i} is green") for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    found = toxicity.report(spark.createDataFrame(texts, "doc_id long, text string"), labels).collect()
    assert len(found) == 80 and sum(x["predicted"] == x["doc_id"] % 2 for x in found) >= 76
    assert len(fits) == 3 and max(most) == 1
