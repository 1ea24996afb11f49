import random

import numpy as np
import pytest

from tapeloom.llm import quality_model

from test_operators import prose


@pytest.mark.parametrize("head", ["\n" * 3000, " " * 3000, "x" * 3000 + " "])
def test_trust_counts_the_words_of_the_whole_text(head):
    model = quality_model.Scorer(np.zeros(quality_model.FEATURES), -4.0, prior=3.0)
    words = "word " * 1000
    assert model.score(head + words) == model.score(words) < 0.5
    assert model.score("word " * 20) == model.score(words) and model.score("word " * 19) > model.score(words)
    assert model.score("word") > 0.5


def test_copies_do_not_shrink_the_sample(spark, monkeypatch):
    rng, seen = random.Random(4), []
    texts = [prose(rng, 12) for _ in range(200)]
    monkeypatch.setattr(quality_model, "train", lambda rows, good: seen.append(len(rows)))
    for copies in (1, 20):
        docs = spark.createDataFrame([(t,) for t in texts * copies], "text string")
        quality_model.fit(docs, fit_rows=100)
    assert seen[0] == seen[1] and 70 < seen[1] < 130
