"""The quality model's scores and labeller estimates against plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tapeloom.llm import quality_model as q


def share_of_repeats(items):
    return sum(a == b for a, b in zip(items, items[1:], strict=False)) / max(1, len(items))


def bucket(h):
    h = (h ^ (h >> 31)) * 0x9E3779B97F4A7C15 % (1 << 64)
    return h >> 52


def kind(byte):
    c = chr(byte)
    if byte >= 128 or "a" <= c <= "z":
        return 1
    if "A" <= c <= "Z":
        return 2
    if "0" <= c <= "9":
        return 3
    if c in "\t\n\v\f\r ":
        return 0
    return 4 if c in ".,;:'\"()-?" else 5 if c == "!" else 6 if c in "#*$%&|<>" else 7


def score(text, weights, bias, prior):
    if not text or text.isspace():
        return 0.0
    kinds = []
    for byte in text.encode():
        k = kind(byte)
        if not kinds or k > 3 or kinds[-1] != k:
            kinds.append(k)
    kinds = [0, 0, *kinds, 0, 0]
    grams = Counter(bucket(sum(kinds[i + j] * 8**j for j in range(4))) for i in range(len(kinds) - 3))
    odds = bias + sum(weights[b] * math.sqrt(n / (3 * grams.total())) for b, n in grams.items())
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    stutter = share_of_repeats(words)
    repeated = 1 - len(set(lines)) / max(1, len(lines))
    for k, s in enumerate((max(1e-6, 1 - stutter), stutter, max(1e-6, 1 - repeated), repeated)):
        odds += weights[bucket((1 << 20) + k)] * math.sqrt(s / 3)
    trust = min(1.0, len(words) / 20)
    return 1 / (1 + math.exp(-(prior + trust * (odds - prior))))


def test_scores_of_the_small_table(spark):
    rng = np.random.default_rng(2)
    model = q.Scorer(rng.normal(size=q.FEATURES), 0.3, prior=1.1)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, " \n"), (-4, "a"), (-5, "A! A! A!\nA! A! A!\n é #"), (-6, "one " * 3000)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    got = q.scored(docs, model).select("row.*", "score").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["score"] == pytest.approx(score(r["text"], model.weights, 0.3, 1.1), abs=1e-9)


def expectation(patterns, rounds):
    """The same mixture by loops over patterns, components and labellers."""
    n_lab, keys = len(q.LABELLERS), sorted(patterns)
    votes = [[k // 3**j % 3 for j in range(n_lab)] for k in keys]
    share = []
    for v in votes:
        calls = sum(x == q.BAD for x in v)
        bad = 0.9 if calls >= 2 else 0.02
        share.append([1 - bad, *(bad * ((x == q.BAD) / calls if calls else 1 / n_lab) for x in v)])
    for _ in range(rounds):
        weight = [[s * patterns[k] for s in row] for k, row in zip(keys, share, strict=True)]
        whole = sum(patterns.values())
        model = []
        for c in range(n_lab + 1):
            rates = []
            for j in range(n_lab):
                two = [0.05 + sum(w[c] for w, v in zip(weight, votes, strict=True) if v[j] == x) for x in (q.GOOD, q.BAD)]
                rates.append([x / sum(two) for x in two])
            model.append(((sum(w[c] for w in weight) + 0.01) / (whole + 0.01 * (n_lab + 1)), rates))
        share = []
        for v in votes:
            row = [p * math.prod(rates[j][x - 1] for j, x in enumerate(v) if x) for p, rates in model]
            share.append([x / sum(row) for x in row])
    return {k: sum(row[1:]) for k, row in zip(keys, share, strict=True)}


def test_posteriors_by_loops():
    rng, counts = random.Random(8), Counter()
    for _ in range(400):
        bad = rng.random() < 0.2
        v = [rng.choice((0, q.BAD, q.BAD)) if bad and rng.random() < 0.5 else rng.choice((0, q.GOOD, q.GOOD, q.GOOD)) for _ in q.LABELLERS]
        counts[sum(x * 3**j for j, x in enumerate(v))] += 1
    want = expectation(counts, 12)
    got, _ = q.estimate(dict(counts), 12)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
