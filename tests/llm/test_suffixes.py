"""Repeated byte strings against all windows of all texts."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import suffixes

SCHEMA = "doc_id long, text string, spans int, lang string"


def brute(texts, least):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + least] for d in data for i in range(len(d) - least + 1))
    out = []
    for i, d in enumerate(data):
        gone = np.zeros(len(d) + 2, bool)
        for at in range(len(d) - least + 1):
            if seen[d[at : at + least]] > 1:
                gone[at + 1 : at + 1 + least] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2).tolist()
        out.append((i, len(d), edges, int(gone.sum()), bytes(c for c, g in zip(d, gone[1:], strict=False) if not g)))
    return out


def found(spark, texts, least):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    return sorted((r["doc_id"], r["n_bytes"], [list(s) for s in r["spans"]], r["n_removed"], bytes(r["kept"])) for r in suffixes.without_repeats(docs, least).collect())


def texts_of(seed, least):
    rng = random.Random(seed)
    make = lambda n, of="abcdefgh éß": "".join(rng.choice(of) for _ in range(n))
    shared, line = make(3 * least), make(least + 3)
    texts = [make(rng.randint(0, 5 * least)) for _ in range(25)]
    texts += [make(rng.randint(0, least)) + shared[: rng.randint(least // 2, 3 * least)] + make(rng.randint(0, least)) for _ in range(15)]
    texts += [make(least // 3) + line + make(least // 3) for _ in range(30)]
    near = make(6 * least)
    texts += [near, near, near[:-1], near[: 2 * least] + "#" + near[2 * least + 1 :], near[: 3 * least] + near[3 * least + 1 :]]
    texts += ["z" * (3 * least), "z" * least, "z" * (least - 1), "ab" * (2 * least), None, "", shared[:least], shared[1 : least + 1]]
    return texts


@pytest.mark.parametrize("least", [200, 40, 9])
def test_equals_all_windows(spark, least):
    texts = texts_of(least, least)
    assert found(spark, texts, least) == brute(texts, least)


def test_few_letters(spark):
    """Many equal windows at every place: overlaps, ties between anchors, one anchor for nearly all."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    assert found(spark, texts, 12) == brute(texts, 12)


def test_runs_cover_all_windows(monkeypatch):
    """Pieces of long texts give the runs of the whole, and equal windows have equal anchors."""
    rng = random.Random(4)
    data = bytes(rng.choice(b"abc") for _ in range(5000)) + b"a" * 700 + bytes(rng.choice(b"abcdefgh") for _ in range(900))
    whole = [x.tolist() for x in suffixes.runs(data, 50)]
    monkeypatch.setattr(suffixes, "PIECE", 333)
    assert [x.tolist() for x in suffixes.runs(data, 50)] == whole
    anchor, place, first, last = whole
    assert first[0] == 0 and last[-1] == len(data) - 50 and all(b + 1 == a for a, b in zip(first[1:], last, strict=False))
    at = {}
    for v, p, a, b in zip(anchor, place, first, last, strict=True):
        for i in range(a, b + 1):
            assert i <= p <= i + 50 - suffixes.GRAM
            assert at.setdefault(data[i : i + 50], (v, p - i)) == (v, p - i)


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffixes.without_repeats(empty, 20).collect() == []
    row = "".join(chr(97 + i * i % 23) for i in range(50))
    docs = spark.createDataFrame([(1, row, 1, "x"), (1, row, 1, "x"), (None, "q" * 10 + row[:30], 1, "x"), (None, None, 1, "x")], SCHEMA)
    got = Counter((r["doc_id"], r["n_removed"]) for r in suffixes.without_repeats(docs, 20).select("doc_id", "n_removed", F.lit(1)).collect())
    assert got == {(1, 50): 2, (None, 30): 1, (None, 0): 1}


def test_a_full_filter_only_lets_more_through(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "FILTER_BITS", 1 << 15)
    texts = texts_of(7, 40)
    assert found(spark, texts, 40) == brute(texts, 40)
    anchors = spark.createDataFrame([(0,), (-1,), (1 << 49,), (1 << 62,)], "anchor long")
    bits = np.unpackbits(np.frombuffer(suffixes.filter_of(anchors), np.uint8), bitorder="little")
    assert np.flatnonzero(bits).tolist() == [0, 1, 1 << 13, (1 << 15) - 1]
