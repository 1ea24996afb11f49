"""Phrases against plain counts: whole results, seams between blocks, and the sketch's bound."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tapeloom.llm import phrases

SCHEMA = "doc_id long, text string, lang string, rank int, phrase string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def grams(rows):
    """lang -> counts of word tuples."""
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered(text or "")):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    return f


def brute(rows, least, percent, most):
    out = []
    for lang, f in grams(rows).items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((score, a, " ".join(p), left, right))
        kept.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, left, right, n, s) for i, (s, a, p, left, right) in enumerate(kept[:most], 1)]
    return sorted(out)


def found(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, lang, 7, "x") for i, (lang, t) in enumerate(rows)], SCHEMA)
    return sorted(map(tuple, phrases.collocations(docs, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_equals_plain_counts(spark):
    rng = random.Random(3)
    words = ["a", "B", "b", "c", "Ärger", "ärger", "x y", "d e", "\x00", "zz"]
    rows = [(rng.choice(["en", "en", "en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", "\n", "\x0b"]) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    rows += [("en", None), (None, ""), ("fr", " .. \n"), ("en", "New York city " * 50), *[("es", "uno dos tres.")] * 12, *[("es", "dos tres cuatro")] * 14]
    for least, percent, most in ((3, 50, 2000), (10, 90, 5)):
        assert found(spark, rows, least=least, percent=percent, most=most) == brute(rows, least, percent, most)


def test_no_words(spark):
    assert found(spark, []) == []
    assert found(spark, [("en", None), (None, "...")]) == []


def test_scores_are_exact_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", "a", 1, 3_000_000_019), ("en", "b", 1, 3_000_000_077), ("en", "a b", 2, 3_000_000_001)], "lang string, phrase string, words int, f long")
    a, left, right = 3_000_000_001, 3_000_000_019, 3_000_000_077
    assert [r["score"] for r in phrases.scored(counts).collect()] == [10**6 * a * a // (left * right)]


def test_blocks_meet_at_their_seams():
    texts = [b"a b c d e f g a b c", b"b c d, a b c", b"", b"a"] * 9
    for most_words, most_held in ((3, 10), (7, 100), (1000, 10_000)):
        counts = phrases._Counts(most_words, most_held)
        got = Counter()
        pieces = [*counts.add("en", texts[:20]), *counts.add("en", texts[20:]), *counts.flush()]
        for _, keys, n, words, _ in pieces:
            for key, m in zip(keys.tolist(), n.tolist(), strict=True):
                ids = [key >> 42, key >> 21 & phrases._ID, key & phrases._ID]
                got[tuple(words[i].decode() for i in ids if i)] += m
        assert got == grams([("en", t.decode()) for t in texts])["en"]


def test_sketch_is_never_too_low(spark):
    """A sketch with far too few cells only lets more through."""
    rng = random.Random(5)
    rows = [("en", " ".join(rng.choice("abcdefghij") + rng.choice("klmn") for _ in range(40))) for _ in range(50)]
    df = spark.createDataFrame(rows, "lang string, text string").select("lang", F.col("text").cast("binary").alias("text")).repartition(3)
    width = 1 << 8
    sketch = [phrases._unpacked(x) for x in phrases.merged_sketch(df, width)]
    for _, keys, n, _, h in phrases._counted(df.toArrow().to_batches()):
        for row in range(phrases.DEPTH):
            assert (sketch[row][phrases._cells(h, row, width)] >= np.minimum(n, phrases.FULL)).all()


def test_large_languages_are_ranked_in_parts(spark):
    rows = spark.range(5000).select(F.lit("en").alias("lang"), (F.col("id") % 7).alias("s"), F.format_string("%05d", "id").alias("p"))
    got = phrases.top(rows, "lang", [F.col("s").desc(), F.col("p")], 900, F.xxhash64("p")).orderBy("rank").collect()
    want = sorted(((r % 7, f"{r:05d}") for r in range(5000)), key=lambda x: (-x[0], x[1]))[:900]
    assert [(r["s"], r["p"]) for r in got] == want and [r["rank"] for r in got] == list(range(1, 901))


def test_a_full_row_is_two_counters_a_byte():
    """Counters that share a byte rise apart and stay at the top; blocks' seams and repeats of a cell lose nothing."""
    width, rng = 1 << 4, np.random.default_rng(2)
    h, counts = rng.integers(0, 1 << 63, 500, dtype=np.uint64), rng.integers(1, 4, 500)
    for upto in (3, 40, 500):
        held = np.zeros(width // 2, np.uint8)
        phrases._raise(held, h[:upto], counts[:upto], 1, width, block=7)
        want = np.bincount(phrases._cells(h[:upto], 1, width), counts[:upto], width)
        assert (phrases._unpacked(held.tobytes()) == np.minimum(want, phrases.FULL)).all()


def test_a_task_holds_its_sketch_and_little_more():
    """Of the largest width, 64 MB of counters; 128 MB and large copies of the hashes before."""
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(40_000)}" for _ in range(2_000)).encode() for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    tracemalloc.start()
    try:
        phrases._filled([batch], phrases.MOST_CELLS)
        assert tracemalloc.get_traced_memory()[1] < 190 << 20
    finally:
        tracemalloc.stop()
