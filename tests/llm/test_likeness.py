import random

import corpus_pipeline
import pytest

from tapeloom.llm import likeness


def five(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_by_force(rows):
    """The smallest id of each class, by comparing all pairs."""
    sets, up = [five(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[find(i)] = min(k, low.get(find(i), k))
    return sorted(low.values())


@pytest.mark.parametrize("few", [likeness.FEW, 1])
def test_the_stage_drops_near_copies(spark, few, monkeypatch):
    """Against all pairs, with buckets compared directly and by their members' differences from a pivot."""
    monkeypatch.setattr(likeness.like_classes, "__defaults__", (80, few))
    r = random.Random(3)
    rows = []
    for g in range(12):
        base = [f"w{r.randrange(500)}" for _ in range(60 + 40 * (g % 4))]
        rows.append(" ".join(base))
        for edits in (0, 1, 1, 2, 3, 5, 9):
            copy = base[:]
            for _ in range(edits):
                copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
            rows.append(" ".join(copy))
    base = [f"w{r.randrange(500)}" for _ in range(70)]
    for _ in range(60):  # one large group, edited with few words at few places, so that edits meet
        copy = base[:]
        for _ in range(r.randrange(7)):
            copy[7 * r.randrange(10)] = f"y{r.randrange(3)}"
        rows.append(" ".join(copy[: r.randrange(50, 71)]))
    rows += ["one two three", "One two  three", "one two four", " \n", None, "a b c d e f", "a b c d e g"]
    rows = [(k, t) for k, t in enumerate(rows)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(x["doc_id"] for x in out.collect()) == kept_by_force(rows)


def test_copies_of_a_row_stay_once(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, "d e f"), (2, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert sorted(x["text"] + str(x["doc_id"]) for x in likeness.one_of_each(docs).collect()) == ["a b c2", "d e fNone"]


def test_ring_chains_find_near_copies_without_bands(spark, monkeypatch):
    """op1's fingerprints of five-word shingles find copies at 4 bits or fewer, each link checked in full; the bands find nothing here."""
    r = random.Random(8)
    rows = []
    for _ in range(6):
        base = [f"w{r.randrange(10**6)}" for _ in range(400)]
        rows += [" ".join(base), " ".join([*base[:399], "end"]), " ".join([*base[:200], *(f"z{r.randrange(10**6)}" for _ in range(200))])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    nodes = likeness.with_nodes(docs, "text", ["doc_id"]).select("node", "fp")
    assert likeness.ring_pairs(nodes).count() == 6
    monkeypatch.setattr(likeness, "with_nodes", lambda rows, *a, _real=likeness.with_nodes: _real(rows, *a).withColumn("bands", likeness.F.slice("bands", 1, 0)))
    assert sorted(x["doc_id"] for x in likeness.one_of_each(docs).collect()) == kept_by_force(list(enumerate(rows)))
