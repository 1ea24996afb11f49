import corpus_pipeline
from tapeloom.llm import substrings


def test_only_repeated_passages_go(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    clean = "A line.\n\n  Another\tline, as it was.\n"
    rows = [(1, clean), (2, f"first\nx {passage}\nlast  line"), (3, f"{passage} \n\nä end"), (4, None), (5, " \n")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t) if t else None) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    want = {1: clean, 2: "first\nx \nlast  line", 3: " \n\nä end", 4: None, 5: " \n"}
    assert got == {k: (t, len(t) if t else None) for k, t in want.items()}


def test_cuts():
    assert substrings.less("a b  c d", [(0, 1), (2, 3)]) == " b   d"
    assert substrings.less(" a b ", [(0, 2)]) == "  "
