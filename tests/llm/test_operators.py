"""The operators against brute force, and their defined results for odd input."""

import collections
import hashlib
import math
import random
import re
import struct
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeloom.llm import fingerprints, languages, packing, pieces, quality_model, quality_rules, sharding, simhash, substrings, warc
from tapeloom.llm import common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, length int, row string, id int, fp string, words string, kept string, score string"
WORD = r"[^\x20\x09-\x0D]+"


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, nulls, blanks, ties, repeated rows, a long text, and columns with clashing names."""
    rng = random.Random(5)
    base, passage = prose(rng, 300), prose(rng, 60)
    texts = [base] * 3
    for _ in range(12):
        w = base.split()
        w[rng.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += [f"{prose(rng, 40)} {passage} {prose(rng, rng.randrange(40))}" for _ in range(8)]
    texts += [prose(rng, rng.randrange(1, 120)) for _ in range(15)]
    texts += ["", " \n\t ", None, "One", "one", "x y z", "Ünï cöde ﬁ 東京 🎈 word", "a b c a b c a b c", "line one\nline one\nline two", "!!! ### $$$", prose(rng, 3000), prose(rng, 35), "é", "é"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 7 == 0 else f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], (None, base, None, None), (None, None, "fr", "s1"), (None, prose(rng, 50), "fr", "s1"), (4, "another text with a used id", "en", "s0")]
    return [(*r, None if r[1] is None else len(r[1]), 9, 9, "r", 9, "f", "w", "k", "s") for r in rows]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(*xs):
    return tuple((x is None, x) if not isinstance(x, float) else (False, x) for x in xs)


def simhash_slow(text):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, linked):
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(values))]


def test_simhash(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fps = [simhash_slow(t) for _, t in rows]
    roots = classes(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    low = {}
    for (i, _), r in zip(rows, roots, strict=True):
        low[r] = i if low.get(r) is None else low[r] if i is None else min(i, low[r])
    want = sorted(key(i, f"{f:016x}", low[r]) for (i, _), f, r in zip(rows, fps, roots, strict=True))
    got = sorted(key(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def cloud(rng, n, bits=24, most=7):
    c, out = rng.getrandbits(64), set()
    while len(out) < n:
        y = c
        for b in rng.sample(range(bits), rng.randrange(most)):
            y ^= 1 << b
        out.add(y)
    return out


@pytest.mark.parametrize("direct", [simhash.DIRECT, 12])
def test_near_classes_of_a_chain_and_a_cloud(spark, direct):
    """Chains of four-bit steps, and a cloud around one value: no link is lost, whatever the size of a bucket."""
    rng = random.Random(2)
    values = set()
    x = rng.getrandbits(64)
    for _ in range(40):
        for b in rng.sample(range(64), 4):
            x ^= 1 << b
        values.add(x)
    values |= cloud(rng, 150) | cloud(rng, 60, 64, 9)
    values |= {rng.getrandbits(64) for _ in range(200)}
    values = sorted(values)
    roots = classes(values, lambda a, b: (a ^ b).bit_count() <= 4)
    rows = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    got = {r["node"]: r["component"] for r in simhash.near_classes(rows, direct=direct).collect()}
    parts = collections.defaultdict(set)
    for v, r in zip(values, roots, strict=True):
        parts[r].add(simhash.signed(v))
    for p in parts.values():
        assert {got.get(v, v) for v in p} == {min(p)}


def test_joined_rows_of_a_cloud_grow_in_proportion(spark, monkeypatch):
    rows, write = collections.Counter(), simhash.written

    def counted(df, label):
        out = write(df, label)
        rows[size] += out.count()
        return out

    monkeypatch.setattr(simhash, "written", counted)
    for size in (1_500, 4_500):
        values = cloud(random.Random(4), size, 40, 8)
        simhash.near_classes(spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")).count()
    assert rows[4_500] < 4 * rows[1_500]


def test_one_of_each(docs):
    near = simhash.near_duplicates(docs)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == near.select("component").distinct().count()


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def test_ring_chain_never_loses_a_link(spark):
    """Two close values share, at each depth, a slot that continues one they share at the depth before."""
    rng = random.Random(1)
    pairs = []
    for _ in range(300):
        a = b = rng.getrandbits(64)
        for bit in rng.sample(range(64), rng.randrange(5)):
            b ^= 1 << bit
        pairs.append((a, b))
    slots = {depth: simhash.ring_slots(4, depth) for depth in (2, 3, 4)}
    starts = spark.createDataFrame([(simhash.signed(a), simhash.signed(b), i) for a, b in pairs for i in range(5)], "a long, b long, i int")
    holds = starts.where(simhash.chain_holds(F.col("a"), F.col("b"), F.col("i"), 4)).collect()
    assert {(r["a"], r["b"]) for r in holds} == {(simhash.signed(a), simhash.signed(b)) for a, b in pairs}
    for a, b, i in map(tuple, holds):
        shared = {-1}
        for depth in (2, 3, 4):
            shared = {k for k, (start, mask, up) in enumerate(slots[depth]) if start == i and (a ^ b) & mask == 0 and (up in shared or depth == 2)}
            assert shared


PAGES = "page_id long, url string, html string, digest string, id int, n int"


def pages():
    big, small = "<p>" + "é" * 120, "<p>tiny</p>"
    rows = [(5, "http://a/ b\r\nX: y", big), (3, None, big), (9, "u", big), (3, "again", big), (1, "u", small), (2, "u", small), (4, "u", None), (6, "u", ""), (None, "u", big), (None, "u", "only " + big), (8, "u", "WARC/1.1\r\n\r\n" * 30), (7, "u", "z" * 300_000)]
    return [(*r, "d", 1, 1) for r in rows]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(pages(), PAGES).repartition(3)
    got = sorted(key(*r) for r in warc.archived(df).collect())
    first = {}
    for i, _, h, *_ in pages():
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h, *_ in pages():
        b = (h or "").encode()
        to = first.get(h) if len(b) >= 100 and first.get(h) != i else None
        want.append(key(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if to is not None else "response", to))
    assert got == sorted(want)
    assert warc.archived(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_seek(spark, tmp_path):
    rows = [(i, "http://x/", f"<p>{i}</p>" * 50) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    index = warc.write_archive(df, f"file://{tmp_path}/a", frame_bytes=4096)
    wanted = spark.createDataFrame([(7,), (33,)], "id long")
    got = {r["id"]: bytes(r["payload"]).decode() for r in warc.lookup(index, f"file://{tmp_path}/a", wanted).collect()}
    assert got == {7: rows[7][2], 33: rows[33][2]}
    bundle = next((tmp_path / "a").glob("*.zst"))
    frames = warc.seek_table(f"file://{bundle}")
    data = bundle.read_bytes()
    assert len(frames) > 5 and data[-4:] == struct.pack("<I", warc.SEEKABLE)
    # Any reader of the format sees one stream: skippable frames are passed over.
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read(-1) for _ in (0,))
    assert len(whole) == sum(f[2] for f in frames)


def canon(t):
    """Compatibility caseless matching by its definition in the Unicode standard, and the white space."""
    t = unicodedata.normalize("NFD", t or "").casefold()
    t = unicodedata.normalize("NFKD", t).casefold()
    return re.sub(r"[\s\x85]+", " ", unicodedata.normalize("NFKC", t)).strip(" ")


def test_fingerprints(docs, none):
    got = fingerprints.fingerprinted(docs).collect()
    by = collections.defaultdict(set)
    for r, t in zip(sorted(got, key=lambda r: key(r["doc_id"])), sorted(docs.select("doc_id", "text").collect(), key=lambda r: key(r["doc_id"])), strict=True):
        by[r["doc_id"]].add(r["fingerprint"])
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id is not null and doc_id != 4").collect()}
    for a in texts:
        for b in texts:
            assert (by[a] == by[b]) == (canon(texts[a]) == canon(texts[b])), (a, b)
    assert fingerprints.fingerprinted(none).count() == 0 and fingerprints.edited(none).count() == 0


def test_folding(spark):
    alike = [["Straße  am\u2028See", "STRASSE AM SEE", "strasse\u00a0am\u0085see "], ["ΟΔΟΣ", "οδος", "οδοσ"], ["ﬁne", "FINE"], ["\u1680", "\u3000\t", "", None]]
    rows = [(k, t) for k, texts in enumerate(alike) for t in texts]
    got = fingerprints.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id").agg(F.collect_set("fingerprint").alias("f")).collect()
    assert all(len(r["f"]) == 1 for r in got) and len({r["f"][0] for r in got}) == len(alike)


def test_folding_is_closed(spark):
    """Every letter with a case or a compatibility form, alone and with marks: all its cases are one document."""
    letters = [chr(c) for c in range(0x250000 >> 4) if not 0xD800 <= c < 0xE000 and (chr(c).lower() != chr(c) or chr(c).upper() != chr(c) or unicodedata.normalize("NFKC", chr(c)) != chr(c)) and unicodedata.category(chr(c)) != "Cn"]
    letters += [c + m for c in ("ι", "Ϊ", "ΐ", "ǰ", "J", "ß", "İ", "ŉ", "ᾳ") for m in ("\u0301", "\u030c", "\u0345", "\u0307\u0323")]
    rows = [(k, t) for k, c in enumerate(letters) for t in {c, c.upper(), c.lower(), c.casefold(), *(unicodedata.normalize(f, c) for f in ("NFC", "NFD", "NFKC", "NFKD"))}]
    df = spark.createDataFrame([*rows, (-1, "ΐ"), (-1, "\u03aa\u0301")], "doc_id long, text string").withColumn("c", fingerprints.canonical(F.col("text")))
    got = collections.defaultdict(set)
    for r in df.collect():
        got[r["doc_id"], canon(r["text"])].add(r["c"])
        assert r["c"] == canon(r["text"]), (r["text"], r["c"])
    assert all(len(x) == 1 for x in got.values()) and len(got) > 2500
    assert len({f for (k, _), v in got.items() if k == -1 for f in v}) == 1


@pytest.mark.parametrize("bits", [128, 4])
def test_edited(docs, bits, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 7)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is None, 0 if r[0] is None else -r[0], [-ord(c) for c in r[1]] + [1]))
    got = collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in fingerprints.edited(docs, bits=bits).collect())
    want = collections.Counter()
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        m = len(t) // 3
        e = t[: len(t) - m] + nxt[:m]
        want[(i, len(t), hashlib.sha256(e.encode()).hexdigest(), float(canon(e) == canon(t)), float(canon(nxt) == canon(t)))] += 1
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 9, 10, 50])
def test_cuts_below(spark, n):
    cuts = [3 * k + 1 for k in range(n)]
    got = spark.range(-2, 3 * n + 4).select("id", fingerprints.cuts_below(F.col("id"), cuts).alias("k")).collect()
    assert all(r["k"] == sum(c < r["id"] for c in cuts) for r in got)


def test_clashes_are_told_apart(docs):
    few = fingerprints.fingerprinted(docs, bits=4).join(docs.select("doc_id", "text"), "doc_id").where("doc_id != 4")
    by = collections.defaultdict(set)
    for r in few.collect():
        by[r["fingerprint"]].add(canon(r["text"]))
    assert all(len(v) == 1 for v in by.values()) and len(by) > 16


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces(docs, none):
    lib = pieces.encoder(MODEL).lib
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = sorted(key(i, len(ids := lib.encode(t)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode() if ids else b"").hexdigest(), True) for i, t in rows)
    assert sorted(key(*r) for r in pieces.round_trip(docs, MODEL).collect()) == want
    for r in pieces.encode_documents(docs, MODEL).join(docs.select("doc_id", "text"), "doc_id").where("doc_id = 49").collect():
        data = r["text"].encode()
        assert b"".join(data[a:b] for a, b in zip(r["begins"], r["ends"], strict=True)) == data
    assert pieces.round_trip(none, MODEL).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab ▁\n\t.é東🎈́"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_encoder_is_the_library(t):
    e = pieces.encoder(MODEL)
    ids = e.lib.encode(t)
    got, joined, src = e.encode([t])[0]
    assert e.safe and (got, joined) == (ids, ",".join(map(str, ids)))
    begins, ends = e.spans(ids, src)
    data = t.encode()
    assert b"".join(data[a:b] for a, b in zip(begins, ends, strict=True)) == data


def test_long_chunks_merge_alike(monkeypatch):
    e = pieces.encoder(MODEL)
    words = ["▁" + "internationalisation" * k + "東京é🎈" for k in (1, 3, 9)]
    short = [e.merged(w) for w in words[:1]] + [e.lib.encode(w[1:]) for w in words[1:]]
    monkeypatch.setattr(pieces, "SCANNED", 0)
    assert [e.merged(w) for w in words] == short


@pytest.fixture(scope="module")
def mapped(tmp_path_factory):
    """The model with a compiled character map in front, and squeezed spaces."""
    import sentencepiece as spm
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto, rules = pb.ModelProto(), pb.ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    rules.ParseFromString(spm.SentencePieceNormalizer(rule_name="nmt_nfkc_cf").serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path_factory.mktemp("model") / "mapped.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aB ﬁ½Ⅷ\n　ß́é"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_encoder_with_a_character_map(mapped, t):
    e = pieces.encoder(mapped)
    assert e.safe and e.normalize.map.units
    ids, _, src = e.encode([t])[0]
    assert ids == e.lib.encode(t)
    begins, ends = e.spans(ids, src)
    assert (begins <= ends).all() and (begins[1:] >= begins[:-1]).all() and (not ids or ends[-1] <= len(t.encode()))


def test_spans_through_a_character_map(mapped):
    e = pieces.encoder(mapped)
    text = "ＡＢＣ ½ ﬁne"
    ids, _, src = e.encode([text])[0]
    begins, ends = e.spans(ids, src)
    data = text.encode()
    by_piece = {e.lib.id_to_piece(k).lstrip("▁"): data[a:b].decode() for k, a, b in zip(ids, begins, ends, strict=True) if e.lib.id_to_piece(k).isalpha() or "▁" in e.lib.id_to_piece(k)}
    assert e.lib.decode(ids) == "abc 1⁄2 fine" and "".join(by_piece.values()).replace(" ", "").startswith("ＡＢＣ")


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_normaliser_is_the_library(rule):
    import sentencepiece as spm
    from sentencepiece import sentencepiece_model_pb2 as pb

    lib = spm.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=True)
    proto = pb.ModelProto()
    proto.ParseFromString(lib.serialized_model_proto())
    own = pieces.Normalizer(proto.normalizer_spec.precompiled_charsmap, False, True, False)
    for t in ["", "plain", "ﬁ ½ ＡＢＣ  ｱﾞ", "  lead  and\ttail  ", "é Ⅷ ㌔​ x", "ß ẞ Σς"]:
        text, src = own(t)
        assert text == lib.normalize(t)
        assert len(src) == len(text.encode()) + 1 and (np.diff(src) >= 0).all()


def model_text(rng, lang, n):
    own = {"en": "the of and tion ing ed er", "de": "der und sch ung keit lich ein", "xx": "zq qx vv kj jq xz qk"}[lang].split()
    return " ".join("".join(rng.choice(own) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_languages(spark, docs, none):
    rng = random.Random(3)
    rows = [(i, model_text(rng, lang, 60), lang) for i, lang in enumerate(["en", "de", "xx"] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = languages.learn(df)
    fresh = [(i, model_text(rng, lang, 40), lang) for i, lang in enumerate(["en", "de", "xx"] * 20)]
    got = {r["doc_id"]: r for r in languages.identify(spark.createDataFrame(fresh, "doc_id long, text string, lang string"), m).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in fresh) == len(fresh)
    name, share, mix = m.infer(model_text(rng, "en", 70) + " " + model_text(rng, "de", 30))
    assert name == "en" and set(mix) == {"en", "de"} and 0.55 < share < 0.85
    assert m.infer(None)[0] == m.infer("")[0] == m.infer("12 !! 🎈")[0] == "und"
    odd = languages.identify(docs, m, ["doc_id"]).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    empty = languages.learn(none)
    assert {r["lang_pred"] for r in languages.identify(docs, empty).collect()} == {"und"} and languages.identify(none, empty).count() == 0


def test_a_model_does_not_depend_on_the_other_languages(spark, monkeypatch):
    rng = random.Random(4)
    few = [(i, model_text(rng, lang, 60), lang) for i, lang in enumerate(["en", "de"] * 20)]
    many = few + [(100 + i, chr(0x4E00 + i) * 3, f"l{i}") for i in range(300)]
    a, b = (languages.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")) for rows in (few, many))
    assert a.bits == b.bits and len(b.names) == 302
    assert all((a.model[:, a.names.index(x)] == b.model[:, b.names.index(x)]).all() for x in ("en", "de"))
    assert all(m.infer(model_text(rng, x, 70))[0] == x for m in (a, b) for x in ("en", "de"))
    monkeypatch.setattr(languages, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError, match="languages"):
        languages.learn(spark.createDataFrame(few, "doc_id long, text string, lang string"))


def test_mixtures_against_plain_loops():
    """The shares, their likelihood and the set that is left, by loops over every n-gram."""
    rng = random.Random(9)
    names, bits = ["a", "b", "c", "d"], 6
    counts = np.array([[rng.randrange(0, 30) for _ in range(1 << bits)] for _ in names], float)
    m = languages.Mixtures(names, counts, bits)
    rates = [[(c + 0.5) / sum(x + 0.5 for x in row) for c in row] for row in counts.tolist()]

    def fit(grams, active, share):
        for _ in range(m.rounds if len(active) > 1 else 0):
            new = [0.0] * len(active)
            for g in grams:
                p = [s * rates[k][g] for k, s in zip(active, share, strict=True)]
                new = [x + y / sum(p) for x, y in zip(new, p, strict=True)]
            share = [x / len(grams) for x in new]
        share = share if len(active) > 1 else [1.0]
        return share, sum(math.log(sum(s * rates[k][g] for k, s in zip(active, share, strict=True))) for g in grams)

    for n in (1, 5, 30, 200):
        text = " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(n))
        grams = np.concatenate(list(languages.hashed_ngrams(text, bits))).tolist()
        active = list(range(len(names)))
        share, value = fit(grams, active, [1 / len(names)] * len(names))
        cost = m.penalty * math.log(max(2.0, len(grams)))
        best = value - cost * len(active)
        while len(active) > 1:
            weak = share.index(min(share))
            rest, start = active[:weak] + active[weak + 1 :], share[:weak] + share[weak + 1 :]
            less, value = fit(grams, rest, [s / sum(start) for s in start])
            if value - cost * len(rest) < best:
                break
            active, share, best = rest, less, value - cost * len(rest)
        name, top, mixture = m.infer(text)
        assert set(mixture) == {names[k] for k in active} and abs(top - max(share)) < 1e-3
        assert all(abs(mixture[names[k]] - s) < 1e-3 for k, s in zip(active, share, strict=True))


def grams_slow(text):
    """The n-grams by the definition, one after another."""
    kept = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()))
    kept = f" {kept} "
    return collections.Counter(kept[i : i + 3] for i in range(len(kept) - 2))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abΣ 1\n.éß東"), st.characters(exclude_categories=["Cs"])), max_size=40), st.integers(1, 9))
def test_language_blocks_count_alike(t, block):
    whole = collections.Counter(np.concatenate(list(languages.hashed_ngrams(t, 20))).tolist())
    assert whole == collections.Counter(np.concatenate(list(languages.hashed_ngrams(t, 20, block=block))).tolist())
    assert sorted(whole.values()) == sorted(grams_slow(t).values())


def test_languages_against_brute_force(spark):
    """Counts of 600 languages by the definition, each text found again, whatever the size of a block."""
    rng = random.Random(8)
    rows = [(i, f"{chr(0x4E00 + 3 * i)}{chr(0x4E01 + 3 * i)} {model_text(rng, 'en', 3)} {chr(0x4E02 + 3 * i)}", f"l{i:03}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r["lang"], r["bucket"]): r["n"] for r in languages.ngram_counts(df, bits=20, block=4).collect()}
    own = collections.defaultdict(int)
    for _, t, lang in rows:
        for gram, n in grams_slow(t).items():
            h = 0
            for c in gram:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
            h ^= h >> 29
            own[lang, (h * 0xBF58476D1CE4E5B9 % 2**64) >> 44] += n
    assert got == own
    m = languages.learn(df)
    assert len(m.names) == 600 and m.bits == 15  # as for few languages
    assert [m.infer(t)[0] for _, t, _ in rows[::60]] == [lang for *_, lang in rows[::60]]


def junk(rng, kind, n):
    w = [model_text(rng, "en", 1) for _ in range(n)]
    return {"symbols": " ".join(x + rng.choice(["###", "$$$", "%%%"]) for x in w), "caps": " ".join(x.upper() + "!!" for x in w), "stutter": " ".join(x for x in w[: n // 10] for _ in range(10)), "pipes": " | ".join(w)}[kind]


def test_quality_model(spark, docs, none):
    rng = random.Random(6)
    rows = [(i, model_text(rng, "en", rng.randrange(60, 200)), 1) for i in range(160)] + [(1000 + i, junk(rng, k, 120), 0) for i, k in enumerate(["symbols", "caps", "stutter", "pipes"] * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, good int")
    model = quality_model.fit(df)
    fresh = [(i, model_text(rng, "de", rng.randrange(60, 200)), 1) for i in range(40)] + [(100 + i, junk(rng, k, 90), 0) for i, k in enumerate(["symbols", "caps", "stutter", "pipes"] * 5)]
    got = quality_model.scored(spark.createDataFrame(fresh, "doc_id long, text string, good int"), model).select("row.*", "score").collect()
    assert sum((r["score"] >= 0.5) == bool(r["good"]) for r in got) >= 58
    odd = quality_model.scored(docs, model)
    assert odd.count() == docs.count() and odd.where("row.text is null or trim(row.text) = ''").where("score > 0").count() == 0
    assert quality_model.fit(none) is None and quality_model.scored(none, None).count() == 0
    assert quality_model.scored(none, model).count() == 0


def test_copies_do_not_swell_the_sample(spark):
    rng = random.Random(2)
    texts = spark.createDataFrame([(t,) for k in range(200) for t in [prose(rng, 9)] * (30 if k < 20 else 1)], "text string")
    rows = texts.count()
    assert quality_model.fit_sample(texts, rows, rows, 5).count() == 200
    few = quality_model.fit_sample(texts, rows, rows // 4, 5)
    assert 20 < few.count() < 90 and few.distinct().count() == few.count()


def test_labeller_accuracies_are_found():
    rng = random.Random(9)
    counts = collections.Counter()
    for _ in range(20_000):
        bad = rng.random() < 0.2
        votes = [(2 if (rng.random() < acc) == bad else 1) if rng.random() < 0.8 else 0 for acc in (0.95, 0.9, 0.85, 0.9, 0.8, 0.9, 0.9, 0.9, 0.9)]
        counts[sum(v * 3**k for k, v in enumerate(votes))] += 1
    _, rates = quality_model.estimate(dict(counts))
    found = [rates[1][k][2] / (rates[1][k][1] + rates[1][k][2]) for k in range(5)]
    assert np.allclose(found, [0.95, 0.9, 0.85, 0.9, 0.8], atol=0.03)
    assert quality_model.estimate({})[0] == {}


def repeats_slow(rows, least=35):
    words = [re.findall(WORD, t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + least]) for w in words for i in range(len(w) - least + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for a in range(len(w) - least + 1):
            if seen[tuple(w[a : a + least])] > 1:
                gone[a : a + least] = [True] * least
        out.append(key(i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("shard", [substrings.SHARD_CONTEXTS, 2])
def test_substrings(docs, none, shard, monkeypatch):
    monkeypatch.setattr(substrings.repeated_spans, "__defaults__", (shard,))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(key(*r) for r in substrings.without_repeats(docs).collect()) == repeats_slow(rows)
    assert substrings.without_repeats(none).count() == 0


def test_substrings_small_alphabet(spark):
    """Few words and short windows: every kind of overlap and self-repeat."""
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(key(*r) for r in substrings.without_repeats(df, least=9).collect()) == repeats_slow(rows, 9)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=20), min_size=1, max_size=5), st.integers(1, 6))
def test_automaton(texts, least):
    a = substrings.SuffixAutomaton()
    for t in texts:
        a.add(t)
    a.close()
    seen = collections.Counter(tuple(t[i : i + least]) for t in texts for i in range(len(t) - least + 1))
    for times in (1, 2):
        for t in texts:
            assert a.matches(t, least, times) == [i + least for i in range(len(t) - least + 1) if seen[tuple(t[i : i + least])] >= times]


def test_reference_spans(spark):
    rng = random.Random(7)
    passage = prose(rng, 90)
    rows = [(1, f"{prose(rng, 20)} {passage} {prose(rng, 10)}"), (2, prose(rng, 50)), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for words in (200_000, 50):
        got = {r["doc_id"]: [list(s) for s in r["spans"]] for r in substrings.reference_spans(df, [prose(rng, 40), passage], shard_words=words).collect()}
        assert got == {1: [[20, 110]], 2: [], 3: []}


WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    got = packing.pack_documents(docs, WORDS, capacity=256).collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for p, s in enumerate(range(0, len(ids), 256)):
            part = ids[s : s + 256]
            want[(r["doc_id"], p, s, len(part), zlib.crc32(part.tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(none, WORDS).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan(counts):
    ranges = packing.plan(dict(counts), 64)
    bins, used = collections.defaultdict(list), collections.Counter()
    for length, first, n, at, offset in sorted(ranges, key=lambda r: (r[0], r[1])):
        assert first == used[length]
        used[length] += n
        for k in range(n):
            bins[at + k].append((offset, length))
    assert used == collections.Counter(counts)
    for b in bins.values():
        b.sort()
        assert all(x[0] == sum(y[1] for y in b[:i]) for i, x in enumerate(b)) and sum(y[1] for y in b) <= 64
    assert sorted(bins) == list(range(len(bins)))
    total = sum(k * n for k, n in counts.items())
    assert len(bins) <= 1.7 * total / 64 + 1 + sum(n for k, n in counts.items() if k > 32)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abT'.,!3 \n éΣ́İ"), st.characters(exclude_categories=["Cs"])), max_size=30))
def test_words_are_the_tokenizer(t):
    ids = packing._tokenizer(WORDS).encode(t, add_special_tokens=False).ids
    assert np.frombuffer(packing.encode_all([t], WORDS)[0], "<u4").tolist() == [*ids, 0]


@pytest.mark.parametrize("t", ["a <|ENDOFTEXT|> b", "A<|EndOfText|>.", "<|endoftext|> One", "É <|StartOfText|>", "<| End |>"])
def test_added_tokens_are_matched_by_case(t):
    ids = packing._tokenizer(WORDS).encode(t, add_special_tokens=False).ids
    assert np.frombuffer(packing.encode_all([t], WORDS)[0], "<u4").tolist() == [*ids, 0]


@pytest.mark.parametrize("t", ["The  Cat's\n\tHat.", "", None, " ÉCOLE, 12,3 <|endoftext|> "])
def test_other_tokenizers_get_whole_texts(t):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = packing._tokenizer(path).encode(t or "", add_special_tokens=False).ids
    assert packing._by_runs(WORDS) and not packing._by_runs(path)
    assert np.frombuffer(packing.encode_all([t], path)[0], "<u4").tolist() == [*ids, 0]


def test_quality_rules(docs, none):
    want = collections.Counter()
    for r in docs.collect():
        t = r["text"] or ""
        w = re.findall(WORD, t)
        seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        want[(r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))] += 1
    rows = quality_rules.ledger(docs)
    got = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows.collect())
    assert got == want
    assert quality_rules.ledger(none).count() == 0
    bits = [r["fail_bits"] for r in rows.collect()]
    for r in quality_rules.ablation(rows).collect():
        bit = quality_rules.policy_mask((r["rule"],))
        assert r["failed"] == sum(b & bit != 0 for b in bits) and r["only_by_this"] == sum(b == bit for b in bits)
    kept = quality_rules.apply_policy(rows, "base").where("kept").count()
    assert kept == sum(b & 3 == 0 for b in bits)


def test_sharding(docs, none):
    got = sharding.interleaved_shards(docs, shards=5).collect()
    texts = sorted(key(r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode()), r["source"]) for r in docs.collect())
    assert sorted(key(r["doc_id"], r["size"], r["text_crc32"], r["source"]) for r in got) == texts
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots[s]) for s in range(5)]
    assert max(sizes) - min(sizes) <= 1
    mix = collections.Counter((r["source"], r["shard"]) for r in got)
    for s in {r["source"] for r in got}:
        n = sum(mix[s, k] for k in range(5))
        assert all(abs(mix[s, k] - n / 5) < 2.5 for k in range(5))
    again = sharding.interleaved_shards(docs.repartition(7), shards=5).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, got))
    assert sharding.interleaved_shards(none).count() == 0


def chained(seed, *values):
    """Spark's 64-bit hash of an int and further columns: each value's, seeded with the one before's, as a signed number; nulls change nothing."""
    h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little", signed=True), 42)
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def test_shards_and_slots_by_hand(spark):
    """Ranks in each source, places on the line, and cuts, by sorting whole lists; with copies, null sources and ids, and ties."""
    rng = random.Random(12)
    rows = [(k if k % 9 else None, rng.choice(["x", "x", "long text " * 9, None]), rng.choice(["a", "a", "a", "b", "", None]), 1) for k in range(400)] + [(7, "x", "a", 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int").repartition(5)
    for shards, seed in ((16, 17), (7, 3)):
        got = collections.Counter((r["doc_id"], r["source"], r["size"], r["text_crc32"], r["law"], r["shard"], r["slot"]) for r in sharding.interleaved_shards(df, shards, seed).collect())
        strata = collections.defaultdict(list)
        for i, t, source, _ in rows:
            data = (t or "").encode()
            size, crc = len(data) + 1, zlib.crc32(data)
            name = "0" if source is None else "1" + source
            strata[name].append((chained(seed, i, size, crc), i, crc, size, source))
        line = []
        for name, own in strata.items():
            own.sort(key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2]))
            phase = (chained(seed, name) % (1 << 20) + 0.5) / (1 << 20)
            line += [((r + phase) / len(own), name, x[0], (x[1] is not None, x[1] or 0), x) for r, x in enumerate(own)]
        line.sort(key=lambda x: x[:4])
        want, seen = collections.Counter(), collections.Counter()
        for place, (*_, x) in enumerate(line):
            shard = place * shards // len(line)
            want[x[1], x[4], x[3], x[2], "rows", shard, seen[shard]] += 1
            seen[shard] += 1
        assert got == want and max(seen.values()) - min(seen.values()) <= 1
