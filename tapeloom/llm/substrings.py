"""Removal of repeated word sequences by suffix automata of reference shards."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keyed_join, written

#: Words of an anchor: every window's smallest hashed run of so many words is its anchor.
ANCHOR_WORDS = 8
#: An anchor with more different contexts than this is settled window by window.
SHARD_CONTEXTS = 2_000
#: Words of one broadcast automaton (two states a word at most).
REFERENCE_WORDS = 200_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class SuffixAutomaton:
    """All substrings of some word sequences, with how often each occurs."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, words: list[bytes], weight: int = 1) -> None:
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for c in words:
            q = nxt[last].get(c, -1)
            if q >= 0:
                if length[q] != length[last] + 1:
                    q = self._clone(last, q, c)
                last = q
                count[last] += weight
                continue
            new = len(nxt)
            nxt.append({}), link.append(0), length.append(length[last] + 1), count.append(weight)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            last = new

    def _clone(self, p: int, q: int, c: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(nxt[q].copy()), link.append(link[q]), length.append(length[p] + 1), self.count.append(0)
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        link[q] = new
        return new

    def close(self) -> SuffixAutomaton:
        """Add the counts up along the suffix links."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]
        return self

    def matches(self, words: list[bytes], least: int, times: int = 1) -> list[int]:
        """Ends (exclusive) of the windows of ``least`` words that occur ``times`` times or more.

        Streams the words and keeps the matching statistic: the longest suffix
        of what was read that the automaton holds.
        """
        nxt, link, length, count = self.next, self.link, self.length, self.count
        out, state, size = [], 0, 0
        for at, c in enumerate(words, 1):
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                size += 1
            if size >= least:
                u = state
                while length[link[u]] >= least:
                    u = link[u]
                if count[u] >= times:
                    out.append(at)
        return out


def merged(windows: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, as maximal spans in order."""
    out: list[list[int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def anchors(words: list[bytes], least: int) -> list[tuple[int, int, int, int]]:
    """``(anchor, context, begin, end)``: runs of windows that share an anchor.

    A window's anchor is the smallest hash among its runs of ``ANCHOR_WORDS``
    words, so equal windows have equal anchors wherever they stand. Windows that
    choose one occurrence of an anchor follow each other; the words that they
    cover are its context, hashed with the anchor's place in it.
    """
    size = min(ANCHOR_WORDS, least)
    wide = least - size + 1
    if len(words) < least:
        return []
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    g = np.zeros(len(words) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(g)]
        g ^= g >> np.uint64(31)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(29)
    pick = np.empty(len(g) - wide + 1, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, wide)
    for at in range(0, len(view), 1 << 16):
        pick[at : at + (1 << 16)] = view[at : at + (1 << 16)].argmin(axis=1)
    pick += np.arange(len(pick))
    first = np.concatenate(([0], np.flatnonzero(np.diff(pick)) + 1))
    last = np.concatenate((first[1:], [len(pick)])) - 1 + least  # end of the run's last window
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    values = g[pick[first]].view(np.int64).tolist()
    rows = zip(values, first.tolist(), last.tolist(), starts[first].tolist(), ends[last - 1].tolist(), (pick[first] - first).tolist(), strict=True)
    return [(v, digest(joined[s:e], at) - (1 << 63), b, x) for v, b, x, s, e, at in rows]


def anchor_table(rows: DataFrame, least: int) -> DataFrame:
    """``(id, k, anchor, context, span)`` of every context; a span is ``begin << 32 | end``. ``rows`` has ``id, k, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                owner, got = [], []
                for k, t in enumerate(batch.column(2).to_pylist()):
                    own = anchors((t or "").encode("utf-8", "replace").split(), least)
                    owner += [k] * len(own)
                    got += own
                if got:
                    take = pa.array(owner, pa.int32())
                    value, context, begin, end = (np.array(c, np.int64) for c in zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(value), pa.array(context), pa.array(begin << 32 | end)], names=["id", "k", "anchor", "context", "span"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, k long, anchor long, context long, span long")


def _with_spans(rows: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """Join texts with what is listed for them; ids may be null."""
    s = spans.withColumnsRenamed({"id": "__id", "k": "__k"})
    return rows.join(s, rows["id"].eqNullSafe(s["__id"]) & (rows["k"] == s["__k"]), how).drop("__id", "__k")


def repeated_spans(rows: DataFrame, least: int, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """``(id, k, spans)``: maximal spans covered by windows that start anywhere else too.

    ``rows`` has ``id``, ``k`` (a hash of the text) and ``text``; equal rows
    share a key and count as different places.

    1. Anchors of all windows are counted; those met once cannot be in a
       repeated window.
    2. Of an anchor's contexts, those with equal hashes (64 bits besides the
       anchor's) repeat as a whole: copies and the inside of shared passages.
    3. The other contexts, and one of each kind of the former, are sent as words
       to shards by anchor. A shard builds the suffix automaton of its contexts
       and streams them for the windows that it holds twice.
    4. An anchor with more than ``shard_contexts`` different contexts (a very
       common passage's edge) would make a shard without bound; its windows are
       counted by 128-bit hash, pre-aggregated, instead.
    """
    found = written(anchor_table(rows.select("id", "k", "text"), least), "anchors")
    again = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    found = written(keyed_join(found, again, ["anchor"]), "repeated")
    kinds = found.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("id", "k", "span")).alias("one"))
    kinds = written(kinds, "contexts")
    whole = found.join(kinds.where("n > 1").select("anchor", "context"), ["anchor", "context"], "left_semi").select("id", "k", "span")
    open_ = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("anchor", "kinds")
    asked = keyed_join(kinds, open_, ["anchor"]).select("one.id", "one.k", F.struct("anchor", F.col("one.span").alias("span"), F.least("n", F.lit(2)).cast("int").alias("n"), (F.col("kinds") > shard_contexts).alias("hot")).alias("c"))
    asked = written(asked, "asked")
    kind = rows.schema["id"].dataType.simpleString()

    def pick(want_hot: bool) -> DataFrame:
        listed = asked.where(F.col("c.hot") == F.lit(want_hot)).groupBy("id", "k").agg(F.collect_list("c").alias("cs"))
        return _with_spans(rows.select("id", "k", "text"), listed, "inner")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, got = [], []
            for r, (t, cs) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                words = t.encode("utf-8", "replace").split()
                for c in cs:
                    owner.append(r)
                    got.append((c["anchor"], c["span"], c["n"], b" ".join(words[c["span"] >> 32 : c["span"] & 0xFFFFFFFF])))
            if got:
                take, cols = pa.array(owner, pa.int32()), list(zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c, x) for c, x in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True))], names=["id", "k", "anchor", "span", "n", "words"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settle() -> Iterator[pa.RecordBatch]:
            automaton = SuffixAutomaton()
            texts = [r["words"].split(b" ") for r in held]
            for r, words in zip(held, texts, strict=True):
                automaton.add(words, r["n"])
            automaton.close()
            out = []
            for r, words in zip(held, texts, strict=True):
                if r["n"] == 1:
                    base = r["span"] >> 32
                    out += [(r["id"], r["k"], base + a << 32 | base + b) for a, b in merged((e - least, e) for e in automaton.matches(words, least, 2))]
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("id", "k", "span"), x, strict=True)) for x in out], schema=pa.schema([("id", id_type[0]), ("k", pa.int64()), ("span", pa.int64())]))

        id_type = [pa.int64()]
        for batch in batches:
            id_type[0] = batch.schema.field("id").type
            for r in batch.to_pylist():
                if len(held) >= shard_contexts and r["anchor"] != held[-1]["anchor"]:
                    yield from settle()
                    held.clear()
                held.append(r)
        if held:
            yield from settle()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, got = [], []
            for r, (t, cs) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                words = t.encode("utf-8", "replace").split()
                for c in cs:
                    for b in range(c["span"] >> 32, (c["span"] & 0xFFFFFFFF) - least + 1):
                        owner.append(r)
                        got.append((b << 32 | b + least, c["n"], xxhash.xxh3_128_digest(b" ".join(words[b : b + least]))))
            if got:
                take, cols = pa.array(owner, pa.int32()), list(zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c, x) for c, x in zip(cols, (pa.int64(), pa.int32(), pa.binary()), strict=True))], names=["id", "k", "span", "n", "window"])

    cold = pick(False).mapInArrow(contexts, f"id {kind}, k long, anchor long, span long, n int, words binary")
    cold = cold.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(shards, f"id {kind}, k long, span long")
    spans = whole.union(cold)
    if not asked.where("c.hot").isEmpty():
        hot = pick(True).mapInArrow(windows, f"id {kind}, k long, span long, n int, window binary")
        twice = hot.groupBy("window").agg(F.sum("n").alias("times")).where("times > 1").select("window")
        spans = spans.union(hot.join(twice, "window").where("n = 1").select("id", "k", "span"))
    return spans.groupBy("id", "k").agg(F.collect_set("span").alias("spans"))


def less(text: str, cuts: list[tuple[int, int]]) -> str:
    """The text without these spans of words; all white space stays."""
    data = text.encode("utf-8", "replace")
    at = [m.span() for m in _WORD.finditer(data)]
    out, last = [], 0
    for a, b in cuts:
        out.append(data[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join((*out, data[last:])).decode("utf-8")


def without_repeats(docs: DataFrame, least: int = 35, id: str = "doc_id", text: str = "text", keep: list[str] | None = None, source: bool = False) -> DataFrame:
    """Each row's id, ``keep`` columns, ``n_words``, ``n_removed`` and ``kept`` (words joined by one space).

    With ``source``, ``kept`` is the text itself less the removed spans: white
    space stays, and so does a text without any (null ones too).

    A word goes if a window of ``least`` words over it starts at another place
    too, in the same or any other row. A null text has no words, and its ``kept``
    is empty. Every copy of a repeated row loses its windows alike.
    """
    keep = keep or []
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = F.col(text) if source else F.coalesce(F.col(text), F.lit(""))
    kept = docs.select(F.col(id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("k"), own.alias("text"), *(F.col(c).alias(f"_{c}") for c in keep)) if keep or source else rows
    both = _with_spans(kept, repeated_spans(rows, least), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n, gone, left = [], [], []
                for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    words = (t or "").encode("utf-8", "replace").split()
                    n.append(len(words))
                    cuts = merged((s >> 32, s & 0xFFFFFFFF) for s in spans) if spans else []
                    if source:
                        gone.append(sum(b - a for a, b in cuts))
                        left.append(less(t, cuts) if cuts else t)
                        continue
                    if spans:
                        stay, last = [], 0
                        for a, b in cuts:
                            stay += words[last:a]
                            last = b
                        words = stay + words[last:]
                    gone.append(n[-1] - len(words))
                    left.append(b" ".join(words).decode("utf-8"))
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[3:], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string())], names=[id, *keep, "n_words", "n_removed", "kept"])

    both = both.select("id", "text", "spans", *(f"_{c}" for c in keep))
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    fields = [T.StructField(id, both.schema["id"].dataType), *(T.StructField(c, both.schema[f"_{c}"].dataType) for c in keep)]
    return both.mapInArrow(run, T.StructType([*fields, *added]))


def reference_spans(docs: DataFrame, reference: list[str], least: int = 35, id: str = "doc_id", text: str = "text", shard_words: int = REFERENCE_WORDS) -> DataFrame:
    """``id`` and ``spans`` (``[begin, end]`` in words): maximal spans whose windows occur in a reference.

    The reference is held by the caller (a benchmark, say). It is cut into shards
    of at most ``shard_words`` words (overlapping where a text is cut), and the
    automaton of each is broadcast and streamed by the documents, one at a time.
    """
    shards: list[list[list[bytes]]] = [[]]
    room = shard_words
    for t in reference:
        words = (t or "").encode("utf-8", "replace").split()
        at = 0
        while len(words) - at >= least:
            if room < least:
                shards.append([])
                room = shard_words
            part = words[at : at + room]
            shards[-1].append(part)
            room -= len(part)
            at += len(part) if at + len(part) >= len(words) else len(part) - least + 1
    spark: SparkSession = docs.sparkSession
    picked = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("spans", F.expr("cast(array() as array<array<int>>)"))
    schema = picked.schema
    for shard in shards:
        held = spark.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            automaton = SuffixAutomaton()
            for words in held.value:
                automaton.add(words)
            automaton.close()
            for batch in batches:
                out = []
                for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    words = t.encode("utf-8", "replace").split()
                    out.append([list(s) for s in merged([*map(tuple, spans), *((e - least, e) for e in automaton.matches(words, least))])])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.list_(pa.int32())))], names=["id", "text", "spans"])

        picked = picked.mapInArrow(run, schema)
    return picked.select(F.col("id").alias(id), "spans")
