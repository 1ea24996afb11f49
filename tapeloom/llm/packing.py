"""Packing token sequences: large-item matching, then best fit of the rest."""

from __future__ import annotations

import bisect
import json
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Entries of a worker's table of words already encoded.
CACHE_WORDS = 800_000
#: Longer runs of non-space are encoded but not kept.
CACHE_CHARS = 48
_beyond_latin = re.compile("[^\x00-ÿ]")
_spaces = re.compile("[\t\n\x0b\x0c\r ]+")
_MARKS = (".", ",")
_known: dict[str, dict[str, bytes]] = {}
#: The normaliser and the splitting rule of tokenizers whose ids can be taken run by run.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _added(path: str) -> tuple[str, ...]:
    return tuple(x.content.lower() for x in _tokenizer(path).get_added_tokens_decoder().values())


@lru_cache(maxsize=4)
def _by_runs(path: str) -> bool:
    """Whether the tokenizer's file says that white space only parts words and case is folded, as ``encode_all`` needs."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    whole = not any(re.search(r"\s", x["content"]) or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"])
    return whole and spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER


def _lowered(text: str, path: str) -> str:
    """The text in lower case where that leaves its ids alone, so that more runs are alike.

    Lower-casing is part of the normaliser. Outside Latin-1 it could depend on
    context, and added tokens are found before it, by their exact spelling; such
    texts stay as they are.
    """
    low = text.lower()
    return text if _beyond_latin.search(text) or any(x in low for x in _added(path)) else low


def encode_all(texts: list[str | None], path: str, end_id: int = 0) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit words, ``end_id`` last.

    Where the tokenizer normalises and splits at white space before anything else,
    the ids of a text are those of its runs of non-space, in order. Runs that
    this worker has met are looked up; the others of a batch are encoded together.
    Any other tokenizer gets whole texts.
    """
    known, tok = _known.setdefault(path, {}), _tokenizer(path)
    end = end_id.to_bytes(4, "little")
    if not _by_runs(path):
        return [b"".join(i.to_bytes(4, "little") for i in e.ids) + end for e in tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    split = [_spaces.split(_lowered(t, path)) if t else [] for t in texts]
    new = {w for words in split for w in words if w not in known}
    here: dict[str, bytes] = {}
    # Letters and the mark behind them are split before anything else, so a word
    # with a mark is the word's ids and the mark's.
    marked = [w for w in new if w[-1:] in _MARKS and w[:-1].isalpha()] if new else []
    if marked:
        new.difference_update(marked)
        new.update(x for w in marked for x in (w[:-1], w[-1]) if x not in known)
    if new:
        listed = list(new)
        for at in range(0, len(listed), 4096):
            part = listed[at : at + 4096]
            for w, e in zip(part, tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                packed = b"".join(i.to_bytes(4, "little") for i in e.ids)
                if len(known) < CACHE_WORDS and len(w) <= CACHE_CHARS:
                    known[w] = packed
                else:
                    here[w] = packed
    for w in marked:
        a, b = w[:-1], w[-1]
        packed = (known[a] if a in known else here[a]) + (known[b] if b in known else here[b])
        if len(known) < CACHE_WORDS and len(w) <= CACHE_CHARS:
            known[w] = packed
        else:
            here[w] = packed
    if not here:
        return [b"".join(map(known.__getitem__, words)) + end for words in split]
    return [b"".join([known[w] if w in known else here[w] for w in words]) + end for words in split]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, id: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Tokenise and cut: ``(id, piece, start, length, ids_crc32)`` for each piece.

    Only documents longer than ``capacity`` are cut. A null or empty text is the
    end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                owner, piece, start, length, crc = [], [], [], [], []
                for k, ids in enumerate(encode_all(batch.column(1).to_pylist(), tokenizer, end_id)):
                    for p, s in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[s : s + 4 * capacity]
                        owner.append(k), piece.append(p), start.append(s // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=[id, "piece", "start", "length", "ids_crc32"],
                )

    picked = docs.select(F.col(id), F.col(text).alias("__text"))
    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id}` {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Place ``counts[length]`` pieces of each length into as few bins as it can.

    Pieces above a third of the capacity go first, longest first: each is joined
    by the longest other such piece that fits, so there are two at most to a bin.
    The rest, longest first, go to the smallest gap that holds them; a new bin
    takes as many as it holds. All alike pieces and bins are moved together, so
    the work depends on the capacity and not on how many pieces there are.

    Returns ranges ``(length, first rank, ranks, first bin, offset)``: the k-th
    piece of a range lies in bin ``first bin + k`` at ``offset``.
    """
    left, used = {k: n for k, n in counts.items() if n}, dict.fromkeys(counts, 0)
    out, gaps, order, bins = [], {}, [], 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        out.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n

    def leave(gap: int, first: int, n: int) -> None:
        if gap > 0:
            if gap not in gaps:
                bisect.insort(order, gap)
                gaps[gap] = []
            gaps[gap].append((first, n))

    big = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for length in big:
        fits = [p for p in big if p <= length and p + length <= capacity]
        for other in fits:
            n = min(left[length], left[other]) if other != length else left[length] // 2
            if n:
                put(length, n, bins, 0)
                put(other, n, bins, length)
                leave(capacity - length - other, bins, n)
                bins += n
        if n := left[length]:
            put(length, n, bins, 0)
            leave(capacity - length, bins, n)
            bins += n
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                gap = order[at]
                first, n = gaps[gap].pop()
                take = min(n, left[length])
                if take < n:
                    gaps[gap].append((first + take, n - take))
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
                put(length, take, first, capacity - gap)
                leave(gap - length, first, take)
                continue
            each = capacity // length
            full, rest = divmod(left[length], each)
            if full:
                for k in range(each):
                    put(length, full, bins, k * length)
                leave(capacity - each * length, bins, full)
                bins += full
            if rest:
                for k in range(rest):
                    put(length, 1, bins, k * length)
                leave(capacity - rest * length, bins, 1)
                bins += 1
    return out


def packed(rows: DataFrame, capacity: int = 2048, id: str = "doc_id") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces (read three times).

    The histogram of lengths (``capacity`` rows at most) is all that the driver
    sees; the plan over it is a bounded table too, and is broadcast. A piece
    finds its place by its rank among pieces of its length; ranks are taken
    within salted groups and shifted by the groups' counts, so that many pieces
    of one length are ranked in many tasks.
    """
    spark = rows.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = max(8, math.ceil(sum(counts.values()) / 100_000))
    ranges = plan(counts, capacity)
    table = spark.createDataFrame(ranges, "p_length long, p_from long, p_n long, p_first long, p_offset long")
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(id, "piece", "ids_crc32"), F.lit(salts)))
    sizes = rows.groupBy("length", "__salt").agg(F.count("*").alias("__c"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.select("length", "__salt", (F.sum("__c").over(before) - F.col("__c")).alias("__from"))
    inner = Window.partitionBy("length", "__salt").orderBy(id, "piece", "ids_crc32")
    ranked = rows.join(sizes, ["length", "__salt"]).withColumn("__rank", F.col("__from") + F.row_number().over(inner) - 1)
    spot = (F.col("length") == F.col("p_length")) & (F.col("__rank") >= F.col("p_from")) & (F.col("__rank") < F.col("p_from") + F.col("p_n"))
    return ranked.join(F.broadcast(table), spot).select(
        id, "piece", "start", "length", "ids_crc32", (F.col("p_first") + F.col("__rank") - F.col("p_from")).alias("sequence_id"), F.col("p_offset").alias("offset")
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, id: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """One row for each piece of each document, placed in a sequence.

    Pieces are written to the shared folder first, so texts are tokenised once
    and a lost executor costs at most its part of that. Repeated rows and null
    ids are packed like any others; no rows give no rows.
    """
    return packed(written(pieces(docs, tokenizer, capacity, id, text, end_id), "pieces"), capacity, id)
