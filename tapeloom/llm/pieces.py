"""SentencePiece encoding with source spans, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
# Fixed values of the model format: kinds of pieces, and the kind of model that merges pairs.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
CACHE_CHUNKS = 1_500_000
CACHE_CHARS = 48
#: Chunks of more characters are merged with a queue.
SCANNED = 64


class CharacterMap:
    """The compiled character map of a model's normaliser.

    The blob is a 32-bit trie size, a double-array trie over UTF-8 bytes, and
    the replacements, each ended by a zero byte; the trie's values are offsets
    among the replacements.
    """

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.texts = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """Length and replacement offset of the longest rule that is a prefix of ``data[at:]``; length 0 if none."""
        units, best = self.units, (0, 0)
        unit = units[0]
        node = self._child(0, unit)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[k]:  # the label, with the leaf flag clear
                break
            node = self._child(node, unit)
            if unit >> 8 & 1:
                best = (k + 1 - at, units[node] & 0x7FFFFFFF)
        return best

    @staticmethod
    def _child(node: int, unit: int) -> int:
        return node ^ (unit >> 10 << ((unit & 1 << 9) >> 6))

    def replacement(self, at: int) -> bytes:
        return self.texts[at : self.texts.index(b"\0", at)]


class Normalizer:
    """A model's text normalisation, with the source place of every output byte."""

    def __init__(self, charsmap: bytes, dummy_prefix: bool, squeeze: bool, escape: bool):
        self.map, self.dummy, self.squeeze, self.escape = CharacterMap(charsmap), dummy_prefix, squeeze, escape
        self.plain = not self.map.units

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its UTF-8 bytes (and its end) the byte of ``text`` it came from."""
        data = text.encode("utf-8", "replace")
        out, src = bytearray(), []
        at = 0
        if self.plain and not self.squeeze:
            return self._plain(data)
        while at < len(data):
            length, value = self.map.longest(data, at) if self.map.units else (0, 0)
            if length:
                new = self.map.replacement(value)
            else:
                lead = data[at]
                length = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = data[at : at + length]
            out += new
            src += [at] * len(new)
            at += length
        if self.squeeze:
            kept, last = [], 0x20  # drops leading spaces and all but the first of a run
            for k, b in enumerate(out):
                if b != 0x20 or last != 0x20:
                    kept.append(k)
                last = b
            while kept and out[kept[-1]] == 0x20:
                kept.pop()
            end = src[kept[-1] + 1] if kept and kept[-1] + 1 < len(src) else len(data)
            src, out = [src[k] for k in kept], bytearray(out[k] for k in kept)
        else:
            end = len(data)
        if not out:
            return "", np.zeros(1, np.int64)
        if self.dummy:
            out, src = bytearray(b" ") + out, [src[0], *src]
        if self.escape:
            spaces = np.frombuffer(bytes(out), np.uint8) == 0x20
            src = np.repeat(np.array(src, np.int64), np.where(spaces, 3, 1)).tolist()
            out = out.replace(b" ", SPACE.encode())
        return out.decode("utf-8"), np.array([*src, end], np.int64)

    def _plain(self, data: bytes) -> tuple[str, np.ndarray]:
        """The identity map, whole arrays at a time: each byte comes from its own place."""
        if not data:
            return "", np.zeros(1, np.int64)
        src = np.arange(len(data) + 1)
        if self.dummy:
            data, src = b" " + data, np.concatenate(([0], src))
        if self.escape:
            times = np.ones(len(src), np.int64)
            times[:-1][np.frombuffer(data, np.uint8) == 0x20] = len(SPACE.encode())
            src, data = np.repeat(src, times), data.replace(b" ", SPACE.encode())
        return data.decode("utf-8"), src


class Encoder:
    """Encodes by pair merges over the normalised text, keeping this worker's table of chunks met before.

    No piece of a model that splits at white space holds a space other than in
    front, nor a line feed, so no merge crosses the place before a run of spaces
    or before a line feed. The ids of a text are those of such chunks in order.
    ``safe`` is false for a model with other pieces, user-defined ones, or of
    another kind than pair merges with bytes to fall back on; the ids of its
    texts are the library's.
    """

    def __init__(self, path: str):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, trained = model.normalizer_spec, model.trainer_spec
        self.lib = spm.SentencePieceProcessor(model_file=path)
        self.normalize = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.width = np.array([1 if p.type == BYTE else 0 if p.type in (UNKNOWN, CONTROL) else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == BYTE}
        inner = any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids)
        kinds = {p.type for p in model.pieces} <= {NORMAL, UNKNOWN, CONTROL, BYTE}
        self.safe = kinds and not inner and spec.escape_whitespaces and trained.model_type == BPE and trained.byte_fallback and len(self.bytes) == 256 and not trained.treat_whitespace_as_suffix
        self.chunk = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*|[^{SPACE}\n]+")
        self.known: dict[str, str] = {}

    def merged(self, chunk: str) -> list[int]:
        """The ids of a chunk: of all neighbours that make a piece the best scored are joined first, of equals the leftmost."""
        part = self._scanned(chunk) if len(chunk) <= SCANNED else self._queued(chunk)
        out = list(map(self.ids.get, part))
        if None not in out:
            return out
        return [k for p, one in zip(part, out, strict=True) for k in ([self.bytes[b] for b in p.encode()] if one is None else [one])]

    def _scanned(self, chunk: str) -> list[str]:
        """The pieces of a short chunk, looking over all neighbours for each merge."""
        scores, none = self.scores, -math.inf
        part = list(chunk)
        value = [scores.get(a + b, none) for a, b in zip(part, part[1:], strict=False)]
        while value and (best := max(value)) > none:
            at = value.index(best)
            part[at : at + 2] = [part[at] + part[at + 1]]
            del value[at]
            if at < len(value):
                value[at] = scores.get(part[at] + part[at + 1], none)
            if at:
                value[at - 1] = scores.get(part[at - 1] + part[at], none)
        return part

    def _queued(self, chunk: str) -> list[str]:
        """The same for a long chunk, with a queue of merges."""
        scores = self.scores
        part: list[str] = list(chunk)
        before, after = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if (both := part[a] + part[b]) in scores:
                heapq.heappush(heap, (-scores[both], a, b, both))

        for at in range(len(part) - 1):
            offer(at, at + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if not part[a] or not part[b] or part[a] + part[b] != both or after[a] != b:
                continue  # one of them was joined meanwhile
            part[a], part[b] = both, ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
                offer(a, after[b])
            if before[a] >= 0:
                offer(before[a], a)
        return [p for p in part if p]

    def encode(self, texts: list[str]) -> list[tuple[list[int], str, np.ndarray]]:
        """The ids of each text, the same as decimals joined by commas, and the source byte of every normalised byte."""
        normal = [self.normalize(t) for t in texts]
        if not self.safe:
            return [(ids, ",".join(map(str, ids)), src) for ids, (_, src) in zip(self.lib.encode(texts, num_threads=1), normal, strict=True)]
        known, out = self.known, []
        for text, src in normal:
            chunks, here = self.chunk.findall(text), {}
            for c in {c for c in chunks if c not in known}:
                into = known if len(known) < CACHE_CHUNKS and len(c) <= CACHE_CHARS else here
                into[c] = ",".join(map(str, self.merged(c)))
            joined = ",".join([known[c] if c in known else here[c] for c in chunks] if here else [known[c] for c in chunks])
            out.append((np.fromstring(joined, np.int32, sep=",").tolist() if joined else [], joined, src))
        return out

    def spans(self, ids: list[int], src: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The source bytes that each id stands for, as starts and ends.

        The pieces cover the normalised text; its alignment takes every piece
        to the source. Byte pieces of one character cover one byte each.
        """
        width = self.width[ids] if ids else np.zeros(0, np.int64)
        if width.sum() != len(src) - 1:
            raise ValueError("the pieces don't cover the normalised text")
        ends = np.cumsum(width)
        return src[ends - width], src[ends]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(docs: DataFrame, model: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``ids``, and the span of source bytes ``[begins[k], ends[k])`` of each id.

    Null and empty texts have no ids. A span is empty where the id stands for
    the space that the model puts in front. Ids equal the library's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                got = e.encode(texts)
                spans = [e.spans(ids, src) for ids, _, src in got]
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([s[0].tolist() for s in spans], kind), pa.array([s[1].tolist() for s in spans], kind)],
                    names=[id, "ids", "begins", "ends"],
                )

    picked = docs.select(F.col(id), F.col(text).alias("__text"))
    return picked.mapInArrow(run, f"`{id}` {picked.schema[0].dataType.simpleString()}, ids array<int>, begins array<long>, ends array<long>")


def round_trip(docs: DataFrame, model: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text: counts and digests, and whether all spans fit.

    ``spans_ok`` says that the pieces cover the normalised text end to end and
    that their spans rise from the first byte of the source to its last. Null
    and empty texts have no ids and decode to the empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n, ids_sha, text_sha, fit = [], [], [], []
                for t, (ids, joined, src) in zip(texts, e.encode(texts), strict=True):
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(e.lib.decode(ids).encode("utf-8")).hexdigest() if ids else hashlib.sha256(b"").hexdigest())
                    begins, ends = e.spans(ids, src)
                    fit.append(bool(not ids or (begins[0] == 0 and ends[-1] == len(t.encode("utf-8", "replace")) and (begins <= ends).all() and (begins[1:] == ends[:-1]).all())))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha), pa.array(fit)], names=[id, "n_tokens", "ids_sha256", "decoded_sha256", "spans_ok"])

    picked = docs.select(F.col(id), F.col(text).alias("__text"))
    return picked.mapInArrow(run, f"`{id}` {picked.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_ok boolean")
