"""Offset-preserving SentencePiece encoding and decoding.

Texts are normalised here, by longest prefixes through the model's compiled character map (a double-array trie and its
replacement strings), while every normalised byte keeps the original byte it came from. The normalised
text goes through the library's encoder with its own normalisation switched off; the pieces' normalised lengths,
summed up and sent through the alignment, give original byte spans.
The model file (under 1 MB) is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featpipe.llm.common import give_back

MARK = "▁"  # fixed value: the library's stand-in for a blank
SLICE = 2 << 20  # characters of a result batch


class CharacterMap:
    """A compiled character map: longest-prefix replacement of UTF-8 bytes."""

    def __init__(self, blob: bytes):
        self.units, self.strings = [], b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
            self.strings = blob[4 + size :]
        self.first = {b for b in range(256) if self.units and self._step(self._base(0, 0), b) is not None}

    def _base(self, node: int, at: int) -> int:
        u = self.units[node]
        return at ^ ((u >> 10) << ((u & 0x200) >> 6))

    def _step(self, base: int, byte: int) -> int | None:
        node = base ^ byte
        return node if node < len(self.units) and self.units[node] & 0x800000FF == byte else None

    def longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """Length of the longest rule at ``start`` and its replacement."""
        if not self.units or start >= len(data) or data[start] not in self.first:
            return None
        base, best = self._base(0, 0), None
        for i in range(start, len(data)):
            node = self._step(base, data[i])
            if node is None:
                break
            base = self._base(node, node)
            if self.units[node] >> 8 & 1:
                best = (i + 1 - start, self.units[base] & 0x7FFFFFFF)
        if best is None:
            return None
        return best[0], self.strings[best[1] : self.strings.index(b"\0", best[1])]


class Encoder:
    """A model taken apart: character map and flags here, the segmentation by the library."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        m.ParseFromString(model)
        n = m.normalizer_spec
        self.map = CharacterMap(n.precompiled_charsmap)
        self.prefix, self.trim, self.escape = n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces
        self.suffix = m.trainer_spec.treat_whitespace_as_suffix
        kinds = proto.ModelProto.SentencePiece
        self.symbols = sorted((p.piece.encode() for p in m.pieces if p.type == kinds.USER_DEFINED), key=len, reverse=True)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n.precompiled_charsmap, n.name = b"", "identity"
        n.add_dummy_prefix = n.remove_extra_whitespaces = n.escape_whitespaces = False
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
        self.lengths = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in m.pieces], np.int64)
        self.unknown = m.trainer_spec.unk_id

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and their end) the original byte offset."""
        if not data:
            return b"", np.zeros(1, np.int64)
        mark = MARK.encode() if self.escape else b" "
        if not self.map.units and not self.trim and not self.symbols:
            raw = np.frombuffer(data, np.uint8)
            align = np.repeat(np.arange(len(raw)), np.where(raw == 32, len(mark), 1))
            text = data.replace(b" ", mark)
            head, tail = (mark, b"") if not self.suffix else (b"", mark)
            if not self.prefix:
                head = tail = b""
            align = np.concatenate([np.zeros(len(head), np.int64), align, np.full(len(tail) + 1, len(raw))])
            return head + text + tail, align
        at, end = 0, len(data)
        if self.trim:
            while at < end and (p := self._prefix(data, at))[1] == b" ":
                at += p[0]
            if at >= end:
                return b"", np.full(1, end)
        out, align = bytearray(), []

        def put(piece: bytes, source: int):
            for b in piece:
                made = mark if b == 32 else bytes((b,))
                out.extend(made)
                align.extend([source] * len(made))

        if self.prefix and not self.suffix:
            put(b" ", at)
        blank = self.trim
        while at < end:
            size, piece = self._prefix(data, at)
            if self.trim and blank:
                piece = piece.lstrip(b" ")
            if piece:
                put(piece, at)
                blank = piece.endswith(b" ")
            at += size
            if not self.trim:
                blank = False
        align.append(at)
        if self.trim:
            while out.endswith(mark):
                del out[-len(mark):]
                end = align[len(out)]
                del align[len(out):]
                align.append(end)
        if self.prefix and self.suffix:
            end = align.pop()
            put(b" ", end)
            align.append(end)
        return bytes(out), np.array(align, np.int64)

    def _prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        for s in self.symbols:
            if data.startswith(s, at):
                return len(s), s
        if hit := self.map.longest(data, at):
            return hit
        lead = data[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return size, data[at : at + size]

    def segment(self, text: str) -> np.ndarray:
        """Ids of a normalised text."""
        return np.array(self.inner.encode(text), np.int32)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and one more original byte offset than ids: piece i covers [offset i, offset i + 1)."""
        data, align = self.normalise((text or "").encode("utf-8", "surrogatepass"))
        ids = self.segment(data.decode("utf-8", "replace")) if data else np.empty(0, np.int32)
        ends = np.zeros(len(ids) + 1, np.int64)
        if (ids == self.unknown).any():  # an unknown piece has the length of its surface
            shown = self.inner.encode(data.decode("utf-8", "replace"), return_type="proto")
            np.cumsum([len(p.surface.encode()) for p in shown.pieces], out=ends[1:])
        else:
            np.cumsum(self.lengths[ids], out=ends[1:])
        return ids, align[ends]

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist()) if len(ids) else ""


def _work(model, kept):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(model.value)

        def made(batch, rows, start):
            ids, spans, texts = zip(*rows, strict=True)
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in xs])), pa.int32()),
                                              pa.array(np.concatenate(xs).astype(np.int32), pa.int32()))
                     for xs in (ids, spans)]
            part = batch.slice(start, len(rows))
            return pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *lists, pa.array(texts, pa.string())],
                                              [*kept, "__sp_ids", "__sp_offsets", "__sp_decoded"])

        for batch in batches:
            rows, start, size = [], 0, 0
            for i, text in enumerate(batch.column("__sp_text").to_pylist()):
                ids, spans = enc.encode(text)
                rows.append((ids, spans, enc.decode(ids)))
                size += len(text or "")
                if size >= SLICE:
                    yield made(batch, rows, start)
                    rows, start, size = [], i + 1, 0
            if rows:
                yield made(batch, rows, start)
        give_back()

    return run


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` and ids, offsets (byte offsets in the text; piece i covers offsets i to i + 1) and decoded.

    NULL and empty texts give no ids, one offset (0) and an empty decoded text. Rows may repeat; an empty table gives
    an empty table; columns of ``docs`` named like a result are replaced.
    """
    with open(model, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    names = [c for c in docs.columns if c not in ("ids", "offsets", "decoded")]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"__sp_c{k}") for k, c in enumerate(names)],
                        F.col(f"`{text}`").cast("string").alias("__sp_text"))
    kept = [f for f in inner.schema if f.name != "__sp_text"]
    ints = T.ArrayType(T.IntegerType())
    out = inner.mapInArrow(_work(shared, [f.name for f in kept]), T.StructType(
        [*kept, T.StructField("__sp_ids", ints), T.StructField("__sp_offsets", ints), T.StructField("__sp_decoded", T.StringType())]))
    return out.select(*[F.col(f"__sp_c{k}").alias(c) for k, c in enumerate(names)], F.col("__sp_ids").alias("ids"),
                      F.col("__sp_offsets").alias("offsets"), F.col("__sp_decoded").alias("decoded"))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, from ``encode``'s result."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
