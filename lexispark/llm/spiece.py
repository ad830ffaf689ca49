"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by the longest prefixes that the model's compiled character map knows, recording for each byte of the
result where it came from; each piece is then projected to the bytes of the original text that it stands for. Pieces come
from the sentencepiece library: where no piece of the model continues over the mark of a new word, each different word is
encoded once and kept in a bounded cache, else whole texts go to the library.

Defined results: null text counts as empty and has no pieces; rows are encoded one by one, so repeated rows get equal
results; other columns are never read. Tables may be empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tokens import ByWord, ranges

MARK = "▁"


class CharMap:
    """Longest-prefix normalisation by a compiled map: u32 size of a double-array trie, the trie, then zero-ended strings."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.trie = np.frombuffer(blob[4 : 4 + size], "<u4").tolist() if blob else []
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest known prefix of data[at:]."""
        if not self.trie:
            return None
        best, unit = None, self.trie[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.trie):
                break
            unit = self.trie[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                value = self.trie[node] & 0x7FFFFFFF
                best = i + 1 - at, self.strings[value : self.strings.index(b"\0", value)]
        return best

    def normalise(self, text: str, dummy_prefix: bool = True, squeeze: bool = False) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, spaces as MARK, and for each of them and the end the byte of the text it came from."""
        data, out, where, at = text.encode(), bytearray(), [], 0
        mark = MARK.encode()
        pieces: list[tuple[int, int, bytes]] = []
        while at < len(data):
            n, new = self.longest(data, at) or (_width(data[at]), data[at : at + _width(data[at])])
            pieces.append((at, at + n, new))
            at += n
        if squeeze:
            while pieces and pieces[0][2] == b" ":
                pieces.pop(0)
            while pieces and pieces[-1][2].endswith(b" "):
                a, b, new = pieces.pop()
                if new.rstrip(b" "):
                    pieces.append((a, b, new.rstrip(b" ")))
        if not pieces:
            return b"", np.array([len(data)])
        if dummy_prefix:
            out += mark
            where += [pieces[0][0]] * 3
        space = dummy_prefix
        for a, b, new in pieces:
            for c in new.decode():
                if squeeze and c == " " and space:
                    continue
                space = c == " "
                x = mark if c == " " else c.encode()
                out += x
                where += [a] * len(x)
        return bytes(out), np.array([*where, pieces[-1][1]])


def _width(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Pieces:
    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.sp, self.map, self.spec = SentencePieceProcessor(model_file=path), CharMap(spec.precompiled_charsmap), spec
        plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        #: Only spaces change, so alignment needs no walk of the map.
        self.plain = bool(plain and not model.trainer_spec.treat_whitespace_as_suffix)
        kinds = {p.type for p in model.pieces}
        self.by_word = self.plain and 4 not in kinds and not any(MARK in p.piece.lstrip(MARK) for p in model.pieces)
        # bytes of the normalised text that a piece covers; 0: an unknown character of any length
        self.bytes = np.array([0 if p.type == 2 else 1 if p.type == 6 else len(p.piece.encode()) for p in model.pieces])

        one = lambda text: self.sp.encode(text, num_threads=1)
        self.encoder = ByWord(lambda texts: [one(t) for t in texts], one, "", bool, MARK) if self.by_word else None

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        if self.encoder is None:
            return [np.array(x, "<u4") for x in self.sp.encode(texts.to_pylist(), num_threads=1)]
        ids, at = self.encoder.encode(texts)
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end in the original text of each piece."""
        if not len(ids):
            return np.zeros(0, int), np.zeros(0, int)
        lengths = self.bytes[ids]
        if self.plain and lengths.all():
            data = np.frombuffer(text.encode(), "u1")
            # normalised position of each original byte: 3 for the dummy prefix, 2 more for each space before
            marks = np.flatnonzero(data == 32)
            ends = np.cumsum(lengths)
            at = marks + 3 + 2 * np.arange(len(marks))  # where the marks of spaces begin

            def back(p: np.ndarray) -> np.ndarray:
                if not len(marks):
                    return np.maximum(p - 3, 0)
                k = np.searchsorted(at, p, "right")
                last = np.maximum(k - 1, 0)
                inside = (k > 0) & (p < at[last] + 3)
                return np.where(inside, marks[last], np.maximum(p - 3 - 2 * k, 0))

            return back(ends - lengths), back(ends)
        normal, where = self.map.normalise(text, self.spec.add_dummy_prefix, self.spec.remove_extra_whitespaces)
        if not lengths.all():
            pos, fixed = 0, []
            for n in lengths.tolist():
                n = n or _width(normal[pos])
                fixed.append(n)
                pos += n
            lengths = np.array(fixed)
        ends = np.minimum(np.cumsum(lengths), len(normal))
        return where[np.minimum(ends - lengths, len(normal))], where[ends]


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """One for each Python worker and model."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep..., ids array<int>, and begins, ends array<int>: the original bytes of each piece."""
    return _mapped(docs, path, text, keep, "ids array<int>, begins array<int>, ends array<int>", _aligned)


def digest(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep..., n_tokens, ids_sha256, decoded_sha256, and ``covered``: bytes of the original text under the pieces."""
    return _mapped(docs, path, text, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string, covered long", _digests)


def _aligned(model: Pieces, texts: pa.Array) -> list[list]:
    rows = [(ids, *model.spans(t, ids)) for t, ids in zip(texts.to_pylist(), model.encode(texts), strict=True)]
    return [[r[k].tolist() for r in rows] for k in range(3)]


def _digests(model: Pieces, texts: pa.Array) -> list[list]:
    cols: list[list] = [[], [], [], []]
    for t, ids in zip(texts.to_pylist(), model.encode(texts), strict=True):
        plain = ids.tolist()
        begins, ends = model.spans(t, ids)
        for c, v in zip(cols, (len(plain), _sha(",".join(map(str, plain))), _sha(model.sp.decode(plain)), int((ends - begins).sum())), strict=True):
            c.append(v)
    return cols


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _mapped(docs: DataFrame, path: str, text: str, keep: tuple[str, ...], made: str, do) -> DataFrame:
    rows = docs.select(*[docs[c] for c in keep], F.coalesce(docs[text], F.lit("")).alias("_text"))
    schema = rows.drop("_text").schema.fields
    full = T.StructType([*schema, *T.StructType.fromDDL(made).fields])

    def work(frames):
        from pyspark.sql.pandas.types import to_arrow_schema

        model, wanted = loaded(path), to_arrow_schema(full)
        for batch in frames:
            for a, b in ranges(batch.column(len(keep))):
                cols = do(model, batch.column(len(keep)).slice(a, b - a))
                arrays = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                arrays += [pa.array(c, wanted.field(len(keep) + i).type) for i, c in enumerate(cols)]
                yield pa.RecordBatch.from_arrays(arrays, [f.name for f in full])

    return rows.mapInArrow(work, full)
