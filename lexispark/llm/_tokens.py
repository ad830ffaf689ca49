"""Token ids of many texts by the byte-pair vocabularies of tokenizers files.

The tokenizers library defines the ids. No token crosses from a word into the white space after it, so each different word
of a batch is encoded once and kept. Words of Latin-1 characters alone, on which normalisation is only lower case, are merged
by tiktoken from the same file, several times faster; the library takes the rest. Tests hold both ways against each other.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes encoded at once, whatever the size of the batches.
CHARS = 12_000_000
#: Words kept by a worker, some 400 MB; all are forgotten when there are more.
CACHE = 800_000
#: Ends each piece where a vocabulary marks the ends of words; texts that hold it go to the library.
LAST = "\x7f"

# The patterns by which the two pre-tokenizers cut texts .
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Letters, numbers and white space of Latin-1, for the second.
_L, _N, _S = r"A-Za-zªµºÀ-ÖØ-öø-ÿ", r"0-9²³¹¼½¾", r"\x09-\x0d\x20\x85\xa0"
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
LATIN_1 = re.compile(r"[\x00-\x7e\x80-\xff]*")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Words:
    """Numbered words and their ids, one after another in an array that grows. Number 0 is a word without ids of its own."""

    def __init__(self, encode, safe, most: int = CACHE) -> None:
        self.most = most
        self.encode, self.safe = encode, safe  # list of words -> lists of ids; whether a word's ids are always the same
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.used, self.known = np.zeros(1 << 16, "<u4"), 0, 1
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.number]
        if len(self.number) + len(new) > self.most:
            self.clear()
            new = words
        if new:
            new = list(dict.fromkeys(new))
            self.number.update((w, 0) for w in new if not self.safe(w))
            new = [w for w in new if w not in self.number]
            found = self.encode(new)
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.concatenate([np.zeros(0, "<u4"), *found]).astype("<u4")
            n = self.known + len(new)
            if n > len(self.starts):
                self.starts, self.lengths = (np.resize(x, 2 * n) for x in (self.starts, self.lengths))
            if self.used + len(flat) > len(self.ids):
                self.ids = np.resize(self.ids, 2 * (self.used + len(flat)))
            self.ids[self.used : self.used + len(flat)] = flat
            self.lengths[self.known : n] = lengths
            self.starts[self.known : n] = self.used + np.cumsum(lengths) - lengths
            self.number.update(zip(new, range(self.known, n), strict=True))
            self.used, self.known = self.used + len(flat), n
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Their ids one after another, and where each number's ids end, from a leading 0."""
        lengths = self.lengths[numbers]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        out = np.empty(ends[-1], "<u4")
        for a in range(0, len(numbers), 1_000_000):  # so that the indexes stay small
            b = min(a + 1_000_000, len(numbers))
            at = np.repeat(self.starts[numbers[a:b]] - ends[a:b], lengths[a:b]) + np.arange(ends[a], ends[b])
            out[ends[a] : ends[b]] = self.ids[at]
        return out, ends


class ByWord:
    """Ids of texts, cut before single spaces by Arrow; each different word is encoded once and kept for later batches.

    ``whole`` and ``many`` turn a list of texts, or of words, into lists of ids; ``keyed`` makes of a word inside a text
    what ``many`` gets; texts that hold one of ``added`` go whole, as do those with a word whose ids depend on its neighbours.
    """

    def __init__(self, whole, many, before: str, safe, *added: str, most: int = CACHE) -> None:
        self.whole, self.before, self.added, self.words = whole, before, added, Words(many, safe, most)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and n + 1 offsets."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds -= bounds[0]
        codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        keys = words.to_pylist()
        if self.before:
            firsts = pc.take(words, pa.array(codes[bounds[:-1]])).to_pylist()
            found = self.words.numbers([*(self.before + w for w in keys), *firsts])
            numbers = found[: len(keys)][codes]
            numbers[bounds[:-1]] = found[len(keys) :]
        else:
            numbers = self.words.numbers(keys)[codes]
        bad = np.zeros(len(texts), bool)
        bad[np.searchsorted(bounds, np.flatnonzero(numbers == 0), "right") - 1] = True
        for x in self.added:
            bad |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        bad &= pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
        ids, ends = self.words.gather(numbers)
        offsets = ends[bounds]
        if not bad.any():
            return ids, offsets
        sizes, parts, at = np.diff(offsets), [], 0
        for i in np.flatnonzero(bad).tolist():
            own = np.array(self.whole([texts[i].as_py()])[0], "<u4")
            parts += [ids[at : offsets[i]], own]
            at, sizes[i] = offsets[i + 1], len(own)
        return np.concatenate([*parts, ids[at:]]), np.concatenate([[0], np.cumsum(sizes)])


class Merges:
    """Words by tokenizers, or directly by the file's merges where it is of one of two known kinds."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.added = [t["content"] for t in told["added_tokens"]]
        self.ended, self.direct = bool(told["model"].get("end_of_word_suffix")), None
        self.by_byte = told["normalizer"] is None and told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.by_word = [x.get("type") for x in (told["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and self.ended
        if told["model"]["type"] == "BPE" and (self.by_word or (self.by_byte and not self.ended)):
            self.direct = self._merger(told["model"])

    def _merger(self, model: dict):
        """text -> bytes of ids, or None if the file's ids don't follow its merges."""
        from tiktoken import Encoding

        letters, end, vocab = byte_letters(), model["end_of_word_suffix"] or "", model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [vocab[a + b] for a, b in pairs]
        if order != sorted(order) or any(vocab[c + e] > order[0] for c in letters for e in {"", end}):
            return None
        ranks = {}
        for t in [*letters, *(c + end for c in letters if end), *(a + b for a, b in pairs)]:
            ended = bool(end) and t.endswith(end)
            ranks[bytes(letters[c] for c in (t[: -len(end)] if ended else t)) + LAST.encode() * ended] = vocab[t]
        pattern = rf"[^{LAST}\s]+{LAST}" if end else BYTE_LEVEL
        return Encoding("merges", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_to_tiktoken_buffer

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def many(self, words: list[str]) -> list[np.ndarray]:
        if self.direct is None:
            return [np.array(x, "<u4") for x in self.whole(words)]
        latin, none = LATIN_1.fullmatch, frozenset()
        plain = [latin(w) is not None for w in words]
        rest = iter(self.whole([w for w, p in zip(words, plain, strict=True) if not p]))
        if self.ended:
            mark = PIECE.sub
            words = [mark(rf"\g<0>{LAST}", w.lower()) if p else w for w, p in zip(words, plain, strict=True)]
        return [np.frombuffer(self.direct(w, none), "<u4") if p else np.array(next(rest), "<u4") for w, p in zip(words, plain, strict=True)]


def _alone(word: str) -> bool:
    return bool(word.strip(" ")) and not (word.lstrip(" ")[:1].isspace() or word[-1].isspace())


_ENCODERS: dict[tuple[str, int], ByWord] = {}


def encoder(path: str, most: int = CACHE) -> ByWord:
    """One for each Python worker, file and number of words that are kept."""
    if (path, most) not in _ENCODERS:
        pa.set_memory_pool(pa.system_memory_pool())  # gives large buffers back at once
        m = Merges(path)
        if not (m.by_byte or m.by_word):
            raise ValueError(f"{path}: neither a byte-level vocabulary nor one with word ends")
        _ENCODERS[path, most] = ByWord(m.whole, m.many, "" if m.by_word else " ", _alone, *m.added, most=most)
    return _ENCODERS[path, most]


def ranges(texts: pa.Array, chars: int = CHARS):
    """Index ranges of about so many bytes, so that memory doesn't depend on how rows are batched."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        done = sizes[start - 1] if start else 0
        end = min(len(texts), int(np.searchsorted(sizes, done + chars, "left")) + 1)
        yield start, end
        start = end
