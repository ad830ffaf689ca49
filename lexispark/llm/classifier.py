"""Quality classifier: histogram gradient-boosted trees over document statistics, scored as flat arrays by numpy.

Each text is read once and becomes ``STATISTICS``, numbers between 0 and 1 made of its characters, words and lines. The labelled rows that are not held
out train the model, all of them, as Spark jobs: a statistic's bins come from exact counts over a grid of ``CELLS``; then for each level of each
tree tasks add gradients by (node, statistic, bin) over their rows, Spark sums these histograms, and the driver, which gets
one histogram of fixed size, picks the splits. Gradients are added as whole numbers of 2 ** -20, so the model doesn't depend on the order of tasks.
A task that is lost is done again from the stored statistics.

The model is four arrays (statistic, bin, left child, value) over the nodes of all trees; a batch of rows moves through all trees at once,
one gather a level, and a leaf is its own child.

Held out are rows whose CRC-32 of the doc_id as text is 2 modulo 4. Labels, lang, source and doc_id are no statistics. Defined results: null and
empty texts have all statistics 0 and are scored like others; rows of null doc_id are not held out and have no label; several labels of a doc_id
count as their mean, and rows of one doc_id are all trained on; null labels don't count; without labelled rows every score is 0.5;
equal texts have equal scores; texts of any length are read whole; an empty table gives no row; other columns, of any name, are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality
from ._shingles import mix, words
from ._text import Deal, Scratch, stored
from ._tokens import ranges

TREES, DEPTH, BINS, CELLS = 24, 3, 32, 1024
RATE, PENALTY, MIN_HESSIAN = 0.3, 1.0, 0.5
#: A document is of quality if its score reaches this.
THRESHOLD = 0.7
CHARS = 8_000_000
ONE = 2**20

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": quality.SYMBOLS.replace("|", "").encode(), "pipe": b"|", "exclaim": b"!", "stop": b".?",
    "comma": b",;:", "quote": b"\"'()[]{}/\\_=+@~^`", "line": b"\n", "space": b" \t\v\f\r",
}
STATISTICS = (*_KINDS, "size", "word_length", "line_words", "distinct_words", "same_word_next", "distinct_windows", "stop_words", "distinct_lines", "wordless_lines")
_WINDOW = 3


def _kind_of_byte() -> np.ndarray:
    out = np.zeros(256, np.int64)
    for i, some in enumerate(_KINDS.values()):
        out[list(some)] = i + 1
    out[0x80:0xC0] = len(_KINDS) + 1  # all but the first byte of a character
    return out


_KIND = _kind_of_byte()
_STOP = np.unique(words(pa.array([form for word in quality.STOP_WORDS for form in (word, word.capitalize())]))[0])


def _distinct(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """How many different values each owner has."""
    order = np.lexsort((values, owner))
    o, v = owner[order], values[order]
    new = np.concatenate([np.ones(min(1, len(o)), bool), (o[1:] != o[:-1]) | (v[1:] != v[:-1])])
    return np.bincount(o[new], minlength=n)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def statistics(texts: pa.Array) -> np.ndarray:
    """(texts x STATISTICS), all in [0, 1]."""
    n, kinds = len(texts), len(_KINDS) + 2
    blob = texts.fill_null("").cast(pa.large_string()).cast(pa.large_binary())
    bounds = np.frombuffer(blob.buffers()[1], np.int64)[blob.offset : blob.offset + n + 1]
    data = np.frombuffer(blob.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    owner = np.repeat(np.arange(n), np.diff(bounds))
    counts = np.bincount(owner * kinds + _KIND[data], minlength=n * kinds).reshape(n, kinds)
    chars = counts[:, :-1].sum(axis=1)
    own = {k: counts[:, i + 1] for i, k in enumerate(_KINDS)}

    w, at = words(blob.cast(pa.large_string()))
    n_words = np.diff(at)
    holder = np.repeat(np.arange(n), n_words)
    same = np.bincount(holder[1:][(w[1:] == w[:-1]) & (holder[1:] == holder[:-1])], minlength=n)
    n_windows = np.maximum(n_words - _WINDOW + 1, 0)
    first = np.arange(n_windows.sum()) + np.repeat(at[:-1] - np.cumsum(n_windows) + n_windows, n_windows)
    window = np.zeros(len(first), np.uint64)
    for i in range(_WINDOW):
        window = mix(window * np.uint64(0x9E3779B97F4A7C15) + w[first + i])

    # lines: from behind a line end or the start of a text to the next
    starts = np.unique(np.concatenate([bounds[:-1], np.flatnonzero(data == 10) + 1]))
    starts = starts[starts < len(data)]
    line_owner = owner[starts]
    powers = np.cumprod(np.full(len(data) + 1, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
    ends = np.concatenate([starts[1:], [len(data)]])[: len(starts)]
    # a line's own end is no part of it
    ends = ends - (data[np.maximum(ends, 1) - 1] == 10) if len(starts) else ends
    inverse = np.cumprod(np.full(len(data) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64), dtype=np.uint64)
    named = (sums[ends] - sums[starts]) * inverse[starts]
    visible = np.concatenate([[0], np.cumsum((_KIND[data] != _KIND[10]) & (_KIND[data] != _KIND[32]))])
    full = visible[ends] > visible[starts]
    n_lines, n_full = np.bincount(line_owner, minlength=n), np.bincount(line_owner[full], minlength=n)

    letters = chars - own["space"] - own["line"]
    out = {k: _share(v, chars) for k, v in own.items()}
    out |= {
        "size": np.log1p(n_words) / 20,
        "word_length": _share(letters, n_words) / 40,
        "line_words": np.log1p(_share(n_words, n_full)) / 12,
        "distinct_words": _share(_distinct(holder, w, n), n_words),
        "same_word_next": _share(same, n_words),
        "distinct_windows": _share(_distinct(np.repeat(np.arange(n), n_windows), window, n), n_windows),
        "stop_words": _share(np.bincount(holder[np.isin(w, _STOP)], minlength=n), n_words),
        "distinct_lines": _share(_distinct(line_owner[full], named[full], n), n_full),
        "wordless_lines": _share(n_lines - n_full, n_lines),
    }
    return np.clip(np.stack([out[k] for k in STATISTICS], axis=1), 0.0, 1.0)


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, x): the statistics of each row, as cells of a grid of CELLS."""
    id_ = docs["doc_id"]
    held = F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            texts = batch.column(2)
            for lo, hi in ranges(texts.fill_null(""), CHARS):
                cells = np.minimum(statistics(texts.slice(lo, hi - lo)) * CELLS, CELLS - 1).astype("<u2")
                x = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * len(STATISTICS)), hi - lo, [None, pa.py_buffer(cells.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), x], ["doc_id", "held_out", "x"])

    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(work, f"doc_id {kind}, held_out boolean, x binary")


def _cells(column: pa.Array) -> np.ndarray:
    """The cells of a batch of described rows."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    return np.frombuffer(column.buffers()[2] or b"", "<u2", offset=int(at[0]), count=int(at[-1] - at[0]) // 2).reshape(len(column), -1)


class Model(NamedTuple):
    """Trees as flat arrays: a row goes to ``left`` if its bin of ``feature`` is at most ``bound``, else to left + 1; a leaf is its own child."""

    edges: np.ndarray  # CELLS x statistics: the bin of each cell
    start: float
    feature: np.ndarray
    bound: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """(rows x trees): where each row ends in each tree."""
        per = 2 ** (DEPTH + 1) - 1
        at = np.tile(np.arange(0, len(self.feature), per), (len(bins), 1))
        rows = np.arange(len(bins))[:, None]
        for _ in range(DEPTH):
            at = self.left[at] + (bins[rows, self.feature[at]] > self.bound[at])
        return at

    def raw(self, bins: np.ndarray) -> np.ndarray:
        return self.start + self.value[self.nodes(bins)].sum(axis=1)

    def binned(self, cells: np.ndarray) -> np.ndarray:
        return self.edges[cells, np.arange(cells.shape[1])]


def grid(rows: DataFrame) -> np.ndarray:
    """(CELLS x statistics): how many rows have each cell of each statistic. rows: (x)."""

    def work(batches):
        total = np.zeros(CELLS * len(STATISTICS), np.int64)
        for batch in batches:
            cells = _cells(batch.column(0)).astype(np.int64)
            total += np.bincount((cells * len(STATISTICS) + np.arange(len(STATISTICS))).ravel(), minlength=len(total))
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[place])], ["place", "n"])

    found = rows.select("x").mapInArrow(work, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS * len(STATISTICS), np.int64)
    out[found["place"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(CELLS, len(STATISTICS))


def bins_of(counts: np.ndarray) -> np.ndarray:
    """The bin of each cell: cells that rows have are dealt over BINS by rank, so that bins hold about equal numbers of rows."""
    upto = np.cumsum(counts, axis=0) - counts
    total = np.maximum(counts.sum(axis=0), 1)
    return np.maximum.accumulate(np.minimum(upto * BINS // total, BINS - 1), axis=0).astype(np.uint8)


def histograms(rows: DataFrame, model: Model, tree: dict[str, np.ndarray], level: int) -> np.ndarray:
    """(nodes of the level x statistics x BINS x 2): sums of gradients and hessians, in units of 1 / ONE. rows: (x, y)."""
    first, width, n = 2**level - 1, 2**level, len(STATISTICS)
    size = width * n * BINS

    def work(batches):
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            bins = model.binned(_cells(batch.column(0)))
            p = 1 / (1 + np.exp(-model.raw(bins)))
            at = np.zeros(len(bins), np.int64)
            for _ in range(level):
                at = tree["left"][at] + (bins[np.arange(len(bins)), tree["feature"][at]] > tree["bound"][at])
            inside = np.flatnonzero(at >= first)  # other rows are in a leaf already
            place = ((at[inside, None] - first) * n + np.arange(n)) * BINS + bins[inside]
            for k, v in enumerate((batch.column(1).to_numpy() - p, p * (1 - p))):
                whole = np.rint(v[inside] * ONE)  # whole numbers, exact as floats for a batch
                total[k] += np.bincount(place.ravel(), np.repeat(whole, n), minlength=size).astype(np.int64)
        seen = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[0, seen]), pa.array(total[1, seen])], ["place", "g", "h"])

    found = rows.select("x", "y").mapInArrow(work, "place long, g long, h long").groupBy("place").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    out = np.zeros((size, 2), np.int64)
    out[found["place"].to_numpy(), 0], out[found["place"].to_numpy(), 1] = found["g"].to_numpy(), found["h"].to_numpy()
    return out.reshape(width, n, BINS, 2)


def split(histogram: np.ndarray) -> tuple[int, int, float] | None:
    """(statistic, last bin on the left, gain) of one node's best split, None if none gains. histogram: (statistics x BINS x 2)."""
    sums = np.cumsum(histogram, axis=1)[:, :-1] / ONE
    whole = histogram[0].sum(axis=0) / ONE
    g, h = sums[..., 0], sums[..., 1]
    gain = g**2 / (h + PENALTY) + (whole[0] - g) ** 2 / (whole[1] - h + PENALTY) - whole[0] ** 2 / (whole[1] + PENALTY)
    gain[(h < MIN_HESSIAN) | (whole[1] - h < MIN_HESSIAN)] = 0
    best = int(np.argmax(gain))
    return (best // gain.shape[1], best % gain.shape[1], float(gain.flat[best])) if gain.flat[best] > 1e-6 else None


def grown(level_sums) -> dict[str, np.ndarray]:
    """One tree. level_sums(tree, level): histograms of the nodes of a level."""
    per = 2 ** (DEPTH + 1) - 1
    tree = {"feature": np.zeros(per, np.int64), "bound": np.full(per, 255), "left": np.arange(per), "value": np.zeros(per)}
    for level in range(DEPTH):
        for i, node in enumerate(level_sums(tree, level)):
            at = 2**level - 1 + i
            if not (found := split(node)):
                continue
            tree["feature"][at], tree["bound"][at], tree["left"][at] = found[0], found[1], 2 * at + 1
            sums = node[found[0]]
            for child, side in ((2 * at + 1, sums[: found[1] + 1]), (2 * at + 2, sums[found[1] + 1 :])):
                g, h = side.sum(axis=0) / ONE
                tree["value"][child] = RATE * g / (h + PENALTY)
    return tree


def boosted(edges: np.ndarray, prior: float, sums, trees: int = TREES) -> Model:
    """The model of ``trees`` trees. sums(model, tree, level): histograms of a level."""
    parts: dict[str, list] = {"feature": [], "bound": [], "left": [], "value": []}
    model = Model(edges, float(np.log(prior / (1 - prior))), *[np.zeros(0, np.int64)] * 3, np.zeros(0))
    for k in range(trees):
        tree = grown(lambda tree, level, model=model: sums(model, tree, level))
        per = len(tree["left"])
        for name, part in parts.items():
            part.append(tree[name] + k * per if name == "left" else tree[name])
        model = model._replace(**{name: np.concatenate(part) for name, part in parts.items()})
    return model


def train(rows: DataFrame, trees: int = TREES) -> Model:
    """rows: (x, y), stored; y from 0 to 1."""
    n, mean = rows.agg(F.count("*"), F.avg("y")).first()
    if not n:
        return boosted(np.zeros((CELLS, len(STATISTICS)), np.uint8), 0.5, None, 0)
    return boosted(bins_of(grid(rows)), (mean * n + 0.5) / (n + 1), lambda *at: histograms(rows, *at), trees)


def labelled(known: DataFrame, labels: DataFrame) -> DataFrame:
    """(x, y) of the rows of ``known`` that have a label and are not held out."""
    own = labels.where(labels["doc_id"].isNotNull() & labels["quality"].isNotNull()).groupBy(labels["doc_id"].alias("doc_id")).agg(F.avg("quality").cast("double").alias("y"))
    free = known.where(~F.col("held_out") & F.col("doc_id").isNotNull())
    sizes = free.groupBy("doc_id").agg(F.count("*").alias("size")).where("size > 1")
    return Deal(["doc_id"], sizes, free.count()).join(free, own, "inner", "x").select("x", "y")


def scored(known: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score) of described rows."""
    kind = known.schema["doc_id"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            score = 1 / (1 + np.exp(-model.raw(model.binned(_cells(batch.column(2))))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["doc_id", "held_out", "score"])

    return known.select("doc_id", "held_out", "x").mapInArrow(work, f"doc_id {kind}, held_out boolean, score double")


def is_quality(score: Column) -> Column:
    return (score >= THRESHOLD).cast("int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``, by a model trained on its labelled rows."""
    known = stored(described(docs), "statistics")
    with Scratch(docs.sparkSession, "classifier") as keep:
        model = train(keep(labelled(known, labels), "labelled"))
    return scored(known, model).withColumn("predicted", is_quality(F.col("score")))
