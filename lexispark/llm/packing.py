"""Best-fit packing of token sequences by exact-complement hashing.

Documents are encoded where they lie. Only the counts of the remainders' lengths (at most ``size`` - 1 of them, whatever
the input) reach the driver, which plans patterns of lengths and how often each is used: for the longest piece left, its
gap is filled exactly by one length, by a pair or by a triple found in indexes of sums, as often as counts allow; what is
left goes best-fit, with the last fillings where that is shorter. Pieces then take their places by rank within their length, counted in salted groups.

Defined results: null text: the end id alone; null ids are kept; repeated rows are packed one by one; no piece is ever dropped or cut except texts
of more than ``size`` tokens. Tables may be empty.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tokens import CACHE, CHARS, encoder, ranges
from ._text import stored

SIZE, END_ID = 1024, 2
#: Points at which the plan may stop to keep exact fillings.
STOPS = 64
#: Rows of one length that are ranked in one group.
ROWS_A_SALT, LEAST_SALTS = 50_000, 32


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, chars: int = CHARS, words: int = CACHE) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut from the end into pieces of ``size``.
    ``chars`` are encoded at once and ``words`` kept, which changes time and memory only."""
    end = np.array([end_id], "<u4")

    def cut(frames):
        enc = encoder(path, words)
        for batch in frames:
            for lo, hi in ranges(batch.column(1), chars):
                ids, at = enc.encode(batch.column(1).slice(lo, hi - lo))
                rows: list[list] = [[], [], [], [], []]
                for doc, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    data, n = np.concatenate([ids[a:b], end]), b - a + 1
                    starts = [0, *range(n % size or min(size, n), n, size)]
                    for k, (s, e) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                        for col, value in zip(rows, (doc, k, s, e - s, zlib.crc32(data[s:e])), strict=True):
                            col.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
                pa.default_memory_pool().release_unused()  # an idle worker stays for a minute

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    return texts.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, times) that use each length as often as it is counted; no pattern is longer than ``size``. Exact fillings
    come first, then best-fit. They can use up the short pieces that best-fit closes gaps with: the last fillings are given back
    to best-fit where that makes the plan shorter, and as many are kept as the shortest plan allows."""
    exact = exact_fillings(counts, size)
    plans = []
    for kept in sorted({len(exact) * i // STOPS for i in range(STOPS + 1)}, reverse=True):
        left = Counter({k: v for k, v in counts.items() if v})
        for pattern, times in exact[:kept]:
            left.subtract({k: v * times for k, v in Counter(pattern).items()})
        plans.append(exact[:kept] + best_fit(+left, size))
    return min(plans, key=lambda p: sum(t for _, t in p))


def exact_fillings(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns that fill ``size`` exactly: each length alone, then with one, two and three partners, found by the gap that it
    leaves in indexes of single, pair and triple sums. A pattern is used as often as the counts allow, so one of its lengths is
    used up but for fewer pieces than the pattern needs. Longer pieces come first; partners are as equal as can be, which spares short pieces."""
    left = Counter({k: v for k, v in counts.items() if v})
    lengths = sorted(left)
    pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for a in lengths:
        for b in itertools.takewhile(lambda b: b <= a and a + b < size, lengths):
            pairs[a + b].append((a, b))
    # of triples (a, b, c) with a >= b >= c the index holds a; b and c are the pairs of what is left
    triples: dict[int, list[int]] = defaultdict(list)
    for a in lengths:
        for rest in pairs:
            if a + rest < size and rest <= 2 * a:
                triples[a + rest].append(a)
    done: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...]) -> None:
        need = Counter(pattern)
        times = min(left[k] // v for k, v in need.items())
        if times:
            done.append((pattern, times))
            left.subtract({k: v * times for k, v in need.items()})

    ways = (
        lambda gap: [()] if not gap else [],
        lambda gap: [(gap,)],
        lambda gap: pairs.get(gap, ()),
        lambda gap: ((a, b, c) for a in triples.get(gap, ()) if left[a] for b, c in pairs[gap - a] if b <= a),
    )
    for way in ways:
        for whole in reversed(lengths):
            for partners in way(size - whole) if left[whole] else ():
                if not left[whole]:
                    break
                use((whole, *partners))
    return done


def best_fit(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of all lengths, the longest first: each goes to the fullest open pattern that it fits."""
    open_: dict[int, list[list]] = defaultdict(list)
    gaps: list[int] = []
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):  # each opens a pattern; several fit into one
                per = size // length
                whole, rest = divmod(n, per)
                for p, t in (((length,) * per, whole), ((length,) * rest, 1)):
                    if t and p:
                        _put(open_, gaps, size - sum(p), [p, t])
                n = 0
                continue
            gap = gaps[at]
            pattern, times = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
                gaps.pop(at)
            t = min(times, n)
            if times > t:
                _put(open_, gaps, gap, [pattern, times - t])
            _put(open_, gaps, gap - length, [(*pattern, length), t])
            n -= t
    return [(p, t) for x in open_.values() for p, t in x]


def _put(open_: dict, gaps: list[int], gap: int, item: list) -> None:
    if gap not in open_:
        bisect.insort(gaps, gap)
    open_[gap].append(item)


def place(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``size``."""
    spark = cut.sparkSession
    known = stored(cut.withColumn("_salt", (F.rand(7) * 2**40).cast("long")), "pieces")
    total = known.groupBy("length").count()
    per_length = {r["length"]: r["count"] for r in total.collect()}  # at most `size` rows
    salts = max(LEAST_SALTS, -(-sum(per_length.values()) // ROWS_A_SALT))
    known = known.withColumn("_salt", F.pmod("_salt", F.lit(salts)))
    # ranks from 0 within a length: within a salt, plus the rows of the salts before
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = known.groupBy("length", "_salt").count().select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    ranked = known.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(bases, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base")).drop("_salt", "_base")

    # slots: of each pattern and place in it, the ranks that go there
    patterns, first, taken, slots = plan(per_length, size), 0, Counter(), defaultdict(list)
    for pattern, times in patterns:
        at = 0
        for length in pattern:
            slots[length].append((taken[length], first, at))
            taken[length] += times
            at += length
        first += times
    rows = [(length, lo, seq, at) for length, own in slots.items() for lo, seq, at in own] or [(0, 0, 0, 0)]
    # from Arrow, since a list of rows would start Python workers of its own, which then stay for a minute
    table = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["length", "lo", "seq", "at"]))
    lists = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "seq", "at"))).alias("_slots"))
    # the last slot that begins at or before the rank, by bisection
    steps = max(1, max((len(x) for x in slots.values()), default=1).bit_length())

    def halve(span, _):
        mid = F.floor((span["a"] + span["b"] + 1) / 2).cast("int")
        right = F.get(F.col("_slots"), mid)["lo"] <= F.col("_rank")
        return F.struct(F.when(right, mid).otherwise(span["a"]).alias("a"), F.when(right, span["b"]).otherwise(mid - 1).alias("b"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("a"), (F.size("_slots") - 1).alias("b")), halve, lambda s: s["a"])
    at = ranked.join(F.broadcast(lists), "length").withColumn("_slot", F.get("_slots", found))
    return at.select(*cut.columns, (F.col("_slot.seq") + F.col("_rank") - F.col("_slot.lo")).alias("sequence_id"), F.col("_slot.at").alias("offset"))


def pack(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, chars: int = CHARS, words: int = CACHE) -> DataFrame:
    return place(pieces(docs, path, size, end_id, chars, words), size)
