"""Near-duplicates by Order MinHash over five-word shingles, verified by banded alignment.

Each of ``SKETCHES`` sketches takes the ``KEPT`` least occurrence-labelled shingles of a text under its own hash and keeps
them in text order, so that it is sensitive to order. Texts that share a sketch are candidates. Two texts are linked if an
alignment of their labelled shingle sequences matches M of them with M / (n1 + n2 - M) >= ``SIMILARITY``. Labelled shingles
are unique within a text, so the alignment is a longest increasing subsequence of matched positions; only matches inside the band
of n1 + n2 - 2M insertions and deletions that the threshold allows can belong to it.

Equal texts are one node throughout. Classes are the connected parts of the links, so a link inside a class need not be looked at:

1. Texts that share two neighbouring sketches are aligned with the one among them whose sketches most texts share, and
   classes are joined. What is left are texts of different classes in one bucket; of these only texts go on that share enough shingles
   with any others.
2. They are aligned with the centre of their bucket, the text with the most common shingles.
3. Each is described by its difference from the centre, the shingles that it lacks or has beside it. For two texts to reach the threshold their differences must have a certain number of shingles in common, which
   follows from their sizes; differences are joined by the rarest of their shingles, so many that two with enough in common
   must share one of these. What a large group has in common is in no difference. These pairs are aligned.

Defined results: null texts are in classes of their own and have no links; texts without words are linked to equal texts only;
null ids come first; repeated rows are equal texts; of rows with equal ids and texts ``keep_first`` keeps any one. Texts of any length
are read whole; tables may be empty; columns of any name come through.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shingles import mix, shingles
from ._text import Deal, Scratch, batches, key, maybe_in, stored, unkey
from ._tokens import ranges

#: At the least similarity two texts have a sketch in common with a chance of 0.8 ** KEPT; that they share none of all is one of 3e-8. With fewer
#: kept shingles, texts that only share a passage would meet in most buckets.
SIMILARITY, SKETCHES, KEPT = 0.8, 24, 3
NEAR = 16
#: Bytes of text hashed at once: numpy holds some fifty times as many. Rows of a batch between Spark and Python, on either side of which it lies twice.
CHARS, BATCH_ROWS = 1_000_000, 1_000
#: Two texts of n1 and n2 shingles are linked if they match at least this share of n1 + n2.
SHARE = SIMILARITY / (1 + SIMILARITY)
EPS = 1e-6
#: Parts that travel with a key, so that a pair which shares many is met once.
BEFORE = 4


def sketch(texts: pa.Array, sketches: int = SKETCHES) -> tuple[np.ndarray, np.ndarray]:
    """Number of shingles of each text, and its sketches (texts x sketches, 0 where there is no shingle)."""
    s, at = shingles(texts)
    sizes = np.diff(at)
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), sketches), np.uint64)
    if not len(full):
        return sizes, out
    every, owner = np.arange(len(full)), np.repeat(np.arange(len(full)), sizes[full])
    most = np.uint64(2**64 - 1)
    # the least few lie among the values below a limit that some NEAR values of a text are expected to pass; where too few do, all are looked at
    limit = np.full(len(full), most)
    large = sizes[full] > NEAR
    limit[large] = (NEAR / sizes[full][large] * 2.0**64).astype(np.uint64)
    limit, least = limit[owner], np.minimum(sizes[full], KEPT)
    for j in range(sketches):
        v = mix(s ^ mix(np.full(1, j + 1, np.uint64) * np.uint64(0xD1B54A32D192ED03)))
        near = v <= limit
        few = np.bincount(owner[near], minlength=len(full)) < least
        if few.any():
            near |= few[owner]
        where = np.flatnonzero(near)
        own, v = owner[where], v[where]
        starts, places = np.searchsorted(own, every), []
        for _ in range(KEPT):
            low = np.minimum.reduceat(v, starts)
            hit = np.flatnonzero(v == low[own])
            hit = hit[np.searchsorted(own[hit], every)]
            places.append(where[hit])
            v[hit] = most
        h = np.full(len(full), j + 1, np.uint64)
        for p in np.sort(np.stack(places), axis=0):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + s[p])
        out[full, j] = h
    return sizes, out


def matched(a: np.ndarray, b: np.ndarray, order: np.ndarray, least: float = SIMILARITY) -> float:
    """Likeness of two labelled shingle sequences by banded alignment; 0 if it is below ``least``. ``order`` sorts b."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    need = least * (n + m) / (1 + least)  # M / (n + m - M) >= least
    band = int(n + m - 2 * need + 1e-9)
    i, j = common(a, b, order)
    near = np.abs(i - j) <= band
    j = j[near]
    if len(j) < need - 1e-9:
        return 0.0
    if np.all(j[1:] > j[:-1]):
        size = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            k = bisect.bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        size = len(tails)
    value = size / (n + m - size)
    return value if value >= least - 1e-12 else 0.0


def common(a: np.ndarray, b: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the labelled shingles that both sequences have. ``order`` sorts b."""
    at = np.searchsorted(b, a, sorter=order)
    found = at < len(b)
    j = order[np.where(found, at, 0)]
    found &= b[j] == a
    return np.flatnonzero(found), j[found]


def nodes(docs: DataFrame) -> DataFrame:
    """(node, doc, copies) for each different text: its MD5, its least document and how many rows have it."""
    rows = docs.where(docs["text"].isNotNull()).select(F.unhex(F.md5(docs["text"].cast("binary"))).alias("node"), key(docs["doc_id"]).alias("d"))
    return rows.groupBy("node").agg(F.min("d").alias("doc"), F.count("*").alias("copies"))


def sketched(docs: DataFrame) -> DataFrame:
    """(node, n, sketches array<long>) of each row with a shingle."""

    def work(frames):
        for batch in frames:
            for lo, hi in ranges(batch.column(1), CHARS):
                n, sk = sketch(batch.column(1).slice(lo, hi - lo))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(sk.view(np.int64).ravel()), SKETCHES).cast(pa.list_(pa.int64()))
                full = pa.array(n > 0)
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), lists], ["node", "n", "sketches"])
                yield out.filter(full)

    return named(docs).mapInArrow(work, "node binary, n long, sketches array<long>")


def named(docs: DataFrame) -> DataFrame:
    return docs.where(docs["text"].isNotNull()).select(F.unhex(F.md5(docs["text"].cast("binary"))).alias("node"), "text")


def sequences(texts: DataFrame) -> DataFrame:
    """(node, s): the labelled shingles of each text in order."""

    def work(frames):
        for batch in frames:
            for lo, hi in ranges(batch.column(1), CHARS):
                s, at = shingles(batch.column(1).slice(lo, hi - lo))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(s.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["node", "s"])

    return texts.select("node", "text").mapInArrow(work, "node binary, s array<long>")


def beside(pairs: DataFrame, seqs: DataFrame, work, schema: str) -> DataFrame:
    """``work(a, b, s_a, order_a, s_b)`` for batches of pairs (a, b), as a row each: b and s_b are lists, a is one text.

    The shingles of a travel once for each salt of a, not once for each pair: they lead the sorted rows of their pairs."""
    only = pairs.select("a", "b")
    deal = Deal(["a"], only.groupBy("a").agg(F.count("*").alias("size")), only.count())
    dealt = deal.many(only, "b")
    heads = dealt.select(F.col("a").alias("node"), "a", "_salt", F.lit(None).cast("binary").alias("b")).distinct()
    rows = heads.unionByName(dealt.withColumn("node", F.col("b"))).join(seqs, "node")
    rows = rows.repartition("a", "_salt").sortWithinPartitions("a", "_salt", F.col("b").asc_nulls_first()).select("a", "b", "s")

    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        name, seq, order = b"", np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in frames:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = batch.column(2).offsets.to_numpy()
            s = batch.column(2).values.to_numpy().view(np.uint64)
            out = []
            for i in range(len(a)):
                own = s[at[i] : at[i + 1]]
                if b[i] is None:
                    name, seq, order = a[i], own.copy(), np.argsort(own, kind="stable")
                elif (row := work(name, b[i], seq, order, own)) is not None:
                    out.append(row)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in out])

    return rows.mapInArrow(run, schema)


def verified(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are linked."""
    return beside(pairs, seqs, lambda a, b, x, order, y: (a, b) if matched(y, x, order) else None, "a binary, b binary")


_LACKS = np.uint64(0x5851F42D4C957F2D)


def _difference(c: bytes, node: bytes, x: np.ndarray, order: np.ndarray, y: np.ndarray):
    i, j = common(y, x, order)
    has, lacks = np.ones(len(y), bool), np.ones(len(x), bool)
    has[i] = lacks[j] = False
    lacking, extra = x[lacks] ^ _LACKS, y[has]
    return c, node, len(x), len(lacking), np.concatenate([lacking, extra]).view(np.int64).tolist()


def differences(members: DataFrame, seqs: DataFrame) -> DataFrame:
    """(c, node, nc, lacks, difference) of members (c, node): c's number of shingles, how many of them the node lacks, and these with those it
    has beside them."""
    pairs = members.select(F.col("c").alias("a"), F.col("node").alias("b"))
    return beside(pairs, seqs, _difference, "c binary, node binary, nc long, lacks long, difference array<long>")


def shared(seqs: DataFrame) -> DataFrame:
    """(node, most): how many of a text's labelled shingles occur in another of these texts, which is the most that any alignment
    between them can match. Texts stand by a number on the way; where two have the same, all of their shingles count."""
    numbered = seqs.withColumn("id", F.xxhash64("node"))
    rows = numbered.select("id", F.explode("s").alias("shingle"))
    once = rows.groupBy("shingle").agg(F.count("*").alias("k"), F.min("id").alias("id")).where("k = 1")
    lone = once.groupBy("id").agg(F.count("*").alias("lone"))
    sizes = numbered.select("id", "node", F.size("s").alias("n")).groupBy("id").agg(F.collect_list(F.struct("node", "n")).alias("texts"))
    most = F.col("t.n") - F.when(F.size("texts") > 1, 0).otherwise(F.coalesce("lone", F.lit(0)))
    return sizes.join(lone, "id", "left").select("texts", "lone", F.explode("texts").alias("t")).select("t.node", most.alias("most"))


def components(links: DataFrame, keep: Scratch) -> DataFrame:
    """(node, root): the least node of each node's connected part, by spreading minima and jumping. links: (a, b), stored."""
    edges = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = keep(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "roots")
    while True:
        near = edges.join(state.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        spread = state.join(near, "node").select("node", F.least("root", "near").alias("next"), "root")
        # a root is its own root, so only where it is another node is there anything to jump to
        jump = state.where("node <> root").select(F.col("node").alias("next"), F.col("root").alias("far"))
        after = keep(spread.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("root"), F.col("root").alias("was")), "roots")
        state = after.select("node", "root")
        if after.where("root <> was").isEmpty():
            return state


def labels(stars: DataFrame, keep: Scratch) -> DataFrame:
    """(node, label): equal labels are of one class. stars: linked (a, b), where a is before b in one order of all nodes, so parents make no ring."""
    up = keep(stars.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")), "parents")
    above = up.toDF("label", "above")
    return keep(up.join(above, "label", "left").select("node", F.coalesce("above", "label").alias("label")), "labels")


def labelled(nodes: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    return nodes.join(labels.toDF(node, label), node, "left").withColumn(label, F.coalesce(label, node))


def _fits(x: str, y: str):
    return F.least(x, y) >= SIMILARITY * F.greatest(x, y) - EPS


def stars(sketches: DataFrame, scores: DataFrame, keep: Scratch) -> DataFrame:
    """Pairs (a, b) of a text and the most central one, a, of those that share two neighbouring sketches with it."""
    nodes = keep(sketches.join(scores, "node"), "scored")
    twos = F.transform(F.sequence(F.lit(0), F.lit(SKETCHES - 1)), lambda i: F.xxhash64(i, F.get("sketches", i), F.get("sketches", F.pmod(i + 1, F.lit(SKETCHES)))))
    rows = nodes.select("node", "n", "score", F.explode(twos).alias("two"))
    first = rows.groupBy("two").agg(F.count("*").alias("size"), F.max_by(F.struct("node", "n"), F.struct("score", "node")).alias("c")).where("size > 1")
    first = keep(first.select("two", "size", F.col("c.node").alias("a"), F.col("c.n").alias("na")), "stars")
    deal = Deal(["two"], first.select("two", "size"), nodes.count() * SKETCHES)
    met = deal.join(rows.select("two", F.col("node").alias("b"), "n"), first.drop("size"), "inner", "b")
    return met.where((F.col("a") != F.col("b")) & _fits("n", "na")).select("a", "b").distinct()


def able(met: DataFrame, deal: Deal, classes: DataFrame, seqs: DataFrame, keep: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts (node, n, most) that share a bucket with one of another class and enough shingles with any, their shingles (node, s),
    and (c, node): the text c of each bucket whose shingles are the most common, and the texts of the bucket. met: (bucket, node, n)."""

    def mixed(rows):
        two = rows.groupBy("bucket").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b").select("bucket")
        return deal.join(rows, two, "left_semi", "node")

    rooted = keep(labelled(met, classes, "node", "root"), "rooted")
    open_ = keep(mixed(rooted), "open")
    texts = open_.select("node", "n").distinct()
    most = shared(seqs.join(texts.select("node"), "node", "left_semi"))
    texts = keep(texts.join(most, "node").where(F.col("most") >= SIMILARITY * F.col("n") - EPS), "able")
    own = keep(seqs.join(texts.select("node"), "node", "left_semi"), "able-sequences")
    rows = keep(mixed(open_.join(texts.select("node"), "node", "left_semi")), "able-open")
    each = own.select("node", F.explode("s").alias("shingle"))
    often = keep(each.groupBy("shingle").agg(F.count("*").alias("size")).where("size > 1"), "shingles")
    by_shingle = Deal(["shingle"], often, texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    common_ = by_shingle.join(each, often, "inner", "node").groupBy("node").agg(F.sum("size").alias("seen"))
    common_ = texts.join(common_, "node").select("node", (F.col("seen") / F.col("n")).alias("seen"))
    centres = rows.join(common_, "node").groupBy("bucket").agg(F.max_by("node", F.struct("seen", "node")).alias("c"))
    members = deal.join(rows.select("bucket", "node"), centres, "inner", "node").select("c", "node").distinct()
    return texts, own, keep(members, "members")


def rests(rooted: DataFrame, texts: DataFrame, own: DataFrame, keep: Scratch) -> DataFrame:
    """Pairs (a, b) of texts of different classes with one centre whose differences leave it open that they reach the threshold. rooted: (c, node, root); texts: (node, n, most)."""
    by_c = Deal(["c"], rooted.groupBy("c").agg(F.count("*").alias("size")), rooted.count())
    counts = rooted.groupBy("c", "root").agg(F.count("*").alias("k")).groupBy("c").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count("*").alias("classes"))
    rooted = keep(by_c.join(rooted.join(texts, "node"), counts.where("classes > 1").drop("classes"), "inner", "node"), "rooted-members")
    diffs = keep(differences(rooted, own).join(rooted, ["c", "node"]), "differences")

    # what one member only lacks or has is common to no two
    parts = diffs.select("c", "node", F.explode("difference").alias("part"))
    often = keep(parts.groupBy("c", "part").agg(F.count("*").alias("size")).where("size > 1"), "parts")
    by_part = Deal(["c", "part"], often, diffs.agg(F.coalesce(F.sum(F.size("difference")), F.lit(0))).first()[0])
    ranked = by_part.join(parts, often, "inner", "node").groupBy("c", "node").agg(F.sort_array(F.collect_list(F.struct("size", "part"))).alias("parts"))
    # of x and y at least SHARE * (nx + ny) shingles are matched; |x and y| = nc - |c less x| - |c less y| + parts in common
    weight = SHARE * F.col("n") + F.col("lacks") - F.col("nc") / 2
    full = diffs.drop("difference").withColumn("w", weight).drop("nc", "lacks").join(ranked, ["c", "node"], "left")
    full = keep(full.withColumn("parts", F.coalesce("parts", F.array().cast("array<struct<size:bigint,part:bigint>>"))), "weighed")

    def reaching(rows, others):
        """``rows`` that can have as much in common with some of ``others`` as the threshold asks for, and the least that they need."""
        need = F.greatest(F.lit(0).cast("long"), F.ceil(F.col("w") + F.col("_least") - EPS))
        met = by_c.join(rows, others.groupBy("c").agg(F.min("w").alias("_least")), "inner", "node")
        return met.withColumn("need", need).drop("_least").where(F.size("parts") >= F.col("need"))

    outer = full.where("root <> main")
    ys = keep(reaching(full, outer), "inner")
    xs = keep(reaching(outer, ys), "outer")

    def prefix(rows):
        # the others must share one of the first size - need + 1 parts, unless they need nothing in common
        least = F.greatest("need", F.lit(1).cast("long"))
        kind = "array<struct<any:boolean,part:bigint,at:int,before:array<bigint>>>"
        empty = F.array().cast(kind)
        rows = rows.withColumn("ids", F.transform("parts", lambda p: p["part"]))

        def key_at(part, i):
            # what stands before a part tells whether two texts have an earlier one in common; the first few parts are the rarest
            return F.struct(F.lit(False).alias("any"), part.alias("part"), i.alias("at"), F.slice("ids", F.lit(1), F.least(i, F.lit(BEFORE))).alias("before"))

        first = F.transform(F.slice("ids", F.lit(1), (F.size("ids") - least + 1).cast("int")), key_at)
        none = F.array(F.struct(F.lit(True), F.lit(0).cast("long"), F.lit(0), F.array().cast("array<bigint>"))).cast(kind)
        keys = F.concat(F.when(F.col("need") == 0, none).otherwise(empty), F.when(F.size("ids") > 0, first).otherwise(empty))
        rows = rows.withColumn("key", F.explode(keys)).withColumn("p", F.size("ids"))
        return rows.select("c", "main", "node", "root", "n", "most", "w", "p", "key.any", "key.part", "key.at", "key.before")

    x = prefix(xs).toDF("c", "main", "x", "rx", "nx", "mx", "wx", "px", "any", "part", "ix", "bx")
    y = prefix(ys).drop("main").toDF("c", "y", "ry", "ny", "my", "wy", "py", "any", "part", "iy", "by")
    need = F.col("wx") + F.col("wy") - EPS
    apart = (F.col("rx") != F.col("ry")) & ((F.col("ry") == F.col("main")) | (F.col("x") < F.col("y"))) & _fits("nx", "ny")
    # a pair counts at the first part that it has in common (at others only if that is none of the first BEFORE); from there on it has at most as many as the shorter rest
    earliest = ~F.arrays_overlap("bx", "by") & (F.least(F.col("px") - F.col("ix"), F.col("py") - F.col("iy")) >= need)
    reach = (F.least("mx", "my") >= SHARE * (F.col("nx") + F.col("ny")) - EPS) & F.when(F.col("any"), need <= 0).otherwise(earliest)
    pairs = x.join(y, ["c", "any", "part"]).where(apart & reach)
    return pairs.select(F.col("y").alias("a"), F.col("x").alias("b")).distinct()


def _once(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs (a, b) without those that were tried in either order."""
    both = done.select(F.least("a", "b").alias("_l"), F.greatest("a", "b").alias("_g"))
    own = pairs.withColumn("_l", F.least("a", "b")).withColumn("_g", F.greatest("a", "b"))
    return own.join(both, ["_l", "_g"], "left_anti").drop("_l", "_g")


def roots(docs: DataFrame) -> DataFrame:
    """(node, root, links) of all texts that have a link to another text; links: how many were verified."""
    spark = docs.sparkSession
    with batches(spark, BATCH_ROWS), Scratch(spark, "neardup") as keep:
        sketches = keep(sketched(docs).dropDuplicates(["node"]), "sketches")
        rows = sketches.select("node", "n", F.explode("sketches").alias("bucket"))
        sizes = keep(rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        deal = Deal(["bucket"], sizes, sketches.count() * SKETCHES)
        met = keep(deal.join(rows, sizes, "inner", "node"), "met")
        scores = keep(met.groupBy("node").agg(F.sum("size").alias("score")), "scores")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # an inner join, since a semi-join would be pushed below the filter and shuffle all texts
        texts = maybe_in(named(docs), scores, "node").repartition(parts, "node").join(scores.select("node"), "node").groupBy("node").agg(F.first("text").alias("text"))
        seqs = keep.bucketed(sequences(texts), "sequences", "node")

        tried = keep(stars(sketches, scores, keep), "star-pairs")
        linked = keep(verified(tried, seqs), "star-links")
        known = labels(linked, keep)
        texts, own, members = able(met.drop("size"), deal, known, seqs, keep)
        members = keep(labelled(labelled(members, known, "c", "rc"), known, "node", "rn"), "labelled")
        ends = members.where("rc <> rn").join(texts.select(F.col("node").alias("c"), F.col("n").alias("nc")), "c").join(texts.select("node", "n"), "node")
        pairs = keep(_once(ends.where(_fits("nc", "n")).select(F.col("c").alias("a"), F.col("node").alias("b")), tried), "centre-pairs")
        tried, centred = tried.unionByName(pairs), keep(verified(pairs, own), "centre-links")
        linked = linked.unionByName(centred)
        # beside one centre all that are linked to it are of its class
        with_centre = members.join(centred.select(F.col("a").alias("c"), F.col("b").alias("node"), F.lit(True).alias("met")), ["c", "node"], "left")
        rooted = keep(with_centre.select("c", "node", F.when(F.col("met"), F.col("rc")).otherwise(F.col("rn")).alias("root")), "rooted-members")
        left = keep(_once(rests(rooted, texts, own, keep), tried), "rests")
        linked = linked.unionByName(keep(verified(left, own), "last-links"))

        # what is linked by labels counts as one
        ends = labelled(labelled(linked, known, "a", "la"), known, "b", "lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        whole = components(keep(ends.where("a <> b").distinct(), "label-links"), keep).toDF("label", "root")
        nodes = linked.select(F.col("a").alias("node")).unionByName(linked.select(F.col("b").alias("node"))).distinct()
        nodes = labelled(nodes, known, "node", "label").join(whole, "label", "left").select("node", F.coalesce("root", "label").alias("root"))
        ends = linked.select(F.col("a").alias("node")).unionByName(linked.select(F.col("b").alias("node")))
        return stored(nodes.join(ends.groupBy("node").agg(F.count("*").alias("links")), "node"), "neardup-roots")


def classes(docs: DataFrame) -> DataFrame:
    """A row for each of ``docs``: doc_id, class_id (the least doc_id of its class), class_rows, and n_links, the verified links of its text to other
    texts. Every two texts of a class are joined by verified links; those inside a class that were not looked for are not counted."""
    known = nodes(docs).join(roots(docs), "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = stored(known, "neardup-nodes")
    heads = known.groupBy("root").agg(F.min("doc").alias("class_doc"), F.sum("copies").alias("class_rows"))
    placed = known.join(heads, "root").select("node", "class_doc", "class_rows", "links")
    rows = docs.select(key(docs["doc_id"]).alias("d"), F.unhex(F.md5(docs["text"].cast("binary"))).alias("node"))
    return rows.join(placed, "node", "left").select(
        unkey(F.col("d")).alias("doc_id"),
        unkey(F.coalesce("class_doc", "d")).alias("class_id"),
        F.coalesce("class_rows", F.lit(1)).cast("long").alias("class_rows"),
        F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class, that with the least doc_id; rows of null text stay."""
    known = nodes(docs).join(roots(docs), "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = known.groupBy("root").agg(F.min_by(F.struct("node", "doc"), F.struct("doc", "node")).alias("head")).select("head.*")
    rows = docs.where(docs["text"].isNotNull()).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.unhex(F.md5(docs["text"].cast("binary"))).alias("node"), key(docs["doc_id"]).alias("doc"))
    kept = rows.join(heads, ["node", "doc"]).groupBy("node", "doc").agg(F.first("_row").alias("_row")).select("_row.*")
    return kept.unionByName(docs.where(docs["text"].isNull()))
