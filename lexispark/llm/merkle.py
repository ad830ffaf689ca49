"""Merkle manifest of a dataset by butterfly exchange.

Each document is a leaf. The leaves of a source, ordered by doc_id, form a tree of fanout 16, and the roots of the sources, ordered
by source, form another. Hashes are lower-case hex SHA-256.

A partition of a tree is an aligned block of ``FANOUT ** BLOCK_LEVELS`` leaves; it hashes its own subtree by itself. Blocks then swap
the roots of what they know round by round: in round r the sixteen blocks that differ only in digit r of their number (in base 16)
exchange their nodes, and each of them hashes the common ancestor again. So after the last round every block holds the siblings of
all its ancestors and the root, and nothing travels back down the tree. Where the last node of a level is short of blocks, those it
has send to the partners of the missing ones too.

Leaves are numbered by ranges of their order and counts of rows in the ranges before, so no source is gathered in a task, however many
rows it has; a block is a row of 256 leaves. Texts are read once, when leaves are hashed.

Defined results: each null is `-`; rows of equal doc_id (also null, which comes first) are ordered by their leaf, and equal rows are leaves
of their own; a source of one leaf has that leaf as its root, and its proof has no hash of its own source; an empty text is `0:`; texts
of any length are hashed whole; an empty table gives no row; other columns, of any name, are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._text import Deal, Scratch, stored

FANOUT, BLOCK_LEVELS = 16, 2
BLOCK = FANOUT**BLOCK_LEVELS
#: Messages that one row makes at once.
STRIPE = 4096


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(docs: DataFrame, text: Column) -> Column:
    return F.sha2(F.concat(*[field(docs[c]) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(g, o, item, leaf): the group of a leaf, its order, what goes with it (doc_id and, where the row is tampered with, the changed leaf)."""
    lower = F.translate(docs["text"], string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0
    rows = docs.select(
        F.when(docs["source"].isNull(), F.lit("")).otherwise(F.concat(F.lit("="), docs["source"].cast("string"))).alias("g"),
        docs["doc_id"],
        leaf(docs, docs["text"]).alias("leaf"),
        F.when(tampered, leaf(docs, lower)).alias("changed"),
    )
    rows = stored(rows, "merkle-leaves").withColumn("copy", F.monotonically_increasing_id())  # the same at each reading of the files
    return rows.select("g", F.struct("doc_id", "leaf", "copy").alias("o"), F.struct("doc_id", "changed").alias("item"), "leaf")


def numbered(rows: DataFrame) -> DataFrame:
    """Adds `rank`, the place of a row in its group from 0, and `total`, the rows of the group."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "g", "o").sortWithinPartitions("g", "o").withColumn("at", F.monotonically_increasing_id())
    # the upper bits of `at` are the range, the lower ones the place in it
    ranged = stored(ranged.drop("o"), "merkle-ranges").withColumn("piece", F.shiftright("at", 33))
    pieces = ranged.groupBy("g", "piece").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    group = Window.partitionBy("g")
    before = F.coalesce(F.sum("size").over(group.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = pieces.select("g", "piece", (before - F.col("first")).alias("shift"), F.sum("size").over(group).alias("total"))
    return ranged.join(bases, ["g", "piece"]).withColumn("rank", F.col("at") + F.col("shift")).drop("at", "shift", "piece")


def _hash(nodes: Column) -> Column:
    return F.sha2(F.array_join(nodes, ""), 256)


def _parents(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda j: _hash(F.slice(nodes, j * FANOUT + 1, F.lit(FANOUT))))


def blocks(rows: DataFrame) -> DataFrame:
    """(g, block, total, items, l0, l1, ..., node): the levels of each block's subtree. A level above the root of its group repeats it."""
    each = rows.groupBy("g", F.floor(F.col("rank") / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "leaf", "item"))).alias("items"), F.first("total").alias("total")
    )
    each = each.withColumn("l0", F.transform("items", lambda x: x["leaf"]))
    for i in range(BLOCK_LEVELS):
        each = each.withColumn(f"l{i + 1}", F.when(F.col("total") > FANOUT**i, _parents(F.col(f"l{i}"))).otherwise(F.col(f"l{i}")))
    each = each.withColumn("items", F.transform("items", lambda x: x["item"]))
    return each.withColumn("node", F.get(f"l{BLOCK_LEVELS}", F.lit(0))).drop(f"l{BLOCK_LEVELS}")


def _messages(state: DataFrame, span: int) -> DataFrame:
    """A row for each receiver `to` of a block's node in the round in which nodes have ``span`` blocks; `k` is the node's number."""
    number = F.ceil(F.col("total") / BLOCK)
    own = F.floor(F.col("block") / span)
    first = own - own % FANOUT

    def width(k: Column) -> Column:
        return F.least(F.lit(span).cast("long"), F.col("number") - k * span)

    rows = state.withColumn("number", number).withColumn("k", own).withColumn("low", F.col("block") % span)
    met = F.when(F.col("number") > span, F.sequence(first, F.least(first + FANOUT, F.ceil(F.col("number") / span)) - 1)).otherwise(F.array(own))
    rows = rows.withColumn("other", F.explode(met)).withColumn("step", width(F.col("k"))).withColumn("room", width(F.col("other")))
    rows = rows.where(F.col("low") < F.col("room"))
    whole = rows.where(F.col("step") >= F.col("room")).withColumn("at", F.col("low"))
    # a short node's blocks have several partners: dealt before they are listed
    many = F.floor((F.col("room") - 1 - F.col("low")) / F.col("step"))
    short = rows.where(F.col("step") < F.col("room")).withColumn("many", many).withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(many / STRIPE))))
    short = short.repartition("g", "block", "other", "stripe")
    turns = F.sequence(F.col("stripe") * STRIPE, F.least(F.col("many"), F.col("stripe") * STRIPE + STRIPE - 1))
    short = short.withColumn("turn", F.explode(turns)).withColumn("at", F.col("low") + F.col("turn") * F.col("step"))
    to = (F.col("other") * span + F.col("at")).alias("to")
    mine = F.when(F.col("other") == F.col("k"), F.when(F.col("at") == F.col("low"), F.col("ups")))
    return whole.unionByName(short.drop("many", "stripe", "turn")).select("g", to, "total", "k", "node", mine.alias("ups"))


def butterfly(state: DataFrame, keep: Scratch) -> DataFrame:
    """(g, block, total, node, ups): node is the root of the group, ups the siblings (left, right) of the block's ancestors from below.
    state: (g, block, total, node), stored."""
    most = state.agg(F.max("total")).first()[0] or 0
    state = state.select("g", "block", "total", "node", F.array().cast("array<struct<left:string,right:string>>").alias("ups"))
    span = 1
    while span * BLOCK < most:
        met = _messages(state, span).groupBy("g", F.col("to").alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("k", "node"))).alias("nodes"), F.first("ups", ignorenulls=True).alias("ups"), F.first("total").alias("total")
        )
        own, on = F.floor(F.col("block") / span), F.col("total") > span * BLOCK

        def joined(nodes: Column, own: Column = own) -> tuple[Column, Column]:
            def part(pick) -> Column:
                return F.array_join(F.transform(F.filter(nodes, pick), lambda x: x["node"]), "")

            return part(lambda x: x["k"] < own), part(lambda x: x["k"] > own)

        left, right = joined(F.col("nodes"))
        above = F.when(on, _hash(F.transform("nodes", lambda x: x["node"]))).otherwise(F.get("nodes", F.lit(0))["node"])
        ups = F.when(on, F.concat("ups", F.array(F.struct(left.alias("left"), right.alias("right"))))).otherwise(F.col("ups"))
        state = keep(met.select("g", "block", "total", above.alias("node"), ups.alias("ups")), f"round-{span}")
        span *= FANOUT
    return state


def forest(rows: DataFrame) -> DataFrame:
    """(g, block, total, items, levels, root, ups) for each block of the trees of all groups. rows: (g, o, item, leaf)."""
    own = stored(blocks(numbered(rows)), "merkle-blocks")
    with Scratch(rows.sparkSession, "merkle") as keep:
        ups = stored(butterfly(own.select("g", "block", "total", "node"), keep), "merkle-proofs")
    return own.drop("node").join(ups.select("g", "block", F.col("node").alias("root"), "ups"), ["g", "block"])


def members(trees: DataFrame, *more: str) -> DataFrame:
    """(g, item, leaf, root, path) and the columns ``more`` for each leaf. path: the siblings (left, right) of it and its ancestors from below."""

    def siblings(i: int, place: Column) -> Column:
        at = F.floor(place / FANOUT**i).cast("int")
        first = at - at % FANOUT
        nodes = F.col(f"l{i}")
        left, right = F.slice(nodes, first + 1, at - first), F.slice(nodes, at + 2, first + (FANOUT - 1) - at)
        return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

    def one(item: Column, place: Column) -> Column:
        below = F.array(*[F.when(F.col("total") > FANOUT**i, siblings(i, place)) for i in range(BLOCK_LEVELS)])
        return F.struct(item.alias("item"), F.get("l0", place).alias("leaf"), F.array_compact(below).alias("below"))

    each = trees.withColumn("x", F.explode(F.transform("items", one)))
    return each.select("g", "x.item", "x.leaf", "root", F.concat("x.below", "ups").alias("path"), *more)


def proofs(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, changed, subroot, root, path) for each row: what proves that it is in the dataset."""
    trees = forest(leaves(docs))
    tops = trees.where("block = 0").select(F.lit("").alias("g"), F.struct("g").alias("o"), F.struct("g", "total").alias("item"), F.col("root").alias("leaf"))
    tops = members(forest(stored(tops, "merkle-subroots"))).select(F.col("item.g").alias("g"), F.col("item.total").alias("rows"), F.col("root").alias("top"), F.col("path").alias("above"))
    tops = stored(tops, "merkle-sources")
    # a source may have most of the blocks
    sizes = tops.select("g", F.ceil(F.col("rows") / BLOCK).alias("size"))
    deal = Deal(["g"], sizes, sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    met = members(deal.join(trees, tops.drop("rows"), "inner", "block"), "top", "above")
    return met.select("item.doc_id", "leaf", "item.changed", F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("path", "above").alias("path"))


def fold(leaf_: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf_, lambda node, p: F.sha2(F.concat(p["left"], node, p["right"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the tampered leaf, where a row is tampered with) and verified."""
    known = proofs(docs)
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), ""), 256)
    out = known.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
