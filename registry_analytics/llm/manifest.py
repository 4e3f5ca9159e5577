"""Merkle manifest of a dataset in van Emde Boas layout.

Every row is a leaf; the leaves of a language, by ascending id, are a binary tree; the roots of
the languages (subroots) are the leaves of one more tree, whose root names the dataset.

A tree is stored in blocks: aligned subtrees of ``BLOCK_HEIGHT`` levels above their leaves.
The nodes of a block lie in one binary value in van Emde Boas order: a tree of k levels is
its upper k // 2 levels, then the trees below them from left to right, each laid out the
same way. ``address`` finds a node by arithmetic alone, so construction and the look-up of
siblings touch few cache lines whatever their size, and no pointers are stored. The
roots of the blocks are the leaves of the next layer of blocks, and so on until one is left.

Spark deals out the work: leaves are hashed in one pass over the texts, sorted by range and
numbered per tree without a gap; a task builds a block of at most ``2 ** BLOCK_HEIGHT``
leaves; a layer has that many times fewer rows than the one below. Proofs go down again:
the siblings above a block travel to its leaves. A language may hold any share of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_code, written

# levels above the leaves of a block: 1024 leaves, 64 KB of nodes
BLOCK_HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ROW_BITS = 33  # monotonically_increasing_id: partition above, row in it below
_DIGEST = 32


def address(levels: int, depth: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Places of the nodes (depth below the root, index from the left) in a tree of so many
    levels."""
    depth, index = np.broadcast_arrays(np.asarray(depth), np.asarray(index))
    if levels == 1:
        return np.zeros(depth.shape, np.int64)
    top = levels // 2
    bottom = levels - top
    out = np.empty(depth.shape, np.int64)
    high = depth < top
    if high.any():
        out[high] = address(top, depth[high], index[high])
    if not high.all():
        d, i = depth[~high] - top, index[~high]
        below = (1 << top) - 1 + (i >> d) * ((1 << bottom) - 1)
        out[~high] = below + address(bottom, d, i & ((1 << d) - 1))
    return out


@lru_cache(maxsize=64)
def places(levels: int) -> list[list[int]]:
    """Byte offsets of the nodes by height above the leaves (0 first) and index."""
    out = []
    for height in range(levels):
        depth = levels - 1 - height
        index = np.arange(1 << depth)
        out.append((address(levels, np.full_like(index, depth), index) * _DIGEST).tolist())
    return out


def join_nodes(nodes: list[bytes]) -> bytes:
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def build(leaves: list[bytes], height: int) -> bytes:
    """Nodes of the subtree over ``leaves`` (1 to ``2 ** height``) in layout order. The last
    node of a level may have no sibling and is hashed alone; places without a node are 0."""
    at = places(height + 1)
    nodes = bytearray(_DIGEST * ((2 << height) - 1))
    level = leaves
    for h in range(height + 1):
        if h:
            level = [join_nodes(level[i:i + 2]) for i in range(0, len(level), 2)]
        for place, digest in zip(at[h], level):
            nodes[place:place + _DIGEST] = digest
    return bytes(nodes)


def siblings(nodes: bytes, height: int, n: int, index: int) -> list[str]:
    """Per level from leaf ``index`` up to below the block's root: ``L`` or ``R`` (the
    sibling's side) and its digest as hex text, or an empty string without a sibling."""
    at, out = places(height + 1), []
    for h in range(height):
        other = index ^ 1
        if other < n:
            place = at[h][other]
            out.append(("L" if other < index else "R") + nodes[place:place + _DIGEST].hex())
        else:
            out.append("")
        index >>= 1
        n = (n + 1) // 2
    return out


def fold(leaf: str, path: list[str]) -> str:
    """The root that follows from a leaf and the siblings on its way up."""
    for step in path:
        both = leaf if not step else step[1:] + leaf if step[0] == "L" else leaf + step[1:]
        leaf = hashlib.sha256(both.encode()).hexdigest()
    return leaf


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[_field(values[c]) for c in FIELDS]), 256)


def numbered(df: DataFrame, tree: str, order: list[str], label: str) -> DataFrame:
    """``df`` with ``pos``, from 0 without a gap in each ``tree``, and ``n``, its leaves.

    Rows are sorted by range over all trees, so no task holds a whole one. A row's number
    follows from its place in its partition and a table with one row per partition and
    tree that meet.
    """
    rows = written(
        df.repartitionByRange(*[F.col(c) for c in (tree, *order)])
        .sortWithinPartitions(tree, *order).withColumn("__at", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__at", _ROW_BITS)), f"{label}-sorted")
    runs = rows.groupBy(tree, "__part").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(tree).orderBy("__part").rowsBetween(
        Window.unboundedPreceding, -1)
    runs = written(
        runs.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .withColumn("n", F.sum("__n").over(Window.partitionBy(tree)))
        .select(tree, "__part", "n", (F.col("__before") - F.col("__first")).alias("__base")),
        f"{label}-runs")
    return rows.join(runs, [tree, "__part"]).withColumn(
        "pos", F.col("__at") + F.col("__base")).drop("__at", "__part", "__base")


def _height() -> Column:
    """Levels of a block above its leaves: full, unless it is the tree's only one."""
    bits = F.length(F.bin(F.col("n") - 1))
    lone = F.when(F.col("n") == 1, F.lit(0)).otherwise(bits)
    return F.when(F.col("n") <= (1 << BLOCK_HEIGHT), lone).otherwise(
        F.lit(BLOCK_HEIGHT)).cast("int").alias("height")


def _blocks(leaves: DataFrame, layer: int) -> DataFrame:
    """One row per block: ``tree``, ``layer``, ``block``, ``height``, ``n_leaves``, ``nodes``,
    ``root``, and ``n``, the leaves of the layer above. ``leaves``: ``tree``, ``pos``, ``n``,
    ``leaf``."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        height = table.column("height")[0].as_py()
        digests = [bytes.fromhex(x) for x in table.column("leaf").to_pylist()]
        nodes = build(digests, height)
        root = places(height + 1)[height][0]
        first = table.slice(0, 1)
        above = -(-first.column("n")[0].as_py() // (1 << BLOCK_HEIGHT))
        return pa.table({
            "tree": first.column("tree"), "layer": pa.array([layer], pa.int32()),
            "block": first.column("block"), "height": pa.array([height], pa.int32()),
            "n_leaves": pa.array([len(digests)], pa.int32()),
            "nodes": pa.array([nodes], pa.binary()),
            "root": [nodes[root:root + _DIGEST].hex()],
            "n": pa.array([above], pa.int64())})

    dealt = leaves.select("tree", "pos", "n", "leaf", _height(),
                          F.shiftright("pos", BLOCK_HEIGHT).alias("block"))
    return dealt.groupBy("tree", "block").applyInArrow(
        run, "tree string, layer int, block long, height int, n_leaves int, nodes binary, "
             "root string, n long")


def layers(leaves: DataFrame, label: str) -> list[DataFrame]:
    """The stored layers of all trees, the one above the leaves first. Trees end at different
    layers: one is done where it has a single block."""
    out = []
    while True:
        made = written(_blocks(leaves, len(out)), f"{label}-layer{len(out)}")
        out.append(made)
        leaves = made.filter("n > 1").select(
            "tree", F.col("block").alias("pos"), "n", F.col("root").alias("leaf"))
        if leaves.isEmpty():
            return out


def roots(stored: list[DataFrame]) -> DataFrame:
    """``tree``, ``root`` of every tree."""
    out = None
    for layer in stored:
        done = layer.filter("n = 1").select("tree", "root")
        out = done if out is None else out.unionByName(done)
    return out


def _paths(leaves: DataFrame, blocks: DataFrame, columns: str) -> DataFrame:
    """``leaves`` (``tree``, ``block``, ``pos`` and others, without the block's) with ``path``: the
    siblings in their block (a row of ``blocks``), then the block's own ``path``; and ``top``, as
    the block has it."""
    kept = [c for c in leaves.columns if c != "block"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        height, n = (right.column(c)[0].as_py() for c in ("height", "n_leaves"))
        nodes, above, top = (right.column(c)[0].as_py() for c in ("nodes", "path", "top"))
        mask = (1 << BLOCK_HEIGHT) - 1
        paths = [siblings(nodes, height, n, p & mask) + above
                 for p in left.column("pos").to_pylist()]
        return (left.select(kept).append_column("path", pa.array(paths, pa.list_(pa.string())))
                .append_column("top", pa.array([top] * left.num_rows, pa.string())))

    return (leaves.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block"))
            .applyInArrow(run, f"{columns}, path array<string>, top string"))


def proofs(leaves: DataFrame, stored: list[DataFrame], tops: DataFrame, columns: str,
           label: str) -> DataFrame:
    """``leaves`` with ``path``, the siblings from the leaf to the root of the whole, and ``top``.
    ``tops``: ``tree``, ``path`` (the siblings above the tree's own root), ``top`` (a string that
    all leaves of the tree get). ``columns``: the schema of ``leaves``."""
    above = None
    for i, layer in reversed(list(enumerate(stored))):
        own = layer.select("tree", "block", "height", "n_leaves", "nodes")
        ends = own.join(layer.filter("n = 1").select("tree", "block"), ["tree", "block"]).join(
            tops, "tree")
        if above is not None:
            ends = ends.unionByName(own.join(above, ["tree", "block"]))
        cut = F.shiftright("pos", BLOCK_HEIGHT).alias("block")
        if not i:
            return _paths(leaves.select("*", cut), ends, columns)
        below = stored[i - 1].filter("n > 1").select("tree", F.col("block").alias("pos"), cut)
        above = written(_paths(below, ends, "tree string, pos long")
                        .select("tree", F.col("pos").alias("block"), "path", "top"),
                        f"{label}-path{i}")
    raise ValueError("a manifest has a layer at least")


def manifest(df: DataFrame) -> DataFrame:
    """One row per row of ``df`` (columns ``FIELDS``; others are ignored): ``doc_id``, ``leaf``,
    ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``, and ``lang``, ``pos``.

    Rows tampered with: ``n_chars`` is one higher where 7 divides the crc32 of the decimal
    ``doc_id``; a NULL id is left alone, a NULL ``n_chars`` stays NULL, so those rows verify.
    NULL ids come first in their language, the NULL language comes first of all. Rows of
    equal id are ordered by their leaf, so the tree does not depend on the order of the
    input; rows equal in every field are equal leaves side by side, each with a proof of
    its own. Whole texts are hashed; an empty text is not a NULL one. An empty frame gives
    an empty result.
    """
    ship_code(df.sparkSession)
    own = {c: F.col(f"`{c}`") for c in FIELDS}
    more = own | {"n_chars": own["n_chars"].cast("decimal(20,0)") + 1}
    hit = F.crc32(own["doc_id"].cast("string")) % 7 == 0
    # the place in the scan parts equal rows, so that many of them can be dealt out
    hashed = written(df.select(
        own["doc_id"].cast("long").alias("doc_id"), own["lang"].cast("string").alias("lang"),
        F.coalesce(F.concat(F.lit("="), own["lang"]), F.lit("")).alias("tree"),
        leaf_hash(own).alias("leaf"),
        F.when(hit & own["n_chars"].isNotNull(), leaf_hash(more)).alias("other"),
        F.monotonically_increasing_id().alias("scan")), "manifest-leaves")
    leaves = written(numbered(hashed, "tree", ["doc_id", "leaf", "scan"], "manifest").drop("scan"),
                     "manifest-numbered")
    stored = layers(leaves, "manifest")

    subroots = roots(stored).withColumnRenamed("root", "subroot")
    whole = written(
        numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "subroot"),
                 "tree", ["name"], "manifest-top"), "manifest-top")
    over = layers(whole.select("tree", "pos", "n", F.col("subroot").alias("leaf")),
                  "manifest-top")
    start = written(df.sparkSession.range(1).select(
        F.lit("").alias("tree"), F.array().cast("array<string>").alias("path"),
        F.lit("").alias("top")), "manifest-start")
    tops = proofs(whole.select("tree", "pos", "name", "subroot"), over, start,
                  "tree string, pos long, name string, subroot string", "manifest-top")
    # the subroot goes down with the path: no join of all rows by their language
    tops = written(tops.select(F.col("name").alias("tree"), "path", F.col("subroot").alias("top")),
                   "manifest-tops")
    root = roots(over).select("root")
    proven = proofs(leaves.select("doc_id", "lang", "tree", "pos", "leaf", "other"), stored, tops,
                    "doc_id long, lang string, tree string, pos long, leaf string, other string",
                    "manifest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("leaf", "other", "path")))
            proof, folded = [], []
            for leaf, other, path in rows:
                proof.append(hashlib.sha256("".join(s[1:] for s in path).encode()).hexdigest())
                folded.append(fold(other or leaf, path))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "lang", "pos", "leaf", "top")]
                + [pa.array(proof, pa.string()), pa.array(folded, pa.string())],
                names=["doc_id", "lang", "pos", "leaf", "subroot", "proof_sha256", "folded_root"])

    checked = proven.mapInArrow(
        run, "doc_id long, lang string, pos long, leaf string, subroot string, "
             "proof_sha256 string, folded_root string")
    return (checked.withColumn("root", root.scalar())
            .withColumn("verified", F.col("folded_root") == F.col("root"))
            .select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified",
                    "lang", "pos"))
