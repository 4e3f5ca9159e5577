"""N-gram Jaccard join with parity sketches.

A document is the set of its word n-grams. Each element flips one bit of a bit sketch, so
the Hamming distance of two sketches is at most the size of the symmetric difference of
the sets. Sets of sizes x <= y with Jaccard similarity t or more satisfy y <= x / t and
differ in at most x (1 - t) / t elements.

1. Size bands: [lo, hi] with lo / hi about t squared, so linked sets lie in one band or in
   neighbouring ones. In band b the difference is at most D = hi (1 - t) / t.
2. The sketch of a band has D + 1 + K parts of 64 bits: 40 of parity, 24 of the XOR of the
   elements' hashes. Linked sketches differ in at most D
   parts, so they agree in at least K + 1 (pigeonhole). Parts without a set bit say
   little; a sketch with at most K of them is joined on its other parts only, which
   still include an agreeing one. Other sketches are joined on all parts. A set is
   sketched for its own band and, if a linked set can lie in the band below, for that.
3. Equal sets are one class. Classes that share a part value form a bucket; all buckets of a
   band with the same centre (the member with most copies, then the largest hash) are one
   group. So a linked pair lies together in some group, and a group has sketches of one
   shape.
4. A group is dealt into blocks of bounded size. For every pair of blocks one task compares
   the sketches and returns a spanning forest of the pairs whose Hamming distance does not
   rule a link out: at most one row per member, never all pairs. A sketch has about a ninth
   of its set's size, so sets are only read for the few that are left.
5. The edges of the forests are verified on the sets. If all hold, their components are those
   of the links. Where one fails, the forest may have stood for other links: the members of
   such a component are compared once more in their groups, now on the sets, by a product
   of incidence matrices.

Buckets, groups and blocks have no cap and nothing is dropped. A group of m members costs
about m squared / block size rows to deal out; exact copies do not count as members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import release_unused
from .common import held, released, scratch, ship_code, written
from .components import components
from .hashing import GOLDEN, Hashes, lists, mixed

# a block has about so many members and elements at most
BLOCK_NODES = 256
BLOCK_ELEMENTS = 400_000
# the same for blocks of sketches
SKETCH_NODES = 1024
SKETCH_ELEMENTS = 2_000_000
PARITY_BITS = 40
# representatives of candidate classes, classes of several rows and members of groups (four numbers
# each at most) that may be broadcast; more are joined by a shuffle
MAX_BROADCAST_ROWS = 1_000_000
_COLUMNS = 4096
_SLICE = 512
_CACHE_WORDS = 200_000
_ADDED = ("n_shingles", "class_id", "component", "component_id")


def shingles(text: str, n: int, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of words; fewer words than n are one n-gram.
    A-Z are lower-cased, words end at ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = mixed(out * GOLDEN + h[i:i + len(out)])
    return np.unique(out)


class Bands:
    """Size bands and sketch shapes for the threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.edges = [1]  # first size of each band

    def _grow(self, size: int) -> None:
        while self.edges[-1] <= size:
            lo = self.edges[-1]
            self.edges.append(lo * self.den * self.den // (self.num * self.num) + 1)

    def of(self, size: int) -> int:
        self._grow(size)
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def reaches_below(self, size: int, band: int) -> bool:
        """Can a set of this size be linked to a smaller one in the band below?"""
        return band > 0 and self.num * size <= self.den * (self.edges[band] - 1)

    def shape(self, band: int) -> tuple[int, int]:
        """Number of parts and K, the parts a sketch may leave out."""
        self._grow(self.edges[band])
        lo, hi = self.edges[band], self.edges[band + 1] - 1
        differ = hi * (self.den - self.num) // self.num
        # about as many parts stay empty at the lower edge of the band, and some to spare
        empty = (differ + 1) * np.exp(-lo / (differ + 1))
        spare = int(np.ceil(empty + 2 * np.sqrt(empty))) if differ else 0
        return differ + 1 + spare, spare


def sketch(elements: np.ndarray, n_parts: int) -> np.ndarray:
    """Parity sketch: every element flips one of ``PARITY_BITS`` bits of its part; above them a
    part has the XOR of its elements' hashes, so that parts of few elements tell them apart."""
    parts = np.zeros(n_parts, np.uint64)
    at = ((elements >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int64)
    bit = (elements & np.uint64(255)) % np.uint64(PARITY_BITS)
    above = (elements >> np.uint64(8)) << np.uint64(PARITY_BITS)
    np.bitwise_xor.at(parts, at, above | np.uint64(1) << bit)
    return parts


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of sketches (along the last axis) in their parity bits: no more than the
    sizes of the symmetric differences of the sets."""
    parity = np.uint64((1 << PARITY_BITS) - 1)
    return np.bitwise_count((a ^ b) & parity).sum(-1, dtype=np.int64)


def sketches_of(elements: np.ndarray, bands: Bands) -> list[tuple[int, bool, np.ndarray]]:
    """Band, whether parts without a set bit are joined too, and the sketch, for the own
    band of a set and for the one below if a linked set can lie there."""
    size = len(elements)
    own = bands.of(size)
    out = []
    for band in (own, own - 1) if bands.reaches_below(size, own) else (own,):
        n_parts, spare = bands.shape(band)
        parts = sketch(elements, n_parts)
        out.append((band, n_parts - int((parts != 0).sum()) > spare, parts))
    return out


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Hashes]]:
    """Slices of the batches, with the worker's table of word hashes."""
    hashes = held("ngram_join", Hashes)
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            if len(hashes) > _CACHE_WORDS:
                hashes.clear()
            yield batch.slice(at, _SLICE), hashes
    hashes.clear()  # the caller's loop still names it
    released()


def _longs(values: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=ends[1:])
    return lists(np.concatenate(values) if values else np.empty(0, np.uint64), ends)


_SKETCHES = T.ArrayType(T.StructType().add("band", "integer").add("whole", "boolean")
                        .add("parts", T.ArrayType(T.LongType())))


def sketches(df: DataFrame, n: int, num: int, den: int, text_col: str = "text") -> DataFrame:
    """``df`` with ``n_shingles``, ``node`` and ``check`` (128 bits of the set's hash; NULL
    for an empty set) and ``sketches``."""
    ship_code(df.sparkSession)
    names = ["n_shingles", "node", "check", "sketches"]
    kept = [c for c in df.columns if c not in names]
    schema = (df.select(*[F.col(f"`{c}`") for c in kept]).schema.add("n_shingles", "long")
              .add("node", "long").add("check", "long").add("sketches", _SKETCHES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for part, hashes in _sliced(batches):
            sets = [shingles(t or "", n, hashes) for t in part.column(text_col).to_pylist()]
            ids = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) if len(s)
                   else (None, None) for s in sets]
            made = [sketches_of(s, bands) if len(s) else [] for s in sets]
            flat = [x for each in made for x in each]
            ends = np.zeros(len(made) + 1, np.int32)
            np.cumsum([len(each) for each in made], out=ends[1:])
            structs = pa.StructArray.from_arrays(
                [pa.array([x[0] for x in flat], pa.int32()),
                 pa.array([x[1] for x in flat], pa.bool_()), _longs([x[2] for x in flat])],
                names=["band", "whole", "parts"])
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in kept] + [
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([i[0] for i in ids], pa.int64()),
                    pa.array([i[1] for i in ids], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), structs)],
                names=kept + names)

    return df.mapInArrow(run, schema)


def _sets(df: DataFrame, n: int) -> DataFrame:
    """``node``, ``elements`` of the texts of ``df`` (``text``, ``node``); a text of another
    set than its ``node`` is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, hashes in _sliced(batches):
            nodes = part.column("node").to_pylist()
            sets = [shingles(t or "", n, hashes) for t in part.column("text").to_pylist()]
            own = [i for i, (s, node) in enumerate(zip(sets, nodes)) if len(s) and node ==
                   int(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)[0])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([nodes[i] for i in own], pa.int64()), _longs([sets[i] for i in own])],
                names=["node", "elements"])

    return df.select("node", "text").mapInArrow(run, "node long, elements array<long>")


def _forest(nodes: np.ndarray, sets: list[np.ndarray], num: int, den: int
            ) -> list[tuple[int, int]]:
    """Spanning forest of the links among the given sets."""
    sizes = np.array([len(e) for e in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[ids] > 1  # the others are in no intersection
    column = np.cumsum(counts > 1) - 1
    owner, ids = owner[shared], column[ids[shared]]
    order = np.argsort(ids, kind="stable")
    owner, ids = owner[order], ids[order]
    common = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, int(ids[-1]) + 1 if len(ids) else 0, _COLUMNS):
        lo, hi = np.searchsorted(ids, (at, at + _COLUMNS))
        part = np.zeros((len(sets), _COLUMNS), np.float32)  # sums below 2 ** 24 are exact
        part[owner[lo:hi], ids[lo:hi] - at] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    up = list(range(len(sets)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    edges = []
    for i, j in np.argwhere(np.triu(common * den >= union * num, 1)).tolist():
        a, b = root(i), root(j)
        if a != b:
            up[a] = b
            edges.append((int(nodes[i]), int(nodes[j])))
    return edges


def _near_forest(nodes: np.ndarray, sizes: np.ndarray, parts: np.ndarray, num: int, den: int
                 ) -> list[tuple[int, int]]:
    """Spanning forest of the pairs whose sketches (sets x parts) do not rule a link out: linked
    sets of x and y elements differ in at most (x + y) (den - num) / (den + num)."""
    edges, found = [], []
    left = np.arange(len(nodes))
    while len(left):
        if found:
            i = found.pop()
        else:
            i, left = left[0], left[1:]
        near = apart(parts[left], parts[i]) * (den + num) <= (
            sizes[left] + sizes[i]) * (den - num)
        edges += [(int(nodes[i]), int(nodes[j])) for j in left[near]]
        found += left[near].tolist()
        left = left[~near]
    return edges


def _dealt(members: DataFrame, max_nodes: int, max_elements: int) -> DataFrame:
    """``members`` (``grp``, ``node``, ``n`` and others) once for every ``task``, a pair of blocks of
    its group."""
    blocks = members.groupBy("grp").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / max_nodes), F.ceil(F.sum("n") / max_elements))
        .cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64(F.lit(9), "node"), F.col("blocks")).cast("int")
    return (members.join(blocks, "grp").withColumn("own", own)
            .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
            .withColumn("task", F.xxhash64("grp", F.least("own", "other"),
                                           F.greatest("own", "other")))
            .drop("grp", "blocks", "own", "other"))


def _arrays(values: pa.ChunkedArray) -> list[np.ndarray]:
    values = values.combine_chunks()
    ends = np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(values.flatten().to_numpy(zero_copy_only=False), ends[:-1])


def _edges(edges: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()),
                     "b": pa.array([b for _, b in edges], pa.int64())})


def _likely_links(members: DataFrame, parts: DataFrame, num: int, den: int) -> DataFrame:
    """Forest edges ``a``, ``b`` of every group by its sketches. ``members``: ``grp``, ``band``,
    ``node``, ``n``; ``parts``: ``node``, ``band``, ``parts``."""

    def compare(table: pa.Table) -> pa.Table:
        return _edges(_near_forest(
            table.column("node").to_numpy(), table.column("n").to_numpy(),
            np.stack(_arrays(table.column("parts"))).view(np.uint64), num, den))

    dealt = _dealt(members, SKETCH_NODES, SKETCH_ELEMENTS)
    return (dealt.join(parts, ["node", "band"]).select("task", "node", "n", "parts")
            .groupBy("task").applyInArrow(compare, "a long, b long")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _links(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Forest edges ``a``, ``b`` of every group by its sets. ``members``: ``grp``, ``node``,
    ``n``."""

    def compare(table: pa.Table) -> pa.Table:
        return _edges(_forest(table.column("node").to_numpy(), _arrays(table.column("elements")),
                              num, den))

    dealt = _dealt(members, BLOCK_NODES, BLOCK_ELEMENTS).select("task", "node")
    return (dealt.join(sets, "node").groupBy("task").applyInArrow(compare, "a long, b long")
            .distinct())


def _verified(edges: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``edges`` with ``holds``: are these two sets linked?"""
    a = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
    b = sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    common = F.size(F.array_intersect("ea", "eb")).cast("long")
    union = F.size("ea") + F.size("eb") - common
    return edges.join(a, "a").join(b, "b").select(
        "a", "b", (common * den >= union * num).alias("holds"))


def _few(rows: DataFrame) -> DataFrame:
    """A written table for a join: broadcast up to ``MAX_BROADCAST_ROWS``."""
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST_ROWS else rows


def _named(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The rows ``carried``, ``id`` with ``n_shingles``, ``node``, ``check``; and of every ``node``,
    ``check`` its ``component``, ``component_id``. ``docs``: ``carried``, ``id``, ``text``."""
    # sketches are the widest column: they are written here only, and read by their row's place
    rows = written(sketches(docs, n, num, den).drop("text").withColumn(
        "at", F.monotonically_increasing_id()), "join-rows", lasting=True)
    classes = written(
        rows.filter(F.col("node").isNotNull()).groupBy("node", "check", "n_shingles").agg(
            F.count(F.lit(1)).alias("copies"), F.min("id").alias("least_id"),
            F.min("at").alias("first")), "join-classes")

    several = classes.filter("copies > 1").select("node", "check", "copies", "first")
    sketched = (rows.filter(F.col("node").isNotNull())
                .join(_few(several), ["node", "check"], "left")
                .filter(F.col("first").isNull() | (F.col("first") == F.col("at"))))
    parts = sketched.select(
        "node", F.coalesce("copies", F.lit(1).cast("long")).alias("copies"),
        F.explode("sketches").alias("x")).select("node", "copies", "x.band", "x.whole", "x.parts")
    by_key = Window.partitionBy("key")
    buckets = (parts.select("node", "copies", "band", "whole", F.posexplode("parts"))
               .filter((F.col("col") != 0) | F.col("whole"))
               .select("node", "copies", "band", F.xxhash64("band", "pos", "col").alias("key"))
               .withColumn("m", F.count(F.lit(1)).over(by_key))
               .withColumn("top", F.max(F.struct("copies", "node")).over(by_key)).filter("m > 1"))
    # all buckets of one centre and band are one group
    pairs = written(buckets.filter(F.col("node") != F.col("top.node"))
                    .select(F.col("top.node").alias("centre"), "band", "node").distinct(),
                    "join-pairs")
    release_unused(docs.sparkSession)  # the parts of all sketches
    grouped = pairs.unionByName(
        pairs.select("centre", "band", F.col("centre").alias("node")).distinct())
    members = written(
        grouped.join(classes.select("node", F.col("n_shingles").alias("n")), "node")
        .select(F.xxhash64("centre", "band").alias("grp"), "band", "node", "n"), "join-members")
    met = _few(written(members.select("node").distinct(), "join-met"))
    likely = written(_likely_links(members, parts.join(met, "node", "left_semi").select(
        "node", "band", "parts"), num, den), "join-likely")

    nodes = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    reps = written(classes.join(nodes, "node", "left_semi").select("node", "least_id"),
                   "join-reps")
    texts = (docs.select("id", "text").join(_few(reps), F.col("id").eqNullSafe(F.col("least_id")))
             .select("node", "text"))
    # rows that repeat an id and text give the same set again
    sets = written(_sets(texts, n).groupBy("node").agg(F.first("elements").alias("elements")),
                   "join-sets")
    checked = written(_verified(likely, sets, num, den), "join-checked")
    links = checked.filter("holds").select("a", "b")
    if not checked.filter("not holds").isEmpty():
        # links lie within the components of likely ones; those with a wrong edge anew
        wide = components(likely)
        torn = wide.join(checked.filter("not holds").select(F.col("a").alias("node")).join(
            wide, "node").select("component").distinct(), "component", "left_semi")
        again = members.join(torn, "node").select(
            F.xxhash64("grp", "component").alias("grp"), "node", "n")
        links = links.unionByName(_links(again, sets, num, den))
    comps = components(written(links, "join-links"))

    named = classes.join(comps, "node", "left").select(
        "node", "check", F.coalesce("component", "node").alias("component"), "least_id")
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return rows.drop("sketches", "at"), written(
        named.join(least, "component").select("node", "check", "component", "component_id"),
        "join-named", lasting=True)


def jaccard_components(df: DataFrame, n: int = 5, num: int = 80, den: int = 100,
                       id_col: str = "doc_id", text_col: str = "text",
                       carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``df``: the columns ``carry`` (default: the id; those named like a
    new one are replaced), ``n_shingles``,
    ``class_id`` (a hash naming its set; NULL for an empty one) and ``component_id``: the
    smallest id reachable over links den * |A & B| >= num * |A | B|.

    NULL and texts without words have an empty set, are linked with nothing and are a
    component of their own (``component_id`` is their id). Texts of fewer than n words are
    one n-gram. Equal sets are linked. Rows with equal ids and different texts are
    different sets; a component without any id has a NULL ``component_id``, but
    ``class_id`` and ``component`` (a hash naming the component, NULL for an empty set) still
    tell it apart. Whole texts are read; an empty frame gives an empty result. Two sets count
    as equal if 128 bits of hash agree.
    """
    carry = [c for c in carry or [id_col] if c not in _ADDED]
    ident = F.col(f"`{id_col}`")
    docs = df.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried"),
                     ident.alias("id"), F.col(f"`{text_col}`").alias("text"))
    with scratch(df.sparkSession):
        rows, named = _named(docs, n, num, den)
    return rows.join(named, ["node", "check"], "left").select(
        *[F.col("carried").getField(c).alias(c) for c in carry], "n_shingles",
        F.col("node").alias("class_id"), "component",
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
        .alias("component_id"))
