"""Document fingerprints: a Merkle tree over paragraphs and sections.

A text is cut into segments (its own content decides where: a segment ends at a word whose
hash is divisible by ``CUT``), segments into paragraphs (lines) and paragraphs into sections
(a section ends at a paragraph whose hash is divisible by ``SECTION``, so an insertion moves
no later boundary). Every inner hash covers the hashes of its children and the number of code
points below. Equal roots mean equal texts; where roots differ, only branches with
different hashes are followed, down to the segments that were edited.

``likeness`` of two trees is the share of code points under segments that both have
(counted with multiplicity): 2 x common / (both lengths).
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship_code, shuffle_partitions, written

CUT = 2
SECTION = 4
# a word with the white space after it; white space at the start is a piece of its own
_PIECE = re.compile(r"[^ \t\n\v\f\r]+[ \t\n\v\f\r]*|[ \t\n\v\f\r]+")
_SLICE = 256
_CACHE_PIECES = 500_000


def _digest(kind: bytes, parts: list[bytes], n_chars: int) -> bytes:
    return hashlib.blake2b(kind + n_chars.to_bytes(8, "big") + b"".join(parts),
                           digest_size=16).digest()


@dataclass(slots=True)
class Node:
    """A node: its hash, first code point, length and children (none: a segment)."""

    hash: bytes
    start: int
    n_chars: int
    children: list[Node] = field(default_factory=list)


class _Ends(dict):
    """Does a segment end at this piece? Remembered, since words repeat."""

    def __missing__(self, piece: str) -> bool:
        if len(self) > _CACHE_PIECES:
            self.clear()
        end = self[piece] = xxhash.xxh3_64_intdigest(piece.rstrip()) % CUT == 0
        return end


_ENDS_AT = _Ends()


def _segments(line: str, start: int) -> list[Node]:
    out, at, held = [], start, []
    for piece in _PIECE.findall(line):
        held.append(piece)
        if _ENDS_AT[piece]:
            text = "".join(held)
            out.append(Node(xxhash.xxh3_128_digest(text), at, len(text)))
            at += len(text)
            held = []
    if held:
        text = "".join(held)
        out.append(Node(xxhash.xxh3_128_digest(text), at, len(text)))
    return out


def _parent(kind: bytes, children: list[Node], start: int) -> Node:
    n = sum(c.n_chars for c in children)
    return Node(_digest(kind, [c.hash for c in children], n), start, n, children)


def tree(text: str, known: dict | None = None) -> Node:
    """The Merkle tree of a whole text; a line keeps its line feed. ``known`` collects the
    paragraphs by place and line and saves those that another text has there too."""
    sections, paragraphs, at = [], [], 0
    for line in _lines(text):
        paragraph = known.get((at, line)) if known is not None else None
        if paragraph is None:
            paragraph = _parent(b"p", _segments(line, at), at)
            if known is not None:
                known[at, line] = paragraph
        at += len(line)
        paragraphs.append(paragraph)
        if int.from_bytes(paragraph.hash[:4], "big") % SECTION == 0:
            sections.append(_parent(b"s", paragraphs, paragraphs[0].start))
            paragraphs = []
    if paragraphs:
        sections.append(_parent(b"s", paragraphs, paragraphs[0].start))
    return _parent(b"r", sections, 0)


def _lines(text: str) -> list[str]:
    cut = text.split("\n")
    return [x + "\n" for x in cut[:-1]] + ([cut[-1]] if cut[-1] else [])


def leaves(root: Node) -> list[Node]:
    """The segments of a tree in order."""
    return [g for section in root.children for paragraph in section.children
            for g in paragraph.children]


def leaf_counts(root: Node) -> tuple[Counter, dict[bytes, int]]:
    """Occurrences and code points of each segment."""
    parts = leaves(root)
    return Counter([g.hash for g in parts]), {g.hash: g.n_chars for g in parts}


def edits(old: Node, new: Node) -> list[tuple[int, int]]:
    """Spans (first code point, length) of ``new`` that ``old`` lacks. Level by level,
    branches with equal hashes are paired off and only the others are followed."""
    olds, news = [old], [new]
    while news:
        left = Counter(n.hash for n in olds)
        changed = []
        for node in news:
            if left[node.hash] > 0:
                left[node.hash] -= 1
            else:
                changed.append(node)
        if not any(n.children for n in changed):
            return [(n.start, n.n_chars) for n in changed if n.n_chars]
        gone = [n for n in olds if left[n.hash] > 0]
        olds = [c for n in gone for c in n.children]
        news = [c for n in changed for c in n.children]
    return []


def likeness(a: Node, b: Node, a_counts=None, b_counts=None) -> float:
    """Share of code points in common segments, 0 to 1; two empty texts are alike.
    ``leaf_counts`` of the trees may be given."""
    if a.hash == b.hash:
        return 1.0
    (left, sizes), (right, _) = a_counts or leaf_counts(a), b_counts or leaf_counts(b)
    common = sum([min(left[h], right[h]) * sizes[h] for h in left.keys() & right.keys()])
    return 2.0 * common / (a.n_chars + b.n_chars)


def edited_text(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the start of ``following``."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def fingerprints(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``fingerprint`` (the root), and the branches ``sections`` (hex hashes) and
    ``paragraphs`` (hex hash, first code point, length). NULL counts as the empty text.
    Columns with these names are replaced; every row is read whole and by itself."""
    ship_code(df.sparkSession)
    names = ["fingerprint", "sections", "paragraphs"]
    kept = [c for c in df.columns if c not in names]
    span = T.StructType().add("hash", "string").add("start", "integer").add("n_chars", "integer")
    schema = (df.select(*[F.col(f"`{c}`") for c in kept]).schema.add("fingerprint", "string")
              .add("sections", T.ArrayType(T.StringType())).add("paragraphs", T.ArrayType(span)))
    types = [pa.string(), pa.list_(pa.string()), pa.list_(pa.struct(
        [("hash", pa.string()), ("start", pa.int32()), ("n_chars", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                roots = [tree(t or "") for t in part.column(text_col).to_pylist()]
                values = [[r.hash.hex() for r in roots],
                          [[s.hash.hex() for s in r.children] for r in roots],
                          [[{"hash": p.hash.hex(), "start": p.start, "n_chars": p.n_chars}
                            for s in r.children for p in s.children] for r in roots]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept] + list(map(pa.array, values, types)),
                    names=kept + names)

    return df.mapInArrow(run, schema)


_COMPARED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")
_ENDS = "kind string, part int, " + _COMPARED + ", n_same long, text string"


def _compare(doc_id, text: str, own: Node, known: dict, counts, following: str, nxt: Node,
             nxt_counts) -> dict:
    changed = edited_text(text, following)
    root = tree(changed, known)
    return {"doc_id": doc_id, "n_chars": len(text),
            "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(),
            "fingerprint": own.hash.hex(), "edited_fingerprint": root.hash.hex(),
            "near_edited": likeness(own, root, counts),
            "near_next": likeness(own, nxt, counts, nxt_counts)}


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text and the next document (ids ascending, NULL
    first; the last is followed by the first).

    Documents are range-partitioned and sorted, so a task sees a document and its follower
    in one pass and holds two texts at a time. Only the first and last document of each
    task are matched afterwards, one row per task. Rows of one id are ordered by a hash of
    the text; rows with equal id and text are one document, repeated as often as given (its
    follower is the next different one). A single document follows itself. NULL texts are
    empty.
    """
    spark = df.sparkSession
    ship_code(spark)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                     F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    parts = docs.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(
        *order, "text").withColumn("part", F.spark_partition_id())
    schema = spark.createDataFrame([], _ENDS).schema
    arrow = pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(),
                                 "double": pa.float64()}.get(f.dataType.simpleString(),
                                                             pa.string())) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # what waits for its follower: id, text, tree, paragraphs, counts, repeats
        part, out = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                rows = batch.slice(at, _SLICE).to_pylist()
                for row in rows:
                    now = (row["doc_id"], row["text"])
                    if before is None:
                        part = row["part"]
                        out.append({"kind": "first", "part": part, "doc_id": now[0],
                                    "text": now[1]})
                    elif before[:2] == now:
                        before = (*before[:5], before[5] + 1)
                        continue
                    known: dict = {}
                    root = tree(now[1], known)
                    counts = leaf_counts(root)
                    if before is not None:
                        done = _compare(*before[:5], now[1], root, counts)
                        out += [{"kind": "done", **done}] * before[5]
                    before = (*now, root, known, counts, 1)
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if before is not None:
            yield pa.RecordBatch.from_pylist([{
                "kind": "last", "part": part, "doc_id": before[0], "text": before[1],
                "n_same": before[5]}], arrow)

    seen = written(parts.mapInArrow(run, schema), "merkle")
    # one first and one last row per task; the last follower is the very first document
    ends = seen.filter("kind <> 'done'").groupBy("part").agg(
        F.max(F.when(F.col("kind") == "last", F.struct("doc_id", "text", "n_same"))).alias("last"),
        F.max(F.when(F.col("kind") == "first", F.struct("doc_id", "text"))).alias("first"))
    firsts = ends.select(F.col("part").alias("p"), F.col("first.text").alias("following"))
    used = ends.agg(F.sort_array(F.collect_list("part")).alias("parts"))  # task numbers
    follow = used.select(F.explode(F.zip_with(
        "parts", F.concat(F.slice("parts", 2, F.greatest(F.size("parts"), F.lit(1))),
                          F.slice("parts", 1, 1)),
        lambda a, b: F.struct(a.alias("part"), b.alias("p")))).alias("x")).select("x.part", "x.p")
    open_ends = ends.join(follow, "part").join(firsts, "p").select(
        "last.doc_id", "last.text", "last.n_same", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        final = pa.schema([arrow.field(n) for n in (
            "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
            "near_edited", "near_next")])
        for batch in batches:
            for row in batch.to_pylist():
                known: dict = {}
                own, nxt = tree(row["text"], known), tree(row["following"])
                done = _compare(row["doc_id"], row["text"], own, known, leaf_counts(own),
                                row["following"], nxt, leaf_counts(nxt))
                for _ in range(row["n_same"]):
                    yield pa.RecordBatch.from_pylist([done], final)

    names = [f.split()[0] for f in _COMPARED.split(", ")]
    return seen.filter("kind = 'done'").select(*names).unionByName(
        open_ends.mapInArrow(finish, _COMPARED))
