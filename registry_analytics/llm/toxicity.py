"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. Evidence words: words and word beginnings that are much more frequent in documents
   labelled toxic (likelihood ratio over a bounded sample of labelled training rows).
2. Voters: small public lexicons, groups of evidence words and surface patterns. Each votes
   or stays silent on every document.
3. Label model: a generative model of the votes given the hidden label, fitted by EM on
   the counts of all vote patterns of all documents; patterns of labelled training rows
   carry their label. It estimates every voter's accuracy and, along the strongest
   dependency tree, how voters correlate given the label.
4. A logistic regression on evidence and votes is trained on the model's posterior labels
   of a bounded sample of documents that are not held out. It scores every document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship_code, written

# bounds of what is fitted on samples
MAX_LABELLED = 60_000
MAX_FIT_ROWS = 50_000
MAX_EVIDENCE = 4_000
MIN_LIKELIHOOD_RATIO = 30.0
MIN_RATE_RATIO = 4.0
THRESHOLD = 0.3

# public English insults, by theme
LEXICONS = {
    "mind": "idiot idiots moron morons stupid dumb imbecile cretin fool fools brainless",
    "worth": "worthless pathetic loser losers useless failure trash garbage scum vermin",
    "disgust": "disgusting filthy vile revolting repulsive nasty sickening pig pigs",
    "ridicule": "clown clowns joke laughable ridiculous coward cowards freak creep",
}
_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"\b[A-Z]{3,}\b")
_PREFIXES = (4, 5, 6)
_SLICE = 512
VOTERS = (*LEXICONS, "evidence_a", "evidence_b", "evidence_c", "beginnings", "two_hits",
          "shouting")


def features(text: str) -> set[str]:
    """Words of a text, lower-cased, and their beginnings (marked ``*``)."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in _PREFIXES if len(w) > n}


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    return F.crc32(ident) % 4 == 2


def evidence(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic") -> list[str]:
    """Words and beginnings that speak for the label, the strongest first, at most
    ``MAX_EVIDENCE``. ``labelled`` is a bounded sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                toxic, clean = Counter(), Counter()
                for text, label in zip(part.column(text_col).to_pylist(),
                                       part.column(label_col).to_pylist()):
                    (toxic if label else clean).update(features(text or ""))
                words = list(toxic | clean)
                yield pa.RecordBatch.from_pydict({
                    "word": words, "a": pa.array([toxic[w] for w in words], pa.int64()),
                    "b": pa.array([clean[w] for w in words], pa.int64())})

    seen = (labelled.select(text_col, label_col)
            .mapInArrow(count, "word string, a long, b long")
            .groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    n1, n0 = labelled.agg(F.count_if(F.col(label_col) == 1),
                          F.count_if(F.col(label_col) == 0)).first()
    if not n1 or not n0:
        return []
    rate1, rate0 = (F.col("a") + 0.5) / (n1 + 1), (F.col("b") + 0.5) / (n0 + 1)
    both = (F.col("a") + F.col("b") + 1.0) / (n1 + n0 + 2)

    def part(hit: Column, n: int, rate: Column) -> Column:
        return hit * F.log(rate / both) + (n - hit) * F.log((1 - rate) / (1 - both))

    ratio = 2 * (part(F.col("a"), n1, rate1) + part(F.col("b"), n0, rate0))
    strong = seen.filter((F.col("a") > 1) & (rate1 > MIN_RATE_RATIO * rate0)).withColumn(
        "ratio", ratio).filter(F.col("ratio") >= MIN_LIKELIHOOD_RATIO)
    top = strong.orderBy(F.desc("ratio"), "word").limit(MAX_EVIDENCE)
    return [r.word for r in top.select("word").collect()]


def cast_votes(df: DataFrame, words: list[str], text_col: str = "text") -> DataFrame:
    """``df`` without its text, with ``hits`` (evidence and voters found) and ``votes`` (a
    bit per voter)."""
    ship_code(df.sparkSession)
    known = set(words)
    themes = {w: name for name, line in LEXICONS.items() for w in line.split()}
    kept = [c for c in df.columns if c not in (text_col, "hits", "votes")]
    schema = (df.select(*[F.col(f"`{c}`") for c in kept]).schema
              .add("hits", T.ArrayType(T.StringType())).add("votes", "integer"))

    groups = {w: "beginnings" if w[-1] == "*" else "evidence_" + "abc"[i % 3]
              for i, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = {w[:-1] for w in known if w[-1] == "*"}
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                hits, votes = [], []
                for text in part.column(text_col).to_pylist():
                    text = text or ""
                    tokens = set(_WORD.findall(text.lower()))
                    found = tokens & known
                    if begins:
                        found |= {w[:n] + "*" for w in tokens for n in _PREFIXES
                                  if w[:n] in begins and len(w) > n}
                    on = {themes[w] for w in tokens & themes.keys()}
                    on |= {groups[w] for w in found}
                    if len(tokens & known | tokens & themes.keys()) > 1:
                        on.add("two_hits")
                    if len(_SHOUT.findall(text)) > 5:
                        on.add("shouting")
                    hits.append(sorted(found) + sorted("voter " + v for v in on))
                    votes.append(sum(1 << i for i, v in enumerate(VOTERS) if v in on))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept] + [pa.array(hits, pa.list_(pa.string())),
                                                      pa.array(votes, pa.int32())],
                    names=kept + ["hits", "votes"])

    return df.mapInArrow(run, schema)


class LabelModel:
    """Votes v given the hidden label y: P(y) prod_j P(v_j | v_parent(j), y), with the
    parents from a maximum spanning tree of the mutual information given y."""

    def __init__(self, n_voters: int, prior: float = 0.1):
        self.n, self.prior = n_voters, prior
        self.parent = [-1] * n_voters
        # voters speak rarely, and more often when the label holds
        self.p = np.empty((n_voters, 2, 2))  # P(vote | parent's vote, y)
        self.p[:, :, 0], self.p[:, :, 1] = 0.02, 0.4

    def _log_joint(self, bits: np.ndarray) -> np.ndarray:
        out = np.tile(np.log([1 - self.prior, self.prior]), (len(bits), 1))
        for j in range(self.n):
            up = bits[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(bits), int)
            for y in (0, 1):
                p = self.p[j, up, y]
                out[:, y] += np.log(np.where(bits[:, j] == 1, p, 1 - p))
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        joint = self._log_joint(self._bits(votes))
        return 1 / (1 + np.exp(np.clip(joint[:, 0] - joint[:, 1], -60, 60)))

    def _bits(self, votes: np.ndarray) -> np.ndarray:
        return (votes[:, None] >> np.arange(self.n)) & 1

    def _tree(self, bits: np.ndarray, weight: np.ndarray) -> list[int]:
        """Chow-Liu: parent of each voter. ``weight``: rows x label."""
        info = np.zeros((self.n, self.n))
        total = weight.sum()
        for i in range(self.n):
            for j in range(i):
                for y in (0, 1):
                    w = weight[:, y]
                    n_y = w.sum() + 4e-3
                    for a in (0, 1):
                        for b in (0, 1):
                            p_ab = (w[(bits[:, i] == a) & (bits[:, j] == b)].sum() + 1e-3) / n_y
                            p_a = (w[bits[:, i] == a].sum() + 2e-3) / n_y
                            p_b = (w[bits[:, j] == b].sum() + 2e-3) / n_y
                            info[i, j] += n_y / total * p_ab * math.log(p_ab / (p_a * p_b))
                info[j, i] = info[i, j]
        parent, inside = [-1] * self.n, {0}
        while len(inside) < self.n:
            i, j = max(((i, j) for i in inside for j in range(self.n) if j not in inside),
                       key=lambda e: info[e])
            parent[j] = i
            inside.add(j)
        return parent

    def fit(self, votes: np.ndarray, unlabelled: np.ndarray, labelled: np.ndarray,
            rounds: int = 40) -> LabelModel:
        """``unlabelled``: documents per pattern; ``labelled``: (pattern, label) counts."""
        bits = self._bits(votes)
        for turn in range(rounds):
            # a first guess by the number of votes: several voters agree. A fit that began
            # with independent voters would take two copies of one voter for the label.
            post = self.posterior(votes) if turn else np.clip(
                (bits.sum(1) - 0.9) / max(1.0, 0.4 * self.n), 0.01, 0.99)
            weight = np.stack([1 - post, post], 1) * unlabelled[:, None] + labelled
            if turn in (0, rounds // 2):
                self.parent = self._tree(bits, weight)
            self.prior = float(np.clip(weight[:, 1].sum() / max(weight.sum(), 1), 1e-4, 0.9))
            for j in range(self.n):
                up = bits[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(bits), int)
                for y in (0, 1):
                    alone = (weight[bits[:, j] == 1, y].sum() + 0.1) / (weight[:, y].sum() + 1)
                    for a in (0, 1):
                        w = weight[up == a, y]
                        on = weight[(up == a) & (bits[:, j] == 1), y].sum()
                        # few cases: fall back on the voter alone
                        p = (on + 5 * alone) / (w.sum() + 5)
                        self.p[j, a, y] = np.clip(p, 1e-4, 1 - 1e-4)
        return self


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", seed: int = 11) -> DataFrame:
    """``id_col``, ``held_out``, ``score`` (0 to 1) and ``predicted`` for every row of ``docs``.

    NULL texts are empty; empty texts get the score of a text without evidence. Rows with
    equal ids are scored one by one. NULL ids count as the empty id and are never
    labelled. Several labels of one id: the largest holds; NULL labels do not count.
    Without any labels the public lexicons alone vote; an empty frame gives an empty
    result. Only the text decides a score: label, language, source and id do not.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    known = (labels.select(F.col(f"`{id_col}`").alias("doc_id"),
                           F.col(f"`{label_col}`").alias("toxic"))
             .filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
             .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    # at most MAX_LABELLED rows of two numbers
    sample = F.broadcast(written(known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
                                 .limit(MAX_LABELLED), "toxic-labels"))
    words = evidence(docs.join(sample, "doc_id"))

    rows = written(cast_votes(docs.withColumn("held_out", held_out()), words), "toxic-votes")
    patterns = rows.groupBy("votes").count().collect()  # at most 2 ** voters rows
    if not patterns:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"),
                           F.lit(0).alias("predicted"))
    votes = np.array([r.votes for r in patterns])
    at = {v: i for i, v in enumerate(votes.tolist())}
    labelled = np.zeros((len(votes), 2))
    for r in rows.join(sample, "doc_id").groupBy("votes", "toxic").count().collect():
        labelled[at[r.votes], r.toxic] = r["count"]
    unlabelled = np.array([r["count"] for r in patterns], float) - labelled.sum(1)
    model = LabelModel(len(VOTERS)).fit(votes, unlabelled, labelled)
    table = rows.sparkSession.createDataFrame(
        [(int(v), float(p)) for v, p in zip(votes, model.posterior(votes))],
        "votes int, p double")

    fraction = min(1.0, MAX_FIT_ROWS / max(1.0, float(unlabelled.sum() + labelled.sum())))
    chance = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "hits"), F.lit(1 << 30)) / (1 << 30)
    fit = (rows.filter(~F.col("held_out") & (chance < fraction)).join(F.broadcast(table), "votes")
           .select("hits", F.explode(F.array(
               F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")),
               F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")))).alias("x"))
           .select("hits", "x.label", "x.weight"))
    vocabulary = words + ["voter " + v for v in VOTERS]
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "hits", "features", binary=True)
    fit = vectors.transform(fit)
    if fit.isEmpty():
        return rows.join(F.broadcast(table), "votes").select(
            "doc_id", "held_out", F.col("p").alias("score"),
            (F.col("p") >= THRESHOLD).cast("int").alias("predicted"))
    linear = LogisticRegression(weightCol="weight", maxIter=50, regParam=0.002,
                                standardization=False).fit(fit)
    scored = linear.transform(vectors.transform(rows))
    p = vector_to_array("probability")[1]
    return scored.select("doc_id", "held_out", p.alias("score"),
                         (p >= THRESHOLD).cast("int").alias("predicted"))
