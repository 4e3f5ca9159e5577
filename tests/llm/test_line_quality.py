import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from registry_analytics.llm import line_quality as lq
from registry_analytics.llm import queries

from ..conftest import SF_SMALL
from .helpers import SCHEMA, odd_documents


def plain_marginals(scores, steps):
    """By summing over all label sequences."""
    total, bad = 0.0, np.zeros(len(scores))
    for y in itertools.product((0, 1), repeat=len(scores)):
        e = sum(s for s, label in zip(scores, y) if label)
        e += sum(steps[a][b] for a, b in zip(y, y[1:]))
        total += np.exp(e)
        bad += np.exp(e) * np.array(y)
    return bad / total, np.log(total)


def chains(n=7, length=6, features=3, seed=1):
    rng = np.random.default_rng(seed)
    inside = np.arange(length) < rng.integers(1, length + 1, n)[:, None]
    return rng.normal(size=(n, length, features)) * inside[:, :, None], inside, rng


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(5)
    for length in (1, 2, 5, 9):
        steps = rng.normal(size=(2, 2))
        model = lq.LineModel(np.ones(1), steps)
        scores = rng.normal(size=length) * 2
        want, log_sum = plain_marginals(scores, steps)
        assert np.allclose(model.marginals(scores), want)
        p, pairs, got = lq._expected(scores[None], np.ones((1, length), bool), steps)
        assert np.allclose(p[0], want) and np.isclose(got, log_sum)
        assert np.isclose(pairs.sum(), length - 1)


def test_padded_chains_do_not_mix():
    _, inside, rng = chains()
    scores = rng.normal(size=inside.shape) * inside
    steps = rng.normal(size=(2, 2))
    p, pairs, _ = lq._expected(scores, inside, steps)
    for i, on in enumerate(inside):
        assert np.allclose(p[i, on], plain_marginals(scores[i, on], steps)[0])
    assert np.isclose(pairs.sum(), inside.sum() - len(inside))


def test_fit_reaches_a_stationary_point():
    features, inside, rng = chains(40)
    labels = (features[:, :, 0] + rng.normal(size=inside.shape) > 0) & inside
    model = lq.fit_chain(features, inside, labels.astype(int), turns=800, ridge=0.01)

    def likelihood(weights):
        s = np.zeros(inside.shape)
        s[inside] = features[inside] @ weights
        _, _, log_sum = lq._expected(s, inside, model.steps)
        own = (s * labels).sum() + sum(
            model.steps[int(a), int(b)] for y, on in zip(labels, inside)
            for a, b in zip(y[on], y[on][1:]))
        return (own - log_sum) / inside.sum() - 0.005 * (weights ** 2).sum()

    best = likelihood(model.weights)
    for i in range(3):
        for d in (-0.1, 0.1):
            assert likelihood(model.weights + d * np.eye(3)[i]) < best + 1e-4
    assert model.weights[0] > 0.5


def test_long_texts_are_read_in_blocks(monkeypatch):
    rng = random.Random(3)
    lines = [" ".join(rng.choices(["A!", "bc", "||", "9", "e%%", "über", "🙂"], k=rng.randint(0, 12)))
             for _ in range(50)]
    text = "\n".join(lines + lines[:5])
    whole = list(lq.feature_blocks(text))
    monkeypatch.setattr(lq, "_BLOCK_LINES", 7)
    monkeypatch.setattr(lq, "_CODES", 16)
    parts = list(lq.feature_blocks(text))
    assert len(parts) == 8 and len(whole) == 1
    assert np.allclose(np.concatenate([f for f, _ in parts]), whole[0][0])
    assert sum(n.sum() for _, n in parts) == len(text) + 1
    kinds = lq._kind_counts(lines)
    assert kinds.sum(1).tolist() == [len(x) for x in lines]
    own = dict(zip(lq.OWN, whole[0][0][-1][:len(lq.OWN)]))
    assert own["seen"] == (1 if lines[4].split() else 0)
    words = lq._word_counts("a a b | c%% a b |")
    assert words == (8, 4, 1, 1, 1, 2)
    monkeypatch.setattr(lq, "_PIECE", 10)
    assert lq._word_counts("a b " * 10)[0] == 20


def test_empty_text_is_one_line():
    (features, lengths), = lq.feature_blocks("")
    assert features.shape == (1, lq.N_FEATURES) and lengths.tolist() == [1]


def labelled_documents(n=160):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        lines = [" ".join(rng.choices(["one", "two", "three", "four", "five"], k=9)).capitalize() + "."
                 for _ in range(rng.randint(2, 9))]
        if not good:
            at = rng.randrange(len(lines))
            lines[at:] = [" | ".join(x.upper().split()) for x in lines[at:]] or ["| |"]
        docs.append((i, "\n".join(lines), "en", "s", 0))
        labels.append((i, int(good)))
    return docs, labels


def test_lines_and_documents_are_told_apart(spark):
    docs, labels = labelled_documents()
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    want, texts = dict(labels), {d[0]: d[1] for d in docs}
    got = lq.score(df, known).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == want[r.doc_id] == int(r.score >= lq.THRESHOLD)
    model = lq.train(df.select("doc_id", "text"), known)
    off = n = 0
    for r in lq.read_lines(df, model).collect():
        lines = texts[r.doc_id].split("\n")
        assert len(r.line_bad) == r.n_lines == len(lines)
        assert r.n_bad_lines == sum(p >= 0.5 for p in r.line_bad)
        lengths = [len(x) + 1 for x in lines]
        assert np.isclose(r.bad_share, np.average(r.line_bad, weights=lengths), atol=1e-4)
        off += sum((p >= 0.5) != ("|" in x) for p, x in zip(r.line_bad, lines))
        n += len(lines)
    assert off < 0.05 * n


def test_held_out_labels_do_not_matter(spark):
    docs, labels = labelled_documents()
    df = spark.createDataFrame(docs, SCHEMA)

    def flipped(i):
        return zlib.crc32(str(i).encode()) % 5 == 0

    a = lq.score(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    b = lq.score(df, spark.createDataFrame(
        [(i, 1 - q if flipped(i) else q) for i, q in labels], "doc_id long, quality int"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, None), (None, 0)],
                                    [(i, i % 2) for i in range(8)] + [(3, 0), (None, 1)]])
def test_odd_and_empty_tables(spark, labels):
    docs = odd_documents() + [(8, "x\n" * 5000, "en", "a", 1), (8, "| " * 100_000, "en", "a", 1)]
    df = spark.createDataFrame(docs, SCHEMA)
    for c in ("score", "held_out", "label", "n_lines", "line_bad"):
        df = df.withColumn(c, F.lit(c))
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    got = lq.score(df, known).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, (d[0] for d in docs)))
    assert all(0 <= r.score <= 1 and r.n_bad_lines <= r.n_lines for r in got)
    if len(labels) < 4:
        assert {r.score for r in got} == {0.5}
    assert lq.score(spark.createDataFrame([], SCHEMA), known).count() == 0
    lines = lq.read_lines(df, None).collect()
    assert all(len(r.line_bad) == r.n_lines for r in lines)


def test_query_separates_held_out_documents(spark):
    folder = SF_SMALL.replace("0.001", "0.01")
    got = {r.doc_id: r for r in queries.op11_line_quality(spark, folder).collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    held = [(got[r.doc_id], r.quality) for r in labels if got[r.doc_id].held_out]
    assert len(held) >= 50
    assert sum(r.predicted == q for r, q in held) >= 0.97 * len(held)
    good, bad = ([r.score for r, q in held if q == k] for k in (1, 0))
    assert np.mean([[g > b for g in good] for b in bad]) > 0.99
