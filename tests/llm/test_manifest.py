import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from registry_analytics.llm import manifest, oracle, queries

from ..conftest import SF_SMALL
from .helpers import SCHEMA, odd_documents, random_documents


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    parts = []
    for v in (doc_id, source, lang, n_chars, text):
        v = None if v is None else str(v)
        parts.append("-" if v is None else f"{len(v.encode())}:{v}")
    return digest(*parts)


def plain_levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def plain_path(levels, i):
    path = []
    for level in levels[:-1]:
        pair = level[i // 2 * 2:i // 2 * 2 + 2]
        path.append((i % 2, pair[1 - i % 2] if len(pair) == 2 else None))
        i //= 2
    return path


def plain_manifest(docs):
    """Rows as tuples of the query's contract columns."""
    by_lang = {}
    for d in docs:
        by_lang.setdefault(d[2], []).append(d)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        rows = sorted(by_lang[lang], key=lambda d: (d[0] is not None, d[0] or 0, plain_leaf(*d)))
        by_lang[lang] = rows
        trees[lang] = plain_levels([plain_leaf(*d) for d in rows])
    top = plain_levels([trees[x][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, d in enumerate(by_lang[lang]):
            path = plain_path(trees[lang], i) + plain_path(top, k)
            changed = d
            if d[0] is not None and d[4] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0:
                changed = (*d[:4], d[4] + 1)
            h = plain_leaf(*changed)
            for side, other in path:
                h = digest(h) if other is None else digest(other, h) if side else digest(h, other)
            root = top[-1][0]
            out.append((d[0], plain_leaf(*d), trees[lang][-1][0], root,
                        digest(*[o for _, o in path if o is not None]), h, h == root))
    return out


def rows_of(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, df.select(names).collect()), key=repr)


@pytest.mark.parametrize("levels", range(1, 12))
def test_addresses_are_a_recursive_layout(levels):
    depth = np.repeat(np.arange(levels), 1 << np.arange(levels))
    index = np.concatenate([np.arange(1 << d) for d in range(levels)])
    at = manifest.address(levels, depth, index)
    assert sorted(at.tolist()) == list(range((1 << levels) - 1))

    def laid_out(k, d, i):
        if k == 1:
            return [(d, i)]
        top = k // 2
        out = laid_out(top, d, i)
        for s in range(1 << top):
            out += laid_out(k - top, d + top, (i << top) + s)
        return out

    order = [(int(d), int(i)) for _, d, i in sorted(zip(at, depth, index))]
    assert order == laid_out(levels, 0, 0)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 33])
def test_blocks_hold_the_tree(n):
    leaves = [digest(str(i)) for i in range(n)]
    height = (n - 1).bit_length()
    nodes = manifest.build([bytes.fromhex(x) for x in leaves], height)
    levels = plain_levels(leaves)
    for i in range(n):
        path = manifest.siblings(nodes, height, n, i)
        assert [(p[:1] == "L", p[1:] or None) for p in path if p] == [
            (bool(s), o) for s, o in plain_path(levels, i) if o]
        assert manifest.fold(leaves[i], path) == levels[-1][0]


@pytest.mark.parametrize("height", [1, 2, 10])
def test_manifest_equals_plain_trees(spark, height, monkeypatch):
    monkeypatch.setattr(manifest, "BLOCK_HEIGHT", height)
    docs = [(d * 5, *rest) for d, *rest in random_documents(75)]
    docs += [(900 + i, f"t{i}", None, None, i) for i in range(5)] + [(1, "x", "aa", "s", None)]
    random.Random(2).shuffle(docs)
    df = spark.createDataFrame(docs, SCHEMA).repartition(6)
    assert rows_of(manifest.manifest(df)) == sorted(plain_manifest(docs), key=repr)


def test_odd_and_empty_tables(spark):
    docs = odd_documents() + [(7, "tab\tquote'\x00", "DE", "", -3), (7, "", "", "-", 0),
                              (2 ** 63 - 1, "top", "en", "a", 2 ** 63 - 1)]
    df = spark.createDataFrame(docs, SCHEMA)
    for c in ("tree", "pos", "leaf", "path", "root"):
        df = df.withColumn(c, F.lit(c))
    assert rows_of(manifest.manifest(df)) == sorted(plain_manifest(docs), key=repr)
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_equal_rows_and_one_language(spark, monkeypatch):
    monkeypatch.setattr(manifest, "BLOCK_HEIGHT", 3)
    docs = [(4, "same", "en", "a", 4)] * 60 + [(i, "t", "en", "a", i) for i in range(30)]
    got = rows_of(manifest.manifest(spark.createDataFrame(docs, SCHEMA).repartition(7)))
    assert got == sorted(plain_manifest(docs), key=repr)


def test_query_equals_sql(spark):
    got = queries.op13_manifest(spark, SF_SMALL)
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{SF_SMALL}/documents.parquet'")
    want = db.sql(oracle.MANIFEST)
    assert want.columns == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert any(not r.verified for r in got.collect())
