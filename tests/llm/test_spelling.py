import random
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from registry_analytics.llm import oracle, queries, spelling

from ..conftest import SF_SMALL
from .helpers import SCHEMA, odd_documents

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_counts(docs):
    n = Counter()
    for doc_id, text, *_ in docs:
        for run in RUN.findall((text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1:]
            if len(run) >= 6:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 5}


def plain_variants(docs):
    n = plain_counts(docs)
    near = {w: [] for w in n}
    for a, b in combinations(n, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, found in near.items():
        top = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


@pytest.mark.parametrize("bucket", [2, 64])
@pytest.mark.parametrize("letters,sizes", [("ab", (1, 9)), ("abcé", (3, 6)), ("a", (1, 12))])
def test_near_words_equal_all_pairs(spark, bucket, letters, sizes):
    rng = random.Random(len(letters))
    words = sorted({"".join(rng.choices(letters, k=rng.randint(*sizes))) for _ in range(150)})
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    got = [tuple(r) for r in spelling.near_words(df, bucket).collect()]
    assert len(got) == len(set(got))
    want = {frozenset(p) for p in combinations(words, 2) if one_edit(*p)}
    assert {frozenset((a, b)) for a, _, b, _ in got} == want
    assert all(words[na - 1] == a and words[nb - 1] == b for a, na, b, nb in got)


def variant_documents():
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdefÀé", k=rng.randint(6, 14))) for _ in range(60)]
    docs = []
    for i in range(400):
        words = []
        for _ in range(25):
            w = base[min(int(rng.expovariate(0.1)), len(base) - 1)]
            if rng.random() < 0.3:
                at = rng.randrange(len(w) + 1)
                w = w[:at] + rng.choice(["", "x", "É"]) + w[at + rng.randrange(2):]
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, rng.choice([" ", "-", "1", "\n"]).join(words), "en", "s", 0))
    # a chain of forms
    chain = "chainword " * 150 + "chainwords " * 30 + "chainswords " * 6
    return docs + [(1000, chain, "en", "s", 0)]


def test_variants_equal_plain_version(spark):
    docs = variant_documents()
    want = plain_variants(docs)
    assert sum(w[1] is not None for w in want) > 20 and any(w[1] != w[2] and w[1] for w in want)
    assert rows_of(spelling.variants(spark.createDataFrame(docs, SCHEMA))) == want


def test_odd_and_empty_tables(spark):
    docs = odd_documents() + [(None, "Repeat Repeat repeats repeats " * 5, "x", "y", 0),
                              (9, "straße Straßen ×÷×÷×÷ ÀÖÀÖÀÖ " * 7, None, None, None),
                              (10, "q" * 50_000 + " ", "en", "a", 1)] * 2
    docs += [(11 + i, "q" * 50_000, "en", "a", 1) for i in range(5)]
    df = spark.createDataFrame(docs, SCHEMA)
    for c in ("word", "n", "key", "rest", "more"):
        df = df.withColumn(c, F.lit(c))
    assert rows_of(spelling.variants(df)) == plain_variants(docs)
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_common_beginning_is_parted(spark):
    """A third of all words share their first half; the rests part them."""
    words = [f"commonpart{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcd"]
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = spelling.near_words(df)
    assert got.count() == sum(one_edit(a, b) for a, b in combinations(words, 2))


def test_query_equals_sql(spark):
    got = queries.op12_spelling(spark, SF_SMALL)
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{SF_SMALL}/documents.parquet'")
    want = db.sql(oracle.SPELLING)
    assert sorted(want.columns) == sorted(got.columns)
    texts = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet")
             .select("doc_id", "text").collect()]
    assert rows_of(got) == sorted(want.fetchall()) == plain_variants(texts)
