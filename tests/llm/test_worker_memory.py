"""Python workers outlive the stages: what they keep, and what they take at once."""

from __future__ import annotations

import gc
import os

import numpy as np
import public_tokenizers
import pyarrow as pa

from registry_analytics.llm import bpe, line_dedup, ngram_join, quality

PIECES = "piece_bpe_32k.model"
RANKS = "byte_bpe_multi_50k.tiktoken"
KEPT = {"Meter", "Codec", "Hashes"}


def _kept(batches):
    """The operators' tables that live in this worker."""
    for batch in batches:
        found = {type(x).__name__ for x in gc.get_objects()} & KEPT
        yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "kept": [",".join(sorted(found))]})


def test_a_worker_keeps_the_tables_of_one_operator(spark):
    docs = spark.createDataFrame([(i, f"some more words of text {i}") for i in range(40)],
                                 "doc_id long, text string").coalesce(1).cache()
    path = public_tokenizers.path(PIECES)
    assert quality.measure(docs, path).filter("n_words = 6").count() == 40
    assert ngram_join.sketches(docs, 3, 90, 100).filter("n_shingles = 4").count() == 40
    coded = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    assert coded.filter("size(ids) > 0").count() == 40
    workers = docs.mapInArrow(_kept, "pid long, kept string").collect()
    assert workers
    for worker in workers:
        assert "," not in worker.kept
    # line dedup frees them too
    ids = docs.selectExpr("doc_id AS id", "doc_id AS rid", "text")
    assert line_dedup.signatures(ids).count() == 40
    for worker in docs.mapInArrow(_kept, "pid long, kept string").collect():
        assert worker.kept == ""


def test_a_worker_keeps_no_tables_between_tasks(spark):
    """Tasks go to idle workers in turn: tables kept by each of them would add up."""
    docs = spark.createDataFrame([(i, f"some more words of text {i}") for i in range(40)],
                                 "doc_id long, text string").coalesce(1).cache()
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    coded = bpe.encode(docs, ranks, pattern)
    for work in (quality.measure(docs, public_tokenizers.path(PIECES)).select("n_words"),
                 ngram_join.sketches(docs, 3, 90, 100).select("n_shingles"),
                 coded.select("ids"), bpe.decode(coded, ranks, pattern).select("decoded")):
        assert len(work.collect()) == 40
        workers = docs.mapInArrow(_kept, "pid long, kept string").collect()
        # the table of word hashes is emptied, its name may stay
        assert {k for w in workers for k in w.kept.split(",")} <= {"", "Hashes"}


def test_decoding_needs_no_encoder(spark):
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    decoder = bpe.Decoder(ranks)
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    assert not hasattr(decoder, "tokenizer")
    for text in ("some words, 漢字 and 🙂", ""):
        ids = np.frombuffer(codec.encode([text])[0], np.int32)
        assert decoder.decode(ids).decode() == text


def test_lines_of_several_cuts_are_one_share(spark):
    """Lines equal one in another cut of the same share have one signature, and places."""
    line = "the same line of some words in every document"
    filler = "\n".join(f"line {'abcdefghij'[i % 10] * (i // 10 + 1)} of this and that filler"
                       for i in range(400))
    rows = [(i, i, f"{filler}\n{line}") for i in range(20)]
    assert line_dedup._CUT_CHARS < sum(len(r[2]) for r in rows) < line_dedup._SLICE_CHARS
    df = spark.createDataFrame(rows, "id long, rid long, text string").coalesce(1)
    found = line_dedup.signatures(df).collect()
    assert len(found) == 20 * 401
    assert {(r.id, r.pos) for r in found} == {(i, p) for i in range(20) for p in range(401)}
    assert sorted(r.copies for r in found if r.copies) == [20] * 401
    assert {r.n1 for r in found if r.pos == 400} == {found[400].n1}
