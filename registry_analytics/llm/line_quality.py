"""Document quality from lines labelled by a linear-chain conditional random field.

1. Every line is measured (``OWN`` numbers: kinds of characters, words, repetition); its features
   are its own numbers and those of the lines before and after it.
2. A chain over the labels good and bad has a weight per feature and per pair of neighbouring
   labels. It is fitted on at most ``MAX_FIT_WINDOWS`` runs of at most ``WINDOW`` lines from at
   most ``MAX_FIT_DOCS`` labelled rows that are not held out, chosen by hash. Lines begin with
   the label of their document, and weights are fitted without neighbours; then lines of bad
   documents that these find good, but for the worst of a run, become good, and the whole
   chain is fitted to these labels.
3. Forward-backward gives every line of every whole text the probability of being bad. The mean,
   weighted by length, is the document's; a logistic curve fitted on the same labelled rows
   makes it a score.

Texts never leave their tasks: the driver gets the numbers of the bounded sample of lines and
one number per sampled document. Scoring is one pass; long texts are measured in blocks.
"""

from __future__ import annotations

import math
import operator
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship_code, written

# bounds of what the model is fitted on
MAX_FIT_DOCS = 8_000
MAX_FIT_WINDOWS = 6_000
WINDOW = 32
THRESHOLD = 0.3

_BLOCK_LINES = 4096
_PIECE = 1 << 16  # code points of a line whose words are held at once
_CODES = 1 << 20
_SLICE = 256
(_OTHER, _LETTER, _UPPER, _DIGIT, _SPACE, _SYMBOL, _STOP, _SHOUT, _PUNCT) = range(9)
_KINDS = 9
_MIXED = re.compile(r"\w[^\w\s]{2,}")
_ALONE = re.compile(r"(?<!\S)[^\w\s]+(?!\S)")

OWN = ("blank", "chars", "words", "word_length", "letters", "upper", "digits", "symbols", "stops",
       "shouts", "punctuation", "other", "repeated_words", "next_words", "repeated_triples",
       "mixed", "alone", "seen", "ends_sentence", "starts_upper", "much_upper", "many_symbols",
       "many_next", "many_alone", "many_mixed", "many_triples")
N_FEATURES = 3 * len(OWN) + 3


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Kind of every code point of the basic plane."""
    out = np.full(1 << 16, _OTHER, np.uint8)
    for c in range(1 << 16):
        ch = chr(c)
        name = unicodedata.category(ch)
        if ch.isspace():
            out[c] = _SPACE
        elif name == "Lu":
            out[c] = _UPPER
        elif name[0] in "LM":
            out[c] = _LETTER
        elif name[0] == "N":
            out[c] = _DIGIT
        elif name[0] == "S" or ch in "#*%&@\\_{}":
            out[c] = _SYMBOL
        elif ch in ".,;:":
            out[c] = _STOP
        elif ch in "!?":
            out[c] = _SHOUT
        elif name[0] == "P":
            out[c] = _PUNCT
    return out


def _kind_counts(lines: list[str]) -> np.ndarray:
    """Characters of each kind, lines x kinds."""
    out = np.zeros(len(lines) * _KINDS, np.int64)
    text, line = "\n".join(lines), 0
    for at in range(0, len(text), _CODES):
        codes = np.frombuffer(text[at:at + _CODES].encode("utf-32-le"), np.uint32)
        ends = codes == 10
        index = np.cumsum(ends) + line
        kinds = _kinds()[np.minimum(codes, 0xFFFF)]
        keys = index[~ends] * _KINDS + kinds[~ends]
        if len(keys):
            low = int(keys[0]) // _KINDS * _KINDS
            counts = np.bincount(keys - low)
            out[low:low + len(counts)] += counts
        line = int(index[-1])
    return out.reshape(len(lines), _KINDS)


def _word_counts(line: str) -> tuple[int, int, int, int, int, int]:
    """Words, repeated words, words equal to the one before, repeated triples of words, words
    with punctuation run on, words without letters or digits. Counted in pieces of a line."""
    sums = (0,) * 6
    for at in range(0, len(line), _PIECE):
        piece = line if len(line) <= _PIECE else line[at:at + _PIECE]
        words = piece.split()
        n = len(words)
        if n:
            after = words[1:]
            triples = len(set(zip(words, after, words[2:])))
            got = (n, n - len(set(words)), sum(map(operator.eq, words, after)),
                   max(0, n - 2) - triples, len(_MIXED.findall(piece)),
                   len(_ALONE.findall(piece)))
            sums = tuple(map(operator.add, sums, got))
    return sums


def own_features(lines: list[str], seen: set[int]) -> np.ndarray:
    """Measures of lines, lines x ``OWN``. ``seen``: hashes of the lines before, added to."""
    kinds = _kind_counts(lines).astype(np.float32)
    repeats = np.zeros(len(lines), np.float32)
    words = np.empty((len(lines), 6), np.float32)
    edges = np.zeros((len(lines), 2), np.float32)
    for i, line in enumerate(lines):
        words[i] = _word_counts(line)
        h = hash(line)
        repeats[i] = h in seen and words[i, 0] > 0
        seen.add(h)
        ink = line.strip() if len(line) < 200 else line[:100].strip() + line[-100:].strip()
        if ink:
            edges[i] = ink[-1] in ".!?…。！？:;\"'”»)", ink[0].isupper()
    n_words, repeated, following, triples, mixed, alone = words.T
    ink = np.maximum(kinds.sum(1) - kinds[:, _SPACE], 1)
    letters = kinds[:, _LETTER] + kinds[:, _UPPER]
    some = np.maximum(n_words, 1)
    upper = kinds[:, _UPPER] / np.maximum(letters, 1)
    symbols, of_next, of_triples = kinds[:, _SYMBOL] / ink, following / some, triples / some
    out = [n_words == 0, np.log1p(kinds.sum(1)) / 5, np.log1p(n_words) / 4,
           np.minimum(ink / some, 40) / 10, letters / ink, upper, kinds[:, _DIGIT] / ink, symbols,
           kinds[:, _STOP] / ink, kinds[:, _SHOUT] / ink, kinds[:, _PUNCT] / ink,
           kinds[:, _OTHER] / ink, repeated / some, of_next, of_triples, mixed / some,
           alone / some, repeats, edges[:, 0], edges[:, 1], upper > 0.4, symbols > 0.06,
           of_next > 0.2, alone / some > 0.2, mixed / some > 0.2, of_triples > 0.3]
    return np.stack(out, 1).astype(np.float32)


def feature_blocks(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and lengths (code points and the line feed) of the lines of a text, a block of
    lines at a time. A text without line feeds, the empty one too, is one line."""
    lines, seen = text.split("\n"), set()
    none = np.zeros((1, len(OWN)), np.float32)
    before, now = none, own_features(lines[:_BLOCK_LINES], seen)
    for at in range(0, len(lines), _BLOCK_LINES):
        after = lines[at + _BLOCK_LINES:at + 2 * _BLOCK_LINES]
        coming = own_features(after, seen) if after else none
        up = np.concatenate([before, now[:-1]])
        down = np.concatenate([now[1:], coming[:1]])
        marks = np.zeros((len(now), 3), np.float32)
        marks[:, 0] = 1
        marks[0, 1] = at == 0
        marks[-1, 2] = not after
        lengths = np.fromiter(map(len, lines[at:at + _BLOCK_LINES]), np.int64, len(now)) + 1
        yield np.concatenate([now, up, down, marks], 1), lengths
        before, now = now[-1:], coming


@dataclass
class LineModel:
    """Chain over the labels 0 (good) and 1 (bad): ``weights`` speak for bad, ``steps`` are
    logarithms by label before and label; ``slope`` and ``offset`` make scores."""

    weights: np.ndarray
    steps: np.ndarray
    slope: float = 0.0
    offset: float = 0.0

    def line_scores(self, features: np.ndarray) -> np.ndarray:
        return np.clip(features.astype(np.float64) @ self.weights, -30, 30)

    def marginals(self, scores: np.ndarray) -> np.ndarray:
        """Probability of bad for every line, by forward-backward."""
        (gg, gb), (bg, bb) = np.exp(np.clip(self.steps, -30, 30)).tolist()
        odds = np.exp(scores).tolist()
        ahead, good, bad = [], 0.5, 0.5
        for i, e in enumerate(odds):
            if i:
                good, bad = good * gg + bad * bg, (good * gb + bad * bb) * e
            else:
                bad *= e
            total = good + bad
            good, bad = good / total, bad / total
            ahead.append(bad)
        out = np.empty(len(odds))
        good = bad = 0.5
        for i in range(len(odds) - 1, -1, -1):
            p = ahead[i]
            yes, no = p * bad, (1 - p) * good
            out[i] = yes / (yes + no)
            after = bad * odds[i]
            good, bad = gg * good + gb * after, bg * good + bb * after
            total = good + bad
            good, bad = good / total, bad / total
        return out

    def read(self, text: str) -> tuple[np.ndarray, float]:
        """Probability of bad of every line, and their mean weighted by length."""
        parts = [(self.line_scores(f), n) for f, n in feature_blocks(text)]
        p = self.marginals(np.concatenate([s for s, _ in parts]))
        return p, float(np.average(p, weights=np.concatenate([n for _, n in parts])))

    def score(self, bad: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * _logit(bad) + self.offset))))


def _logit(p):
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def _expected(scores: np.ndarray, inside: np.ndarray, steps: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of bad, expected label pairs and the log partition sum of padded chains
    (chains x lines)."""
    n, length = scores.shape
    step = np.exp(steps)
    node = np.stack([np.ones_like(scores), np.exp(scores)], 2)
    ahead, back = np.empty((n, length, 2)), np.empty((n, length, 2))
    log_sum = 0.0
    for t in range(length):
        a = node[:, t] * (ahead[:, t - 1] @ step if t else 1.0)
        total = a.sum(1, keepdims=True)
        ahead[:, t] = a / total
        log_sum += float(np.log(total[inside[:, t], 0]).sum())
    b = np.ones((n, 2))
    for t in range(length - 1, -1, -1):
        last = ~inside[:, t + 1] if t + 1 < length else np.ones(n, bool)
        if t + 1 < length:
            b = (node[:, t + 1] * b) @ step.T
            b /= b.sum(1, keepdims=True)
        b[last] = 0.5
        back[:, t] = b
    p = ahead * back
    p = p[:, :, 1] / p.sum(2)
    pairs = np.zeros((2, 2))
    for t in range(1, length):
        on = inside[:, t]
        x = (ahead[on, t - 1][:, :, None] * step * (node[on, t] * back[on, t])[:, None, :])
        pairs += (x / x.sum((1, 2), keepdims=True)).sum(0)
    return p, pairs, log_sum


def fit_chain(features: np.ndarray, inside: np.ndarray, labels: np.ndarray,
              turns: int = 150, rate: float = 0.1, ridge: float = 1e-3,
              free: np.ndarray | None = None) -> LineModel:
    """Weights of the greatest penalised likelihood, by Adam over all chains. ``features``:
    chains x lines x features, ``inside``: which lines are there, ``labels``: 0 or 1, ``free``:
    which weights and steps are fitted (the others stay 0)."""
    n_lines = max(1, int(inside.sum()))
    flat, wanted = features[inside], labels[inside].astype(np.float64)
    both = inside[:, 1:]
    seen = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            seen[a, b] = ((labels[:, :-1] == a) & (labels[:, 1:] == b) & both).sum()
    x = np.zeros(features.shape[2] + 4)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for turn in range(1, turns + 1):
        weights, steps = x[:-4], x[-4:].reshape(2, 2)
        scores = np.zeros(inside.shape)
        scores[inside] = np.clip(flat @ weights, -30, 30)
        p, pairs, _ = _expected(scores, inside, steps)
        gain = np.concatenate([flat.T @ (wanted - p[inside]), (seen - pairs).ravel()]) / n_lines
        gain -= ridge * x
        if free is not None:
            gain = gain * free
        m, v = 0.9 * m + 0.1 * gain, 0.99 * v + 0.01 * gain ** 2
        x = x + rate * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.99 ** turn)) + 1e-8)
    return LineModel(x[:-4].copy(), x[-4:].reshape(2, 2).copy())


def fit_windows(windows: list[tuple[int, bytes]]) -> LineModel:
    """``windows``: label of the document (1 good) and the features of a run of its lines."""
    runs = [(label, np.frombuffer(data, np.float32).reshape(-1, N_FEATURES))
            for label, data in windows]
    length = max(len(f) for _, f in runs)
    features = np.zeros((len(runs), length, N_FEATURES))
    inside = np.zeros((len(runs), length), bool)
    for i, (_, f) in enumerate(runs):
        features[i, :len(f)], inside[i, :len(f)] = f, True
    from_bad = np.array([label == 0 for label, _ in runs])
    labels = (inside & from_bad[:, None]).astype(np.int64)
    alone = np.zeros(N_FEATURES + 4)
    alone[:len(OWN)] = alone[3 * len(OWN)] = 1
    lines = fit_chain(features, inside, labels, free=alone)
    scores = np.full(inside.shape, -np.inf)
    scores[inside] = lines.line_scores(features[inside])
    bad = (scores >= 0) | (scores == scores.max(1, keepdims=True))
    return fit_chain(features, inside, (bad & labels).astype(np.int64))


def fit_curve(bad: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of the label over the logit of ``bad``."""
    x = np.stack([_logit(bad), np.ones(len(bad))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        bend = (x * (counts * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        move = np.linalg.solve(bend, x.T @ (counts * (labels - p)) - 1e-2 * w)
        w = w + move * min(1.0, 2.0 / max(1e-9, float(np.abs(move).max())))
    return float(w[0]), float(w[1])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learnt from: crc32 of the id as text leaves 0 when divided by 5."""
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    return F.crc32(ident) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", seed: int = 17
          ) -> LineModel | None:
    """The model of ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``label_col``). None
    without training rows of both labels. NULL labels and ids do not count; of several labels
    of an id the largest holds. Rows with equal ids are all labelled."""
    known = (labels.select("doc_id", F.col(f"`{label_col}`").alias("label"))
             .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
             .groupBy("doc_id").agg((F.max("label") > 0).cast("int").alias("label"))
             .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(MAX_FIT_DOCS))
    # at most MAX_FIT_DOCS rows of two numbers
    rows = docs.join(F.broadcast(written(known, "line-labels")), "doc_id").select("text", "label")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(*(batch.column(c).to_pylist() for c in ("text", "label"))):
                for features, _ in feature_blocks(text or ""):
                    starts = range(0, len(features), WINDOW)
                    yield pa.RecordBatch.from_pydict({
                        "label": pa.array([label] * len(starts), pa.int32()),
                        "run": pa.array([features[i:i + WINDOW].tobytes() for i in starts],
                                        pa.binary())})

    ship_code(docs.sparkSession)
    cuts = rows.mapInArrow(cut, "label int, run binary")
    few = (cuts.orderBy(F.xxhash64(F.lit(seed + 1), "run"), "run").limit(MAX_FIT_WINDOWS)
           .collect())
    if len({r.label for r in few}) < 2:
        return None
    model = fit_windows([(r.label, bytes(r.run)) for r in few])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"),
                 pa.array([model.read(t or "")[1] for t in texts], pa.float64())],
                names=["label", "bad"])

    means = rows.mapInArrow(judge, "label int, bad double")
    # at most 20,002 rows: a count for each label and share of four digits
    seen = means.groupBy("label", F.round("bad", 4).alias("bad")).agg(
        F.count(F.lit(1)).alias("n")).orderBy("label", "bad").collect()
    model.slope, model.offset = fit_curve(
        *(np.array([r[c] for r in seen], float) for c in ("bad", "label", "n")))
    return model


def read_lines(df: DataFrame, model: LineModel | None, text_col: str = "text",
               with_lines: bool = True) -> DataFrame:
    """``df`` without its text, with ``n_lines``, ``n_bad_lines`` (long), ``bad_share``, ``score``
    (double) and, if asked for, ``line_bad``: the probability of bad of every line. New columns
    replace those of their names. Without a model every score is 0.5."""
    ship_code(df.sparkSession)
    fresh = ["n_lines", "n_bad_lines", "bad_share", "score"] + ["line_bad"] * with_lines
    kept = [c for c in df.columns if c != text_col and c not in fresh]
    schema = (df.select(*[F.col(f"`{c}`") for c in kept]).schema.add("n_lines", "long")
              .add("n_bad_lines", "long").add("bad_share", "double").add("score", "double"))
    if with_lines:
        schema = schema.add("line_bad", T.ArrayType(T.FloatType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                n, n_bad, share, score, lines = [], [], [], [], []
                for text in part.column(text_col).to_pylist():
                    if model is None:
                        p, bad = np.full((text or "").count("\n") + 1, 0.5), 0.5
                    else:
                        p, bad = model.read(text or "")
                    n.append(len(p))
                    n_bad.append(int((p >= 0.5).sum()))
                    share.append(bad)
                    score.append(0.5 if model is None else model.score(bad))
                    lines.append(p.astype(np.float32) if with_lines else None)
                new = [pa.array(n, pa.int64()), pa.array(n_bad, pa.int64()),
                       pa.array(share, pa.float64()), pa.array(score, pa.float64())]
                if with_lines:
                    new.append(pa.array(lines, pa.list_(pa.float32())))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + new,
                                                 names=kept + fresh)

    return df.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1, higher: label 1 likelier), ``predicted``,
    ``n_lines``, ``n_bad_lines`` and ``bad_share`` for every row of ``docs``.

    NULL texts count as empty; an empty text is one empty line and is scored like any. Rows
    with equal ids are scored one by one. NULL ids count as the empty id, are held out and
    never labelled. Only the text decides a score: label, language, source and id do not.
    Without labels of both kinds every score is 0.5; an empty frame gives an empty result.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    labels = labels.withColumnRenamed(id_col, "doc_id")
    model = train(docs, labels, label_col)
    read = read_lines(docs.withColumn("held_out", held_out()), model, with_lines=False)
    return read.select("doc_id", "held_out", "score",
                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
                       "n_lines", "n_bad_lines", "bad_share")
