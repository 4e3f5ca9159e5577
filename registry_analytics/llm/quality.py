"""Quality rules: word statistics and tokeniser fertility with rejection bands.

Every whole text is cut into words. A public vocabulary with byte fallback measures all of
them (``all_``), and by themselves those without digits (numbers, addresses and keys say
nothing about the language; where they hold more than half of the characters, all words
once more): code points per token, the share of byte-fallback tokens, and the entropy of the
tokens. The values of running text lie close together for texts of one language and size;
symbol noise, tables and shouting lie outside. A group is a language and a power of two of
tokens; its band is the median plus or minus ``WIDTH`` robust standard deviations
(interquartile range / 1.349), more in a group of few documents. Bands come from exact
histograms over all documents that pass the base rules, and judge all of them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, released, ship_code, written

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
WINDOW = 5
WIDTH = 4.0
# a language and size with fewer documents has a band that is wider by the root of what is missing
MIN_GROUP = 50
# scale of the stored values, least interquartile range, which sides reject
METRICS = {"chars_per_token": (1000, 0.03, "both"), "byte_share": (1000, 0.01, "above"),
           "token_entropy": (1000, 0.1, "both"),
           "all_chars_per_token": (1000, 0.1, "both"), "all_byte_share": (1000, 0.01, "above"),
           "all_token_entropy": (1000, 0.2, "both")}
MAX_MODEL_BYTES = 64 << 20
# about 54 MB of the worker
_CACHE_WORDS = 200_000
_CACHED_BYTES = 64
_SLICE = 512

_STATS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"),
          ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("n_tokens", "long"),
          ("chars_per_token", "double"), ("byte_share", "double"), ("token_entropy", "double"),
          ("all_tokens", "long"), ("all_chars_per_token", "double"), ("all_byte_share", "double"),
          ("all_token_entropy", "double")]


class Meter:
    """Vocabulary and word table of one worker."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.sp.get_piece_size()
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(n)], bool)
        self.ids: dict[bytes, bytes] = {}
        self.chars: dict[bytes, int] = {}
        self.digits: set[bytes] = set()

    def learn(self, words: set[bytes]) -> None:
        new = list(words)
        # documents hold no invalid UTF-8; a word is whole UTF-8 since it is cut at ASCII
        texts = [w.decode("utf-8", "replace") for w in new]
        for word, text, ids in zip(new, texts, self.sp.encode(texts, num_threads=1)):
            self.ids[word], self.chars[word] = np.array(ids, np.int32).tobytes(), len(text)
            if any(c in word for c in b"0123456789"):
                self.digits.add(word)

    def forget(self, word: bytes) -> None:
        del self.ids[word], self.chars[word]
        self.digits.discard(word)

    def clear(self) -> None:
        self.ids.clear()
        self.chars.clear()
        self.digits.clear()

    def _values(self, words: list[bytes], chars: int) -> tuple[int, float, float, float]:
        ids = np.frombuffer(b"".join(map(self.ids.__getitem__, words)), np.int32)
        n = len(ids)
        if not n:
            return 0, 0.0, 0.0, 0.0
        counts = np.unique(ids, return_counts=True)[1]
        entropy = float(np.log2(n) - (counts * np.log2(counts)).sum() / n)
        return n, chars / n, float(self.is_byte[ids].mean()), entropy

    def measure(self, words: list[bytes], word_chars: int) -> tuple:
        """Tokens, code points per token, byte-fallback share, entropy in bits: of the words
        without digits (of all where these hold less than half of the code points), of all
        words. ``word_chars``: the code points of all words."""
        every = self._values(words, word_chars)
        if self.digits.isdisjoint(words):
            return every * 2
        plain = [w for w in words if w not in self.digits]
        chars = sum(map(self.chars.__getitem__, plain))
        return (every if 2 * chars < word_chars else self._values(plain, chars)) + every


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window of ``window`` words that occurs twice or more."""
    n = len(words) - window + 1
    if n < 2 or len(set(words)) == len(words):
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(window):
        key = (key ^ h[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    _, at, counts = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[at] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def word_stats(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """The base statistics of one text and its words."""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    return (len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeat_words(words))


def measure(df: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``df`` with the statistics of ``_STATS``; columns with these names are replaced. A
    NULL text counts as empty. Rows are measured one by one, repeated ones included, on
    their whole text. The vocabulary file (at most ``MAX_MODEL_BYTES``) is sent to the tasks."""
    if os.path.getsize(model_path) > MAX_MODEL_BYTES:
        raise ValueError(f"vocabulary above {MAX_MODEL_BYTES} bytes")
    ship_code(df.sparkSession)
    with open(model_path, "rb") as file:
        model = df.sparkSession.sparkContext.broadcast(file.read())
    key = ("quality", model_path, os.path.getmtime(model_path))
    names = [n for n, _ in _STATS]
    kept = [c for c in df.columns if c not in names]
    schema = df.select(*[F.col(f"`{c}`") for c in kept]).schema
    for name, kind in _STATS:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = held(key, lambda: Meter(model.value))
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                words = [t.encode().split() for t in texts]  # bytes.split cuts at ASCII space
                if len(meter.ids) > _CACHE_WORDS:
                    meter.clear()
                new = {w for ws in words for w in ws if w not in meter.ids}
                meter.learn(new)
                base = [word_stats(t, w) for t, w in zip(texts, words)]
                rows = [b + meter.measure(w, b[1]) for b, w in zip(base, words)]
                for word in new:
                    if len(word) > _CACHED_BYTES or word in meter.digits:
                        meter.forget(word)
                arrays = [part.column(c) for c in kept]
                for (name, kind), values in zip(_STATS, zip(*rows)):
                    arrays.append(pa.array(values, pa.int64() if kind == "long" else pa.float64()))
                yield pa.RecordBatch.from_arrays(arrays, names=kept + names)
        del meter
        released()

    return df.mapInArrow(run, schema)


def base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _size_class() -> Column:
    return F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int")


def _metrics(measured: DataFrame) -> list[str]:
    """The metrics that ``measured`` has: all of them if it comes from ``measure``."""
    return [m for m in METRICS if m in measured.columns]


def bands(measured: DataFrame, group_col: str = "lang", width: float = WIDTH) -> DataFrame:
    """Rejection bands: one row per group and size class with ``low`` and ``high`` of each
    metric. Quartiles of few documents are vague: below ``MIN_GROUP`` the band widens."""
    metrics = _metrics(measured)
    sound = measured.filter(~base_failed() & (F.col("n_tokens") > 0)).select(
        F.col(f"`{group_col}`").alias("grp"), _size_class().alias("size_class"),
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.round(F.col(m) * scale).cast("long").alias("v"))
            for m in metrics for scale in METRICS[m][:1]])).alias("x"))
    hist = sound.groupBy("grp", "size_class", "x.metric", "x.v").count()
    quart = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("count"))
    own = hist.groupBy(F.col("grp").cast("string").alias("grp"), "size_class", "metric").agg(
        quart.alias("q"), F.sum("count").alias("docs"))

    def side(metric: str, sign: int) -> Column:
        scale, least, sides = METRICS[metric]
        if sides == "above" and sign < 0:
            return F.lit(float("-inf"))
        q = F.col("q")
        sigma = F.greatest((q[2] - q[0]) / scale, F.lit(least)) / 1.349
        few = F.sqrt(F.greatest(F.lit(1.0), MIN_GROUP / F.col("docs")))
        return q[1] / scale + sign * width * few * sigma

    return own.groupBy("grp", "size_class").agg(
        F.max("docs").alias("docs"),
        *[F.max(F.when(F.col("metric") == m, side(m, s))).alias(f"{name}_{m}")
          for m in metrics for s, name in ((-1, "low"), (1, "high"))])


def judge(measured: DataFrame, group_col: str = "lang", width: float = WIDTH) -> DataFrame:
    """``measured`` (from ``measure``, best written first: it is read twice) with
    ``base_failed`` and ``kept``.

    A document that fails the base rules goes; others stay unless a metric lies outside
    the band of their own language and size, however few documents that has (another
    language's band says nothing about them). NULL is a group like any other. An empty frame
    stays empty.
    """
    metrics = _metrics(measured)
    table = written(bands(measured, group_col, width), "quality-bands")
    lim = [f"{s}_{m}" for m in metrics for s in ("low", "high")]
    own = table.select(
        "grp", F.col("size_class").alias("own_class"), F.struct(*lim).alias("band"))
    kept_cols = [F.col(f"`{c}`") for c in measured.columns if c not in ("base_failed", "kept")]
    df = measured.withColumn("__class", _size_class())
    # a written table: Spark broadcasts it while it is small and shuffles it when it is not
    df = df.join(own, F.col(f"`{group_col}`").cast("string").eqNullSafe(F.col("grp"))
                 & (F.col("__class") == F.col("own_class")), "left")
    band = F.col("band")
    inside = F.lit(True)
    for m in metrics:
        # compare what the histogram saw
        value = F.round(F.col(m) * METRICS[m][0]) / METRICS[m][0]
        inside = inside & value.between(band[f"low_{m}"], band[f"high_{m}"])
    fits = band.isNull() | (F.col("n_tokens") == 0) | inside
    return df.select(*kept_cols, base_failed().alias("base_failed"),
                     (~base_failed() & fits).alias("kept"))
