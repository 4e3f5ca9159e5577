"""Spelling variants: words at one edit, found with asymmetric q-chunks.

Two words are near if one inserted, deleted or replaced code point makes one the other. The
shorter word x of a pair (either, at equal lengths) is cut into two disjoint chunks, its
halves; the other word y offers its positional grams of the same lengths. The edit touches
one half of x only, so the other half is a gram of y, moved by nothing (head) or by the
difference of the lengths (tail), hence within a shift of one. Of all grams of y only those at
these places can match, and only those are sent: two for words of its own length and two
for words one shorter.

What is not in the matched chunk (the rest) decides: two rests at one edit are a pair. Words
that share a chunk may be many. A bucket with more than ``BUCKET`` rows is not compared;
its rests are cut into chunks and grams the same way, which parts it, and so on until buckets
are small or rests are single code points. No bucket is cut off and no pair is lost, and the
rows grow by four a round where buckets are large.

Words are counted with partial aggregation before the shuffle; a word is one row afterwards,
however often it occurs.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

NO_RUN = r"[^A-Za-zÀ-ÿ]+"
MIN_POINTS = 6
MIN_COUNT = 5
FORM_FACTOR = 5
SLIP = 199
# rows of a bucket that are compared with each other; larger ones are parted
BUCKET = 64


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word``, ``n``: words of at least ``MIN_POINTS`` code points and ``MIN_COUNT``
    occurrences. A run of a document loses a code point where ``SLIP`` divides the crc32 of
    ``<id>:<run>``; a NULL id counts as an empty one."""
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    runs = docs.select(ident.alias("id"), F.explode(F.split(
        lower_ascii(F.col(f"`{text_col}`")), NO_RUN, -1)).alias("run"))
    runs = runs.filter(F.length("run") >= MIN_POINTS)
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at),
                       F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(h % SLIP == 0, slipped).otherwise(F.col("run")).alias("word"))
    return (words.filter(F.length("word") >= MIN_POINTS).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_COUNT))


def _parted(rows: DataFrame) -> DataFrame:
    """Chunks and grams of the rests. ``rows``: ``key``, ``word``, ``n``, ``rest`` and ``more``, by
    how many code points (0 or 1) the rest is longer than those cut into chunks."""
    size = F.length("rest") - F.col("more")  # of the rests that are cut
    half = F.floor(size / 2).cast("int")
    head = F.substring(F.col("rest"), F.lit(1), half)
    after = F.substring(F.col("rest"), half + 1, F.length("rest"))
    # the tail gram begins one later in a longer rest
    tail = F.substring(F.col("rest"), half + F.col("more") + 1, F.length("rest"))
    before = F.substring(F.col("rest"), F.lit(1), half + F.col("more"))

    def part(side: int, chunk: Column, rest: Column) -> Column:
        return F.struct(F.xxhash64("key", F.lit(side), size, chunk).alias("key"),
                        rest.alias("rest"))

    return rows.select("word", "n", "more", F.explode(F.array(
        part(0, head, after), part(1, tail, before))).alias("x")).select(
        F.col("x.key").alias("key"), "word", "n", F.col("x.rest").alias("rest"), "more")


def one_edit(a: Column, b: Column) -> Column:
    return F.call_function("levenshtein", a, b, F.lit(1)) == 1


def _pairs(rows: DataFrame) -> DataFrame:
    """Near words of the small buckets: ``a``, ``na``, ``b``, ``nb``; ``b`` is longer or, at equal
    lengths, greater. Chunk hashes may collide, so whole words are verified."""
    own = rows.filter("more = 0").select("key", F.col("word").alias("a"), F.col("n").alias("na"),
                                         F.col("rest").alias("rest_a"))
    other = rows.select("key", F.col("word").alias("b"), F.col("n").alias("nb"),
                        F.col("rest").alias("rest_b"), "more")
    return (own.join(other, "key")
            .filter((F.col("more") == 1) | (F.col("a") < F.col("b")))
            .filter(one_edit(F.col("rest_a"), F.col("rest_b"))
                    & one_edit(F.col("a"), F.col("b")))
            .select("a", "na", "b", "nb"))


def near_words(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``words``: ``word``, ``n``, one row per word. Returns every pair of near words once, as
    ``a``, ``na``, ``b``, ``nb``. Words of one code point have no halves and are paired too."""
    rows = words.select(
        F.lit(0).cast("long").alias("key"), "word", "n", F.col("word").alias("rest"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("more"))
    rows = rows.filter(F.length("rest") > F.col("more"))
    found = None
    while True:
        parted = written(_parted(rows), "spelling-parted")
        # a bucket without a rest that is cut, or with one row only, has no pair
        sizes = parted.groupBy("key").agg(
            F.count(F.lit(1)).alias("m"), F.min("more").alias("least"),
            F.max(F.length("rest") - F.col("more")).alias("long")
        ).filter("m > 1 and least = 0").drop("least")
        held = written(parted.join(sizes, "key"), "spelling-buckets")
        # rests of one code point cannot be parted: such a bucket has a row per letter
        small = (F.col("m") <= bucket) | (F.col("long") <= 1)
        pairs = written(_pairs(held.filter(small)), "spelling-pairs")
        found = pairs if found is None else found.unionByName(pairs)
        rows = held.filter(~small).drop("m", "long")
        if rows.isEmpty():
            # an edit between two equal code points leaves both halves whole
            return found.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` for every word with a form. Forms grow in count, so they have no
    cycles; each round doubles the steps that are followed."""
    found = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        after = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(found.join(after, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"),
            F.col("further").isNotNull().alias("moved")), "spelling-roots")
        found = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return found


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: ``word``, ``form`` (its near word of largest count, ties: the smallest
    in code-point order, if that count is at least ``FORM_FACTOR`` times the word's; else
    NULL), ``root`` (where the forms end; the word itself if it has none), ``n``, ``n_near``,
    ``form_n``.

    NULL and empty texts have no words. Ids may be NULL (an empty id) or repeat, and rows
    that repeat count again. Whole texts and words of any length are read. Other columns
    are ignored; an empty frame gives an empty result.
    """
    words = written(word_counts(docs, id_col, text_col), "spelling-words")
    pairs = written(near_words(words), "spelling-near")
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"),
                         F.col("nb").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"),
                     F.col("na").alias("near_n")))
    best = sides.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near"))).alias("best"))
    rows = words.join(best, "word", "left")
    enough = -F.col("best.rank") >= FORM_FACTOR * F.col("n")
    rows = written(rows.select(
        "word", F.when(enough, F.col("best.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, -F.col("best.rank")).alias("form_n")), "spelling-forms")
    roots = _roots(rows.filter(F.col("form").isNotNull()).select("word", "form"))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
