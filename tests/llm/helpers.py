"""Fixtures and plain versions shared by the tests of the training-data operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_words(text):
    return WORD.findall(text or "")


def odd_documents():
    """NULLs in every column, empty and long texts, ties, repeated rows, repeated ids."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    return [
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 50),
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 50),
        (1, "another text under the same id with a few more words in it", "en", "a", 50),
        (2, None, "en", "a", None), (3, "", None, "b", 0), (4, " \n\t ", "de", None, 4),
        (None, "a document without an id that still has a text", "en", "c", 40),
        (None, None, None, None, None), (5, long, "en", "b", len(long)),
        (6, "x", "fr", "c", 1), (7, "Grüße aus 漢字 🙂 é", "de", "c", 20),
    ]


def random_documents(n, seed=3, words=400, sources=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        lines = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 30)))
                 for _ in range(rng.randint(1, 6))]
        text = "\n".join(lines)
        out.append((i, text, rng.choice(["en", "de"]), f"s{rng.randrange(sources)}", len(text)))
    return out


def groups(pairs, nodes):
    """Smallest member of each node's component."""
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}
