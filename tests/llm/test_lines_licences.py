import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from registry_analytics.llm import license_scan, line_dedup

from .helpers import SCHEMA, groups, odd_documents


def plain_norm(line):
    return re.sub(r"[^\W\d_]+|.", lambda m: m.group() if m.group()[0].isalpha() else " ",
                  line.lower(), flags=re.S)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_dedup(docs):
    """Every pair of lines, by edit similarity alone."""
    seen = defaultdict(list)
    for doc_id, text in docs:
        for pos, line in enumerate((text or "").split("\n")):
            norm = " ".join(plain_norm(line).split())
            if len(norm.split()) >= line_dedup.MIN_WORDS or len(norm) >= line_dedup.MIN_LENGTH:
                seen[norm].append((doc_id, pos))
    norms = sorted(seen)
    links = []
    for i, a in enumerate(norms):
        for b in norms[:i]:
            longer = max(len(a), len(b))
            if abs(len(a) - len(b)) <= longer * 0.1 and edit_distance(a, b) <= math.floor(
                    longer * 0.1 + 1e-9):
                links.append((b, a))
    comp = groups(links, norms)
    members = defaultdict(list)
    for n in norms:
        members[comp[n]] += seen[n]
    gone = {o for occ in members.values() for o in sorted(occ)[1:]}
    return {d: None if t is None else "\n".join(
        [x for p, x in enumerate(t.split("\n")) if (d, p) not in gone]) for d, t in docs}


def fuzzy_documents():
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "zeta", "iota"]
    bases = [" ".join(rng.choices(words, k=rng.randint(5, 40))) for _ in range(12)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 5)):
            line = rng.choice(bases)
            kind = rng.random()
            if kind < 0.3:
                line = line.upper() + " 2024!"
            elif kind < 0.5:
                w = line.split()
                w[rng.randrange(len(w))] += "s"
                line = " ".join(w)
            elif kind < 0.6:
                line = " ".join(rng.choices(words, k=12))
            lines.append(line)
        docs.append((i, "\n".join(lines + ["", "Short line."])))
    return docs


def test_line_dedup_equals_brute_force(spark):
    docs = fuzzy_documents() + [(900, None), (901, ""), (902, "\n\n")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {d: r.text for d, r in got.items()} == plain_dedup(docs)
    assert sum(r.n_removed for r in got.values()) > 40
    assert all(r.n_lines == (0 if docs_text is None else docs_text.count("\n") + 1)
               for (d, docs_text) in docs for r in [got[d]])


def some_words(lines):
    """Hash and length of every word, and words of each line, as the operator has them."""
    got = line_dedup.cut("\n".join(" ".join(words) + " q" * 5 for words in lines))
    at = np.cumsum(got.words) - got.words
    kept = np.concatenate([np.arange(a, a + len(words)) for a, words in zip(at, lines)])
    return got.h[kept], got.length[kept], np.array([len(words) for words in lines])


def test_lines_are_cut_like_normal_forms():
    rng = random.Random(1)
    signs = list("abÉßé ") * 4 + list("12_-,.;\t\x0b\u2028½²ǅİ") + list("漢字かナไท🙂\U00020010")
    lines = ["".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(300)]
    lines = [x for line in lines for x in (line, "".join(rng.choices(line, k=3)))]
    lines += lines[:40] + [line.upper() for line in lines[:40] if "ß" not in line]
    lines += ["one two three", "sixteen letters or more in a line here", ""]
    got = line_dedup.cut("\n".join(lines))
    norms = [line_dedup.normal(line) for line in lines]
    single = re.compile("[\u0e00-\u0eff\u3040-\u30ff\u4e00-\u9fff\U00020000-\U000323ff]|"
                        "[^\u0e00-\u0eff\u3040-\u30ff\u4e00-\u9fff\U00020000-\U000323ff]+")
    words = [[w for run in n.split() for w in single.findall(run)] for n in norms]
    want = [i for i, n in enumerate(norms) if len(words[i]) >= 5 or len(n) >= 30]
    assert got.pos.tolist() == want and 100 < len(want) < len(lines) - 10
    assert got.size.tolist() == [len(norms[i]) for i in want]
    assert got.words.tolist() == [len(words[i]) for i in want]
    assert got.length.tolist() == [len(w) for i in want for w in words[i]]
    flat = [w for i in want for w in words[i]]
    assert len(set(zip(flat, got.h.tolist()))) == len(set(flat)) == len(set(got.h.tolist()))
    names = list(zip(got.n1.tolist(), got.n2.tolist()))
    forms = [tuple(words[i]) for i in want]
    assert len(set(zip(names, forms))) == len(set(names)) == len(set(forms))


def test_simhash_is_the_majority_of_word_hashes():
    lines = [["alpha", "beta", "gamma"], ["one"], ["ab", "middling"] * 300 + ["cde"] * 250, ["a", "b", "a", "c", "d"], ["x", "seventh", "yz"]]
    h, length, sizes = some_words(lines)
    hashes = dict(zip([w for words in lines for w in words], h))
    got = line_dedup.simhash(h, length, np.cumsum(sizes) - sizes, sizes)
    for words, value in zip(lines, got.view(np.uint8).reshape(-1, 8)):
        votes = [w for w in words for _ in range(4 if len(w) > 4 else 1)]
        bits = np.unpackbits(np.array([hashes[w] for w in votes], np.uint64)
                             .view(np.uint8).reshape(-1, 8), axis=1)
        assert (np.unpackbits(value) == (2 * bits.sum(0) > len(votes))).all()


def edited(rng, a, edits):
    b = list(a)
    for _ in range(edits):
        at, kind = rng.randrange(len(b) + 1), rng.random()
        if kind < 0.4:
            b.insert(at, rng.choice("abxé "))
        elif b and kind < 0.7:
            b[min(at, len(b) - 1)] = rng.choice("abxé ")
        elif b:
            del b[min(at, len(b) - 1)]
    return "".join(b)


def test_bounds_and_edit_distance():
    rng = random.Random(2)
    for i in range(300):
        a = "".join(rng.choices("abcd é漢", k=rng.randint(0, 90)))
        b = edited(rng, a, rng.randint(0, 9)) if i % 5 else "".join(rng.choices("abcd é", k=30))
        d = edit_distance(a, b)
        assert line_dedup.edit_distance(a, b, 200) == d
        limit = rng.randint(0, 12)
        assert min(line_dedup.edit_distance(a, b, limit), limit + 1) == min(d, limit + 1)
        x, y = line_dedup.letter_counts([a, b]).astype(int)
        assert max(np.maximum(x - y, 0).sum(), np.maximum(y - x, 0).sum()) <= d
        assert line_dedup.shares_grams(a, b, d)
        longer = max(len(a), len(b))
        assert line_dedup.similar(a, b) == (d <= math.floor(longer * 0.1 + 1e-9))
    assert line_dedup.letter_counts(["a" * 500]).max() == 127
    assert not line_dedup.shares_grams("ab" * 30, "cd" * 30, 60 // line_dedup.GRAM - 1)
    assert line_dedup.shares_grams("ab" * 30, "cd" * 30, 60 // line_dedup.GRAM)


def test_long_lines_are_compared(spark):
    rng = random.Random(18)
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(300)]
    docs = []
    for i in range(6):
        line = rng.choices(words, k=rng.choice([90, 120]))
        docs.append((i, " ".join(line)))
        for j in rng.sample(range(len(line)), len(line) // rng.choice([12, 30])):
            line[j] = rng.choice(words)
        docs.append((100 + i, " ".join(line)))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain_dedup(docs)


def test_keys_are_the_first_pairs():
    rng = random.Random(5)
    lines = [rng.choices([f"word{i}" for i in range(40)], k=k) for k in (1, 2, 5, 8, 9, 30, 60)]
    h, length, sizes = some_words(lines)
    hashes = dict(zip([w for words in lines for w in words], h))
    keys, n = line_dedup.keys_of(h, length, sizes)
    at = np.cumsum(n) - n
    both = []
    for i, words in enumerate(lines):
        own = set(keys[at[i]:at[i] + n[i]].tolist())
        assert len(own) == n[i] and 1 <= n[i] <= 2 * line_dedup.KEYS
        # every key is a pair of the line, and a line's copy has the same keys
        pairs = {int(line_dedup.mixed(np.array([hashes[a]]) * line_dedup.GOLDEN + hashes[b])[0])
                 for j, a in enumerate(words) for b in (words[j + 1:] or words[j:])}
        assert own <= pairs
        both.append(own)
    again, m = line_dedup.keys_of(h[::1].copy(), length, sizes)
    assert (again == keys).all() and (m == n).all()


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Many variants of one line, linked to their neighbours, in buckets of several blocks."""
    monkeypatch.setattr(line_dedup, "BLOCK", 4)
    base = "abcdefghij klmnopqrst uvwxyzabcd efghijklmn opqrstuvwx yzabcdefgh ijklmnopqr"
    docs = [(i, base + " " + "x" * (i % 4 + 1) + chr(97 + i)) for i in range(26)]
    docs += [(100 + i, base + " " + c * 9) for i, c in enumerate("stuvwz")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain_dedup(docs)


def test_a_common_pair_of_words_joins_nothing(spark):
    """A third of all lines hold the same two long words; some of them have a variant."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(2000)]
    docs = []
    for i in range(400):
        line = rng.choices(words, k=12)
        if i % 3 == 0:
            line[4:6] = ["extraordinarily", "commonplace"]
        docs.append((i, " ".join(line)))
        if i % 30 == 0:
            docs.append((1000 + i, " ".join(line) + "x"))
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {d for d, n in got.items() if n} == {1000 + i for i in range(0, 400, 30)}


def test_scripts_without_spaces_are_compared(spark):
    chinese = "这一行文字在许多文档中重复出现，因此只应保留一次。"
    japanese = "この行は多くの文書で繰り返されるため、一度だけ残すべきです。"
    docs = [(1, chinese + "\n短行"), (2, "另一个开头\n" + chinese), (3, japanese),
            (4, japanese.replace("多くの", "多くな") + "\n短行"), (5, "短行"),
            (6, "Donaudampfschifffahrtsgesellschaftskapitän Mütze"),
            (7, "donaudampfschifffahrtsgesellschaftskapitän: Mütze!"), (8, "two words"),
            (9, "two words")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict(docs) | {2: "另一个开头", 4: "短行", 7: ""}


def varied_lines():
    """Lines of 5 to 60 words, each followed by a variant of edit similarity >= 0.9: one word
    replaced, or typos at random places up to a share of the edits allowed."""
    rng = random.Random(31)
    letters = "etaoinshrdlucmfwypvbgk"
    vocabulary = ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(3000)]
    out = []
    while len(out) < 600:
        n = rng.choice([5, 7, 10, 15, 20, 30, 40, 60])
        words = rng.choices(vocabulary, k=n)
        a, kind = " ".join(words), len(out) % 3
        if kind == 0:
            words[rng.randrange(n)] = rng.choice(vocabulary)
            b = " ".join(words)
        else:
            b = list(a)
            for i in rng.sample(range(len(a)), max(1, len(a) // (30 if kind == 1 else 15))):
                b[i] = b[i] if b[i] == " " else rng.choice(letters)
            b = "".join(b)
        if a != b and edit_distance(a, b) <= math.floor(max(len(a), len(b)) * 0.1 + 1e-9):
            out.append((("word", "few typos", "many typos")[kind], n, a, b))
    return out


def test_lines_of_edit_similarity_are_found(spark):
    """Recall by edit similarity alone, without the operator's own hashes."""
    pairs = varied_lines()
    docs = [(2 * i + j, line) for i, p in enumerate(pairs) for j, line in enumerate(p[2:])]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert not any(got[2 * i] for i in range(len(pairs)))  # no two lines by chance
    found = defaultdict(list)
    for i, p in enumerate(pairs):
        found[p[0]].append(got[2 * i + 1])
    recall = {kind: sum(f) / len(f) for kind, f in found.items()}
    assert recall["word"] > 0.99 and recall["few typos"] > 0.98
    assert recall["many typos"] > 0.9


def test_line_dedup_odd_rows(spark):
    docs = odd_documents()
    df = spark.createDataFrame(docs, SCHEMA).withColumnRenamed("source", "n_lines")
    got = line_dedup.dedup_lines(df).collect()
    assert len(got) == len(docs)
    twins = [r for r in got if r.doc_id == 1 and r.text.startswith("one")]
    assert len(twins) == 2 and all(r.n_removed == 0 for r in twins)  # equal rows are one document
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_words_of(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def plain_scan(docs):
    """Cosines of every line and text to every notice, with all words weighed alike."""
    notices = [(name, Counter(plain_words_of(t)))
               for name, texts in license_scan.TEMPLATES.items() for t in texts]
    vocabulary = {w for _, n in notices for w in n}
    df = Counter(w for _, t in docs for w in set(plain_words_of(t or "")) & vocabulary)
    n = len(docs)
    idf = {w: math.log((n + 1) / (df[w] + 1)) + 1 for w in vocabulary}
    other = math.log((n + 1) / 2) + 1
    rare = {w for w in vocabulary if df[w] <= license_scan.RARE_SHARE * n}
    out = {}
    for doc_id, text in docs:
        best = None
        for unit, part in enumerate([text or "", *(text or "").split("\n")], -1):
            tf = Counter(plain_words_of(part))
            if not rare & tf.keys():
                continue
            size = math.sqrt(sum((c * idf.get(w, other)) ** 2 for w, c in tf.items()))
            for name, notice in notices:
                length = math.sqrt(sum((c * idf[w]) ** 2 for w, c in notice.items()))
                dot = sum(c * idf[w] * tf[w] * idf[w] for w, c in notice.items())
                cos = round(dot / size / length, 6)
                if cos >= license_scan.MATCH:
                    best = min(best or (9,), (-cos, unit, name))
        out[doc_id] = best and (best[2], -best[0], best[1])
    return out


def licence_documents():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(80)] + ["the", "this", "of", "work"]
    docs = [(i, " ".join(rng.choices(words, k=30))) for i in range(60)]
    docs += [(100, "w1 w2\nReleased under the MIT License.\nw3"),
             (101, "Licensed under the Apache License, Version 2.0."),
             (102, "intro\nThis work is licensed under the GNU General Public License, version 3."),
             (103, "LICENSED UNDER CC BY-NC 4.0"), (104, None), (105, ""),
             (106, "w1 license w2 w3 w4 w5 w6 w7"), (107, "w5 w6\nlicensed under cc by 4.0 w9")]
    return docs


def test_licence_scan_equals_brute_force(spark):
    docs = licence_documents()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(df, F.lit(None).cast("string")).collect()}
    for doc_id, want in plain_scan(docs).items():
        r = got[doc_id]
        if want is None:
            assert r.licence is None and r.via is None
        else:
            assert (r.licence, r.notice_line) == (want[0], want[2])
            assert r.cosine == pytest.approx(want[1], abs=2e-6)
    assert got[100].via == "header" and got[101].via == "file" and got[106].licence is None


@pytest.mark.parametrize("n_plain,n_mit", [(2, 1), (10, 2), (40, 30)])
def test_common_notices_are_found(spark, n_plain, n_mit):
    """Small tables, and a notice that a large share of all documents carries."""
    docs = [(i, f"w{i} the work of w{i + 1}") for i in range(n_plain)]
    docs += [(100 + i, f"x{i} of\nReleased under the MIT License.\ny{i}") for i in range(n_mit)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.licence, r.notice_line) for r in license_scan.scan(
        df, F.lit(None).cast("string")).collect()}
    assert got == {d: ("MIT", 1) if d >= 100 else (None, None) for d, _ in docs}
    assert {d: w and (w[0], w[2]) for d, w in plain_scan(docs).items()} == {
        d: None if v[0] is None else v for d, v in got.items()}


def test_licences_are_inherited_from_the_nearest_directory(spark):
    mit, apache = "Released under the MIT License.", "Licensed under CC BY-NC 4.0."
    rows = [(1, mit, "p/LICENSE"), (2, "w1 w2", "p/a.txt"), (3, "w3", "p/x/y/b.txt"),
            (4, apache, "p/x/COPYING"), (5, "w4 w4", "q/c.txt"), (6, None, "p/x/y/z/d.txt"),
            (7, "w5", "e.txt"), (8, "w6", None), (9, "w7 w8\n" + apache, "p/own.txt")]
    rows += [(100 + i, f"w{i} w{i + 1} w{i + 2}", "r/f.txt") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = {r.doc_id: (r.licence, r.via, r.from_dir) for r in license_scan.scan(
        df, F.col("path")).collect()}
    assert got[2] == ("MIT", "inherited", "p") and got[3] == ("CC-BY-NC-4.0", "inherited", "p/x")
    assert got[6] == ("CC-BY-NC-4.0", "inherited", "p/x") and got[9][1] == "header"
    assert got[5] == got[7] == got[8] == (None, None, None)


MIT_TEXT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def test_full_licence_texts_are_inherited(spark):
    rows = [(1, MIT_TEXT, "p/LICENSE.txt"), (2, "w1 w2", "p/x/a.txt"),
            (3, MIT_TEXT, "q/notes.txt"), (4, "w3 w4", "q/b.txt")]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = {r.doc_id: (r.licence, r.via, r.from_dir) for r in license_scan.scan(
        df, F.col("path")).collect()}
    assert got[2] == ("MIT", "inherited", "p") and got[1][0] == got[3][0] == "MIT"
    assert got[4] == (None, None, None)


def test_licence_scan_odd_rows(spark):
    df = spark.createDataFrame(odd_documents(), SCHEMA).withColumnRenamed("source", "licence")
    got = license_scan.scan(df, F.col("licence"))
    assert got.count() == len(odd_documents())
    assert license_scan.scan(spark.createDataFrame([], SCHEMA), F.col("source")).count() == 0
