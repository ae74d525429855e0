import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from strandlake.llm import spelling


def plain_words(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            number = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if number % 97 == 0:
                run = run[:number % len(run)] + run[number % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(docs):
    words = plain_words(docs)
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def found(spark, docs):
    table = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    return sorted((tuple(r) for r in spelling.spelling_groups(table).collect()), key=repr)


def test_random_words_against_all_pairs(spark):
    rng = random.Random(3)
    letters = "aé"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 8))) for _ in range(150)]
    docs = [(i, " ".join(rng.choices(words, weights=[1 + (j % 7) ** 3 for j in range(150)], k=400))) for i in range(25)]
    expected = plain(docs)
    assert found(spark, docs) == expected
    assert sum(r[1] is not None for r in expected) > 20 and any(r[1] != r[2] and r[1] for r in expected)


def test_odd_rows(spark):
    long = "abcdefghij" * 9  # two words with one edit far from either end, and one at an end
    docs = [
        (1, "Words WORDS words wordz wordz wordz, wordĀword"), (2, None), (3, ""), (None, "words wordsé wordsé wordsé"),
        (4, "aaaaa " * 20 + "aaaaaa " * 8 + "aaaaaaa " * 4 + "aaaa " * 50), (4, "aaaaa " * 20),
        (5, f"{long} " * 5 + f"{long[:44]}X{long[45:]} " * 12 + f"{long}x " * 30),
        (6, "tieab tieab tieab tieac tieac tieac tieac tieac tieac tiead tiead tiead tiead tiead tiead"),
        (7, "z" * 5000 + " " + "z" * 5000 + " " + "z" * 5000),
    ]
    got = found(spark, docs)
    assert got == plain(docs)
    assert ("tieab", "tieac", "tieac", 3, 2, 6) in got


def test_empty_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, "only short or rare words here")]) == []


@pytest.mark.parametrize("steps", [1, 2, 4])
def test_labels_of_any_length(spark, steps, monkeypatch):
    monkeypatch.setattr(spelling, "STEPS", steps)
    rng = random.Random(steps)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(5, 11))) for _ in range(60)}
    words = sorted(words)
    table = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n bigint")
    got = {(r.word, r.near, r.near_n) for r in spelling.near_pairs(table).collect()}
    assert got == {(a, b, words.index(b) + 1) for a in words for b in words if one_edit(a, b)}


def test_runs():
    assert spelling.runs_of("Ab1É×é÷ zāq".encode()) == [b"ab", "É×é÷".encode(), b"z", b"q"]
    assert spelling.runs_of(None) == spelling.runs_of(b"12 ..") == []
