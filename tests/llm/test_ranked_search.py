import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandlake.llm import ranked_search as rs

from .test_phrases import plain_words


def plain(docs, items, top=10):
    terms = [(doc, Counter(plain_words(text))) for doc, text in docs]
    terms = [(doc, t) for doc, t in terms if t]
    n_docs, n_terms = len(terms), sum(sum(t.values()) for _, t in terms)
    df = Counter(w for _, t in terms for w in t)
    out = []
    for item, text in items:
        scores = []
        for doc, t in terms:
            m = 100 - 90 + (90 * sum(t.values()) * n_docs) // n_terms
            score = 0
            for w in set(plain_words(text)) & t.keys():
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * t[w]) // (1000 * t[w] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, i, None if null else doc, -s) for i, (s, null, doc) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    documents = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(1))
    tests = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    result = rs.search(documents, tests, **more)
    assert result.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in result.collect()), key=repr)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 30, 200])))) for i in range(n)]
    items = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 4, 25])))) for i in range(25)]
    return docs, items


@pytest.mark.parametrize("segment", [1, 7, 100, 16_384])
def test_against_all_scores(spark, segment, monkeypatch):
    monkeypatch.setattr(rs, "_SEGMENT_ROWS", segment)
    docs, items = corpus(segment)
    expected = plain(docs, items)
    assert found(spark, docs, items) == expected
    assert found(spark, docs, items, block_terms=40) == expected


def test_odd_rows(spark):
    docs = [
        (1, "One two. THREE"), (2, None), (3, ""), (4, "... !"), (None, "one two"), (5, "one two"), (1, "one, two"), (5, "one two"),
        (6, "é É"), (7, "one " * 100_000), (8, "rare"),
    ]
    items = [(1, "two one"), (1, "three"), (2, None), (3, " . "), (4, "unseen"), (5, "É"), (None, "rare rare")]
    assert found(spark, docs, items) == plain(docs, items)


def test_many_ties_keep_the_lowest_ids(spark):
    docs = [(i, "same words here") for i in range(300)]
    assert [r[2] for r in sorted(found(spark, docs, [(1, "same")]))] == list(range(10))


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, None)], [(1, "a")]) == []


@pytest.mark.parametrize("short", [1, 64, 10**9])
def test_segments_return_the_best(short, monkeypatch):
    """All lists short, some, or none: the same documents; and blocks that cannot reach the score are skipped."""
    monkeypatch.setattr(rs, "SHORT", short)
    rng = np.random.default_rng(5)
    n = 2000
    found = [np.sort(rng.choice(40, 6, p=np.arange(1, 41) / 820)).astype(np.int32) for _ in range(n)]
    weights = np.arange(40, 0, -1) * 10
    segment = rs._Segment(found, [6] * n, weights, n, 6 * n)
    for terms in ([0, 5, 30, 39], [1], [38, 39], list(range(40))):
        scores = np.zeros(n, np.int64)
        for t in terms:
            if t in segment.lists:
                a, b = segment.lists[t]
                np.add.at(scores, segment.doc[a:b], segment.value[a:b])
        for least in (1, int(np.partition(scores, n - 5)[n - 5])):
            docs, got = segment.best(terms, least, 10)
            assert (got == scores[docs]).all()
            floor = max(least, int(np.partition(scores, n - 10)[n - 10]))
            assert set(np.flatnonzero(scores >= max(floor, 1))) == {d for d, s in zip(docs, got, strict=True) if s >= floor}
