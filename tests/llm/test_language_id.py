import math
import zlib

import numpy as np
import pytest
from strandlake.llm import language_id as li
from strandlake.llm.queries import op1_language_id


def plain_log_probability(word, pieces, probability):
    """Sum over all segmentations, by recursion; every prefix is rescaled."""
    def number(part):
        key = li._hash(li._codes([part], len(part)))[0, -1]
        at = int(np.searchsorted(pieces.hashes, key))
        return at if at < len(pieces.hashes) and pieces.hashes[at] == key else None

    word = li.marked(word)
    total = [0.0]
    for end in range(1, len(word) + 1):
        parts = []
        for start in range(max(0, end - pieces.longest), end):
            piece = number(word[start:end])
            if piece is None and end - start == 1:
                piece = pieces.size - 1
            if piece is not None:
                parts.append(total[start] + math.log(probability[piece]))
        total.append(max(parts) + math.log(sum(math.exp(p - max(parts)) for p in parts)))
    return total[-1]


@pytest.fixture(scope="module")
def pieces():
    return li.load_pieces()


def test_forward_sums_all_segmentations(pieces):
    rng = np.random.default_rng(0)
    probability = rng.dirichlet(np.full(pieces.size, 0.5), size=2).T + 1e-12
    model = li.Model(pieces, ["a", "b"], np.zeros(2), probability)
    words = ["the", "▁", "thereafter", "日本ฉx", "a" * 60, "\x00z", "ées", "wonderful" * 20, "the" * 40]
    scores = li.word_scores(words, model)
    for word, row in zip(words, scores, strict=True):
        for language in (0, 1):
            assert math.isclose(row[language], plain_log_probability(word, pieces, probability[:, language]), rel_tol=1e-9)


def test_no_cut_within_a_word(pieces):
    """The whole word of 60 letters, not two parts of it."""
    probability = np.full((pieces.size, 1), 1 / pieces.size)
    model = li.Model(pieces, ["a"], np.zeros(1), probability)
    word = "internationalisation" * 3
    whole, one, other = li.word_scores([word, word[:31], word[31:]], model)[:, 0]
    assert math.isclose(whole, plain_log_probability(word, pieces, probability[:, 0]), rel_tol=1e-12)
    assert whole > one + other + 1


def test_words_of_any_length_in_one_batch(pieces):
    rng = np.random.default_rng(3)
    probability = rng.dirichlet(np.full(pieces.size, 0.5), size=2).T + 1e-12
    words = ["a", "of", "the" * 21, "then" * 16, "x" * 3000, "grown", "ฉ" * 65]
    lattice = li._Lattice(words, pieces)
    times = rng.random((len(words), 2))
    together = lattice.expected(probability, times)
    alone = [li._Lattice([w], pieces).expected(probability, t[None]) for w, t in zip(words, times, strict=True)]
    assert np.allclose(together, sum(alone), rtol=1e-9)
    sizes = sorted(i for some, _ in li.lattices(words * 3, pieces) for i in some)
    assert sizes == list(range(3 * len(words)))


def test_remembered_words_change_nothing(pieces, monkeypatch):
    rng = np.random.default_rng(4)
    probability = rng.dirichlet(np.full(pieces.size, 0.5), size=2).T + 1e-12
    model = li.Model(pieces, ["a", "b"], np.log([0.5, 0.5]), probability)
    texts = [" ".join(rng.choice(["one", "two", "three", "four" * 9, "five", "six"], 4)) for _ in range(40)]
    expected = [li.Scorer(model)([t])[0] for t in texts]
    for limit in (1, 3, 5):
        monkeypatch.setattr(li, "_REMEMBERED", limit)
        score = li.Scorer(model)
        found = [p for i in range(0, 40, 5) for p in score(texts[i:i + 5])]
        assert [p[0] for p in found] == [p[0] for p in expected]
        assert np.allclose([p[1] for p in found], [p[1] for p in expected], rtol=1e-9)


def test_ties_go_to_the_first_language(pieces):
    probability = np.full((pieces.size, 3), 1 / pieces.size)
    model = li.Model(pieces, ["aa", "bb", "cc"], np.log([1 / 3] * 3), probability)
    assert [p[0] for p in li.Scorer(model)(["any words", "here"])] == ["aa", "aa"]


def test_expected_counts_fit_lengths(pieces):
    probability = np.full((pieces.size, 1), 1 / pieces.size)
    lattice = li._Lattice(["zq"], pieces)
    counts = lattice.expected(probability, np.array([[2.0]]))
    eps = 1e-6  # the derivative of the log probability gives the expected counts
    for piece in np.flatnonzero(counts[:, 0]):
        more = probability.copy()
        more[piece] *= 1 + eps
        slope = (np.log(lattice.forward(more)[3, 0, 0]) - np.log(lattice.forward(probability)[3, 0, 0])) / eps
        assert math.isclose(counts[piece, 0], 2 * slope, rel_tol=1e-3)


def test_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op1_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_odd_rows(spark):
    docs = [(1, "hello there friend", "en", "x"), (2, "bonjour mon ami", "fr", None), (3, None, "en", None), (4, "", None, None),
            (5, "123 ½² Ⅷ ...", "en", None), (6, "hello " * 40_000, None, None), (None, "ami", None, None), (2, "bonjour", "fr", "y"),
            (7, "x" * 100_000, None, None)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, score string")
    model = li.train(table)
    found = {(r.doc_id, r.lang_pred) for r in li.predict(table, model).collect()}
    assert {(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (None, "fr")} <= found
    kept = li.keep_known(table, model)
    assert kept.columns == table.columns
    sure = {(r.doc_id, r.lang_pred) for r in li.predict(table, model).collect() if r.lang_pred != "und" and r.score >= 0.5}
    assert sorted(r.doc_id or 0 for r in kept.collect() if r.doc_id != 2) == sorted(d or 0 for d, _ in sure if d != 2)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    model = li.train(empty)
    assert li.predict(empty, model).count() == 0
    one = spark.createDataFrame([(1, "words", None)], empty.schema)
    assert [tuple(r) for r in li.predict(one, model).collect()] == [(1, "und", 0.0)]


def test_runs_of_pieces_never_seen(pieces):
    unseen = 1e-15
    probability = np.full((pieces.size, 2), unseen)
    probability[:, 1] = 1 / pieces.size
    run = "\u0e01\u0e02\u0e03\u0e04" * 8
    words = [run, "the", "\u0e01" * 32]
    lattice = li._Lattice(words, pieces)
    assert lattice.forward(probability)[33, 0, 0] == 0  # beyond a double
    model = li.Model(pieces, ["a", "b"], np.zeros(2), probability)
    for word, score in zip(words, li.word_scores(words, model), strict=True):
        for language in (0, 1):
            assert math.isclose(score[language], plain_log_probability(word, pieces, probability[:, language]), rel_tol=1e-12)
    times = np.array([[0.0, 2.0], [3.0, 1.0], [5.0, 0.0]])
    counts = lattice.expected(probability, times)
    assert np.isfinite(counts).all() and counts[:, 0].sum() > 5 and counts[:, 1].sum() > 2
    alone = [li._Lattice([w], pieces).expected(probability, t[None]) for w, t in zip(words, times, strict=True)]
    assert np.allclose(counts, sum(alone))
    plain = np.full((pieces.size, 1), 1 / pieces.size)
    once = np.array([[1.0]])
    ordinary = li._Lattice(["whether"], pieces)
    assert np.allclose(ordinary.expected(plain, once), ordinary._expected_by_logs(plain, once), rtol=1e-9)
