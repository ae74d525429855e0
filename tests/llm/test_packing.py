import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from strandlake.llm import packing, token_counts

TEXTS = [
    None, "", " ", "a", "  two  spaces ", "tab\t and\n newline \n x", "It's we'll  DON'T 've", "<|endoftext|> x <|endoftext|>y",
    "nbsp  x  y 　 z", "café é ﬁ Ω", "x" * 3000, "word " * 2000, "1234567 89 ...!!! --", "\x1c a \x85 b",
    "ΣΑΣ <|startoftext|>", "End. Of, it. x., It's. é. 3. A.B. <|STARTOFTEXT|> <|endoftext|>. e\u0301. E\u0301 ", "日本語 テキスト", "the quick brown fox",
]


@pytest.fixture(scope="module")
def tokenizer():
    return packing.load_tokenizer(packing.TOKENIZER)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab'sé \t\n 1.<|>", max_size=40), max_size=5))
def test_chunks_give_the_ids_of_the_whole_text(tokenizer, texts):
    coded = packing.id_encoder(tokenizer)(texts)
    assert [list(np.frombuffer(c, "<u4")) for c in coded] == [ids_of(tokenizer, t) for t in texts]


def check_packed(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_documents(spark, tokenizer):
    docs = [(i, t, 1.5) for i, t in enumerate(TEXTS)] + [(3, "a", None), (3, "other", None), (None, "no id", None)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, length double")
    rows = packing.pack_documents(table, with_ids=True).collect()
    expected = []
    for doc, text, _ in docs:
        ids = [*ids_of(tokenizer, text), 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)] if len(ids) > 1024 else [0, len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected.append((doc, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    bins = check_packed(rows, 1024)
    whole = packing.sequences(packing.pack_documents(table, with_ids=True)).collect()
    assert len(whole) == len(bins) and sum(len(r.ids) for r in whole) == sum(e[3] for e in expected)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack_documents(empty).count() == 0
    assert token_counts.count_tokens(empty).count() == 0


def plain_bins(plan):
    return [sizes for sizes, times in plan for _ in range(times)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_plan_uses_every_piece_once(sizes):
    counts = {s: sizes.count(s) for s in set(sizes)}
    bins = plain_bins(packing.best_two_fit(counts, 20))
    assert sorted(s for b in bins for s in b) == sorted(sizes)
    assert all(0 < sum(b) <= 20 for b in bins)


def test_replacement_by_two():
    # greedy gives 10 + 4 with room 6, although 5 and 5 ... fill the bin
    assert [10, 7, 3] in plain_bins(packing.best_two_fit({10: 1, 8: 1, 7: 1, 3: 1}, 20))


def test_plan_is_short_and_tight_for_many_pieces():
    rng = random.Random(1)
    counts = {s: rng.randrange(1, 10**9) for s in range(1, 1025)}
    plan = packing.best_two_fit(counts, 1024)
    total = sum(s * n for s, n in counts.items())
    assert len(plan) < 5000
    assert sum(times for _, times in plan) < 1.02 * total / 1024


def test_hot_length(spark):
    docs = spark.createDataFrame([(i, "one two three") for i in range(3000)] + [(9999, "x")], "doc_id bigint, text string")
    rows = packing.pack_documents(docs, capacity=10).collect()
    check_packed(rows, 10)
    assert len(rows) == 3001 and len({r.sequence_id for r in rows}) == 1500


@pytest.mark.parametrize("head", [0, 3, 200_000])
def test_token_counts(spark, head):
    tokenizer = packing.load_tokenizer(token_counts.TOKENIZER)
    docs = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "a", "y"), (3, "other", "z"), (None, "no id", None)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, word string")
    rows = token_counts.count_tokens(table, head=head).collect()
    expected = [(d, len((t or "").encode()), len(ids_of(tokenizer, t))) for d, t, _ in docs]
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.n_bytes, r.n_tokens)) for r in rows)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abS'sÉé́ \t\n1.,<|>", max_size=40))
def test_pre_tokens_add_up(word_tokenizer, text):
    parts = [p.decode() for p in token_counts.pre_tokens(text.encode())]
    assert sum(len(ids_of(word_tokenizer, p)) for p in parts) == len(ids_of(word_tokenizer, text))


@pytest.fixture(scope="module")
def word_tokenizer():
    return packing.load_tokenizer(token_counts.TOKENIZER)
