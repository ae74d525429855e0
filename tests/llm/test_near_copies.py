import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from strandlake.llm import near_copies


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_kept(docs):
    """Numbers of the rows that stay."""
    sets = [plain_set(text) for _, text in docs]
    group = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            if group[i] != group[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    best = {}
    for i, (doc, _) in enumerate(docs):
        if group[i] not in best or doc < docs[best[group[i]]][0]:
            best[group[i]] = i
    return sorted(docs[i][0] for i in best.values())


def edited(words, rng, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_stage_drops_copies_with_a_few_words_changed(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(300)]
    docs = [(1, " ".join(base)), (2, edited(base, rng, 3)), (3, edited(base, rng, 5)), (4, edited(base, rng, 40)),
            (5, " ".join(base[20:])), (6, "another text of six words here")]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6] == plain_kept(docs)


def plain_distance(a, b):
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def plain_groups(items, linked):
    group = list(range(len(items)))
    for i in range(len(items)):
        for j in range(i):
            if group[i] != group[j] and linked(items[i], items[j]):
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    return group


def corpus(seed):
    rng = random.Random(seed)
    notice = [f"n{i}" for i in range(30)]
    docs = [(0, None), (1, ""), (2, "  ")]
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([4, 6, 60, 200]))]
        for _ in range(rng.choice([1, 4, 20])):
            tail = notice if rng.random() < 0.5 else []
            docs.append((len(docs), edited(base + tail, rng, rng.randint(0, 4))))
    return docs


@pytest.mark.parametrize("seed", [1, 4])
def test_groups_are_those_of_close_fingerprints(spark, seed, monkeypatch):
    docs = corpus(seed)
    # keys of one byte: every close pair meets somewhere
    monkeypatch.setattr(near_copies, "TABLES", [(i, i) for i in range(32)])
    found = near_copies.near_copies(spark.createDataFrame(docs, "doc_id bigint, text string"))
    groups = {r.id: r.group for r in found.collect()}
    prints = [near_copies.fingerprint((text or "").encode()) for _, text in docs]
    plain = plain_groups(prints, lambda a, b: plain_distance(a, b) <= near_copies.RADIUS)
    for i in range(len(docs)):
        for j in range(i):
            assert (groups[i] == groups[j]) == (plain[i] == plain[j])
    assert 10 < len(set(plain)) < len(docs)


def test_recall_and_precision_on_sets(spark):
    docs = corpus(7) + [(1000 + d, t) for d, t in corpus(8)]
    found = near_copies.near_copies(spark.createDataFrame(docs, "doc_id bigint, text string"))
    groups = {r.id: r.group for r in found.collect()}
    sets = [plain_set(text) for _, text in docs]
    alike = missed = wrong = 0
    for i in range(len(docs)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            together = groups[docs[i][0]] == groups[docs[j][0]]
            alike += 5 * both >= 4 * either
            missed += 5 * both >= 4 * either and not together
            wrong += both < 0.5 * either and together
    assert alike > 100 and missed <= 0.1 * alike and not wrong


def test_bit_planes_count_distances(monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 2**63, (5, 4), dtype=np.int64).view(np.uint64)
    prints = []
    for i in range(400):
        bits = np.unpackbits(centres[i % 5].view(np.uint8))
        bits[rng.choice(256, rng.integers(0, 60), replace=False)] ^= 1
        prints.append(np.packbits(bits).view("<u8"))
    prints = np.array(prints)
    bucket = np.sort(rng.integers(0, 4, 400))
    root = np.concatenate([np.sort(rng.integers(0, 200, (bucket == b).sum())) for b in range(4)])
    monkeypatch.setattr(near_copies, "_WORDS_AT_ONCE", 7)
    u, v = near_copies.bucket_links(bucket, root, prints)

    def linked(i, j):
        same_root = root[i] == root[j]
        return bucket[i] == bucket[j] and (same_root or plain_distance(prints[i].tobytes(), prints[j].tobytes()) <= near_copies.RADIUS)

    for b in range(4):
        rows = np.flatnonzero(bucket == b)
        plain = plain_groups(list(rows), linked)
        links = {tuple(sorted(p)) for p in zip(u.tolist(), v.tolist(), strict=True)}
        mine = plain_groups([int(root[i]) for i in rows], lambda x, y: x == y or tuple(sorted((x, y))) in links)
        # links of other buckets may join more
        for x in range(len(rows)):
            for y in range(x):
                assert plain[x] != plain[y] or mine[x] == mine[y]
    assert near_copies.bucket_links(bucket[:0], root[:0], prints[:0])[0].size == 0


def test_a_large_group_and_unlike_documents_that_share_a_notice(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    notice = " ".join(f"n{i}" for i in range(40))
    docs = [(i, edited(base, rng, 2)) for i in range(300)]
    docs += [(1000 + i, " ".join(f"u{i}x{j}" for j in range(60)) + " " + notice) for i in range(300)]
    docs += [(5000, "word " * 100_000), (5001, "word " * 100_000 + "end")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("fp", F.lit("clash")).withColumn("node", F.lit(1))
    kept = near_copies.drop_near_copies(table)
    assert kept.columns == table.columns
    kept = {r.doc_id for r in kept.collect()}
    assert kept & set(range(300)) == {0} and len(kept & set(range(1000, 1300))) == 300 and 5000 in kept


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_copies.drop_near_copies(empty).count() == 0
    rows = [(1, "one text"), (1, "one text"), (2, "one text"), (3, None), (4, "")]
    kept = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [1, 1, 3]


def test_rows_of_one_id_and_null_ids(spark):
    base = [f"w{i}" for i in range(200)]
    rng = random.Random(2)
    rows = [(1, " ".join(base)), (1, "a clean text"), (None, edited(base, rng, 1)), (None, "clean without an id")]
    kept = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.text for r in kept) == sorted([rows[0][1], rows[1][1], rows[3][1]])
