import hashlib
import random

import numpy as np
from pyspark.sql import functions as F
from strandlake.llm import order_minhash as om


def mixed(x):
    for _ in range(2):
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 % 2**64
    return x ^ (x >> 32)


def plain_fingerprint(text):
    """Runs one at a time, numbered in a dictionary; selected by sorting each part."""
    if not text:
        return [0] * om.PARTS
    runs = [text[i:i + om.CHARS] for i in range(max(1, len(text) - om.CHARS + 1))]
    hashes, seen, parts = [], {}, [[] for _ in range(om.PARTS)]
    for place, run in enumerate(runs):
        h = 0
        for c in run:
            h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
        hashes.append(mixed(h))
        key = hashes[-1] >> 24
        item = mixed((key + seen.get(key, 0) * 0x9E3779B97F4A7C15) % 2**64)
        # ties of the bits that are compared go by run, then occurrence
        parts[item >> 58].append((item >> 24, key, seen.get(key, 0), place))
        seen[key] = seen.get(key, 0) + 1
    out = []
    for items in parts:
        places = sorted(place for *_, place in sorted(items)[:om.TUPLE])
        at = [None] * (om.TUPLE - len(places)) + places
        total = 0
        for place in at:
            total = mixed((total * 0x9E3779B97F4A7C15 + (0 if place is None else hashes[place]) + 1) % 2**64)
        out.append((total >> 32) | 1 if places else 0)
    return out


def plain_likeness(a, b):
    used = [i for i in range(len(a)) if a[i] or b[i]]
    return sum(a[i] == b[i] for i in used) / len(used) if used else 1.0


def plain(docs):
    docs = sorted(docs, key=lambda d: -d[0] if d[0] is not None else 2**63)
    out = []
    for i, (doc, text) in enumerate(docs):
        text, then = text or "", docs[(i + 1) % len(docs)][1] or ""
        half = len(text) // 2
        changed = text[:len(text) - half] + then[:half]
        a, b, c = map(plain_fingerprint, (text, changed, then))
        out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), hexed(a), hexed(b), plain_likeness(a, b), plain_likeness(a, c)))
    return sorted(out, key=repr)


def hexed(mark):
    return np.array(mark, np.uint32).tobytes().hex()


def found(spark, docs):
    table = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("mark", F.lit("clash")).withColumn("part", F.lit(1))
    return sorted((tuple(r) for r in om.edited_documents(table).collect()), key=repr)


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "épsilon", "日本語", "\U0001F600"]) for _ in range(n))


def test_against_plain_runs(spark):
    rng = random.Random(1)
    docs = [(i * 7, words(rng, rng.choice([1, 3, 40, 200]))) for i in range(40)]
    docs += [(1, None), (2, ""), (3, "x"), (4, "abcd"), (5, "abcde"), (None, "a text without an id"), (6, docs[3][1]), (8, "la" * 3000)]
    assert found(spark, docs) == plain(docs)


def test_one_row_no_row_and_repeated_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, "its own next")]) == plain([(1, "its own next")])
    rows = [(1, "the same row")] * 5 + [(2, "another")]
    assert found(spark, rows) == plain(rows)


def test_ties_of_ids_go_by_text(spark):
    rows = [(1, "one text of an id"), (1, "another text of an id"), (0, "zero")]
    got = found(spark, rows)
    assert got == found(spark, rows[::-1]) and len(got) == 3


def test_fingerprint_sees_order_and_content():
    rng = random.Random(2)
    base = [f"{rng.randrange(10**6):x}" for _ in range(400)]
    text = " ".join(base)

    def like(other):
        return om.likeness(om.fingerprint(om.codes_of(text)), om.fingerprint(om.codes_of(other)))

    one_word = like(" ".join([*base[:200], "changed", *base[201:]]))
    halves = like(" ".join(base[200:] + base[:200]))
    shuffled = like(" ".join(rng.sample(base, len(base))))
    unlike = like(" ".join(f"{rng.randrange(10**6):x}" for _ in range(400)))
    assert like(text) == 1 and one_word > 0.85 and 0.3 < halves < 0.7 and unlike < 0.05 < shuffled < halves + 0.1


def test_long_texts_take_the_other_sort(monkeypatch):
    rng = random.Random(4)
    codes = om.codes_of(words(rng, 3000))
    quick = om.fingerprint(codes)
    monkeypatch.setattr(om, "_order", lambda values: np.argsort(values >> np.uint64(24), kind="stable"))
    assert (om.fingerprint(codes) == quick).all()
