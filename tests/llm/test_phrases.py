import hashlib
import random

import pytest
from pyspark.sql import functions as F
from strandlake.llm import phrases


def plain_words(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if "A" <= c <= "Z":
            c = c.lower()
        if "a" <= c <= "z" or "0" <= c <= "9" or ord(c) > 127:
            word += c
        elif word:
            words.append(word)
            word = ""
    return words


def plain(docs, items, window=10):
    cuts = []
    for item, text in items:
        words = plain_words(text)
        cuts += [(item, words[i:i + window]) for i in range(max(1, len(words) - window + 1)) if words]
    out = []
    for doc, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for item, cut in cuts:
            for i in range(len(words) - len(cut) + 1):
                if words[i:i + len(cut)] == cut:
                    hit.update(range(i, i + len(cut)))
                    found.add(item)
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    documents = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("term", F.lit("clash"))
    tests = spark.createDataFrame(items, "item_id bigint, text string").withColumn("pos", F.lit(1))
    return sorted((tuple(r) for r in phrases.contamination(documents, tests, **more).collect()), key=repr)


def test_cases(spark):
    ten = "one two three four five six seven eight nine ten"
    items = [
        (1, ten), (2, "Short item"), (3, None), (4, " .. "), (5, "the the the the the the the the the the the"),
        (6, ten + " eleven"), (6, "repeated id of an item that also has ten words here"), (10, "solo"), (7, "ÉTÉ, été!"),
        (8, "never seen"), (9, "a " * 12), (11, "1 a 2 a 3 a 4 a 5 a 6 a 7 a"),
    ]
    docs = [
        (1, ten), (2, "x " + ten.upper().replace(" ", "--") + " eleven y"), (3, None), (4, ""), (5, "\n\t"),
        (6, "the " * 25), (7, "short ITEM short item solo"), (8, "one two three four five six seven eight nine"),
        (9, "a " * 50_000), (1, ten), (1, "same id, other text"), (None, "solo"), (10, "été été ÉTÉ été"),
        (11, "0 1 a 2 a 3 a 4 a 5 a 6 a 7 a 8"), (12, ten[:-1]),
    ]
    assert found(spark, docs, items) == plain(docs, items)


@pytest.mark.parametrize("blocks", [50_000, 20])
def test_random_texts(spark, blocks):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices("abcd", k=rng.randint(0, 9)))) for i in range(25)]
    docs = [(i, " ".join(rng.choices("abcd", k=rng.randint(0, 60)))) for i in range(60)]
    assert found(spark, docs, items, window=4, block_windows=blocks) == plain(docs, items, 4)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b")]) == []
    assert found(spark, [(1, "a b")], []) == plain([(1, "a b")], [])


@pytest.mark.parametrize("distance", [0, 1, 4, 30])
def test_proximity_of_all_places(spark, distance):
    rng = random.Random(distance)
    docs = [(i, " ".join(rng.choices(["rare", "Common", "other", "x", "y"], [1, 6, 3, 20, 20], k=120))) for i in range(15)]
    docs += [(20, None), (21, ""), (None, "rare common, rare"), (22, "common " * 40), (22, "common " * 40), (22, "rare x common")]
    pairs = [("rare", "common"), ("common", "common"), ("other", "rare"), ("unseen", "rare")]
    expected = set()
    for doc, text in docs:
        words = plain_words(text)
        for a, b in pairs:
            expected |= {
                (str(doc), text, a, b, i, j) for i, w in enumerate(words) if w == a
                for j, v in enumerate(words) if v == b and abs(i - j) <= distance and (a != b or i < j)
            }
    table = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("pos", F.lit("clash"))
    texts = {(r.doc_id, r.k): r.text for r in table.select("doc_id", "text", F.xxhash64("text").alias("k")).collect()}
    found = phrases.proximity_matches(table, pairs, distance).collect()
    got = [(str(r.doc_id), texts[r.doc_id, r.text_key], r.first, r.second, r.pos, r.other) for r in found]
    assert len(got) == len(set(got)) and set(got) == expected and (expected or distance == 0)


def test_drop(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, None, "y"), (3, "solo", "z")], "doc_id bigint, text string, lang string")
    items = spark.createDataFrame([(1, "solo"), (2, None)], "item_id bigint, text string")
    kept = phrases.drop_contaminated(docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and kept.columns == docs.columns
