import math
import random
import zlib

import pytest
from pyspark.sql import functions as F
from strandlake.llm import quality
from strandlake.llm.queries import op8_quality

TREES = """RandomForestClassificationModel: uid=x, numTrees=2
  Tree 0 (weight 1.0):
    If (feature 0 <= 2.5)
     If (feature 1 <= -1.0E-3)
      Predict: 0.0
     Else (feature 1 > -1.0E-3)
      Predict: 1.0
    Else (feature 0 > 2.5)
     If (feature 0 <= 4.0)
      Predict: 1.0
     Else (feature 0 > 4.0)
      Predict: 0.0
  Tree 1 (weight 1.0):
    Predict: 0.0
"""


def test_tree_paths():
    assert quality.tree_paths(TREES, ["a", "b"]) == {
        (("a", False, 2.5),), (("a", False, 2.5), ("b", False, -0.001)), (("a", False, 2.5), ("b", True, -0.001)),
        (("a", True, 2.5),), (("a", False, 4.0), ("a", True, 2.5)), (("a", True, 4.0),),
    }


def test_statistics_of_odd_texts(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "ÀB c"), (None, "x" * 300_000), (4, "a\nb\na")]
    rows = quality.statistics(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    found = {(r.id, r.lines, r.line_repeats): r for r in rows}
    assert len(found) == len(rows) == 6
    assert found[4, 1.0, 1 - 2 / 3].word_repeats == pytest.approx(1 / 3)
    assert all(value is not None and value == value for r in rows for value in list(r)[1:])


def test_scores_follow_the_rules(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (3.0, 0.0)], "a double, b double")
    ensemble = quality.Ensemble(0.5, [((("a", True, 2.0),), 1.5), ((("a", False, 1.0), ("b", True, 1.0)), -0.5)])
    scores = [r.s for r in rows.select(ensemble.score().alias("s")).collect()]
    assert scores == pytest.approx([0.5, 1 / (1 + 2.718281828459045 ** -2)])


def plain_statistics(text):
    """Straight loops over the bytes of a text."""
    data = (text or "").encode()
    n = len(data)

    def share(some):
        return sum(b in some for b in data) / n if n else 0.0

    words, word = [], b""
    for b in data + b" ":
        if b in b" \t\n\r\x0b\x0c":
            words += [word] if word else []
            word = b""
        else:
            word += bytes([b])
    lines = data.split(b"\n")
    m = max(len(words), 1)
    good_ends = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz.,;:!?)\"'-"
    odd = 0
    for w in words:
        odd += len(w) > 1 and w[-1] in b"!?" and w[-2] in b"!?" or not (w[-1] in good_ends or w[-1] >= 128)
    return {
        "log_bytes": math.log(1 + n), "log_words": math.log(1 + len(words)), "word_bytes": n / m,
        "upper": share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digit": share(b"0123456789"), "space": share(b" \t\n\r"),
        "symbol": share(b"#$%&*+<=>@[]^_`{|}~/\\"), "mark": share(b"!\"'(),-.:;?"), "beyond": share(range(128, 256)),
        "lines": len(lines) / m, "line_repeats": 1 - len(set(lines)) / len(lines),
        "word_repeats": 1 - len(set(words)) / m if words else 0.0, "odd_ends": odd / m,
        "short_words": sum(len(w) <= 2 for w in words) / m, "long_words": sum(len(w) > 20 for w in words) / m,
        "top_word": max(map(words.count, set(words)), default=0) / m,
    }


def test_scores_of_all_rows_by_plain_rules(spark, sf):
    """Statistics, rules and the logistic sum once more in plain Python, over every row of the table."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 20000")
    odd = [(90_001, None), (90_002, ""), (90_003, "¿Qué?? a!! b) c> ~ \n\n x\x0by"), (90_003, "the same id"), (None, "no id 12")]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id bigint, text string"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores, ensemble = quality.score_documents(docs, labels, F.lit(True))
    assert len(ensemble.rules) > 3
    expected = []
    for doc, text in docs.collect():
        numbers = plain_statistics(text)
        total = ensemble.intercept
        for rule, weight in ensemble.rules:
            if all(numbers[name] > bound if above else numbers[name] <= bound for name, above, bound in rule):
                total += weight
        expected.append((-1 if doc is None else doc, 1 / (1 + math.exp(-total))))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in scores.collect())
    assert [g[0] for g in got] == [e[0] for e in sorted(expected)]
    assert [g[1] for g in got] == pytest.approx([e[1] for e in sorted(expected)], abs=1e-9)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op8_quality(spark, folder).collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    held = [x for x in labels if zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    assert all(rows[x.doc_id].held_out for x in held)
    assert sum(rows[x.doc_id].predicted == x.quality for x in held) >= 0.95 * len(held)


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([(1, 1), (2, 1), (3, None), (4, 7)], 1.0), ([(1, 0)], 0.0)])
def test_labels_of_one_kind(spark, labels, score):
    docs = spark.createDataFrame([(1, "a b", 9.0), (2, None, None), (2, "a", 1.0), (None, "x", 2.0)], "doc_id bigint, text string, label double")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int")
    rows, _ = quality.score_documents(docs, known, F.lit(True))
    assert [r.score for r in rows.collect()] == pytest.approx([score] * 4, abs=1e-5)


def test_sample_bound_and_empty_table(spark):
    rng = random.Random(2)
    docs = [(i, "word " * rng.randint(5, 40) if i % 2 else "$$ " * rng.randint(5, 40)) for i in range(400)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, quality int")
    rows, ensemble = quality.score_documents(table, labels, F.lit(True), sample_rows=200)
    assert ensemble.rules and all((r.score > 0.5) == bool(r.doc_id % 2) for r in rows.collect())
    empty, _ = quality.score_documents(table.limit(0), labels, F.lit(True))
    assert empty.count() == 0
