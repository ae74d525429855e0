import random

import pytest
from strandlake.llm import line_dedup


def plain_words(line):
    line = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
    for space in "\t\x0b\x0c\r":
        line = line.replace(space, " ")
    return [w for w in line.split(" ") if w]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_match(a, b):
    by_words = max(len(a), len(b)) >= 8 and abs(len(a) - len(b)) <= 1 and distance(a, b) <= 1
    one, other = " ".join(a), " ".join(b)
    return a == b or by_words or (min(len(a), len(b)) < 8 <= max(len(one), len(other)) and abs(len(one) - len(other)) <= 1 and distance(one, other) <= 1)


def plain(docs):
    """Kept line numbers of each document; ids are distinct."""
    lines = []
    for doc, text in sorted(docs, key=lambda d: d[0]):
        lines += [(doc, n, plain_words(line)) for n, line in enumerate((text or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    kept = {doc: [] for doc, _ in docs}
    for at, (doc, n, words) in enumerate(lines):
        if not any(plain_match(words, w) for _, _, w in lines[:at]):
            kept[doc].append(n)
    return kept


def found(spark, docs, **more):
    table = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, line string")
    return {r.doc_id: list(r.kept) for r in line_dedup.kept_lines(table, **more).collect()}


def test_cases(spark):
    ten = "one two three four five six seven eight nine ten"
    docs = [
        (5, ten + "\n\n  \n" + ten.upper() + "\nshort line\nshort  LINE\nshort lane"), (3, "intro\n" + ten.replace("five", "5")),
        (7, ten + " eleven"), (8, ten.replace("one ", "")), (9, "zero " + ten), (10, ten + " eleven twelve"), (11, None), (12, ""),
        (13, "a b c d e f g h i"), (14, "b c d e f g h i j"), (15, "a a a a a a a a a\na a a a a a a a\na a a a a a a"),
        (16, "word " * 5000 + "end"), (17, "word " * 5000 + "stop"), (18, "È é w x y z 1 2 3\nè é w x y z 1 2 3"),
    ]
    assert found(spark, docs) == plain(docs)


def test_short_lines_by_code_points(spark):
    seven = "one two three four five six seven"
    docs = [
        (1, "Page 2 of 10\nPage 3 of 10\nPage 10 of 10\npage of 10"), (2, "été\nétés\nete\nx\ny\nxy\nxyz\nseven ch\nseven c\nseven cx\nsevn cx"), (3, seven + "\n" + seven + " eight"),
        (4, "one two three four five six sevens\nonetwo three four five six seven"), (5, "a b c d e f g h\na b c d e f gh\na b c d e f g"),
        (6, "日本語の行\n日本語の列\n日本語行"),
    ]
    assert found(spark, docs) == plain(docs)
    assert found(spark, [(7, "z" * 50_000 + "\n" + "z" * 49_999 + "y\n" + "z" * 49_997 + "xyy")]) == {7: [0, 2]}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_short_lines(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab ") for _ in range(rng.randint(3, 16))) for _ in range(15)]
    docs = []
    for doc in range(50):
        lines = []
        for _ in range(rng.randint(0, 4)):
            line = list(rng.choice(base))
            at = rng.randrange(len(line))
            line[at:at + rng.randint(0, 1)] = rng.choices("ab ", k=rng.randint(0, 1))
            lines.append("".join(line))
        docs.append((doc, "\n".join(lines)))
    assert found(spark, docs) == plain(docs)


@pytest.mark.parametrize("bits", [7, 26])
def test_random_lines(spark, bits):
    rng = random.Random(4)
    base = [[rng.choice("abcde") for _ in range(rng.randint(6, 12))] for _ in range(12)]
    docs = []
    for doc in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            words = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(words))
                words[at:at + rng.randint(0, 1)] = rng.choices("abcde", k=rng.randint(0, 1))
            lines.append(" ".join(words))
        docs.append((doc, "\n".join(lines)))
    assert found(spark, docs, filter_bits=bits) == plain(docs)


def test_many_lines_that_differ_in_one_word(spark):
    docs = [(i, f"thank you for your visit to {i} and come back soon") for i in range(2000)]
    assert found(spark, docs) == {i: [0] if i == 0 else [] for i in range(2000)}


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "x y"), (1, "x y"), (1, "other\nx y"), (None, "x y\nnew")], "doc_id bigint, text string")
    rows = line_dedup.kept_lines(docs).collect()
    # of two texts of an id the one with the lower key comes first; its repeated row is the same document
    one, other = (next(r.text_key for r in rows if r.doc_id == 1 and n == sum(x.text_key == r.text_key for x in rows)) for n in (2, 1))
    assert all(list(r.kept) == ([0] if one < other else []) for r in rows if r.text_key == one)
    assert [list(r.kept) for r in rows if r.text_key == other] == [[0] if one < other else [0, 1]]
    assert [list(r.kept) for r in rows if r.doc_id is None] == [[1]]


def test_a_null_id_is_not_the_largest(spark):
    docs = spark.createDataFrame([(2**63 - 1, "a line\nanother one"), (None, "a line\nanother one")], "doc_id bigint, text string")
    kept = [(r.doc_id, list(r.kept)) for r in line_dedup.kept_lines(docs).collect()]
    assert sorted(len(k) for _, k in kept) == [0, 2]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert line_dedup.kept_lines(docs.limit(0)).count() == 0


def test_clean(spark):
    docs = spark.createDataFrame([(1, "a\n\nb\na", "k"), (2, "b\nc", "k"), (3, None, None)], "doc_id bigint, text string, lang string")
    rows = line_dedup.clean(docs)
    assert rows.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in rows.collect()) == [(1, "a\n\nb"), (2, "c"), (3, None)]


def test_within_one_edit():
    rng = random.Random(9)
    for _ in range(3000):
        a, b = (rng.choices("ab", k=rng.randint(0, 5)) for _ in range(2))
        assert line_dedup.within_one_edit(a, b) == (distance(a, b) <= 1)
