import hashlib

import pytest
from check import connect, rows_of
from strandlake.llm import exact_dedup
from strandlake.llm.oracles import ORACLES
from strandlake.llm.queries import QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = [
    (5, "Same", "a"), (9, "sAME", None), (2, "same", "b"), (3, None, None), (4, "", "c"), (6, "É", None), (7, "é", None),
    (8, "alone", None), (8, "alone", None), (None, "null id", None), (None, "NULL id", "d"), (None, "same", None),
    (10, "long " * 100_000, None), (11, "LONG " * 100_000, None), (1, "other text, id of its own", None),
]


def plain(docs):
    groups = {}
    for doc, text, *_ in docs:
        groups.setdefault((text or "").translate(LOWER), []).append(doc)
    out = []
    for doc, text, *_ in docs:
        key = (text or "").translate(LOWER)
        ids = [i for i in groups[key] if i is not None]
        keep = max(ids, default=None)
        out.append((doc, keep, len(groups[key]), doc == keep, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [6, 10, 25])
def test_every_row_has_its_group(spark, bits):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string, keep_id string")
    rows = exact_dedup.duplicates(docs, filter_bits=bits)
    assert sorted((tuple(r) for r in rows.collect()), key=repr) == plain(DOCS)


@pytest.mark.parametrize("bits", [6, 25])
def test_one_row_of_each_text_stays(spark, bits):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string, keep_id string")
    stay = exact_dedup.deduplicate(docs, filter_bits=bits)
    assert stay.columns == docs.columns
    rows = [tuple(r) for r in stay.collect()]
    assert sorted(r[0] for r in rows if r[0] is not None) == [1, 4, 6, 7, 8, 9, 11]
    assert len(rows) == 8 and len({(r[1] or "").translate(LOWER) for r in rows}) == 8


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert exact_dedup.duplicates(empty).count() == exact_dedup.deduplicate(empty).count() == 0


def test_query_against_sql(spark, sf):
    result = QUERIES["op9_exact_dedup"](spark, sf)
    cursor = connect(sf).execute(ORACLES["op9_exact_dedup"])
    assert rows_of(result.columns, [tuple(r) for r in result.collect()]) == rows_of(
        [d[0] for d in cursor.description], cursor.fetchall()
    )
