import hashlib
import random
import re

import pytest
from strandlake.llm import secret_scan as scan
from strandlake.llm.queries import op6_secret_scan

BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]


def plain_base(text):
    found = [
        (m.start(), i, f"{kind}:{m.start()}:{m.end()}")
        for i, (kind, pattern, group, least) in enumerate(BASE) for m in pattern.finditer(text or "") if len(m[group]) >= least
    ]
    return [f[2] for f in sorted(found)]


def test_derived_queries():
    assert scan.trigram_query(r"(?i)(Token|api_?key)\x20*=") == [
        ["_ke", "api", "i_k", "key", "pi_"], ["api", "ike", "key", "pik"], ["ken", "oke", "tok"]
    ]
    assert scan.trigram_query("AKIA[A-Z0-9]+") == [["aki", "kia"]]
    assert scan.trigram_query("[0-9a-f]{32,}") == scan.trigram_query("(abcd)?x*") == scan.trigram_query("ab|xyz") == []
    assert scan.trigram_query("(abc.*)+(def|ghi)") == [["abc", "def"], ["abc", "ghi"]]
    with pytest.raises(ValueError):
        scan.trigram_query("(?s)abc")


def test_spans(spark, tmp_path):
    rng = random.Random(3)
    parts = ["password", "PassWd", "secret", "token", "api_key", "ApiKey", '"', "'", " ", "=", ":", "AKIA", "ABCDEFGH1234", "é", "😀",
             "0123456789abcdef", "deadbeef", "short", "value_long.er=", "\n", "x", "ghp_" + "a1" * 18, "-----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890ab"]
    docs = [(i, "".join(rng.choices(parts, k=rng.randint(0, 30))), "clash") for i in range(300)]
    docs += [(300, None, None), (301, "", None), (5, docs[5][1], "again"), (5, "token: other-text-1", None), (None, "secret=abcdefgh", None),
             (302, "token=abcd1234 " * 20_000, None), (303, "token:secret: abcdefghij", None), (304, "AKIA" * 5, None)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(docs, "doc_id bigint, text string, low string").write.parquet(path)
    rows = op6_secret_scan(spark, str(tmp_path)).collect()
    expected = []
    for doc, text, _ in docs:
        base = plain_base(text)
        count = [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]
        expected.append((doc, *count, hashlib.sha256(",".join(base).encode()).hexdigest()))
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)[:5]) for r in rows)
    text = {(d, t): None for d, t, _ in docs}
    assert len(text) == len(docs) - 1
    assert any("forge:" in r.spans for r in rows) and any("private:" in r.spans for r in rows) and any("chat:" in r.spans for r in rows)


def test_empty_table_and_other_rules(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert scan.find_secrets(empty).count() == 0
    docs = spark.createDataFrame([(1, "abc 12"), (2, "xabcx")], "doc_id bigint, text string")
    for rules in ((scan.Rule("only", "abc"),), (scan.Rule("only", "[0-9]+"),)):
        rows = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in scan.find_secrets(docs, rules).collect()}
        assert rows == ({1: [(0, 3)], 2: [(1, 4)]} if rules[0].pattern == "abc" else {1: [(4, 6)], 2: []})
