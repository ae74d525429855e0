import random

import pytest
import xxhash
from strandlake.llm import simhash
from strandlake.llm.components import components


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    known = sorted(parent)
    for i, a in enumerate(known):
        for b in known[:i]:
            if bin(a ^ b).count("1") <= 2:
                parent[root(a)] = root(b)
    low = {}
    for i, p in zip(ids, prints, strict=True):
        low[root(p)] = min(i, low.get(root(p), i))
    return [low[root(p)] for p in prints]


def test_texts(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [
        None, "", " \n\t", "One", "one two", "ONE two three", base, base.upper(), base.replace("w399", "x"),
        base.replace("w200", "y"), "é È w x y", base, "long " * 30_000, "a\x0bb\x0cc\x1cd e",
    ]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, "One", None), (None, "no id here", None)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, fp string")).collect()
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    expected = {
        (i, f"{p:016x}", c)
        for i, p, c in zip([r[0] for r in rows], prints, plain_components([99 if r[0] is None else r[0] for r in rows], prints), strict=True)
    }
    assert len(found) == len(rows)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in found if r.doc_id is not None} == {
        e for e in expected if e[0] is not None
    }
    assert [r.component_id for r in found if r.doc_id is None] == [None]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_links_of_crowded_fingerprints(spark, seed):
    rng = random.Random(seed)
    prints = set()
    for _ in range(15):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([2, 30, 150])):
            p = centre
            for _ in range(rng.randint(0, 4)):
                p ^= 1 << rng.randrange(64 if rng.random() < 0.5 else 6)
            prints.add(p)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp bigint"))
    root = {r.node: r.root for r in components(links).collect()}
    groups = [root.get(p, p) for p in signed]
    expected = plain_components(prints, prints)
    assert len(set(groups)) == len(set(expected)) == len(set(zip(groups, expected, strict=True)))


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 300)] + [(299, 400), (5, 5)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 300)}, 400: 100}


def test_drop_keeps_one_of_each(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base, "x"), (2, base + " ", "y"), (9, "quite another text", None), (11, None, None), (10, "", None)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 9, 10]
    assert kept.columns == ["doc_id", "text", "lang"]


def test_drop_tells_rows_of_one_id_apart(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(1, base), (2, base + " "), (2, "a clean text of the same id"), (None, base + "\n"), (None, "clean without an id"),
            (7, "shared by two"), (7, "shared  by two"), (None, "only nulls here"), (None, "only  nulls here")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    found = sorted((str(r.doc_id), " ".join(r.text.split())) for r in kept)
    assert found == sorted([("1", base), ("2", "a clean text of the same id"), ("None", "clean without an id"),
                            ("7", "shared by two"), ("None", "only nulls here")])
