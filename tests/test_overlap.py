import random

import pytest
from plain import random_dna, reverse_complement
from strandlake import HashSpec
from strandlake.operators import overlap, sketchset

SPEC = HashSpec(k=13, w=5)


@pytest.fixture(scope="module")
def reads(spark):
    rng = random.Random(12)
    genome = random_dna(rng, 5000)
    rows = []
    for i in range(40):
        a = rng.randrange(0, 4200)
        seq = genome[a:a + rng.randrange(150, 800)]
        kind = rng.random()
        if kind < 0.15:  # a rearranged read
            mid = len(seq) // 2
            seq = seq[mid:] + seq[:mid]
        elif kind < 0.3:  # a repeat within the read
            seq = seq + seq[:100]
        elif kind < 0.4:  # an inverted half
            mid = len(seq) // 2
            seq = seq[:mid] + reverse_complement(seq[mid:])
        rows.append((i, seq if rng.random() < 0.5 else reverse_complement(seq)))
    rows += [(40, random_dna(rng, 60)), (41, "ACG"), (42, genome[:700]), (43, genome[100:600])]
    return spark.createDataFrame(rows, "read_id bigint, seq string")


@pytest.fixture(scope="module")
def readset(spark, reads):
    chosen = sketchset.set_copy(sketchset.count_sequences(reads, spec=SPEC), 2, 12, 20).cache()
    every = overlap.read_hits(reads, chosen, SPEC).cache()
    hits = overlap.known_hits(every)
    table = overlap.read_table(reads, every).cache()
    pairs = overlap.overlaps(hits).cache()
    return table, hits, pairs


def plain_overlaps(hits):
    """Pairwise overlaps by nested loops over dictionaries."""
    by_read = {}
    for r in sorted(hits, key=lambda r: (r["read_id"], r["ord"])):
        if r["copy"] == 1:
            by_read.setdefault(r["read_id"], []).append(r)
    out = {}
    for x, x_hits in by_read.items():
        first = {}
        for r in x_hits:
            first.setdefault(r["hash"], r)
        for y, y_hits in by_read.items():
            shared = [(first[r["hash"]], r) for r in y_hits if r["hash"] in first]
            if len(shared) < 3:
                continue
            same = [a["is_fwd"] == b["is_fwd"] for a, b in shared]
            ords = [a["ord"] for a, _ in shared]
            steps = [q - p for p, q in zip(ords, ords[1:])]
            if all(same):
                z = [a["pos"] - b["pos"] for a, b in shared]
                wrong = sum(s < 0 for s in steps)
                out[x, y] = (len(shared), len(shared) - wrong, 0, int(sum(z) / len(z)), True, wrong > 0)
            elif not any(same):
                z = [a["pos"] + b["pos"] for a, b in shared]
                wrong = sum(s > 0 for s in steps)
                out[x, y] = (len(shared), 0, len(shared) - wrong, int(sum(z) / len(z)), False, wrong > 0)
            else:
                out[x, y] = (len(shared), sum(same), len(same) - sum(same), 0, False, True)
    return out


def plain_flags(table, repeats, pairs):
    """Visit reads in id order, three times, keeping a set of flags for each."""
    flags = {r["read_id"]: set() for r in table}
    facts = {r["read_id"]: r for r in table}
    for flag, least in (("bad_order10", 10), ("bad_order1", 2), ("bad_order1", 1)):
        for x in sorted(flags):
            if repeats.get(x):
                flags[x].add("bad_repeat")
            seen = [bad for (a, y), bad in pairs.items() if a == x and not flags[y]]
            if not seen:
                flags[x].add("bad_no_match")
                if facts[x]["n_hit"] < 10:
                    flags[x].add("bad_low_hit")
                elif facts[x]["n_copy1"] < 10:
                    flags[x].add("bad_low_copy1")
            if sum(seen) >= least and (flag == "bad_order10" or "bad_order10" not in flags[x]):
                flags[x].add(flag)
    return flags


def test_overlaps_match_plain_loops(readset):
    _, hits, pairs = readset
    want = plain_overlaps(hits.collect())
    got = {
        (r["x"], r["y"]): (r["n_hit"], r["n_plus"], r["n_minus"], r["offset"], r["is_plus"], r["is_bad"])
        for r in pairs.collect()}
    assert got == want
    assert any(v[5] for v in want.values()) and any(not v[4] for v in want.values())


def test_wanted_restricts_the_first_read(spark, readset):
    _, hits, pairs = readset
    one = spark.createDataFrame([(3,)], "read_id bigint")
    assert sorted(map(tuple, overlap.overlaps(hits, one).collect())) == sorted(
        map(tuple, pairs.where("x = 3").collect()))


def test_flags_match_a_scan_in_order(readset):
    table, hits, pairs = readset
    flagged, counts = overlap.mark_bad_reads(table, hits, pairs)
    repeats = {r["read_id"]: r["n_repeat"] for r in overlap.repeat_counts(hits).collect()}
    want = plain_flags(table.collect(), repeats, {(r["x"], r["y"]): r["is_bad"] for r in pairs.collect()})
    got = {r["read_id"]: {f for f in overlap.FLAGS if r[f]} for r in flagged.collect()}
    assert got == want
    assert counts["single"] == 0 or any("bad_order1" in f for f in want.values())
    assert {"bad_repeat", "bad_no_match", "bad_low_hit"} <= set().union(*want.values())
    frozen, _ = overlap.mark_bad_reads(table, hits, pairs, mode="frozen")
    assert frozen.count() == len(want)
    with pytest.raises(ValueError):
        overlap.mark_bad_reads(table, hits, pairs, mode="other")


def test_containment(readset):
    table, hits, pairs = readset
    flagged = overlap.with_bad(table.withColumns({f: overlap.F.lit(False) for f in overlap.FLAGS}))
    contained = {r["read_id"]: r["contained_in"] for r in overlap.mark_contained(flagged, pairs).collect()}
    assert contained[43] is not None and contained[41] is None
    lens = {r["read_id"]: r["len"] for r in table.collect()}
    assert all(y is None or lens[y] >= lens[x] for x, y in contained.items())


def test_report_and_pairs(spark, readset):
    table, hits, pairs = readset
    report = overlap.read_report(table, hits, pairs).where("read_id = 41").head()
    assert (report["n_good"], report["n_bad"], report["n_repeat"]) == (0, 0, 0)
    listed = overlap.hit_pairs(hits, spark.createDataFrame([(42, 43)], "x bigint, y bigint")).collect()
    n = pairs.where("x = 42 and y = 43").head()["n_hit"]
    assert len(listed) >= n > 3


def test_documents_are_sketched_once(spark, sf, monkeypatch):
    from pyspark.sql import functions as F
    from strandlake.operators.sketch import sketch
    from strandlake.plans import inputs

    seen = []

    def counted(*args, **named):
        seen.append(args)
        return sketch(*args, **named)

    for module in (inputs, overlap, sketchset):
        monkeypatch.setattr(module, "sketch", counted)
    table, hits, chosen = inputs.readset(spark, sf)
    assert len(seen) == 1
    assert table.agg(F.sum("n_hit")).first()[0] == hits.count()
    assert chosen.count() == hits.select("hash").distinct().count()
