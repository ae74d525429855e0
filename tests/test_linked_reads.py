"""Barcodes, incidence, truth classes and clusters, up to a simulated diploid sample."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plain import random_dna, reverse_complement, sampled
from strandlake import LINKED_READ_SPEC
from strandlake.operators import barcodes, cluster, incidence, ranks, skew, truth
from strandlake.operators.sketch import sketch


def test_whitelist_precedence(spark):
    near = "ACGTACGTACGTACGA"
    white = spark.createDataFrame([(1, "ACGTACGTACGTACGT"), (2, near)], "line_no bigint, barcode string")
    reads = spark.createDataFrame(
        [("ACGTACGTACGTACGTTT",), ("ACGTACGTACGTACGCTT",), ("NCGTACGTACGTACGA",), ("TTTTTTTTTTTTTTTT",)], "seq1 string")
    exact = barcodes.whitelist_variants(white)
    latest = barcodes.whitelist_variants(white, exact_first=False)
    fixed = {r["seq1"]: (r["barcode"], r["fix_pos"]) for r in barcodes.correct_barcodes(reads, exact).collect()}
    assert fixed["ACGTACGTACGTACGTTT"] == ("ACGTACGTACGTACGT", None)
    assert fixed["ACGTACGTACGTACGCTT"] == (near, 15)
    assert fixed["NCGTACGTACGTACGA"] == (near, None)
    assert len(fixed) == 3
    rewritten = {r["seq1"]: r["barcode"] for r in barcodes.correct_barcodes(reads, latest).collect()}
    assert rewritten["ACGTACGTACGTACGTTT"] == near
    counts = barcodes.correction_counts(reads, exact).head()
    assert (counts["n_written"], counts["n_dropped"], counts["n_fixed"], counts["fixed_15"]) == (3, 1, 1, 1)


def test_variants_of_a_whitelist_are_not_broadcast(spark, sf):
    from strandlake.plans.workloads import QUERIES

    for name in ("corrected_barcodes", "corrected_barcodes_latest", "barcode_correction_counts"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
        depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
        at = next(i for i, line in enumerate(plan) if "explode([A,C,G,T])" in line)
        while "Join" not in plan[at]:
            assert "BroadcastExchange" not in plan[at]
            at = max(i for i in range(at) if depth[i] < depth[at])


def test_a_barcode_of_many_reads_is_cut(spark):
    white = spark.createDataFrame([(1, "A" * 16), (2, "C" * 16)], "line_no long, barcode string")
    reads = spark.range(30_000).select("id", F.when(F.col("id") % 100 > 0, "A" * 16).otherwise("C" * 15 + "G").alias("seq1"))
    fixed = barcodes.correct_barcodes(reads, barcodes.whitelist_variants(white))
    assert fixed.columns == ["id", "seq1", "barcode", "fix_pos"]
    counts = {(r["barcode"], r["fix_pos"]): (r["n"], r["ids"]) for r in fixed.groupBy("barcode", "fix_pos").agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("ids")).collect()}
    assert counts == {("A" * 16, None): (29_700, 29_700), ("C" * 16, 15): (300, 300)}


def test_pairing_needs_every_second_mate(spark):
    schema = "seq_id bigint, name string, seq string, qual string"
    one = spark.createDataFrame([(1, "a", "A", "I"), (2, "b", "C", "I")], schema)
    two = spark.createDataFrame([(1, "a", "G", "I"), (2, "x", "T", "I")], schema)
    rows = barcodes.pair_reads(one, two).orderBy("seq_id").collect()
    assert [(r["seq2"], r["names_differ"]) for r in rows] == [("G", False), ("T", True)]
    with pytest.raises(Exception, match="ended early"):
        barcodes.pair_reads(one, two.where("seq_id = 1")).collect()


def test_depth_is_the_length_of_the_inverse_list(spark, sf):
    from strandlake.plans.inputs import order_incidence

    inc = order_incidence(spark, sf)
    lists = cluster.carriers(inc, [(0, 1 << 40)])
    assert lists.where(F.size("members") != F.col("depth")).count() == 0
    assert lists.count() == incidence.hash_depths(inc).count()


def test_pairs_of_a_task_are_bounded(spark, monkeypatch):
    rng = random.Random(11)
    carried = {b: rng.sample(range(40), 12) for b in range(60)}
    inc = spark.createDataFrame([(b, h, 1) for b, hashes in carried.items() for h in hashes], "barcode long, hash long, read long")
    depths = incidence.hash_depths(inc)
    expected = Counter((x, h) for hashes in carried.values() for x in hashes for h in hashes if x != h)
    monkeypatch.setattr(incidence, "PAIRS", 300)
    near = incidence._near(inc, depths, depths.select(F.col("hash").alias("x")))
    assert near.rdd.getNumPartitions() == 60 * 12 * 12 // 300 + 1
    assert {(r["x"], r["hash"]): r["share"] for r in near.collect()} == expected


def test_share_histogram_of_barcodes_of_all_sizes(spark):
    rng = random.Random(14)
    members = {b: rng.sample(range(60), rng.choice([2, 4, 8, 20, 40])) for b in range(14)}
    members[14] = list(range(60))
    members[15] = list(range(0, 60, 2))
    inc = spark.createDataFrame([(b, h) for b, hs in members.items() for h in hs], "barcode bigint, hash bigint")
    ranged = spark.createDataFrame([(h,) for h in range(60) if h % 3], "hash bigint")
    targets = spark.createDataFrame([(h,) for h in range(60) if h % 4], "x bigint")
    carried = {h: {b for b, hs in members.items() if h in hs} for h in range(60)}
    want = Counter()
    for x in range(60):
        for y in range(60):
            share = len(carried[x] & carried[y])
            if x % 4 and y % 3 and x != y and share:
                want[x, share] += 1
    got = {(r["x"], r["share"]): r["n"] for r in incidence.share_histogram(inc, ranged, targets).collect()}
    assert got == want
    near = incidence.neighbours(inc, ranged, targets)
    assert {(r["x"], r["share"]): r["n"] for r in incidence.share_counts(near).collect()} == want


def test_ranges_can_be_united(spark):
    depths = spark.createDataFrame([(i, i) for i in range(10)], "hash bigint, depth bigint")
    got = incidence.in_range(depths, [(1, 3), (5, 6)]).orderBy("hash").collect()
    assert [r["hash"] for r in got] == [1, 2, 5]
    with pytest.raises(ValueError):
        incidence.in_range(depths, [])


def test_global_rank_and_running_sum(spark):
    rng = random.Random(8)
    rows = [(rng.choice([7, 7, 7, rng.randrange(10**9)]), i * 3) for i in range(500)]
    df = spark.createDataFrame(rows, "k bigint, t bigint")
    got = {(r["k"], r["t"]): r["rank"] for r in ranks.global_rank(df, "k", "t", "rank").collect()}
    assert got == {row: i for i, row in enumerate(sorted(rows), start=1)}


def test_ranks_with_an_outlier_and_a_key_of_half_the_rows(spark):
    rows = [(5, i) for i in range(2000)] + [(rng, -1) for rng in range(10, 1900)] + [(10**17, 3), (-(10**17), 4)]
    df = spark.createDataFrame(rows, "k bigint, t bigint").repartition(7)
    ranked = ranks.global_rank(df, "k", "t", "rank")
    got = {(r["k"], r["t"]): r["rank"] for r in ranked.collect()}
    assert got == {row: i for i, row in enumerate(sorted(rows), start=1)}
    # ranges follow the rows: half of them stand under one key, and are cut
    sizes = [r["count"] for r in ranks._dealt(df, ["k", "t"]).groupBy("_part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.5 * len(rows) / 4


def test_grouped_rank_and_running_sum(spark):
    rng = random.Random(11)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.randrange(50), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g bigint, o bigint, t bigint")
    got = {r["t"]: r["number"] for r in ranks.grouped_rank(df, ["g"], ["o", "t"], "number").collect()}
    for group in (None, 1, 2, 3):
        mine = sorted((o, t) for g, o, t in rows if g == group)
        assert [got[t] for _, t in mine] == list(range(1, len(mine) + 1))
    sums = {r["t"]: r["before"] for r in ranks.running_sum(df, "t", "o", "before").collect()}
    assert sums == {t: sum(o for _, o, u in rows if u < t) for _, _, t in rows}


def test_hot_keys_are_cut_and_copied(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0)], "k bigint, a bigint")
    right = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 7), (3, 8)], "k bigint, b bigint")
    hot = skew.hot_keys(right, "k", rows=10)
    assert [tuple(r) for r in hot.collect()] == [(1, 10)]
    cut = skew.cut(right, hot, "k", "b")
    met = skew.copied(left, hot, "k").join(cut, ["k", "_part"]).select("k", "a", "b").collect()
    assert sorted(map(tuple, met)) == sorted([(1, a, b) for a in range(50) for b in range(100)] + [(2, 0, 7)])
    assert max(r["count"] for r in cut.groupBy("k", "_part").count().collect()) < 30


def plain_clusters(inc, low, high, threshold, start):
    """Straight loops over dictionaries: labels and shares of the good hashes of every barcode."""
    carried = defaultdict(list)
    for b, h, _ in inc:
        carried[h].append(b)
    out = {}
    for barcode in {b for b, _, _ in inc}:
        good = sorted((len(carried[h]), h, r) for b, h, r in inc if b == barcode and low <= len(carried[h]) < high)
        first, label, founder, share = {}, [0] * len(good), [None], [0.0] * len(good)
        for i, (_, h, _) in enumerate(good):
            if i < start:
                continue
            tally = Counter()
            for c in carried[h]:
                if c != barcode and first.setdefault(c, i) < i:
                    tally[first[c]] += 1
            if not tally or max(tally.values()) < threshold:
                continue
            best = min(j for j in tally if tally[j] == max(tally.values()))
            if not label[best]:
                label[best] = len(founder)
                founder.append(best)
            label[i] = label[best]
            share[i] = tally[founder[label[i]]] / sum(tally.values())
        parts = [{c} for c in range(1, len(founder))]
        for read in {r for _, _, r in good}:
            touched = {label[i] for i, g in enumerate(good) if g[2] == read and label[i]}
            if touched:
                hit = [p for p in parts if p & touched]
                parts = [p for p in parts if not p & touched] + [set().union(*hit)]
        number = {c: k for k, p in enumerate(sorted(parts, key=min), start=1) for c in p}
        for i, (_, h, _) in enumerate(good):
            out[barcode, h] = (i, label[i], number.get(label[i], 0), round(share[i], 9))
    return out


@pytest.mark.parametrize("start, pairs, at_once", [(0, 4_000_000, 1_000_000), (1, 50, 1), (0, 200, 300)])
def test_clusters_match_plain_loops(spark, start, pairs, at_once, monkeypatch):
    """Whole, or every barcode cut into parts; one group of rows at a time, or many."""
    monkeypatch.setattr(cluster, "PAIRS", pairs)
    monkeypatch.setattr(cluster, "_PAIRS_AT_ONCE", at_once)
    rng = random.Random(9)
    rows = sorted({(b, h): rng.randrange(12) for b in range(30) for h in rng.sample(range(60), 25)}.items())
    inc = [(b, h, r) for (b, h), r in rows]
    df = spark.createDataFrame(inc, "barcode bigint, hash bigint, read bigint")
    labels = cluster.cluster_hashes(df, [(5, 16)], threshold=4, start=start)
    got = {(r["barcode"], r["hash"]): (r["i"], r["raw"], r["sub"], round(r["share"], 9)) for r in labels.collect()}
    want = plain_clusters(inc, 5, 16, 4, start)
    assert got == want and any(v[2] for v in want.values())
    some = cluster.cluster_hashes(df, [(5, 16)], threshold=4, start=start, codes=(3, 9)).collect()
    assert {r["barcode"] for r in some} == set(range(3, 9))


def test_more_clusters_than_a_byte_counts(spark):
    inc = [(0, 10 * k + h, k) for k in range(300) for h in range(4)]
    inc += [(1 + 6 * k + b, 10 * k + h, h) for k in range(300) for b in range(6) for h in range(4)]
    df = spark.createDataFrame(inc, "barcode bigint, hash bigint, read bigint")
    labels = cluster.cluster_hashes(df, [(2, 50)], start=0, codes=(0, 1)).collect()
    assert {r["raw"] for r in labels} == {r["sub"] for r in labels} == set(range(1, 301))


@pytest.fixture(scope="module")
def diploid(spark):
    """Two haplotypes with single-base differences and a duplicated stretch, read as barcoded pairs."""
    rng = random.Random(10)
    hap_a = random_dna(rng, 60_000)
    hap_a += hap_a[3000:4000]
    hap_b = list(hap_a)
    for p in range(len(hap_b)):
        if rng.random() < 0.01:
            hap_b[p] = rng.choice([c for c in "ACGT" if c != hap_b[p]])
    hap_b = "".join(hap_b)
    pairs, molecule_of, apart = [], {}, set()
    read = 0
    for barcode in range(60):
        begins = [rng.randrange(0, len(hap_a) - 5000) for _ in range(3)]
        if all(abs(a - b) > 5000 for k, a in enumerate(begins) for b in begins[:k]):
            apart.add(barcode)
        for m in range(3):
            hap = rng.choice([hap_a, hap_b])
            begin = begins[m]
            for _ in range(60):
                at = begin + rng.randrange(0, 5000 - 400)
                seq1 = "A" * 23 + hap[at:at + 128]
                seq2 = reverse_complement(hap[at + 250:at + 401])
                pairs.append((barcode, read, seq1, seq2))
                molecule_of[read] = (barcode, m)
                read += 1
    df = spark.createDataFrame(pairs, "barcode bigint, read bigint, seq1 string, seq2 string")
    return hap_a, hap_b, df, pairs, molecule_of, apart


def test_diploid_truth_and_clusters(spark, diploid):
    hap_a, hap_b, df, pairs, molecule_of, apart = diploid
    spec = LINKED_READ_SPEC
    inc = incidence.build_incidence(incidence.linked_read_hits(df, spec)).cache()
    want = set()
    for barcode, _, seq1, seq2 in [p for p in pairs if p[0] < 6]:
        want |= {(barcode, h) for _, h, _ in sampled(seq1[23:], 21, 31) + sampled(seq2, 21, 31)}
    assert {(r["barcode"], r["hash"]) for r in inc.where("barcode < 6").collect()} == want

    genomes = spark.createDataFrame([(1, hap_a), (2, hap_b)], "g int, seq string")
    hits = [
        sketch(genomes.where(f"g = {g}"), [F.lit(1).alias("chr")], "seq", spec).select("hash", "chr", "pos")
        for g in (1, 2)
    ]
    crib = truth.build_crib(incidence.hash_depths(inc), *hits)
    seen_a = Counter(h for _, h, _ in sampled(hap_a, 21, 31))
    seen_b = Counter(h for _, h, _ in sampled(hap_b, 21, 31))
    for row in crib.collect():
        a, b = seen_a[row["hash"]], seen_b[row["hash"]]
        kind = ("err" if not a and not b else "hom" if (a, b) == (1, 1)
                else "mul" if max(a, b) > 1 else "htA" if a else "htB")
        assert row["type"] == kind
    assert {r["type"] for r in crib.collect()} >= {"hom", "htA", "htB", "mul"}

    labels = cluster.cluster_hashes(inc, [(4, 25)], threshold=3)
    by_cluster = defaultdict(Counter)
    for r in labels.where("sub > 0").collect():
        by_cluster[r["barcode"], r["sub"]][molecule_of[r["read"]]] += 1
    total = sum(sum(c.values()) for c in by_cluster.values())
    # molecules that lie apart on the genome must come apart
    clear = [c for (barcode, _), c in by_cluster.items() if barcode in apart]
    right = sum(c.most_common(1)[0][1] for c in clear)
    assert len(apart) > 10 and right / sum(sum(c.values()) for c in clear) > 0.9
    report = cluster.cluster_report(labels, crib)
    assert report.agg(F.sum("n_hash")).head()[0] == total

    rows, codes = cluster.split_codes(inc, incidence.code_table(inc), labels)
    assert rows.count() == inc.count()
    assert codes.agg(F.sum("n_hash")).head()[0] == inc.count()
    moved = codes.where("parent is not null").agg(F.sum("n_hash")).head()[0]
    assert moved == total
    inc.unpersist()


def test_lists_of_barcodes_are_packed_and_unpacked():
    import pyarrow as pa

    lists = [[1, 2, 500], [], [0], [-(1 << 63), -1, 0, (1 << 63) - 1], [127, 128, 16_384 + 128, 1 << 40], []]
    for some in (lists, lists[:0], [[]], lists[2:]):
        assert cluster._unpacked(cluster._packed(pa.array(some, pa.list_(pa.int64())))).to_pylist() == some
    packed = cluster._packed(pa.array(lists, pa.list_(pa.int64())))
    assert cluster._unpacked(packed[1:4]).to_pylist() == lists[1:4]
    assert cluster._unpacked(cluster._packed(pa.array(lists, pa.list_(pa.int64()))[2:5])).to_pylist() == lists[2:5]
    assert cluster._unpacked(pa.array([None, packed[0].as_py()], pa.binary())).to_pylist() == [[], lists[0]]
    assert len(packed[0].as_py()) == 4


def test_lists_of_barcodes_travel_once(spark, sf):
    from strandlake.plans.inputs import supplier_incidence

    good = cluster.good_hashes(supplier_incidence(spark, sf), [(2, 10_000)])
    dealt = []
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(cluster, "cut_lineage", lambda df: dealt.append(df) or df)
            cluster._joined(good, good, 1, 5)
        plan = dealt[0]._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set(threshold, before)
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    at = next(i for i, line in enumerate(plan) if "collect_list(barcode" in line)
    while "Join" not in plan[at]:
        at = max(i for i in range(at) if depth[i] < depth[at])
    above = []
    while depth[at]:
        at = max(i for i in range(at) if depth[i] < depth[at])
        above.append(plan[at])
    assert sum(" Exchange " in line or "+- Exchange" in line for line in above) == 1


def test_pairs_are_sorted_as_one_number_where_they_fit(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    group = np.sort(rng.integers(5, 60, 5_000))
    other = rng.integers(-40, 200, 5_000)
    wide = np.where(other > 100, other + (1 << 61), other)
    for numbers in (other, wide, other[:0]):
        own = group[:len(numbers)]
        expected = np.lexsort((numbers, own))
        order, new = cluster._by_group(own, numbers)
        pairs = list(zip(own[expected].tolist(), numbers[expected].tolist(), strict=True))
        assert order.tolist() == expected.tolist()
        assert new.tolist() == [k == 0 or pairs[k] != pairs[k - 1] for k in range(len(pairs))]
    monkeypatch.setattr(np, "lexsort", None)
    cluster._by_group(group, other)


def test_no_null_lists_are_sent_to_python(spark, sf, monkeypatch):
    from strandlake.plans.inputs import supplier_incidence

    good = cluster.good_hashes(supplier_incidence(spark, sf), [(2, 10_000)])
    sent = []
    send = type(good).mapInArrow
    monkeypatch.setattr(type(good), "mapInArrow", lambda df, *args: sent.append(df) or send(df, *args))
    monkeypatch.setattr(cluster, "cut_lineage", lambda df: df)
    cluster._joined(good, good, 1, 5)
    rows = sent[0].groupBy().agg(F.count("*"), F.count("others"), F.count("packed"), F.count_if(F.size("others") > 0)).head()
    assert rows[0] > 0 and rows[0] == rows[1] == rows[2] and rows[3] == 0


@pytest.mark.parametrize("start, pairs, most", [(0, 4_000_000, 8), (1, 150, 2)])
def test_lists_travel_to_a_slice_of_the_barcodes_at_a_time(spark, start, pairs, most, monkeypatch):
    """Also where some barcodes are cut and others whole, and where blocks and batches end anywhere."""
    monkeypatch.setattr(cluster, "PAIRS", pairs)
    monkeypatch.setattr(cluster, "SLICE_PAIRS", 900)
    monkeypatch.setattr(cluster, "SLICES", most)
    monkeypatch.setattr(cluster, "_PAIRS_AT_ONCE", 70)
    monkeypatch.setattr(cluster, "_BYTES_AT_ONCE", 500)
    monkeypatch.setattr(cluster, "ROWS", 40)
    rng = random.Random(12)
    rows = sorted({(b, h): rng.randrange(15) for b in range(40) for h in rng.sample(range(60), rng.choice((9, 22, 30)))}.items())
    inc = [(b, h, r) for (b, h), r in rows]
    df = spark.createDataFrame(inc, "barcode bigint, hash bigint, read bigint").cache()
    dealt = []
    deal = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda df, *by: dealt.append(df) or deal(df, *by))
    labels = cluster.cluster_hashes(df, [(5, 19)], threshold=4, start=start)
    slices = [d.select("barcode").collect() for d in dealt if d.columns == ["barcode", "depth", "hash", "read", "others"]]
    got = {(r["barcode"], r["hash"]): (r["i"], r["raw"], r["sub"], round(r["share"], 9)) for r in labels.collect()}
    want = plain_clusters(inc, 5, 19, 4, start)
    assert got == want and any(v[2] for v in want.values()) and labels.count() == len(want)
    assert 2 <= len(slices) <= cluster.SLICES
    mine = [{r["barcode"] for r in s} for s in slices]
    assert len(set().union(*mine)) == sum(map(len, mine)) and max(map(len, slices)) < 0.7 * sum(map(len, slices))
    assert sum(map(len, slices)) == len(want) if start == 0 else 0 < sum(map(len, slices)) < len(want)
    df.unpersist()


def test_null_reads_and_barcodes_are_the_same_in_whole_and_cut_barcodes(spark, monkeypatch):
    rng = random.Random(13)
    inc = [(b or None, h, rng.choice([None, None, *range(40)])) for b in range(30) for h in [*rng.sample(range(60), 25), None]]
    df = spark.createDataFrame(inc, "barcode bigint, hash bigint, read bigint").cache()
    found = []
    for pairs in (4_000_000, 1):
        monkeypatch.setattr(cluster, "PAIRS", pairs)
        labels = cluster.cluster_hashes(df, [(5, 16)], threshold=3)
        assert [f.dataType.simpleString() for f in labels.schema] == ["bigint"] * 4 + ["int"] * 3 + ["double"]
        found.append(Counter((r["barcode"], r["hash"], r["read"], r["i"], r["raw"], r["sub"], round(r["share"], 9)) for r in labels.collect()))
    assert found[0] == found[1] and max(k[4] for k in found[0]) > 1
    assert {k[4] for k in found[0] if k[0] is None} == {0}
    df.unpersist()


def test_clusters_are_united_over_chains_of_reads():
    import numpy as np

    n = 1000
    order = np.random.default_rng(5).permutation(n)
    # a read joins each cluster and the next of a random order, except every hundredth
    edges = [(order[k], k) for k in range(n)] + [(order[k + 1], k) for k in range(n - 1) if k % 100 < 99]
    cluster_of, read = np.array(edges).T
    low = cluster._united(cluster_of, read, n)
    assert all(set(low[order[at:at + 100]]) == {order[at:at + 100].min()} for at in range(0, n, 100))
    assert cluster._united(cluster_of[:0], read[:0], 3).tolist() == [0, 1, 2]


def written(spark, make):
    """What ``make`` returns, and the bytes of the checkpoints it wrote that are still there."""
    from pathlib import Path

    spark.range(1).checkpoint()
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    before = set(folder.glob("rdd-*"))
    made = make()
    return made, sum(p.stat().st_size for d in set(folder.glob("rdd-*")) - before for p in d.glob("part-*"))


def test_tables_of_the_size_of_the_input_are_written_as_blocks(spark):
    from strandlake.session import cut_lineage, cut_lineage_packed

    n = 200_000
    df = spark.range(0, n, 1, 2).select(
        F.floor(F.col("id") / 600).alias("barcode"), F.when(F.col("id") % 7 > 0, F.pmod(F.xxhash64("id"), F.lit(20_000))).alias("hash"),
        F.lit(0.5).alias("share"), F.col("id").cast("string").alias("name"), (F.col("id") % 3).cast("int").alias("i"),
    )
    kept = cut_lineage_packed(df)
    assert kept.schema.simpleString() == df.schema.simpleString()
    assert kept.exceptAll(df).isEmpty() and kept.count() == n
    numbers = df.select("barcode", "hash")
    assert written(spark, lambda: cut_lineage_packed(numbers))[1] < 0.7 * written(spark, lambda: cut_lineage(numbers))[1]
    empty = cut_lineage_packed(df.where("i < 0"))
    assert empty.isEmpty() and empty.columns == df.columns


def test_split_rows_are_written_as_blocks(spark):
    from strandlake.session import cut_lineage

    inc = spark.range(0, 100_000, 1, 4).select(
        F.floor(F.col("id") / 500).alias("barcode"), (F.col("id") * 2654435761 % (1 << 22)).alias("hash"),
        F.pmod(F.xxhash64("id"), F.lit(50)).alias("read"),
    )
    labelled = inc.withColumn("sub", F.when(F.col("hash") % 20 < 3, F.col("hash") % 20).otherwise(0).cast("int"))
    labels = labelled.where("hash % 3 > 0").select("barcode", "hash", "sub")
    (rows, codes), size = written(spark, lambda: cluster.split_codes(inc, incidence.code_table(inc), labels))
    assert size < 0.8 * written(spark, lambda: cut_lineage(labelled))[1]

    moved, stay = defaultdict(list), Counter()
    reads = defaultdict(set)
    wanted = set()
    for b, h, r, sub in labelled.collect():
        reads[b].add(r)
        if h % 3 and sub:
            moved[b, sub].append((h, r))
        else:
            stay[b] += 1
            wanted.add((b, h, r))
    subs = {b: max([0, *(s for o, s in moved if o == b)]) for b in reads}
    base = {b: max(reads) + sum(subs[o] for o in reads if o < b) for b in reads}
    made = {(b, len(reads[b]), stay[b], None) for b in reads}
    for (b, sub), some in moved.items():
        number = {}
        for h, r in sorted(some):
            wanted.add((base[b] + sub, h, number.setdefault(r, len(number))))
        made.add((base[b] + sub, len(number), len(some), b))
    assert {tuple(r) for r in rows.select("barcode", "hash", "read").collect()} == wanted and rows.count() == len(wanted)
    assert {tuple(r) for r in codes.select("barcode", "n_read", "n_hash", "parent").collect()} == made and codes.count() == len(made)


def test_shuffle_files_are_given_up_when_rows_are_written(spark, monkeypatch):
    import time
    from pathlib import Path

    from strandlake import session

    folders = [Path(p) for p in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()]

    def shuffled():
        return {p for folder in folders for p in folder.rglob("shuffle_*.data")}

    before = shuffled()
    made = []
    keep = session.cut_lineage
    # as the job ends, before its shuffle is given up
    monkeypatch.setattr(session, "cut_lineage", lambda df: (keep(df), made.extend(shuffled() - before))[0])
    df = spark.range(100_000).select("id", (F.col("id") % 1000).alias("k"))
    kept = session.cut_lineage_packed(df.repartition("k"))
    until = time.time() + 20
    while set(made) & shuffled() and time.time() < until:
        session.give_up(spark, time.monotonic())
        time.sleep(0.5)
    assert made and not set(made) & shuffled() and kept.count() == 100_000
