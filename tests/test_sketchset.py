import pytest
from pyspark.sql import functions as F

from strandlake import HashSpec, SKETCH_SPEC
from strandlake.operators import histogram, sketchset


def make(spark, rows):
    return spark.createDataFrame(rows, "hash bigint, depth int, copy tinyint")


def table(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


@pytest.fixture(scope="module")
def sets(spark):
    one = make(spark, [(1, 5, 1), (2, 65000, 2), (3, 1, 0)])
    two = make(spark, [(1, 7, 1), (2, 1000, 2), (4, 2, 3)])
    return one, two


def test_merge_modes(sets):
    assert table(sketchset.merge(*sets)) == [(1, 12, 2), (2, 66000, 3), (3, 1, 0), (4, 2, 3)]
    assert table(sketchset.merge(*sets, copy_mode="compat"))[0] == (1, 12, 3)
    assert table(sketchset.merge(*sets)) == table(sketchset.merge(*reversed(sets)))
    assert table(sketchset.merge_all(list(sets))) == table(sketchset.merge(*sets))


def test_merge_refuses_other_settings(sets):
    with pytest.raises(ValueError):
        sketchset.merge(*sets, specs=(SKETCH_SPEC, HashSpec(k=21)))


def test_counts_have_no_upper_bound(spark):
    hits = spark.range(70000).select(F.lit(7).cast("bigint").alias("hash"))
    assert table(sketchset.count_hits(hits), "hash", "depth") == [(7, 70000)]


def test_prune_is_half_open_and_idempotent(sets):
    kept = sketchset.prune(sets[0], 1, 5)
    assert table(kept, "hash") == [(3,)]
    assert table(sketchset.prune(kept, 1, 5)) == table(kept)
    assert table(sketchset.prune(sets[0], 2, 0), "hash") == [(1,), (2,)]


def test_copy_classes(spark):
    base = make(spark, [(i, d, 0) for i, d in enumerate((1, 9, 10, 49, 50, 99, 100, 500))])
    classed = sketchset.set_copy(base, 10, 50, 100)
    assert [r["copy"] for r in classed.orderBy("hash").collect()] == [0, 0, 1, 1, 2, 2, 3, 3]
    multi = sketchset.set_copy_multi(classed, 50)
    assert [r["copy"] for r in multi.orderBy("hash").collect()] == [0, 0, 1, 1, 3, 3, 3, 3]


def test_depth_report(sets):
    report = sketchset.depth_report(sets[0], {"b": sets[1]}, hexadecimal=False)
    assert table(report, "hash", "copy", "depth", "depth_b") == [
        (1, 1, 5, 7), (2, 2, 65000, 1000), (3, 0, 1, 0)]


def test_set_summary(sets):
    row = sketchset.set_summary(sets[0]).head()
    assert (row["n_entries"], row["total_count"], row["n50_depth"], row["copy0"]) == (3, 65006, 65000, 1)


def test_histogram_summary(spark):
    hist = spark.createDataFrame([(0, 6), (1, 2), (4, 2)], "bin bigint, n bigint")
    plain = histogram.summary(hist).head()
    assert (plain["mode"], plain["median"], plain["percent99"], plain["n50"]) == (0, 0, 4, 4)
    assert histogram.summary(hist, skip_zero_bin=True).head()["median"] == 1
    assert table(histogram.dense(hist)) == [(0, 6), (1, 2), (2, 0), (3, 0), (4, 2)]


def test_add_is_union(spark):
    rows = [("ACGTTGCAACGGTATCGATCGATTACGATC" * 8,), ("GATTACA" * 30,), ("C" * 90,)]
    seqs = spark.createDataFrame(rows, "seq string")
    spec = HashSpec(k=7, w=2)
    whole = sketchset.count_sequences(seqs.union(seqs), spec=spec)
    one = sketchset.count_sequences(seqs, spec=spec)
    assert table(sketchset.merge(one, one)) == table(whole)
