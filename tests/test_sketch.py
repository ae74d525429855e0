import random

import pyarrow as pa
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from plain import canonical, kmer_hash, random_dna, reverse_complement, sampled
from strandlake import HashSpec
from strandlake.functions import alphabet
from strandlake.functions.hashing import canonical_hash, encode_kmer
from strandlake.functions import sampling
from strandlake.functions.sampling import jump_minimizer_positions, minimizer_hits, sampled_hits
from strandlake.operators.sketch import minimizers, sketch, sketch_native, sketch_pieces

# Test vectors: k, k-mer, forward hash, reverse-strand hash.
VECTORS = [
    (19, "A" * 19, 0, 212585669055),
    (19, "C" * 19, 70861889685, 141723779370),
    (19, "ACGTACGTACGTACGTACG", 86228586361, 30918838439),
    (21, "GATTACAGATTACAGATTACA", 3386650630435, 3411234651200),
    (4, "ACGT", 184, 184),
    (31, "GATTACAGATTACAGATTACAGATTACAGAT", 2330108094023375721, 2441689731403878322),
]


def test_vectors(spark):
    for k, kmer, forward, reverse in VECTORS:
        assert (kmer_hash(kmer, k), kmer_hash(reverse_complement(kmer), k)) == (forward, reverse)
        row = spark.range(1).select(canonical_hash(F.lit(kmer), HashSpec(k=k)).alias("h")).head()["h"]
        assert (row["hash"], row["is_fwd"]) == (min(forward, reverse), forward < reverse)


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.one_of(st.none(), st.text("ACGTNacgtx", max_size=60)), max_size=6),
    st.integers(1, 31),
    st.integers(1, 5),
)
def test_sampled_hits_match_definition(seqs, k, w):
    found = sampled_hits(pa.array(seqs, pa.string()), HashSpec(k=k, w=w)).to_pylist()
    for seq, hits in zip(seqs, found):
        want = sampled(seq or "", k, w)
        assert [(h["pos"], h["hash"], h["is_fwd"]) for h in hits] == want
        assert [h["ord"] for h in hits] == list(range(len(want)))


def test_block_borders_and_slices():
    rng = random.Random(1)
    seqs = [random_dna(rng, n) for n in (150_000, 0, 18, 19, 140_001)]
    spec = HashSpec()
    array = pa.array(["TTTT"] + seqs).slice(1)
    for seq, hits in zip(seqs, sampled_hits(array, spec).to_pylist()):
        assert [(h["pos"], h["hash"], h["is_fwd"]) for h in hits] == sampled(seq, 19, 31)


@pytest.fixture(scope="module")
def reads(spark):
    rng = random.Random(2)
    rows = [(i, random_dna(rng, rng.randrange(0, 400))) for i in range(40)]
    rows += [(40, "A" * 60), (41, "T" * 60), (42, ""), (43, "ACGT" * 4), (44, "N" * 40)]
    return spark.createDataFrame(rows, "id bigint, seq string").repartition(3)


def triples(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_native_and_arrow_agree(reads):
    spec = HashSpec(k=11, w=3)
    columns = ("id", "pos", "hash", "is_fwd")
    fast = triples(sketch(reads, ["id"], "seq", spec), *columns)
    assert fast == triples(sketch_native(reads, ["id"], "seq", spec), *columns)
    assert fast == triples(sketch_pieces(reads, ["id"], "seq", spec, max_bases=37), *columns)
    assert (40, 0, 0, True) in fast and (41, 0, 0, False) in fast


def test_strand_symmetry(reads):
    spec = HashSpec(k=12, w=2)
    turned = reads.withColumn("seq", alphabet.reverse_complement(F.translate("seq", "N", "A")))
    one = {(r["id"], r["hash"]) for r in sketch(reads, ["id"], "seq", spec).collect()}
    two = {(r["id"], r["hash"]) for r in sketch(turned, ["id"], "seq", spec).collect()}
    assert one == two


def brute_minimizers(hashes, w):
    """Walk as defined: least of the window, windows start after the last one visited."""
    out, start = [], 0
    while True:
        window = list(range(start, min(start + w, len(hashes))))
        if not window:
            return out
        least = min(hashes[i] for i in window)
        if out and len(window) < w and least >= hashes[out[-1]]:
            return out
        out.append(min((i for i in window if hashes[i] == least), key=lambda i: i % w))
        if start + w >= len(hashes):
            return out
        start = out[-1] + 1


def test_minimizers(reads):
    spec = HashSpec(k=9, w=5)
    got = {}
    for row in minimizers(reads, ["id"], "seq", spec).orderBy("id", "pos").collect():
        got.setdefault(row["id"], []).append((row["pos"], row["hash"], row["is_fwd"]))
    for row in reads.collect():
        kmers = canonical(row["seq"], 9)
        want = [(p, *kmers[p]) for p in brute_minimizers([h for h, _ in kmers], 5)]
        assert got.get(row["id"], []) == want


def jumps(*rows, w):
    row, at = jump_minimizer_positions(np.array([h for r in rows for h in r]), np.array([len(r) for r in rows]), w)
    return [at[row == i].tolist() for i in range(len(rows))]


def test_minimizer_shapes():
    import numpy as np

    assert jumps([5], w=3) == [[0]]
    assert jumps([3, 1, 2], w=3) == [[1]]
    assert jumps([1, 5, 5, 5, 5], w=3) == [[0, 3]]
    assert jumps([1, 5, 6, 7, 0], w=4) == [[0, 4]]
    assert jumps([1, 5, 6, 0, 2], w=4) == [[3]]


def test_spec_limits():
    for bad in ({"k": 0}, {"k": 32}, {"w": 0}, {"factor": 0}):
        with pytest.raises(ValueError):
            HashSpec(**bad)


def test_alphabets(spark):
    row = spark.createDataFrame([("acgtnRY-xU*",)], "s string").select(
        alphabet.dna_text(F.col("s")), alphabet.dna_text_ambiguous(F.col("s")),
        alphabet.dna_ambiguous_to_n(F.col("s")), alphabet.dna_index(F.col("s")),
        encode_kmer(F.lit("ACGTN")),
    ).head()
    assert tuple(row) == ("ACGTN", "ACGTNRY-", "ACGTNNN-", "01230", 0b0001101100)


def test_minimizers_of_rows_laid_end_to_end():
    rng = np.random.default_rng(3)
    rows = [rng.integers(0, 9, n).tolist() for n in (0, 1, 30, 2, 0, 57, 5)]
    assert jumps(*rows, w=5) == [jumps(r, w=5)[0] if r else [] for r in rows]


def test_minimizers_of_blocks_and_of_pieces_of_a_long_row(monkeypatch):
    rng = np.random.default_rng(5)
    rows = ["".join(rng.choice(list("ACGT"), n)) for n in (0, 3, 40, 500, 7, 64, 0, 1203, 9, 10)] + ["A" * 300, "ACG" * 80]
    for spec in (HashSpec(k=3, w=5), HashSpec(k=9, w=31), HashSpec(k=4, w=1)):
        whole = minimizer_hits(pa.array(rows), spec).to_pylist()
        for row, hits in zip(rows, whole, strict=True):
            kmers = canonical(row, spec.k)
            assert [h["pos"] for h in hits] == brute_minimizers([h for h, _ in kmers], spec.w)
        for size in (1, 30, 64, 100):
            monkeypatch.setattr(sampling, "_BLOCK", size)
            assert minimizer_hits(pa.array(rows), spec).to_pylist() == whole
        monkeypatch.undo()


def test_minimizers_need_little_memory_beside_the_batch():
    import tracemalloc

    rng = np.random.default_rng(6)
    bases = np.frombuffer(b"ACGT", np.uint8)[rng.integers(0, 4, 4_000_000)].tobytes().decode()
    for rows in ([bases], [bases[i:i + 2000] for i in range(0, len(bases), 2000)]):
        seqs = pa.array(rows)
        tracemalloc.start()
        minimizer_hits(seqs, HashSpec())
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 20 * len(bases)
