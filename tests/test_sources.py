import gzip
import random

import pytest
from pyspark.sql import functions as F

from plain import random_dna
from strandlake import HashSpec
from strandlake.functions import packing
from strandlake.operators import sketchset
from strandlake.sources import fastq, packed, sequences, tables


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def wrapped(seq, n=60):
    return "\n".join(seq[i:i + n] for i in range(0, len(seq), n))


def test_fasta_over_splits(spark, tmp_path, small_splits):
    rng = random.Random(3)
    records = [(f"r{i}", f"note {i}>x", random_dna(rng, rng.randrange(0, 900))) for i in range(80)]
    (tmp_path / "a.fa").write_text("".join(f">{n} {d}\n{wrapped(s)}\n" for n, d, s in records[:50]))
    # a second file, without a final newline
    (tmp_path / "b.fa").write_text("".join(f">{n} {d}\n{wrapped(s)}\n" for n, d, s in records[50:])[:-1])
    df = sequences.read_fasta(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 3
    rows = [tuple(r) for r in df.orderBy("seq_id").collect()]
    assert rows == [(i, *r) for i, r in enumerate(records, start=1)]


def test_fasta_edges(spark, tmp_path):
    path = tmp_path / "x.fa"
    path.write_text("acgt\nnnx-\n>two\n>three  a b\nAC\r\nGT*\n")
    rows = sequences.read_fasta(spark, str(path)).orderBy("seq_id").collect()
    assert [tuple(r) for r in rows] == [
        (1, "", "", "ACGTNN-"), (2, "two", "", ""), (3, "three", "a b", "ACGT")]
    with pytest.raises(Exception, match="bad character"):
        sequences.read_fasta(spark, str(path), invalid="fail").collect()
    assert sequences.read_fasta(spark, str(path)).where("name = 'two'").count() == 1


def fastq_text(records):
    return "".join(f"@{n} x\n{s}\n+\n{q}\n" for n, s, q in records)


def test_fastq_over_splits_and_gzip(spark, tmp_path, small_splits):
    rng = random.Random(4)
    records = []
    for i in range(120):
        n = rng.randrange(1, 200)
        records.append((f"q{i}", random_dna(rng, n), "".join(rng.choice("@+>I5!") for _ in range(n))))
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.fq").write_text(fastq_text(records[:70]))
    with gzip.open(tmp_path / "p" / "b.fq.gz", "wt") as out:
        out.write(fastq_text(records[70:]))
    df = sequences.read_fastq(spark, str(tmp_path / "p"))
    rows = [(r["seq_id"], r["name"], r["seq"], r["qual"]) for r in df.orderBy("seq_id").collect()]
    assert rows == [(i, *r) for i, r in enumerate(records, start=1)]
    assert sequences.sniff(spark, str(tmp_path / "p" / "b.fq.gz")) == "fastq"
    assert sequences.read_sequences(spark, str(tmp_path / "p" / "a.fq")).count() == 70


def dealt(spark, lines, sizes):
    """``lines`` of one file as splits of the given sizes, over and over."""
    rows, block = [], 0
    while lines:
        size = sizes[block % len(sizes)]
        rows += [("f", block, value) for value in lines[:size]]
        lines, block = lines[size:], block + 1
    df = spark.createDataFrame(rows, "file string, block bigint, value string").withColumn("at", F.monotonically_increasing_id())
    return df.repartition(3, "block").sortWithinPartitions("block", "at").drop("at")


def random_records(rng, n, least=0):
    out = []
    for i in range(n):
        size = rng.randrange(least, 90)
        out.append((f"q{i}", random_dna(rng, size), "".join(rng.choice("@+I5") for _ in range(size))))
    return out


@pytest.mark.parametrize("sizes", [[1], [2, 3, 0, 1, 5], [4], [7], [50], [10_000]])
def test_four_lines_over_any_splits(spark, sizes):
    rng = random.Random(len(sizes) + sizes[0])
    records = random_records(rng, 60)
    sizes = [s for s in sizes if s]
    df = fastq.four_line_records(dealt(spark, fastq_text(records).split("\n")[:-1], sizes))
    rows = [(r["rec"], r["seq_id"], r["header"], r["seq"], r["qual"]) for r in df.orderBy("rec").collect()]
    assert rows == [(i, i + 1, f"@{n} x", s, q) for i, (n, s, q) in enumerate(records)]


@pytest.mark.parametrize("sizes", [[1], [3, 2, 1], [11], [40], [10_000]])
def test_lines_of_any_number_over_any_splits(spark, sizes):
    rng = random.Random(7 + sizes[0])
    records = random_records(rng, 60)
    text = "".join(f"@{n} x\n{wrapped(s, 20)}\n+{rng.choice(['', n, n + ' x'])}\n{wrapped(q, 13)}\n" for n, s, q in records)
    df = fastq.multi_line_records(dealt(spark, text.split("\n")[:-1], sizes))
    rows = [(r["rec"], r["seq_id"], r["header"], r["seq"], r["qual"]) for r in df.orderBy("rec").collect()]
    assert rows == [(i, i + 1, f"@{n} x", s, q) for i, (n, s, q) in enumerate(records)]


def test_multi_line_files(spark, tmp_path, small_splits):
    rng = random.Random(8)
    records = random_records(rng, 150)
    for name, some in (("a.fq", records[:100]), ("b.fq", records[100:])):
        (tmp_path / name).write_text("".join(f"@{n} x\n{wrapped(s, 30)}\n+\n{wrapped(q, 30)}\n" for n, s, q in some))
    df = sequences.read_fastq(spark, str(tmp_path), multi_line=True)
    assert [(r["seq_id"], r["name"], r["seq"], r["qual"]) for r in df.orderBy("seq_id").collect()] == [(i, *r) for i, r in enumerate(records, 1)]


@pytest.mark.parametrize("text", ["@a\nAC\nGT\n+\nIII\n", "@a\nACGT\n+\nIIIII\n@b\nA\n+\nI\n", "ACGT\n@b\nA\n+\nI\n", "@a\nAC\n+b\nII\n", "@a\nAC\n"])
@pytest.mark.parametrize("sizes", [[2], [100]])
def test_multi_line_errors(spark, text, sizes):
    with pytest.raises(Exception, match="no certain record|mismatching"):
        fastq.multi_line_records(dealt(spark, text.split("\n")[:-1], sizes)).collect()


def test_no_lines(spark):
    empty = spark.createDataFrame([], "file string, block bigint, value string")
    assert fastq.four_line_records(empty).count() == fastq.multi_line_records(empty).count() == 0


def test_fastq_errors(spark, tmp_path):
    path = tmp_path / "bad.fq"
    path.write_text("@a\nACGT\n+\nIIII\n@b\nACG\n+\nII\n@c\nACGT\n")
    with pytest.raises(Exception, match="bad record"):
        sequences.read_fastq(spark, str(path)).collect()
    kept = sequences.read_fastq(spark, str(path), strict=False).collect()
    assert [r["name"] for r in kept] == ["a"]
    path.write_text("@a\nACGT\n+\nIIII\n")
    assert sequences.read_fastq(spark, str(path), fixed_length=4).count() == 1
    with pytest.raises(Exception, match="bad record"):
        sequences.read_fastq(spark, str(path), fixed_length=5).collect()


def test_write_round_trips(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, f"n{i}", "d" if i % 2 else "", random_dna(rng, 60 * (i % 3) + i), "I" * (60 * (i % 3) + i)) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "seq_id bigint, name string, desc string, seq string, qual string").coalesce(1)
    sequences.write_fasta(df, str(tmp_path / "fa"))
    sequences.write_fastq(df, str(tmp_path / "fq"))
    back = sequences.read_fasta(spark, str(tmp_path / "fa")).orderBy("seq_id").collect()
    assert [tuple(r) for r in back] == [r[:4] for r in rows]
    back = sequences.read_fastq(spark, str(tmp_path / "fq")).orderBy("seq_id").collect()
    assert [tuple(r) for r in back] == rows
    assert max(len(l) for f in (tmp_path / "fa").glob("part*") for l in f.read_text().split("\n")) <= 60


def test_whitelist_and_score_table(spark, tmp_path):
    (tmp_path / "w").write_text("ACGTACGTACGTACGT\nTTTTACGTACGTACGT\n")
    rows = sequences.read_whitelist(spark, str(tmp_path / "w")).orderBy("line_no").collect()
    assert [tuple(r) for r in rows] == [(1, "ACGTACGTACGTACGT"), (2, "TTTTACGTACGTACGT")]
    (tmp_path / "w2").write_text("ACGT\n")
    with pytest.raises(Exception, match="bad barcode"):
        sequences.read_whitelist(spark, str(tmp_path / "w2")).collect()
    (tmp_path / "m").write_text("# scores\n   A  C\nA  5 -4 # best\nC -4  6\n")
    scores = {(r["a"], r["b"]): r["score"] for r in sequences.read_score_table(spark, str(tmp_path / "m")).collect()}
    assert scores == {("A", "A"): 5, ("A", "C"): -4, ("C", "A"): -4, ("C", "C"): 6}


def packed_by_hand(seq1, qual1, seq2, qual2):
    out = b""
    for text, per, n in ((seq1, 16, 10), (qual1, 32, 5), (seq2, 16, 10), (qual2, 32, 5)):
        for i in range(n):
            word = 0
            for j in range(per):
                c = text[i * per + j] if i * per + j < len(text) else None
                if per == 16:
                    word = word * 4 + max("ACGT".find(c or "A"), 0)
                else:
                    word = word * 2 + (c is not None and c >= "8")
            out += word.to_bytes(4, "little")
    return out


def test_packed_pairs_file(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for _ in range(50):
        rows.append((random_dna(rng, 151), "".join(rng.choice("!7~8I") for _ in range(151)),
                     random_dna(rng, 151), "I" * 151))
    df = spark.createDataFrame(rows, "s1 string, q1 string, s2 string, q2 string").select(
        packing.pack_pair(F.col("s1"), F.col("q1"), F.col("s2"), F.col("q2")).alias("record"))
    want = sorted(packed_by_hand(*r) for r in rows)
    assert sorted(bytes(r["record"]) for r in df.collect()) == want
    packed.write_packed_pairs(df, str(tmp_path / "out"))
    data = b"".join(f.read_bytes() for f in sorted((tmp_path / "out").glob("*.pairs")))
    stored = [data[i:i + 120] for i in range(0, len(data), 120)]
    assert sorted(stored) == want and [s[:4] for s in stored] == sorted(s[:4] for s in stored)
    back = packed.read_packed_pairs(spark, str(tmp_path / "out")).orderBy("read").collect()
    assert len(back) == 50 and [r["read"] for r in back] == list(range(50))
    by_seq = {r[0]: r for r in rows}
    for row in back:
        s1, q1, s2, _ = by_seq[row["seq1"][:151]]
        assert row["seq2"][:151] == s2
        assert row["qual1"][:151] == "".join("1" if c >= "8" else "0" for c in q1)
        assert row["barcode"] == int("".join(str("ACGT".index(c)) for c in s1[:16]), 4)
    assert packed.read_packed_pairs(spark, str(tmp_path / "out"), limit=7).count() == 7
    packed.write_packed_pairs(df, str(tmp_path / "out"))
    assert packed.read_packed_pairs(spark, str(tmp_path / "out")).count() == 100


def test_right_justified_tail(spark):
    row = spark.range(1).select(
        packing.pack_bases(F.lit("ACGTACGTACGTACGTGT"), 2, True).alias("right"),
        packing.pack_bases(F.lit("ACGTACGTACGTACGTGT"), 2).alias("left"),
        packing.pack_qualities(F.lit("I!I"), 1, True).alias("q"),
    ).head()
    assert row["right"][1] == 0b1011 and row["left"][1] == 0b1011 << 28 and row["q"] == [5]


def test_save_and_load(spark, tmp_path):
    seqs = spark.createDataFrame([("ACGTTGCAAC" * 20,)], "seq string")
    spec = HashSpec(k=9, w=3)
    made = sketchset.count_sequences(seqs, spec=spec)
    tables.save("sketch", str(tmp_path / "s"), spec, sketch=made)
    back_spec, loaded = tables.load(spark, "sketch", str(tmp_path / "s"))
    assert back_spec == spec
    assert sorted(map(tuple, loaded["sketch"].collect())) == sorted(map(tuple, made.collect()))
    with pytest.raises(ValueError):
        tables.save("sketch", str(tmp_path / "t"), spec, sketch=made.drop("copy"))
    with pytest.raises(ValueError):
        tables.save("reference", str(tmp_path / "t"), spec, sketch=made)
    tables.write_report(made, str(tmp_path / "r"), "MH")
    assert all(l.startswith("MH\t") for f in (tmp_path / "r").glob("part*") for l in f.read_text().splitlines())


def test_records_have_room_for_160_bases(spark):
    df = spark.createDataFrame([("A" * 250, "I" * 250, "C" * 100, "I" * 100)], "s1 string, q1 string, s2 string, q2 string")
    with pytest.raises(Exception, match="room for 160"):
        df.select(packing.pack_pair("s1", "q1", "s2", "q2")).collect()
    with pytest.raises(Exception, match="more than 160"):
        df.select(packing.pack_bases(F.col("s1"), 10)).collect()


def test_lines_at_borders_move_as_pieces():
    import pyarrow as pa

    # a split within a record says nothing of where one starts
    lines = ["ACGT", ""] * 1_000
    batch = pa.RecordBatch.from_pydict({"file": ["f"] * 2_000, "block": pa.array([3] * 2_000, pa.int64()), "value": lines})
    rows = [r for b in fastq._many(iter([batch])) for r in b.to_pylist()]
    heads = sorted((r["at"], r["header"]) for r in rows if r["kind"] == "head")
    assert [line for _, text in heads for line in text.split("\n")] == lines
    assert [at for at, _ in heads] == list(range(0, 2_000, fastq.PIECE_LINES)) and len(rows) == len(heads) + 1
