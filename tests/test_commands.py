"""The command line from raw files to reports."""

import random

from plain import random_dna, reverse_complement
from strandlake.__main__ import main


def run(capsys, *argv):
    capsys.readouterr()
    main([str(a) for a in argv])
    return [line.split("\t") for line in capsys.readouterr().out.splitlines()]


def test_sketch_map_and_reads(spark, tmp_path, capsys):
    rng = random.Random(15)
    genome = random_dna(rng, 8000)
    starts = [rng.randrange(0, 7000) for _ in range(60)]
    (tmp_path / "ref.fa").write_text(f">chr1\n{genome}\n")
    (tmp_path / "reads.fa").write_text("".join(
        f">r{i}\n{genome[a:a + 900] if i % 2 else reverse_complement(genome[a:a + 900])}\n" for i, a in enumerate(starts)))
    t = tmp_path
    run(capsys, "sketch", "build", t / "reads.fa", "--out", t / "s1", "--w", 8)
    run(capsys, "sketch", "merge", t / "s1", t / "s1", "--out", t / "s2")
    run(capsys, "sketch", "prune", t / "s2", "--min", 4, "--out", t / "s3")
    run(capsys, "sketch", "copy", t / "s3", "--levels", 1, 60, 90, "--out", t / "s4")
    assert run(capsys, "sketch", "summary", t / "s4")[0] == ["SH k 19  w 8"]
    depths = [int(r[0]) for r in run(capsys, "sketch", "histogram", t / "s4")[1:]]
    assert depths == sorted(depths) and all(d % 2 == 0 and d >= 4 for d in depths)
    assert run(capsys, "sketch", "depths", t / "s4", t / "s1")[0] == ["hash", "copy", "depth", "depth_1"]

    run(capsys, "map", "index", t / "ref.fa", "--out", t / "ref", "--w", 8)
    header, *rows = run(capsys, "map", "queries", t / "ref", t / "reads.fa")
    assert {r[header.index("ref")] for r in rows} == {"chr1"} and len(rows) == 60
    assert len(run(capsys, "map", "summary", t / "ref", t / "reads.fa")) == 61
    assert len(run(capsys, "map", "seeds", t / "ref", t / "reads.fa")) > 61

    run(capsys, "reads", "load", t / "s4", t / "reads.fa", "--out", t / "rs")
    assert run(capsys, "reads", "stats", t / "rs")[1][0] == "60"
    assert len(run(capsys, "reads", "report", t / "rs")) == 61
    partners = run(capsys, "reads", "overlaps", t / "rs", "--read", 1)
    assert len(partners) > 3
    assert len(run(capsys, "reads", "pair", t / "rs", "--read", 1, "--other", partners[1][1])) > 3
    assert len(run(capsys, "reads", "flag", t / "rs", "--out", t / "fl")) == 3
    contained = run(capsys, "reads", "contain", t / "rs", t / "fl")
    assert len(contained) > 1 and contained[-2] == ["n_contained", "n_free", "free_avg_len"]
    built = run(capsys, "reads", "assemble", t / "rs", "--read", 1)
    assert ["n_hash", "mean_count"] in built and ["hash", "next_hash", "n"] in built
    assert ["A"] in [r[:1] for r in run(capsys, "composition", "report", t / "reads.fa")]


def test_linked_reads(spark, tmp_path, capsys):
    rng = random.Random(16)
    t = tmp_path
    genome = random_dna(rng, 9000)
    codes = [random_dna(rng, 16) for _ in range(12)]
    one, two = [], []
    for i in range(12 * 80):
        code = codes[i % 12]
        at = (i % 12) * 250 + rng.randrange(0, 4000)
        first = code + "A" * 7 + genome[at:at + 128]
        second = reverse_complement(genome[at + 200:at + 351])
        one.append(f"@p{i}\n{first}\n+\n{'I' * 151}\n")
        two.append(f"@p{i}\n{second}\n+\n{'I' * 151}\n")
    (t / "1.fq").write_text("".join(one))
    (t / "2.fq").write_text("".join(two))
    found = [r[0] for r in run(capsys, "linked", "codes", t / "1.fq", "--min", 50)[1:]]
    assert sorted(found) == sorted(codes)
    (t / "white").write_text("\n".join(found) + "\n")
    counts = run(capsys, "linked", "pack", t / "1.fq", t / "2.fq", "--out", t / "pairs", "--whitelist", t / "white")
    assert counts[1][:3] == ["960", "0", "0"]
    run(capsys, "linked", "load", t / "pairs", "--out", t / "inc", "--lengths", 151, 151)
    stats = run(capsys, "linked", "stats", t / "inc")
    assert stats[1][:2] == ["960", "12"]
    assert run(capsys, "linked", "histograms", t / "inc")[0] == ["bin", "n", "cum_frac", "cum_mass_frac"]
    (t / "a.fa").write_text(f">1\n{genome}\n")
    kinds = run(capsys, "linked", "crib", t / "inc", t / "a.fa", t / "a.fa", "--out", t / "crib")
    assert "hom" in [r[0] for r in kinds]
    assert run(capsys, "linked", "classes", t / "inc", t / "crib")[0] == ["depth", "err", "het", "hom", "mul"]
    hashes = [r["hash"] for r in spark.read.parquet(str(t / "inc" / "inc")).groupBy("hash").count().orderBy("count", ascending=False).head(2)]
    span = ("--range", 2, 13)
    assert len(run(capsys, "linked", "explore", t / "inc", *span, "--hashes", hashes[0])) > 1
    assert len(run(capsys, "linked", "info", t / "inc", *span, "--hashes", *hashes)) == 3
    assert len(run(capsys, "linked", "shared", t / "inc", *span, "--hashes", *hashes)) > 1
    run(capsys, "linked", "scan", t / "inc", *span, "--counts", 3, 8)
    assert len(run(capsys, "linked", "errors", t / "inc", t / "crib", *span)) > 1
    run(capsys, "linked", "cluster", t / "inc", *span, "--threshold", 2, "--out", t / "labels")
    code = spark.read.parquet(str(t / "labels")).agg({"barcode": "max"}).head()[0]
    shown = run(capsys, "linked", "explore-code", t / "inc", t / "crib", *span, "--threshold", 2, "--code", code)
    assert ["shared", "n"] in shown or ["bin", "n"] in shown
    report = run(capsys, "linked", "report", t / "inc", t / "labels", "--crib", t / "crib")
    assert report[-2] == ["min_point_density"]
    run(capsys, "linked", "split", t / "inc", t / "labels", "--out", t / "inc2")
    assert spark.read.parquet(str(t / "inc2" / "codes")).where("parent is not null").count() > 0
    assert run(capsys, "linked", "class-summary", t / "inc2", t / "crib")[0] == ["is_cluster", "type", "n_rows", "n_hash", "ratio"]


def test_several_files_are_one_input(spark, tmp_path, capsys):
    rng = random.Random(18)
    t = tmp_path
    genomes = [random_dna(rng, 3000) for _ in range(2)]
    for i, genome in enumerate(genomes):
        (t / f"ref{i}.fa").write_text(f">chr{i}\n{genome}\n")
    (t / "q0.fa").write_text(f">a\n{genomes[0][300:1500]}\n")
    (t / "q1.fq").write_text(f"@b\n{genomes[1][900:2100]}\n+\n{'I' * 1200}\n")
    run(capsys, "map", "index", t / "ref0.fa", t / "ref1.fa", "--out", t / "ref", "--w", 8)
    header, *rows = run(capsys, "map", "queries", t / "ref", t / "q0.fa", t / "q1.fq")
    assert sorted((r[header.index("name")], r[header.index("ref")]) for r in rows) == [("a", "chr0"), ("b", "chr1")]
