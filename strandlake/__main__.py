"""Command line: ``python -m strandlake <group> <command> ...``.

Every command reads saved tables or sequence files and writes a saved table (``--out``) or a report
(``--report`` for tab-separated files; otherwise lines on standard output).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.packing import pack_pair
from .operators import (
    barcodes, cluster, composition, histogram, incidence, mapping, overlap, sketchset, truth,
)
from .operators.sketch import sketch_pieces
from .session import build_session
from .sources import packed, sequences, tables
from .spec import DEFAULT_FACTOR, HashSpec, LINKED_READ_K


def show(df: DataFrame, args, tag: str | None = None) -> None:
    """Write a report, or stream its lines to standard output partition by partition."""
    if args.report:
        tables.write_report(df, args.report, tag)
        return
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def spec_of(args) -> HashSpec:
    return HashSpec(args.k, args.w, args.factor)


def one_set(spark, root):
    spec, found = tables.load(spark, "sketch", root)
    return spec, found["sketch"]


# ---------------------------------------------------------------------------------- sketch


def sketch_build(spark, args):
    spec = spec_of(args)
    counted = []
    for path in args.reads:
        seqs = sequences.read_sequences(spark, path)
        if args.linked:
            seqs = sketchset.trim_linked_prefix(seqs, F.col("seq_id") % 2 == 1)
        counted.append(sketchset.count_sequences(seqs, spec=spec))
    made = counted[0] if len(counted) == 1 else sketchset.merge_all(counted)
    tables.save("sketch", args.out, spec, sketch=made)


def sketch_merge(spark, args):
    loaded = [one_set(spark, root) for root in args.sets]
    specs = [spec for spec, _ in loaded]
    tables.save("sketch", args.out, specs[0], sketch=sketchset.merge_all([s for _, s in loaded], specs))


def sketch_prune(spark, args):
    spec, found = one_set(spark, args.set)
    tables.save("sketch", args.out, spec, sketch=sketchset.prune(found, args.min, args.max))


def sketch_copy(spark, args):
    spec, found = one_set(spark, args.set)
    if len(args.levels) == 1:
        found = sketchset.set_copy_multi(found, args.levels[0])
    else:
        found = sketchset.set_copy(found, *args.levels)
    tables.save("sketch", args.out, spec, sketch=found)


def sketch_summary(spark, args):
    spec, found = one_set(spark, args.set)
    print(spec)
    show(sketchset.set_summary(found), args, "MS")


def sketch_histogram(spark, args):
    show(sketchset.depth_histogram(one_set(spark, args.set)[1]).orderBy("depth"), args, "DP")


def sketch_depths(spark, args):
    main, *others = [one_set(spark, root)[1] for root in args.sets]
    show(sketchset.depth_report(main, {str(i): o for i, o in enumerate(others, 1)}), args, "MH")


# --------------------------------------------------------------------------------- mapping


def map_index(spark, args):
    spec = spec_of(args)
    refs = sequences.read_sequences(spark, args.references).withColumnRenamed("seq_id", "ref_id")
    mapping.check_unique_names(refs)
    hits = mapping.reference_hits(refs, spec, in_pieces=True)
    tables.save(
        "reference", args.out, spec, ref_hits=hits, ref_seqs=mapping.reference_sequences(refs)
    )


def _mapped(spark, args):
    spec, ref = tables.load(spark, "reference", args.index)
    queries = sequences.read_sequences(spark, args.reads).withColumnRenamed("seq_id", "query_id")
    summary, chains = mapping.map_queries(queries, mapping.reference_index(ref["ref_hits"]), spec)
    names = queries.select("query_id", "name")
    ref_names = ref["ref_seqs"].select("ref_id", F.col("name").alias("ref"))
    return summary.join(names, "query_id"), chains.join(names, "query_id").join(ref_names, "ref_id")


def map_queries(spark, args):
    show(_mapped(spark, args)[1], args, "M")


def map_summary(spark, args):
    show(_mapped(spark, args)[0], args, "Q")


def map_seeds(spark, args):
    spec, ref = tables.load(spark, "reference", args.index)
    queries = sequences.read_sequences(spark, args.reads).withColumnRenamed("seq_id", "query_id")
    show(mapping.seed_places(mapping.query_seeds(queries, mapping.reference_index(ref["ref_hits"]), spec)), args)


# ----------------------------------------------------------------------------------- reads


def reads_load(spark, args):
    spec, found = one_set(spark, args.set)
    reads = sequences.read_sequences(spark, args.reads).withColumnRenamed("seq_id", "read_id")
    hits = overlap.read_hits(reads, found, spec)
    tables.save(
        "readset", args.out, spec, reads=overlap.read_table(reads, hits),
        read_hits=overlap.known_hits(hits),
    )


def _readset(spark, args):
    _, found = tables.load(spark, "readset", args.readset)
    return found["reads"], found["read_hits"]


def reads_stats(spark, args):
    show(overlap.readset_stats(_readset(spark, args)[0]), args, "RS")


def reads_report(spark, args):
    table, hits = _readset(spark, args)
    show(overlap.read_report(table, hits, overlap.overlaps(hits)), args, "RR")


def _of_read(spark, args):
    _, hits = _readset(spark, args)
    wanted = spark.createDataFrame([(args.read,)], "read_id bigint")
    return hits, overlap.overlaps(hits, wanted)


def reads_overlaps(spark, args):
    show(_of_read(spark, args)[1], args, "RH")


def reads_pair(spark, args):
    _, hits = _readset(spark, args)
    pair = spark.createDataFrame([(args.read, args.other)], "x bigint, y bigint")
    show(overlap.hit_pairs(hits, pair), args, "RO")


def reads_flag(spark, args):
    table, hits = _readset(spark, args)
    flagged, counts = overlap.mark_bad_reads(table, hits, overlap.overlaps(hits), args.mode)
    for label, n in counts.items():
        print(f"MB\t{n} with {label} bad overlaps")
    flagged.write.parquet(args.out)


def reads_contain(spark, args):
    _, hits = _readset(spark, args)
    found = overlap.mark_contained(spark.read.parquet(args.flagged), overlap.overlaps(hits))
    show(found, args, "MC")
    show(overlap.containment_summary(found), args)


def reads_assemble(spark, args):
    hits, pairs = _of_read(spark, args)
    pooled = overlap.pooled_hits(hits, pairs)
    show(overlap.support_table(pooled, overlap.hit_depths(hits)), args, "AH")
    show(overlap.assembly_summary(pooled), args)
    show(overlap.successors(hits, pairs), args)


# ---------------------------------------------------------------------------- linked reads


def linked_codes(spark, args):
    reads = sequences.read_fastq(spark, args.reads)
    show(barcodes.good_codes(reads, "seq", args.min).select("barcode"), args)


def linked_pack(spark, args):
    pairs = barcodes.pair_reads(
        sequences.read_fastq(spark, args.first), sequences.read_fastq(spark, args.second)
    )
    if args.whitelist:
        variants = barcodes.whitelist_variants(sequences.read_whitelist(spark, args.whitelist))
        show(barcodes.correction_counts(pairs, variants), args)
        fixed = barcodes.correct_barcodes(pairs, variants)
        after = F.substring(F.col("seq1"), F.lit(barcodes.BARCODE_BASES + 1), F.length("seq1"))
        pairs = fixed.withColumn("seq1", F.concat("barcode", after))
    record = pack_pair(F.col("seq1"), F.col("qual1"), F.col("seq2"), F.col("qual2"))
    packed.write_packed_pairs(pairs.select(record.alias("record")), args.out)


def linked_load(spark, args):
    spec = spec_of(args)
    pairs = packed.read_packed_pairs(spark, args.pairs, args.limit, tuple(args.lengths) if args.lengths else None)
    inc = incidence.build_incidence(incidence.linked_read_hits(pairs, spec))
    codes = incidence.code_table(inc, pairs)
    tables.save("incidence", args.out, spec, inc=inc, codes=codes)


def _incidence(spark, args):
    spec, found = tables.load(spark, "incidence", args.incidence)
    return spec, found["inc"], found["codes"]


def linked_stats(spark, args):
    _, inc, codes = _incidence(spark, args)
    show(incidence.incidence_totals(codes), args)
    show(histogram.summary(incidence.depth_histogram(inc)), args, "HASH_COUNT_STATS")
    show(histogram.summary(incidence.code_size_histogram(codes)), args, "CODE_SIZE_STATS")


def linked_histograms(spark, args):
    _, inc, codes = _incidence(spark, args)
    for counted in (incidence.depth_histogram(inc), incidence.code_size_histogram(codes)):
        show(histogram.cumulative(counted).select("bin", "n", "cum_frac", "cum_mass_frac").orderBy("bin"), args)


def linked_classes(spark, args):
    show(truth.crib_table(spark.read.parquet(args.crib)).orderBy("depth"), args)


def linked_class_summary(spark, args):
    _, inc, codes = _incidence(spark, args)
    if "parent" not in codes.columns:
        codes = codes.withColumn("parent", F.lit(None).cast("bigint"))
    show(truth.crib_summary(inc, spark.read.parquet(args.crib), codes), args)


def linked_explore_code(spark, args):
    _, inc, _ = _incidence(spark, args)
    found = cluster.explore_code(inc, [tuple(args.range)], spark.read.parquet(args.crib), args.code, args.threshold)
    for name in ("clusters", "share_histogram", "share"):
        report = found[name]
        if "others" in report.columns:
            report = report.withColumn("others", F.array_join("others", " "))
        show(report, args)


def _near(spark, args):
    _, inc, _ = _incidence(spark, args)
    depths = incidence.hash_depths(inc)
    targets = spark.createDataFrame([(h,) for h in args.hashes], "x bigint")
    ranged = incidence.in_range(depths, [tuple(args.range)])
    return inc, depths, targets, incidence.neighbours(inc, ranged, targets)


def linked_explore(spark, args):
    explored = incidence.explore(_near(spark, args)[3])
    show(explored.withColumn("sample_hashes", F.array_join("sample_hashes", " ")), args)


def linked_info(spark, args):
    _, depths, targets, near = _near(spark, args)
    show(incidence.hash_info(depths, near, targets), args, "HASH_INFO")


def linked_shared(spark, args):
    inc, _, _, near = _near(spark, args)
    show(incidence.double_shared(near, *args.hashes[:2], inc), args)


def linked_scan(spark, args):
    _, inc, _ = _incidence(spark, args)
    depths = incidence.hash_depths(inc)
    ranged = incidence.in_range(depths, [tuple(args.range)])
    ids = incidence.hash_ids(inc)
    numbered = depths.join(ids, "hash").select(F.col("hash_id").alias("hash"), "depth", F.col("hash").alias("own"))
    picked = incidence.scan_targets(numbered, *args.counts)
    targets = picked.join(ids.withColumnRenamed("hash_id", "x"), "x").select(F.col("hash").alias("x"), "depth")
    show(incidence.share_scan(inc, ranged, targets), args, "SHARE_SCAN")


def _genome(spark, path, spec):
    chromosomes = sequences.read_fasta(spark, path).withColumnRenamed("seq_id", "chr")
    return sketch_pieces(chromosomes, ["chr"], "seq", spec).select("hash", "chr", "pos")


def linked_crib(spark, args):
    spec, inc, _ = _incidence(spark, args)
    made = truth.build_crib(
        incidence.hash_depths(inc), *[_genome(spark, g, spec) for g in args.genomes]
    )
    made.write.parquet(args.out)
    show(truth.crib_stats(spark.read.parquet(args.out)), args)


def linked_errors(spark, args):
    _, inc, _ = _incidence(spark, args)
    depths = incidence.hash_depths(inc)
    ranged = incidence.in_range(depths, [tuple(args.range)])
    shares = incidence.share_histogram(inc, ranged, depths.select(F.col("hash").alias("x")))
    typed = incidence.flag_errors(incidence.error_scores(shares, depths), spark.read.parquet(args.crib))
    show(incidence.score_summary(typed, ranged), args)


def linked_cluster(spark, args):
    _, inc, _ = _incidence(spark, args)
    codes = tuple(args.codes) if args.codes else None
    labels = cluster.cluster_hashes(inc, [tuple(args.range)], args.threshold, codes=codes)
    labels.write.parquet(args.out)


def linked_report(spark, args):
    _, _, codes = _incidence(spark, args)
    labels = spark.read.parquet(args.labels)
    show(cluster.code_summary(codes, labels), args, "CLUSTER_SUMMARY")
    if args.crib:
        report = cluster.cluster_report(labels, spark.read.parquet(args.crib))
        show(report.withColumn("others", F.array_join("others", " ")), args, "CODE_CLUSTER")
    show(cluster.min_point_density(labels), args, "MIN_POINT_DENSITY")


def linked_split(spark, args):
    spec, inc, codes = _incidence(spark, args)
    rows, made = cluster.split_codes(inc, codes, spark.read.parquet(args.labels))
    tables.save("incidence", args.out, spec, inc=rows, codes=made)


def composition_report(spark, args):
    if sequences.sniff(spark, args.reads) == "fastq":
        reads = sequences.read_fastq(spark, args.reads)
        show(composition.quality_composition(reads).orderBy("quality"), args)
    else:
        reads = sequences.read_fasta(spark, args.reads)
    show(composition.length_summary(reads), args)
    show(composition.base_composition(reads).orderBy("base"), args)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandlake")
    top.add_argument("--master", default=None)
    groups = top.add_subparsers(dest="group", required=True)

    def group(name):
        return groups.add_parser(name).add_subparsers(dest="command", required=True)

    def command(under, name, run, *positional, out=False, **options):
        cmd = under.add_parser(name)
        for arg in positional:
            many = arg.endswith("+")
            cmd.add_argument(arg.rstrip("+"), **({"nargs": "+"} if many else {}))
        if out:
            cmd.add_argument("--out", required=True)
        cmd.add_argument("--report", default=None)
        for option, settings in options.items():
            cmd.add_argument("--" + option.replace("_", "-"), **settings)
        cmd.set_defaults(run=run)

    def hashing(k=19):
        return {
            "k": {"type": int, "default": k}, "w": {"type": int, "default": 31},
            "factor": {"type": int, "default": DEFAULT_FACTOR},
        }

    number = {"type": int, "required": True}
    span = {"type": int, "nargs": 2, "required": True}
    numbers = {"type": int, "nargs": "+", "required": True}

    g = group("sketch")
    command(g, "build", sketch_build, "reads+", out=True, linked={"action": "store_true"}, **hashing())
    command(g, "merge", sketch_merge, "sets+", out=True)
    command(g, "prune", sketch_prune, "set", out=True, min=number, max={"type": int, "default": 0})
    command(g, "copy", sketch_copy, "set", out=True, levels=numbers)
    command(g, "summary", sketch_summary, "set")
    command(g, "histogram", sketch_histogram, "set")
    command(g, "depths", sketch_depths, "sets+")
    g = group("map")
    command(g, "index", map_index, "references+", out=True, **hashing())
    command(g, "queries", map_queries, "index", "reads+")
    command(g, "summary", map_summary, "index", "reads+")
    command(g, "seeds", map_seeds, "index", "reads+")
    g = group("reads")
    command(g, "load", reads_load, "set", "reads", out=True)
    command(g, "stats", reads_stats, "readset")
    command(g, "report", reads_report, "readset")
    command(g, "overlaps", reads_overlaps, "readset", read=number)
    command(g, "pair", reads_pair, "readset", read=number, other=number)
    command(g, "flag", reads_flag, "readset", out=True, mode={"default": "sequential"})
    command(g, "contain", reads_contain, "readset", "flagged")
    command(g, "assemble", reads_assemble, "readset", read=number)
    g = group("linked")
    command(g, "codes", linked_codes, "reads", min={"type": int, "default": barcodes.GOOD_CODE_READS})
    command(g, "pack", linked_pack, "first", "second", out=True, whitelist={"default": None})
    command(
        g, "load", linked_load, "pairs", out=True, limit={"type": int, "default": 0},
        lengths={"type": int, "nargs": 2, "default": None}, **hashing(LINKED_READ_K),
    )
    command(g, "stats", linked_stats, "incidence")
    command(g, "histograms", linked_histograms, "incidence")
    command(g, "classes", linked_classes, "incidence", "crib")
    command(g, "class-summary", linked_class_summary, "incidence", "crib")
    command(
        g, "explore-code", linked_explore_code, "incidence", "crib", range=span, code=number,
        threshold={"type": int, "default": cluster.DEFAULT_THRESHOLD},
    )
    command(g, "explore", linked_explore, "incidence", range=span, hashes=numbers)
    command(g, "info", linked_info, "incidence", range=span, hashes=numbers)
    command(g, "shared", linked_shared, "incidence", range=span, hashes=numbers)
    command(g, "scan", linked_scan, "incidence", range=span, counts=span)
    command(g, "crib", linked_crib, "incidence", "genomes+", out=True)
    command(g, "errors", linked_errors, "incidence", "crib", range=span)
    command(
        g, "cluster", linked_cluster, "incidence", out=True, range=span,
        threshold={"type": int, "default": cluster.DEFAULT_THRESHOLD},
        codes={"type": int, "nargs": 2, "default": None},
    )
    command(g, "report", linked_report, "incidence", "labels", crib={"default": None})
    command(g, "split", linked_split, "incidence", "labels", out=True)
    command(group("composition"), "report", composition_report, "reads")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(build_session(args.master), args)


if __name__ == "__main__":
    main()
