"""The ready-made queries: name to function of (session, folder of tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import (
    dna_ambiguous_to_n, dna_index, dna_text, dna_text_ambiguous, letters_as_dna, protein_text, reverse_complement,
)
from ..functions.packing import pack_pair, unpack_pair
from ..operators import (
    barcodes, cluster, composition, histogram, incidence, mapping, overlap, ranks, sketchset, truth,
)
from ..operators.sketch import minimizers, sketch
from ..session import cut_lineage, cut_lineage_packed
from ..sources import fastq, sequences
from . import inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

DIGITS = 6


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


# ---------------------------------------------------------------------------------- readers


@query
def fastq_records(spark, sf):
    """Records of four lines, which lie across splits."""
    return sequences.fastq_reads(fastq.four_line_records(inputs.fastq_lines(spark, sf)))


@query
def fastq_fixed_length_records(spark, sf):
    """Records of parts, whose reads all have one length; others would be an error."""
    parts = inputs.table(spark, sf, "part").select(
        F.col("p_partkey").alias("read_id"), F.lit(None).cast("string").alias("lang"), inputs.user_barcode(F.col("p_partkey")).alias("seq")
    )
    return sequences.fastq_reads(fastq.four_line_records(inputs.as_fastq_lines(parts)), fixed_length=16)


@query
def fasta_records(spark, sf):
    """Titles and sequences of documents, whose texts are wrapped; characters that are no symbols are dropped."""
    return sequences.fasta_reads(inputs.fasta_records(spark, sf))


@query
def fasta_texts(spark, sf):
    return inputs.titled_documents(spark, sf).select("read_id", sequences.fasta_text().alias("value"))


@query
def fastq_texts(spark, sf):
    rows = inputs.titled_documents(spark, sf).withColumn("qual", F.translate("seq", "ACGT", "@+I5"))
    return rows.select("read_id", sequences.fastq_text().alias("value"))


@query
def converted_texts(spark, sf):
    """Texts through the alphabets."""
    rows = inputs.table(spark, sf, "documents").select("doc_id", "text")
    made = {"bases": dna_text, "ambiguous": dna_text_ambiguous, "to_n": dna_ambiguous_to_n, "digits": dna_index, "amino_acids": protein_text}
    return rows.select("doc_id", *[convert(F.col("text")).alias(name) for name, convert in made.items()])


@query
def whitelist_lines(spark, sf):
    """Barcodes of customers as lines, every seventh after an empty one."""
    code = inputs.user_barcode(F.col("c_custkey"))
    lines = inputs.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit(" "), F.lower(code)).alias("value"))
    blank = lines.where("c_custkey % 7 = 0").select("c_custkey", F.lit("").alias("value"))
    numbered = ranks.grouped_rank(lines.unionByName(blank), [], ["c_custkey", "value"], "seq_id")
    return sequences.whitelist(numbered)


@query
def fastq_multi_line_records(spark, sf):
    return sequences.fastq_reads(fastq.multi_line_records(inputs.fastq_lines(spark, sf, wrap=60)))


# ------------------------------------------------------------------------------ sketch sets


@query
def sketch_hits(spark, sf):
    return sketch(inputs.documents(spark, sf), ["read_id"]).select(
        "read_id", "ord", "pos", "hash", "is_fwd"
    )


@query
def sketch_depth_histogram(spark, sf):
    return sketchset.depth_histogram(inputs.document_set(spark, sf))


@query
def sketch_totals(spark, sf):
    return sketchset.input_totals(inputs.documents(spark, sf))


@query
def sketch_linked_reads(spark, sf):
    first = F.col("read_id") % 2 == 0
    trimmed = sketchset.trim_linked_prefix(inputs.documents(spark, sf), first)
    return sketchset.count_sequences(trimmed).select("hash", "depth")


@query
def sketch_prune(spark, sf):
    return sketchset.prune(inputs.document_set(spark, sf), 2, 50).select("hash", "depth")


@query
def sketch_copy_classes(spark, sf):
    return sketchset.set_copy_multi(inputs.classed_set(spark, sf), 75).select(
        "hash", "depth", F.col("copy").cast("int").alias("copy")
    )


def _merged(spark, sf, mode):
    sets = inputs.language_sets(spark, sf)
    merged = sketchset.merge(sets["en"], sets["fr"], copy_mode=mode)
    return merged.select("hash", "depth", F.col("copy").cast("int").alias("copy"))


@query
def sketch_merge(spark, sf):
    return _merged(spark, sf, "additive")


@query
def sketch_merge_compat(spark, sf):
    return _merged(spark, sf, "compat")


@query
def sketch_merge_all(spark, sf):
    merged = sketchset.merge_all(list(inputs.language_sets(spark, sf).values()))
    return merged.select("hash", "depth", F.col("copy").cast("int").alias("copy"))


@query
def sketch_summary(spark, sf):
    return sketchset.set_summary(inputs.classed_set(spark, sf))


@query
def sketch_depth_report(spark, sf):
    report = sketchset.depth_report(
        sketchset.prune(inputs.classed_set(spark, sf), 2), inputs.language_sets(spark, sf)
    )
    return report.withColumn("copy", F.col("copy").cast("int"))


@query
def sketch_minimizers(spark, sf):
    return minimizers(inputs.documents(spark, sf), ["read_id"])


# ------------------------------------------------------------------------------ composition


@query
def base_composition(spark, sf):
    return rounded(composition.base_composition(inputs.table(spark, sf, "documents"), "text"), "pct")


@query
def quality_composition(spark, sf):
    return rounded(
        composition.quality_composition(inputs.table(spark, sf, "conversations"), "text"), "pct"
    )


@query
def sequence_lengths(spark, sf):
    return composition.length_summary(inputs.table(spark, sf, "pages"), "html")


# --------------------------------------------------------------------------------- barcodes


@query
def good_codes(spark, sf):
    return barcodes.good_codes(inputs.documents(spark, sf), "seq", min_reads=2)


@query
def corrected_barcodes(spark, sf):
    variants = barcodes.whitelist_variants(inputs.customer_whitelist(spark, sf))
    return barcodes.correct_barcodes(inputs.barcoded_events(spark, sf), variants).select(
        "event_id", "barcode", "fix_pos"
    )


@query
def corrected_barcodes_latest(spark, sf):
    variants = barcodes.whitelist_variants(inputs.customer_whitelist(spark, sf), exact_first=False)
    return barcodes.correct_barcodes(inputs.barcoded_events(spark, sf), variants).select(
        "event_id", "barcode", "fix_pos"
    )


@query
def barcode_correction_counts(spark, sf):
    variants = barcodes.whitelist_variants(inputs.customer_whitelist(spark, sf))
    counts = barcodes.correction_counts(inputs.barcoded_events(spark, sf), variants)
    return rounded(counts, "pct_dropped", "pct_fixed")


@query
def paired_mates(spark, sf):
    docs = inputs.documents(spark, sf, "lang", "source").withColumnRenamed("read_id", "seq_id")
    qual = F.repeat(F.lit("I"), F.length("seq"))
    first = docs.select("seq_id", F.col("lang").alias("name"), "seq", qual.alias("qual"))
    second = docs.select(
        "seq_id", F.when(F.col("lang") == "en", "en").otherwise(F.col("source")).alias("name"),
        reverse_complement(F.col("seq")).alias("seq"), qual.alias("qual"),
    )
    return barcodes.pair_reads(first, second).select(
        "seq_id", "names_differ", F.length("seq1").alias("len1"), F.md5("seq2").alias("seq2_md5")
    )


def _part_pairs(spark, sf):
    text = F.concat("p_name", "p_brand", "p_type")
    return inputs.table(spark, sf, "part").select(
        "p_partkey", letters_as_dna(text).alias("seq1"), text.alias("qual1"),
        reverse_complement(letters_as_dna(text)).alias("seq2"), F.reverse(text).alias("qual2"),
    )


@query
def packed_records(spark, sf):
    record = pack_pair(F.col("seq1"), F.col("qual1"), F.col("seq2"), F.col("qual2"))
    return _part_pairs(spark, sf).select("p_partkey", F.hex(record).alias("record"))


@query
def unpacked_records(spark, sf):
    record = pack_pair(F.col("seq1"), F.col("qual1"), F.col("seq2"), F.col("qual2"))
    rows = _part_pairs(spark, sf).select("p_partkey", unpack_pair(record).alias("p"))
    return rows.select("p_partkey", "p.barcode", "p.seq1", "p.qual1", "p.seq2", "p.qual2")


@query
def linked_read_incidence(spark, sf):
    dna = letters_as_dna(F.col("text"))
    pairs = inputs.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("barcode"), F.col("turn").alias("read"), dna.alias("seq1"),
        reverse_complement(dna).alias("seq2"),
    )
    return incidence.build_incidence(incidence.linked_read_hits(pairs))


# -------------------------------------------------------------------------------- incidence


@query
def barcode_hashes(spark, sf):
    return inputs.order_incidence(spark, sf)


@query
def barcode_totals(spark, sf):
    return incidence.incidence_totals(incidence.code_table(inputs.order_incidence(spark, sf)))


@query
def inverse_totals(spark, sf):
    return incidence.inverse_totals(inputs.order_incidence(spark, sf))


@query
def inverse_lists(spark, sf):
    """Barcodes of every part in the depth range."""
    lists = cluster.carriers(inputs.supplier_incidence(spark, sf), [inputs.PART_RANGE])
    names = F.array_join(F.sort_array("members.barcode"), " ")
    return lists.select("hash", "depth", names.alias("barcodes"))


@query
def hash_ids(spark, sf):
    return incidence.hash_ids(inputs.order_incidence(spark, sf))


@query
def hash_depth_histogram(spark, sf):
    hist = incidence.depth_histogram(inputs.order_incidence(spark, sf))
    return rounded(
        histogram.cumulative(hist).select("bin", "n", "cum_frac", "cum_mass_frac"),
        "cum_frac", "cum_mass_frac",
    )


@query
def hash_depth_stats(spark, sf):
    return histogram.summary(incidence.depth_histogram(inputs.order_incidence(spark, sf)))


@query
def code_size_stats(spark, sf):
    codes = incidence.code_table(inputs.order_incidence(spark, sf))
    return histogram.summary(incidence.code_size_histogram(codes), skip_zero_bin=True)


def _deepest(depths: DataFrame, n: int) -> DataFrame:
    return depths.orderBy(F.desc("depth"), "hash").limit(n).select(F.col("hash").alias("x"))


def _supplier_neighbours(spark, sf, n):
    inc = cut_lineage(inputs.supplier_incidence(spark, sf))
    depths = incidence.hash_depths(inc)
    targets = _deepest(depths, n)
    ranged = incidence.in_range(depths, [inputs.PART_RANGE])
    return inc, depths, targets, incidence.neighbours(inc, ranged, targets)


@query
def hash_neighbours(spark, sf):
    return _supplier_neighbours(spark, sf, 1)[3]


@query
def hash_explore(spark, sf):
    explored = incidence.explore(_supplier_neighbours(spark, sf, 1)[3])
    return explored.withColumn("sample_hashes", F.array_join("sample_hashes", " "))


@query
def hash_double_shared(spark, sf):
    inc, _, targets, near = _supplier_neighbours(spark, sf, 2)
    x1, x2 = (row["x"] for row in targets.collect())
    return incidence.double_shared(near, x1, x2, inc)


@query
def hash_info(spark, sf):
    """Every hundredth part by key, as the command's increment asks for."""
    inc = cut_lineage(inputs.supplier_incidence(spark, sf))
    depths = incidence.hash_depths(inc)
    targets = depths.where(F.col("hash") % 100 == 0).select(F.col("hash").alias("x"))
    ranged = incidence.in_range(depths, [inputs.PART_RANGE])
    in_range = ranged.select(F.col("hash").alias("x"))
    near = incidence.neighbours(inc, ranged, targets.join(in_range, "x", "left_semi"))
    return incidence.hash_info(depths, near, targets)


@query
def share_scan(spark, sf):
    inc = cut_lineage(inputs.supplier_incidence(spark, sf))
    depths = incidence.hash_depths(inc)
    ranged = incidence.in_range(depths, [inputs.PART_RANGE])
    return incidence.share_scan(inc, ranged, incidence.scan_targets(depths, 20, 40))


def _error_scores(spark, sf):
    """Scores of every supplier, whose neighbours are those around the median depth; and these."""
    inc = cut_lineage(inputs.order_supplier_incidence(spark, sf))
    depths = incidence.hash_depths(inc)
    ranged = incidence.in_range(depths, [incidence.middle_range(depths)])
    shares = incidence.share_histogram(inc, ranged, depths.select(F.col("hash").alias("x")))
    scores = incidence.error_scores(shares, depths)
    return incidence.flag_errors(scores, inputs.supplier_crib(spark, sf)), ranged


@query
def error_scores(spark, sf):
    return rounded(_error_scores(spark, sf)[0], "score")


@query
def error_score_summary(spark, sf):
    summary = incidence.score_summary(*_error_scores(spark, sf))
    return rounded(summary, "min_score", "mean_score", "max_score")


# ------------------------------------------------------------------------------------ truth


def _crib(spark, sf):
    return truth.build_crib(
        inputs.document_depths(spark, sf),
        inputs.genome_hits(spark, sf, "en"),
        inputs.genome_hits(spark, sf, "de"),
    )


@query
def crib_classes(spark, sf):
    return _crib(spark, sf)


@query
def crib_labels(spark, sf):
    return _crib(spark, sf).select("hash", incidence.hash_label().alias("label"))


@query
def crib_table(spark, sf):
    return truth.crib_table(_crib(spark, sf))


@query
def crib_stats(spark, sf):
    return rounded(truth.crib_stats(_crib(spark, sf)), "mean_depth")


@query
def crib_presence(spark, sf):
    known = sketchset.prune(inputs.document_set(spark, sf), 2)
    return truth.genome_presence(inputs.genome_hits(spark, sf, "en"), known)


# --------------------------------------------------------------------------------- clusters


def _clusters(spark, sf):
    inc = cut_lineage_packed(inputs.supplier_incidence(spark, sf))
    return inc, cluster.cluster_hashes(inc, [inputs.PART_RANGE])


@query
def cluster_labels(spark, sf):
    _, labels = _clusters(spark, sf)
    return labels.select("barcode", "hash", "i", "raw", "sub")


@query
def cluster_codes(spark, sf):
    _, labels = _clusters(spark, sf)
    return rounded(cluster.code_clusters(labels), "point_to_min")


@query
def cluster_code_summary(spark, sf):
    inc, labels = _clusters(spark, sf)
    return cluster.code_summary(incidence.code_table(inc), labels)


@query
def cluster_sizes(spark, sf):
    _, labels = _clusters(spark, sf)
    return histogram.summary(incidence.code_size_histogram(cluster.code_clusters(labels), "n_sub"))


@query
def cluster_report(spark, sf):
    _, labels = _clusters(spark, sf)
    report = cluster.cluster_report(labels, inputs.part_crib(spark, sf))
    return report.withColumn("others", F.array_join("others", " "))


@query
def cluster_point_density(spark, sf):
    _, labels = _clusters(spark, sf)
    return rounded(cluster.min_point_density(labels), "min_point_density")


def _split(spark, sf):
    inc, labels = _clusters(spark, sf)
    return cluster.split_codes(inc, incidence.code_table(inc), labels)


@query
def cluster_split(spark, sf):
    return _split(spark, sf)[0]


@query
def cluster_split_codes(spark, sf):
    return _split(spark, sf)[1]


@query
def crib_summary(spark, sf):
    rows, codes = _split(spark, sf)
    return rounded(truth.crib_summary(rows, inputs.part_crib(spark, sf), codes), "ratio")


def _explored(spark, sf):
    inc = cut_lineage(inputs.supplier_incidence(spark, sf))
    largest = incidence.code_table(inc).orderBy(F.desc("n_hash"), "barcode").head()["barcode"]
    return cluster.explore_code(
        inc, [inputs.PART_RANGE], inputs.part_crib(spark, sf), largest
    )


@query
def explore_code_clusters(spark, sf):
    return _explored(spark, sf)["labels"].select("barcode", "hash", "i", "raw", "sub")


@query
def explore_code_share(spark, sf):
    return _explored(spark, sf)["share"]


@query
def explore_code_histogram(spark, sf):
    return _explored(spark, sf)["share_histogram"]


# ---------------------------------------------------------------------------------- mapping


def _index(spark, sf):
    return mapping.reference_index(mapping.reference_hits(inputs.references(spark, sf)))


def _queries(spark, sf):
    return inputs.documents(spark, sf).withColumnRenamed("read_id", "query_id")


@query
def reference_index(spark, sf):
    return _index(spark, sf).select(
        "hash", "copy", F.col("place1.ref_id").alias("ref1"), F.col("place1.offset").alias("off1"),
        F.col("place2.ref_id").alias("ref2"), F.col("place2.offset").alias("off2"),
    )


@query
def reference_hits_in_pieces(spark, sf):
    """Pages as references, hashed in pieces of 500 bases."""
    refs = inputs.table(spark, sf, "pages").select(F.col("page_id").alias("ref_id"), letters_as_dna(F.col("html")).alias("seq"))
    return mapping.reference_hits(refs, in_pieces=True, piece_bases=500)


@query
def reference_summary(spark, sf):
    refs = inputs.references(spark, sf)
    hits = mapping.reference_hits(refs)
    return mapping.index_summary(
        mapping.reference_index(hits), hits, mapping.reference_sequences(refs)
    )


@query
def query_summary(spark, sf):
    queries = _queries(spark, sf)
    seeds = mapping.query_seeds(queries, _index(spark, sf))
    return rounded(mapping.query_summary(queries, seeds), "hit_frac")


@query
def query_seed_places(spark, sf):
    return mapping.seed_places(mapping.query_seeds(_queries(spark, sf), _index(spark, sf)))


@query
def query_chains_compat(spark, sf):
    """Against references that are all there twice, so that hits are double-copy."""
    refs = inputs.references(spark, sf)
    twice = refs.unionByName(refs.withColumn("ref_id", F.col("ref_id") + inputs.SECOND_COPY))
    index = mapping.reference_index(mapping.reference_hits(twice))
    _, chains = mapping.map_queries(_queries(spark, sf), index, compat_tail=True)
    return rounded(chains, "density", "copy1_frac")


@query
def query_chains(spark, sf):
    _, chains = mapping.map_queries(_queries(spark, sf), _index(spark, sf))
    return rounded(chains, "density", "copy1_frac")


# --------------------------------------------------------------------------------- overlaps


@query
def read_counts(spark, sf):
    return inputs.readset(spark, sf)[0]


@query
def read_overlaps(spark, sf):
    _, hits, _ = inputs.readset(spark, sf)
    return rounded(overlap.overlaps(hits), "mean_offset", "sd")


@query
def read_report(spark, sf):
    table, hits, _ = inputs.readset(spark, sf)
    return overlap.read_report(table, hits, overlap.overlaps(hits))


@query
def bad_overlap_counts(spark, sf):
    _, hits, _ = inputs.readset(spark, sf)
    return overlap.bad_overlap_counts(overlap.overlaps(hits))


def _flagged(spark, sf, mode="sequential"):
    table, hits, chosen = inputs.readset(spark, sf)
    pairs = cut_lineage(overlap.overlaps(hits))
    return overlap.mark_bad_reads(table, hits, pairs, mode)[0], hits, pairs, chosen


@query
def bad_reads(spark, sf):
    return _flagged(spark, sf)[0].select("read_id", *overlap.FLAGS, "bad")


@query
def bad_reads_frozen(spark, sf):
    return _flagged(spark, sf, "frozen")[0].select("read_id", *overlap.FLAGS, "bad")


@query
def contained_reads(spark, sf):
    flagged, _, pairs, _ = _flagged(spark, sf)
    return overlap.mark_contained(flagged, pairs)


@query
def containment_summary(spark, sf):
    flagged, _, pairs, _ = _flagged(spark, sf)
    return rounded(
        overlap.containment_summary(overlap.mark_contained(flagged, pairs)), "free_avg_len"
    )


@query
def readset_stats(spark, sf):
    stats = overlap.readset_stats(_flagged(spark, sf)[0])
    return rounded(stats, *[c for c, t in stats.dtypes if t == "double"])


@query
def read_hit_gaps(spark, sf):
    _, hits, _ = inputs.readset(spark, sf)
    return overlap.with_gaps(hits).select("read_id", "ord", "pos", "dx")


@query
def read_hit_positions(spark, sf):
    """Positions restored from gaps."""
    _, hits, _ = inputs.readset(spark, sf)
    return overlap.positions_from_gaps(overlap.with_gaps(hits).drop("pos")).select("read_id", "ord", "pos")


@query
def copy_class_stats(spark, sf):
    _, hits, chosen = inputs.readset(spark, sf)
    stats = overlap.class_stats(chosen, hits).withColumn("copy", F.col("copy").cast("int"))
    return rounded(stats, "frac_hit", "frac_hit2", "avg_depth2")


@query
def overlap_hit_pairs(spark, sf):
    """Hit by hit, the overlaps of every read with the read that contains it."""
    flagged, hits, pairs, _ = _flagged(spark, sf)
    contained = overlap.mark_contained(flagged, pairs).where("contained_in is not null")
    return overlap.hit_pairs(
        hits, contained.select(F.col("read_id").alias("x"), F.col("contained_in").alias("y"))
    )


def _assembly(spark, sf):
    """Overlaps of the read with most of them (ties: the lowest id)."""
    _, hits, _ = inputs.readset(spark, sf)
    pairs = cut_lineage(overlap.overlaps(hits))
    counts = pairs.groupBy("x").count().orderBy(F.desc("count"), "x").limit(1).select("x")
    return hits, pairs.join(F.broadcast(counts), "x")


@query
def assembly_hits(spark, sf):
    hits, pairs = _assembly(spark, sf)
    pooled = overlap.pooled_hits(hits, pairs)
    return pooled.select("hash", F.col("copy").cast("int").alias("copy"), "count", "up_count", "pos")


@query
def assembly_summary(spark, sf):
    return rounded(overlap.assembly_summary(overlap.pooled_hits(*_assembly(spark, sf))), "mean_count")


@query
def assembly_support(spark, sf):
    hits, pairs = _assembly(spark, sf)
    return overlap.support_table(overlap.pooled_hits(hits, pairs), overlap.hit_depths(hits))


@query
def assembly_successors(spark, sf):
    hits, pairs = _assembly(spark, sf)
    return overlap.successors(hits, pairs)
