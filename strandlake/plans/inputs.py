"""Inputs of the ready-made queries, derived from the sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import letters_as_dna
from ..functions.packing import word_to_bases
from ..operators import overlap, ranks, sketchset
from ..operators.incidence import CRIB_TYPES, build_incidence
from ..operators.sketch import sketch
from ..session import cut_lineage

# Parameters of the ready-made queries.
COPY_LEVELS = (2, 50, 100)
CODE_FACTOR = 2654435761
PART_RANGE = (10, 60)
#: Added to the numbers of references that are there a second time.
SECOND_COPY = 1_000_000
#: Lines of a split of :func:`fastq_lines`; no multiple of the lines of a record.
SPLIT_LINES = 997


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out where a scan has fewer splits than there are cores; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """``(read_id, *keep, seq)``."""
    rows = table(spark, sf_dir, "documents").select("doc_id", *keep, "text")
    return spread(rows).select(
        F.col("doc_id").alias("read_id"), *keep, letters_as_dna(F.col("text")).alias("seq")
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark")
    return rows.select(F.col("item_id").alias("ref_id"), letters_as_dna(F.col("text")).alias("seq"))


def fastq_lines(spark: SparkSession, sf_dir: str, wrap: int | None = None) -> DataFrame:
    """``(file, block, value)``: documents as the lines of one FASTQ file, dealt over splits that cut records anywhere.

    Qualities are made of marks that also start headers and plus lines. With ``wrap``, sequences are cut into lines of so many
    bases, and qualities into lines of ten less.
    """
    return as_fastq_lines(documents(spark, sf_dir, "lang"), wrap)


def as_fastq_lines(reads: DataFrame, wrap: int | None = None) -> DataFrame:
    """The same of ``reads(read_id, lang, seq)``."""
    def lines_of(size: int | None) -> Column:
        return F.lit(1) if size is None else F.greatest(F.ceil(F.length("seq") / size), F.lit(1))

    def cut(column: Column, size: int | None) -> Column:
        if size is None:
            return F.array(column)
        return F.split(F.regexp_replace(column, f"(.{{{size}}})(?=.)", "$1\n"), "\n")

    # the reads are numbered by their first lines, and travel as the lines they have in a split
    n = lines_of(wrap) + lines_of(wrap and wrap - 10) + 2
    n = n if wrap is None else F.when(F.col("seq").isNull(), 0).otherwise(n)
    rows = ranks.running_sum(cut_lineage(reads.select("read_id", "lang", "seq", n.cast("bigint").alias("n"))), "read_id", "n", "first")
    header = F.concat(F.lit("@"), F.col("read_id"), F.lit(" "), F.coalesce("lang", F.lit("")))
    qual = cut(F.translate("seq", "ACGT", "@+I5"), wrap and wrap - 10)
    rows = rows.where("n > 0").select(F.concat(F.array(header), cut(F.col("seq"), wrap), F.array(F.lit("+")), qual).alias("parts"), "first", "n")

    def in_split(block: Column) -> Column:
        start = F.greatest(F.col("first"), block * SPLIT_LINES)
        end = F.least(F.col("first") + F.col("n"), (block + 1) * SPLIT_LINES)
        values = F.slice("parts", (start - F.col("first") + 1).cast("int"), (end - start).cast("int"))
        return F.struct(block.alias("block"), start.alias("line"), values.alias("values"))

    blocks = F.sequence(F.floor(F.col("first") / SPLIT_LINES), F.floor((F.col("first") + F.col("n") - 1) / SPLIT_LINES))
    pieces = rows.select(F.inline(F.transform(blocks, in_split)))
    dealt = pieces.repartition("block").sortWithinPartitions("block", "line")
    return dealt.select(F.lit("documents").alias("file"), "block", F.explode("values").alias("value"))


def titled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(read_id, name, desc, seq)``."""
    return documents(spark, sf_dir, "lang").select("read_id", F.col("read_id").cast("string").alias("name"), F.col("lang").alias("desc"), "seq")


def fasta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(in_file, seq_id, value)``: documents as the records of one FASTA file, with their own texts as sequences."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    numbered = ranks.grouped_rank(rows, [], ["doc_id"], "seq_id")
    header = F.concat(F.when(F.col("seq_id") == 1, ">").otherwise(""), F.col("doc_id"), F.lit(" "), F.coalesce("lang", F.lit("")))
    return numbered.select((F.col("seq_id") - 1).alias("in_file"), "seq_id", F.concat_ws("\n", header, "text").alias("value"))


def document_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketchset.count_sequences(documents(spark, sf_dir))


def classed_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketchset.set_copy(document_set(spark, sf_dir), *COPY_LEVELS)


def language_sets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """One sketch set per language; the documents are sketched once for all of them."""
    counted = cut_lineage(
        sketch(documents(spark, sf_dir, "lang"), ["lang"])
        .groupBy("lang", "hash")
        .agg(F.count("*").alias("depth"), F.lit(0).cast("tinyint").alias("copy"))
    )
    return {
        lang: sketchset.set_copy(counted.where(F.col("lang") == lang).drop("lang"), *COPY_LEVELS)
        for lang in ("de", "en", "es", "fr")
    }


def readset(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read table, known hits and sketch set of the documents, which are sketched once; the hits are written once with their
    copy classes."""
    sampled = cut_lineage(sketch(documents(spark, sf_dir), ["read_id"]))
    chosen = cut_lineage(sketchset.set_copy(sketchset.count_hits(sampled), *COPY_LEVELS))
    every = cut_lineage(overlap.with_copy(sampled, chosen))
    # a base for each letter: lengths need no bases
    letters = F.regexp_replace("text", "[^A-Za-z]", "").alias("seq")
    lengths = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("read_id"), letters)
    return overlap.read_table(lengths, every), overlap.known_hits(every), chosen


def order_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small barcodes: orders carry parts."""
    return build_incidence(
        table(spark, sf_dir, "lineitem").select(
            F.col("l_orderkey").alias("barcode"), F.col("l_partkey").alias("hash"),
            F.col("l_linenumber").alias("read"),
        )
    )


def supplier_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large barcodes: suppliers carry parts, each read an order."""
    return build_incidence(
        table(spark, sf_dir, "lineitem").select(
            F.col("l_suppkey").alias("barcode"), F.col("l_partkey").alias("hash"),
            F.col("l_orderkey").alias("read"),
        )
    )


def order_supplier_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small barcodes that share often: orders carry suppliers."""
    return build_incidence(
        table(spark, sf_dir, "lineitem").select(
            F.col("l_orderkey").alias("barcode"), F.col("l_suppkey").alias("hash"),
            F.col("l_linenumber").alias("read"),
        )
    )


def _class_of(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in CRIB_TYPES]), (number % 5 + 1).cast("int"))


def part_crib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth classes of parts, made up from their size and key."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("hash"), _class_of(F.col("p_size")).alias("type"),
        (F.col("p_size") % 7 + 1).cast("int").alias("chr"),
        (F.col("p_partkey") % 100).cast("int").alias("pos"),
    )


def supplier_crib(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("hash"), _class_of(F.col("s_nationkey")).alias("type")
    )


def user_barcode(user: Column) -> Column:
    """A 16-mer for each user number."""
    return word_to_bases(user * F.lit(CODE_FACTOR) % F.lit(4**16))


def barcoded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reads that start with the barcode of their user, misread at one or two bases."""
    rows = table(spark, sf_dir, "events").select("event_id", user_barcode(F.col("user_id")).alias("code"))
    event = F.col("event_id")
    base = F.substring(F.lit("ACGT"), (F.floor(event / 16) % 4 + 1).cast("int"), F.lit(1))
    once = F.overlay("code", base, (event % 16 + 1).cast("int"), F.lit(1))
    twice = F.when(
        event % 7 == 0, F.overlay(once, base, ((event + 5) % 16 + 1).cast("int"), F.lit(1))
    ).otherwise(once)
    return rows.select("event_id", twice.alias("seq1"))


def customer_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("line_no"), user_barcode(F.col("c_custkey")).alias("barcode")
    )


def genome_hits(spark: SparkSession, sf_dir: str, lang: str) -> DataFrame:
    """The documents of one language as a genome with one chromosome each."""
    docs = documents(spark, sf_dir, "lang").where(F.col("lang") == lang)
    return sketch(docs, ["read_id"]).select("hash", (F.col("read_id") + 1).alias("chr"), "pos")


def document_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_set(spark, sf_dir).select("hash", F.col("depth").cast("bigint").alias("depth"))
