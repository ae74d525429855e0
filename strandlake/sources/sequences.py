"""FASTA and FASTQ as tables ``(seq_id, name, desc, seq[, qual])``; gzip is read transparently."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import IUPAC, dna_text_ambiguous
from . import fastq
from .lines import numbered

# Wrapped line length of written records, and the first character of the quality scale.
LINE_BASES = 60
QUALITY_ZERO = 33


def _name(header: Column) -> Column:
    return F.regexp_extract(header, r"^(\S*)", 1)


def _desc(header: Column) -> Column:
    return F.regexp_extract(header, r"^\S*\s+(.*)$", 1)


def sniff(spark: SparkSession, path: str) -> str:
    """``fasta`` or ``fastq``, from the first character."""
    first = spark.read.text(path).select(F.substring("value", 1, 1).alias("c")).head(1)
    if not first:
        raise ValueError(f"{path} is empty")
    kinds = {">": "fasta", "@": "fastq"}
    if first[0]["c"] not in kinds:
        raise ValueError(f"{path} is neither FASTA nor FASTQ")
    return kinds[first[0]["c"]]


def read_fasta(
    spark: SparkSession,
    paths: str | Sequence[str],
    convert: Callable[[Column], Column] = dna_text_ambiguous,
    invalid: str = "drop",
) -> DataFrame:
    """Multi-line FASTA; ``convert`` cleans the sequence and drops what it does not know.

    A first record without a header has an empty name; empty records are kept. ``invalid="fail"``
    raises on characters outside the nucleotide alphabet.
    """
    return fasta_reads(numbered(spark, paths, "\n>"), convert, invalid)


def fasta_reads(
    records: DataFrame, convert: Callable[[Column], Column] = dna_text_ambiguous, invalid: str = "drop"
) -> DataFrame:
    """``(seq_id, name, desc, seq)`` of ``records(in_file, seq_id, value)``, texts that were split before each ``>``."""
    if invalid not in ("drop", "fail"):
        raise ValueError(f"unknown handling {invalid!r}")
    headless = (F.col("in_file") == 0) & ~F.col("value").startswith(">")
    text = F.when(headless, F.concat(F.lit("\n"), F.col("value"))).otherwise(
        F.regexp_replace("value", "^>", "")
    )
    header = F.substring_index(F.col("text"), "\n", 1)
    body = F.regexp_replace(F.substring(F.col("text"), F.length("header") + 2, F.length("text")), r"\s", "")
    split = (
        records.withColumn("text", text).withColumn("header", header).withColumn("body", body)
    )
    seq = convert(F.col("body"))
    if invalid == "fail":
        bad = F.upper("body").rlike(f"[^{IUPAC}-]")
        message = F.concat(F.lit("bad character in sequence "), F.col("header"))
        seq = F.when(bad, F.raise_error(message)).otherwise(seq)
    trimmed = F.regexp_replace("header", r"\r$", "")
    return split.select(
        "seq_id", _name(trimmed).alias("name"), _desc(trimmed).alias("desc"), seq.alias("seq")
    )


def split_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(file, block, value)``: lines with the split they stand in."""
    rows = spark.read.text(paths if isinstance(paths, str) else list(paths))
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def fastq_reads(records: DataFrame, strict: bool = True, fixed_length: int | None = None) -> DataFrame:
    """``(seq_id, name, desc, seq, qual)`` from records of :mod:`fastq`."""
    if fixed_length is not None:
        fits = F.length("seq") == fixed_length
        message = F.concat(F.lit("bad record "), F.col("rec").cast("string"), F.lit(" in "), F.col("file"))
        if strict:
            records = records.withColumn("seq", F.when(fits | F.col("seq").isNull(), F.col("seq")).otherwise(F.raise_error(message)))
        else:
            records = records.where(fits)
    header = F.substring(F.col("header"), F.lit(2), F.length("header"))
    return records.select("seq_id", _name(header).alias("name"), _desc(header).alias("desc"), "seq", "qual")


def read_fastq(
    spark: SparkSession,
    paths: str | Sequence[str],
    strict: bool = True,
    fixed_length: int | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """FASTQ of four lines a record, or of ``multi_line`` ones. ``strict`` raises on a record that breaks the format, otherwise
    it is dropped; multi-line files are always strict.

    ``fixed_length`` demands that every read has that many bases.
    """
    lines = split_lines(spark, paths)
    records = fastq.multi_line_records(lines) if multi_line else fastq.four_line_records(lines, strict)
    return fastq_reads(records, strict, fixed_length)


def phred(qual: Column) -> Column:
    """Quality values of a quality string."""
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - QUALITY_ZERO)


def read_sequences(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """FASTA or FASTQ, whichever each of ``paths`` holds, without qualities.

    Record numbers run on over all files: first over those in FASTA, then over those in FASTQ.
    """
    kinds: dict[str, list[str]] = {"fasta": [], "fastq": []}
    for path in [paths] if isinstance(paths, str) else paths:
        kinds[sniff(spark, path)].append(path)
    fasta = read_fasta(spark, kinds["fasta"]) if kinds["fasta"] else None
    fastq = read_fastq(spark, kinds["fastq"]).drop("qual") if kinds["fastq"] else None
    if fasta is None or fastq is None:
        return fastq if fasta is None else fasta
    last = fasta.agg(F.coalesce(F.max("seq_id"), F.lit(0)).alias("last"))
    moved = fastq.crossJoin(F.broadcast(last)).withColumn("seq_id", F.col("seq_id") + F.col("last"))
    return fasta.unionByName(moved.drop("last"))


def _wrapped(column: str) -> Column:
    return F.regexp_replace(column, f"(.{{{LINE_BASES}}})(?=.)", "$1\n")


def _title(mark: str) -> Column:
    desc = F.when(F.coalesce("desc", F.lit("")) == "", "").otherwise(F.concat(F.lit(" "), F.col("desc")))
    return F.concat(F.lit(mark), F.col("name"), desc)


def fasta_text() -> Column:
    """A record of ``name``, ``desc`` and ``seq``, its lines wrapped."""
    return F.concat_ws("\n", _title(">"), _wrapped("seq"))


def fastq_text() -> Column:
    """A record of ``name``, ``desc``, ``seq`` and ``qual``, four lines."""
    return F.concat_ws("\n", _title("@"), F.col("seq"), F.lit("+"), F.col("qual"))


def write_fasta(df: DataFrame, path: str, compression: str = "none") -> None:
    df.select(fasta_text().alias("value")).write.option("compression", compression).text(path)


def write_fastq(df: DataFrame, path: str, compression: str = "none") -> None:
    df.select(fastq_text().alias("value")).write.option("compression", compression).text(path)


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, barcode)``, one 16-mer per line; another length is an error."""
    return whitelist(numbered(spark, path))


def whitelist(lines: DataFrame) -> DataFrame:
    """``(line_no, barcode)`` of ``lines(seq_id, value)``; empty lines are none."""
    lines = lines.select(
        F.col("seq_id").alias("line_no"), F.upper(F.trim("value")).alias("barcode")
    ).where(F.col("barcode") != "")
    message = F.concat(F.lit("bad barcode line "), F.col("line_no").cast("string"))
    good = F.when(F.length("barcode") == 16, F.col("barcode")).otherwise(F.raise_error(message))
    return lines.select("line_no", good.alias("barcode"))


def read_score_table(spark: SparkSession, path: str) -> DataFrame:
    """``(a, b, score)`` of a substitution matrix: comments after ``#``, a line of symbols, then rows.

    The file is one small document, read whole.
    """
    lines = F.filter(
        F.transform(F.split("value", "\n"), lambda s: F.trim(F.regexp_replace(s, "#.*", ""))),
        lambda s: s != "",
    )
    table = spark.read.text(path, wholetext=True).select(lines.alias("lines"))
    heads = table.select(F.posexplode(F.split(F.element_at("lines", 1), r"\s+")).alias("col", "b"))
    cells = table.select(F.explode(F.slice("lines", 2, F.size("lines"))).alias("line")).select(
        F.split("line", r"\s+").alias("cell")
    )
    scores = cells.select(
        F.element_at("cell", 1).alias("a"),
        F.posexplode(F.slice("cell", 2, F.size("cell"))).alias("col", "score"),
    )
    return scores.join(F.broadcast(heads), "col").select("a", "b", F.col("score").cast("int"))
