"""FASTQ records from lines that are dealt over splits, by composing parser states.

``lines(file, block, value)`` has the lines of each split (``block`` orders the splits of a ``file``) consecutive and in order
within a partition, as the text reader gives them. One scan finds the records of every split under each state in which
the split before may have left the parser; an ordered scan of one row for each split then tells the state it did
leave; and only lines at the borders of splits move.

* Records of four lines: the state is how many lines of a record are open, 0 to 3. Every run of four lines that looks like a
  record is kept with the number of its first line; the lines in the splits before tell which of the four phases is right.
* Records of many lines (sequence up to a line that starts with ``+`` and repeats the name or none, then as many quality
  characters as bases): a line
  that starts with ``@`` may be a header or quality. Each such line leads to the next header, or to an error. Where the ways
  from the first ``STARTS`` lines that begin a whole record and lead to the end of the split have met, a record starts. The lines before it
  go to the record that the splits before left open, and must complete it exactly there; anything else is an error.

What the scan found is written once (``cut_lineage``), so that files are read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Possible first headers of a split whose ways must have met.
STARTS = 8
#: Lines at the border of a split that move as one row.
PIECE_LINES = 500

_AT, _PLUS = ord("@"), ord("+")
#: Letters, gaps, and white space.
_BASES = r"^[A-Za-z*.\s-]*$"
_KEY = ["file", "block"]
_FIELDS = ["kind", "at", "header", "seq", "plus", "qual"]
_SCHEMA = "file string, block bigint, kind string, at bigint, header string, seq string, plus string, qual string"


def _first_bytes(lines: pa.Array) -> np.ndarray:
    """The first byte of each line, 0 for an empty one."""
    code = pc.binary_slice(lines.cast(pa.large_binary()), 0, 1).cast(pa.large_binary())
    sizes = pc.binary_length(code).to_numpy(zero_copy_only=False)
    found = np.zeros(len(lines), np.uint8)
    found[sizes > 0] = np.frombuffer(b"".join(code.to_pylist()), np.uint8)
    return found


def _sizes(lines: pa.Array) -> np.ndarray:
    return pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)


def _rows(key: tuple, kind: str, at: np.ndarray, *columns: pa.Array) -> pa.RecordBatch:
    """Rows of one split; missing columns are null."""
    n = len(at)
    texts = [c.cast(pa.string()) for c in columns] + [pa.nulls(n, pa.string())] * (4 - len(columns))
    arrays = [pa.repeat(pa.scalar(v, kind_of), n) for v, kind_of in ((key[0], pa.string()), (key[1], pa.int64()), (kind, pa.string()))]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(at, pa.int64()), *texts], names=[*_KEY, *_FIELDS])


def _splits(batches: Iterator[pa.RecordBatch]):
    """``(key, lines)`` of each split."""
    key, held = None, []
    for batch in batches:
        files, blocks, values = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).cast(pa.large_string())
        if not batch.num_rows:
            continue
        names = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new = np.flatnonzero((blocks[1:] != blocks[:-1]) | (names[1:] != names[:-1])) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
            here = files[a].as_py(), int(blocks[a])
            if key is not None and here != key:
                yield key, pa.concat_arrays(held)
                held = []
            key = here
            held.append(values[a:b])
    if key is not None:
        yield key, pa.concat_arrays(held)


def _four(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, lines in _splits(batches):
        n, first, size = len(lines), _first_bytes(lines), _sizes(lines)
        j = np.arange(max(0, n - 3))
        good = (first[j] == _AT) & (first[j + 2] == _PLUS) & (size[j + 1] == size[j + 3])
        at = j[good]
        yield _rows(key, "record", at, *(lines.take(pa.array(at + i)) for i in range(4)))
        # of each phase the first that is no record
        bad = np.array([b[0] for p in range(4) if len(b := np.flatnonzero(~good[p::4]) * 4 + p)], np.int64)
        yield _rows(key, "bad", bad)
        edge = np.unique(np.concatenate([np.arange(min(3, n)), np.arange(max(0, n - 3), n)]))
        yield _rows(key, "line", edge, lines.take(pa.array(edge)))
        yield _rows(key, "split", np.array([n]))


def four_line_records(lines: DataFrame, strict: bool = True) -> DataFrame:
    """``(file, rec, seq_id, header, seq, plus, qual)``; ``rec`` counts in the file from 0, ``seq_id`` over all files from 1.

    ``strict`` raises on lines that are no record, otherwise they are dropped.
    """
    found = cut_lineage(lines.select(*_KEY, "value").mapInArrow(_four, _SCHEMA))
    splits = found.where("kind = 'split'").select(*_KEY, F.col("at").alias("n"))
    here = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(here), F.lit(0)))
    files = splits.groupBy("file").agg(F.ceil(F.sum("n") / 4).alias("recs"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("recs").over(earlier), F.lit(0)).alias("base"))
    placed = found.where("kind <> 'split'").join(splits, _KEY).withColumn("line", F.col("before") + F.col("at"))
    rec = F.floor(F.col("line") / 4).alias("rec")
    texts = ["header", "seq", "plus", "qual"]
    phase = (F.col("line") % 4).alias("phase")
    whole = placed.where((F.col("kind") != "line") & (F.col("line") % 4 == 0)).select("file", rec, phase, *texts)
    # records that lie across a border, put together from the lines there
    ends = F.col("before") + F.col("n")
    open_ = placed.where("kind = 'line'").where((rec * 4 < F.col("before")) | (rec * 4 + 4 > ends))
    parts = [F.max(F.when(F.col("line") % 4 == i, F.col("header"))).alias(t) for i, t in enumerate(texts)]
    joined = open_.groupBy("file", rec).agg(F.lit(0).cast("bigint").alias("phase"), *parts)
    good = F.coalesce(
        F.col("header").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("qual")), F.lit(False)
    )
    both = whole.unionByName(joined).join(files, "file")
    if strict:
        message = F.concat(F.lit("bad record "), F.col("rec").cast("string"), F.lit(" in "), F.col("file"))
        # filters may be tried before that of the phase: rows of another are no error
        seq = F.when(F.col("phase") != 0, F.lit(None)).when(good, F.col("seq")).otherwise(F.raise_error(message))
        both = both.withColumn("seq", seq)
    else:
        both = both.where(good)
    return both.select("file", "rec", (F.col("base") + F.col("rec") + 1).alias("seq_id"), *texts)


def _ways(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each line, as a header: the line of the next header (the number of lines: the split ends first; -1: no record),
    and the line with the plus."""
    n, first, size = len(lines), _first_bytes(lines), _sizes(lines)
    up_to = np.append(0, np.cumsum(size))

    def next_of(mark: np.ndarray) -> np.ndarray:
        where = np.append(np.flatnonzero(mark), n)
        return where[np.searchsorted(where, np.arange(n + 1))]

    after = np.minimum(np.arange(n) + 1, n)
    plus = next_of(first == _PLUS)[after]
    bases = up_to[plus] - up_to[after]
    begins = up_to[np.minimum(plus + 1, n)]
    end = np.searchsorted(up_to, begins + bases)  # lines up to here hold the qualities
    exact = (plus < n) & (end <= n)
    exact[exact] = up_to[end[exact]] == (begins + bases)[exact]
    # sequences have no other characters, and a plus line has no other name
    odd = np.append(0, np.cumsum(~pc.match_substring_regex(lines, _BASES).to_numpy(zero_copy_only=False)))
    fits = (odd[plus] == odd[after]) & (first == _AT)
    heads = np.flatnonzero(fits & (plus < n))
    for j in heads[size[plus[heads]] > 1].tolist():
        again = lines[int(plus[j])].as_py()[1:].split(maxsplit=1)
        fits[j] = not again or again[0] == "".join(lines[j].as_py()[1:].split(maxsplit=1)[:1])
    # an empty record has an empty line of qualities
    then = next_of(size > 0)[np.minimum(np.maximum(end, plus + 1), n)]
    way = np.where(exact, then, np.where((plus < n) & (end <= n), -1, n))
    lead = np.append(first, _AT)
    return np.where(fits & (way >= 0) & (lead[way] == _AT), way, -1), plus


def _certain(way: np.ndarray) -> int:
    """Where the ways from the first possible headers have met; the number of lines if nowhere."""
    way = way.tolist()
    n = len(way)
    leads = [to >= 0 for to in way] + [True]
    for j in range(n - 1, -1, -1):
        if leads[j]:
            leads[j] = leads[way[j]]
    # a line after which no record ends within the split says nothing
    starts = [j for j in range(n) if leads[j] and way[j] < n][:STARTS]
    at = starts[0] if starts else n
    for other in starts[1:]:
        while at != other:
            at, other = (way[at], other) if at < other else (at, way[other])
    return at


def _record_rows(key: tuple, kind: str, lines: pa.Array, heads: list[int], way: np.ndarray, plus: np.ndarray) -> pa.RecordBatch:
    values = lines.to_pylist() if heads else []
    seq = ["".join(values[j + 1:plus[j]]) for j in heads]
    qual = ["".join(values[plus[j] + 1:way[j]]) for j in heads]
    return _rows(
        key, kind, np.arange(len(heads)), pa.array([values[j] for j in heads], pa.string()), pa.array(seq, pa.string()),
        pa.array([values[plus[j]] for j in heads], pa.string()), pa.array(qual, pa.string()),
    )


def _piece_rows(key: tuple, kind: str, lines: pa.Array, first: int) -> pa.RecordBatch:
    """Rows of up to ``PIECE_LINES`` lines each, and the number of the first."""
    at = np.arange(0, len(lines), PIECE_LINES)
    offsets = pa.array(np.append(at, len(lines)), pa.int32())
    pieces = pc.binary_join(pa.ListArray.from_arrays(offsets, lines.cast(pa.string())), "\n")
    return _rows(key, kind, first + at, pieces)


def _many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, lines in _splits(batches):
        n = len(lines)
        way, plus = _ways(lines)
        at = start = _certain(way)
        heads = []
        while at < n and way[at] < n:
            heads.append(at)
            at = int(way[at])
        yield _record_rows(key, "record", lines, heads, way, plus)
        yield _piece_rows(key, "head", lines[:start], 0)
        yield _piece_rows(key, "tail", lines[at:], at)
        yield _rows(key, "split", np.array([len(heads)]), pa.array(["certain" if start < n else "open"]))


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines ``(file, group, value)`` of the borders, in order: all of them are records."""
    for key, lines in _splits(batches):
        full = np.flatnonzero(_sizes(lines) > 0)
        if not len(full):
            continue
        lines = lines[int(full[0]):]
        n = len(lines)
        way, plus = _ways(lines)
        # the last record ends with the lines
        whole = [0]
        while 0 <= way[whole[-1]] < n:
            whole.append(int(way[whole[-1]]))
        if way[whole[-1]] < 0 or not _complete(lines, whole[-1], int(plus[whole[-1]])):
            raise ValueError(f"{key[0]}: no certain record after split {key[1]}, at {lines[whole[-1]].as_py()!r}")
        yield _record_rows(key, "border", lines, whole, way, plus)


def _complete(lines: pa.Array, head: int, plus: int) -> bool:
    size = _sizes(lines)
    return plus < len(lines) and size[head + 1:plus].sum() == size[plus + 1:].sum()


def multi_line_records(lines: DataFrame) -> DataFrame:
    """``(file, rec, seq_id, header, seq, plus, qual)`` of records whose sequences and qualities may be cut into lines.

    Raises on anything else, and on a plus line that names another record.
    """
    found = cut_lineage(lines.select(*_KEY, "value").mapInArrow(_many, _SCHEMA))
    in_file = Window.partitionBy("file").orderBy("block")
    splits = found.where("kind = 'split'").select(*_KEY, F.col("at").alias("n"), (F.col("header") == "certain").cast("int").alias("certain"))
    splits = splits.withColumn("group", F.sum("certain").over(in_file))
    # a head belongs to the record that was open before its split, a tail to the one that is open after it
    group = F.when(F.col("kind") == "tail", F.col("group")).otherwise(F.col("group") - F.col("certain"))
    edges = found.where("kind IN ('head', 'tail')").join(splits, _KEY).select("file", group.alias("group"), "block", "kind", "at", "header")
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["file", "group", "block", "kind", "at"]
    dealt = edges.repartition(parts, "file", "group").sortWithinPartitions(*order)
    edge_lines = dealt.select("file", F.col("group").alias("block"), F.explode(F.split("header", "\n")).alias("value"))
    borders = cut_lineage(edge_lines.mapInArrow(_borders, _SCHEMA))
    # records in order: those of a split, then those across its end
    counts = borders.groupBy("file", F.col("block").alias("group")).agg(F.count("*").alias("across"))
    # lines before the first certain record of a file are those of a group 0
    zero = splits.select("file").distinct().select(
        "file", F.lit(-1).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("certain"), F.lit(0).cast("bigint").alias("group")
    )
    firsts = splits.select(*_KEY, "n", "certain", "group").unionByName(zero).join(counts, ["file", "group"], "left").select(
        *_KEY, "group", "certain", "n", F.when(F.col("certain") == 1, F.coalesce("across", F.lit(0))).otherwise(0).alias("across")
    )
    total = F.col("n") + F.col("across")
    here, over_all = (
        Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        for by, order in ((["file"], ["block"]), ([F.lit(0)], ["file", "block"]))
    )
    firsts = firsts.select(
        *_KEY, "group", "certain", "n", F.coalesce(F.sum(total).over(here), F.lit(0)).alias("rec0"),
        F.coalesce(F.sum(total).over(over_all), F.lit(0)).alias("id0"),
    )
    texts = ["header", "seq", "plus", "qual"]
    core = found.where("kind = 'record'").join(firsts, _KEY).select("file", "rec0", "id0", "at", *texts)
    sure = firsts.where("certain = 1").select("file", "group", (F.col("rec0") + F.col("n")).alias("rec0"), (F.col("id0") + F.col("n")).alias("id0"))
    across = borders.withColumnRenamed("block", "group").join(sure, ["file", "group"]).select("file", "rec0", "id0", "at", *texts)
    both = core.unionByName(across)
    return both.select("file", (F.col("rec0") + F.col("at")).alias("rec"), (F.col("id0") + F.col("at") + 1).alias("seq_id"), *texts)
