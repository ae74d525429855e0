"""Words grouped with their spelling variants, by a frontier of states over a trie that is a table of edges.

Words are counted over all texts (tasks count before the shuffle). Two words are near if one inserted, deleted or replaced
character makes one of the other. The *form* of a word is its most frequent near word, if that is at least twice as
frequent; its *root* is reached by following forms.

1. ``edges`` is the trie: ``(node, label, child, nexts, near, near_n)``. A node is the hash of a prefix; ``label`` leads from
   ``node`` to ``child``; ``nexts`` are the characters that follow the child, ``near`` the word that ends there. Labels have one
   character up to depth ``STEPS`` and then reach to the next power of two, so that the levels of very long words are
   few. Each word also goes in backwards, into a trie of its own.
2. ``near_pairs`` moves a frontier of states ``(word, position, node, edits)`` one edge at a time: an equal label keeps the
   number of edits, and a first difference is taken for a replaced character, or one that the word lacks. A state
   that has ended a word with one edit is a pair. Pairs are looked for in one direction only: the shorter word finds the
   longer, and of two equally long ones the lower finds the higher.
3. Of two near words either the first or the last half is equal, so a frontier starts at the middle of the word, in the
   forward or in the backward trie: no node near a root, where very many states would meet, is ever entered.
   A node has as many edges as the alphabet has letters, whatever the input, up to depth ``STEPS``.
4. Pairs are verified by their edit distance, so that equal hashes do no harm. Roots come by doubling pointers; every
   form is at least twice as frequent, so six doublings reach all.

Null texts have no words; a null id is the text ``null``. Repeated rows count again; empty tables have no words; ties go to
the lowest word in code-point order. A very long word takes memory in proportion to its length times the depth of powers
of two. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_batches, text_bytes

LEAST_CHARS = 5
LEAST_TIMES = 3
#: One run in so many loses a character.
EDITED = 97
#: A form is at least so many times as frequent.
RATIO = 2
#: Depths up to here have labels of one character.
STEPS = 32

_COUNTED_AT_ONCE = 300_000
#: Bytes of the letters of a run, in lower case; other bytes become blanks.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b == 0xC3 or 0x80 <= b <= 0xBF else 32 for b in range(256))
_OTHER_LEADS = re.compile(rb"[\xC2\xC4-\xFF]")
_RUN = re.compile(rb"(?:[a-z]|\xC3[\x80-\xBF])+")


def runs_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case."""
    if not text:
        return []
    if _OTHER_LEADS.search(text):
        return _RUN.findall(text.lower())
    return text.translate(_LETTERS).split()


def _without_one(run: bytes, number: int) -> bytes:
    letters = run.decode()
    at = number % len(letters)
    return (letters[:at] + letters[at + 1:]).encode()


def _count_batches(batches):
    """Words of a task, given out before they fill the memory. Runs below the least length in bytes are never words."""

    def rows():
        words = pa.array(list(seen), pa.binary()).cast(pa.string())
        result = pa.RecordBatch.from_arrays([words, pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        seen.clear()
        return result

    seen: Counter[bytes] = Counter()
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
            start = crc32(f"{key}:".encode())
            for run, times in Counter(run for run in runs_of(text) if len(run) >= LEAST_CHARS).items():
                number = crc32(run, start)
                seen[run if number % EDITED else _without_one(run, number)] += times
            if len(seen) > _COUNTED_AT_ONCE:
                yield rows()
    yield rows()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_times: int = LEAST_TIMES) -> DataFrame:
    """``(word, n)`` of the words that are long and frequent enough."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(key.alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = map_batches(rows, _count_batches, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= least_times) & (F.char_length("word") >= LEAST_CHARS))


def _stop(depth: str) -> str:
    """The deepest end of a label at ``depth`` or before."""
    return f"if({depth} <= {STEPS}, {depth}, cast(shiftleft(1L, cast(floor(log2({depth})) AS int)) AS int))"


def _oriented(words: DataFrame) -> DataFrame:
    """``(side, w, n, size, middle)``: every word forwards (side 0) and backwards."""
    both = words.select("n", F.posexplode(F.array("word", F.reverse("word"))).alias("side", "w"))
    sized = both.withColumn("size", F.char_length("w"))
    return sized.withColumn("middle", F.expr("cast((size + side) div 2 AS int)"))


def _node(depth: str) -> F.Column:
    return F.expr(f"xxhash64(side, left(w, {depth}))")


def edges(words: DataFrame) -> DataFrame:
    """The trie of ``words(word, n)``, from the depths on where a frontier can start."""
    first = _stop("greatest(middle - 1, 0)")
    ends = f"filter(sequence({first}, size), d -> d = size OR d <= {STEPS} OR (d & (d - 1)) = 0)"
    paths = _oriented(words).withColumn("ends", F.expr(ends))
    steps = paths.select("*", F.posexplode(F.slice("ends", F.lit(2), F.size("ends"))).alias("step", "to"))
    steps = steps.withColumn("at", F.expr("ends[step]"))
    over = F.col("to") == F.col("size")
    rows = steps.select(
        _node("at").alias("node"), F.expr("substr(w, at + 1, to - at)").alias("label"), _node("to").alias("child"),
        F.expr("substr(w, to + 1, 1)").alias("next"), F.when(over, F.col("w")).alias("near"), F.when(over, F.col("n")).alias("near_n"),
    )
    return rows.groupBy("node", "label", "child").agg(
        F.array_join(F.collect_set("next"), "").alias("nexts"), F.max("near").alias("near"), F.max("near_n").alias("near_n")
    )


def _moved(frontier: DataFrame, trie: DataFrame) -> DataFrame:
    """The frontier one edge further; ``near`` is set where a state has ended a word with one edit."""
    here = f"substr(w, p + 1, m)"
    same = F.expr(f"{here} = label")
    met = frontier.join(trie.withColumnRenamed("child", "to").withColumn("m", F.char_length("label")), "node")
    met = met.where((F.col("edits") == 0) | same)
    replaced = f"p + m <= size AND {here} < label AND levenshtein({here}, label, 1) = 1"
    lacking = "p + m - 1 <= size AND levenshtein(substr(w, p + 1, m - 1), label, 1) = 1"
    # a state after the edge: where in the word it stands, and its edits; -1 if there is none
    ways = F.when(same, F.expr("array(struct(p + m AS p, edits AS edits))")).otherwise(F.expr(
        f"array(struct(if({replaced}, p + m, -1) AS p, 1 AS edits), struct(if({lacking}, p + m - 1, -1) AS p, 1 AS edits))"
    ))
    after = met.select("side", "w", "n", "size", F.col("to").alias("node"), "nexts", "near", "near_n", F.explode(ways).alias("way"))
    after = after.select("*", "way.p", "way.edits").where("p >= 0")
    ended = F.expr("p = size AND edits = 1")
    goes_on = F.expr("edits = 0 OR (p < size AND instr(nexts, substr(w, p + 1, 1)) > 0)")
    after = after.where(goes_on | (ended & F.col("near").isNotNull()))
    return after.select(
        "side", "w", "n", "size", "node", "p", "edits",
        F.when(ended, F.col("near")).alias("near"), F.when(ended, F.col("near_n")).alias("near_n"),
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """``(word, near, near_n)``: every pair of near words of ``words(word, n)``, both ways round, once."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the trie is dealt out once; each level moves the frontier only
    trie = cut_lineage(edges(words).repartition(parts, "node").sortWithinPartitions("node"))
    start = _oriented(words).withColumn("p", F.expr(_stop("middle")))
    frontier = start.select("side", "w", "n", "size", _node("p").alias("node"), "p", F.lit(0).alias("edits"))
    found = None
    while True:
        moved = cut_lineage(_moved(frontier, trie))
        if moved.isEmpty():
            break
        ended = moved.where("near IS NOT NULL").select("side", "w", "n", "near", "near_n")
        found = ended if found is None else found.unionByName(ended)
        frontier = moved.where("near IS NULL").drop("near", "near_n")
    if found is None:
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    forward = [F.expr(f"if(side = 0, {c}, reverse({c}))") for c in ("w", "near")]
    pairs = found.select(forward[0].alias("word"), "n", forward[1].alias("near"), "near_n")
    pairs = pairs.where(F.levenshtein("word", "near", 1) == 1)
    back = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.unionByName(back).select("word", "near", "near_n").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of every word of ``forms(word, form)``; a form that is not in ``forms`` ends the way."""
    at = cut_lineage(forms.select("word", F.col("form").alias("root")))
    for _ in range(6):
        above = at.select(F.col("word").alias("root"), F.col("root").alias("above"))
        moved = cut_lineage(at.join(above, "root", "left"))
        at = moved.select("word", F.coalesce("above", "root").alias("root"))
        if moved.where("above IS NOT NULL").isEmpty():
            break
    return at


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word."""
    words = cut_lineage(word_counts(docs, id_col, text_col))
    near = near_pairs(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    best_n = -F.col("best.less")
    rows = words.join(near, "word", "left").withColumn("large", best_n >= ratio * F.col("n"))
    rows = cut_lineage(rows.select(
        "word", F.when(F.col("large"), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("large"), best_n).alias("form_n"),
    ))
    roots = _roots(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
