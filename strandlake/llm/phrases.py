"""Benchmark decontamination over a positional inverted index of the documents.

Words: A-Z in lower case, runs of digits, letters and everything beyond ASCII. A window is ``WINDOW``
consecutive words of a test item; an item with fewer words, but not none, is one window.

1. ``term_counts``: how often the terms of the test items occur in all documents. A task counts before
   anything is shuffled.
2. ``rare_terms``: the terms of every window, rarest first. The rarest is its anchor.
3. ``postings``: the index, ``(doc_id, text_key, pos, term)``. It holds every occurrence of an anchor and every
   test term within a window's length of one; other occurrences lie in no occurrence of any window. It is
   written once and serves all windows.
4. ``phrase_matches``: the anchor's postings, moved back by its offset, give the possible starts of a window; these
   are intersected with the postings of the next rarest terms, each moved by its offset, one term at a time
   while lists are long, then all the rest at once. What remains are the exact occurrences.

``proximity_matches`` finds all places where two terms stand within a distance, in any order, from complete lists of both;
decontamination does not use it.

Test items are taken in blocks of at most ``BLOCK_WINDOWS`` distinct windows, so that the terms a task looks up
have a fixed bound; each block is one pass over the documents, and all rows take part in every block.

Rows are told apart by id and a hash of the text. Rows that repeat both are answered alike; null texts and ids
are allowed (no words; a row of their own). Null or wordless items never match; items that repeat an id are one
item. Very long documents cost memory in proportion to one document. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_batches, salt, text_bytes

WINDOW = 10
BLOCK_WINDOWS = 50_000
#: How many of the rarest terms are intersected one at a time.
ONE_BY_ONE = 2

_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_KEYS = ["doc_id", "text_key"]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LETTERS).split()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")
    )


def item_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text"):
    """``(item_id, window, terms)``: one row for each different window of an item; ``window`` is a hash."""

    def cut(batches):
        for batch in batches:
            ids, windows = [], []
            for item, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                words = words_of(text)
                found = {tuple(words[i:i + window]) for i in range(max(1, len(words) - window + 1))} if words else ()
                ids += [item] * len(found)
                windows += [[w.decode() for w in terms] for terms in sorted(found)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(windows, pa.list_(pa.string()))], names=["item_id", "terms"]
            )

    rows = items.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text"))
    cuts = map_batches(rows, cut, "item_id bigint, terms array<string>")
    return cuts.withColumn("window", F.md5(F.array_join("terms", " "))).distinct()


def _blocks(windows: DataFrame, block_windows: int) -> list[DataFrame]:
    """``(window, terms)``, dealt into blocks; usually there is one."""
    distinct = windows.select("window", "terms").distinct()
    n = max(1, -(-distinct.count() * 5 // (block_windows * 4)))  # a fifth below the bound on average
    block = F.pmod(F.xxhash64("window"), F.lit(n))
    return [distinct.where(block == i) for i in range(n)]


def _term_numbers(windows: DataFrame) -> dict[bytes, int]:
    """The terms of one block, at most ``WINDOW`` for each window."""
    rows = windows.select(F.explode("terms").alias("term")).distinct().collect()
    return {term.encode(): i for i, term in enumerate(sorted(r.term for r in rows))}


def _found(text: bytes | None, numbers: dict[bytes, int]) -> tuple[int, np.ndarray]:
    words = words_of(text)
    known = np.fromiter((numbers.get(w, -1) for w in words), np.int64, len(words))
    return len(words), known


def term_counts(rows: DataFrame, numbers: dict[bytes, int]) -> np.ndarray:
    """Occurrences of each numbered term."""
    size = len(numbers)

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                known = _found(text, numbers)[1]
                total += np.bincount(known[known >= 0], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    counted = map_batches(rows.select("text"), count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    result = np.zeros(size, np.int64)
    for row in counted.collect():
        result[row.term] = row.n
    return result


def rare_terms(windows: DataFrame, numbers: dict[bytes, int], counts: np.ndarray):
    """``(window, offset, term, rank)`` with rank 0 for the rarest, as rows of Python, and the anchors."""
    rows, anchors = [], set()
    for window, terms in windows.select("window", "terms").collect():
        known = [(int(counts[numbers[t.encode()]]), numbers[t.encode()], i) for i, t in enumerate(terms)]
        if min(known)[0] == 0:
            continue  # a term that no document has
        ranked = sorted(known)
        anchors.add(ranked[0][1])
        rows += [(window, offset, term, rank) for rank, (_, term, offset) in enumerate(ranked)]
    return rows, anchors


def postings(rows: DataFrame, numbers: dict[bytes, int], anchors: set[int], window: int = WINDOW) -> DataFrame:
    """``(doc_id, text_key, pos, term, anchor)``; a document without any has none."""
    is_anchor = np.zeros(len(numbers) + 1, bool)  # the last is for words that are no term
    is_anchor[sorted(anchors)] = True

    def index(batches):
        for batch in batches:
            parts = []
            for i, text in enumerate(text_bytes(batch.column(2))):
                known = _found(text, numbers)[1]
                at = np.flatnonzero(is_anchor[known])
                if not len(at):
                    continue
                edges = np.zeros(len(known) + 1, np.int64)
                np.add.at(edges, np.maximum(at - window + 1, 0), 1)
                np.add.at(edges, np.minimum(at + window, len(known)), -1)
                near = np.flatnonzero((np.cumsum(edges[:-1]) > 0) & (known >= 0))
                parts.append((np.full(len(near), i), near, known[near]))
            if not parts:
                continue
            row, pos, term = (np.concatenate(p) for p in zip(*parts, strict=True))
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(pos), pa.array(term),
                 pa.array(is_anchor[term])],
                names=[*_KEYS, "pos", "term", "anchor"],
            )

    return map_batches(
        rows, index, "doc_id bigint, text_key bigint, pos bigint, term bigint, anchor boolean"
    )


def _same(left: str, right: str, *columns: str) -> Column:
    both = F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id"))
    for name in ("text_key", *columns):
        both = both & (F.col(f"{left}.{name}") == F.col(f"{right}.{name}"))
    return both


def phrase_matches(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """``(doc_id, text_key, window, start, size)`` of every occurrence of a window."""
    sizes = ranked.groupBy("window").agg(F.count("*").alias("size"))
    firsts = ranked.where("rank = 0").select("window", "offset", "term").join(sizes, "window")
    # an anchor that very many documents share is dealt over the salts
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    dealt = index.where("anchor").withColumn("salt", (salt("doc_id", "pos") % 8).cast("int"))
    starts = dealt.join(firsts, ["term", "salt"]).select(
        *_KEYS, "window", "size", (F.col("pos") - F.col("offset")).alias("start")
    ).where("start >= 0")
    places = index.select(*_KEYS, "pos", "term")
    wanted = ranked.select("window", "rank", "offset", "term")
    for rank in range(1, ONE_BY_ONE + 1):
        step = wanted.where(F.col("rank") == rank).select("window", "offset", "term")
        moved = starts.join(F.broadcast(step), "window", "left").withColumn("pos", F.col("start") + F.col("offset"))
        short = moved.where("term IS NULL").select(*starts.columns)
        longer = moved.where("term IS NOT NULL").alias("m")
        met = longer.join(places.alias("p"), _same("m", "p", "pos", "term"), "left_semi")
        starts = met.select(*starts.columns).unionByName(short)
    rest = wanted.where(F.col("rank") > ONE_BY_ONE).groupBy("window").agg(
        F.collect_list(F.struct("offset", "term")).alias("rest")  # at most WINDOW
    )
    starts = starts.join(F.broadcast(rest), "window", "left")
    done = starts.where("rest IS NULL").drop("rest")
    open_ = starts.where("rest IS NOT NULL").withColumn("r", F.explode("rest")).select(
        *_KEYS, "window", "size", "start", (F.col("start") + F.col("r.offset")).alias("pos"),
        F.col("r.term").alias("term"),
    )
    met = open_.alias("m").join(places.alias("p"), _same("m", "p", "pos", "term"), "left_semi")
    # rows that repeat id and text are met more than once
    whole = met.groupBy(*_KEYS, "window", "size", "start").agg(F.size(F.collect_set("pos")).alias("n"))
    whole = whole.where(F.col("n") == F.col("size") - 1 - ONE_BY_ONE).drop("n")
    return done.unionByName(whole).distinct()


def proximity_matches(
    docs: DataFrame, pairs: list[tuple[str, str]], distance: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, text_key, first, second, pos, other)``: all places of two terms at most ``distance`` words apart, in any order.

    The index has every occurrence of the terms of ``pairs``, which are words in lower case. Positions meet by document and
    stretch of positions, so that a frequent term of a long document is dealt over its stretches. A term paired with itself
    gives each two of its places once, the earlier first. Rows that repeat id and text are one.
    """
    numbers = {t.encode(): i for i, t in enumerate(sorted({t for pair in pairs for t in pair}))}
    index = postings(_keyed(docs, id_col, text_col), numbers, set(numbers.values()), window=1)
    index = index.select(*_KEYS, "pos", "term").distinct()
    wanted = [(a, b, numbers[a.encode()], numbers[b.encode()]) for a, b in pairs]
    wanted = docs.sparkSession.createDataFrame(wanted, "first string, second string, term bigint, then bigint")
    stretch = F.floor(F.col("pos") / (distance + 1))
    ones = index.join(F.broadcast(wanted), "term").withColumn("stretch", stretch)
    others = index.select(
        *_KEYS, F.col("term").alias("then"), F.col("pos").alias("other"), F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch")
    )
    met = ones.alias("o").join(others.alias("p"), _same("o", "p", "then", "stretch"))
    apart = F.col("p.other") - F.col("o.pos")
    near = (F.abs(apart) <= distance) & ((F.col("o.term") != F.col("o.then")) | (apart > 0))
    return met.where(near).select("o.doc_id", "o.text_key", "first", "second", "pos", "other")


def _word_counts(batches):
    for batch in batches:
        sizes = [len(words_of(t)) for t in text_bytes(batch.column(2))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=[*_KEYS, "n_words"]
        )


def occurrences(
    rows: DataFrame, windows: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """``phrase_matches`` of all blocks of ``windows`` in ``rows(doc_id, text_key, text)``."""
    spark = rows.sparkSession
    matches = None
    for block in _blocks(windows, block_windows):
        numbers = _term_numbers(block)
        ranked, anchors = rare_terms(block, numbers, term_counts(rows, numbers))
        if not ranked:
            continue
        index = cut_lineage(postings(rows, numbers, anchors, window))
        ranked = spark.createDataFrame(ranked, "window string, offset int, term bigint, rank int")
        found = phrase_matches(index, ranked)
        matches = found if matches is None else matches.unionByName(found)
    empty = "doc_id bigint, text_key bigint, window string, size bigint, start bigint"
    return cut_lineage(spark.createDataFrame([], empty) if matches is None else matches)


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` for every row of ``docs``."""
    rows = _keyed(docs, id_col, text_col)
    windows = cut_lineage(item_windows(items, window))
    found = occurrences(rows, windows, window, block_windows)
    places = found.select(*_KEYS, F.explode(F.expr("sequence(start, start + size - 1)")).alias("pos"))
    hits = places.distinct().groupBy(*_KEYS).agg(F.count("*").alias("n_hit"))
    matched = found.select(*_KEYS, "window").distinct()
    matched = matched.join(windows.select("window", "item_id"), "window").select(*_KEYS, "item_id").distinct()
    names = F.sort_array(F.collect_list(F.col("item_id").cast("string")))  # bounded by the test items
    matched = matched.groupBy(*_KEYS).agg(F.count("*").alias("n_items"), F.array_join(names, ",").alias("items"))
    found = hits.alias("h").join(matched.alias("i"), _same("h", "i")).select(
        "h.doc_id", "h.text_key", "n_hit", "n_items", "items"
    )
    counted = map_batches(rows, _word_counts, "doc_id bigint, text_key bigint, n_words bigint")
    zero = F.lit(0).cast("bigint")
    return counted.alias("c").join(found.alias("f"), _same("c", "f"), "left").select(
        "c.doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` without any occurrence of a window."""
    found = occurrences(_keyed(docs, id_col, text_col), cut_lineage(item_windows(items, window)), window)
    dirty = found.select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__gone_key")).distinct()
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col("__gone")) & (F.xxhash64(text_col) == F.col("__gone_key"))
    return docs.join(dirty, same, "left_anti")
