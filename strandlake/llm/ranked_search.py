"""The best documents of every item of a list, ranked by the terms they share: hybrid of term- and document-at-a-time.

Terms are runs of digits, letters and everything beyond ASCII, A-Z in lower case. A term's weight in a document grows with
its occurrences there and falls with the length of the document and with the number of documents that hold the term; all of
it is integer arithmetic (``contributions``). A document's score is the sum over the terms of an item, once each.

1. ``corpus_statistics`` counts documents, terms, and the documents of each term of the items, in one scan; tasks count before
   anything is shuffled.
2. A second scan ranks. A task inverts its documents, a segment of bounded size at a time, into postings
   lists of the items' terms. For each item the short lists are summed into accumulators, term at a time. These
   then stand beside the long lists as one more list with a bound of its own, and all are read document at a time
   in blocks of ``BLOCK`` documents: a block whose bounds add up to no more than the score that the item's
   list of best documents asks for so far is skipped without being read.
3. Tasks return no more than ``top`` documents for each item, and these are merged in two steps. No postings are shuffled.

Items are taken in blocks of about ``BLOCK_TERMS`` terms, so that what a task looks up has a bound; each block is two
scans of the documents, and usually there is one.

Every row of the documents is a document, and every row of the items is an item. Rows that repeat an id or a text are ranked
like any other. Equal scores go by ascending id, nulls last, then in any order. Null texts have no terms; a document without a
term is not counted, an item without one has no rows. Empty tables give no rows. A very long document is a segment of its
own. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SALTS, map_batches, text_bytes

TOP = 10
BLOCK_TERMS = 1_000_000
#: Documents of a block that is read or skipped.
BLOCK = 64
#: Lists of one document in so many, or fewer, are summed before.
SHORT = 64

_SEGMENT_ROWS = 16_384
_SEGMENT_TERMS = 1 << 22
#: A-Z in lower case; blanks between terms.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_NO_ID = 1 << 63  # above any id


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def contributions(weights: np.ndarray, tf: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a posting adds to a score; all 64-bit integers, rounding down."""
    m = 100 - 90 + (90 * sizes * n_docs) // n_terms
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _item_blocks(items: DataFrame, id_col: str, text_col: str, block_terms: int):
    """Lists of ``(item id, terms)``, one for each block."""

    def cut(batches):
        for batch in batches:
            terms = [sorted({t.decode() for t in terms_of(text)}) for text in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.string()))], names=["id", "terms"])

    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = map_batches(rows, cut, f"id {rows.schema['id'].dataType.simpleString()}, terms array<string>").where("size(terms) > 0")
    n = max(1, -(-(found.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms))
    block = F.pmod(F.xxhash64("id", "terms"), F.lit(n))
    for i in range(n):
        yield [(r.id, [t.encode() for t in r.terms]) for r in found.where(block == i).collect()]


def corpus_statistics(rows: DataFrame, numbers: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each numbered term."""
    size = len(numbers)

    def count(batches):
        df = np.zeros(size + 2, np.int64)
        for batch in batches:
            for text in text_bytes(batch.column(1)):
                terms = terms_of(text)
                df[size] += bool(terms)
                df[size + 1] += len(terms)
                df[[numbers[t] for t in numbers.keys() & set(terms)]] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "n"])

    total = np.zeros(size + 2, np.int64)
    counted = map_batches(rows, count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    for row in counted.collect():  # a row for each term of the block
        total[row.term] = row.n
    return int(total[size]), int(total[size + 1]), total[:size]


class _Segment:
    """Postings lists of some documents."""

    def __init__(self, found: list[np.ndarray], sizes: list[int], weights: np.ndarray, n_docs: int, n_terms: int):
        self.n = len(found)
        doc = np.repeat(np.arange(self.n), [len(f) for f in found])
        key, tf = np.unique(np.concatenate(found).astype(np.int64) * self.n + doc, return_counts=True)
        term, self.doc = key // self.n, key % self.n
        self.value = contributions(weights[term], tf, np.array(sizes, np.int64)[self.doc], n_docs, n_terms)
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        self.lists = dict(zip(term[starts].tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(term)], strict=True), strict=True))
        self.blocks = -(-self.n // BLOCK)
        self.long: dict[int, tuple] = {}

    def _long_list(self, term: int):
        """Documents, values, where each block begins, and the bound of each block."""
        if term not in self.long:
            a, b = self.lists[term]
            doc, value = self.doc[a:b], self.value[a:b]
            bound = np.zeros(self.blocks, np.int64)
            np.maximum.at(bound, doc // BLOCK, value)
            self.long[term] = doc, value, np.searchsorted(doc, np.arange(self.blocks + 1) * BLOCK), bound
        return self.long[term]

    def best(self, terms: list[int], least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores that may be among the best: those above or at ``least``, and the best ``top`` of them at least."""
        mine = sorted((t for t in terms if t in self.lists), key=lambda t: self.lists[t][1] - self.lists[t][0])
        short = [t for t in mine if (self.lists[t][1] - self.lists[t][0]) * SHORT <= self.n]
        score = np.zeros(self.n, np.int64)
        for t in short:  # term at a time
            a, b = self.lists[t]
            score[self.doc[a:b]] += self.value[a:b]
        bound = np.zeros(self.blocks * BLOCK, np.int64)
        bound[:self.n] = score
        bound = bound.reshape(-1, BLOCK).max(axis=1)
        long = [self._long_list(t) for t in mine[len(short):]]
        for *_, more in long:
            bound = bound + more
        # document at a time: blocks with the highest bounds first, until no other can reach what is asked for
        order = np.argsort(-bound, kind="stable")
        docs, scores, at = [], [], 0
        while at < len(order):
            some = order[at:at + max(1, len(order) // 4)]
            some = np.sort(some[bound[some] >= max(least, 1)])
            if not len(some):
                break
            at += max(1, len(order) // 4)
            for doc, value, begins, _ in long:
                take = _ranges(begins[some], begins[some + 1])
                score[doc[take]] += value[take]
            here = _ranges(some * BLOCK, np.minimum(some * BLOCK + BLOCK, self.n))
            here = here[score[here] >= max(least, 1)]
            docs.append(here)
            scores.append(score[here])
            if sum(map(len, scores)) >= top:
                every = np.concatenate(scores)
                least = max(least, int(np.partition(every, len(every) - top)[len(every) - top]))
        if not docs:
            return score[:0], score[:0]
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        keep = scores >= max(least, 1)
        return docs[keep], scores[keep]


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the half-open ranges, one range after the other."""
    size = end - begin
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _rank(items, numbers: dict[bytes, int], weights: np.ndarray, n_docs: int, n_terms: int, top: int):
    """A function that ranks the documents of a task for each item: ``(item, id, score)``."""
    item_terms = [[numbers[t] for t in terms] for _, terms in items]

    def rank(batches):
        # of each item the best so far, the worst first: (score, -id)
        best: list[list[tuple]] = [[] for _ in items]
        found, sizes, ids, held = [], [], [], 0

        def end_segment():
            nonlocal held
            if held:
                segment = _Segment(found, sizes, weights, n_docs, n_terms)
                for heap, terms in zip(best, item_terms, strict=True):
                    docs, scores = segment.best(terms, heap[0][0] if len(heap) == top else 1, top)
                    for d, score in zip(docs.tolist(), scores.tolist(), strict=True):
                        entry = score, -(_NO_ID if ids[d] is None else ids[d])
                        if len(heap) < top:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
            found.clear(), sizes.clear(), ids.clear()
            held = 0

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                terms = terms_of(text)
                known = np.array([n for n in map(numbers.get, terms) if n is not None], np.int32)
                if len(known):
                    found.append(known), sizes.append(len(terms)), ids.append(key)
                    held += len(known)
                    if len(found) >= _SEGMENT_ROWS or held >= _SEGMENT_TERMS:
                        end_segment()
        end_segment()
        ranked = [(item, score, id_) for item, heap in enumerate(best) for score, id_ in heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in ranked], pa.int64()), pa.array([None if r[2] == -_NO_ID else -r[2] for r in ranked], pa.int64()),
             pa.array([r[1] for r in ranked], pa.int64())], names=["item", "id", "score"],
        )

    return rank


def _highest(rows: DataFrame, by: tuple[str, ...], top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``(item_col, rank, id_col, score)``: the ``top`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = items.schema[item_col].dataType.simpleString()
    result = spark.createDataFrame([], f"{item_col} {kind}, rank int, {id_col} bigint, score bigint")
    for block in _item_blocks(items, item_col, item_text_col, block_terms):
        if not block:
            continue
        numbers = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        n_docs, n_terms, df = corpus_statistics(rows, numbers)
        weights = np.array([weight(n_docs, n) for n in df.tolist()], np.int64)
        ranked = map_batches(rows, _rank(block, numbers, weights, n_docs, n_terms, top), "item bigint, id bigint, score bigint")
        # the best of some tasks, then those of all
        ranked = ranked.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        ranked = _highest(_highest(ranked, ("item", "part"), top).select("item", "id", "score"), ("item",), top)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item bigint, name {kind}")
        named = ranked.join(F.broadcast(names), "item").select(
            F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score"
        )
        result = result.unionByName(named)
    return result
