"""Token counts without ids: pieces are counted once for each distinct pre-token.

A pre-token is a run without ASCII white space, at which the word-level tokenizer always ends a word, with A-Z in lower
case, as the tokenizer has it, and without the full stop or comma after its last letter, which is one of its own.

1. ``vocabulary``: every distinct pre-token of all texts with its number of occurrences (tasks count before the
   shuffle), and the number of pieces, which is found once for each.
2. ``count_tokens``: per document the frequencies of its pre-tokens are joined to these piece counts and summed. The
   ``HEAD`` most frequent pre-tokens, a fixed number, are broadcast and joined within the task, so that no common word
   is shuffled; every other pre-token goes through a shuffle join.

Documents are told apart by id and a hash of the text; rows that repeat both are answered alike. Null texts count as
empty: no bytes, no tokens. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_batches, text_bytes
from .packing import load_tokenizer

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
HEAD = 200_000

_COUNTED_AT_ONCE = 500_000
_END_MARK = re.compile(rb"(?<=[A-Za-z])([.,])(?=\s)")


def pre_tokens(text: bytes | None) -> list[bytes]:
    if not text:
        return []
    if b"<|" not in text:  # a special string counts as it is written
        text = text.lower()
    return _END_MARK.sub(rb" \1", text).split()


def _occurrences(batches):
    """Pre-tokens of a task with their counts, given out before they fill the memory."""
    def rows():
        result = pa.RecordBatch.from_arrays(
            [pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"]
        )
        seen.clear()
        return result

    seen: Counter[bytes] = Counter()
    for batch in batches:
        for text in text_bytes(batch.column(0)):
            seen.update(pre_tokens(text))
            if len(seen) > _COUNTED_AT_ONCE:
                yield rows()
    yield rows()


def vocabulary(docs: DataFrame, tokenizer: str = TOKENIZER, text_col: str = "text") -> DataFrame:
    """``(word, n, pieces)`` of every distinct pre-token."""

    def count(batches):
        encode = load_tokenizer(tokenizer).encode_batch
        for batch in batches:
            words = [w.decode() for w in batch.column(0).to_pylist()]
            sizes = [len(e) for at in range(0, len(words), 1024)
                     for e in encode(words[at:at + 1024], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["word", "n", "pieces"]
            )

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    found = map_batches(texts, _occurrences, "word binary, n bigint")
    return map_batches(found.groupBy("word").agg(F.sum("n").alias("n")), count, "word binary, n bigint, pieces bigint")


def _most_frequent(words: DataFrame, most: int) -> DataFrame:
    """Words above a frequency that fewer than ``most`` reach; an eighth of a doubling is one step."""
    words = words.withColumn("step", F.floor(F.log2("n") * 8))
    steps = {r.step: r.n for r in words.groupBy("step").agg(F.count("*").alias("n")).collect()}  # at most 512
    least, total = max(steps, default=0) + 1, 0
    for step in sorted(steps, reverse=True):
        total += steps[step]
        if total > most:
            break
        least = step
    return words.where(F.col("step") >= least)


def _frequencies(rows: DataFrame, head) -> DataFrame:
    """A row for each document with what the head gives, and one for each other pre-token in it."""

    def split(batches):
        known = head.value
        for batch in batches:
            row, word, n, tokens, size = [], [], [], [], []
            for i, text in enumerate(text_bytes(batch.column(2))):
                text = text or b""
                total = 0
                for w, times in Counter(pre_tokens(text)).items():
                    pieces = known.get(w)
                    if pieces is None:
                        row.append(i)
                        word.append(w)
                        n.append(times)
                        tokens.append(None)
                        size.append(None)
                    else:
                        total += pieces * times
                row.append(i)
                word.append(b" %d" % (i % 997))  # meets no pre-token, as it has a space, and is no hot key
                n.append(0)
                tokens.append(total)
                size.append(len(text))
            taken = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(word, pa.binary()),
                 pa.array(n, pa.int64()), pa.array(tokens, pa.int64()), pa.array(size, pa.int64())],
                names=["id", "text_key", "word", "n", "tokens", "n_bytes"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, split, f"id {kind}, text_key bigint, word binary, n bigint, tokens bigint, n_bytes bigint")


def count_tokens(
    docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD
) -> DataFrame:
    """``(id_col, n_bytes, n_tokens)`` of every row of ``docs``."""
    words = cut_lineage(vocabulary(docs, tokenizer, text_col))
    common = _most_frequent(words, head).select("word", "pieces").toArrow()
    known = dict(zip(common.column("word").to_pylist(), common.column("pieces").to_pylist(), strict=True))
    known = docs.sparkSession.sparkContext.broadcast(known)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    parts = _frequencies(rows, known).join(words.select("word", "pieces"), "word", "left")
    totals = parts.groupBy("id", "text_key").agg(
        F.sum(F.coalesce(F.col("n") * F.col("pieces"), "tokens")).alias("tokens"),
        F.max("n_bytes").alias("n_bytes"),
        F.count("tokens").cast("int").alias("rows"),
    )
    # the totals of rows that repeat id and text hold each of them
    each = totals.withColumn("row", F.explode(F.expr("array_repeat(1, rows)")))
    return each.select(
        F.col("id").alias(id_col), "n_bytes", F.expr("tokens div rows").alias("n_tokens")
    )
