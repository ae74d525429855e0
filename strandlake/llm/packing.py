"""Best-two-fit packing of token sequences.

``token_pieces`` turns each text into ids and an end id; only longer documents are cut, into pieces of ``capacity``
ids of which the first may be shorter. ``best_two_fit`` plans the bins from the number of pieces of each length,
at most ``capacity`` numbers whatever the input:

* fill a bin greedily, always with the longest piece that fits;
* then replace its shortest piece with the two unpacked pieces that fill the widened gap best, if they leave less
  room than the one did;
* repeat the same bin for as long as there are pieces for it. Each step uses a length up to its last few
  pieces, so the plan has a few thousand kinds of bins at any scale.

``pack`` ranks the pieces of each length in parts (a length may hold a third of all pieces) and looks the place of
each rank up in the plan. No piece meets another in one task, and no piece is left out.

Ids equal those of the tokenizer on the whole text: texts are cut before single spaces between other characters,
where the byte-level tokenizer always starts a new pre-token, and the ids of such chunks are remembered. Null texts
count as empty: one piece with the end id. Rows that repeat an id get their own places. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_batches

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
PARTS = 1024

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: What makes a cut before each single space doubtful.
_ODD_SPACE = ["  ", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]
_REMEMBERED = 600_000
_NOT_LATIN = "\u0250"
_LONGEST_REMEMBERED = 64
_CHARS_AT_ONCE = 1 << 21
_RANK_BITS = 44


def load_tokenizer(name: str):
    """A tokenizer of the public vocabulary files, or of any path, that uses one thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(name if os.sep in name else public_tokenizers.path(name))


def _chunks(text: str) -> list[str]:
    """Keys of chunks of which none shares a pre-token with the next.

    A key is what stands after one space or, if it begins with a new line, what stands after that: the start of a text,
    or what comes after a new line or before a mark.
    """
    odd = text[0] == " " or text[-1] == " " or any(map(text.__contains__, _ODD_SPACE))
    first, *rest = _CUT.split(text) if odd else text.split(" ")
    rest.insert(0, "\n" + first)
    return rest


def _parts(key: str) -> list[str]:
    """A key by the keys of the lines and end marks in it, if that is where pre-tokens end; shared by more texts."""
    start, *lines = key[1:].split("\n") if key[0] == "\n" else key.split("\n")
    keys = ["\n" + start if key[0] == "\n" else start]
    for line in lines:
        keys += ["\n\n", "\n" + line]
    if lines and any(not x or x[0].isspace() or x[-1].isspace() for x in (start, *lines)):
        return [key]
    parts = []
    for x in keys:
        if len(x) > 2 and x[-1] in ".," and x[-2].isalpha():
            parts += [x[:-1], "\n" + x[-1]]
        else:
            parts.append(x)
    return parts


def _ranks(tokenizer) -> dict[bytes, int] | None:
    """Tokens as bytes with their ids, if ids and merges of a byte-level vocabulary come in one order."""
    model = json.loads(tokenizer.to_str())["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}  # the byte-level alphabet: other bytes follow from 256 on
    letters.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)})
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(made) or any(c not in letters for token in model["vocab"] for c in token):
        return None
    return {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}


def _key_encoder(tokenizer) -> Callable[[list[str]], list[bytes]]:
    """Ids of keys. Where the vocabulary's ranks give its merges, Latin keys take the library that works on ranks."""
    quick = None
    if ranks := _ranks(tokenizer):
        import public_tokenizers
        import tiktoken

        quick = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
    special = {t.content[0] for t in tokenizer.get_added_tokens_decoder().values()}

    packers = [struct.Struct(f"<{n}I").pack for n in range(65)]

    def encode(keys: list[str]) -> list[bytes]:
        coded = []
        for key in keys:
            text = key[1:] if key[0] == "\n" else " " + key
            if quick and (text.isascii() or max(text) < _NOT_LATIN) and special.isdisjoint(text):
                ids = quick(text)
            else:
                ids = tokenizer.encode(text, add_special_tokens=False).ids
            coded.append(packers[len(ids)](*ids) if len(ids) < 65 else np.array(ids, "<u4").tobytes())
        return coded

    return encode


def id_encoder(tokenizer) -> Callable[[list[str]], list[bytes]]:
    """Little-endian 32-bit ids of each text."""
    known: dict[str, bytes] = {}
    encode_keys = _key_encoder(tokenizer)

    def encode(texts: list[str]) -> list[bytes]:
        if len(known) > _REMEMBERED:
            known.clear()
        cut = [_chunks(text) if text else [] for text in texts]
        new = {key for keys in cut for key in keys} - known.keys()
        made = {
            key: parts for key in new if (key[-1] in ".,\n" or "\n" in key) and len(parts := _parts(key)) > 1
        }
        plain = new - made.keys() | {part for parts in made.values() for part in parts} - known.keys()
        plain = list(plain)
        known.update(zip(plain, encode_keys(plain), strict=True))
        for key, parts in made.items():
            known[key] = b"".join(map(known.__getitem__, parts))
        coded = [b"".join(map(known.__getitem__, keys)) for keys in cut]
        for key in [*plain, *made]:
            if len(key) > _LONGEST_REMEMBERED:
                del known[key]
        return coded

    return encode


def _grouped(texts: list[str], most: int = _CHARS_AT_ONCE):
    """Runs of texts with about ``most`` characters."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def token_pieces(
    docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)`` and, if asked for, ``ids``."""
    width = 4 * capacity
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        encode = id_encoder(load_tokenizer(tokenizer))
        for batch in batches:
            row, number, start, length, crc, ids = [], [], [], [], [], []
            at = 0
            for texts in _grouped([t or "" for t in batch.column(1).to_pylist()]):
                for coded in encode(texts):
                    coded += end
                    begin, stop, piece = 0, len(coded) % width or min(len(coded), width), 0
                    while begin < len(coded):
                        part = coded[begin:stop]
                        row.append(at)
                        number.append(piece)
                        start.append(begin // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                        begin, stop, piece = stop, stop + width, piece + 1
                    at += 1
            columns = {
                "id": batch.column(0).take(pa.array(row, pa.int64())), "piece": pa.array(number, pa.int32()),
                "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return map_batches(rows, cut, schema + ", ids array<int>" * with_ids)


def _longest(left: list[int], used: dict[int, int], at_most: int) -> int:
    """The longest length with a piece that is not used yet; 0 if there is none."""
    for size in range(at_most, 0, -1):
        if left[size] > used.get(size, 0):
            return size
    return 0


def _best_two(left: list[int], used: dict[int, int], gap: int, above: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum in ``(above, gap]``."""
    free = [s for s in range(1, min(gap, len(left) - 1) + 1) if left[s] > used.get(s, 0)]
    best, pair = above, None
    low, high = 0, len(free) - 1
    while low <= high:
        total = free[low] + free[high]
        if total > gap:
            high -= 1
            continue
        twice = low != high or left[free[low]] - used.get(free[low], 0) > 1
        if total > best and twice:
            best, pair = total, (free[high], free[low])
        low += 1
    return pair


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Kinds of bins and how many there are of each, for ``counts[length]`` pieces."""
    left = [0] * (capacity + 1)
    for size, n in counts.items():
        left[size] = n
    plan = []
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return plan
        used: dict[int, int] = {}
        gap = capacity
        while size := _longest(left, used, min(gap, top)):
            used[size] = used.get(size, 0) + 1
            gap -= size
        if gap and sum(used.values()) > 1:
            small = min(used)
            without = {**used, small: used[small] - 1}
            # the replaced piece must not come back as one of the two
            if pair := _best_two(left, {**without, small: left[small]}, gap + small, small):
                used = without
                for size in pair:
                    used[size] = used.get(size, 0) + 1
        used = {size: n for size, n in used.items() if n}
        times = min(left[size] // n for size, n in used.items())
        for size, n in used.items():
            left[size] -= n * times
        plan.append(([s for s in sorted(used, reverse=True) for _ in range(used[s])], times))


def _places(plan: list[tuple[list[int], int]]):
    """Of each run of ranks of a length: its first rank (with the length above), bin and offset."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for sizes, times in plan:
        offset = 0
        for size in sizes:
            rank = taken.get(size, 0)
            rows.append(((size << _RANK_BITS) + rank, base, offset))
            taken[size] = rank + times
            offset += size
        base += times
    rows.sort()
    return tuple(np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``(id, piece, start, length, ids_crc32)``."""
    counts = {r["length"]: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    first, bins, offsets = _places(best_two_fit(counts, capacity))

    def place(batches):
        for batch in batches:
            key = (batch.column("length").to_numpy() << _RANK_BITS) + batch.column("rank").to_numpy()
            run = np.searchsorted(first, key, side="right") - 1
            fields = [batch.column(name) for name in names]
            added = [pa.array(bins[run] + key - first[run]), pa.array(offsets[run])]
            yield pa.RecordBatch.from_arrays(fields + added, names=[*names, "sequence_id", "offset"])

    names = pieces.columns
    order = ["id", "piece", "start", "ids_crc32"]
    rows = pieces.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(PARTS)))
    within = Window.partitionBy("length", "part").orderBy(*order)
    local = rows.withColumn("local", F.row_number().over(within) - 1)
    sizes = rows.groupBy("length", "part").agg(F.count("*").alias("n"))  # at most capacity x PARTS rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = local.join(starts, ["length", "part"]).select(
        *names, (F.col("before") + F.col("local")).cast("bigint").alias("rank")
    )
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return map_batches(ranked, place, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", with_ids: bool = False, **options) -> DataFrame:
    """Pieces of all documents with their places: pieces are written once, then planned and placed."""
    pieces = cut_lineage(token_pieces(docs, id_col=id_col, with_ids=with_ids, **options))
    return pack(pieces, options.get("capacity", CAPACITY)).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the token sequences of pieces that were packed with their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` ids
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
