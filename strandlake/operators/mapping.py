"""Mapping query sequences to reference sequences through shared sampled k-mers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import HashSpec, SKETCH_SPEC
from .ranks import grouped_rank
from .sketch import sketch, sketch_pieces

# How far a chain may drift off its diagonal (in hits), and the single-copy hits that
# a reported chain must exceed.
MAX_DRIFT = 50
MIN_HITS = 2
COPY_MULTI = 3
#: Bases of a piece of a giant reference.
PIECE_BASES = 1 << 22


def reference_hits(
    refs: DataFrame,
    spec: HashSpec = SKETCH_SPEC,
    sketch_set: DataFrame | None = None,
    in_pieces: bool = False,
    piece_bases: int = PIECE_BASES,
) -> DataFrame:
    """``(ref_id, ref_ord, hash, offset)`` of ``refs(ref_id, seq)``; ``ref_ord`` counts along each reference.

    With ``sketch_set`` only hashes of that set are indexed, and ``ref_ord`` counts those. ``in_pieces``
    spreads few giant references over the cluster, as overlapping pieces of ``piece_bases``; hits are then numbered by
    sampled ranges, which cut a giant reference too.
    """
    if in_pieces:
        hits = sketch_pieces(refs, ["ref_id"], "seq", spec, piece_bases)
    else:
        hits = sketch(refs, ["ref_id"], "seq", spec)
    if sketch_set is not None:
        hits = hits.join(sketch_set.select("hash"), "hash", "left_semi")
    if sketch_set is not None or in_pieces:
        hits = grouped_rank(hits.select("ref_id", "pos", "hash"), ["ref_id"], ["pos"], "ord")
        hits = hits.withColumn("ord", (F.col("ord") - 1).cast("int"))
    return hits.select("ref_id", F.col("ord").alias("ref_ord"), "hash", F.col("pos").alias("offset"))


def reference_sequences(refs: DataFrame) -> DataFrame:
    """``(ref_id, name, len)``."""
    name = F.col("name") if "name" in refs.columns else F.col("ref_id").cast("string")
    return refs.select("ref_id", name.alias("name"), F.length("seq").alias("len"))


def check_unique_names(refs: DataFrame) -> None:
    twice = refs.groupBy("name").count().where("count > 1").select("name").head(1)
    if twice:
        raise ValueError(f"duplicate reference name {twice[0]['name']!r}")


def reference_index(hits: DataFrame) -> DataFrame:
    """One row per hash: copy class and its first two places ``(ref_id, ref_ord, offset)`` in reference order.

    Class 1 or 2 is the number of occurrences, 3 stands for more. Only the least and the largest place
    are kept, which for two occurrences are both of them; a repeat of any size stays one row. Number and
    offset rise together along a reference, so each can be joined to the reference in one number.
    """
    ref = F.shiftleft(F.col("ref_id").cast("int").cast("bigint"), 32)
    by_ord = ref.bitwiseOR(F.col("ref_ord").cast("bigint"))
    by_offset = ref.bitwiseOR(F.col("offset").cast("bigint"))
    ends = hits.groupBy("hash").agg(
        F.least(F.count("*"), F.lit(COPY_MULTI)).cast("int").alias("copy"),
        F.min(by_ord).alias("ord1"), F.min(by_offset).alias("off1"),
        F.max(by_ord).alias("ord2"), F.max(by_offset).alias("off2"),
    )

    def low(name: str) -> Column:
        return F.col(name).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")

    def place(n: int) -> Column:
        return F.struct(
            F.shiftright(f"ord{n}", 32).alias("ref_id"), low(f"ord{n}").alias("ref_ord"),
            low(f"off{n}").alias("offset"),
        ).alias(f"place{n}")

    return ends.select("hash", "copy", place(1), place(2))


def index_summary(index: DataFrame, hits: DataFrame, sequences: DataFrame) -> DataFrame:
    classes = index.agg(
        F.count_if(F.col("copy") == 1).alias("n_copy1"),
        F.count_if(F.col("copy") == 2).alias("n_copy2"),
        F.count_if(F.col("copy") == COPY_MULTI).alias("n_multi"),
    )
    n_hits = hits.agg(F.count("*").alias("n_hits"))
    seqs = sequences.agg(
        F.count("*").alias("n_refs"), F.sum(F.col("len").cast("bigint")).alias("total_len")
    )
    return classes.join(F.broadcast(n_hits)).join(F.broadcast(seqs))


def query_seeds(
    queries: DataFrame, index: DataFrame, spec: HashSpec = SKETCH_SPEC
) -> DataFrame:
    """Hits of ``queries(query_id, seq)`` with copy class and places; ``copy`` is NULL for a miss."""
    hits = sketch(queries, ["query_id", F.length("seq").alias("len")], "seq", spec).select(
        "query_id", "len", F.col("ord").alias("i"), "pos", "hash"
    )
    return hits.join(index, "hash", "left")


def query_summary(queries: DataFrame, seeds: DataFrame) -> DataFrame:
    """Per query: length, misses, hits per copy class and the fraction of hits."""
    tallies = seeds.groupBy("query_id").agg(
        F.count("*").alias("n_seed"),
        F.count_if(F.col("copy").isNull()).alias("miss"),
        F.count_if(F.col("copy") == 1).alias("copy1"),
        F.count_if(F.col("copy") == 2).alias("copy2"),
        F.count_if(F.col("copy") == COPY_MULTI).alias("multi"),
    )
    sizes = queries.select("query_id", F.length("seq").alias("len"))
    counts = ["n_seed", "miss", "copy1", "copy2", "multi"]
    joined = sizes.join(tallies, "query_id", "left").fillna(0, counts)
    frac = F.try_divide((F.col("n_seed") - F.col("miss")).cast("double"), F.col("n_seed"))
    return joined.select(
        "query_id", "len", "miss", "copy1", "copy2", "multi", frac.alias("hit_frac")
    )


_CHAIN_FIELDS = [
    ("query_id", pa.int64()), ("len", pa.int32()), ("q_start", pa.int32()), ("q_end", pa.int32()),
    ("ref_id", pa.int64()), ("ref_start", pa.int32()), ("ref_end", pa.int32()),
    ("n1", pa.int32()), ("n2", pa.int32()), ("ref_span", pa.int32()), ("copy1", pa.int32()),
]
_CHAIN_SCHEMA = (
    "query_id bigint, len int, q_start int, q_end int, ref_id bigint, ref_start int, ref_end int, "
    "n1 int, n2 int, ref_span int, copy1 int"
)
_SEED_COLUMNS = ["query_id", "len", "i", "pos", "copy", "ref1", "ord1", "off1", "ref2", "ord2", "off2"]
#: An open chain: its reference, its first and latest seed, its counts; ``way`` is the direction, 0 while it is open.
_STATE = ["open", "ref", "i0", "pos0", "ord0", "off0", "pos", "ord", "off", "n1", "n2", "way", "drifted"]


def _takes(chain: dict, ref: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which chains go on at a place: on their reference, and if they have a direction, along it and not drifted."""
    along = (chain["drifted"] == 0) & ((order - chain["ord"]) * chain["way"] >= 0)
    return (chain["open"] == 1) & (ref == chain["ref"]) & ((chain["way"] == 0) | along)


def _chain_lanes(seeds: dict, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chains that close within lanes of seeds, as ``(lane, *_STATE)``; ``state`` has the open chain of each lane, before and after.

    All lanes take a step at a time, the longest last.
    """
    closed = []
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    for step in range(int(size.max(initial=0))):
        lanes = order[:int(np.searchsorted(-size[order], -step))]
        chain = dict(zip(_STATE, state[:, lanes], strict=True))
        seed = {name: column[starts[lanes] + step] for name, column in seeds.items()}
        single = seed["copy"] == 1
        # a double-copy seed that cannot go on at its first place takes its second, if only to start there
        second = ~single & (chain["open"] == 1) & ~_takes(chain, seed["ref1"], seed["ord1"])
        ref, at, off = (np.where(second, seed[f"{c}2"], seed[f"{c}1"]) for c in ("ref", "ord", "off"))
        on = _takes(chain, ref, at)
        over = ~on & (chain["open"] == 1)
        if over.any():
            closed.append(np.concatenate([lanes[over][None], state[:, lanes[over]]]))
        for name, begins in (("ref", ref), ("i0", seed["i"]), ("pos0", seed["pos"]), ("ord0", at), ("off0", off)):
            chain[name] = np.where(on, chain[name], begins)
        chain["n1"] = np.where(on, chain["n1"], 0) + single
        chain["n2"] = np.where(on, chain["n2"], 0) + ~single
        walked = at - chain["ord0"]
        chain |= {"open": np.ones_like(at), "pos": seed["pos"], "ord": at, "off": off, "way": np.sign(walked)}
        chain["drifted"] = np.abs(np.abs(walked) - (seed["i"] - chain["i0"])) > MAX_DRIFT
        state[:, lanes] = [chain[name] for name in _STATE]
    return (np.concatenate(closed, axis=1) if closed else np.zeros((len(_STATE) + 1, 0), np.int64)), state


def _chain_batches(batches: Iterator[pa.RecordBatch], compat_tail: bool) -> Iterator[pa.RecordBatch]:
    """Chain seeds that arrive sorted by (query, i).

    A lane ends with its query, or where two seeds in a row have no reference in common: there a chain starts, whatever came
    before. The open chain of the last lane, and the chains found in its query, are carried to the next batch.
    """
    carried = np.zeros((len(_STATE), 1), np.int64)
    key, length, copy1 = None, 0, 0
    found: list[np.ndarray] = []
    last: dict[str, int] = {}

    def rows_of(keys, lengths, chains, singles):
        c = dict(zip(_STATE, chains, strict=True))
        columns = [keys, lengths, c["pos0"], c["pos"], c["ref"], c["off0"], c["off"], c["n1"], c["n2"], np.abs(c["ord"] - c["ord0"]), singles]
        return pa.RecordBatch.from_arrays(
            [pa.array(x).cast(kind) for x, (_, kind) in zip(columns, _CHAIN_FIELDS, strict=True)], [name for name, _ in _CHAIN_FIELDS]
        )

    def kept(chains, tail):
        """Chains with enough hits; ``tail`` marks those that end a query."""
        c = dict(zip(_STATE, chains, strict=True))
        return chains[:, (np.where(tail & compat_tail, c["n2"], c["n1"]) > MIN_HITS) & (c["open"] == 1)]

    def finish():
        chains = np.concatenate([*found, kept(carried, np.ones(1, bool))], axis=1)
        n = chains.shape[1]
        return rows_of(np.full(n, key), np.full(n, length), chains, np.full(n, copy1))

    for batch in batches:
        if not batch.num_rows:
            continue
        seeds = {name: batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in _SEED_COLUMNS}
        query, single = seeds["query_id"], seeds["copy"] == 1
        refs = [np.append(last.get(name, -1), seeds[name]) for name in ("ref1", "ref2")]
        apart = np.logical_and.reduce([a[1:] != b[:-1] for a in refs for b in refs])
        fresh = np.append(query[0] != key if key is not None else True, query[1:] != query[:-1])
        starts = np.flatnonzero(fresh | apart | (np.arange(len(query)) == 0))
        ends = np.append(starts[1:], len(query))
        state = np.zeros((len(_STATE), len(starts)), np.int64)
        if fresh[0]:
            if key is not None:
                yield finish()
            found, copy1 = [], 0
        elif apart[0]:
            found.append(kept(carried, np.zeros(1, bool)))
            # a chain was open (of no reference, -1), so a double-copy seed takes its second place
            state[0, 0] = 1
            state[1, 0] = -1
        else:
            state[:, :1] = carried
        # the same for lanes that start within a query
        inside = np.flatnonzero(~fresh[starts])
        inside = inside[inside > 0]
        state[0, inside] = 1
        state[1, inside] = -1
        closed, state = _chain_lanes(seeds, starts, ends, state)
        lane, chains = closed[0], closed[1:]
        real = chains[1] >= 0
        lane, chains = lane[real], chains[:, real]
        enough = chains[_STATE.index("n1")] > MIN_HITS
        lane, chains = lane[enough], chains[:, enough]
        # the chains that lanes end with, but for the last lane
        ended = np.arange(len(starts) - 1)
        tail = fresh[ends[ended]] if len(ended) else np.zeros(0, bool)
        support = np.where(tail & compat_tail, state[_STATE.index("n2"), ended], state[_STATE.index("n1"), ended])
        ended = ended[support > MIN_HITS]
        lane, chains = np.append(lane, ended), np.concatenate([chains, state[:, ended]], axis=1)
        carried = state[:, -1:].copy()
        # by query of the batch
        number = np.cumsum(fresh)
        which = number[starts[lane]]
        singles = np.bincount(number, single, number[-1] + 1).astype(np.int64)
        first, final = number[0], number[-1]
        if not fresh[0]:
            found.append(chains[:, which == first])
            copy1 += singles[first]
        if final != first or fresh[0]:
            if not fresh[0]:
                singles[first] = copy1
                chains_open = np.concatenate(found, axis=1)
                n = chains_open.shape[1]
                yield rows_of(np.full(n, key), np.full(n, length), chains_open, np.full(n, copy1))
            done = (which != final) & ((which != first) | fresh[0])
            yield rows_of(query[starts[lane[done]]], seeds["len"][starts[lane[done]]], chains[:, done], singles[which[done]])
            found, copy1 = [chains[:, which == final]], singles[final]
        key, length = query[-1], seeds["len"][-1]
        last = {name: int(seeds[name][-1]) for name in ("ref1", "ref2")}
    if key is not None:
        yield finish()


def chain_seeds(seeds: DataFrame, compat_tail: bool = False) -> DataFrame:
    """Greedy chains of the single- and double-copy seeds of each query.

    A seed extends the open chain where its place lies on the same reference, continues in the chain's
    direction, and the chain before it has not drifted; a double-copy seed may use its second place.
    Chains with more than ``MIN_HITS`` single-copy hits are reported (``compat_tail`` judges the last
    chain of a query by its double-copy hits instead).

    Seeds are sorted within partitions and stream through as columns: many queries, and parts of one query where the
    reference changes, are chained at once. A task holds one open chain and the chains found in the current query, never its
    seeds.
    """
    usable = seeds.where(F.col("copy") < COPY_MULTI).select(
        F.col("query_id").cast("bigint"), "len", "i", "pos", "copy",
        F.col("place1.ref_id").cast("bigint").alias("ref1"), F.col("place1.ref_ord").alias("ord1"),
        F.col("place1.offset").alias("off1"),
        F.col("place2.ref_id").cast("bigint").alias("ref2"), F.col("place2.ref_ord").alias("ord2"),
        F.col("place2.offset").alias("off2"),
    )
    ordered = usable.repartition("query_id").sortWithinPartitions("query_id", "i")
    return ordered.mapInArrow(lambda batches: _chain_batches(batches, compat_tail), _CHAIN_SCHEMA)


def map_queries(
    queries: DataFrame, index: DataFrame, spec: HashSpec = SKETCH_SPEC, compat_tail: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Per-query summary, and chains with hit density along the reference and share of single-copy hits."""
    seeds = query_seeds(queries, index, spec)
    hits = (F.col("n1") + F.col("n2")).cast("double")
    chains = chain_seeds(seeds, compat_tail).select(
        "query_id", "q_start", "q_end", "len", "ref_id", "ref_start", "ref_end", "n1", "n2",
        F.try_divide(hits, F.col("ref_span")).alias("density"),
        F.try_divide(F.col("n1").cast("double"), F.col("copy1")).alias("copy1_frac"),
    )
    return query_summary(queries, seeds), chains


def seed_places(seeds: DataFrame) -> DataFrame:
    """Verbose listing: each usable seed with its place, and its second place for class 2."""
    second = F.when(F.col("copy") == 2, F.col("place2"))
    return seeds.where(F.col("copy") < COPY_MULTI).select(
        "query_id", "pos", "copy",
        F.col("place1.ref_id").alias("ref1"), F.col("place1.offset").alias("off1"),
        second["ref_id"].alias("ref2"), second["offset"].alias("off2"),
    )
