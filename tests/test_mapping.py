import random

from plain import random_dna, reverse_complement
from pyspark.sql import functions as F
from strandlake import HashSpec
from strandlake.operators import mapping

SPEC = HashSpec(k=15, w=4)


def frame(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} bigint, seq string")


def plain_chains(seeds, tail="n1"):
    """Chains of one query from seeds (i, pos, [places]) by the written rule, on whole lists."""
    chains = []
    for i, pos, places in seeds:
        chain = chains[-1] if chains else None

        def fits(place):
            first, last = chain[0], chain[-1]
            if place[0] != first[2][0]:
                return False
            step = last[2][1] - first[2][1]
            if step == 0:
                return True
            if abs(abs(step) - (last[0] - first[0])) > 50:
                return False
            return place[1] >= last[2][1] if step > 0 else place[1] <= last[2][1]

        chosen = next((p for p in places if chain and fits(p)), None)
        if chosen:
            chain.append((i, pos, chosen, len(places)))
        else:
            place = places[0] if chain is None else places[-1]
            chains.append([(i, pos, place, len(places))])
    out = []
    for at, chain in enumerate(chains):
        n1 = sum(c[3] == 1 for c in chain)
        n2 = len(chain) - n1
        support = n2 if tail == "n2" and at == len(chains) - 1 else n1
        if support > 2:
            out.append((chain[0][1], chain[-1][1], chain[0][2][0], chain[0][2][2], chain[-1][2][2], n1, n2))
    return out


def fixture(spark):
    rng = random.Random(11)
    base = random_dna(rng, 6000)
    refs = [(0, base[:3000] + base[500:1500] + random_dna(rng, 500)), (1, base[3000:] + base[100:300] * 2)]
    queries = []
    for q in range(30):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            ref = refs[rng.randrange(2)][1]
            a = rng.randrange(len(ref) - 400)
            part = ref[a:a + rng.randrange(30, 900)]
            parts.append(part if rng.random() < 0.6 else reverse_complement(part))
            parts.append(random_dna(rng, rng.randrange(0, 300)))
        queries.append((q, "".join(parts)))
    queries.append((30, "ACGT"))
    return frame(spark, refs, "ref_id"), frame(spark, queries, "query_id")


def test_chains_match_plain_rule(spark):
    refs, queries = fixture(spark)
    index = mapping.reference_index(mapping.reference_hits(refs, SPEC))
    seeds = mapping.query_seeds(queries, index, SPEC).cache()
    by_query = {}
    for r in seeds.where("copy < 3").orderBy("query_id", "i").collect():
        places = [tuple(r["place1"])] + ([tuple(r["place2"])] if r["copy"] == 2 else [])
        by_query.setdefault(r["query_id"], []).append((r["i"], r["pos"], places))
    for compat, tail in ((False, "n1"), (True, "n2")):
        want = sorted((q, *c) for q, s in by_query.items() for c in plain_chains(s, tail))
        chains = mapping.chain_seeds(seeds, compat_tail=compat)
        got = sorted(
            (r["query_id"], r["q_start"], r["q_end"], r["ref_id"], r["ref_start"], r["ref_end"], r["n1"], r["n2"])
            for r in chains.collect())
        assert got == want and want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        again = mapping.chain_seeds(seeds).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert again == mapping.chain_seeds(seeds).count()
    seeds.unpersist()


def test_summary_and_classes(spark):
    refs, queries = fixture(spark)
    hits = mapping.reference_hits(refs, SPEC)
    index = mapping.reference_index(hits)
    counts = {r["hash"]: r["count"] for r in hits.groupBy("hash").count().collect()}
    for row in index.collect():
        assert row["copy"] == min(counts[row["hash"]], 3)
    summary, chains = mapping.map_queries(queries, index, SPEC)
    short = summary.where("query_id = 30").head()
    assert (short["len"], short["miss"], short["copy1"], short["hit_frac"]) == (4, 0, 0, None)
    assert chains.where("density is not null and (copy1_frac <= 0 or copy1_frac > 1)").count() == 0
    spread = mapping.reference_hits(refs, SPEC, in_pieces=True)
    assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, hits.collect()))
    some = index.limit(20).select("hash")
    known = mapping.reference_hits(refs, SPEC, some)
    ords = known.groupBy("ref_id").agg(F.max("ref_ord").alias("top"), F.count("*").alias("n")).collect()
    assert all(r["top"] == r["n"] - 1 for r in ords)
