import math

import corpus_pipeline
from strandlake.llm import language_id as li
from strandlake.llm import near_copies, packing

from .test_language_id import plain_log_probability
from .test_near_copies import plain_distance, plain_groups
from .test_packing import check_packed
from .test_phrases import plain as plain_contamination


def plain_languages(spark, docs):
    """The model is trained by the operator; scores are found again by plain recursion."""
    table = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    model = li.train(table.where(~li.held_out()))
    known = {}
    kept = []
    for doc in docs:
        if not any(c.isalpha() for c in doc[1] or ""):
            continue
        total = [float(p) for p in model.prior]
        for word in li.words_of(doc[1]):
            if word not in known:
                known[word] = [plain_log_probability(word, model.pieces, model.probability[:, i]) for i in range(len(total))]
            total = [a + b for a, b in zip(total, known[word], strict=True)]
        if 1 / sum(math.exp(x - max(total)) for x in total) >= 0.5:
            kept.append(doc)
    return kept


def plain_copies(docs):
    low = [(doc[1] or "").translate({c: c + 32 for c in range(65, 91)}) for doc in docs]
    best = {}
    for doc, text in zip(docs, low, strict=True):
        best[text] = max(doc[0], best.get(text, doc[0]))
    return [doc for doc, text in zip(docs, low, strict=True) if best[text] == doc[0]]


def test_stages_and_run(spark, sf, tmp_path):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = [d for d in docs if len(d[1] or "") < 1200]
    longest = max(docs, key=lambda d: len(d[1]))
    docs += [(1000, None, None, None, None), (1001, "12 ..", "en", "x", 5), (1002, docs[0][1].upper(), "fr", "x", 1),
             (1003, longest[1] + " ", None, None, None), (1004, "", "en", "x", 0), (1005, longest[1] + ".", "en", "x", 1)]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    expected = [docs := plain_languages(spark, docs)]
    expected.append(docs := plain_copies(docs))
    prints = [near_copies.fingerprint((d[1] or "").encode()) for d in docs]
    groups = plain_groups(prints, lambda a, b: plain_distance(a, b) <= near_copies.RADIUS)
    expected.append(docs := [d for d, g in zip(docs, groups, strict=True) if d[0] == min(e[0] for e, h in zip(docs, groups, strict=True) if h == g)])
    dirty = {r[0] for r in plain_contamination([(d[0], d[1]) for d in docs], items) if r[-1]}
    expected.append(docs := [d for d in docs if d[0] not in dirty])
    at = spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), rows in zip(corpus_pipeline.STAGES[:-1], expected, strict=True):
        at = stage(spark, at, folder)
        assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted((tuple(r) for r in at.collect()), key=repr) == sorted(rows, key=repr), name
    assert len({len(rows) for rows in expected}) == 4  # every stage decides something
    packed = corpus_pipeline.run(spark, folder).collect()
    tokenizer = packing.load_tokenizer(packing.TOKENIZER)
    sizes = {d[0]: len(tokenizer.encode(d[1], add_special_tokens=False).ids) + 1 for d in docs}
    found = {}
    for r in packed:
        found[r.doc_id] = found.get(r.doc_id, 0) + r.length
    assert found == sizes
    bins = check_packed(packed, 1024)
    assert len(bins) <= 1.1 * sum(sizes.values()) / 1024 + 1


def test_stages_of_empty_and_odd_tables(spark, sf):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string"
    for rows in ([], [(None, None, None, None, None, None), (1, "", None, None, None, "x"), (1, "", None, None, None, "x")]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() <= max(len(rows), 0)
