"""Quality scores by a sparse ensemble of rules.

1. ``statistics``: numbers about each whole text.
2. ``tree_paths``: shallow trees are grown on labelled rows, and every path from a root to a node becomes a rule: a
   conjunction of bounds on statistics.
3. ``train``: a logistic regression with a lasso penalty weighs the rules; those with weight 0 go.
4. ``Ensemble.score``: the rules that stay are compiled into one Spark column expression over the statistics.

Trees and weights are fitted on at most about ``SAMPLE_ROWS`` labelled rows, chosen by a hash of the id; scores cover
every row. Null texts count as empty. Labels other than 0 and 1, and null ones, are ignored; rows that repeat an id
meet each of its labels. Without labels of both kinds every score is the share of label 1, or 0.5 without any label.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_batches, text_bytes

SAMPLE_ROWS = 100_000
N_TREES = 12
DEPTH = 3
LASSO = 0.0005
THRESHOLD = 0.3
SEED = 7

STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "space", "symbol", "mark", "beyond", "lines",
    "line_repeats", "word_repeats", "odd_ends", "short_words", "long_words", "top_word",
]

_CLASS = np.zeros(256, np.int64)  # 0: other letters and controls
for _name, _bytes in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r", b"#$%&*+<=>@[]^_`{|}~/\\", b"!\"'(),-.:;?", bytes(range(128, 256))), 1
):
    _CLASS[list(_bytes)] = _name
_ODD_END = re.compile(rb"[^0-9A-Za-z\x80-\xff.,;:!?)\"'\x2d](?=\s|$)|[!?]{2}(?=\s|$)")


def text_statistics(text: bytes) -> list[float]:
    """The numbers named in ``STATISTICS``; shares are of bytes, words or lines."""
    n = len(text)
    classes = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=7) / max(n, 1)
    words = text.split()
    n_words = max(len(words), 1)
    counts = Counter(words)
    lines = text.split(b"\n")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return [
        math.log1p(n), math.log1p(len(words)), n / n_words, *classes[1:], len(lines) / n_words,
        1 - len(set(lines)) / len(lines), 1 - len(counts) / n_words if words else 0.0,
        len(_ODD_END.findall(text)) / n_words, float((sizes <= 2).sum()) / n_words, float((sizes > 20).sum()) / n_words,
        max(counts.values(), default=0) / n_words,
    ]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, *STATISTICS)`` of every row."""

    def measure(batches):
        for batch in batches:
            rows = [text_statistics(text or b"") for text in text_bytes(batch.column(1))]
            columns = np.array(rows, dtype=float).reshape(-1, len(STATISTICS)).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in columns)], names=["id", *STATISTICS]
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    numbers = ", ".join(f"{name} double" for name in STATISTICS)
    return map_batches(rows, measure, f"id {rows.schema['id'].dataType.simpleString()}, {numbers}")


#: A bound: statistic, whether it must be above, value.
Bound = tuple[str, bool, float]
Rule = tuple[Bound, ...]


def holds(rule: Rule) -> Column:
    """A rule as a column."""
    return functools.reduce(
        operator.and_, [F.col(name) > value if above else F.col(name) <= value for name, above, value in rule]
    )


_BRANCH = re.compile(r"\s*(?:If|Else) \(feature (\d+) (<=|>) ([-0-9.E]+)\)")


def tree_paths(description: str, names: list[str]) -> set[Rule]:
    """Rules from the printed form of an ensemble of trees: every path that starts at a root."""
    rules: set[Rule] = set()
    path: list[tuple[int, Bound]] = []
    for line in description.splitlines():
        depth = len(line) - len(line.lstrip())
        path = [step for step in path if step[0] < depth]
        if found := _BRANCH.fullmatch(line):
            path.append((depth, (names[int(found[1])], found[2] == ">", float(found[3]))))
            rules.add(_merged([bound for _, bound in path]))
    return rules


def _merged(bounds: list[Bound]) -> Rule:
    """The tightest bound for each statistic and side."""
    tight: dict[tuple[str, bool], float] = {}
    for name, above, value in bounds:
        known = tight.get((name, above), value)
        tight[name, above] = max(known, value) if above else min(known, value)
    return tuple(sorted((name, above, value) for (name, above), value in tight.items()))


@dataclass
class Ensemble:
    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        """Probability of label 1 as a column over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _constant(n: int, ones: int) -> Ensemble:
    share = min(max(ones / n if n else 0.5, 1e-6), 1 - 1e-6)
    return Ensemble(math.log(share / (1 - share)), [])


def train(measured: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Ensemble:
    """Fit on rows of ``measured(id, ...)`` with ``labels(id, label)``."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    known = labels.where("label IN (0, 1)").select("id", F.col("label").cast("double").alias("label"))
    n = known.count()
    buckets = max(1, -(-n // sample_rows))
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(buckets)) == 0)
    rows = cut_lineage(measured.join(known, "id").select("label", *STATISTICS))
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if ones in (0, n):
        return _constant(n, ones)
    vectors = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(rows)
    trees = RandomForestClassifier(numTrees=N_TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.5, maxBins=64)
    found = sorted(tree_paths(trees.fit(vectors).toDebugString, STATISTICS))
    if not found:
        return _constant(n, ones)
    flags = rows.select("label", *[holds(rule).cast("double").alias(f"r{i}") for i, rule in enumerate(found)])
    inputs = VectorAssembler(inputCols=[f"r{i}" for i in range(len(found))], outputCol="features").transform(flags)
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60)
    fitted = lasso.fit(inputs.select("label", "features"))
    weighed = zip(found, fitted.coefficients.toArray().tolist(), strict=True)
    return Ensemble(float(fitted.intercept), [(rule, weight) for rule, weight in weighed if weight])


def score_documents(
    docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", sample_rows: int = SAMPLE_ROWS,
) -> tuple[DataFrame, Ensemble]:
    """``(id_col, score)`` of every row, and the rules; labels count where ``learn_from`` holds for their row."""
    measured = cut_lineage(statistics(docs, id_col, text_col))
    usable = labels.where(learn_from).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    ensemble = train(measured, usable, sample_rows)
    return measured.select(F.col("id").alias(id_col), ensemble.score().alias("score")), ensemble
