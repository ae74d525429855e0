"""Secret scans through a trigram inverted index, with DataFrame functions only.

1. ``trigram_query`` derives from the regex of a rule a Boolean query: alternatives, each a set of trigrams (in lower
   case) that every match must contain. A rule with an alternative without trigrams has no query.
2. ``scan_rows`` reads every text once: which of the rules' trigrams it has, and the matches of rules without a
   query, which must scan fully. ``index`` turns the former into posting rows ``(trigram, doc_id, text_key)``.
3. ``candidates`` intersects postings: a document is a candidate of a rule if it is in the lists of all trigrams of one
   alternative.
4. ``verify`` runs the regexes on candidates. Texts are shuffled to meet the candidates only if they have the rarest
   trigram, by posting list, of some alternative: all candidates do.

Spans count code points, end exclusive; matches of a rule are leftmost and do not overlap, and matches that are
too short are dropped after that. Null texts count as empty: no spans. Rows are told apart by id and a hash of the
text; rows that repeat both are answered alike. A document's spans are gathered in one row; nothing else is gathered.
The number of trigrams, alternatives and rules depends on the rules alone.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass
from re import IGNORECASE, _constants, _parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """``group`` must have at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# Kinds and patterns. A run of hex digits that is matched greedily and dropped below 32 is a run of 32 or more.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
MORE_RULES = (
    Rule("private", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES

_MOST_STRINGS = 64
_KEYS = ["doc_id", "text_key"]


def _strings(parsed) -> set[str] | None:
    """All strings that a part of a regex matches, if there are few."""
    found = {""}
    for kind, value in parsed:
        if kind is _constants.LITERAL:
            some = {chr(value).lower()}
        elif kind is _constants.IN:
            some = set()
            for what, x in value:
                if what is _constants.LITERAL:
                    some.add(chr(x).lower())
                elif what is _constants.RANGE and x[1] - x[0] < _MOST_STRINGS:
                    some |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None
        elif kind is _constants.BRANCH:
            parts = [_strings(branch) for branch in value[1]]
            if None in parts:
                return None
            some = set().union(*parts)
        elif kind is _constants.SUBPATTERN:
            some = _strings(value[-1])
        elif kind is _constants.MAX_REPEAT and value[1] <= 4 and (once := _strings(value[2])) is not None:
            some, power = set(), {""}
            for n in range(value[1] + 1):
                if n >= value[0]:
                    some |= power
                power = {a + b for a in power for b in once}
                if len(power) > _MOST_STRINGS:
                    return None
        else:
            return None
        if some is None or len(found) * len(some) > _MOST_STRINGS:
            return None
        found = {a + b for a in found for b in some}
    return found


def _least(query: set[frozenset]) -> set[frozenset]:
    """Without alternatives that ask for more than another."""
    return {a for a in query if not any(b < a for b in query)}


def _both(one: set[frozenset], other: set[frozenset]) -> set[frozenset]:
    return _least({a | b for a in one for b in other}) if len(one) * len(other) <= _MOST_STRINGS else one


def _trigrams(strings: set[str]) -> set[frozenset]:
    return _least({frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings})


def _query(parsed) -> set[frozenset]:
    query, run = {frozenset()}, {""}
    for item in parsed:
        some = _strings([item])
        if some is not None and len(run) * len(some) <= _MOST_STRINGS:
            run = {a + b for a in run for b in some}
            continue
        query = _both(query, _trigrams(run))
        run = some or {""}
        if some is None:
            kind, value = item
            if kind is _constants.SUBPATTERN:
                query = _both(query, _query(value[-1]))
            elif kind is _constants.BRANCH:
                query = _both(query, _least(set().union(*(_query(branch) for branch in value[1]))))
            elif kind in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and value[0] > 0:
                query = _both(query, _query(value[2]))
    return _both(query, _trigrams(run))


def trigram_query(pattern: str) -> list[list[str]]:
    """Alternatives of trigrams that a text with a match must contain; ``[]`` if there is no such query."""
    parsed = _parser.parse(pattern)
    if parsed.state.flags & ~(IGNORECASE | 32):  # 32 stands for text patterns
        raise ValueError(f"only the flag i is understood: {pattern}")
    query = _query(parsed)
    return [] if frozenset() in query else sorted(sorted(alternative) for alternative in query)


def _lengths(text: Column, rule: Rule) -> Column:
    """Lengths of the texts between matches, of the matches and of their groups; null without a match."""
    pattern = F.lit(rule.pattern)
    return F.when(F.rlike(text, pattern), F.struct(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gaps"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("sizes"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("groups"),
    ))


def _matches(text: Column, rules: list[tuple[int, Rule]]) -> Column:
    """``(number, gaps, sizes, groups)`` of each rule that matches."""
    each = []
    for number, rule in rules:
        found = _lengths(text, rule)
        each.append(F.when(found.isNotNull(), F.struct(
            F.lit(number).alias("number"), found["gaps"].alias("gaps"), found["sizes"].alias("sizes"),
            found["groups"].alias("groups"),
        )))
    return F.array_compact(F.array(*each))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"), F.lower(text).alias("low")
    )


def scan_rows(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(doc_id, text_key, trigrams, matches)`` of every row; matches of rules without a query."""
    queries = [trigram_query(rule.pattern) for rule in rules]
    wanted = sorted({t for query in queries for alternative in query for t in alternative})
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted]))
    fully = [(i, rule) for i, rule in enumerate(rules) if not queries[i]]
    none = F.array().cast("array<struct<number:int,gaps:array<int>,sizes:array<int>,groups:array<int>>>")
    return texts.select(
        *_KEYS, (present if wanted else F.array().cast("array<string>")).alias("trigrams"),
        (_matches(F.col("text"), fully) if fully else none).alias("matches"),
    )


def index(rows: DataFrame) -> DataFrame:
    """Posting rows ``(trigram, doc_id, text_key)``."""
    return rows.select(F.explode("trigrams").alias("trigram"), *_KEYS)


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(doc_id, text_key)`` of rows that are in all lists of an alternative of some rule."""
    alternatives = [alternative for rule in rules for alternative in trigram_query(rule.pattern)]
    needs = [(i, t, len(alternative)) for i, alternative in enumerate(alternatives) for t in alternative]
    needs = postings.sparkSession.createDataFrame(needs, "alternative int, trigram string, need int")
    met = postings.join(F.broadcast(needs), "trigram").groupBy(*_KEYS, "alternative", "need")
    met = met.agg(F.size(F.collect_set("trigram")).alias("n"))
    return met.where("n = need").select(*_KEYS).distinct()


def verify(texts: DataFrame, postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(doc_id, text_key, matches)`` of candidates, for rules with a query."""
    queried = [(i, rule) for i, rule in enumerate(rules) if trigram_query(rule.pattern)]
    sizes = {r.trigram: r.n for r in postings.groupBy("trigram").agg(F.count("*").alias("n")).collect()}
    rarest = {
        min(alternative, key=lambda t: (sizes.get(t, 0), t))
        for _, rule in queried for alternative in trigram_query(rule.pattern)
    }
    may = functools.reduce(operator.or_, [F.contains("low", F.lit(t)) for t in sorted(rarest)], F.lit(False))
    found = candidates(postings, rules)
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.text_key") == F.col("c.text_key"))
    met = texts.where(may).alias("d").join(found.alias("c"), same, "left_semi")
    return met.select(*_KEYS, _matches(F.col("text"), queried).alias("matches"))


def _spans(found: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(doc_id, text_key, number, start, end)`` from ``(doc_id, text_key, matches)``."""
    one = found.select(*_KEYS, F.explode("matches").alias("m")).select(*_KEYS, "m.*")
    one = one.dropDuplicates([*_KEYS, "number"])
    parts = one.select(*_KEYS, "number", F.posexplode(F.arrays_zip("gaps", "sizes", "groups")).alias("i", "m"))
    before = Window.partitionBy(*_KEYS, "number").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum(F.col("m.gaps") + F.coalesce("m.sizes", F.lit(0))).over(before), F.lit(0))
    spans = parts.withColumn("start", gone + F.col("m.gaps")).where("m.sizes IS NOT NULL")
    least = F.element_at(F.array(*[F.lit(rule.least) for rule in rules]), F.col("number") + 1)
    return spans.where(F.col("m.groups") >= least).select(
        *_KEYS, "number", "start", (F.col("start") + F.col("m.sizes")).alias("end")
    )


def find_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, spans)`` of every row; ``spans`` is an array of ``(start, number, kind, end)`` in that order."""
    texts = _keyed(docs, id_col, text_col)
    rows = cut_lineage(scan_rows(texts, rules))
    postings = index(rows)
    found = rows.where(F.size("matches") > 0).select(*_KEYS, "matches").unionByName(verify(texts, postings, rules))
    kind = F.element_at(F.array(*[F.lit(rule.kind) for rule in rules]), F.col("number") + 1)
    span = F.struct("start", "number", kind.alias("kind"), "end")
    spans = _spans(found, rules).groupBy(*_KEYS).agg(F.sort_array(F.collect_list(span)).alias("spans"))
    same = F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.text_key") == F.col("s.text_key"))
    none = F.array().cast(spans.schema["spans"].dataType)
    return rows.alias("r").join(spans.alias("s"), same, "left").select(
        F.col("r.doc_id").alias(id_col), F.coalesce("s.spans", none).alias("spans")
    )


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
