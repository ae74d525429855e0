"""Language identification by unigrams over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary. The score of a text is the probability
of its words, and that of a word is the sum over all its segmentations into pieces, found by a forward pass.

* A word is a run without white space of any length, in lower case, with a mark before it. A character without a piece
  is one unknown piece.
* ``train`` counts the words of each language over all training rows (tasks count before the shuffle), then runs a
  few rounds of expectation maximisation from equal probabilities. Each round is a job over the distinct words, in
  which tasks add up expected pieces; the driver gets one number for each piece and language.
* Passes run for many words together, as many as have ``_CELLS`` characters, or for one longer word. Words whose
  probability comes near the smallest number of a double, in any language, and very long ones, are done in logarithms.
* ``predict`` scores whole texts; short words are remembered within a task. ``score`` is the posterior of the best
  language. Only texts go to Python; other columns stay in the JVM.

Null texts and texts without a letter are ``und`` with score 0. Training ignores rows with null language, text or id. A
table without training rows predicts ``und`` with score 0. Ties go to the language first in the alphabet. Rows that repeat
are scored alike. Memory grows with the longest word of a text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import BATCH_ROWS, map_batches

VOCABULARY = "piece_bpe_32k.model"
ROUNDS = 3
UNKNOWN = "und"
#: Rows whose score is below are rejected by ``keep_known``.
LEAST_SCORE = 0.5
#: Texts of a batch that is scored have about so many bytes at most, but always one text.
PREDICT_BYTES = 8 << 20

_MARK = "▁"
_LETTER = re.compile(r"[^\W\d_]")  # and some numbers
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 17
_MIXES = [((i * 0x5851F42D4C957F2D | 1) % 2**64, (i * 0x2545F4914F6CDD1D | 1) % 2**64) for i in range(1, 20)]
_SMOOTH = 0.1
#: Words with a probability below are done in logarithms. Prefixes that underflow in other words carry less than 1e-58 of it.
_TINY = 1e-250
#: Longer words may underflow in most of their length; they are done in logarithms from the start.
_LONG = 64
_CELLS = 1 << 17
#: Below so many words at a place their pieces are added up together, not by length.
_FEW = 64
_REMEMBERED = 600_000
_REMEMBERED_LENGTH = 24
_COUNTED_AT_ONCE = 150_000
_COUNTED_CHARS = 1 << 24
_CHARS_AT_ONCE = 1 << 20


@dataclass
class Pieces:
    """The vocabulary as hashes, numbered from 0; the last number is the unknown piece.

    Each hash has one of two places in a table, so that many are looked up at once.
    """

    hashes: np.ndarray
    longest: int

    def __post_init__(self):
        self.size = len(self.hashes) + 1
        for self.mix in _MIXES:
            if (owner := self._settled()) is not None:
                break
        else:
            raise ValueError("the pieces have no table")
        self.table = np.zeros(1 << _TABLE_BITS, np.uint64)
        self.number = np.full(1 << _TABLE_BITS, self.size - 1)
        at, piece = (np.array(x, np.int64) for x in (list(owner), list(owner.values())))
        self.table[at], self.number[at] = self.hashes[piece], piece

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint64(64 - _TABLE_BITS)
        first, second = ((hashes * np.uint64(mix)) >> shift for mix in self.mix)
        return first.astype(np.int64), second.astype(np.int64)

    def _settled(self) -> dict[int, int] | None:
        """The piece at each place; one that is pushed out goes to its other place."""
        first, second = (places.tolist() for places in self._places(self.hashes))
        owner: dict[int, int] = {}
        for piece, at in enumerate(first):
            for _ in range(500):
                owner[at], piece = piece, owner.get(at)
                if piece is None:
                    break
                at = second[piece] if at == first[piece] else first[piece]
            else:
                return None
        return owner

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are pieces, and their numbers."""
        first, second = self._places(keys)
        at = np.where(self.table[first] == keys, first, second)
        return self.table[at] == keys, self.number[at]


@dataclass
class Model:
    pieces: Pieces
    languages: list[str]
    prior: np.ndarray
    probability: np.ndarray  # a row for each piece, a column for each language


def _hash(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of each row, modulo 2**64; the first is of the empty prefix."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * _BASE + codes[:, i]
    return out


def load_pieces(name: str = VOCABULARY) -> Pieces:
    """Pieces of a sentencepiece vocabulary; bytes, control and unknown pieces are left out."""
    import os

    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=name if os.sep in name else public_tokenizers.path(name))
    words = {
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
    }
    words = sorted(words)
    sizes = np.array([len(w) for w in words])
    codes = _codes(words, int(sizes.max()))
    hashes = np.unique(_hash(codes)[np.arange(len(words)), sizes])
    return Pieces(hashes, int(sizes.max()))


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points of each word, plus one; 0 beyond its end."""
    padded = "".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(padded, "<u4").reshape(len(words), width).astype(np.uint64) + np.uint64(1)
    past = np.arange(width) >= np.array([len(w) for w in words])[:, None]
    return np.where(past, np.uint64(0), codes)


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def marked(word: str) -> str:
    """What of a word is cut into pieces."""
    return _MARK + word


class _Lattice:
    """All pieces that fit somewhere in some words, all words at a time."""

    def __init__(self, words: list[str], pieces: Pieces):
        self.words, self.pieces = words, pieces
        words = [marked(w) for w in words]
        self.size = np.array([len(w) for w in words], np.int64)
        self.width = int(self.size.max(initial=0))
        codes = np.ascontiguousarray(_codes(words, self.width).T) if words else np.zeros((0, 0), np.uint64)
        prefix = np.zeros((self.width + 1, len(words)), np.uint64)
        for end in range(self.width):
            prefix[end + 1] = prefix[end] * _BASE + codes[end]
        power = np.cumprod(np.full((min(pieces.longest, max(1, self.width)), 1), _BASE), axis=0)
        # of each end: (lengths, words, pieces); words stand once in each, or all are in one
        self.edges = self._by_end(prefix, power) if len(words) >= _FEW else self._at_once(prefix, power)

    def _by_end(self, prefix: np.ndarray, power: np.ndarray) -> list[list[tuple]]:
        edges = []
        for end in range(1, self.width + 1):
            here = np.flatnonzero(self.size >= end)
            some = prefix if len(here) == len(self.size) else prefix[max(0, end - len(power)):end + 1, here]
            last = end if some is prefix else len(some) - 1
            most = min(end, len(power))
            found, number = self.pieces.find(some[last] - some[last - most:last][::-1] * power[:most])
            number[0][~found[0]] = self.pieces.size - 1
            found[0] = True
            edges.append([
                (length + 1, here[word], number[length, word])
                for length in range(most) if len(word := np.flatnonzero(found[length]))
            ])
        return edges

    def _at_once(self, prefix: np.ndarray, power: np.ndarray) -> list[list[tuple]]:
        """For few words, which may be long."""
        inside = np.arange(1, self.width + 1)[:, None] <= self.size
        there = np.zeros((self.width, len(power), len(self.size)), bool)
        number = np.zeros(there.shape, np.int32)
        for i in range(min(len(power), self.width)):
            found, at = self.pieces.find(prefix[i + 1:] - prefix[:-i - 1] * power[i])
            there[i:, i] = (found | (i == 0)) & inside[i:]
            number[i:, i] = np.where(found, at, self.pieces.size - 1)
        end, length, word = np.nonzero(there)
        piece = number[end, length, word]
        length += 1
        cut = np.searchsorted(end, np.arange(self.width + 1)).tolist()
        return [[(length[a:b], word[a:b], piece[a:b])] for a, b in zip(cut, cut[1:], strict=False)]

    def forward(self, probability: np.ndarray) -> np.ndarray:
        """Probability of each prefix of each word, by language."""
        return self._forward(probability, np.multiply, np.add, 1.0, 0.0)

    def _log_forward(self, logs: np.ndarray) -> np.ndarray:
        return self._forward(logs, np.add, np.logaddexp, 0.0, -np.inf)

    def _forward(self, weights, along, over, start, nothing):
        alpha = np.full((self.width + 1, len(self.size), weights.shape[1]), nothing)
        alpha[0] = start
        for end, edges in enumerate(self.edges, 1):
            for length, word, piece in edges:
                passed = along(alpha[end - length, word], weights[piece])
                if isinstance(length, int):
                    alpha[end, word] = over(alpha[end, word], passed)
                else:
                    over.at(alpha[end], word, passed)
        return alpha

    def _whole(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[self.size, np.arange(len(self.size))]

    def _apart(self, probability: np.ndarray):
        """Forward probabilities, those of whole words, and which words are to be done in logarithms."""
        if self.width > _LONG:
            return None, None, np.ones(len(self.size), bool)
        alpha = self.forward(probability)
        whole = self._whole(alpha)
        return alpha, whole, (whole < _TINY).any(axis=1)

    def expected(self, probability: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected occurrences of each piece, by language, in ``times`` of each word."""
        alpha, whole, tiny = self._apart(probability)
        if tiny.all():
            return self._expected_by_logs(probability, times)
        counts = np.zeros_like(probability)
        if tiny.any():
            counts += self._part(tiny)._expected_by_logs(probability, times[tiny])
        word = np.flatnonzero(~tiny)
        beta = np.zeros_like(alpha)
        beta[self.size[word], word] = times[word] / whole[word]
        for end in range(self.width, 0, -1):
            for length, word, piece in self.edges[end - 1]:
                passed = probability[piece] * beta[end, word]
                # a start has one piece that ends here
                beta[end - length, word] += passed
                _add(counts, piece, passed * alpha[end - length, word])
        return counts

    def log_scores(self, probability: np.ndarray) -> np.ndarray:
        """Log probability of each word, by language."""
        _, whole, tiny = self._apart(probability)
        if tiny.all():
            return self._whole(self._log_forward(np.log(probability)))
        scores = np.log(np.where(tiny[:, None], 1, whole))
        if tiny.any():
            part = self._part(tiny)
            scores[tiny] = part._whole(part._log_forward(np.log(probability)))
        return scores

    def _part(self, some: np.ndarray) -> _Lattice:
        return _Lattice([self.words[i] for i in np.flatnonzero(some)], self.pieces)

    def _expected_by_logs(self, probability: np.ndarray, times: np.ndarray) -> np.ndarray:
        logs = np.log(probability)
        alpha = self._log_forward(logs)
        word = np.arange(len(self.size))
        beta = np.full_like(alpha, -np.inf)
        beta[self.size, word] = -alpha[self.size, word]
        counts = np.zeros_like(probability)
        for end in range(self.width, 0, -1):
            for length, word, piece in self.edges[end - 1]:
                passed = logs[piece] + beta[end, word]
                beta[end - length, word] = np.logaddexp(beta[end - length, word], passed)
                _add(counts, piece, np.exp(passed + alpha[end - length, word]) * times[word])
        return counts


def _add(counts: np.ndarray, piece: np.ndarray, passed: np.ndarray) -> None:
    if len(piece) > _FEW * 32:
        for language in range(counts.shape[1]):
            counts[:, language] += np.bincount(piece, passed[:, language], len(counts))
    else:
        np.add.at(counts, piece, passed)


def lattices(words: list[str], pieces: Pieces):
    """Numbers of words and their lattice, a bounded number of characters at a time."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order] + 1
    at = 0
    while at < len(order):
        most = max(1, _CELLS // int(sizes[at]))
        fits = sizes[at:at + most] * np.arange(1, min(most, len(order) - at) + 1) <= _CELLS
        to = at + max(1, int(fits.sum()))
        yield order[at:to], _Lattice([words[i] for i in order[at:to]], pieces)
        at = to


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Log probability of each word, by language."""
    scores = np.zeros((len(words), len(model.languages)))
    for some, lattice in lattices(words, model.pieces):
        scores[some] = lattice.log_scores(model.probability)
    return scores


def _count_words(batches):
    """Words of a task by language, given out before they fill the memory."""
    def rows():
        langs = [lang for lang, words in seen.items() for _ in words]
        words, times = ([x for words in seen.values() for x in part(words)] for part in (dict.keys, dict.values))
        result = pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(times, pa.int64())], names=["lang", "word", "n"],
        )
        seen.clear()
        return result

    seen: dict[str, Counter[str]] = {}
    chars = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = words_of(text.as_py())
            seen.setdefault(lang, Counter()).update(words)
            if max(map(len, words), default=0) > _REMEMBERED_LENGTH:
                chars += sum(map(len, words))
            if sum(map(len, seen.values())) > _COUNTED_AT_ONCE or chars > _COUNTED_CHARS:
                yield rows()
                chars = 0
    yield rows()


def _expect(words: DataFrame, model: Model) -> np.ndarray:
    """One round over the distinct words ``(word, ns)``, ``ns`` by language."""
    size, n_languages = model.pieces.size, len(model.languages)

    def expect(batches):
        counts = np.zeros((size, n_languages))
        for batch in batches:
            found = batch.column(0).to_pylist()
            times = np.array(batch.column(1).to_pylist(), dtype=float)
            for some, lattice in lattices(found, model.pieces):
                counts += lattice.expected(model.probability, times[some])
        piece, language = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece), pa.array(language), pa.array(counts[piece, language])], names=["piece", "lang", "n"]
        )

    parts = map_batches(words, expect, "piece bigint, lang bigint, n double").groupBy("piece", "lang")
    counts = np.zeros((size, n_languages))
    for row in parts.agg(F.sum("n").alias("n")).collect():  # at most a row for each piece and language
        counts[row.piece, row.lang] = row.n
    return counts


def _probabilities(counts: np.ndarray) -> np.ndarray:
    smooth = counts + _SMOOTH
    return smooth / smooth.sum(axis=0)


def train(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY, rounds: int = ROUNDS
) -> Model:
    """Fit on all rows of ``docs`` that have a text and a language."""
    pieces = load_pieces(vocabulary)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    prior = np.array([sizes[x] for x in languages], dtype=float)
    model = Model(pieces, languages, np.log(prior / prior.sum()), _probabilities(np.zeros((pieces.size, len(languages)))))
    if not languages:
        return model
    counted = map_batches(rows, _count_words, "lang string, word string, n bigint")
    by_language = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).cast("double") for x in languages]
    words = cut_lineage(counted.groupBy("word").agg(F.array(*by_language).alias("ns")))
    for _ in range(rounds):
        model.probability = _probabilities(_expect(words, model))
    return model


class Scorer:
    """Predictions of one task; remembers short words."""

    def __init__(self, model: Model):
        self.model = model
        self.number: dict[str, int] = {}
        self.scores = np.zeros((_REMEMBERED, len(model.languages)))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.model.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        cut = [words_of(text) for text in texts]
        new = list({w for words in cut for w in words} - self.number.keys())
        new_scores = word_scores(new, self.model)
        if len(self.number) + len(new) > _REMEMBERED:
            once = dict(zip(new, new_scores, strict=True))
            found = [self._total(words, once) for words in cut]
            self.number = {}
        else:
            found = None
        keep = [i for i, w in enumerate(new) if len(w) <= _REMEMBERED_LENGTH][:_REMEMBERED]
        at = len(self.number)
        self.scores[at:at + len(keep)] = new_scores[keep]
        self.number.update(zip((new[i] for i in keep), range(at, at + len(keep)), strict=True))
        if found is None:
            long = {w: new_scores[i] for i, w in enumerate(new) if len(w) > _REMEMBERED_LENGTH}
            found = [self._total(words, long) for words in cut]
        return [self._best(text, total) for text, total in zip(texts, found, strict=True)]

    def _total(self, words: list[str], others: dict[str, np.ndarray]) -> np.ndarray:
        """Log probability of the words, which are remembered or among ``others``."""
        at = list(map(self.number.get, words))
        if None not in at:
            return self.scores[at].sum(axis=0) + self.model.prior
        total = self.scores[[i for i in at if i is not None]].sum(axis=0) + self.model.prior
        return total + np.sum([others[w] for w, i in zip(words, at, strict=True) if i is None], axis=0)

    def _best(self, text: str | None, total: np.ndarray) -> tuple[str, float]:
        if not text or not any(found[0].isalpha() for found in _LETTER.finditer(text)):
            return UNKNOWN, 0.0
        best = int(total.argmax())
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def _grouped(texts: list[str | None]):
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text or "")
        if size >= _CHARS_AT_ONCE:
            yield group
            group, size = [], 0
    if group:
        yield group


def _predicted(spark, model: Model, text: Column) -> Column:
    """A column ``(lang, score)``; only ``text`` goes to Python, in bounded batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PREDICT_BYTES))

    @F.arrow_udf("struct<lang:string,score:double>")
    def predicted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = Scorer(model)
        for column in columns:
            found = [p for group in _grouped(column.to_pylist()) for p in score(group)]
            yield pa.StructArray.from_arrays(
                [pa.array([p[0] for p in found], pa.string()), pa.array([p[1] for p in found], pa.float64())], ["lang", "score"]
            )

    return predicted(text)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, lang_pred, score)`` of every row."""
    found = docs.select(F.col(id_col), _predicted(docs.sparkSession, model, F.col(text_col).cast("string")).alias("__found"))
    return found.select(id_col, F.col("__found.lang").alias("lang_pred"), F.col("__found.score").alias("score"))


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` that get a language with a score of at least ``least``; nothing is shuffled."""
    found = docs.withColumn("__found", _predicted(docs.sparkSession, model, F.col(text_col).cast("string")))
    return found.where((F.col("__found.lang") != UNKNOWN) & (F.col("__found.score") >= least)).select(*docs.columns)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5, F.lit(0)) == 0
