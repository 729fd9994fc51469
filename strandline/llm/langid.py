"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary (its lower-case letter pieces). A word's probability is the sum,
over all ways to cut it into pieces, of the product of their probabilities: a forward pass over its letters, rescaled on the way
so that words of any length stay within the range of a double. A text's score is the product over its words; the language with
the highest posterior (equal priors) is predicted.

Piece probabilities are fitted by a few rounds of expectation maximisation on a sample of about ``SAMPLE_DOCS`` labelled documents
of each language (all, if it has no more), chosen by a hash of id and text, so that rows with one id are not chosen all or none.
The sample's words are counted by (language, word); each round adds up the expected pieces of all words in Spark, word by
word, so that no task holds a language. Predictions read whole texts and nothing else.

Defined cases: a text that is null or has no letter is `und` with score 0; rows without a label teach nothing; without any
labelled row every text is `und`; repeated rows count as often as they occur; an empty table gives an empty table; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import bounded, settled

#: Documents of each language, on average, that the model is fitted on; a language with no more than these gives all.
SAMPLE_DOCS = 3000
ROUNDS = 3
SMOOTH = 0.1
#: The probability of a letter that is no piece, in every language.
UNKNOWN = 1e-7
#: Words whose scores a worker keeps; then it starts anew.
CACHE = 300_000
WORDS = re.compile(r"[^\W\d_]+")
LONGEST = 16
#: The letters after which a forward or backward pass is rescaled: as far as a piece reaches.
RESCALE = LONGEST
#: Expected pieces are rounded to this part of one, so that their sums are exact and no order of adding matters.
GRAIN = float(1 << 20)
_vocabularies: dict[str, dict[str, int]] = {}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> dict[str, int]:
    """The vocabulary's pieces of lower-case letters, with or without the mark of a word's start, numbered from 0."""
    if path not in _vocabularies:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        good = [p for p in pieces if p == "▁" or (len(p) <= LONGEST and p.removeprefix("▁").isalpha() and p == p.lower())]
        _vocabularies[path] = {p: i for i, p in enumerate(dict.fromkeys(good))}
    return _vocabularies[path]


def words_of(text: str | None) -> list[str]:
    """The letter words, none if no character is a letter (such as a lone fraction sign)."""
    return WORDS.findall(text.lower()) if text and any(map(str.isalpha, text)) else []


def _ends(words: list[str], n: int, pieces: dict[str, int]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """For words of n letters (mark included) and each end from 1: the begins of spans that end there, with their piece numbers.

    The number is -1 for no piece, -2 for an unknown letter.
    """
    get = pieces.get
    for j in range(1, n + 1):
        out = []
        for i in range(max(0, j - LONGEST), j):
            missing = -2 if j - i == 1 else -1
            ids = [get(w[i:j], missing) for w in words]
            if missing == -2 or max(ids) >= 0:
                out.append((i, np.array(ids, np.int64)))
        yield out


def _rescale(alpha: list[np.ndarray], shift: list[np.ndarray]) -> None:
    """Divides the last values, which are all that a pass still reads, by the largest of them; notes it in their shifts."""
    top = np.maximum.reduce(alpha[-RESCALE:])
    for k in range(max(0, len(alpha) - RESCALE), len(alpha)):
        alpha[k] = alpha[k] / top
        shift[k] = shift[k] + np.log(top)


def _forward(ends: Iterable[list[tuple[int, np.ndarray]]], table: np.ndarray, count: int, keep: bool) -> tuple[list[np.ndarray | None], list[np.ndarray | None]]:
    """The probability of each beginning, over exp(its shift). Without ``keep`` only the last ones are held."""
    zero = np.zeros((count, table.shape[1]))
    alpha: list[np.ndarray | None] = [np.ones_like(zero)]
    shift: list[np.ndarray | None] = [zero]
    for j, spans in enumerate(ends, 1):
        total = np.zeros_like(zero)
        for i, ids in spans:
            total += alpha[i] * table[ids]
        alpha.append(total)
        shift.append(shift[-1])
        if j % RESCALE == 0:
            _rescale(alpha, shift)
        if not keep and j >= LONGEST:
            alpha[j - LONGEST] = shift[j - LONGEST] = None
    return alpha, shift


def _backward(ends: list[list[tuple[int, np.ndarray]]], table: np.ndarray, count: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """As _forward, from the end: number k stands for the last k letters."""
    n = len(ends)
    begins: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n)]
    for j, spans in enumerate(ends, 1):
        for i, ids in spans:
            begins[i].append((n - j, ids))
    return _forward(reversed(begins), table, count, keep=True)


def word_scores(words: list[str], pieces: dict[str, int], table: np.ndarray) -> np.ndarray:
    """ln P(word) for each word (rows) and language (columns). table: a row per piece, then one for unknown letters, then zeros."""
    out = np.zeros((len(words), table.shape[1]))
    by_length: dict[int, list[int]] = defaultdict(list)
    for k, word in enumerate(words):
        by_length[len(word) + 1].append(k)
    for n, found in by_length.items():
        for at in range(0, len(found), 4096):
            rows = found[at : at + 4096]
            alpha, shift = _forward(_ends(["▁" + words[k] for k in rows], n, pieces), table, len(rows), keep=False)
            out[rows] = np.log(alpha[n]) + shift[n]
    return out


def _table(probabilities: np.ndarray) -> np.ndarray:
    """Rows -2 and -1 stand for an unknown letter and for no piece."""
    languages = probabilities.shape[1]
    return np.vstack([probabilities, np.full((1, languages), UNKNOWN), np.zeros((1, languages))])


def expected_pieces(words: list[str], weights: np.ndarray, pieces: dict[str, int], table: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words of one language, by its column of probabilities."""
    expected = np.zeros(len(pieces) + 2)
    by_length: dict[int, list[int]] = defaultdict(list)
    for k, word in enumerate(words):
        by_length[len(word) + 1].append(k)
    for n, found in by_length.items():
        step = max(1, 65_536 // n)
        for at in range(0, len(found), step):
            rows = found[at : at + step]
            ends = list(_ends(["▁" + words[k] for k in rows], n, pieces))
            alpha, a = _forward(ends, table, len(rows), keep=True)
            beta, b = _backward(ends, table, len(rows))
            whole = np.log(alpha[n]) + a[n]
            for j, spans in enumerate(ends, 1):
                after = beta[n - j] * np.exp(b[n - j] - whole + a[j]) * weights[rows][:, None]
                for i, ids in spans:
                    chance = alpha[i] * np.exp(a[i] - a[j]) * table[ids] * after
                    expected += np.bincount(ids % len(expected), weights=np.rint(chance[:, 0] * GRAIN), minlength=len(expected))
    return expected[: len(pieces)] / GRAIN


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) rows to (lang, word, n), counted within a batch of 64 texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            counts: Counter = Counter()
            some = batch.slice(at, 64)
            for lang, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                counts.update((lang, word) for word in words_of(text))
            if counts:
                langs, words = zip(*counts)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that never teach: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, vocabulary_file: str, sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages, and the table of word_scores. What comes to the driver is one number per language and piece."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    # one row per language
    shares = labelled.groupBy(F.col(lang_col).alias("_lang")).agg(F.least(F.lit(1.0), F.lit(sample_docs) / F.count(F.lit(1))).alias("_share"))
    chosen = F.pmod(F.xxhash64("_id", "_text", F.lit("sample")), F.lit(1 << 30)) < F.col("_share") * (1 << 30)
    named = labelled.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    sample = named.join(bounded(settled(shares)), "_lang").filter(chosen).select(F.col("_lang").alias("lang"), F.col("_text").alias("text"))
    words = settled(sample.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages = [r["lang"] for r in words.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return [], np.zeros((0, 0))
    size = len(vocabulary(vocabulary_file))
    chance = np.full((size, len(languages)), 1 / size)
    for _ in range(rounds):
        chance = _round(words, languages, chance, vocabulary_file) + SMOOTH
        chance /= np.ascontiguousarray(chance.T).sum(axis=1)  # each language's sum by itself
    return languages, _table(chance)


def _round(words: DataFrame, languages: list[str], chance: np.ndarray, vocabulary_file: str) -> np.ndarray:
    """The expected pieces of all words, a column per language."""
    model = words.sparkSession.sparkContext.broadcast(_table(chance))  # as large as vocabulary and languages make it
    number = {lang: k for k, lang in enumerate(languages)}

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, found = vocabulary(vocabulary_file), {}
        for batch in batches:
            frame = batch.to_pandas()
            for lang, own in frame.groupby("lang", sort=True):
                k = number[lang]
                found[k] = found.get(k, 0) + expected_pieces(own["word"].tolist(), own["n"].to_numpy(float), pieces, model.value[:, k : k + 1])
        for k, expected in found.items():
            some = np.flatnonzero(expected)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), pa.array(expected[some])], names=["lang", "piece", "expected"])

    sums = words.mapInArrow(expect, "lang int, piece int, expected double").groupBy("lang", "piece").agg(F.sum("expected").alias("expected"))
    out = np.zeros(chance.shape)
    table = sums.toArrow()  # at most one row for each language and piece
    out[table["piece"].to_numpy(), table["lang"].to_numpy()] = table["expected"].to_numpy()
    return out


PREDICTION = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


class Scorer:
    """Scores texts; keeps words' scores from one batch to the next."""

    def __init__(self, languages: list[str], table: np.ndarray, pieces: dict[str, int]):
        self.languages, self.table, self.pieces = languages, table, pieces
        self.at: dict[str, int] = {}
        self.scores = np.zeros((CACHE, len(languages)), np.float32)

    def _learn(self, words: Iterable[str]) -> None:
        new = list(set(words).difference(self.at))
        if len(self.at) + len(new) > CACHE:
            self.at.clear()
            new = list(set(words))
        first = len(self.at)
        self.scores[first : first + len(new)] = word_scores(new, self.pieces, self.table)
        self.at.update(zip(new, range(first, first + len(new))))

    def total(self, words: list[str]) -> np.ndarray:
        if len(set(words)) > CACHE // 2:  # more different words than are kept: in stretches
            return sum(self.total(words[i : i + CACHE // 4]) for i in range(0, len(words), CACHE // 4))
        try:
            rows = [self.at[w] for w in words]
        except KeyError:
            self._learn(words)
            rows = [self.at[w] for w in words]
        return self.scores[rows].sum(axis=0, dtype=np.float64)

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_words(words_of(text))

    def predict_words(self, words: list[str]) -> tuple[str, float]:
        if not words or not self.languages:
            return "und", 0.0
        total = self.total(words)
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.languages[best], float(odds[best] / odds.sum())

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found = [words_of(t) for t in texts]
        ahead = set().union(*found)
        if self.languages and len(ahead) < CACHE // 2:
            self._learn(ahead)
        return [self.predict_words(words) for words in found]


_scorers: dict[str, Scorer] = {}


def predictor(docs: DataFrame, vocabulary_file: str | None = None, **fitting):
    """A function of a text column that gives struct<lang_pred, score>, fitted on ``docs``."""
    path = vocabulary_file or vocabulary_path()
    languages, table = fit(docs, path, **fitting)
    model = docs.sparkSession.sparkContext.broadcast((languages, table))
    name = f"{id(model)}-{len(languages)}-{float(table.sum())}"

    def predict(texts: pa.Array) -> pa.Array:
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = Scorer(*model.value, vocabulary(path))
        scorer, out = _scorers[name], []
        for at in range(0, len(texts), 256):
            out += scorer.predict_all(texts.slice(at, 256).to_pylist())
        names, scores = zip(*out) if out else ((), ())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return F.arrow_udf(predict, PREDICTION)


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **settings) -> DataFrame:
    """One row per document: its id, held_out, lang_pred, score."""
    predict = predictor(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **settings)
    rows = docs.select(F.col(id_col).alias(id_col), held_out(id_col).alias("held_out"), predict(text_col).alias("_p"))
    return rows.select(id_col, "held_out", "_p.lang_pred", "_p.score")


def known_language(docs: DataFrame, least: float = 0.5, text_col: str = "text", **settings) -> DataFrame:
    """The documents, with all their columns, whose language is told with a score of at least ``least``."""
    predict = predictor(docs, text_col=text_col, **settings)
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"), predict(text_col).alias("_p"))
    return rows.filter((F.col("_p.lang_pred") != "und") & (F.col("_p.score") >= least)).select("_doc.*")
