"""Quality rules by line labelling: Viterbi decoding of a linear-chain conditional random field.

Each line is content or boilerplate. The field has a weight per line feature, label and pair of neighbouring labels. Only documents
are labelled, so the lines' labels are latent: a line of a good document is content with chance ``PRIOR[1]``, one of a bad document
with ``PRIOR[0]``, and a line that recurs among different neighbours in the sample (a header, a footer) with ``PRIOR[2]``, all before
its features are looked at. The weights ascend the likelihood of these constraints summed over all label sequences: each step
compares what the field expects under the constraint with what it expects without it (expectation maximisation by gradient).
A clean line of a bad document thus becomes content, because good documents have the like. Decoding takes the best label sequence
of a whole text; a document stays if at least ``CONTENT_SHARE`` of its words lie in content lines and no base rule fails.

The fit reads a sample of at most ``SAMPLE_DOCS`` labelled documents, those with the smallest hashes of id, label and text, up to
``SAMPLE_LINES`` lines in all (a document of more than a tenth of these teaches nothing), in chains of at most ``CHAIN`` lines.

Defined cases: a null or empty text has no words and fails; lines without a word take part in no sequence; without labelled rows
every line is content; of rows with one id and label, each is a candidate of its own for the sample; repeated rows get equal
results; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window
from xxhash import xxh3_64_intdigest

from .common import bytes_of

SAMPLE_DOCS = 2000
SAMPLE_LINES = 200_000
CHAIN = 64
#: Chance that a line is content, before its features are known: in a bad document, in a good one, where it recurs.
PRIOR = (0.4, 0.97, 0.1)
#: So many different neighbourhoods make a line recur.
RECURS = 3
CONTENT_SHARE = 0.7
SYMBOLS = "#*$%&|<>"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WINDOW = 8
#: Kinds of code points below 0x250: bits for space, symbol, capital, letter, digit, exclamation or question mark.
SPACE, SYMBOL, CAPITAL, LETTER, DIGIT, MARK = 1, 2, 4, 8, 16, 32
_KIND = np.full(0x251, LETTER, np.uint8)  # the last for all beyond
for _c in range(0x250):
    _s = chr(_c)
    _KIND[_c] = SPACE * (_s in SPACES) | SYMBOL * (_s in SYMBOLS) | CAPITAL * _s.isupper() | LETTER * _s.isalpha() | DIGIT * _s.isdigit() | MARK * (_s in "!?")
#: For each set of kinds (rows), which of space, symbol, capital, letter, digit, mark it holds, and whether it is part of a word.
_HAS = np.array([[k >> i & 1 for i in range(6)] + [1 - (k & 1)] for k in range(64)])
FEATURES = ("bias", "symbols", "capitals", "digits", "marks", "other", "long words", "short", "ends a sentence", "first or last", "repeated", "stutter", "odd neighbours")


#: Characters of a block of lines (a longer line is a block by itself), and keys that are sorted at a time.
BLOCK, KEYS = 1 << 18, 1 << 20


def _blocks(text: str) -> Iterator[str]:
    """The text in blocks of whole lines."""
    begin = 0
    while begin <= len(text):
        end = text.find("\n", begin + BLOCK)
        end = len(text) if end < 0 else end
        yield text[begin:end]
        begin = end + 1


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys have equal numbers, from 0; and which keys occur more than once. The different keys are gathered from pieces, then looked up."""
    pieces = range(0, len(keys), KEYS)
    distinct = np.concatenate([keys[:0], *[np.unique(keys[i : i + KEYS]) for i in pieces]])
    distinct = np.unique(distinct) if len(pieces) > 1 else distinct
    numbers, counts = np.empty(len(keys), np.int32), np.zeros(len(distinct), np.int32)
    for i in pieces:
        numbers[i : i + KEYS] = np.searchsorted(distinct, keys[i : i + KEYS])
        found, n = np.unique(numbers[i : i + KEYS], return_counts=True)
        counts[found] += n.astype(np.int32)
    again = np.empty(len(keys), bool)
    for i in pieces:
        again[i : i + KEYS] = counts[numbers[i : i + KEYS]] > 1
    return numbers, again


def _hashes(parts: Iterator[list[bytes]]) -> np.ndarray:
    """64-bit hashes of all parts in order: 8 bytes each is what is held of them."""
    found = [np.fromiter(map(xxh3_64_intdigest, own), np.uint64, len(own)) for own in parts]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def word_numbers(text: str | None) -> np.ndarray:
    """Equal words have equal numbers, from 0."""
    return _numbered(_hashes(bytes_of(block).split() for block in _blocks(text or "")))[0]


class Lines:
    """The lines of a text that have a word: words (of each), odd (marks and symbols per word), repeated; counts over the text; and the
    features, a block at a time, so that a text of millions of short lines takes a few dozen bytes a line."""

    def __init__(self, text: str | None, numbers: np.ndarray | None = None):
        self.text, self.numbers = text or "", numbers
        words, odd = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
        self.counts = {"word_chars": 0, "n_symbols": 0}
        for block in _blocks(self.text) if self.text else ():
            held = _line_counts(block)
            some = held["words"] > 0
            words.append(held["words"][some].astype(np.int32))
            odd.append(np.minimum((held["symbols"] + held["marks"])[some] / held["words"][some], 1).astype(np.float32))
            self.counts["word_chars"] += int(held["chars"].sum())
            self.counts["n_symbols"] += int(held["symbols"].sum())
        self.words, self.odd = np.concatenate(words), np.concatenate(odd)
        lines = _hashes([bytes_of(x) for x in block.split("\n") if x.strip(SPACES)] for block in _blocks(self.text))
        distinct, self.repeated = _numbered(lines) if len(lines) else (np.zeros(0, np.int32), np.zeros(0, bool))
        self.dup_lines = len(lines) - (int(distinct.max()) + 1 if len(lines) else 0)

    def features(self) -> Iterator[np.ndarray]:
        if self.numbers is None:
            self.numbers = word_numbers(self.text)
        n, at, word_at = len(self.words), 0, 0
        for block in _blocks(self.text) if n else ():
            held = _line_counts(block)
            some = held["words"] > 0
            own, rows = int(some.sum()), slice(at, at + int(some.sum()))
            c, w = held["chars"][some].astype(float), held["words"][some].astype(float)
            numbers = self.numbers[word_at : word_at + int(held["words"].sum())]
            again = (numbers[1:] == numbers[:-1]) & (held["of_word"][1:] == held["of_word"][:-1])
            stutter = np.bincount(held["of_word"][1:][again], minlength=len(some))[some] / w
            near = np.concatenate([[self.odd[at - 1] if at else 0], self.odd[at : at + own + 1]])
            around = (near[:own] + np.append(near, 0)[2 : own + 2]) / 2
            edge = np.zeros(own)
            if n > 2 and own:
                edge[0] = at == 0
                edge[-1] = max(edge[-1], at + own == n)
            symbols, capitals, letters, digits, marks = (held[k][some] for k in ("symbols", "capitals", "letters", "digits", "marks"))
            yield np.stack([
                np.ones(own), np.minimum(symbols / w, 1), capitals / np.maximum(letters, 1), digits / c, np.minimum(marks / w, 1),
                (c - symbols - letters - digits - marks) / c, np.minimum(c / w, 40) / 10, (w < 4).astype(float), np.isin(held["last"][some], [33, 46, 63]).astype(float),
                edge, self.repeated[rows].astype(float), stutter, around,
            ], axis=1)
            at, word_at = at + own, word_at + len(numbers)


def _line_counts(block: str) -> dict[str, np.ndarray]:
    """For each line of a block: words, chars in words, symbols, capitals, letters, digits, marks, last (character in a word); and
    of_word, the line of each word."""
    points = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _KIND[np.minimum(points, 0x250)]
    ends = np.flatnonzero(points == 10)
    n = len(ends) + 1
    line = np.repeat(np.arange(n), np.diff(ends, prepend=-1, append=len(points) - 1))
    held = np.bincount(line * 64 + kind, minlength=64 * n).reshape(n, 64) @ _HAS
    names = ("symbols", "capitals", "letters", "digits", "marks", "chars")
    out = dict(zip(names, held.T[1:]))
    space = kind & SPACE
    begins = np.flatnonzero(space < np.concatenate([[SPACE], space[:-1]])) if len(points) else np.zeros(0, int)
    finals = np.flatnonzero(space < np.concatenate([space[1:], [SPACE]])) if len(points) else np.zeros(0, int)
    last = np.zeros(n, np.uint32)
    last[line[finals]] = points[finals]
    return out | {"words": np.bincount(line[begins], minlength=n), "last": last, "of_word": line[begins]}


def line_features(text: str | None, numbers: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """For each line that has a word: its features and its words; and counts over the text: word_chars, n_symbols. For texts of bounded size.

    ``numbers``: the text's word numbers, if they are known already.
    """
    lines = Lines(text, numbers)
    return np.concatenate([np.zeros((0, len(FEATURES))), *lines.features()]), lines.words.astype(np.int64), lines.counts


def repeat_words(numbers: np.ndarray) -> int:
    """The words in windows of 8 that occur twice or more, found by numbering windows of 2, 4 and 8."""
    if len(numbers) <= WINDOW:
        return 0
    for step in (1, 2, 4):
        keys = numbers[:-step].astype(np.int64)
        keys *= int(numbers.max()) + 1
        keys += numbers[step:]
        numbers, again = _numbered(keys)
        del keys
        if not again.any():
            return 0
    cover = np.zeros(len(again) + WINDOW - 1, bool)
    for k in range(WINDOW):
        cover[k : k + len(again)] |= again
    return int(cover.sum())


def dup_lines(text: str | None) -> int:
    return Lines(text).dup_lines


class Field:
    """Weights: emit (features), content's score over boilerplate's; move (2 x 2); begin (2). Label 1 is content."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, begin: np.ndarray):
        self.emit, self.move, self.begin = emit, move, begin

    @classmethod
    def trusting(cls) -> Field:
        return cls(np.eye(1, len(FEATURES))[0], np.zeros((2, 2)), np.zeros(2))

    def decode(self, features: np.ndarray | Iterator[np.ndarray]) -> np.ndarray:
        """The best label sequence (Viterbi) of rows that may come in blocks; content on a tie. A byte a line is held for the way back."""
        (aa, ab), (ba, bb) = self.move.tolist()
        a, b = None, None
        back = bytearray()
        for block in [features] if isinstance(features, np.ndarray) else features:
            for s in (block @ self.emit).tolist():
                if a is None:
                    a, b = self.begin.tolist()
                    b += s
                    continue
                to_a, to_b = (b + ba >= a + aa), (b + bb >= a + ab)
                back.append(to_a | to_b << 1)
                a, b = max(a + aa, b + ba), max(a + ab, b + bb) + s
        if a is None:
            return np.zeros(0, np.int8)
        label = int(b >= a)
        out = bytearray([label])
        for step in reversed(back):
            label = step >> label & 1
            out.append(label)
        return np.frombuffer(out, np.int8)[::-1]

    @classmethod
    def fitted(cls, texts: list[np.ndarray], content: list[np.ndarray], rounds: int = 150, rate: float = 0.5, decay: float = 1e-3) -> Field:
        """Maximum likelihood (with weight decay) of the constraints ``content``: for each line, its chance of being content."""
        chains = [(x[i : i + CHAIN], p[i : i + CHAIN]) for x, p in zip(texts, content) for i in range(0, len(x), CHAIN)]
        if not chains or len({float(v) for _, p in chains for v in p}) < 2:
            return cls.trusting()
        chains.sort(key=lambda c: len(c[0]))
        groups = []
        for at in range(0, len(chains), 1024):
            some = chains[at : at + 1024]
            length = len(some[-1][0])
            x = np.zeros((len(some), length, len(FEATURES)))
            bias = np.zeros((len(some), length, 2))
            there = np.zeros((len(some), length), bool)
            for r, (own, p) in enumerate(some):
                x[r, : len(own)], there[r, : len(own)] = own, True
                bias[r, : len(own)] = np.log(np.stack([1 - p, p], axis=1))
            groups.append((x, there, bias))
        field = cls(np.zeros(len(FEATURES)), np.zeros((2, 2)), np.zeros(2))
        size = [np.zeros_like(w) + 1e-8 for w in (field.emit, field.move, field.begin)]
        for _ in range(rounds):
            slopes = [field._slope(*g) for g in groups]
            for k, (w, s) in enumerate(zip((field.emit, field.move, field.begin), size)):
                slope = sum(f[k] for f in slopes) / len(chains) - decay * w
                s += slope**2
                w += rate * slope / np.sqrt(s)
        return field

    def _expected(self, x: np.ndarray, there: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a forward and a backward pass expect: the features of content lines, the moves, the first labels."""
        n, length = there.shape
        forward, backward = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        forward[:, 0] = self.begin + score[:, 0]
        for t in range(1, length):
            a, b = forward[:, t - 1, :1] + self.move[0], forward[:, t - 1, 1:] + self.move[1]
            forward[:, t] = np.where(there[:, t, None], np.logaddexp(a, b) + score[:, t], forward[:, t - 1])
        for t in range(length - 2, -1, -1):
            after = score[:, t + 1] + backward[:, t + 1]
            step = np.logaddexp(self.move[:, 0] + after[:, :1], self.move[:, 1] + after[:, 1:])
            backward[:, t] = np.where(there[:, t + 1, None], step, 0)
        z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        content = np.exp(forward[:, :, 1] + backward[:, :, 1] - z[:, None]) * there
        pair = forward[:, :-1, :, None] + self.move + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]
        moves = (np.exp(np.minimum(pair, 0)) * there[:, 1:, None, None]).sum(axis=(0, 1))
        first = content[:, 0].sum()
        return np.einsum("nt,ntf->f", content, x), moves, np.array([n - first, first])

    def _slope(self, x: np.ndarray, there: np.ndarray, bias: np.ndarray) -> list[np.ndarray]:
        """The likelihood's gradient: what is expected under the constraint, less what is expected without it."""
        score = np.stack([np.zeros(there.shape), x @ self.emit], axis=2)
        return [a - b for a, b in zip(self._expected(x, there, score + bias), self._expected(x, there, score))]


def content_words(field: Field, features: np.ndarray | Iterator[np.ndarray], words: np.ndarray) -> int:
    return int(words[field.decode(features) == 1].sum())


LINES = StructType([StructField("x", ArrayType(ArrayType(DoubleType()))), StructField("line", ArrayType(LongType())), StructField("around", ArrayType(LongType()))])
_LINES = pa.struct([("x", pa.list_(pa.list_(pa.float64()))), ("line", pa.list_(pa.int64())), ("around", pa.list_(pa.int64()))])


def _sample_lines(text: str | None) -> dict:
    """The features of the lines that have a word, their hashes, and those of their neighbours."""
    h = xxh3_64_intdigest
    own = [h(x.encode("utf-8", "surrogatepass")) >> 1 for x in (text or "").split("\n") if x.strip(SPACES)]
    ends = [0, *own, 0]
    return {"x": line_features(text)[0].tolist(), "line": own, "around": [h(f"{a},{b}") >> 1 for a, b in zip(ends, ends[2:])]}


@F.arrow_udf(LINES)
def _lines(texts: pa.Array) -> pa.Array:
    return pa.array([_sample_lines(t.as_py()) for t in texts], _LINES)


def constraints(labels: list[int], lines: list[list[int]], around: list[list[int]]) -> list[np.ndarray]:
    """For each text's lines, the chance of being content that its label and its recurrence give."""
    places: dict[int, set[int]] = {}
    for own, near in zip(lines, around):
        for a, b in zip(own, near):
            places.setdefault(a, set()).add(b)
    recurs = {a for a, found in places.items() if len(found) >= RECURS}
    return [np.array([PRIOR[2] if a in recurs else PRIOR[label] for a in own], float) for label, own in zip(labels, lines)]


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """A field fitted on a bounded sample of labelled documents; the features of its lines come to the driver."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("_label"))
    # the smallest by hash, of at most so many rows: what is broadcast and what is joined are both bounded
    chosen = known.orderBy(F.xxhash64("_id", F.lit("sample")), "_id", "_label").limit(sample_docs)
    text = F.col(text_col)
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    named = docs.select(F.col(id_col).alias("_doc"), text.alias("_text"), n_lines.alias("_lines"), F.xxhash64(text).alias("_hash"))
    joined = named.filter(F.col("_lines") <= sample_lines // 10).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    order = [F.xxhash64("_id", "_label", "_hash"), F.col("_id"), F.col("_label"), F.col("_hash")]
    first = joined.orderBy(*order).limit(sample_docs)  # by the bounded sample of ids, and by the same bound where ids repeat
    held = F.sum("_lines").over(Window.orderBy(*order))
    found = first.withColumn("_held", held).filter(F.col("_held") <= sample_lines).select("_label", _lines("_text").alias("s")).collect()
    texts = [np.array(r["s"]["x"], float).reshape(-1, len(FEATURES)) for r in found]
    return Field.fitted(texts, constraints([r["_label"] for r in found], [r["s"]["line"] for r in found], [r["s"]["around"] for r in found]))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_content_words")
RESULT = StructType([StructField(c, LongType()) for c in COUNTS] + [StructField("base_failed", BooleanType()), StructField("kept", BooleanType())])


def judged(text: str | None, field: Field) -> tuple:
    words = word_numbers(text)
    again, n = repeat_words(words), len(words)
    lines = Lines(text, words)
    good = content_words(field, lines.features(), lines.words)
    failed = n < 20 or 100 * again > 30 * n
    return n, lines.counts["word_chars"], lines.counts["n_symbols"], lines.dup_lines, again, len(lines.words), good, failed, not failed and good >= CONTENT_SHARE * n


def judge(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the counts, base_failed, kept."""

    def decide(texts: pa.Array) -> pa.Array:
        columns = list(zip(*[judged(t.as_py(), field) for t in texts])) or [()] * (len(COUNTS) + 2)
        kinds = [pa.int64()] * len(COUNTS) + [pa.bool_()] * 2
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=RESULT.names)

    rows = docs.select(F.col(id_col).alias(id_col), F.arrow_udf(decide, RESULT)(text_col).alias("_q"))
    return rows.select(id_col, "_q.*")
