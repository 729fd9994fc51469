"""The language model's sample: rare languages and long words."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import langid


def test_rare_language_is_learnt_beside_a_hot_one(spark):
    rows = [(i, "the house and the water of the people", "hot") for i in range(3000)] + [(5000 + i, "żółw gęś źdźbło ćma łąka", "rare") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, _ = langid.fit(docs, langid.vocabulary_path(), sample_docs=20)
    assert languages == ["hot", "rare"]
    found = langid.predict_languages(docs, sample_docs=20).filter(F.col("doc_id") >= 5000).collect()
    assert len(found) == 12 and {r["lang_pred"] for r in found} == {"rare"}


def test_sample_of_each_language_is_bounded(spark, monkeypatch):
    rows = [(i, f"t{i}", "a" if i % 10 else "b") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    path = langid.vocabulary_path()
    whole = langid.fit(docs.filter("lang = 'b'"), path, sample_docs=4000)[1]
    assert np.array_equal(langid.fit(docs, path, sample_docs=400)[1][:, 1], whole[:, 0])  # no more than 400: all of them
    assert not np.array_equal(langid.fit(docs, path, sample_docs=400)[1][:, 0], langid.fit(docs, path, sample_docs=4000)[1][:, 0])


def test_rows_of_one_id_are_sampled_by_their_texts(spark):
    rows = [(None, f"text number {'abcdefghij'[i % 10]} {i}", "a") for i in range(3000)] + [(i, "other words", "b") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    path = langid.vocabulary_path()
    languages, table = langid.fit(docs, path, sample_docs=300)
    assert languages == ["a", "b"]
    assert not np.array_equal(table[:, 0], langid.fit(docs, path, sample_docs=3000)[1][:, 0])


def exact_log(word, pieces, chance):
    """ln P(word) in whole numbers' fractions: every segmentation, at any length."""
    marked, own = "▁" + word, [Fraction(float(c)) for c in chance]
    unknown = Fraction(langid.UNKNOWN)
    alpha = [Fraction(1)] + [Fraction(0)] * len(marked)
    for j in range(1, len(marked) + 1):
        for i in range(max(0, j - langid.LONGEST), j):
            piece = marked[i:j]
            if piece in pieces:
                alpha[j] += alpha[i] * own[pieces[piece]]
            elif j - i == 1:
                alpha[j] += alpha[i] * unknown
    return math.log(alpha[-1].numerator) - math.log(alpha[-1].denominator)


@pytest.mark.parametrize("n", [1, 15, 16, 17, 31, 32, 40, 200, 1000])
def test_words_of_any_length(n):
    pieces = {p: i for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "ba", "abab", "abababababababab", "bb"])}
    r = np.random.default_rng(n)
    chance = r.random((len(pieces), 2)) / 50
    word = "".join(r.choice(list("abx"), n, p=[0.55, 0.4, 0.05]))
    got = langid.word_scores([word, "b" * n], pieces, langid._table(chance))
    want = [[exact_log(w, pieces, chance[:, k]) for k in range(2)] for w in (word, "b" * n)]
    assert got == pytest.approx(np.array(want), rel=1e-10)


@pytest.mark.parametrize("n", [5, 16, 33, 70])
def test_expected_pieces_are_the_gradient(n):
    """d ln P / d ln p(piece) is how often the piece is expected, at any length."""
    pieces = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "ba", "abab"])}
    r = np.random.default_rng(n)
    chance = r.random((len(pieces), 1))
    words, weights = ["".join(r.choice(list("ab"), n)), "ab" * (n // 2) + "x"], np.array([2.0, 3.0])
    got = langid.expected_pieces(words, weights, pieces, langid._table(chance))
    for k in range(len(pieces)):
        up, down = chance.copy(), chance.copy()
        up[k] *= math.exp(1e-5)
        down[k] *= math.exp(-1e-5)
        slope = (langid.word_scores(words, pieces, langid._table(up)) - langid.word_scores(words, pieces, langid._table(down)))[:, 0] / 2e-5
        assert got[k] == pytest.approx(weights @ slope, rel=1e-4, abs=1e-4)


def test_long_words_teach_and_tell(spark):
    rows = [(i, "abcd" * 50 if i % 2 else "dcba" * 50, "x" if i % 2 else "y") for i in range(40)]
    found = langid.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {(r["doc_id"] % 2, r["lang_pred"]) for r in found} == {(1, "x"), (0, "y")}
