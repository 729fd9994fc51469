"""Quality classifier: a sparse ensemble of rules over text statistics.

Every text becomes a row of statistics, all of them Spark column expressions over the whole text (``STATISTICS``). Trees of small depth
are grown on labelled rows; each path from a root to a node is a rule, the conjunction of its conditions (``Rule``: one interval per
statistic). A logistic model with a lasso penalty weighs the rules and leaves few of them with a weight. ``Ensemble.score`` compiles these
into one Spark expression, so texts are scored without Python.

The fit takes at most ``SAMPLE_EACH`` rows of each label, those with the smallest hashes of their id and statistics; weights restore the
labels' shares. Statistics are settled once, for the fit and the scores.

Defined cases: a null text is an empty one, whose statistics are all zero; it gets a score like any other. A document without a label, or with a
null one, takes no part in the fit; one with several labels is a row for each; null ids have no label. Without labelled rows every score
is a half, with one label only it is that label. Repeated rows get equal scores; an empty table gives an empty table; extra columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, settled

SAMPLE_EACH = 3000
TREES, DEPTH, SEED = 24, 4, 7
#: Penalty of the lasso.
PENALTY = 0.002
#: Steps of the lasso at most.
ROUNDS = 60
HELD_OUT_OF, HELD_OUT = 4, 2
KEPT_FROM = 0.7
_IN, _OUT = rf"[^{SPACE}]", rf"[{SPACE}]"
STATISTICS = ("log_words", "word_length", "symbols", "capitals", "digits", "marks", "stops", "commas", "shouted", "stutters", "line_words", "echoes", "other")
#: A word (a line) and its copies that follow at once; all quantifiers are possessive, so no text makes them go back.
_STUTTER = rf"(?<!{_IN})({_IN}++)(?:{_OUT}++\1(?!{_IN}))++"
_ECHO = r"(?m)^([^\n]++)(?:\n\1$)++"


def _without(text: Column, pattern: str, put: str = "") -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(put))


def _lost(text: Column, pattern: str, put: str = "") -> Column:
    """The characters that the pattern's matches take; no list of matches is made, so memory is a text's own size."""
    return (F.char_length(text) - F.char_length(_without(text, pattern, put))).cast("double")


def statistics(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the statistics of each text."""
    text, named = F.col("_text"), [F.col(f"`{c}`") for c in keep]
    rows = docs.select(*named, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    marked = F.char_length(_without(text, rf"{_IN}++", "x"))  # white space, and one character a word
    rows = rows.select(
        *named, F.char_length(text).cast("double").alias("_total"), marked.cast("double").alias("_marked"), _without(text, rf"{_OUT}++").alias("_solid"),
        _lost(text, rf"[.!?](?!{_IN})").alias("_stops"), _lost(text, r"\p{Lu}++").alias("_capitals"), _lost(text, r"\p{Lu}{2,}+").alias("_shouted"),
        _lost(text, _STUTTER, "$1").alias("_stutters"), _lost(text, _ECHO, "$1").alias("_echoes"), (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("_lines"),
    )
    rows = rows.withColumn("_rest", _without(F.col("_solid"), r"\p{L}++")).withColumn("_inside", F.char_length("_solid").cast("double")).drop("_solid")
    rest = F.col("_rest")
    rows = rows.select("*", F.char_length(rest).cast("double").alias("_odd"), *[_lost(rest, p).alias(n) for n, p in (("_symbols", r"[#*$%&|<>]++"), ("_digits", r"\p{Nd}++"), ("_marks", r"[!?]++"), ("_commas", r"[,;:]++"), ("_periods", r"[.]++"))])
    words = F.greatest(F.col("_marked") - (F.col("_total") - F.col("_inside")), F.lit(0.0))
    each, chars, total = F.greatest(words, F.lit(1.0)), F.greatest("_inside", F.lit(1.0)), F.greatest("_total", F.lit(1.0))
    letters = F.greatest(F.col("_inside") - F.col("_odd"), F.lit(1.0))
    other = (F.col("_odd") - F.col("_symbols") - F.col("_digits") - F.col("_marks") - F.col("_commas") - F.col("_periods")) / chars
    made = [
        F.log1p(words), F.col("_inside") / each, F.col("_symbols") / each, F.col("_capitals") / letters, F.col("_digits") / chars, F.col("_marks") / each, F.col("_stops") / each,
        F.col("_commas") / each, F.col("_shouted") / letters, F.col("_stutters") / total, F.log1p(words / F.col("_lines")), F.col("_echoes") / total, other,
    ]
    return rows.select(*named, *[m.alias(n) for n, m in zip(STATISTICS, made)])


@dataclass(frozen=True)
class Rule:
    """A conjunction: for each statistic named, low < value <= high (None: open)."""

    bounds: tuple[tuple[str, float | None, float | None], ...]

    def column(self) -> Column:
        conditions = [F.col(n) > F.lit(low) for n, low, _ in self.bounds if low is not None] + [F.col(n) <= F.lit(high) for n, _, high in self.bounds if high is not None]
        return reduce(lambda a, b: a & b, conditions)

    def __str__(self) -> str:
        return " and ".join(f"{'' if low is None else f'{low:.4g} < '}{n}{'' if high is None else f' <= {high:.4g}'}" for n, low, high in self.bounds)


_CONDITION = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)$")


def rules_of(tree: str, names: Sequence[str]) -> list[Rule]:
    """The rules of one tree, from its description: a path to each node but the root."""
    out, path = [], []
    for line in tree.splitlines():
        found = _CONDITION.match(line)
        if not found:
            continue
        indent = len(found[1])
        path = [p for p in path if p[0] < indent] + [(indent, names[int(found[2])], found[3], float(found[4]))]
        low: dict[str, float] = {}
        high: dict[str, float] = {}
        for _, name, sign, value in path:
            if sign == ">":
                low[name] = max(value, low.get(name, value))
            else:
                high[name] = min(value, high.get(name, value))
        out.append(Rule(tuple((n, low.get(n), high.get(n)) for n in names if n in low or n in high)))
    return out


@dataclass(frozen=True)
class Ensemble:
    """score = logistic(bias + the weights of the rules that hold)."""

    bias: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Over the columns of ``statistics``."""
        z = reduce(lambda a, b: a + b, [F.when(r.column(), F.lit(w)).otherwise(0.0) for r, w in self.weights], F.lit(self.bias))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT_OF == HELD_OUT, F.lit(False))


def sample(rows: DataFrame, label: str, each: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``each`` rows of each label, the ones with the smallest hashes, with a weight that restores the labels' shares; and their counts."""
    counts = {int(r[0]): r[1] for r in rows.groupBy(label).count().collect()}
    total, out = sum(counts.values()), None
    for value, n in sorted(counts.items()):
        some = rows.filter(F.col(label) == value).orderBy(F.xxhash64("doc_id", *STATISTICS)).limit(each).withColumn("_weight", F.lit(n / min(n, each) / total * min(total, 2 * each)))
        out = some if out is None else out.union(some)
    return out, counts


def fit(rows: DataFrame, labels: DataFrame, label: str = "quality", each: int = SAMPLE_EACH, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Ensemble:
    """rows: doc_id and statistics. Labels of held-out documents are not read."""
    known = labels.filter(~held_out() & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
    met = settled(rows.join(known, F.col("doc_id") == F.col("_id")).select("doc_id", *STATISTICS, "_label"))
    chosen, counts = sample(met, "_label", each)
    if len(counts) < 2:
        return Ensemble({0: -30.0, 1: 30.0}[next(iter(counts))] if counts else 0.0, ())
    chosen = settled(chosen.coalesce(2))  # bounded by ``each``
    vectors = chosen.select(array_to_vector(F.array(*STATISTICS)).alias("features"), "_label", "_weight")
    forest = RandomForestClassifier(labelCol="_label", weightCol="_weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=5, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=SEED).fit(vectors)
    rules = sorted({r for t in forest.trees for r in rules_of(t.toDebugString, STATISTICS)}, key=str)
    if not rules:
        return Ensemble(math.log(counts[1] / counts[0]), ())
    held = settled(chosen.select(array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("features"), "_label", "_weight"))
    lasso = LogisticRegression(labelCol="_label", weightCol="_weight", regParam=penalty, elasticNetParam=1.0, standardization=False, maxIter=ROUNDS, tol=1e-5).fit(held)
    weights = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if w != 0.0]
    return Ensemble(float(lasso.intercept), tuple(weights))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = settled(statistics(docs))
    ensemble = fit(rows, labels, **options)
    scored = rows.select("doc_id", held_out().alias("held_out"), ensemble.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= KEPT_FROM).cast("int"))
