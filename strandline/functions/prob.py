"""Column expressions for probabilities: phred scales, log space, genotype and depth likelihoods.

Spark's ln(0) is null; these helpers give minus infinity, as likelihoods need.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least decimal exponent of an error probability: phred values end at 3070.
LEAST_EXPONENT = -307
MINUS_INFINITY = float("-inf")


def ln(x: Column) -> Column:
    return F.when(x > 0, F.log(x)).when(x <= 0, F.lit(MINUS_INFINITY))


def phred(error: Column) -> Column:
    log10 = F.when(error > 0, F.log10(error)).otherwise(F.lit(float(LEAST_EXPONENT)))
    return F.greatest(log10, F.lit(float(LEAST_EXPONENT))) * -10.0


def ln_phred(ln_error: Column) -> Column:
    return F.greatest(ln_error / math.log(10), F.lit(float(LEAST_EXPONENT))) * -10.0


def rounded_phred(error: Column, most: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(most), F.round(phred(error)).cast("int")))


def log_sum(a: Column, b: Column) -> Column:
    """ln(e^a + e^b)."""
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(high == MINUS_INFINITY, high).otherwise(high + F.log1p(F.exp(low - high)))


def normalised(values: Sequence[Column]) -> list[Column]:
    """Probabilities from unscaled logarithms."""
    most = F.greatest(*values)
    parts = [F.exp(v - most) for v in values]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def first_argmax(values: Sequence[Column]) -> Column:
    """The index of the largest value; the first on a tie."""
    return F.array_position(F.array(*values), F.greatest(*values)).cast("int") - 1


def complement(values: Sequence[Column], i: int) -> Column:
    """The sum of all but one: more exact than 1 - p near 1."""
    rest = [v for k, v in enumerate(values) if k != i]
    return sum(rest[1:], rest[0])


# --- genotypes from allele counts ---

#: The chance that a read supports the wrong allele, and the prior of a variant per site.
ERROR, THETA = 1e-5, 5e-4


def genotype_logs(ref: Column, alt: Column, haploid: Column) -> list[Column]:
    """ln P(counts | hom ref, het, hom alt); a haploid sample can't be het."""
    right, wrong, half = math.log(1 - ERROR), math.log(ERROR), math.log(0.5)
    return [
        ref * F.lit(right) + alt * F.lit(wrong),
        F.when(haploid, F.lit(MINUS_INFINITY)).otherwise((ref + alt) * F.lit(half)),
        ref * F.lit(wrong) + alt * F.lit(right),
    ]


def genotype_priors(haploid: Column) -> list[Column]:
    """ln priors: diploid (1 - 1.5 theta, theta, theta / 2); haploid (1 - theta, none, theta)."""
    return [
        F.when(haploid, F.lit(math.log(1 - THETA))).otherwise(F.lit(math.log(1 - 1.5 * THETA))),
        F.when(haploid, F.lit(MINUS_INFINITY)).otherwise(F.lit(math.log(THETA))),
        F.when(haploid, F.lit(math.log(THETA))).otherwise(F.lit(math.log(THETA / 2))),
    ]


def phred_likelihoods(logs: Sequence[Column], most: int = 999) -> list[Column]:
    """PL: phred-scaled distance of each likelihood to the best."""
    best = F.greatest(*logs)
    return [F.least(F.lit(most), F.round(ln_phred(v - best)).cast("int")) for v in logs]
