"""Entropies, cross-entropies and softmax over probability and logit arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curate.functions.base import ColumnLike, col, let

TARGET_FLOOR = 1e-9
PREDICTION_FLOOR = 1e-7


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def clip(v: Column, floor: float) -> Column:
    return F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(1.0)), F.lit(floor)))


def entropy(target: ColumnLike) -> Column:
    """-sum t ln t, with t floored at 1e-9 inside the logarithm."""
    return -total(F.transform(col(target), lambda t: t * F.ln(clip(t, TARGET_FLOOR))))


def soft_ce(target: ColumnLike, predicted: ColumnLike) -> Column:
    """-sum t ln p, with p floored at 1e-7."""
    return -total(F.zip_with(col(target), col(predicted), lambda t, p: t * F.ln(clip(p, PREDICTION_FLOOR))))


def hard_ce(cls: ColumnLike, predicted: ColumnLike) -> Column:
    """-ln p[class], with p floored at 1e-9."""
    return -F.ln(clip(F.get(col(predicted), col(cls)), TARGET_FLOOR))


def argmax(values: ColumnLike) -> Column:
    """0-based position of the first largest element."""
    v = col(values)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def logit_ce(logits: ColumnLike, target: ColumnLike) -> Column:
    """Cross-entropy of a target index under softmax(logits), by a shifted log-sum-exp."""
    z = col(logits)

    def lse(top: Column) -> Column:
        return top + F.ln(total(F.transform(z, lambda v: F.exp(v.cast("double") - top))))

    return let(F.array_max(z).cast("double"), lse) - F.get(z, col(target))


def legal_priors(logits: ColumnLike, allowed: ColumnLike) -> Column:
    """Softmax of the allowed logits, in the order of ``allowed``; sums to 1."""
    picked = F.transform(col(allowed), lambda i: F.get(col(logits), i).cast("double"))

    def shifted(z: Column) -> Column:
        return let(F.array_max(z), lambda top: F.transform(z, lambda v: F.exp(v - top)))

    def normalised(weight: Column) -> Column:
        return let(total(weight), lambda s: F.transform(weight, lambda w: w / s))

    return let(let(picked, shifted), normalised)


def masked_softmax(logits: ColumnLike, allowed: ColumnLike) -> Column:
    """Softmax over the allowed indices only, as long as ``logits``, with 0 elsewhere."""
    keep = col(allowed)
    place = let(
        legal_priors(logits, allowed),
        lambda p: F.transform(
            F.sequence(F.lit(0), F.size(col(logits)) - 1),
            lambda i: F.coalesce(F.get(p, (F.array_position(keep, i) - 1).cast("int")), F.lit(0.0)),
        ),
    )
    return place
