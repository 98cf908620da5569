"""Numeric objectives over distributions of student and teacher, as native array expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; a column used inside a lambda would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def log_sum_exp(xs: Column) -> Column:
    return let(xs, lambda v: let(F.array_max(v), lambda m: m + F.log(total(F.transform(v, lambda x: F.exp(x - m))))))


def log_softmax(xs: Column) -> Column:
    return let(xs, lambda v: let(log_sum_exp(v), lambda lse: F.transform(v, lambda x: x - lse)))


def top_k(log_probs: Column, k: int) -> Column:
    """The k largest as structs (lp, i), largest first; of equal ones the smaller position."""
    keyed = F.transform(log_probs, lambda x, i: F.struct((-x).alias("m"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: F.struct((-s["m"]).alias("lp"), s["i"].alias("i")))


def at(log_probs: Column, picks: Column) -> Column:
    return F.transform(picks, lambda s: log_probs[s["i"]])


def _tail(lps: Column) -> Column:
    return F.greatest(1.0 - total(F.transform(lps, F.exp)), F.lit(1e-12))


def cross_entropy_top_k(teacher: Column, student: Column, k: int) -> Column:
    """−Σ p_t log p_s over the teacher's k likeliest ids."""
    def value(d: Column) -> Column:
        return let(top_k(d["t"], k), lambda picks: -total(F.zip_with(F.transform(picks, lambda s: F.exp(s["lp"])), at(d["s"], picks), lambda p, q: p * q)))

    return let(F.struct(teacher.alias("t"), student.alias("s")), value)


def _divergence(lp: Column, lq: Column) -> Column:
    """KL over picked ids and one cell for all others, from the log probabilities of the picks."""
    body = total(F.zip_with(lp, lq, lambda a, b: F.exp(a) * (a - b)))
    return let(_tail(lp), lambda tp: let(_tail(lq), lambda tq: body + tp * (F.log(tp) - F.log(tq))))


def kl_top_k_tail(p: Column, q: Column, k: int) -> Column:
    """KL of p from q over the k likeliest ids of p and one cell for all others.

    With the teacher as p it is the forward, with the student as p the reverse divergence. Raises where the
    mass of the picks exceeds 1.01.
    """
    def checked(s: Column) -> Column:
        mass = total(F.transform(s["lp"], F.exp))
        return F.when(mass <= 1.01, _divergence(s["lp"], s["lq"])).otherwise(F.raise_error(F.lit("mass above one")).cast("double"))

    bound = let(
        F.struct(p.alias("p"), q.alias("q")),
        lambda d: let(top_k(d["p"], k), lambda picks: F.struct(F.transform(picks, lambda s: s["lp"]).alias("lp"), at(d["q"], picks).alias("lq"))),
    )
    return let(bound, checked)


#: The smallest normal 32-bit float, below which probabilities are not told apart from none.
TINY = 1.1754943508222875e-38


def stored_forward_kl(student: Column, ids: Column, lps: Column) -> Column:
    """Forward KL of a stored teacher row, its top ids and their log probabilities, with all other ids as one cell.

    A mass above one by at most 0.01, as rounding leaves it, is scaled back to one; a larger one, an empty row, repeated
    ids and values that are not finite are errors. Null rows give null.
    """
    def value(d: Column) -> Column:
        def kl(p: Column) -> Column:
            q = F.transform(d["i"], lambda i: d["s"][i])
            body = total(F.zip_with(p, q, lambda a, b: a * (F.log(F.greatest(a, F.lit(TINY))) - b)))
            rest = lambda mass: F.greatest(1.0 - mass, F.lit(0.0))
            tp, tq = rest(total(p)), rest(total(F.transform(q, F.exp)))
            return body + tp * (F.log(F.greatest(tp, F.lit(TINY))) - F.log(F.greatest(tq, F.lit(TINY))))

        def checked(mass: Column) -> Column:
            fail = lambda text: F.raise_error(F.lit(text)).cast("double")
            scaled = F.transform(d["t"], lambda x: F.exp(x) / F.greatest(mass, F.lit(1.0)))
            return (
                F.when(F.size(d["i"]) == 0, fail("empty support"))
                .when(F.size(F.array_distinct(d["i"])) < F.size(d["i"]), fail("repeated ids"))
                .when(F.isnan(mass) | (F.abs(mass) == float("inf")), fail("values are not finite"))
                .when(mass > 1.01, fail("mass above one"))
                .otherwise(let(scaled, kl))
            )

        return let(total(F.transform(d["t"], F.exp)), checked)

    bound = F.struct(student.alias("s"), ids.alias("i"), lps.alias("t"))
    return F.when(ids.isNotNull() & lps.isNotNull(), let(bound, value))


def support_reverse_kl(student: Column, teacher: Column, support: Column) -> Column:
    """Reverse KL over given ids, repeated ids once, with the rest as one cell."""
    bound = let(
        F.struct(student.alias("s"), teacher.alias("t"), F.array_distinct(support).alias("i")),
        lambda d: F.struct(F.transform(d["i"], lambda i: d["s"][i]).alias("lp"), F.transform(d["i"], lambda i: d["t"][i]).alias("lq")),
    )
    return let(bound, lambda s: _divergence(s["lp"], s["lq"]))


def k3(policy: Column, reference: Column, ratio: float = 20.0, clip: float = 10.0) -> Column:
    """The sampled estimator exp(r) − r − 1 of a log ratio r, both clipped."""
    r = F.greatest(F.least(reference - policy, F.lit(ratio)), F.lit(-ratio))
    return F.greatest(F.least(F.exp(r) - r - 1.0, F.lit(clip)), F.lit(-clip))


def choice_cross_entropy(logits: Column, gold: Column) -> Column:
    return log_sum_exp(logits) - logits[gold]


def argmax(logits: Column) -> Column:
    """Position of the first maximum."""
    return F.array_position(logits, F.array_max(logits)) - 1


def norms(xs: Column) -> tuple[Column, Column]:
    return total(F.transform(xs, F.abs)), F.sqrt(total(F.transform(xs, lambda x: x * x)))


def merge_chunks(chunks: Column, ranks: Column, width: int) -> Column:
    """Chunks side by side, each cut to its rank and padded with zeros to ``width``."""
    return F.flatten(
        F.zip_with(chunks, ranks, lambda c, r: F.concat(F.slice(c, 1, r), F.array_repeat(F.lit(0.0), F.lit(width) - F.size(F.slice(c, 1, r)))))
    )


def combine_chunks(chunks: Column, most: int, rank: int, bias: Column | None = None, scale: float = 1.0) -> Column:
    """The rank rows of a context's chunks one after another, then the bias rows times ``scale``, then zeros up to
    ``(most + 1) * rank`` rows, ``most`` being the largest number of chunks of any context. Chunks are arrays of ``rank``
    rows, rows are arrays of one width.
    """
    rows = F.flatten(chunks)
    if bias is not None:
        rows = F.concat(rows, F.transform(bias, lambda r: F.transform(r, lambda x: x * scale)))
    zero = F.transform(F.get(F.get(chunks, F.lit(0)), F.lit(0)), lambda x: F.lit(0.0))
    return F.concat(rows, F.array_repeat(zero, F.lit((most + 1) * rank) - F.size(rows)))


def warmup_cosine(step: Column, warmup: int, steps: int) -> Column:
    """Factor of the learning rate: linear warm-up, then half a cosine down to 0."""
    progress = F.least((step - warmup) / F.lit(float(max(1, steps - warmup))), F.lit(1.0))
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(0.5 * (1.0 + F.cos(F.lit(math.pi) * progress)))
