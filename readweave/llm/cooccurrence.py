"""Pairs of items that occur together, against a bipartite configuration null."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from readweave.operators.skew import lookup_join
from readweave.session import cut

#: -log10 of a p-value is ranked in steps of 1/STEPS up to FINE, and beyond, where no double holds the p-value
#: any more, in steps of a tenth of a per cent of itself.
STEPS, FINE, COARSE = 100, 400, 1000


def fit_null(degrees: np.ndarray, items: np.ndarray, sizes: np.ndarray, baskets: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Fugacity of each basket size in the bipartite configuration model.

    ``items[i]`` items have degree ``degrees[i]`` and ``baskets[s]`` baskets have size
    ``sizes[s]``. The model links item i and basket b with p = x_i y_b / (1 + x_i y_b) so that
    every expected degree and size equals the observed one. Items of one degree share x and
    baskets of one size share y, so the fit works on the two histograms, not on the data.
    """
    degrees, items = np.asarray(degrees, float), np.asarray(items, float)
    sizes, baskets = np.asarray(sizes, float), np.asarray(baskets, float)
    total = max((degrees * items).sum(), 1e-300)
    x, y = degrees / math.sqrt(total), sizes / math.sqrt(total)
    for _ in range(rounds):
        x = degrees / ((baskets * y) / (1 + np.outer(x, y))).sum(1)
        new = sizes / ((items * x)[:, None] / (1 + np.outer(x, y))).sum(0)
        done = np.allclose(new, y, rtol=1e-10, atol=0)
        y = new
        if done:
            break
    return y


def fugacity(degree: np.ndarray, y: np.ndarray, baskets: np.ndarray, rounds: int = 60) -> np.ndarray:
    """x of items of the given degrees when the baskets' y are known."""
    degree = np.asarray(degree, float)
    x = degree / max((baskets * y).sum(), 1e-300)
    for _ in range(rounds):
        x = degree / ((baskets * y) / (1 + np.outer(x, y))).sum(1)
    return x


def _log_upper_normal(w: np.ndarray) -> np.ndarray:
    """log of the standard normal's upper tail, exact to double precision far out as well."""
    out = np.empty_like(w)
    near = w < 5
    out[near] = [math.log(0.5 * math.erfc(v / math.sqrt(2))) for v in w[near]]
    far = w[~near]
    frac = np.zeros_like(far)
    for k in range(60, 0, -1):
        frac = k / (far + frac)
    out[~near] = -0.5 * far * far - 0.5 * math.log(2 * math.pi) - np.log(far + frac)
    return out


def surprise(n12: np.ndarray, q: np.ndarray, baskets: np.ndarray) -> np.ndarray:
    """-log10 P(X >= n12) for X a sum of independent Binomial(baskets[s], q[:, s]).

    A Poisson-binomial whose trials come in classes; its tail is taken by the saddlepoint
    (Lugannani-Rice with the lattice correction), whose relative error stays small far out,
    where exact convolution cannot go.
    """
    k, q = np.asarray(n12, float), np.clip(np.asarray(q, float), 1e-300, 1 - 1e-12)
    mean, most = q @ baskets, baskets.sum()
    with np.errstate(all="ignore"):
        t = np.log(np.maximum(k, 0.5)) - np.log(mean)
        for _ in range(50):
            e = q * np.exp(np.clip(t, -300, 300))[:, None]
            p = e / (1 - q + e)
            slope = np.maximum((p * (1 - p)) @ baskets, 1e-300)
            t = t - np.clip((p @ baskets - np.minimum(k, most - 1e-9)) / slope, -1, 1)
        e = q * np.exp(np.clip(t, -300, 300))[:, None]
        p = e / (1 - q + e)
        cumulant, spread = np.log1p(e - q) @ baskets, np.maximum((p * (1 - p)) @ baskets, 1e-300)
        w = np.sign(t) * np.sqrt(np.maximum(2 * (t * k - cumulant), 0))
        u = -np.expm1(-t) * np.sqrt(spread)
        close = np.abs(w) < 1e-4
        w, u = np.where(close, 1.0, w), np.where(close, 1.0, u)
        log_sf = _log_upper_normal(w)
        log_pdf = -0.5 * w * w - 0.5 * math.log(2 * math.pi)
        log_p = log_sf + np.log(np.maximum(1 + np.exp(log_pdf - log_sf) * (1 / u - 1 / w), 1e-12))
        # at the mean the formula is 0 / 0; there the normal with half a step of correction serves
        log_p = np.where(close, _log_upper_normal((k - 0.5 - mean) / np.sqrt(spread)), log_p)
    log_p = np.where(k <= 0, 0.0, log_p)
    return np.maximum(-np.minimum(log_p, 0.0) / math.log(10), 0.0)


def _surprise_column(n12: Column, d1: Column, d2: Column, y: np.ndarray, baskets: np.ndarray) -> Column:
    """The surprise, and that of the pair being there at all, as a struct; ``y`` and ``baskets`` are those of the
    fitted null, the last ones of baskets of both items."""

    @F.arrow_udf(T._parse_datatype_string("struct<all:double,seen:double>"))
    def run(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for part in parts:
            a, b, c = (np.asarray(x.to_numpy(zero_copy_only=False), dtype=float) for x in part)
            value, seen = np.zeros(len(a)), np.zeros(len(a))
            if len(a) and len(y):
                q = linked(b, y, baskets) * linked(c, y, baskets)
                value = surprise(a, q[:, None], baskets[-1:])
                seen = -np.log10(np.maximum(-np.expm1(baskets[-1] * np.log1p(-np.minimum(q, 1 - 1e-12))), 1e-300))
            yield pa.StructArray.from_arrays([pa.array(value), pa.array(seen)], ["all", "seen"])

    return run(n12, d1, d2)


def linked(degree: np.ndarray, y: np.ndarray, baskets: np.ndarray) -> np.ndarray:
    """The null's probability that an item of each degree is in a given basket of the largest size."""
    kinds, place = np.unique(degree, return_inverse=True)
    x = fugacity(kinds, y, baskets) * y[-1]
    return (x / (1 + x))[place]


def cooccurrence(
    records: DataFrame, left: str, right: str, weight: str, min_count: int = 0, null: bool = True
) -> DataFrame:
    """Weighted counts of (left, right) values that one record holds together, and their surprise.

    Every record is a basket of its left and its right item, taken ``weight`` times; a record in
    which one item is null is a basket of size one. The records are reduced to pair states first
    (with map-side combining, so a hot item arrives at the shuffles as few states), which are
    written once; all counts come from them. ``n12`` is the exact pair count, ``n1``, ``n2`` and ``total``
    are those of the records with both items, ``d1`` and ``d2`` the items' counts over all records.

    The null is the bipartite configuration model fitted to every item's frequency d and every
    basket's size (see :func:`fit_null`; frequencies enter the fit as a histogram in steps of
    1 %, so it is bounded and off by at most half of that). n12 is Poisson-binomial under it,
    ``surprise`` is -log10 of its upper tail, ``surprise_seen`` that of the tail given that the pair occurs at
    all, and ``observed`` the number of pairs that do.

    Result: ``left, right, n12, n1, n2, total, expected, lift`` and, with ``null``, ``d1, d2, observed,
    surprise, surprise_seen``, for pairs with n12 >= ``min_count``; counts always cover all records. Null weights
    are 0. Repeated records add up; an empty table gives an empty result; only the three named
    columns are read.
    """
    rows = records.select(
        records[left].alias("left"), records[right].alias("right"),
        F.coalesce(records[weight], F.lit(0)).cast("bigint").alias("w"),
    )
    states = cut(rows.where(F.col("left").isNotNull() | F.col("right").isNotNull()).groupBy("left", "right").agg(F.sum("w").alias("n12")))
    both = F.col("left").isNotNull() & F.col("right").isNotNull()
    counts = [states.where(F.col(side).isNotNull()).groupBy(side).agg(F.sum(F.when(both, F.col("n12"))).alias(f"n{i}"), F.sum("n12").alias(f"d{i}"), F.count(F.lit(1)).alias(f"__k{i}")) for i, side in ((1, "left"), (2, "right"))]
    number = lambda when, what: F.coalesce(F.sum(F.when(when, what)), F.lit(0))
    total, alone, observed = states.agg(number(both, F.col("n12")), number(~both, F.col("n12")), number(both & (F.col("n12") > 0), F.lit(1))).first()
    pairs = states.where(both & (F.col("n12") >= min_count))
    # an item with very many partners finds its counts by broadcast
    out = lookup_join(lookup_join(pairs, counts[0], ["left"], "__k1"), counts[1], ["right"], "__k2").withColumn("total", F.lit(total).cast("bigint"))
    expected = F.col("n1").cast("double") * F.col("n2").cast("double") / F.nullif(F.col("total"), F.lit(0)).cast("double")
    out = out.withColumn("expected", expected).withColumn(
        "lift", F.when(F.col("expected") > 0, F.col("n12") / F.col("expected"))
    )
    known = ["left", "right", "n12", "n1", "n2", "total", "expected", "lift"]
    if not null:
        return out.select(*known)
    y, baskets = _fit(counts[0], counts[1], alone, total)
    out = out.withColumn("__x", F.when(F.col("expected") > 0, _surprise_column(F.col("n12"), F.col("d1"), F.col("d2"), y, baskets)))
    seen = F.greatest(F.col("__x.all") - F.col("__x.seen"), F.lit(0.0)).alias("surprise_seen")
    return out.select(*known, "d1", "d2", F.lit(observed).alias("observed"), F.col("__x.all").alias("surprise"), seen)


def _fit(lefts: DataFrame, rights: DataFrame, alone: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The null fitted to two bounded histograms: degrees in steps of 1 %, and two basket sizes."""
    degree = lefts.select(F.col("d1").alias("d")).union(rights.select("d2")).where("d > 0")
    step = F.round(F.log("d") * 100).cast("int")
    hist = degree.groupBy(step.alias("b")).agg(F.avg("d").alias("d"), F.count(F.lit(1)).alias("n")).collect()
    baskets = np.array([alone, total], float)
    used = baskets > 0
    if not used[1] or not hist:
        return np.empty(0), np.empty(0)
    y = fit_null([r["d"] for r in hist], [r["n"] for r in hist], np.array([1.0, 2.0])[used], baskets[used])
    return y, baskets[used]


def with_false_discovery(pairs: DataFrame, surprise: str = "surprise_seen", tests: str = "observed") -> DataFrame:
    """Add ``q_value``, the Benjamini-Hochberg bound over all pairs that occur.

    Pairs that do not occur are not tested, so each p-value is the tail given that the pair occurs.
    The ranks come from a table of -log10 p in steps (40,001 of them up to FINE, beyond it one per
    thousandth, so its size follows the logarithm of the surprise and it is broadcast) instead of
    a global sort; rounding goes to the careful side, so q_value never lies below the exact one
    and is at most 2.4 % above it at the same rank. Where ``pairs`` are some of the tested ones
    only, such as those of a least count, ranks count those given, which can only raise q_value.
    Pairs without surprise have no q_value.
    """
    s = F.col(surprise)
    step = F.when(s < FINE, F.floor(s * STEPS)).otherwise(FINE * STEPS + F.floor(F.log(F.greatest(s, F.lit(1.0)) / FINE) * COARSE)).cast("int")
    rows = cut(pairs.withColumn("__b", step))  # read twice below: for the ranks and for the result
    table = rows.where(F.col("__b").isNotNull()).groupBy("__b").agg(F.count(F.lit(1)).alias("__n"), F.max(tests).cast("double").alias("__m"))
    above = Window.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    # from FINE on the p-value is below the smallest double, and so is the bound
    raw = F.col("__m") * F.pow(F.lit(10.0), -F.least(F.col("__b") / STEPS, F.lit(float(FINE)))) / F.sum("__n").over(above)
    table = table.withColumn("__q", raw).select("__b", F.least(F.min("__q").over(below), F.lit(1.0)).alias("q_value"))
    return rows.join(F.broadcast(table), "__b", "left").drop("__b")


def discoveries(pairs: DataFrame, level: float) -> DataFrame:
    """The pairs the null rejects at a false-discovery rate of ``level``."""
    return with_false_discovery(pairs).where(F.col("q_value") <= level)
