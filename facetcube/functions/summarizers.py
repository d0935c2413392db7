"""Exponentially weighted states of irregular samples, as built-in column expressions.

A state is a sum of decayed terms, so it is built by plain sums, merged by
decaying every part to the latest time and adding, and finished by a division.
For samples (x_i, t_i) with T = max t:

    w = sum e^-(T-t_i)/alpha         s = sum x_i e^-(T-t_i)/alpha
    v, u: the same with the exponent times k / (k - 1)   (Canny kinds)
    rates: w and v follow from T and T0 = min t

Kinds: exp_avg, exp_rate, exp_biased_binomial, canny_avg, canny_rate,
canny_biased_binomial. Samples with a null value or time are skipped; an empty
state is null. Sums do not depend on the order of the samples, so late ones
need no treatment of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetcube.functions.folding import Decaying, fold

KINDS = ("exp_avg", "exp_rate", "exp_biased_binomial", "canny_avg", "canny_rate", "canny_biased_binomial")


@dataclass(frozen=True)
class Summarizer:
    """Parameters of a kind: ``dt`` ms after which a sample's weight has fallen to ``m``; ``k`` of the Canny kinds; ``p0`` and ``epsilon`` of the bias."""

    kind: str
    dt: float
    m: float = 0.01
    k: float = 4.0
    p0: float | None = None
    epsilon: float | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown summarizer type {self.kind!r}; known: {', '.join(KINDS)}")
        if not self.dt > 0 or not 0 < self.m < 1 or not self.k > 1:
            raise ValueError("dt must be positive, m between 0 and 1, k above 1")
        if self.biased and not (self.p0 is not None and 0 < self.p0 < 1):
            raise ValueError("a biased binomial needs p0 between 0 and 1")

    @property
    def canny(self) -> bool:
        return self.kind.startswith("canny")

    @property
    def rate(self) -> bool:
        return self.kind.endswith("rate")

    @property
    def biased(self) -> bool:
        return self.kind.endswith("binomial")

    @property
    def supports_complement(self) -> bool:
        return not self.rate

    @property
    def alpha(self) -> float:
        return -self.dt / math.log(self.m / self.k if self.canny else self.m)

    @property
    def beta(self) -> float:
        """Time constant of the second exponent."""
        return self.alpha * (self.k - 1) / self.k

    @property
    def sums(self) -> tuple[str, ...]:
        """Fields that decay and add."""
        return tuple(f for f in ("w", "v", "s", "u") if (self.canny or f in "ws") and not (self.rate and f in "wv"))

    @property
    def fields(self) -> tuple[str, ...]:
        return (*self.sums, "t", *(("t0",) if self.rate else ()))

    def tau(self, f: str) -> float:
        return self.beta if f in "vu" else self.alpha

    # --- aggregation -----------------------------------------------------------------

    def decaying(self, time: str, value: Callable[[str], str], first: str, prefix: str = "") -> Decaying:
        """What ``folding.fold`` adds up: ``value`` gives the SQL of a field at ``time``; ``first`` is that of the first time."""
        return Decaying(time, [(prefix + f, value(f), self.tau(f)) for f in self.sums], [(prefix + "t0", first)] if self.rate else [], [prefix + "t"])

    def of_samples(self, x: str, t: str, prefix: str = "") -> Decaying:
        """State of the samples in the columns ``x`` and ``t`` (doubles, both null where there is none)."""
        return self.decaying(f"`{t}`", lambda f: f"`{x}`" if f in "su" else f"case when `{x}` is not null then 1D end", f"`{t}`", prefix)

    def of_states(self, prefix: str = "", weight: str | None = None) -> Decaying:
        """State of all states in the columns of ``prefix``. ``weight``: column of factors; -1 takes a state away."""
        times = f" * `{weight}`" if weight else ""
        return self.decaying(f"`{prefix}t`", lambda f: f"`{prefix}{f}`{times}", f"`{prefix}t0`", prefix)

    def summarize(self, df: DataFrame, keys: Sequence[str], x: Column, t: Column, name: str = "state") -> DataFrame:
        """State struct of each group of samples; samples with a null or NaN are left out."""
        samples = df.select(*keys, x.cast("double").alias("_x"), t.cast("double").alias("_t")).filter("_x is not null and _t is not null and not isnan(_x) and not isnan(_t)")
        out = fold(samples, keys, [], [self.of_samples("_x", "_t")])
        return out.filter("t is not null").select(*keys, F.struct(*self.fields).alias(name))

    # --- scalar algebra over state structs ---------------------------------------------

    def _struct(self, fields: dict[str, Column]) -> Column:
        return F.struct(*(c.alias(f) for f, c in fields.items()))

    def _decayed(self, state: Column, f: str, to: Column) -> Column:
        return state[f] * F.exp((state["t"] - to) / self.tau(f))

    def new(self) -> Column:
        """An empty state."""
        return F.lit(None).cast("struct<" + ", ".join(f"{f}: double" for f in self.fields) + ">")

    def combine(self, *states: Column) -> Column:
        """The state of disjoint histories together; null states are empty ones."""
        some = F.filter(F.array(*states), lambda s: s.isNotNull())
        latest = F.array_max(F.transform(some, lambda s: s["t"]))

        def total(f: str) -> Column:
            return F.aggregate(some, F.lit(0.0), lambda a, s: a + s[f] * F.exp((s["t"] - latest) / self.tau(f)))

        fields = {f: total(f) for f in self.sums}
        fields["t"] = latest
        if self.rate:
            fields["t0"] = F.array_min(F.transform(some, lambda s: s["t0"]))
        return F.when(F.size(some) > 0, self._struct(fields))

    def weighted(self, state: Column, now: Column | None = None) -> dict[str, Column]:
        """w, v, s, u at ``now`` (default: the state's own time), for rates with w and v from its span."""
        at = state["t"] if now is None else F.greatest(state["t"], now)
        out = {f: self._decayed(state, f, at) for f in self.sums}
        if self.rate:
            span = at - state["t0"]
            out["w"] = self.alpha * (1 - F.exp(-span / self.alpha))
            if self.canny:
                out["v"] = self.beta * (1 - F.exp(-span / self.beta))
        return out

    def complement(self, whole: Column, part: Column, stretch: bool = False) -> Column:
        """The state of ``whole`` without ``part``, in the fields of an average (w, v, s, u, t).

        ``part`` must not end after ``whole``, unless ``stretch`` decays the
        whole to the part's time; else null. Rates: the part must be a
        contiguous beginning or end of the whole.
        """
        latest = F.greatest(whole["t"], part["t"]) if stretch else whole["t"]
        a, b = self.weighted(whole, latest), self.weighted(part)
        decay = lambda f: F.exp((part["t"] - latest) / self.tau(f))
        fields = {f: a[f] - b[f] * decay(f) for f in ("w", "v", "s", "u") if f in a} | {"t": latest}
        out = self._struct(fields)
        return F.when(part.isNull(), self._struct(self.weighted(whole) | {"t": whole["t"]})).when(F.lit(stretch) | (whole["t"] >= part["t"]), out)

    def ones(self, state: Column, positives: Column) -> Column:
        """Add the history of the ones alone (of a binomial whose zeros, or all trials, are in ``state``)."""
        latest = F.greatest(state["t"], positives["t"])
        fields = {f: self._decayed(state, f, latest) + (self._decayed(positives, f, latest) if f in "su" else 0) for f in self.sums} | {"t": latest}
        return F.when(positives.isNull(), state).otherwise(self._struct(fields))

    def _ratio(self, p: dict[str, Column], plus: float = 0.0, minus: float = 0.0) -> Column:
        top, bottom = p["s"], p["w"]
        if self.canny:
            top, bottom = self.k * p["s"] - (self.k - 1) * p["u"], self.k * p["w"] - (self.k - 1) * p["v"]
        total = bottom + (plus + minus)
        return F.when(total == 0, 0.0).otherwise((top + plus) / total)

    def value(self, state: Column) -> Column:
        """The average or rate; 0 without weight (a rate of a single sample); null for an empty state. Unbiased for all kinds."""
        names = ["w", "s", *(["v", "u"] if self.canny else [])]
        p = self.weighted(state) if self.rate else {f: state[f] for f in names}
        return F.when(state.isNotNull(), F.when(p["w"] == 0, 0.0).otherwise(self._ratio(p)))

    def value_of_parts(self, state: Column) -> Column:
        """The value of a state in the fields of an average, as ``complement`` gives it."""
        p = {f: state[f] for f in ("w", "s", *(("v", "u") if self.canny else ()))}
        return F.when(state.isNotNull(), F.when(p["w"] == 0, 0.0).otherwise(self._ratio(p)))

    def bias(self) -> tuple[float, float]:
        """Weights (of ones, of zeros) that pull an estimate towards p0."""
        eps = self.epsilon if self.epsilon is not None else 0.3 if self.canny else 0.5
        unit = (eps - 1) / math.log(eps)
        p = self.p0
        return (unit * p / (1 - p), unit) if p >= 0.5 else (unit, unit * (1 - p) / p)

    def value_now(self, state: Column, now: Column) -> Column:
        """The value at a later time: averages stay, rates fall, biased binomials return to p0."""
        if self.biased:
            return F.when(state.isNotNull(), self._ratio(self.weighted(state, now), *self.bias()))
        if self.rate:
            p = self.weighted(state, now)
            return F.when(state.isNotNull(), F.when(p["w"] == 0, 0.0).otherwise(self._ratio(p)))
        return self.value(state)

    def biased_value(self, state: Column) -> Column:
        """The estimate with its bias at the state's own time."""
        return self.value_now(state, state["t"])

    def first_time(self, state: Column) -> Column:
        """Time of the first sample of a rate."""
        return state["t0"]


def parse_init(text: str) -> Summarizer:
    """A summarizer from ``type=CANNY_AVG dt=600000 m=0.01 k=4 p0=0.25 epsilon=0.5``."""
    given: dict[str, str] = {}
    for part in text.split():
        key, eq, value = part.partition("=")
        if not eq or not value:
            raise ValueError(f"expected key=value, got {part!r}")
        if key in given:
            raise ValueError(f"{key} is given twice")
        given[key] = value
    unknown = set(given) - {"type", "dt", "m", "k", "p0", "epsilon"}
    if unknown:
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    if "type" not in given or "dt" not in given:
        raise ValueError("type and dt are required")
    return Summarizer(given["type"].lower(), **{k: float(v) for k, v in given.items() if k != "type"})


# --- running mean and variance ------------------------------------------------------------

WELFORD = "struct<n: double, mean: double, m2: double>"


def welford(x: Column) -> Column:
    """State (n, mean, sum of squared deviations) of the non-null values of a group; null for none."""
    n = F.count(x).cast("double")
    return F.when(n > 0, F.struct(n.alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * n).alias("m2")))


def welford_merge(df: DataFrame, keys: Sequence[str], state: str, most: float = 1e8) -> DataFrame:
    """States (in the column ``state``) merged by ``keys``: the keys and ``state``; groups without a value are left out.

    Squares are taken of the deviations from the group's mean, which a first
    aggregate gives, so nothing cancels for large means; both aggregates
    combine before the shuffle. ``most`` caps n, as in ``welford_combine``.
    """
    parts = df.select(*keys, F.col(state).alias("_s")).filter("_s.n > 0")
    whole = parts.groupBy(*keys).agg(F.sum("_s.n").alias("_n"), (F.sum(F.col("_s.n") * F.col("_s.mean")) / F.sum("_s.n")).alias("_mean"))
    own = whole.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_n", "_mean")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    d = F.col("_s.mean") - F.col("_mean")
    m2 = F.sum(F.col("_s.m2") + F.col("_s.n") * d * d)
    merged = parts.join(own, same).groupBy(*keys).agg(F.max("_n").alias("_n"), F.max("_mean").alias("_mean"), m2.alias("_m2"))
    kept = F.least("_n", F.lit(most))
    return merged.select(*keys, F.struct(kept.alias("n"), F.col("_mean").alias("mean"), (F.col("_m2") * kept / F.col("_n")).alias("m2")).alias(state))


def welford_combine(a: Column, b: Column, most: float = 1e8) -> Column:
    """Two states merged, by the exact formula; ``most`` caps n, so that old values are forgotten."""
    n, d = a["n"] + b["n"], b["mean"] - a["mean"]
    kept = F.least(n, F.lit(most))
    out = F.struct(kept.alias("n"), (a["mean"] + d * b["n"] / n).alias("mean"), ((a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n) * kept / n).alias("m2"))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(out)


def welford_variance(s: Column) -> Column:
    return s["m2"] / s["n"]
