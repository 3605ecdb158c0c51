"""Statistics: correlations by built-ins, tests by closed forms."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(x, y).alias("r"))


def mean_ranks(df: DataFrame, x: str) -> DataFrame:
    """(value, rank): mean ranks of the distinct values of x."""
    from strandlake.operators.reads import with_running_sum

    counted = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return with_running_sum(counted, "value", "n").select("value", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's correlation of mean ranks, over rows with both values."""
    both = df.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null")
    a = mean_ranks(both, "x").select(F.col("value").alias("x"), F.col("rank").alias("rx"))
    b = mean_ranks(both, "y").select(F.col("value").alias("y"), F.col("rank").alias("ry"))
    return both.join(a, "x").join(b, "y").agg(F.corr("rx", "ry").alias("rho"))


def chi_square(df: DataFrame, x: str, y: str) -> DataFrame:
    """(chi2, df, p) of the contingency table of two columns."""
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy("x").agg(F.sum("n").alias("rx"))
    cols = cells.groupBy("y").agg(F.sum("n").alias("cy"))
    # n * (sum over cells of n_xy^2 / (n_x n_y) - 1); empty cells add nothing
    parts = cells.join(rows, "x").join(cols, "y").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / (F.col("rx") * F.col("cy"))).alias("q"), F.countDistinct("x").alias("r"), F.countDistinct("y").alias("c"))
    freedom = ((F.col("r") - 1) * (F.col("c") - 1)).cast("long")
    p = special(lambda a, x: 1.0 if x <= 0 else gamma_q(a, x))
    out = parts.select((F.col("n") * (F.col("q") - 1)).alias("chi2"), freedom.alias("df"))
    return out.withColumn("p", p(F.col("df") / 2, F.col("chi2") / 2))


def special(f: Callable[..., float]):
    """A pandas UDF of a scalar function of doubles; null where an argument is."""

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        rows = zip(*columns, strict=True)
        return pd.Series([None if any(pd.isna(v) for v in row) else f(*row) for row in rows], dtype="float64")

    return run


def gamma_q(a: float, x: float) -> float:
    """The upper regularised incomplete gamma function."""
    return 1.0 - gamma_p(a, x) if x < a + 1 else _gamma_fraction(a, x)


def gamma_p(a: float, x: float) -> float:
    """The lower regularised incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x >= a + 1:
        return 1.0 - _gamma_fraction(a, x)
    term = total = 1.0 / a
    k = a
    while abs(term) > abs(total) * 1e-16:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _lentz(pairs, tiny: float = 1e-300) -> float:
    """A continued fraction a1/(b1 + a2/(b2 + ...)) from its (a, b) pairs."""
    value, c, d = tiny, tiny, 0.0
    for a, b in pairs:
        d = 1 / ((b + a * d) or tiny)
        c = (b + a / c) or tiny
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return value


def _gamma_fraction(a: float, x: float) -> float:
    def pairs():
        yield 1.0, x + 1 - a
        for k in range(1, 10_000):
            yield -k * (k - a), x + 2 * k + 1 - a

    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * _lentz(pairs())


def beta_i(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)

    def pairs():
        yield 1.0, 1.0
        for k in range(1, 10_000):
            m = k // 2
            yield (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))), 1.0

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front / a * _lentz(pairs())


def fisher_exact(a: int, b: int, c: int, d: int) -> tuple[float, float, float]:
    """(left, right, two-sided) of a two-by-two table."""
    r, s, n = a + b, a + c, a + b + c + d
    choose = lambda m, k: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)
    low, high = max(0, r + s - n), min(r, s)
    p = {x: math.exp(choose(s, x) + choose(n - s, r - x) - choose(n, r)) for x in range(low, high + 1)}
    here = p[a]
    return min(1.0, sum(v for x, v in p.items() if x <= a)), min(1.0, sum(v for x, v in p.items() if x >= a)), min(1.0, sum(v for v in p.values() if v <= here * (1 + 1e-9)))


FISHER = "left double, right double, two double"


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """struct<left, right, two> of two-by-two tables; null where a count is."""

    @F.pandas_udf(FISHER)
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        rows = [fisher_exact(*map(int, row)) if not any(pd.isna(v) for v in row) else (None,) * 3 for row in zip(a, b, c, d, strict=True)]
        return pd.DataFrame(rows, columns=["left", "right", "two"], dtype="float64")

    return run(a, b, c, d)


def kolmogorov_smirnov(df: DataFrame, value: str, first: Column) -> DataFrame:
    """(distance): the largest gap between the distributions of value where ``first`` holds and
    where it does not.  The gap times both sizes is one running sum over distinct values."""
    from strandlake.operators.reads import with_running_sum

    one = df.where(F.col(value).isNotNull()).select(F.col(value).alias("value"), F.coalesce(first, F.lit(False)).alias("one"))
    counted = one.groupBy("value").agg(F.count_if("one").alias("a"), F.count_if(~F.col("one")).alias("b"))
    na, nb = (int(x or 0) for x in counted.agg(F.sum("a"), F.sum("b")).first())
    if not na or not nb:
        return counted.agg(F.lit(None).cast("double").alias("distance"))
    step = counted.select("value", (F.col("a").cast("decimal(20,0)") * nb - F.col("b") * na).cast("decimal(38,0)").alias("step"))
    return with_running_sum(step, "value", "step").agg((F.max(F.abs(F.col("before") + F.col("step"))).cast("double") / (float(na) * nb)).alias("distance"))


def log_binomial(n: Column, m: Column) -> Column:
    """The natural logarithm of the number of ways to take m of n."""
    return special(lambda n, m: math.lgamma(n + 1) - math.lgamma(m + 1) - math.lgamma(n - m + 1))(n.cast("double"), m.cast("double"))


def bernstein(weights: list[float], t: Column) -> Column:
    """The polynomial with these Bernstein coefficients at t, 0 to 1, by built-ins."""
    n = len(weights) - 1
    return sum((F.lit(float(w) * math.comb(n, i)) * F.pow(t, F.lit(i)) * F.pow(1 - t, F.lit(n - i)) for i, w in enumerate(weights)), F.lit(0.0))


def kth_smallest(df: DataFrame, column: str, k: int) -> DataFrame:
    """(value): the k-th smallest of a column, from 1; no row beyond its end.  Values are
    counted first, so equal ones are one row."""
    from strandlake.operators.reads import with_running_sum

    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return with_running_sum(counted, "value", "n").where((F.col("before") < k) & (F.col("before") + F.col("n") >= k)).select("value")


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """df in an order by keyed hashes of a unique column, the same on every run."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), key)


class Twister:
    """The 64-bit Mersenne Twister: whole numbers and fractions from a seed."""

    # Fixed values of the generator.
    SIZE, MIDDLE, MATRIX, UPPER, LOWER, SPREAD = 312, 156, 0xB5026F5AA96619E9, 0xFFFFFFFF80000000, 0x7FFFFFFF, 6364136223846793005

    def __init__(self, seed: int):
        word = (1 << 64) - 1
        self._state = [seed & word]
        for i in range(1, self.SIZE):
            last = self._state[-1]
            self._state.append((self.SPREAD * (last ^ last >> 62) + i) & word)
        self._at = self.SIZE

    def integer(self) -> int:
        if self._at == self.SIZE:
            s, n = self._state, self.SIZE
            for i in range(n):
                x = s[i] & self.UPPER | s[(i + 1) % n] & self.LOWER
                s[i] = s[(i + self.MIDDLE) % n] ^ x >> 1 ^ (self.MATRIX if x & 1 else 0)
            self._at = 0
        x = self._state[self._at]
        self._at += 1
        x ^= x >> 29 & 0x5555555555555555
        x ^= x << 17 & 0x71D67FFFEDA60000
        x ^= x << 37 & 0xFFF7EEE000000000
        return x ^ x >> 43

    def fraction(self) -> float:
        """In [0, 1)."""
        return (self.integer() >> 11) / 9007199254740992.0


def jackknife(df: DataFrame, group: str, value: str) -> DataFrame:
    """(estimate, variance) of the mean of value by leaving out one group at a time."""
    per = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    ts, tn, groups = per.agg(F.sum("s"), F.sum("n"), F.count(F.lit(1))).first()  # one row
    if not tn:
        return per.select(F.lit(None).cast("double").alias("estimate"), F.lit(None).cast("double").alias("variance")).limit(1)
    left = per.select(((F.lit(float(ts)) - F.col("s")) / F.nullif(F.lit(tn) - F.col("n"), F.lit(0))).alias("m"))
    return left.agg(F.var_pop("m").alias("v")).select(F.lit(ts / tn).alias("estimate"), (F.lit(groups - 1) * F.col("v")).alias("variance"))


def minimise_patterns(f: Callable[[list[float]], float], start: list[float], radius: float = 0.5, least: float = 1e-7, most: int = 50_000) -> list[float]:
    """A local minimum by pattern search: axis steps, repeated along their sum while they help."""
    best, value, calls = list(start), f(list(start)), 0

    def explore(at: list[float], v: float, r: float) -> tuple[list[float], float]:
        nonlocal calls
        at = list(at)
        for i in range(len(at)):
            for step in (r, -r):
                trial = [*at[:i], at[i] + step, *at[i + 1 :]]
                calls += 1
                if (t := f(trial)) < v:
                    at, v = trial, t
                    break
        return at, v

    while radius > least and calls < most:
        at, v = explore(best, value, radius)
        if v >= value:
            radius /= 2
            continue
        while v < value and calls < most:
            old, best, value = best, at, v
            leap = [2 * b - a for a, b in zip(old, best, strict=True)]
            calls += 1
            at, v = explore(leap, f(leap), radius)
    return best


def minimise_line(f: Callable[[float], float], low: float, high: float, tolerance: float = 1e-9) -> float:
    """A minimum within [low, high] by golden sections with parabolic steps where they help."""
    golden = (3 - math.sqrt(5)) / 2
    x = w = v = low + golden * (high - low)
    fx = fw = fv = f(x)
    move = before = high - low
    for _ in range(500):
        middle, slack = (low + high) / 2, tolerance * abs(x) + 1e-12
        if abs(x - middle) <= 2 * slack - (high - low) / 2:
            break
        r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
        top, bottom = (x - v) * q - (x - w) * r, 2 * (q - r)
        step = -top / bottom if bottom else math.inf
        if not (abs(step) < abs(before) / 2 and low < x + step < high):
            step = golden * ((low if x >= middle else high) - x)
            move = (low if x >= middle else high) - x
        before, move = move, step
        u = x + (step if abs(step) >= slack else math.copysign(slack, step))
        fu = f(u)
        if fu <= fx:
            low, high = (x, high) if u >= x else (low, x)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            low, high = (u, high) if u < x else (low, u)
            if fu <= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return x
