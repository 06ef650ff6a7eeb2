"""Statistical scalar functions as SQL text and as columns.

The text holds only arithmetic that every SQL dialect reads alike, so a plan and the SQL that it is
checked against can share a formula; the tests check the formulas themselves against ``math``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hart's rational approximation of the normal tail, as published by G. West (2005).
_TAIL_TOP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_TAIL_BOTTOM = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)

#: Wichura's algorithm AS 241 (PPND16) for the inverse normal.
_CENTRE_TOP = (
    2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608,
)
_CENTRE_BOTTOM = (
    5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0,
)
_NEAR_TOP = (
    7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734,
)
_NEAR_BOTTOM = (
    1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0,
)
_FAR_TOP = (
    2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772,
)
_FAR_BOTTOM = (
    2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0,
)


def _polynomial(x: str, coefficients: Sequence[float]) -> str:
    out = _number(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {_number(c)})"
    return out


def _number(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def sql_phi(x: str) -> str:
    """Normal CDF, absolute error below 1e-14; NULL stays NULL."""
    a = f"abs({x})"
    near = f"exp(-{a} * {a} / 2) * {_polynomial(a, _TAIL_TOP)} / {_polynomial(a, _TAIL_BOTTOM)}"
    far = f"exp(-{a} * {a} / 2) / ({a} + 1.0 / ({a} + 2.0 / ({a} + 3.0 / ({a} + 4.0 / ({a} + 0.65))))) / 2.506628274631"
    tail = f"CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < 7.07106781186547 THEN {near} ELSE {far} END"
    return f"CASE WHEN {x} > 0 THEN 1.0 - ({tail}) ELSE ({tail}) END"


def _inverse(p: str, q: str, r: str) -> str:
    """The three branches of the inverse from p, q = p - 1/2 and r = sqrt(-ln(min(p, 1 - p)))."""
    r0 = f"(0.180625 - {q} * {q})"
    centre = f"{q} * {_polynomial(r0, _CENTRE_TOP)} / {_polynomial(r0, _CENTRE_BOTTOM)}"
    near = f"{_polynomial(f'({r} - 1.6)', _NEAR_TOP)} / {_polynomial(f'({r} - 1.6)', _NEAR_BOTTOM)}"
    far = f"{_polynomial(f'({r} - 5.0)', _FAR_TOP)} / {_polynomial(f'({r} - 5.0)', _FAR_BOTTOM)}"
    side = f"CASE WHEN {r} <= 5 THEN {near} ELSE {far} END"
    return f"CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN abs({q}) <= 0.425 THEN {centre} ELSE sign({q}) * ({side}) END"


def sql_phi_inverse(p: str) -> str:
    """Inverse normal CDF; NULL outside (0, 1)."""
    q = f"({p} - 0.5)"
    return _inverse(p, q, f"sqrt(-ln(CASE WHEN {q} < 0 THEN {p} ELSE 1.0 - {p} END))")


def sql_hill(x: str, half: float, power: float) -> str:
    """Saturation x^k / (x^k + half^k) of x clipped at 0."""
    y = f"power(greatest({x}, 0.0), {power})"
    return f"CASE WHEN {x} IS NOT NULL THEN {y} / ({y} + power({half}, {power})) END"


def sql_noisy_or(*terms: str) -> str:
    """1 - prod(1 - p), missing terms as 0."""
    return "1.0 - " + " * ".join(f"(1.0 - coalesce({t}, 0.0))" for t in terms)


def phi(name: str) -> Column:
    return F.expr(sql_phi(f"`{name}`"))


def with_phi_inverse(df: DataFrame, share: str, out: str) -> DataFrame:
    """``df`` with the inverse normal of column ``share``. The steps are columns of their own: written as one
    expression the repeated square root outgrows what generated code may hold."""
    p = F.col(share)
    tail = F.when((p > 0) & (p < 1), F.sqrt(-F.ln(F.least(p, 1 - p))))
    staged = df.withColumn("__q", p - 0.5).withColumn("__r", tail)
    return staged.withColumn(out, F.expr(_inverse(f"`{share}`", "__q", "__r"))).drop("__q", "__r")


def hill(name: str, half: float, power: float) -> Column:
    return F.expr(sql_hill(f"`{name}`", half, power))


def noisy_or(*names: str) -> Column:
    return F.expr(sql_noisy_or(*[f"`{n}`" for n in names]))


def log2p1(x: Column) -> Column:
    """log2(x + 1) of x clipped at 0; NULL stays NULL."""
    return F.when(x.isNotNull(), F.log2(F.greatest(x, F.lit(0.0)) + 1))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Winsorised value; NULL stays NULL although least and greatest skip NULLs."""
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def strict_min(columns: Sequence[Column]) -> Column:
    """Row-wise minimum that is NULL if any column is."""
    known = F.lit(True)
    for c in columns:
        known = known & c.isNotNull()
    return F.when(known, F.least(*columns) if len(columns) > 1 else columns[0])


def argmin_name(columns: dict[str, Column], order: Sequence[str]) -> Column:
    """Name of the row's least column; ties go to the first of ``order``; NULL if any column is."""
    least = strict_min([columns[k] for k in order])
    out = F.lit(None).cast("string")
    for k in reversed(order):
        out = F.when(columns[k] == least, F.lit(k)).otherwise(out)
    return out


def selectivity(wanted: Column, unwanted: Sequence[Column]) -> Column:
    """wanted x prod(1 - unwanted)."""
    out = wanted
    for b in unwanted:
        out = out * (1 - b)
    return out


def confidence_ramp(rho: Column, low: float, high: float) -> Column:
    """rho as a confidence in [0, 1] between two bounds; unknown rho counts as full confidence."""
    unknown = rho.isNull() | F.isnan(rho)
    if high <= low:
        return F.when(unknown | (rho >= high), 1.0).otherwise(0.0)
    return F.when(unknown, 1.0).otherwise(F.least(F.greatest((rho - low) / (high - low), F.lit(0.0)), F.lit(1.0)))


def signs_disagree(a: Column, b: Column, least: float = 1.0) -> Column:
    """Both beyond ``least`` and of opposite sign; NULL and NaN count as no disagreement."""
    known = ~F.isnan(a) & ~F.isnan(b)
    return F.coalesce(known & (F.abs(a) > least) & (F.abs(b) > least) & (F.signum(a) != F.signum(b)), F.lit(False))


def score_band(score: Column, high: float = 0.8, low: float = 0.5, names: Sequence[str] = ("likely_essential", "possibly_essential", "likely_non_essential")) -> Column:
    """Band of a score; NULL falls to the lowest band."""
    return F.when(score >= high, names[0]).when(score >= low, names[1]).otherwise(names[2])


def log_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function for x >= 1, to about 1e-13: Stirling's series at x + 8, stepped down."""
    z = x.cast("double") + 8.0
    series = (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    product = x.cast("double")
    for i in range(1, 8):
        product = product * (x.cast("double") + float(i))
    return series - F.ln(product)


def log_choose(n: Column, k: Column) -> Column:
    """Natural logarithm of n over k, 0 <= k <= n."""
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation of the rows that have both; NULL where one of them does not vary (``corr`` raises there)."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / spread)
