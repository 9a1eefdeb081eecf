"""Normal and chi-square functions as SQL text.

The texts of ``norm_pdf``, ``norm_cdf`` and ``norm_ppf`` are plain arithmetic that Spark
and other SQL engines read alike; arguments should be column names, as they are
repeated.  Constants carry exponents so that no engine takes them for decimals.
"""

from __future__ import annotations

# Wichura's algorithm AS 241 (PPND16), numerators and denominators from the constant term.
_CENTRE = (
    "3.3871328727963666080e0 1.3314166789178437745e2 1.9715909503065514427e3 1.3731693765509461125e4 4.5921953931549871457e4 6.7265770927008700853e4 3.3430575583588128105e4 2.5090809287301226727e3",
    "1.0e0 4.2313330701600911252e1 6.8718700749205790830e2 5.3941960214247511077e3 2.1213794301586595867e4 3.9307895800092710610e4 2.8729085735721942674e4 5.2264952788528545610e3",
)
_MIDDLE = (
    "1.42343711074968357734e0 4.63033784615654529590e0 5.76949722146069140550e0 3.64784832476320460504e0 1.27045825245236838258e0 2.41780725177450611770e-1 2.27238449892691845833e-2 7.74545014278341407640e-4",
    "1.0e0 2.05319162663775882187e0 1.67638483018380384940e0 6.89767334985100004550e-1 1.48103976427480074590e-1 1.51986665636164571966e-2 5.47593808499534494600e-4 1.05075007164441684324e-9",
)
_TAIL = (
    "6.65790464350110377720e0 5.46378491116411436990e0 1.78482653991729133580e0 2.96560571828504891230e-1 2.65321895265761230930e-2 1.24266094738807843860e-3 2.71155556874348757815e-5 2.01033439929228813265e-7",
    "1.0e0 5.99832206555887937690e-1 1.36929880922735805310e-1 1.48753612908506148525e-2 7.86869131145613259100e-4 1.84631831751005468180e-5 1.42151175831644588870e-7 2.04426310338993978564e-15",
)
# Hart's rational approximation 5666 of the normal distribution, from the highest power.
_HART = (
    "3.52624965998911e-2 7.00383064443688e-1 6.37396220353165e0 3.3912866078383e1 1.12079291497871e2 2.21213596169931e2 2.20206867912376e2",
    "8.83883476483184e-2 1.75566716318264e0 1.6064177579207e1 8.67807322029461e1 2.96564248779674e2 6.37333633378831e2 7.93826512519948e2 4.40413735824752e2",
)


def _rising(text: str, x: str) -> str:
    """A polynomial given from the constant term."""
    out = ""
    for c in reversed(text.split()):
        out = f"({out} * {x} + {c})" if out else c
    return out


def _falling(text: str, x: str) -> str:
    return _rising(" ".join(reversed(text.split())), x)


def norm_pdf(x: str) -> str:
    return f"(exp(-5.0e-1 * ({x}) * ({x})) * 3.98942280401432677940e-1)"


def norm_cdf(x: str) -> str:
    a = f"abs({x})"
    near = f"({_falling(_HART[0], a)}) / ({_falling(_HART[1], a)})"
    far = a + " + 6.5e-1"
    for k in (4, 3, 2, 1):
        far = f"{a} + {k}.0e0 / ({far})"
    upper = f"(exp(-5.0e-1 * {a} * {a}) * case when {a} < 7.07106781186547e0 then {near} else 1.0e0 / (({far}) * 2.506628274631e0) end)"
    return f"(case when ({x}) > 0.0e0 then 1.0e0 - {upper} else {upper} end)"


def norm_ppf(p: str) -> str:
    """The quantile, for 0 < p < 1; null elsewhere."""
    q = f"(({p}) - 5.0e-1)"
    s = f"(1.80625e-1 - {q} * {q})"
    r = f"sqrt(-ln(case when {q} < 0.0e0 then ({p}) else 1.0e0 - ({p}) end))"
    middle = f"({_rising(_MIDDLE[0], f'({r} - 1.6e0)')}) / ({_rising(_MIDDLE[1], f'({r} - 1.6e0)')})"
    tail = f"({_rising(_TAIL[0], f'({r} - 5.0e0)')}) / ({_rising(_TAIL[1], f'({r} - 5.0e0)')})"
    outer = f"(case when {q} < 0.0e0 then -1.0e0 else 1.0e0 end) * (case when {r} <= 5.0e0 then {middle} else {tail} end)"
    return f"(case when ({p}) <= 0.0e0 or ({p}) >= 1.0e0 then null when abs({q}) <= 4.25e-1 then {q} * ({_rising(_CENTRE[0], s)}) / ({_rising(_CENTRE[1], s)}) else {outer} end)"


def chi2_sf(x: str, df: str) -> str:
    """Upper tail of chi-square for integer df >= 1 (1 where x <= 0), as a finite sum; Spark SQL."""
    h = f"(({x}) / 2.0e0)"
    odd = f"(({df}) % 2 = 1)"
    terms = f"(case when {odd} then cast((({df}) - 1) / 2 as int) else cast(({df}) / 2 as int) end)"
    first = f"(case when {odd} then sqrt({h}) * exp(-{h}) * 1.1283791670955125739e0 else exp(-{h}) end)"
    shift = f"(case when {odd} then 5.0e-1 else 0.0e0 end)"
    fold = (
        f"aggregate(if({terms} > 0, sequence(1, {terms}), array()), named_struct('t', {first}, 's', 0.0e0), "
        f"(a, k) -> named_struct('t', a.t * {h} / (k + {shift}), 's', a.s + a.t), a -> a.s)"
    )
    root = f"sqrt({x})"
    return f"(case when ({x}) <= 0.0e0 then 1.0e0 else least(1.0e0, (case when {odd} then 2.0e0 * {norm_cdf('-' + root)} else 0.0e0 end) + {fold}) end)"


def chi2_sf_duckdb(x: str, df: str) -> str:
    """The same tail for an engine with lgamma and list functions; an independent form for cross-checks."""
    h = f"(({x}) / 2.0e0)"
    sums = f"coalesce(list_sum(list_transform(range(0, cast(floor(({df}) / 2) as bigint)), lambda k: exp(-{h} + (k + ({df}) % 2 * 5.0e-1) * ln({h}) - lgamma(k + 1.0e0 + ({df}) % 2 * 5.0e-1)))), 0.0e0)"
    return f"(case when ({x}) <= 0.0e0 then 1.0e0 else least(1.0e0, (case when ({df}) % 2 = 1 then 2.0e0 * {norm_cdf(f'-sqrt({x})')} else 0.0e0 end) + {sums}) end)"
