"""NO-NO2-O3 chemistry and air-quality index as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.functions.dimensions import INDEX_COLOURS, INDEX_LIMITS, NO_COLOUR, PPB, UNCERTAINTY


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once a row, so that long formulas stay small as code."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def no2_after(no2: Column, nox: Column, ox: Column, tau: Column, j: Column, k: Column) -> Column:
    """NO2 (ppb) after time tau from the exact solution of d[NO2]/dt = k (N - y)(X - y) - J y, kept within [0, min(N, X)]; infinite tau: its end."""
    given = F.struct(no2.alias("y"), nox.alias("n"), ox.alias("x"), tau.cast("double").alias("tau"), F.greatest(j, F.lit(0.0)).alias("j"), k.alias("k"))

    def rooted(g: Column) -> Column:
        b = g["n"] + g["x"] + g["j"] / F.nullif(g["k"], F.lit(0.0))
        return once(F.struct(g.alias("g"), b.alias("b"), F.sqrt(F.greatest(F.lit(1e-12), b * b - 4 * g["n"] * g["x"])).alias("root")), moved)

    def moved(r: Column) -> Column:
        g, low, high = r["g"], (r["b"] - r["root"]) / 2, (r["b"] + r["root"]) / 2
        apart = g["y"] - high
        ratio = (g["y"] - low) / F.when(F.abs(apart) >= 1e-12, apart) * F.exp(-F.least(g["k"] * r["root"] * g["tau"], F.lit(700.0)))
        return once(F.struct(g.alias("g"), low.alias("low"), high.alias("high"), ratio.alias("q")), kept)

    def kept(z: Column) -> Column:
        g = z["g"]
        end = F.coalesce((z["low"] - z["high"] * z["q"]) / F.nullif(1 - z["q"], F.lit(0.0)), z["low"])
        y = F.when((g["tau"] <= 0) | (g["k"] <= 0), g["y"]).when(g["tau"] == float("inf"), z["low"]).otherwise(end)
        return F.greatest(F.lit(0.0), F.least(y, g["n"], g["x"]))

    return once(given, rooted)


def no2_scheme(nox_added: Column, no2: Column, nox: Column, o3: Column, tau: Column, j: Column, k: Column, share: float = 0.10) -> dict[str, Column]:
    """NO2, NO, O3 and NOx (ug/m3) and oxidant (ppb) of a background to which traffic adds NOx, ``share`` of it as NO2. Missing and negative: 0."""
    some = lambda c: F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0)))
    added, first, ozone = some(nox_added) / PPB["no2"], some(no2) / PPB["no2"], some(o3) / PPB["o3"]
    n, x0 = some(nox) / PPB["no2"] + added, first + share * added
    x = ozone + x0
    y = no2_after(x0, n, x, tau, some(j), k)
    all_ = once(F.struct(n.alias("n"), x.alias("x"), y.alias("y")), lambda s: F.struct((s["y"] * PPB["no2"]).alias("no2"), ((s["n"] - s["y"]) * PPB["no"]).alias("no"), ((s["x"] - s["y"]) * PPB["o3"]).alias("o3"), (s["n"] * PPB["no2"]).alias("nox"), s["x"].alias("ox")))
    return {k: all_[k] for k in ("no2", "no", "o3", "nox", "ox")}


def with_no2(rows: DataFrame, name: str, nox_added: Column, no2: Column, nox: Column, o3: Column, tau: Column, j: Column, k: Column, share: float = 0.10) -> DataFrame:
    """rows with ``name``, a struct of what ``no2_scheme`` gives: each step is a column that is computed once, in generated code, for any number of results."""
    some = lambda c: F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0)))
    c = lambda x: F.col(f"_{name}_{x}")

    def step(df: DataFrame, **new: Column) -> DataFrame:
        return df.withColumns({f"_{name}_{x}": e for x, e in new.items()})

    out = step(rows, a=some(nox_added) / PPB["no2"], f=some(no2) / PPB["no2"], o=some(o3) / PPB["o3"], m=some(nox) / PPB["no2"], j=some(j), k=k, t=tau.cast("double"))
    out = step(out, n=c("m") + c("a"), y=c("f") + share * c("a"))
    out = step(out, x=c("o") + c("y"))
    out = step(out, b=c("n") + c("x") + c("j") / F.nullif(c("k"), F.lit(0.0)))
    out = step(out, r=F.sqrt(F.greatest(F.lit(1e-12), c("b") * c("b") - 4 * c("n") * c("x"))))
    out = step(out, l=(c("b") - c("r")) / 2, h=(c("b") + c("r")) / 2)
    out = step(out, p=c("y") - c("h"))
    out = step(out, q=(c("y") - c("l")) / F.when(F.abs(c("p")) >= 1e-12, c("p")) * F.exp(-F.least(c("k") * c("r") * c("t"), F.lit(700.0))))
    end = F.coalesce((c("l") - c("h") * c("q")) / F.nullif(1 - c("q"), F.lit(0.0)), c("l"))
    y = F.when((c("t") <= 0) | (c("k") <= 0), c("y")).when(c("t") == float("inf"), c("l")).otherwise(end)
    out = step(out, z=F.greatest(F.lit(0.0), F.least(y, c("n"), c("x"))))
    got = F.struct((c("z") * PPB["no2"]).alias("no2"), ((c("n") - c("z")) * PPB["no"]).alias("no"), ((c("x") - c("z")) * PPB["o3"]).alias("o3"), (c("n") * PPB["no2"]).alias("nox"), c("x").alias("ox"))
    return out.select(*rows.columns, got.alias(name))


def index_level(pollutant: Column, value: Column, scheme: str = "european") -> Column:
    """Level 1 to 6 of one of five pollutants; a value on a limit belongs to the lower level; 0 if missing or another pollutant."""
    of = F.lit(0)
    for p, limits in INDEX_LIMITS[scheme].items():
        of = F.when(pollutant == p, level(value, tuple(map(float, limits)))).otherwise(of)
    return of


def index_colour(level_: Column, scheme: str = "european") -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, INDEX_COLOURS[scheme])), level_ - 1), F.lit(NO_COLOUR))


def quality_indicator(o: Column, p: Column, pollutant: str) -> Column:
    """Aggregate: error against twice the measurement uncertainty of one of four pollutants; NULL for others."""
    if pollutant not in UNCERTAINTY:
        return F.lit(None).cast("double")
    relative, reference, constant = UNCERTAINTY[pollutant]
    both = o.isNotNull() & p.isNotNull()
    error = F.avg(F.when(both, (o - p) * (o - p)))
    doubt = F.avg(F.when(both, relative * relative * ((1 - constant * constant) * o * o + constant * constant * reference * reference)))
    return F.sqrt(error) / (2 * F.sqrt(doubt))


def level(value: Column, breaks: tuple[float, ...]) -> Column:
    """Index level from 1; a value on a break belongs to the lower level; 0 if missing."""
    out = F.lit(1)
    for b in breaks:
        out = out + (value > b).cast("int")
    return F.coalesce(out, F.lit(0))


def band(value: Column, breaks: tuple[float, ...]) -> Column:
    """Display band from 1; a value on a break belongs to the upper band."""
    out = F.lit(1)
    for b in breaks:
        out = out + (value >= b).cast("int")
    return out


def photolysis(sun: Column) -> Column:
    """J(NO2) in 1/s from irradiance."""
    g = F.greatest(F.lit(0.0), F.coalesce(sun, F.lit(0.0)))
    return F.greatest(F.lit(0.0), 1.05 * (1.47e-5 * g - 4.84e-9 * g * g))


def titration(celsius: Column, hpa: float = 1013.25) -> Column:
    """k(NO + O3) in 1/(ppb s); missing temperature: 15."""
    kelvin = F.coalesce(celsius, F.lit(15.0)) + 273.15
    return 3.0e-12 * F.exp(-1500 / kelvin) * (7.2429e18 * hpa / kelvin) * 1e-9


def briggs(cls: Column, x: Column) -> tuple[Column, Column]:
    """Lateral and vertical spread in metres at distance x in a built-up area."""
    across = F.when(cls.isin("A", "B"), 0.32).when(cls == "C", 0.22).when(cls == "D", 0.16).otherwise(0.11)
    up = F.when(cls.isin("A", "B"), 0.24 * x * F.sqrt(1 + 0.001 * x)).when(cls == "C", 0.2 * x).when(cls == "D", 0.14 * x / F.sqrt(1 + 0.0003 * x))
    return across * x / F.sqrt(1 + 0.0004 * x), up.otherwise(0.08 * x / F.sqrt(1 + 0.0015 * x))


def increment(gamma: Column, age: Column, strength: Column, u: Column, beta: float, default_tau: float = 60.0) -> tuple[Column, Column, Column]:
    """Total, parts by group, and mean age of what all groups add, for arrays over groups and the effective wind u; NULL entries are 0."""
    zero = F.lit(0.0)
    times = lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, zero) * F.coalesce(y, zero))
    total = lambda a: F.aggregate(a, zero, lambda x, y: x + y)
    parts = F.transform(times(strength, gamma), lambda x: 1e6 * beta * x / u)
    mass = total(times(strength, gamma)) / u
    return total(parts), parts, F.when(mass > 0, total(times(strength, age)) / (u * u) / mass).otherwise(default_tau)
