"""Tables of responses by direction, stability class and source group: scan of their documents, what is wrong with them, and their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Directions, classes that a table may have, source groups.
DIRECTIONS, CLASSES, GROUPS = 16, ("AC", "D", "EF", "A", "B", "C", "E", "F"), ("A", "B", "C", "D")
SCHEMA = """meta struct<status:string,grid:string>, dirs array<double>, classes array<string>, groups array<string>, gamma array<array<array<double>>>, age array<array<array<double>>>,
band array<array<array<array<double>>>>, wind array<struct<s4:double,s10:double,dir4:double,dir10:double>>, quality array<array<struct<converged:boolean,mass_ok:boolean>>>"""
KEYS = ("meta", "dirs", "classes", "groups", "gamma", "age", "band", "wind")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row a document, with ``file``; what has another shape than SCHEMA is NULL."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))


def _cells(name: str, classes: Column, deep: bool) -> list[Column]:
    """Arrays of messages about one array by direction and class; NULL where a place is right."""
    rows = F.coalesce(F.col(name), F.array().cast("array<array<array<array<double>>>>" if deep else "array<array<array<double>>>"))
    of = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    short = F.transform(rows, lambda r, d: F.when(r.isNull() | (F.size(r) != F.size(classes)), of(f"{name}[", d, "] must have ", F.size(classes), " classes")))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))

    def cell(c: Column, d: Column, k: Column) -> Column:
        at = of(f"{name}[", d, "][", k, "]")
        wrong = F.exists(c, lambda g: F.coalesce(F.exists(g, bad), F.lit(True))) if deep else F.exists(c, bad)
        pairs = F.exists(c, lambda g: g.isNull() | (F.size(g) != 2)) if deep else F.lit(False)
        out = F.when(c.isNull(), F.lit(None).cast("string")).when(F.size(c) != len(GROUPS), F.concat(at, F.lit(f" must have {len(GROUPS)} groups"))).when(pairs, F.concat(at, F.lit(" must hold [min, max] pairs"))).when(wrong, F.concat(at, F.lit(" has non-finite values")))
        return out if deep or name != "gamma" else out.when(F.exists(c, lambda v: v < 0), F.concat(at, F.lit(" has negative values")))

    each = F.flatten(F.transform(rows, lambda r, d: F.transform(F.coalesce(r, F.array().cast("array<array<array<double>>>" if deep else "array<array<double>>")), lambda c, k: cell(c, d, k))))
    whole = F.array(F.when(F.size(rows) != DIRECTIONS, F.lit(f"{name} must have {DIRECTIONS} directions")))
    return [F.when(F.size(rows) == DIRECTIONS, F.concat(short, each)).otherwise(whole)]


def problems(documents: DataFrame) -> DataFrame:
    """(file, level, message): ``error`` where a document has the wrong shape, ``warning`` where entries are missing or were solved badly. A good one has no row.

    A document that lacks a key has errors about that only.
    """
    lacking = F.array(*(F.when(F.col(k).isNull(), f"missing key '{k}'") for k in KEYS))
    whole = F.size(F.array_compact(lacking)) == 0
    classes = F.coalesce("classes", F.array().cast("array<string>"))
    steps = F.transform(F.col("dirs"), lambda x, i: F.coalesce(F.abs(x - i * (360.0 / DIRECTIONS)) <= 1e-9, F.lit(False)))
    shape = F.array(
        F.when((F.size("dirs") != DIRECTIONS) | ~F.forall(steps, lambda x: x), f"dirs must be the {DIRECTIONS} directions from 0"),
        F.when(F.concat_ws(",", "groups") != ",".join(GROUPS), f"groups must be {', '.join(GROUPS)}"),
        F.when((F.size(classes) == 0) | F.exists(classes, lambda c: c.isNull() | ~c.isin(*CLASSES)), "classes must be some of " + ", ".join(CLASSES)),
        F.when(F.size("wind") != DIRECTIONS, f"wind must have {DIRECTIONS} directions"),
    )
    wind = F.transform("wind", lambda w, d: F.when(w.isNotNull() & (w["s4"].isNull() | w["s10"].isNull() | w["dir4"].isNull() | w["dir10"].isNull()), F.concat(F.lit("wind["), d.cast("string"), F.lit("] needs s4, s10, dir4, dir10"))))
    still = F.transform("wind", lambda w, d: F.when(w.isNull(), F.concat(F.lit("wind["), d.cast("string"), F.lit("] missing"))))
    errors = F.concat(shape, wind, *(c for n in ("gamma", "age", "band") for c in _cells(n, classes, n == "band")))
    empty = F.size(F.filter(F.flatten("gamma"), lambda c: c.isNull()))
    poor = F.size(F.filter(F.flatten("quality"), lambda q: ~F.coalesce(q["converged"], F.lit(True)) | ~F.coalesce(q["mass_ok"], F.lit(True))))
    left_out = F.when(empty > 0, F.concat(empty.cast("string"), F.lit(" of "), (DIRECTIONS * F.size(classes)).cast("string"), F.lit(" gamma entries are null")))
    solved = F.when(F.col("quality").isNull(), "no quality of the entries").when(poor > 0, F.concat(poor.cast("string"), F.lit(" entries did not converge or miss the mass tolerance")))
    warnings = F.concat(still, F.array(left_out, solved))
    found = lambda level, texts: F.transform(F.array_compact(texts), lambda m: F.struct(F.lit(level).alias("level"), m.alias("message")))
    every = F.when(whole, F.concat(found("error", errors), found("warning", warnings))).otherwise(found("error", lacking))
    return documents.select("file", F.inline(every))


def rows(documents: DataFrame) -> DataFrame:
    """(file, direction, grp, gamma, age, band): the entries of good documents; those without a response are left out."""
    bad = problems(documents).filter("level = 'error'").select("file").distinct()
    good = documents.join(bad, "file", "left_anti")
    one = good.select("file", "dirs", "classes", "age", "band", F.posexplode("gamma").alias("d", "_g"))
    each = one.select("file", F.get("dirs", F.col("d")).alias("direction"), "classes", F.get("age", F.col("d")).alias("_a"), F.get("band", F.col("d")).alias("_b"), F.posexplode("_g").alias("k", "gamma"))
    return each.filter("gamma IS NOT NULL").select("file", "direction", F.get("classes", F.col("k")).alias("grp"), "gamma", F.get("_a", F.col("k")).alias("age"), F.get("_b", F.col("k")).alias("band"))
