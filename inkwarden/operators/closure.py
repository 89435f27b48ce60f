"""What is reached from where along relations, and whether that is what there is.

Packages say which parts they have and which of them refer to which. A package is whole
when what is reached from its roots is exactly its parts: nothing referred to is missing, nothing
is there that nobody refers to. Both are sets of rows, for all packages at once.

Reaching is semi-naive: a round follows the relations of what the round before has
found for the first time, and ends when nothing is new, so it takes as many rounds as the
longest way has steps, and circles end by themselves. Relations lie partitioned by package
and source once; a round moves its own new rows.

Cases: null packages are one package, null parts are no parts; repeated rows count once; a
package without a root reaches nothing; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import _checkpoint


def _null_safe(df: DataFrame) -> DataFrame:
    """``df`` with its package as a key that is never null."""
    return df.withColumn("_p", F.when(F.col("package").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("package").cast("string"))))


def reached(relations: DataFrame, roots: DataFrame) -> DataFrame:
    """package, part and steps (the fewest from a root, which has 0) from relations (package, source, target) and roots (package, part)."""
    edges = _checkpoint(_null_safe(relations).filter("source IS NOT NULL AND target IS NOT NULL").select("_p", "source", "target").distinct())
    new = _checkpoint(_null_safe(roots).filter("part IS NOT NULL").select("_p", "package", "part").distinct().withColumn("steps", F.lit(0)))
    found, steps = new, 0
    while not new.isEmpty():
        steps += 1
        next_to = new.select("_p", "package", F.col("part").alias("source")).join(edges, ["_p", "source"]).select("_p", "package", F.col("target").alias("part")).distinct()
        new = _checkpoint(next_to.join(found.select("_p", "part"), ["_p", "part"], "left_anti").select("_p", "package", "part", F.lit(steps).alias("steps")))
        found = _checkpoint(found.unionByName(new))
    return found.select("package", "part", "steps")


def differences(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """package, part and side (MISSING: wanted and not there; UNREFERENCED: there and not wanted), as two anti-joins of sets."""
    a, b = (_null_safe(x).filter("part IS NOT NULL").select("_p", "package", "part").distinct() for x in (wanted, there))
    one = lambda x, y, side: x.join(y.select("_p", "part"), ["_p", "part"], "left_anti").select("package", "part", F.lit(side).alias("side"))
    return one(a, b, "MISSING").unionByName(one(b, a, "UNREFERENCED"))


def closed(parts: DataFrame, relations: DataFrame, roots: DataFrame) -> DataFrame:
    """A row for each package: whether it is VALID or INVALID, and how many parts are missing or unreferenced."""
    bad = _null_safe(differences(reached(relations, roots), parts)).groupBy("_p").agg(F.count_if(F.col("side") == "MISSING").alias("missing"), F.count_if(F.col("side") == "UNREFERENCED").alias("unreferenced"))
    packages = _null_safe(parts.select("package").unionByName(roots.select("package"))).groupBy("_p").agg(F.first("package").alias("package"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return packages.join(bad, "_p", "left").select("package", F.when(F.col("missing").isNull(), "VALID").otherwise("INVALID").alias("status"), zero("missing"), zero("unreferenced"))
