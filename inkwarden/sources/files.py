"""Files as DataFrames: bounded reads, names, formats and stable snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract import FRONTMATTER_BYTES, FRONTMATTER_LINES, MAX_BYTES

CONFIG_BYTES = 4 * 1024 * 1024


def read_files(spark: SparkSession, path: str, most_bytes: int = MAX_BYTES, glob: str | None = None) -> DataFrame:
    """path, modified, length, content and filename of the files below ``path``; those over ``most_bytes`` have null content.

    The length filter reaches the reader, so that oversized files are listed and never read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    within = files.filter(F.col("length") <= most_bytes)
    beyond = files.filter(F.col("length") > most_bytes).select("path", "modificationTime", "length").withColumn("content", F.lit(None).cast("binary"))
    return within.unionByName(beyond).withColumnRenamed("modificationTime", "modified").withColumn("filename", F.element_at(F.split("path", "/"), -1))


def under(path: Column, root: str) -> Column:
    """Whether a path is a root or below it, whatever it starts like."""
    root = root.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def allowed(files: DataFrame, roots: list[str], excluded: list[str] = []) -> DataFrame:  # noqa: B006
    inside = F.lit(False)
    for r in roots:
        inside = inside | under(F.col("path"), r)
    for r in excluded:
        inside = inside & ~under(F.col("path"), r)
    return files.filter(inside)


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths of ``before`` that a second listing has with the same length and time."""
    return before.join(after.select("path", "length", "modified"), ["path", "length", "modified"], "left_semi")


def format_col(filename: Column) -> Column:
    base = F.regexp_extract(F.translate(filename, "\\", "/"), "[^/]*$", 0)
    return F.when((base == ".env") | base.startswith(".env."), "env").when(base.contains("."), F.lower(F.regexp_extract(base, r"[^.]*$", 0))).otherwise("")


def _front(text: Column) -> Column:
    """Lines are looked at one by one: a regular expression over all of them would need a stack as deep as the block."""
    lines = F.split(text, "\n")

    def block(opener: str, closer: str) -> Column:
        rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1)))
        end = F.array_position(F.transform(rest, lambda x: F.rlike(x, F.lit(closer))), True)
        content = F.concat(F.array_join(F.slice(rest, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int")), "\n"), F.lit("\n"))
        return F.when(F.rlike(F.element_at(lines, 1), F.lit(opener)) & (end > 1), content)

    yaml, toml = block(r"^---[ \t]*\r?$", r"^(?:---|\.\.\.)[ \t]*\r?$"), block(r"^\+\+\+[ \t]*\r?$", r"^\+\+\+[ \t]*\r?$")
    return F.when(text.startswith("---") & text.contains("\n"), yaml).when(text.startswith("+++") & text.contains("\n"), toml)


def frontmatter_col(text: Column) -> Column:
    """The closed block behind a first line ``---`` or ``+++``, null without one or with one that is refused."""
    return F.when(frontmatter_refusal(text).isNull(), _front(text))


def frontmatter_refusal(text: Column) -> Column:
    """FRONTMATTER_LIMIT for a block of too many lines or bytes."""
    front = _front(text)
    return F.when((F.octet_length(front) > FRONTMATTER_BYTES) | (F.regexp_count(front, F.lit("\n")) > FRONTMATTER_LINES), "FRONTMATTER_LIMIT")


def config_files(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, CONFIG_BYTES)
