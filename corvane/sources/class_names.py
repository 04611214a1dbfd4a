"""Class names and split layouts of image sets, from the texts of their `dataset.yaml` or `classes.txt`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


def _unquoted(text: Column) -> Column:
    """A YAML scalar without its comment, white space and quotes."""
    plain = F.trim(F.regexp_replace(text, r"""^(\s*(?:'[^']*'|"[^"]*"|[^'"#]*?))\s*(?:#.*)?$""", "$1"))
    return F.when(plain.rlike("^'.*'$") | plain.rlike('^".*"$'), F.regexp_replace(plain, r"""^['"]|['"]$""", "")).otherwise(plain)


def _pairs(lines: Column, number: bool) -> Column:
    """(class_id, name) of list lines, numbered from 0, or of map lines."""
    if number:
        return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^\s*(\d+)\s*:", 1).cast("int").alias("class_id"), _unquoted(F.regexp_extract(x, r"^\s*\d+\s*:(.*)$", 1)).alias("name")))
    return F.transform(lines, lambda x, i: F.struct(i.cast("int").alias("class_id"), _unquoted(F.regexp_replace(x, r"^\s*-\s+", "")).alias("name")))


def _cut(text: Column) -> Column:
    """The parts of a list between its commas, but for those in quotes; white space alone between commas is none.

    A comma is in quotes if what follows it has an open quote, so the text is
    read from its end.  Possessive groups keep the time linear and the stack flat.
    """
    parts = F.regexp_extract_all(F.reverse(text), F.lit(r"""(?s)(?:[^'",]|'[^']*+'|"[^"]*+"|['"].*+)++"""), F.lit(0))
    return F.filter(F.reverse(F.transform(parts, F.reverse)), lambda x: F.trim(x) != "")


def yaml_names(text: Column) -> Column:
    """array of (class_id, name) under `names`: a list or map in brackets or on lines of its own; null where there is none."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    inline = F.regexp_extract(text, r"(?m)^names\s*:\s*([\[{][^\]}]*)[\]}]", 1)
    body = F.filter(F.split(F.regexp_extract(text, r"(?m)^names\s*:[ \t]*(?:#.*)?\n((?:(?:[ \t]+\S.*|-\s.*|[ \t]*|#.*)(?:\n|\z))++)", 1), "\n"), lambda x: ~x.rlike(r"^\s*(#.*)?$"))
    items = _cut(F.substring(inline, 2, 1 << 30))
    return (
        F.when(inline.startswith("{"), _pairs(items, True)).when(inline.startswith("["), _pairs(items, False))
        .when((F.size(body) > 0) & F.forall(body, lambda x: x.rlike(r"^\s*-\s")), _pairs(body, False)).when((F.size(body) > 0) & F.forall(body, lambda x: x.rlike(r"^\s*\d+\s*:")), _pairs(body, True))
    )


def plain_names(text: Column) -> Column:
    """array of (class_id, name) of a list with one name a line; blank lines don't count."""
    return F.transform(F.filter(F.transform(F.split(text, "\r\n?|\n"), lambda x: F.trim(x)), lambda x: x != ""), lambda x, i: F.struct(i.cast("int").alias("class_id"), x.alias("name")))


def yaml_splits(text: Column) -> Column:
    """array of (split, path) of the splits that a `dataset.yaml` names."""
    found = [F.struct(F.lit(s).alias("split"), _unquoted(F.regexp_extract(text, rf"(?m)^{s}\s*:[ \t]*(\S.*)$", 1)).alias("path")) for s in SPLITS]
    return F.filter(F.array(*found), lambda x: x["path"] != "")


def class_lists(files: DataFrame, key: str) -> DataFrame:
    """(key, class_id, name, problem) of image sets, from files (key, file, text).

    A set's dataset.yaml comes before its classes.txt, unless it names nothing.
    problem is null for sound rows; `none` where a set names nothing, `repeated`
    for a name or number that a set has twice, `blank` for one without letters.
    """
    named = F.when(F.col("file").endswith("dataset.yaml"), yaml_names(F.col("text"))).otherwise(plain_names(F.col("text")))
    read = files.select(key, F.when(F.col("file").endswith("dataset.yaml"), 0).otherwise(1).alias("rank"), named.alias("names")).withColumn("none", F.coalesce(F.size("names"), F.lit(0)) <= 0)
    best = read.groupBy(key).agg(F.min_by("names", F.struct("none", "rank")).alias("names"), F.min("none").alias("none"))
    none = F.array(F.struct(F.lit(None).cast("int").alias("class_id"), F.lit(None).cast("string").alias("name")))
    names = best.select(key, "none", F.inline(F.when(F.col("none"), none).otherwise(F.col("names"))))
    # A set may have many names: they are counted by name and by number, not held against each other.
    twice = lambda field: F.count(field).over(Window.partitionBy(key, field)) > 1
    problem = F.when(F.col("none"), "none").when(F.col("name") == "", "blank").when(twice("name") | twice("class_id"), "repeated")
    return names.select(key, "class_id", "name", problem.alias("problem"))


def read_class_lists(spark: SparkSession, folder: str) -> DataFrame:
    """class_lists of every folder at or below one, by its path."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="{dataset.yaml,classes.txt}")
    path = F.col("_metadata.file_path")
    return class_lists(files.select(F.regexp_replace(path, r"/[^/]+$", "").alias("folder"), path.alias("file"), F.col("value").alias("text")), "folder")
