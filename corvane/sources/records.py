"""Readers and writers of record formats: line records, blocks, JSON, logs and labels.

Readers take a DataFrame of whole files (source, text), as read_texts gives, or
of lines (source, line_no, line); a file is one row, so its lines keep their
order however the rows are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import rounded


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of whole files, without a byte order mark."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.input_file_name().alias("source"), F.regexp_replace("value", "^﻿", "").alias("text"))


def lines_of(texts: DataFrame) -> DataFrame:
    """(source, line_no from 1, line) of texts; a last line break opens no line."""
    cut = F.split(F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), r"\n\z", ""), "\n")
    return texts.select("source", F.posexplode(cut).alias("n", "line")).select("source", (F.col("n") + 1).alias("line_no"), "line")


def csv_manifest(spark: SparkSession, path: str, columns: tuple[str, ...], *, whole: tuple[str, ...] = (), key: tuple[str, ...] = ()) -> DataFrame:
    """The named columns of CSV files with a header, those of `whole` as whole numbers.

    A byte order mark is dropped.  A missing column raises at once; a value of
    `whole` that is no whole number raises when the rows are read.  If a key is
    given, rows that repeat it raise too, which takes one pass over the keys.
    """
    rows = spark.read.option("header", True).option("encoding", "UTF-8").option("enforceSchema", False).csv(path)
    rows = rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns])
    if missing := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    number = lambda c: F.when(F.col(c).rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c).cast("bigint")).otherwise(F.raise_error(F.concat(F.lit(f"{c} is no whole number: "), F.coalesce(c, F.lit("null")))).cast("bigint"))
    found = rows.select(*[number(c).alias(c) if c in whole else F.col(c) for c in columns])
    if key and not (again := found.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").limit(1)).isEmpty():
        raise ValueError(f"a key stands more than once: {again.first().asDict()}")
    return found


def _stripped(c: str) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def triplets(lines: DataFrame) -> DataFrame:
    """(source, position from 0, image, text): after blank lines an image line, then its text line, blank or not.

    In a run of lines between blank ones, lines pair up as image and text; an
    image left over at the end of a run has an empty text.
    """
    w = Window.partitionBy("source").orderBy("line_no")
    own = lines.withColumn("bare", _stripped("line")).withColumn("run", F.sum((F.col("bare") == "").cast("int")).over(w)).where("bare <> ''")
    place = F.row_number().over(Window.partitionBy("source", "run").orderBy("line_no")) - 1
    paired = own.withColumn("place", place).groupBy("source", "run", F.floor(F.col("place") / 2).alias("pair")).agg(F.min("line_no").alias("line_no"), F.min_by("bare", "place").alias("image"), F.max(F.when(F.col("place") % 2 == 1, F.col("bare"))).alias("text"))
    return paired.select("source", (F.row_number().over(w) - 1).alias("position"), "image", F.coalesce("text", F.lit("")).alias("text"))


def line_pairs(lines: DataFrame) -> DataFrame:
    """(source, position, image, text) of a log of pairs: blank lines don't count; an odd number raises."""
    w = Window.partitionBy("source").orderBy("line_no")
    own = lines.withColumn("bare", _stripped("line")).where("bare <> ''").withColumn("place", F.row_number().over(w) - 1)
    pairs = own.groupBy("source", F.floor(F.col("place") / 2).alias("position")).agg(F.count("*").alias("n"), F.min_by("bare", "place").alias("image"), F.max_by("bare", "place").alias("text"))
    return pairs.where(F.when(F.col("n") == 2, F.lit(True)).otherwise(F.raise_error(F.lit("a log of pairs has a line left over")).cast("boolean"))).drop("n")


def blocks(texts: DataFrame) -> DataFrame:
    """(source, position, image, text): blocks between blank lines, their first two lines; the last of equal images stays."""
    cut = texts.select("source", F.posexplode(F.split("text", r"\n[ \t\r]*\n")).alias("position", "block"))
    rows = F.filter(F.transform(F.split("block", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    own = cut.select("source", "position", rows.alias("rows")).where(F.size("rows") > 0).select("source", "position", F.col("rows")[0].alias("image"), F.coalesce(F.get("rows", F.lit(1)), F.lit("")).alias("text"))
    last = F.row_number().over(Window.partitionBy("source", "image").orderBy(F.desc("position")))
    return own.where(F.col("image").rlike(r"(?i)\.(png|jpe?g|bmp)$")).withColumn("_n", last).where("_n = 1").drop("_n")


def header_blocks(lines: DataFrame, strict: bool = True) -> DataFrame:
    """(source, position, sample_id, raw_text): a line that is an image name opens a block, to the next one.

    Blank lines at the end of a block are left out.  Text before the first
    header raises if strict, and is left out otherwise.
    """
    w = Window.partitionBy("source").orderBy("line_no")
    header = F.col("bare").rlike(r"(?i)^\S+\.(png|jpe?g)$")
    own = lines.withColumn("bare", _stripped("line")).withColumn("header", header).withColumn("position", F.sum(F.col("header").cast("int")).over(w) - 1)
    early = (F.col("position") < 0) & (F.col("bare") != "")
    own = own.where(F.when(early, F.raise_error(F.lit("text before the first header")).cast("boolean")).otherwise(F.col("position") >= 0)) if strict else own.where("position >= 0")
    bodies = own.groupBy("source", "position").agg(F.max(F.when(F.col("header"), F.col("bare"))).alias("sample_id"), F.sort_array(F.collect_list(F.when(~F.col("header"), F.struct("line_no", "line")))).alias("body"))
    return bodies.select("source", "position", "sample_id", F.regexp_replace(F.array_join(F.transform("body", lambda x: x["line"]), "\n"), r"\s+\z", "").alias("raw_text"))


def json_objects(texts: DataFrame, schema: str, keys: list[str]) -> DataFrame:
    """Rows of JSON arrays of objects with exactly these keys, with record_index; other, missing or repeated keys raise."""
    items = texts.select("source", F.posexplode(F.from_json("text", "array<string>")).alias("record_index", "item"))
    found = F.json_object_keys("item")
    exact = (F.size(found) == len(keys)) & (F.size(F.array_except(found, F.array(*map(F.lit, keys)))) == 0) & (F.size(F.array_distinct(found)) == F.size(found))
    parsed = items.where(F.when(F.coalesce(exact, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("wrong keys in record "), F.col("record_index").cast("string"))).cast("boolean")))
    return parsed.select("source", "record_index", F.from_json("item", schema).alias("r")).select("source", "record_index", "r.*")


def json_or_lines(texts: DataFrame, schema: str) -> DataFrame:
    """Rows of texts that are JSON arrays or one JSON object a line, with their format."""
    whole = F.regexp_extract("text", r"^\s*(\S)", 1) == "["
    items = F.when(whole, F.from_json("text", "array<string>")).otherwise(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    return texts.select("source", F.when(whole, "array").otherwise("lines").alias("format"), F.posexplode(items).alias("record_index", "item")).select("source", "format", "record_index", F.from_json("item", schema).alias("r")).select("source", "format", "record_index", "r.*")


def json_lines(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines with their number) of JSON lines; blank ones don't count."""
    own = lines.where(F.trim("line") != "").withColumn("whole", F.try_parse_json("line").isNotNull())
    good = own.where("whole").select("source", "line_no", F.from_json("line", schema).alias("r")).select("source", "line_no", "r.*")
    return good, own.where(~F.col("whole")).select("source", "line_no", "line")


def overrides(lines: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """(ord, record_index, method, gt_index, pred_index, reason) of JSON lines; blank and # lines don't count, wrong ones raise."""
    own = lines.where(~F.col("line").rlike(r"^\s*(#|$)")).select("line_no", F.try_parse_json("line").alias("v"), F.json_object_keys("line").alias("k"))
    kind = lambda name: F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))
    whole = lambda name: kind(name) == "BIGINT"
    names = ["record_index", "method", "gt_index", "pred_index", "reason"]
    ok = F.coalesce((F.array_sort("k") == F.array_sort(F.array(*map(F.lit, names)))) & whole("record_index") & whole("gt_index") & (whole("pred_index") | kind("pred_index").isin("VOID")) & F.try_variant_get("v", "$.method", "string").isin(*methods), F.lit(False))
    checked = own.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("wrong override in line "), F.col("line_no").cast("string"))).cast("boolean")))
    get = lambda name, to: F.try_variant_get("v", f"$.{name}", to).alias(name)
    return checked.select(F.col("line_no").alias("ord"), get("record_index", "int"), get("method", "string"), get("gt_index", "int"), get("pred_index", "int"), get("reason", "string"))


def box_labels(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """(source, annotation_index, name, cx, cy, w, h, valid) of label lines with five columns; classes: (class_id, name)."""
    part = F.split(F.trim("line"), r"\s+")
    number = lambda i: F.get("part", F.lit(i)).try_cast("double")
    own = lines.where(F.trim("line") != "").select("source", F.col("line_no").alias("annotation_index"), part.alias("part"))
    own = own.select("source", "annotation_index", F.when(F.col("part")[0].rlike(r"^(0|[1-9]\d*)$"), F.col("part")[0].try_cast("int")).alias("class_id"), *[number(i).alias(n) for i, n in enumerate(("cx", "cy", "w", "h"), 1)], (F.size("part") == 5).alias("five"))
    joined = own.join(F.broadcast(classes), "class_id", "left")
    valid = F.col("five") & F.col("name").isNotNull() & F.coalesce((F.col("w") > 0) & (F.col("h") > 0), F.lit(False))
    return joined.select("source", "annotation_index", "name", "cx", "cy", "w", "h", F.coalesce(valid, F.lit(False)).alias("valid"))


def settings(lines: DataFrame) -> DataFrame:
    """(key, value) of lines with an ASCII or full-width colon; quotes around a value are left out, the last of equal keys stays."""
    own = lines.select("line_no", F.trim(F.regexp_extract("line", r"^\s*([^:：]+)[:：](.*)$", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_extract("line", r"^\s*([^:：]+)[:：](.*)$", 2)), r"""^["'](.*)["']$""", "$1").alias("value"))
    return own.where("key <> ''").groupBy("key").agg(F.max_by("value", "line_no").alias("value"))


def last_by_key(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The last row of each key; a null key is left out."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(position)))
    return rows.where(F.col(key).isNotNull()).withColumn("_n", n).where("_n = 1").drop("_n")


def files(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, stem, length, repeated_stem) of files below a folder with one of the suffixes, in any case; empty files are not listed."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    own = found.where(F.lower("path").rlike("(" + "|".join(s.lower().replace(".", r"\.") for s in suffixes) + ")$"))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return own.withColumn("stem", stem).withColumn("repeated_stem", F.count("*").over(Window.partitionBy(F.lower("stem"))) > 1)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, length) of files, for a manifest to be held against later."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


def manifest_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = before.select("path", F.col("sha256").alias("was")), after.select("path", F.col("sha256").alias("is"))
    return a.join(b, "path", "full").where(~F.col("was").eqNullSafe(F.col("is")))


def scene_objects(texts: DataFrame) -> DataFrame:
    """(source, name, distance, direction) of scene JSON with models, rounded to 2 and 1 places as their binary values are."""
    schema = "struct<models:array<struct<name:string,distance:double,direction:double>>>"
    return texts.select("source", F.inline(F.from_json("text", schema)["models"])).select("source", "name", rounded(F.col("distance"), 2).alias("distance"), rounded(F.col("direction"), 1).alias("direction"))


def assistant_text(messages: Column, exact: bool = True) -> Column:
    """The first assistant content; exact: that role as spelled, even if empty; else any case, the first not empty."""
    if exact:
        return F.get(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(0))["content"]
    return F.get(F.filter(messages, lambda m: (F.lower(m["role"]) == "assistant") & (F.trim(m["content"]) != "")), F.lit(0))["content"]


def write_triplets(records: DataFrame, path: str) -> None:
    """Three-line records as text: image, text and a blank line."""
    records.orderBy("position").select(F.concat_ws("\n", "image", "text", F.lit(""))).write.text(path)


def conversation_json(records: DataFrame) -> DataFrame:
    """(value): a JSON object of messages and images for each record (prompt, answer, image)."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return records.select(F.to_json(F.struct(F.array(turn("user", "prompt"), turn("assistant", "answer")).alias("messages"), F.array("image").alias("images"))).alias("value"))


def create_once(frame: DataFrame, path: str) -> bool:
    """Writes rows as Parquet unless they are there already; raises where others are.  Whether it wrote."""
    spark = frame.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        frame.write.mode("errorifexists").parquet(path)
        return True
    there = spark.read.schema(frame.schema).parquet(path)
    if there.exceptAll(frame).isEmpty() and frame.exceptAll(there).isEmpty():
        return False
    raise ValueError(f"{path} holds other rows")


def _report(frame: DataFrame, most: int) -> tuple[list, int]:
    """A report's first rows, and how many are left out; they are counted only where there are more."""
    rows = frame.limit(most + 1).collect()
    return rows[:most], frame.count() - most if len(rows) > most else 0


def markdown(frame: DataFrame, most: int = 50) -> str:
    """A Markdown table of a report's first rows, and how many are left out."""
    rows, left = _report(frame, most)
    out = ["| " + " | ".join(frame.columns) + " |", "|" + "---|" * len(frame.columns)]
    out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows]
    return "\n".join(out + [f"… and {left} more"] * (left > 0))


# Characters that LaTeX reads as its own, and how they are written.
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex(frame: DataFrame, most: int = 50) -> str:
    """A LaTeX tabular of a report's first rows; numbers stand to the right."""
    rows, left = _report(frame, most)
    text = lambda v: "" if v is None else "".join(LATEX.get(c, c) for c in str(v))
    sides = "".join("r" if kind in ("int", "bigint", "double", "float") or kind.startswith("decimal") else "l" for _, kind in frame.dtypes)
    line = lambda values: " & ".join(map(text, values)) + r" \\"
    out = [rf"\begin{{tabular}}{{{sides}}}", r"\toprule", line(frame.columns), r"\midrule", *map(line, rows), r"\bottomrule", r"\end{tabular}"]
    return "\n".join(out + [f"% {left} more"] * (left > 0))


def paired_by_priority(items: DataFrame, candidates: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """For each item the candidate whose key equals the first of its keys that any candidate has."""
    wanted = items.select(key, F.posexplode(F.array(*keys)).alias("priority", "candidate"))
    found = wanted.join(candidates.select("candidate").distinct(), "candidate")
    return found.groupBy(key).agg(F.min_by("candidate", "priority").alias("candidate"), F.min("priority").alias("priority"))


def manual_categories(texts: DataFrame) -> DataFrame:
    """(sample, index, category, valid) of JSON that maps samples to maps of index to category; an index must be plain decimal."""
    outer = texts.select(F.explode(F.from_json("text", "map<string,map<string,string>>")).alias("sample", "own"))
    return outer.select("sample", F.explode("own").alias("index", "category")).withColumn("valid", F.col("index").rlike(r"^(0|[1-9][0-9]*)$"))


def with_defaults(annotations: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Columns that old annotations lack, or have as null, get their defaults."""
    for name, value in defaults.items():
        annotations = annotations.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in annotations.columns else F.lit(value))
    return annotations


def matrix_table(cells: DataFrame, row: str, column: str, value: str, order: tuple[str, ...]) -> DataFrame:
    """Cells as a table with a row for each row label and a column for each of `order`; absent ones are 0."""
    return cells.groupBy(row).pivot(column, list(order)).agg(F.sum(value)).na.fill(0)
