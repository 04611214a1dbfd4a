"""Reader of cached arrays: a manifest describes the arrays of an entry, each stored in the NPY form.

An entry is a hit, a miss (nothing cached, another kind, or made from other
inputs) or damaged (manifest and arrays don't fit each other); damaged ones are
for quarantine.  Headers are parsed from the bytes by Spark's own functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an entry may hold at most, and the types that arrays may have.
SCHEMA_VERSION = 1
MOST_ARRAYS, MOST_ELEMENTS, MOST_BYTES = 64, 100_000_000, 320 << 20
MOST_ENTRY_ELEMENTS, MOST_ENTRY_BYTES = 300_000_000, 512 << 20
ITEM_BYTES = {"bool": 1, "uint8": 1, "float32": 4}
NPY_TYPES = {"|b1": "bool", "|u1": "uint8", "<f4": "float32"}
_MANIFEST_KEYS = ("array_sha256", "arrays", "fingerprint", "kind", "metadata", "sample_id", "schema_version", "stage")


def _least_endian(data: Column, at: int, size: int) -> Column:
    """An unsigned number of some bytes from a place on (1 is the first), least byte first."""
    return F.conv(F.concat(*[F.hex(F.substring(data, at + size - 1 - i, 1)) for i in range(size)]), 16, 10).cast("bigint")


def npy_header(data: Column) -> Column:
    """struct(dtype, shape, start) of an array in the NPY form, version 1; null where it isn't one."""
    size = _least_endian(data, 9, 2)
    text = F.decode(F.substring(data, F.lit(11), size.cast("int")), "ISO-8859-1")
    dtype = F.lit(None).cast("string")
    for code, name in NPY_TYPES.items():
        dtype = F.when(F.regexp_extract(text, r"'descr'\s*:\s*'([^']*)'", 1) == code, name).otherwise(dtype)
    shape = F.transform(F.regexp_extract_all(F.regexp_extract(text, r"'shape'\s*:\s*\(([0-9,\s]*)\)", 1), F.lit(r"(\d+)"), 1), lambda x: x.cast("bigint"))
    sound = (F.hex(F.substring(data, 1, 8)) == "934E554D50590100") & (F.octet_length(data) >= 10 + size) & text.rlike(r"'fortran_order'\s*:\s*False") & dtype.isNotNull() & (F.size(shape) > 0)
    return F.when(sound, F.struct(dtype.alias("dtype"), shape.alias("shape"), (10 + size).alias("start")))


def npy_bytes(dtype: str, shape: Column, values: Column) -> Column:
    """An array in the NPY form from its type, shape and raw values."""
    code = next(c for c, name in NPY_TYPES.items() if name == dtype)
    text = F.concat(F.lit(f"{{'descr': '{code}', 'fortran_order': False, 'shape': ("), F.array_join(F.transform(shape, lambda x: x.cast("string")), ", "), F.lit("), }"))
    padded = F.concat(F.rpad(text, 117, " "), F.lit("\n"))  # 10 + 118 bytes are a multiple of 64
    return F.concat(F.unhex(F.lit("934E554D505901007600")), padded.cast("binary"), values)


def _product(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("bigint"), lambda a, b: a * b)


def read_arrays(wanted: DataFrame, manifests: DataFrame, arrays: DataFrame) -> DataFrame:
    """(sample_id, stage, outcome, reason, arrays): hit, miss or damaged, why, and the arrays of hits.

    wanted has sample_id, stage and the expected fingerprint; manifests has
    sample_id, stage and body (JSON, null if unreadable); arrays has sample_id,
    stage, name and data.  array_sha256 of a manifest covers the names and
    SHA-256 digests of its arrays in the order of names.  Without a manifest an
    entry is a miss, arrays or not; with one but without arrays it is damaged,
    even if the fingerprint is another.
    """
    parts = arrays.select("sample_id", "stage", "name", F.sha2("data", 256).alias("digest"), npy_header(F.col("data")).alias("header"), F.octet_length("data").cast("bigint").alias("size"), "data")
    held = parts.groupBy("sample_id", "stage").agg(F.sort_array(F.collect_list(F.struct("name", "digest", "header", "size", "data"))).alias("held"))  # an entry's arrays, which its manifest bounds
    rows = wanted.join(manifests.withColumn("has", F.lit(True)), ["sample_id", "stage"], "left").join(held, ["sample_id", "stage"], "left")
    v = F.try_parse_json("body")
    rows = rows.withColumns({"v": v, "held": F.coalesce("held", F.array().cast(rows.schema["held"].dataType))})
    v, held = F.col("v"), F.col("held")
    text = lambda name: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))
    described = F.try_variant_get(v, "$.arrays", "map<string,struct<shape:array<bigint>,dtype:string,ndim:bigint>>")
    rows = rows.withColumn("described", described)
    described = F.col("described")
    own = F.map_values(described)
    size_of = lambda d: _product(d["shape"]) * F.element_at(F.create_map(*[F.lit(x) for item in ITEM_BYTES.items() for x in item]), d["dtype"])
    sound = lambda d: d["ndim"].isin(2, 3) & (F.size(d["shape"]) == d["ndim"]) & F.forall(d["shape"], lambda n: n > 0) & d["dtype"].isin(*ITEM_BYTES) & (_product(d["shape"]) <= MOST_ELEMENTS) & (size_of(d) <= MOST_BYTES)
    total = lambda value: F.aggregate(own, F.lit(0).cast("bigint"), lambda a, d: a + value(d))
    fits = lambda x: (x["header"]["dtype"] == described[x["name"]]["dtype"]) & (x["header"]["shape"] == described[x["name"]]["shape"]) & (x["size"] - x["header"]["start"] == size_of(described[x["name"]]))
    checksum = F.sha2(F.array_join(F.transform(held, lambda x: F.concat_ws(":", x["name"], x["digest"])), "\n"), 256)
    base = lambda kind: (F.try_variant_get(v, "$.schema_version", "bigint") == SCHEMA_VERSION) & (text("sample_id") == F.col("sample_id")) & (text("stage") == F.col("stage")) & (text("kind") == kind) & (text("fingerprint") != "")
    keys = F.sort_array(F.json_object_keys(F.to_json(v)))
    rules = [
        (F.col("has").isNull(), "miss", "absent"),
        (base("json"), "miss", "other_kind"),
        (~base("npz"), "damaged", "manifest"),
        (F.size(held) == 0, "damaged", "no_arrays"),
        (text("fingerprint") != F.col("fingerprint"), "miss", "stale"),
        ((keys != F.array(*map(F.lit, _MANIFEST_KEYS))) | ~text("array_sha256").rlike("^[0-9a-f]{64}$") | ~F.startswith(F.schema_of_variant(F.try_variant_get(v, "$.metadata", "variant")), F.lit("OBJECT")), "damaged", "manifest"),
        (text("array_sha256") != checksum, "damaged", "checksum"),
        (~(F.size(own).between(1, MOST_ARRAYS) & F.forall(F.map_keys(described), lambda k: k.rlike("^[A-Za-z][A-Za-z0-9_]*$")) & F.forall(own, sound)), "damaged", "descriptors"),
        ((total(lambda d: _product(d["shape"])) > MOST_ENTRY_ELEMENTS) | (total(size_of) > MOST_ENTRY_BYTES), "damaged", "limits"),
        (F.sort_array(F.map_keys(described)) != F.transform(held, lambda x: x["name"]), "damaged", "names"),
        (~F.forall(held, fits), "damaged", "arrays"),
    ]
    verdict = F.struct(F.lit("hit").alias("outcome"), F.lit("").alias("reason"))
    for check, outcome, reason in reversed(rules):
        # What can't be told, as a part is missing or of another type, counts as failed.
        verdict = F.when(F.coalesce(check, F.lit(outcome == "damaged")), F.struct(F.lit(outcome).alias("outcome"), F.lit(reason).alias("reason"))).otherwise(verdict)
    rows = rows.withColumn("verdict", verdict)
    kept = F.when(F.col("verdict.outcome") == "hit", F.transform(held, lambda x: F.struct(x["name"].alias("name"), x["header"]["dtype"].alias("dtype"), x["header"]["shape"].alias("shape"), x["data"].alias("data"))))
    return rows.select("sample_id", "stage", "verdict.outcome", "verdict.reason", kept.alias("arrays"))
