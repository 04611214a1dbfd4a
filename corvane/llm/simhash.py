"""Near-duplicates by SimHash: fingerprints that differ in few bits are linked.

A fingerprint is cut into blocks.  Two that differ in at most d bits agree in
all but d blocks at most, so they share the value of some choice of
blocks - d blocks.  Joining on these values finds every close pair; the Hamming
distance is then verified.  A value that very many fingerprints share is not
paired out: there, fingerprints meet at the numbers one bit away from both.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.components import components
from corvane.llm.textkit import batches_of, by_text, checkpointed, joined, lower_ascii, slices, word_spans

#: Blocks of the registered query; pairs share BLOCKS - DISTANCE of them.
BLOCKS = 5
DISTANCE = 2
SHINGLE = 3
#: A block value with more fingerprints is handled by meeting points, with nothing left out.
BUCKET = 64


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The 64-bit SimHash of each text over its word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    count = len(offsets) - 1
    starts, ends, numbers = word_spans(lower_ascii(data), offsets)
    out = np.zeros(count, dtype=np.uint64)
    if not len(starts):
        return out
    text, places = joined(lower_ascii(data), starts, ends)
    stops = places + (ends - starts)
    edges = by_text(numbers, count)
    first, after = edges[:-1][numbers], edges[1:][numbers]
    at = np.arange(len(numbers))
    last = np.minimum(at + size, after) - 1
    whole = (at + size <= after) | (at == first)
    raw = text.tobytes()
    hashes = np.array([xxh64_intdigest(raw[a:b], 42) for a, b in zip(places[whole].tolist(), stops[last[whole]].tolist(), strict=True)], dtype=np.uint64)
    owners = numbers[whole]
    heads = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1])))
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    totals = np.diff(np.append(heads, len(owners)))
    out[owners[heads]] = np.packbits(2 * ones > totals[:, None], axis=1).view(">u8").ravel()
    return out


def _fingerprint_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            found = fingerprints_of(data, offsets, size).astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found)], names=["id", "fp"])

    return run


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) for each document, fp as a signed long; a text without words has 0."""
    kind = dict(docs.dtypes)[key]
    return batches_of(docs.select(docs[key].alias("id"), docs[text].alias("text")), _fingerprint_rows(shingle), f"id {kind}, fp bigint")


def _masks(blocks: int, shared: int) -> list[int]:
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(parts, shared)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def close_links(prints: DataFrame, *, blocks: int = BLOCKS, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) of distinct fingerprints (column fp) that connect all those within the distance.

    Values of shared blocks with up to `bucket` fingerprints give every close
    pair.  Fingerprints of fuller values are linked through the numbers at half
    the distance from both, which connects just the same ones; this way needs a
    distance of 1 or 2.
    """
    if not 0 < distance < blocks:
        raise ValueError("the distance must be at least 1 and below the number of blocks")
    masks = _masks(blocks, blocks - distance)
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("choice", "value"))
    sizes = keyed.groupBy("choice", "value").agg(F.count("*").alias("n")).where("n > 1")
    shared = checkpointed(keyed.join(sizes, ["choice", "value"]).select("choice", "value", "fp", "n"))
    few = shared.where(F.col("n") <= bucket).select("choice", "value", "fp")
    pairs = few.select("choice", "value", F.col("fp").alias("u")).join(few.withColumnRenamed("fp", "v"), ["choice", "value"]).where("u < v").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance).select("u", "v")
    many = shared.where(F.col("n") > bucket)
    if many.isEmpty():
        return pairs.distinct()
    if distance > 2:
        raise ValueError("values that many fingerprints share need a distance of 1 or 2")
    many = many.select("fp").distinct()
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long")) for i in range(64)])
    met = many.select("fp", F.explode(near).alias("between"))
    if distance == 1:  # equal halves don't exist: a neighbour is met only at itself
        known = many.select(F.col("fp").alias("between"))
        return pairs.union(met.join(known, "between").where("fp < between").select(F.col("fp").alias("u"), F.col("between").alias("v"))).distinct()
    least = met.groupBy("between").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1").select("between", "u")
    return pairs.union(met.join(least, "between").where("u <> fp").select("u", F.col("fp").alias("v"))).distinct()


def simhash_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, blocks: int = BLOCKS, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """One row for each document: key, fingerprint (16 hex digits), component_id.

    component_id is the least key that links reach, the document's own included.
    Texts that are null or have no word share the fingerprint zero and are
    linked like others.  Null keys are never a component_id unless a component
    has no other; repeated rows keep their number; an empty table gives none;
    other columns are not read.
    """
    rows = checkpointed(fingerprints(docs, key=key, text=text, shingle=shingle))
    classes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(close_links(classes.select("fp"), blocks=blocks, distance=distance, bucket=bucket))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
