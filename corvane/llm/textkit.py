"""Helpers that the operators of this subpackage share: Arrow batches to words.

A word is a run of bytes other than 0x20 and 0x09-0x0D, taken from UTF-8.  The
functions work on a whole Arrow batch at once: the texts of a batch are one
byte buffer, and words are positions in it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in slices of at most so many bytes (a longer text alone).
SLICE_BYTES = 4 << 20
#: Rows in an Arrow batch that Spark hands to Python, which bounds its memory.
BATCH_ROWS = 1000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def batches_of(frame: DataFrame, function: Callable, schema: str) -> DataFrame:
    """mapInArrow with batches of BATCH_ROWS rows, unless the session asks for fewer."""
    spark = frame.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))
    return frame.mapInArrow(function, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session's checkpoints, which all executors share.

    Without spark.checkpoint.dir a local session takes a temporary folder, as in
    tests; on a cluster that is an error, as executors would not see it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="corvane-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder beside the session's checkpoints."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(frame: DataFrame) -> DataFrame:
    """The rows written to the session's checkpoint folder, which cuts the lineage."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_remainder(column: Column, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty) and their n + 1 offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    array = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches into row ranges of at most `most` bytes of text: (rows, bytes, offsets)."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
        start, rows = 0, batch.num_rows
        while start < rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
            yield batch.slice(start, end - start), data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
            start = end


def gathered(batches: Iterator[pa.RecordBatch], most: int, rows: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Whole documents of batches with a text column, put together up to so many bytes and rows: (rows, bytes, offsets)."""
    held, size, count = [], 0, 0

    def flush():
        table = pa.Table.from_batches(held)
        return table, *text_buffer(table["text"])

    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            more = pc.sum(pc.binary_length(part["text"])).as_py() or 0
            if held and (size + more > most or count + part.num_rows > rows):
                yield flush()
                held, size, count = [], 0, 0
            held.append(part)
            size, count = size + more, count + part.num_rows
    if held:
        yield flush()


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word; words don't cross texts."""
    inside = ~separators[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first, last = inside.copy(), inside.copy()
    if len(data):
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        before[edges], after[edges - 1] = False, False
        first &= ~before
        last &= ~after
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def distinct(data: np.ndarray, places: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct byte strings among the n that lie one after another in data, and the number of each one's."""
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(np.ascontiguousarray(places, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = whole.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def numbered_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of a buffer, compared byte by byte, and the number of each word's; words rise and don't overlap."""
    step = np.zeros(len(data) + 1, np.int8)
    step[starts] = 1
    step[ends] -= 1  # where the next word starts at once, nothing changes
    inside = np.cumsum(step[:-1], dtype=np.int8).view(bool)
    return distinct(data[inside], np.concatenate(([0], np.cumsum(ends - starts))))


def strings(values: pa.Array) -> list[bytes]:
    """The byte strings of a large_binary array without nulls, sliced from its buffer."""
    if not len(values):
        return []
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[values.offset : values.offset + len(values) + 1].tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def hashes_of(values: pa.Array) -> np.ndarray:
    """XXH3 of each byte string, 64 bits."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, strings(values)), dtype=np.uint64, count=len(values))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH3 of each word's bytes, worked out once for each distinct word."""
    words, which = numbered_words(data, starts, ends)
    return hashes_of(words)[which]


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each `size` consecutive word hashes, mixed one after another."""
    count = max(0, len(hashes) - size + 1)
    out = np.full(count, size, dtype=np.uint64)
    for at in range(size):
        out = mixed(out * _STEP + hashes[at : at + count])
    return out


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with one space after each, and each word's start in that."""
    lengths = ends - starts
    places = np.cumsum(lengths + 1) - lengths - 1
    out = np.full(int(lengths.sum()) + len(lengths), 0x20, dtype=np.uint8)
    where = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(places, lengths) + where] = data[np.repeat(starts, lengths) + where]
    return out, places


def by_text(numbers: np.ndarray, count: int) -> np.ndarray:
    """For rising text numbers of items: where each text's items start, and the end."""
    return np.searchsorted(numbers, np.arange(count + 1))
