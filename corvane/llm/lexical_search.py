"""Ranked lexical search: accumulators of short lists beside document-at-a-time skipping over long ones.

Documents are cut into shards; each keeps an inverted index of its terms.  For
an item, a shard's short lists are summed into accumulators at once (term at a
time).  These then stand beside the long lists as one more iterator with a bound
on its scores, and all are read document by document: blocks of documents whose
bounds can't reach the item's tenth best score are skipped, lists that can't
lift a document that high by themselves are only probed, and a document is
dropped as soon as what is left can't save it.  A task carries the tenth best
scores on from shard to shard, and sends its best documents only.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from corvane.llm.textkit import batches_of, checkpointed, gathered, lower_ascii, numbered_words, word_spans

#: Bytes of text and documents in a shard, at most (a longer text is a shard alone).
SHARD_BYTES, SHARD_ROWS = 8 << 20, 50_000
#: Lists of at most this share of a shard's documents are short.
SHORT_SHARE = 1 / 32
#: Documents in a block, for whose best score each list has a bound.
BLOCK = 64
#: Distinct words of the items in a block of items, which is broadcast, and items in it, at most.
BLOCK_TERMS, BLOCK_ITEMS = 200_000, 20_000
#: Tasks whose best documents of an item are ranked together before the last ranking.
MERGED_TASKS = 64

#: What stands between terms: ASCII other than letters and digits.
BETWEEN = np.zeros(256, dtype=bool)
BETWEEN[[b for b in range(0x80) if not chr(b).isalnum()]] = True

_INDEX = "shard bigint, ids array<bigint>, n_docs bigint, n_terms bigint, payload binary"


def terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of an Arrow column of texts (null: empty): the distinct terms, and the number and text of each occurrence."""
    from corvane.llm.textkit import text_buffer

    return _terms(*text_buffer(column))


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    data = lower_ascii(data)
    starts, ends, owner = word_spans(data, offsets, BETWEEN)
    terms, which = numbered_words(data, starts, ends)
    return terms, which, owner


def _pack(arrays: list[np.ndarray]) -> bytes:
    raw = b"".join(a.tobytes() for a in arrays)
    return struct.pack("<Q", len(raw)) + pa.Codec("zstd").compress(raw, asbytes=True)


class _Shard:
    """A shard's index: lengths of its documents, terms, and postings (document, occurrences) by term."""

    def __init__(self, ids: list, payload: bytes):
        raw = pa.Codec("zstd").decompress(payload[8:], struct.unpack_from("<Q", payload)[0], asbytes=True)
        counts, at = np.frombuffer(raw, "<u8", 4), 32
        parts = []
        for kind, count in zip(("<u4", "<u4", "<u4", "<u4", "<u4"), (counts[0], counts[1], counts[1], counts[2], counts[2]), strict=True):
            parts.append(np.frombuffer(raw, kind, int(count), at))
            at += parts[-1].nbytes
        self.lengths, sizes, lists, self.docs, self.times = parts
        self.ids = ids
        self.starts = np.concatenate(([0], np.cumsum(lists, dtype=np.int64)))
        places = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        self.terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(places), pa.py_buffer(raw[at:])])

    def found(self, wanted: pa.Array) -> np.ndarray:
        """The number in this shard of each wanted term, -1 where it has none."""
        if not len(self.terms):
            return np.full(len(wanted), -1)
        return pc.fill_null(pc.index_in(wanted, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    for rows, data, offsets in gathered(batches, SHARD_BYTES, SHARD_ROWS):
        terms, which, owner = _terms(data, offsets)
        n = len(offsets) - 1
        lengths = np.bincount(owner, minlength=n)
        keys, times = np.unique(which.astype(np.int64) * n + owner, return_counts=True)
        lists = np.bincount(keys // n, minlength=len(terms)) if len(keys) else np.zeros(len(terms), np.int64)
        _, ends, words = terms.buffers() if len(terms) else (None, None, None)
        places = np.frombuffer(ends, np.int64)[terms.offset : terms.offset + len(terms) + 1] if len(terms) else np.zeros(1, np.int64)
        words = np.frombuffer(words, np.uint8)[places[0] : places[-1]] if words is not None else np.zeros(0, np.uint8)
        counts = np.array([n, len(terms), len(keys), 0], "<u8")
        payload = _pack([counts, lengths.astype("<u4"), np.diff(places).astype("<u4"), lists.astype("<u4"), (keys % n).astype("<u4"), times.astype("<u4"), words])
        values = [[(part << 32) | number], [rows["id"].to_pylist()], [int((lengths > 0).sum())], [int(lengths.sum())], [payload]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["shard", "ids", "n_docs", "n_terms", "payload"])
        number += 1


def lexical_index(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index: a row for each shard of documents, with their ids and its packed terms and postings.

    key is an integer, by which equal scores are ordered; others are refused.  A
    null or empty text has no terms and is never found; rows with a null key are
    documents like others; repeated rows are documents of their own; an empty
    table gives an empty index; other columns are not read.
    """
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise ValueError(f"{key} orders equal scores and has to be an integer")
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return checkpointed(batches_of(rows, _shards, _INDEX))


class _Block:
    """Items that are searched together: numbers and terms with their times, and the distinct terms of all."""

    def __init__(self, first: int):
        self.first, self.keys, self.items, self.numbers = first, [], [], {}

    def add(self, key, words: list[bytes]) -> None:
        own: dict[int, int] = {}
        for w in words:
            at = self.numbers.setdefault(w, len(self.numbers))
            own[at] = own.get(at, 0) + 1
        self.keys.append(key)
        self.items.append((np.array(list(own), np.int64), np.array(list(own.values()), np.int64)))

    def terms(self) -> pa.Array:
        return pa.array(list(self.numbers), pa.large_binary())


def _blocks(items: DataFrame, terms: int, most: int) -> Iterator[_Block]:
    """Items in blocks of bounded size, read one partition after another; only the block at hand is held."""
    block = _Block(0)
    for row in items.toLocalIterator():
        words, which, _ = terms_of(pa.array([row["text"]], pa.string()))
        own = [words[int(i)].as_py() for i in which]
        if block.keys and (len(block.numbers) + len(own) > terms or len(block.keys) >= most):
            yield block
            block = _Block(block.first + len(block.keys))
        block.add(row["key"], own)
    if block.keys:
        yield block


def _frequencies(wanted):
    """Documents that hold each wanted term, a row for each term that a task has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, total = wanted.value, None
        for batch in batches:
            for payload in batch["payload"].to_pylist():
                shard = _Shard([], payload)
                at = shard.found(terms)
                held = np.diff(shard.starts)[at] if len(shard.terms) else np.zeros(len(terms), np.int64)
                own = np.where(at >= 0, held, 0)
                total = own if total is None else total + own
        if total is not None:
            met = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met].astype(np.int64))], names=["term", "n"])

    return run


class _List:
    """One iterator: rising documents with their scores, the best of all and of each block of documents."""

    def __init__(self, docs: np.ndarray, scores: np.ndarray, blocks: int):
        self.docs, self.scores, self.bound = docs, scores, int(scores.max()) if len(scores) else 0
        self.block = np.zeros(blocks, np.int64)
        numbers = docs // BLOCK
        heads = np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1]))) if len(docs) else np.zeros(0, np.int64)
        if len(heads):
            self.block[numbers[heads]] = np.maximum.reduceat(scores, heads)

    def at(self, docs: np.ndarray) -> np.ndarray:
        """The scores of some rising documents, 0 where the list lacks them."""
        place = np.searchsorted(self.docs, docs)
        place[place == len(self.docs)] = 0
        return np.where(self.docs[place] == docs, self.scores[place], 0)


def _summed(docs: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores added up by document, documents rising."""
    order = np.argsort(docs, kind="stable")
    docs, scores = docs[order], scores[order]
    heads = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
    return docs[heads], np.add.reduceat(scores, heads)


def hybrid(short: list[tuple[np.ndarray, np.ndarray]], long: list[tuple[_List, int]], least: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that score `least` or more, and their scores, from short (documents, scores) and long (list, times).

    Others may be among them with a score below `least`, but none at or above it is lost.
    """
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    lists = list(long)
    if short:
        lists.append((_List(*_summed(np.concatenate([d for d, _ in short]), np.concatenate([s for _, s in short])), blocks), 1))
    lists = sorted((x for x in lists if x[0].bound), key=lambda x: x[0].bound * x[1])
    bounds = np.cumsum([x.bound * times for x, times in lists])
    if not len(bounds) or bounds[-1] < least:
        return nothing
    alive = sum(x.block * times for x, times in lists) >= least
    if not alive.any():
        return nothing
    first = int(np.searchsorted(bounds, least))  # lists before it can't lift a document to `least` by themselves
    whole = bool(alive.all())
    docs, scores = [], []
    for x, times in lists[first:]:
        kept = slice(None) if whole else alive[x.docs // BLOCK]
        docs.append(x.docs[kept])
        scores.append(x.scores[kept] * times)
    docs, scores = _summed(np.concatenate(docs), np.concatenate(scores)) if sum(map(len, docs)) else nothing
    for at in range(first - 1, -1, -1):
        kept = scores + bounds[at] >= least
        docs, scores = docs[kept], scores[kept]
        if not len(docs):
            return nothing
        scores = scores + lists[at][0].at(docs) * lists[at][1]
    kept = scores >= least
    return docs[kept], scores[kept]


class _Best:
    """The best documents of an item so far: scores falling, equal ones by rising id, unknown ids last."""

    def __init__(self, most: int):
        self.most, self.rows, self.least = most, [], 1

    def add(self, scores: list[int], ids: list) -> None:
        self.rows = sorted(self.rows + list(zip(scores, ids, strict=True)), key=lambda r: (-r[0], r[1] is None, r[1] or 0))[: self.most]
        if len(self.rows) == self.most:
            self.least = self.rows[-1][0]  # an equal score may still win by its id


def _search(shared, top: int):
    """The best documents of every item in a task's shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, items, weights, n_all, l_all = shared.value
        best = [_Best(top) for _ in items]
        for batch in batches:
            for ids, payload in zip(batch["ids"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                _scan(_Shard(ids, payload), terms, items, weights, n_all, l_all, best)
        out = [(number, s, i) for number, b in enumerate(best) for s, i in b.rows]
        if out:
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["number", "score", "id"])

    return run


def _scan(shard: _Shard, terms: pa.Array, items: list, weights: np.ndarray, n_all: int, l_all: int, best: list[_Best]) -> None:
    where, sizes = shard.found(terms), np.diff(shard.starts)
    blocks = -(-len(shard.lengths) // BLOCK)
    room = 100 - 75 + (75 * shard.lengths.astype(np.int64) * n_all) // l_all
    made: dict[int, _List] = {}

    def list_of(term: int) -> _List:
        if term not in made:
            a, b = shard.starts[where[term]], shard.starts[where[term] + 1]
            docs, times = shard.docs[a:b].astype(np.int64), shard.times[a:b].astype(np.int64)
            made[term] = _List(docs, weights[term] * ((1_000_000_000 * times) // (1000 * times + 8 * room[docs])), blocks)
        return made[term]

    limit = max(1, int(len(shard.lengths) * SHORT_SHARE))
    for (own, times), kept in zip(items, best, strict=True):
        lists = [(list_of(int(t)), int(n), int(sizes[where[t]])) for t, n in zip(own, times, strict=True) if where[t] >= 0]
        if sum(x.bound * n for x, n, _ in lists) < kept.least:
            continue
        short = [(x.docs, x.scores * n) for x, n, size in lists if size <= limit]
        docs, scores = hybrid(short, [(x, n) for x, n, size in lists if size > limit], kept.least, blocks)
        if len(docs) > kept.most:  # all that reach the score of the last one that can stay
            enough = scores >= np.partition(scores, -kept.most)[-kept.most]
            docs, scores = docs[enough], scores[enough]
        if len(docs):
            kept.add(scores.tolist(), [shard.ids[int(d)] for d in docs])


def lexical_search(index: DataFrame, items: DataFrame, *, item: str = "item_id", text: str = "text", top: int = 10, key: str = "doc_id", block_terms: int = BLOCK_TERMS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item, rank, key, score): the `top` best documents of each item with a score above 0, ranks from 1.

    With N documents that hold a term, L terms in all, n terms of a document, df
    documents that hold a term and tf its times in one, a term's weight is
    floor(1000 ln((2N + 2) / (2df + 1))), a document's m is 25 + 75nN div L, and
    its score the sum of weight * (10^9 tf div (1000tf + 8m)) over the item's
    terms, repeats included.  Equal scores go by rising key, null keys last.

    Items are searched in blocks of bounded size, each over the whole index; of
    one block a task holds its lists and `top` documents an item.  An item with a
    null or empty text, or none of whose terms occurs, has no rows; repeated
    items have their own rows each; an empty table on either side gives none.
    """
    spark = index.sparkSession
    whole = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    item_type, found = items.schema[item].dataType, []
    n_all, l_all = int(whole["n"] or 0), int(whole["l"] or 0)
    for block in _blocks(items.select(F.col(item).alias("key"), F.col(text).alias("text")), block_terms, block_items) if n_all else ():
        terms = block.terms()
        wanted = spark.sparkContext.broadcast(terms)
        held = index.select("payload").mapInArrow(_frequencies(wanted), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()  # at most block_terms rows
        weights = np.zeros(len(terms), np.int64)
        for row in held:
            weights[row["term"]] = math.floor(1000 * math.log((2 * n_all + 2) / (2 * row["n"] + 1)))
        shared = spark.sparkContext.broadcast((terms, block.items, weights, n_all, l_all))
        rows = index.select("ids", "payload").mapInArrow(_search(shared, top), "number bigint, score bigint, id bigint")
        named = spark.createDataFrame([(n, k) for n, k in enumerate(block.keys)], _named_schema(item_type))
        found.append(rows.withColumn("part", F.floor(F.spark_partition_id() / MERGED_TASKS)).join(F.broadcast(named), "number").withColumn("number", F.col("number") + block.first))
    if not found:
        return index.select(F.lit(None).cast(item_type).alias(item), F.lit(0).alias("rank"), F.lit(None).cast("bigint").alias(key), F.lit(0).cast("bigint").alias("score")).where("false")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    order = [F.desc("score"), F.asc_nulls_last("id")]
    for by in (["number", "part"], ["number"]):  # what a few tasks found, then all of it
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return rows.select(F.col("item_key").alias(item), "rank", F.col("id").alias(key), "score")


def _named_schema(item_type):
    from pyspark.sql.types import LongType, StructField, StructType

    return StructType([StructField("number", LongType()), StructField("item_key", item_type)])
