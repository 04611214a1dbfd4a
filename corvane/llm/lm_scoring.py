"""Language-model scores of documents by a hierarchical Pitman-Yor model of words.

A word's context is the class of the word before it: its hash in one of CLASSES,
so that frequent words have a class nearly to themselves and rare ones share.
Each class has a restaurant; they all share one parent, whose own base is uniform
over the learned words and one more, for unknown ones.

Documents are cut into slices.  A slice sends its distinct pairs of class and
word to the buckets of the words, where customers are counted, seats are sampled
and averaged predictive probabilities computed; these return to the slice, in
the same order.  A frequent word meets there once for each slice, not for each
document or token, and nothing as large as the vocabulary is sent around.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import pitman_yor as py
from corvane.llm.textkit import batches_of, by_text, checkpointed, gathered, lower_ascii, mixed, partitions, word_hashes, word_spans

#: Bytes of text and documents in a slice, at most (a longer text is a slice alone).
SLICE_BYTES, SLICE_ROWS = 8 << 20, 50_000
#: Bytes of a slice whose words are looked up at once.
PIECE_BYTES = 1 << 20
#: Discount and strength of the class restaurants and of their parent.
DISCOUNT, STRENGTH = 0.75, 5.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.6, 10.0
#: Gibbs sweeps of the first round, and in the last one before and for the averages.
FIRST_SWEEPS, BURN_IN, SAMPLES = 3, 2, 4
#: Classes in a row of totals.
TOTALS_BLOCK = 4096
#: Classes of preceding words, whose totals all pass through the driver: a bound on what is broadcast.
CLASSES = 1 << 16
#: The end of a text, as a word.
_END = np.uint64(0x5851F42D4C957F2D)


def _tokens(data: np.ndarray, offsets: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hash, context class and text number of each token, ends included."""
    data = lower_ascii(data)
    starts, ends, numbers = word_spans(data, offsets)
    words = mixed(word_hashes(data, starts, ends))
    del data, starts, ends
    own = (words & np.uint64(CLASSES - 1)).astype(np.uint16)
    edges = by_text(numbers, count)
    at = np.arange(len(numbers)) + numbers  # an end stands after each text's words
    end_at = edges[1:] + np.arange(count)
    hashes, classes = np.empty(len(numbers) + count, np.uint64), np.zeros(len(numbers) + count, np.uint16)
    hashes[at], hashes[end_at] = words, _END
    classes[at + 1] = own
    classes[edges[:-1] + np.arange(count)] = 0
    owners = np.empty(len(hashes), np.uint16)  # a slice has fewer rows
    owners[at], owners[end_at] = numbers, np.arange(count)
    return hashes, classes, owners


def _piecewise(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The tokens of a slice, taken from pieces of PIECE_BYTES (a longer text alone), which bounds what the look-up holds."""
    found, start, count = [], 0, len(offsets) - 1
    while start < count:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + PIECE_BYTES, side="right")) - 1)
        hashes, classes, owners = _tokens(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start], end - start)
        found.append((hashes, classes, owners + np.uint16(start)))
        start = end
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _packed(*arrays: np.ndarray) -> bytes:
    raw = b"".join(a.tobytes() for a in arrays)
    return struct.pack("<Q", len(raw)) + pa.Codec("zstd").compress(raw, asbytes=True)


class _Reader:
    """Arrays from packed bytes, one after another."""

    def __init__(self, data: bytes):
        self.raw, self.at = pa.Codec("zstd").decompress(data[8:], struct.unpack_from("<Q", data)[0], asbytes=True), 0

    def take(self, kind: str, count: int) -> np.ndarray:
        out = np.frombuffer(self.raw, dtype=kind, count=count, offset=self.at)
        self.at += out.nbytes
        return out


_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_())]
_NAMES = ["batch", "bucket", "n_words", "n_pairs", "payload", "ids", "held"]
_SCHEMA = "batch bigint, bucket int, n_words bigint, n_pairs bigint, payload binary, ids array<bigint>, held array<boolean>"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=False)], names=_NAMES[: len(columns)])


def _slice_rows(buckets: int):
    """For each slice a row of its occurrences (bucket -1) and one of its pairs for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for rows, data, offsets in gathered(batches, SLICE_BYTES, SLICE_ROWS):
            batch, number = (part << 32) | number, number + 1
            hashes, classes, owners = _piecewise(data, offsets)
            data = offsets = None
            held = rows["held"].combine_chunks()
            train = ~held.to_numpy(zero_copy_only=False).astype(bool)
            order = np.lexsort((owners, classes, hashes))
            h, c, d = hashes[order], classes[order], owners[order]
            del order, hashes, classes, owners
            new_word = np.concatenate(([True], h[1:] != h[:-1]))
            new_pair = new_word | np.concatenate(([True], c[1:] != c[:-1]))
            heads = np.flatnonzero(new_pair | np.concatenate(([True], d[1:] != d[:-1])))
            times = np.diff(np.append(heads, len(h))).astype(np.uint32)
            d = d[heads]
            pairs = np.flatnonzero(new_pair[heads])  # in occurrences
            words = np.flatnonzero(new_word[heads[pairs]])  # in pairs
            learned = np.add.reduceat(np.where(train[d], times, np.uint32(0)), pairs)
            documents = np.diff(np.append(pairs, len(d)))
            pair_class = c[heads[pairs]]
            word_hash = h[heads[pairs[words]]]
            own_pairs = np.diff(np.append(words, len(pairs)))
            payload = struct.pack("<Q", len(d)) + _packed(own_pairs.astype("<u4"), documents.astype("<u4"), d.astype("<u2"), times.astype("<u4"))
            yield _batch([(batch, -1, len(words), len(pairs), payload, rows["id"].to_pylist(), held.to_pylist())])
            bucket = ((word_hash >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # rises with the hash
            out = []
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            for at in range(buckets):
                a, b = cuts[at], cuts[at + 1]
                if a < b:
                    u, v = words[a], words[b] if b < len(words) else len(pairs)
                    out.append((batch, at, int(b - a), int(v - u), _packed(word_hash[a:b], own_pairs[a:b].astype("<u4"), pair_class[u:v].astype("<u2"), learned[u:v].astype("<u4")), None, None))
            yield _batch(out)

    return run


class _Bucket:
    """The pairs of the words of a bucket, added up over slices."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.slices, hashes, classes, learned = [], [], [], []
        for b in batches:
            for batch, bucket, n_words, n_pairs, data in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                read = _Reader(data)
                hashes.append(np.repeat(read.take("<u8", n_words), (counts := read.take("<u4", n_words)).astype(np.int64)))
                classes.append(read.take("<u2", n_pairs))
                learned.append(read.take("<u4", n_pairs))
                self.slices.append((batch, bucket, n_words, n_pairs, np.cumsum(counts.astype(np.int64)) - counts))
        if not self.slices:
            return
        h, c = np.concatenate(hashes), np.concatenate(classes).astype(np.int64)
        self.words, word = np.unique(h, return_inverse=True)
        keys, self.pair = np.unique(word.astype(np.int64) * CLASSES + c, return_inverse=True)
        self.word, self.context = keys // CLASSES, keys % CLASSES
        self.customers = np.bincount(self.pair, np.concatenate(learned).astype(float), len(keys))
        self.counts = np.bincount(self.word, self.customers, len(self.words))
        self.seen = np.flatnonzero(self.customers > 0)
        self.many = self.seen[self.customers[self.seen] > 1]  # others have one customer at one table


def _start(bucket: _Bucket) -> tuple[np.ndarray, np.ndarray]:
    """First tables of pairs and of words: those expected for their customers."""
    tables = np.where(bucket.customers > 0, np.ceil(np.maximum(bucket.customers, 0) ** DISCOUNT), 0)
    above = np.bincount(bucket.word, tables, len(bucket.words))
    return tables, np.where(above > 0, np.ceil(above**ROOT_DISCOUNT), 0)


def _sweeps(bucket: _Bucket, totals: Totals, sweeps: int, seed: int):
    """Gibbs sweeps over a bucket from its first tables; yields tables of pairs and of words after each one.

    Each sweep seats all dishes given the totals of the round before, of all
    buckets alike, with draws that belong to the words: how words are dealt out
    over buckets changes nothing.
    """
    tables, root_tables = _start(bucket)
    many, seen_words = bucket.many, np.flatnonzero(bucket.counts > 0)
    pair_draws = py.Draws(mixed(bucket.words[bucket.word[many]]) + bucket.context[many].astype(np.uint64), seed)
    word_draws = py.Draws(bucket.words[seen_words], seed)
    all_tables, all_root = totals.tables[-1], totals.root_tables[-1]
    for _ in range(sweeps):
        root = _root(bucket, tables, root_tables, all_tables.sum(), all_root, totals.words)
        if len(many):
            others = np.maximum(all_tables[bucket.context[many]] - tables[many], 0)
            tables[many] = py.reseat(bucket.customers[many], tables[many], others, np.maximum(root[bucket.word[many]], 1e-300), STRENGTH, DISCOUNT, pair_draws)
        customers_above = np.bincount(bucket.word, tables, len(bucket.words))
        if len(seen_words):
            others = np.maximum(all_root - root_tables[seen_words], 0)
            root_tables[seen_words] = py.reseat(customers_above[seen_words], root_tables[seen_words], others, np.full(len(seen_words), 1 / (totals.words + 1)), ROOT_STRENGTH, ROOT_DISCOUNT, word_draws)
        yield tables, root_tables


def _samples(bucket: _Bucket, totals: Totals, seed: int):
    """The seatings that predictions are averaged over."""
    for at, state in enumerate(_sweeps(bucket, totals, BURN_IN + SAMPLES, seed)):
        if at >= BURN_IN:
            yield state


def _root(bucket: _Bucket, tables: np.ndarray, root_tables: np.ndarray, all_above: float, all_root: float, words: float) -> np.ndarray:
    """The shared parent's probabilities of a bucket's words."""
    above = np.bincount(bucket.word, tables, len(bucket.words))
    return py.predictive(above, root_tables, all_above, all_root, 1 / (words + 1), ROOT_STRENGTH, ROOT_DISCOUNT)


def predictions(bucket: _Bucket, totals: Totals, samples: Totals, seed: int):
    """For each sample the probabilities of a bucket's pairs and, from the parent alone, of its words.

    samples has the totals of these same seatings, so that in each sample a
    class's probabilities of all words and of the unknown one sum to one.
    """
    room = totals.customers[bucket.context]
    for at, (tables, root_tables) in enumerate(_samples(bucket, totals, seed)):
        all_tables = samples.tables[at]
        root = _root(bucket, tables, root_tables, all_tables.sum(), samples.root_tables[at], totals.words)
        yield py.predictive(bucket.customers, tables, room, all_tables[bucket.context], root[bucket.word], STRENGTH, DISCOUNT), root


@dataclass(frozen=True)
class Totals:
    """Sums over all buckets: learned words, customers of each class and, for each of some seatings, tables of each class and of the parent."""

    words: float
    customers: np.ndarray
    tables: np.ndarray
    root_tables: np.ndarray


def _block_rows(tables: list[np.ndarray], numbers: list[float]) -> Iterator[pa.RecordBatch]:
    """Sums of a bucket as rows: the classes in blocks, and last the plain numbers under block -1."""
    whole = np.stack(tables)
    rows = [(at, whole[:, at : at + TOTALS_BLOCK].tobytes()) for at in range(0, CLASSES, TOTALS_BLOCK) if whole[:, at : at + TOTALS_BLOCK].any()]
    rows.append((-1, np.array(numbers, float).tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["block", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up rows of equal blocks; a task holds one for each of its blocks, of which there are CLASSES / TOTALS_BLOCK + 1."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, sums in zip(batch["block"].to_pylist(), batch["sums"].to_pylist(), strict=True):
            own = np.frombuffer(sums, float)
            held[block] = held[block] + own if block in held else own
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()])], names=["block", "sums"])


def _summed(pairs: DataFrame, of_bucket, rows: int, numbers: int) -> tuple[np.ndarray, np.ndarray]:
    """Over all buckets, the sums of some rows of classes and of some numbers; they are whole, so their order doesn't matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Bucket(batches)
        if bucket.slices:
            yield from _block_rows(*of_bucket(bucket))

    parts = pairs.mapInArrow(run, "block bigint, sums binary").repartition(partitions(pairs.sparkSession), "block").mapInArrow(_added, "block bigint, sums binary")
    tables, plain = np.zeros((rows, CLASSES)), np.zeros(numbers)
    for r in parts.collect():
        own = np.frombuffer(r["sums"], float)
        if r["block"] < 0:
            plain += own
        else:
            tables[:, r["block"] : r["block"] + TOTALS_BLOCK] += own.reshape(rows, -1)
    return tables, plain


def _by_class(bucket: _Bucket, values: np.ndarray) -> np.ndarray:
    return np.bincount(bucket.context, values, CLASSES)


def _first_sums(bucket: _Bucket):
    tables, root_tables = _start(bucket)
    return [_by_class(bucket, bucket.customers), _by_class(bucket, tables)], [float((bucket.counts > 0).sum()), float(root_tables.sum())]


def _sums_of(seatings):
    """The sums of a bucket in each of its seatings."""

    def run(bucket: _Bucket):
        found = [(_by_class(bucket, tables), float(root_tables.sum())) for tables, root_tables in seatings(bucket)]
        return [x[0] for x in found], [x[1] for x in found]

    return run


def _totals(pairs: DataFrame, seed: int) -> tuple[Totals, Totals]:
    """The totals that the last round seats by, and those of each of its samples."""
    (customers, tables), (words, root) = _summed(pairs, _first_sums, 2, 2)
    start = Totals(words, customers, tables[None], np.array([root]))
    tables, root = _summed(pairs, _sums_of(lambda b: _sweeps(b, start, FIRST_SWEEPS, seed)), FIRST_SWEEPS, FIRST_SWEEPS)
    first = Totals(words, customers, tables, root)
    tables, root = _summed(pairs, _sums_of(lambda b: _samples(b, first, seed + 1)), SAMPLES, SAMPLES)
    return first, Totals(words, customers, tables, root)


def _answers(totals: Totals, samples: Totals, seed: int):
    """For each slice and bucket: the counts of its words and the averaged log10 probabilities of its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Bucket(batches)
        if not bucket.slices:
            return
        mean = np.zeros(len(bucket.word))
        for own, _ in predictions(bucket, totals, samples, seed + 1):
            mean += own / SAMPLES
        log = np.log10(mean).astype("<f4")
        at = 0
        for batch, number, n_words, n_pairs, heads in bucket.slices:
            own = bucket.pair[at : at + n_pairs]
            at += n_pairs
            counts = bucket.counts[bucket.word[own[heads]]].astype("<i8")
            yield _batch([(batch, number, n_words, n_pairs, _packed(counts, log[own]))])

    return run


def _document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins each slice's occurrences with the answers; rows come ordered by slice and bucket."""

    def finish(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held or held[0][0] != -1:
            return
        _, n_words, n_pairs, data, ids, flags = held[0]
        n = struct.unpack_from("<Q", data)[0]
        read = _Reader(data[8:])
        own_pairs, documents = read.take("<u4", n_words), read.take("<u4", n_pairs)
        d, times = read.take("<u2", n).astype(np.int64), read.take("<u4", n).astype(float)
        parts = [(_Reader(x[3]), x[1], x[2]) for x in held[1:]]
        counts = np.concatenate([r.take("<i8", words) for r, words, _ in parts])
        log = np.concatenate([r.take("<f4", pairs) for r, _, pairs in parts]).astype(float)
        if len(counts) != n_words or len(log) != n_pairs:
            raise RuntimeError("a slice's answers don't fit its words; was the input changed meanwhile?")
        c = np.repeat(np.repeat(counts, own_pairs), documents)
        total = lambda x: np.bincount(d, x * times, len(ids))
        columns = [pa.array(ids, pa.int64()), pa.array(flags, pa.bool_()), pa.array(total(np.ones(n)).astype(np.int64)), pa.array(total(c > 0).astype(np.int64)), pa.array(total(np.log10(c + 0.5))), pa.array(total(np.repeat(log, documents)))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "n_tokens", "n_known", "base", "score"])

    now, held = None, []
    for b in batches:
        for batch, *rest in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
            if batch != now:
                yield from finish(held)
                now, held = batch, []
            held.append(tuple(rest))
    yield from finish(held)


def lm_scores(docs: DataFrame, held_out: Column, *, key: str = "doc_id", text: str = "text", seed: int = 11) -> DataFrame:
    """One row for each document: key (an integer), held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    The model learns from rows where held_out is false.  score is the base-10
    logarithm of the model's probability of the text, end included, and
    perplexity that of a token.  A null or empty text is its end alone; repeated
    rows count as often as they stand there and get a row each; an empty table
    gives none; other columns are not read.
    """
    spark = docs.sparkSession
    buckets = partitions(spark)
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cut = checkpointed(batches_of(rows, _slice_rows(buckets), _SCHEMA))
    pairs = checkpointed(cut.where("bucket >= 0").select("batch", "bucket", "n_words", "n_pairs", "payload").repartitionById(buckets, F.col("bucket")))  # a task for each bucket: by hash, some tasks would get several
    totals, samples = _totals(pairs, seed)
    train_tokens, words = int(totals.customers.sum()), totals.words
    answers = pairs.mapInArrow(_answers(totals, samples, seed), "batch bigint, bucket int, n_words bigint, n_pairs bigint, payload binary")
    both = cut.where("bucket = -1").unionByName(answers, allowMissingColumns=True)
    dealt = both.repartition(buckets, "batch").sortWithinPartitions("batch", "bucket").select(*_NAMES)
    found = dealt.mapInArrow(_document_rows, "id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double")
    divisor = float(np.log10(train_tokens + 0.5 * (words + 1)))
    base = F.col("base") - F.col("n_tokens") * F.lit(divisor)
    return found.select(F.col("id").alias(key), "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
