"""Token files: one array of ids for many documents, with Elias-Fano boundaries.

Documents are dealt out by ranges of their keys, in order.  Each task writes
segments: a segment holds the keys and the ends of its documents as Elias-Fano
codes, and all their ids one after another, in the fewest whole bytes that the
vocabulary needs.  The start of a segment among all ids is the only 64-bit
offset; within it, offsets are selected from the code.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import elias_fano
from corvane.llm.textkit import batches_of, by_text, lower_ascii, numbered_words, partitions, slices, strings, word_spans

#: Ids in a segment, beyond which the next one is begun.
SEGMENT_IDS = 2_000_000
#: Distinct words that a task keeps the ids of; beyond it they are encoded anew.
CACHE_WORDS = 500_000
_MAGIC = b"CVT1"
#: Magic, bytes of an id, documents with a null key, whether others follow, the least key.
_HEAD = "<4sBQBq"


#: How the tokenizers that WordCoder knows cut texts into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The first character after the Latin blocks that have small letters of one code each.
_LATIN = "\u0250"


def _plain(text: str) -> bool:
    """Whether a text is small letters of the Latin blocks, which no normal form changes."""
    return text.isalpha() and text == text.lower() and max(text) < _LATIN


#: Plain letters are 1, ASCII punctuation that the pattern never splits is 2, all else 0.
_KINDS = np.array([1 if _plain(chr(c)) else 2 if c < 0x80 and chr(c) in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~" else 0 for c in range(ord(_LATIN) + 1)], dtype=np.uint8)


def splits_at_spaces(tokenizer_json: str) -> bool:
    """Whether a tokenizer file drops case and white space, ends words with </w> and joins letters with nothing else, as WordCoder needs."""
    spec = json.loads(tokenizer_json)
    parts = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    model = spec.get("model", {})
    return parts == ["NFC", "Replace", "Lowercase"] and cuts[0].get("pattern") == {"Regex": WORD_PATTERN} and cuts[0].get("behavior") == "Removed" and cuts[-1].get("add_prefix_space") is False and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", []))


class WordCoder:
    """Ids of texts, word by word, kept for the texts of one task.

    Words of plain small letters and the punctuation after them are told apart
    for a whole slice at once; plain ones are encoded many at a time, as each
    ends with a token that marks an end.  A tokenizer that joins words, or
    keeps case or white space, is given whole texts instead.
    """

    def __init__(self, tokenizer_json: str, kind: str, by_word: bool, special: list[bytes], most: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.kind, self.by_word, self.special, self.most = Tokenizer.from_str(tokenizer_json), kind, by_word, special, most
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[at for token, at in vocabulary.items() if token.endswith("</w>")]] = True
        #: The same model for plain words between spaces, which need no normal form and no pattern.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[bytes, bytes] = {}

    def _many(self, texts: list[str]) -> list:
        return getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)(texts, add_special_tokens=False)

    def _singly(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 5000):
            part = words[at : at + 5000]
            for word, coded in zip(part, self._many([w.decode("utf-8", "replace") for w in part]), strict=True):
                self.known[word] = np.array(coded.ids, dtype=self.kind).tobytes()

    def _together(self, words: list[bytes]) -> None:
        """Words of plain small letters, each of which is one run for the tokenizer."""
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            ids = np.array(self.bare.encode(b" ".join(part).decode(), add_special_tokens=False).ids, dtype=self.kind)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                self._singly(part)
                continue
            raw, size = ids.tobytes(), ids.itemsize
            starts = np.concatenate(([0], ends[:-1])) * size
            self.known.update(zip(part, [raw[a:b] for a, b in zip(starts.tolist(), (ends * size).tolist(), strict=True)], strict=True))

    def _learn(self, words: list[bytes]) -> None:
        """Encodes new words; those that aren't plain as they are, but for capitals of the Latin blocks."""
        plain, rest = [], {}
        for word in words:
            if word.isascii() and word.isalpha():
                plain.append(word)
            elif _plain(text := word.decode("utf-8", "replace")):
                plain.append(word)
            else:
                rest[word] = (text.lower() if text and max(text) < _LATIN else text).encode()
        self._together(plain)
        new = set(rest.values()) - self.known.keys()
        plain = [t for t in new if _plain(t.decode())]
        self._together(plain)
        self._singly(list(new.difference(plain)))
        self.known.update((w, self.known[t]) for w, t in rest.items())

    @staticmethod
    def pieces(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and word number of the parts of words: plain letters are cut off from the punctuation that ends a word."""
        starts, ends, numbers = ends[:-1], ends[1:], np.arange(len(ends) - 1)
        places = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of each character
        codes = data.astype(np.uint32) if len(places) == len(data) else np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        kinds = _KINDS[np.minimum(codes, len(_KINDS) - 1)]
        letters, after = (np.concatenate(([0], np.cumsum(kinds == kind, dtype=np.int32))) for kind in (1, 2))
        places = np.append(places, len(data))
        first, last = np.searchsorted(places, starts), np.searchsorted(places, ends)
        n = letters[last] - letters[first]
        cut = (n > 0) & (n < last - first) & (n + after[last] - after[first] == last - first) & (letters[first + n] - letters[first] == n)
        at = np.arange(len(starts)) + np.cumsum(cut) - cut
        out = [np.empty(len(starts) + int(cut.sum()), dtype=np.int64) for _ in range(3)]
        middle = np.where(cut, places[first + n], ends)
        for array, values in zip(out, (starts, middle, numbers), strict=True):
            array[at] = values
        for array, values in zip(out, (middle, ends, numbers), strict=True):
            array[at[cut] + 1] = values[cut]
        return out[0], out[1], out[2]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each text of a buffer; each distinct word is looked up once."""
        count, raw = len(offsets) - 1, data.tobytes()
        whole = lambda i: raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")
        pack = lambda coded: np.array(coded.ids, dtype=self.kind).tobytes()
        if not self.by_word:
            return [pack(x) for x in self._many([whole(i) for i in range(count)])]
        named = [t for t in self.special if t in raw]
        special = [i for i in range(count) if any(raw.find(t, offsets[i], offsets[i + 1]) >= 0 for t in named)] if named else []
        data = lower_ascii(data)
        starts, ends, numbers = word_spans(data, offsets)
        out = [b""] * count
        if len(starts):
            values, which = numbered_words(data, starts, ends)
            ids = self._word_ids(values).take(pa.array(which))
            cuts = _ends(ids)[by_text(numbers, count)].tolist()
            ids = ids.buffers()[2].to_pybytes()
            out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in special:
            out[i] = pack(self.tokenizer.encode(whole(i), add_special_tokens=False))
        return out

    def _word_ids(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words, from those of their parts."""
        places, data = _ends(words), np.frombuffer(words.buffers()[2], dtype=np.uint8)
        starts, ends, numbers = self.pieces(data, places)
        values, which = numbered_words(data, starts, ends)
        parts = strings(values)
        if len(self.known) + len(parts) > self.most:
            self.known = {}
        self._learn([p for p in parts if p not in self.known])
        flat = pa.array([self.known[p] for p in parts], pa.large_binary()).take(pa.array(which))
        cuts = _ends(flat)[by_text(numbers, len(words))]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(cuts.tobytes()), flat.buffers()[2]])


def _ends(values: pa.Array) -> np.ndarray:
    """The n + 1 places of a large_binary array's values."""
    return np.frombuffer(values.buffers()[1], dtype=np.int64)[: len(values) + 1]


def pack_segment(keys: list[int | None], ends: np.ndarray, ids: bytes, width: int) -> bytes:
    """The bytes of a segment: keys rise, nulls first; ends are those of each document's ids."""
    nulls = sum(k is None for k in keys)
    rest = np.array(keys[nulls:], dtype=np.int64)
    least = int(rest[0]) if len(rest) else 0
    spread = (rest.view(np.uint64) - np.int64(least).view(np.uint64)).astype(np.uint64)
    return struct.pack(_HEAD, _MAGIC, width, nulls, bool(len(rest)), least) + elias_fano.encode(spread) + elias_fano.encode(ends) + ids


class Segment:
    """Reads the bytes of a segment."""

    def __init__(self, data: bytes):
        magic, self.width, self.nulls, _, self.least = struct.unpack_from(_HEAD, data)
        if magic != _MAGIC:
            raise ValueError("not a segment of token ids")
        self.coded_keys = elias_fano.EliasFano(data, struct.calcsize(_HEAD))
        self.ends = elias_fano.EliasFano(data, self.coded_keys.end)
        self.ids = np.frombuffer(data, dtype=f"<u{self.width}", offset=self.ends.end)

    def __len__(self) -> int:
        return len(self.ends)

    def keys(self, start: int = 0, stop: int | None = None) -> list[int | None]:
        """The keys of documents start to stop."""
        stop = len(self) if stop is None else stop
        found = self.coded_keys.selected(max(0, start - self.nulls), max(0, stop - self.nulls)) + np.int64(self.least).view(np.uint64)
        return [None] * (min(stop, self.nulls) - min(start, self.nulls)) + found.view(np.int64).tolist()

    def document(self, number: int) -> np.ndarray:
        """The ids of one document, by two selections."""
        return self.ids[self.ends.select(number - 1) if number else 0 : self.ends.select(number)]


def _segments(tokenizer_json: str, end_id: int, width: int, most: int):
    by_word, special = splits_at_spaces(tokenizer_json), [t["content"].encode() for t in json.loads(tokenizer_json).get("added_tokens", [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = f"<u{width}"
        coder, last = WordCoder(tokenizer_json, kind, by_word, special), np.array([end_id], dtype=kind).tobytes()
        part, number, start = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        parts: list[bytes] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, parts, total, number, start
            ends = np.cumsum([len(x) // width for x in parts], dtype=np.int64)
            row = [part, number, start, len(keys), int(ends[-1]), pack_segment(keys, ends, b"".join(parts), width)]
            number, start, keys, parts, total = number + 1, start + int(ends[-1]), [], [], 0
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["part", "number", "start", "n_docs", "n_ids", "segment"])

        for rows, data, offsets in slices(batches):
            for key, ids in zip(rows.column(0).to_pylist(), coder.encode(data, offsets), strict=True):
                keys.append(key)
                parts.append(ids + last)
                total += len(ids) // width + 1
                if total >= most:
                    yield flush()
        if keys:
            yield flush()

    return run


def write_token_ids(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int, key: str = "doc_id", text: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Writes the ids of all documents, in ascending order of an integer key, as segments under path.

    Each document's ids are followed by end_id.  A null text counts as empty;
    null keys come first; rows that repeat a key are ordered by their texts; an
    empty table makes an empty file set.  Other columns are not read.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    from tokenizers import Tokenizer

    width = 2 if max(end_id + 1, Tokenizer.from_str(tokenizer_json).get_vocab_size()) <= 1 << 16 else 4
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), "id").sortWithinPartitions("id", "text")
    schema = "part int, number int, start bigint, n_docs bigint, n_ids bigint, segment binary"
    batches_of(dealt, _segments(tokenizer_json, end_id, width, segment_ids), schema).write.option("compression", "zstd").parquet(path)


def _documents(before: dict[int, int], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, data in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", "start", "segment")), strict=True):
                segment = Segment(data)
                for first in range(0, len(segment), elias_fano.SAMPLE):
                    after = min(first + elias_fano.SAMPLE, len(segment))
                    begin = segment.ends.select(first - 1) if first else 0
                    ends = segment.ends.selected(first, after).astype(np.int64) - begin
                    starts = np.concatenate(([0], ends[:-1]))
                    ids = segment.ids[begin : begin + int(ends[-1])]
                    wide = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
                    crcs = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    columns = [pa.array(segment.keys(first, after), pa.int64()), pa.array(starts + before[part] + start + begin), pa.array(ends - starts), pa.array(crcs, pa.int64())]
                    names = ["id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.LargeListArray.from_arrays(np.append(starts, ends[-1]), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read_token_ids(spark: SparkSession, path: str, *, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row for each document of a file set: key, start, n_tokens, ids_crc32 and ids (if with_ids).

    start counts the ids of all documents before it.  Only the sizes of the
    parts, one for each task that wrote, pass through the driver.
    """
    files = spark.read.schema("part int, number int, start bigint, n_docs bigint, n_ids bigint, segment binary").parquet(path)
    sizes = {r.part: r.n for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]
    schema = "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return batches_of(files.select("part", "start", "segment"), _documents(before, with_ids), schema).withColumnRenamed("id", key)

