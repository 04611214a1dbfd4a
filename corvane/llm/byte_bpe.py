"""Byte-level BPE by recursive DuckDB queries, one database for each Spark task.

Texts are cut at the matches of the tokenizer's pattern.  The distinct words of
a task go to recursive queries: rows of word and token position are joined with
the merge table, and in each step every word contracts its leftmost pair of
least rank, until none is left.  Ordered aggregation over the token rows decodes
the ids of every word.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from corvane.llm.textkit import batches_of, by_text, distinct, slices, strings

#: Distinct words that a task keeps between batches; beyond it they are worked out anew.
CACHE_WORDS = 500_000
#: Bytes of text in a slice, and distinct words in one recursive query, at most.
SLICE_BYTES, QUERY_WORDS = 8 << 20, 60_000
#: Words of so many bytes take a query that contracts equal pairs of a word together where that gives the same ids.
LONG_WORD = 64
#: The pattern whose matches are found for all characters of a slice at once; others go through the regex library.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# A word is done, and leaves the recursion, in the step that finds no pair of it in the merge table.
_STEPS = """
WITH RECURSIVE steps(word, ids, done) AS (
    SELECT word, ids, false FROM words
    UNION ALL
    SELECT s.word, CASE WHEN b.word IS NULL THEN s.ids ELSE list_concat(s.ids[:b.place - 1], [b.rank], s.ids[b.place + 2:]) END, b.word IS NULL
    FROM (FROM steps WHERE NOT done) s LEFT JOIN (
        SELECT word, (least & 4294967295)::INTEGER AS place, (least >> 32)::INTEGER AS rank FROM (
            SELECT p.word, min((m.rank::BIGINT << 32) | p.place) AS least
            FROM (SELECT word, unnest(ids[:-2]) AS l, unnest(ids[2:]) AS r, unnest(range(1, len(ids))) AS place FROM steps WHERE NOT done) p
            JOIN merges m ON m.pair = ((p.l::BIGINT << 32) | p.r)
            GROUP BY p.word)) b ON s.word = b.word)
SELECT word, ids FROM steps WHERE done ORDER BY word
"""

# Equal pairs of least rank are contracted together, from the left, if their token is calm: if no pair
# that it is part of has a lower rank, so that none of them would be overtaken.  Of others the first one is.
_LONG_STEPS = """
WITH RECURSIVE steps(word, ids) USING KEY (word) AS (
    SELECT word, ids FROM words
    UNION
    (WITH ranked AS (
        SELECT p.word, p.place, m.rank, m.calm
        FROM (SELECT word, unnest(ids[:-2]) AS l, unnest(ids[2:]) AS r, unnest(range(1, len(ids))) AS place FROM steps) p
        JOIN merges m ON m.pair = ((p.l::BIGINT << 32) | p.r)),
    least AS (SELECT r.word, r.place, r.rank, r.calm FROM ranked r JOIN (SELECT word, min(rank) AS rank FROM ranked GROUP BY word) b USING (word, rank)),
    runs AS (SELECT *, place - row_number() OVER (PARTITION BY word ORDER BY place) AS run, row_number() OVER (PARTITION BY word ORDER BY place) AS n FROM least),
    hits AS (SELECT word, place, rank, calm, n FROM runs QUALIFY (row_number() OVER (PARTITION BY word, run ORDER BY place)) % 2 = 1),
    chosen AS (SELECT word, rank, list(place ORDER BY place) AS places FROM hits WHERE calm OR n = 1 GROUP BY word, rank)
    SELECT s.word, list_concat(flatten(list_transform(range(1, len(c.places) + 1), lambda i: list_append(s.ids[CASE WHEN i = 1 THEN 1 ELSE c.places[i - 1] + 2 END : c.places[i] - 1], c.rank))), s.ids[c.places[len(c.places)] + 2:])
    FROM steps s JOIN chosen c ON s.word = c.word))
SELECT word, ids FROM steps ORDER BY word
"""

# The bytes of all words' ids, one word after another.
_DECODE = """
SELECT string_agg(v.hex, '' ORDER BY t.word, t.place)
FROM (SELECT word, unnest(ids) AS id, unnest(range(len(ids))) AS place FROM coded) t JOIN tokens v ON v.id = t.id
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """The pairs of tokens that make a token: both ranks in one number, the token's rank, and whether it is calm."""
    rows = [(ranks[token[:i]], ranks[token[i:]], rank) for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    left, right, rank = np.array(rows, dtype=np.int64).reshape(-1, 3).T
    lowest = np.full(max(ranks.values(), default=0) + 1, np.iinfo(np.int64).max)
    for side in (left, right):
        np.minimum.at(lowest, side, rank)
    return pa.table({"pair": (left << 32) | right, "rank": rank.astype(np.int32), "calm": lowest[rank] > rank})


class Coder:
    """Encodes and decodes words with a private DuckDB database."""

    def __init__(self, ranks: dict[bytes, int], merges: pa.Table, memory: str = "256MB"):
        import duckdb

        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.sizes[list(ranks.values())] = [len(t) for t in ranks]
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": memory})
        self._create("merges", merges)
        self._create("tokens", pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": pa.array([t.hex() for t in ranks])}))

    def _create(self, name: str, table: pa.Table) -> None:
        self.con.register("given", table)
        self.con.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS FROM given")
        self.con.unregister("given")

    def _encoded(self, words: list[bytes], query: str) -> pa.ChunkedArray:
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum([0] + [len(w) for w in words])
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(self.byte_ids[text]))
        self._create("words", pa.table({"word": pa.array(np.arange(len(words), dtype=np.int32)), "ids": ids}))
        return self.con.sql(query).to_arrow_table()["ids"]

    def code(self, words: list[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """For each word its ids, packed as little-endian unsigned 32-bit numbers, and the bytes that these decode to."""
        out: dict = {}
        whole = [w for w in words if w in self.ranks]
        rest = [w for w in words if w not in self.ranks]
        tokens = pa.chunked_array([pa.ListArray.from_arrays(pa.array(range(len(whole) + 1), pa.int32()), pa.array([self.ranks[w] for w in whole], pa.int32()))])
        out.update(zip(whole, self._packed(tokens), strict=True))
        for query, part in ((_STEPS, [w for w in rest if len(w) < LONG_WORD]), (_LONG_STEPS, [w for w in rest if len(w) >= LONG_WORD])):
            for at in range(0, len(part), QUERY_WORDS):
                own = part[at : at + QUERY_WORDS]
                out.update(zip(own, self._packed(self._encoded(own, query)), strict=True))
        return out

    def _packed(self, ids: pa.ChunkedArray) -> Iterator[tuple[bytes, bytes]]:
        self._create("coded", pa.table({"word": pa.array(np.arange(len(ids), dtype=np.int32)), "ids": ids}))
        back = bytes.fromhex(self.con.sql(_DECODE).fetchall()[0][0] or "")
        ids = ids.combine_chunks()
        flat, ends = ids.flatten().to_numpy(), np.cumsum(np.append(0, pc.list_value_length(ids).to_numpy()))
        raw, cuts = flat.astype("<u4").tobytes(), np.append(0, np.cumsum(self.sizes[flat]))[ends].tolist()
        ends = (4 * ends).tolist()
        return ((raw[a:b], back[c:d]) for a, b, c, d in zip(ends[:-1], ends[1:], cuts[:-1], cuts[1:], strict=True))


_LETTER, _NUMBER, _SPACE, _OTHER, _NEW = 1, 2, 3, 0, 255


class Cutter:
    """Cuts the texts of a slice into words: the matches of a pattern, which together are the whole text."""

    def __init__(self, pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        self.quick = pattern == PATTERN
        self.kinds = np.full(0x110000, _NEW, dtype=np.uint8)
        self.classes = [(kind, regex.compile(own)) for kind, own in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s"))]

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where each word of the slice begins, in bytes."""
        if self.quick:
            return self._quick(data, offsets)
        raw, found = data.tobytes(), [np.zeros(0, np.int64)]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            sizes = [len(w.encode()) for w in self.pattern.findall(raw[a:b].decode())]
            if sum(sizes) != b - a:
                raise ValueError("the pattern's matches must cover every text")
            found.append(a + np.cumsum([0, *sizes])[:-1])
        return np.concatenate(found).astype(np.int64)

    def _kinds(self, codes: np.ndarray) -> np.ndarray:
        found = self.kinds[codes]
        if (found == _NEW).any():
            for code in np.unique(codes[found == _NEW]).tolist():
                self.kinds[code] = next((kind for kind, own in self.classes if own.match(chr(code))), _OTHER)
            found = self.kinds[codes]
        return found

    def _quick(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bytes_at = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of each character
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        n = len(codes)
        if not n:
            return bytes_at
        kinds = self._kinds(codes)
        edge = np.zeros(n + 1, dtype=bool)  # texts begin here
        edge[np.searchsorted(bytes_at, offsets)] = True
        edge[n] = True
        space = kinds == _SPACE
        before = np.concatenate(([_OTHER], kinds[:-1]))
        last = np.concatenate((space[:-1] & ~space[1:] & ~edge[1:-1], [False]))  # of white space before a word
        joined = np.concatenate(([False], (last & (codes == 0x20))[:-1]))  # a word takes the space before it
        first = ((kinds != before) & ~joined) | last
        first |= edge[:-1]
        self._contractions(codes, kinds, edge, first)
        return bytes_at[np.flatnonzero(first)]

    @staticmethod
    def _contractions(codes: np.ndarray, kinds: np.ndarray, edge: np.ndarray, first: np.ndarray) -> None:
        """Moves the starts of words around 's 't 're 've 'm 'll 'd."""
        at = np.flatnonzero((codes[:-1] == 0x27) & first[:-1] & ~edge[1:-1])
        one = at[np.isin(codes[at + 1], [ord(c) for c in "stmd"])]
        at = at[at + 2 < len(codes)]
        at = at[~edge[at + 2]]
        pair = (codes[at + 1].astype(np.int64) << 16) | codes[at + 2]
        two = at[np.isin(pair, [(ord(a) << 16) | ord(b) for a, b in ("re", "ve", "ll")])]
        for found, size in ((one, 2), (two, 3)):
            first[found + 1] = False
            after = found + size
            after = after[after < len(codes)]
            # A space that the word after takes along, or a run of one kind that the match has cut, begins anew.
            first[after] = True


class Words:
    """Ids and decoded bytes of words, kept for the texts of one task."""

    def __init__(self, coder: Coder, cutter: Cutter, most: int = CACHE_WORDS):
        self.coder, self.cutter, self.most = coder, cutter, most
        self.known: dict[bytes, tuple[bytes, bytes]] = {}

    def code(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """The packed ids and the decoded bytes of each text of a buffer; each distinct word is looked up once."""
        starts = self.cutter.starts(data, offsets)
        values, which = distinct(data, np.append(starts, len(data)))
        words = strings(values)
        if len(self.known) + len(words) > self.most:
            self.known = {}
        self.known.update(self.coder.code([w for w in words if w not in self.known]))
        coded = [self.known[w] for w in words]
        cuts = np.searchsorted(starts, offsets)
        out = []
        for side in (0, 1):
            flat = pa.array([x[side] for x in coded], pa.large_binary()).take(pa.array(which)) if len(which) else pa.array([], pa.large_binary())
            ends = np.frombuffer(flat.buffers()[1], dtype=np.int64)[: len(flat) + 1][cuts] if len(which) else np.zeros(len(cuts), np.int64)
            raw = flat.buffers()[2].to_pybytes() if len(which) else b""
            out.append([raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
        return out[0], out[1]


def _rows(ranks: dict[bytes, int], merges: bytes, pattern: str, with_ids: bool, with_decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for rows, data, offsets in slices(batches, most=SLICE_BYTES):
            words = words or Words(Coder(ranks, pa.ipc.open_stream(merges).read_all()), Cutter(pattern))
            ids, back = words.code(data, offsets)
            columns = [rows.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in back])]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            if with_decoded:
                columns.append(pa.array(back, pa.binary()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def byte_bpe(docs: DataFrame, ranks_path: str, pattern: str, *, key: str = "doc_id", text: str = "text", with_ids: bool = True, with_decoded: bool = False) -> DataFrame:
    """One row for each document: key, n_tokens, ids_sha256, decoded_sha256, and ids and decoded bytes (where asked for).

    Each match of the pattern is encoded by itself with the ranks of the file,
    without special tokens; the ids are then decoded.  The matches must cover
    every text, else the job fails.  A null text counts as empty and has no ids;
    repeated rows get a row each, as do null keys; an empty table gives none;
    other columns are not read, so that their names can't clash.
    """
    kind = dict(docs.dtypes)[key]
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded binary" * with_decoded
    rows = docs.select(docs[key].alias("id"), docs[text].alias("text"))
    ranks = read_ranks(ranks_path)
    return batches_of(rows, _rows(ranks, _stream(merge_table(ranks)), pattern, with_ids, with_decoded), schema).withColumnRenamed("id", key)
