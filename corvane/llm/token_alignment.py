"""Alignment of two tokenizers' tokens by merge-path partitioning.

The byte offsets where tokens of A and of B end are two rising lists over a
slice of documents.  Diagonals through their merge are found by binary search
and cut it into independent pieces of equal work.  A piece merges its part and
emits the overlaps of A and B tokens; groups end where both lists end a token,
and those that reach over a piece's end are stitched by the groups counted
before it.

An id pair's count is the number of documents that hold it linked.  Slices send
their distinct pairs, pre-aggregated; counts return to the slices that asked.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.textkit import batches_of, checkpointed, distinct, gathered

#: Bytes of text and documents in a slice, at most (a longer text is a slice alone).
SLICE_BYTES, SLICE_ROWS = 4 << 20, 50_000
#: Ends of both lists that a piece merges.
PIECE = 1 << 16
#: Bytes of distinct stretches that are encoded at once (a longer one alone).
ENCODED_BYTES = 1 << 16

_SPACE, _MARK = 0x20, "▁"


def _byte_characters() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable Latin-1 as itself, others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Ids to token bytes, as one buffer with offsets; ids beyond it or unknown have none."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens, one after another."""
        sizes = self.sizes[ids]
        return self.data[np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


class Tokenizers:
    """Both tokenizers of a task, and whether texts may be cut into stretches before they are encoded.

    A stretch starts at a space after a character that isn't white space.  A cut
    there changes no ids where A's pattern starts a match at it, and where no
    piece of B has a space after another character.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as file:
            kind = json.load(file)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        entries, letters = self.a.get_vocab(), _byte_characters()
        tokens = [b""] * (max(entries.values()) + 1)
        for token, number in entries.items():
            tokens[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes_a = Vocabulary(tokens)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)])
        pre = kind.get("pre_tokenizer") or {}
        whole = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not kind.get("normalizer")
        self.cuts = bool(whole and not any(_MARK in p.lstrip(_MARK) for p in pieces))

    def encode_a(self, text: str) -> list[int]:
        return self.a.encode(text, add_special_tokens=False).ids

    def encode_b(self, text: str) -> list[int]:
        """text starts with the space that B adds itself; a single one is that space alone."""
        return self.b.encode(text[1:]) if len(text) > 1 else [self.b.piece_to_id(_MARK)]


def stretch_starts(data: np.ndarray, places: np.ndarray, cuts: bool) -> np.ndarray:
    """Where stretches start in texts that lie one after another from places on, each with a space before it."""
    start = np.zeros(len(data), bool)
    start[places[:-1][places[:-1] < places[1:]]] = True
    if cuts and len(data) > 1:
        before = data[:-1]
        second, third = np.zeros_like(before), np.zeros_like(before)
        second[1:], third[2:] = before[:-1], before[:-2]
        closing = (before > 0x20) & (before != 0x7F)
        # Unicode's white space of two and three bytes; A's pattern may carry on over it.
        wide = ((second == 0xC2) & ((before == 0x85) | (before == 0xA0))) | ((third == 0xE1) & (second == 0x9A) & (before == 0x80)) | ((third == 0xE3) & (second == 0x80) & (before == 0x80))
        wide |= (third == 0xE2) & (((second == 0x80) & ((before <= 0x8A) | np.isin(before, (0xA8, 0xA9, 0xAF)))) | ((second == 0x81) & (before == 0x9F)))
        start[1:] |= (data[1:] == _SPACE) & closing & ~wide
    return np.flatnonzero(start)


def _ids(tools: Tokenizers, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of A and of B of some stretches, how many each has, and which stretches B gives back."""
    sizes = np.array([len(s) for s in stretches], np.int64)
    text, ends = b"".join(stretches), np.cumsum(sizes)
    good = np.ones(len(stretches), bool)
    if tools.cuts and all(s[-1] > 0x20 for s in stretches[:-1]):
        string = text.decode()
        a, b = np.array(tools.encode_a(string), np.int64), np.array(tools.encode_b(string), np.int64)
        back = tools.bytes_b.joined(b)
        if len(back) == len(text) and back.tobytes() == text and tools.bytes_a.sizes[a].sum() == len(text):
            counts = [np.diff(np.searchsorted(np.cumsum(v.sizes[ids]), np.concatenate(([0], ends)), side="right")) for v, ids in ((tools.bytes_a, a), (tools.bytes_b, b))]
            return a, counts[0], b, counts[1], good
    out_a, out_b = [], []
    for at, s in enumerate(stretches):
        string = s.decode()
        out_a.append(tools.encode_a(string))
        out_b.append(tools.encode_b(string))
        own = [v.joined(np.array(ids, np.int64)).tobytes() for v, ids in ((tools.bytes_a, out_a[-1]), (tools.bytes_b, out_b[-1]))]
        good[at] = own[0] == s and own[1] == s
        if not good[at]:
            out_a[-1], out_b[-1] = [], []
    flat = lambda lists: np.array([x for ids in lists for x in ids], np.int64)
    return flat(out_a), np.array([len(x) for x in out_a], np.int64), flat(out_b), np.array([len(x) for x in out_b], np.int64), good


def _alone(stretch: bytes) -> bool:
    """Whether a stretch is encoded by itself: it ends a text in white space, or has a mark that B takes for a space."""
    return stretch[-1] <= 0x20 or stretch[-1] == 0x7F or b"\xe2\x96\x81" in stretch or (stretch[-1] >= 0x80 and stretch.decode()[-1].isspace())


def _encoded(tools: Tokenizers, words: list[bytes]):
    """_ids of all distinct stretches, put together in blocks; the number of one is its place in words."""
    found, block, size = [], [], 0
    alone = [_alone(w) for w in words]
    order = sorted(range(len(words)), key=alone.__getitem__)
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    for i in order:
        if block and (alone[i] or size + len(words[i]) > ENCODED_BYTES):
            found.append(_ids(tools, block))
            block, size = [], 0
        block.append(words[i])
        size += len(words[i])
    if block:
        found.append(_ids(tools, block))
    a, count_a, b, count_b, good = (np.concatenate(x) for x in zip(*found, strict=True))
    return a, count_a, b, count_b, good, place


def _taken(ids: np.ndarray, counts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of stretches one after another, and how many each has."""
    starts, own = np.cumsum(counts) - counts, counts[which]
    return ids[np.repeat(starts[which] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))], own


def diagonals(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of a and of b lie before each cut of their merge into pieces of `piece` ends.

    All cuts are found together by binary search along their diagonals.  Of
    equal ends a's comes first, and a cut never parts them.
    """
    cuts = np.arange(0, len(a) + len(b), piece)
    low, high = np.maximum(0, cuts - len(b)), np.minimum(cuts, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        at = np.minimum(middle, len(a) - 1)
        ahead = open_ & (a[at] <= b[np.clip(cuts - middle - 1, 0, len(b) - 1)])
        low, high = np.where(ahead, middle + 1, low), np.where(open_ & ~ahead, middle, high)
    i, j = low, cuts - low
    split = (i > 0) & (j < len(b))
    j = j + (split & (a[np.maximum(i - 1, 0)] == b[np.minimum(j, len(b) - 1)]))
    return np.append(i, len(a)), np.append(j, len(b))


def piece_links(a: np.ndarray, b: np.ndarray, i: tuple[int, int], j: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one piece, independent of others: the A and the B token of each overlap, and whether both end with it."""
    own_a, own_b = a[i[0] : i[1]], b[j[0] : j[1]]
    merged = np.concatenate([own_a, own_b])
    merged.sort(kind="stable")
    ends = merged[np.concatenate(([True], merged[1:] != merged[:-1]))] if len(merged) else merged
    of_a, of_b = np.searchsorted(own_a, ends), np.searchsorted(own_b, ends)
    both = np.zeros(len(ends), bool)
    both[np.searchsorted(ends, np.intersect1d(own_a, own_b, assume_unique=True))] = True
    return of_a + i[0], of_b + j[0], both


def links(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A token, B token and group of every overlap of two lists with the same last end."""
    if not len(a):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    i, j = diagonals(a, b, piece)
    found, closed = [], 0
    for at in range(len(i) - 1):
        of_a, of_b, both = piece_links(a, b, (int(i[at]), int(i[at + 1])), (int(j[at]), int(j[at + 1])))
        # A group that the piece before has left open goes on with its number.
        found.append((of_a, of_b, closed + np.cumsum(both) - both))
        closed += int(both.sum())
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _numerals(count: int, ends: str) -> pa.Array:
    """The decimal numbers below count, once before each of some characters."""
    return pa.array([f"{n}{e}".encode() for e in ends for n in range(count)], pa.large_binary())


class _Writer:
    """The text form of groups: ids of a group's A tokens, |, those of its B tokens, ; between groups."""

    def __init__(self, tools: Tokenizers):
        self.size_a, self.size_b = len(tools.bytes_a.sizes), len(tools.bytes_b.sizes)
        self.strings = pa.concat_arrays([_numerals(self.size_a, ",|"), _numerals(self.size_b, ",;")])

    def forms(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, edges: np.ndarray) -> list[bytes]:
        """The form of each document, whose groups lie between edges."""
        last_a = np.append(group_a[1:] != group_a[:-1], True)[: len(a)]
        last_b = np.append(group_b[1:] != group_b[:-1], True)[: len(b)]
        groups = int(edges[-1])
        before_a, before_b = (np.concatenate(([0], np.cumsum(np.bincount(g, minlength=groups)))) for g in (group_a, group_b))
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + before_b[group_a]] = a + np.where(last_a, self.size_a, 0)
        codes[np.arange(len(b)) + before_a[group_b + 1]] = 2 * self.size_a + b + np.where(last_b, self.size_b, 0)
        text = self.strings.take(pa.array(codes))
        _, offsets, data = text.buffers()
        offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
        raw, at = memoryview(data) if data is not None else memoryview(b""), (before_a + before_b)[edges]
        return [bytes(raw[offsets[x] : offsets[y] - 1]) if y > x else b"" for x, y in zip(at[:-1], at[1:], strict=True)]


_COLUMNS = ["slice", "ids", "n_a", "n_b", "n_groups", "n_links", "digests", "forms", "pairs", "held", "payload"]
_KINDS = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
_SCHEMA = "slice bigint, ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, digests array<string>, forms array<string>, pairs array<bigint>, held array<bigint>, payload binary"


def _aligned(path_a: str, path_b: str, with_groups: bool):
    """For each slice its documents' figures, its distinct id pairs with the documents that hold each, and its links, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = writer = None
        part, number = TaskContext.get().partitionId(), 0
        for rows, data, offsets in gathered(batches, SLICE_BYTES, SLICE_ROWS):
            if tools is None:
                tools = Tokenizers(path_a, path_b)
                writer = _Writer(tools)
            values = _slice(tools, writer, data, offsets, with_groups)
            row = [(part << 32) | number, rows["id"].to_pylist(), *values]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _KINDS, strict=True)], names=_COLUMNS)
            number += 1

    return run


def _slice(tools: Tokenizers, writer: _Writer, data: np.ndarray, offsets: np.ndarray, with_groups: bool) -> list:
    count = len(offsets) - 1
    sizes = np.diff(offsets)
    spaced = np.where(sizes > 0, sizes + 1, 0)  # texts with the space before them; empty ones have none
    places = np.concatenate(([0], np.cumsum(spaced)))
    full = np.full(int(places[-1]), _SPACE, np.uint8)
    inner = np.ones(len(full), bool)
    inner[places[:-1][spaced > 0]] = False
    full[inner] = data
    starts = stretch_starts(full, places, tools.cuts)
    doc_of = np.searchsorted(places, starts, side="right") - 1
    good = spaced > 0
    if len(starts):
        words, which = distinct(full, np.concatenate((starts, [len(full)])))
        ids_a, count_a, ids_b, count_b, fine, place = _encoded(tools, words.to_pylist())
        which = place[which]
        good[doc_of[~fine[which]]] = False
        kept = good[doc_of]
        which, doc_of = which[kept], doc_of[kept]
    if not good.any():
        zero = [0] * count
        return [zero, zero, zero, zero, [""] * count, [""] * count if with_groups else None, [], [], b""]
    a, own_a = _taken(ids_a, count_a, which)
    b, own_b = _taken(ids_b, count_b, which)
    # Ends count the bytes of documents with tokens only; the last ones of both lists are equal in each document.
    ends_a, ends_b = np.cumsum(tools.bytes_a.sizes[a]), np.cumsum(tools.bytes_b.sizes[b])
    link_a, link_b, group = links(ends_a, ends_b)
    token_doc = np.repeat(doc_of, own_a)
    doc = token_doc[link_a]
    n_a, n_b, n_links = (np.bincount(x, minlength=count) for x in (token_doc, np.repeat(doc_of, own_b), doc))
    group_doc = doc[np.concatenate(([True], group[1:] != group[:-1]))]
    n_groups = np.bincount(group_doc, minlength=count)
    group_a, group_b = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
    group_a[link_a], group_b[link_b] = group, group
    forms = writer.forms(a, b, group_a, group_b, np.concatenate(([0], np.cumsum(n_groups))))
    digests = [hashlib.sha256(f).hexdigest() if g else "" for f, g in zip(forms, good.tolist(), strict=True)]
    keys, times = np.unique((a[link_a] * len(tools.bytes_b.sizes) + b[link_b]) * count + doc, return_counts=True)
    pair = keys // count
    heads = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    held = np.diff(np.append(heads, len(pair)))
    raw = np.concatenate([(keys % count).astype("<u4"), times.astype("<u4")]).tobytes()
    payload = struct.pack("<Q", len(raw)) + pa.Codec("zstd").compress(raw, asbytes=True)
    return [n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), digests, [f.decode() for f in forms] if with_groups else None, pair[heads], held, payload]


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Brings the counts of pairs to the documents of their slice."""
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            ids, n_a, n_b, n_groups, n_links, digests, forms = (one[c].flatten() for c in ("ids", "n_a", "n_b", "n_groups", "n_links", "digests", "forms"))
            best, total = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            found = one["found"].flatten()
            if len(found):
                order = np.argsort(found.field("pair").to_numpy(), kind="stable")
                counts, top = found.field("n").to_numpy()[order], found.field("top").to_numpy(zero_copy_only=False)[order]
                held = one["held"].flatten().to_numpy()
                data = one["payload"][0].as_py()
                raw = np.frombuffer(pa.Codec("zstd").decompress(data[8:], struct.unpack_from("<Q", data)[0], asbytes=True), "<u4").astype(np.int64)
                docs, times = raw[: len(raw) // 2], raw[len(raw) // 2 :]
                if len(held) != len(counts) or int(held.sum()) != len(docs):
                    raise RuntimeError("a slice's counts don't fit its pairs; was the input changed meanwhile?")
                counts, top = np.repeat(counts, held), np.repeat(top, held)
                np.add.at(total, docs, times * counts)
                np.add.at(best, docs, times * top)
            columns = [ids, n_a, n_b, n_groups, n_links, pa.array(best), pa.array(total), digests, forms if len(forms) else pa.nulls(len(ids), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"])


def token_alignment(docs: DataFrame, path_a: str, path_b: str, *, key: str = "doc_id", text: str = "text", with_groups: bool = True) -> DataFrame:
    """One row for each document: key (an integer), n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups.

    A is the byte-level tokenizer at path_a, applied to a space and the text; B
    the SentencePiece model at path_b, which adds that space itself.  A link is a
    pair of an A and a B token whose bytes overlap; its count is the number of
    documents that hold its ids linked, and n_best are those whose count is the
    highest of their A id, ties included.  groups writes out the ids between
    offsets where both end a token.

    A null or empty text has no tokens, nor has one whose tokens' bytes differ
    from it; their figures are 0 and groups_sha256 ''.  Repeated rows are
    documents of their own and get a row each, as do null keys; an empty table
    gives none; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cut = checkpointed(batches_of(rows, _aligned(path_a, path_b, with_groups), _SCHEMA))
    asked = cut.select("slice", F.explode(F.arrays_zip("pairs", "held")).alias("x")).select("slice", "x.pairs", "x.held").withColumnsRenamed({"pairs": "pair"})
    counts = checkpointed(asked.groupBy("pair").agg(F.sum("held").alias("n")))
    size_b = _pieces(path_b)
    # One row for each id of A: its vocabulary bounds what is broadcast.
    highest = counts.groupBy(F.expr(f"pair div {size_b}").alias("a")).agg(F.max("n").alias("most"))
    judged = counts.join(F.broadcast(highest), F.expr(f"pair div {size_b}") == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("top"))
    # A slice's pairs come back as one row, which its bytes of text bound.
    found = asked.join(judged, "pair").groupBy("slice").agg(F.collect_list(F.struct("pair", "n", "top")).alias("found"))
    dealt = cut.drop("pairs").join(found.withColumnRenamed("slice", "of"), F.col("slice") == F.col("of"), "left").drop("of")
    schema = "id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, groups string"
    out = dealt.mapInArrow(_figures, schema).withColumnRenamed("id", key)
    return out if with_groups else out.drop("groups")


def _pieces(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
