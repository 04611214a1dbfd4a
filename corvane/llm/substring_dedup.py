"""Substring dedup by repeated-phrase automata.

A window is so many consecutive words of a document.  Each window names one of
its phrases (shorter runs of words) by the least hash, so equal windows name
equal phrases, and neighbouring windows mostly the same one; the words that a
run of such windows covers are a passage.

1. Every document yields digests of the phrases it names and of the passages
   around them.  Phrases that two documents name are confirmed; of their
   passages, those that an earlier document has are repeated as a whole.
2. The first document of each confirmed passage tells its phrase, as text, and
   the passage's measures.  Where a phrase stands in several passages, it tells
   the passage's windows too, which are compared one by one over all documents.
3. Documents are dealt out with the confirmed phrases that concern them.  Each
   shard of documents compiles these phrases into an Aho-Corasick automaton and
   streams all its texts through it.  A hit places a passage, whose digest is
   then compared.

What the automaton doesn't find is not removed: there is no other way from a
confirmed phrase to its place in a text.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.textkit import batches_of, by_text, checkpointed, joined, run_hashes, slices, word_hashes, word_spans

WINDOW = 50
PHRASE = 8
#: A key that very many documents share is dealt over so many tasks.
SALTS = 16


class Texts:
    """The words of a slice of texts, joined by single spaces."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.count = data, len(offsets) - 1
        self.starts, self.ends, self.numbers = word_spans(data, offsets)
        text, self.places = joined(data, self.starts, self.ends)
        self.stops = self.places + (self.ends - self.starts)
        self.raw = text.tobytes()
        self.edges = by_text(self.numbers, self.count)

    def words(self, start: int, stop: int) -> bytes:
        return self.raw[self.places[start] : self.stops[stop - 1]]


def _digests(texts: Texts, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """128-bit digests (two signed numbers each) of ranges of words."""
    from xxhash import xxh3_128_digest

    raw = texts.raw
    found = b"".join([xxh3_128_digest(raw[a:b]) for a, b in zip(texts.places[starts].tolist(), texts.stops[stops - 1].tolist(), strict=True)])
    return np.frombuffer(found, dtype="<i8").reshape(-1, 2)


def passages(texts: Texts, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and the place of the named phrase, in words, of each passage of the texts."""
    nothing = np.zeros(0, dtype=np.int64)
    n = len(texts.starts)
    if n < window:
        return nothing, nothing, nothing
    order = run_hashes(word_hashes(texts.data, texts.starts, texts.ends), phrase)
    least, width, wanted = order, 1, window - phrase + 1
    while width * 2 <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wanted:
        least = np.minimum(least[: width - wanted], least[wanted - width :])
    at = np.arange(n - window + 1)
    windows = at[texts.numbers[: len(at)] == texts.numbers[window - 1 :]]
    if not len(windows):
        return nothing, nothing, nothing
    named = least[windows]
    change = np.flatnonzero((named[1:] != named[:-1]) | (windows[1:] != windows[:-1] + 1) | (texts.numbers[windows[1:]] != texts.numbers[windows[:-1]])) + 1
    heads = np.concatenate(([0], change))
    first, last, named = windows[heads], windows[np.append(change, len(windows)) - 1], named[heads]
    place, left = np.empty(len(first), dtype=np.int64), np.arange(len(first))
    for step in range(wanted):
        hit = order[first[left] + step] == named[left]
        place[left[hit]] = first[left[hit]] + step
        left = left[~hit]
    return first, last + window, place


def _columns(*digests: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(d[:, i])) for d in digests for i in (0, 1)]


def _phrase_rows(window: int, phrase: int):
    """Digests of the phrases that each text names and of their passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            texts = Texts(data, offsets)
            start, stop, place = passages(texts, window, phrase)
            owners = rows.column(0).take(pa.array(texts.numbers[start]))
            columns = _columns(_digests(texts, place, place + phrase), _digests(texts, start, stop))
            yield pa.RecordBatch.from_arrays([owners, *columns[:3]], names=["id", "h1", "h2", "p"])

    return run


def located(texts: Texts, spots: dict[tuple[int, str], list[tuple]], phrase: int) -> Iterator[tuple[int, int, bool]]:
    """(start, stop, whole) of each passage that the automaton places and whose digest agrees.

    spots has, for a text number and a phrase, (p1, p2, before, length, whole)
    of the passages around it.  The automaton is compiled from the phrases and
    run once over all the texts.
    """
    import ahocorasick

    automaton = ahocorasick.Automaton()
    named = sorted({p for _, p in spots})
    for at, own in enumerate(named):
        automaton.add_word(f" {own} ".encode().decode("latin-1"), at)
    if not named:
        return
    automaton.make_automaton()
    stream = (b" " + texts.raw).decode("latin-1")  # one character a byte: places are bytes
    hits = np.fromiter((x for pair in automaton.iter(stream) for x in pair), dtype=np.int64).reshape(-1, 2)
    last = np.searchsorted(texts.stops, hits[:, 0] - 1)
    first = last - phrase + 1
    within = texts.numbers[first] == texts.numbers[last]
    hits, first = hits[within], first[within]
    numbers = texts.numbers[first]
    for number, place, at in zip(numbers.tolist(), first.tolist(), hits[:, 1].tolist(), strict=True):
        for p1, p2, before, length, whole in spots.get((number, named[at]), ()):
            start = place - before
            if start >= texts.edges[number] and start + length <= texts.edges[number + 1]:
                found = _digests(texts, np.array([start]), np.array([start + length]))[0]
                if found[0] == p1 and found[1] == p2:
                    yield start, start + length, whole


def _spots(column: pa.Array) -> dict[tuple[int, str], list[tuple]]:
    """The lists of a slice's rows by text number and phrase."""
    out: dict[tuple[int, str], list[tuple]] = defaultdict(list)
    for number, own in enumerate(column.to_pylist()):
        for s in own or ():
            out[number, s["phrase"]].append((s["p"], s["p2"], s["before"], s["length"], s["whole"]))
    return out


def _told(window: int, phrase: int, windows: bool):
    """What the first documents of passages tell: each passage's phrase and measures, or the digests of windows to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = (b.filter(pc.is_valid(b.column(b.schema.get_field_index("owned")))) for b in batches)
        for rows, data, offsets in slices(some):
            texts = Texts(data, offsets)
            start, stop, place = passages(texts, window, phrase)
            own = {(n, o["h1"], o["p"]): o["several"] for n, owned in enumerate(rows.column(rows.schema.get_field_index("owned")).to_pylist()) for o in owned}
            digests = _digests(texts, start, stop).tolist()
            heads = _digests(texts, place, place + phrase)[:, 0].tolist()
            found = [own.get((n, h, d[0])) for n, h, d in zip(texts.numbers[start].tolist(), heads, digests, strict=True)]
            if windows:
                runs = [np.arange(a, b - window + 1) for a, b, several in zip(start.tolist(), stop.tolist(), found, strict=True) if several]
                at = np.unique(np.concatenate(runs)) if runs else np.zeros(0, dtype=np.int64)
                w1, w2 = _columns(_digests(texts, at, at + window))
                table = pa.table({"n": texts.numbers[at], "w1": w1, "w2": w2}).group_by(["n", "w1", "w2"]).aggregate([]).combine_chunks()
                yield from pa.table({"id": rows.column(0).take(table["n"]), "w1": table["w1"], "w2": table["w2"]}).to_batches()
                continue
            told: dict[tuple, tuple] = {}
            for a, b, p, h, d, several in zip(start.tolist(), stop.tolist(), place.tolist(), heads, digests, found, strict=True):
                if several is not None:
                    told[h, d[0]] = (h, *d, texts.words(p, p + phrase).decode(), p - a, b - a)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in told.values()], kind) for i, kind in enumerate(kinds)], names=["h1", "p", "p2", "phrase", "before", "length"])

    return run


def without(data: np.ndarray, offsets: np.ndarray, own: Texts, gone: np.ndarray) -> pa.Array:
    """The texts without the words that are gone, each with the white space after it."""
    follow = np.append(own.starts[1:], len(data))
    follow = np.minimum(follow, offsets[1:][own.numbers]) if len(follow) == len(own.numbers) else follow[:0]
    edge = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(edge, own.starts[gone], 1)
    np.add.at(edge, follow[gone], -1)
    kept = np.cumsum(edge[:-1]) == 0
    left = np.concatenate(([0], np.cumsum(kept)))[offsets]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(left.astype(np.int64).tobytes()), pa.py_buffer(data[kept].tobytes())).cast(pa.string())


def _removals(window: int, phrase: int, carried: list[str], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            count = rows.num_rows
            field = lambda name: rows.column(rows.schema.get_field_index(name))  # noqa: E731, B023
            texts = Texts(data, offsets)
            known = {(n, w["w1"], w["w2"]) for n, own in enumerate(field("windows").to_pylist()) for w in own or ()}
            lost = np.zeros(len(texts.starts) + 1, dtype=np.int64)
            for start, stop, whole in located(texts, _spots(field("spots")), phrase):
                if whole:
                    lost[start] += 1
                    lost[stop] -= 1
                elif known:
                    at = np.arange(start, stop - window + 1)
                    number = int(texts.numbers[start])
                    for place, (w1, w2) in zip(at.tolist(), _digests(texts, at, at + window).tolist(), strict=True):
                        if (number, w1, w2) in known:
                            lost[place] += 1
                            lost[place + window] -= 1
            gone = np.cumsum(lost[:-1]) > 0
            n_words = np.bincount(texts.numbers, minlength=count)
            n_removed = np.bincount(texts.numbers[gone], minlength=count)
            text, places = joined(data, texts.starts[~gone], texts.ends[~gone])
            edges = by_text(texts.numbers[~gone], count)
            places = np.append(places, len(text))
            raw = memoryview(text)
            kept = [hashlib.sha256(raw[places[a] : max(places[a], places[b] - 1)]).hexdigest() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            columns = [field("id"), pa.array(n_words.astype(np.int64)), pa.array(n_removed.astype(np.int64)), pa.array(kept)] + [field(f"_{c}") for c in carried]
            names = ["id", "n_words", "n_removed", "kept_sha256", *[f"_{c}" for c in carried]]
            if with_text:
                columns.append(without(data, offsets, texts, gone))
                names.append("_clean_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def with_bounds(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows with the least (low_) and the greatest (high_) of each value for their key; only keys with two different ids are returned.

    The bounds are pre-aggregated before they are shuffled.  To be joined with
    the rows they are repeated for those of SALTS salts, taken from the ids,
    that the key's rows have: a key of very many rows fills no task.  rows has
    no other columns than id, keys and values, and the join's own filters stand in
    both branches, so that one shuffle serves both.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).where(" and ".join(f"{c} is not null" for c in [*keys, "salt"])).repartition(*keys, "salt")
    bounds = salted.groupBy(*keys).agg(*[f(v).alias(f"{name}_{v}") for v in values for f, name in ((F.min, "low"), (F.max, "high"))], F.bit_or(F.expr("shiftleft(1, salt)")).alias("salts")).where("low_id < high_id")
    dealt = bounds.withColumn("salt", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.col("salts").bitwiseAND(F.call_function("shiftleft", F.lit(1), s)) != 0))).drop("salts")
    return salted.join(dealt, [*keys, "salt"]).drop("salt")


def substring_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, phrase: int = PHRASE, carry: tuple[str, ...] = (), with_text: bool = True) -> DataFrame:
    """One row for each document: key, n_words, n_removed, kept_sha256, columns to carry, and clean_text (if with_text).

    A word is removed if it lies in a window whose words also start in a
    document with a smaller key; the first document keeps it.  clean_text is the
    text without these words and the white space after each; kept_sha256 is that
    of the kept words joined by one space.  A null or empty text has no words.  Rows with a null
    key lose nothing and take nothing from others; rows that repeat a key count
    as one document, and each gets its row.  An empty table gives none.  Other
    columns are not read; columns to carry may have any name but those returned.
    """
    kind = dict(docs.dtypes)[key]
    rows = docs.select(docs[key].alias("id"), docs[text].alias("text"))
    found = batches_of(rows.where("id is not null"), _phrase_rows(window, phrase), f"id {kind}, h1 bigint, h2 bigint, p bigint")
    named = checkpointed(with_bounds(found, ["h1", "h2"], ["id", "p"]).select("id", "h1", "p", (F.col("low_p") < F.col("high_p")).alias("several")))
    # A passage goes by the first half of its phrase's digest and of its own, 128 bits in all.
    owners = named.groupBy("h1", "p").agg(F.min("id").alias("id"), F.max("id").alias("high"), F.bool_or("several").alias("several")).where("several or id < high")
    later = with_bounds(named.select("id", "h1", "p"), ["h1", "p"], ["id"]).where("id > low_id").select("id", "h1", "p", F.lit(True).alias("whole"), F.lit(False).alias("several"))
    marks = checkpointed(later.unionByName(owners.select("id", "h1", "p", F.lit(False).alias("whole"), "several")))
    lists = marks.where(~F.col("whole")).groupBy("id").agg(F.collect_list(F.struct("h1", "p", "several")).alias("owned"))

    # The joins below deal out the same columns by the same key, without a filter
    # in between, so that Spark shuffles the texts once and reads them again.
    others = [c for c in carry if c not in (key, text)]
    whole = docs.select(docs[key].alias("id"), docs[text].alias("text"), *[docs[c].alias(f"_{c}") for c in others])
    first = whole.join(lists, "id", "left")
    windows = batches_of(first, _told(window, phrase, True), f"id {kind}, w1 bigint, w2 bigint")
    single = with_bounds(windows, ["w1", "w2"], ["id"]).where("id > low_id").groupBy("id").agg(F.collect_set(F.struct("w1", "w2")).alias("windows"))
    told = batches_of(first, _told(window, phrase, False), "h1 bigint, p bigint, p2 bigint, phrase string, before int, length int")
    spots = marks.where("whole or several").join(told, ["h1", "p"]).groupBy("id").agg(F.collect_set(F.struct("phrase", "p", "p2", "before", "length", "whole")).alias("spots"))
    dealt = whole.join(spots.join(single, "id", "left"), "id", "left")
    kinds = dict(docs.dtypes)
    schema = f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + "".join(f", `_{c}` {kinds[c]}" for c in others) + ", _clean_text string" * with_text
    found = batches_of(dealt, _removals(window, phrase, others, with_text), schema)
    return found.select(F.col("id").alias(key), "n_words", "n_removed", "kept_sha256", *[F.col(f"_{c}").alias(c) for c in others], *[F.col("_clean_text").alias("clean_text")] * with_text)
