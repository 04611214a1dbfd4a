"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

Shingles of the item windows are ordered by how rare they are in the documents.
A window occurs only where all its shingles do, so its rarest one is a
necessary prefix: documents are joined on that alone, held to the bounds of
length and position, and verified word by word.  DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.textkit import checkpointed

WINDOW = 13
SHINGLE = 5
#: Item shingles up to this number are broadcast; beyond it they are shuffled.
BROADCAST_SHINGLES = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII other than 0-9 and a-z, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lower-cased (null: none)."""
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lower, BETWEEN), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")


def _shingle(words: str, at: str, size: int) -> Column:
    return F.xxhash64(*[F.get(F.col(words), F.col(at) + i) for i in range(size)])


def _shingles(frame: DataFrame, words: str, sizes: list[int], at: str = "at") -> DataFrame:
    """A row for each position and shingle size, with the shingle's hash."""
    kept = frame.columns
    rows = frame.select(*kept, F.explode(F.sequence(F.lit(0), F.size(words) - 1)).alias(at)) if words == "window" else frame.select(*kept, F.posexplode(words).alias(at, "_word"))
    if len(sizes) == 1:
        return rows.select(*kept, at, F.lit(sizes[0]).alias("size"), _shingle(words, at, sizes[0]).alias("token"))
    hashed = F.array(*[F.struct(F.lit(n).alias("size"), _shingle(words, at, n).alias("token")) for n in sizes])
    return rows.select(*kept, at, F.inline(hashed))


def item_windows(benchmark: DataFrame, *, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, window): the distinct windows of each item; a shorter item is one window."""
    words = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    return words.select("item", "words", F.explode(starts).alias("from")).select("item", F.slice("words", F.col("from") + 1, window).alias("window")).distinct()


def window_hits(docs: DataFrame, windows: DataFrame, *, window: int = WINDOW, shingle: int = SHINGLE, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """(id, copy, from, length, window_id) for each occurrence of a window in a document.

    docs has id, copy (a hash of the text) and words; windows has window_id and
    window, an array of words.
    """
    sizes = sorted({min(shingle, r[0]) for r in windows.select(F.size("window").alias("n")).distinct().collect()}) or [shingle]
    parts = _shingles(windows.select("window_id", "window"), "window", sizes).where((F.col("size") == F.least(F.lit(shingle), F.size("window"))) & (F.col("at") + F.col("size") <= F.size("window")))
    parts = parts.select("window_id", "window", "at", "token").withColumnRenamed("at", "offset")
    small = parts.count() <= broadcast_shingles
    sided = F.broadcast if small else (lambda frame: frame)

    found = _shingles(docs.select("words"), "words", sizes).select("token")
    counts = found.join(sided(parts.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    ranked = parts.join(counts, "token", "left").groupBy("window_id").agg(F.min(F.coalesce("n", F.lit(0))).alias("least"), F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("rarest"), F.first("window").alias("window"))
    prefixes = ranked.where("least > 0").select("window_id", "window", F.size("window").alias("length"), F.col("rarest.token").alias("token"), F.col("rarest.offset").alias("offset"))

    bounds = (F.col("at") >= F.col("offset")) & (F.col("at") - F.col("offset") + F.col("length") <= F.size("words"))
    equal = F.slice("words", F.col("at") - F.col("offset") + 1, F.col("length")) == F.col("window")
    hit = ["id", "copy", (F.col("at") - F.col("offset")).alias("from"), "length", "window_id"]
    if small:
        return _shingles(docs, "words", sizes).join(F.broadcast(prefixes), "token").where(bounds & equal).select(*hit)
    places = _shingles(docs, "words", sizes).select("id", "copy", "at", "token").join(prefixes.select("token", "offset", "length", "window_id"), "token").distinct()
    texts = docs.dropDuplicates(["id", "copy"])
    back = places.join(texts, places.id.eqNullSafe(texts.id) & (places.copy == texts.copy)).select(places.id, places.copy, "at", "token", "offset", "length", "window_id", "words")
    return back.where(bounds).join(prefixes.select("window_id", "window"), "window_id").where(equal).select(*hit)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, share: int = 20, carry: tuple[str, ...] = (), broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """One row for each document: key, columns to carry, n_words, n_hit, n_items, items, contaminated.

    n_hit counts the words inside any occurrence of an item's window; items are
    those with an occurring window, as sorted strings; contaminated if n_hit > 0
    and share * n_hit >= n_words.  A null or empty text has no words; an item
    without words, or with a null id or text, hits nothing.  Repeated rows get a
    row each; an empty table of documents gives none, an empty benchmark no
    hits.  Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("copy"), F.col(text).alias("text"))
    words = rows.select("id", "copy", words_of(F.col("text")).alias("words"))
    owned = item_windows(benchmark, item=item, text=item_text, window=window).where("item is not null").withColumn("window_id", F.sha2(F.array_join("window", " "), 256))
    hits = window_hits(words, owned.select("window_id", "window").distinct(), window=window, shingle=shingle, broadcast_shingles=broadcast_shingles)
    # Written once, as two branches below read it; it has rows for documents with hits only.
    by_doc = checkpointed(hits.groupBy("id", "copy").agg(F.sort_array(F.collect_set(F.struct("from", "length"))).alias("spans"), F.collect_set("window_id").alias("window_ids")))
    step = lambda acc, x: F.struct(F.greatest(acc["end"], x["from"] + x["length"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["from"] + x["length"] - F.greatest(acc["end"], x["from"]))).alias("n"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step)["n"].cast("long")
    named = by_doc.select("id", "copy", F.explode("window_ids").alias("window_id")).join(owned.select("window_id", "item"), "window_id").groupBy("id", "copy").agg(F.sort_array(F.collect_set("item")).alias("items"))
    counted = by_doc.select("id", "copy", covered.alias("n_hit"))
    found = counted.join(named, counted.id.eqNullSafe(named.id) & (counted.copy == named.copy)).select(counted.id.alias("id_"), counted.copy.alias("copy_"), "n_hit", "items")
    others = [c for c in carry if c != key]
    all_rows = docs.select(F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("copy"), word_count(F.col(text)).alias("n_words"), *[F.col(c).alias(f"_{c}") for c in others])
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return all_rows.join(found, all_rows.id.eqNullSafe(found.id_) & (F.col("copy") == F.col("copy_")), "left").select(
        F.col("id").alias(key),
        *[F.col(f"_{c}").alias(c) for c in others],
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
