"""Column functions on names, tags and other short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the cautious singular: nouns that stay as they are.
INVARIANT_NOUNS = ("species", "news", "status", "glass", "glasses", "gas", "bus")
# Spellings of the SAFE marker.
SAFE_VARIANTS = ("exact", "regex", "lower", "set")
SAFE_SET = ("</safe>", "<safe/>", "<safe />", "safe")
# Hazard categories in display order, SAFE last.
CATEGORIES = ("GROUND", "PIT", "OVERHEAD")
LABELS = (*CATEGORIES, "SAFE")
# Heads of names that say nothing of the thing.
GENERIC_HEADS = ("obstacle", "object", "hazard")


def collapsed(text: Column) -> Column:
    """A text with each run of white space as one space, and none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\x0B]+", " "))


def singular_token(token: Column) -> Column:
    """The cautious singular of a lower-case token."""
    ends = lambda *suffixes: token.rlike("(" + "|".join(suffixes) + ")$")
    return (
        F.when(token == "buses", "bus")
        .when(token.isin(*INVARIANT_NOUNS), token)
        .when((F.length(token) > 4) & ends("ies"), F.regexp_replace(token, "ies$", "y"))
        .when((F.length(token) > 4) & ends("ches", "shes", "xes", "zes", "sses"), F.regexp_replace(token, "es$", ""))
        .when((F.length(token) > 3) & ends("s") & ~ends("ss", "us", "is", "ses"), F.regexp_replace(token, "s$", ""))
        .otherwise(token)
    )


def cautious_name(name: Column) -> Column:
    """A name in lower case, with single spaces between singular words of a-z and 0-9."""
    words = F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: w != "")
    return F.array_join(F.transform(words, singular_token), " ")


def simple_name(name: Column) -> Column:
    """A name in lower case without punctuation; words of over two letters lose one final s, unless it follows another."""
    plain = collapsed(F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", " "))
    words = F.filter(F.split(plain, " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when((F.length(w) > 2) & w.endswith("s") & ~w.endswith("ss"), F.regexp_replace(w, "s$", "")).otherwise(w)), " ")


def tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(name, " "), lambda w: w != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    """Common tokens of two normalised names over all their tokens; null without tokens."""
    return F.try_divide(F.size(F.array_intersect(tokens(a), tokens(b))), F.size(F.array_union(tokens(a), tokens(b))))


def token_subset(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(tokens(a), tokens(b)))
    return (F.size(tokens(a)) > 0) & (F.size(tokens(b)) > 0) & ((common == F.size(tokens(a))) | (common == F.size(tokens(b))))


def tag(text: Column, name: str) -> Column:
    """The stripped content of the first <name>…</name>, in any case; '' without one."""
    return F.regexp_replace(F.regexp_extract(text, rf"(?is)<{name}>(.*?)</{name}>", 1), r"^\s+|\s+$", "")


def is_safe(text: Column, variant: str = "exact") -> Column:
    """Whether a text says SAFE and nothing else; the variants differ in what spellings they take."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    if variant == "exact":
        return bare == "<SAFE/>"
    if variant == "regex":
        return bare.rlike(r"(?i)^<SAFE\s*/>$")
    if variant == "lower":
        return F.lower(bare) == "<safe/>"
    if variant == "set":
        return F.lower(bare).isin(*SAFE_SET)
    raise ValueError(f"variant must be one of {SAFE_VARIANTS}")


def quality_flags(text: Column) -> Column:
    """[empty, malformed] for nothing, [malformed] for what is neither SAFE nor ALERT with GUIDE, else []."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    flags = F.when(bare == "", F.array(F.lit("empty"), F.lit("malformed"))).when(is_safe(text), F.array()).when(bare.rlike(r"(?s)\A<ALERT>.+?</ALERT>\s*<GUIDE>.+?</GUIDE>\z"), F.array())
    return flags.otherwise(F.array(F.lit("malformed"))).cast("array<string>")


def unfenced(text: Column) -> Column:
    """A text without the Markdown fence around it."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)\A\s*```[a-zA-Z]*\s*", ""), r"(?s)\s*```\s*\z", "")


def without_thinking(text: Column) -> Column:
    """A text without a leading thinking block."""
    return F.regexp_replace(text, r"(?is)\A\s*<think>.*?</think>\s*", "")


def has_generic_head(name: Column) -> Column:
    """Whether the last word of a name is a generic noun."""
    head = F.element_at(F.regexp_extract_all(F.lower(name), F.lit("([a-z]+)"), F.lit(1)), -1)
    return F.coalesce(F.when((F.length(head) > 2) & head.endswith("s"), F.regexp_replace(head, "s$", "")).otherwise(head).isin(*GENERIC_HEADS), F.lit(False))


def image_label(path: Column, with_parent: bool = False) -> Column:
    """The file name of a path, or the last folder and the file name."""
    return F.substring_index(path, "/", -2 if with_parent else -1)


def clean_categories(categories: Column, distinct: bool = True) -> Column:
    """Known categories, trimmed and in upper case, in their order."""
    known = F.filter(F.transform(categories, lambda c: F.upper(F.trim(c))), lambda c: c.isin(*CATEGORIES))
    return F.array_distinct(known) if distinct else known


def has_cjk(text: Column) -> Column:
    return text.rlike("[一-鿿]")


def json_block(text: Column) -> Column:
    """From the first { to the last }, over lines; '' without both."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def fingerprint(*fields: Column) -> Column:
    """SHA-256 of the compact JSON object of fields, in the order of their names."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def fixed(value: Column, places: int) -> Column:
    """A number with a fixed count of places, rounded by its exact binary value, ties to even; empty for null, whole numbers up to 2**52."""
    scale = 10**places
    v = F.abs(value.cast("double"))
    # v * 2 * scale in two parts, of which the second is what the first one's rounding lost.
    factor, split = float(2 * scale), 134217729.0
    product, big = v * factor, v * split
    high = big - (big - v)
    factor_high = factor * split - (factor * split - factor)
    low, factor_low = v - high, factor - factor_high
    lost = ((high * factor_high - product) + high * factor_low + low * factor_high) + low * factor_low
    whole = F.floor(product / 2)
    over = product - 2 * whole  # at 1, a tie but for what was lost
    units = whole + F.when((over > 1) | ((over == 1) & ((lost > 0) | ((lost == 0) & (whole % 2 == 1)))), 1).otherwise(0)
    digits = F.concat(F.floor(units / scale).cast("string"), F.lit("."), F.lpad((units % scale).cast("string"), places, "0")) if places else units.cast("string")
    number = F.concat(F.when(value < 0, "-").otherwise(""), digits)
    return F.when(value.isNull(), "").when(F.isnan(value.cast("double")), "nan").when(v == float("inf"), F.when(value < 0, "-inf").otherwise("inf")).otherwise(number)


def formatted(value: Column, digits: int = 3, missing: str = "--") -> Column:
    """A number with a fixed count of places, or a mark where there is none."""
    return F.when(value.isNull() | F.isnan(value), missing).otherwise(fixed(value, digits))


def rounded(value: Column, places: int) -> Column:
    """A double rounded to some places by its exact binary value, ties to even."""
    return F.when(value.isNotNull(), fixed(value, places).cast("double"))


def duration(seconds: Column) -> Column:
    """Seconds as MM:SS, or as HH:MM:SS from an hour on; negative ones count as none."""
    whole = F.floor(F.greatest(seconds, F.lit(0.0))).cast("int")
    part = lambda size, of: F.pmod(F.floor(whole / size).cast("int"), F.lit(of))
    short = F.format_string("%02d:%02d", part(60, 60), part(1, 60))
    return F.when(whole >= 3600, F.concat(F.format_string("%02d:", F.floor(whole / 3600).cast("int")), short)).otherwise(short)


def progress_bar(done: Column, total: Column, width: int = 20) -> Column:
    """A bar of # for the share that is done, filled up with -."""
    share = F.coalesce(F.try_divide(F.least(F.greatest(done, F.lit(0)), total), total), F.lit(0.0))
    full = F.when(total > 0, F.floor(share * width)).otherwise(0).cast("int")
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("-"), F.lit(width) - full))


def trimmed_tokens(ids: Column, end_ids: tuple[int, ...], limit: int) -> Column:
    """struct(ids, finish): token ids before the first end id, and whether they stop, reach the limit or neither."""
    places = F.filter(F.transform(ids, lambda x, i: F.when(x.isin(*end_ids), i)), lambda i: i.isNotNull())
    at = F.array_min(places)
    kept = F.when(at.isNull(), ids).otherwise(F.slice(ids, 1, F.coalesce(at, F.lit(0))))
    return F.struct(kept.alias("ids"), F.when(at.isNotNull(), "stop").when(F.size(ids) >= limit, "length").otherwise("open").alias("finish"))


def safe_relative_path(path: Column) -> Column:
    """Whether a path stays below its root: no .., backslash, colon, control character, empty part or leading slash."""
    parts = F.split(path, "/")
    return ~path.rlike(r"[\\:\x00-\x1F]") & (path != "") & F.forall(parts, lambda p: (p != "") & (p != ".") & (p != ".."))


def redacted(text: Column) -> Column:
    """A text with keys, tokens and data URLs replaced."""
    text = F.regexp_replace(text, r"data:[\w/+.-]+;base64,[A-Za-z0-9+/=]+", "[DATA]")
    text = F.regexp_replace(text, r"(?i)\b(bearer)\s+[A-Za-z0-9._~+/-]+=*", "$1 [REDACTED]")
    return F.regexp_replace(text, r"""(?i)\b(api[_-]?key|secret|password|token)("?\s*[=:]\s*"?)[^\s",}]+""", "$1$2[REDACTED]")


def answer_of(text: Column, field: str = "alter", missing: str = "[ALTER_EXTRACTION_FAILED]") -> Column:
    """A text field of the JSON object from the first { to the last } of an answer, or a mark that there is none."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(json_block(text)), f"$.{field}", "string"), F.lit(missing))


def scoring_text(text: Column, safe_sentences: str = "The path is clear. Go ahead.") -> Column:
    """What a text is scored by: alert and guide in one line, two sentences for SAFE, else the text itself."""
    alert, guide = collapsed(tag(text, "ALERT")), collapsed(tag(text, "GUIDE"))
    return F.when(is_safe(text, "regex"), safe_sentences).when((alert != "") | (guide != ""), F.trim(F.concat_ws(" ", alert, guide))).otherwise(collapsed(text))


def response_text(body: Column, paths: tuple[str, ...] = ("$.choices[0].message.content", "$.output_text", "$.response", "$.text")) -> Column:
    """The first of some places in a JSON answer that holds text."""
    parsed = F.try_parse_json(body)
    at = lambda p: F.when(F.schema_of_variant(F.try_variant_get(parsed, p, "variant")) == "STRING", F.try_variant_get(parsed, p, "string"))
    return F.coalesce(*[at(p) for p in paths])


def category_objects(text: Column) -> Column:
    """Named objects of a JSON answer with their clean categories; those without any go, and null where it isn't such JSON."""
    parsed = F.from_json(json_block(text), "struct<objects:array<struct<name:string,categories:array<string>>>>")
    clean = F.transform(parsed["objects"], lambda o: F.struct(F.trim(o["name"]).alias("name"), clean_categories(o["categories"]).alias("categories")))
    return F.filter(clean, lambda o: (o["name"] != "") & (F.size(o["categories"]) > 0))
