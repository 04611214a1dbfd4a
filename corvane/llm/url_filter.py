"""URL filter: host and path rules, then a weighted vocabulary of terms.

Rules name a host and the start of a path; the longest that fits decides.  For
other URLs an Aho-Corasick automaton over all that follows :// counts terms that
stand alone between characters other than letters and digits: one strict term,
or several distinct soft terms, weigh enough to block the URL.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.textkit import batches_of

# Terms of unwanted sites in several languages, strict ones and soft ones.
STRICT_TERMS = (
    "adult", "bukkake", "camgirl", "camgirls", "casino", "casinos", "erotik", "erotique", "escort", "escorts", "fetish", "hardcore", "hentai", "keygen",
    "malware", "milf", "nsfw", "onlyfans", "phishing", "porn", "porno", "pornografia", "pornographie", "rape", "sex", "sexe", "sexo", "slut", "spam",
    "spyware", "torrents", "viagra", "cialis", "warez", "webcamsex", "xvideos", "xxx",
)
SOFT_TERMS = (
    "ads", "amateur", "apuestas", "babes", "bet", "bets", "betting", "bonus", "cheap", "chicas", "click", "clickbait", "clicks", "coupon", "crack", "credit",
    "dating", "deals", "discount", "filles", "forex", "free", "frauen", "gambling", "geld", "girls", "gratis", "gratuit", "hot", "jackpot", "kredit",
    "loan", "loans", "lotto", "maedchen", "miracle", "money", "nackt", "nude", "paris-sportifs", "payday", "pharmacy", "pills", "poker", "promo", "referral",
    "replica", "rencontre", "roulette", "sexy", "singles", "slots", "spielautomaten", "swingers", "teen", "teens", "torrent", "track", "viagra-online",
    "weightloss", "win", "winner", "wetten",
)
#: What a strict and a soft term weigh; distinct terms of this weight in all block a URL.
STRICT_WEIGHT, SOFT_WEIGHT, LIMIT = 2, 1, 2
SOFT_LIMIT = LIMIT // SOFT_WEIGHT
#: (verdict, host, start of path) of the registered query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def url_host(url: Column) -> Column:
    """From after the first :// to /, ?, # or the end; A-Z in lower case; '' without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host, to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_verdict(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule that fits, or null.

    A rule fits its host and all subdomains if the path starts with the rule's.
    Length is that of host and path together; of equal ones the first wins.
    """
    found = F.lit(None)
    for verdict, on, start in sorted(rules, key=lambda rule: -len(rule[1] + rule[2]))[::-1]:
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(on + start).alias("rule"))).otherwise(found)
    return found


def weights_of(strict: Iterable[str], soft: Iterable[str]) -> dict[str, int]:
    """The vocabulary: a weight for each term; one strict term weighs as much as blocks a URL."""
    return {term: SOFT_WEIGHT for term in soft} | {term: STRICT_WEIGHT for term in strict}


def term_hits(weights: dict[str, int]):
    """An Arrow function that counts the terms of URLs: strict_terms, soft_terms (distinct), n_terms (all hits) and weight.

    A URL is read from after :// to its end, decoded from percent signs, in
    lower case.  A term counts where no letter or digit stands beside it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in weights:
            automaton.add_word(term, term)
        if weights:
            automaton.make_automaton()
        alone = lambda text, at: not (0 <= at < len(text) and text[at].isalnum())
        for batch in batches:
            out: list[tuple] = []
            for url in batch.column("_url").to_pylist():
                text = unquote((url or "").partition("://")[2]).lower()
                hits = [term for end, term in automaton.iter(text) if alone(text, end - len(term)) and alone(text, end + 1)] if weights else []
                found = sorted(set(hits))
                out.append(([t for t in found if weights[t] >= STRICT_WEIGHT], [t for t in found if weights[t] < STRICT_WEIGHT], len(hits), sum(weights[t] for t in found)))
            kinds = (pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.int64())
            kept = [batch.column(c) for c in ("_key", "_host", "_path")]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)]], names=["_key", "_host", "_path", "strict_terms", "soft_terms", "n_terms", "weight"])

    return run


def url_filter(pages: DataFrame, *, url: str = "url", key: str = "page_id", rules=RULES, strict=STRICT_TERMS, soft=SOFT_TERMS, limit: int = LIMIT) -> DataFrame:
    """One row for each row of pages: key, host, path, rule, verdict, strict_terms, soft_terms, n_terms, weight.

    Only the two named columns are read, whatever others there are.  A null URL
    or one without :// has an empty host and path, fits no rule and has no
    terms, so it is allowed.  Repeated rows each get their row; an empty table
    gives none.
    """
    parts = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), url_host(F.col(url)).alias("_host"), url_path(F.col(url)).alias("_path"))
    kind = dict(parts.dtypes)["_key"]
    found = batches_of(parts, term_hits(weights_of(strict, soft)), f"_key {kind}, _host string, _path string, strict_terms array<string>, soft_terms array<string>, n_terms bigint, weight bigint")
    chosen = rule_verdict(F.col("_host"), F.col("_path"), rules) if rules else F.lit(None).cast("struct<verdict:string,rule:string>")
    by_terms = F.when(F.col("weight") >= limit, "block").otherwise("allow")
    return found.withColumn("_chosen", chosen).select(
        F.col("_key").alias(key),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_chosen.rule").alias("rule"),
        F.coalesce(F.col("_chosen.verdict"), by_terms).alias("verdict"),
        "strict_terms",
        "soft_terms",
        "n_terms",
        "weight",
    )
