"""Each operator against a brute-force version, on small made-up rows with odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corvane.llm import byte_bpe, decontaminate, elias_fano, language_id, license_scan, lm_scoring, pitman_yor, quality_rules, simhash, substring_dedup, token_output, url_filter
from corvane.llm.components import components
from corvane.llm.textkit import crc_remainder, shared_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, id string, fp string, words string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def documents(seed=1, count=60):
    """Documents with shared passages, near and exact copies, nulls, empties, odd white space and one long text."""
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "é", "Été", "x|", "中文", "don't", "end.", "1.5", " ", "big"] + [f"w{i}" for i in range(40)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, other = words(70), words(55)
    texts = [None, "", " \t\n", "one", "two words", "\x1c\x1d odd\x1fcontrols", " ".join(words(3000))]
    for _ in range(count):
        parts = words(rng.randint(1, 90))
        if rng.random() < 0.4:
            parts[rng.randint(0, len(parts)) : 0] = passage
        if rng.random() < 0.3:
            parts += other[rng.randint(0, 4) :]
        texts.append(rng.choice([" ", "  ", "\n"]).join(parts))
        if rng.random() < 0.2:
            texts.append(texts[-1])
        if rng.random() < 0.2:
            texts.append(texts[-1] + " tail")
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i * 3 - 5, t, "en", "clash", "clash", "clash") for i, t in zip(order, texts, strict=True)]


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(rows):
    return {r[0]: r[1] or "" for r in rows}


def test_substring_dedup(docs, rows):
    texts, first = texts_of(rows), {}
    for key in sorted(texts):
        words = WORD.findall(texts[key])
        for j in range(len(words) - 49):
            first.setdefault(tuple(words[j : j + 50]), key)
    removed = 0
    for r in substring_dedup.substring_dedup(docs, carry=("id", "fp")).collect():
        words, gone = WORD.findall(texts[r.doc_id]), set()
        for j in range(len(words) - 49):
            if first[tuple(words[j : j + 50])] < r.doc_id:
                gone |= set(range(j, j + 50))
        kept = [w for j, w in enumerate(words) if j not in gone]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
        assert WORD.findall(r.clean_text) == kept and (gone or r.clean_text == texts[r.doc_id]) and (r.id, r.fp) == ("clash", "clash")
        removed += len(gone)
    assert removed > 1000


def test_substring_dedup_odd_rows(spark, empty):
    long = " ".join(map(str, range(60)))
    same = " ".join(["again"] * 120)
    rows = [(1, long), (2, long), (2, long), (None, long), (3, same), (4, same)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(0, 0), (1, 0), (2, 60), (2, 60), (3, 0), (4, 120)]
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_language_id(spark, rows, empty):
    rng = random.Random(2)
    kinds = {"aa": "abcd", "bb": "bcde", "cc": "éèàç"}
    made = [(i, " ".join("".join(rng.choice(own) for _ in range(rng.randint(2, 6))) for _ in range(20)), lang) for i, (lang, own) in enumerate(list(kinds.items()) * 60)]
    made += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !", "cc"), (1003, made[0][1], None)]
    frame = spark.createDataFrame(made, "doc_id bigint, text string, lang string").withColumn("score", F.lit(1)).withColumn("held", crc_remainder(F.col("doc_id"), 4) == 2)
    model = language_id.fit(frame.where("not held"))
    assert model.languages == ["aa", "bb", "cc"] and (model.weights == 0).mean() > 0.5 and model.temperature > 0
    found = {r.doc_id: r for r in language_id.predict(frame, model).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (1000, 1001, 1002))
    held = [(found[i].lang_pred, lang) for i, _, lang in made if zlib.crc32(str(i).encode()) % 4 == 2 and found[i].lang_pred != "und"]
    assert held and np.mean([a == b for a, b in held]) > 0.95 and all(0 <= r.score <= 1 for r in found.values())
    nothing = language_id.fit(empty)
    assert language_id.predict(empty, nothing).count() == 0
    assert {r.lang_pred for r in language_id.predict(frame, nothing).collect()} == {"und"}


def test_quality_rules(spark, docs, rows, empty):
    texts = texts_of(rows)
    for r in quality_rules.quality_rules(docs).collect():
        t = texts[r.doc_id]
        words = WORD.findall(t)
        triples = list(zip(words, words[1:], words[2:]))
        often = Counter(triples)
        covered = {j + k for j, x in enumerate(triples) if often[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and r.n_lines == len(lines)
    prose = [f"Line{i} alpha{i} beta{i} gamma{i}, and delta{i}." for i in range(12)]
    noisy = prose[:3] + ["a | b | c | d | e"] * 2 + ["$$$ ### %%% &&& *** $$$"] + [f"no end here {i} of many words without a stop" for i in range(30)]
    made = spark.createDataFrame([(1, "\n".join(prose)), (2, "\n".join(noisy)), (3, "\n".join(prose + ["Click here."]))], "doc_id bigint, text string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(made).collect()}
    assert got[1].kept and got[1].clean_text == "\n".join(prose) and not got[2].kept and got[3].kept and got[3].failed == {"boilerplate": 1} and got[3].clean_text == "\n".join(prose)
    assert quality_rules.quality_rules(empty).count() == 0


def test_lm_scoring(docs, rows, empty):
    texts = texts_of(rows)
    train = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in [*WORD.findall(lower(t)), None])
    total, distinct = sum(train.values()), len(train)
    scores = lm_scoring.lm_scores(docs, crc_remainder(F.col("doc_id"), 5) == 1).collect()
    assert len(scores) == len(rows)
    for r in scores:
        words = [*WORD.findall(lower(texts[r.doc_id])), None]
        base = sum(np.log10((train[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(train[w] > 0 for w in words), total)
        assert r.base_score == pytest.approx(base) and r.score < 0 and r.perplexity > 1
    spark = docs.sparkSession
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    again = {r.doc_id: r.score for r in lm_scoring.lm_scores(docs.repartition(5), crc_remainder(F.col("doc_id"), 5) == 1).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert again == pytest.approx({r.doc_id: r.score for r in scores}, rel=1e-6)  # however words are dealt out
    held = [r for r in scores if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_scoring.lm_scores(empty, F.lit(False)).count() == 0


def test_seating():
    for c, a, d in ((1, 1.0, 0.5), (10, 2.0, 0.3), (300, 5.0, 0.6)):
        many = pitman_yor.seat(np.full(4000, float(c)), np.full(4000, a), d, pitman_yor.Draws(np.arange(4000), 4))
        # The expected number of tables follows a recurrence over customers.
        mean = 1.0
        for n in range(1, c):
            mean += (a + d * mean) / (a + n)
        assert many.min() >= 1 and many.max() <= c and many.mean() == pytest.approx(mean, rel=0.05)
    x = np.array([0.3, 1.0, 5.5, 80.0])
    from math import lgamma

    assert pitman_yor.lgamma(x) == pytest.approx([lgamma(v) for v in x], abs=1e-9)


def test_simhash(docs, rows, empty):
    import xxhash

    prints = {}
    for i, t in texts_of(rows).items():
        words = WORD.findall(lower(t))
        shingles = [" ".join(words[j : j + 3]) for j in range(len(words) - 2)] or [" ".join(words)] * bool(words)
        ones = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
        prints[i] = sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))
    root = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    for bucket in (64, 1):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs, bucket=bucket).collect()}
        assert got == {i: (f"{prints[i]:016x}", root[i]) for i in prints}
    assert simhash.simhash_groups(empty).count() == 0


def test_close_links_keep_components(spark):
    rng = random.Random(8)
    near = {0}
    for _ in range(150):
        near.add(rng.choice(sorted(near)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    near |= {rng.getrandbits(64) for _ in range(50)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in near]
    root = {x: x for x in near}
    for _ in range(12):
        for a in near:
            root[a] = min(root[b] for b in near if (a ^ b).bit_count() <= 2)
    for bucket in (1000, 2):
        links = simhash.close_links(spark.createDataFrame(signed, "fp bigint"), bucket=bucket)
        parts = {r.node % (1 << 64): r.root % (1 << 64) for r in components(links).collect()}
        groups = lambda label: {frozenset(x for x in near if label(x) == r) for r in {label(x) for x in near}}
        assert groups(lambda x: parts.get(x, x)) == groups(root.get)


def test_decontaminate(spark, docs, rows, empty):
    texts, rng = texts_of(rows), random.Random(9)
    sources = [ITEM_WORD.findall(lower(t)) for t in texts.values()]
    items = [(i, " ".join(s[k : k + 20])) for i, s in enumerate(x for x in sources if len(x) > 60) for k in [rng.randint(0, 30)]][:12]
    items += [(100, "zz yy xx"), (101, " ".join(sources[10][:2])), (102, None), (103, "  "), (None, "w1 w2"), (104, items[0][1])]
    benchmark = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id bigint, text string, doc_id string")
    windows = defaultdict(set)
    for i, t in items:
        words = ITEM_WORD.findall(lower(t or ""))
        if words and i is not None:
            for j in range(max(1, len(words) - 12)):
                windows[tuple(words[j : j + 13])].add(str(i))
    for most in (500_000, 0):
        got = decontaminate.decontaminate(docs, benchmark, carry=("lang",), broadcast_shingles=most).collect()
        assert len(got) == len(rows)
        for r in got:
            words, hit, found = ITEM_WORD.findall(lower(texts[r.doc_id])), set(), set()
            for n in {len(w) for w in windows}:
                for j in range(len(words) - n + 1):
                    if own := windows.get(tuple(words[j : j + n])):
                        hit |= set(range(j, j + n))
                        found |= own
            assert (r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) == (len(words), len(hit), len(found), sorted(found), bool(hit) and 20 * len(hit) >= len(words))
    assert decontaminate.decontaminate(empty, benchmark).count() == 0
    assert decontaminate.decontaminate(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 0), (1, 99), (1000, 10), (1000, 10**12), (700, 2000), (5, 2**62)):
        values = np.sort(rng.integers(0, top + 1, n)).astype(np.uint64)
        code = elias_fano.encode(values)
        read = elias_fano.EliasFano(b"xx" + code + b"yy", 2)
        assert (read.values() == values).all() and read.end == 2 + len(code) and all(read.select(i) == int(values[i]) for i in range(n))
        if n == 1000 and top > 10**6:
            assert len(code) < 8 * n


def test_token_output(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(7000, "a <|endoftext|> B."), (7001, "İ|| ÉTÉ.. don't"), (None, "null key")], "doc_id bigint, text string")
    frame = docs.select("doc_id", "text").unionByName(extra)
    where = shared_path(spark, "test")
    token_output.write_token_ids(frame, where, path, end_id=2, segment_ids=500)
    start = 0
    got = token_output.read_token_ids(spark, where).orderBy(F.asc_nulls_first("doc_id")).collect()
    texts = texts_of(rows) | {7000: "a <|endoftext|> B.", 7001: "İ|| ÉTÉ.. don't", None: "null key"}
    assert [r.doc_id for r in got] == [None, *sorted(k for k in texts if k is not None)]
    for r in got:
        ids = [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    segment = token_output.Segment(bytes(spark.read.parquet(where).orderBy("part", "number").first().segment))
    assert len(segment) == len(segment.keys()) and [len(segment.document(i)) for i in range(len(segment))] == [r.n_tokens for r in got[: len(segment)]]
    nowhere = shared_path(spark, "test")
    token_output.write_token_ids(empty, nowhere, path, end_id=2)
    assert token_output.read_token_ids(spark, nowhere).count() == 0


def test_license_scan(spark, docs, empty):
    mit = "MIT License\n\n" + license_scan.SENTENCES["mit-grant"][0].replace("Software without", "Software\nwithout") + "\n\n" + license_scan.SENTENCES["mit-notice"][0]
    made = [(1, mit), (2, "Text. Released under the MIT License."), (3, "All rights reserved.\nLicensed under the GPL, version 3."), (4, "The MIT License is nice to read about."), (5, None), (6, "Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(made, "doc_id bigint, text string")).collect()}
    assert [got[i].licences for i in range(1, 7)] == [["MIT"], ["MIT"], ["GPL-3.0-only", "proprietary"], [], [], ["CC-BY-NC-4.0"]]
    assert got[1].sentence_ids == ["mit-title", "mit-grant", "mit-notice"] and got[1].n_rules == 1
    assert license_scan.license_scan(empty).count() == 0 and license_scan.license_scan(docs).count() == docs.count()


def test_byte_bpe(docs, rows, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    texts = texts_of(rows)
    for r in byte_bpe.byte_bpe(docs, path, public_tokenizers.PATTERN, with_decoded=True).collect():
        ids = exact.encode_ordinary(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert bytes(r.decoded).decode() == texts[r.doc_id] and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert byte_bpe.byte_bpe(empty, path, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_odd_texts():
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces, rng = byte_bpe.Words(byte_bpe.Coder(ranks, byte_bpe.merge_table(ranks)), byte_bpe.Cutter(public_tokenizers.PATTERN)), random.Random(1)
    letters = list("abe TH'sretn  \n\t\r\x1c\x1f\xa0　é中1²３.,!?#-😀́İ\x85")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(800)] + ["a" * 1000, "abcab" * 300, "".join(rng.choice("etaoin") for _ in range(3000)), ""]
    raw = [t.encode() for t in texts]
    ids, back = pieces.code(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(t) for t in raw]))
    for t, a, b in zip(texts, ids, back, strict=True):
        assert np.frombuffer(a, "<u4").tolist() == exact.encode_ordinary(t) and b == t.encode()


def test_url_filter(spark):
    made = [
        (1, "http://A.Example.NET/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"), (2, "https://x.net/a?b", "x.net", "/a", "net/", "block"), (3, "https://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        (4, "https://x.org/fr/casino", "x.org", "/fr/casino", "org/fr/", "allow"), (5, "https://free-bets.com", "free-bets.com", "", None, "block"), (6, "https://freebets.com/win", "freebets.com", "/win", None, "allow"),
        (7, "https://my-casino.io", "my-casino.io", "", None, "block"), (8, "https://mycasinos.io/", "mycasinos.io", "/", None, "allow"), (15, "https://a.com/p%6Frn?q=1", "a.com", "/p%6Frn", None, "block"), (16, "https://a.com/?x=free&y=bonus", "a.com", "/", None, "block"), (9, None, "", "", None, "allow"), (10, "casino", "", "", None, "allow"),
        (11, "https://x.net", "x.net", "", None, "allow"), (12, "https://notexample.com/de/", "notexample.com", "/de/", None, "allow"), (13, "http://a.com/#casino", "a.com", "/", None, "block"), (14, "http://free.com/FREE/free", "free.com", "/FREE/free", None, "allow"),
    ]
    frame = spark.createDataFrame([(i, u, "x") for i, u, *_ in made] + [(1, "http://A.Example.NET/en/1", "x")], "page_id bigint, url string, host string")
    got = sorted((tuple(r)[:5] for r in url_filter.url_filter(frame).collect()), key=repr)
    assert got == sorted([(i, h, p, r, v) for i, _, h, p, r, v in made] + [(1, *made[0][2:])], key=repr)
    assert url_filter.url_filter(frame.limit(0)).count() == 0
