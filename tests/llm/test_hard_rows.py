"""Words and passages made to collide in weak hashes, rows with odd ids, and clashing column names."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import byte_bpe, decontaminate, language_id, license_scan, lm_scoring, quality_rules, simhash, substring_dedup, token_output
from corvane.llm.textkit import shared_path, text_buffer

SCHEMA = "doc_id bigint, text string"


def thue_morse(letters, length):
    return "".join(letters[i.bit_count() % 2] for i in range(length))


TWINS = {n: (thue_morse("ab", n), thue_morse("ba", n)) for n in (1024, 2048)}
X, Y = (" ".join("aardvark" if c == "a" else "bee" for c in t) for t in TWINS[2048])


@pytest.fixture(scope="module")
def twins(spark):
    rows = [(i, t) for i, t in enumerate([*TWINS[1024], *TWINS[2048], X, Y, f"{X} tail", f"one {TWINS[1024][0]} {TWINS[1024][1]}, two {TWINS[1024][0]}"])]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(2).cache()


def test_colliding_words_bpe(twins):
    import tiktoken

    rows, docs = twins
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.byte_bpe(docs, path, public_tokenizers.PATTERN).collect()}
    for i, t in rows:
        assert got[i].ids == exact.encode_ordinary(t) and got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_colliding_words_token_output(spark, twins):
    from tokenizers import Tokenizer

    rows, docs = twins
    path, where = public_tokenizers.path("word_bpe_49k.json"), shared_path(spark, "test")
    token_output.write_token_ids(docs.union(docs.limit(1)).union(spark.createDataFrame([(None, "x"), (None, "y")], SCHEMA)), where, path, end_id=2)
    tokenizer = Tokenizer.from_file(path)
    got = token_output.read_token_ids(spark, where).collect()
    assert sorted(Counter(r.doc_id for r in got).values()) == [1] * (len(rows) - 1) + [2, 2]
    assert all(r.ids == [*tokenizer.encode(rows[r.doc_id][1], add_special_tokens=False).ids, 2] for r in got if r.doc_id is not None)


def test_other_tokenizer(spark):
    """A tokenizer that keeps case and white space is given whole texts."""
    from tokenizers import Tokenizer

    path, where = public_tokenizers.path("byte_bpe_50k.json"), shared_path(spark, "test")
    rows = [(1, "Two  words, The End.\n"), (2, ""), (3, None)]
    token_output.write_token_ids(spark.createDataFrame(rows, SCHEMA), where, path, end_id=50256)
    tokenizer = Tokenizer.from_file(path)
    assert {r.doc_id: r.ids for r in token_output.read_token_ids(spark, where).collect()} == {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 50256] for i, t in rows}


def test_colliding_words_figures(twins):
    rows, docs = twins
    texts = dict(rows)
    for r in quality_rules.quality_rules(docs).collect():
        words = texts[r.doc_id].split()
        often = Counter(zip(words, words[1:], words[2:]))
        assert r.n_repeat_words == len({j + k for j, x in enumerate(zip(words, words[1:], words[2:])) if often[x] > 1 for k in range(3)})
    held = F.col("doc_id") % 2 == 1
    train = Counter(w for i, t in rows if i % 2 == 0 for w in [*t.split(), None])
    for r in lm_scoring.lm_scores(docs, held).collect():
        assert r.n_known == sum(train[w] > 0 for w in [*texts[r.doc_id].split(), None]) and r.train_tokens == sum(train.values())


def test_colliding_passages(twins):
    rows, docs = twins
    first: dict = {}
    for i, t in rows:
        words = t.split()
        for j in range(len(words) - 49):
            first.setdefault(tuple(words[j : j + 50]), i)
    for r in substring_dedup.substring_dedup(docs, with_text=False).collect():
        words, gone = rows[r.doc_id][1].split(), set()
        for j in range(len(words) - 49):
            if first[tuple(words[j : j + 50])] < r.doc_id:
                gone |= set(range(j, j + 50))
        assert (r.n_words, r.n_removed) == (len(words), len(gone))


def test_automaton_decides(monkeypatch):
    """Without the automaton's hits nothing is removed: no other way leads from a phrase to its place."""
    words = [f"w{i}" for i in range(70)]
    text = pa.array(["one two " + " ".join(words)])
    own = substring_dedup.Texts(*text_buffer(text))
    start, stop, place = substring_dedup.passages(own, 50, 8)
    digests = substring_dedup._digests(own, start, stop)
    spots = [[{"phrase": own.words(p, p + 8).decode(), "p": int(d[0]), "p2": int(d[1]), "before": int(p - a), "length": int(b - a), "whole": True} for a, b, p, d in zip(start, stop, place, digests, strict=True)]]
    batch = pa.RecordBatch.from_pydict({"id": [1], "text": text, "spots": spots, "windows": pa.array([None], pa.list_(pa.struct([("w1", pa.int64()), ("w2", pa.int64())])))})
    removed = lambda: next(substring_dedup._removals(50, 8, [], False)(iter([batch]))).column(2).to_pylist()
    assert removed() == [72]
    monkeypatch.setattr(substring_dedup, "located", lambda *_: iter(()))
    assert removed() == [0]


def test_hot_passage(spark):
    """One passage in most documents, between words of their own, over more documents than a key has salts."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([*(f"a{i}x{j}" for j in range(rng.randint(0, 30))), *passage[: rng.randint(50, 60)], *(f"b{i}x{j}" for j in range(rng.randint(0, 30)))])) for i in range(80)]
    first: dict = {}
    for i, t in rows:
        for j in range(len(t.split()) - 49):
            first.setdefault(tuple(t.split()[j : j + 50]), i)
    for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5), with_text=False).collect():
        words = rows[r.doc_id][1].split()
        gone = {k for j in range(len(words) - 49) if first[tuple(words[j : j + 50])] < r.doc_id for k in range(j, j + 50)}
        assert r.n_removed == len(gone)


def test_follow_the_leader_by_scalars():
    """The vectorised learner against the same updates written out number by number."""
    rng = np.random.default_rng(3)
    examples = [(int(rng.integers(3)), np.sort(rng.choice(8, 3, replace=False)), rng.random(3)) for _ in range(40)]
    model = language_id.Model(["a", "b", "c"], np.ones(8), np.zeros((9, 3)))
    language_id.follow_the_leader(model, examples, epochs=2)
    alpha, beta, l1, l2 = language_id.ALPHA, language_id.BETA, language_id.L1, language_id.L2
    z, n, order = np.zeros((9, 3)), np.zeros((9, 3)), np.random.default_rng(7)
    weight = lambda z_, n_: 0.0 if abs(z_) <= l1 else (np.sign(z_) * l1 - z_) / ((beta + np.sqrt(n_)) / alpha + l2)
    for _ in range(2):
        for at in order.permutation(len(examples)):
            label, which, values = examples[at]
            pairs = [*zip(which.tolist(), values.tolist(), strict=True), (8, 1.0)]
            w = {(i, c): weight(z[i, c], n[i, c]) for i, _ in pairs for c in range(3)}
            score = [sum(w[i, c] * x for i, x in pairs) for c in range(3)]
            total = sum(np.exp(score))
            for i, x in pairs:
                for c in range(3):
                    g = (np.exp(score[c]) / total - (c == label)) * x
                    z[i, c] += g - (np.sqrt(n[i, c] + g * g) - np.sqrt(n[i, c])) / alpha * w[i, c]
                    n[i, c] += g * g
    assert model.weights == pytest.approx(np.vectorize(weight)(z, n))


def test_calibration(spark, small):
    """Scores of short held-out texts agree with how often they are right; noise is never near certain."""
    docs = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = language_id.fit(docs.where("doc_id % 2 = 0"))
    assert model.temperature > language_id.LEAST_TEMPERATURE
    found = [(model.predict(r.text[:size]), r.lang) for r in docs.where("doc_id % 2 = 1 and lang is not null").collect() for size in (8, 16, 40) if any(c.isalpha() for c in (r.text or "")[:size])]
    right, score = np.array([p[0] == lang for p, lang in found]), np.array([p[1] for p, _ in found])
    bins = np.minimum((score * 5).astype(int), 4)
    error = sum(abs(right[bins == b].mean() - score[bins == b].mean()) * (bins == b).mean() for b in range(5) if (bins == b).any())
    assert error < 0.1 and ((score - right) ** 2).mean() < 0.2
    assert model.predict("zzzz qqqq xxxx")[1] < 0.95


def test_licences_by_brute_force(spark):
    """Known sentences in any line wrapping, among other text, against a plain search of joined parts."""
    rng, known = random.Random(4), {license_scan.normalised(s): name for name, own in license_scan.SENTENCES.items() for s in own}
    for own in license_scan.SENTENCES.values():
        for s in own:
            assert [p for p, _, _ in license_scan.pieces(s)] == [license_scan.normalised(s)], s
    pool = [s for own in license_scan.SENTENCES.values() for s in own[:3]] + ["Copyright (c) 2020 Somebody.", "Other words stand here.", "not a sentence"]
    rows = []
    for i in range(150):
        chosen = [rng.choice(pool) for _ in range(rng.randint(1, 6))]
        text = rng.choice(["\n", "\n\n"]).join(c if c[-1:] in ".:;!?" else c + rng.choice(["", "."]) for c in chosen)
        rows.append((i, "".join("\n" if c == " " and rng.random() < 0.1 else c for c in text)))
    rows += [(900, None), (901, ""), (902, "word " * 200_000), (1, rows[1][1]), (None, rows[2][1])]
    got = license_scan.license_scan(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], f"{SCHEMA}, licences string, n_rules int")).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        parts, out, start = list(license_scan.pieces(t or "")), [], 0
        for at, (part, ended, _) in enumerate(parts):
            joined = [" ".join(p for p, _, _ in parts[s : at + 1]) for s in range(start, at + 1)]
            hit = next((known[x] for x in joined if x in known), None) if part else None
            out += [hit] * bool(hit)
            if hit or ended or not part:
                start = at + 1
        want[i] = out
    for r in got:
        assert r.sentence_ids == want[r.doc_id]
    far = "MIT License\n" + "filler " * 100 + "\n" + license_scan.SENTENCES["mit-grant"][0]
    rules = {"X": (("mit-title", "mit-grant"),)}
    frame = spark.createDataFrame([(1, far), (2, far.replace("filler " * 90, ""))], SCHEMA)
    assert [r.licences for r in license_scan.license_scan(frame, rules=rules).orderBy("doc_id").collect()] == [[], ["X"]]


def test_pipeline_stages_on_odd_rows(spark, small):
    """Nulls, repeated rows, empty tables and columns whose names the operators return too."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = ["n_words", "clean_text", "contaminated", "score", "lang_pred", "known", "id", "copy", "items", "component_id", "words", "fp", "a b"]
    clash = docs.select("*", *[F.lit(5).alias(n) for n in names])
    odd = clash.limit(3).withColumn("text", F.lit(None).cast("string")).union(clash.limit(2)).union(clash.limit(2).withColumn("doc_id", F.lit(None).cast("bigint")))
    for rows in (clash.union(odd), clash.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, small)
            if name != "byte_bpe":
                assert out.dtypes == rows.dtypes
                assert out.where(" or ".join(f"`{n}` <> 5" for n in names)).count() == 0
    kept = corpus_pipeline.simhash_stage(spark, clash.union(odd), small)
    assert kept.where("doc_id is null").count() == 2
    assert corpus_pipeline.language_stage(spark, clash.union(odd), small).where("text is null").count() == 0


def test_repeated_and_null_ids(spark):
    """Rows that repeat an id, or have none, get a row each."""
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (2, "x " * 30_000)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("n_words", F.lit("clash"))
    benchmark = spark.createDataFrame([(7, "c d e")], "item_id bigint, text string")
    hits = decontaminate.decontaminate(frame, benchmark).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in hits) == [(0, 0, 0), (0, 7, 3), (1, 7, 3), (1, 7, 3), (2, 30_000, 0)]
    groups = sorted(((r.doc_id or 0), r.component_id) for r in simhash.simhash_groups(frame).collect() if r.fingerprint != "0" * 16)
    assert groups == [(0, 1), (1, 1), (1, 1), (2, 2)]
    for out in (quality_rules.quality_rules(frame), lm_scoring.lm_scores(frame, F.lit(False)), language_id.predict(frame, language_id.fit(frame.withColumn("lang", F.lit("aa"))), columns=["doc_id"])):
        assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 0, 1, 1, 2]
    assert zlib.crc32(b"") == 0
