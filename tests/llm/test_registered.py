"""The registered queries: against their SQL, and the pipeline against a brute-force version."""

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from comparing import assert_same, connect  # noqa: E402

from corvane.llm.oracles import ORACLE_SQL  # noqa: E402
from corvane.llm.queries import QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    frame = QUERIES[name](spark, small)
    if name in ORACLE_SQL:
        assert_same(frame, connect(small), ORACLE_SQL[name])
    else:
        assert frame.count() == spark.read.parquet(f"{small}/documents.parquet").count()


def test_pipeline(spark, small):
    import corpus_pipeline
    import tiktoken
    from public_tokenizers import PATTERN, path

    from corvane.llm.byte_bpe import read_ranks

    word, item_word = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    small_letters = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    docs = {i: t for i, t in docs.items() if re.search(r"[^\W\d_]", t)}  # the language stage; it knows all clean ones
    groups = {r.doc_id: r.component_id for r in QUERIES["op5_simhash"](spark, small).collect()}
    docs = {i: t for i, t in docs.items() if groups[i] == i}
    first, left = {}, {}
    for i in sorted(docs):
        words = word.findall(docs[i])
        for j in range(len(words) - 49):
            first.setdefault(tuple(words[j : j + 50]), i)
    for i, t in docs.items():
        spans, gone = [m.span() for m in word.finditer(t)], set()
        for j in range(len(spans) - 49):
            if first[tuple(t[a:b] for a, b in spans[j : j + 50])] < i:
                gone |= set(range(j, j + 50))
        ends = [a for a, _ in spans[1:]] + [len(t)]
        kept = t if not gone else t[: spans[0][0]] + "".join(t[a:e] for j, ((a, _), e) in enumerate(zip(spans, ends, strict=True)) if j not in gone)
        if not gone or len(gone) < len(spans):
            left[i] = kept
    windows = set()
    for r in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        words = item_word.findall(small_letters(r.text))
        windows |= {tuple(words[j : j + 13]) for j in range(max(1, len(words) - 12))}
    clean = {}
    for i, t in left.items():
        words, hit = item_word.findall(small_letters(t)), set()
        for j in range(len(words)):
            if tuple(words[j : j + 13]) in windows:
                hit |= set(range(j, min(j + 13, len(words))))
        if not hit or 20 * len(hit) < len(words):
            clean[i] = t
    exact = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, small).collect()}
    assert got == {i: exact.encode_ordinary(t) for i, t in clean.items()}
