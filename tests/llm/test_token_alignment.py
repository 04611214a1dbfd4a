"""Cross-tokenizer alignment against a brute-force version that encodes whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corvane.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_table():
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b, letters = sentencepiece.SentencePieceProcessor(model_file=B), byte_table()
    token_b = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    def both(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        return [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids_a], [(i, token_b(b.id_to_piece(i))) for i in ids_b]

    return both


def brute(coders, docs):
    out, held = {}, Counter()
    for n, text in docs:
        out[n] = None
        if not text:
            continue
        a, b = coders(text)
        whole = (" " + text).encode()
        if b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
            continue
        spans = []
        for tokens in (a, b):
            at, own = 0, []
            for i, t in tokens:
                own.append((at, at + len(t), i))
                at += len(t)
            spans.append(own)
        links = [(x, y) for xa, xe, x in spans[0] for ya, ye, y in spans[1] if xa < ye and ya < xe] if len(a) * len(b) < 10**5 else walk(*spans)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for cut in cuts if len(cuts) < 500 else []:
            groups.append("|".join(",".join(str(i) for s, _, i in own if low <= s < cut) for own in spans))
            low = cut
        out[n] = (len(a), len(b), len(cuts), links, ";".join(groups))
        held.update(set(links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    rows = {}
    for n, found in out.items():
        if found is None:
            rows[n] = (0, 0, 0, 0, 0, 0, "")
        else:
            na, nb, ng, links, text = found
            rows[n] = (na, nb, ng, len(links), sum(held[k] == most[k[0]] for k in links), sum(held[k] for k in links), text)
    return rows


def walk(a, b):
    i = j = 0
    links = []
    while i < len(a) and j < len(b):
        links.append((a[i][2], b[j][2]))
        x, y = a[i][1], b[j][1]
        i, j = i + (x <= y), j + (y <= x)
    return links


TEXTS = [None, "", " ", "  ", "\n", " a", "a ", "a  b", "a ", "a   b", "  x", "x   y　 z　", "don't 's  't", "<|endoftext|> and <s> </s> <unk>", "a▁b fine", "fine ▁", "naïve café 中文 テスト", "\x00\x1c \x7f  z\x7f", "tab\tnew\n\n  line \r\n", "ééé " * 40, "😀😀 👩‍👩‍👧", "x" * 3000, "12345 67 8", "$$$ %%% word### next***", "end   ", "\u0085 a  b   c"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    pieces = ["the ", "The", " of", "é", " ", "  ", "\n", "\t", "1", "23", ".", "'s", "中", "word", " ", "　", "$$", "😀", "abcdefg", "-"]
    return TEXTS + ["".join(rng.choices(pieces, k=rng.randint(1, 60))) for _ in range(250)] + ["the same text"] * 5 + ["the word " * 20_000]


@pytest.mark.parametrize("parts", [1, 5])
def test_alignment(spark, coders, texts, parts):
    docs = list(enumerate(texts))
    table = spark.createDataFrame([(i, t, "clash", 7) for i, t in docs], "doc_id bigint, text string, pair string, n_a int").repartition(parts)
    got = {r.doc_id: r for r in ta.token_alignment(table, A, B).collect()}
    want = brute(coders, docs)
    assert len(got) == len(docs)
    for i, (na, nb, ng, nl, best, total, form) in want.items():
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == (na, nb, ng, nl, best, total), (i, texts[i])
        if form or not na:
            assert r.groups == form and r.groups_sha256 == (hashlib.sha256(form.encode()).hexdigest() if form else ""), (i, texts[i])


def test_odd_rows(spark):
    table = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id bigint, text string")
    rows = ta.token_alignment(table, A, B, with_groups=False)
    assert rows.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((r.doc_id or 0, r.n_links, r.count_sum) for r in rows.collect()) == [(0, 2, 6), (1, 2, 6), (1, 2, 6), (2, 0, 0)]
    assert ta.token_alignment(table.where("false"), A, B).count() == 0


def test_pieces():
    rng = np.random.default_rng(1)
    for _ in range(300):
        end = int(rng.integers(1, 60))
        lists = [np.unique(np.append(rng.choice(np.arange(1, end + 1), int(rng.integers(1, end + 1))), end)) for _ in range(2)]
        a, b = lists
        whole = sorted(set(a.tolist()) | set(b.tolist()))
        want = [(int(np.searchsorted(a, e)), int(np.searchsorted(b, e)), sum(x < e and x in set(b.tolist()) for x in a.tolist())) for e in whole]
        for piece in (1, 2, 5, 1000):
            assert list(zip(*(x.tolist() for x in ta.links(a, b, piece)), strict=True)) == want
            i, j = ta.diagonals(a, b, piece)
            assert (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all() and (np.diff(i) + np.diff(j) <= piece + 1).all()
