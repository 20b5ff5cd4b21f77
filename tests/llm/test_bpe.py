import base64
import hashlib
import struct

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from verdimill.llm import bpe
from verdimill.llm.bpe import Codec, encode_column

PATH = P.path("byte_bpe_multi_50k.tiktoken")
DATA = open(PATH, "rb").read()
CODEC = Codec.parse(DATA, P.PATTERN)
RANKS = {base64.b64decode(a): int(b) for a, b in (x.split() for x in DATA.splitlines() if x)}
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture
def tiny_leaves(monkeypatch):
    monkeypatch.setattr(bpe, "LEAF", 5)
    monkeypatch.setattr(bpe, "SHORT", 4)


ALPHABET = st.sampled_from(list("abehnst'lrvmd  \n\t\r.,!?*#0123éüß漢字😀  \x1ćİ"))


@settings(max_examples=1500, deadline=None)
@given(st.text(ALPHABET, max_size=60))
def test_trees_agree_with_library(text):
    old = bpe.LEAF, bpe.SHORT
    bpe.LEAF, bpe.SHORT = 5, 4
    try:
        c = Codec(RANKS, P.PATTERN)
        ids = c.encode(text)
        assert ids == ENC.encode_ordinary(text)
        assert c.decode(ids) == text.encode()
    finally:
        bpe.LEAF, bpe.SHORT = old


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_unicode(text):
    assert CODEC.encode(text) == ENC.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 3001, "ab" * 5000, "é" * 777, " " * 2000 + "x", "'" * 999 + "ll", "https" * 300, "x\n" * 3000, "don't we'll I'd " * 700, "1" * 5000, "ß漢" * 900])
def test_long_runs(text, tiny_leaves):
    assert Codec(RANKS, P.PATTERN).encode(text) == ENC.encode_ordinary(text)


def test_every_code_point_splits_alike():
    bad = []
    for block in range(0, 0x20000, 256):
        text = "".join(f"a{chr(c)}b{chr(c)}{chr(c)} {chr(c)}1" for c in range(block, block + 256) if not 0xD800 <= c < 0xE000)
        if CODEC.encode(text) != ENC.encode_ordinary(text):
            bad.append(block)
    # Blocks with characters that one of the two Unicode tables does not know yet.
    assert len(bad) <= 12, [hex(b) for b in bad]


def test_frame(spark, sf):
    rows = [(1, "Hello, world", "x"), (2, None, "y"), (3, "", "z"), (4, "Hello, world", "x"), (None, "t" * 10000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.ids_sha256): r for r in encode_column(df, PATH, P.PATTERN, keep_ids=True).collect()}
    assert len(got) == 5
    for doc_id, text, _ in rows:
        ids = ENC.encode_ordinary(text or "")
        digest = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        r = got[doc_id, digest]
        assert (r.n_tokens, list(r.ids), r.decoded_sha256) == (len(ids), ids, hashlib.sha256((text or "").encode()).hexdigest())
    assert encode_column(df.limit(0), PATH, P.PATTERN).collect() == []


def test_documents_match_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: len(ENC.encode_ordinary(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in bpe.tokenize_documents(docs, PATH, P.PATTERN).collect()} == want
