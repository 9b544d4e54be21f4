import base64
import os
import random
from array import array

import numpy as np
import pytest

from assaylake.llm.bpe import PATTERN, VOCABULARY, BacktrackingEncoder, OffsetDecoder, count_tokens, decode_ids, encode_texts

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def encoder():
    with open(VOCABULARY, "rb") as f:
        return BacktrackingEncoder(f.read())


@pytest.fixture(scope="module")
def other():
    import tiktoken

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def ids(encoder, text):
    out = array("i")
    encoder.encode(text, out)
    return list(out)


def test_same_ids_as_a_merging_encoder(encoder, other):
    rng = random.Random(7)
    alphabet = " aabbetholsinrsd  \n\r\té世界́🐛-=_0123<|>"
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80)))
        assert ids(encoder, text) == other(text), text
    for text in ("<|endoftext|>", "a" * 20_000, "xyz" * 7_000, " " * 9_000, "​﻿", "don't", "١٢٣"):
        assert ids(encoder, text) == other(text)


def test_every_token_is_its_own_code(encoder):
    assert all(encoder.encode_piece(t.decode()) == (i,) for i, t in enumerate(encoder.tokens) if _is_text(t))


def _is_text(t):
    try:
        return bool(t.decode())
    except UnicodeDecodeError:
        return False


def test_decoder(encoder):
    d = OffsetDecoder(encoder.tokens)
    for i in (0, 50255, 1234):
        assert d.decode(np.array([i])) == encoder.tokens[i]
    assert d.decode(np.array([], int)) == b""


def test_tables(spark, other):
    long = "commit 0af3 " * 120_000  # beyond the length that is split at once
    rows = [(1, "hello  world\n"), (2, None), (3, ""), (3, "again"), (None, "naïve 🐛"), (5, long), (6, "<|endoftext|>")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, ids int")
    out = encode_texts(df, "doc_id", "text")
    got = sorted(((r.doc_id or 0, list(r.ids)) for r in out.collect()), key=lambda r: (r[0], len(r[1])))
    assert got == sorted([(k or 0, other(t) if t else []) for k, t in rows], key=lambda r: (r[0], len(r[1])))
    back = decode_ids(out, "doc_id")
    assert sorted(((r.doc_id or 0, r.text) for r in back.collect())) == sorted((k or 0, t or "") for k, t in rows)
    sizes = {(r.doc_id, r.n_tokens) for r in count_tokens(df, "text", keep=["doc_id"]).collect()}
    assert (2, 0) in sizes and (3, 0) in sizes and (1, len(other("hello  world\n"))) in sizes
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0
