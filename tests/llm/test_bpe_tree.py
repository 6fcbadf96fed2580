import base64
import hashlib

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bpe_tree
from millrace.llm.bpe_tree import Codec

VOCAB = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCAB, "rb"))}
TIK = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = Codec(RANKS)


def whole(text):
    import regex

    return [i for p in regex.findall(P.PATTERN, text) for i in CODEC.encode_piece(p)]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text("ab ", min_size=30, max_size=400), st.text("aeéß日本", max_size=300)))
def test_same_as_tiktoken(text):
    assert whole(text) == TIK.encode_ordinary(text)
    assert CODEC.decode(whole(text)) == text.encode()


def test_long_runs():
    for text in ("a" * 5000, "ab" * 3000, "internationalization" * 200, "=" * 3001, " " * 999, "日" * 2000):
        assert whole(text) == TIK.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=120), st.binary(max_size=120))
def test_join_is_encoding_of_both(a, b):
    assert CODEC.join(CODEC.merge(a), CODEC.merge(b)) == CODEC.merge(a + b)


def test_pieces_come_up_the_tree():
    """Every piece that is no token is joined from halves, and the joins' windows decide the ids."""
    import regex

    class Glued(Codec):
        def join(self, left, right):
            return left + right

    words = [w for text in ("internationalization of Wörterbücher, 12345 and the thhant eder inlyth thtiat",) for w in regex.findall(P.PATTERN, text)]
    fresh, glued = Codec(RANKS), Glued(RANKS)
    for word in words:
        before = fresh.joins
        ids = fresh.encode_piece(word)
        if word.encode() not in RANKS:
            assert fresh.joins > before or len(word.encode()) <= bpe_tree.SUBTREE_BYTES
            assert glued.encode_piece(word) != ids
    assert fresh.joins > 20


def test_query_joins(spark):
    """Of the pieces of the smallest table that are no tokens, all are made by joins."""
    import regex

    fresh = Codec(RANKS)
    pieces = {p for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() for p in regex.findall(P.PATTERN, r.text)}
    others = [p for p in pieces if p.encode() not in RANKS and len(p.encode()) > bpe_tree.SUBTREE_BYTES]
    for p in others:
        fresh.encode_piece(p)
    assert others and fresh.joins >= len(others)


def test_rows(spark):
    rows = [(1, "Hello wörld 123"), (1, "Hello wörld 123"), (None, "x"), (4, None), (5, ""), (6, "z" * 30000 + " end")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")
    found = bpe_tree.decode(bpe_tree.encode(docs, VOCAB, P.PATTERN), VOCAB).collect()
    assert len(found) == len(rows)
    got = sorted((r.doc_id or -1, r.ids, bytes(r.decoded)) for r in found)
    assert got == sorted((i or -1, TIK.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    again = bpe_tree.encode(docs, VOCAB, P.PATTERN, decoded=True).collect()
    assert sorted((r.doc_id or -1, r.ids, bytes(r.decoded)) for r in again) == got
    assert bpe_tree.decode(bpe_tree.encode(docs.limit(0), VOCAB, P.PATTERN), VOCAB).count() == 0


def test_query(spark):
    from millrace.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op8_bpe_tree"](spark, sf).collect():
        ids = TIK.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
