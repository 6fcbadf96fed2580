import zlib

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import packing

PATH = P.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
END = (2).to_bytes(4, "little")


def ids(text):
    return b"".join(i.to_bytes(4, "little") for i in TOKENIZER.encode(text or "", add_special_tokens=False).ids) + END


def verify(rows, texts, window):
    """Every id once, sequences gapless; returns the padding's share."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == texts.keys()
    for doc, parts in by_doc.items():
        data, at = ids(texts[doc]), 0
        for start, length, crc, total in sorted(parts):
            assert (start, total) == (at, len(data) // 4) and zlib.crc32(data[4 * start : 4 * (start + length)]) == crc
            at += length
        assert 4 * at == len(data)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length
            at += length
        assert at <= window
    used = sum(n for parts in by_sequence.values() for _, n in parts)
    return 1 - used / (window * len(by_sequence))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_tree_finds_the_tightest_window(lengths):
    """Against a search through all open windows."""
    rooms, plain, opened = packing.Rooms(20), [], 0
    for n in sorted(lengths, reverse=True):
        fits = [r for r in plain if r >= n]
        got = rooms.take(n)
        assert (got[0] if got else None) == (min(fits) if fits else None)
        room, number = got or (20, opened)
        opened += number == opened
        if fits:
            plain.remove(min(fits))
        plain.append(room - n)
        rooms.put(room - n, number)


def test_words_are_taken_apart_here():
    assert packing.text_ids(PATH).latin


@settings(max_examples=2000, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(st.characters(max_codepoint=0x190), max_size=30), st.text("aA'sSdDlLvVeErR1,.!<|> ßµ", max_size=30), st.text("aA'sS \t\x1c\x85  ́é9<|endoftext|>ΣİIı", max_size=60)))
def test_words_apart_give_the_same_ids(text):
    assert packing.text_ids(PATH).encode(text) + END == ids(text)


def test_query(spark):
    from millrace.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert verify(QUERIES["op2_packing"](spark, sf).collect(), texts, 4096) < 0.02


def test_rows(spark):
    rows = [(1, None), (1, None), (None, "a b"), (3, ""), (4, "word " * 30000)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, length int")
    found = packing.pack(docs, PATH, 512).collect()
    assert sum(r.length for r in found) == 30001 + 3 + 3 and sum(r.doc_id is None for r in found) == 1
    assert max(r.length for r in found) == 512
    assert packing.pack(docs.limit(0), PATH).count() == 0
