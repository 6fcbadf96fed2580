import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import sentence_spans as sp

LAST = (1 << 63) - 1


def plain_units(text):
    """(words, place) of each unit, word by word."""
    found = [(m[0], m.start()) for m in sp.WORD.finditer(text)]
    sentences, now = [], []
    for k, (w, at) in enumerate(found):
        now.append((w, at))
        if sp.END.search(w) or k + 1 == len(found) or "\n" in text[at : found[k + 1][1]]:
            sentences.append(now)
            now = []
    out = []
    for s in sentences:
        h = [xxhash.xxh3_64_intdigest(w) for w, _ in s]
        cuts = [i for i in range(3, len(s) - 3) if len(s) > 10 and h[i] < min(h[i - 3 : i] + h[i + 1 : i + 4])]
        for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True):
            out.append((tuple(w for w, _ in s[a:b]), s[a][1]))
    return out


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text("ab .!?\n\t日。\x1c)", max_size=200), st.lists(st.text("abcdefg", min_size=1, max_size=2), max_size=80).map(" ".join)))
def test_units(text):
    h, starts = sp.units(text)
    want = plain_units(text)
    assert [len(w) for w, _ in want] == np.diff(np.append(starts, len(h))).tolist()
    hashes, first, stop = sp.runs(text)
    by_words = {}
    for x, a, b in zip(hashes, first, stop, strict=True):
        words = tuple(w for u, _ in want[a:b] for w in u)
        assert len(words) >= 12 and b - a >= 3 and (b - a == 3 or sum(len(u) for u, _ in want[a : b - 1]) < 12)
        assert by_words.setdefault(x, words) == words


def plainly(rows):
    """The texts that stay, from the definition, all runs in one dictionary."""
    docs = sorted({(LAST if i is None else i, (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t, seed=42)), t) for i, t in rows if t is not None})
    first, out = {}, {}
    for doc, _, text in docs:
        found, gone = plain_units(text), set()
        words = [w for w, _ in found]
        for a in range(len(found)):
            for b in range(a + 3, len(found) + 1):
                if sum(map(len, words[a:b])) >= 12:
                    key = tuple(w for u in words[a:b] for w in u)
                    if first.setdefault(key, (doc, text, a)) != (doc, text, a):
                        gone.update(range(a, b))
                    break
        edges = [0, *(at for _, at in found[1:]), len(text)]
        out[doc, text] = "".join(text[edges[k] : edges[k + 1]] for k in range(len(found)) if k not in gone) if gone else text
    return out


def compare(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, hash string, start int")
    found = sp.remove_repeats(docs).collect()
    want = plainly(rows)
    assert sorted((str(r.doc_id), str(r.text)) for r in found) == sorted((str(i), str(t if t is None else want[LAST if i is None else i, t])) for i, t in rows)
    return {r.doc_id: r for r in found}


def sentence(rng, n):
    return " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(n)).capitalize() + "."


def test_pasted_passages_are_found(spark):
    """Passages of over 50 words, pasted anywhere, even within sentences."""
    rng = random.Random(5)
    for size in (4, 15, 60):
        passages = [" ".join(sentence(rng, size) for _ in range(60 // size)) for _ in range(20)]
        rows = []
        for i in range(100):
            host = " ".join(sentence(rng, rng.randrange(1, 25)) for _ in range(12)).split()
            at = rng.randrange(len(host))
            rows.append((i, " ".join([*host[:at], passages[i % 20], *host[at:]])))
        found = compare(spark, rows)
        assert all(r.removed_words == 0 for i, r in found.items() if i < 20)
        assert all(20 <= r.removed_words <= 60 for i, r in found.items() if i >= 20)


def test_rows(spark):
    rng = random.Random(6)
    text = " ".join(sentence(rng, 6) for _ in range(9))
    rows = [(1, text), (2, text + "\nOwn end."), (2, text + "\nOwn end."), (None, text), (3, None), (4, ""), (5, " \n"), (6, "One. Two. Three."), (7, "One. Two. Three."), (8, "Same words all the time. " * 2000), (1, "other text of id one")]
    found = compare(spark, rows)
    assert found[2].text == "Own end." and found[None].text == ""
    assert sp.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    from millrace.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plainly(rows)
    found = QUERIES["op5_sentence_spans"](spark, sf).collect()
    assert sorted((r.doc_id, r.text) for r in found) == sorted((i, want[i, t]) for i, t in rows)
    assert sum(r.n_removed for r in found) > 20
