import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import suffix_tree as st

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def symbols(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), ""]


def is_held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def plain_base(rows):
    counts = Counter(s for i, t in rows if not is_held(i) for s in symbols(t))
    total, size = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    return [(i, is_held(i), len(symbols(t)), sum(counts[s] > 0 for s in symbols(t)), total, sum(math.log10((counts[s] + 0.5) / size) for s in symbols(t))) for i, t in rows]


def compare(found, rows):
    want = sorted(plain_base(rows), key=str)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found), key=str)
    assert [g[:5] for g in sorted(got, key=lambda x: str(x[:5]))] == [w[:5] for w in sorted(want, key=lambda x: str(x[:5]))]
    assert sorted(g[5] for g in got) == pytest.approx(sorted(w[5] for w in want), abs=1e-6)


def test_rows(spark):
    rows = [(1, "A b É é"), (None, "a\tb  c"), (2, None), (3, ""), (3, ""), (9, "new words only"), (10, "b " * 5000), (7, "x\x1cy a")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, score string, row int")
    compare(st.score(docs).collect(), rows)
    assert st.score(docs.limit(0)).count() == 0
    held = next(i for i in range(99) if is_held(i))
    only = st.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()[0]
    assert (only.train_tokens, only.n_known, only.base_score, only.score) == (0, 0, 0.0, 0.0)


def plain_model(rows, depth):
    """The root's and all states' probabilities by dictionaries of contexts, which are tuples of words; None is what is not in the vocabulary."""
    train = [symbols(t) for i, t in rows if not is_held(i)]
    counts = Counter(s for t in train for s in t)
    total = sum(counts.values())
    size = total + 0.5 * (len(counts) + 1)
    ranges = {}
    for c in counts.values():
        ranges.setdefault(math.floor(math.log2(c) * 8), []).append(c)
    floor = st._floor([(min(r), len(r)) for r in ranges.values()])
    vocabulary = {w for w, c in counts.items() if c >= floor}
    root = {w: (counts[w] + 0.5) / size for w in vocabulary}
    root[None] = 1 - sum(root.values())

    def contexts(t, i):
        """Before the symbol at i, of one word, two and so on; with the beginning as far as it is near enough."""
        whole = (*(["<begin>"] if i < depth else []), *t[max(i - depth, 0) : i])
        return [whole[-n:] for n in range(1, min(depth, len(whole)) + 1)]

    follow = {}
    for t in train:
        for i, w in enumerate(t):
            for context in contexts(t, i):
                follow.setdefault(context, Counter())[w if w in vocabulary else None] += 1
    occurs = {s: sum(f.values()) for s, f in follow.items()}
    states = {}

    def share(s):
        return (st.DISCOUNT * len(follow[s]) + st.SMOOTH) / (occurs[s] + st.SMOOTH)

    def smoothed(s, c, low):
        return (c - st.DISCOUNT if c else 0) / (occurs[s] + st.SMOOTH) + share(s) * low

    def probability(s, w):
        """Of a symbol in the longest retained suffix."""
        if not s:
            return root[w]
        low = probability(s[1:], w)
        return smoothed(s, follow[s][w], low) if s in states else low

    for s in sorted((s for s, n in occurs.items() if n >= st.CONTEXT), key=len):
        f, n = follow[s], occurs[s]
        low = {w: probability(s[1:], w) for w in f}
        own = {w: smoothed(s, c, low[w]) for w, c in f.items()}
        bits = sum(p * math.log2(p / low[w]) for w, p in own.items()) + (1 - sum(low.values())) * share(s) * math.log2(share(s))
        free = len(own) + 1
        if bits >= st.LEAST_BITS and 2 * math.log(2) * n * bits > free + 4 * math.sqrt(2 * free):
            states[s] = True

    def word(t, i, w):
        symbol = w if w in vocabulary else None
        p = probability(contexts(t, i)[-1] if depth else (), symbol)
        return p if symbol is not None else p / root[None] * (counts[w] + 0.5) / size

    return word, states, counts


def invented():
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["the big red fox jumps far", "the big red hen sits down", "rare%d big red cat" % i, "x y", "one m n o first", "two m n o second"]) for _ in range(20)) for i in range(80)]
    return [(10_000 + i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("bucket, vocabulary", [(1_000_000, 1 << 20), (150, 1 << 20), (40, 12)])
def test_against_dictionaries(spark, bucket, vocabulary, monkeypatch):
    """In one bucket; with hot contexts of every depth dealt on; and with a small vocabulary too."""
    monkeypatch.setattr(st, "BUCKET", bucket)
    monkeypatch.setattr(st, "VOCABULARY", vocabulary)
    rows = invented()
    if bucket > 1000:
        rows += [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for depth in (1, 4) if bucket > 1000 else (0, 2, 4):
        found = {r.doc_id: r.score for r in st.score(table, depth=depth).collect()}
        word, states, _ = plain_model(rows, depth)
        assert depth < 4 or vocabulary < 100 or max(map(len, states)) == 4  # "one m n o first" needs four words
        want = [sum(math.log10(word(t, i, w)) for i, w in enumerate(t)) for t in (symbols(t) for _, t in rows)]
        assert [found[i] for i, _ in rows] == pytest.approx(want, rel=1e-9, abs=1e-6)


def test_hot_contexts_are_dealt_on(spark, monkeypatch):
    """No bucket holds much more than its share, though two words follow each other in a third of all places."""
    monkeypatch.setattr(st, "BUCKET", 200)
    docs = spark.createDataFrame([*invented(), *((i, "a b " * 10 + f"u{i}") for i in range(150))], "doc_id long, text string")
    v, _ = st._words(docs, "doc_id", "text")
    numbered = docs.select(st.held_out(docs, "doc_id").alias("held_out"), "text").mapInArrow(st._numbered(spark.sparkContext.broadcast(v)), st.T.StructType([st.T.StructField("held_out", st.T.BooleanType()), *st.NUMBERED]))
    numbered = numbered.withColumn("row", st.F.monotonically_increasing_id()).select("row", "held_out", "words", "others")
    hot = st._find_hot(v, numbered.filter("not held_out").select("words", "others"), 4)
    assert {len(words) for words, _ in hot.known.values()} == {1, 2, 3, 4}
    dealt = numbered.mapInArrow(st._deal(spark.sparkContext.broadcast((v, hot)), 4), st.DEALT).groupBy("bucket").agg(st.F.sum("n").alias("n"))
    sizes = [r.n for r in dealt.collect()]
    assert max(sizes) < 5 * hot.piece  # each of the two words alone is followed by seven pieces


def test_rounds_deal_everything_once(spark, monkeypatch):
    """Each of the rounds deals about a third, all occurrences of a word in one; together they deal what one round would."""
    monkeypatch.setattr(st, "BUCKET", 200)
    docs = spark.createDataFrame(invented(), "doc_id long, text string")
    v, _ = st._words(docs, "doc_id", "text")
    numbered = docs.select(st.held_out(docs, "doc_id").alias("held_out"), "text").mapInArrow(st._numbered(spark.sparkContext.broadcast(v)), st.T.StructType([st.T.StructField("held_out", st.T.BooleanType()), *st.NUMBERED]))
    numbered = numbered.withColumn("row", st.F.monotonically_increasing_id()).select("row", "held_out", "words", "others")
    texts = numbered.filter("not held_out").select("words", "others")

    def dealt(hot, turn):
        rows = numbered.mapInArrow(st._deal(spark.sparkContext.broadcast((v, hot)), 4, turn), st.DEALT).collect()
        return Counter(tuple(x) for r in rows for x in st._unpack(r.packed, r.n, 4 + st.EXTRA)[:-1].T.tolist())

    whole = dealt(st._find_hot(v, texts, 4), 0)
    hot = st._find_hot(v, texts, 4, st.ROUNDS)
    parts = [dealt(hot, turn) for turn in range(hot.rounds)]
    assert hot.rounds == 3 and sum(parts, Counter()) == whole
    assert sum(len({x[0] for x in p}) for p in parts) == len({x[0] for x in whole})
    assert max(p.total() for p in parts) < 0.5 * whole.total()


def test_a_bucket_is_scored_bit_by_bit(monkeypatch):
    """A bucket of many pieces' worth takes less memory than its columns, and has the gains of the whole."""
    monkeypatch.setattr(st, "BUCKET", 20_000)
    rng, n = np.random.default_rng(3), 300_000
    before, symbols = rng.integers(0, 40, (4, n)), rng.integers(0, 40, n)
    before[0] += 40 * rng.integers(0, 50, n)
    row = np.arange(n) // 100
    columns = np.concatenate([before, [symbols, row, np.ones(n, int), np.zeros(n, int)]])
    v, hot = st.Words(np.arange(2000), np.full(2000, n // 2000), n, 2000), st.Hot(n)
    group = pa.Table.from_batches([st._dealt(np.zeros(n // 30, int), part) for part in np.split(columns, 30, axis=1)])

    class Sent:
        value = (v, hot)

    tracemalloc.start()
    found = st._scorer(Sent, 4)(group)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    gain = np.log10(st.probabilities(before, symbols, np.ones(n, int), np.zeros(n, int), np.full(n, 4), v.root) / v.root[symbols])
    assert peak < columns.nbytes
    assert dict(zip(found["row"].to_pylist(), found["gain"].to_pylist(), strict=True)) == pytest.approx(dict(enumerate(np.bincount(row, gain).tolist())), rel=1e-9, abs=1e-9)


def test_gains_are_handed_on_packed(monkeypatch):
    """A bucket has a row for each class of texts, whatever the number of texts, and their sums are the gains of all buckets."""
    monkeypatch.setattr(st, "BUCKET", 2000)
    rng, n = np.random.default_rng(4), 6000
    before = rng.integers(0, 9, (4, n))
    columns = np.concatenate([before, [(before[0] + 1) % 9, np.arange(n) // 3 << 33 | np.arange(n) % 3, np.ones(n, int), np.zeros(n, int)]])
    v, hot = st.Words(np.arange(9), np.full(9, n // 9), n, 9), st.Hot(n)
    groups = [pa.Table.from_batches([st._dealt(np.full(n // 2, k), part)]) for k, part in enumerate(np.split(columns, 2, axis=1))]

    class Sent:
        value = (v, hot)

    want = Counter()
    for group in groups:
        found = st._scorer(Sent, 4)(group)
        want.update(dict(zip(found["row"].to_pylist(), found["gain"].to_pylist(), strict=True)))
    handed = [st._handed(Sent, 4)(group) for group in groups]
    assert hot.buckets == 3 and len(want) > 1000 and all(h.num_rows <= hot.buckets for h in handed)
    both = pa.concat_tables(handed)
    classes = [st._totals(both.filter(pa.array([b == k for b in both["bucket"].to_pylist()]))) for k in range(hot.buckets)]
    got = [pair for t in classes for pair in zip(t["row"].to_pylist(), t["gain"].to_pylist(), strict=True)]
    assert len(got) == len(want) and dict(got) == pytest.approx(dict(want), rel=1e-12)


def test_counts_of_hot_contexts_are_handed_on_packed(spark, monkeypatch):
    """A task has a row for each part of a hot context, and no count is lost."""
    monkeypatch.setattr(st, "BUCKET", 200)
    docs = spark.createDataFrame(invented(), "doc_id long, text string").coalesce(1)
    v, _ = st._words(docs, "doc_id", "text")
    texts = docs.filter(~st.held_out(docs, "doc_id")).select("text").mapInArrow(st._numbered(spark.sparkContext.broadcast(v)), st.T.StructType(st.NUMBERED)).select("words", "others")
    hot = st._find_hot(v, texts, 4)
    rows = texts.mapInArrow(st._continuations(spark.sparkContext.broadcast((v, hot)), 4, 0), st.COUNTED).collect()
    sums = Counter()
    for r in rows:
        sums[r.s] += int(st._unpack(r.packed, r.n, 2)[1].sum())
    assert len(rows) == len({(r.s, r.part) for r in rows}) <= hot.parts.sum()
    one = {s: c for s, (words, c) in hot.known.items() if len(words) == 1}
    assert one and {s: sums[s] for s in one} == one


def test_rare_contexts_are_dropped_on_the_way(spark, monkeypatch):
    """Of all the pairs after hot words few are handed on, and all that are hot."""
    monkeypatch.setattr(st, "BUCKET", 4000)
    docs = spark.createDataFrame([(i, "a b " * 30 + " ".join(f"a u{i * k % 701}" for k in range(60))) for i in range(400)], "doc_id long, text string").coalesce(1)
    v, _ = st._words(docs, "doc_id", "text")
    numbered = docs.select("text").mapInArrow(st._numbered(spark.sparkContext.broadcast(v)), st.T.StructType(st.NUMBERED)).select("words", "others").coalesce(1)
    hot = st.Hot(v.total)
    a, b = (int(x) for x in v.numbers(st.hashes([b"a", b"b"])))
    hot.known = {int(st._mix(st.np.zeros(1, int), st.np.array([n]))[0]): ((n,), int(v.c[n])) for n in (a, b)}
    hot.sort()
    found = numbered.mapInArrow(st._longer(spark.sparkContext.broadcast((v, hot)), 2), "s long, words array<long>, c long").collect()
    assert {(a, b), (b, a)} <= {tuple(r.words) for r in found if r.c >= hot.least}
    assert len(found) < 20


def test_probabilities_sum_to_one():
    """In every context, over all known words and one unknown."""
    word, states, counts = plain_model(invented(), 4)
    for s in [*states, ("fox", "x"), ("never",)]:
        before = s[1:] if s[0] == "<begin>" else (*"wxyz", *s)
        assert sum(word(before, len(before), w) for w in [*counts, "never"]) == pytest.approx(1, abs=1e-9)


def test_query(spark):
    from millrace.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = QUERIES["op6_suffix_tree"](spark, sf).collect()
    compare(found, rows)
    held = [r for r in found if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.1
    assert sum(r.score > r.base_score for r in held if r.n_tokens > 50) > 0.9 * sum(r.n_tokens > 50 for r in held)
