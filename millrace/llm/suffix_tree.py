"""Language-model scores from a probabilistic suffix tree over words.

The tree's states are contexts of up to DEPTH words, or the beginning of the text
and what follows it. A context that occurs CONTEXT times in the training texts is
looked at; it is retained if its next-symbol distribution diverges from that of
its longest retained suffix: by KL of at least LEAST_BITS, and by more than chance
would give. These limits are the same at every size, so the tree grows with the
corpus. A symbol is scored in the longest retained suffix of what precedes it.

Counts are smoothed by the suffix's distribution, the root's being that of single
symbols: it gets DISCOUNT of the count of each symbol seen in the context, and SMOOTH
occurrences besides, so every state's probabilities sum to 1. The
symbols of a state are the VOCABULARY most frequent words that occur FREQUENT times;
all others are one symbol there, which they share in proportion to their root
probability. As a part of contexts every word counts by itself.

All contexts that end in one word are suffixes or extensions of each other. So each
occurrence of a symbol is dealt, with the words before it, by its last word into
buckets of about BUCKET occurrences; there the states are found and the symbols
scored, without the rest of the tree. A context with half a bucket of occurrences is
dealt by the word before it, and so on; its own counts, summed up beforehand, go to
all buckets of its occurrences. No task holds more than some buckets' worth, packed, and
unpacks about half a bucket's worth at a time, by last words; only the vocabulary and the contexts dealt on, of which there are at most 2 ** 21 at
each depth, are sent to all tasks.

Dealt occurrences take more disk than the texts. So they are dealt in ROUNDS: by
the last word, each context and all its occurrences are in one of these, and of a
round only each text's sum is kept.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import cut, field, release, sliced

#: Symbols that a state tells apart at most, and their least count.
VOCABULARY, FREQUENT = 1 << 20, 2
#: Least count of a context; its least divergence in bits.
CONTEXT, LEAST_BITS = 8, 0.01
#: What is taken from the count of each symbol seen in a context and goes to the suffix's distribution; occurrences drawn from that besides.
DISCOUNT, SMOOTH = 0.75, 5.0
#: Words that a context may have.
DEPTH = 4
#: Occurrences in a bucket; there are at most 2 ** 20 buckets, which grow beyond that.
BUCKET, BUCKETS = 1_000_000, 1 << 20
#: Classes of last words, by which a task takes a bucket bit by bit.
CLASSES = 256
#: Rounds in which occurrences are dealt, if there are as many buckets.
ROUNDS = 3
#: Distinct words, or occurrences, that a task gathers before it hands them on.
HELD = 500_000
END = b""
#: In place of a context's word: the beginning of the text, and nothing (no context is that long, or it is too rare).
BEGIN, NONE = (1 << 24) - 3, (1 << 24) - 2


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, then the end."""
    return [*(text or "").encode().lower().split(), END]


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def held_out(docs: DataFrame, id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    for batch in sliced(batches):
        for text in batch.column(0).to_pylist():
            held.update(tokens(text))
            if len(held) > HELD:
                yield _batch({"h": hashes(list(held)), "c": np.fromiter(held.values(), np.int64, len(held))})
                held.clear()
    if held:
        yield _batch({"h": hashes(list(held)), "c": np.fromiter(held.values(), np.int64, len(held))})


def _pack(columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers as bytes: each column's least number, how many bytes its others differ in, and these: all first bytes, all second ones and so on, compressed."""
    least = columns.min(axis=1, initial=(1 << 63) - 1)
    above = columns.view(np.uint64) - least.view(np.uint64)[:, None]
    widths = [(int(most).bit_length() + 7) // 8 for most in above.max(axis=1, initial=0)]
    planes = [(column >> np.uint64(8 * k)).astype(np.uint8).tobytes() for column, width in zip(above, widths, strict=True) for k in range(width)]
    return least.tobytes() + bytes(widths) + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int, columns: int) -> np.ndarray:
    least, widths = np.frombuffer(packed, np.uint64, columns), packed[8 * columns : 9 * columns]
    planes = np.frombuffer(pa.decompress(packed[9 * columns :], n * sum(widths), codec="zstd"), np.uint8)
    above, at = np.zeros((columns, n, 8), np.uint8), 0
    for k, width in enumerate(widths):
        above[k, :, :width] = planes[at : at + n * width].reshape(width, n).T
        at += n * width
    return (above.view(np.uint64).reshape(columns, n) + least[:, None]).view(np.int64)


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts (h, c) as one row for each batch."""
    for batch in batches:
        columns = np.stack([column.to_numpy() for column in batch.columns])
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int32()), pa.array([_pack(columns)], pa.binary())], names=["n", "packed"])


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n, packed in zip(batch["n"].to_pylist(), batch["packed"].to_pylist(), strict=True):
            yield _batch(dict(zip("hc", _unpack(packed, n, 2), strict=True)))


def _search(sorted_: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted values in a sorted array, -1 where absent."""
    if not len(sorted_):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return np.where(sorted_[at] == wanted, at, -1)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two columns of 64 bits (the finalizer of splitmix64)."""
    x = (a.view(np.uint64) + np.uint64(0xD1B54A32D192ED03)) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


class Words:
    """The vocabulary: words numbered in falling order of their count; the number after the last stands for all others."""

    def __init__(self, h: np.ndarray, c: np.ndarray, total: int, kinds: int):
        order = np.lexsort((h, -c))
        by_hash = np.argsort(h[order])
        self.h, self.number = h[order][by_hash], by_hash.astype(np.int64)
        self.c, self.total, self.other = c[order], total, len(h)
        self.size = total + 0.5 * (kinds + 1)
        self.root = np.append(self.c + 0.5, total - self.c.sum() + 0.5 * (kinds - len(h) + 1)) / self.size
        #: By number: whether a context may hold the word. Other words may unless all are rarer than a context must be.
        self.enough = np.append(self.c >= CONTEXT, not len(h) or self.c.min() > CONTEXT)

    def numbers(self, found: np.ndarray) -> np.ndarray:
        """Hashes as numbers, -1 for other words."""
        at = _search(self.h, found)
        return np.where(at >= 0, self.number[at] if len(self.number) else at, -1)


def _floor(histogram: list[tuple[int, int]]) -> int:
    """The least count of a vocabulary word. histogram: (least count of a range, words in it)."""
    words, floor = 0, 1 << 62
    for least, kinds in sorted(histogram, reverse=True):
        words += kinds
        if words > VOCABULARY:
            break
        floor = least
    return max(floor, FREQUENT)


def _words(docs: DataFrame, id_col: str, text_col: str) -> tuple[Words, DataFrame]:
    """The vocabulary, and the counts (h, c) of all words by hash."""
    texts = docs.filter(~held_out(docs, id_col)).select(text_col)
    counted = texts.mapInArrow(count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    counts = cut(counted.mapInArrow(_shrink, "n int, packed binary")).mapInArrow(_restore, "h long, c long")
    ranges = counts.groupBy(F.floor(F.log2("c") * 8).alias("range")).agg(F.min("c").alias("least"), F.count("*").alias("kinds"), F.sum("c").alias("c")).collect()
    total, kinds = sum(r.c for r in ranges), sum(r.kinds for r in ranges)
    found = counts.filter(F.col("c") >= _floor([(r.least, r.kinds) for r in ranges])).toArrow()
    return Words(found["h"].to_numpy(), found["c"].to_numpy(), total, kinds), counts


NUMBERED = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("words", T.BinaryType()), T.StructField("others", T.ArrayType(T.LongType()))]


def _small(words: np.ndarray) -> bytes:
    """Numbers of the vocabulary in three bytes each."""
    return words.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _large(small: bytes) -> np.ndarray:
    low, middle, high = np.frombuffer(small, np.uint8).reshape(-1, 3).T.astype(np.int64)
    words = low | middle << 8 | high << 16
    return np.where(words == 0xFFFFFF, -1, words)


def _numbered(sent):
    """A function for mapInArrow: each text's NUMBERED columns in place of the text, which comes last. base lacks the other words, whose hashes are in others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Words = sent.value
        log = np.log10(v.root)
        for batch in sliced(batches):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for text in batch.column(batch.num_columns - 1).to_pylist():
                found = hashes(tokens(text))
                words = v.numbers(found)
                known = words[words >= 0]
                for out, value in zip(rows, (len(found), len(known), float(log[known].sum()), _small(words), found[words < 0]), strict=True):
                    out.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x, k) for x, k in zip(rows, kinds, strict=True))], names=[*batch.schema.names[:-1], *(f.name for f in NUMBERED)])

    return run


class Hot:
    """The contexts that are dealt on by the word before them, each with its words (the last first) and its count."""

    def __init__(self, total: int, rounds: int = 1):
        self.piece = max(BUCKET, total // BUCKETS)
        self.rounds = max(1, min(rounds, -(-total // self.piece)))
        #: Of a round.
        self.buckets = max(1, -(-total // (self.piece * self.rounds)))
        self.least = max(1, self.piece // 2)
        self.known: dict[int, tuple[tuple[int, ...], int]] = {}
        self.sort()

    def sort(self) -> None:
        self.s = np.array(sorted(self.known), np.int64)
        self.parts = np.array([self.known[s][1] // self.least + 1 for s in self.s.tolist()] or [1], np.int64)

    def targets(self, words: tuple[int, ...]) -> set[int]:
        """The buckets that hold occurrences of a hot context."""
        found: set[int] = set()
        for s, parts in zip(self.s.tolist(), self.parts.tolist(), strict=False):
            if self.known[s][0][: len(words)] == words:
                found.update((s % self.buckets + x) % self.buckets for x in range(min(parts, self.buckets)))
        return found


def _occurrences(v: Words, depth: int, batch: pa.RecordBatch, turn: int = 0, rounds: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every symbol of a batch's texts (words, others) that has a context in this turn of the rounds: those words, the last first; its number; its text's place in the batch."""
    texts = batch.column("words").to_pylist()
    lengths = np.array([len(x) // 3 for x in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    flat = _large(b"".join(texts))
    own = np.where(v.enough[flat], flat, NONE)
    if v.enough[-1]:
        own[flat < 0] = batch.column("others").flatten().to_numpy(zero_copy_only=False) | np.int64(-(1 << 63))
    last = np.empty(len(flat) if depth else 0, np.int64)
    last[1:] = own[: max(len(last) - 1, 0)]
    last[starts[: len(last)]] = BEGIN  # every text has its end at least
    places = np.flatnonzero((last != NONE) & (last % rounds == turn))
    text = np.searchsorted(starts, places, "right") - 1
    at = places - starts[text]
    before = np.empty((depth, len(places)), np.int64)
    ended = np.zeros(len(places), bool)
    for d in range(depth):
        before[d] = own[np.maximum(places - d - 1, 0)] if d else last[places]
        before[d, at == d] = BEGIN
        ended |= (at < d) | (before[d] == NONE)
        before[d, ended] = NONE
    symbols = flat[places]
    return before, np.where(symbols < 0, v.other, symbols), text


def _contexts(before: np.ndarray) -> list[np.ndarray]:
    """By depth, the hash of every occurrence's context."""
    found, s = [], np.zeros(before.shape[1], np.int64)
    for words in before:
        s = _mix(s, words)
        found.append(s)
    return found


def _levels(hot: Hot, before: np.ndarray, contexts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How many of each occurrence's contexts are hot, from the shortest on, and the place of the longest of these (-1: none)."""
    level, place = np.zeros(before.shape[1], np.int64), np.full(before.shape[1], -1, np.int64)
    for d, s in enumerate(contexts):
        at = _search(hot.s, s)
        more = (level == d) & (at >= 0) & (before[d] != NONE)
        level[more], place[more] = d + 1, at[more]
    return level, place


def _longer(sent, depth: int):
    """A function for mapInArrow: counts of the contexts (s, its words) of depth whose suffixes are all hot.

    Those too rare to be hot are dropped on the way (lossy counting), so what is
    left doesn't grow with the texts. All tasks' counts of a context lack a tenth
    of Hot.least at most; they only decide where occurrences are dealt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, hot = sent.value
        share, seen = hot.least / (10 * max(v.total, 1)), 0
        s, c, missed, words = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty((depth, 0), np.int64)
        for batch in sliced(batches):
            before, _, _ = _occurrences(v, depth, batch)
            contexts = _contexts(before)
            level, _ = _levels(hot, before[: depth - 1], contexts[: depth - 1])
            wanted = np.flatnonzero((level == depth - 1) & (before[-1] != NONE))
            s, first, owner = np.unique(np.concatenate([s, contexts[-1][wanted]]), return_index=True, return_inverse=True)
            c = np.bincount(owner, np.concatenate([c, np.ones(len(wanted))]), len(s)).astype(np.int64)
            missed = np.concatenate([missed, np.full(len(wanted), share * seen)])[first]  # at most so many before
            words = np.concatenate([words, before[:, wanted]], axis=1)[:, first]
            seen += before.shape[1]
            some = c + missed > share * seen
            s, c, missed, words = s[some], c[some], missed[some], words[:, some]
        yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(list(words.T), pa.list_(pa.int64())), pa.array(c)], names=["s", "words", "c"])

    return run


#: Counts of a hot context's symbols (packed columns of these and their counts), in parts by symbol.
COUNTED = "s long, part int, n int, packed binary"


def _counted(hot: Hot, keys: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    """Counts as COUNTED. keys: place of the hot context and symbol."""
    place, w = keys >> 32, keys & 0xFFFFFFFF
    found, owner = np.unique((place << 32) | w % hot.parts[place], return_inverse=True)
    parts = np.split(np.argsort(owner, kind="stable"), np.cumsum(np.bincount(owner))[:-1])
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    columns = (hot.s[found >> 32], found & 0xFFFFFFFF, [len(p) for p in parts], [_pack(np.stack([w[p], c[p]])) for p in parts])
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["s", "part", "n", "packed"])


def _continuations(sent, depth: int, turn: int):
    """A function for mapInArrow: COUNTED of the (hot context, symbol) of a round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, hot = sent.value
        keys, c = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in sliced(batches):
            before, symbols, _ = _occurrences(v, depth, batch, turn, hot.rounds)
            contexts = _contexts(before)
            level, _ = _levels(hot, before, contexts)
            found = [(_search(hot.s, s[level > d]) << 32) | symbols[level > d] for d, s in enumerate(contexts)]
            counts = np.concatenate([c, np.ones(sum(map(len, found)), np.int64)])
            keys, owner = np.unique(np.concatenate([keys, *found]), return_inverse=True)
            c = np.bincount(owner, counts, len(keys)).astype(np.int64)
            if len(keys) > HELD:
                yield _counted(hot, keys, c)
                keys, c = keys[:0], c[:0]
        if len(keys):
            yield _counted(hot, keys, c)

    return run


#: Occurrences of a bucket: packed columns of the words before, the symbol, the text's row (-1: summed up beforehand), the count, and the hot suffixes.
DEALT, EXTRA = "bucket int, n int, packed binary", 4


def _dealt(buckets: np.ndarray, columns: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(buckets, kind="stable")
    found, starts = np.unique(buckets[order], return_index=True)
    parts = np.split(order, starts[1:]) if len(found) else []
    return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array([len(p) for p in parts], pa.int32()), pa.array([_pack(columns[:, p]) for p in parts], pa.binary())], names=["bucket", "n", "packed"])


def _deal(sent, depth: int, turn: int = 0):
    """A function for mapInArrow: numbered texts (row, held_out, words, others) as DEALT occurrences of a round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, hot = sent.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def dealt() -> pa.RecordBatch:
            buckets, columns = np.concatenate([b for b, _ in held]), np.concatenate([c for _, c in held], axis=1)
            held.clear()
            return _dealt(buckets, columns)

        for batch in sliced(batches):
            before, symbols, text = _occurrences(v, depth, batch, turn, hot.rounds)
            row = batch.column("row").to_numpy()[text]
            learned = (~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool))[text].astype(np.int64)
            contexts = _contexts(before)
            level, place = _levels(hot, before, contexts)
            bucket = contexts[0] % hot.buckets if depth else row
            for d in range(1, depth + 1):
                at = np.flatnonzero(level == d)
                spread = _mix(row[at], np.arange(len(at)))
                if d < depth:
                    spread = np.where(before[d, at] == NONE, spread, contexts[d][at])
                bucket[at] = (contexts[d - 1][at] % hot.buckets + spread % np.minimum(hot.parts[place[at]], hot.buckets)) % hot.buckets
            held.append((bucket, np.concatenate([before, [symbols, row, learned, level]])))
            size += len(bucket)
            del before, symbols, text, row, learned, contexts, level, place, bucket
            if size > HELD:
                yield dealt()
                size = 0
        if size:
            yield dealt()

    return run


def _spread(sent, depth: int):
    """A function for applyInArrow: a part of a hot context's COUNTED, summed up, as DEALT columns for all buckets that need it."""

    def run(group: pa.Table) -> pa.Table:
        _, hot = sent.value
        words = hot.known[group["s"][0].as_py()][0]
        w, c = np.concatenate([_unpack(packed.as_py(), n.as_py(), 2) for n, packed in zip(group["n"], group["packed"], strict=True)], axis=1)
        w, owner = np.unique(w, return_inverse=True)
        columns = np.full((depth + EXTRA, len(w)), NONE, np.int64)
        columns[: len(words)] = np.array(words)[:, None]
        columns[depth], columns[depth + 1], columns[depth + 2], columns[depth + 3] = w, -1, np.bincount(owner, c), len(words) - 1
        packed, to = _pack(columns), sorted(hot.targets(words))
        return pa.table({"bucket": pa.array(to, pa.int32()), "n": pa.array([len(w)] * len(to), pa.int32()), "packed": pa.array([packed] * len(to), pa.binary())})

    return run


def _diverges(bits: np.ndarray, n: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Whether the divergence is large, and more than that of n draws from the suffix's own distribution."""
    freedom = listed + 1
    return (bits >= LEAST_BITS) & (2 * math.log(2) * n * bits > freedom + 4 * np.sqrt(2 * freedom))


def probabilities(before: np.ndarray, symbols: np.ndarray, counts: np.ndarray, first: np.ndarray, last: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Each occurrence's probability in its longest retained context.

    An occurrence adds its count to its contexts longer than first and no longer than last.
    """
    low = root[symbols]
    live, contexts = np.arange(len(symbols)), np.zeros(len(symbols), np.int64)
    for d, words in enumerate(before):
        some = words[live] != NONE
        live = live[some]
        if not len(live):
            break
        contexts = _mix(contexts[some], words[live])
        weight = np.where((first[live] <= d) & (last[live] > d), counts[live], 0)
        s, owner = np.unique(contexts, return_inverse=True)
        n = np.bincount(owner, weight, len(s))
        some = n[owner] >= CONTEXT
        live, contexts, weight, owner = live[some], contexts[some], weight[some], owner[some]
        pairs, at, pair = np.unique((owner << 32) | symbols[live], return_index=True, return_inverse=True)
        of, under, c = pairs >> 32, low[live][at], np.bincount(pair, weight, len(pairs))
        seen = c > 0
        listed, mass = np.bincount(of, seen, len(s)), np.bincount(of, np.where(seen, under, 0.0), len(s))
        unseen = (DISCOUNT * listed + SMOOTH) / (n + SMOOTH)
        own = np.maximum(c - DISCOUNT, 0) / (n[of] + SMOOTH) + unseen[of] * under
        bits = np.bincount(of, np.where(seen, own * np.log2(own / under), 0.0), len(s)) + np.maximum(1 - mass, 0) * unseen * np.log2(unseen)
        kept = _diverges(bits, n, listed)[owner]
        low[live[kept]] = own[pair[kept]]
    return low


def _summed(row: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, at = np.unique(row, return_inverse=True)
    return rows, np.bincount(at, gain, len(rows)).astype(float)


def _shares(parts: list[np.ndarray], most: int) -> list[tuple[int, int]]:
    """Ranges of classes that hold most occurrences at most, or are one class. parts: the classes of occurrences."""
    shares, size = [(0, 0)], 0
    for k, n in enumerate(sum(np.bincount(part, minlength=CLASSES) for part in parts).tolist()):
        if size and size + n > most:
            shares.append((k, k))
            size = 0
        shares[-1], size = (shares[-1][0], k + 1), size + n
    return shares


def _part(bucket: list[tuple[int, bytes]], depth: int, most: int) -> Iterator[np.ndarray]:
    """The columns of a bucket's occurrences, about most at a time, all of a last word together. bucket: packed columns, which are unpacked for each time again."""

    def unpacked():
        return (_unpack(packed, n, depth + EXTRA) for n, packed in bucket)

    if sum(n for n, _ in bucket) <= most:
        yield np.concatenate(list(unpacked()), axis=1)
        return
    classes = [(_mix(columns[0], columns[0]).view(np.uint64) % np.uint64(CLASSES)).astype(np.uint8) for columns in unpacked()]
    for low, high in _shares(classes, most):
        yield np.concatenate([columns[:, (of >= low) & (of < high)] for of, columns in zip(classes, unpacked(), strict=True)], axis=1)


def _scorer(sent, depth: int):
    """A function for applyInArrow: by row, what a bucket's states add to the root's log10 probabilities."""

    def run(group: pa.Table) -> pa.Table:
        v, hot = sent.value
        rows, gains = np.empty(0, np.int64), np.empty(0)
        for columns in _part(list(zip(group["n"].to_pylist(), group["packed"].to_pylist(), strict=True)), depth, hot.least):
            before, (symbols, row, counts, first) = columns[:depth], columns[depth:]
            last = np.where(row < 0, first + 1, depth)
            gain = np.log10(probabilities(before, symbols, counts, first, last, v.root) / v.root[symbols])
            some = np.flatnonzero((row >= 0) & (gain != 0))
            rows, gains = _summed(np.concatenate([rows, row[some]]), np.concatenate([gains, gain[some]]))
        return pa.table({"row": rows, "gain": gains})

    return run


def _handed(sent, depth: int):
    """A function for applyInArrow: what _scorer finds, as packed columns (row, bits of the gain) in as many classes of rows as there are buckets."""
    scored = _scorer(sent, depth)

    def run(group: pa.Table) -> pa.Table:
        rows, gains = (column.to_numpy() for column in scored(group).columns)
        return pa.Table.from_batches([_dealt(rows % sent.value[1].buckets, np.stack([rows, gains.view(np.int64)]))])

    return run


def _totals(group: pa.Table) -> pa.Table:
    """For applyInArrow: the sums (row, gain) of a class of rows, from what all buckets handed on."""
    parts = [_unpack(packed.as_py(), n.as_py(), 2) for n, packed in zip(group["n"], group["packed"], strict=True)]
    rows, gains = np.concatenate(parts, axis=1)
    rows, gains = _summed(rows, gains.view(np.float64))
    return pa.table({"row": rows, "gain": gains})


def _find_hot(v: Words, texts: DataFrame, depth: int, rounds: int = 1) -> Hot:
    """The hot contexts. texts: numbered training texts."""
    hot = Hot(v.total, rounds)
    context = texts.sparkSession.sparkContext
    end = v.numbers(hashes([END]))[0]
    one = [(n, c) for n, c in enumerate(v.c.tolist()) if c >= hot.least and v.enough[n] and n != end]
    if end >= 0 and v.c[end] >= hot.least:
        one.append((BEGIN, int(v.c[end])))  # as many texts begin as end
    ids = np.array([n for n, _ in one], np.int64)
    new = {s: ((n,), c) for s, (n, c) in zip(_mix(np.zeros(len(ids), np.int64), ids).tolist(), one, strict=True)} if depth else {}
    for d in range(2, depth + 2):
        hot.known |= new
        hot.sort()
        if not new or d > depth:
            break
        sent = context.broadcast((v, hot))
        found = texts.mapInArrow(_longer(sent, d), "s long, words array<long>, c long").groupBy("s", "words").agg(F.sum("c").alias("c"))
        new = {r.s: (tuple(r.words), r.c) for r in found.filter(F.col("c") >= hot.least).collect()}
        sent.unpersist()
    return hot


def _gains(numbered: DataFrame, texts: DataFrame, sent, depth: int, turn: int) -> DataFrame:
    """By row, what a round's states add to the root's log10 probabilities; computed, so that the dealt occurrences can go."""
    _, hot = sent.value
    dealt = numbered.select("row", "held_out", "words", "others").mapInArrow(_deal(sent, depth, turn), DEALT)
    if hot.known:
        counted = texts.mapInArrow(_continuations(sent, depth, turn), COUNTED)
        dealt = dealt.union(counted.groupBy("s", "part").applyInArrow(_spread(sent, depth), DEALT))
    handed = dealt.repartition(hot.buckets, "bucket").groupBy("bucket").applyInArrow(_handed(sent, depth), DEALT)
    return cut(handed.groupBy("bucket").applyInArrow(_totals, "row long, gain double"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from rows whose crc32 of the id as text isn't 1 modulo 5;
    a null id counts as an empty text there. depth: words that a context may
    have. A null or empty text is its end alone. Repeated rows are learned from
    and scored each. With nothing to learn from, every symbol is unknown. Other
    columns are ignored. An empty table gives an empty table.
    """
    context = docs.sparkSession.sparkContext
    v, counts = _words(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), held_out(docs, id_col).alias("held_out"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", field(docs, id_col).dataType), T.StructField("held_out", T.BooleanType()), *NUMBERED])
    numbered = cut(rows.mapInArrow(_numbered(context.broadcast(v)), schema).withColumn("row", F.monotonically_increasing_id()))
    texts = numbered.filter(~F.col("held_out")).select("words", "others")
    hot = _find_hot(v, texts, depth, ROUNDS if depth else 1)
    sent = context.broadcast((v, hot))
    gains = None
    for turn in range(hot.rounds):
        release(docs.sparkSession)
        found = _gains(numbered, texts, sent, depth, turn)
        gains = gains.union(found) if gains else found
    release(docs.sparkSession)
    c = F.coalesce("c", F.lit(0))
    rare = counts.filter(F.col("c") < int(v.c[-1])) if v.other else counts
    others = numbered.select("row", F.explode("others").alias("h")).join(rare, "h", "left")
    more = others.groupBy("row").agg(F.sum(F.log10((c + 0.5) / F.lit(v.size))).alias("more"), F.sum((c > 0).cast("long")).alias("known"))
    plain = numbered.select("row", "id", "held_out", "n_tokens", "n_known", "base")
    both = plain.join(more, "row", "left").join(gains.groupBy("row").agg(F.sum("gain").alias("gain")), "row", "left")
    base = F.col("base") + F.coalesce("more", F.lit(0.0))
    return both.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )
