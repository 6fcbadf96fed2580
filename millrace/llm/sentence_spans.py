"""Removing repeated passages: hashes of sliding runs of sentences.

Every run of several consecutive sentences is hashed, the hashes are joined over
all documents, and sentences covered by a run that isn't its hash's first are
removed. A passage that was pasted into a sentence shares no whole sentence at
its edges, or none at all if it is one long sentence. So a sentence of more than
LONG words counts as several: it is cut before each word whose hash is less than
those of the three words on either side. Such cuts depend on the words nearby
only, and so fall alike in every copy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import sliced

#: Sentences in a run, and words that it has at least (else it takes in further sentences).
RUN, WORDS = 3, 12
#: Sentences of more words are cut; REACH words on each side are looked at.
LONG, REACH = 10, 3
LAST = (1 << 63) - 1

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A word that ends a sentence ends so; so does the last word of a line.
END = re.compile(r"[.!?…。！？][\"'”»)\]]*\Z")
CLOSING = frozenset(".!?…。！？\"'”»)]")
BASE = 0x9E3779B97F4A7C15


@lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        factors = np.full(size, base, np.uint64)
        factors[:1] = 1
        out.append(np.multiply.accumulate(factors))
    return out[0], out[1]


def units(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of a text's words, and the numbers of the words that begin a sentence or part of one."""
    words: list[str] = []
    ends: list[int] = []
    for line in text.split("\n"):
        if found := WORD.findall(line):
            at = len(words) + 1
            ends += [i for i, w in enumerate(found, at) if w[-1] in CLOSING and END.search(w)]
            words += found
            if not ends or ends[-1] != len(words):
                ends.append(len(words))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    stops = np.array(ends, np.int64)
    starts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
    sizes = stops - starts
    long = np.flatnonzero(sizes > LONG)
    if len(long):
        low = np.ones(len(h), bool)
        for step in range(1, REACH + 1):
            low[step:] &= h[step:] < h[:-step]
            low[:-step] &= h[:-step] < h[step:]
        change = np.zeros(len(h) + 1, np.int64)  # words that have REACH others of their long sentence on each side
        np.add.at(change, starts[long] + REACH, 1)
        np.add.at(change, stops[long] - REACH, -1)
        low &= np.cumsum(change[:-1]) > 0
        starts = np.sort(np.concatenate([starts, np.flatnonzero(low)]))
    return h, starts


def runs(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last + 1) of the shortest long enough run from each unit on, as far as there is one."""
    h, starts = units(text)
    edges = np.append(starts, len(h))
    first = np.arange(len(starts))
    stop = np.maximum(first + RUN, np.searchsorted(edges, starts + WORDS))
    fits = stop < len(edges)
    first, stop = first[fits], stop[fits]
    power, inverse = _powers(1 << max(12, int(len(h)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)])])
    a, b = edges[first], edges[stop]
    mixed = (sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(32))).astype(np.int64), first, stop


RUN_SCHEMA = "doc long, mark long, hash long, start int, stop int"


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        found = [runs(text) for text in batch.column(2).to_pylist()]
        if not found:
            continue
        which = pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]))
        columns = [np.concatenate([x[k] for x in found]).astype(kind) for k, kind in enumerate((np.int64, np.int32, np.int32))]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), *map(pa.array, columns)], names=["doc", "mark", "hash", "start", "stop"])


def strip(text: str | None, gone: list[dict] | None) -> tuple[str | None, int, int]:
    """The text without the units in the ranges gone, and the units and words that went. White space goes with the word before it."""
    if not gone:
        return text, 0, 0
    h, starts = units(text)
    change = np.zeros(len(starts) + 1, np.int64)
    for r in gone:
        change[r["start"]] += 1
        change[r["stop"]] -= 1
    lost = np.cumsum(change[:-1]) > 0
    places = [m.start() for m in WORD.finditer(text)]
    places[0] = 0
    edges = [places[k] for k in starts] + [len(text)]
    sizes = np.diff(np.append(starts, len(h)))
    return "".join(text[edges[k] : edges[k + 1]] for k in np.flatnonzero(~lost)), int(lost.sum()), int(sizes[lost].sum())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_removed, removed_words) of every row, the text without later repeats.

    First is what comes first by id, then by a hash of the text, then in the
    text; ids are integers (others are an error where they are no numbers), and
    null ids come last. Rows equal in id and text count as one document. A null
    text stays null. Other columns are ignored. An empty table gives an empty
    table.
    """
    named = docs.select(F.col(id_col), F.col(text_col), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text_col).alias("mark"))
    spans = named.filter(F.col(text_col).isNotNull()).select("doc", "mark", text_col).mapInArrow(_emit, RUN_SCHEMA)
    first = spans.groupBy("hash").agg(F.min(F.struct("doc", "mark", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("hash", "first")
    later = spans.join(first, "hash").filter(F.struct("doc", "mark", "start") > F.col("first"))
    gone = later.groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "stop")).alias("gone"))
    marked = named.join(gone, ["doc", "mark"], "left").select(id_col, text_col, "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [strip(text, gone) for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            texts, *counts = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in counts)], names=[id_col, text_col, "n_removed", "removed_words"])

    counts = [T.StructField(n, T.LongType()) for n in ("n_removed", "removed_words")]
    return marked.mapInArrow(run, T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(text_col, T.StringType()), *counts]))
