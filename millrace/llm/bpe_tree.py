"""Byte-level BPE by reduction over the monoid of token sequences.

A piece that is no token is cut in halves down to single bytes, and its encoding
is built from those of its halves. Two neighbouring encodings are joined by encoding again a window of tokens around the seam. The
window grows until the tokens at its two edges are settled: a pair of tokens is
settled if encoding its bytes gives that pair again. A sequence whose adjacent
pairs are all settled is the encoding of its bytes (the first merge to cross a
border would cross it as well when the two tokens stand alone), so nothing
outside the window can change. The empty sequence is the neutral element.
Decoding concatenates bytes up the same kind of tree.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.common import field, sliced

#: Windows of at most so many bytes are merged by scanning all pairs each time, longer ones by a queue of pairs.
SCANNED_BYTES = 48
#: Subtrees of at most so many bytes are remembered, and how many of them, and of seams and settled pairs of tokens.
SUBTREE_BYTES, REMEMBERED = 8, 200_000
#: Distinct pieces remembered by a worker, and the longest that is remembered; beyond them pieces are encoded anew.
MEMO_PIECES, MEMO_CHARS = 300_000, 48
#: A rank above all.
NEVER = 1 << 62


class Codec:
    """Encoder and decoder for one file of ranks (a base64 token and its rank per line)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.settled = lru_cache(REMEMBERED)(self._settled)
        self.seam = lru_cache(REMEMBERED)(self._seam)
        self.subtree = lru_cache(REMEMBERED)(self._halved)
        self.joins = 0

    @classmethod
    def load(cls, path: str) -> Codec:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def merge(self, data: bytes) -> list[int]:
        """The definition: merge the lowest-ranked adjacent pair, leftmost first, until none is left."""
        return self._merge_short(data) if len(data) <= SCANNED_BYTES else self._merge_long(data)

    def _merge_short(self, data: bytes) -> list[int]:
        """By scanning all pairs each time, which is quickest for a word."""
        get, bounds = self.ranks.get, list(range(len(data) + 1))
        pairs = [get(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
        while pairs and (least := min(pairs)) != NEVER:
            i = pairs.index(least)
            del pairs[i], bounds[i + 1]
            if i < len(pairs):
                pairs[i] = get(data[bounds[i] : bounds[i + 2]], NEVER)
            if i:
                pairs[i - 1] = get(data[bounds[i - 1] : bounds[i + 1]], NEVER)
        return [self.ranks[data[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _merge_long(self, data: bytes) -> list[int]:
        """By a queue of pairs."""
        size = len(data)
        end, before = list(range(1, size + 1)), list(range(-1, size))
        ranks, queue = self.ranks, []
        for i in range(size - 1):
            if (rank := ranks.get(data[i : i + 2])) is not None:
                queue.append((rank, i, i + 2))
        heapq.heapify(queue)
        alive = [True] * size
        while queue:
            rank, i, stop = heapq.heappop(queue)
            if not alive[i] or end[i] >= size or end[end[i]] != stop or not alive[end[i]]:
                continue
            alive[end[i]] = False
            end[i] = stop
            if stop < size:
                before[stop] = i
                if (rank := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(queue, (rank, i, end[stop]))
            if (left := before[i]) >= 0 and (rank := ranks.get(data[left:stop])) is not None:
                heapq.heappush(queue, (rank, left, stop))
        out, i = [], 0
        while i < size:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def _settled(self, left: int, right: int) -> bool:
        return self.merge(self.tokens[left] + self.tokens[right]) == [left, right]

    def _seam(self, left: int, right: int) -> list[int]:
        return self.merge(self.tokens[left] + self.tokens[right])

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both sequences' bytes; neither list is changed."""
        if not left or not right:
            return left or right
        self.joins += 1
        seam, reach = self.seam(left[-1], right[0]), 1
        while not ((len(left) <= reach or self.settled(left[-reach - 1], seam[0])) and (len(right) <= reach or self.settled(seam[-1], right[reach]))):
            reach *= 2
            seam = self.merge(b"".join(map(self.tokens.__getitem__, left[-reach:] + right[:reach])))
        return left[:-reach] + seam + right[reach:]

    def reduce(self, data: bytes) -> list[int]:
        return self.subtree(data) if len(data) <= SUBTREE_BYTES else self._halved(data)

    def _halved(self, data: bytes) -> list[int]:
        if len(data) == 1:
            return [self.ranks[data]]
        half = len(data) // 2
        return self.join(self.reduce(data[:half]), self.reduce(data[half:]))

    def encode_piece(self, piece: str) -> list[int]:
        """One match of the pattern. A piece that is a token is that token, as in the tiktoken library."""
        data = piece.encode()
        return [whole] if (whole := self.ranks.get(data)) is not None else self.reduce(data)

    def decode(self, ids: Sequence[int]) -> bytes:
        """The ids' bytes, joined up a tree of 64 branches."""
        parts = list(map(self.tokens.__getitem__, ids))
        while len(parts) > 64:
            parts = [b"".join(parts[i : i + 64]) for i in range(0, len(parts), 64)]
        return b"".join(parts)


class Memo(dict):
    """Encodings of pieces as packed 32-bit ids. It starts anew when full, so its size is bounded."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = pack(self.codec.encode_piece(piece))
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = ids
        return ids


def pack(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


@lru_cache(4)
def _loaded(path: str) -> Memo:
    return Memo(Codec.load(path))


@lru_cache(4)
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


def list_array(packed: list[bytes | None]) -> pa.Array:
    """Arrow lists of int32 from packed ids."""
    offsets, at = [0], 0
    for p in packed:
        at += len(p or b"") // 4
        offsets.append(at)
    values = pa.Array.from_buffers(pa.int32(), at, [None, pa.py_buffer(b"".join(p or b"" for p in packed))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def encode(docs: DataFrame, vocab: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids array<int>) of every row's whole text; every row gives one row.

    With decoded, also the bytes that the ids stand for, decoded in the same
    task, so ids need not travel back. A null or empty text has no ids. Rows
    with equal ids or texts stay apart; a null id stays null. Other columns are
    ignored, whatever their names. An empty table gives an empty table. vocab is
    a path that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, find = _loaded(vocab), _pattern(pattern).findall
        for batch in sliced(batches):
            packed = [b"".join(map(memo.__getitem__, find(text or ""))) for text in batch.column(1).to_pylist()]
            columns = {id_col: batch.column(0), "ids": list_array(packed)}
            if decoded:
                columns["decoded"] = pa.array([memo.codec.decode(memoryview(p).cast("i")) for p in packed], pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    out = [T.StructField("decoded", T.BinaryType())] if decoded else []
    schema = T.StructType([field(docs, id_col), T.StructField("ids", T.ArrayType(T.IntegerType())), *out])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocab: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes of an array of ids; null ids give no bytes. An id that is not in the vocabulary is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _loaded(vocab).codec
        for batch in sliced(batches):
            at = batch.schema.get_field_index(ids_col)
            data = [codec.decode(ids or []) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=[*batch.schema.names, out_col])

    schema = T.StructType([*encoded.schema.fields, T.StructField(out_col, T.BinaryType())])
    return encoded.mapInArrow(run, schema)
