"""Packing token sequences into windows of fixed length: best-fit decreasing.

Documents become ids, an end id after each. What exceeds a window is cut into
full windows first; what remains of each document is placed, longest first, in
the open window with the least room that suffices, found by a segment tree over
room left, else in a new window. Groups of bounded size are packed apart. Within
a task the pieces of a group arrive in falling length, so they are placed as
they stream by, and only the open windows' room is held in memory.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import field, sliced

#: Text in a group, in bytes; a group's last window is its only poorly filled one.
GROUP_BYTES = 64 << 20
#: A sequence's id is its group's number times this, plus its number in the group.
GROUP_SPAN = 1 << 40
#: Distinct words whose ids a worker remembers, and the longest that is remembered; others are encoded anew.
MEMO_WORDS, MEMO_CHARS = 300_000, 48
#: The parts of a tokenizer's file for which LATIN gives its pieces.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: The letters and digits of Latin text in lower case. No character of such a text is composed with the next, or changes its length in lower case.
LETTERS, NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_TEXT = re.compile("[\x09-\x0d\x20-\x7e\xa1-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u203e]*+")
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\x09-\\x0d\\x20{LETTERS}{NUMBERS}]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Rooms:
    """Open windows by room left: a segment tree over 0..size that finds the least room of at least n."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.filled = bytearray(2 * self.leaves)
        self.windows: dict[int, list[int]] = {}

    def put(self, room: int, window: int) -> None:
        if room <= 0:
            return
        self.windows.setdefault(room, []).append(window)
        at = room + self.leaves
        while at and not self.filled[at]:
            self.filled[at] = 1
            at >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """(room, window) of the tightest window with room for n, no longer open after that."""
        at = n + self.leaves
        if not self.filled[at]:
            while at > 1 and (at & 1 or not self.filled[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.filled[2 * at] else 2 * at + 1
        room = at - self.leaves
        window = self.windows[room].pop()
        if not self.windows[room]:
            del self.windows[room]
            while at and not (at < self.leaves and (self.filled[2 * at] or self.filled[2 * at + 1])):
                self.filled[at] = 0
                at >>= 1
        return room, window


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself, or from 256 on in order for the others."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


class PieceIds(dict):
    """Packed ids of pieces that the pattern matched."""

    def __init__(self, tokenizer):
        self.tokenize, self.shown = tokenizer.model.tokenize, _byte_characters()

    def __missing__(self, piece: str) -> bytes:
        ids = b"".join(token.id.to_bytes(4, "little") for token in self.tokenize("".join(map(self.shown.__getitem__, piece.encode()))))
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[piece] = ids
        return ids


class TextIds(dict):
    """Packed ids of texts, with those of words and pieces remembered; they start anew when full, so their size is bounded.

    If the tokenizer lower-cases and then takes the matches of the pattern that
    LATIN follows, a text of Latin script is taken apart here, and only new
    pieces go to the library. Of other texts each word, and what may hold an
    added token, is encoded by the library: it must drop white space and never
    join what white space parts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = PieceIds(self.tokenizer)
        with open(path) as file:
            setting = json.load(file)
        self.latin = setting["normalizer"] == NORMALIZER and setting["pre_tokenizer"] == PRE_TOKENIZER and not setting["post_processor"]
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, word: str) -> bytes:
        ids = b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.latin and LATIN_TEXT.fullmatch(text) and not any(token in text for token in self.added):
            return b"".join(map(self.pieces.__getitem__, LATIN.findall(text.lower())))
        return b"".join(map(self.__getitem__, WORD.findall(text)))


@lru_cache(4)
def text_ids(path: str) -> TextIds:
    return TextIds(path)


def pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, doc_tokens, start, length, ids binary): full windows of each document, then the rest.

    ids are little-endian 32-bit. A null or empty text is its end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end, width = text_ids(tokenizer), end_id.to_bytes(4, "little"), 4 * window
        for batch in sliced(batches):
            which, total, starts, lengths, parts = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = known.encode(text or "") + end
                for at in range(0, len(ids), width):
                    part = ids[at : at + width]
                    which.append(row)
                    total.append(len(ids) // 4)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    parts.append(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which, pa.int64())), pa.array(total, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(parts, pa.binary())],
                names=[id_col, "doc_tokens", "start", "length", "ids"],
            )

    longs = [T.StructField(n, T.LongType()) for n in ("doc_tokens", "start", "length")]
    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([field(docs, id_col), *longs, T.StructField("ids", T.BinaryType())]))


def place(window: int):
    """A function for mapInArrow that adds sequence_id and offset to pieces sorted by group and falling length.

    Of windows with equal room the one that was opened or filled last is taken;
    pieces of equal length are placed in the order they come in. No pieces give
    no windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rooms, opened = None, Rooms(window), 0
        for batch in sliced(batches):
            sequences, offsets = [], []
            columns = batch.schema.names
            for g, n in zip(batch.column(columns.index("group")).to_pylist(), batch.column(columns.index("length")).to_pylist(), strict=True):
                if g != group:
                    group, rooms, opened = g, Rooms(window), 0
                room, number = rooms.take(n) or (window, opened)
                opened += number == opened
                sequences.append(g * GROUP_SPAN + number)
                offsets.append(window - room)
                rooms.put(room - n, number)
            kept = [c for c in columns if c != "group"]
            yield pa.RecordBatch.from_arrays([*(batch.column(columns.index(c)) for c in kept), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], names=[*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, doc_tokens, start, length, ids, sequence_id, offset.

    Every id of every row's whole text is in exactly one piece; a sequence's
    pieces fill it gaplessly from 0. A null or empty text gives one piece, its
    end id. Repeated rows and ids are packed like any others, a null id stays
    null. Other columns are ignored. An empty table gives an empty table. The
    number of groups follows the bytes of text, and that of tasks follows the
    groups, so a task's share does not grow with the table.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    cut = pieces(docs, tokenizer, window, end_id, id_col, text_col)
    mixed = cut.withColumn("group", F.pmod(F.xxhash64(id_col, "start", F.crc32("ids")), F.lit(groups)))
    sorted_ = mixed.repartition(2 * groups, "group").sortWithinPartitions("group", F.desc("length"), id_col, "start", F.crc32("ids"))
    longs = [T.StructField(n, T.LongType()) for n in ("sequence_id", "offset")]
    return sorted_.mapInArrow(place(window), T.StructType([*cut.schema.fields, *longs]))
