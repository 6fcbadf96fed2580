"""Near duplicates by Order MinHash, verified by banded alignment.

A text's grams are its runs of five words, each labelled with how often it has
occurred before. For each of REPEATS hash functions the PICKS grams of least hash
are taken in the order of the text; texts that agree in one such tuple are
candidates. The chance of that falls with the edit distance, not only with the
overlap. In each bucket of equal tuples every text is first compared with two
texts drawn by hash, others in each bucket. Texts that then share a tuple with
one in another component are dealt anew, exactly: by those of their rarest grams
of which two alike texts must share one. There the texts outside a bucket's
largest component are compared with all in other ones, in blocks. So every pair
that shares a tuple and is alike ends in one class. Before texts are
fetched, profiles (how many grams fall into each of PROFILE cells) rule out pairs
that differ too much in any order. A candidate pair is alike if the edit distance of its
gram sequences, computed within a band, is at most 0.2 of the longer, or if their
overlap (Jaccard, repeated grams counted) is at least 0.8: that allows up to 2/9
of such edits where one place is deleted and another inserted.

Exact copies are one node from the start. Classes are the connected components
of verified pairs. Each text is first compared with the partner it shares most
tuples with; of its other candidates only those in another component are compared.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import cut, shuffles_dropped, sliced
from millrace.llm.sentence_spans import WORD

GRAM, REPEATS, PICKS, SIMILARITY = 5, 32, 3, 0.8
#: Texts of more grams are hashed function by function, to bound memory.
WIDE = 4096
#: Cells of a profile, and about how many of a bucket's texts are on each side of one block.
PROFILE, BLOCK = 256, 128
#: Links that one task labels.
PART_LINKS = 250_000

PAIR = ["node", "node_id", "pivot", "pivot_id"]
BLOCK_KEY = ["bucket", "i", "j"]

_rng = np.random.default_rng(20)
SEEDS = _rng.integers(0, 1 << 63, REPEATS, dtype=np.uint64)
FACTORS = _rng.integers(0, 1 << 62, REPEATS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def grams(text: str | None) -> np.ndarray:
    """64-bit hashes of the text's word 5-grams in order; one of all words if they are fewer, none if there is no word."""
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, WORD.findall(text or "")), np.uint64)
    n = max(1, len(words) - GRAM + 1) if len(words) else 0
    out = np.full(n, min(len(words), GRAM), np.uint64)
    for k in range(min(GRAM, len(words))):
        out = _mix(out * np.uint64(0x100000001B3) + words[k : k + n])
    return out


def labelled(found: np.ndarray) -> np.ndarray:
    """Gram hashes that tell a gram's occurrences apart."""
    order = np.argsort(found, kind="stable")
    ranked = found[order]
    fresh = np.empty(len(found), bool)
    fresh[:1] = True
    fresh[1:] = ranked[1:] != ranked[:-1]
    if fresh.all():
        return found
    at = np.arange(len(found))
    occurrence = at - np.maximum.accumulate(np.where(fresh, at, 0))
    out = found.copy()
    out[order] += occurrence.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return out


def sketch(found: np.ndarray) -> np.ndarray:
    """One hash for each of REPEATS functions: of the least PICKS labelled grams, in the order of the text."""
    if not len(found):
        return np.zeros(0, np.int64)
    marks = labelled(found)
    picks = min(PICKS, len(marks))

    def least(rows: slice) -> np.ndarray:
        with np.errstate(over="ignore"):
            values = _mix((marks[None, :] ^ SEEDS[rows, None]) * FACTORS[rows, None])
        return np.sort(np.argpartition(values, picks - 1, axis=1)[:, :picks], axis=1)

    step = REPEATS if len(marks) <= WIDE else 1
    where = np.concatenate([least(slice(r, r + step)) for r in range(0, REPEATS, step)])
    out = np.arange(1, REPEATS + 1, dtype=np.uint64)
    for k in range(picks):
        out = _mix(out * np.uint64(0x9FB21C651E98DF25) + marks[where[:, k]])
    return out.astype(np.int64)


def banded_distance(a: Sequence, b: Sequence, band: int) -> int:
    """The edit distance of two sequences if it is at most band, else band + 1.

    One column of the band is a pair of bit vectors of its vertical steps, up
    and down; each column follows from the last by a few operations on whole
    vectors.
    """
    if len(a) < len(b):
        a, b = b, a
    start, end = 0, 0
    while start < len(b) and a[start] == b[start]:
        start += 1
    while end < len(b) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    shift = len(a) - len(b)
    if shift > band or not b:
        return min(shift, band + 1)
    if not band:
        return 1
    mask = (1 << 2 * band + 1) - 1
    match: dict = {}
    for i, x in enumerate(a):
        match.setdefault(x, []).append(i)
    width = (len(a) + band) // 8 + 1
    masks: dict = {}
    for x in set(b):
        bits = bytearray(width)
        for i in match.get(x, ()):
            bits[(i + band) >> 3] |= 1 << ((i + band) & 7)
        masks[x] = int.from_bytes(bits, "little")
    up, down, distance, probe = mask & ~((1 << band) - 1), 0, shift, 1 << band + shift
    for j, x in enumerate(b):
        equal = (masks[x] >> j) & mask
        level = ((((equal & up) + up) ^ up) | equal | down) & mask
        right = (down | ~(level | up)) & mask
        left = level & up
        level_up = level >> 1
        up = left | (~(level_up | right) & mask)
        down = level_up & right
        if not level & probe:
            distance += 1
            if distance > band:
                return band + 1
    return distance


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two gram sequences' edit distance is at most 1 - SIMILARITY of the longer one, or their overlap at least SIMILARITY."""
    longest = max(len(a), len(b))
    band = int(longest * (1 - SIMILARITY) + 1e-9)
    if abs(len(a) - len(b)) > band:
        return False
    x, y = a.tolist(), b.tolist()
    common = sum((Counter(x) & Counter(y)).values())
    if longest - common > band:  # what they share in any order bounds what aligns
        return False
    if common and common >= SIMILARITY * (len(a) + len(b) - common) - 1e-9:
        return True
    return banded_distance(x, y, band) <= band


def _nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text (null as empty) and node, the text's 128-bit hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.md5(text)).alias("node"))


def profile(found: np.ndarray) -> bytes:
    """How many grams fall into each cell, 255 at most."""
    return np.minimum(np.bincount((found % np.uint64(PROFILE)).astype(np.int64), minlength=PROFILE), 255).astype(np.uint8).tobytes()


def may_be_alike(n: np.ndarray, p: np.ndarray, other_n: np.ndarray, other_p: np.ndarray) -> np.ndarray:
    """False where lengths and profiles (one row each, or one for all) alone forbid enough likeness."""
    band = (np.maximum(n, other_n) * (1 - SIMILARITY) + 1e-9).astype(np.int64)
    more = p.astype(np.int16) - other_p
    return (np.abs(n - other_n) <= band) & (np.maximum(more, 0).sum(axis=-1) <= band) & (np.maximum(-more, 0).sum(axis=-1) <= band)


def _profiles(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, PROFILE)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        sizes, sketches, profiles = [], [], []
        for text in batch.column(2).to_pylist():
            found = grams(text)
            sizes.append(len(found))
            sketches.append(sketch(found))
            profiles.append(profile(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), pa.array(profiles, pa.binary())], names=["id", "node", "n", "sketch", "profile"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, p, other_n, other_p = (batch[k] for k in ("n", "profile", "other_n", "other_profile"))
        yield batch.select([*PAIR, "shared"]).filter(pa.array(may_be_alike(n.to_numpy(), _profiles(p), other_n.to_numpy(), _profiles(other_p))))


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each block that may be alike, are of different roots and share no earlier tuple. Rows come by block."""
    kept = None
    for batch in sliced(batches):
        rows = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
        block = np.stack([rows[k].to_numpy() for k in BLOCK_KEY])
        last = int(np.flatnonzero(np.append(True, (block[:, 1:] != block[:, :-1]).any(axis=0)))[-1]) if rows.num_rows else 0
        kept = rows.slice(last)
        yield from _compared(rows.slice(0, last))
    if kept is not None:
        yield from _compared(kept)


def _compared(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Each stray text of a block against the block's others."""
    if not rows.num_rows:
        return
    block = np.stack([rows[k].to_numpy() for k in BLOCK_KEY])
    starts = np.flatnonzero(np.append(True, (block[:, 1:] != block[:, :-1]).any(axis=0)))
    number, root, n, r = (rows[k].to_numpy() for k in ("row", "root", "n", "r"))
    left, stray = (rows[k].to_numpy(zero_copy_only=False) for k in ("left", "stray"))
    sketches = rows["sketch"].combine_chunks().flatten().to_numpy().reshape(-1, REPEATS)
    profiles = _profiles(rows["profile"])
    for start, end in zip(starts, [*starts[1:], len(n)], strict=True):
        inside = np.arange(start, end)
        others = inside[~left[start:end]]
        one, two = [], []
        for a in inside[left[start:end]]:
            # two stray texts meet in a block of either
            c = others[(root[others] != root[a]) & (~stray[others] | (number[others] > number[a])) & (np.abs(n[others] - n[a]) <= np.maximum(n[others], n[a]) * (1 - SIMILARITY) + 1e-9)]
            c = c[~(sketches[c, : r[a]] == sketches[a, : r[a]]).any(axis=1)]
            if len(c):
                c = c[may_be_alike(n[c], profiles[c], n[a], profiles[a])]
                one.append(np.full(len(c), a))
                two.append(c)
        if one:
            ends = (rows.select(["node", "id"]).take(pa.array(np.concatenate(x))) for x in (one, two))
            yield from pa.table([column for side in ends for column in side.columns], names=PAIR).to_batches()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        left, right = (batch.column(k).to_pylist() for k in (2, 3))
        memo: dict[str, np.ndarray] = {}
        keep = []
        for a, b in zip(left, right, strict=True):
            if b not in memo:
                memo = {b: grams(b)}
            keep.append(alike(grams(a), memo[b]))
        yield batch.select(["node", "pivot"]).filter(pa.array(keep, pa.bool_()))


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (node, pivot) whose texts are alike. texts: node, text, a row for each node."""
    own = texts.select("node", F.col("text").alias("left"))
    other = texts.select(F.col("node").alias("pivot"), F.col("text").alias("right"))
    full = pairs.select("node", "pivot").join(own, "node").join(other, "pivot").select("node", "pivot", "left", "right")
    return full.mapInArrow(_verified, "node binary, pivot binary").distinct()


def _plain(df: DataFrame, parts: int) -> DataFrame:
    """As cut, in few parts, without the size that the checkpoint hands on: a product over joins, it would double its digits in each round."""
    found = cut(df.coalesce(parts))._jdf
    session = df.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(found.queryExecution().toRdd(), found.schema(), False), session)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in links (node, pivot): root is the least node that it is connected to.

    Each round takes the least label among neighbours, then the label's own
    label, until nothing changes; rounds follow the logarithm of a component's
    diameter. The work is dealt to parts of PART_LINKS links, as rounds over few
    links would else be mostly empty tasks.
    """
    parts = max(1, -(-links.count() // PART_LINKS))
    both = _plain(links.select(F.col("node").alias("a"), F.col("pivot").alias("b")).union(links.select("pivot", "node")), parts)
    labels = _plain(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")), parts)
    while True:
        met = both.join(labels.select(F.col("node").alias("b"), "root"), "b").coalesce(parts)
        near = met.groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low")).coalesce(parts)
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("next"))
        moved = _plain(lower.join(jump, "low").select("node", "root", F.least("low", "next").alias("low")), parts)
        changed = not moved.filter("low < root").isEmpty()
        labels = moved.select("node", F.col("low").alias("root"))
        if not changed:
            return labels


def joined_components(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """roots (node, root) after more links (node, pivot). Only links between components are labelled; None is no link."""
    if links.isEmpty():
        return roots
    if roots is None:
        return components(links)
    own = roots.withColumnRenamed("root", "own")
    between = links.join(own, "node", "left").select(F.coalesce("own", "node").alias("node"), "pivot")
    between = between.join(own.withColumnRenamed("node", "pivot"), "pivot", "left").select("node", F.coalesce("own", "pivot").alias("pivot"))
    moved = components(cut(between.filter("node <> pivot").distinct()))
    fresh = moved.select("node").join(roots.select("root").distinct(), F.col("node") == F.col("root"), "left_anti").select("node", F.col("node").alias("root"))
    further = moved.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return cut(roots.union(fresh).join(further, "root", "left").select("node", F.coalesce("next", "root").alias("root")))


def sketched(nodes: DataFrame) -> DataFrame:
    """A row for each node: its number, id (the least one), n, sketch and profile. Numbers hold once it is cut."""
    found = nodes.select("id", "node", "text").mapInArrow(_sketched, "id " + nodes.schema["id"].dataType.simpleString() + ", node binary, n long, sketch array<long>, profile binary")
    single = found.groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("profile").alias("profile"))
    return single.withColumn("row", F.monotonically_increasing_id())


def _pair_schema(single: DataFrame) -> str:
    kind = single.schema["id"].dataType.simpleString()
    return f"node binary, node_id {kind}, pivot binary, pivot_id {kind}"


def _ordered(pairs: DataFrame) -> DataFrame:
    """Each pair once, the lesser node first."""
    turned = F.col("node") > F.col("pivot")
    one, two = F.struct("node", F.col("node_id").alias("id")), F.struct(F.col("pivot").alias("node"), F.col("pivot_id").alias("id"))
    both = pairs.select(F.when(turned, two).otherwise(one).alias("x"), F.when(turned, one).otherwise(two).alias("y"), *(c for c in pairs.columns if c not in PAIR))
    return both.select(F.col("x.node").alias("node"), F.col("x.id").alias("node_id"), F.col("y.node").alias("pivot"), F.col("y.id").alias("pivot_id"), *both.columns[2:])


def buckets(single: DataFrame) -> DataFrame:
    """(row, r, bucket, one, two) for each tuple that a text shares with another: two texts drawn in its bucket.

    Two are drawn by the least and greatest of their number XOR the bucket's
    hash, which is one comparison of 64 bits and gives the number back.
    """
    rows = single.select("row", F.posexplode("sketch").alias("r", "bucket"))
    drawn = F.col("row").bitwiseXOR(F.col("bucket"))
    two = rows.groupBy("bucket").agg(F.min(drawn).alias("low"), F.max(drawn).alias("high")).filter("low < high")
    met = rows.join(two, "bucket")
    return met.select("row", "r", "bucket", F.col("low").bitwiseXOR(F.col("bucket")).alias("one"), F.col("high").bitwiseXOR(F.col("bucket")).alias("two"))


def candidates(single: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """(node, node_id, pivot, pivot_id, shared): each text with the two drawn in each bucket it is in.

    Pairs whose lengths or profiles alone forbid enough likeness are left out.
    met is what buckets() found.
    """
    met = buckets(single) if met is None else met
    pairs = met.select("row", F.explode(F.array("one", "two")).alias("other")).filter("row <> other")
    counted = pairs.groupBy(F.least("row", "other").alias("row"), F.greatest("row", "other").alias("other")).agg(F.count("*").alias("shared"))
    own = single.select("row", "node", F.col("id").alias("node_id"), "n", "profile")
    other = single.select(F.col("row").alias("other"), F.col("node").alias("pivot"), F.col("id").alias("pivot_id"), F.col("n").alias("other_n"), F.col("profile").alias("other_profile"))
    both = counted.join(own, "row").join(other, "other").select(*PAIR, "shared", "n", "profile", "other_n", "other_profile")
    return _ordered(both.mapInArrow(_likely, _pair_schema(single) + ", shared long"))


def _with_roots(single: DataFrame, roots: DataFrame | None, met: DataFrame) -> DataFrame:
    """met with root, the number of the root of each text's component. roots: (node, root) of linked texts, or None."""
    if roots is None:
        return met.withColumn("root", F.col("row"))
    numbers = single.select("node", "row")
    rooted = roots.join(numbers, "node").select("row", F.col("root").alias("node")).join(numbers.withColumnRenamed("row", "root"), "node").select("row", "root")
    return met.join(rooted, "row", "left").withColumn("root", F.coalesce("root", "row"))


def unmet(single: DataFrame, roots: DataFrame | None, met: DataFrame | None = None) -> DataFrame:
    """(node, node_id, pivot, pivot_id): all texts that share a bucket, may be alike, and are in different components.

    Buckets are those of met (row, r, bucket), by default of tuples; a pair is
    left out where it shares the tuple of a function before r. In a bucket only the texts outside its largest component, the stray ones,
    are compared, with all others. They are dealt into slots of BLOCK, and so
    are all texts; a block is a slot of stray ones and a slot of any, so a
    large bucket is the work of many tasks.
    """
    rows = _with_roots(single, roots, (buckets(single) if met is None else met).select("row", "r", "bucket"))
    sizes = rows.groupBy("bucket", "root").agg(F.count("*").alias("c"))
    most = F.max(F.struct("c", "root"))
    mixed = sizes.groupBy("bucket").agg(most.alias("most"), F.sum("c").alias("m"), F.count("*").alias("kinds")).filter("kinds > 1")
    slots = lambda c: F.ceil(c / BLOCK).cast("long")
    mixed = mixed.select("bucket", F.col("most.root").alias("main"), slots(F.col("m") - F.col("most.c")).alias("strays"), slots(F.col("m")).alias("all"))
    dealt = rows.join(mixed, "bucket").withColumn("stray", F.col("root") != F.col("main"))
    every = lambda c: F.sequence(F.lit(0).cast("long"), c - 1)
    own = lambda c: F.pmod(F.xxhash64("row"), c)
    as_left = F.transform(F.when(F.col("stray"), every(F.col("all"))).otherwise(F.array().cast("array<long>")), lambda j: F.struct(F.lit(True).alias("left"), own(F.col("strays")).alias("i"), j.alias("j")))
    as_other = F.transform(every(F.col("strays")), lambda i: F.struct(F.lit(False).alias("left"), i.alias("i"), own(F.col("all")).alias("j")))
    blocks = dealt.select("row", "root", "r", "bucket", "stray", F.inline(F.concat(as_left, as_other))).join(single, "row")
    sorted_ = blocks.repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY)
    return _ordered(sorted_.mapInArrow(_block_pairs, _pair_schema(single)))


def _texts(nodes: DataFrame, single: DataFrame, met: DataFrame) -> DataFrame:
    """(node, text, row, n) of the texts in met, a row for each."""
    wanted = single.select(F.col("node").alias("_node"), F.col("id").alias("_id"), "row", "n").join(met.select("row"), "row", "left_semi")
    found = nodes.join(wanted, (F.col("node") == F.col("_node")) & F.col("id").eqNullSafe(F.col("_id")))
    return found.select("node", "text", "row", "n").dropDuplicates(["node"])


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        found = [labelled(grams(text)).view(np.int64) for text in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["row", "n", "grams"])


def rarest(texts: DataFrame) -> DataFrame:
    """(row, r, bucket): of each text the labelled grams that are among its rarest and that another text holds.

    Alike texts share all but a band of the longer one's grams, so in any order
    of all grams the first band + 1 of either text have one in common. Here rare
    grams come first: texts that share a frequent passage alone do not meet.
    """
    held = texts.select("row", "n", "text").mapInArrow(_labelled, "row long, n long, grams array<long>").select("row", "n", F.explode("grams").alias("bucket"))
    often = held.groupBy("bucket").agg(F.count("*").alias("often")).filter("often > 1")
    text = Window.partitionBy("row")
    ranked = held.join(often, "bucket").withColumn("known", F.count("*").over(text)).withColumn("place", F.row_number().over(text.orderBy("often", "bucket")))
    band = F.floor(F.col("n") * (1 - SIMILARITY) + 1e-9)
    return ranked.filter(F.col("n") - F.col("known") + F.col("place") <= band + 1).select("row", F.lit(0).alias("r"), "bucket")


def mixed_texts(single: DataFrame, roots: DataFrame | None, met: DataFrame) -> DataFrame:
    """The numbers of the texts that share a tuple with one in another component."""
    rows = _with_roots(single, roots, met)
    mixed = rows.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket")
    return rows.join(mixed, "bucket", "left_semi").select("row").distinct()


def _best_first(pairs: DataFrame, texts: DataFrame) -> DataFrame | None:
    """(node, root) after all pairs of texts that are alike are linked; None if there is none.

    The pair of each text that shares most tuples comes first, then those that
    are still in different components.
    """
    if pairs.isEmpty():
        return None
    sides = pairs.select("node", "pivot", "shared").union(pairs.select("pivot", "node", "shared"))
    best = cut(sides.groupBy("node").agg(F.max_by("pivot", F.struct("shared", "pivot")).alias("pivot")).select(F.least("node", "pivot").alias("node"), F.greatest("node", "pivot").alias("pivot")).distinct())
    roots = joined_components(None, cut(_verify(best, texts)))
    rest = pairs.select("node", "pivot").join(best, ["node", "pivot"], "left_anti")
    if roots is not None:
        rest = rest.join(roots, "node", "left").withColumnRenamed("root", "own").join(roots.select(F.col("node").alias("pivot"), "root"), "pivot", "left").filter("own IS NULL OR root IS NULL OR own <> root")
    return joined_components(roots, cut(_verify(rest.select("node", "pivot"), texts)))


def near_roots(nodes: DataFrame) -> DataFrame | None:
    """(node, root) of the texts that are linked: all that share a tuple and are alike are in one component. None if there is no link."""
    with shuffles_dropped(nodes.sparkSession):  # each step is cut, so none needs the shuffles of one before
        single = cut(sketched(nodes))
        met = cut(buckets(single))
        texts = cut(_texts(nodes, single, met))
        drawn = cut(candidates(single, met))
        roots = _best_first(drawn, texts)
        rare = cut(rarest(texts.join(mixed_texts(single, roots, met), "row", "left_semi")))
        others = unmet(single, roots, rare).select("node", "pivot").distinct().join(drawn.select("node", "pivot"), ["node", "pivot"], "left_anti")
        return joined_components(roots, cut(_verify(others, texts)))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, node, class_id) of every row; class_id is the least id in the row's class.

    A null text counts as an empty one; all texts without a word that are equal
    are copies, and not near to others. Repeated rows are copies. A class of
    null ids alone has a null class_id, though node still tells texts apart.
    Other columns are ignored. An empty table gives an empty table.
    """
    nodes = _nodes(docs, id_col, text_col)
    roots = near_roots(nodes)
    named = nodes.select("id", "node")
    grouped = named.withColumn("group", F.col("node")) if roots is None else named.join(roots.withColumnRenamed("root", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    least = grouped.groupBy("group").agg(F.min("id").alias("class_id"))
    return grouped.join(least, "group").select(F.col("id").alias(id_col), "node", "group", "class_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all columns: one of the class's least id, then of the least hash of its text.

    Of rows equal in both any one stays. Null texts count as empty ones, null
    ids come last, and an empty table gives an empty table.
    """
    found = classes(docs, id_col, text_col)
    first = found.groupBy("group").agg(F.min(F.struct(F.coalesce(F.col(id_col), F.lit((1 << 63) - 1)).alias("_id"), F.col("node").alias("_node"))).alias("f")).select("f._id", "f._node")
    marked = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col(id_col), F.lit((1 << 63) - 1)).alias("_id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("_node"))
    return marked.join(first, ["_node", "_id"], "left_semi").groupBy("_node", "_id").agg(F.first("_row").alias("_row")).select("_row.*")
