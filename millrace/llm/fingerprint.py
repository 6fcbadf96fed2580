"""Fingerprints of documents: winnowing over hashes of word 5-grams.

Each window of consecutive grams gives its least hash, the rightmost of equals,
with its position in words. Two texts that share WINDOW + GRAM - 1 words in a
row share a fingerprint, and its positions tell where. Everything is DataFrame
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import BLANKS, SPACE, computed

GRAM, WINDOW = 5, 10
#: Text in a bucket of neighbouring documents, in bytes, and buckets at most: beyond 512 GB they grow, to some 800 MB at 100 TB, which a sort spills.
BUCKET_BYTES, BUCKETS = 4 << 20, 1 << 17
LEAST = -(1 << 63)


def word_array(text: Column) -> Column:
    """A text's words; none for null."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def gram_hashes(words: Column) -> Column:
    """Hashes of all GRAM words in a row, or one of all words if they are fewer."""
    count = F.size(words)
    many = F.transform(F.slice(words, 1, F.greatest(count - (GRAM - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, GRAM))))
    return F.when(count >= GRAM, many).when(count > 0, F.array(F.xxhash64(F.array_join(words, " "), F.lit(GRAM)))).otherwise(F.array().cast("array<bigint>"))


def window_minima(grams: Column) -> Column:
    """array<struct<h, back>>: the least hash of each window; back is minus its position, so of equals the rightmost is least."""
    placed = F.transform(grams, lambda h, i: F.struct(h.alias("h"), (-i).alias("back")))
    starts = F.when(F.size(grams) > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(grams) - (WINDOW - 1)))).otherwise(F.array().cast("array<int>"))
    return placed, starts


def add_fingerprint(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """df with out_col, array<struct<h, back>> in order of position; text_col's null counts as empty, which has no fingerprint."""
    steps = computed(df, _words=word_array(F.col(text_col)))
    steps = computed(steps, _grams=gram_hashes(F.col("_words"))).drop("_words")
    placed, starts = window_minima(F.col("_grams"))
    steps = computed(steps, _placed=placed, _starts=starts).drop("_grams")
    steps = computed(steps, _minima=F.transform("_starts", lambda s: F.array_min(F.slice("_placed", s, F.lit(WINDOW))))).drop("_placed", "_starts")
    changed = lambda m, i: (i == 0) | (F.get("_minima", F.greatest(i - 1, F.lit(0)))["back"] != m["back"])
    return computed(steps, **{out_col: F.filter("_minima", changed)}).drop("_minima")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two fingerprints: 1 if both are empty, 0 if one is."""
    one, two = (F.array_distinct(F.transform(x, lambda m: m["h"])) for x in (a, b))
    shared = F.size(F.array_intersect(one, two))
    every = F.size(one) + F.size(two) - shared
    return F.when(every == 0, 1.0).otherwise(shared / F.greatest(every, F.lit(1)))


def listing(fingerprint: Column) -> Column:
    """position:hash, joined by commas; the hash in hexadecimal."""
    return F.array_join(F.transform(fingerprint, lambda m: F.concat_ws(":", (-m["back"]).cast("string"), F.hex(m["h"]))), ",")


def _bucket(value: Column, cuts: list[int]) -> Column:
    """How many of the rising cuts are at most value, by bisection."""
    if not cuts:
        return F.lit(0)
    array = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(at + step <= len(cuts), F.when(F.get(array, at + step - 1) <= value, at + step).otherwise(at)).otherwise(at))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Window]:
    """Rows dealt to buckets of neighbouring ids, and the window in which the next row is the next document.

    Order is falling id (null last), then a hash of the text. Each bucket also
    gets, with guest = 1, the first document of the next bucket that has rows
    (the last one that of the first), so lead() is right for every row that
    isn't a guest. Only bucket borders, BUCKETS at most, come to the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("_id"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = min(BUCKETS, max(1, -(-size // BUCKET_BYTES)))
    cuts: list[int] = []
    if buckets > 1:
        shares = F.array(*(F.lit(k / buckets) for k in range(1, buckets)))
        cuts = sorted(set(rows.agg(F.percentile_approx("_id", shares, F.lit(max(10_000, 8 * buckets)))).first()[0]))
    rows = rows.withColumn("_bucket", _bucket(F.col("_id"), cuts))
    heads = [(r[0], r[1]) for r in rows.groupBy("_bucket").agg(F.max("_id")).collect()]
    heads.sort(reverse=True)
    guests = [(heads[k][1], heads[k - 1][0]) for k in range(len(heads))]
    lent = F.broadcast(spark.createDataFrame(guests, "_id long, _lent int"))
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("guest"))
    both = F.when(F.col("_lent").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("_lent").alias("bucket"), F.lit(1).alias("guest"))))
    dealt = rows.join(lent, "_id", "left").select(id_col, "_text", "_id", F.inline(both))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("_id"), F.desc(F.xxhash64("_text")), F.desc("_text"))
    return dealt, order


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, edited, fingerprint, edited_fingerprint, next_fingerprint) of every row.

    edited is the text with its last third replaced by as much of the next
    document's start. A null text counts as empty. Repeated rows are documents
    of their own; the only document is its own next. Ids are integers (others
    are an error where they are no numbers); null ids come last. Other
    columns are ignored. An empty table gives an empty table.
    """
    dealt, order = with_next(docs, id_col, text_col)
    led = dealt.withColumn("_next", F.lead("_text").over(order))
    marked = add_fingerprint(led, "_text", "fingerprint")
    both = marked.withColumn("next_fingerprint", F.lead("fingerprint").over(order)).filter("guest = 0")
    length = F.length("_text")
    third = F.floor(length / 3).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), length - third), F.substring("_next", F.lit(1), third))
    done = add_fingerprint(both.withColumn("edited", edited), "edited", "edited_fingerprint")
    return done.select(id_col, F.col("_text").alias("text"), "edited", "fingerprint", "edited_fingerprint", "next_fingerprint")
