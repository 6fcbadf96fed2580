"""Removing repeated lines: winnowing over line hashes.

A document is its sequence of lines that hold a word. A window is the shortest
run of lines from any line on that holds LONE_WORDS words in one line, or has
WINDOW lines; each picks a fingerprint: a line of so many words, or else the
least hash of its short lines (rightmost of equals). So a line of five words is
always a fingerprint, and a run of three short lines that occurs twice picks the
same line in both places.

A match is extended both ways as far as short lines reach: a fingerprint is
joined by its own hash, if it is long enough, and by those of the runs around it
that hold at most WINDOW lines, each with the first occurrence of that very run.
So a run counts as repeated if it occurred anywhere before, not only where the
first occurrence of one of its lines was. The later run is deleted. In all: a run
of lines goes if the same lines in a row occurred before and it is three lines
long or holds a line of five words. What is deleted always has an earlier copy,
so one copy of every line stays. Hashes are 128 bits wide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SPACE, computed, cut, place

#: Lines in a window of short lines, and so in the shortest run of them that goes.
WINDOW = 3
#: Words that a line has if it may be deleted alone.
LONE_WORDS = 5
BLANKS = " \t\x0b\x0c\r"


def mark_of(text: Column) -> Column:
    """60 bits of a text's MD5, which tell texts of one id apart."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _word_lines(text: Column) -> Column:
    """The numbers of the lines that hold a word, in order."""
    numbered = F.transform(F.split(text, "\n"), lambda line, i: F.when(F.trim(line, F.lit(BLANKS)) != "", i))
    return F.filter(numbered, lambda i: i.isNotNull())


def _sequence(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, mark (which together name a document) and seq, its lines with a word: their hash h and whether they are long."""
    trimmed = F.filter(F.transform(F.split(F.col(text_col), "\n"), lambda line: F.trim(line, F.lit(BLANKS))), lambda t: t != "")
    hashed = F.transform(trimmed, lambda t: F.struct(F.unhex(F.md5(t)).alias("h"), (F.size(F.split(t, SPACE)) >= LONE_WORDS).alias("long")))
    return computed(docs.filter(F.col(text_col).isNotNull()), doc=place(id_col), mark=mark_of(F.col(text_col)), seq=hashed).select("doc", "mark", "seq")


def _runs(seq: Column) -> Column:
    """array<struct<key, start, size>>: the runs by which fingerprints are joined."""
    at = lambda p: F.when(p >= 0, F.get(seq, F.greatest(p, F.lit(0))))
    short = lambda p: F.coalesce(~at(p)["long"], F.lit(False))
    key = lambda start, size: F.unhex(F.md5(F.concat(*(at(start + k)["h"] for k in range(size)))))
    run = lambda start, size: F.struct((key(start, size) if size > 1 else at(start)["h"]).alias("key"), start.cast("int").alias("start"), F.lit(size).alias("size"))

    def around(x: Column, p: Column) -> Column:
        one, two = short(p - 1), short(p + 1)
        as_long = F.array(
            run(p, 1),
            F.when(one, run(p - 1, 2)),
            F.when(two, run(p, 2)),
            F.when(one & short(p - 2), run(p - 2, 3)),
            F.when(two & short(p + 2), run(p, 3)),
        )
        h = {k: at(p + k)["h"] for k in (-2, -1, 1, 2)}
        windows = {-2: one & short(p - 2), -1: one & two, 0: two & short(p + 2)}
        # rightmost of equals: what stands before may be equal, what follows must be greater
        beats = lambda start: [h[k] >= x["h"] if k < 0 else h[k] > x["h"] for k in range(start, start + WINDOW) if k]
        least = {start: windows[start] & beats(start)[0] & beats(start)[1] for start in windows}
        picked = least[-2] | least[-1] | least[0]
        as_short = F.array(*(F.when(windows[start], run(p + start, WINDOW)) for start in windows))
        none = F.array(F.lit(None).cast("struct<key:binary,start:int,size:int>"))
        return F.when(x["long"], as_long).when(F.coalesce(picked, F.lit(False)), as_short).otherwise(none)

    return F.filter(F.flatten(F.transform(seq, around)), lambda r: r.isNotNull())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each fingerprint and run around it: doc, mark, key (the run's hash), start (its first line with a word), size."""
    return _sequence(docs, id_col, text_col).select("doc", "mark", F.inline(_runs(F.col("seq"))))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, mark, gone): the places, among the lines with a word, of what is to be deleted, for documents that have any."""
    marks = cut(fingerprints(docs, id_col, text_col))
    where = F.struct("doc", "mark", "start")
    first = marks.groupBy("key").agg(F.min(where).alias("first"), F.max(where).alias("last")).filter("first < last").select("key", "first")
    later = marks.join(first, "key").filter(where > F.col("first"))
    return later.select("doc", "mark", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("p")).groupBy("doc", "mark").agg(F.collect_set("p").alias("gone"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col cut to the lines that stay, and n_lines and n_deleted (long) added.

    Order is that of id, of any type that has one, and for equal ids of a hash of
    the text; null ids come last. Rows equal in both count as one document: none
    is later than the other. Lines without a word are never deleted. A null text
    stays null and has no lines, an empty one has one. Columns named n_lines or
    n_deleted are replaced; an empty table gives an empty table.
    """
    named = docs.drop("n_lines", "n_deleted").withColumn("_doc", place(id_col)).withColumn("_mark", mark_of(F.col(text_col)))
    gone = repeated(docs, id_col, text_col).select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"), F.col("gone").alias("_gone"))
    found = named.join(gone, ["_doc", "_mark"], "left")
    has = F.col("_gone").isNotNull()
    found = found.withColumn("_lines", F.when(has, F.split(text_col, "\n"))).withColumn("_word", F.when(has, _word_lines(F.col(text_col))))
    lost = F.transform(F.col("_gone"), lambda p: F.get(F.col("_word"), p))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), lost)
    text = F.when(has, F.array_join(F.transform(kept, lambda i: F.get(F.col("_lines"), i)), "\n")).otherwise(F.col(text_col))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.length(F.regexp_replace(text_col, "[^\n]+", "")) + 1).cast("long")
    n_deleted = F.coalesce(F.size("_gone"), F.lit(0)).cast("long")
    out = computed(found, n_lines=n_lines, n_deleted=n_deleted, _text=text)
    return out.select(*(F.col("_text").alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_deleted")), "n_lines", "n_deleted")


#: The rule itself, from the lines' own text: a run of one to three lines that occurred before, of three lines or with one of five words.
ORACLE = """
WITH docs AS (
  SELECT doc_id, text, doc_id IS NULL AS late, ('0x' || substr(md5(text), 1, 15))::BIGINT AS mark FROM documents
), lines AS (
  SELECT DISTINCT doc_id, late, mark, i, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t
  FROM (SELECT doc_id, late, mark, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs)
), worded AS (
  SELECT *, len(string_split_regex(t, '[\\x20\\x09-\\x0D]+')) >= 5 AS long FROM lines WHERE t <> ''
), around AS (
  SELECT *, row_number() OVER w AS p, lead(t, 1) OVER w AS t2, lead(t, 2) OVER w AS t3, lead(i, 1) OVER w AS i2, lead(i, 2) OVER w AS i3, lead(long, 1) OVER w AS long2
  FROM worded WINDOW w AS (PARTITION BY doc_id, late, mark ORDER BY i)
), runs AS (
  SELECT doc_id, late, mark, p, [t] AS run, [i] AS places FROM around WHERE long
  UNION ALL SELECT doc_id, late, mark, p, [t, t2], [i, i2] FROM around WHERE t2 IS NOT NULL AND (long OR long2)
  UNION ALL SELECT doc_id, late, mark, p, [t, t2, t3], [i, i2, i3] FROM around WHERE t3 IS NOT NULL
), later AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY late, doc_id, mark, p) AS nth FROM runs
), gone AS (
  SELECT doc_id, late, mark, list(DISTINCT i) AS gone FROM (SELECT doc_id, late, mark, unnest(places) AS i FROM later WHERE nth > 1) GROUP BY ALL
)
SELECT docs.doc_id,
       CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda i: NOT list_contains(gone, i)), lambda i: string_split(text, chr(10))[i]), chr(10)) END AS text,
       CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_deleted
FROM docs LEFT JOIN gone ON docs.doc_id IS NOT DISTINCT FROM gone.doc_id AND docs.mark IS NOT DISTINCT FROM gone.mark
"""
