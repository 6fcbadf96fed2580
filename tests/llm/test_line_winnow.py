import hashlib
import random

import duckdb

from millrace.llm import line_winnow

LAST = (1 << 63) - 1


def h60(s):
    return int(hashlib.md5(s.encode()).hexdigest()[:15], 16)


def plainly(rows):
    """Texts by (doc, text), from the rule: every run of one to three lines that stood before goes, if it has three or one of five words."""
    docs = sorted({(LAST if i is None else i, h60(t), t) for i, t in rows if t is not None})
    seen, gone = set(), {}
    for doc, mark, text in docs:
        lines = [(i, t) for i, t in enumerate(line.strip(" \t\x0b\x0c\r") for line in text.split("\n")) if t]
        for p in range(len(lines)):
            for size in (1, 2, 3):
                part = lines[p : p + size]
                if len(part) == size and (size == 3 or any(len(t.split()) >= 5 for _, t in part)):
                    run = tuple(t for _, t in part)
                    if run in seen:
                        gone.setdefault((doc, mark), set()).update(i for i, _ in part)
                    seen.add(run)
    return {(doc, text): "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone.get((doc, mark), ())) for doc, mark, text in docs}


def compare(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, lines string, n_lines int")
    want = plainly(rows)
    found = line_winnow.deduplicate(docs).collect()
    got = sorted((str(r.doc_id), str(r.text), r.n_lines, r.n_deleted) for r in found)
    expected = []
    for i, t in rows:
        kept = None if t is None else want[LAST if i is None else i, t]
        n = 0 if t is None else t.count("\n") + 1
        expected.append((str(i), str(kept), n, 0 if t is None else n - (kept.count("\n") + 1 if kept or n == 1 and t == kept else 0)))
    assert [g[:3] for g in got] == [e[:3] for e in sorted(expected)]
    return {r.doc_id: r for r in found}


def test_small_cases(spark):
    a, b, c, d = ("one two three four five %s" % x for x in "abcd")
    rows = [(1, f"{a}\n{b}\n{c}"), (2, f"x\n{a}\n{b}\n{c}\ny"), (3, f"{d}\n\n{a} \n{d}"), (4, "short\nshort\nshort\nshort"), (None, a), (None, a), (5, None), (6, ""), (7, "\n \n"), (1, f"{a}\n{b}\n{c}")]
    found = compare(spark, rows)
    assert found[2].text == "x\ny" and found[2].n_deleted == 3
    assert found[1].text == f"{a}\n{b}\n{c}"


def test_random_documents(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdefg") for _ in range(rng.choice((1, 2, 4, 6, 9)))) for _ in range(40)]
    rows = [(i, "\n".join(rng.choice([*pool, "", f"own {i} {k} w w w"]) for k in range(rng.randrange(1, 14)))) for i in range(150)]
    rows += [(200, "\n".join(pool[k % 40] for k in range(3000)))]
    compare(spark, rows)


def test_a_run_whose_lines_first_stood_elsewhere(spark):
    """Each line, and each pair of lines, of the later run has its first occurrence in another setting."""
    rows = [(1, "A\nB\nx"), (2, "y\nB\nC"), (3, "p\nA\nB\nC\nq"), (4, "r\nA\nB\nC\ns")]
    assert compare(spark, rows)[4].text == "r\ns"


def test_a_long_line_between_new_ones(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(i, "\n".join([f"new line {i} {k} of some words" for k in range(5)] + [long] + [f"after it {i} {k} of some words" for k in range(4)])) for i in range(30)]
    found = compare(spark, rows)
    assert [long in found[i].text for i in range(30)] == [True] + [False] * 29


def test_every_run_of_short_lines_that_stood_before_goes(spark):
    """The promise, not the definition: any later copy of three or more lines, whatever they are, is gone whole."""
    rng = random.Random(8)
    pool = [rng.choice("abcdef") + rng.choice(("", " b", " b c d e")) for _ in range(30)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(3, 12)))) for i in range(120)]
    found = compare(spark, rows)
    before = set()
    for i, text in rows:
        lines, kept = text.split("\n"), found[i].text.split("\n")
        keep = [True] * len(lines)
        for p in range(len(lines) - 2):
            if tuple(lines[p : p + 3]) in before:
                keep[p : p + 3] = [False] * 3
        left = [x for x, k in zip(lines, keep, strict=True) if k]
        it = iter(left)
        assert kept == [""] or all(x in it for x in kept)  # nothing else is left
        before |= {tuple(lines[p : p + 3]) for p in range(len(lines) - 2)}


def test_text_ids_and_the_greatest_id(spark):
    line = "one two three four five six"
    texts = spark.createDataFrame([("b", line), ("a", line), (None, line), ("c", "x")], "doc_id string, text string")
    assert sorted((str(r.doc_id), r.text) for r in line_winnow.deduplicate(texts).collect()) == [("None", ""), ("a", line), ("b", ""), ("c", "x")]
    numbers = spark.createDataFrame([(LAST, line), (None, line)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in line_winnow.deduplicate(numbers).collect()) == [(str(LAST), line), ("None", "")]


def test_empty_table(spark):
    assert line_winnow.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_sql(spark):
    from millrace.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, text, n_lines, n_deleted FROM ({ORACLES['op3_line_winnow']})").fetchall())
    found = sorted((r.doc_id, r.text, r.n_lines, r.n_deleted) for r in QUERIES["op3_line_winnow"](spark, sf).collect())
    assert found == want and sum(r[3] for r in found) > 500
    rows = [(r[0], r[1]) for r in con.execute("SELECT doc_id, text FROM documents").fetchall()]
    plain = plainly(rows)
    assert [r[1] for r in found] == [plain[k] for k in sorted(rows)]
