import re
from collections import Counter

import numpy as np
from millrace.llm import decision_list as dl

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plainly(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dups, len(covered)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_statistics(spark):
    texts = [None, "", " \n\t ", "a", "a b c d e", "a b c d e a b c d e", "x x x x x x x", "é ü 日本 a\n\n b \n b \nb", "#*$ %&|<> #" * 3, "a b c d e f g h a b c d e x y a b c d e " * 3, "l\nl\n \nl", "w " * 30000 + "z"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    found = {r.doc_id: tuple(r[n] for n in NAMES) for r in dl.statistics(docs).collect()}
    assert found == {i: plainly(t) for i, t in enumerate(texts)}
    assert dl.statistics(docs.limit(0)).count() == 0


def test_rules_are_found_and_read():
    rng = np.random.default_rng(1)
    x = rng.random((600, len(dl.FEATURES)))
    bad = (x[:, 2] > 0.7) & (x[:, 1] <= 0.5) | (x[:, 4] > 0.9)
    rules = dl.learn(x, bad, np.arange(600) % 3)
    hit = np.any([dl.covers(r, x) for r in rules], axis=0)
    assert (hit == bad).mean() > 0.97 and {c.feature for r in rules for c in r} == {"repeats", "symbols", "word_length"}
    assert dl.learn(x, np.zeros(600, bool), np.arange(600) % 3) == []


def test_query(spark):
    from millrace.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op4_decision_list"](spark, SF).collect()
    rules = dl.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert rules and len(rows) == len(docs)
    for r in rows:
        n, chars, symbols, dups, repeats = plainly(docs[r.doc_id])
        assert tuple(r[x] for x in NAMES) == (n, chars, symbols, dups, repeats)
        failed = n < 10 or 100 * repeats > 20 * n
        x = np.array([[n, *(v / n if n else np.nan for v in (chars, symbols, dups, repeats))]])
        assert r.base_failed == failed and r.kept == (not failed and not any(dl.covers(rule, x)[0] for rule in rules))
    marked = [(labels[r.doc_id], r.kept) for r in rows if r.doc_id in labels and not r.base_failed]
    assert sum(kept for q, kept in marked if q) >= 0.99 * sum(q for q, _ in marked)
    assert sum(kept for q, kept in marked if not q) <= 0.1 * sum(not q for q, _ in marked)


def test_labels_of_all_kinds(spark):
    docs = spark.createDataFrame([(1, "a " * 20), (1, "a " * 20), (None, "b c " * 9), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, None), (None, 0), (9, 1), (2, 5)], "doc_id long, quality int")
    assert dl.judge(docs, labels).count() == 4
    assert [r.kept for r in dl.judge(docs.limit(0), labels.limit(0)).collect()] == []
    words = " ".join(f"w{i}" for i in range(50))
    assert [r.kept for r in dl.judge(spark.createDataFrame([(3, words)], docs.schema), labels).collect()] == [True]
