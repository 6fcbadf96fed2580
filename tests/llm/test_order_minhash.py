import glob
import hashlib
import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import order_minhash as om
from millrace.llm.common import FILE_CLEANUP


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=24), st.lists(st.integers(0, 3), max_size=24), st.integers(0, 12))
def test_banded_distance(a, b, band):
    assert om.banded_distance(a, b, band) == min(plain_distance(a, b), band + 1)


def test_labels_tell_occurrences_apart():
    found = np.array([5, 7, 5, 5, 7], np.uint64)
    assert len(set(om.labelled(found).tolist())) == 5
    assert om.labelled(found)[[0, 1]].tolist() == [5, 7]


def test_order_counts():
    one, two = "a b c d e f", "u v w x y z q r s t"
    assert (om.sketch(om.grams(f"{one} {two}")) != om.sketch(om.grams(f"{two} {one}"))).any()
    assert len(om.sketch(om.grams(""))) == 0 and len(om.sketch(om.grams("a b"))) == om.REPEATS


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + rng.randrange(2)] = [f"new{rng.randrange(10**6)}"] * rng.randrange(2)
    return words


def plainly(rows):
    """Class of each row from all pairs of distinct texts."""
    texts = sorted({t or "" for _, t in rows})
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    found = {t: om.grams(t) for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            longest = max(len(found[a]), len(found[b]))
            if longest and abs(len(found[a]) - len(found[b])) <= 0.2 * longest and find(a) != find(b) and len(set(found[a].tolist()) & set(found[b].tolist())) > 0.3 * longest:
                if plain_distance(found[a].tolist(), found[b].tolist()) <= 0.2 * longest + 1e-9:
                    root[find(a)] = find(b)
    least = {}
    for i, t in rows:
        if i is not None:
            least[find(t or "")] = min(i, least.get(find(t or ""), i))
    return {(i, t): least.get(find(t or "")) for i, t in rows}


def corpus(seed, groups=25, singles=40):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [" ".join(word() for _ in range(rng.randrange(1, 90))) for _ in range(singles)]
    passage = [word() for _ in range(40)]
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(40, 120))]
        texts += [" ".join(edited(rng, base, rng.randrange(1 + len(base) // 30))) for _ in range(rng.randrange(1, 6))]
        texts.append(" ".join(passage + base[:20]))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_classes(spark):
    rows = corpus(1) + [(900, None), (901, ""), (902, " "), (None, "null id text of a few words here"), (None, "another null id, other text of words"), (903, "w1 w2 w1 w2 " * 3000), (904, "w1 w2 w1 w2 " * 2990), (5, "same id other text than before in row five")]
    rows += [rows[3], rows[3]]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, node string, n int")
    found = om.classes(docs).collect()
    want = plainly([r for r in rows if r[0] not in (903, 904)])
    want |= {rows[i]: 903 for i in range(len(rows)) if rows[i][0] in (903, 904)}
    assert len(found) == len(rows)
    assert sorted((str(r.doc_id), str(r.class_id)) for r in found) == sorted((str(i), str(want[i, t])) for i, t in rows)
    kept = om.keep_first(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert len(kept) == len({r.group for r in found})
    assert {r.doc_id for r in kept} == {r.class_id for r in found}


def versions(seed, count):
    """A text of 3000 words, and versions with nine passages of 58 new words: each alike to the text, not to each other."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    rows = [" ".join(base)]
    for v in range(count):
        words = list(base)
        for at in sorted(rng.sample(range(3000), 9), reverse=True):
            words[at:at] = [f"v{v}x{rng.randrange(10**6)}" for _ in range(58)]
        rows.append(" ".join(words))
    return rows


def test_all_that_share_a_bucket_are_compared(spark):
    texts = versions(5, 150)
    assert om.alike(om.grams(texts[0]), om.grams(texts[1])) and not om.alike(om.grams(texts[2]), om.grams(texts[1]))
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(8)
    nodes = om._nodes(docs, "doc_id", "text")
    sketches = [set(om.sketch(om.grams(t)).tolist()) for t in texts]
    meets = [i for i, s in enumerate(sketches) if s & sketches[0]]
    assert len(meets) > 130
    single = om.cut(om.sketched(nodes))
    old, om.BLOCK = om.BLOCK, 16
    try:
        pairs, drawn = ([(bytes(r.node), bytes(r.pivot)) for r in step.collect()] for step in (om.unmet(single, None), om.candidates(single)))
    finally:
        om.BLOCK = old
    number = {hashlib.md5(t.encode()).digest(): i for i, t in enumerate(texts)}
    want = set()
    for a in range(len(texts)):
        for b in range(a):
            if sketches[a] & sketches[b]:
                want.add((a, b))
    got, some = ([tuple(sorted((number[x], number[y]), reverse=True)) for x, y in found] for found in (pairs, drawn))
    assert len(got) == len(set(got)) and set(got) <= want
    assert {(i, 0) for i in meets if i} <= set(got)
    assert not {(i, 0) for i in meets if i} <= set(some)  # the drawn partners alone are not all


def test_overlap_with_a_deletion_and_an_insertion_elsewhere():
    for size, moved in ((904, 100), (95, 10)):
        words = [f"w{i}" for i in range(size)]
        a, b = om.grams(" ".join(words)), om.grams(" ".join(words[moved:] + [f"n{i}" for i in range(moved)]))
        common = len(set(a.tolist()) & set(b.tolist()))
        assert common >= 0.8 * (2 * len(a) - common) and om.banded_distance(a.tolist(), b.tolist(), len(a)) > 0.2 * len(a)
        assert om.alike(a, b)


def test_profiles_forbid_no_alike_pair():
    rng = random.Random(6)
    alike = 0
    for _ in range(400):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(5, 200))]
        a, b = (om.grams(" ".join(edited(rng, base, rng.randrange(6)))) for _ in range(2))
        if om.alike(a, b):
            alike += 1
            p, q = (np.frombuffer(om.profile(x), np.uint8) for x in (a, b))
            assert om.may_be_alike(np.int64(len(a)), p, np.int64(len(b)), q)
    assert alike > 50


def test_few_and_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert om.classes(docs).count() == om.keep_first(docs).count() == 0
    alone = spark.createDataFrame([(1, "x")], docs.schema)
    assert [tuple(r) for r in om.keep_first(alone).collect()] == [(1, "x")]


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(bytearray([i + 1]), bytearray([i])) for i in range(60)] + [(bytearray([90]), bytearray([91]))], "node binary, pivot binary")
    found = {r.node[0]: r.root[0] for r in om.components(links).collect()}
    assert found == {**{i: 0 for i in range(61)}, 90: 90, 91: 90}


def test_components_grow_with_links(spark):
    rng = random.Random(4)
    links = [(rng.randrange(90), rng.randrange(90)) for _ in range(70)]
    frame = lambda part: spark.createDataFrame(part, "node long, pivot long").filter("node <> pivot")
    roots = None
    for at in range(0, 75, 15):
        roots = om.joined_components(roots, frame(links[at : at + 15] or [(1, 1)]))
    want = {r.node: r.root for r in om.components(frame(links)).collect()}
    found = {r.node: r.root for r in roots.collect()}
    assert len(found) == roots.count() and found == want


def test_no_shuffle_files_stay_behind(spark):
    folders = [str(d) for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {f for top in folders for f in glob.glob(f"{top}/*/shuffle_*")}
    nodes = om._nodes(spark.createDataFrame(corpus(2), "doc_id long, text string").repartition(4), "doc_id", "text")
    setting = spark.conf.get(FILE_CLEANUP)
    before = files()
    assert om.near_roots(nodes) is not None
    end = time.time() + 10
    while files() - before and time.time() < end:  # they go a moment later
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(FILE_CLEANUP) == setting


def test_query(spark):
    from millrace.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plainly(rows)
    found = {r.doc_id: r.class_id for r in QUERIES["op10_order_minhash"](spark, sf).collect()}
    assert found == {i: want[i, t] for i, t in rows}
