import hashlib
import re

import xxhash

from millrace.llm import fingerprint as fp

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def xx(*words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w if isinstance(w, bytes) else w.encode(), seed=h)
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plainly(text):
    words = WORD.findall(text or "")
    if not words:
        return []
    grams = [signed(xx(*words[i : i + 5])) for i in range(len(words) - 4)] or [signed(xx(" ".join(words), (5).to_bytes(4, "little")))]
    out = []
    for s in range(max(1, len(grams) - 9)):
        window = grams[s : s + 10]
        p = max(s + k for k, h in enumerate(window) if h == min(window))
        if not out or out[-1][0] != p:
            out.append((p, grams[p]))
    return out


def text_of(marks):
    return ",".join(f"{p}:{h & (1 << 64) - 1:X}" for p, h in marks)


def alike(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def verify(rows, docs):
    """docs: (id, text) in falling order of id."""
    want = []
    for k, (i, t) in enumerate(docs):
        t, after = t or "", docs[(k + 1) % len(docs)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        a, e, n = plainly(t), plainly(edited), plainly(after)
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), text_of(a), text_of(e), alike(a, e), alike(a, n)))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in rows]
    assert sorted(got) == sorted(want)


def run(spark, tmp_path, rows):
    from millrace.llm.queries import QUERIES

    spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, edited string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return QUERIES["op9_fingerprint"](spark, str(tmp_path)).collect()


def test_rows(spark, tmp_path):
    rows = [(9, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (7, None), (5, ""), (4, "é日本 😀 x\n\ty"), (3, "w " * 4000), (2, "a b"), (None, "last one of all")]
    verify(run(spark, tmp_path, rows), rows)
    verify(run(spark, tmp_path, rows[:1]), rows[:1])
    same = [(5, "same text here")] * 3
    verify(run(spark, tmp_path, same), same)
    assert run(spark, tmp_path, []) == []


def test_many_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_BYTES", 500)
    rows = [(i * i, f"document {i} says " + " ".join(f"w{(i * k) % 17}" for k in range(i % 40))) for i in reversed(range(200))]
    verify(run(spark, tmp_path, rows), rows)


def test_query(spark):
    from millrace.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    rows = QUERIES["op9_fingerprint"](spark, sf).collect()
    verify(rows, docs)
    long = [r for r in rows if r.n_chars > 300]
    assert min(r.near_edited for r in long) > 0.2 and sorted(r.near_next for r in long)[len(long) // 2] < 0.05
