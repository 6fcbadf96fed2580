import numpy as np
import public_tokenizers as P

from tests.llm import test_decision_list as quality
from tests.llm import test_line_winnow as lines
from tests.llm import test_order_minhash as near
from tests.llm import test_packing as packing


def test_pipeline_against_plain_python(spark):
    import corpus_pipeline
    from millrace.llm import decision_list as dl
    from millrace.llm.pii import redacted

    sf = "/root/testdata/sf0.001"
    raw = spark.read.parquet(f"{sf}/documents.parquet")
    docs = {r.doc_id: r.text for r in raw.collect()}
    rules = dl.fit(raw, spark.read.parquet(f"{sf}/labels.parquet"))

    def good(text):
        n, *rest, repeats = quality.plainly(text)
        x = np.array([[n, *(v / n if n else np.nan for v in (*rest, repeats))]])
        return n >= 10 and 100 * repeats <= 20 * n and not any(dl.covers(rule, x)[0] for rule in rules)

    docs = {i: t for i, t in docs.items() if good(t)}
    plain = lines.plainly(list(docs.items()))
    docs = {i: plain[i, t] for i, t in docs.items() if len(plain[i, t].split()) >= 10}
    classes = near.plainly(list(docs.items()))
    docs = {i: redacted(t) for i, t in docs.items() if classes[i, t] == i}
    from pyspark.sql import functions as F

    found = corpus_pipeline.run(spark, sf).withColumn("ids_crc32", F.crc32("ids")).collect()
    packing.verify(found, docs, 4096)
    assert len(docs) > 50 and P.path("word_bpe_49k.json")


def test_stages_keep_columns_and_bear_nulls(spark, tmp_path):
    import corpus_pipeline

    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words, "x"), (1, words, "x"), (None, words + " end", None), (2, None, "y"), (3, "", "z"), (4, words.upper() + " me@x.org", "k")]
    rows = [(*r, 7, "clash") for r in rows]
    spark.createDataFrame(rows, "doc_id long, text string, n_words string, n_lines int, _id string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    assert sorted((r.doc_id, r.text[-10:], r.n_words, r.n_lines, r["_id"]) for r in docs.collect()) == [(1, words[-10:], "x", 7, "clash"), (4, "39 [EMAIL]", "k", 7, "clash")]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0), str(tmp_path)).count() == 0
