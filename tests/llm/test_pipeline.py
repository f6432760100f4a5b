import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from glyphmill.llm import packing, secret_scan, simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute(docs, labels):
    """The pipeline's decisions before packing in plain Python over a list of rows."""
    held, turn = {}, {}
    for r in labels:
        held[r.doc_id] = max(r.toxic, held.get(r.doc_id, 0))
    for r in docs:
        turn[r["doc_id"]] = r["turn"]
    sample = [(toxicity.as_bytes(r["text"]), bool(held[r["doc_id"]])) for r in sorted(docs, key=lambda r: (r["turn"], r["doc_id"])) if r["doc_id"] in held and r["text"]]
    model, threshold = toxicity.fit(sample)
    docs = [r for r in docs if not model.score([toxicity.as_bytes(r["text"])])[0] > threshold]
    hi, lo, _ = simhash.fingerprints([r["text"] for r in docs])
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        d = np.bitwise_count(hi[i] ^ hi[i + 1 :]).astype(int) + np.bitwise_count(lo[i] ^ lo[i + 1 :])
        for j in np.flatnonzero(d <= 20):
            a, b = sorted((find(i), find(i + 1 + int(j))))
            root[b] = a
    docs = [r for i, r in enumerate(docs) if find(i) == i]
    return {r["doc_id"]: secret_scan.redact(r["text"]) for r in docs}


def windows(rows):
    """What lies in each window; the windows' numbers depend on how the table is partitioned."""
    held = {}
    for r in sorted(rows, key=lambda r: (r.pack_id, r.slot)):
        held.setdefault(r.pack_id, []).append((r.slot, r.doc_id, r.start_word, r.n_words, round(r.score, 6)))
    return sorted(held.values())


def test_pipeline_is_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in docs.withColumn("turn", F.xxhash64("doc_id")).orderBy("doc_id").collect()]
    want = brute(rows, spark.read.parquet(f"{sf}/labels.parquet").collect())
    staged = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        staged = stage(spark, staged, sf)
        assert staged.columns == COLUMNS
    assert {r.doc_id: r.text for r in staged.collect()} == want
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == set(want)
    direct = packing.pack_documents(spark.createDataFrame(list(want.items()), "doc_id bigint, text string")).collect()
    assert windows(out) == windows(direct)


def test_stages_take_odd_rows(spark, sf):
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, None, None, None, None), (None, "x y z", "en", "s", 5), (3, "", "en", "s", 0)]
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, slot int, toxic int"
    for sample, least in ((rows, 1), ([], 0)):
        docs = spark.createDataFrame([(*r, 0, 1) for r in sample], kind)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == [*COLUMNS, "slot", "toxic"]
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= least
