"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from glyphmill import queries as own
from glyphmill.operators.encode import encode_documents
from glyphmill.session import local_session, shipped

HEADLINE = ("pretoken_tally_gpt2", "pretoken_tally_gpt4o", "script_aware_tally", "pair_counts_words", "superword_runs", "ngram_counts", "train_ops", "encode_documents_ids", "decode_roundtrip")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = shipped(local_session(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    every, took = own.queries(), {}
    for name in HEADLINE:
        began = time.time()
        every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    chars = docs.selectExpr("sum(length(text))").first()[0]
    encoder = own._encoder(spark, sf_dir)
    began = time.time()
    encode_documents(docs.repartition(int(cpus) * 4), encoder).write.format("noop").mode("overwrite").save()
    encode = time.time() - began
    print(json.dumps({"metric": "total time of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1], "cores": cpus, "encode_chars": chars, "encode_chars_per_sec": round(chars / encode), "vocabulary": own.VOCAB_SIZE}))


if __name__ == "__main__":
    main()
