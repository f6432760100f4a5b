"""Toxicity by class-conditional Kneser-Ney models over bytes.

A toxic and an ordinary model are fitted on labelled documents; a document's score is the mean
log-likelihood ratio of its bytes, and a threshold calibrated on held-out labelled rows decides.
Orders 3 to 5 are of a class; below them both models back off to one chain of continuation counts over
the texts of both classes, so that strings which are rare in both are neutral.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .charlm import RatioModel, best_threshold
from .shared import only
from .textutil import text_steps

SCHEMA = "doc_id bigint, llr double, is_toxic boolean"


def as_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.lower().encode("utf-8", "surrogatepass")


def sampled(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(turn, doc_id, toxic, text) of at most per_class labelled documents of each class, those whose hash of
    doc_id, turn, comes first.

    A document with contradicting labels counts as toxic; rows with NULLs and empty texts are left out; of
    several texts under one doc_id the smallest is taken.
    """
    flat = only(labels, "doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("turn", F.xxhash64("doc_id"))
    picked = None
    for toxic in (1, 0):
        part = flat.filter(F.col("toxic") == toxic).orderBy("turn", "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # the sample is bounded by 2 * per_class rows of ids, so it may be broadcast at any corpus size
    found = only(docs, "doc_id", "text").dropna().filter(F.length("text") > 0).join(F.broadcast(picked), "doc_id")
    return found.groupBy("turn", "doc_id", "toxic").agg(F.min("text").alias("text"))


def _in_turn(rows: list) -> list[tuple[bytes, bool]]:
    return [(as_bytes(r["text"]), bool(r["toxic"])) for r in sorted(rows, key=lambda r: (r["turn"], r["doc_id"]))]


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> list[tuple[bytes, bool]]:
    """The sampled texts in turn, on the driver; fitted() doesn't bring them there."""
    return _in_turn(sampled(docs, labels, per_class).collect())


def fitted(docs: DataFrame, labels: DataFrame, order: int, shared: int, per_class: int) -> bytes | None:
    """What fit() makes of the sample, pickled; None where no class or only one is labelled. One task fits, so
    the driver holds neither the texts nor what counting them takes."""

    def run(batches):
        sample = _in_turn([r for batch in batches for r in batch.to_pylist()])
        if len({toxic for _, toxic in sample}) == 2:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sample, order, shared))], pa.binary())], names=["model"])

    row = sampled(docs, labels, per_class).repartition(1).mapInArrow(run, "model binary").first()
    return bytes(row.model) if row else None


def fit(sample: list[tuple[bytes, bool]], order: int = 5, shared: int = 2, held_out: int = 5) -> tuple[RatioModel, float]:
    """Models from all but every held_out-th row of each class, and the threshold from those rows."""
    sides = {True: [], False: []}
    for data, toxic in sample:
        sides[toxic].append(data)
    test = {k: v[held_out - 1 :: held_out] for k, v in sides.items()}
    train = {k: [x for i, x in enumerate(v) if i % held_out != held_out - 1] for k, v in sides.items()}
    model = RatioModel(order, "kneser_ney", shared=shared).fit(train[True], train[False])
    held = test[True] + test[False]
    y = np.array([True] * len(test[True]) + [False] * len(test[False]))
    return model, best_threshold(model.score(held), y)


def score_toxicity(docs: DataFrame, labels: DataFrame, order: int = 5, shared: int = 2, per_class: int = 2000) -> DataFrame:
    """(doc_id, llr, is_toxic) for every row of docs.

    docs needs doc_id and text; labels needs doc_id and toxic; other columns of either are ignored.
    A NULL or empty text has llr NULL and is not toxic, and so has every row when no class or only
    one class is labelled. A score equal to the threshold is not toxic. Repeated rows are scored
    one by one; NULL ids are carried through; whole texts are scored whatever their length. The models
    are fitted on at most per_class labelled documents of each class.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(fitted(docs, labels, order, shared, per_class))

    def run(batches):
        model, threshold = pickle.loads(held.value) if held.value else (None, 0.0)
        for batch in batches:
            for a, b, texts in text_steps(batch, "text", 1_000_000):
                scores = model.score([as_bytes(t) for t in texts]) if model else np.full(b - a, np.nan)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(scores, mask=np.isnan(scores)), pa.array(scores > threshold)],
                    names=["doc_id", "llr", "is_toxic"],
                )

    return only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(run, SCHEMA)


def drop_toxic(docs: DataFrame, labels: DataFrame, order: int = 5, shared: int = 2, per_class: int = 2000) -> DataFrame:
    """Rows of docs that aren't rejected, with their columns; the text is scored within one pass.

    A NULL or empty text stays. Extra columns are carried, whatever their names.
    """
    spark = docs.sparkSession
    found = fitted(docs, labels, order, shared, per_class)
    if not found:
        return docs
    held = spark.sparkContext.broadcast(found)

    def run(batches):
        model, threshold = pickle.loads(held.value)
        for batch in batches:
            keep = []
            for _, _, texts in text_steps(batch, "text", 1_000_000):
                keep.append(~(model.score([as_bytes(t) for t in texts]) > threshold))
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
