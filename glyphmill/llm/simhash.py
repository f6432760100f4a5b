"""Near-duplicate removal by SimHash and multi-index hashing.

A document's fingerprint has 128 bits, each the sign of a sum over its distinct words. Two documents
are near copies where at most `radius` bits differ. By the pigeonhole rule such a pair agrees on at
least one of `segments` bit ranges up to floor(radius / segments) bits, so for each range the small
Hamming ball around its value is enumerated, table matches are fetched, and the complete distance
decides. The search is exact: what pairs within the radius connect is connected, and no partner is cut
off; of a bucket's near pairs only so many are handed on as connect its rows.

The tables of a range are spread over buckets by the first bits of its value. A fingerprint is sent
to the few buckets whose first bits lie within the ball (1 + p + p(p-1)/2 of them for p bits and a
ball of 2) and enumerates the rest of the ball there. p follows the logarithm of the number of
distinct fingerprints, so a bucket's size stays the same as the corpus grows.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .shared import only, saved
from .textutil import mix64, text_steps, word_hashes

BITS = 128
_CHUNK = 1 << 16
#: Pairs that are compared at once.
_PAIRS = 1 << 20


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high half, low half, number of distinct words) for each text."""
    words, counts = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((words, owner))
    words, owner = words[order], owner[order]
    fresh = np.ones(len(words), dtype=bool)
    fresh[1:] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
    words, owner = words[fresh], owner[fresh]
    kinds = np.bincount(owner, minlength=len(texts))
    halves = []
    for salt in (1, 2):
        ones = np.zeros((len(texts), 64), dtype=np.int64)
        mixed = mix64(words + np.uint64(salt * 0x632BE59BD9B4E019 % (1 << 64)))
        for a in range(0, len(mixed), _CHUNK):
            bits = np.unpackbits(mixed[a : a + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            part = owner[a : a + _CHUNK]
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            ones[part[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        signs = (2 * ones > kinds[:, None]).astype(np.uint8)
        halves.append(np.packbits(signs, axis=1, bitorder="little").view(np.uint64).ravel() if len(texts) else np.zeros(0, np.uint64))
    return halves[0], halves[1], kinds


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, hi, lo) of the documents that have an id and at least one word."""

    def run(batches):
        for batch in batches:
            for a, b, texts in text_steps(batch, "text", 1_000_000):
                hi, lo, kinds = fingerprints(texts)
                table = pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64))], names=["doc_id", "hi", "lo"])
                yield table.filter(pa.array(kinds > 0))

    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint")).dropna()
    return rows.mapInArrow(run, "doc_id bigint, hi bigint, lo bigint")


def _ranges(segments: int) -> list[tuple[int, int]]:
    edges = [round(BITS * i / segments) for i in range(segments + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _cut(hi: np.ndarray, lo: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Bits begin to end of the fingerprint lo + 2^64 hi, as a number."""
    mask = np.uint64((1 << (end - begin)) - 1)
    if end <= 64:
        return (lo >> np.uint64(begin)) & mask
    if begin >= 64:
        return (hi >> np.uint64(begin - 64)) & mask
    return ((lo >> np.uint64(begin)) | (hi << np.uint64(64 - begin))) & mask


def _ball(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(width), k)], dtype=np.uint64)


def _probes(prefix_bits: int, segments: int, reach: int):
    """Blocks of fingerprints for each range and bucket. Of two buckets within reach only the one with
    the larger number is sent the other's fingerprints, since a pair needs to meet once."""

    def run(batches):
        for batch in batches:
            ids, hi, lo = (np.asarray(batch.column(i)) for i in range(3))
            uhi, ulo = hi.view(np.uint64), lo.view(np.uint64)
            for k, (begin, end) in enumerate(_ranges(segments)):
                p = min(prefix_bits, end - begin)
                home = _cut(uhi, ulo, begin, end) >> np.uint64(end - begin - p)
                for flip in _ball(p, reach):
                    bucket = home ^ flip
                    at = np.flatnonzero(bucket >= home)
                    at = at[np.argsort(bucket[at], kind="stable")]
                    first = np.flatnonzero(np.r_[True, bucket[at][1:] != bucket[at][:-1]]) if len(at) else np.zeros(0, np.int64)
                    blocks = np.split(at, first[1:]) if len(at) else []
                    n = len(blocks)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, k, np.int32)), pa.array(bucket[at[first]].astype(np.int32)), pa.array(np.full(n, reach - int(flip).bit_count(), np.int32)), pa.array([np.concatenate([ids[x], hi[x], lo[x]]).tobytes() for x in blocks], pa.binary())],
                        names=["seg", "bucket", "room", "block"],
                    )

    return run


def join_labels(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after linked rows x and y have come to share the smaller one; a label is a row that has it itself."""
    while True:
        a, b = labels[x], labels[y]
        apart = a != b
        if not apart.any():
            return labels
        parent = np.arange(len(labels))
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        labels = parent[labels]
        while (parent[labels] != labels).any():
            labels = parent[labels]


def _matcher(prefix_bits: int, segments: int, reach: int, radius: int):
    """Links between the fingerprints of a bucket: enough of them to connect whatever the complete
    distances connect, and no more than rows. Rows that are connected already aren't compared again."""
    spans = _ranges(segments)

    def match(table: pa.Table) -> pa.Table:
        k = table.column("seg")[0].as_py()
        begin, end = spans[k]
        width = end - begin - min(prefix_bits, end - begin)
        blocks = [np.frombuffer(x, dtype=np.int64).reshape(3, -1) for x in table.column("block").to_pylist()]
        ids, hi, lo = np.concatenate(blocks, axis=1)
        hi, lo = hi.view(np.uint64), lo.view(np.uint64)
        room = np.repeat(table.column("room").to_numpy(), [x.shape[1] for x in blocks])
        low = _cut(hi, lo, begin, begin + width) if width else np.zeros(len(ids), np.uint64)
        home = np.flatnonzero(room == reach)  # its own prefix: the row is in the table itself
        home = home[np.argsort(low[home], kind="stable")]
        keys, first, count = np.unique(low[home], return_index=True, return_counts=True)
        labels = np.arange(len(ids))

        def near(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ok = np.bitwise_count(hi[x] ^ hi[y]).astype(np.int64) + np.bitwise_count(lo[x] ^ lo[y]) <= radius
            return x[ok], y[ok]

        if len(home):  # each row with the first of its key: variants of one template come together at once
            labels = join_labels(labels, *near(home, np.repeat(home[first], count)))
        for flip in sorted(_ball(width, reach).tolist(), key=int.bit_count):
            able = np.flatnonzero(room >= flip.bit_count())
            wanted = low[able] ^ np.uint64(flip)
            slot = np.searchsorted(keys, wanted).clip(0, max(0, len(keys) - 1))
            hit = keys[slot] == wanted if len(keys) else np.zeros(len(wanted), bool)
            able, slot = able[hit], slot[hit]
            if not len(able):
                continue
            least, most = np.minimum.reduceat(labels[home], first), np.maximum.reduceat(labels[home], first)
            new = (least[slot] != most[slot]) | (least[slot] != labels[able])  # else all of that key is connected with the row
            able, slot = able[new], slot[new]
            ends, a = np.cumsum(count[slot]), 0
            while a < len(able):  # bounds what is expanded at once
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _PAIRS, side="right")))
                n = count[slot[a:b]]
                x = np.repeat(able[a:b], n)
                y = home[np.repeat(first[slot[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                ok = labels[x] != labels[y]
                labels = join_labels(labels, *near(x[ok], y[ok]))
                a = b
        x = np.flatnonzero(labels != np.arange(len(ids)))
        y = labels[x]
        return pa.table({"a": np.minimum(ids[x], ids[y]), "b": np.maximum(ids[x], ids[y])})

    return match


def near_links(reps: DataFrame, total: int, radius: int = 20, segments: int = 7, bucket_rows: int = 50_000) -> DataFrame:
    """(a, b) with a <= b: links of (id, hi, lo) rows whose connected components are those of all pairs
    within the radius. A bucket gives fewer links than it has rows, however many pairs are near."""
    reach = radius // segments
    prefix_bits = max(0, math.ceil(math.log2(max(1, total / bucket_rows))))
    rows = reps.mapInArrow(_probes(prefix_bits, segments, reach), "seg int, bucket int, room int, block binary")
    return rows.groupBy("seg", "bucket").applyInArrow(_matcher(prefix_bits, segments, reach, radius), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each node of (a, b) reaches. Labels hop along edges and through
    the labels' own labels; every round is kept in the shared folder, so lineage stays short."""
    both = saved(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).repartition("a"))
    labels = saved(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "id"))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("heard"))
        hop = labels.join(near, "id", "left").select("id", "root", F.least("root", F.coalesce("heard", "root")).alias("seen"))
        jump = labels.select(F.col("id").alias("seen"), F.col("root").alias("further"))
        step = saved(hop.join(jump, "seen", "left").select("id", F.col("root").alias("was"), F.least("seen", F.coalesce("further", "seen")).alias("root")))
        changed = step.filter("was <> root").limit(1).count()
        labels = step.select("id", "root")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, radius: int = 20, segments: int = 7) -> DataFrame:
    """(doc_id, keeper_id) for every document that a copy or near copy with a smaller doc_id replaces.

    Groups are the connected components of "at most `radius` of 128 bits differ"; the smallest doc_id
    of a group is its keeper and has no row. Documents with a NULL id, a NULL text or no word at all
    belong to no group. Rows that repeat a doc_id count as one document and give one row at most; of
    different texts under one doc_id each links that id to what is near it. An empty table gives an
    empty result; columns other than doc_id and text are ignored; texts are taken whole.
    """
    rows = saved(signatures(docs))
    same = rows.groupBy("hi", "lo").agg(F.min("doc_id").alias("id"))
    reps = saved(same)
    # one fingerprint may stand for several documents and one id for several fingerprints; both are edges
    exact = rows.join(reps, ["hi", "lo"]).filter("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b")).distinct()
    found = near_links(reps.select("id", "hi", "lo"), reps.count(), radius, segments)
    groups = components(found.unionByName(exact))
    return groups.filter("id <> root").select(F.col("id").alias("doc_id"), F.col("root").alias("keeper_id"))


def drop_near_duplicates(docs: DataFrame, radius: int = 20, segments: int = 7) -> DataFrame:
    """Rows of docs without those that near_duplicates names, and one row for each doc_id that repeats.

    Of rows that share a doc_id the one with the smallest text stays (NULL first), and of those the one
    with the smallest hash of all columns. Rows with a NULL doc_id stay. Columns, also extra ones, are
    those of docs.
    """
    gone = saved(near_duplicates(docs, radius, segments).select(F.col("doc_id").alias("__gone")))
    many = saved(docs.groupBy(F.col("doc_id").alias("__gone")).count().filter("count > 1 and __gone is not null").select("__gone"))
    kept = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    if not many.take(1):
        return kept
    match = kept["doc_id"] == many["__gone"]
    order = Window.partitionBy("doc_id").orderBy("text", F.xxhash64(F.to_json(F.struct("*"))))
    first = kept.join(many, match, "left_semi").withColumn("__nth", F.row_number().over(order)).filter("__nth = 1").drop("__nth")
    return kept.join(many, match, "left_anti").unionByName(first)
