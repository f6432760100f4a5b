"""Greedy partition of chunks by a dictionary of n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.pretokenize import parts
from .ngrams import hashes_of, longer, ngram_counts, packed


def split_greedily(tokens: list[bytes], grams: set[tuple[bytes, ...]], prefixes: set[tuple[bytes, ...]]) -> list[list[bytes]]:
    """From the left the longest n-gram of two or more tokens, else a single token."""
    out, at = [], 0
    while at < len(tokens):
        size = 1
        for end in range(at + 1, len(tokens) + 1):
            candidate = tuple(tokens[at:end])
            if candidate not in prefixes:
                break
            if candidate in grams:
                size = end - at
        out.append(tokens[at : at + size])
        at += size
    return out


def prefixes_of(grams: set[tuple[bytes, ...]]) -> set[tuple[bytes, ...]]:
    return {g[:n] for g in grams for n in range(1, len(g) + 1)}


def _flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Tokens of lists one after the other, and the lists' lengths."""
    lists = column.cast(pa.list_(pa.binary()))
    return lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, g, whole) of n-grams and of their beginnings of two or more tokens: two hashes, and whether it's an n-gram itself."""
    for batch in batches:
        words, lengths = _flat(batch.column(0))
        singles = hashes_of(words)
        at, size = (np.cumsum(lengths) - lengths)[lengths > 1], lengths[lengths > 1]
        hashes, n = [s[at] for s in singles], 2
        while len(at):
            hashes = longer(hashes, singles, at + n - 1)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[0].view(np.int64)), pa.array(hashes[1].view(np.int64)), pa.array((size == n).astype(np.int64))], ["h", "g", "whole"])
            at, hashes, size, n = at[size > n], [h[size > n] for h in hashes], size[size > n], n + 1


def _split(held):
    """(tokens, cnt) parted by the dictionary; as split_greedily does, for all chunks of a slice at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, second, whole = held.value
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
            for a, b in parts(sizes, 1 << 17):
                words, lengths = _flat(batch.column(0).slice(a, b - a))
                singles = hashes_of(words)
                left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(words))
                steps = np.ones(len(words), dtype=np.int64)
                at, hashes, n = np.arange(len(words)), singles, 2
                while len(at):
                    on = left[at] >= n
                    at = at[on]
                    hashes = longer([h[on] for h in hashes], singles, at + n - 1)
                    found = np.minimum(np.searchsorted(known, hashes[0]), len(known) - 1)
                    hit = (known[found] == hashes[0]) & (second[found] == hashes[1])
                    at, hashes, found = at[hit], [h[hit] for h in hashes], found[hit]
                    steps[at[whole[found]]] = n
                    n += 1
                starts, place, jumps = [], 0, steps.tolist()
                while place < len(jumps):
                    starts.append(place)
                    place += jumps[place]
                counts = np.repeat(batch.column(1).slice(a, b - a).to_numpy(), lengths)[starts]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([*starts, len(words)], pa.int32()), words), pa.array(counts)], ["tokens", "cnt"])

    return run


def greedy_split(chunks: DataFrame, ngrams: DataFrame) -> DataFrame:
    """(tokens, cnt): chunks partitioned and tallied again. The dictionary is what passed a count threshold; workers
    get 17 bytes for each of its n-grams and their beginnings, which are told apart by 128 bits of hashes."""
    rows = ngrams.select("ngram").mapInArrow(_beginnings, "h bigint, g bigint, whole bigint").groupBy("h", "g").agg(F.max("whole").alias("whole"))
    found = rows.mapInArrow(packed, "h binary, g binary, whole binary").collect()
    sums = chunks.select("tokens", F.col("cnt").cast("bigint").alias("cnt"))
    if found:
        known, second, whole = (np.concatenate([np.frombuffer(r[k], kind) for r in found]) for k, kind in (("h", np.uint64), ("g", np.uint64), ("whole", np.int64)))
        order = np.argsort(known)
        held = chunks.sparkSession.sparkContext.broadcast((known[order], second[order], whole[order].astype(bool)))
        sums = sums.mapInArrow(_split(held), "tokens array<binary>, cnt bigint")
    return sums.groupBy("tokens").agg(F.sum("cnt").alias("cnt"))


def ngram_split(chunks: DataFrame, c_min: int, min_count: int = 15, max_len: int = 30) -> DataFrame:
    """Splits by the n-grams that occur at least as often as the word model's last merge."""
    return greedy_split(chunks, ngram_counts(chunks, max_len, max(c_min, min_count)))
