"""Corpus statistics over chunks (tokens array<binary>, cnt bigint) and pretokens."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.codec import byte_tokens
from ..functions.pretokenize import Splitter, is_native, mergeable_column, parts, with_pretokens
from .ngrams import ngram_counts
from .rewrite import adjacent_pairs

__all__ = [  # noqa: F822
    "best_pairs", "byte_chunks", "document_runs", "eligible_runs", "ios_of_chunks", "ios_ratios", "ngram_counts", "ngram_lengths", "pair_counts", "pretoken_tally", "single_byte_count", "smallest_recent_count", "tallied", "token_counts",
    "token_locations", "whole_word_count",
]


#: Distinct pretokens that a worker counts before it hands them on.
_REMEMBERED = 200_000


def _counted(splitter: Splitter):
    """Texts as (pretoken, cnt), counted within a worker's bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], ["pretoken", "cnt"])

        for batch in batches:
            texts = batch.column(0)
            for a, b in parts(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)):
                for text in texts.slice(a, b - a).to_pylist():
                    if text is not None:
                        tally.update(splitter.split(text))
                if len(tally) >= _REMEMBERED:
                    yield rows()
                    tally.clear()
        if tally:
            yield rows()

    return run


def pretoken_tally(docs: DataFrame, splitter: Splitter, text: str = "text") -> DataFrame:
    """(pretoken, cnt): occurrences of each distinct pretoken; partial sums are combined before the shuffle."""
    if not is_native(splitter):
        return docs.select(text).mapInArrow(_counted(splitter), "pretoken string, cnt bigint").groupBy("pretoken").agg(F.sum("cnt").alias("cnt"))
    return with_pretokens(docs.select(text), splitter, text, "p").select(F.explode("p").alias("pretoken")).groupBy("pretoken").agg(F.count("*").alias("cnt"))


def byte_chunks(tally: DataFrame) -> DataFrame:
    """(tokens, cnt): pretokens as single bytes."""
    return tally.select(byte_tokens(F.col("pretoken")).alias("tokens"), "cnt")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(left, right, cnt) weighted by the chunks' counts."""
    pairs = chunks.select(F.explode(adjacent_pairs(F.col("tokens"))).alias("p"), "cnt")
    return pairs.groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(F.sum(F.col("cnt") * F.col("p.times")).alias("cnt"))


def token_counts(chunks: DataFrame) -> DataFrame:
    """(token, cnt) weighted."""
    return chunks.select(F.explode("tokens").alias("token"), "cnt").groupBy("token").agg(F.sum("cnt").alias("cnt"))


def whole_word_count(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.coalesce(F.sum(F.when(F.size("tokens") == 1, F.col("cnt"))), F.lit(0)).alias("whole_words"))


def single_byte_count(chunks: DataFrame) -> DataFrame:
    return token_counts(chunks).agg(F.coalesce(F.sum(F.when(F.octet_length("token") == 1, F.col("cnt"))), F.lit(0)).alias("single_bytes"))


def token_locations(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(token, key): in which chunks a token occurs, as rows, so that no list grows with the corpus."""
    return chunks.select(F.explode(F.array_distinct("tokens")).alias("token"), key)


def best_pairs(pairs: DataFrame, n: int = 1) -> DataFrame:
    """Highest count first; among equals the smallest bytes of left, then right."""
    return pairs.orderBy(F.desc("cnt"), "left", "right").limit(n)


def ios_ratios(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(left, right, cnt, ios_left, ios_right): the share of each side's occurrences that the pair takes."""
    a = tokens.select(F.col("token").alias("left"), F.col("cnt").alias("c_left"))
    b = tokens.select(F.col("token").alias("right"), F.col("cnt").alias("c_right"))
    both = pairs.join(a, "left").join(b, "right")
    return both.select("left", "right", "cnt", (F.col("cnt") / F.col("c_left")).alias("ios_left"), (F.col("cnt") / F.col("c_right")).alias("ios_right"))


def ios_of_chunks(chunks: DataFrame) -> DataFrame:
    """The same of (tokens, cnt), which are computed once: tokens are counted beside pairs, as pairs without a right side."""
    kind = "array<struct<left:binary,right:binary,times:int>>"
    alone = F.transform("tokens", lambda t: F.struct(t.alias("left"), F.lit(None).cast("binary").alias("right"), F.lit(1).alias("times")))
    cells = chunks.select(F.explode(F.concat(adjacent_pairs(F.col("tokens")), alone.cast(kind))).alias("p"), "cnt")
    counts = cells.groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(F.sum(F.col("cnt") * F.col("p.times")).alias("cnt"))
    single = F.max(F.when(F.col("right").isNull(), F.col("cnt")))
    known = counts.withColumn("c_left", single.over(Window.partitionBy("left"))).withColumn("c_right", single.over(Window.partitionBy(F.coalesce("right", "left"))))
    return known.filter(F.col("right").isNotNull()).select("left", "right", "cnt", (F.col("cnt") / F.col("c_left")).alias("ios_left"), (F.col("cnt") / F.col("c_right")).alias("ios_right"))


def smallest_recent_count(ops: DataFrame) -> DataFrame:
    """Count of the merge with the highest index."""
    return ops.filter("left is not null").agg(F.max_by("cnt", "idx").alias("c_min"))


def ngram_lengths(ngrams: DataFrame) -> DataFrame:
    return ngrams.groupBy("n").agg(F.count("*").alias("kinds"), F.sum("cnt").alias("total"))


def _runs_in(lists: pa.ListArray, held: np.ndarray) -> pa.ListArray:
    """Maximal runs of two or more held elements within each list; held has one flag for each element."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    last = np.zeros(len(held), dtype=bool)
    last[np.cumsum(lengths)[lengths > 0] - 1] = True
    linked = np.zeros(len(held) + 1, dtype=bool)  # whether the element at i - 1 goes on at i
    linked[1:-1] = held[:-1] & held[1:] & ~last[:-1]
    starts, ends = np.flatnonzero(linked[1:] & ~linked[:-1]), np.flatnonzero(linked[:-1] & ~linked[1:]) + 1
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    values = lists.flatten().take(pa.array(np.repeat(starts - before, sizes) + np.arange(sizes.sum())))
    return pa.ListArray.from_arrays(pa.array(np.append(before, sizes.sum()), pa.int32()), values.cast(pa.binary()))


def _runs(eligible: frozenset[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = None if eligible is None else pa.array(sorted(eligible), pa.string())
        for batch in batches:
            whole = batch.column(0).cast(pa.list_(pa.string()))
            for a, b in parts(pc.fill_null(pc.list_value_length(whole), 0).to_numpy(zero_copy_only=False), 1 << 17):
                lists = whole.slice(a, b - a)
                held = batch.column(1).slice(a, b - a).flatten() if allowed is None else pc.is_in(lists.flatten(), value_set=allowed)
                if len(held):
                    yield pa.RecordBatch.from_arrays([_runs_in(lists, held.to_numpy(zero_copy_only=False))], ["tokens"])

    return run


def document_runs(docs: DataFrame, splitter: Splitter, eligible: set[str] | None = None, text: str = "text", then: Callable = iter, schema: str = "tokens array<binary>") -> DataFrame:
    """(tokens): maximal runs of two or more eligible pretokens that follow each other in a text, each where it occurs; no shuffle.
    eligible: pretokens, or None for "may merge". then: what the same worker makes of the batches, and its schema."""
    split = with_pretokens(docs.select(text), splitter, text, "p").select("p")
    if eligible is None:
        split = split.select("p", F.transform("p", lambda t: mergeable_column(t.cast("binary"))).alias("held"))
    runs = _runs(None if eligible is None else frozenset(eligible))
    return split.mapInArrow(lambda batches: then(runs(batches)), schema)


def tallied(runs: DataFrame) -> DataFrame:
    return runs.groupBy("tokens").agg(F.count("*").alias("cnt"))


def eligible_runs(exploded: DataFrame, eligible: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(tokens, cnt): maximal runs of two or more eligible pretokens that follow each other, tallied.

    exploded is (key, pos, pretoken); eligible is (pretoken), or None for "may merge".
    """
    if eligible is None:
        held = exploded.filter(mergeable_column(F.col("pretoken").cast("binary")))
    else:
        held = exploded.join(eligible.select("pretoken"), "pretoken", "left_semi")
    order = Window.partitionBy(key).orderBy("pos")
    islands = held.withColumn("island", F.col("pos") - F.row_number().over(order))
    runs = islands.groupBy(key, "island").agg(F.sort_array(F.collect_list(F.struct("pos", "pretoken"))).alias("r")).filter(F.size("r") >= 2)
    return runs.select(F.transform("r", lambda x: x["pretoken"].cast("binary")).alias("tokens")).groupBy("tokens").agg(F.count("*").alias("cnt"))
