"""Merging as a sequence of DataFrame jobs, for corpora whose distinct chunks don't fit one machine.

Each round takes a batch of merges that is provably what one-by-one merging would do: pairs in order
of count, in whole groups of equal counts, as long as no token occurs in two of them and none pairs a
token with itself. A pair that a merge creates can't be more frequent than a pair that it destroys, and
that one would have ended the batch. Without deletions (tau > 1).
"""

from __future__ import annotations

from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.stats import pair_counts
from .local_merge import merge_tokens


def exact_batch(top: list[tuple[bytes, bytes, int]], most: int) -> list[tuple[bytes, bytes, int]]:
    """The longest safe beginning of pairs in order; one pair at least."""
    taken: list[tuple[bytes, bytes, int]] = []
    used: set[bytes] = set()
    groups = [list(g) for _, g in groupby(top, key=lambda r: r[2])]
    for i, group in enumerate(groups):
        tokens = [t for left, right, _ in group for t in (left, right)]
        unfinished = i == len(groups) - 1 and len(top) >= most  # the group may go on beyond what was fetched
        if unfinished or len(set(tokens)) < len(tokens) or used & set(tokens):
            break
        taken += group
        used |= set(tokens)
    return taken or top[:1]


def _merged(batch: list[tuple[bytes, bytes, int]]):
    """The batch's merges, one after the other, over a column of tokens; plans stay as long as they are."""
    pairs = [(left, right) for left, right, _ in batch]

    @F.pandas_udf("array<binary>")
    def run(chunks: pd.Series) -> pd.Series:
        def one(tokens):
            held = [bytes(t) for t in tokens]
            for left, right in pairs:
                if left in held and right in held:
                    held, _ = merge_tokens(held, left, right)
            return held

        return chunks.map(one, na_action="ignore")

    return run


def merge_rounds(chunks: DataFrame, merges: int, fetch: int = 256, keep_every: int = 5) -> list[tuple[bytes, bytes, int]]:
    """(left, right, cnt) of the first `merges` merges over (tokens, cnt). Lineage is cut by checkpoint(), so
    the session needs a checkpoint folder that all executors share."""
    if not chunks.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        raise ValueError("set a checkpoint folder that all executors share: spark.checkpoint.dir")
    log: list[tuple[bytes, bytes, int]] = []
    rounds = 0
    while len(log) < merges:
        top = pair_counts(chunks).orderBy(F.desc("cnt"), "left", "right").limit(fetch).collect()
        if not top:
            break
        batch = exact_batch([(bytes(r.left), bytes(r.right), r.cnt) for r in top], fetch)[: merges - len(log)]
        log += batch
        chunks = chunks.withColumn("tokens", _merged(batch)("tokens"))
        rounds += 1
        if rounds % keep_every == 0:
            chunks = chunks.checkpoint()
    return log
