"""The merge loop over distinct chunks that stay on the executors.

The driver holds the counts of pairs and tokens, whose number follows the vocabulary, and chooses every
operation; the chunks lie as flat arrays of token numbers, in pieces of bounded size, in the shared folder.
A job replays what has been done since the arrays were last written, applies further operations and
returns what each changes in the counts. Those further operations are a forecast from the most frequent
chunks: an effect is used only if the exact counts then choose that very operation, otherwise the next job
starts from the right one. So the log doesn't depend on the forecast, only the number of jobs does.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..session import Folder
from .local_merge import MergeEngine, Operations, Pair, Vocabulary

#: What stands behind each chunk in an array.
END = -1
#: Token numbers in a piece, about; forecast operations in a job; operations after which the arrays are written anew.
PIECE, FIRST_AHEAD, MOST_AHEAD, REWRITE = 500_000, 8, 48, 40
#: Pairs that a forecast looks at.
_LIKELY = 2000

Piece = tuple[np.ndarray, np.ndarray]
#: ("merge", left, right, made) or ("part", token, parts), in token numbers.
Operation = tuple
#: Pairs as left * width + right and their changes, the weight of what was replaced, whether a chunk became one token.
Effect = tuple[np.ndarray, np.ndarray, int, bool]


def flat(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Chunks of these lengths, each with END behind it."""
    out = np.full(len(ids) + len(lengths), END, dtype=np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths)] = ids
    return out


def summed(keys: np.ndarray, weights: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their weights, those of 0 left out. Sums are exact up to 2^53."""
    if bins <= 1 << 22 and len(keys) > bins >> 4:
        sums = np.bincount(keys, weights=weights, minlength=bins)
        found = np.flatnonzero(sums)
        return found.astype(np.int64), sums[found].astype(np.int64)
    found, at = np.unique(keys, return_inverse=True)
    sums = np.bincount(at, weights=weights, minlength=len(found)).astype(np.int64)
    return found[sums != 0], sums[sums != 0]


def pairs_in(tokens: np.ndarray, weights: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(left * width + right, weight) of every pair; weights has one for each place. n equal tokens in a row hold n // 2 pairs."""
    left, right = tokens[:-1], tokens[1:]
    counted = (left >= 0) & (right >= 0)
    same = counted & (left == right)
    if same.any():
        at = np.arange(len(same))
        counted &= ~(same & ((at - np.maximum.accumulate(np.where(same, 0, at + 1))) % 2 == 1))
    return left[counted].astype(np.int64) * width + right[counted], weights[:-1][counted]


def places(tokens: np.ndarray, operation: Operation) -> np.ndarray:
    """Where an operation applies."""
    if operation[0] == "part":
        return np.flatnonzero(tokens == operation[1])
    hits = np.flatnonzero((tokens[:-1] == operation[1]) & (tokens[1:] == operation[2]))
    if operation[1] == operation[2] and len(hits):
        first = np.concatenate(([True], np.diff(hits) != 1))
        hits = hits[(hits - hits[first][np.cumsum(first) - 1]) % 2 == 0]
    return hits


def replaced(tokens: np.ndarray, operation: Operation, hits: np.ndarray) -> np.ndarray:
    """The tokens after an operation at these places."""
    if not len(hits):
        return tokens
    if operation[0] == "merge":
        keep = np.ones(len(tokens), dtype=bool)
        keep[hits + 1] = False
        out = tokens.copy()
        out[hits] = operation[3]
        return out[keep]
    parts = operation[2]
    times = np.ones(len(tokens), dtype=np.int64)
    times[hits] = len(parts)
    out = np.repeat(tokens, times)
    at = hits + np.arange(len(hits)) * (len(parts) - 1)
    for i, part in enumerate(parts):
        out[at + i] = part
    return out


def effect_of(tokens: np.ndarray, weights: np.ndarray, operation: Operation, width: int) -> tuple[np.ndarray, Effect]:
    """The tokens after an operation, and what it changes. Only chunks that it touches are counted."""
    hits = places(tokens, operation)
    if not len(hits):
        return tokens, (np.zeros(0, np.int64), np.zeros(0, np.int64), 0, False)
    ends = np.flatnonzero(tokens < 0)
    chunk = np.searchsorted(ends, hits)
    weight = int(weights[chunk].sum())
    touched = chunk[np.concatenate(([True], np.diff(chunk) > 0))]
    starts = np.where(touched > 0, ends[touched - 1] + 1, 0)
    lengths = ends[touched] + 1 - starts
    part = tokens[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]
    after = replaced(part, operation, places(part, operation))
    lengths_after = np.diff(np.flatnonzero(after < 0), prepend=-1)
    was, lost = pairs_in(part, np.repeat(weights[touched], lengths), width)
    now, won = pairs_in(after, np.repeat(weights[touched], lengths_after), width)
    keys, change = summed(np.concatenate((was, now)), np.concatenate((-lost, won)), width * width)
    return replaced(tokens, operation, hits), (keys, change, weight, operation[0] == "merge" and bool((lengths_after == 2).any()))


def together(effects: Iterable[Effect], width: int) -> Effect:
    """One operation's effect over several pieces."""
    every = list(effects)
    keys, change = summed(np.concatenate([e[0] for e in every]), np.concatenate([e[1] for e in every]), width * width)
    return keys, change, sum(e[2] for e in every), any(e[3] for e in every)


def _effects(done: list[Operation], wanted: list[Operation], width: int):
    def run(pieces: Iterator[Piece]) -> Iterator[list[Effect]]:
        found: list[list[Effect]] = [[] for _ in wanted]
        for tokens, weights in pieces:
            for operation in done:
                tokens = replaced(tokens, operation, places(tokens, operation))
            for at, operation in zip(found, wanted, strict=True):
                tokens, effect = effect_of(tokens, weights, operation, width)
                at.append(effect)
        if found and found[0]:
            yield [together(at, width) for at in found]

    return run


def _counts(done: list[Operation], width: int):
    """Pairs with their counts, tokens with their counts, and the number of chunks."""

    def run(pieces: Iterator[Piece]) -> Iterator[tuple]:
        found = []
        for tokens, weights in pieces:
            for operation in done:
                tokens = replaced(tokens, operation, places(tokens, operation))
            each = np.repeat(weights, np.diff(np.flatnonzero(tokens < 0), prepend=-1))
            real = tokens >= 0
            found.append((*summed(*pairs_in(tokens, each, width), width * width), *summed(tokens[real].astype(np.int64), each[real], width)))
        if found:
            pairs, n, singles, m = (np.concatenate(x) for x in zip(*found, strict=True))
            yield *summed(pairs, n, width * width), *summed(singles, m, width)

    return run


def _pieces(alphabet: list[bytes] | None):
    """Rows of (tokens, cnt) as pieces. Without an alphabet a chunk's tokens are its single bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(alphabet, pa.binary()) if alphabet is not None else None
        held: list[Piece] = []

        def piece() -> pa.RecordBatch:
            columns = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], ["tokens", "weights"])

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(0).cast(pa.list_(pa.binary()))
            values, bounds = lists.flatten(), np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
            if known is None:
                places_of = np.concatenate(([0], np.cumsum(pc.binary_length(values).to_numpy().astype(np.int64))))
                ids, bounds = np.frombuffer(b"".join(values.to_pylist()), dtype=np.uint8), places_of[bounds]
            else:
                ids = pc.index_in(values, value_set=known)
                if ids.null_count:
                    raise ValueError("a chunk holds a token that isn't in the alphabet")
                ids = ids.to_numpy()
            held.append((flat(ids, np.diff(bounds)), batch.column(1).to_numpy().astype(np.int64)))
            if sum(len(x) for x, _ in held) >= PIECE:
                yield piece()
                held = []
        if held:
            yield piece()

    return run


class SpreadEngine(MergeEngine):
    """A MergeEngine whose chunks are rows of (tokens, cnt); head: some chunks, the most frequent ones, to forecast by."""

    def __init__(self, chunks: DataFrame, head: list[tuple[list[bytes], int]], alphabet: list[bytes] | None = None):
        self.names: list[bytes] = [bytes([b]) for b in range(256)] if alphabet is None else list(alphabet)
        self.numbers = {t: i for i, t in enumerate(self.names)}
        self.context = chunks.sparkSession.sparkContext
        self.folder, self.written = Folder(chunks.sparkSession, "merge"), 0
        self.parts = max(2 * self.context.defaultParallelism, 1)
        made = chunks.select("tokens", "cnt").mapInArrow(_pieces(alphabet), "tokens binary, weights binary").repartition(self.parts)
        self._write(made.rdd.map(lambda r: (np.frombuffer(r.tokens, np.int32), np.frombuffer(r.weights, np.int64))))
        ids = [self.numbers[t] for tokens, _ in head for t in tokens]
        self.head: Piece = flat(np.array(ids, np.int32), np.array([len(t) for t, _ in head])), np.array([n for _, n in head], np.int64)
        self.done: list[Operation] = []
        self.forecast: deque[tuple[Operation, Effect]] = deque()
        self.ahead, self.jobs, self.ops = FIRST_AHEAD, 0, None
        pairs, singles = self._counted()
        self.pairs = defaultdict(int, pairs)
        self.singles = defaultdict(int, singles)
        self.chunks = self.singles
        self.heap = [(-n, pair) for pair, n in self.pairs.items()]
        heapq.heapify(self.heap)

    def _write(self, pieces) -> None:
        old, self.written = self.written, self.written + 1
        pieces.saveAsPickleFile(f"{self.folder.path}/{self.written}", 1)
        self.state = self.context.pickleFile(f"{self.folder.path}/{self.written}", self.parts)
        if old:
            self.folder.remove(str(old))

    def close(self) -> None:
        self.folder.remove()

    def _number(self, token: bytes) -> int:
        if token not in self.numbers:
            self.numbers[token] = len(self.names)
            self.names.append(token)
        return self.numbers[token]

    def _pair(self, key: int, width: int) -> Pair:
        return self.names[key // width], self.names[key % width]

    def _counted(self) -> tuple[dict[Pair, int], dict[bytes, int]]:
        width = len(self.names)
        every = self.state.mapPartitions(_counts(self.done, width)).collect()
        if not every:
            return {}, {}
        pairs, n, singles, m = (np.concatenate(x) for x in zip(*every, strict=True))
        pairs, n = summed(pairs, n, width * width)
        singles, m = summed(singles, m, width)
        return {self._pair(k, width): c for k, c in zip(pairs.tolist(), n.tolist(), strict=True)}, {self.names[k]: c for k, c in zip(singles.tolist(), m.tolist(), strict=True)}

    def _expected(self, first: Operation) -> list[Operation]:
        """first and what will probably follow. Changes that the head shows are scaled to the count of the whole."""
        tokens, weights = self.head
        counts: dict[Pair, float] = dict(heapq.nlargest(_LIKELY, self.pairs.items(), key=lambda x: x[1]))
        singles: dict[bytes, float] = dict(self.singles)
        out: list[Operation] = []

        def apply(operation: Operation) -> None:
            nonlocal tokens
            out.append(operation)
            whole = counts.get((self.names[operation[1]], self.names[operation[2]]), 0) if operation[0] == "merge" else singles.get(self.names[operation[1]], 0)
            width = len(self.names)
            tokens, (keys, change, weight, _) = effect_of(tokens, weights, operation, width)
            scale = whole / weight if weight else 1
            for key, n in zip(keys.tolist(), change.tolist(), strict=True):
                pair = self._pair(key, width)
                counts[pair] = counts.get(pair, 0) + n * scale
            if operation[0] == "merge":
                counts.pop((self.names[operation[1]], self.names[operation[2]]), None)
            for token, n in self._changed(operation).items():
                singles[token] = singles.get(token, 0) + n * whole

        def stepped(operation: Operation) -> None:
            left, right = self.names[operation[1]], self.names[operation[2]]
            count = counts.get((left, right), 0)
            shares = [(count / max(singles.get(t, 0), 1), t) for t in (left, right)]
            apply(operation)
            for share, token in shares:
                if self.ops and self.ops.blowup and len(token) > 1 and share >= self.ops.tau:
                    apply(self._parting(token, self.ops.parts(token)))

        stepped(first) if first[0] == "merge" else apply(first)
        while len(out) < self.ahead and counts:
            (left, right), n = min(counts.items(), key=lambda x: (-x[1], x[0]))
            if n <= 0:
                break
            stepped(self._merging(left, right))
        return out

    def _merging(self, left: bytes, right: bytes) -> Operation:
        return "merge", self._number(left), self._number(right), self._number(left + right)

    def _parting(self, token: bytes, parts: list[bytes]) -> Operation:
        return "part", self._number(token), tuple(self._number(p) for p in parts)

    def _changed(self, operation: Operation) -> dict[bytes, int]:
        """By how much the count of each token changes at one place."""
        gone, new = (operation[1:3], operation[3:]) if operation[0] == "merge" else (operation[1:2], operation[2])
        out: dict[bytes, int] = defaultdict(int)
        for tokens, n in ((gone, -1), (new, 1)):
            for t in tokens:
                out[self.names[t]] += n
        return out

    def _run(self, operation: Operation) -> bool:
        if not self.forecast or self.forecast[0][0] != operation:
            self.ahead = max(FIRST_AHEAD, self.ahead // 2) if self.forecast else min(MOST_AHEAD, 2 * self.ahead)
            if len(self.done) >= REWRITE:
                done = self.done

                def moved(piece: Piece) -> Piece:
                    tokens, weights = piece
                    for x in done:
                        tokens = replaced(tokens, x, places(tokens, x))
                    return tokens, weights

                self._write(self.state.map(moved))
                self.done = []
            expected = self._expected(operation)
            width = len(self.names)
            found = self.state.mapPartitions(_effects(self.done, expected, width)).collect()
            self.jobs += 1
            self.width = width
            self.forecast = deque(zip(expected, [together(x, width) for x in zip(*found, strict=True)], strict=True))
        _, (keys, change, weight, whole) = self.forecast.popleft()
        self.done.append(operation)
        self.head = replaced(self.head[0], operation, places(self.head[0], operation)), self.head[1]
        for token, n in self._changed(operation).items():
            self.singles[token] += n * weight
        self._apply({self._pair(k, self.width): n for k, n in zip(keys.tolist(), change.tolist(), strict=True)})
        return whole

    def merge(self, pair: Pair) -> bool:
        return self._run(self._merging(*pair))

    def blow_up(self, token: bytes, parts: list[bytes]) -> None:
        self._run(self._parting(token, parts))

    def step(self, pair: Pair, ops: Operations, vocabulary: Vocabulary) -> None:
        self.ops = ops
        super().step(pair, ops, vocabulary)

    def verify(self) -> None:
        pairs, singles = self._counted()
        if pairs != {p: n for p, n in self.pairs.items() if n} or singles != {t: n for t, n in self.singles.items() if n}:
            raise RuntimeError("counts have drifted from the chunks")
