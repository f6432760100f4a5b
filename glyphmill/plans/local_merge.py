"""Sequential merge engine over distinct chunks.

Counting is distributed; what reaches this engine is one entry for each distinct chunk, so its size
follows the vocabulary of the corpus and not its length. Pair counts are kept up by each changed
chunk's difference, and the best pair comes from a heap whose outdated entries are skipped.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

from ..functions.codec import INITIAL_BYTES, printable

Pair = tuple[bytes, bytes]


def merge_tokens(tokens: list[bytes], left: bytes, right: bytes) -> tuple[list[bytes], int]:
    """Tokens after greedy merging from the left, and the number of merges."""
    out: list[bytes] = []
    i, done = 0, 0
    while i < len(tokens):
        if tokens[i] == left and i + 1 < len(tokens) and tokens[i + 1] == right:
            out.append(left + right)
            i += 2
            done += 1
        else:
            out.append(tokens[i])
            i += 1
    return out, done


def blow_up_tokens(tokens: list[bytes], bad: bytes, parts: list[bytes]) -> tuple[list[bytes], int]:
    out: list[bytes] = []
    for t in tokens:
        out.extend(parts if t == bad else (t,))
    return out, tokens.count(bad)


def chunk_pairs(tokens: list[bytes]) -> Counter[Pair]:
    """Adjacent pairs; n equal tokens in a row hold n // 2 pairs of themselves."""
    out: Counter[Pair] = Counter()
    used = False
    for a, b in zip(tokens, tokens[1:]):
        if a == b:
            used = not used
            if not used:
                continue
        else:
            used = False
        out[a, b] += 1
    return out


@dataclass
class Operations:
    """The log of a training pass. Merges and deletions share one sequence of indices."""

    tau: float = 1.1
    is_super: bool = False
    superbpe_mode: bool = False
    blowup: bool = True
    merges: dict[int, tuple[Pair, int, int]] = field(default_factory=dict)
    deletions: dict[int, bytes] = field(default_factory=dict)

    def next_index(self) -> int:
        return len(self.merges) + len(self.deletions)

    def parts(self, token: bytes) -> list[bytes]:
        """What a deleted token turns into: its bytes, or the pair of the first merge that made it."""
        if self.blowup:
            return [bytes([b]) for b in token]
        for idx in sorted(self.merges):
            (left, right), _, _ = self.merges[idx]
            if left + right == token:
                return [left, right]
        raise ValueError(f"no merge makes {printable(token)}")

    def ordered(self) -> list[tuple[int, str, Pair | bytes, int, int]]:
        rows = [(i, "merge", pair, cnt, flag) for i, (pair, cnt, flag) in self.merges.items()]
        rows += [(i, "delete", token, 0, 0) for i, token in self.deletions.items()]
        return sorted(rows)

    def trimmed(self, n: int) -> Operations:
        """The first n operations."""
        keep = {row[0] for row in self.ordered()[:n]}
        return Operations(self.tau, self.is_super, self.superbpe_mode, self.blowup, {i: m for i, m in self.merges.items() if i in keep}, {i: d for i, d in self.deletions.items() if i in keep})

    def check(self) -> None:
        every = sorted([*self.merges, *self.deletions])
        if every != list(range(len(every))):
            raise ValueError("operation indices aren't contiguous")


class Vocabulary:
    """Tokens with dense ids in the order of creation, and special tokens behind them."""

    def __init__(self, tokens: Iterable[bytes] = (), supers: Iterable[bytes] = ()):
        self.ids: dict[bytes, int] = {}
        self.supers = set(supers)
        self.counts: dict[bytes, int] = {}
        self.specials: dict[str, int] = {}
        for t in tokens:
            self.add(t, t in self.supers)

    @classmethod
    def initial(cls) -> Vocabulary:
        return cls(bytes([b]) for b in INITIAL_BYTES)

    def copy(self) -> Vocabulary:
        """Tokens, flags and counts; special tokens aren't carried over."""
        out = Vocabulary(self.ids, self.supers)
        out.counts = dict(self.counts)
        return out

    def add(self, token: bytes, is_super: bool = False) -> int:
        if token not in self.ids:
            self.ids[token] = len(self.ids)
            if is_super:
                self.supers.add(token)
        return self.ids[token]

    def delete(self, token: bytes) -> None:
        """Takes a token out; the ids behind it move up."""
        at = self.ids.pop(token)
        self.supers.discard(token)
        for other, i in self.ids.items():
            if i > at:
                self.ids[other] = i - 1

    def __contains__(self, token: bytes) -> bool:
        return token in self.ids

    def __len__(self) -> int:
        return len(self.ids)

    @property
    def tokens(self) -> list[bytes]:
        return list(self.ids)

    def __getitem__(self, i: int) -> bytes:
        return self.tokens[i]

    def total_size(self) -> int:
        return len(self.ids) + len(self.specials)

    def register_specials(self, texts: Iterable[str]) -> int:
        """Gives new special tokens the next ids; how many were new."""
        new = 0
        for text in texts:
            if text not in self.specials:
                self.specials[text] = self.total_size()
                new += 1
        return new

    def words(self) -> list[bytes]:
        return [t for t in self.ids if t not in self.supers]

    def super_tokens(self) -> list[bytes]:
        return [t for t in self.ids if t in self.supers]

    def all_ids(self) -> set[int]:
        return {*self.ids.values(), *self.specials.values()}

    def verify(self) -> None:
        if list(self.ids.values()) != list(range(len(self.ids))):
            raise ValueError("token ids aren't dense")
        if sorted(self.specials.values()) != list(range(len(self.ids), self.total_size())):
            raise ValueError("special ids don't follow the tokens")


class MergeEngine:
    """State of the loop: chunks, their pair and token counts, and where each token occurs."""

    def __init__(self, chunks: Iterable[tuple[list[bytes], int]]):
        self.chunks: list[list[bytes]] = []
        self.weights: list[int] = []
        self.pairs: dict[Pair, int] = defaultdict(int)
        self.singles: dict[bytes, int] = defaultdict(int)
        self.where: dict[bytes, set[int]] = defaultdict(set)
        for i, (tokens, weight) in enumerate(chunks):
            self.chunks.append(list(tokens))
            self.weights.append(weight)
            for pair, n in chunk_pairs(tokens).items():
                self.pairs[pair] += n * weight
            for t in tokens:
                self.singles[t] += weight
                self.where[t].add(i)
        self.heap = [(-n, pair) for pair, n in self.pairs.items()]
        heapq.heapify(self.heap)

    def best(self) -> tuple[Pair | None, int]:
        """Most frequent pair; among equals the smallest bytes."""
        while self.heap:
            n, pair = self.heap[0]
            if self.pairs.get(pair, 0) == -n:
                return pair, -n
            heapq.heappop(self.heap)
        return None, 0

    def _replace(self, i: int, new: list[bytes], delta: dict[Pair, int]) -> None:
        """Puts a chunk's new tokens in place and adds what that does to the pairs to delta."""
        weight = self.weights[i]
        for tokens, n in ((self.chunks[i], -weight), (new, weight)):
            used, a = False, None
            for b in tokens:
                if a is not None:
                    used = a == b and not used
                    if a != b or used:
                        delta[a, b] = delta.get((a, b), 0) + n
                a = b
        self.chunks[i] = new

    def _moved(self, i: int, changed: dict[bytes, int]) -> None:
        """Token counts and places of a chunk whose tokens have changed by these numbers."""
        weight, held = self.weights[i], set(self.chunks[i])
        for t, n in changed.items():
            self.singles[t] += n * weight
            if t in held:
                self.where[t].add(i)
            else:
                self.where[t].discard(i)

    def _apply(self, delta: dict[Pair, int]) -> None:
        for pair, n in delta.items():
            if n:
                left = self.pairs[pair] + n
                if left:
                    self.pairs[pair] = left
                    heapq.heappush(self.heap, (-left, pair))
                else:
                    del self.pairs[pair]

    def merge(self, pair: Pair) -> bool:
        """Merges everywhere; whether some chunk became a single token by it."""
        left, right = pair
        whole = False
        delta: dict[Pair, int] = {}
        for i in sorted(self.where[left] & self.where[right]):
            new, n = merge_tokens(self.chunks[i], left, right)
            if n:
                self._replace(i, new, delta)
                self._moved(i, {left: -n, right: -n, left + right: n} if left != right else {left: -2 * n, left + right: n})
                whole |= len(new) == 1
        self._apply(delta)
        return whole

    def blow_up(self, token: bytes, parts: list[bytes]) -> None:
        delta: dict[Pair, int] = {}
        for i in sorted(self.where[token]):
            new, n = blow_up_tokens(self.chunks[i], token, parts)
            changed = Counter({p: n * parts.count(p) for p in parts})
            changed[token] -= n
            self._replace(i, new, delta)
            self._moved(i, changed)
        self._apply(delta)

    def step(self, pair: Pair, ops: Operations, vocabulary: Vocabulary) -> None:
        """One merge, then the deletion of each side that it used up to the share tau or more."""
        left, right = pair
        count = self.pairs[pair]
        shares = (count / self.singles[left], left), (count / self.singles[right], right)
        whole = self.merge(pair)
        ops.merges[ops.next_index()] = (pair, count, int(whole))
        vocabulary.add(left + right, ops.is_super)
        for share, token in shares:
            if len(token) > 1 and share >= ops.tau:
                parts = ops.parts(token)
                self.blow_up(token, parts)
                ops.deletions[ops.next_index()] = token
                if token in vocabulary:
                    vocabulary.delete(token)

    def verify(self) -> None:
        """Recounts everything and compares."""
        fresh = MergeEngine(zip(self.chunks, self.weights, strict=True))
        same = fresh.pairs == {p: n for p, n in self.pairs.items() if n} and dict(fresh.singles) == {t: n for t, n in self.singles.items() if n}
        if not same or dict(fresh.where) != {t: w for t, w in self.where.items() if w}:
            raise RuntimeError("counts have drifted from the chunks")
