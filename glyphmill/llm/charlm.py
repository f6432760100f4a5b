"""Two byte n-gram models, one for each class, compared by their log-likelihood ratio.

Both classes are smoothed towards ONE shared chain of lower orders, whose counts are those of both
classes' texts together, so an expression that neither class has seen adds nothing to either side, and
one that is rare in both is spelled by what they share. For every n-gram that any class holds, the
difference of the two log-probabilities is worked out at fitting time; scoring then needs a single
lookup for each byte and order. An n-gram of up to 7 bytes is its own key, so nothing collides.
"""

from __future__ import annotations

import numpy as np

from .textutil import HashTable

_WINDOW = 1 << 19


def _stream(texts: list[bytes], pad: int) -> np.ndarray:
    gap = b"\0" * pad
    return np.frombuffer(gap + gap.join(texts) + (gap if texts else b""), dtype=np.uint8)


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """Key of the n bytes that end at each position from n - 1 on."""
    out = np.zeros(max(0, len(data) - n + 1), dtype=np.uint64)
    for i in range(n):
        out = (out << np.uint64(8)) | data[i : len(data) - n + 1 + i].astype(np.uint64)
    return out


def _tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def _aligned(union: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(union))
    out[np.searchsorted(union, keys)] = values
    return out


class RatioModel:
    """log P(text | first class) - log P(text | second class), a mean for each byte.

    smoothing "kneser_ney": interpolated, raw counts at the highest order, counts of distinct
    left neighbours below it, one discount for each order and class from its counts of 1 and 2.
    smoothing "witten_bell": raw counts; a context that occurs fewer than `min_context` times in
    both classes together is left out, so the order varies with what is known.
    Orders up to `shared` have the same counts for both classes.
    """

    def __init__(self, order: int = 5, smoothing: str = "kneser_ney", min_context: int = 1, shared: int = 1):
        if not 2 <= order <= 7:
            raise ValueError("order must lie between 2 and 7")
        if not 1 <= shared < order:
            raise ValueError("shared must lie between 1 and order - 1")
        if smoothing not in ("kneser_ney", "witten_bell"):
            raise ValueError(f"unknown smoothing {smoothing}")
        self.order, self.smoothing, self.min_context, self.shared = order, smoothing, min_context, shared

    def _counts(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(keys, counts) for orders 1 to the highest; grams that end in padding are left out."""
        data = _stream(texts, self.order - 1)
        raw = []
        for n in range(1, self.order + 1):
            keys = _grams(data, n)
            raw.append(_tally(keys[(keys & np.uint64(255)) != 0]))
        if self.smoothing == "witten_bell":
            return raw
        out = []
        for n in range(1, self.order):
            longer = raw[n][0]
            out.append(_tally(longer & np.uint64((1 << (8 * n)) - 1)))
        return [*out, raw[-1]]

    def fit(self, first: list[bytes], second: list[bytes]) -> RatioModel:
        by_class = [self._counts(x) for x in (first, second)]
        pooled = np.full(256, 0.5)
        for counts in by_class:
            pooled[counts[0][0].astype(int)] += counts[0][1]
        lower = [np.log(pooled / pooled.sum())] * 2
        lower_keys = np.arange(256, dtype=np.uint64)
        self.tables: list[HashTable | None] = [None]
        self.values: list[np.ndarray] = [np.zeros(256)]
        self.backoffs: list[np.ndarray] = []
        self.at_start: list[float] = []
        pooled = self._counts([*first, *second]) if self.shared > 1 else []
        for n in range(2, self.order + 1):
            pairs = [pooled[n - 1]] * 2 if n <= self.shared else [c[n - 1] for c in by_class]
            union = np.union1d(pairs[0][0], pairs[1][0])
            context, group = np.unique(union >> np.uint64(8), return_inverse=True)
            counts = [_aligned(union, *p) for p in pairs]
            totals = [np.bincount(group, c, len(context)) for c in counts]
            keep = totals[0] + totals[1] >= self.min_context
            kept = keep[group]
            logs, gammas = [], []
            suffix = np.searchsorted(lower_keys, union & np.uint64((1 << (8 * (n - 1))) - 1)).clip(0, max(0, len(lower_keys) - 1))
            known = lower_keys[suffix] == union & np.uint64((1 << (8 * (n - 1))) - 1) if len(lower_keys) else np.zeros(len(union), bool)
            for side in (0, 1):
                c, total = counts[side], totals[side]
                kinds = np.bincount(group, c > 0, len(context))
                if self.smoothing == "kneser_ney":
                    ones, twos = float((c == 1).sum()), float((c == 2).sum())
                    discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
                    gamma = np.divide(discount * kinds, total, out=np.ones_like(total), where=total > 0)
                    direct = np.divide(np.maximum(c - discount, 0), total[group], out=np.zeros(len(c)), where=total[group] > 0)
                else:
                    gamma = np.divide(kinds, total + kinds, out=np.ones_like(total), where=total > 0)
                    direct = np.divide(c, (total + kinds)[group], out=np.zeros(len(c)), where=total[group] > 0)
                below = np.where(known, np.exp(lower[side][suffix]), 1 / 512)
                logs.append(np.log(direct + gamma[group] * below))
                gammas.append(np.log(gamma))
            # the weight of backing off at this order belongs to the context, a gram of the order below
            row = self._rows_below(n - 1, context)
            backoff = np.zeros(len(self.values[-1]))
            placed = (row >= 0) & keep
            backoff[row[placed]] = (gammas[0] - gammas[1])[placed]
            self.backoffs.append(backoff)
            # the context of a text's first byte is padding, which is no gram of its own
            self.at_start.append(float((gammas[0] - gammas[1])[0]) if len(context) and context[0] == 0 and keep[0] else 0.0)
            union, logs = union[kept], [x[kept] for x in logs]
            self.tables.append(HashTable(union))
            self.values.append(logs[0] - logs[1])
            lower, lower_keys = logs, union
        return self

    def _rows_below(self, n: int, context: np.ndarray) -> np.ndarray:
        if n == 1:
            return context.astype(np.int64)
        return self.tables[n - 1].find(context)

    def _ratios(self, data: np.ndarray) -> np.ndarray:
        """Log-ratio at each position from order - 1 on; 0 at padding."""
        skip = self.order - 1
        total = len(data) - skip
        rows = data.astype(np.int64)
        ratio = np.zeros(len(data))
        for n in range(2, self.order + 1):
            if n < self.shared:
                continue  # no difference there; the next order needs only the rows of its contexts
            if n > self.shared:
                before = np.full(len(data), -1, dtype=np.int64)
                before[1:] = rows[:-1]
                ratio += np.where(before >= 0, self.backoffs[n - 2][before], 0.0)
                if n > 2:
                    ratio[1:][data[:-1] == 0] += self.at_start[n - 2]
            keys = _grams(data, n)
            rows = np.full(len(data), -1, dtype=np.int64)
            rows[n - 1 :] = self.tables[n - 1].find(keys)
            if n > self.shared:
                ratio = np.where(rows >= 0, self.values[n - 1][rows], ratio)
        ratio[data == 0] = 0.0
        return ratio[skip : skip + total]

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Mean log-ratio of each text; NaN for an empty one. Zero bytes within a text count for nothing."""
        skip = self.order - 1
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        data = _stream(texts, skip)
        sums = np.zeros(len(texts))
        bounds = np.cumsum(sizes + skip) - sizes  # where each text begins, after the leading padding
        for at in range(skip, len(data), _WINDOW):
            part = self._ratios(data[at - skip : at + _WINDOW])
            owner = np.searchsorted(bounds, np.arange(at, at + len(part)), side="right") - 1
            sums += np.bincount(np.maximum(owner, 0), part, len(texts)) if len(texts) else 0
        return np.divide(sums, sizes, out=np.full(len(texts), np.nan), where=sizes > 0)


def best_threshold(scores: np.ndarray, positive: np.ndarray) -> float:
    """Threshold of the best F1 for `score > threshold`; among equals the middle of the widest gap.

    Without rows of both classes there is nothing to calibrate with: 0.
    """
    good = ~np.isnan(scores)
    scores, positive = scores[good], positive[good].astype(bool)
    if not positive.any() or positive.all():
        return 0.0
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(positive[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + positive.sum())
    gap = s - np.append(s[1:], s[-1] - 1.0)
    f1[gap <= 0] = -1
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    at = best[np.argmax(gap[best])]
    return float(s[at] - gap[at] / 2) if at + 1 < len(s) else float(s[at] - 0.5)
