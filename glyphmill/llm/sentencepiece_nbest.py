"""N-best SentencePiece segmentation: forward Viterbi scores are the exact heuristic of a backward
A* search over the piece lattice.

A text's lattice falls apart where no piece can cross: before a space mark that follows another
character, and around characters that no piece holds. Its N best paths are therefore made of the best
paths of such chunks, apart from deviations in at most N - 1 chunks, those with the smallest gap
between their best and second-best path. Forward and backward Viterbi run over all distinct chunks of
a step at once in NumPy; A* enumerates the N best paths of the few chunks that deviate.

The model file's path is a parameter. Pieces are scored by log-probabilities as the file gives them. A
file of merges has ranks instead, which say nothing about sums; as merges come in the order of frequency,
the piece of rank r is then given the probability of Zipf's law, 1 / (1 + r) over the sum of all. Nothing is
trained. A character that no piece holds is spelled in byte pieces at the price of an unknown piece.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import only
from .textutil import HashTable, span_hashes, text_steps

MARK = "▁"
_BASE = np.uint64(0x100000001B3)
_LONG = 48  # chunks beyond this length are searched one by one
_UNKNOWN = 10.0
_UNRANKED = -1e8  # files give pieces that are never to be chosen a score far below
_MEMORY = 600_000  # distinct chunks that a worker remembers before it starts afresh

_TOOLS: dict[tuple[str, int, bool], Segmenter] = {}  # a worker's, for all its tasks

SCHEMA = "doc_id bigint, rank int, score double, n_pieces int, ids array<int>, decodes boolean"


class Pieces:
    """The vocabulary as plain data, so that it can be broadcast."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte_ids = np.full(256, -1, dtype=np.int32)
        self.ids: dict[str, int] = {}
        self.scores = np.array([model.get_score(i) for i in range(len(self.text))])
        for i, piece in enumerate(self.text):
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
        ranked = np.array([i for i in self.ids.values() if self.scores[i] > _UNRANKED])
        if (self.scores[ranked] == np.round(self.scores[ranked])).all():
            share = 1 / (1 - self.scores[ranked])
            self.scores[ranked] = np.log(share / share.sum())
        self.data = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode("utf-8", "surrogatepass") for i, p in enumerate(self.text)]
        self.unknown_id = model.unk_id()
        self.unknown_score = float(min(x for x in self.scores[list(self.ids.values())] if x > _UNRANKED)) - _UNKNOWN
        self.longest = max(map(len, self.ids))
        self.crossing = any(MARK in p.lstrip(MARK) for p in self.ids)
        known = sorted(set("".join(self.ids)) - {MARK})
        self.held = np.zeros(0x110000, dtype=bool)  # characters that some piece holds
        self.held[[ord(c) for c in known]] = True
        prefixes: dict[int, int] = {}  # hash of every beginning of a piece, and the piece that it is
        for piece, i in self.ids.items():
            value = 0
            for c in piece:
                value = (value * int(_BASE) + ord(c) + 1) % (1 << 64)
                prefixes.setdefault(value, -1)
            prefixes[value] = i
        self.prefix_ids = np.fromiter(prefixes.values(), dtype=np.int32, count=len(prefixes))
        self.prefixes = HashTable(np.fromiter(prefixes, dtype=np.uint64, count=len(prefixes)))

    def spelled(self, char: str) -> list[int]:
        ids = [int(self.byte_ids[b]) for b in char.encode("utf-8", "surrogatepass")]
        return ids if min(ids) >= 0 else [self.unknown_id]

    def edges(self, chunk: str, start: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """(end, score, ids) of the lattice's edges from a position."""
        out = []
        for end in range(start + 1, min(len(chunk), start + self.longest) + 1):
            i = self.ids.get(chunk[start:end])
            if i is not None:
                out.append((end, float(self.scores[i]), (i,)))
        if not out or out[0][0] > start + 1:
            out.insert(0, (start + 1, self.unknown_score, tuple(self.spelled(chunk[start]))))
        return out

    def n_best(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """Up to n (score, ids), best first: Viterbi forward, then A* from the end of the chunk."""
        size = len(chunk)
        ahead = [-np.inf] * (size + 1)
        ahead[0] = 0.0
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
        for start in range(size):
            for end, score, ids in self.edges(chunk, start):
                into[end].append((start, score, ids))
                ahead[end] = max(ahead[end], ahead[start] + score)
        out: list[tuple[float, tuple[int, ...]]] = []
        turn = 0
        agenda = [(-ahead[size], turn, size, 0.0, None)]
        while agenda and len(out) < n:
            cost, _, at, behind, path = heapq.heappop(agenda)
            if at == 0:
                ids = []
                while path:
                    ids.extend(path[0])
                    path = path[1]
                out.append((-cost, tuple(ids)))
                continue
            for start, score, ids in into[at]:
                turn += 1
                heapq.heappush(agenda, (-(ahead[start] + score + behind), turn, start, score + behind, (ids, path)))
        return out


def _string(codes: np.ndarray) -> str:
    return codes.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def chunk_starts(pieces: Pieces, codes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the chunks of marked text begin: no piece crosses one of these positions."""
    mark = codes == ord(MARK)
    alone = ~mark & ~pieces.held[codes]
    begins = np.zeros(len(codes), dtype=bool)
    begins[text_starts] = True
    begins |= alone
    begins[1:] |= alone[:-1]
    if not pieces.crossing:
        begins[1:] |= mark[1:] & ~mark[:-1]
    return np.flatnonzero(begins)


def viterbi(pieces: Pieces, codes: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(score, gap to the second-best path, where the ids begin, ids) of every chunk; a gap is inf for
    a chunk with a single path."""
    score, gap = np.zeros(len(start)), np.full(len(start), np.inf)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # chunk, position from the end, id
    plain = (lengths <= _LONG) & (pieces.held[codes[start]] | (codes[start] == ord(MARK)))
    for i in np.flatnonzero(~plain):
        best = pieces.n_best(_string(codes[start[i] : start[i] + lengths[i]]), 2)
        score[i] = best[0][0]
        if len(best) > 1:
            gap[i] = best[0][0] - best[1][0]
        ids = np.array(best[0][1], dtype=np.int64)
        found.append((np.full(len(ids), i), np.arange(len(ids))[::-1], ids))
    for size in np.unique(lengths[plain]):
        every = np.flatnonzero(plain & (lengths == size))
        for a in range(0, len(every), 8192):
            _same_length(pieces, codes, start, every[a : a + 8192], int(size), score, gap, found)
    if not found:
        return score, gap, np.zeros(len(start) + 1, np.int64), np.zeros(0, np.int64)
    chunk, back, ids = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((-back, chunk))
    return score, gap, np.searchsorted(chunk[order], np.arange(len(start) + 1)), ids[order]


def _relax(edges: list, ahead: np.ndarray, step: np.ndarray, taken: np.ndarray, begin: int, end: int, lanes: np.ndarray, ids: np.ndarray | int, cost: np.ndarray | float) -> None:
    edges.append((begin, end, lanes, cost))
    total = ahead[begin, lanes] + cost
    better = total > ahead[end, lanes]
    chosen = lanes[better]
    ahead[end, chosen] = total[better]
    step[end, chosen] = end - begin
    taken[end, chosen] = ids if isinstance(ids, int) else ids[better]


def _same_length(pieces: Pieces, codes: np.ndarray, start: np.ndarray, rows: np.ndarray, size: int, score: np.ndarray, gap: np.ndarray, found: list) -> None:
    n = len(rows)
    codes = codes[start[rows][:, None] + np.arange(size)].T.astype(np.uint64) + np.uint64(1)
    edges: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    ahead = np.full((size + 1, n), -np.inf)
    ahead[0] = 0
    step = np.zeros((size + 1, n), dtype=np.int8)
    taken = np.full((size + 1, n), -1, dtype=np.int32)
    for begin in range(size):
        lanes, key = np.arange(n), np.zeros(n, dtype=np.uint64)
        for end in range(begin + 1, min(size, begin + pieces.longest) + 1):
            key = key * _BASE + codes[end - 1][lanes]
            row = pieces.prefixes.find(key)
            viable = row >= 0
            if end == begin + 1 and not viable.all():
                _relax(edges, ahead, step, taken, begin, end, lanes[~viable], -1, pieces.unknown_score)
            lanes, key, ids = lanes[viable], key[viable], pieces.prefix_ids[row[viable]]
            if not len(lanes):
                break
            piece = ids >= 0
            if end == begin + 1 and not piece.all():
                _relax(edges, ahead, step, taken, begin, end, lanes[~piece], -1, pieces.unknown_score)
            if piece.any():
                _relax(edges, ahead, step, taken, begin, end, lanes[piece], ids[piece], pieces.scores[ids[piece]])
    behind = np.full((size + 1, n), -np.inf)
    behind[size] = 0
    for begin, end, lanes, cost in reversed(edges):
        behind[begin, lanes] = np.maximum(behind[begin, lanes], behind[end, lanes] + cost)
    on = np.zeros((size + 1, n), dtype=bool)
    at, lane, depth = np.full(n, size), np.arange(n), 0
    unknown = np.zeros(n, dtype=bool)
    parts = []
    while len(lane):
        on[at, lane] = True
        ids = taken[at, lane]
        unknown[lane[ids < 0]] = True
        parts.append((lane, np.full(len(lane), depth), ids))
        at = at - step[at, lane]
        lane, at = lane[at > 0], at[at > 0]
        depth += 1
    second = np.full(n, -np.inf)
    for begin, end, lanes, cost in edges:
        best = on[end, lanes] & (step[end, lanes] == end - begin)
        second[lanes] = np.maximum(second[lanes], np.where(best, -np.inf, ahead[begin, lanes] + cost + behind[end, lanes]))
    score[rows] = ahead[size]
    gap[rows] = np.maximum(ahead[size] - second, 0)
    for lane, back, ids in parts:
        ok = ~unknown[lane]
        found.append((rows[lane[ok]], back[ok], ids[ok].astype(np.int64)))
    for lane in np.flatnonzero(unknown):  # byte pieces on the best path: several ids for one edge
        ids = np.array(pieces.n_best(_string(codes[:, lane] - np.uint64(1)), 1)[0][1], dtype=np.int64)
        found.append((np.full(len(ids), rows[lane]), np.arange(len(ids))[::-1], ids))


class Segmenter:
    """Segments texts; what it worked out for a chunk is remembered, up to a number of chunks."""

    def __init__(self, pieces: Pieces, n: int, prefix: bool = True):
        self.pieces, self.n, self.prefix = pieces, n, prefix
        self._held = lru_cache(maxsize=50_000)(lambda chunk: self.pieces.n_best(chunk, self.n))
        self._forget()

    def alternatives(self, chunk: str) -> list[tuple[float, tuple[int, ...]]]:
        """The chunk's n best segmentations; those of long chunks aren't remembered."""
        return self._held(chunk) if len(chunk) <= _LONG else self.pieces.n_best(chunk, self.n)

    def _forget(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.score, self.gap, self.begin, self.ids = np.zeros(0), np.zeros(0), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _rows(self, codes: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Row of each chunk in what is remembered; chunks that are new are worked out."""
        if len(self.keys) > _MEMORY:
            self._forget()
        keys, first, inverse = np.unique(span_hashes(codes, start, start + lengths), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys).clip(0, max(0, len(self.keys) - 1))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
        rows = np.empty(len(keys), dtype=np.int64)
        rows[known] = self.rows[at[known]]
        new = first[~known]
        rows[~known] = len(self.score) + np.arange(len(new))
        score, gap, begin, ids = viterbi(self.pieces, codes, start[new], lengths[new])
        self.score, self.gap = np.concatenate([self.score, score]), np.concatenate([self.gap, gap])
        self.begin = np.concatenate([self.begin, begin[1:] + self.begin[-1]])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        every = np.concatenate([self.keys, keys[~known]])
        order = np.argsort(every, kind="stable")
        self.keys, self.rows = every[order], np.concatenate([self.rows, rows[~known]])[order]
        return rows[inverse]

    def segment(self, texts: list[str]) -> list[list[tuple[float, np.ndarray]]]:
        """For each text up to n (score, ids), best first; an empty text has one empty segmentation."""
        lead = MARK if self.prefix else ""
        sizes = np.fromiter((len(t) + len(lead) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
        codes = np.frombuffer("".join([lead + t for t in texts if t]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
        codes[codes == 32] = ord(MARK)
        stops = np.cumsum(sizes)
        if not len(codes):
            return [[(0.0, np.zeros(0, np.int32))] for _ in texts]
        start = chunk_starts(self.pieces, codes, (stops - sizes)[sizes > 0])
        lengths = np.diff(np.append(start, len(codes)))
        x = self._rows(codes, start, lengths)
        count = self.begin[x + 1] - self.begin[x]
        ends = np.cumsum(count)
        flat = self.ids[np.repeat(self.begin[x] - (ends - count), count) + np.arange(ends[-1])]
        bounds = np.searchsorted(start, np.append(0, stops))
        scores, gaps = self.score[x], self.gap[x]
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            zero = int(ends[a] - count[a]) if a < b else 0
            best = flat[zero : int(ends[b - 1])] if a < b else flat[:0]
            total = float(scores[a:b].sum())
            own = [(total, best)]
            out.append(own)
            if self.n == 1 or a == b:
                continue
            near = np.sort(np.argsort(gaps[a:b], kind="stable")[: self.n - 1]) + a
            combined: list[tuple[float, tuple[tuple[int, tuple[int, ...]], ...]]] = [(0.0, ())]
            for at in near[np.isfinite(gaps[near])].tolist():
                options = self.alternatives(_string(codes[start[at] : start[at] + lengths[at]]))
                combined = sorted(((loss + options[0][0] - s, (*changes, (at, path)) if k else changes) for loss, changes in combined for k, (s, path) in enumerate(options)), key=lambda c: c[0])[: self.n]
            for loss, changes in combined[1:]:
                parts, done = [], 0
                for at, path in changes:
                    parts += [best[done : int(ends[at] - count[at]) - zero], np.array(path, dtype=best.dtype)]
                    done = int(ends[at]) - zero
                own.append((total - loss, np.concatenate([*parts, best[done:]])))
        return out


def encode_n_best(docs: DataFrame, model_path: str, n: int = 3, prefix: bool = True) -> DataFrame:
    """(doc_id, rank, score, n_pieces, ids, decodes): the up to n best segmentations of every row of docs.

    `decodes` says whether decoding the ids gives the text again (a U+2581 in it comes back as a space).
    `score` is the sum of the pieces' scores, rounded to 6 decimals. Equal scores are told apart by
    the order in which the search finds them, which depends on the text alone. An empty text has one
    segmentation without pieces; a NULL text has one row with NULL in all three and in decodes. Repeated rows are
    segmented each; NULL ids are carried; an empty table gives none; texts are taken whole. Columns
    other than doc_id and text are ignored.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    held = docs.sparkSession.sparkContext.broadcast(Pieces(model_path))

    def run(batches):
        tool = _TOOLS.setdefault((model_path, n, prefix), None) or Segmenter(held.value, n, prefix)
        _TOOLS[model_path, n, prefix] = tool
        for batch in batches:
            for a, _, texts in text_steps(batch, "text", 2_000_000):
                at = [i for i, t in enumerate(texts) if t is not None]
                found = dict(zip(at, tool.segment([texts[i] for i in at]), strict=True))
                ids = batch.column("doc_id").slice(a, len(texts))
                row, rank, score, path, back = [], [], [], [], []
                for i in range(len(texts)):
                    for r, (s, p) in enumerate(found.get(i, [(None, None)])):
                        row.append(i)
                        rank.append(r + 1)
                        score.append(s if s is None else round(s, 6))
                        path.append(p)
                        back.append(None if p is None else decode_ids(held.value, p.tolist(), prefix) == texts[i].replace(MARK, " "))
                sizes = np.array([0 if p is None else len(p) for p in path])
                values = np.concatenate([p for p in path if p is not None] or [np.zeros(0)]).astype(np.int32)
                gone = np.array([p is None for p in path], dtype=bool)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values), mask=pa.array(gone))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(rank, pa.int32()), pa.array(score, pa.float64()), pa.array(sizes.astype(np.int32), mask=gone), lists, pa.array(back, pa.bool_())], names=["doc_id", "rank", "score", "n_pieces", "ids", "decodes"])

    return only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(run, SCHEMA)


def decode_ids(pieces: Pieces, ids: list[int], prefix: bool = True) -> str:
    """Text of a segmentation; broken byte sequences become U+FFFD."""
    text = b"".join([pieces.data[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if prefix and text.startswith(" ") else text


def decode(segmentations: DataFrame, model_path: str, prefix: bool = True) -> DataFrame:
    """(doc_id, rank, text) for rows with doc_id, rank and ids. NULL ids give NULL. A text comes back as
    it was, except that a U+2581 in it becomes a space, which is the mark's meaning."""
    held = segmentations.sparkSession.sparkContext.broadcast(Pieces(model_path))

    def run(batches):
        for batch in batches:
            texts = [None if x is None else decode_ids(held.value, x, prefix) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rank"), pa.array(texts, pa.string())], names=["doc_id", "rank", "text"])

    return only(segmentations, "doc_id", "rank", "ids").mapInArrow(run, "doc_id bigint, rank int, text string")
