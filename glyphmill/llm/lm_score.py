"""Language-model scores with stupid backoff, computed relationally.

    S(w | h) = count(h w) / count(h)      where count(h w) reaches min_count
             = 0.4 * S(w | h without its first word)   otherwise
    S(w)     = count(w) / count()         count() is the number of all words

All counts are taken over the whole corpus. The plan is one join on n-grams:

1. documents are grouped into batches of a bounded size and exploded into n-grams of every order;
   a batch combines its equal n-grams, so a frequent one is sent once for each batch and no
   partition is skewed by it;
2. the n-grams are partitioned by hash, and each partition sums its count table and joins it to the
   n-grams that were sent;
3. the joined counts return to their batch, and are summed for each document.

An n-gram is its partition's number and 48 further bits of a hash. Partitions follow the corpus in
number, not in size, so two n-grams of a partition share a key with a chance near 1e-8 at any scale.
Keys are sent sorted, as gaps in separate byte planes, which halves what is shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .shared import only
from .textutil import ngram_hashes, steps, word_hashes

SCHEMA = "doc_id bigint, n_words bigint, log_score double, mean_log_score double"
_KEY_BITS = 48
_POSITIONS = 1 << 17  # positions that are summed at once


def _pack(keys: np.ndarray) -> bytes:
    """Sorted 48-bit keys as gaps: the planes of byte 5, byte 4, then the four low bytes."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return b"".join(((gaps >> np.uint64(8 * i)).astype(np.uint8)).tobytes() for i in range(5, -1, -1))


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(6, -1)
    gaps = np.zeros(planes.shape[1], dtype=np.uint64)
    for plane in planes:
        gaps = (gaps << np.uint64(8)) | plane.astype(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    """One byte for a count under 255; larger ones follow in full."""
    return counts.clip(0, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def _unpack_counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, dtype=np.uint8, count=n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, dtype=np.int64, offset=n)
    return out


def _words(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a column of texts; a small part of it is taken out of Arrow at a time."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    parts = [word_hashes(column.slice(a, b - a).to_pylist()) for a, b in steps(lengths, 500_000)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _exploded(words: np.ndarray, owner: np.ndarray, order: int, bits: int):
    """For each order in turn, so that one order's arrays are held at a time: its number, the distinct
    keys in order, and the row of the key at each position, -1 where the text has fewer words up to
    there. Order 0 is the empty n-gram, which every word has. Keys are sorted a range at a time."""
    spare = np.uint64(max(0, 64 - _KEY_BITS - bits))
    yield 0, np.zeros(1, np.uint64), np.zeros(len(words), np.int32)
    for n in range(1, order + 1):
        keys, ok = ngram_hashes(words, owner, n)
        rows = np.full(len(words), -1, dtype=np.int32)
        distinct, known = [np.zeros(0, np.uint64)], 0
        top = (keys >> np.uint64(61)).astype(np.uint8)
        top[~ok] = 255
        keys >>= spare
        for part in range(8):
            where = np.flatnonzero(top == part)
            own = keys[where]
            at = np.argsort(own)
            own, where = own[at], where[at]
            fresh = np.ones(len(own), dtype=bool)
            fresh[1:] = own[1:] != own[:-1]
            rows[where] = np.cumsum(fresh, dtype=np.int32) + np.int32(known - 1)
            distinct.append(own[fresh])
            known += len(distinct[-1])
        del keys, top, ok
        yield n, np.concatenate(distinct), rows


def _owners(sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


def _explode(order: int, bits: int):
    low = np.uint64(min(64 - bits, _KEY_BITS))
    mask = np.uint64((1 << int(low)) - 1)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        words, sizes = _words(table.column("text"))
        out: dict[str, list] = {"bucket": [], "batch": [], "order": [], "n": [], "keys": [], "counts": []}
        for n, unique, rows in _exploded(words, _owners(sizes), order, bits):
            counts = np.bincount(rows[rows >= 0], minlength=len(unique))
            bucket = (unique >> low).astype(np.int64) if bits else np.zeros(len(unique), np.int64)
            at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(unique) else np.zeros(0, np.int64)
            for a, b in zip(at, np.r_[at[1:], len(unique)], strict=False):
                for name, value in (("bucket", bucket[a]), ("batch", key[0].as_py()), ("order", n), ("n", b - a), ("keys", _pack(unique[a:b] & mask)), ("counts", _pack_counts(counts[a:b]))):
                    out[name].append(value)
        kinds = {"bucket": pa.int64(), "batch": pa.int64(), "order": pa.int32(), "n": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    return run


def _count_and_join(table: pa.Table) -> pa.Table:
    """Sums the partition's count table and gives every sender the counts of its keys. An order's hash has
    a seed of its own, so orders are told apart by their keys; order 0 has key 0."""
    sizes = table.column("n").to_pylist()
    keys = np.concatenate([_unpack(x) for x in table.column("keys").to_pylist()])
    sent = np.concatenate([_unpack_counts(x, n) for x, n in zip(table.column("counts").to_pylist(), sizes, strict=True)])
    at = np.argsort(keys)
    keys = keys[at]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    totals = np.add.reduceat(sent[at], first)
    joined = np.empty(len(at), dtype=np.int64)
    joined[at] = np.repeat(totals, np.diff(np.r_[first, len(keys)]))
    ends = np.cumsum(sizes)
    packed = [_pack_counts(joined[e - n : e]) for e, n in zip(ends, sizes, strict=True)]
    return table.select(["batch", "bucket", "order", "n"]).append_column("counts", pa.array(packed, pa.binary()))


def _summed(order: int, bits: int, min_count: int, backoff: float):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        words, sizes = _words(docs.column("text"))
        owner = _owners(sizes)
        total = len(words)
        replies = replies.sort_by([("order", "ascending"), ("bucket", "ascending")])
        orders = replies.column("order").to_numpy()
        levels = []  # (row of each position, log of each row's count, whether the row counts as seen)
        for n, unique, rows in _exploded(words, owner, order, bits):
            mine = np.flatnonzero(orders == n)
            got = [_unpack_counts(replies.column("counts")[int(i)].as_py(), replies.column("n")[int(i)].as_py()) for i in mine]
            counts = np.concatenate(got) if got else np.zeros(len(unique), np.int64)
            levels.append((rows, np.log(np.maximum(counts, 1)), counts >= (min_count if n > 1 else 1)))
        score = np.zeros(total)
        for a in range(0, total, _POSITIONS):
            part = slice(a, min(total, a + _POSITIONS))
            # upwards: an order that is seen replaces what lower orders gave, one that isn't costs a backoff
            for n in range(1, order + 1):
                rows, logs, seen = levels[n]
                own = rows[part]
                ok = own >= 0
                hit = np.zeros(len(own), dtype=bool)
                hit[ok] = seen[own[ok]]
                # the history of a position is the n-gram that ends before it
                before = np.flatnonzero(hit) + a - (n > 1)
                score[part][ok & ~hit] += math.log(backoff)
                score[part][hit] = logs[own[hit]] - levels[n - 1][1][levels[n - 1][0][before]]
        sums = np.bincount(owner, score, len(sizes))
        none = sizes == 0
        return pa.table({
            "doc_id": docs.column("doc_id"), "n_words": pa.array(sizes.astype(np.int64)),
            "log_score": pa.array(sums, mask=none), "mean_log_score": pa.array(sums / np.maximum(sizes, 1), mask=none),
        })

    return run


def score_documents(docs: DataFrame, order: int = 3, min_count: int = 2, backoff: float = 0.4, batch_bytes: int = 16_000_000, bucket_keys: int = 2_000_000) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) for every row of docs, under n-grams of all docs.

    n-grams of two or more words need `min_count` occurrences in the corpus, so that a document's own
    single n-gram doesn't vouch for itself; a word counts from its first occurrence. The first words
    of a text use the orders that their history allows, without a penalty. A text that is NULL or
    has no word has 0 words and NULL scores. Repeated rows are counted and scored each time; NULL
    ids are carried; an empty table gives none; texts are taken whole, and one that exceeds
    `batch_bytes` makes a batch of its own or shares one. Other columns are ignored.
    """
    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, math.ceil(size / batch_bytes))
    bits = max(0, math.ceil(math.log2(max(1.0, size / 6 * order * 0.7 / bucket_keys))))
    batched = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(batches)))
    sent = batched.groupBy("batch").applyInArrow(_explode(order, bits), "bucket bigint, batch bigint, order int, n bigint, keys binary, counts binary")
    joined = sent.groupBy("bucket").applyInArrow(_count_and_join, "batch bigint, bucket bigint, order int, n bigint, counts binary")
    return batched.groupBy("batch").cogroup(joined.groupBy("batch")).applyInArrow(_summed(order, bits, min_count, backoff), SCHEMA)


def score_sql(order: int = 3, min_count: int = 2, backoff: float = 0.4) -> str:
    """The same over a table `documents`, in SQL."""
    levels = "".join(f", c{n} AS (SELECT {', '.join(f'w{i}' for i in range(n))}, count(*) AS n FROM g WHERE w{n - 1} IS NOT NULL GROUP BY ALL)" for n in range(1, order + 1))
    joins = "".join(f" LEFT JOIN c{n} ON " + " AND ".join(f"g.w{i} = c{n}.w{i}" for i in range(n)) + (f" LEFT JOIN c{n - 1} AS h{n} ON " + " AND ".join(f"g.w{i + 1} = h{n}.w{i}" for i in range(n - 1)) if n > 1 else "") for n in range(1, order + 1))
    cases = "".join(f" WHEN c{n}.n >= {min_count} THEN ln(c{n}.n) - ln(h{n}.n) + {math.log(backoff)!r} * (least({order}, pos) - {n})" for n in range(order, 1, -1))
    lags = ", ".join(["w AS w0", *(f"lag(w, {i}) OVER (PARTITION BY doc_id ORDER BY pos) AS w{i}" for i in range(1, order))])
    return (
        "WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS ws FROM documents), "
        "e AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM t), "
        f"g AS (SELECT doc_id, pos, {lags} FROM e), total AS (SELECT count(*) AS n FROM g){levels}, "
        f"s AS (SELECT doc_id, CASE{cases} ELSE ln(c1.n) - ln(total.n) + {math.log(backoff)!r} * (least({order}, pos) - 1) END AS s FROM g CROSS JOIN total{joins}), "
        "d AS (SELECT doc_id, count(*) AS n_words, sum(s) AS s FROM s GROUP BY doc_id) "
        "SELECT t.doc_id, coalesce(n_words, 0) AS n_words, round(s, 6) AS log_score, round(s / n_words, 6) AS mean_log_score FROM t LEFT JOIN d USING (doc_id)"
    )
