"""Encoding and decoding with a trained model."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans.local_merge import blow_up_tokens, merge_tokens
from ..sources.model_file import Model, ModelError, read_model, specials_table, vocabulary_table

_REMEMBERED = 200_000


class SpecialTokenError(ValueError):
    """A text holds a special token where none is allowed."""


class Encoder:
    """A model made ready for encoding; immutable in use, so it can be broadcast."""

    def __init__(self, model: Model):
        self.model, self.splitter, self.vocabulary = model, model.splitter, model.vocabulary
        self._merges: dict[tuple[bytes, bytes], list[int]] = defaultdict(list)
        self._deletions: dict[bytes, list[int]] = defaultdict(list)
        for i, (pair, _, _) in sorted(model.words.merges.items()):
            self._merges[pair].append(i)
        for i, token in sorted(model.words.deletions.items()):
            self._deletions[token].append(i)
        self._parts = {t: model.words.parts(t) for t in self._deletions}
        self._supers: dict[tuple[bytes, bytes], int] = {}
        for i, (pair, _, _) in sorted((model.supers.merges if model.supers else {}).items()):
            self._supers.setdefault(pair, i)
        if model.supers:
            if model.supers.deletions:
                raise ModelError("a second pass has no deletions")
            self.possible = {t for pair in self._supers for t in pair}
        else:
            self.possible = {t for t in self.vocabulary.ids if self.splitter.mergeable(t)}
        self.reachable: frozenset[bytes] = frozenset()
        self._remember()
        self.reachable = frozenset(t for t in self.vocabulary.words() if self._reaches(t))
        self._remember()

    @classmethod
    def from_file(cls, path: str) -> Encoder:
        return cls(read_model(path))

    def _remember(self) -> None:
        self._chunk = lru_cache(maxsize=_REMEMBERED)(self._encode_chunk)
        self._known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_chunk", "_known")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._remember()

    def _reaches(self, token: bytes) -> bool:
        try:
            return len(self.tokens(token.decode("utf-8"), shortcut=False)) == 1
        except UnicodeDecodeError:
            return False

    def replay(self, data: bytes) -> list[bytes]:
        """Tokens of one pretoken: over and over the operation of the lowest index above the last one."""
        tokens, last = [bytes([b]) for b in data], -1
        while True:
            found = None
            for pair in zip(tokens, tokens[1:]):
                indices = self._merges.get(pair)
                if indices and (at := bisect_right(indices, last)) < len(indices) and (found is None or indices[at] < found[0]):
                    found = (indices[at], pair)
            if self._deletions:
                for t in tokens:
                    indices = self._deletions.get(t)
                    if indices and (at := bisect_right(indices, last)) < len(indices) and (found is None or indices[at] < found[0]):
                        found = (indices[at], t)
            if found is None:
                return tokens
            last = found[0]
            if isinstance(found[1], tuple):
                tokens, _ = merge_tokens(tokens, *found[1])
            else:
                tokens, _ = blow_up_tokens(tokens, found[1], self._parts[found[1]])

    def _encode_chunk(self, pretoken: str, shortcut: bool) -> tuple[bytes, ...]:
        data = pretoken.encode("utf-8")
        return (data,) if shortcut and data in self.reachable else tuple(self.replay(data))

    def supermerge(self, tokens: list[bytes]) -> list[bytes]:
        """Merges of the second pass: always the lowest index that is present."""
        while True:
            best = min(((self._supers[p], p) for p in zip(tokens, tokens[1:]) if p in self._supers), default=None)
            if best is None:
                return tokens
            tokens, _ = merge_tokens(tokens, *best[1])

    def tokens(self, text: str, shortcut: bool = True) -> list[bytes]:
        chunks = [self._chunk(p, shortcut) for p in self.splitter.split(text)]
        if not self._supers:
            return [t for c in chunks for t in c]
        out: list[bytes] = []
        run: list[bytes] = []
        for c in [*chunks, ()]:
            if len(c) == 1 and c[0] in self.possible:
                run.append(c[0])
                continue
            out.extend(self.supermerge(run) if len(run) > 1 else run)
            run = []
            out.extend(c)
        return out

    def _ids(self, tokens: list[bytes] | tuple[bytes, ...]) -> tuple[int, ...]:
        try:
            return tuple([self.vocabulary.ids[t] for t in tokens])
        except KeyError as missing:
            raise ModelError(f"{missing.args[0]!r} isn't in the vocabulary: the model's deletions left it without an id") from None

    def encode_ordinary(self, text: str, shortcut: bool = True) -> list[int]:
        if self._supers or not shortcut:
            return list(self._ids(self.tokens(text, shortcut)))
        # without a second pass a pretoken's ids don't depend on its neighbours, so each is worked out once
        out: list[int] = []
        known = self._known
        for pretoken in self.splitter.split(text):
            ids = known.get(pretoken)
            if ids is None:
                if len(known) >= _REMEMBERED:
                    known.clear()
                ids = known[pretoken] = self._ids(self._encode_chunk(pretoken, True))
            out += ids
        return out

    def encode(self, text: str, allowed: str | set[str] = "none_raise") -> list[int]:
        """allowed: "all", "none", "none_raise", or the special tokens to look for."""
        specials = self.vocabulary.specials
        if allowed == "none_raise":
            if any(s in text for s in specials):
                raise SpecialTokenError("the text holds a special token")
            wanted: dict[str, int] = {}
        elif allowed in ("all", "none"):
            wanted = specials if allowed == "all" else {}
        elif isinstance(allowed, (set, frozenset)):
            wanted = {k: v for k, v in specials.items() if k in allowed}
        else:
            raise ValueError(f"allowed={allowed!r} isn't understood")
        if not wanted:
            return self.encode_ordinary(text)
        out: list[int] = []
        for part in re.split("(" + "|".join(map(re.escape, wanted)) + ")", text):
            out += [wanted[part]] if part in wanted else self.encode_ordinary(part)
        return out

    @property
    def by_id(self) -> dict[int, bytes]:
        return {i: t for t, i in self.vocabulary.ids.items()} | {i: s.encode() for s, i in self.vocabulary.specials.items()}

    def decode_bytes(self, ids: list[int]) -> bytes:
        table = self.by_id
        try:
            return b"".join(table[i] for i in ids)
        except KeyError as missing:
            raise ModelError(f"no token has the id {missing.args[0]}") from None

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def get_vocab(self, with_specials: bool = True) -> dict[bytes, int]:
        return self.vocabulary.ids | ({s.encode(): i for s, i in self.vocabulary.specials.items()} if with_specials else {})

    def get_vocab_size(self, with_specials: bool = True) -> int:
        return self.vocabulary.total_size() if with_specials else len(self.vocabulary)

    def token_to_id(self, token: str | bytes) -> int | None:
        return self.vocabulary.ids.get(token.encode() if isinstance(token, str) else token)

    def id_to_token(self, i: int) -> str | None:
        return self.vocabulary[i].decode("utf-8", "replace") if 0 <= i < len(self.vocabulary) else None

    def add_special_tokens(self, texts: list[str]) -> int:
        return self.vocabulary.register_specials(texts)


def encode_documents(docs: DataFrame, encoder: Encoder, text: str = "text", into: str = "ids", allowed: str | set[str] = "none_raise") -> DataFrame:
    """docs with a column of token ids, batch or streaming. A worker remembers pretokens that it has met.
    A NULL text gives NULL; a special token in a text is an error unless `allowed` says otherwise. A table
    of fewer partitions than the session has cores is spread over them; a larger one isn't shuffled."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if not docs.isStreaming and docs.rdd.getNumPartitions() < cores:
        docs = docs.repartition(4 * cores)
    held = docs.sparkSession.sparkContext.broadcast(encoder)

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        tool = held.value
        return texts.map(lambda t: None if t is None else tool.encode(t, allowed))

    return docs.withColumn(into, run(F.col(text)))


def decode_documents(docs: DataFrame, encoder: Encoder, ids: str = "ids", into: str = "text") -> DataFrame:
    """docs with the text of a column of ids; broken UTF-8 becomes U+FFFD."""
    held = docs.sparkSession.sparkContext.broadcast(encoder.by_id)

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        table = held.value

        def one(row):
            if row is None:
                return None
            try:
                # right after encode_documents Spark hands on that function's lists, otherwise arrays
                return b"".join([table[i] for i in (row if isinstance(row, list) else row.tolist())]).decode("utf-8", "replace")
            except KeyError as missing:
                raise ModelError(f"no token has the id {missing.args[0]}") from None

        return rows.map(one)

    return docs.withColumn(into, run(F.col(ids)))


def decode_bytes_joined(docs: DataFrame, encoder: Encoder, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, data): the same as a lookup join on the vocabulary, which shows its plan to the optimiser.

    One row for each row of docs: no ids give no bytes, NULL gives NULL, and rows that share a key are
    decoded each; an unknown or NULL id is an error."""
    spark = docs.sparkSession
    table = vocabulary_table(spark, encoder.model).select("id", "token").unionByName(specials_table(spark, encoder.model).select("id", F.col("token").cast("binary").alias("token")))
    # the number is given before a row is taken apart
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(key).alias("__key"), F.col(ids).alias("__ids"))
    rows = rows.select("__row", "__key", F.col("__ids").isNull().alias("__null"), F.posexplode_outer("__ids").alias("pos", "id"))
    parts = rows.join(F.broadcast(table), "id", "left")  # as many rows as the vocabulary has tokens
    known = F.when(F.col("pos").isNull(), F.lit("")).otherwise(F.coalesce(F.hex("token"), F.raise_error(F.lit("unknown id"))))
    joined = parts.groupBy("__row", "__key", "__null").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("pos", F.lit(0)).alias("pos"), known.alias("hex")))).alias("p"))
    data = F.when(~F.col("__null"), F.unhex(F.array_join(F.transform("p", lambda x: x["hex"]), "")))
    return joined.select(F.col("__key").alias(key), data.alias("data"))


def eligible_pretokens(encoder: Encoder) -> set[bytes]:
    """Pretokens that a second pass may merge: reachable as one token, and a possible part."""
    return set(encoder.reachable) & encoder.possible
