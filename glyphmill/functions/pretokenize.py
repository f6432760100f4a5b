"""Splitting documents into pretokens.

Simple mode applies one pattern to the whole text. Script-aware mode first cuts the text into runs of
a script; runs of the character scripts use a pattern of their own. A mark that inherits its script
stays with its run; common characters between two runs go to the later one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from . import patterns, scripts


@dataclass
class Splitter:
    """Settings of a pretokenizer; both script settings or neither."""

    main: str = patterns.GPT4O
    character: str | None = None
    character_scripts: tuple[str, ...] | None = None
    merge_pattern: str = patterns.MERGE_SIMPLE
    _cache: dict = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self) -> None:
        if (self.character is None) != (not self.character_scripts):
            raise ValueError("a pattern for character scripts and the scripts go together")
        if self.character_scripts:
            self.character_scripts = tuple(sorted(self.character_scripts))
            scripts.numbers(self.character_scripts)
        for p in (self.main, self.character, self.merge_pattern):
            if p is not None:
                regex.compile(p)

    @classmethod
    def gpt4o_style(cls) -> Splitter:
        return cls(patterns.GPT4O, patterns.CHARACTER_GPT4O, patterns.CHARACTER_SCRIPTS)

    @classmethod
    def word_level(cls) -> Splitter:
        return cls(patterns.WORD_LEVEL, patterns.CHARACTER, patterns.CHARACTER_SCRIPTS)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_cache": {}}

    def _compiled(self, pattern: str):
        if pattern not in self._cache:
            self._cache[pattern] = regex.compile(pattern)
        return self._cache[pattern]

    def runs(self, text: str) -> list[tuple[str, bool]]:
        """(run, whether its script is a character script) of a text."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = scripts.table()[codes]
        real = np.flatnonzero(kind > scripts.INHERITED)
        wanted = scripts.numbers(self.character_scripts)
        if not len(real):
            return [(text, False)] if text else []
        change = np.flatnonzero(kind[real[1:]] != kind[real[:-1]])
        # a run ends after its last own character and the inherited ones that follow among them
        cuts = [0]
        for i in change:
            last, following = real[i], real[i + 1]
            inherited = np.flatnonzero(kind[last:following] == scripts.INHERITED)
            cuts.append(int(last + (inherited[-1] if len(inherited) else 0) + 1))
        cuts.append(len(text))
        own = [kind[real[0]], *kind[real[change + 1]]]
        return [(text[a:b], int(k) in wanted) for a, b, k in zip(cuts[:-1], cuts[1:], own, strict=True)]

    def split(self, text: str) -> list[str]:
        if not self.character:
            return self._compiled(self.main).findall(text)
        main, character = self._compiled(self.main), self._compiled(self.character)
        return [p for run, single in self.runs(text) for p in (character if single else main).findall(run)]

    def mergeable(self, token: bytes) -> bool:
        """Whether a token may take part in a merge across pretokens: valid UTF-8 and the pattern found."""
        try:
            return self._compiled(self.merge_pattern).search(token.decode("utf-8")) is not None
        except UnicodeDecodeError:
            return False


def pretokens_native(text: Column, pattern: str) -> Column:
    """Simple mode as a built-in expression; for patterns that Java can express."""
    form = patterns.java(pattern)
    if form is None:
        raise ValueError("this pattern needs the Arrow backend")
    return F.regexp_extract_all(text, F.lit(form), F.lit(0))


def is_native(splitter: Splitter) -> bool:
    """Whether a built-in expression splits exactly as this."""
    return splitter.character is None and patterns.java(splitter.main) is not None and splitter.main in patterns.CATALOGUE.values()


def parts(sizes: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about `most`: a batch's rows are counted, not weighed, by Spark."""
    group = (np.cumsum(sizes) - sizes).astype(np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)] if len(sizes) else [0]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def with_pretokens(docs: DataFrame, splitter: Splitter, text: str = "text", into: str = "pretokens", backend: str = "auto") -> DataFrame:
    """docs with a column of pretokens. backend: native, arrow, or auto (native where it's exact)."""
    if backend not in ("auto", "native", "arrow"):
        raise ValueError(f"unknown backend {backend}")
    if backend == "native" or backend == "auto" and is_native(splitter):
        return docs.withColumn(into, pretokens_native(F.col(text), splitter.main))

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for a, b in parts(texts.str.len().fillna(0).to_numpy()):
                yield texts.iloc[a:b].map(lambda t: None if t is None else splitter.split(t))

    return docs.withColumn(into, split(F.col(text)))


def pretokens_exploded(docs: DataFrame, splitter: Splitter, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, pretoken)."""
    return with_pretokens(docs.select(key, text), splitter, text, "__p").select(key, F.posexplode("__p").alias("pos", "pretoken"))


def mergeable_column(token: Column, merge_pattern: str = patterns.MERGE_SIMPLE) -> Column:
    """could_merge of a binary column; the pattern is searched in valid UTF-8 only."""
    form = patterns.java(merge_pattern)
    return F.when(F.is_valid_utf8(token.cast("string")), token.cast("string").rlike(form)).otherwise(F.lit(False))


def both_mergeable_column(left: Column, right: Column, merge_pattern: str = patterns.MERGE_SIMPLE) -> Column:
    return mergeable_column(left, merge_pattern) & mergeable_column(right, merge_pattern)


@lru_cache(maxsize=2)
def _ready(script_aware: bool) -> Splitter:
    return Splitter.gpt4o_style() if script_aware else Splitter()


def pretokenize(text: str) -> list[str]:
    """Pretokens of one text in simple mode; the splitter is made once."""
    return _ready(False).split(text)


def pretokenize_script_aware(text: str) -> list[str]:
    """The same with single characters for the scripts that are written without blanks."""
    return _ready(True).split(text)
