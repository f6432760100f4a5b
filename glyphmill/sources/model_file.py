"""The text model file, version 2: vocabulary, special tokens, and one or two sections of operations."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from ..functions.codec import printable, unprintable
from ..functions.pretokenize import Splitter
from ..plans.local_merge import Operations, Vocabulary

MAGIC = "glyphmill"
KINDS = ("word", "boundless", "superbpe")


class ModelError(ValueError):
    """A model file or a model that breaks its own rules."""


@dataclass
class Model:
    vocabulary: Vocabulary
    words: Operations
    splitter: Splitter
    supers: Operations | None = None

    @property
    def kind(self) -> str:
        if self.supers is None:
            return "word"
        return "superbpe" if self.supers.superbpe_mode else "boundless"


def _write_section(f: TextIO, ops: Operations, splitter: Splitter) -> None:
    config = {
        "tau": ops.tau, "is_super": ops.is_super, "superbpe_mode": ops.superbpe_mode, "blowup": ops.blowup, "main_regex": splitter.main, "script_specific_regex": splitter.character,
        "script_specific_scripts": list(splitter.character_scripts) if splitter.character_scripts else None, "merge_pattern": splitter.merge_pattern,
    }
    print(json.dumps(config), "merges", len(ops.merges), sep="\n", file=f)
    for i, ((left, right), count, flag) in sorted(ops.merges.items()):
        print(i, printable(left), printable(right), count, flag, file=f)
    print("deletions", len(ops.deletions), sep="\n", file=f)
    for i, token in sorted(ops.deletions.items()):
        print(i, printable(token), file=f)


def write_model(model: Model, path: str, magic: str = MAGIC) -> None:
    """magic is the first word of the header; other tools may expect their own."""
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        print(magic, "v2", model.kind, file=f)
        print("vocabulary", len(model.vocabulary), sep="\n", file=f)
        for token, i in model.vocabulary.ids.items():
            print(i, printable(token), model.vocabulary.counts.get(token, 0), int(token in model.vocabulary.supers), file=f)
        print("special_tokens", len(model.vocabulary.specials), sep="\n", file=f)
        for text, i in sorted(model.vocabulary.specials.items(), key=lambda x: x[1]):
            print(i, text, file=f)
        print("words", file=f)
        _write_section(f, model.words, model.splitter)
        if model.supers is not None:
            print("superwords", file=f)
            _write_section(f, model.supers, model.splitter)


class _Lines:
    def __init__(self, f: TextIO):
        self.f = f

    def line(self) -> str:
        text = self.f.readline()
        if not text:
            raise ModelError("the file ends early")
        return text.rstrip("\n")

    def expect(self, name: str) -> None:
        if (found := self.line()) != name:
            raise ModelError(f"expected {name!r}, found {found!r}")

    def fields(self, n: int, most: int = -1) -> list[str]:
        parts = self.line().split(" ", most)
        if len(parts) != n:
            raise ModelError(f"expected {n} fields, found {parts}")
        return parts

    def section(self, name: str) -> range:
        self.expect(name)
        return range(int(self.line()))


def _read_section(lines: _Lines) -> tuple[Operations, Splitter]:
    config = json.loads(lines.line())
    missing = {"tau", "is_super", "superbpe_mode", "blowup", "main_regex"} - {k for k, v in config.items() if v is not None}
    if missing:
        raise ModelError(f"the configuration lacks {sorted(missing)}")
    scripts = config.get("script_specific_scripts")
    splitter = Splitter(config["main_regex"], config.get("script_specific_regex"), tuple(scripts) if scripts else None, config["merge_pattern"])
    ops = Operations(config["tau"], config["is_super"], config["superbpe_mode"], config["blowup"])
    for _ in lines.section("merges"):
        i, left, right, count, flag = lines.fields(5)
        ops.merges[int(i)] = ((unprintable(left), unprintable(right)), int(count), int(flag))
    for _ in lines.section("deletions"):
        i, token = lines.fields(2)
        ops.deletions[int(i)] = unprintable(token)
    ops.check()
    return ops, splitter


def read_model(path: str) -> Model:
    with open(path, encoding="utf-8", newline="\n") as f:
        lines = _Lines(f)
        header = lines.line().split()
        if len(header) != 3 or header[1] != "v2" or header[2] not in KINDS:
            raise ModelError(f"unknown header {header}")
        vocabulary = Vocabulary()
        for _ in lines.section("vocabulary"):
            i, token, count, flag = lines.fields(4)
            if vocabulary.add(unprintable(token), flag == "1") != int(i):
                raise ModelError(f"token {i} is out of place")
            if int(count):
                vocabulary.counts[unprintable(token)] = int(count)
        for _ in lines.section("special_tokens"):
            i, text = lines.fields(2, 1)
            vocabulary.specials[text] = int(i)
        lines.expect("words")
        words, splitter = _read_section(lines)
        supers = None
        if header[2] != "word":
            lines.expect("superwords")
            supers, splitter = _read_section(lines)[0], splitter
    vocabulary.verify()
    return Model(vocabulary, words, splitter, supers)


def vocabulary_table(spark: SparkSession, model: Model) -> DataFrame:
    v = model.vocabulary
    return spark.createDataFrame([(i, bytearray(t), v.counts.get(t, 0), t in v.supers) for t, i in v.ids.items()], "id int, token binary, cnt bigint, is_super boolean")


def specials_table(spark: SparkSession, model: Model) -> DataFrame:
    return spark.createDataFrame([(i, t) for t, i in model.vocabulary.specials.items()], "id int, token string")


def operations_table(spark: SparkSession, ops: Operations) -> DataFrame:
    """(idx, kind, left, right, token, cnt, unlocked): merges and deletions as one log."""
    rows = [(i, kind, bytearray(x[0]), bytearray(x[1]), bytearray(x[0] + x[1]), cnt, flag) if kind == "merge" else (i, kind, None, None, bytearray(x), None, None) for i, kind, x, cnt, flag in ops.ordered()]
    return spark.createDataFrame(rows, "idx int, kind string, left binary, right binary, token binary, cnt bigint, unlocked int")


def write_tables(spark: SparkSession, model: Model, folder: str) -> None:
    """The model as Parquet tables beside each other."""
    vocabulary_table(spark, model).write.parquet(f"{folder}/vocabulary")
    specials_table(spark, model).write.parquet(f"{folder}/special_tokens")
    operations_table(spark, model.words).write.parquet(f"{folder}/words")
    if model.supers is not None:
        operations_table(spark, model.supers).write.parquet(f"{folder}/superwords")
