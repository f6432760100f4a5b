"""Text dumps: pretokens, runs, n-grams and hexadecimal vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.codec import hex_column, printable_column


def _lines(df: DataFrame, path: str) -> None:
    # one ordered file is what these formats are; the rows are distinct tokens, not the corpus
    df.coalesce(1).write.mode("errorifexists").text(path)


def save_pretokens(tally: DataFrame, path: str) -> None:
    """count, tab, printable token; most frequent first, among equals the largest bytes first."""
    token = F.col("pretoken").cast("binary")
    _lines(tally.orderBy(F.desc("cnt"), F.desc(token)).select(F.concat_ws("\t", F.col("cnt").cast("string"), printable_column(token))), path)


def save_runs(runs: DataFrame, path: str) -> None:
    """count, then the tokens, all separated by tabs."""
    tokens = F.transform("tokens", printable_column)
    _lines(runs.orderBy(F.desc("cnt"), F.desc("tokens")).select(F.concat_ws("\t", F.col("cnt").cast("string"), F.array_join(tokens, "\t"))), path)


def save_ngrams(ngrams: DataFrame, path: str) -> None:
    """count, tab, tokens separated by spaces."""
    tokens = F.transform("ngram", printable_column)
    _lines(ngrams.orderBy(F.desc("cnt"), "ngram").select(F.concat_ws("\t", F.col("cnt").cast("string"), F.array_join(tokens, " "))), path)


def save_hex_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """One hexadecimal token a line, by id."""
    _lines(vocabulary.orderBy("id").select(hex_column(F.col("token"))), path)
