"""Queries of the vocabulary operators over the driver's tables, and the same in SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import patterns
from .functions.codec import hex_column, printable_column
from .functions.pretokenize import Splitter, mergeable_column, with_pretokens
from .operators import ngrams, stats
from .operators.encode import Encoder, decode_bytes_joined, decode_documents, encode_documents
from .operators.greedy_split import greedy_split
from .operators.rewrite import blow_up, merge_pair
from .plans.local_merge import Vocabulary
from .plans.train import runs_of, train_supers, train_words
from .sources.corpus import byte_budget, first_documents
from .sources.model_file import Model, operations_table, vocabulary_table

GPT2, GPT4O = Splitter(patterns.GPT2), Splitter(patterns.GPT4O)
#: The operators whose feature is a limit.
BUDGET, LINES, TOP = 1_000_000, 500, 25
NGRAM_COUNT, NGRAM_LENGTH = 15, 30
VOCAB_SIZE, SUPERS = 500, 40


def _docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tally(splitter: Splitter) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: stats.pretoken_tally(_docs(spark, d), splitter)


def _gpt2_chunks(spark: SparkSession, d: str) -> DataFrame:
    return stats.byte_chunks(stats.pretoken_tally(_docs(spark, d), GPT2))


def pretoken_length_hist(spark: SparkSession, d: str) -> DataFrame:
    tally = stats.pretoken_tally(_docs(spark, d), GPT2)
    return tally.groupBy(F.length("pretoken").cast("bigint").alias("n_chars")).agg(F.sum("cnt").alias("cnt"))


def reversibility_check(spark: SparkSession, d: str) -> DataFrame:
    split = with_pretokens(_docs(spark, d).select("doc_id", "text"), GPT4O)
    return split.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), (F.array_join("pretokens", "") == F.col("text")).alias("same"))


def script_aware_tally(spark: SparkSession, d: str) -> DataFrame:
    return stats.pretoken_tally(_docs(spark, d), Splitter.gpt4o_style())


def byte_budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    return byte_budget(_docs(spark, d).select("doc_id", "text"), BUDGET).select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"))


def line_limit(spark: SparkSession, d: str) -> DataFrame:
    return first_documents(_docs(spark, d).select("doc_id", "lang"), LINES)


def byte_frequency(spark: SparkSession, d: str) -> DataFrame:
    # pretokens make up the whole text, and of those only distinct ones are taken apart
    return stats.token_counts(_gpt2_chunks(spark, d)).select(hex_column(F.col("token")).alias("byte"), "cnt")


def _pairs_shown(pairs: DataFrame) -> DataFrame:
    return pairs.select(hex_column(F.col("left")).alias("left"), hex_column(F.col("right")).alias("right"), "cnt")


def pair_counts_words(spark: SparkSession, d: str) -> DataFrame:
    return _pairs_shown(stats.pair_counts(_gpt2_chunks(spark, d)))


def best_pair_topk(spark: SparkSession, d: str) -> DataFrame:
    return _pairs_shown(stats.best_pairs(stats.pair_counts(_gpt2_chunks(spark, d)), TOP))


def ios_ratios(spark: SparkSession, d: str) -> DataFrame:
    found = stats.ios_of_chunks(_gpt2_chunks(spark, d))
    return found.select(hex_column(F.col("left")).alias("left"), hex_column(F.col("right")).alias("right"), "cnt", F.round("ios_left", 9).alias("ios_left"), F.round("ios_right", 9).alias("ios_right"))


def whole_words(spark: SparkSession, d: str) -> DataFrame:
    chunks = _gpt2_chunks(spark, d)
    return stats.whole_word_count(chunks).crossJoin(stats.single_byte_count(chunks))


def merge_once(spark: SparkSession, d: str) -> DataFrame:
    merged = merge_pair(F.col("tokens"), F.lit(b"e"), F.lit(b"n"))
    return _gpt2_chunks(spark, d).select(F.array_join(F.transform(merged, hex_column), " ").alias("tokens"), "cnt")


def blow_up_once(spark: SparkSession, d: str) -> DataFrame:
    merged = merge_pair(F.col("tokens"), F.lit(b"e"), F.lit(b"n"))
    parted = blow_up(merged, F.lit(b"en"), F.array(F.lit(b"e"), F.lit(b"n")))
    return _gpt2_chunks(spark, d).select(F.array_join(F.transform(parted, hex_column), " ").alias("tokens"), "cnt")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return stats.document_runs(_docs(spark, d), GPT2)


def _ngrams(spark: SparkSession, d: str) -> DataFrame:
    return ngrams.frequent(stats.document_runs(_docs(spark, d), GPT2, then=ngrams.as_pieces, schema=ngrams.PIECES), NGRAM_LENGTH, NGRAM_COUNT)


def _joined(tokens: str) -> F.Column:
    return F.array_join(F.transform(tokens, lambda t: t.cast("string")), "␟")


def superword_runs(spark: SparkSession, d: str) -> DataFrame:
    return stats.tallied(_runs(spark, d)).select(_joined("tokens").alias("tokens"), "cnt")


def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    return _ngrams(spark, d).select(_joined("ngram").alias("ngram"), F.col("n").cast("bigint").alias("n"), "cnt")


def ngram_len_hist(spark: SparkSession, d: str) -> DataFrame:
    found = stats.ngram_lengths(_ngrams(spark, d))
    return found.select(F.col("n").cast("bigint").alias("n"), "kinds", "total")


def mergeable_tokens(spark: SparkSession, d: str) -> DataFrame:
    tally = stats.pretoken_tally(_docs(spark, d), GPT2)
    return tally.select("pretoken", mergeable_column(F.col("pretoken").cast("binary")).alias("mergeable"))


def printable_bytes(spark: SparkSession, d: str) -> DataFrame:
    bytes_ = spark.range(256).select("id", F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("token"))
    return bytes_.select("id", printable_column(F.col("token")).alias("shown"), hex_column(F.col("token")).alias("hex"))


def vocab_initial(spark: SparkSession, d: str) -> DataFrame:
    rows = [(i, t.hex()) for t, i in Vocabulary.initial().ids.items()]
    return spark.createDataFrame(rows, "id bigint, token string")


@lru_cache(maxsize=4)
def _trained(spark: SparkSession, d: str) -> Model:
    return train_words(_docs(spark, d), VOCAB_SIZE, tau=0.9, splitter=GPT2, specials=["<|end|>"])


@lru_cache(maxsize=4)
def _encoder(spark: SparkSession, d: str) -> Encoder:
    return Encoder(_trained(spark, d))


def train_ops(spark: SparkSession, d: str) -> DataFrame:
    ops = operations_table(spark, _trained(spark, d).words)
    return ops.select("idx", "kind", *[hex_column(F.col(c)).alias(c) for c in ("left", "right", "token")], "cnt", "unlocked")


def trained_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary_table(spark, _trained(spark, d)).select("id", hex_column(F.col("token")).alias("token"), "cnt", "is_super")


def train_boundless_ops(spark: SparkSession, d: str) -> DataFrame:
    model = train_supers(_docs(spark, d), _trained(spark, d))
    return operations_table(spark, model.supers).select("idx", hex_column(F.col("left")).alias("left"), hex_column(F.col("right")).alias("right"), "cnt")


def train_superbpe_ops(spark: SparkSession, d: str) -> DataFrame:
    model = train_supers(_docs(spark, d), _trained(spark, d), SUPERS)
    return operations_table(spark, model.supers).select("idx", hex_column(F.col("left")).alias("left"), hex_column(F.col("right")).alias("right"), "cnt")


def model_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs_of(_docs(spark, d), _trained(spark, d)).select(_joined("tokens").alias("tokens"), "cnt")


def greedy_split_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = _runs(spark, d).withColumn("cnt", F.lit(1).cast("bigint"))
    return greedy_split(runs, _ngrams(spark, d)).select(_joined("tokens").alias("tokens"), "cnt")


def encode_documents_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_documents(_docs(spark, d).select("doc_id", "text"), _encoder(spark, d)).select("doc_id", F.size("ids").alias("n_tokens"), "ids")


def decode_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    encoder = _encoder(spark, d)
    encoded = encode_documents(_docs(spark, d).select("doc_id", "text"), encoder).select("doc_id", "ids")
    return decode_documents(encoded, encoder).select("doc_id", "text")


def decode_joined(spark: SparkSession, d: str) -> DataFrame:
    encoder = _encoder(spark, d)
    encoded = encode_documents(_docs(spark, d).select("doc_id", "text"), encoder).select("doc_id", "ids")
    return decode_bytes_joined(encoded, encoder).select("doc_id", F.col("data").cast("string").alias("text"))


def conversations_tokens_by_role(spark: SparkSession, d: str) -> DataFrame:
    encoded = encode_documents(_docs(spark, d, "conversations").select("role", "text"), _encoder(spark, d))
    return encoded.groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.size("ids")).alias("n_tokens"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {"pretoken_tally_gpt2": _tally(GPT2), "pretoken_tally_gpt4o": _tally(GPT4O)}
    rest = (
        pretoken_length_hist, reversibility_check, script_aware_tally, byte_budget_prefix, line_limit, byte_frequency, pair_counts_words, best_pair_topk, ios_ratios, whole_words, merge_once, blow_up_once, superword_runs, ngram_counts,
        ngram_len_hist, mergeable_tokens, printable_bytes, vocab_initial, train_ops, trained_vocabulary, train_boundless_ops, train_superbpe_ops, model_runs, greedy_split_runs, encode_documents_ids, decode_roundtrip, decode_joined, conversations_tokens_by_role,
    )
    return named | {f.__name__: f for f in rest}


# DuckDB's regular expressions have no lookahead. A private character before the last of several blanks
# that a word follows stands in for it, and is left out of every negated class.
_WS = r"\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_STAND = r"\x{F8FF}"
_GPT2_SQL = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}{_STAND}]+|[{_WS}]+"
_SUFFIX = "(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
_LEAD = rf"[^\r\n\p{{L}}\p{{N}}{_STAND}]?"
_UP, _LOW = (r"[\p{" + r"}\p{".join(x) + "}]" for x in (("Lu", "Lt", "Lm", "Lo", "M"), ("Ll", "Lm", "Lo", "M")))
_GPT4O_SQL = rf"{_LEAD}{_UP}*{_LOW}+{_SUFFIX}|{_LEAD}{_UP}+{_LOW}*{_SUFFIX}|\p{{N}}{{1,3}}| ?[^{_WS}\p{{L}}\p{{N}}{_STAND}]+[\r\n/]*|[{_WS}]*[\r\n]+|[{_WS}]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pretokens_sql(pattern: str, last: str) -> str:
    marked = rf"regexp_replace(text, {_quoted(rf'([{_WS}])({last})([^{_WS}])')}, {_quoted(chr(92) + '1' + chr(0xF8FF) + chr(92) + '2' + chr(92) + '3')}, 'g')"
    return f"p AS (SELECT doc_id, regexp_extract_all({marked}, {_quoted(pattern)}) AS ps FROM documents)"


_P2 = "WITH " + _pretokens_sql(_GPT2_SQL, f"[{_WS}]")
_P4 = "WITH " + _pretokens_sql(_GPT4O_SQL, f"[{_WS.replace(chr(92) + 'n', '').replace(chr(92) + 'r', '')}]")
_T2 = f"{_P2}, t AS (SELECT pretoken, count(*) AS cnt FROM (SELECT unnest(ps) AS pretoken FROM p) GROUP BY pretoken)"
_CHUNKS = f"{_T2}, c AS (SELECT row_number() OVER () AS id, lower(hex(encode(pretoken))) AS h, cnt FROM t), b AS (SELECT id, cnt, i, substr(h, 2 * i - 1, 2) AS tok FROM (SELECT id, h, cnt, unnest(range(1, len(h) // 2 + 1)) AS i FROM c))"
_PAIRS = (
    f"{_CHUNKS}, r AS (SELECT *, i - row_number() OVER (PARTITION BY id, tok ORDER BY i) AS island FROM b), "
    "q AS (SELECT *, row_number() OVER (PARTITION BY id, tok, island ORDER BY i) - 1 AS nth, lead(tok) OVER (PARTITION BY id ORDER BY i) AS following FROM r), "
    'pc AS (SELECT tok AS "left", following AS "right", sum(cnt)::BIGINT AS cnt FROM q WHERE following IS NOT NULL AND (tok <> following OR nth % 2 = 0) GROUP BY ALL), '
    "tc AS (SELECT tok, sum(cnt)::BIGINT AS cnt FROM b GROUP BY tok)"
)
_RUNS = (
    f"{_P2}, e AS (SELECT doc_id, unnest(ps) AS pretoken, unnest(range(len(ps))) AS pos FROM p), "
    "i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM e WHERE regexp_matches(pretoken, '\\p{L}')), "
    "g AS (SELECT list(pretoken ORDER BY pos) AS ts FROM i GROUP BY doc_id, island HAVING count(*) >= 2), runs AS (SELECT ts, count(*) AS cnt FROM g GROUP BY ts)"
)
_GRAMS = (
    f"{_RUNS}, s AS (SELECT ts, cnt, n, unnest(range(1, len(ts) - n + 2)) AS k FROM runs, (SELECT unnest(range(2, {NGRAM_LENGTH + 1})) AS n)), "
    f"ng AS (SELECT array_to_string(ts[k:k + n - 1], '␟') AS ngram, n, sum(cnt)::BIGINT AS cnt FROM s GROUP BY ALL HAVING sum(cnt) >= {NGRAM_COUNT})"
)


def oracle_sql() -> dict[str, str]:
    plain = "array_to_string(list_transform(range(1, len(h) // 2 + 1), lambda i: substr(h, 2 * i - 1, 2)), ' ')"
    tally4 = f"{_P4} SELECT pretoken, count(*) AS cnt FROM (SELECT unnest(ps) AS pretoken FROM p) GROUP BY pretoken"
    shown = "SELECT i AS id, CASE WHEN i BETWEEN 33 AND 126 OR i BETWEEN 161 AND 172 OR i BETWEEN 174 AND 255 THEN chr(i::INT) ELSE chr((256 + CASE WHEN i < 33 THEN i WHEN i < 161 THEN i - 94 ELSE 67 END)::INT) END AS shown, lower(lpad(hex(i), 2, '0')) AS hex"
    return {
        "pretoken_tally_gpt2": f"{_T2} SELECT pretoken, cnt FROM t",
        "pretoken_tally_gpt4o": tally4,
        "script_aware_tally": tally4,
        "pretoken_length_hist": f"{_T2} SELECT length(pretoken) AS n_chars, sum(cnt)::BIGINT AS cnt FROM t GROUP BY ALL",
        "reversibility_check": "SELECT doc_id, length(text) AS n_chars, true AS same FROM documents",
        "byte_budget_prefix": f"SELECT doc_id, n_bytes FROM (SELECT doc_id, strlen(text) AS n_bytes, coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < {BUDGET}",
        "line_limit": f"SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT {LINES}",
        "byte_frequency": f"{_CHUNKS} SELECT tok AS byte, sum(cnt)::BIGINT AS cnt FROM b GROUP BY tok",
        "pair_counts_words": f'{_PAIRS} SELECT "left", "right", cnt FROM pc',
        "best_pair_topk": f'{_PAIRS} SELECT "left", "right", cnt FROM pc ORDER BY cnt DESC, "left", "right" LIMIT {TOP}',
        "ios_ratios": f'{_PAIRS} SELECT "left", "right", pc.cnt, round(pc.cnt / a.cnt, 9) AS ios_left, round(pc.cnt / z.cnt, 9) AS ios_right FROM pc JOIN tc a ON a.tok = "left" JOIN tc z ON z.tok = "right"',
        "whole_words": f"{_CHUNKS} SELECT (SELECT coalesce(sum(cnt), 0)::BIGINT FROM c WHERE len(h) = 2) AS whole_words, (SELECT sum(cnt)::BIGINT FROM b) AS single_bytes",
        "merge_once": f"{_CHUNKS} SELECT replace({plain}, '65 6e', '656e') AS tokens, cnt FROM c",
        "blow_up_once": f"{_CHUNKS} SELECT {plain} AS tokens, cnt FROM c",
        "superword_runs": f"{_RUNS} SELECT array_to_string(ts, '␟') AS tokens, cnt FROM runs",
        "ngram_counts": f"{_GRAMS} SELECT ngram, n, cnt FROM ng",
        "ngram_len_hist": f"{_GRAMS} SELECT n, count(*) AS kinds, sum(cnt)::BIGINT AS total FROM ng GROUP BY n",
        "mergeable_tokens": f"{_T2} SELECT pretoken, regexp_matches(pretoken, '\\p{{L}}') AS mergeable FROM t",
        "printable_bytes": f"{shown} FROM (SELECT unnest(range(256)) AS i)",
        "vocab_initial": "SELECT row_number() OVER (ORDER BY i) - 1 AS id, lower(lpad(hex(i), 2, '0')) AS token FROM (SELECT unnest(range(245)) AS i) WHERE i NOT IN (192, 193)",
        "decode_roundtrip": "SELECT doc_id, text FROM documents",
        "decode_joined": "SELECT doc_id, text FROM documents",
    }
