"""What stays bounded as tables grow: results must be those of the small forms."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glyphmill.functions import patterns
from glyphmill.functions.pretokenize import Splitter, parts, pretokens_exploded, with_pretokens
from glyphmill.operators import ngrams, stats
from glyphmill.operators.greedy_split import greedy_split, prefixes_of, split_greedily
from glyphmill.plans import spread_merge, train
from glyphmill.plans.local_merge import MergeEngine, Operations, Vocabulary


def words_of(rng, n, letters="aab"):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n)})


def run(engine, tau, blowup, size):
    ops, vocabulary = Operations(tau, blowup=blowup), Vocabulary.initial()
    while len(vocabulary) < size and engine.pairs:
        pair, _ = engine.best()
        engine.step(pair, ops, vocabulary)
        engine.verify()
    return ops.merges, ops.deletions, vocabulary.ids, {t: n for t, n in engine.singles.items() if n}


def test_flat_operations_change_counts_as_the_engine_does():
    rng = random.Random(3)
    for _ in range(200):
        chunks = [([bytes([b]) for b in w.encode()], rng.randint(1, 9)) for w in words_of(rng, 12)]
        engine = MergeEngine(chunks)
        tokens = spread_merge.flat(np.array([t[0] for c, _ in chunks for t in c], np.int32), np.array([len(c) for c, _ in chunks]))
        weights = np.array([n for _, n in chunks])
        for made, (left, right) in enumerate([(97, 97), (98, 97), (256, 98), (256, 256)], 256):
            names = {97: b"a", 98: b"b", 256: b"aa", 257: b"ba", 258: b"aab", 259: b"aaaa"}
            before = dict(engine.pairs)
            whole = engine.merge((names[left], names[right]))
            tokens, (keys, change, _, seen) = spread_merge.effect_of(tokens, weights, ("merge", left, right, made), 300)
            got = {(names[k // 300], names[k % 300]): n for k, n in zip(keys.tolist(), change.tolist())}
            assert got == {p: n for p in {*before, *engine.pairs} if (n := engine.pairs.get(p, 0) - before.get(p, 0))} and seen == whole
        assert tokens.tolist() == [x for c in engine.chunks for x in [*({v: k for k, v in names.items()}[t] for t in c), spread_merge.END]]


@pytest.mark.parametrize("tau,blowup,size", [(0.5, True, 262), (0.8, False, 258), (1.1, True, 256)])
def test_spread_engine_is_the_local_one(spark, monkeypatch, tau, blowup, size):
    """The driver holds 20 of the chunks only."""
    monkeypatch.setattr(spread_merge, "PIECE", 200)
    monkeypatch.setattr(spread_merge, "REWRITE", 3)
    rng = random.Random(size)
    chunks = sorted(((w, rng.randint(1, 30)) for w in words_of(rng, 150, "aabcd")), key=lambda x: -x[1])
    df = spark.createDataFrame([([bytearray(w.encode())], n) for w, n in chunks], "tokens array<binary>, cnt bigint")
    single = [([bytes([b]) for b in w.encode()], n) for w, n in chunks]
    engine = spread_merge.SpreadEngine(df, single[:20])
    assert run(engine, tau, blowup, size) == run(MergeEngine(single), tau, blowup, size)
    assert engine.written > 1
    engine.close()


@pytest.mark.parametrize("supers", [None, 6])
def test_training_doesnt_need_all_chunks_on_the_driver(spark, monkeypatch, supers):
    rng = random.Random(5)
    held = words_of(rng, 60, "abcde")
    docs = spark.createDataFrame([(i, " ".join(rng.choices(held[:20] + held, k=30))) for i in range(40)], "doc_id bigint, text string")

    def trained():
        words = train.train_words(docs, 300, tau=0.9, splitter=Splitter(patterns.GPT2), specials=["<|end|>"])
        more = train.train_supers(docs, words, supers)
        return words.words, words.vocabulary.ids, words.vocabulary.counts, more.supers, more.vocabulary.ids, more.vocabulary.counts, more.words

    want = trained()
    monkeypatch.setattr(train, "LOCAL_CHUNKS", 5)
    used = []
    monkeypatch.setattr(train, "MergeEngine", lambda *a: pytest.fail("all chunks went to the driver"))
    monkeypatch.setattr(spread_merge.SpreadEngine, "close", lambda self, close=spread_merge.SpreadEngine.close: (used.append(len(self.head[1])), close(self)))
    assert trained() == want and len(used) == 2 and max(used) <= 5


def brute_ngrams(chunks, most, least):
    found = Counter()
    for tokens, n in chunks:
        for size in range(2, most + 1):
            for i in range(len(tokens) - size + 1):
                found[tuple(tokens[i : i + size])] += n
    return {g: n for g, n in found.items() if n >= least}


def chunks_of(spark, chunks):
    return spark.createDataFrame([([bytearray(t) for t in c], n) for c, n in chunks], "tokens array<binary>, cnt bigint")


@pytest.fixture(scope="module")
def repeated():
    """Chunks with long parts in common, among many that aren't."""
    rng = random.Random(8)
    words = [w.encode() for w in words_of(rng, 40, "abcdé")]
    long = [rng.choice(words) for _ in range(34)]
    return [(rng.choices(words, k=rng.randint(1, 12)) + long[: rng.randint(0, 34)], rng.randint(1, 4)) for _ in range(300)] + [([], 3), ([b"a"], 9)]


@pytest.mark.parametrize("least", [1, 15, 200, 10**6])
def test_ngrams_by_levels_are_all_frequent_ones(spark, monkeypatch, repeated, least):
    monkeypatch.setattr(ngrams, "PIECE", 500)
    monkeypatch.setattr(ngrams, "MOST_BITS", 9)  # so few that maps keep too much
    monkeypatch.setattr(ngrams, "FEWEST_BITS", 9)
    found = ngrams.ngram_counts(chunks_of(spark, repeated), 30, least).collect()
    assert {tuple(bytes(t) for t in r.ngram): r.cnt for r in found} == brute_ngrams(repeated, 30, least)
    assert len(found) == len(set(map(str, found))) and all(r.n == len(r.ngram) for r in found)


def test_ngrams_shuffle_follows_the_tokens():
    """Before, the shuffle had a row for each of the 29 lengths at each place."""
    rng = random.Random(9)
    chunks = [[str(rng.random()).encode() for _ in range(200)] for _ in range(20)]
    pieces = list(ngrams.as_pieces([pa.RecordBatch.from_arrays([pa.array(chunks, pa.list_(pa.binary()))], ["tokens"])]))
    rows = [b for b in ngrams._level([], 30)(pieces)]
    assert sum(b.num_rows for b in rows) == 20 * 199 + len(pieces) and rows[-1].to_pylist() == [{"h": None, "cnt": 20 * sum(201 - n for n in range(3, 31))}]


@pytest.mark.parametrize("least", [15, 10**6])
def test_greedy_split_without_the_dictionary_as_objects(spark, repeated, least):
    grams = set(brute_ngrams(repeated, 30, least))
    want = Counter()
    for tokens, n in repeated:
        for part in split_greedily(tokens, grams, prefixes_of(grams)) if grams else [tokens]:
            want[tuple(part)] += n
    df = chunks_of(spark, repeated)
    found = greedy_split(df, ngrams.ngram_counts(df, 30, least)).collect()
    assert {tuple(bytes(t) for t in r.tokens): r.cnt for r in found} == want and len(found) == len(want)
    some = {g for g in grams if len(g) != 3}  # n-grams whose beginnings aren't n-grams
    if some:
        listed = spark.createDataFrame([([bytearray(t) for t in g],) for g in some], "ngram array<binary>")
        want = Counter()
        for tokens, n in repeated:
            for part in split_greedily(tokens, some, prefixes_of(some)):
                want[tuple(part)] += n
        assert {tuple(bytes(t) for t in r.tokens): r.cnt for r in greedy_split(df, listed).collect()} == want


TEXTS = ["the cat sat, on the mat", "", None, "1 2 3", "one 2 two three 4 five", "a b c", "a", "Ünïcode wörds\nand more ", "你好 世界 hello"]


def test_runs_within_documents(spark, monkeypatch):
    """A run ends with its text, also where doc_ids are the same; no shuffle before the tally."""
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").coalesce(1)
    splitter = Splitter(patterns.GPT2)
    key = lambda df: {tuple(bytes(t) for t in r.tokens): r.cnt for r in df.collect()}
    runs = stats.document_runs(docs, splitter)
    assert key(stats.tallied(runs)) == key(stats.eligible_runs(pretokens_exploded(docs, splitter)))
    assert "Exchange" not in runs._jdf.queryExecution().executedPlan().toString()
    some = {" on", " the", "the", " cat", "a", " b", " two", " three"}
    listed = spark.createDataFrame([(t,) for t in some], "pretoken string")
    assert key(stats.tallied(stats.document_runs(docs, splitter, some))) == key(stats.eligible_runs(pretokens_exploded(docs, splitter), listed))
    same = docs.withColumn("doc_id", docs.doc_id * 0)
    assert key(stats.tallied(stats.document_runs(same, splitter))) == key(stats.tallied(runs))


def test_tally_in_python_takes_texts_in_small_parts():
    """Batches of many texts aren't split all at once, and what is counted is handed on."""
    splitter, held = Splitter.gpt4o_style(), []
    splitter.split = lambda text: held.append(text) or text.split(" ")
    batch = pa.RecordBatch.from_arrays([pa.array(["a b a", None, "b c"] * 50)], ["text"])
    rows = [r for b in stats._counted(splitter)([batch]) for r in b.to_pylist()]
    assert Counter({r["pretoken"]: r["cnt"] for r in rows}) == {"a": 100, "b": 100, "c": 50} and len(held) == 100
    assert parts(np.array([3, 3, 3, 9, 0, 1]), 4) == [(0, 2), (2, 3), (3, 4), (4, 6)] and parts(np.zeros(0)) == [] and parts(np.zeros(3)) == [(0, 3)]


def test_python_tally_is_that_of_lists(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    splitter = Splitter.gpt4o_style()
    want = Counter(p for t in TEXTS if t is not None for p in splitter.split(t))
    assert {r.pretoken: r.cnt for r in stats.pretoken_tally(docs, splitter).collect()} == want
    assert [r.p for r in with_pretokens(docs.coalesce(1), splitter, into="p").collect()] == [None if t is None else splitter.split(t) for t in TEXTS]


def test_ratios_read_the_chunks_once(spark):
    chunks = chunks_of(spark, [([b"a", b"a", b"a", b"b"], 2), ([b"b", b"a"], 3), ([b"c"], 1), ([], 4)])
    want = stats.ios_ratios(stats.pair_counts(chunks), stats.token_counts(chunks))
    found = stats.ios_of_chunks(chunks)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    read = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + df._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation")
    assert read(found) == 1 < read(want)
