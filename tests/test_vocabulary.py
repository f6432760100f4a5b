"""Pretokens, statistics, training, model files and encoding, against golden tables and brute force."""

import random
from collections import Counter
from pathlib import Path

import pytest
import regex
from pyspark.sql import functions as F

from glyphmill import queries as own
from glyphmill.cli import main, parser
from glyphmill.functions import patterns
from glyphmill.functions.codec import INITIAL_BYTES, TO_CHAR, can_supermerge, is_all_digits, printable, unprintable
from glyphmill.functions.pretokenize import Splitter, pretokenize, pretokenize_script_aware, with_pretokens
from glyphmill.operators import stats
from glyphmill.operators.encode import Encoder, SpecialTokenError, decode_bytes_joined, decode_documents, encode_documents
from glyphmill.operators.greedy_split import prefixes_of, split_greedily
from glyphmill.operators.rewrite import blow_up, delete_token, merge_pair
from glyphmill.plans.frame_merge import merge_rounds
from glyphmill.plans.local_merge import MergeEngine, Operations, Vocabulary, blow_up_tokens, chunk_pairs, merge_tokens
from glyphmill.plans.train import train_supers, train_words
from glyphmill.sources import sinks
from glyphmill.sources.corpus import byte_budget, first_documents, read_hex_vocabulary, read_jsonl
from glyphmill.sources.model_file import Model, ModelError, read_model, write_model, write_tables
from glyphmill.streaming.encode_stream import document_stream, encode_to

GOLDEN = [tuple(line.rstrip("\n").split("\t")) for line in (Path(__file__).parent / "golden.txt").open()]
SPLITTERS = {"word_level": Splitter.word_level(), "gpt4o_script": Splitter.gpt4o_style()}


@pytest.mark.parametrize("config,row", GOLDEN)
def test_golden_pretokens(config, row):
    want = row.encode().decode("unicode_escape").split("␟")
    assert SPLITTERS[config].split("".join(want)) == want


@pytest.mark.parametrize("config", SPLITTERS)
def test_long_blanks(config):
    want = {"word_level": [16, 3], "gpt4o_script": [19]}[config]
    assert SPLITTERS[config].split("a" + 20 * " " + "b") == ["a", *(n * " " for n in want), " b"]


def test_splitter_settings():
    for bad in ({"character": patterns.CHARACTER}, {"character_scripts": ("Han",)}):
        with pytest.raises(ValueError):
            Splitter(**bad)
    with pytest.raises(KeyError):
        Splitter(patterns.GPT4O, patterns.CHARACTER, ("Klingon",))
    assert Splitter().split("") == [] and all(regex.compile(p) for p in patterns.CATALOGUE.values())
    assert Splitter().mergeable(b" a") and not Splitter().mergeable(b"12") and not Splitter().mergeable(b"\xff")


def test_backends_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for name in ("gpt2", "gpt4", "gpt4o"):
        splitter = Splitter(patterns.CATALOGUE[name])
        both = with_pretokens(with_pretokens(docs, splitter, backend="native", into="a"), splitter, backend="arrow", into="b")
        assert both.filter("a <> b").count() == 0


def test_codec():
    assert len(INITIAL_BYTES) == 243 and len(set(TO_CHAR.values())) == 256
    assert all(unprintable(printable(bytes([b]))) == bytes([b]) for b in range(256)) and printable(b"A z") == "AĠz"
    with pytest.raises(KeyError):
        unprintable("一")


def singles(text):
    return [bytes([b]) for b in text.encode()]


def test_rewrites(spark):
    tokens = singles("abcab")
    assert merge_tokens(tokens, b"a", b"b") == ([b"ab", b"c", b"ab"], 2)
    assert blow_up_tokens([b"ab", b"c", b"ab"], b"ab", [b"a", b"b"]) == (tokens, 2)
    assert chunk_pairs(tokens) == {(b"a", b"b"): 2, (b"b", b"c"): 1, (b"c", b"a"): 1}
    assert [chunk_pairs([b"a"] * n)[b"a", b"a"] for n in range(6)] == [0, 0, 1, 1, 2, 2]
    rng = random.Random(0)
    rows = [["".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))] for _ in range(60)]
    df = spark.createDataFrame([(r[0], [bytearray(t) for t in singles(r[0])]) for r in rows], "text string, tokens array<binary>")
    made = df.select("text", merge_pair(F.col("tokens"), F.lit(b"a"), F.lit(b"a")).alias("m"), delete_token(F.col("tokens"), F.lit(b"a")).alias("d"))
    made = made.withColumn("u", blow_up(F.col("m"), F.lit(b"aa"), F.array(F.lit(b"a"), F.lit(b"a"))))
    for r in made.collect():
        assert [bytes(t) for t in r.m] == merge_tokens(singles(r.text), b"a", b"a")[0]
        assert [bytes(t) for t in r.u] == singles(r.text) and b"".join(map(bytes, r.d)).decode() == r.text.replace("a", "")
    apart = df.select("text", merge_pair(F.col("tokens"), F.lit(b"a"), F.lit(b"b")).alias("m"))
    assert all([bytes(t) for t in r.m] == merge_tokens(singles(r.text), b"a", b"b")[0] for r in apart.collect())
    pairs = {(bytes(r.left), bytes(r.right)): r.cnt for r in stats.pair_counts(df.select("tokens", F.lit(3).cast("bigint").alias("cnt"))).collect()}
    want = Counter()
    for (text,) in rows:
        for p, n in chunk_pairs(singles(text)).items():
            want[p] += 3 * n
    assert pairs == want


def test_rewrites_are_linear(spark):
    """A pretoken of a megabyte, as base64 or a sequence of letters gives."""
    long = spark.range(1).select(F.expr("transform(sequence(1, 1000000), i -> cast(if(i % 3 = 0, 'a', 'b') as binary))").alias("tokens"), F.lit(1).cast("bigint").alias("cnt"))
    counts = {(bytes(r.left), bytes(r.right)): r.cnt for r in stats.pair_counts(long).collect()}
    assert counts == {(b"b", b"b"): 333_333, (b"b", b"a"): 333_333, (b"a", b"b"): 333_333}
    assert long.select(F.size(merge_pair(F.col("tokens"), F.lit(b"b"), F.lit(b"b"))).alias("n"), F.size(merge_pair(F.col("tokens"), F.lit(b"b"), F.lit(b"a"))).alias("m")).first() == (666_667, 666_667)


def brute_training(chunks, size, tau, blowup):
    held, weights = [list(c) for c, _ in chunks], [n for _, n in chunks]
    ops, vocabulary = Operations(tau, blowup=blowup), Vocabulary.initial()
    while True:
        pairs, alone = Counter(), Counter()
        for c, n in zip(held, weights):
            for p, k in chunk_pairs(c).items():
                pairs[p] += k * n
            for t in c:
                alone[t] += n
        if not pairs:
            return ops, vocabulary
        best = min(pairs, key=lambda p: (-pairs[p], p))
        shares = [(pairs[best] / alone[t], t) for t in best]
        merged = [merge_tokens(c, *best) for c in held]
        held = [c for c, _ in merged]
        ops.merges[ops.next_index()] = (best, pairs[best], int(any(k and len(c) == 1 for c, k in merged)))
        vocabulary.add(best[0] + best[1])
        for share, t in shares:
            if len(t) > 1 and share >= tau:
                parts = ops.parts(t)
                held = [blow_up_tokens(c, t, parts)[0] for c in held]
                ops.deletions[ops.next_index()] = t
                if t in vocabulary:
                    vocabulary.delete(t)
        if all(len(c) < 2 for c in held) or len(vocabulary) >= size:
            return ops, vocabulary


def random_chunks(rng):
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))): rng.randint(1, 9) for _ in range(rng.randint(1, 14))}
    return [(singles(w), n) for w, n in words.items()]


def test_engine_is_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        chunks, tau, blowup, size = random_chunks(rng), rng.choice([0.5, 0.7, 0.9, 1.1]), rng.random() < 0.7, 243 + rng.randint(1, 12)
        engine, ops, vocabulary = MergeEngine(chunks), Operations(tau, blowup=blowup), Vocabulary.initial()
        while True:
            pair, _ = engine.best()
            if pair is None:
                break
            engine.step(pair, ops, vocabulary)
            engine.verify()
            if not engine.pairs or len(vocabulary) >= size:
                break
        want = brute_training(chunks, size, tau, blowup)
        assert (ops.merges, ops.deletions, vocabulary.ids) == (want[0].merges, want[0].deletions, want[1].ids)
        if blowup:  # encoding a training word replays its training
            tool = Encoder(Model(vocabulary, ops, Splitter()))
            assert [tool.replay(b"".join(c)) for c, _ in chunks] == engine.chunks


def test_frame_rounds_are_sequential(spark):
    rng = random.Random(2)
    chunks = [c for c in random_chunks(rng) + random_chunks(rng) if c[0]]
    merged = Counter()
    for c, n in chunks:
        merged[tuple(c)] += n
    engine, want = MergeEngine((list(c), n) for c, n in merged.items()), []
    ops, vocabulary = Operations(), Vocabulary.initial()
    while len(want) < 8 and (pair := engine.best())[0]:
        want.append((*pair[0], pair[1]))
        engine.step(pair[0], ops, vocabulary)
    df = spark.createDataFrame([([bytearray(t) for t in c], n) for c, n in merged.items()], "tokens array<binary>, cnt bigint")
    assert merge_rounds(df, 8, keep_every=1) == want


TEXTS = ["the cat sat on the mat", "the dog sat on the log", "the cat and the dog and the bird", "a bird in the hand is worth two", "the the the"] * 4


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")


@pytest.fixture(scope="module")
def words(docs):
    return train_words(docs, 280, tau=0.9, splitter=Splitter(patterns.GPT2), specials=["<|end|>"], recalc=5)


@pytest.mark.parametrize("supers", [None, 5])
@pytest.mark.parametrize("greedy", [False, True])
def test_second_pass_and_files(docs, words, tmp_path, supers, greedy):
    model = train_supers(docs, words, supers, greedy=greedy, min_count=2, specials=["<|more|>"], recalc=1)
    assert model.kind == ("boundless" if supers is None else "superbpe")
    assert (len(model.vocabulary) == len(words.vocabulary)) if supers is None else (len(model.vocabulary.super_tokens()) <= 5)
    assert list(model.vocabulary.specials) == ["<|end|>", "<|more|>"]
    write_model(model, str(tmp_path / "m"))
    again = read_model(str(tmp_path / "m"))
    assert (again.vocabulary.ids, again.vocabulary.counts, again.vocabulary.specials, again.words, again.supers, again.splitter) == (model.vocabulary.ids, model.vocabulary.counts, model.vocabulary.specials, model.words, model.supers, model.splitter)
    tool = Encoder(again)
    for text in [*TEXTS, "", "unseen wörds 123!", "  two  blanks\n"]:
        ids = tool.encode(text)
        assert tool.decode(ids) == text and ids == tool.encode_ordinary(text, shortcut=False)
    write_tables(docs.sparkSession, model, str(tmp_path / "tables"))
    (tmp_path / "broken").write_text("x v2 word\nvocabulary\n1\n")
    with pytest.raises(ModelError):
        read_model(str(tmp_path / "broken"))


def test_special_tokens(words):
    tool = Encoder(words)
    end = words.vocabulary.specials["<|end|>"]
    assert tool.encode("cat<|end|>dog", "all")[-len(tool.encode("dog")) - 1] == end
    assert end not in tool.encode("cat<|end|>dog", "none") and end in tool.encode("<|end|>", {"<|end|>"})
    with pytest.raises(SpecialTokenError):
        tool.encode("<|end|>")
    with pytest.raises(ModelError):
        tool.decode([10**6])
    assert tool.get_vocab_size() == len(tool.get_vocab()) and tool.token_to_id("a") == 97 and tool.id_to_token(97) == "a"


def test_encoding_frames_and_streams(spark, docs, words, tmp_path):
    tool = Encoder(words)
    rows = docs.unionByName(spark.createDataFrame([(99, None)], docs.schema))
    got = {r.doc_id: r.ids for r in encode_documents(rows, tool).collect()}
    assert got[99] is None and all(got[i] == tool.encode(t) for i, t in enumerate(TEXTS))
    joined = decode_bytes_joined(encode_documents(docs, tool), tool).collect()
    assert {r.doc_id: bytes(r.data).decode() for r in joined} == dict(enumerate(TEXTS))
    odd = spark.createDataFrame([(1, "the cat"), (2, ""), (3, None), (4, "a b"), (4, "a c"), (None, "x")], "doc_id bigint, text string")
    back = [(r.doc_id, r.data and bytes(r.data).decode() or (None if r.data is None else "")) for r in decode_bytes_joined(encode_documents(odd, tool), tool).collect()]
    assert sorted(back, key=str) == sorted([(r.doc_id, r.text) for r in odd.collect()], key=str)
    with pytest.raises(Exception, match="special token"):
        encode_documents(spark.createDataFrame([(1, "a<|end|>b")], "doc_id bigint, text string"), tool).collect()
    with pytest.raises(Exception, match="no token has the id"):
        decode_documents(spark.createDataFrame([(1, [10**6])], "doc_id bigint, ids array<int>"), tool).collect()
    docs.write.parquet(str(tmp_path / "in"))
    encode_to(document_stream(spark, str(tmp_path / "in")), tool, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert {r.doc_id: r.ids for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {i: got[i] for i in range(len(TEXTS))}


def test_decoding_what_was_just_encoded(spark, words, tmp_path):
    """Both in one plan, and from a table that was written in between; rows without a text and empty ones too."""
    tool = Encoder(words)
    odd = spark.createDataFrame([*enumerate(TEXTS), (98, ""), (99, None), (99, "the cat")], "doc_id bigint, text string")
    want = sorted(map(tuple, odd.collect()), key=str)
    encoded = encode_documents(odd, tool).select("doc_id", "ids")
    assert sorted(map(tuple, decode_documents(encoded, tool).select("doc_id", "text").collect()), key=str) == want
    encoded.write.parquet(str(tmp_path / "ids"))
    assert sorted(map(tuple, decode_documents(spark.read.parquet(str(tmp_path / "ids")), tool).select("doc_id", "text").collect()), key=str) == want


def test_sources_and_sinks(spark, docs, words, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"text": "one"}\n{"text": "tw\\u00f6", "x": 1}\n\n{"text": "three"}\n')
    read = read_jsonl(spark, str(tmp_path / "c.jsonl"))
    assert [r.text for r in read.orderBy("doc_id").collect()] == ["one", "twö", "three"]
    assert [r.text for r in first_documents(read, 2).collect()] == ["one", "twö"] and first_documents(read, 9).count() == 3
    assert sorted(r.text for r in byte_budget(read, 4).collect()) == ["one", "twö"] and byte_budget(read, 3).count() == 1
    (tmp_path / "bad.jsonl").write_text('{"txt": "one"}\n')
    with pytest.raises(Exception, match="no text"):
        read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    assert read_jsonl(spark, str(tmp_path / "bad.jsonl"), "drop").count() == 0
    tally = stats.pretoken_tally(docs, Splitter(patterns.GPT2))
    sinks.save_pretokens(tally, str(tmp_path / "p"))
    lines = spark.read.text(str(tmp_path / "p")).collect()
    assert lines[0].value.split("\t")[1] == "Ġthe" and len(lines) == tally.count()
    from glyphmill.sources.model_file import vocabulary_table

    sinks.save_hex_vocabulary(vocabulary_table(spark, words), str(tmp_path / "h"))
    part = next((tmp_path / "h").glob("part*"))
    assert [bytes(r.token) for r in read_hex_vocabulary(spark, str(part)).orderBy("id").collect()] == words.vocabulary.tokens


def test_greedy_split():
    grams = {(b"a", b"b"), (b"a", b"b", b"c"), (b"c", b"d")}
    assert split_greedily(singles("abcdabx"), grams, prefixes_of(grams)) == [singles("abc"), [b"d"], singles("ab"), [b"x"]]


def test_vocabulary():
    v = Vocabulary([b"a", b"b", b"c"])
    v.register_specials(["<s>"])
    v.delete(b"a")
    assert v.ids == {b"b": 0, b"c": 1} and v.add(b"b") == 0 and v.add(b"d", True) == 2 and v.super_tokens() == [b"d"]


def test_queries_and_command_line(spark, sf):
    every = own.queries()
    assert set(own.oracle_sql()) <= set(every)
    assert every["pretoken_tally_gpt2"](spark, sf).count() > 100
    assert parser().parse_args(["train-word", "c", "m", "--vocab-size", "300"]).vocab_size == 300


def test_registered_ngrams_are_as_long_as_the_reference(spark, tmp_path):
    words = [f" w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(32)]
    rows = [(i, "".join(f" w{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(32))) for i in range(15)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    every = own.queries()
    assert {r.n: r.kinds for r in every["ngram_len_hist"](spark, str(tmp_path)).collect()} == {n: 33 - n for n in range(2, 31)}
    assert every["ngram_counts"](spark, str(tmp_path)).filter("n = 30").count() == 3
    pieces = {r.tokens: r.cnt for r in every["greedy_split_runs"](spark, str(tmp_path)).collect()}
    assert pieces == {"␟".join(words[:30]): 15, "␟".join(words[30:]): 15}


def test_small_conveniences():
    assert is_all_digits(b"0123") and is_all_digits(b"") and not is_all_digits(b"1a")
    assert can_supermerge(b" don't_A") and not can_supermerge(b"a1") and not can_supermerge("é".encode())
    assert pretokenize("Hello world") == Splitter().split("Hello world") and pretokenize_script_aware("漢字 a") == Splitter.gpt4o_style().split("漢字 a")


def test_command_line(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("".join('{"text": "%s"}\n' % t for t in TEXTS))
    rows = []
    main(["train-word", str(tmp_path / "c.jsonl"), str(tmp_path / "w.model"), "--vocab-size", "260", "--special", "<|end|>", "--outprefix", str(tmp_path / "p"), "--checkpoint-iterations", "250", "--progress-interval", "5", "--save-pretokens", str(tmp_path / "t")])
    assert {f.name for f in tmp_path.glob("p_*.model")} == {"p_250.model", "p_260.model"} and list((tmp_path / "t").glob("part*"))
    model = train_words(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string"), 260, specials=["<|end|>"], progress_interval=5, report=rows.append)
    assert read_model(str(tmp_path / "w.model")).vocabulary.ids == model.vocabulary.ids and len(rows) == 3
    spark.createDataFrame([(1, "the cat<|end|>")], "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
    main(["encode", str(tmp_path / "w.model"), str(tmp_path / "in"), str(tmp_path / "ids"), "--allowed", "<|end|>"])
    main(["decode", str(tmp_path / "w.model"), str(tmp_path / "ids"), str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).first().text == "the cat<|end|>"
    main(["train-boundless", str(tmp_path / "c.jsonl"), str(tmp_path / "b.model"), "--word-model", str(tmp_path / "w.model"), "--progress-interval", "1"])
    assert len(read_model(str(tmp_path / "b.model")).vocabulary) == 260
