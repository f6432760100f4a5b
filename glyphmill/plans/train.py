"""Trainers. Scanning, pretokenization and tallies are distributed; the merges that follow are inherently
ordered. Up to LOCAL_CHUNKS distinct chunks go through a loop on the driver; more stay on the executors, and the
driver holds counts only."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..functions.pretokenize import Splitter
from ..operators.encode import Encoder, eligible_pretokens
from ..operators.greedy_split import ngram_split
from ..operators.stats import document_runs, pretoken_tally, tallied
from ..sources.corpus import byte_budget, first_documents
from ..sources.model_file import Model, ModelError, write_model
from .local_merge import MergeEngine, Operations, Vocabulary
from .spread_merge import SpreadEngine

log = logging.getLogger(__name__)
FIRST_SIZE = 243
LOCAL_CHUNKS = 50_000


def limited(docs: DataFrame, num_lines: int | None, max_bytes: int | None) -> DataFrame:
    if num_lines is not None:
        docs = first_documents(docs, num_lines)
    return docs if max_bytes is None else byte_budget(docs, max_bytes)


@contextmanager
def _engine(chunks: DataFrame, most: int | None, alphabet: list[bytes] | None = None) -> Iterator[MergeEngine]:
    """The merge engine of distinct chunks (tokens, cnt). Without an alphabet a chunk starts as its single bytes. More than
    `most` chunks, where that is given, are an error."""
    chunks = chunks.persist(StorageLevel.MEMORY_AND_DISK)
    engine = None
    try:
        sizes = chunks.groupBy(F.floor(4 * F.log2("cnt")).alias("size")).agg(F.count("*").alias("n")).collect()
        total = sum(r.n for r in sizes)
        if most is not None and total > most:
            raise ModelError(f"more than {most} distinct chunks: raise max_chunks or train on a smaller corpus")
        local = total <= LOCAL_CHUNKS
        rows = (chunks.orderBy(F.desc("cnt"), F.desc("tokens")) if local else _frequent(chunks, {r["size"]: r.n for r in sizes}, LOCAL_CHUNKS)).collect()
        each = [([bytes([b]) for t in r.tokens for b in t] if alphabet is None else [bytes(t) for t in r.tokens], r.cnt) for r in rows]
        engine = MergeEngine(each) if local else SpreadEngine(chunks, each, alphabet)
        del rows, each
        chunks.unpersist()
        yield engine
    finally:
        chunks.unpersist()
        if isinstance(engine, SpreadEngine):
            engine.close()


def _frequent(chunks: DataFrame, sizes: dict[int, int], most: int) -> DataFrame:
    """Up to `most` of the most frequent chunks, in whole classes of size as far as they go."""
    taken = 0
    for size in sorted(sizes, reverse=True):
        if taken + sizes[size] > most:
            break
        taken, least = taken + sizes[size], size
    return (chunks.filter(F.floor(4 * F.log2("cnt")) >= least) if taken else chunks).limit(most)


def train_words(
    docs: DataFrame, vocab_size: int, tau: float = 1.1, splitter: Splitter | None = None, blowup: bool = True, num_lines: int | None = None, max_bytes: int | None = None,
    recalc: int = 0, checkpoint_iterations: int = 0, outprefix: str | None = None, specials: list[str] = (), progress_interval: int = 0, max_chunks: int | None = None, report: Callable[[dict], None] | None = None,
) -> Model:
    """First pass: merges within pretokens until vocab_size tokens are alive, with deletions for tau <= 1."""
    if vocab_size < FIRST_SIZE:
        raise ValueError(f"vocab_size must be at least {FIRST_SIZE}")
    splitter = splitter or Splitter()
    tally = pretoken_tally(limited(docs, num_lines, max_bytes), splitter)
    words = tally.filter(F.octet_length("pretoken") > 0).select(F.array(F.col("pretoken").cast("binary")).alias("tokens"), "cnt")
    with _engine(words, max_chunks) as engine:
        return _words(engine, vocab_size, tau, splitter, blowup, recalc, checkpoint_iterations, outprefix, specials, progress_interval, report)


def _words(
    engine: MergeEngine, vocab_size: int, tau: float, splitter: Splitter, blowup: bool, recalc: int, checkpoint_iterations: int, outprefix: str | None, specials: list[str], progress_interval: int, report: Callable[[dict], None] | None
) -> Model:
    if not engine.chunks:
        raise ValueError("the corpus has no pretokens")
    vocabulary, ops = Vocabulary.initial(), Operations(tau, blowup=blowup)
    vocabulary.register_specials(specials)
    model = Model(vocabulary, ops, splitter)
    step = 0
    while True:
        pair, count = engine.best()
        if pair is not None:
            engine.step(pair, ops, vocabulary)
            _renumber(vocabulary)
        if recalc and step and step % recalc == 0:
            engine.verify()
        step += 1
        if progress_interval and step % progress_interval == 0:
            _tell(report, step=step, vocab=len(vocabulary), left=pair and pair[0], right=pair and pair[1], count=count, pairs=len(engine.pairs))
        done = pair is None or not engine.pairs or len(vocabulary) >= vocab_size
        if outprefix and (done or checkpoint_iterations and len(vocabulary) % checkpoint_iterations == 0):
            vocabulary.counts = {t: n for t, n in engine.singles.items() if n and t in vocabulary}
            write_model(model, f"{outprefix}_{len(vocabulary)}.model")
        if done:
            break
    vocabulary.counts = {t: n for t, n in engine.singles.items() if n and t in vocabulary}
    return model


def _renumber(vocabulary: Vocabulary) -> None:
    """Special ids stay behind the tokens while those come and go."""
    for i, text in enumerate(sorted(vocabulary.specials, key=vocabulary.specials.get)):
        vocabulary.specials[text] = len(vocabulary) + i


def _tell(report: Callable[[dict], None] | None, **row) -> None:
    report(row) if report else log.info("%s", row)


def runs_of(docs: DataFrame, word_model: Model, eligible: set[bytes] | None = None) -> DataFrame:
    """(tokens, cnt): runs of pretokens that are one token each and may merge."""
    eligible = eligible_pretokens(Encoder(word_model)) if eligible is None else eligible
    return tallied(document_runs(docs, word_model.splitter, {t.decode() for t in eligible}))


def train_supers(
    docs: DataFrame, word_model: Model, supers: int | None = None, num_lines: int | None = None, max_bytes: int | None = None, greedy: bool = False, min_count: int = 15, max_ngram_len: int = 30,
    recalc: int = 0, specials: list[str] = (), outprefix: str | None = None, checkpoint_iterations: int = 0, max_chunks: int | None = None, progress_interval: int = 0, report: Callable[[dict], None] | None = None,
) -> Model:
    """Second pass: merges across pretokens.

    With `supers` that many are put on top of the whole word vocabulary. Without, they compete by count
    with the recorded word merges, ties going to those, until the vocabulary is as large as before.
    """
    if supers is not None and supers < 1:
        raise ValueError("supers must be at least 1")
    eligible = eligible_pretokens(Encoder(word_model))
    runs = runs_of(limited(docs, num_lines, max_bytes), word_model, eligible)
    if greedy:
        last = max(word_model.words.merges, default=None)
        runs = ngram_split(runs, word_model.words.merges[last][1] if last is not None else 0, min_count, max_ngram_len)
    with _engine(runs, max_chunks, sorted(eligible)) as engine:
        return _supers(engine, word_model, supers, recalc, specials, outprefix, checkpoint_iterations, progress_interval, report)


def _supers(
    engine: MergeEngine, word_model: Model, supers: int | None, recalc: int, specials: list[str], outprefix: str | None, checkpoint_iterations: int, progress_interval: int, report: Callable[[dict], None] | None
) -> Model:
    ops = Operations(1.1, is_super=True, superbpe_mode=supers is not None)
    log_of_words = word_model.words.ordered()
    vocabulary = Vocabulary.initial() if supers is None else word_model.vocabulary.copy()
    target, at, step = len(word_model.vocabulary), 0, 0

    def drained(at: int) -> int:
        while at < len(log_of_words) and log_of_words[at][1] == "delete":
            if log_of_words[at][2] in vocabulary:
                vocabulary.delete(log_of_words[at][2])
            at += 1
        return at

    def finished() -> Model:
        final = vocabulary.copy()
        final.counts = {t: n for t, n in engine.singles.items() if n and t in final}
        kept = [t for t, _ in sorted(word_model.vocabulary.specials.items(), key=lambda x: x[1])]
        final.register_specials([*kept, *specials])
        return Model(final, word_model.words if supers is not None else word_model.words.trimmed(at), word_model.splitter, ops)

    while True:
        pair, count = engine.best()
        if supers is not None:
            if pair is not None:
                engine.step(pair, ops, vocabulary)
        else:
            at = drained(at)
            merge = log_of_words[at] if at < len(log_of_words) else None
            if pair is not None and count > (merge[3] if merge else -1):
                if pair[0] not in vocabulary or pair[1] not in vocabulary:
                    raise ModelError(f"a part of {pair} isn't in the vocabulary yet")
                engine.step(pair, ops, vocabulary)
            elif merge is not None:
                vocabulary.add(merge[2][0] + merge[2][1])
                at = drained(at + 1)
        if recalc and step and step % recalc == 0:
            engine.verify()
        step += 1
        if progress_interval and step % progress_interval == 0:
            _tell(report, step=step, vocab=len(vocabulary), left=pair and pair[0], right=pair and pair[1], count=count, pairs=len(engine.pairs))
        if supers is None and not engine.pairs and step == 1:
            log.warning("no runs to merge: the second pass ends after its first step")
        done = not engine.pairs or (len(vocabulary) - target >= supers if supers is not None else len(vocabulary) >= target)
        if outprefix and (done or checkpoint_iterations and len(vocabulary) % checkpoint_iterations == 0):
            write_model(finished(), f"{outprefix}_{len(vocabulary)}.model")
        if done:
            return finished()
