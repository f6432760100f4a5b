"""Command line: train-word, train-boundless, train-super, encode, decode."""

from __future__ import annotations

import argparse
import logging

from .functions.patterns import CATALOGUE, CHARACTER, CHARACTER_GPT4O, CHARACTER_SCRIPTS
from .functions.pretokenize import Splitter
from .operators.encode import Encoder, decode_documents, encode_documents
from .operators.stats import pretoken_tally
from .plans.train import limited, runs_of, train_supers, train_words
from .session import local_session
from .sources.corpus import read_jsonl
from .sources.model_file import read_model, write_model
from .sources.sinks import save_pretokens, save_runs


def _splitter(args: argparse.Namespace) -> Splitter:
    main = CATALOGUE.get(args.pattern, args.pattern)
    if not args.script_aware:
        return Splitter(main)
    return Splitter(main, CHARACTER_GPT4O if args.pattern == "gpt4o" else CHARACTER, CHARACTER_SCRIPTS)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="glyphmill", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("train-word", "train-boundless", "train-super"):
        p = commands.add_parser(name)
        p.add_argument("corpus", help="JSON lines with a text each")
        p.add_argument("model", help="file to write")
        p.add_argument("--num-lines", type=int)
        p.add_argument("--max-bytes", type=int, help="stop reading there; by default all is read")
        p.add_argument("--outprefix", help="also write PREFIX_<size>.model, at checkpoints and at the end")
        p.add_argument("--checkpoint-iterations", type=int, default=0, help="a checkpoint whenever the vocabulary's size is a multiple")
        p.add_argument("--progress-interval", type=int, default=0, help="log a row every so many steps")
        p.add_argument("--save-pretokens", metavar="FOLDER", help="dump the tally that is trained on")
        p.add_argument("--recalc", type=int, default=0)
        p.add_argument("--special", action="append", default=[])
        if name == "train-word":
            p.add_argument("--vocab-size", type=int, required=True)
            p.add_argument("--tau", type=float, default=1.1)
            p.add_argument("--pattern", default="gpt4o")
            p.add_argument("--script-aware", action="store_true")
            p.add_argument("--pairs-for-deleted", action="store_true", help="replace a deleted token by the pair that made it")
        else:
            p.add_argument("--word-model", required=True)
            p.add_argument("--greedy-split", action="store_true")
            p.add_argument("--min-count", type=int, default=15)
            p.add_argument("--max-ngram-len", type=int, default=30)
        if name == "train-super":
            p.add_argument("--supers", type=int, required=True)
    for name in ("encode", "decode"):
        p = commands.add_parser(name)
        p.add_argument("model")
        p.add_argument("source", help="Parquet with doc_id and text, or ids")
        p.add_argument("target")
        if name == "encode":
            p.add_argument("--allowed", nargs="*", default=["none_raise"], help="none_raise, none, all, or the special tokens to look for")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = local_session()
    if args.command in ("encode", "decode"):
        rows, encoder = spark.read.parquet(args.source), Encoder.from_file(args.model)
        if args.command == "decode":
            made = decode_documents(rows, encoder)
        else:
            named = args.allowed[0] if len(args.allowed) == 1 and args.allowed[0] in ("none_raise", "none", "all") else set(args.allowed)
            made = encode_documents(rows, encoder, allowed=named)
        made.write.parquet(args.target)
        return
    docs = read_jsonl(spark, args.corpus)
    common = {"num_lines": args.num_lines, "max_bytes": args.max_bytes, "recalc": args.recalc, "specials": args.special}
    common |= {"outprefix": args.outprefix, "checkpoint_iterations": args.checkpoint_iterations, "progress_interval": args.progress_interval}
    if args.progress_interval:
        logging.basicConfig(level=logging.INFO)
    if args.save_pretokens:
        if args.command == "train-word":
            save_pretokens(pretoken_tally(limited(docs, args.num_lines, args.max_bytes), _splitter(args)), args.save_pretokens)
        else:
            save_runs(runs_of(limited(docs, args.num_lines, args.max_bytes), read_model(args.word_model)), args.save_pretokens)
    if args.command == "train-word":
        model = train_words(docs, args.vocab_size, args.tau, _splitter(args), blowup=not args.pairs_for_deleted, **common)
    else:
        supers = args.supers if args.command == "train-super" else None
        model = train_supers(docs, read_model(args.word_model), supers, greedy=args.greedy_split, min_count=args.min_count, max_ngram_len=args.max_ngram_len, **common)
    write_model(model, args.model)


if __name__ == "__main__":
    main()
