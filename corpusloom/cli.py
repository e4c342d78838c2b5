"""Command line: version, embed, search, contextualize, info, convert, merge.

Models are named as ``module:object`` (an encoder, reranker or generator); without one, the hashing encoder
stands in, so that every command runs without a model.
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dates import with_parsed_dates
from .operators import bm25, chunking, embed, generate, merge, packing
from .plans.request import SearchRequest, search
from .session import local_session
from .sources import files

VERSION = "0.1.0"
DIM = 256


def _load(name: str | None):
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _encoder(args) -> embed.Model:
    return embed.model_of(args.model, encode=_load(args.encoder)) if args.encoder else embed.model_of("hashing", dim=DIM, encode=embed.HashingEncoder(DIM))


def _csv(value: str | None) -> list[str]:
    return [v.strip() for v in (value or "").split(",") if v.strip()]


def cmd_version(spark: SparkSession | None, args) -> None:
    print(VERSION)


def cmd_embed(spark: SparkSession, args) -> None:
    rows = files.read_jsonl(spark, args.input, warn=True)
    if args.scales:
        rows = chunking.multiscale_chunk_entries(rows, [int(s) for s in _csv(args.scales)], args.overlap_tokens)
    elif args.chunk:
        rows = chunking.chunk_entries(rows, args.chunk_tokens, args.overlap_tokens)
    rows = rows.drop("idx") if args.scales or args.chunk else rows
    model = _encoder(args)
    cache = os.path.join(os.path.dirname(args.output), f".corpusloom_cache_{os.path.splitext(os.path.basename(args.input))[0]}")
    got = embed.embed_entries(rows, model, cache, args.force)
    write = files.write_json_index if args.format == "json" else files.write_index
    meta = write(got, args.output, {"embedding_model": model.name})
    if args.format != "json":
        bm25.build(files.read_index(spark, args.output)).write(f"{args.output}/text")
    print(json.dumps(meta, ensure_ascii=False))


def _text_index(spark: SparkSession, path: str, rows: DataFrame) -> bm25.TextIndex:
    """The postings that were written with a split index; those of a JSON index are made anew."""
    return bm25.build(rows) if path.endswith((".json", ".jsonl")) else bm25.TextIndex.read(spark, f"{path}/text")


def _answer(spark: SparkSession, rows: DataFrame, args, query: str) -> list[dict]:
    vector = tuple(float(x) for x in _encoder(args).encode([query])[0])
    rerank = generate.rerank(_load(args.reranker)) if args.rerank and args.reranker else None
    request = SearchRequest(query, vector, top_k=args.top, sources=frozenset(_csv(args.sources)), hybrid=args.hybrid, freshness_weight=args.fresh, as_of=datetime.now(), reranker=rerank)
    got = search(rows, request, _text_index(spark, args.index, rows) if args.hybrid else None).orderBy("pos")
    return [json.loads(r.j) for r in got.select(F.to_json(F.struct(*got.columns)).alias("j")).collect()]


def shown(results: list[dict], detailed: bool = False) -> str:
    """Results for reading: rank, source, title, similarity, date, id, and on request the text."""
    lines = []
    for place, row in enumerate(results, 1):
        name = (row.get("source") or "unknown").upper()
        scores = f"Sim: {row['similarity']:.3f}"
        if (again := row.get("rerank_score")) is not None:
            scores += f"  Reranked: {again:.3f}"
        lines += [f"{place}. [{name}] {row.get('title') or row['id']}  {scores}", f"   {row.get('date') or ''}  {row['id']}"]
        if detailed and row.get("text"):
            lines.append("   " + row["text"])
    return "\n".join(lines)


def cmd_search(spark: SparkSession, args) -> None:
    rows = files.read_any(spark, args.index)
    if args.cag:
        stats = packing.corpus_stats(rows).first()
        print(f"{stats.entries} entries, about {stats.tokens} tokens", file=sys.stderr)
        got = generate.answer_corpus(rows, args.query, _load(args.generator), set(_csv(args.sources)) or None, model=args.cag_model or os.environ.get("CORPUS_ANSWER_MODEL", ""))
        print(json.dumps(got, ensure_ascii=False))
        return
    rows = with_parsed_dates(rows).cache()
    if args.query:
        results = _answer(spark, rows, args, args.query)
        print(json.dumps(results, ensure_ascii=False) if args.json else shown(results, args.detailed))
    while args.interactive and (line := sys.stdin.readline()):
        line = line.strip()
        if line == "!quit":
            break
        if not line:
            continue
        if line.startswith("!"):
            name, _, value = line[1:].partition(" ")
            if name in ("hybrid", "rerank", "detailed"):
                setattr(args, name, not getattr(args, name))
            elif name == "top":
                args.top = int(value)
            elif name == "fresh":
                args.fresh = float(value or 0.3)
            elif name == "sources":
                args.sources = value
            else:
                print("!sources !top !hybrid !rerank !fresh !detailed !quit")
            continue
        print(shown(_answer(spark, rows, args, line), args.detailed))


def cmd_contextualize(spark: SparkSession, args) -> None:
    rows = files.read_jsonl(spark, args.input)
    print(files.write_jsonl(generate.contextualize(rows, _load(args.generator), args.model, args.concurrency), args.output))


def cmd_info(spark: SparkSession, args) -> None:
    for key, value in files.read_metadata(spark, args.index).items():
        if key != "sources":
            print(f"{key}: {value}")
    for r in files.source_counts(files.read_any(spark, args.index)).orderBy(F.desc("entries"), "source").collect():
        print(f"  {r.source}: {r.entries}")
    for r in files.disk_size(spark, args.index).collect():
        print(f"  {r.name}: {r.bytes} bytes")


def cmd_convert(spark: SparkSession, args) -> None:
    to_json = args.to == "json" if args.to else not args.input.endswith(".json")
    print(json.dumps((files.split_to_json if to_json else files.json_to_split)(spark, args.input, args.output)))


def cmd_merge(spark: SparkSession, args) -> None:
    inputs = [files.read_any(spark, p) for p in args.inputs]
    meta, warned = merge.merged_metadata([files.read_metadata(spark, p) for p in args.inputs], [os.path.basename(p) for p in args.inputs])
    for w in warned:
        print(w, file=sys.stderr)
    meta["input_sources"] = {r.source: r.entries for r in merge.merged_source_counts(inputs).collect()}
    order = merge.merge(inputs).drop("idx", "input_no")
    print(json.dumps(files.write_json_index(order, args.output, meta) if args.output.endswith(".json") else files.write_index(order, args.output, meta)))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusloom", description="Embed, index and search text corpora on Spark.")
    sub = top.add_subparsers(dest="command")
    sub.add_parser("version").set_defaults(run=cmd_version)
    p = sub.add_parser("embed")
    p.add_argument("input")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--chunk", action="store_true")
    p.add_argument("--chunk-tokens", type=int, default=500)
    p.add_argument("--overlap-tokens", type=int, default=50)
    p.add_argument("--scales")
    p.add_argument("--force", action="store_true")
    p.add_argument("--format", choices=("split", "json"), default="split")
    p.set_defaults(run=cmd_embed)
    s = sub.add_parser("search")
    s.add_argument("index")
    s.add_argument("query", nargs="?")
    s.add_argument("-k", "--top", type=int, default=10)
    s.add_argument("-s", "--sources")
    s.add_argument("--hybrid", action="store_true")
    s.add_argument("--rerank", action="store_true")
    s.add_argument("--reranker")
    s.add_argument("--fresh", type=float, default=0.0)
    s.add_argument("--interactive", action="store_true")
    s.add_argument("--detailed", action="store_true")
    s.add_argument("--json", action="store_true")
    s.add_argument("--cag", action="store_true")
    s.add_argument("--cag-model")
    s.set_defaults(run=cmd_search)
    c = sub.add_parser("contextualize")
    c.add_argument("input")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--concurrency", type=int, default=10)
    c.set_defaults(run=cmd_contextualize)
    for q in (p, s, c):
        q.add_argument("--model", default="Alibaba-NLP/gte-modernbert-base")
        q.add_argument("--encoder", help="module:object, texts -> vectors")
        q.add_argument("--generator", help="module:object, prompt -> text")
    i = sub.add_parser("info")
    i.add_argument("index")
    i.set_defaults(run=cmd_info)
    v = sub.add_parser("convert")
    v.add_argument("input")
    v.add_argument("output")
    v.add_argument("--to", choices=("split", "json"))
    v.set_defaults(run=cmd_convert)
    m = sub.add_parser("merge")
    m.add_argument("inputs", nargs="+")
    m.add_argument("-o", "--output", required=True)
    m.set_defaults(run=cmd_merge)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    if not args.command:
        top.print_help()
        return 0
    args.run(None if args.command == "version" else spark or local_session(), args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
