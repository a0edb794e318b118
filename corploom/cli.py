"""Command line: prepare a corpus, build an index, search it (also line by line from stdin), verify it, token statistics, the rank-frequency law."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corploom import web
from corploom.functions import text as X
from corploom.operators import blocks, corpus, fuzzy, index, search, statistics, synonyms, verify
from corploom.sources import files


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corploom")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("prepare")
    r.add_argument("raw"), r.add_argument("out"), r.add_argument("--no-glue", action="store_true")
    b = sub.add_parser("build")
    b.add_argument("corpus"), b.add_argument("index"), b.add_argument("--tokenizer", default="unicode"), b.add_argument("--stem", action="store_true"), b.add_argument("--sample", type=int, default=0)
    s = sub.add_parser("search")
    s.add_argument("index"), s.add_argument("--query"), s.add_argument("--adjacency", default="last"), s.add_argument("--rank", action="store_true"), s.add_argument("--synonyms")
    v = sub.add_parser("verify")
    v.add_argument("index"), v.add_argument("corpus"), v.add_argument("--top", type=int, default=10), v.add_argument("--stem", action="store_true")
    g = sub.add_parser("suggest")
    g.add_argument("index"), g.add_argument("words", nargs="+"), g.add_argument("--limit", type=int, default=10)
    m = sub.add_parser("measure")
    m.add_argument("index")
    y = sub.add_parser("quality")
    y.add_argument("grades")
    z = sub.add_parser("zipf")
    z.add_argument("index"), z.add_argument("out")
    t = sub.add_parser("stats")
    t.add_argument("corpus"), t.add_argument("--tokenizer", default="unicode"), t.add_argument("--sample", type=int, default=0), t.add_argument("--out")
    w = sub.add_parser("serve")
    w.add_argument("index"), w.add_argument("corpus"), w.add_argument("--port", type=int, default=8000)
    a = p.parse_args(argv)
    spark, began = SparkSession.builder.appName("corploom").getOrCreate(), time.monotonic()
    if a.command == "prepare":
        kept, rejects, stats = corpus.prepare(files.read_raw(spark, a.raw), glue=not a.no_glue)
        files.write_parts(kept, f"{a.out}/corpus")
        files.write_rejects(rejects, f"{a.out}/rejects")
        info = corpus.info_text(stats)
        info.coalesce(1).write.mode("overwrite").text(f"{a.out}/info")
        print(info.first()[0])
        print(f"seconds: {time.monotonic() - began:.1f}")
    elif a.command == "build":
        built = index.build(files.read_parts(spark, a.corpus), a.tokenizer, X.stem if a.stem else None, a.sample, folder=a.index)
        print(built.meta.first().asDict())
    elif a.command == "search":
        ix = index.Index.open(spark, a.index)
        classes = synonyms.close(files.read_pairs(spark, a.synonyms)) if a.synonyms else None
        for q in [a.query] if a.query else filter(None, map(str.strip, sys.stdin)):
            found = search.rank(ix, q, search.PAGE, a.adjacency, classes) if a.rank else search.find(ix, q, a.adjacency, classes).orderBy("docnum").limit(search.PAGE)
            for r in found.collect():
                print(f"{r['docid']}\t{r['title']}" + (f"\t{r['score']:.4f}" if a.rank else ""))
    elif a.command == "suggest":
        asked = spark.createDataFrame([(w,) for w in a.words], "word string")
        for r in fuzzy.suggest_many(asked, index.Index.open(spark, a.index).soft_terms(), limit=a.limit).orderBy("word", "nth").collect():
            print(r["word"], r["term"], r["distance"], r["df"], sep="\t")
    elif a.command == "measure":
        ix = index.Index.open(spark, a.index)
        for table in (index.speed(ix), blocks.density(ix.blocks)):
            for r in table.collect():
                print(r.asDict())
    elif a.command == "quality":
        for r in statistics.ranking_levels(files.read_grades(spark, a.grades)).orderBy("query_id", "level").collect():
            print(r.asDict())
    elif a.command == "verify":
        ix = index.Index.open(spark, a.index)
        texts = ix.forward.select("docnum", "docid").join(files.last_texts(files.read_parts(spark, a.corpus)), "docid", "left")
        for r in verify.verify(ix.vocab, ix.postings, texts, a.top, stemmer=X.stem if a.stem else None).collect():
            print(r.asDict())
    elif a.command == "zipf":
        vocab = index.Index.open(spark, a.index).vocab
        report = statistics.zipf_report(vocab)
        files.write_json_row(report, a.out)
        web.plot_ranks(statistics.rank_frequency(vocab, 20_000), report.first(), f"{a.out}.png")
    elif a.command == "stats":
        docs = index.number(files.read_parts(spark, a.corpus))
        docs = docs.where(F.col("docnum") <= a.sample) if a.sample else docs
        told = statistics.stats_row(docs, mode=a.tokenizer)
        if a.out:
            files.write_json_row(told, f"{a.out}/tokens_stats")
            files.write_lines(statistics.tokenized(docs, a.sample or 200, a.tokenizer).orderBy("docnum").drop("docnum"), f"{a.out}/sample_tokenized")
        row = told.first()
        print({k: row[k] for k in ("docs_processed", "total_tokens", "unique_terms")})
        for r in row["top_terms"]:
            print(r["term"], r["cf"], sep="\t")
    else:
        web.serve(index.Index.open(spark, a.index), files.last_texts(files.read_parts(spark, a.corpus)), a.port)
    return 0


if __name__ == "__main__":
    sys.exit(main())
