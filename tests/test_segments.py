"""An index that grows by batches equals one that is built at once."""

import json
import os

from pyspark.sql import functions as F

from corploom.operators import blocks, index, search
from corploom.streaming import ingest, segments

WORDS = "crimson green blue dark-blue kino".split()
QUERIES = ["crimson && !green", '"green blue"', "!crimson", "title:even", '"crimson blue" / 3 || kino']


def text(i):
    return " ".join(WORDS[(i * k) % 5] for k in range(1, 2 + i % 6))


def test_batches_and_merges(spark, tmp_path):
    source, target, checkpoint = tmp_path / "source", str(tmp_path / "target"), str(tmp_path / "checkpoint")
    source.mkdir()
    row = lambda i: json.dumps({"id": f"d{i:03}", "title": "even" if i % 2 == 0 else "odd", "text": text(i)}) + "\n"
    n, held = 0, []
    for files in (3, 2):
        for _ in range(files):
            rows = [row(i) for i in range(n * 4, n * 4 + 4)] + ([row(n)] if n else [])  # and one that an earlier batch had
            (source / f"{n:02}.json").write_text("".join(rows))
            os.utime(source / f"{n:02}.json", (1_700_000_000 + n, 1_700_000_000 + n))
            n += 1
        segments.grow(ingest.raw_stream(spark, str(source), 1), target, checkpoint, tier=2).awaitTermination()
        held.append([(s.first, s.last) for s in segments.live(spark, target)])
    assert held == [[(0, 1), (2, 2)], [(0, 3), (4, 4)]]  # pairs are merged, and pairs of pairs
    grown = segments.open_index(spark, target)
    whole = index.build(spark.createDataFrame([(f"d{i:03}", "even" if i % 2 == 0 else "odd", text(i)) for i in range(n * 4)], "docid string, title string, text string"))
    for q in QUERIES:
        run = lambda ix, q=q: sorted(r["docid"] for r in search.find(ix, q).collect())
        assert run(grown) == run(whole) != [], q
    best = lambda ix: sorted((r["docid"], round(r["score"], 9)) for r in search.rank(ix, "kino green", k=n * 4).collect())
    assert best(grown) == best(whole)
    assert {(r["term"], r["df"]) for r in grown.vocab.collect()} == {(r["term"], r["df"]) for r in whole.vocab.collect()}
    places = lambda ix: sorted((r["docid"], r["term"], r["places"]) for r in blocks.entries(ix.blocks, "places").join(ix.forward.select("docnum", "docid"), "docnum").collect())
    assert places(grown) == places(whole)
    assert grown.forward.agg(F.count_distinct("docnum")).first()[0] == n * 4


def test_a_batch_that_runs_again(spark, tmp_path):
    source, target, checkpoint = tmp_path / "source", str(tmp_path / "target"), tmp_path / "checkpoint"
    source.mkdir()
    (source / "a.json").write_text(json.dumps({"id": "a", "title": "t", "text": "x"}) + "\n" + json.dumps({"id": "", "title": "t", "text": "x"}) + "\n")
    run = lambda: segments.grow(ingest.raw_stream(spark, str(source)), target, str(checkpoint)).awaitTermination()
    run()
    for f in (checkpoint / "commits").glob("*0*"):
        f.unlink()
    run()
    assert [(s.first, s.last) for s in segments.live(spark, target)] == [(0, 0)]
    assert segments.open_index(spark, target).forward.count() == 1
    (source / "b.json").write_text(json.dumps({"id": "a", "title": "t", "text": "again"}) + "\n")
    run()
    assert len(segments.live(spark, target)) == 1  # nothing new, no segment
