"""The crawl's relational part: category walk, resume, and a fetch with retries behind a pluggable client."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

CATEGORY, PAGE = "CATEGORY", "MAIN"


def walk_categories(edges: DataFrame, root: str, max_level: int) -> DataFrame:
    """(title, level) of the pages under root: edges (parent, child, ns).

    A category is entered while its level is below max_level; deeper ones are left
    out.  There is no visited check: a page reached twice comes twice.
    """
    spark = edges.sparkSession
    frontier, pages = spark.createDataFrame([(root,)], "category string"), None
    for level in range(max_level + 1):
        step = edges.join(frontier, edges["parent"] == frontier["category"]).select("child", "ns")
        found = step.where(F.col("ns") == PAGE).select(F.col("child").alias("title"), F.lit(level).alias("level"))
        pages = found if pages is None else pages.unionAll(found)
        frontier = step.where(F.col("ns") == CATEGORY).select(F.col("child").alias("category"))
    return pages


def not_yet(titles: DataFrame, processed: DataFrame, max_pages: int = 0) -> DataFrame:
    """Titles that a run has still to fetch; max_pages 0 is no limit."""
    left = titles.join(processed, "title", "left_anti")
    return left.limit(max_pages) if max_pages else left


def fetch(titles: DataFrame, client: Callable[[], Callable[[str], str]], attempts: int = 3, backoff: float = 1.0) -> DataFrame:
    """titles with text: client() makes a session, which is made anew after a failure; waits grow linearly; '' when all attempts fail."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session = client()
        for pdf in batches:
            texts = []
            for title in pdf["title"]:
                text = ""
                for n in range(1, attempts + 1):
                    try:
                        text = session(title) or ""
                        break
                    except Exception:  # noqa: BLE001  any failure of the client is retried
                        if n < attempts:
                            time.sleep(backoff * n)
                            session = client()
                texts.append(text)
            yield pd.DataFrame({"title": pdf["title"], "text": texts})

    return titles.select("title").mapInPandas(run, "title string, text string")


def counted(fetched: DataFrame, name: str = "crawl") -> tuple[DataFrame, Observation]:
    """fetched, and what will be known once it has run: pages seen, pages without text, bytes of text."""
    seen = Observation(name)
    empty = F.coalesce(F.length("text"), F.lit(0)) == 0
    return fetched.observe(seen, F.count(F.lit(1)).alias("pages"), F.count_if(empty).alias("empty"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes")), seen


def progress(seen: Observation, seconds: float) -> dict[str, float]:
    """What counted tells of a crawl that has run, with pages a second over the caller's clock."""
    told = seen.get
    return {**told, "pages_per_second": told["pages"] / seconds if seconds > 0 else 0.0}


def raw_documents(fetched: DataFrame, source: str) -> DataFrame:
    """Raw document rows of the pages that have text; the id is the SHA-1 of the title."""
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return fetched.where(F.length("text") > 0).select(F.sha1("title").alias("id"), "title", "text", F.lit(source).alias("source"), stamp.alias("retrieved_at"), F.octet_length("text").cast("long").alias("bytes"))
