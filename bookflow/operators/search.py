"""Substring search over chapter titles, topics and sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bookflow.functions.text import snippet, strip
from bookflow.operators.lookup import substring_join

ORDER = ["ch", "kind", "pos"]          # a chapter's title, then its topics, then its sentences


def search_items(chapters: DataFrame, topics: DataFrame, sentences: DataFrame,
                 timed_only: bool = False) -> DataFrame:
    """``(book, ch, kind, pos, time, text)``; kind 0 title, 1 topic, 2 sentence."""
    if timed_only:
        topics = topics.filter("time IS NOT NULL")
    c = chapters.select("book", "ch", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("pos"),
                        F.lit(0.0).alias("time"), F.col("title").alias("text"))
    t = topics.select("book", "ch", F.lit(1).alias("kind"), F.col("pos").cast("long").alias("pos"), "time",
                      F.col("title").alias("text"))
    s = sentences.select("book", "ch", F.lit(2).alias("kind"), F.col("i").cast("long").alias("pos"),
                         F.col("s").alias("time"), F.col("t").alias("text"))
    return c.unionByName(t).unionByName(s)


def search(items: DataFrame, queries: DataFrame, scan_cap: int = 201, keep: int = 60) -> DataFrame:
    """Hits per (query, book): the first ``scan_cap`` in book order, titles and topics first.

    Blank queries match nothing.  ``scan_cap`` and ``keep`` are the feature itself (201 and 60
    on the web, 120 and 60 on the phone); both are group-limited windows, so a task keeps no
    more than the cap per query before the shuffle.
    """
    q = queries.select("q", F.lower(strip("q")).alias("needle")).filter("needle <> ''")
    hits = substring_join(items.withColumn("lc", F.lower("text")), q, "lc", "needle", ["book", *ORDER], carry=["time"])
    in_order = W.partitionBy("q", "book").orderBy(*ORDER)
    hits = hits.withColumn("_n", F.row_number().over(in_order)).filter(F.col("_n") <= scan_cap)
    shown = W.partitionBy("q", "book").orderBy((F.col("kind") == 2), "_n")
    # Only what is shown meets its text again.
    return (hits.withColumn("rank", F.row_number().over(shown)).filter(F.col("rank") <= keep)
            .join(items.select("book", *ORDER, "text"), ["book", *ORDER])
            .select("q", "book", "rank", "ch", "kind", "time", snippet("text", "needle").alias("snippet")))
