"""Paragraphs and sentences with exact character offsets."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookflow.functions.arrays import let, prefix_lengths
from bookflow.functions.text import _c
from bookflow.operators import scan
from bookflow.settings import CHUNK_CHARS

# Both patterns tile the text: what lies between two paragraphs (line feeds) or sentences
# (stray end marks) is the head of the following piece, so piece lengths add up to offsets.
PARAGRAPH = r"\n*[^\n]+(?:\n[^\n]+)*"
SENTENCE = r"""[.!?]*[^.!?]+(?:[.!?]+["')\]]*|\z)"""


def _lead(c: Column, pattern: str) -> Column:
    return F.length(F.regexp_extract(c, pattern, 0))


def paragraph_spans(text) -> Column:
    """``array<struct<cs, ce, t>>`` of the paragraphs."""
    def spans(pieces):
        return F.zip_with(pieces, prefix_lengths(pieces), lambda x, pos: let(
            _lead(x, r"^\n*"), lambda n: F.struct(
                (pos + n).alias("cs"), (pos + F.length(x)).alias("ce"),
                F.substring(x, n + 1, F.length(x)).alias("t"))))
    return let(F.regexp_extract_all(_c(text), F.lit(PARAGRAPH), F.lit(0)), spans)


_STARTS, _BODIES = re.compile(PARAGRAPH), re.compile(SENTENCE.replace(r"\z", r"\Z"))
_SPANS = T.ArrayType(T.StructType([T.StructField("cs", T.IntegerType()), T.StructField("ce", T.IntegerType()), T.StructField("t", T.StringType()),
                                   T.StructField("p", T.BooleanType()), T.StructField("first", T.BooleanType())]))


@F.arrow_udf(_SPANS)
def _sentences_of(texts: pa.Array) -> pa.Array:
    """Sentences of a batch of texts: one pass of a pattern over a paragraph instead of expressions for each of its sentences."""
    starts, found, opens, closes, at = [], [], [], [], [0]
    for text in texts.to_pylist():
        for par in _STARTS.finditer(text or ""):
            own, n = par.group().lstrip("\n"), len(found)
            pos = par.end() - len(own)
            for piece in _BODIES.findall(own):
                pos += len(piece)
                # Stray end marks, then white space, then the sentence itself.
                body = (piece.lstrip(".!?") if piece[0] in ".!?" else piece).lstrip()
                if t := body.rstrip():
                    starts.append(pos - len(body))
                    found.append(t)
            if len(found) > n:
                opens.append(n)
                closes.append(len(found) - 1)
        at.append(len(found))
    t, cs = pa.array(found, pa.string()), np.array(starts, dtype=np.int32)
    first, p = np.zeros(len(found), dtype=bool), np.zeros(len(found), dtype=bool)
    first[opens], p[closes] = True, True
    ce = pa.array(cs + pc.utf8_length(t).to_numpy(zero_copy_only=False).astype(np.int32), pa.int32())
    spans = pa.StructArray.from_arrays([pa.array(cs), ce, t, pa.array(p), pa.array(first)], names=["cs", "ce", "t", "p", "first"])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans, mask=texts.is_null())


def sentence_spans(text) -> Column:
    """``array<struct<cs, ce, t, p, first>>``; ``p`` marks the last sentence of a paragraph.

    A paragraph always ends a sentence, so a slice of a page gives the same sentences as the
    whole text, and the last sentence of a slice always closes a paragraph.
    """
    return _sentences_of(_c(text))


def sentences(slices: DataFrame) -> DataFrame:
    """``(book, ch, page, k, t, cs, ce, p, first)``, offsets relative to the chapter.

    ``p`` and ``first`` mark the last and first sentence of a paragraph.
    """
    d = slices.select("book", "ch", "page", "base", sentence_spans("text").alias("_s"))
    d = d.select("book", "ch", "page", "base", F.posexplode("_s").alias("k", "s"))
    return d.select("book", "ch", "page", "k", F.col("s.t").alias("t"),
                    (F.col("base") + F.col("s.cs")).cast("long").alias("cs"),
                    (F.col("base") + F.col("s.ce")).cast("long").alias("ce"),
                    F.col("s.p").alias("p"), F.col("s.first").alias("first"))


def chunk_sentences(sents: DataFrame, budget: int = CHUNK_CHARS) -> DataFrame:
    """Group sentences for continuous synthesis: ``chunk`` closes at a paragraph end or budget.

    A paragraph end resets the fold, so each page is folded on its own.
    """
    item = F.struct("k", F.length("t").alias("n"), "p")
    g = sents.groupBy("book", "ch", "page").agg(F.array_sort(F.collect_list(item)).alias("_x"))
    zero = F.struct(F.lit(0).alias("used"), F.lit(0).alias("id"),
                    F.array().cast("array<int>").alias("out"))

    def step(a, x):
        full = (a["used"] > 0) & (a["used"] + x["n"] > budget)
        cid = a["id"] + F.when(full, 1).otherwise(0)
        used = F.when(full, F.lit(0)).otherwise(a["used"]) + x["n"]
        return F.struct(F.when(x["p"], F.lit(0)).otherwise(used).alias("used"),
                        (cid + F.when(x["p"], 1).otherwise(0)).alias("id"),
                        F.concat(a["out"], F.array(cid)).alias("out"))

    ids = F.aggregate("_x", zero, step)["out"]
    g = g.withColumn("_ids", ids).withColumn("_n", F.element_at("_ids", -1) + 1)
    per_page = scan.prefix_sum(g, ["book", "ch"], ["page"], F.floor(F.col("page") / 1024),
                               _before=F.col("_n").cast("long"))
    return per_page.select("book", "ch", "page", "_before",
                           F.explode(F.arrays_zip(F.col("_x").alias("x"), F.col("_ids").alias("c")))
                           .alias("z")).select(
        "book", "ch", "page", F.col("z.x.k").alias("k"), F.col("z.x.n").alias("n"),
        (F.col("_before") + F.col("z.c")).alias("chunk"))
