"""Library scan: nested book manifests in, flat tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookflow.functions.text import strip
from bookflow.sources import listing

TOPIC = "struct<title:string,level:int,time:double>"
SENTENCE = "struct<i:int,t:string,s:double,e:double,cs:int,ce:int,p:int>"
CHAPTER = (f"struct<id:string,index:int,title:string,level:int,page:int,status:string,error:string,"
           f"audio:string,duration:double,start_global:double,topics:array<{TOPIC}>,"
           f"sentences:array<{SENTENCE}>>")
MANIFEST = (f"id string, title string, author string, source_pdf string, created string, engine string, "
            f"voice string, lang string, speed double, device string, sample_rate int, "
            f"audio_format string, toc_source string, structure_source string, n_pages int, "
            f"timing_version int, pronunciation_rules int, status string, chapters_total int, "
            f"chapters_ready int, total_duration double, chapters array<{CHAPTER}>")


def manifest_schema(summary: bool = False) -> T.StructType:
    """With ``summary`` chapters hold their status only: sentences and topics are passed over, not decoded."""
    fields = MANIFEST.replace(CHAPTER, "struct<status:string>") if summary else MANIFEST
    return T.StructType.fromDDL(fields + ", _corrupt_record string")


def read_manifests(spark: SparkSession, path: str, summary: bool = False) -> DataFrame:
    """All ``*/manifest.json`` below ``path``; files that do not parse are skipped.

    ``dir`` is the book's folder; id and title default to it.
    """
    files = listing.whole_texts(listing.listed(spark, f"{path.rstrip('/')}/*/manifest.json"))
    # A file may hold several manifests in a list.
    each = F.when(strip("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    return parse_manifests(files.select("dir", F.explode(each).alias("value")), "value", "dir", summary)


def parse_manifests(df: DataFrame, doc: str, name: str, summary: bool = False) -> DataFrame:
    """Manifests held as JSON strings in a table (``name`` stands for the folder)."""
    j = F.from_json(doc, manifest_schema(summary), {"mode": "PERMISSIVE",
                                             "columnNameOfCorruptRecord": "_corrupt_record"})
    d = df.select(F.col(name).cast("string").alias("dir"), j.alias("m"))
    return with_defaults(d.filter("m IS NOT NULL AND m._corrupt_record IS NULL").select(
        "dir", "m.*").drop("_corrupt_record"))


def with_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({"id": F.coalesce("id", "dir"), "title": F.coalesce("title", "dir")})


def is_ready(status) -> Column:
    """A chapter without a status is ready (older manifests)."""
    c = F.col(status) if isinstance(status, str) else status
    return F.coalesce(c, F.lit("ready")) == "ready"


def manifest_chapters(df: DataFrame) -> DataFrame:
    c = df.select(F.col("id").alias("book"), F.posexplode("chapters").alias("ch", "c"))
    return c.select("book", "ch", F.coalesce("c.id", F.format_string("ch%04d", "ch")).alias("chapter_id"),
                    "c.title", "c.level", "c.page", F.coalesce("c.status", F.lit("ready")).alias("status"),
                    "c.audio", F.coalesce("c.duration", F.lit(0.0)).alias("duration"), "c.start_global")


def manifest_topics(df: DataFrame) -> DataFrame:
    c = df.select(F.col("id").alias("book"), F.posexplode("chapters").alias("ch", "c"))
    t = c.select("book", "ch", F.posexplode("c.topics").alias("pos", "t"))
    return t.select("book", "ch", "pos", "t.title", F.coalesce("t.level", F.lit(2)).alias("level"), "t.time")


def manifest_sentences(df: DataFrame) -> DataFrame:
    c = df.select(F.col("id").alias("book"), F.posexplode("chapters").alias("ch", "c"))
    s = c.select("book", "ch", F.posexplode("c.sentences").alias("pos", "s"))
    return s.select("book", "ch", F.coalesce("s.i", "pos").alias("i"), "s.t", "s.s", "s.e", "s.cs", "s.ce",
                    F.coalesce("s.p", F.lit(0)).alias("p"))
