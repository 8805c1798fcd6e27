"""Structure profiles: tolerant JSON replies in, typed rows with defaults out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.functions.text import json_object

CLEANING = ("struct<drop_line_patterns:array<string>,drop_substrings:array<string>,fix_letter_spacing:boolean,"
            "drop_decorative:boolean,strip_page_numbers:boolean,header_zone_max_y:int,footer_zone_min_y:int>")
LABELS = "struct<patterns:array<string>,strip_repeated_title:boolean>"
SKIP = "struct<titles:array<string>,page_ranges:array<array<int>>>"
STRUCTURE = "struct<toc:string,markers:array<struct<level:int,title:string,page:int>>,heading_pattern:string>"
PROFILE = f"struct<cleaning:{CLEANING},heading_labels:{LABELS},skip_sections:{SKIP},structure:{STRUCTURE}>"


def parse_profiles(df: DataFrame, book: str, reply: str) -> DataFrame:
    """``profiles(book, cleaning, heading_labels, skip_sections, structure, usable)``.

    A reply without a JSON object is not usable: its book keeps the default heuristics.  A
    missing ``toc`` mode means the embedded table of contents is trusted.
    """
    d = df.select(F.col(book).alias("book"), json_object(reply).alias("_j"))
    d = d.select("book", F.col("_j").isNotNull().alias("usable"), F.from_json("_j", PROFILE).alias("p"))
    toc = F.coalesce("p.structure.toc", F.lit("trust"))
    return d.select("book", "p.cleaning", "p.heading_labels", "p.skip_sections", F.struct(
        toc.alias("toc"), F.col("p.structure.markers").alias("markers"),
        F.col("p.structure.heading_pattern").alias("heading_pattern")).alias("structure"), "usable")


def profile_json(profiles: DataFrame) -> DataFrame:
    """The profile as one JSON document per book."""
    return profiles.select("book", F.to_json(F.struct(
        F.lit(1).alias("version"), "cleaning", "heading_labels", "skip_sections", "structure")).alias("doc"))
