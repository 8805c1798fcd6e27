"""HTML pages to paragraph text."""

from __future__ import annotations

import html as _html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookflow.functions.text import _c, normalize_unicode, strip

# ---- Fixed values ----------------------------------------------------------------------------
BLOCK_TAGS = ("p", "div", "section", "article", "blockquote", "li", "ul", "ol", "table", "tr", "td",
              "th", "h1", "h2", "h3", "h4", "h5", "h6", "br", "hr", "figure", "figcaption", "pre",
              "header", "footer")
SKIP_TAGS = ("script", "style", "head", "title", "nav")
# Common entities, decoded without leaving the JVM; the ampersand comes last.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "nbsp": " ", "copy": "©",
            "middot": "·", "ndash": "–", "mdash": "—", "hellip": "…", "lsquo": "‘", "rsquo": "’",
            "ldquo": "“", "rdquo": "”", "amp": "&"}
# ------------------------------------------------------------------------------------------------

_OTHER_ENTITY = rf"&(?!(?:{'|'.join(ENTITIES)});)[A-Za-z#]"


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(_html.unescape, na_action="ignore")


def html_to_text(col, keep_comments: bool = False) -> Column:
    """Paragraphs of a page, separated by an empty line.

    Skipped elements go with their content, every block end tag (and br, hr) ends a line, other
    tags vanish.  Common entities are decoded in the JVM; only pages with others visit Python.
    """
    body = F.regexp_extract(_c(col), r"(?is)<body\b[^>]*>(.*)", 1)
    c = F.when(body != "", body).otherwise(_c(col))
    c = F.regexp_replace(c, r"(?s)<!--(.*?)-->", "$1" if keep_comments else "")
    c = F.regexp_replace(c, rf"(?is)<({'|'.join(SKIP_TAGS)})\b[^>]*>.*?</\1\s*>", "")
    c = F.replace(c, F.lit("\r"), F.lit(""))
    c = F.regexp_replace(c, rf"(?i)</(?:{'|'.join(BLOCK_TAGS)})\s*>|<(?:br|hr)\b[^>]*>", "\n")
    c = F.regexp_replace(c, r"<[/!?A-Za-z][^>]*>", "")
    plain = c
    for name, ch in ENTITIES.items():
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(ch))
    other = F.when(c.rlike(_OTHER_ENTITY), c)
    text = normalize_unicode(F.coalesce(_unescape(other), plain))
    lines = F.transform(F.split(text, "\n"), lambda s: strip(F.regexp_replace(s, "[ \t ]+", " ")))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n\n")
