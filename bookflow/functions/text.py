"""Column functions over text; all of them but `match_key_all` stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookflow.functions.arrays import let, prefix_lengths
from bookflow.settings import MAX_TAG, MAX_TAGS

# ---- Fixed values --------------------------------------------------------------------------
# Replaced before compatibility normalisation, so "…" becomes three dots and "ﬅ" becomes "st".
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
             "…": "..."}
CHARS_FROM = "‘’“”–—\u00a0"
CHARS_TO = "''\"\"-- "
PAGE_NUMBER = r"^\s*(?:[ivxlcdmIVXLCDM]+|\p{Nd}+)\s*$"
DECORATIVE = r"^[.•·*_=~\-–—\s]{2,}$"
HEADING_PREFIX = r"^\s*(?:chapter|section|part)\s+[\divxlc]+[:.\s-]*"
# ---------------------------------------------------------------------------------------------

# White space as Python's str.strip() and split() know it.  Spelled out: the (?U) form of \s asks
# the Unicode tables for every character.
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
            "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_BREAK = r"\R|[\x1c-\x1e]"
WORD = r"[A-Za-z0-9_\p{L}\p{N}]"
_REPLACED = r"[\xa0\u2013-\u2026\ufb00-\ufb06]"  # a range around all of the above
_NEEDS_NFKC = r"[^\x00-\x7F\u00C0-\u00FF]"   # ASCII and the Latin-1 letters are NFKC-stable


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_unicode(col, nfkc: bool = True) -> Column:
    """Straight quotes, plain dashes, split ligatures, NFKC.

    NFKC is called from the ICU library that Spark ships for its collations, so no row leaves
    the JVM; text in ASCII and Latin-1 letters skips it.  Inside a lambda pass ``nfkc=False``
    (the call counts as nondeterministic there) and normalise the whole column beforehand.
    """
    c = _c(col)
    out = F.translate(c, CHARS_FROM, CHARS_TO)
    for lig, plain in LIGATURES.items():
        out = F.replace(out, F.lit(lig), F.lit(plain))
    ascii_only = F.octet_length(c) == F.length(c)
    out = F.when(~ascii_only & c.rlike(_REPLACED), out).otherwise(c)
    if not nfkc:
        return out
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), out, F.lit(True))
    return F.when(~ascii_only & c.rlike(_NEEDS_NFKC), composed).otherwise(out)


def strip(col) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(_c(col), F.lit(WS_CHARS))


def squash(col) -> Column:
    """White-space runs become one blank; ends are trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(_c(col), F.lit("")), rf"{WS}{{2,}}|(?! ){WS}", " "))


def squeeze_blanks(col) -> Column:
    """Runs of blanks and tabs become one blank (single blanks are left alone)."""
    return F.regexp_replace(_c(col), "[ \t]{2,}|\t", " ")


def dehyphenate(col) -> Column:
    """Rejoin words broken by a hyphen (or soft hyphen) at a line end."""
    c = _c(col)
    broken = F.contains(c, F.lit("-\n")) | F.contains(c, F.lit("\u00ad\n"))
    return F.when(broken, F.regexp_replace(c, f"({WORD})[\u00ad-]\n({WORD})", "$1$2")).otherwise(c)


def slugify(col, n: int = 60, empty: str = "book") -> Column:
    s = F.lower(normalize_unicode(col))
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, n), "-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(empty))


def match_key(col, nfkc: bool = True) -> Column:
    """Comparison key of a title or line: lower-case a-z, 0-9 and single blanks."""
    s = F.lower(normalize_unicode(col, nfkc))
    s = F.regexp_replace(s, HEADING_PREFIX, "")
    s = F.regexp_replace(s, "[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(s, " +", " "))


_PREFIX = re.compile(HEADING_PREFIX, re.ASCII)
_KEPT = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 0x20 for c in range(256))


@F.arrow_udf(T.StringType())
def _keys(texts: pa.Array) -> pa.Array:
    def key(t: str) -> str:
        return " ".join(_PREFIX.sub("", t.lower(), count=1).encode("ascii", "replace").translate(_KEPT).decode().split())
    return pa.array([None if t is None else key(t) for t in texts.to_pylist()], pa.string())


def match_key_all(col) -> Column:
    """``match_key`` of a column of whole texts, in batches; not for lambdas."""
    return _keys(normalize_unicode(col))


def key_head(col, n: int) -> Column:
    """The first ``n`` characters of ``match_key``.

    Of a long text only the start is read, unless its key isn't longer than that: behind a key's n-th character nothing changes it.
    """
    c = _c(col)
    start = match_key(F.substring(c, 1, 16 * n))
    return F.when(F.length(start) > n, F.substring(start, 1, n)).otherwise(F.substring(match_key(c), 1, n))


def word_count(col) -> Column:
    return F.regexp_count(_c(col), F.lit(WORD + "+"))


def token_count(col) -> Column:
    """Number of white-space separated tokens."""
    c = strip(col)
    # Single blanks only (cleaned text): counting them needs no regex matches to be collected.
    odd = F.contains(c, F.lit("  ")) | c.rlike(r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680-\u3000]")
    blanks = F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))
    return F.when(c == "", 0).otherwise(
        1 + F.when(odd, F.regexp_count(c, F.lit(WS + "+"))).otherwise(blanks))


def is_page_number(col) -> Column:
    return _c(col).rlike(PAGE_NUMBER)


def is_decorative(col) -> Column:
    return _c(col).rlike(DECORATIVE)


def fix_letter_spacing(col) -> Column:
    """``T H E`` becomes ``THE``: blanks inside a run of three or more single letters go.

    A blank belongs to such a run when single letters stand on both sides and one more on
    either side; the look-arounds say exactly that, so no callback is needed.
    """
    one = r"\b[^\W\d_]\b"
    return F.regexp_replace(
        _c(col), rf"(?U)(?<={one} {one}) (?={one})|(?<={one}) (?={one} {one})", "")


def truncate(col, n: int) -> Column:
    c = F.coalesce(_c(col), F.lit(""))
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


# ---- escaping -------------------------------------------------------------------------------

def escape_markup(col, kind: str = "xml") -> Column:
    """``vtt`` and ``xml`` escape & < >; ``html`` and ``attr`` escape the double quote as well."""
    c = _c(col)
    for ch, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(ch), F.lit(ent))
    if kind == "html":
        c = F.replace(c, F.lit('"'), F.lit("&quot;"))
    if kind == "attr":
        # A value with double quotes only is put in single quotes; with both, &quot; is used.
        for ch, ent in (("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
            c = F.replace(c, F.lit(ch), F.lit(ent))
        dq, sq = F.contains(c, F.lit('"')), F.contains(c, F.lit("'"))
        c = (F.when(dq & sq, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit("&quot;")), F.lit('"')))
              .when(dq, F.concat(F.lit("'"), c, F.lit("'")))
              .otherwise(F.concat(F.lit('"'), c, F.lit('"'))))
    return c


def yaml_scalar(col) -> Column:
    c = F.coalesce(_c(col), F.lit(""))
    special = (c == "") | c.rlike(r"""^[ \-?]|[:#\[\]{},&*!|>%@`"']""")
    quoted = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(special, F.concat(F.lit('"'), quoted, F.lit('"'))).otherwise(c)


def blockquote(col, marker: str = "> ") -> Column:
    c = F.coalesce(_c(col), F.lit(""))
    return F.concat(F.lit(marker), F.replace(c, F.lit("\n"), F.lit("\n" + marker)))


# ---- tags -----------------------------------------------------------------------------------

def split_tags(col) -> Column:
    return F.split(_c(col), "[,\n]+")


def norm_tags(tags) -> Column:
    """Clean a tag array: no leading '#', at most 40 characters, 20 tags, first spelling wins."""
    cleaned = F.transform(tags, lambda t: F.substring(strip(F.ltrim(strip(t), F.lit("#"))), 1, MAX_TAG))
    kept = F.filter(cleaned, lambda t: t.isNotNull() & (t != ""))
    # The first tags that differ, by hash; only for these is the spelling looked up, so the work is linear in the number of tags.
    both = lambda k: F.struct(k.alias("tag"), F.transform(k, F.lower).alias("low"))
    return let(let(kept, both), lambda v: F.transform(F.slice(F.array_distinct(v["low"]), 1, MAX_TAGS),
                                                      lambda x: F.element_at(v["tag"], F.array_position(v["low"], x).cast("int"))))


def slug_tag(col) -> Column:
    s = F.regexp_replace(strip(F.coalesce(_c(col), F.lit(""))), WS + "+", "-")
    s = F.regexp_replace(s, r"[^0-9A-Za-z_/\-]", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("tag"))


def inline_tags(tags) -> Column:
    some = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t != "")
    return F.array_join(F.transform(some, lambda t: F.concat(F.lit("#"), slug_tag(t))), " ")


# ---- search ---------------------------------------------------------------------------------

def snippet(text, query, before: int = 30, after: int = 50, pos=None) -> Column:
    """The hit with context, ``<mark>``ed and HTML-escaped; ``…`` where text was left out."""
    t, q = _c(text), _c(query)
    idx = (F.position(q, F.lower(t)) if pos is None else pos).cast("int") - 1
    a = F.greatest(F.lit(0), idx - before)
    b = F.least(F.length(t), idx + F.length(q) + after)

    def cut(frm, to):
        return escape_markup(F.substring(t, frm + 1, F.greatest(to - frm, F.lit(0))), "html")

    return F.concat(F.when(a > 0, "…").otherwise(""), cut(a, idx), F.lit("<mark>"),
                    cut(idx, idx + F.length(q)), F.lit("</mark>"), cut(idx + F.length(q), b),
                    F.when(b < F.length(t), "…").otherwise(""))


def occurrences(text, needle) -> Column:
    """0-based positions of all occurrences, overlapping ones included; the needle is not empty."""
    t, q = _c(text), _c(needle)
    quoted = F.concat(F.lit("(?s)(?=\\Q"), F.replace(q, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    # Cut before each of them: the pieces' lengths add up to the positions, however many there are.
    at = let(F.split(t, quoted, -1), prefix_lengths)
    return F.when(F.startswith(t, q), at).when(F.contains(t, q), F.slice(at, F.lit(2), F.size(at))).otherwise(F.array().cast("array<int>"))


# ---- pronunciation --------------------------------------------------------------------------

def compiles(pattern: str) -> bool:
    spark = SparkSession.getActiveSession()
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:
        return False


def compile_rules(rules: Sequence[dict]) -> list[tuple[str, str]]:
    """Turn a (small, user-written) rule list into Java pattern/replacement pairs.

    Rules that do not compile are skipped, as one bad pattern would fail the whole job.
    """
    out = []
    for r in rules:
        frm, to = str(r.get("from") or ""), str(r.get("to") or "")
        if not frm:
            continue
        flags = "(?iu)" if r.get("ignore_case", True) else ""
        if r.get("regex", False):
            try:
                re.compile(frm)
            except re.error:
                continue
            pattern = "(?U)" + flags + frm
            repl = re.sub(r"\\(\d+|g<\d+>)", lambda m: "$" + re.sub(r"\D", "", m.group(1)),
                          to.replace("$", r"\$"))
        else:
            pattern = re.sub(r"([^\w\s])", r"\\\1", frm)
            if r.get("whole_word", True):
                pattern = ((r"(?<!\w)" if re.match(r"\w", frm) else "") + pattern
                           + (r"(?!\w)" if re.search(r"\w\Z", frm) else ""))
            pattern = "(?U)" + flags + pattern
            repl = to.replace("\\", "\\\\").replace("$", r"\$")
        if compiles(pattern):
            out.append((pattern, repl))
    return out


def apply_rules(col, compiled: Sequence[tuple[str, str]]) -> Column:
    c = _c(col)
    for pattern, repl in compiled:
        c = F.regexp_replace(c, pattern, repl)
    return c


# ---- titles, labels, ids --------------------------------------------------------------------

def normalize_all(texts) -> Column:
    """``normalize_unicode`` of every text of an array; all in one call, as NFKC can't be asked for inside a lambda.

    Texts hold no U+0001. Null ones become empty.
    """
    c = _c(texts)
    whole = normalize_unicode(F.array_join(c, "\u0001", ""))
    return F.when(F.size(c) > 0, F.split(whole, "\u0001")).otherwise(F.array().cast("array<string>"))


def title_matches(title, wanted) -> Column:
    """Equal keys, or a wanted key of six or more characters inside the title."""
    keys = F.transform(normalize_all(wanted), lambda w: match_key(w, nfkc=False))
    return let(F.struct(match_key(title).alias("k"), keys.alias("w")), lambda v: (v["k"] != "") & F.exists(
        v["w"], lambda w: (w == v["k"]) | ((F.length(w) >= 6) & F.contains(v["k"], w))))


def norm_words(col) -> Column:
    """Words in the aligner's alphabet (a-z and the apostrophe)."""
    return F.filter(F.split(F.regexp_replace(F.lower(_c(col)), "[^a-z' ]+", " "), " +"),
                    lambda w: w != "")


def normalize_url(col) -> Column:
    """Trim, add a scheme, drop one trailing slash; null when empty (reject those rows)."""
    c = F.nullif(strip(col), F.lit(""))
    c = F.when(c.rlike("^https?://"), c).otherwise(F.concat(F.lit("http://"), c))
    return F.regexp_replace(c, "/$", "")


def chapter_id(ch) -> Column:
    return F.format_string("ch%04d", _c(ch))


def subtitle_stem(book, ch) -> Column:
    return F.format_string("%s-ch%02d", _c(book), _c(ch))


def block_id(ch, si) -> Column:
    return F.format_string("^ch%d-s%d", _c(ch) + 1, _c(si))


def book_title(meta, path) -> Column:
    """Metadata title, else the file name without folder and suffix, '_' as a blank."""
    name = F.regexp_extract(_c(path), "([^/]*)$", 1)
    stem = F.when(name.rlike(r"^\.?[^.]+$"), name).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))
    return F.coalesce(F.nullif(strip(meta), F.lit("")), strip(F.replace(stem, F.lit("_"), F.lit(" "))))


def status_label(status, done, total) -> Column:
    """The strip under a library card; null for ready books, which show listening progress."""
    tmpl = (F.when(_c(status) == "generating", "Generating · %d/%d chapters")
             .when(_c(status) == "partial", "Incomplete · %d/%d · tap to resume")
             .otherwise("Stopped · %d/%d · tap to resume"))
    frac = F.concat(F.coalesce(_c(done), F.lit(0)).cast("string"), F.lit("/"),
                    F.coalesce(_c(total), F.lit(0)).cast("string"))
    return F.when(F.coalesce(_c(status), F.lit("ready")) == "ready", None).otherwise(
        F.replace(tmpl, F.lit("%d/%d"), frac))


def banner_label(status, active, paused, cancelling) -> Column:
    """The generation banner; null when nothing is being or remains to be generated."""
    return (F.when(active & paused, "Paused").when(active & cancelling, "Cancelling")
             .when(active, "Generating")
             .when(_c(status) == "cancelled", "Generation cancelled")
             .when(_c(status) == "partial", "Generation incomplete")
             .when(_c(status) == "generating", "Generation stopped"))


def json_object(col) -> Column:
    """The JSON object inside a reply that may carry a code fence or prose around it."""
    c = strip(col)
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    c = F.when(fenced != "", strip(fenced)).otherwise(c)
    start = F.instr(c, "{")
    c = F.when(start > 0, F.substring(c, start, F.length(c)))
    whole = F.try_parse_json(c)
    outer = F.regexp_extract(c, r"(?s)^(.*\})", 1)
    # Well-formed as is, else up to the last closing brace, else null (no usable profile).
    return F.when(whole.isNotNull(), c).otherwise(
        F.when((outer != "") & F.try_parse_json(outer).isNotNull(), outer))


def content_key(*cols, length: int = 16) -> Column:
    """Short content hash over the fields joined by the unit separator."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *[_c(c) for c in cols]), 256), 1, length)


def source_key(content, model: str = "", version: int = 1) -> Column:
    return F.sha1(F.concat(F.encode(F.lit(f"v{version}:{model}:"), "UTF-8"), _c(content)))
