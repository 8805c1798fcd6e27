"""Column functions over seconds, dates and progress."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookflow.functions.text import _c, token_count
from bookflow.settings import MIN_SENTENCE_SECONDS, SAMPLE_RATE, WORDS_PER_SECOND


def _seconds(col) -> Column:
    """Null, NaN and negative seconds count as zero."""
    c = _c(col).cast("double")
    return F.when(c.isNull() | F.isnan(c) | (c < 0), F.lit(0.0)).otherwise(c)


def _clock(total: Column) -> Column:
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(
        F.format_string("%d:%02d", m, s))


def fmt_ts(sec, sep: str = ",") -> Column:
    """``HH:MM:SS,mmm`` (half-even rounding to the millisecond)."""
    ms = F.rint(_seconds(sec) * 1000).cast("long")
    return F.format_string(f"%02d:%02d:%02d{sep}%03d", F.floor(ms / 3_600_000),
                           F.floor(ms % 3_600_000 / 60_000), F.floor(ms % 60_000 / 1000), ms % 1000)


def fmt_clock(sec) -> Column:
    """``M:SS`` or ``H:MM:SS``, rounded down."""
    return _clock(F.floor(_seconds(sec)).cast("long"))


def fmt_dur(sec) -> Column:
    """``M:SS`` or ``H:MM:SS``, rounded to the nearest second."""
    return _clock(F.rint(F.coalesce(_c(sec).cast("double"), F.lit(0.0))).cast("long"))


def fmt_hm(sec) -> Column:
    """``1h 53m``, ``45m`` or ``2h``."""
    total = F.floor(F.coalesce(_c(sec).cast("double"), F.lit(0.0)) / 60 + 0.5).cast("long")
    h, m = F.floor(total / 60), total % 60
    return (F.when((h > 0) & (m > 0), F.format_string("%dh %dm", h, m))
             .when(h > 0, F.format_string("%dh", h)).otherwise(F.format_string("%dm", m)))


def pub_date(created, minutes) -> Column:
    """RFC-1123 date of an ISO time stamp plus a number of minutes (session zone UTC)."""
    ts = F.try_to_timestamp(_c(created)) + F.make_interval(mins=_c(minutes))
    return F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def est_samples(text) -> Column:
    """Estimated spoken length in audio samples (an integer, so sums are exact)."""
    return _samples(token_count(text))


def est_samples_all(text) -> Column:
    """``est_samples`` of a column of rows, counted in batches; not for lambdas."""
    return _samples(_tokens(_c(text)))


def _samples(tokens: Column) -> Column:
    secs = F.greatest(F.lit(MIN_SENTENCE_SECONDS), tokens / F.lit(WORDS_PER_SECOND))
    return F.floor(secs * SAMPLE_RATE).cast("long")


@F.arrow_udf(T.IntegerType())
def _tokens(texts: pa.Array) -> pa.Array:
    # A null text has no count; the greatest of it and the shortest length is the latter, as in ``est_samples``.
    return pa.array([None if t is None else len(t.split()) for t in texts.to_pylist()], pa.int32())


def est_duration(text) -> Column:
    return est_samples(text) / F.lit(float(SAMPLE_RATE))


def progress_frac(chapter_start, t, total) -> Column:
    return F.when(_c(total) > 0, F.least(F.lit(1.0), (_c(chapter_start) + _c(t)) / _c(total))
                  ).otherwise(F.lit(0.0))


def _js_round(c: Column) -> Column:
    return F.floor(c + 0.5)


def percent(frac) -> Column:
    """Whole percent, 0 to 100."""
    p = _js_round(F.coalesce(_c(frac), F.lit(0.0)) * 100)
    return F.greatest(F.lit(0), F.least(F.lit(100), p)).cast("int")


def card_percent(frac, status) -> Column:
    """Percent on a card: at least 2, 100 once finished, null without progress."""
    f = _c(frac)
    done = (F.coalesce(_c(status), F.lit("ready")) == "ready") & (f >= 0.999)
    p = F.least(F.lit(100), F.greatest(F.lit(2), _js_round(f * 100)))
    return F.when(f > 0, F.when(done, 100).otherwise(p)).cast("int")


def as_float(col, default: float = 0.0) -> Column:
    v = _c(col).try_cast("double")
    return F.coalesce(F.nanvl(v, F.lit(None).cast("double")), F.lit(default))


def as_int(col, default: int = 0) -> Column:
    return F.coalesce(_c(col).try_cast("int"), F.lit(default))
