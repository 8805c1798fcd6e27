"""Toxicity: gradient-boosted trees over a few dense features of the whole text, calibrated by isotonic regression.

The lexicon (words and word beginnings that toxic texts have far more often) is learned from labelled rows. These fall
into three parts by a hash of their text; the features of each part are taken under the lexicon of the other two, so
neither the trees (parts 0 and 1) nor the calibration (part 2) see densities of a lexicon taken from the same
rows. Documents are scored under the lexicon of all parts.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import free_name, worker_state
from bookflow.settings import stage

#: About so many labelled rows of each class are learned from, chosen by a hash of their id.
SAMPLE = 4000
TREES, DEPTH = 20, 3
LEAST_DOCS, LEAST_SHARE, LEAST_ODDS = 3, 0.02, 3.0   # a lexicon term: toxic texts that have it, log odds
PARTS = (0, 1, 2)
BEGINNINGS = (4, 5, 6, 7, 8)                         # characters
NEAR, SPAN = 5, 50                                   # words
THRESHOLD = 0.7
REMEMBERED = 400_000                                 # distinct tokens a task remembers; then it starts afresh
TERMS = 300_000                                      # distinct terms a task counts before it hands them on

# Second-person words, and characters that stand for letters.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen deiner euch euer ihr sie tu te toi ton "
                          "ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split())
LEET = str.maketrans("013457@$!|€", "oieastasile")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
PLAIN_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
HIT, PERSON, CAPITALS, HIDDEN, HIDDEN_HIT, TERM_BITS = 1, 2, 4, 8, 16, 5

FEATURE_NAMES = ("hits", "terms", "hit_density", "densest", "odds", "person_density", "near_person", "capital_letters",
                 "capital_words", "exclaimed", "questioned", "punctuation", "repeated_marks", "hidden_density",
                 "hidden_hits", "words")


def _terms_of_word(w: str) -> list[str]:
    return [f"={w}", *(f"^{w[:n]}" for n in BEGINNINGS if len(w) > n)]


def terms_of(token: str) -> tuple[list[str], bool]:
    """Terms by which a token may be in the lexicon, and whether it hides letters behind signs or digits."""
    core = token.lower().strip(PLAIN_MARKS)
    if core.isalpha():
        return _terms_of_word(core), False
    core = EDGE.sub("", core)
    if not core:
        return [], False
    plain = core.translate(LEET)
    plain = re.sub(r"[\W_\d]+", "", plain)
    letters = any(map(str.isalpha, core))
    hidden = letters and plain != core and not core.replace("-", "").replace("'", "").replace("’", "").isalpha()
    words = {re.sub(r"[\W_\d]+", "", core), plain} - {""}
    return [x for w in words for x in _terms_of_word(w)], hidden


def _document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, part, n): in how many texts of a class and part a term is; each counted in the task as far as TERMS go.

    No text stands next to its terms: what is held is bounded by TERMS, REMEMBERED and the batch.
    """
    known: dict[str, list[str]] = {}
    counts: Counter = Counter()

    def emit() -> pa.RecordBatch:
        term, toxic, part = zip(*counts, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(toxic, pa.int32()), pa.array(part, pa.int32()),
                                           pa.array(counts.values(), pa.int64())], ["term", "toxic", "part", "n"])
    for b in batches:
        for k, (y, p) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
            own: set[str] = set()
            for token in set(b.column(0)[k].as_py().split()):
                found = known.get(token)
                if found is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    found = known[token] = terms_of(token)[0]
                own.update(found)
            counts.update((x, y, p) for x in own)
            if len(counts) >= TERMS:
                yield emit()
                counts.clear()
    if counts:
        yield emit()


ALL = -1


def lexicons(rows: DataFrame) -> dict[int, dict[str, float]]:
    """Log odds of the terms that tell toxic texts (columns text, toxic, part): for each part those of the other parts, under
    ALL those of all. The terms are counted once; their number is bounded by the least share."""
    n = {(r["part"], r["toxic"]): r["n"] for r in rows.groupBy("part", "toxic").agg(F.count("*").alias("n")).collect()}
    counts = rows.select("text", "toxic", "part").mapInArrow(_document_terms, "term string, toxic int, part int, n bigint").groupBy("term").agg(
        *[F.coalesce(F.sum(F.when((F.col("part") == p) & (F.col("toxic") == y), F.col("n"))), F.lit(0)).alias(f"n{p}{y}") for p in PARTS for y in (0, 1)])
    told = {}
    for out in (ALL, *PARTS):
        parts = [p for p in PARTS if p != out]
        bad, good = (sum(n.get((p, y), 0) for p in parts) for y in (1, 0))
        has, lacks = (sum(F.col(f"n{p}{y}") for p in parts) for y in (1, 0))
        odds = F.log((has + 0.5) / (bad + 1)) - F.log((lacks + 0.5) / (good + 1))
        least = LEAST_ODDS - (0.7 if bad < 100 else 0)
        told[out] = F.when((has >= max(LEAST_DOCS, math.ceil(LEAST_SHARE * bad))) & (odds >= least), odds)
    kept = counts.select("term", *[c.alias(f"o{k}") for k, c in enumerate(told.values())]).where(
        " OR ".join(f"o{k} IS NOT NULL" for k in range(len(told)))).collect()
    return {out: {r["term"]: r[f"o{k}"] for r in kept if r[f"o{k}"] is not None} for k, out in enumerate(told)}


class Codes(dict):
    """Token to its flags and, above them, one more than the number of its term in the lexicon; worked out when first asked for."""

    def __init__(self, terms: dict[str, float]):
        super().__init__()
        self.terms, self.number = terms, {t: k for k, t in enumerate(terms)}
        self.words = {t[1:] for t in terms if t[0] == "="}
        self.heads = {t[1:1 + BEGINNINGS[0]] for t in terms if t[0] == "^"}

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        core = token.strip(PLAIN_MARKS)
        word = core.lower()
        if word.isalpha() and core.isalpha() and word not in self.words and word[:BEGINNINGS[0]] not in self.heads:
            # Nearly all tokens: letters that no term of the lexicon begins like.
            code = PERSON * (word in SECOND_PERSON) | CAPITALS * (len(core) > 1 and core.isupper())
            self[token] = code
            return code
        terms, hidden = terms_of(token)
        best = max((t for t in terms if t in self.terms), key=self.terms.__getitem__, default="")
        core = EDGE.sub("", token)
        code = (HIT * bool(best) | PERSON * (core.lower() in SECOND_PERSON) | HIDDEN * hidden
                | CAPITALS * (len(core) > 1 and core.isupper()) | HIDDEN_HIT * bool(best and hidden))
        code |= (self.number[best] + 1 if best else 0) << TERM_BITS
        self[token] = code
        return code


class Extractor:
    """Feature rows of texts under a lexicon."""

    def __init__(self, terms: dict[str, float]):
        self.codes, self.odds = Codes(terms), np.array([0.0, *terms.values()])
        # Of every character: 1 if a capital, 2 if a punctuation mark.
        self.kinds = np.zeros(0x110000, np.uint8)
        self.kinds[[c for c in range(0x110000) if chr(c).isupper()]] = 1
        self.kinds[[ord(c) for c in PLAIN_MARKS]] = 2

    def row(self, text: str | None) -> list[float]:
        text = text or ""
        tokens = text.split()
        codes = np.fromiter(map(self.codes.__getitem__, tokens), np.int64, len(tokens))
        n, chars = max(1, len(tokens)), max(1, len(text))
        at, person = np.flatnonzero(codes & HIT), np.flatnonzero(codes & PERSON)
        terms = codes[at] >> TERM_BITS
        densest = int((np.searchsorted(at, at + SPAN) - np.arange(len(at))).max(initial=0))
        near = 0.0
        if len(at) and len(person):
            k = np.searchsorted(person, at)
            before = at - person[np.maximum(k - 1, 0)]
            after = person[np.minimum(k, len(person) - 1)] - at
            gap = np.minimum(np.where(k > 0, before, NEAR + 1), np.where(k < len(person), after, NEAR + 1))
            near = float((gap <= NEAR).mean())
        kinds = self.kinds[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        capitals, marks = np.count_nonzero(kinds == 1), np.count_nonzero(kinds == 2)
        share = lambda flag: np.count_nonzero(codes & flag) / n
        return [math.log1p(len(at)), math.log1p(len(np.unique(terms))), len(at) / n, densest / SPAN,
                float(self.odds[terms].max(initial=0.0)) if len(at) else 0.0, len(person) / n, near, capitals / chars,
                share(CAPITALS), text.count("!") / n, text.count("?") / n, marks / chars,
                (text.count("!!") + text.count("??") + text.count("?!")) / n, share(HIDDEN), share(HIDDEN_HIT), math.log1p(len(tokens))]


def features(docs: DataFrame, terms: dict[int, dict[str, float]], text: str, keep: list[str], out: str, part: Column) -> DataFrame:
    """``keep`` and ``out`` (array<double>), each row under the lexicon of its ``part``, in one narrow pass."""
    src, which = free_name(docs, "_text", "_part")
    rows = docs.select(docs[text].alias(src), part.alias(which), *[docs[c] for c in keep])

    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_state("toxicity", dict)        # tokens stay known from task to task
        if name not in known:
            known.clear()
            known[name] = {k: Extractor(t) for k, t in terms.items()}
        extractors = known[name]
        for b in batches:
            x = [extractors[p].row(t.as_py()) for t, p in zip(b.column(0), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(x, pa.list_(pa.float64()))], [*b.schema.names[2:], out])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop(src, which).schema), f"`{out}` array<double>"])
    return rows.mapInArrow(run, schema)


@dataclass
class Model:
    terms: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    prior: float


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Callable[[str], Column], sample: int, doc_id: str,
                    text: str, toxic: str) -> DataFrame:
    """text, toxic (0 or 1) and part (0, 1, 2) of about ``sample`` labelled rows of each class.

    The sampled ids, at most about twice ``sample``, travel to the documents; no text moves.
    """
    known = (labels.where(labels[toxic].isin(0, 1) & labels[doc_id].isNotNull()).where(usable(doc_id))
             .groupBy(labels[doc_id].alias("_id")).agg(F.max(labels[toxic]).cast("int").alias("_toxic")))
    n = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("_toxic") == 1, F.lit(min(1.0, sample / max(1, n.get(1, 0))))).otherwise(
        F.lit(min(1.0, sample / max(1, n.get(0, 0)))))
    # Written, so that the join knows its size.
    taken = stage(known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_003)) < share * 1_000_003), "toxicity-ids")
    rows = docs.select(docs[doc_id].alias("_doc"), docs[text].alias("text")).join(
        taken, F.col("_doc") == F.col("_id")).where("text IS NOT NULL")
    # Exact copies are one case: a copied text must not make a lexicon of its own words.
    return rows.groupBy("text").agg(F.max("_toxic").alias("toxic")).withColumn(
        "part", F.pmod(F.xxhash64(F.lit("part"), "text"), F.lit(5)).cast("int")).withColumn(
        "part", F.when(F.col("part") < 2, 0).when(F.col("part") < 4, 1).otherwise(2))


def fit(docs: DataFrame, labels: DataFrame, usable: Callable[[str], Column], sample: int = SAMPLE,
        doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Learn from the labelled rows whose id is ``usable`` (a function from the id's column name to a condition)."""
    data = stage(labelled_sample(docs, labels, usable, sample, doc_id, text, toxic), "toxicity-sample")
    lexica = lexicons(data)
    terms = lexica[ALL]
    rows = stage(features(data, lexica, "text", ["toxic", "part"], "x", F.col("part")), "toxicity-features").select(
        F.col("toxic").cast("double").alias("label"), "part", array_to_vector("x").alias("features"))
    n = {(r["part"], r["label"]): r["n"] for r in rows.groupBy("part", "label").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    prior = sum(v for (_, y), v in n.items() if y) / total if total else 0.0
    if not all(n.get((0, y), 0) + n.get((1, y), 0) for y in (0.0, 1.0)):
        return Model(terms, None, None, prior)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, minInstancesPerNode=2, seed=1).fit(
        rows.where("part < 2").coalesce(2))
    held = n.get((2, 0.0), 0) and n.get((2, 1.0), 0)
    calibration = None
    if held:
        raw = trees.transform(rows.where("part = 2").coalesce(2)).select(
            vector_to_array("probability")[1].alias("features"), "label")
        calibration = IsotonicRegression(featuresCol="features", labelCol="label").fit(raw)
    return Model(terms, trees, calibration, prior)


def score(docs: DataFrame, model: Model, text: str = "text", score: str = "score", predicted: str = "predicted",
          threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Add a score (0 to 1, higher: toxic likelier) and the prediction (1 from ``threshold`` up, else 0) to every row.

    Null and empty texts are scored like any other: they have no words. If the labelled rows hold one class only, every
    score is its share. ``keep`` names the columns to keep (default: all); of clashing names the new ones
    win. Rows don't depend on each other: repeated rows come out repeated, an empty table stays empty.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (score.lower(), predicted.lower())]
    x, v, raw, p, c, raw_p, y = free_name(docs, "_x", "_features", "_raw", "_probability", "_calibrated", "_one", "_prediction")
    if model.trees is None:
        out = docs.select(*kept).withColumn(score, F.lit(model.prior))
    else:
        rows = features(docs, {ALL: model.terms}, text, kept, x, F.lit(ALL)).withColumn(v, array_to_vector(x)).drop(x)
        trees = model.trees.copy().setFeaturesCol(v).setRawPredictionCol(raw).setProbabilityCol(p).setPredictionCol(y)
        out = trees.transform(rows).withColumn(raw_p, vector_to_array(p)[1]).drop(v, raw, p, y)
        if model.calibration is not None:
            out = model.calibration.copy().setFeaturesCol(raw_p).setPredictionCol(c).transform(out)
            # Where the calibration sample is flat the trees' own order breaks ties, within a thousandth.
            out = out.withColumn(c, F.col(c) * 0.999 + F.col(raw_p) * 0.001)
        else:
            out = out.withColumn(c, F.col(raw_p))
        out = out.withColumn(score, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c)))).drop(raw_p, c)
    return out.withColumn(predicted, (F.col(score) >= threshold).cast("int"))
