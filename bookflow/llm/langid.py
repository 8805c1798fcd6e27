"""Hierarchical language identification: the family first, then one-versus-one linear SVMs inside it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import forget_worker_state, free_name
from bookflow.settings import stage

#: About so many distinct labelled texts of each language are learned from, chosen by their hash.
SAMPLE = 800
FEATURES = 2048          # hashed byte n-grams of 1, 2 and 3
CHUNK = 1 << 18          # bytes whose n-grams are counted at once
STEEPNESS = 4.0          # of the curve from an SVM's margin to a score
ROUNDS, PENALTY = 30, 1e-4

# Families of languages by ISO 639-1 code; any other code is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "as bn gu hi mr ne or pa si ur",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "uralic": "et fi hu",
    "semitic": "am ar he mt",
}


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.lower() in codes.split()), lang)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _lower_bytes() -> np.ndarray:
    """Bytes of letters, lower-cased; all other ASCII becomes a space."""
    lut = np.full(256, 0x20, np.uint8)
    lut[0x41:0x5B] = lut[0x61:0x7B] = np.arange(0x61, 0x7B)
    lut[0x80:] = np.arange(0x80, 0x100)
    return lut


def features(texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES numbers for each text: square roots of n-gram shares, of length 1 (0 without letters)."""
    out = np.zeros((len(texts), FEATURES), np.float64)
    lut, pending, size = _lower_bytes(), [], 0

    def count(parts: list[tuple[int, bytes]]) -> None:
        data = lut[np.frombuffer(b"".join(b for _, b in parts), np.uint8)].astype(np.uint32)
        row = np.repeat(np.array([k for k, _ in parts]), [len(b) for _, b in parts])
        gram = np.zeros(len(data), np.uint32)
        for n in range(3):
            end = len(data) - n
            if end <= 0:
                break
            gram = gram[:end] * np.uint32(257) + data[n:] + np.uint32(1)
            # N-grams of one text and not of white space alone.
            real = (row[:end] == row[n:]) & ((data[:end] != 0x20) | (data[n:] != 0x20))
            slot = ((gram * np.uint32(2654435761)) >> np.uint32(32 - 11)).astype(np.int64)
            at = row[:end][real] * FEATURES + slot[real]
            low, high = parts[0][0], parts[-1][0] + 1
            out[low:high] += np.bincount(at - low * FEATURES, minlength=(high - low) * FEATURES).reshape(-1, FEATURES)

    for k, t in enumerate(texts):
        b = (t or "").lower().encode()
        for at in range(0, len(b), CHUNK):      # a long text adds up its parts
            part = b[at:at + CHUNK + (2 if at + CHUNK < len(b) else 0)]
            if size and size + len(part) > CHUNK:
                count(pending)
                pending, size = [], 0
            pending.append((k, part))
            size += len(part)
    if pending:
        count(pending)
    out = np.sqrt(out)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm, norm, 1)


@dataclass
class Model:
    """Languages, and one linear function for each family against the rest and each pair inside a family."""
    langs: list[str]
    family_svm: dict[str, int] = field(default_factory=dict)
    pair_svm: dict[tuple[str, str], int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, FEATURES)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def predict(self, x: np.ndarray) -> tuple[list[str], list[float]]:
        margin = x @ self.weights.T + self.bias
        curve = lambda m: 1 / (1 + np.exp(-STEEPNESS * m))
        groups: dict[str, list[str]] = {}
        for lang in self.langs:
            groups.setdefault(family(lang), []).append(lang)
        names = sorted(groups)
        langs, scores = np.empty(len(x), object), np.ones(len(x))
        if len(names) == 2:                      # one function tells two families apart
            m = margin[:, self.family_svm[names[0]]]
            chosen, scores = np.where(m >= 0, 0, 1), curve(np.abs(m))
        elif len(names) > 2:
            m = margin[:, [self.family_svm[f] for f in names]]
            chosen, scores = m.argmax(1), curve(m.max(1))
        else:
            chosen = np.zeros(len(x), int)
        for f, name in enumerate(names):
            own, members = np.flatnonzero(chosen == f), groups[name]
            if len(members) == 1:
                langs[own] = members[0]
                continue
            votes, total = np.zeros((len(own), len(members))), np.zeros((len(own), len(members)))
            least = np.full((len(own), len(members)), np.inf)
            for a, b in combinations(range(len(members)), 2):
                m = margin[own, self.pair_svm[members[a], members[b]]]
                votes[:, a] += m >= 0
                votes[:, b] += m < 0
                total[:, a] += m
                total[:, b] -= m
                least[:, a] = np.minimum(least[:, a], m)
                least[:, b] = np.minimum(least[:, b], -m)
            best = (votes + np.tanh(total) / 4).argmax(1)        # equal votes: the larger sum of margins
            langs[own] = np.array(members, object)[best]
            scores[own] *= curve(least[np.arange(len(own)), best])
        return langs.tolist(), scores.tolist()


def learned_from(docs: DataFrame, text: str, lang: str, labelled: Column, sample: int) -> DataFrame:
    """lang, x: features of about ``sample`` distinct texts of each language, all if it has no more. Copies count once."""
    rows = docs.where(labelled & docs[lang].isNotNull() & docs[text].isNotNull()).select(
        docs[lang].cast("string").alias("lang"), docs[text].alias("text"))
    texts_ = rows.select("lang", F.xxhash64("text").alias("h")).distinct()
    counts = {r["lang"]: r["n"] for r in texts_.groupBy("lang").agg(F.count("*").alias("n")).collect()}   # one row a language
    if not counts:
        return rows.sparkSession.createDataFrame([], "lang string, x array<float>")
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, sample / n))).otherwise(share)
    taken = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < share * 1_000_003).distinct().sortWithinPartitions("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            good = [k for k, t in enumerate(texts) if has_letter(t)]
            x = features([texts[k] for k in good]).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(good, pa.int64())), pa.array(list(x), pa.list_(pa.float32()))], ["lang", "x"])
    return taken.mapInArrow(run, "lang string, x array<float>")


def fit(docs: DataFrame, labelled: Column, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from the rows of ``docs`` for which ``labelled`` is true and text and language aren't null."""
    data = stage(learned_from(docs, text, lang, labelled, sample), "language-sample").select(
        "lang", array_to_vector("x").alias("features"))
    langs = sorted(r["lang"] for r in data.select("lang").distinct().collect())
    model = Model(langs)
    weights, bias = [], []

    def svm(rows: DataFrame, positive: Column) -> int:
        m = LinearSVC(maxIter=ROUNDS, regParam=PENALTY, standardization=False).fit(
            rows.select("features", positive.cast("double").alias("label")).coalesce(4))
        weights.append(m.coefficients.toArray())
        bias.append(m.intercept)
        return len(bias) - 1

    groups: dict[str, list[str]] = {}
    for x in langs:
        groups.setdefault(family(x), []).append(x)
    if len(groups) > 1:
        for name in sorted(groups)[:1] if len(groups) == 2 else sorted(groups):
            model.family_svm[name] = svm(data, F.col("lang").isin(groups[name]))
    for members in groups.values():
        for a, b in combinations(members, 2):
            model.pair_svm[a, b] = svm(data.where(F.col("lang").isin(a, b)), F.col("lang") == a)
    if weights:
        model.weights, model.bias = np.stack(weights), np.array(bias)
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score",
             keep: list[str] | None = None) -> DataFrame:
    """Add the predicted language and a score (0 to 1) to every row, from its whole text alone.

    A text that is null or has no letter is ``und`` with score 0, as is any text if no language was learned. The score is
    the product of a logistic curve over the margins of the family's and of the narrowest deciding pair's
    SVM. ``keep`` names the columns to keep (default: all); of clashing names the new ones win. Rows don't
    depend on each other: repeated rows come out repeated, an empty table stays empty.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (lang_pred.lower(), score.lower())]
    src = free_name(docs, "_text")[0]
    rows = docs.select(docs[text].alias(src), *[docs[c] for c in kept])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop(src).schema),
                        f"`{lang_pred}` string, `{score}` double"])
    return rows.mapInArrow(_identify_batches(model, lang_pred, score), schema)


def _identify_batches(model: Model, lang_pred: str, score: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_worker_state()
        for b in batches:
            texts = b.column(0).to_pylist()
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            good = [k for k, t in enumerate(texts) if has_letter(t)] if model.langs else []
            if good:
                for k, x, s in zip(good, *model.predict(features([texts[k] for k in good])), strict=True):
                    langs[k], scores[k] = x, float(s)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             [*b.schema.names[1:], lang_pred, score])
    return run
