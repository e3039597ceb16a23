"""Toxicity: a logistic word model, regularised by counterfactual sentences.

Each labelled text is a set of features with damped counts: its words, and the
beginnings of its words, so that inflected forms share what they say.  For every text
that holds an identity term, a copy is made in which each term is swapped for
another term of its group.  Training minimises log loss plus ``pull`` times the
squared change of the score between a text and its copy, so neutral mentions of
a group do not raise a score.

Training uses at most ``sample`` labelled rows, those with the smallest seeded
hash of their id, so the model is the same however the table is split.  Features are
counted and laid out in the executors; the driver gets numbers only.  The model then
scores every whole text.  Texts of equal words score equally.

Defined results: null and empty texts have no features and get the score of the
intercept; rows with a null label or a null id are never learned from; without
any usable label the score is 0.5 everywhere; several labels of one document
count as several rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipule.llm.common import arrow_map, crc_mod, dropped, table, written

# Identity terms, grouped by what may stand for each other.
IDENTITY = (
    ("men", "women", "boys", "girls"),
    ("man", "woman", "boy", "girl"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("american", "mexican", "chinese", "indian", "russian", "french", "german", "spanish"),
    ("old", "young", "elderly"),
    ("disabled", "blind", "deaf"),
    ("immigrant", "immigrants", "refugee", "refugees"),
)
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5)
SAMPLE, MIN_DOCS, PULL, DECAY, ROUNDS, HELD_MOD = 6_000, 5, 1.0, 1.0, 300, 5
#: Standard errors by which a feature's share of label 1 must differ from the overall one.
LEAST_Z = 3.0
#: Words remembered by a task between texts.
MEMO = 200_000


def _swaps() -> dict[str, str]:
    return {term: group[(k + 1) % len(group)] for group in IDENTITY for k, term in enumerate(group)}


def features(word: str) -> tuple[str, ...]:
    """A word and its marked beginnings."""
    return (word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) > n))


class Model(NamedTuple):
    """Feature weights and intercept."""

    weights: dict[str, float]
    intercept: float


class Scorer:
    """Applies a model; remembers which known features a word has."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def score(self, text: str | None) -> float:
        """Probability of label 1."""
        weights, known, hit = self.model.weights, self.known, {}
        if len(known) > MEMO:
            known.clear()
        for w in WORD.findall((text or "").lower()):
            found = known.get(w)
            if found is None:
                found = known[w] = tuple(f for f in features(w) if f in weights)
            for f in found:
                hit[f] = hit.get(f, 0) + 1
        return _sigmoid(self.model.intercept + sum(weights[f] * _damp(n) for f, n in sorted(hit.items())))


def _damp(n: float) -> float:
    return 1.0 + math.log(n) if n > 1 else 1.0


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def counterfactual(words: list[str]) -> list[str] | None:
    """The words with every identity term swapped; None without any."""
    swaps = _swaps()
    turned = [swaps.get(w, w) for w in words]
    return turned if turned != words else None


Row = tuple[list[int], list[float], list[int], list[float]]


def _bags(text: str | None) -> tuple[dict[str, int], dict[str, int] | None]:
    """The features of a text, and those of its copy with swapped identity terms."""
    words = WORD.findall((text or "").lower())
    other = counterfactual(words)
    return _bag(words), None if other is None else _bag(other)


def _counted(seen: dict[str, list[int]], bag: dict[str, int], other: dict[str, int] | None, label: int) -> None:
    for w in bag:
        seen.setdefault(w, [0, 0])[label] += 1
    for w in other or ():
        seen.setdefault(w, [0, 0])


def _swapped_features() -> set[str]:
    return {f for term in _swaps() for f in features(term)}


def _row(bag: dict[str, int], other: dict[str, int] | None, column: dict[str, int]) -> Row:
    """Columns and damped counts of a text, and those in which its copy differs."""
    known = [w for w in bag if w in column]
    gaps = [(column[w], d) for w in sorted({*bag, *other}) if w in column and (d := (_damp(bag[w]) if w in bag else 0.0) - (_damp(other[w]) if w in other else 0.0))] if other is not None else []
    return [column[w] for w in known], [_damp(bag[w]) for w in known], [c for c, _ in gaps], [d for _, d in gaps]


def _constant(n: int, yes: int) -> Model:
    """What is left without any telling feature, or with one label only."""
    share = (yes + 0.5) / (n + 1) if n else 0.5
    return Model({}, math.log(share / (1 - share)))


def _solved(names: list[str], rows: list[Row], labels: list[int], pull: float, decay: float, rounds: int) -> Model:
    gather = lambda k: np.array([v for r in rows for v in r[k]])
    at = lambda k: np.repeat(np.arange(len(rows)), [len(r[k]) for r in rows])
    return _descend(len(rows), names, np.array(labels, float), (at(0), gather(0).astype(int), gather(1)), (at(2), gather(2).astype(int), gather(3)), pull, decay, rounds)


def fit(texts: list[str | None], labels: list[int], *, pull: float = PULL, decay: float = DECAY, rounds: int = ROUNDS, min_docs: int = MIN_DOCS, least_z: float = LEAST_Z) -> Model:
    """Train on labelled texts; ``rounds`` steps over all of them.

    Features in fewer than ``min_docs`` texts get no weight, nor do those whose
    share of label 1 is within ``least_z`` standard errors of the overall share.
    """
    bags = [_bags(t) for t in texts]
    seen: dict[str, list[int]] = {}
    for (bag, other), label in zip(bags, labels, strict=True):
        _counted(seen, bag, other, label)
    share, swaps = sum(labels) / max(len(labels), 1), _swapped_features()
    names = sorted(w for w, (no, yes) in seen.items() if w in swaps or no + yes >= min_docs and _telling(no, yes, share, least_z))
    if not names or len(set(labels)) < 2:
        return _constant(len(labels), sum(labels))
    column = {w: k for k, w in enumerate(names)}
    return _solved(names, [_row(bag, other, column) for bag, other in bags], labels, pull, decay, rounds)


def _telling(no: int, yes: int, share: float, least_z: float) -> bool:
    n = no + yes
    return abs(yes - n * share) >= least_z * math.sqrt(n * share * (1 - share))


def _bag(words: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for w in words:
        for f in features(w):
            out[f] = out.get(f, 0) + 1
    return out


def _descend(n: int, names: list[str], y: np.ndarray, x: tuple, d: tuple, pull: float, decay: float, rounds: int) -> Model:
    """Accelerated gradient descent, preconditioned by each weight's curvature."""
    k = len(names)
    (xr, xc, xv), (dr, dc, dv) = x, d
    dr, dc = dr.astype(int), dc.astype(int)
    w, b = np.zeros(k), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    momentum, ahead, b_ahead = 0.0, w.copy(), b
    width = np.bincount(xr, xv, n)  # bounds each row's share of the joint curvature
    curve = 0.25 * np.bincount(xc, xv * np.maximum(width[xr], 1.0), k) + decay
    if len(dr):
        curve += 2 * pull * 0.25 * np.bincount(dc, np.abs(dv) * np.bincount(dr, np.abs(dv), n)[dr], k)
    b_curve = 0.25 * float(np.sum(1 + width))
    for _ in range(rounds):
        z = b_ahead + np.bincount(xr, xv * ahead[xc], n)
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        pulled = np.zeros(n)
        if len(dr):
            other = 1 / (1 + np.exp(-np.clip(z - np.bincount(dr, dv * ahead[dc], n), -35, 35)))
            gap = p - other
            pulled = 2 * pull * gap
            slope, slope_other = pulled * p * (1 - p), pulled * other * (1 - other)
            # A copy's features are the text's less the difference.
            grad = np.bincount(xc, xv * (p - y + slope - slope_other)[xr], k) + np.bincount(dc, dv * slope_other[dr], k)
            b_grad = float(np.sum(p - y + slope - slope_other))
        else:
            grad, b_grad = np.bincount(xc, xv * (p - y)[xr], k), float(np.sum(p - y))
        step, b_step = ahead - (grad + decay * ahead) / curve, b_ahead - b_grad / b_curve
        after = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        keep = (momentum - 1) / after if momentum > 1 else 0.0
        ahead, b_ahead = step + keep * (step - w), b_step + keep * (b_step - b)
        w, b, momentum = step, b_step, after
    return Model(dict(zip(names, map(float, w), strict=True)), float(b))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, sample: int = SAMPLE, held_mod: int = HELD_MOD) -> Model:
    """Fit on labelled rows whose crc32 of the id, modulo ``held_mod``, is not 0."""
    known = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (crc_mod("_id", held_mod) != 0))
        .orderBy(F.xxhash64(F.lit(17), "_id"), "_id", "_y")
        .limit(sample)
    )
    held = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).join(F.broadcast(known), "_id")
    held = written(held.select("_id", "_y", "_t"), "labelled")
    model = _trained(held)
    dropped(held)
    return model


#: Features that a task counts before it hands them on.
FLUSH = 200_000


def _trained(held: DataFrame) -> Model:
    """The model of labelled rows ``(_id, _y, _t)``, as :func:`fit` makes it, from features built where the texts are.

    Only counts of telling features, and what the rows hold of them, reach the driver.
    """
    total = held.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("yes")).first()
    n, yes = total["n"], int(total["yes"] or 0)
    if yes in (0, n):
        return _constant(n, yes)
    share, swaps = yes / n, _swapped_features()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (0, 1))], names=["f", "no", "yes"])
            seen.clear()
            return out

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _counted(seen, *_bags(text), label)
                if len(seen) > FLUSH:
                    yield flush()
        yield flush()

    sums = arrow_map(held, ["_y", "_t"], count, "f string, no long, yes long").groupBy("f").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    many = F.col("no") + F.col("yes")
    far = F.abs(F.col("yes") - many * share) >= LEAST_Z * F.sqrt(many * share * (1 - share)) - 1e-9
    # Each kept feature is in MIN_DOCS of the sample's rows, or part of an identity term.
    kept = sums.where(F.col("f").isin(*sorted(swaps)) | (many >= MIN_DOCS) & far).collect()
    names = sorted(r["f"] for r in kept if r["f"] in swaps or _telling(r["no"], r["yes"], share, LEAST_Z))
    if not names:
        return _constant(n, yes)
    column = {w: k for k, w in enumerate(names)}

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_row(*_bags(text), column) for text in batch.column(2).to_pylist()]
            kinds = (pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([m[k] for m in made], t) for k, t in enumerate(kinds))], names=["_id", "_y", "a", "b", "c", "d"])

    kind = held.schema["_id"].dataType.simpleString()
    rows = arrow_map(held, ["_id", "_y", "_t"], rows_of, f"_id {kind}, _y int, a array<int>, b array<double>, c array<int>, d array<double>").collect()
    rows.sort(key=lambda r: (r["_id"], r["_y"], r["a"]))
    return _solved(names, [(r["a"], r["b"], r["c"], r["d"]) for r in rows], [r["_y"] for r in rows], PULL, DECAY, ROUNDS)


def scored(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *, held_mod: int = HELD_MOD) -> DataFrame:
    """Score every whole text; ``predicted`` is 1 from a score of 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            scores = [scorer.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    kind = df.schema[id_col].dataType.simpleString()
    held = F.coalesce(crc_mod(id_col, held_mod) == 0, F.lit(False))
    out = arrow_map(df, [id_col, text_col], run, f"`{id_col}` {kind}, score double")
    return out.select(id_col, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
