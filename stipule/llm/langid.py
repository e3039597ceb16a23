"""Language identification by a small byte convolutional network.

Filters of widths 2, 3 and 4 slide over the UTF-8 bytes of a fixed-length
window; the largest response of each filter feeds a softmax over languages.  A
filter of width w is w tables of 256 rows, one for each place.  For applying
the network, neighbouring tables are summed into one table over byte pairs, so a
response costs one or two look-ups.  The windows of a text tile it whole; its
logits are the mean of theirs, weighted by their bytes.

The network is trained in numpy with Adam on at most ``per_language`` texts of
each language, fewer where there are so many languages that they would exceed
``SAMPLE`` texts in all, picked by a seeded hash of the id.  Every language is
learned.  From each text it learns ``DRAWN`` windows at seeded places anywhere in
the whole text; prediction reads whole texts.

One more class stands for what is in no language: windows with their bytes
shuffled, with one or two characters only, or of random letters, as many as a
language has, and at least ``LEAST_NONE``.  It has no part in a prediction or its score; :func:`accepted` rejects
texts for which it outweighs every language, if they have ``ENOUGH`` bytes: in a
shorter one a single number or key may outweigh the words around it.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
without any labelled text everything is ``und``; the languages ``und`` and the empty
one name none and are not learned; more languages than ``SAMPLE`` are
an error, as each needs a text; rows with a null language or id
are never learned from; repeated rows give repeated results; other columns are
ignored, or kept where a filter returns whole rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipule.llm.common import arrow_map, crc_mod, small_batches, table, text_bytes

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 8, 128
PER_LANGUAGE, SAMPLE, DRAWN, HELD_MOD, HELD = 1200, 240_000, 2, 4, 2
#: Small samples are gone over until ``STEPS`` steps are made.
EPOCHS, STEPS, BATCH, RATE, SEED = 6, 300, 128, 0.01, 11
#: Windows looked up together: the responses of one width take 4 MB.
AT_ONCE = 1024
UNKNOWN, ENOUGH, LEAST_NONE = "und", 2 * WINDOW, 300


class Network(NamedTuple):
    """Filter tables by width (width, 256, filters), softmax weights and languages; the last column is no language."""

    tables: tuple[np.ndarray, ...]
    dense: np.ndarray
    bias: np.ndarray
    languages: tuple[str, ...]


def windows(data: bytes) -> np.ndarray:
    """The bytes of a text as rows of ``WINDOW``; the last is filled with zeros."""
    flat = np.frombuffer(data, np.uint8)
    return np.pad(flat, (0, -len(flat) % WINDOW)).reshape(-1, WINDOW)


def responses(net: Network, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Largest response of every filter in every window, and where it occurs."""
    tops, places = [], []
    for tab in net.tables:
        w = len(tab)
        out = sum(tab[o][rows[:, o : rows.shape[1] - w + 1 + o]] for o in range(w))
        at = out.argmax(axis=1)
        tops.append(np.take_along_axis(out, at[:, None, :], 1)[:, 0])
        places.append(at)
    return np.concatenate(tops, axis=1), places


def train(texts: list[bytes], names: list[str], *, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Fit the network on windows of labelled text."""
    languages = tuple(sorted(set(names)))
    label_of = {n: k for k, n in enumerate(languages)}
    rng = np.random.default_rng(seed)
    parts = [windows(t) for t in texts]
    rows = np.concatenate([*parts, np.zeros((0, WINDOW), np.uint8)])
    label = np.repeat([label_of[n] for n in names], [len(p) for p in parts]).astype(int)
    none = _no_language(rows, max(LEAST_NONE, -(-len(rows) // max(len(languages), 1))), rng)
    rows, label = np.concatenate([rows, none]), np.concatenate([label, np.full(len(none), len(languages))])
    tables = tuple(rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS)
    net = Network(tables, rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages) + 1)).astype(np.float32), np.zeros(len(languages) + 1, np.float32), languages)
    params = [*net.tables, net.dense, net.bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(max(epochs, -(-STEPS * BATCH // max(len(rows), BATCH)))):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            step += 1
            grads = _gradient(net, rows[order[k : k + BATCH]], label[order[k : k + BATCH]])
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    if len(none):  # as if it had as many windows as a language
        net.bias[-1] -= np.log(len(none) * len(languages) / max(len(rows) - len(none), 1))
    return net


def _no_language(rows: np.ndarray, many: int, rng: np.random.Generator) -> np.ndarray:
    """Windows without language: shuffled ones, runs of one or two characters, random letters."""
    out = rows[rng.integers(0, len(rows), many)].copy() if len(rows) else rows.copy()
    for k, row in enumerate(out):
        n = int((row > 0).sum())
        if k % 3 == 0:
            rng.shuffle(row[:n])
        elif k % 3 == 1:
            row[:n] = rng.choice(rng.integers(33, 127, 2), n)
        else:
            row[:n] = rng.integers(97, 123, n) - 32 * (k % 2)
    return out


def _gradient(net: Network, rows: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    top, places = responses(net, rows)
    held = np.maximum(top, 0)
    share = _softmax(held @ net.dense + net.bias)
    share[np.arange(len(rows)), label] -= 1
    share /= len(rows)
    back = (share @ net.dense.T) * (top > 0)
    grads = []
    for i, (tab, at) in enumerate(zip(net.tables, places, strict=True)):
        grad, own = np.zeros_like(tab), back[:, i * FILTERS : (i + 1) * FILTERS]
        for o in range(len(tab)):
            np.add.at(grad[o], (np.take_along_axis(rows, at + o, 1), np.arange(FILTERS)[None, :]), own)
        grads.append(grad)
    return [*grads, held.T @ share, share.sum(axis=0)]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Applied:
    """A trained network with its tables folded over byte pairs."""

    def __init__(self, net: Network) -> None:
        self.net = net
        pair = lambda a, b: np.ascontiguousarray((a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS))
        two, three, four = net.tables
        self.two, self.three, self.last = pair(*two), pair(three[0], three[1]), np.ascontiguousarray(three[2])
        self.four, self.five = pair(four[0], four[1]), pair(four[2], four[3])

    def logits(self, rows: np.ndarray) -> np.ndarray:
        """Logits of each window."""
        out = []
        for k in range(0, len(rows), AT_ONCE):
            b = rows[k : k + AT_ONCE]
            pair = b[:, :-1].astype(np.intp) << 8
            pair |= b[:, 1:]
            three = self.three.take(pair[:, :-1], 0)
            three += self.last.take(b[:, 2:], 0)
            four = self.four.take(pair[:, :-2], 0)
            four += self.five.take(pair[:, 2:], 0)
            tops = [_largest(x) for x in (self.two.take(pair, 0), three, four)]
            out.append(np.maximum(np.concatenate(tops, axis=1), 0) @ self.net.dense + self.net.bias)
        return np.concatenate(out)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each whole text."""
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language and score of each whole text, and whether it is in a language at all."""
        langs, scores, fine = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
        asked = [k for k, t in enumerate(texts) if t and self.net.languages and any(map(str.isalpha, t))]
        group: list[int] = []
        size = 0
        for k in asked:
            group.append(k)
            size += len(texts[k])
            if size > AT_ONCE * WINDOW:
                self._group(texts, group, langs, scores, fine)
                group, size = [], 0
        if group:
            self._group(texts, group, langs, scores, fine)
        return langs, scores, fine

    def _group(self, texts: list, group: list[int], langs: list[str], scores: list[float], fine: list[bool]) -> None:
        data = [text_bytes(texts[k]) for k in group]
        parts = [windows(d) for d in data]
        weight = np.concatenate([np.minimum(len(d) - WINDOW * np.arange(len(p)), WINDOW) for d, p in zip(data, parts, strict=True)])
        starts = np.cumsum([0, *(len(p) for p in parts[:-1])])
        sums = np.add.reduceat(self.logits(np.concatenate(parts)) * weight[:, None], starts)
        mean = sums / np.array([len(d) for d in data])[:, None]
        none, mean = mean[:, -1], mean[:, :-1]
        share = _softmax(mean)
        told = (mean.max(axis=1) >= none) | (np.array([len(d) for d in data]) < ENOUGH)
        for k, best, top, ok in zip(group, share.argmax(axis=1), share.max(axis=1), told, strict=True):
            langs[k], scores[k], fine[k] = self.net.languages[best], float(min(1.0, top)), bool(ok)


def _largest(x: np.ndarray) -> np.ndarray:
    """Maximum over the middle axis by halving, which keeps long contiguous runs."""
    while (n := x.shape[1]) > 1:
        half = (n + 1) // 2
        x = np.maximum(x[:, :half], x[:, n - half :])
    return x[:, 0]


def _sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> tuple[int, DataFrame]:
    """How many texts a language may give, and a seeded sample of those that are not held out, somewhat larger.

    One pass counts the languages; the next keeps rows by a hash threshold set
    for each language, so no language's rows are gathered or ranked.
    """
    usable = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(lang_col).cast("string").alias("_l")).where(
        F.col("_t").isNotNull() & ~F.col("_l").isin("", UNKNOWN) & (crc_mod("_id", HELD_MOD) != HELD)
    )
    counts = usable.groupBy("_l").count().limit(SAMPLE + 1).collect()  # a row for each language
    if len(counts) > SAMPLE:
        raise ValueError(f"{lang_col} has more than {SAMPLE} values")
    most = min(per_language, SAMPLE // max(len(counts), 1))
    shares = [(r["_l"], min(1.0, 1.2 * most / r["count"])) for r in counts]
    place = F.pmod(F.xxhash64(F.lit(SEED), "_id"), F.lit(1 << 30)) / float(1 << 30)
    small = F.broadcast(docs.sparkSession.createDataFrame(shares, "_l string, _share double"))  # at most SAMPLE rows
    return most, usable.withColumn("_p", place).join(small, "_l").where(F.col("_p") < F.col("_share")).drop("_share")


def _drawn(data: bytes) -> list[bytes]:
    """Windows at places that the text itself seeds."""
    last = max(len(data) - WINDOW, 0)
    places = sorted({xxhash.xxh3_64_intdigest(data, seed=SEED + k) % (last + 1) for k in range(DRAWN)})
    return [data[p : p + WINDOW] for p in places] if data else []


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, per_language: int = PER_LANGUAGE) -> Network:
    """Train on a bounded, seeded sample of rows that are not held out."""
    most, sampled = _sampled(docs, id_col, text_col, lang_col, per_language)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_drawn(text_bytes(t.as_py())) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(parts, pa.list_(pa.binary()))], names=["_p", "_id", "_l", "_s"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = arrow_map(sampled, ["_p", "_id", "_l", "_t"], draw, f"_p double, _id {kind}, _l string, _s array<binary>").collect()  # at most about 1.2 * SAMPLE * DRAWN windows
    texts, names, had = [], [], {}
    for r in sorted(rows, key=lambda r: (r["_p"], r["_id"], r["_l"], r["_s"])):
        had[r["_l"]] = had.get(r["_l"], 0) + 1
        if had[r["_l"]] <= most:
            texts += r["_s"]
            names += [r["_l"]] * len(r["_s"])
    return train([bytes(t) for t in texts], names) if names else Network((), np.zeros((0, 0)), np.zeros(0), ())


def predicted(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language and score of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net_at = Applied(net) if net.languages else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, scores = net_at.predict(texts) if net_at else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    held = F.coalesce(crc_mod(id_col, HELD_MOD) == HELD, F.lit(False))
    out = arrow_map(df, [id_col, text_col], run, f"`{id_col}` {kind}, lang_pred string, score double")
    return out.select(id_col, held.alias("held_out"), "lang_pred", "score")


def accepted(df: DataFrame, net: Network, text_col: str = "text", *, lang_col: str | None = None) -> DataFrame:
    """The rows whose text has letters and, as the network sees it, a language.

    Where ``lang_col`` is null, empty or ``und`` it takes the language predicted;
    nothing else changes.
    """
    small_batches(df.sparkSession)
    at = df.columns.index(text_col)
    to = df.columns.index(lang_col) if lang_col in df.columns and df.schema[lang_col].dataType.simpleString() == "string" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net_at = Applied(net) if net.languages else None
        for batch in batches:
            if net_at is None:
                yield batch.slice(0, 0)
                continue
            langs, _, fine = net_at.judge(batch.column(at).to_pylist())
            if to is not None:
                told = [x if held in (None, "", UNKNOWN) else held for held, x in zip(batch.column(to).to_pylist(), langs, strict=True)]
                batch = pa.RecordBatch.from_arrays([*batch.columns[:to], pa.array(told, batch.column(to).type), *batch.columns[to + 1 :]], schema=batch.schema)
            yield batch.filter(pa.array(fine, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return predicted(docs, fit(docs))
