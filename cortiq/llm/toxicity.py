"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of several widths, max pooling.

A word's embedding is the sum of its rows in a hashed table: one for the word and one for each of its first letters'
prefixes, so that unseen forms share what their stems have shown. The first column of the table starts as the smoothed
log odds of a feature among the labelled documents, the others small and random; everything is then trained in numpy
by Adam on the logistic loss, where max pooling sends each filter's gradient to one position of a text. A held-back
part of the training rows fits the final slope and offset of the score and a threshold for each language.

Training takes at most TRAIN_ROWS labelled rows (those with the smallest hash of their id) of TRAIN_BYTES bytes together, on
the driver; scoring is one narrow pass over whole texts. Scores depend on the text alone.

Defined results: null and wordless texts get the score of a text in which no filter finds anything; rows that repeat an
id and text score alike; null ids are scored and never held out; labels that are null are not learnt from; of labels
that repeat an id the toxic one counts, and of documents that repeat a labelled id the one with the smallest text hash. Languages
without enough labelled rows use the threshold of all. With labels of one kind only every score is their drawn-in share, 0 without
labels, and no text is at a threshold. Labelled texts longer than TRAIN_TEXT are not learnt from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import mapped, words_of, written

#: At most so many labelled rows, of so many bytes of text together and in one text, are fitted.
TRAIN_ROWS, TRAIN_BYTES, TRAIN_TEXT = 8_000, 48_000_000, 3_000_000
PREFIXES = (3, 5, 7)
BUCKETS, DIM, WIDTHS, FILTERS = 2**17, 8, (1, 2, 3), 6
EPOCHS, LEAST_STEPS, BATCH, RATE = 6, 60, 128, 0.03
#: Words of a worker's cache of projections.
CACHE_ROWS = 150_000
HELD_OUT_FOLD, FOLDS = 2, 4


def features(word: bytes) -> list[int]:
    """Buckets of a word and its prefixes, by letters; 0 is no feature."""
    letters = word.decode("utf-8", "surrogatepass")
    keys = [b"w" + word] + [b"p%d" % n + letters[:n].encode("utf-8", "surrogatepass") for n in PREFIXES if len(letters) > n]
    found = [1 + zlib.crc32(k) % (BUCKETS - 1) for k in keys]
    return found + [0] * (1 + len(PREFIXES) - len(found))


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]  # for each width (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def project(self, feats: np.ndarray) -> np.ndarray:
        """What each place of each filter gets from a word: (words, places * FILTERS)."""
        e = self.table[feats].sum(axis=1)
        return np.concatenate([e @ w[j] for w in self.filters for j in range(len(w))], axis=1)

    def pooled(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The largest value of each filter in each text; rows are the projections of all words, every text non-empty."""
        out, at = [], 0
        for w, b in zip(self.filters, self.bias, strict=True):
            n = len(w)
            # Places beyond the end of a text add nothing, so a text shorter than the filter still has a value.
            total = rows[:, at * FILTERS : (at + 1) * FILTERS].copy()
            ends = np.append(starts[1:], len(rows))
            for j in range(1, n):
                moved = rows[j:, (at + j) * FILTERS : (at + j + 1) * FILTERS].copy()
                for back in range(j):
                    past = ends - j + back
                    moved[past[(past >= np.maximum(starts, 0)) & (past < len(moved))]] = 0
                total[: len(moved)] += moved
            out.append(np.maximum(np.maximum.reduceat(total, starts, axis=0) + b, 0))
            at += n
        return np.concatenate(out, axis=1)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.out + self.offset

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -30, 30)))


class Adam:
    def __init__(self, like: np.ndarray, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros_like(like), np.zeros_like(like), 0, rate

    def step(self, x: np.ndarray, g: np.ndarray, rows: np.ndarray | None = None) -> None:
        self.t += 1
        at = slice(None) if rows is None else rows
        self.m[at] = 0.9 * self.m[at] + 0.1 * g
        self.v[at] = 0.99 * self.v[at] + 0.01 * g * g
        x[at] -= self.rate * self.m[at] / (1 - 0.9**self.t) / (np.sqrt(self.v[at] / (1 - 0.99**self.t)) + 1e-6)


def fit(texts: Iterable[list[bytes]], labels: np.ndarray, langs: list[str], seed: int = 7) -> Model:
    """Train on lists of words; texts without words are left out."""
    rng = np.random.default_rng(seed)
    vocabulary: dict[bytes, int] = {}
    coded = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in t), np.int32, len(t)) for t in texts]
    keep = [i for i, c in enumerate(coded) if len(c)]
    coded, labels, langs = [coded[i] for i in keep], np.asarray(labels, float)[keep], [langs[i] for i in keep]
    feats = np.fromiter((b for w in vocabulary for b in features(w)), np.int32, len(vocabulary) * (1 + len(PREFIXES))).reshape(-1, 1 + len(PREFIXES))
    vocabulary.clear()
    model = Model(
        rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32),
        [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.2, FILTERS * len(WIDTHS)).astype(np.float32),
        0.0,
    )
    model.table[0] = 0
    if not len(labels) or labels.min() == labels.max():
        # Labels of one kind, or none, are no evidence against any text: the score is their share, no text is told as toxic.
        rate = max(labels.sum() / (len(labels) + 2), 1e-12)
        model.out[:] = 0
        model.offset = float(np.log(rate / (1 - rate)))
        model.thresholds[""] = float("inf")
        return model
    held = rng.random(len(coded)) < 0.2
    fitted, tried = np.flatnonzero(~held), np.flatnonzero(held)
    if labels[fitted].min() == labels[fitted].max() or labels[tried].sum() < 30:
        fitted = tried = np.arange(len(coded))
    # The first column: how much more documents with the feature are labelled than those without.
    seen = np.zeros((2, BUCKETS))
    for i in fitted:
        seen[int(labels[i]), np.unique(feats[np.unique(coded[i])])] += 1
    n1, n0 = labels[fitted].sum(), (1 - labels[fitted]).sum()
    odds = np.log((seen[1] + 0.1) / (n1 + 1)) - np.log((seen[0] + 0.5 + 0.02 * n0 / max(n1, 1)) / (n0 + 1))
    model.table[:, 0] = np.where(seen.sum(axis=0) >= 2, np.clip(odds, -1, 4), 0)
    model.table[0] = 0
    for w, b in zip(model.filters, model.bias, strict=True):
        w[:, 0, :] = 0.4 / len(w) + rng.normal(0, 0.05, w[:, 0, :].shape)
        b -= np.float32(0.3)
    model.out[:] = np.abs(model.out) + 0.2
    model.offset = -1.0
    params = [Adam(model.table, RATE / 10)] + [Adam(w, RATE) for w in model.filters] + [Adam(b, RATE) for b in model.bias] + [Adam(model.out, RATE), Adam(np.zeros(1), RATE)]
    offset = np.array([model.offset])
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(fitted)))):
        order = rng.permutation(fitted)
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            _train_step(model, params, offset, [coded[i] for i in some], feats, labels[some])
    model.offset = float(offset[0])
    logits = np.concatenate([score_words(model, [coded[i] for i in tried[k : k + BATCH]], feats) for k in range(0, len(tried), BATCH)])
    y = labels[tried]
    a, b = 1.0, 0.0
    for _ in range(100):  # slope and offset of the score by Newton's method
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        g = np.array([((p - y) * logits).sum() + 3 * (a - 1), (p - y).sum() + 0.3 * b])
        h = p * (1 - p)
        hess = np.array([[(h * logits**2).sum() + 3, (h * logits).sum()], [(h * logits).sum(), h.sum() + 0.3]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    if np.isfinite(a) and a > 0.05:
        model.slope, model.shift = float(a), float(b)
    p = model.probability(logits)
    names = np.array(langs, object)[tried]
    for lang in ["", *sorted({x for x in names if x})]:
        mine = np.ones(len(y), bool) if lang == "" else names == lang
        if mine.sum() >= 20 and y[mine].sum() >= 3:
            cuts = np.unique(p[mine])
            f1 = [2 * ((p[mine] >= c) & (y[mine] == 1)).sum() / ((p[mine] >= c).sum() + y[mine].sum()) for c in cuts]
            model.thresholds[lang] = float(cuts[int(np.argmax(f1))])
    return model


def score_words(model: Model, coded: list[np.ndarray], feats: np.ndarray) -> np.ndarray:
    used, inverse = np.unique(np.concatenate(coded), return_inverse=True)
    rows = model.project(feats[used])[inverse]
    return model.logits(model.pooled(rows, np.cumsum([0] + [len(c) for c in coded[:-1]])))


def _train_step(model: Model, params: list[Adam], offset: np.ndarray, coded: list[np.ndarray], feats: np.ndarray, y: np.ndarray) -> None:
    used, inverse = np.unique(np.concatenate(coded), return_inverse=True)
    e = model.table[feats[used]].sum(axis=1)
    bounds = np.cumsum([0] + [len(c) for c in coded])
    pooled, where = [], []
    for w, b in zip(model.filters, model.bias, strict=True):
        parts = [(e @ w[j])[inverse] for j in range(len(w))]
        values, places = np.zeros((len(coded), FILTERS), np.float32), np.zeros((len(coded), FILTERS), np.int64)
        for d in range(len(coded)):
            s, t = bounds[d], bounds[d + 1]
            total = parts[0][s:t].copy()
            for j in range(1, len(w)):
                total[: t - s - j] += parts[j][s + j : t]
            places[d] = s + total.argmax(axis=0)
            values[d] = total[places[d] - s, np.arange(FILTERS)]
        pooled.append(np.maximum(values + b, 0))
        where.append(places)
    h = np.concatenate(pooled, axis=1)
    p = 1 / (1 + np.exp(-np.clip(h @ model.out + offset[0], -30, 30)))
    g = ((p - y) / len(y)).astype(np.float32)
    dh = g[:, None] * model.out * (h > 0)
    de = np.zeros_like(e)
    ends = bounds[1:, None]
    for i, (w, b, places) in enumerate(zip(model.filters, model.bias, where, strict=True)):
        d = dh[:, i * FILTERS : (i + 1) * FILTERS]
        dw = np.zeros_like(w)
        for j in range(len(w)):
            at = places + j
            inside = at < ends
            ids = inverse[np.minimum(at, len(inverse) - 1)]
            dj = np.where(inside, d, 0)
            dw[j] = np.einsum("bfe,bf->ef", e[ids], dj)
            np.add.at(de, ids.ravel(), (dj[:, :, None] * w[j].T[None]).reshape(-1, DIM))
        params[1 + i].step(w, dw + 1e-4 * w)
        params[1 + len(WIDTHS) + i].step(b, d.sum(axis=0))
    params[-2].step(model.out, h.T @ g + 1e-3 * model.out)
    params[-1].step(offset, g.sum(keepdims=True))
    touched = np.flatnonzero(np.abs(de).sum(axis=1))
    if len(touched):
        rows = feats[used[touched]]
        grad = np.zeros((rows.max() + 1, DIM), np.float32)
        np.add.at(grad, rows.ravel(), np.repeat(de[touched], rows.shape[1], axis=0))
        some = np.unique(rows)
        some = some[some > 0]
        params[0].step(model.table, grad[some], some)


class Scorer:
    """Scores of texts; keeps the projections of words in a bounded cache."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.rows = np.zeros((CACHE_ROWS, sum(WIDTHS) * FILTERS), np.float32)

    def logit(self, text: str | None) -> float:
        words = words_of(text)
        m = self.model
        if not words:
            return float(m.logits(np.concatenate([np.maximum(b, 0) for b in m.bias])[None])[0])
        low = None
        # A text of any length in pieces of 50,000 words that overlap by the widest filter; the maximum joins them.
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000 + max(WIDTHS) - 1]
            got = m.pooled(self.projected(part), np.zeros(1, np.int64))[0]
            low = got if low is None else np.maximum(low, got)
        return float(m.logits(low[None])[0])

    def projected(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        missing = list(set(words).difference(known))
        if missing:
            if len(known) + len(missing) > CACHE_ROWS:
                known.clear()
                missing = list(set(words))
            at = len(known)
            self.rows[at : at + len(missing)] = self.model.project(np.array([features(w) for w in missing]))
            known.update(zip(missing, range(at, at + len(missing)), strict=True))
        return self.rows[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]


def training_rows(docs: DataFrame, labels: DataFrame, held_out: bool = True) -> pd.DataFrame:
    """At most TRAIN_ROWS labelled texts of TRAIN_BYTES bytes: (doc_id, text, lang, toxic), leaving out the fold that is held out."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    fold = F.crc32(F.col("label_id").cast("string")) % FOLDS
    if held_out:
        known = known.where(fold != HELD_OUT_FOLD)
    # A limit on a sort by hash: every task keeps TRAIN_ROWS rows at most before the driver merges them.
    some = known.groupBy("label_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("label_id"), "label_id").limit(TRAIN_ROWS)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.xxhash64(text).alias("order"), text.alias("text"), F.col("lang").cast("string").alias("lang")).alias("row"))
    # One row for each id, by partial aggregation, before anything leaves the tasks; then whole texts up to the bound of bytes.
    found = rows.join(F.broadcast(some), F.col("doc_id") == F.col("label_id")).groupBy("doc_id", "toxic").agg(F.min("row").alias("row")).select("doc_id", "toxic", "row.text", "row.lang")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    found = written(docs.sparkSession, found.withColumn("size", size).where(F.col("size") <= TRAIN_TEXT), "labelled-texts")
    # Lengths alone are added up in one task, of TRAIN_ROWS rows at most; texts follow for the rows within the bound.
    upto = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    within = found.select("doc_id", "size").withColumn("upto", upto).where(F.col("upto") <= TRAIN_BYTES).select("doc_id")
    rows = found.join(F.broadcast(within), "doc_id").select("doc_id", "text", "lang", "toxic")
    # As Arrow's batches, which the driver's JVM passes on as they are: rows one by one would stand there in several copies.
    return rows.toArrow().to_pandas().sort_values("doc_id")


def train(docs: DataFrame, labels: DataFrame, held_out: bool = True) -> Model:
    rows = training_rows(docs, labels, held_out)
    return fit(map(words_of, rows["text"]), rows["toxic"].to_numpy(), [x if isinstance(x, str) else "" for x in rows["lang"]])


def scores(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """docs with `score` and `toxic_in_lang` (at or above the threshold of its language)."""
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns
    score, flag = "score", "toxic_in_lang"
    kept = docs.select(*[c for c in names if c not in (score, flag)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m)
        default = m.thresholds.get("", 0.5)
        for batch in batches:
            p = m.probability(np.array([scorer.logit(t.as_py()) for t in batch.column("text")], float))
            cut = np.array([m.thresholds.get(x.as_py() or "", default) for x in batch.column("lang")], float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array(p >= cut, pa.bool_())], [*batch.schema.names, score, flag])

    return mapped(kept, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + f", {score} double, {flag} boolean")

