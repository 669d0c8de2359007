"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over word features is trained with numpy from texts confirmed as toxic and unlabelled texts. With the
class prior p, the risk is p R+(positive) + max(0, R-(unlabelled) - p R-(positive)): what the unlabelled texts cost as
negatives is corrected by the toxic ones among them, and where a fit to noise drives that part below zero the step
goes back up instead. Features of a text are its different words and their first four and five letters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm._arrays import filled, hash_strings, owner, pack, slices, unpack, words
from glossa.llm._common import checkpoint

#: Bounds of the fitted sample: positive texts, unlabelled texts.
MAX_POSITIVE, MAX_UNLABELLED = 3000, 9000
MIN_DOCUMENTS = 2
#: A feature's share in confirmed texts over its share in unlabelled ones must surely exceed RATIO, or this power of the largest ratio there can be.
RATIO, POWER = 4, 0.63
#: Text bytes scored at a time.
SLICE = 5 << 19
ROUNDS, RATE, DECAY = 150, 0.05, 3e-4
EDGES = ".,;:!?\"'()[]{}<>|-_*#%&/\\–—…«»“”‘’¡¿"
THRESHOLD = 0.3


def word_features(unique: pa.Array) -> list[np.ndarray]:
    """Hashes of each word, of its first four and of its first five letters."""
    bare = pc.utf8_lower(pc.utf8_trim(unique, characters=EDGES))
    heads = [pc.binary_join_element_wise(str(k), pc.utf8_slice_codeunits(bare, 0, k), "\x00") for k in (4, 5)]
    return [hash_strings(x) for x in (bare, *heads)]


def _document_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each different (document, word) of a batch: document and word indexes, unique words."""
    index, offsets, unique = words(filled(batch.column("text")))
    size = max(1, len(unique))
    pairs = np.unique(owner(offsets) * size + index)
    return pairs // size, pairs % size, unique


class Model:
    """Weights by feature hash, ascending, and the bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.keys, self.weights, self.bias = keys, weights, bias

    def logits(self, batch: pa.RecordBatch) -> np.ndarray:
        doc, word, unique = _document_words(batch)
        value = np.zeros(len(unique))
        for h in word_features(unique):
            at = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
            if len(self.keys):
                value += np.where(self.keys[at] == h, self.weights[at], 0.0)
        return self.bias + np.bincount(doc, value[word], minlength=batch.num_rows)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def least_evidence(prior: float) -> float:
    """The log ratio of shares that a feature must surely exceed.

    A share ``prior`` of the unlabelled texts is toxic too, so that no ratio of the two shares exceeds 1 / prior. Required is a ratio of
    min(RATIO, prior ** -POWER): at any prior from 0.01 to 0.4, 3.7 to 6.4 times the feature's share in non-toxic texts.
    """
    return float(min(np.log(RATIO), -POWER * np.log(prior)))


def evidence(n_positive: Column, n_unlabelled: Column, positives: int, unlabelled: int) -> Column:
    """Log ratio of a feature's shares in confirmed and in unlabelled texts, two standard deviations down."""
    share = lambda n, total: (n + 0.5) / (max(1, total) + 1)
    deviation = F.sqrt(1 / (n_positive + 0.5) + 1 / (n_unlabelled + 0.5))
    return F.log(share(n_positive, positives) / share(n_unlabelled, unlabelled)) - 2 * deviation


def train_nnpu(rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias. rows: feature indexes of each text (repeats count); positive: 1 for confirmed, 0 for unlabelled."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, bias = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    share = np.where(positive == 1, 1 / max(1, (positive == 1).sum()), 1 / max(1, (positive == 0).sum()))
    mean, square = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, ROUNDS + 1):
        z = bias + np.bincount(doc, w[flat], minlength=len(rows))
        p = _sigmoid(z)
        minus = np.logaddexp(0, z)
        negative = (share * minus)[positive == 0].sum() - prior * (share * minus)[positive == 1].sum()
        # derivatives by z of p R+ and of the corrected negative part
        plus = np.where(positive == 1, prior * share * (p - 1), 0.0)
        corrected = np.where(positive == 1, -prior, 1.0) * share * p
        g = plus + corrected if negative >= 0 else -corrected
        step = np.append(np.bincount(flat, g[doc], minlength=n_features) + DECAY * w, g.sum())
        mean, square = 0.9 * mean + 0.1 * step, 0.999 * square + 0.001 * step**2
        move = RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        # a projected step: a text that shows no feature is no likelier toxic than the prior says
        w, bias = w - move[:-1], min(bias - move[-1], float(np.log(prior / (1 - prior))))
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from the rows of ``docs`` and ``labels`` whose ``doc_id`` column fulfils ``learn_from``."""
    marked = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("y")).filter(learn_from & F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.groupBy("doc_id").agg(F.max("y").alias("y"))
    n, n_positive = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("y") == 1, 1)), F.lit(0))).first()
    if not n_positive:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -35.0)
    prior = min(0.95, max(1e-4, n_positive / n))
    order = F.xxhash64(F.lit("positive"), "doc_id")
    chosen = marked.filter("y = 1").orderBy(order, "doc_id").limit(MAX_POSITIVE).select("doc_id")  # bounded, so it may be broadcast
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter(learn_from)
    fp = F.xxhash64("text")
    positives = rows.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64(F.lit("row"), "doc_id", fp), "doc_id", fp).limit(2 * MAX_POSITIVE)
    # a share by hash first, so that few rows are ordered; ordered, so that reruns take the same
    h = F.xxhash64(F.lit("unlabelled"), "doc_id")
    share = 0.95 * MAX_UNLABELLED / max(1, rows.count())
    unlabelled = rows.filter(h / float(1 << 64) + 0.5 <= share).orderBy(h, "doc_id", fp).limit(MAX_UNLABELLED)
    sample = checkpoint(positives.withColumn("y", F.lit(1)).unionByName(unlabelled.withColumn("y", F.lit(0))).repartition(32))
    texts_of = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_numpy()
            for kind in np.unique(y):
                for part in slices([batch.filter(pa.array(y == kind))]):
                    doc, word, unique = _document_words(part)
                    pairs = np.concatenate([np.stack([doc.astype(np.uint64), h[word]], 1) for h in word_features(unique)])
                    keys, count = np.unique(np.unique(pairs, axis=0)[:, 1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(keys), kind), keys.view(np.int64), count.astype(np.int64))], names=["y", "f", "n"])

    counted = sample.select("text", "y").mapInArrow(features, "y int, f long, n long").groupBy("f").agg(
        *[F.coalesce(F.sum(F.when(F.col("y") == y, F.col("n"))), F.lit(0)).alias(f"n{y}") for y in (0, 1)]
    )
    telling = counted.filter((F.col("n1") >= MIN_DOCUMENTS) & (evidence(F.col("n1"), F.col("n0"), texts_of.get(1, 0), texts_of.get(0, 0)) > least_evidence(prior)))
    keys = np.sort(telling.select("f").toPandas()["f"].to_numpy(np.int64).view(np.uint64))

    def lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc, word, unique = _document_words(batch)
            out: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            for h in word_features(unique):
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                at = np.where(keys[at] == h, at, -1) if len(keys) else np.full(len(h), -1)
                for i in range(batch.num_rows):
                    own = at[word[cuts[i] : cuts[i + 1]]]
                    out[i].append(own[own >= 0])
            blobs = [pack(np.concatenate(x)) for x in out]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(blobs, pa.binary())], names=["y", "f"])

    found = sample.select("y", "text").mapInArrow(lists, "y int, f binary").toPandas().sort_values(["y", "f"])
    texts = [unpack(b).astype(np.int64) for b in found["f"]]
    w, bias = train_nnpu(texts, found["y"].to_numpy(), len(keys), prior)
    return Model(keys, w, bias)


def scorer(model: Model):
    """A pandas-free scoring function over record batches with columns doc_id and text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_sigmoid(model.logits(batch)))], names=["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, score (0 to 1, higher: likelier toxic), per input row.

    ``learn_from`` is a condition on ``doc_id``: only such rows are learned from, positives by their label and a sample of
    all such texts, without labels, as unlabelled. A doc_id with several labels counts as toxic if one says so. A null or
    empty text gets the score of a text without features. Without a toxic label to learn from all scores are about
    0. Repeated rows get the same score; an empty table gives an empty result; long texts count whole; other columns are ignored.
    The fit sees ``MAX_POSITIVE`` positive ids (and at most twice as many of their rows) and ``MAX_UNLABELLED`` texts at most, chosen by hash.
    """
    model = fit(docs, labels, learn_from, doc_id, text, label)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(scorer(model), f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, learn_from: Column, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, whatever their names, that score below ``threshold``.

    Scores of nulls, empty and long texts, ties and repeated rows as in ``toxicity``; an empty table gives an empty table.
    """
    model = fit(docs, labels, learn_from, text=text)
    position = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, docs_text, SLICE):
            scored = pa.RecordBatch.from_arrays([batch.column(position)], names=["text"])
            yield batch.filter(pa.array(_sigmoid(model.logits(scored)) < threshold))

    docs_text = text
    return docs.mapInArrow(run, docs.schema)
