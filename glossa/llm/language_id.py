"""Language identification by nearest clustered centroid.

A text is the TF-IDF vector of its hashed character 1- to 3-grams, of unit length. Each language has several centroids, the
spherical k-means clusters of its sampled texts, and a text gets the language of the centroid with the largest
cosine. Each centroid has a reach: the largest distance (1 - cosine) of the sampled texts that it won, with a margin. A text beyond the
reach of its nearest centroid, or beyond a given distance, is rejected: it is like none of the texts learned from.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm._arrays import filled, slices

DIM = 4096
CLUSTERS = 5
#: Texts that the centroids are fitted on, those with the smallest hashes of their ids: per language, and of all languages, which share them alike.
MAX_PER_LANGUAGE, MAX_TEXTS = 600, 24_000
#: A reach is the largest distance among the texts won, and this share of what is left to 1.
MARGIN = 0.25
UNKNOWN = "und"


def ngram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (texts x DIM) of hashed 1- to 3-grams, and whether each text has a letter."""
    joined = "  " + "".join(f"{t}  " for t in texts)
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    own = np.repeat(np.arange(len(texts)), sizes + 2)  # a text owns the two blanks after it
    used, code = np.unique(raw, return_inverse=True)
    chars = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in used]
    letter = np.array([c.isalpha() for c in chars])
    low = np.array([ord(c.lower()[0]) if a else 32 for c, a in zip(chars, letter, strict=True)], np.uint32)[code]
    has = np.zeros(len(texts), bool)
    has[own[letter[code][2:]]] = True
    c0, c1, c2 = low[:-2], low[1:-1], low[2:]
    total = np.zeros(len(texts) * DIM)
    blank = np.uint32(32)
    grams = (
        (c2 != blank, c2 * np.uint32(2654435761)),
        ((c1 != blank) | (c2 != blank), c1 * np.uint32(2246822519) + c2 * np.uint32(3266489917) + np.uint32(1)),
        (c1 != blank, c0 * np.uint32(668265263) + c1 * np.uint32(374761393) + c2 * np.uint32(2654435769) + np.uint32(2)),
    )
    for keep, h in grams:
        h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822507)
        cell = (h >> np.uint32(20)).astype(np.int64)
        total += np.bincount(own[keep] * DIM + cell[keep], minlength=len(total))
    return total.reshape(len(texts), DIM), has


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows; starts from rows far from one another, so it draws nothing."""
    centres = [unit(x.mean(0, keepdims=True))[0]]
    near = x @ centres[0]
    while len(centres) < min(k, len(x)):
        centres.append(x[int(np.argmin(near))])
        near = np.maximum(near, x @ centres[-1])
    c = np.array(centres)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.array([unit(x[own == j].mean(0, keepdims=True))[0] if (own == j).any() else c[j] for j in range(len(c))])
    return c


class Model:
    """idf, centroids, and the language and the reach of each centroid."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, owner: list[str], reach: np.ndarray) -> None:
        self.idf, self.centroids, self.owner, self.reach = idf.astype(np.float32), centroids.astype(np.float32), owner, reach

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether the text lies beyond the centroid's reach."""
        counts, has = ngram_counts(texts)
        cosine = unit(np.log1p(counts) * self.idf) @ self.centroids.T if len(self.owner) else np.zeros((len(texts), 1))
        best = np.argmax(cosine, axis=1)
        names = [(self.owner[b] if self.owner else UNKNOWN) if h else UNKNOWN for b, h in zip(best, has, strict=True)]
        score = np.where(has, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0.0)
        return names, score, ~has | (1 - score > (self.reach[best] if len(self.owner) else 0.0))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", clusters: int = CLUSTERS) -> Model:
    """Learns from the rows of ``docs`` with a lang and a text: of each language as many as ``MAX_PER_LANGUAGE`` and ``MAX_TEXTS`` allow, one at least."""
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = known.groupBy("lang").count().collect()
    most = min(MAX_PER_LANGUAGE, max(1, MAX_TEXTS // max(1, len(counts))))
    # a share of each language by hash first, so that the ranking sees a bounded number of rows
    h = F.xxhash64(F.lit("language"), "doc_id", "text")
    share = {r["lang"]: min(1.0, 1.5 * most / r["count"] + 20 / r["count"]) for r in counts}
    if not share:
        return Model(np.zeros(DIM), np.zeros((0, DIM)), [], np.zeros(0))
    limit = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])[F.col("lang")]
    drawn = known.withColumn("h", h).filter((F.col("h") / float(1 << 64) + 0.5) <= limit)
    drawn = drawn.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("r") <= most)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 19):
            found, has = ngram_counts(batch.column("text").to_pylist())
            cells = [np.minimum(row, 65535).astype("<u2").tobytes() for row in found]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(has), pa.array(cells, pa.binary())], names=["lang", "h", "ok", "cells"])

    rows = drawn.select("lang", "h", "text").mapInArrow(run, "lang string, h long, ok boolean, cells binary").filter("ok").toPandas()
    rows = rows.sort_values(["lang", "h", "cells"], ignore_index=True)
    if rows.empty:
        return Model(np.zeros(DIM), np.zeros((0, DIM)), [], np.zeros(0))
    x = np.frombuffer(b"".join(rows["cells"]), "<u2").reshape(len(rows), DIM).astype(np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1
    x = unit(np.log1p(x) * idf.astype(np.float32))
    centroids, owner = [], []
    for name, group in rows.groupby("lang", sort=True):
        c = spherical_kmeans(x[group.index], clusters)
        centroids.append(c)
        owner += [str(name)] * len(c)
    every = np.concatenate(centroids)
    cosine = x @ every.T.astype(np.float32)
    won = np.argmax(cosine, axis=1)
    far = np.zeros(len(every))
    np.maximum.at(far, won, 1 - cosine[np.arange(len(x)), won])
    return Model(idf, every, owner, far + MARGIN * (1 - far))


def language_id(
    docs: DataFrame,
    learn_from: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    reject_above: float | None = None,
    clusters: int = CLUSTERS,
    keep_rejected: bool = False,
) -> DataFrame:
    """doc_id, lang_pred, score (cosine to the nearest centroid, 0 to 1), distance, rejected, per input row.

    Learns only from rows where ``learn_from`` holds and both lang and text are not null. A null or empty text, or one without
    a letter (Unicode), is rejected with score 0, and so is with its score a text beyond the reach of its nearest centroid, or
    farther than ``reject_above`` if that is given. What is rejected is ``und``; with ``keep_rejected`` a text with letters has its
    nearest language all the same. Ties go to the language that sorts first. Whole texts count. Without any row to learn
    from all are ``und``; repeated rows get the same answer; an empty table gives an empty result; other columns are ignored.
    """
    model = fit(docs.filter(learn_from), doc_id, text, lang, clusters)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 19):
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                names, score, beyond = model.predict(filled(part.column("text")).to_pylist())
                rejected = beyond if reject_above is None else (score == 0) | (1 - score > reject_above)
                if not keep_rejected:
                    names = [UNKNOWN if r else x for x, r in zip(names, rejected, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(1 - score, pa.float64()), pa.array(rejected)],
                    names=["doc_id", "lang_pred", "score", "distance", "rejected"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, distance double, rejected boolean")
