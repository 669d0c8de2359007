"""Language-model scores by deleted interpolation of word bigrams, unigrams and a uniform distribution.

P(w | v) = a2 c(v w) / c(v) + a1 c(w) / N + a0 / (V + 1), with one triple of weights for each bucket of context frequencies
(powers of two). The weights are learned by expectation-maximisation on held-out counts: every training token in turn is
deleted from the counts and predicted from the rest. Counts are over all training texts, without a cut-off.

Batches of documents send their different words and word pairs, with training counts, to the partition that owns the
hash range, which adds them up and answers each batch; no table of counts is ever broadcast or collected. The driver
sees one histogram of held-out probability ratios for the weights: at most BUCKETS x 128 x 128 cells of half an octave,
each with the means of its ratios, however large the corpus is.

The documents themselves go past that exchange, from a second scan. Both scans sign each batch. Should they have cut the
rows differently (an input that isn't stored, rows that a lost executor's retry reordered), the signatures differ; the rows are then
written to the shared folder, and the work is done again on what is written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm._arrays import filled, give_back, hash_strings, mix64, pack, pack_sorted, parts, slices, unpack, unpack_sorted, words
from glossa.llm._common import checkpoint, shuffle_partitions

#: Histogram cells per octave, and the code of probability zero.
FINE, ZERO = 2, -4096
BUCKETS = 64
ROUNDS = 60
#: Text bytes per batch: the larger, the fewer repeats of a pair are sent.
SLICE = 6 << 20
END, START = np.uint64(0x8F0A6B1C5D3E2F47), np.uint64(0x1D2C3B4A59687786)


def _numbered(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers with an end after each document, tokens per document, and the hash of each number, ascending."""
    index, offsets, unique = words(filled(batch.column("text")))
    h = np.append(hash_strings(unique) if len(unique) else np.zeros(0, np.uint64), END)
    n = np.diff(offsets)
    token = np.full(len(index) + len(n), len(h) - 1)
    token[np.arange(len(index)) + np.repeat(np.arange(len(n)), n)] = index
    order = np.argsort(h, kind="stable")
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    return rank[token], n + 1, h[order]


def _pairs(token: np.ndarray, per_doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different (word before, word) pairs, ascending, and the number of each token's pair."""
    before = np.empty(len(token), np.uint64)
    before[1:] = h[token[:-1]]
    before[np.cumsum(per_doc) - per_doc] = START
    g = mix64(before * np.uint64(0x9E3779B97F4A7C15) + h[token])
    return np.unique(g, return_inverse=True)


_NAMES = ["p", "batch", "kind", "a", "b"]
_SENT = "p int, batch long, kind int, a binary, b binary"
META, WORD, PAIR, TOTAL, SIGN = 0, 1, 2, 3, 4
#: What the job's error says when two scans were cut differently.
CUT = "two scans of the documents were cut differently"


def _record(rows: list[tuple]) -> pa.RecordBatch:
    p, batch, kind, a, b = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(p, pa.int32()), pa.array(batch, pa.int64()), pa.array(kind, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=_NAMES
    )


def _batches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Number and parts of each batch; two scans of the same rows number them alike, and ``_assembled`` checks that they did."""
    for serial, batch in enumerate(slices(batches, most=SLICE)):
        yield (batch.column("part")[0].as_py() << 32) + serial, batch, batch.column("held_out").to_numpy(zero_copy_only=False), *_numbered(batch)


def _signature(batch: pa.RecordBatch) -> bytes:
    """Of a batch's documents and texts, in order."""
    text = filled(batch.column("text"))
    ids = batch.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy().tobytes()
    return b"".join(zlib.crc32(b"\0".join(x)).to_bytes(4, "little") for x in ([ids], text.cast(pa.binary()).to_pylist()))


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per batch: its documents, its words' hashes and its tokens."""
    for number, batch, held, token, per_doc, h in _batches(batches):
        ids = batch.column("doc_id").cast(pa.int64())
        about = [ids.is_valid().to_numpy(zero_copy_only=False).astype("<u8"), ids.fill_null(0).to_numpy().view("<u8"), held.astype("<u8"), per_doc.astype("<u8")]
        often = np.argsort(-np.bincount(token, minlength=len(h)), kind="stable")  # small numbers for frequent words
        short = np.empty(len(h), np.int64)
        short[often] = np.arange(len(h))
        meta = b"".join(x.tobytes() for x in (np.array([len(per_doc), len(h)], "<u8"), *about, h[often].astype("<u8")))
        yield _record([(0, number, META, _signature(batch) + meta, pack(short[token]))])


def _sent(n_parts: int):
    """Batches of documents -> their different words and pairs with training counts, by owner of the hash range."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch, held, token, per_doc, h in _batches(batches):
            yield _record([(number % n_parts, number, SIGN, _signature(batch), None)])
            train = ~np.repeat(held, per_doc)
            pair, at = _pairs(token, per_doc, h)
            for kind, key, count in (
                (WORD, h, np.bincount(token[train], minlength=len(h))),
                (PAIR, pair, np.bincount(at[train], minlength=len(pair))),
            ):
                cuts = parts(key, n_parts)
                some = np.flatnonzero(np.diff(cuts)).tolist()
                yield _record([(p, number, kind, pack_sorted(key[cuts[p] : cuts[p + 1]]), pack(count[cuts[p] : cuts[p + 1]])) for p in some])

    return run


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In the owner of a hash range: the summed counts, in the order of each batch's hashes, and one row of totals."""
    asked: dict[int, list] = {WORD: [], PAIR: []}
    part = None
    for batch in batches:
        for p, b, kind, x, y in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True):
            part = p
            if kind == SIGN:
                yield _record([(p, b, SIGN, x, None)])
                continue
            asked[kind].append((b, unpack_sorted(x), unpack(y)))
    for kind, lists in asked.items():
        if not lists:
            continue
        every = np.concatenate([v for _, v, _ in lists])
        order = np.argsort(every, kind="stable")
        new = np.ones(len(every), bool)
        new[1:] = np.diff(every[order]) != 0
        starts = np.flatnonzero(new)
        total = np.add.reduceat(np.concatenate([c for _, _, c in lists])[order], starts)
        count = np.empty(len(every), np.uint64)
        count[order] = np.repeat(total, np.diff(np.append(starts, len(every))))
        at = 0
        for b, v, _ in lists:
            yield _record([(part, b, kind, None, pack(count[at : at + len(v)]))])
            at += len(v)
        if kind == WORD:
            sums = np.array([int(total.sum()), int((total > 0).sum())], "<u8").tobytes()
            yield _record([(part, -1 - part, TOTAL, sums, None)])
        del every, order, new, count, total
    give_back()


_JOINED = "n long, v long, about binary, words binary, pairs binary"


def _assembled(table: pa.Table) -> pa.Table:
    """For each batch, the training counts of every token and of its pair; totals pass through."""
    rows = sorted(table.to_pylist(), key=lambda r: r["p"])
    names = ["n", "v", "about", "words", "pairs"]
    if rows[0]["kind"] == TOTAL:
        n, v = np.frombuffer(rows[0]["a"], "<u8")
        return pa.table([pa.array([int(n)]), pa.array([int(v)]), *(pa.array([None], pa.binary()) for _ in range(3))], names=names)
    meta, sign = ([r for r in rows if r["kind"] == k] for k in (META, SIGN))
    if len(meta) != 1 or len(sign) != 1 or meta[0]["a"][:8] != sign[0]["a"]:
        raise RuntimeError(CUT)
    meta = meta[0]
    docs, vocabulary = (int(x) for x in np.frombuffer(meta["a"], "<u8", 2, offset=8))
    values = np.frombuffer(meta["a"], "<u8", offset=24)
    about, h = values[: 4 * docs].reshape(4, docs), values[4 * docs : 4 * docs + vocabulary]
    token = unpack(meta["b"]).astype(np.int64)
    count = {kind: np.concatenate([unpack(r["b"]) for r in rows if r["kind"] == kind]) for kind in (WORD, PAIR)}
    pair, at = _pairs(token, about[3].astype(np.int64), h)
    if len(count[WORD]) != vocabulary or len(count[PAIR]) != len(pair):
        raise RuntimeError(CUT)
    of_word = np.empty(vocabulary, np.uint64)
    of_word[np.argsort(h, kind="stable")] = count[WORD]
    blobs = (about.tobytes(), pack(of_word[token]), pack(count[PAIR][at]))
    return pa.table([pa.array([None], pa.int64()), pa.array([None], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs)], names=names)


def _counts(about: bytes, word_blob: bytes, pair_blob: bytes) -> tuple[np.ndarray, ...]:
    """Validity, id, held_out and tokens of each document; counts of each token, of its context and of its pair."""
    valid, ids, held, per_doc = np.frombuffer(about, "<u8").reshape(4, -1)
    per_doc = per_doc.astype(np.int64)
    word, pair = unpack(word_blob).astype(float), unpack(pair_blob).astype(float)
    ends = np.cumsum(per_doc)
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[ends - per_doc] = word[ends - 1]  # the start has been seen as often as the end
    return valid, ids, held, per_doc, word, context, pair


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, then one bucket per power of two."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


def _held_out_counts(n: int, v: int):
    """Histogram cells (cell, count, r2, r1) of the training tokens, each predicted without itself; r2 and r1 are sums of ratios to uniform."""

    def cell(ratio: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.where(ratio > 0, np.floor(FINE * np.log2(np.where(ratio > 0, ratio, 1))), ZERO).astype(np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blobs in zip(*(batch.column(c).to_pylist() for c in ("about", "words", "pairs")), strict=True):
                _, _, held, per_doc, word, context, pair = _counts(*blobs)
                train = ~np.repeat(held.astype(bool), per_doc)
                word, context, pair = word[train] - 1, context[train] - 1, pair[train] - 1
                r2, r1 = np.where(context > 0, pair / np.maximum(context, 1), 0) * (v + 1), word / max(1, n - 1) * (v + 1)
                code = (bucket(context) << 32) + ((cell(r2) + 8192) << 16) + cell(r1) + 8192
                found, at, count = np.unique(code, return_inverse=True, return_counts=True)
                sums = (np.bincount(at, r, minlength=len(found)) for r in (r2, r1))
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(count.astype(np.int64)), *map(pa.array, sums)], names=["cell", "count", "r2", "r1"])

    return run


def learn_weights(cells: np.ndarray, counts: np.ndarray, ratios: np.ndarray | None = None) -> np.ndarray:
    """Weights (bucket x pair, word, uniform) by expectation-maximisation on a histogram of held-out tokens.

    ratios: the mean ratios of each cell to the uniform probability (pair, word); None: the cells' lower edges.
    """
    where, c2, c1 = cells >> 32, ((cells >> 16) & 0xFFFF) - 8192, (cells & 0xFFFF) - 8192
    if ratios is None:
        ratios = np.stack([np.where(c == ZERO, 0.0, np.exp2(c / FINE)) for c in (c2, c1)], 1)
    ratio = np.concatenate([ratios, np.ones((len(cells), 1))], 1)
    weights = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    prior = np.array([0.4, 0.5, 0.1])  # one token's worth, so that no weight becomes zero
    for _ in range(ROUNDS):
        share = weights[where] * ratio
        share *= (counts / share.sum(1))[:, None]
        new = np.stack([np.bincount(where, share[:, j], minlength=BUCKETS) for j in range(3)], 1) + prior
        weights = new / new.sum(1, keepdims=True)
    return weights


def _assembled_batches(rows: DataFrame) -> DataFrame:
    """Totals, and the batches with their counts."""
    n_parts = shuffle_partitions(rows)
    sent = rows.mapInArrow(_sent(n_parts), _SENT)
    counted = sent.repartitionById(n_parts, "p").mapInArrow(_counted, _SENT)
    answered = counted.unionByName(rows.mapInArrow(_documents, _SENT))
    return checkpoint(answered.groupBy("batch").applyInArrow(_assembled, _JOINED))


def lm_scores(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per input row; learns where ``held_out`` is not true.

    A-Z is lower-cased; tokens are words ``[^\\x20\\x09-\\x0D]+`` and one end, so a null or empty text is one token. Words and
    pairs are told apart by 64-bit hashes. base_score adds log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens, with c the token's
    count, N all and V the different tokens of the training texts; score is the model's log10 probability. Held out
    null counts as true. Without training texts the model is the uniform one. Repeated rows count and are scored
    each; an empty table gives an empty result; other columns are ignored. Long texts count whole, each as a batch of its own
    beyond ``SLICE`` bytes, with about thirty times its size in arrays.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.spark_partition_id().alias("part"))
    try:
        joined = _assembled_batches(rows)
    except Exception as error:
        if CUT not in str(error):
            raise
        joined = _assembled_batches(checkpoint(rows))
    n, v = joined.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    batches = joined.filter("about IS NOT NULL").select("about", "words", "pairs")
    sums = [F.sum(c).alias(c) for c in ("count", "r2", "r1")]
    cells = batches.mapInArrow(_held_out_counts(n, v), "cell long, count long, r2 double, r1 double").groupBy("cell").agg(*sums).toPandas()
    cells = cells.sort_values("cell")
    count = cells["count"].to_numpy(float)
    weights = learn_weights(cells["cell"].to_numpy(np.int64), count, cells[["r2", "r1"]].to_numpy(float) / count[:, None])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blobs in zip(*(batch.column(c).to_pylist() for c in ("about", "words", "pairs")), strict=True):
                valid, ids, held, per_doc, word, context, pair = _counts(*blobs)
                a = weights[bucket(context)]
                p = a[:, 0] * np.where(context > 0, pair / np.maximum(context, 1), 0) + a[:, 1] * (word / max(1, n)) + a[:, 2] / (v + 1)
                if not n:
                    p = np.ones(len(word))
                base = np.log10((word + 0.5) / (n + 0.5 * (v + 1)))
                starts = np.cumsum(per_doc) - per_doc
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids.view(np.int64), mask=valid == 0), pa.array(held.astype(bool)), pa.array(per_doc),
                        pa.array(np.add.reduceat((word > 0).astype(np.int64), starts)), pa.array(np.full(len(ids), n, np.int64)),
                        pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(np.log10(p), starts)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return batches.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
