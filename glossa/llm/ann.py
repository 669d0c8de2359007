"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` tables hashes a vector by ``HASHES`` Gaussian (2-stable) projections cut into cells of one width. A
query visits its own bucket and the buckets it reaches by moving some coordinates one cell up or down, in the order
of estimated success: the sum of squared distances to the cell walls that are crossed, smallest first. Candidates of all
tables are merged and ranked by their exact distance.

Rows and queries meet by bucket: a row goes once to each partition that holds one of its ``TABLES`` buckets, a query once to
each partition that holds a bucket it visits. No row is copied for the number of queries. A bucket of more than ``BUCKET_ROWS`` rows
is cut into pieces by a hash of the row; its queries visit all pieces. Within a partition the rows come first and queries
stream past them, so memory holds one partition's rows and one batch of queries.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm._arrays import mix64
from glossa.llm._common import checkpoint

TABLES, HASHES, PROBES = 8, 8, 600
#: Cell width, as a multiple of the median distance between sampled vectors.
WIDTH = 1.06
#: Rows that the width is fitted on.
SAMPLE = 1000
#: Rows (with their copies) per partition, rows of a bucket per piece, and the largest number of buckets cut into pieces.
PARTITION_ROWS, BUCKET_ROWS, MAX_CUT = 65_536, 4096, 200_000
#: Queries handled at a time; rows compared exactly at a time.
QUERY_BATCH, PAIRS = 64, 1 << 17


def _clean(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """uid, id, dim, v (the bytes of doubles) of the rows that take part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)  # null components become NaN
            own = np.repeat(np.arange(len(n)), n)
            bad = np.bincount(own, ~np.isfinite(flat), minlength=len(n)) > 0
            some = np.bincount(own, flat != 0, minlength=len(n)) > 0
            ok = pa.array(~bad & some & batch.column("id").is_valid().to_numpy(zero_copy_only=False))
            ends = pa.array(np.concatenate([[0], np.cumsum(8 * n)]), pa.int64())
            blobs = pa.Array.from_buffers(pa.large_binary(), len(n), [None, ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("id"), pa.array(n, pa.int32()), blobs], names=["uid", "id", "dim", "v"]).filter(ok)

    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v"))
    return rows.mapInArrow(run, "uid long, id long, dim int, v binary")


class Tables:
    """The hash functions for one dimension; the same wherever they are made."""

    def __init__(self, dim: int, width: float, tables: int, hashes: int, probes: int, seed: int) -> None:
        rng = np.random.default_rng([seed, dim])
        self.dim, self.width, self.tables, self.hashes = dim, width, tables, hashes
        self.lines = rng.standard_normal((tables, dim, hashes))
        self.shift = rng.uniform(0, 1, (tables, 1, hashes))
        self.mixer = rng.integers(1, 1 << 62, (tables, hashes)) | 1
        self.moves = np.array(list(itertools.product((-1, 0, 1), repeat=hashes)), np.int64)
        self.probes = min(probes, len(self.moves))

    def codes(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket code of each row, and its place within the cell in each coordinate."""
        p = x @ self.lines[t] / self.width + self.shift[t]
        cell = np.floor(p)
        return (cell.astype(np.int64) * self.mixer[t]).sum(1), p - cell

    def visited(self, x: np.ndarray, t: int) -> np.ndarray:
        """Bucket codes that each query visits: the likeliest moves by squared distances to the walls crossed."""
        code, at = self.codes(x, t)
        cost = at**2 @ (self.moves == -1).T + (1 - at) ** 2 @ (self.moves == 1).T
        best = np.argpartition(cost, self.probes - 1, axis=1)[:, : self.probes]
        return code[:, None] + (self.moves @ self.mixer[t])[best]

    def buckets(self, codes: np.ndarray, t: int) -> np.ndarray:
        """Names of buckets over all tables and dimensions."""
        return mix64(codes.view(np.uint64) + mix64(np.array([t * 65_537 + self.dim], np.uint64)))


def _matrix(blobs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), float).reshape(len(blobs), -1)


def _by_dim(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    dims = batch.column("dim").to_numpy()
    for d in np.unique(dims):
        yield batch.filter(pa.array(dims == d))


def _fit_width(clean: DataFrame) -> dict[int, float]:
    """Cell width per dimension, from the ``SAMPLE`` rows with the smallest hashes."""
    sample = clean.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).toPandas()
    widths = {}
    for dim, group in sample.groupby("dim"):
        d = _distances(_matrix(pa.array(group["v"])))
        middle = float(np.median(d[d > 0])) if (d > 0).any() else 1.0
        widths[int(dim)] = WIDTH * middle
    return widths


def _distances(x: np.ndarray) -> np.ndarray:
    sq = (x**2).sum(1)
    return np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0))[np.triu_indices(len(x), 1)]


def _pieces(bucket: np.ndarray, cut: dict[str, np.ndarray]) -> np.ndarray:
    """The number of pieces of each bucket."""
    if not len(cut["bucket"]):
        return np.ones(len(bucket), np.int64)
    at = np.minimum(np.searchsorted(cut["bucket"], bucket), len(cut["bucket"]) - 1)
    return np.where(cut["bucket"][at] == bucket, cut["pieces"][at], 1)


def _cell(bucket: np.ndarray, piece: np.ndarray) -> np.ndarray:
    return mix64(bucket + piece.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_SENT = "p long, asks boolean, uid long, id long, dim int, v binary, cells binary"


def _sent(batch: pa.RecordBatch, row: np.ndarray, cell: np.ndarray, n_parts: int, asks: bool) -> pa.RecordBatch:
    """One record per (row, partition): the row and its cells there."""
    part = (cell % np.uint64(n_parts)).astype(np.int64)
    order = np.lexsort((part, row))
    row, part, cell = row[order], part[order], cell[order]
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row) != 0) | (np.diff(part) != 0)
    first = np.flatnonzero(new)
    ends = np.append(first, len(row))
    raw = cell.tobytes()
    cells = pa.array([raw[8 * a : 8 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
    own = batch.take(pa.array(row[first]))
    return pa.RecordBatch.from_arrays(
        [pa.array(part[first]), pa.array(np.full(len(first), asks)), *(own.column(c) for c in ("uid", "id", "dim", "v")), cells], names=["p", "asks", "uid", "id", "dim", "v", "cells"]
    )


def _top(query: np.ndarray, distance: np.ndarray, vec: np.ndarray, uid: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k nearest of each query (ties to the smaller id), query after query."""
    order = np.lexsort((uid, vec, distance, query))
    new = np.ones(len(order), bool)
    new[1:] = np.diff(query[order]) != 0
    starts = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[place < k]


_FOUND = "query_id long, uid long, vec_id long, score double, n_compared long"


def _found(q_ids: np.ndarray, compared: np.ndarray, query: np.ndarray, distance: np.ndarray, vec: np.ndarray, uid: np.ndarray, k: int) -> pa.RecordBatch:
    """The k nearest of each query, and with the first of them how many rows were compared."""
    best = _top(query, distance, vec, uid, k)
    asked = query[best]
    first = np.ones(len(best), bool)
    first[1:] = np.diff(asked) != 0
    columns = (q_ids[asked], uid[best], vec[best], distance[best], np.where(first, compared[asked], 0))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["query_id", "uid", "vec_id", "score", "n_compared"])


def _closest(x: np.ndarray, q: np.ndarray, hit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) of ``hit`` that can be among the k nearest: by squared distances from one matrix product, with room for its rounding."""
    sx, sq = (x**2).sum(1), (q**2).sum(1)
    most = sx.max(initial=0) + sq.max(initial=0)
    if hit.shape[1] > k and most < 1e300:
        rough = sx[None, :] - 2 * (q @ x.T)
        rough[~hit] = np.inf
        hit = hit & (rough <= np.partition(rough, k - 1, axis=1)[:, k - 1 : k] + 1e-9 * most)
    return np.nonzero(hit)


def _measured(rows: np.ndarray, queries: np.ndarray, asker: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Exact distances of pairs, ``PAIRS`` at a time."""
    out = np.empty(len(row))
    for a in range(0, len(row), PAIRS):
        b = slice(a, a + PAIRS)
        out[b] = np.sqrt(((rows[row[b]] - queries[asker[b]]) ** 2).sum(1))
    return out


def _meet(k: int):
    """Partitions sorted by (p, dim, asks): the rows of a partition are kept, the queries after them are answered as they come."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for batch in batches:
            p, dim, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("p", "dim", "asks"))
            change = np.flatnonzero((np.diff(p) != 0) | (np.diff(dim) != 0) | (asks[1:] != asks[:-1])) + 1
            cuts = [0, *change.tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b <= a:
                    continue
                if at != (p[a], dim[a]):
                    at, held, index = (p[a], dim[a]), [], None
                if not asks[a]:
                    held.append(batch.slice(a, b - a))
                elif held:
                    index = index or _Index(pa.Table.from_batches(held).combine_chunks())
                    for s in range(a, b, QUERY_BATCH):
                        yield index.answer(batch.slice(s, min(QUERY_BATCH, b - s)), k)

    return run


class _Index:
    """The rows of one partition by cell."""

    def __init__(self, rows: pa.Table) -> None:
        self.x = _matrix(rows.column("v"))
        self.uid, self.id = rows.column("uid").to_numpy(), rows.column("id").to_numpy()
        cell, row = _cells(rows.column("cells"))
        order = np.argsort(cell, kind="stable")
        self.row = row[order]
        self.cells, self.first = np.unique(cell[order], return_index=True)
        self.size = np.diff(np.append(self.first, len(cell)))

    def answer(self, asked: pa.RecordBatch, k: int) -> pa.RecordBatch:
        q, q_ids = _matrix(asked.column("v")), asked.column("id").to_numpy()
        cell, asker = _cells(asked.column("cells"))
        at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        hit = self.cells[at] == cell
        at, asker = at[hit], asker[hit]
        size = self.size[at]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        hit = np.zeros((len(q), len(self.uid)), bool)
        hit[np.repeat(asker, size), self.row[np.repeat(self.first[at], size) + within]] = True
        hit &= self.id[None, :] != q_ids[:, None]
        asker, row = _closest(self.x, q, hit, k)
        return _found(q_ids, hit.sum(1), asker, _measured(self.x, q, asker, row), self.id[row], self.uid[row], k)


def _cells(blobs: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = blobs.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint64), np.repeat(np.arange(len(raw)), [len(r) // 8 for r in raw])


def _exhaustive(clean: DataFrame, short: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """The k nearest of all rows for the few queries that hashing served badly: blocks of queries, broadcast, against a scan of the rows."""
    n = short.count()
    number = F.row_number().over(Window.orderBy("id"))  # queries in need only
    numbered = checkpoint(short.withColumn("b", F.floor((number - 1) / block)))
    out = None
    for b in range(-(-n // block)):
        asked = numbered.filter(F.col("b") == b).select("id", "dim", "v").toArrow().combine_chunks()
        by = {d.column("dim")[0].as_py(): (d.column("id").to_numpy(), _matrix(d.column("v"))) for d in _by_dim(asked.to_batches()[0])}

        def run(batches: Iterable[pa.RecordBatch], by=by) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows in _by_dim(batch):
                    q_ids, q = by.get(rows.column("dim")[0].as_py(), (np.zeros(0, np.int64), None))
                    ids, uid = rows.column("id").to_numpy(), rows.column("uid").to_numpy()
                    x = _matrix(rows.column("v"))
                    for s in range(0, len(q_ids), QUERY_BATCH):
                        mine = q_ids[s : s + QUERY_BATCH]
                        hit = mine[:, None] != ids[None, :]
                        asker, row = _closest(x, q[s : s + QUERY_BATCH], hit, k)
                        if len(row):
                            yield _found(mine, hit.sum(1), asker, _measured(x, q[s : s + QUERY_BATCH], asker, row), ids[row], uid[row], k)

        part = _ranked(clean.mapInArrow(run, _FOUND), k)
        out = part if out is None else out.unionByName(part)
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of what the partitions found, each row once; n_compared sums over partitions."""
    once = found.groupBy("query_id", "uid", "vec_id").agg(F.min("score").alias("score"), F.sum("n_compared").alias("n_compared"))
    by = Window.partitionBy("query_id")
    ranked = once.withColumn("n_compared", F.sum("n_compared").over(by)).withColumn("rank", F.row_number().over(by.orderBy("score", "vec_id", "uid")))
    return ranked.filter(F.col("rank") <= k).drop("uid")


def ann_search(
    vectors: DataFrame,
    is_query: Callable[[Column], Column],
    k: int = 10,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    tables: int = TABLES,
    hashes: int = HASHES,
    probes: int = PROBES,
    width: float | None = None,
    seed: int = 7,
) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance in double precision) of the k nearest found for each query, n_compared.

    Queries are the rows whose id fulfils ``is_query``; candidates are all rows with another id and as many components.
    Rows with a null id, or a null, empty or zero vector, or a null or non-finite component, take no part. Ties go to
    the smaller id; repeated rows are candidates each, and repeated queries are asked once by their first vector. A
    query for which the hashing finds fewer than k neighbours is compared with every row instead, so it
    returns k, or all there are. ``width`` None: fitted on ``SAMPLE`` rows. n_compared is the number of exact distances taken for
    the query. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    clean = checkpoint(_clean(vectors, vec_id, embedding))
    queries = clean.filter(is_query(F.col("id"))).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("m"))
    queries = checkpoint(queries.select(F.lit(0).cast("long").alias("uid"), "id", "m.dim", "m.v"))
    n_rows = clean.count()
    widths = _fit_width(clean) if width is None else {}

    def family(dim: int) -> Tables:
        return Tables(dim, width or widths.get(dim, 1.0), tables, hashes, probes, seed)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _by_dim(batch):
                x, f = _matrix(rows.column("v")), family(rows.column("dim")[0].as_py())
                found, n = np.unique(np.concatenate([f.buckets(f.codes(x, t)[0], t) for t in range(tables)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["bucket", "n"])

    # fewer than MAX_CUT buckets can have more rows than this, so their list has a bound at any size of the table
    most = max(BUCKET_ROWS, n_rows * tables // MAX_CUT + 1)
    large = clean.mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") > most).toPandas()
    name = large["bucket"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(name)
    cut = {"bucket": name[order], "pieces": -(-large["n"].to_numpy(np.int64)[order] // most)}
    n_parts = max(1, -(-n_rows * tables // PARTITION_ROWS), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def rows_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _by_dim(batch):
                x, f = _matrix(rows.column("v")), family(rows.column("dim")[0].as_py())
                bucket = np.concatenate([f.buckets(f.codes(x, t)[0], t) for t in range(tables)])
                salt = mix64(np.tile(rows.column("uid").to_numpy().view(np.uint64), tables))
                cell = _cell(bucket, (salt % _pieces(bucket, cut).astype(np.uint64)).astype(np.int64))
                yield _sent(rows, np.tile(np.arange(len(x)), tables), cell, n_parts, False)

    def queries_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, QUERY_BATCH):
                for rows in _by_dim(batch.slice(s, QUERY_BATCH)):
                    x, f = _matrix(rows.column("v")), family(rows.column("dim")[0].as_py())
                    bucket = np.concatenate([f.buckets(f.visited(x, t).reshape(-1), t) for t in range(tables)])
                    row = np.tile(np.repeat(np.arange(len(x)), f.probes), tables)
                    n = _pieces(bucket, cut)
                    piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    yield _sent(rows, np.repeat(row, n), _cell(np.repeat(bucket, n), piece), n_parts, True)

    sent = clean.mapInArrow(rows_out, _SENT).unionByName(queries.mapInArrow(queries_out, _SENT))
    dealt = sent.repartitionById(n_parts, F.col("p").cast("int")).sortWithinPartitions("p", "dim", "asks")
    found = checkpoint(_ranked(dealt.mapInArrow(_meet(k), _FOUND), k))
    full = found.filter(F.col("rank") == min(k, max(1, n_rows - 1))).select(F.col("query_id").alias("id"))
    short = checkpoint(queries.join(full, "id", "left_anti"))
    if not short.isEmpty():
        rest = _exhaustive(clean, short, k)
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
    return found.select("query_id", "rank", "vec_id", "score", "n_compared")
