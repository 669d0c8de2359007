"""N-gram Jaccard join: exact links between documents whose word shingle sets are similar, and their components.

The Jaccard distance is a metric. Among texts nearly all distances are 1, though, so no pivot tells unrelated texts apart, and
Voronoi cells over a corpus would replicate every document everywhere. The corpus is first cut without loss by a prefix of
each set: shingles are ordered by document frequency, and two sets similar enough share one of the first few. What
meets on a prefix shingle forms the region of a pivot, and a region is joined in the metric way: pivots, Voronoi cells,
boundary documents replicated by the triangle inequality, cells joined recursively, each link decided by exact counts.

1. Batches of documents send their different shingle hashes, with the number of their documents, to the partition that owns the
   hash range; it counts documents per shingle and answers with the shingles that others share. A document most of
   whose shingles are its own ends here.
2. Equal sets become one class; classes send their prefix shingles out and get the pivot of each.
3. A region of ``REGION`` sets at most is joined in one task. A larger one is parted over tasks, round by round: its sets are measured
   against ``CELLS`` pivots, get their Voronoi cell, and are copied into the cells in whose window they lie; the cells are
   the regions of the next round. What links with a pivot forms a tree, and pairs within a tree need no look; a cell of one
   tree ends here. Only where a round leaves a cell nearly as large as the region (distances that are all alike), the
   sets outside the largest tree meet all others, chunk by chunk.
4. Connected components of the links, by alternating stars, checkpointed each round.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.lineage import components, free_names, skew_join
from glossa.llm._arrays import filled, give_back, hash_strings, mix64, owner, pack, pack_sorted, parts, slices, unpack, unpack_sorted, words
from glossa.llm._common import checkpoint, shuffle_partitions

WORDS = 5
#: Similarity as a fraction of integers, so that links are decided without rounding.
NUMERATOR, DENOMINATOR = 80, 100
#: Documents of a region that one task joins, and those that are compared without further pivots.
REGION, LEAF = 1500, 32
#: Pivots of a round, 8 at most (their links are one byte), and the share of a region that its largest cell must stay below.
CELLS, PARTED = 8, 0.8
#: Text bytes per batch, and those whose words are in arrays at a time.
SLICE, PIECE = 4 << 20, 1 << 20
#: Ids that may be broadcast (8 bytes each), as a count has checked; more are shuffled.
BROADCAST_IDS = 500_000
MOST_DF = 255
#: Shingles mixed at a time.
RUN = 1 << 17


def shingles(texts: pa.Array, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (shingle hash, document index), ascending by hash, then document.

    Found piece by piece and merged, so that the arrays of words, many times the texts, are those of a piece.
    """
    found, first = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
    for piece in slices([pa.RecordBatch.from_arrays([texts], names=["text"])], most=PIECE):
        value, own = _shingles(piece.column("text"), n_words)
        found.append((value, own + first))
        first += piece.num_rows
    if len(found) == 2:
        return found[1]
    value, own = (np.concatenate(x) for x in zip(*found, strict=True))
    del found
    order = np.argsort(value, kind="stable")  # documents ascend from piece to piece
    own = own[order]
    return value[order], own


def _shingles(texts: pa.Array, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    index, offsets, unique = words(texts)
    h = hash_strings(unique)[index] if len(unique) else np.zeros(0, np.uint64)
    weights = mix64(np.arange(1, n_words + 1, dtype=np.uint64)) | np.uint64(1)
    n = np.diff(offsets)
    doc = owner(offsets)
    full = np.zeros(max(0, len(h) - n_words + 1), np.uint64)
    for k in range(n_words):
        full += h[k : len(h) - n_words + 1 + k] * weights[k] if len(full) else full
    inside = doc[: len(full)] == doc[n_words - 1 :] if len(full) else np.zeros(0, bool)
    short = np.flatnonzero((n > 0) & (n < n_words))
    # the length enters too, so that a short text's only shingle is none of another length
    whole = [int(np.sum(h[offsets[i] : offsets[i + 1]] * weights[: n[i]], dtype=np.uint64)) + int(n[i]) * 0x632BE59BD9B4E019 & (1 << 64) - 1 for i in short]
    value = mix64(np.concatenate([full[inside], np.array(whole, np.uint64)]))
    own = np.concatenate([doc[: len(full)][inside], short])
    order = np.lexsort((own, value)) if len(short) else np.argsort(value, kind="stable")
    value, own = value[order], own[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    return value[first], own[first]


def _set_hashes(value: np.ndarray, own: np.ndarray, n: int) -> list[np.ndarray]:
    """Two order-free 64-bit hashes of each document's set: sums of two mixes of its members, added up a run of members at a time."""
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        total = np.zeros(n, np.uint64)
        for a in range(0, len(value), RUN):
            mixed, members = mix64(value[a : a + RUN] ^ np.uint64(salt)), own[a : a + RUN]
            for shift in (0, 16, 32, 48):
                part = ((mixed >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(float)
                total += np.bincount(members, part, minlength=n).astype(np.uint64) << np.uint64(shift)
        out.append(total)
    return out


_ASKED = ["batch", "meta", "hashes", "counts", "owners"]


def _sent(n_parts: int, n_words: int):
    """Batches of documents -> different shingles by owner of their hash range, and one row with the documents themselves."""

    def rows_of(batch: pa.RecordBatch, number: int) -> pa.RecordBatch:
        value, own = shingles(filled(batch.column("text")), n_words)
        n = batch.num_rows
        s1, s2 = _set_hashes(value, own, n)
        ids = batch.column("doc_id").cast(pa.int64())
        doc = [ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint64), ids.fill_null(0).to_numpy().view(np.uint64)]
        keys = [batch.column("key").to_numpy().view(np.uint64)] if "key" in batch.schema.names else []
        about = [*doc, np.bincount(own, minlength=n).astype(np.uint64), s1, s2, *keys]
        cuts = parts(value, n_parts)
        rows = [(number % n_parts, b"".join(a.astype("<u8").tobytes() for a in about), None, None, None)]
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            different, count = np.unique(value[cuts[p] : cuts[p + 1]], return_counts=True)
            rows.append((p, None, pack_sorted(different), pack(count), pack(own[cuts[p] : cuts[p + 1]])))
        part, *blobs = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([number] * len(rows), pa.int64()), *(pa.array(x, pa.binary()) for x in blobs)], names=["p", *_ASKED])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for serial, batch in enumerate(slices(batches, most=SLICE)):
            yield rows_of(batch, base + serial)  # nothing of a batch is held while the next is worked on

    return run


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In the owner of a hash range: answers each batch with its shingles that several documents have, and passes on meta rows.

    A batch sends a shingle once for all its documents, so one that many documents have costs an entry per batch.
    """

    def record(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=[*_ASKED, "df"])

    ids, values, counts, owners = [], [], [], []
    for batch in batches:
        for b, meta, h, c, o in zip(*(batch.column(c).to_pylist() for c in _ASKED), strict=True):
            if meta is not None:
                yield record([(b, meta, None, None, None, None)])
            else:
                ids.append(b), values.append(unpack_sorted(h)), counts.append(unpack(c).astype(np.uint32)), owners.append(o)
    if not values:
        return
    every = np.concatenate(values)
    values = np.split(every, np.cumsum([len(v) for v in values])[:-1])  # not held twice
    order = np.argsort(every, kind="stable")
    new, ordered = np.ones(len(every), bool), every[order]
    new[1:] = ordered[1:] != ordered[:-1]
    del ordered
    starts = np.flatnonzero(new)
    total = np.add.reduceat(np.minimum(np.concatenate(counts), MOST_DF)[order], starts, dtype=np.uint64)
    df = np.empty(len(every), np.uint8)
    df[order] = np.repeat(np.minimum(total, MOST_DF).astype(np.uint8), np.diff(np.append(starts, len(every))))
    at = 0
    for b, v, c, o in zip(ids, values, counts, owners, strict=True):
        mine = df[at : at + len(v)]
        at += len(v)
        keep = mine > 1
        if keep.any():
            yield record([(b, None, pack_sorted(v[keep]), pack(c[keep]), pack(unpack(o)[np.repeat(keep, c.astype(np.int64))]), pack(mine[keep]))])
    del every, order, new, df, values
    give_back()


def needed(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least overlap that a set of n needs with any similar set."""
    return -(-num * n // den)


def _assembled(num: int, den: int, keyed: bool):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        meta = next(r["meta"] for r in rows if r["meta"] is not None)
        valid, ids, n, s1, s2, *keys = np.frombuffer(meta, "<u8").reshape(5 + keyed, -1)
        docs, n = len(n), n.astype(np.int64)
        answers = [r for r in rows if r["meta"] is None]
        none = [np.zeros(0, np.uint64)]
        times = np.concatenate([unpack(r["counts"]) for r in answers] or none).astype(np.int64)
        value = np.repeat(np.concatenate([unpack_sorted(r["hashes"]) for r in answers] or none), times)
        df = np.repeat(np.concatenate([unpack(r["df"]) for r in answers] or none), times)
        own = np.concatenate([unpack(r["owners"]) for r in answers] or none).astype(np.int64)
        m = np.bincount(own, minlength=docs)
        prefix = n - needed(n, num, den) + 1 - (n - m)  # of the shared shingles; those of one document come first and match nothing
        live = (n > 0) & (prefix > 0)
        keep = live[own]
        value, own, df = value[keep], own[keep], df[keep]
        order = np.lexsort((value, df, own))
        value, own = value[order], own[order]
        cuts = np.searchsorted(own, np.arange(docs + 1))
        tokens = [value[cuts[i] : cuts[i + 1]].tobytes() if live[i] else None for i in range(docs)]
        uid = (table.column("batch")[0].as_py() << 20) + np.arange(docs)
        return pa.Table.from_arrays(
            [
                pa.array(uid, pa.int64()), pa.array(ids.view(np.int64), mask=valid == 0), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                pa.array(np.where(live, prefix, 0)), pa.array(tokens, pa.binary()),
                *(pa.array(k.view(np.int64)) for k in keys),
            ],
            names=["uid", "doc_id", "n", "s1", "s2", "prefix", "tokens", *["key"] * keyed],
        )

    return run


def _prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prefix = batch.column("prefix").to_numpy()
        tokens = [np.frombuffer(t, np.int64)[:k] for t, k in zip(batch.column("tokens").to_pylist(), prefix, strict=True)]
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.repeat(batch.column("uid").to_numpy(), prefix))], names=["token", "uid"])


class Region:
    """Sets of one region, their links found so far as a forest."""

    def __init__(self, sizes: np.ndarray, tokens: list[np.ndarray], num: int, den: int, every: bool = False, trees: np.ndarray | None = None) -> None:
        self.n, self.num, self.den = sizes.astype(np.int64), num, den
        self.reach = 1 - num / den + 1e-9
        self.tokens = [np.sort(t) for t in tokens]
        self.root = np.arange(len(sizes))
        if trees is not None and not every:  # sets with one number (not -1) are known to be connected
            _, first, number = np.unique(trees, return_index=True, return_inverse=True)
            self.root = np.where(trees >= 0, first[number], self.root)
        #: with ``every``, all links are looked for and kept, not only what joins trees
        self.every, self.links = every, set()

    def overlap(self, p: int, members: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of p with each member, exactly."""
        if not len(members):
            return np.zeros(0, np.int64)
        own = self.tokens[p]
        flat = np.concatenate([self.tokens[i] for i in members])
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        seen = np.concatenate([[0], np.cumsum(own[at] == flat)])
        ends = np.cumsum([len(self.tokens[i]) for i in members])
        return np.diff(np.concatenate([[0], seen[ends]]))

    def measure(self, p: int, members: np.ndarray) -> np.ndarray:
        """Distances from p; members that link with p join its tree."""
        both = self.overlap(p, members)
        union = self.n[p] + self.n[members] - both
        near = members[self.den * both >= self.num * union]
        if self.every:
            self.links.update((min(p, int(m)), max(p, int(m))) for m in near if m != p)
        for r in np.unique(self.root[near]):
            self.root[self.root == r] = self.root[p]
        return 1 - both / union

    def _done(self, members: np.ndarray) -> bool:
        return not self.every and len(np.unique(self.root[members])) == 1

    def join(self, members: np.ndarray, home: np.ndarray | None = None) -> None:
        """Finds the links of pairs with at least one member of ``home`` (None: all) that are not in one tree yet."""
        home = members if home is None else home
        if len(members) <= LEAF or len(home) <= CELLS:
            return self.compare(members, home)
        # pivots far from one another; each measures all members
        pivots, near = [int(home[0])], []
        while True:
            near.append(self.measure(pivots[-1], members))
            closest = np.min(near, axis=0)
            if len(pivots) == CELLS or self._done(members):
                break
            pivots.append(int(members[int(np.argmax(closest))]))
        if self._done(members):
            return None
        near = np.array(near)
        cell = np.argmin(near, axis=0)
        is_home = np.isin(members, home)
        for j in range(len(pivots)):
            inner = (cell == j) & is_home
            window = near[j] <= near.min(axis=0) + 2 * self.reach  # a partner of an inner document lies here
            if not inner.any():
                continue
            if window.sum() > 0.8 * len(members):  # cells that don't part: distances to the pivots prune single pairs
                self.compare(members[window], members[inner], near[:, window], near[:, inner])
            else:
                self.join(members[window], members[inner])
        return None

    def compare(self, members: np.ndarray, home: np.ndarray, near: np.ndarray | None = None, home_near: np.ndarray | None = None) -> None:
        for k, p in enumerate(home):
            other = members != p if self.every else self.root[members] != self.root[p]
            small, large = np.minimum(self.n[members], self.n[p]), np.maximum(self.n[members], self.n[p])
            other &= self.den * small >= self.num * large
            if near is not None:
                other &= (np.abs(near - home_near[:, k : k + 1]) <= self.reach).all(axis=0)
            if other.any():
                self.measure(int(p), members[other])


def _joined(num: int, den: int, every: bool):
    """Joins one region: pairs with at least one set that is at home in it."""

    def run(table: pa.Table) -> pa.Table:
        uid = table.column("uid").to_numpy()
        home = table.column("home").to_numpy(zero_copy_only=False)
        order = np.lexsort((~home, uid))  # a set that came twice counts as at home if it is in one of them
        order = order[np.r_[True, np.diff(uid[order]) != 0]] if len(order) else order
        uid, home = uid[order], home[order]
        raw = table.column("tokens").to_pylist()
        region = Region(table.column("n").to_numpy()[order], [np.frombuffer(raw[i], np.uint64) for i in order], num, den, every, table.column("tree").to_numpy()[order])
        region.join(np.arange(len(uid)), np.flatnonzero(home))
        if every:
            pairs = np.array(sorted(region.links), np.int64).reshape(-1, 2)
            return pa.Table.from_arrays([pa.array(uid[pairs[:, 1]]), pa.array(uid[pairs[:, 0]])], names=["a", "b"])
        linked = np.flatnonzero(region.root != np.arange(len(uid)))
        return pa.Table.from_arrays([pa.array(uid[linked]), pa.array(uid[region.root[linked]])], names=["a", "b"])

    return run


_MEASURED = "region long, uid long, home boolean, tree long, links array<long>, mask int, own int, windows int"


def _measured(num: int, den: int):
    """Part of a region with all its pivots: each set's links with them, its Voronoi cell and the windows in which it lies."""

    def run(table: pa.Table) -> pa.Table:
        raw, size = table.column("tokens").to_pylist(), table.column("n").to_numpy()
        place = table.column("place").to_numpy()
        uid = table.column("uid").to_numpy()
        sets = Region(size, [np.frombuffer(t, np.uint64) for t in raw], num, den)
        pivots = np.flatnonzero(place >= 0)
        pivots = pivots[np.argsort(place[pivots])]
        members = np.flatnonzero(place < 0)
        both = np.stack([sets.overlap(int(p), members) for p in pivots])
        union = size[pivots][:, None] + size[members][None, :] - both
        linked = den * both >= num * union
        near = 1 - both / union
        window = near <= near.min(axis=0) + 2 * sets.reach
        bit = 1 << np.arange(len(pivots))
        links = [uid[pivots[column]].tolist() for column in linked.T]
        kept = table.take(pa.array(members))
        columns = [kept.column("region"), kept.column("uid"), kept.column("home"), kept.column("tree"), pa.array(links, pa.list_(pa.int64()))]
        columns += [pa.array(x.astype(np.int32)) for x in (bit @ linked, np.argmin(near, axis=0), bit @ window)]
        return pa.Table.from_arrays(columns, names=["region", "uid", "home", "tree", "links", "mask", "own", "windows"])

    return run


def _grown(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each region, the tree of each pivot: pivots that a set links with at once are in one."""
    for batch in batches:
        out = []
        for masks, pivots in zip(batch.column("masks").to_pylist(), batch.column("pivots").to_pylist(), strict=True):
            groups: list[int] = []
            for m in masks:
                apart = [g for g in groups if not g & m]
                groups = [*apart, sum(g for g in groups if g & m) | m] if m else groups
            out.append([next((pivots[(g & -g).bit_length() - 1] for g in groups if g >> j & 1), -1) for j in range(len(pivots))])
        yield pa.RecordBatch.from_arrays([batch.column("region"), pa.array(out, pa.list_(pa.int64()))], names=["region", "trees"])


def _bits(mask: str) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda j: F.col(mask).bitwiseAND(F.call_function("shiftleft", F.lit(1), j)) != 0)


def _dense(level: DataFrame, chosen: DataFrame, num: int, den: int, every: bool) -> tuple[DataFrame, DataFrame | None]:
    """Regions that a task can join (region, i, j, uid, home, tree) out of any regions (region, uid), and links found on the way.

    Each round parts the regions over ``REGION`` into the Voronoi cells of their pivots.
    """
    level = level.select("region", "uid", F.lit(True).alias("home"), F.lit(-1).cast("long").alias("tree"))
    ready, links, depth = None, None, 0
    zero = F.lit(0).cast("int")
    while True:
        counts = level.groupBy("region").agg(F.count(F.lit(1)).alias("c"))
        large = checkpoint(counts.filter(F.col("c") > REGION))
        done = large.isEmpty()
        small = level if done else level.join(_bounded(large.select("region")), "region", "left_anti")
        small = small.select("region", zero.alias("i"), zero.alias("j"), "uid", "home", "tree")
        ready = small if ready is None else ready.unionByName(small)
        if done:
            return ready, links
        depth += 1
        level = level.join(_bounded(large), "region")
        # pivots by hash, among the sets at home: one aggregate each, so that a region of any size is halved before the exchange
        drawn = [F.min(F.struct(F.xxhash64(F.lit(f"{depth}:{k}"), "uid").alias("h"), "uid")).getField("uid") for k in range(CELLS)]
        pivots = checkpoint(level.filter("home").groupBy("region", "c").agg(F.array_distinct(F.array(*drawn)).alias("pivots")))
        pieces = F.ceil(F.col("c") / REGION).cast("int")
        of_pivot = pivots.withColumn("s", F.explode(F.sequence(zero, pieces - 1))).select("region", "s", F.posexplode("pivots").alias("place", "uid"))
        of_pivot = of_pivot.withColumn("home", F.lit(True)).withColumn("tree", F.lit(-1).cast("long"))
        of_set = level.select("region", F.pmod(F.xxhash64(F.lit("piece"), "uid"), pieces).cast("int").alias("s"), F.lit(-1).alias("place"), "uid", "home", "tree")
        rows = of_set.unionByName(of_pivot).join(chosen.select("uid", "n", "tokens"), "uid")
        measured = checkpoint(rows.groupBy("region", "s").applyInArrow(_measured(num, den), _MEASURED))
        found = measured.select(F.explode("links").alias("b"), F.col("uid").alias("a")).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        links = found if links is None else links.unionByName(found)

        masks = measured.groupBy("region").agg(F.collect_set("mask").alias("masks")).join(pivots, "region")  # of 256 masks at most
        grown = masks.select("region", "masks", "pivots").mapInArrow(_grown, "region long, trees array<long>")
        grown = _bounded(checkpoint(grown.join(large, "region")))
        own_tree = F.when(F.col("mask") > 0, F.get("trees", F.array_min(_bits("mask")))).otherwise(F.col("tree"))
        measured = checkpoint(measured.join(grown, "region").withColumn("tree", own_tree).drop("trees", "links"))
        cells = measured.select("region", "c", "uid", "home", "tree", "own", F.explode(_bits("windows")).alias("cell")).withColumn("home", F.col("home") & (F.col("own") == F.col("cell")))
        about = [F.count(F.lit(1)).alias("n"), F.max("home").alias("any_home"), F.min("tree").alias("t0"), F.max("tree").alias("t1")]
        sizes = checkpoint(cells.groupBy("region", "c", "cell").agg(*about))
        one_tree = (F.col("t0") == F.col("t1")) & (F.col("t0") >= 0) if not every else F.lit(False)
        alive = sizes.filter(F.col("any_home") & ~one_tree)
        stuck = _bounded(checkpoint(alive.groupBy("region", "c").agg(F.max("n").alias("n")).filter(F.col("n") > PARTED * F.col("c")).select("region")))
        parted = alive.join(stuck, "region", "left_anti").select("region", "cell")
        whole = measured.join(stuck, "region", "left_semi")
        ready = ready.unionByName(_grid(whole.select("region", "uid", "home", "tree"), every))
        level = cells.join(_bounded(checkpoint(parted)), ["region", "cell"])
        level = checkpoint(level.select(F.xxhash64(F.lit(depth), "region", "cell").alias("region"), "uid", "home", "tree"))


def _grid(rows: DataFrame, every: bool) -> DataFrame:
    """Chunks of regions whose cells don't part: what is outside a region's largest tree meets all, the tree's sets don't meet one another."""
    half = max(1, REGION // 2)
    trees = rows.groupBy("region", "tree").agg(F.count(F.lit(1)).alias("k"))
    key = F.struct(F.when((F.col("tree") >= 0) & F.lit(not every), F.col("k")).otherwise(0).alias("k"), "tree")
    main = trees.groupBy("region").agg(F.max(key).alias("m"), F.sum("k").alias("c"))
    chunks = lambda n: F.ceil(n / half).cast("int")
    main = checkpoint(main.select("region", F.when(F.col("m.k") > 0, F.col("m.tree")).otherwise(-2).alias("main"), chunks(F.col("m.k")).alias("inside"), chunks(F.col("c") - F.col("m.k")).alias("outside")))
    x = rows.join(_bounded(main), "region").withColumn("in_main", F.col("tree") == F.col("main"))
    number = F.xxhash64(F.lit("chunk"), "uid")
    x = x.withColumn("x", F.when(F.col("in_main"), F.pmod(number, F.greatest("inside", F.lit(1)))).otherwise(F.col("inside") + F.pmod(number, F.greatest("outside", F.lit(1)))).cast("int"))
    other = F.when(F.col("in_main"), F.sequence(F.col("inside"), F.col("inside") + F.col("outside") - 1)).otherwise(F.sequence(F.lit(0), F.col("inside") + F.col("outside") - 1))
    x = x.filter("outside > 0").withColumn("y", F.explode(other))
    return x.select("region", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "uid", "home", "tree")


def _bounded(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _classes_and_links(docs: DataFrame, doc_id: str, text: str, n_words: int, num: int, den: int, every: bool, key: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets of all rows, their classes, and links between class representatives: all of them, or enough for the components.

    With ``key``, a long column, sets have it as ``key``, and classes have ``first``, the least (no id, doc_id, key) of their rows.
    """
    keys = [F.col(key).alias("key")] if key else []
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *keys)
    n_parts = shuffle_partitions(rows)
    sent = rows.mapInArrow(_sent(n_parts, n_words), "p int, batch long, meta binary, hashes binary, counts binary, owners binary")
    shared = sent.repartitionById(n_parts, "p").mapInArrow(_shared, "batch long, meta binary, hashes binary, counts binary, owners binary, df binary")
    sets = shared.groupBy("batch").applyInArrow(_assembled(num, den, bool(key)), "uid long, doc_id long, n long, s1 long, s2 long, prefix long, tokens binary" + (", key long" if key else ""))
    sets = checkpoint(sets)

    more = [F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first")] if key else []
    classes = sets.filter("n > 0").groupBy("s1", "s2").agg(F.min("uid").alias("rep"), F.min("doc_id").alias("least"), *more, F.count(F.lit(1)).alias("size"), F.max("prefix").alias("prefix"))
    reps = checkpoint(classes.filter("prefix > 0").select(F.col("rep").alias("uid")))
    chosen = sets.filter("tokens IS NOT NULL").join(_bounded(reps), "uid", "left_semi")
    tokens = checkpoint(chosen.select("uid", "prefix", "tokens").mapInArrow(_prefixes, "token long, uid long"))
    blocks = tokens.groupBy("token").agg(F.min("uid").alias("pivot"), F.max("uid").alias("last"), F.count(F.lit(1)).alias("c")).filter("pivot <> last").select("token", "pivot", "c")
    members = checkpoint(skew_join(tokens, checkpoint(blocks), ["token"], "c", "inner").select(F.col("pivot").alias("region"), "uid").distinct())
    regions, on_the_way = _dense(members, chosen, num, den, every)
    regions = regions.join(chosen.select("uid", "n", "tokens"), "uid")
    links = regions.groupBy("region", "i", "j").applyInArrow(_joined(num, den, every), "a long, b long")
    return sets, classes, links if on_the_way is None else links.unionByName(on_the_way)


def jaccard_join(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, class_size (rows with the same set), component_id.

    A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; a document's set is its distinct ``n_words``-word shingles, or
    its whole word sequence if shorter; a text that is null or has no words has an empty set and links with nothing. Rows
    link when den * |A and B| >= num * |A or B|; component_id is the smallest doc_id reachable by links, null ids
    aside. Repeated rows and equal texts link as any rows do. An empty table gives an empty result; other columns are ignored.
    Words and shingles are
    compared by 64-bit hashes.
    """
    sets, classes, links = _classes_and_links(docs, doc_id, text, n_words, num, den, every=False)
    roots = components(links)

    found = checkpoint(classes.join(roots, F.col("rep") == F.col("node"), "left").select("s1", "s2", "least", "size", F.coalesce("root", "rep").alias("root")))
    best = found.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("size").alias("rows"), F.count(F.lit(1)).alias("c")).filter(F.col("rows") > 1)
    known = checkpoint(skew_join(found, checkpoint(best), ["root"], "c", "inner").select("s1", "s2", "size", "component_id"))
    return _with_class(sets, known, "size").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("size", F.lit(1).cast("long")).alias("class_size"),
        F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _with_class(sets: DataFrame, known: DataFrame, size: str) -> DataFrame:
    """Rows with what is known of their class; those with an empty set, which may be many, have none and aren't shuffled."""
    slim = sets.drop("tokens", "prefix")
    joined = skew_join(slim.filter("n > 0"), known, ["s1", "s2"], size, "left")
    empty = slim.filter("n = 0").select(*slim.columns, *[F.lit(None).cast(known.schema[c].dataType).alias(c) for c in known.columns if c not in ("s1", "s2")])
    return joined.unionByName(empty)


def jaccard_links(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR
) -> tuple[DataFrame, DataFrame]:
    """All links: pairs (a, b) of class numbers, a > b, each once, and membership (doc_id, class, class_size, n_links), a row per input row.

    A class is the rows with one set; its rows all link with one another and are not expanded. n_links counts the rows that a row links with.
    """
    sets, classes, links = _classes_and_links(docs, doc_id, text, n_words, num, den, every=True)
    pairs = checkpoint(links.distinct())
    size = classes.select(F.col("rep").alias("b"), "size")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = both.join(size, "b").groupBy("a").agg(F.sum("size").alias("more"))
    known = checkpoint(classes.select("s1", "s2", "rep", "size").join(more, F.col("rep") == F.col("a"), "left").drop("a"))
    member = _with_class(sets, known, "size")
    n_links = F.when(F.col("n") > 0, F.col("size") - 1 + F.coalesce("more", F.lit(0))).otherwise(0)
    return pairs, member.select("doc_id", F.coalesce("rep", "uid").alias("class"), F.coalesce("size", F.lit(1).cast("long")).alias("class_size"), n_links.alias("n_links"))


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """One row of each component of ``jaccard_join``, that with the smallest doc_id, with all its columns, whatever their names.

    Decided by row: rows of one doc_id with different texts stay or go each for itself. In a component rows without a doc_id come last, and of
    rows with one doc_id that with the smallest text hash is taken. Of rows that repeat doc_id and text one stays. Rows without words (null
    and empty texts among them) link with nothing; of them only repeats of a doc_id go. Long texts count whole. An empty table
    gives an empty table. Texts stay where they are while the rows that go are few enough to be broadcast (``BROADCAST_IDS``).
    """
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), key.alias("key"))
    sets, classes, links = _classes_and_links(rows, "doc_id", "text", options.get("n_words", WORDS), options.get("num", NUMERATOR), options.get("den", DENOMINATOR), every=False, key="key")
    roots = components(links)
    known = checkpoint(classes.join(roots, F.col("rep") == F.col("node"), "left").select("s1", "s2", F.coalesce("root", "rep").alias("root"), "first", "size"))
    best = known.groupBy("root").agg(F.min("first").alias("best"), F.sum("size").alias("rows"), F.count(F.lit(1)).alias("c")).filter(F.col("rows") > 1)
    of_class = checkpoint(skew_join(known, checkpoint(best), ["root"], "c", "inner").select("s1", "s2", "size", "best"))
    slim = sets.select("doc_id", "key", "n", "s1", "s2")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    decided = checkpoint(skew_join(slim.filter("n > 0"), of_class, ["s1", "s2"], "size", "inner").select("doc_id", "key", (first == F.col("best")).alias("stays")))
    id_, key_, alone_, gone_id, gone_key = free_names(docs, "id", "key", "alone", "gone_id", "gone_key")

    def there(found: DataFrame) -> tuple[DataFrame, Column]:
        named = found.select(F.col("doc_id").alias(gone_id), F.col("key").alias(gone_key))
        return _bounded(checkpoint(named)), F.col(id_).eqNullSafe(F.col(gone_id)) & (F.col(key_) == F.col(gone_key))

    left = docs.withColumn(id_, F.col(doc_id).cast("long")).withColumn(key_, key)
    left = left.join(*there(decided.filter("NOT stays").select("doc_id", "key").distinct()), "left_anti")
    # rows without an id and without words link with nothing, so that they are no repeats
    repeats = slim.filter("doc_id IS NOT NULL OR n > 0").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    repeats = checkpoint(repeats.select("doc_id", "key"))
    if not repeats.isEmpty():
        seen = there(repeats)
        alone = F.when(F.col(id_).isNull() & ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]"), F.monotonically_increasing_id())
        once = left.join(*seen, "left_semi").withColumn(alone_, alone).dropDuplicates([id_, key_, alone_]).drop(alone_)
        left = left.join(*seen, "left_anti").unionByName(once)
    return left.drop(id_, key_)
