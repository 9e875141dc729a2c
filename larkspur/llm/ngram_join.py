"""N-gram Jaccard self-join by prefix trees, and the classes of near duplicates it links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, frugal, frugal_group, materialize, release, text_bytes, whole
from .shingles import WIDTH, shingle_sets

#: Two sets are linked if 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Shingles gathered before a chunk is sent off.
CHUNK = 1 << 20


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a batch's texts end to end, and where each starts."""
    texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    from .tokens import slices

    for batch in batches:
        for rows in slices(batch):
            yield rows, *shingle_sets(*_texts(rows), width)


def _identity(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


_SENT = "part int, chunk long, docs binary, sizes binary, marks binary, tokens binary, owners binary"
#: One document of a chunk on its way: id, whether it has none, and a hash of its text that tells apart rows that repeat an id.
_DOC = np.dtype([("id", "<i8"), ("none", "u1"), ("fit", "<i8")])


def _send(chunk: int, parts: int, docs: np.ndarray, sizes: list[int], marks: list[bytes], hashes: list[np.ndarray]) -> pa.RecordBatch:
    """One row a partition with the chunk's shingles there: those of one set with their owner, those of more once, unowned.

    The chunk's documents ride along on one of the rows.
    """
    h = np.concatenate(hashes)
    owner = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = h[1:] != h[:-1]
    again = np.zeros(len(h), dtype=bool)
    again[:-1] = ~first[1:]
    owner[again] = 0xFFFFFFFF
    h, owner = h[first], owner[first]
    part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cuts = np.searchsorted(part, np.arange(parts + 1))
    token = (((h >> np.uint64(32)) * np.uint64(parts)) & np.uint64(0xFFFFFFFF)).astype(np.uint32) ^ (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    home = chunk % parts
    columns: list[list] = [[], [], [], [], [], [], []]
    for p in range(parts):
        a, b = cuts[p], cuts[p + 1]
        at_home = p == home
        for column, value in zip(columns, (p, chunk, docs.tobytes() if at_home else None, np.array(sizes, dtype=np.uint32).tobytes() if at_home else len(sizes).to_bytes(4, "little"), b"".join(marks) if at_home else None, token[a:b].tobytes(), owner[a:b].tobytes())):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[2:])], names=[x.split()[0] for x in _SENT.split(", ")])


def _single(table: pa.Table) -> pa.Table:
    """For each chunk the count of shingles that no other set of any chunk has, by document."""
    tokens, owners = ([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column(c)] for c in ("tokens", "owners"))
    docs, sizes = table.column("docs"), table.column("sizes")
    t = np.concatenate(tokens) if tokens else np.zeros(0, np.uint32)
    tokens.clear()
    order = np.argsort(t).astype(np.uint32)
    t = t[order]
    alone = np.ones(len(t), dtype=bool)
    alone[1:] &= t[1:] != t[:-1]
    alone[:-1] &= t[1:] != t[:-1]
    single = np.zeros(len(t), dtype=bool)
    single[order] = alone
    del order, t, alone
    out, at = [], 0
    for k, own in enumerate(owners):
        here = docs[k].is_valid
        n = len(sizes[k].as_buffer()) // 4 if here else int.from_bytes(sizes[k].as_py(), "little")
        mine = own[single[at : at + len(own)]]
        at += len(own)
        out.append(np.bincount(mine[mine != 0xFFFFFFFF], minlength=n).astype(np.uint32).tobytes())
    keep = [sizes[k].as_py() if docs[k].is_valid else None for k in range(len(out))]
    return pa.table({"chunk": table.column("chunk"), "docs": docs, "sizes": pa.array(keep, pa.binary()), "marks": table.column("marks"), "single": pa.array(out, pa.binary())})


def _sum(table: pa.Table) -> pa.Table:
    """The documents of one chunk with their counts from all partitions added up."""
    total = np.sum([np.frombuffer(x, np.uint32).astype(np.int64) for x in table.column("single").to_pylist()], axis=0)
    k = next(i for i, d in enumerate(table.column("docs")) if d.is_valid)
    marks = table.column("marks")[k].as_py()
    docs = np.frombuffer(table.column("docs")[k].as_py(), _DOC)
    return pa.table({"id": pa.array(docs["id"].copy(), mask=docs["none"].astype(bool)), "fit": pa.array(docs["fit"].copy()), "n": pa.array(np.frombuffer(table.column("sizes")[k].as_py(), np.uint32).astype(np.int64)), "mark": pa.array([marks[i : i + 16] for i in range(0, len(marks), 16)], pa.binary()), "single": pa.array(total)})


def _counted(sent: DataFrame) -> DataFrame:
    replies = sent.groupBy("part").applyInArrow(frugal_group(_single), "chunk long, docs binary, sizes binary, marks binary, single binary")
    return replies.groupBy("chunk").applyInArrow(frugal_group(_sum), "id long, fit long, n long, mark binary, single long")


def _chunks(sets: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """Sets gathered into chunks and sent; a chunk's number is unique in the job."""
    base, turn = TaskContext.get().partitionId() << 32, 0
    docs, sizes, marks, hashes, held = [], [], [], [], 0
    for which, h, bounds in sets:
        docs.append(which)
        hashes.append(h)
        for i in range(len(which)):
            mine = h[bounds[i] : bounds[i + 1]]
            sizes.append(len(mine))
            marks.append(_identity(mine))
        held += len(h)
        if held >= CHUNK:
            yield _send(base + turn, parts, np.concatenate(docs), sizes, marks, hashes)
            docs, sizes, marks, hashes, held, turn = [], [], [], [], 0, turn + 1
    if sizes:
        yield _send(base + turn, parts, np.concatenate(docs), sizes, marks, hashes)


def _docs(id_: pa.Array, fit: pa.Array | None = None) -> np.ndarray:
    out = np.zeros(len(id_), dtype=_DOC)
    out["id"] = np.asarray(id_.fill_null(0))
    out["none"] = np.asarray(id_.is_null().cast(pa.uint8()))
    if fit is not None:
        out["fit"] = np.asarray(fit)
    return out


#: Tokens of one node of the tree at most, so that a long unbranched path can be left halfway.
RUN = 64


class Trie:
    """Sets of integers in a global order as paths of a prefix tree, for overlap searches that share common beginnings.

    A stretch without branches is one node of up to RUN tokens. The tree is kept level by level in arrays: each node's
    tokens, parent, depth, and the least and greatest size of the sets below.
    """

    def __init__(self, sets: list[np.ndarray], vocabulary: int):
        """sets: each in the global order, as ranks below `vocabulary` that ascend."""
        self.mine = np.zeros(vocabulary, dtype=bool)
        keys = [s.astype(">i4").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=keys.__getitem__)
        begin, end, source, up, members = [0], [0], [0], [-1], {}
        stack = [0]

        def node(a: int, b: int, of: int, parent: int) -> int:
            begin.append(a)
            end.append(b)
            source.append(of)
            up.append(parent)
            return len(up) - 1

        for k, i in enumerate(order):
            size, shared = len(sets[i]), 0
            if k:
                before = sets[order[k - 1]]
                m = min(size, len(before))
                differ = np.flatnonzero(sets[i][:m] != before[:m])
                shared = int(differ[0]) if len(differ) else m
            last = 0
            while end[stack[-1]] > shared:
                last = stack.pop()
            if end[stack[-1]] < shared:
                fork = node(end[stack[-1]], shared, source[last], stack[-1])
                begin[last], up[last] = shared, fork
                stack.append(fork)
            if size > shared:
                stack.append(node(shared, size, i, stack[-1]))
            members.setdefault(stack[-1], []).append(i)
        for x in range(1, len(up)):  # long nodes become chains
            while end[x] - begin[x] > RUN:
                up[x] = node(begin[x], begin[x] + RUN, source[x], up[x])
                begin[x] += RUN
        low, high = [1 << 60] * len(up), [-1] * len(up)
        depth = [-1] * len(up)
        depth[0] = 0
        for x in range(len(up)):
            path = []
            while depth[x] < 0:
                path.append(x)
                x = up[x]
            for y in reversed(path):
                depth[y] = depth[up[y]] + 1
        by_depth = sorted(range(len(up)), key=depth.__getitem__)
        for x in reversed(by_depth):
            if x in members:
                low[x], high[x] = min(low[x], end[x]), max(high[x], end[x])
            if x:
                low[up[x]], high[up[x]] = min(low[up[x]], low[x]), max(high[up[x]], high[x])
        place = {x: k for k, x in enumerate(by_depth)}
        spans = [sets[source[x]][begin[x] : end[x]] for x in by_depth]
        lengths = np.array([len(t) for t in spans], dtype=np.int64)
        self.tokens = np.concatenate(spans) if len(sets) else np.zeros(0, np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.parent = np.array([place.get(up[x], 0) for x in by_depth], dtype=np.int64)
        self.low, self.high, self.deep = (np.array([v[x] for x in by_depth], dtype=np.int64) for v in (low, high, end))
        at = np.array([depth[x] for x in by_depth])
        self.levels = np.searchsorted(at, np.arange(1, int(at[-1]) + 2))
        held = [(place[x], i) for x, mine in members.items() for i in mine]
        held.sort()
        self.holder, self.member = (np.array([h[k] for h in held], dtype=np.int64) for k in (0, 1))

    def search(self, probe: np.ndarray, percent: int) -> np.ndarray:
        """Members linked with the probe. A subtree is left when the shingles still to come, on its longest path or in the
        probe, can't lift the overlap that all its paths share to what the shortest of them needs."""
        n = len(probe)
        self.mine[probe] = True
        alive, overlap = np.zeros(len(self.parent), dtype=bool), np.zeros(len(self.parent), dtype=np.int64)
        alive[0] = True
        least = -(-percent * n // 100)
        for a, b in zip(self.levels, self.levels[1:]):
            keep = a + np.flatnonzero(alive[self.parent[a:b]])
            if not len(keep):
                break
            long = self.ends[keep] - self.starts[keep]
            first = np.cumsum(long) - long
            which = np.repeat(self.starts[keep] - first, long) + np.arange(int(long.sum()))
            have = overlap[self.parent[keep]] + np.add.reduceat(self.mine[self.tokens[which]].astype(np.int64), first)
            lo, hi = self.low[keep], self.high[keep]
            need = -(-percent * (n + np.maximum(lo, least)) // (100 + percent))
            to_come = np.minimum(hi - self.deep[keep], n - np.searchsorted(probe, self.tokens[self.ends[keep] - 1], side="right"))
            alive[keep] = (100 * n >= percent * lo) & (hi >= least) & (have + to_come >= need)
            overlap[keep] = have
        self.mine[probe] = False
        have, size = overlap[self.holder], self.deep[self.holder]
        return self.member[alive[self.holder] & (100 * have >= percent * (n + size - have))]


def join_block(nodes: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT, probes: int | None = None) -> list[tuple[int, int]]:
    """(node, root) for nodes that links within the block connect; the root is the smallest node reached.

    All sets go into one prefix tree, rarest shingles first. Each set in turn that nothing reaches yet is searched, which
    settles groups of copies in few searches. If several classes are left, each set outside the largest is searched too, so
    no link is lost. probes: if given, the first so many sets are searched, and only their links are wanted.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), dtype=np.int32)
    rank[np.lexsort((values, times))] = np.arange(len(values))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    ranked = rank[inverse]
    del values, inverse, times
    ordered = [np.sort(ranked[a:b]) for a, b in zip(bounds, bounds[1:])]
    trie = Trie(ordered, len(rank))
    label = np.arange(m)
    reached = np.zeros(m, dtype=bool)
    searched = np.zeros(m, dtype=bool)

    def search(i: int) -> None:
        linked = np.append(trie.search(ordered[i], percent), i)
        reached[linked] = searched[i] = True
        found = np.unique(label[linked])
        if len(found) > 1:
            label[np.isin(label, found)] = found[0]

    for i in range(m if probes is None else probes):
        if probes is not None or not reached[i]:
            search(i)
    if probes is None:
        classes, counts = np.unique(label, return_counts=True)
        for i in np.flatnonzero((label != classes[np.argmax(counts)]) & ~searched) if len(classes) > 1 else ():
            search(i)
    order = np.lexsort((nodes, label))
    first = np.ones(m, dtype=bool)
    first[1:] = label[order][1:] != label[order][:-1]
    root = nodes[order][first][np.cumsum(first) - 1]
    other = nodes[order] != root
    return list(zip(nodes[order][other].tolist(), root[other].tolist()))


#: Up to so many edges are finished in one task of an executor; more are contracted by rounds over the cluster first.
FEW_EDGES = 300_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): the smallest node reachable.

    Alternates linking larger and smaller neighbours to the least one until all groups are stars; each round works on the edge
    table in the cluster, minima are pre-aggregated, and neither links nor components reach the driver.
    """
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while now.count() > FEW_EDGES:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        release(now)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = materialize(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(large)
        # done when each node has one edge and no root has one: all are stars then
        if now.groupBy("u").count().where("count > 1").isEmpty() and now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    return now.coalesce(1).mapInArrow(frugal(_forest), "node long, root long")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of a bounded number of edges, by union-find."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "root"])


#: Cells of the table of rough counts (a byte each when sent to the tasks), and shingles that one task of the join holds.
CELLS, BLOCK_SHINGLES = 1 << 22, 1_000_000
_SEGMENTS = 64


def _rough_counts(sets: DataFrame) -> np.ndarray:
    """For each cell (the top bits of a shingle) the logarithm of how often its shingles occur, in CELLS bytes whatever the input.

    A task sends only the cells it has met, so what is shuffled is no more than the sets themselves.
    """
    each = CELLS // _SEGMENTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.uint32)
        for batch in batches:
            for x in batch.column("tokens").to_pylist():
                np.add.at(total, (np.frombuffer(x, np.uint64) >> np.uint64(42)).astype(np.int64), 1)
        met = np.flatnonzero(total).astype(np.uint32)
        cuts = np.searchsorted(met, np.arange(_SEGMENTS + 1) * each)
        rows = [(k, met[a:b].tobytes(), total[met[a:b]].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[c] for r in rows], pa.binary()) for c in (1, 2))], names=["segment", "cells", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cells, counts in zip(*(batch.column(c).to_pylist() for c in ("segment", "cells", "counts"))):
                sums.setdefault(k, np.zeros(each, dtype=np.int64))[np.frombuffer(cells, np.uint32) - k * each] += np.frombuffer(counts, np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.log2(v + 1).astype(np.uint8).tobytes() for v in sums.values()], pa.binary())], names=["segment", "counts"])

    summed = sets.select("tokens").mapInArrow(frugal(count), "segment int, cells binary, counts binary").repartition(_SEGMENTS, "segment").mapInArrow(add, "segment int, counts binary")
    out = np.zeros(CELLS, dtype=np.uint8)
    for r in summed.collect():
        out[r["segment"] * each : (r["segment"] + 1) * each] = np.frombuffer(r["counts"], np.uint8)
    return out


def _members(sets: DataFrame, percent: int) -> DataFrame:
    """(node, hub, n): sets that may be linked meet at a hub, the least node that has a shingle of both their prefixes.

    A set's prefix has so many of its rarest shingles that two linked sets share one of them (order: rough count, then
    hash); so both are members of that shingle's hub. A hub's group reaches one step only: groups overlap, but don't chain.
    """
    code = sets.sparkSession.sparkContext.broadcast(_rough_counts(sets))

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, tokens, sizes = [], [], []
            for node, x in zip(batch.column("node").to_pylist(), batch.column("tokens").to_pylist()):
                h = np.frombuffer(x, np.uint64)
                n = len(h)
                keep = n - -(-percent * n // 100) + 1
                h = h[np.lexsort((h, code.value[(h >> np.uint64(42)).astype(np.int64)]))][:keep]
                nodes.append(np.full(len(h), node))
                sizes.append(np.full(len(h), n))
                tokens.append(h.view(np.int64))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (nodes, tokens, sizes)], names=["node", "token", "n"])

    rows = materialize(sets.mapInArrow(frugal(prefix), "node long, token long, n long"), "prefixes", "snappy")
    hubs = rows.groupBy("token").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("token", "hub")
    hubs = materialize(hubs, "hubs")  # a written side, so that adaptive execution can split the rows of a hot shingle
    out = materialize(rows.join(hubs, "token").select("node", "hub", "n").distinct(), "members")
    release(rows, hubs)
    return out


def _band(n: str, percent: int) -> Column:
    """Two linked sets are in the same or in neighbouring bands of sizes."""
    return F.floor(F.log(F.col(n).cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")


def _joined(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b) links that connect what is linked among the members of each hub.

    Small groups are bundled. One with more than BLOCK_SHINGLES shingles is dealt by bands of set sizes and then by hash
    into blocks, and its hub joins each of them: a large group of near copies is connected through its hub at once. What
    is not connected with its hub by then is searched in the blocks of its own and the neighbouring bands, so no link is
    lost, no task gets an unbounded group, and blocks don't meet in pairs.
    """
    weight = members.groupBy("hub").agg(F.sum("n").alias("weight"))
    heavy = materialize(weight.where(F.col("weight") > BLOCK_SHINGLES).select("hub"), "heavy")
    total = members.agg(F.sum("n")).first()[0] or 0
    bundles = max(1, -(-total // (BLOCK_SHINGLES // 2)))
    light = members.join(heavy, "hub", "left_anti").select("node", F.pmod(F.xxhash64("hub"), F.lit(bundles)).cast("long").alias("g"), F.lit(-1).alias("band"), F.lit(-1).alias("sub"), "hub", F.lit(False).alias("probe"))
    if heavy.isEmpty():
        return _run(sets, light, percent)
    large = members.join(heavy, "hub").withColumn("band", _band("n", percent))
    slots = materialize(large.groupBy("hub", "band").agg(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).cast("int").alias("subs")), "slots")
    placed = large.join(slots, ["hub", "band"]).select("node", F.col("hub").alias("g"), "band", F.pmod(F.xxhash64("node"), F.col("subs")).cast("int").alias("sub"), "hub", F.lit(False).alias("probe"))
    everywhere = slots.select(F.col("hub").alias("node"), F.col("hub").alias("g"), "band", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), "hub", F.lit(False).alias("probe"))
    first = materialize(_run(sets, light.unionByName(placed).unionByName(everywhere), percent), "links")
    label = materialize(components(first), "labels")
    of = lambda c, name: label.select(F.col("node").alias(c), F.col("root").alias(name))
    apart = large.join(of("node", "own"), "node", "left").join(of("hub", "its"), "hub", "left").where(F.coalesce("own", "node") != F.coalesce("its", "hub")).select("node", "hub", "band")
    near = apart.select("node", "hub", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"))
    asked = near.join(slots, ["hub", "band"]).select("node", F.col("hub").alias("g"), "band", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), "hub", F.lit(True).alias("probe"))
    met = asked.select("g", "band", "sub").distinct()
    again = placed.join(met, ["g", "band", "sub"], "left_semi").unionByName(asked)
    return first.unionByName(_run(sets, again, percent))


def _run(sets: DataFrame, tasks: DataFrame, percent: int) -> DataFrame:
    """Links within each group of each task; a group with probes is searched for their links only."""

    def run(table: pa.Table) -> pa.Table:
        hub, node, probe = (np.asarray(table.column(c)) for c in ("hub", "node", "probe"))
        tokens = table.column("tokens")
        order = np.lexsort((~probe, node, hub))
        left, right = [], []
        edges = [0, *(np.flatnonzero(np.diff(hub[order])) + 1).tolist(), len(order)]
        for a, b in zip(edges, edges[1:]):
            mine = order[a:b]
            mine = mine[np.concatenate([[True], np.diff(node[mine]) != 0])] if len(mine) else mine
            mine = mine[np.argsort(~probe[mine], kind="stable")]
            asked = int(probe[mine].sum())
            for x, y in join_block(node[mine], [np.frombuffer(tokens[int(i)].as_buffer(), np.uint64) for i in mine], percent, asked or None):
                left.append(x)
                right.append(y)
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    dealt = tasks.join(sets.select("node", "tokens"), "node").select("g", "band", "sub", "node", "hub", "probe", "tokens")
    return dealt.groupBy("g", "band", "sub").applyInArrow(frugal_group(run), "a long, b long")


#: Bytes of text whose shingles meet in one partition of the count.
PART_BYTES = 16 << 20


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, fit, stays) for every row of docs.

    1. Each shingle is sent once a chunk to the partition of its hash, which answers how many of each set no other set
    has. More than the part that may differ: the set is linked with nothing, and done. The number of partitions follows
    the bytes of text, so none grows with the input. 2. Equal sets become one class. 3. Sets of the classes left are joined
    within the groups of hubs, each a prefix tree. 4. Classes that links connect get the smallest doc_id of their rows.

    fit is a hash of the text; stays marks the one text of a component that has the smallest (doc_id, fit), and what is
    alone. Null, empty and blank texts have no shingles and are linked with nothing: they are their own component. A null
    doc_id never becomes a component's id unless all its rows have none. Rows that repeat an id are separate texts; rows that
    repeat both id and text stay or go together. Extra columns are ignored; an empty table gives no rows. Shingles are
    compared as 64-bit hashes.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text")).select("id", "text", F.xxhash64("text").alias("fit"))
    parts = max(8, -(-text_bytes(docs, text_col) // PART_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _chunks(((_docs(b.column("id"), b.column("fit")), h, at) for b, h, at in _sets(batches, width)), parts)

    counted = materialize(_counted(rows.mapInArrow(frugal(send), _SENT)), "counted")
    spare = 100 - percent
    open_ = counted.where((F.col("n") > 0) & (100 * F.col("single") <= spare * F.col("n")))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fit"))
    classes = open_.groupBy("mark").agg(least.alias("first"))
    classes = materialize(classes.select("mark", "first.id", "first.fit", F.monotonically_increasing_id().alias("node")), "classes")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, h, at in _sets(batches, width):
            found: list[list] = [[], [], []]
            for i, (mark, node) in enumerate(zip(b.column("mark").to_pylist(), b.column("node").to_pylist())):
                mine = h[at[i] : at[i + 1]]
                if _identity(mine) == mark:
                    for column, value in zip(found, (node, len(mine), mine.tobytes())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.binary())], names=["node", "n", "tokens"])

    # rows that repeat both id and text match a class each: one of them is enough
    key = classes.select(F.col("id").alias("i"), F.col("fit").alias("f"), "mark", "node")
    texts = rows.join(key.hint("merge"), F.col("id").eqNullSafe(F.col("i")) & (F.col("fit") == F.col("f")))
    found = materialize(texts.select("text", "mark", "node").mapInArrow(frugal(extract), "node long, n long, tokens binary"), "found", "snappy")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for b in batches:
                x = b.column("tokens").to_pylist()
                yield _docs(b.column("node")), np.frombuffer(b"".join(x), np.uint64), np.concatenate([[0], np.cumsum([len(t) // 8 for t in x])])

        yield from _chunks(each(), parts)

    unique = found.dropDuplicates(["node"])
    sent = materialize(unique, "sets", "snappy")
    release(found)
    left = _counted(sent.mapInArrow(frugal(again), _SENT)).where(100 * F.col("single") <= spare * F.col("n")).select(F.col("id").alias("node"))
    sets = materialize(sent.join(left, "node", "left_semi"), "sets", "snappy")
    release(sent)
    links = materialize(_joined(sets, _members(sets, percent), percent), "links")
    release(sets)
    linked = components(links)
    named = classes.join(linked, "node", "left").select("mark", "id", "fit", F.coalesce("root", "node").alias("root"))
    smallest = named.groupBy("root").agg(least.alias("least"))
    of = materialize(named.join(smallest, "root").select("mark", F.col("least.id").alias("component_id"), F.col("least.fit").alias("chosen"), F.lit(True).alias("known")), "classes-of")
    out = counted.join(of, "mark", "left")
    stays = F.when(F.col("known"), F.col("id").eqNullSafe(F.col("component_id")) & (F.col("fit") == F.col("chosen"))).otherwise(F.lit(True))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "fit", stays.alias("stays"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
