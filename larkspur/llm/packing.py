"""Best-fit packing of documents into sequences by linear grouping."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, frugal, gapless_rank, materialize, whole
from .tokens import ENCODED, END_ID, default_tokenizer, slices, token_rows

CAPACITY = 1024
#: Groups of large lengths, and the least length that counts as large, as a share of the capacity; of the plans by these the
#: one with the fewest sequences is taken. Many groups, as rounding up costs room; large ones meet in pairs by the second.
TRIED = ((512, 0.5), (512, 0.34))


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(items of each size in a sequence, whole times it is used) of a near-optimal fractional cover of the demand.

    The linear program over configurations is solved by generating columns: the duals price the sizes, a knapsack over
    the capacity finds the best configuration, and one pivot brings it in, for at most so many rounds. Times are rounded down.
    """
    k = len(sizes)
    if not k:
        return []
    columns = np.zeros((k, k))
    np.fill_diagonal(columns, [capacity // s for s in sizes])
    inverse = np.diag(1 / np.diag(columns))
    times = np.diag(inverse) * np.array(demand, dtype=float)
    for _ in range(rounds):
        price = inverse.sum(axis=0)
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for j, s in enumerate(sizes):
            if price[j] <= 1e-12:
                continue
            for _ in range(capacity // s):  # each pass allows one more item of this size
                gain = best[:-s] + price[j]
                better = gain > best[s:] + 1e-12
                if not better.any():
                    break
                best[s:] = np.where(better, gain, best[s:])
                choice[s:][better] = j
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        while room > 0 and choice[room] >= 0:
            column[choice[room]] += 1
            room -= sizes[choice[room]]
        if (price * column).sum() <= 1 + 1e-9:
            break
        move = (inverse * column).sum(axis=1)  # no BLAS: its threads may hang in a process that also holds a JVM gateway
        ratio = np.where(move > 1e-9, times / np.where(move > 1e-9, move, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        times = np.maximum(times - step * move, 0)
        times[out] = step
        columns[:, out] = column
        inverse[out] /= move[out]
        move[out] = 0
        inverse -= move[:, None] * inverse[out]
    whole_times = np.floor(times + 1e-6).astype(np.int64)
    return [(columns[:, j].astype(np.int64), int(n)) for j, n in enumerate(whole_times) if n > 0]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = TRIED[0][0], large: float = TRIED[0][1]) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, count, first sequence, offset) that place `counts` items of each length, and the sequences used.

    The input is a histogram, so time and memory depend on the capacity, not on the number of documents. Large lengths
    are sorted and cut into groups of equal cardinality, each rounded up to its largest; configurations of these few sizes
    are optimised; actual lengths take the rounded places; what rounding down left over, and small lengths, go best-fit
    (longest first, into the fullest sequence that still has room).
    """
    left = {length: n for length, n in counts.items() if n}
    taken = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    used = left.pop(capacity, 0)
    if used:
        runs.append((capacity, 0, used, 0, 0))
    room: dict[int, list[list[int]]] = {}
    rooms: list[int] = []

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, taken[length], n, sequence, offset))
        taken[length] += n
        left[length] -= n

    def keep(space: int, sequence: int, n: int) -> None:
        if space and n:
            if space not in room:
                room[space] = []
                insort(rooms, space)
            room[space].append([sequence, n])

    big = [(length, left[length]) for length in sorted(left, reverse=True) if length > capacity * large]
    total = sum(n for _, n in big)
    each = max(1, -(-total // groups))
    lists: list[list[list[int]]] = []
    filled = each
    for length, n in big:
        while n:
            if filled == each:
                lists.append([])
                filled = 0
            m = min(n, each - filled)
            lists[-1].append([length, m])
            n, filled = n - m, filled + m
    merged: list[list[list[int]]] = []
    for runs_of in lists:  # groups with the same largest length are one size
        if merged and merged[-1][0][0] == runs_of[0][0]:
            merged[-1] += runs_of
        else:
            merged.append(runs_of)
    sizes, demand = [g[0][0] for g in merged], [sum(n for _, n in g) for g in merged]
    for pattern, times in configurations(sizes, demand, capacity):
        times = min([times, *(sum(n for _, n in merged[g]) // int(a) for g, a in enumerate(pattern) if a)])
        if not times:
            continue
        slots = []
        for g in np.flatnonzero(pattern):
            for _ in range(int(pattern[g])):
                slot, need = [], times
                while need:
                    length, n = merged[g][0]
                    m = min(n, need)
                    slot.append([length, m])
                    need -= m
                    if m == n:
                        merged[g].pop(0)
                    else:
                        merged[g][0][1] -= m
                slots.append(slot)
        done = 0
        while done < times:
            n = min(s[0][1] for s in slots)
            offset = 0
            for s in slots:
                put(s[0][0], n, used + done, offset)
                offset += s[0][0]
                s[0][1] -= n
                if not s[0][1]:
                    s.pop(0)
            keep(capacity - offset, used + done, n)
            done += n
        used += times
    for length in sorted(left, reverse=True):
        while (n := left[length]) > 0:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                space = rooms[at]
                sequence, bins = room[space].pop()
                if not room[space]:
                    del room[space]
                    rooms.pop(at)
            else:
                space, sequence = capacity, used
                bins = -(-n // (capacity // length))
                used += bins
            fit = space // length
            full = min(bins, n // fit)
            for i in range(fit if full else 0):
                put(length, full, sequence, capacity - space + i * length)
            keep(space - fit * length, sequence, full)
            rest = n - full * fit
            if full < bins and rest:
                rest = min(rest, fit)
                for i in range(rest):
                    put(length, 1, sequence + full, capacity - space + i * length)
                keep(space - rest * length, sequence + full, 1)
                full += 1
            if full < bins:
                keep(space, sequence + full, bins - full)
    return np.array(runs, dtype=np.int64).reshape(-1, 5), used


def best_plan(counts: dict[int, int], capacity: int = CAPACITY, tried: tuple[tuple[int, float], ...] = TRIED) -> tuple[np.ndarray, int]:
    """The plan() with the fewest sequences; the first of equals."""
    return min((plan(counts, capacity, *t) for t in tried), key=lambda p: p[1])


def cut(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids with the end id; longer ones cut, the short piece first."""
    path = path or default_tokenizer()
    bounded_batches(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, most=ENCODED):
                ids, bounds = token_rows(rows.column("text").to_pylist(), path, end_id)
                n = np.diff(bounds)
                pieces_of = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces_of)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces_of) - pieces_of, pieces_of)
                first = (n - (pieces_of - 1) * capacity)[doc]
                start = np.where(piece > 0, first + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first)
                view, at = memoryview(ids).cast("B"), 4 * (bounds[doc] + start)
                crc = [zlib.crc32(view[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    return rows.mapInArrow(frugal(pieces, "tokens"), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence_id and offset.

    Null and empty texts are one end id. Rows that repeat an id are packed each. An empty table gives no rows; extra
    columns are ignored. Texts are read once and never shuffled: the driver gets the histogram of lengths (at most
    `capacity` rows), pieces are ranked within their length, and ranks map to places by runs whose number depends on the
    capacity only.
    """
    cuts = materialize(cut(docs, capacity, path, end_id, id_col, text_col), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in cuts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = best_plan(counts, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    keys = (runs[:, 0] << 44) | runs[:, 1]
    first, sequence, offset = runs[:, 1].copy(), runs[:, 3].copy(), runs[:, 4].copy()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = np.asarray(batch.column("rank"), dtype=np.int64)
            at = np.searchsorted(keys, (np.asarray(batch.column("length"), dtype=np.int64) << 44) | rank, side="right") - 1
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = gapless_rank(cuts, ["length"], ["doc_id", "piece", "start", "ids_crc32"], ["doc_id", "piece", "ids_crc32"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
