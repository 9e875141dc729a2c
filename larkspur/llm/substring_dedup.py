"""Repeated byte strings across documents, by a logarithmic family of sorted indexes over sampled suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, frugal, frugal_group, materialize, text_bytes, whole
from .shingles import _ODD, _inverse, _powers, mix

#: Bytes of a string that must not repeat, and of the grams whose least hash in it marks a suffix.
LENGTH, GRAM = 50, 24
#: Bytes of text looked at at once (longer texts in pieces), of a chunk whose suffixes are sent together, and of the text
#: whose suffixes meet in one partition; suffixes of one batch there.
PIECE, CHUNK, PART, BATCH = 1 << 19, 4 << 20, 8 << 20, 1 << 16
_BASE = 0xA24BAED4963EE407
_RAW = mix(np.arange(1, 257, dtype=np.uint64) * _ODD * np.uint64(3))
_UP, _DOWN = _powers(_BASE, PIECE + 4096), _powers(_inverse(_BASE), PIECE + 4096)
#: States of a suffix: nothing to do, an earlier document has its whole phrase, its windows must be compared, and on the way to
#: a partition: not settled in its chunk; the same, and its key has other phrases there.
_EMPTY, _FULL, _OPEN, _ASK, _ASK_OPEN = 0, 1, 2, 3, 4


def _sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which hash_of() gets the hash of any substring."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_RAW[data] * _UP[: len(data)], out=out[1:])
    return out


def hash_of(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[begin:end]."""
    return mix((sums[end] - sums[begin]) * _DOWN[begin] + (end - begin).astype(np.uint64) * _ODD)


def suffixes(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, suffix key, phrase hash) of the sampled suffixes of texts that lie end to end.

    Each window of `length` bytes belongs to the least of its grams, the first of equals; consecutive windows with the same
    one are a run, and its phrase is what they cover. Two texts that share a window share the key of its suffix.
    """
    none = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    n = len(data)
    if n < length:
        return none
    sums = _sums(data)
    at = np.arange(n - gram + 1, dtype=np.int64)
    key = hash_of(sums, at, at + gram)
    least = (key & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    step, width = 1, length - gram + 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    text = np.repeat(np.arange(len(bounds) - 1), np.maximum(np.diff(bounds), 0))
    start = np.arange(n - length + 1, dtype=np.int64)
    inside = text[: n - length + 1] == text[length - 1 :]
    start, least = start[inside], least[: n - length + 1][inside]
    if not len(start):
        return none
    mark = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (mark[1:] != mark[:-1]) | (start[1:] != start[:-1] + 1)
    first = start[new]
    last = start[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])]
    mark = mark[new]
    return text[first], first, last, mix(key[mark] ^ _ODD), hash_of(sums, first, last + length)  # mixed, as least hashes are small ones


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts of a column, without copies."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


class Pieces:
    """The sampled suffixes of some texts, found piece by piece; a text longer than PIECE is looked at in overlapping pieces."""

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int, gram: int):
        self.data, self.off, self.length = data, off, length
        self.ranges: list[tuple[int, int]] = []
        found: list[tuple[np.ndarray, ...]] = []
        i, n = 0, len(off) - 1
        while i < n:
            if off[i + 1] - off[i] > PIECE:
                spots = [(i, i + 1, int(a), int(min(a + PIECE + length - 1, off[i + 1]))) for a in range(int(off[i]), int(off[i + 1]) - length + 1, PIECE)]
                i += 1
            else:
                j = max(i + 1, int(np.searchsorted(off, off[i] + PIECE, side="right")) - 1)
                spots = [(i, j, int(off[i]), int(off[j]))]
                i = j
            for x, y, a, b in spots:
                bounds = np.clip(off[x : y + 1], a, b) - a
                text, first, last, key, phrase = suffixes(data[a:b], bounds, length, gram)
                self.ranges.append((a, b))
                found.append((text + x, first + a, last + a, key, phrase, np.full(len(text), len(self.ranges) - 1)))
        empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),)
        #: Of each suffix: text, first and last window (places in data), key, phrase, piece.
        self.text, self.first, self.last, self.key, self.phrase, self.piece = (np.concatenate(x) for x in zip(empty, *found)) if found else empty

    def known(self, states: list[bytes | None], parts: int) -> np.ndarray:
        """The state of each suffix; states[i] has those of text i by partition and place."""
        order = np.lexsort((_part(self.key, parts), self.text))
        count = np.bincount(self.text, minlength=len(states))
        out = np.zeros(len(order), dtype=np.uint8)
        out[order] = np.frombuffer(b"".join(s if s is not None else bytes(int(c)) for s, c in zip(states, count)), np.uint8)
        return out

    def windows(self, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, hash) of each window of the suffixes `on`, in their order."""
        which = np.flatnonzero(on)
        size = self.last[which] - self.first[which] + 1
        start = np.repeat(self.first[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        piece, hashes = np.repeat(self.piece[which], size), np.zeros(len(start), dtype=np.uint64)
        for k in np.unique(piece):
            a, b = self.ranges[k]
            mine = start[piece == k] - a
            hashes[piece == k] = hash_of(_sums(self.data[a:b]), mine, mine + self.length)
        return np.repeat(self.text[which], size), start, hashes


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _rank(docs: np.ndarray) -> np.ndarray:
    """Ranks by id, no id last; equal ids have the same."""
    by = np.lexsort((docs["id"], docs["none"]))
    out = np.zeros(len(docs), dtype=np.int32)
    if len(by):
        id_, none = docs["id"][by], docs["none"][by]
        out[by[1:]] = np.cumsum((id_[1:] != id_[:-1]) | (none[1:] != none[:-1]))
    return out


_SENT = "part int, chunk long, docs binary, ids binary, own binary, local binary, ref binary, keys binary, phrases binary"
_BACK = "chunk long, part int, docs binary, own binary, state binary"
#: A document on its way: id, whether it has none, and a hash of its text that tells apart rows that repeat an id.
_DOC = np.dtype([("id", "<i8"), ("none", "u1"), ("fit", "<i8")])
_ID = np.dtype([("none", "u1"), ("id", "<i8")])


def _docs(id_: pa.Array, fit: pa.Array) -> np.ndarray:
    out = np.zeros(len(id_), dtype=_DOC)
    out["id"], out["none"], out["fit"] = np.asarray(id_.fill_null(0)), np.asarray(id_.is_null().cast(pa.uint8())), np.asarray(fit)
    return out


def _deltas(x: np.ndarray) -> bytes:
    return np.diff(x, prepend=x.dtype.type(0)).astype(np.int32).tobytes()


def _undelta(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(x, np.int32), dtype=np.int32)


def _send(chunk: int, parts: int, docs: np.ndarray, own: np.ndarray, key: np.ndarray, phrase: np.ndarray) -> pa.RecordBatch:
    """One row a partition. Of each key only the suffixes of the chunk's least document are sent.

    Later documents of the chunk are settled here: with a phrase that an earlier one has, it repeats; with another one, its
    windows will be compared. So a key that a third of all documents hold is sent once a chunk.
    """
    own = own.astype(np.int32)
    mine = _rank(docs)[own]
    order = np.lexsort((mine, phrase, key))
    k, f, d = key[order], phrase[order], mine[order]
    new_key, new_phrase = np.ones(len(order), dtype=bool), np.ones(len(order), dtype=bool)
    new_key[1:] = k[1:] != k[:-1]
    new_phrase[1:] = new_key[1:] | (f[1:] != f[:-1])
    of_key, of_phrase = (np.cumsum(x, dtype=np.int32) - 1 for x in (new_key, new_phrase))
    del k, f
    least = np.minimum.reduceat(d, np.flatnonzero(new_key)) if len(d) else d
    asked = d == least[of_key] if len(d) else np.zeros(0, dtype=bool)
    local = np.empty(len(order), dtype=np.uint8)
    settled = np.where(asked, _ASK, np.where(d > d[new_phrase][of_phrase] if len(d) else asked, _FULL, _OPEN)).astype(np.uint8)
    if len(d):
        settled[asked & np.logical_or.reduceat(settled == _OPEN, np.flatnonzero(new_key))[of_key]] = _ASK_OPEN
    local[order] = settled
    sent_at = order[new_phrase]  # of each phrase the first suffix; it is asked if any of the phrase's is
    ref = np.empty(len(order), dtype=np.int32)
    ref[order] = sent_at[of_phrase] if len(order) else order
    del order, new_key, new_phrase, of_key, of_phrase, settled, d, asked, mine
    part = _part(key, parts).astype(np.int32)
    token = (((key >> np.uint64(32)) * np.uint64(parts)) & np.uint64(0xFFFFFFFF)).astype(np.uint32) ^ (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    place = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[place], np.arange(parts + 1))
    index = np.empty(len(own), dtype=np.int32)
    id_ = np.empty(len(docs), dtype=_ID)
    id_["none"], id_["id"] = docs["none"], docs["id"]
    columns: list[list] = [[] for _ in range(9)]
    for p in range(parts):
        here = place[cuts[p] : cuts[p + 1]]
        asks = here[local[here] >= _ASK]
        sent = asks[ref[asks] == asks]
        index[sent] = np.arange(len(sent))
        twice = len(sent) < len(asks)
        who = np.unique(own[asks])  # ids only of documents that ask
        for column, value in zip(columns, (p, chunk, docs.tobytes() if p == chunk % parts else None, id_[who].tobytes(), _deltas(own[here]), local[here].tobytes(), index[ref[asks]].tobytes() if twice else None, token[sent].tobytes(), (phrase[sent] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes())):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[2:])], names=[x.split()[0] for x in _SENT.split(", ")])


class Levels:
    """A logarithmic family of sorted indexes of suffixes (key, phrase).

    scan() reads a sorted batch along each standing level; add() then puts the batch in as a level of its own, and while the
    level below is no larger, the two merge. So each suffix is merged a logarithmic number of times, and a batch meets a
    logarithmic number of levels. Batches come in the order of documents: what stands is earlier than what is scanned.
    """

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def scan(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(suffix stands in a level, its key does) for each of the sorted codes (key above, phrase below)."""
        whole_, key = np.zeros(len(code), dtype=bool), np.zeros(len(code), dtype=bool)
        high = code & np.uint64(0xFFFFFFFF00000000)
        for level in self.levels:
            at = np.searchsorted(level, high)
            key |= (level[np.minimum(at, len(level) - 1)] & np.uint64(0xFFFFFFFF00000000)) == high
            at = np.searchsorted(level, code)
            whole_ |= level[np.minimum(at, len(level) - 1)] == code
        return whole_, key

    def add(self, code: np.ndarray) -> None:
        """Puts sorted codes in."""
        if not len(code):
            return
        while self.levels and len(self.levels[-1]) <= 2 * len(code):
            code = np.concatenate([self.levels.pop(), code])
            code.sort(kind="stable")
            code = code[np.concatenate([[True], code[1:] != code[:-1]])]
        self.levels.append(code)


def batches_of(code: np.ndarray, rank: np.ndarray, open_: np.ndarray, batch: int = BATCH) -> np.ndarray:
    """The state of each suffix, by batches of documents in ascending order: sort a batch, scan it against the levels, add it.

    open_: whether its key is known to have other phrases too. The first holder of a phrase whose key has other phrases,
    before or after it, is _OPEN, as later windows are compared with its own.
    """
    state = np.zeros(len(code), dtype=np.uint8)
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    index, a = Levels(), 0
    while a < len(order):
        b = int(np.searchsorted(sorted_rank, sorted_rank[min(a + batch, len(order)) - 1], side="right"))
        mine = order[a:b]
        mine = mine[np.lexsort((rank[mine], code[mine]))]
        c, r = code[mine], rank[mine]
        new = np.ones(len(c), dtype=bool)
        new[1:] = c[1:] != c[:-1]
        new_key = np.ones(len(c), dtype=bool)
        new_key[1:] = (c[1:] >> np.uint64(32)) != (c[:-1] >> np.uint64(32))
        phrase_seen, key_seen = index.scan(c)
        phrase_seen |= r > r[new][np.cumsum(new) - 1]
        key_seen |= r > np.minimum.reduceat(r, np.flatnonzero(new_key))[np.cumsum(new_key) - 1]
        state[mine] = np.where(phrase_seen, _FULL, np.where(key_seen, _OPEN, _EMPTY))
        index.add(c[new])
        a = b
    key = code >> np.uint64(32)
    shared = np.unique(key[open_ | (state == _OPEN)])
    if len(shared):
        state[(state == _EMPTY) & (shared[np.minimum(np.searchsorted(shared, key), len(shared) - 1)] == key)] = _OPEN
    return state


def _answer(table: pa.Table) -> pa.Table:
    """The state of each suffix of the partition: _FULL if an earlier document has its whole phrase, _OPEN if its windows must be compared."""
    keys, phrases, ids = (table.column(c) for c in ("keys", "phrases", "ids"))
    local = [np.frombuffer(x.as_buffer(), np.uint8).copy() for x in table.column("local")]
    refs = [np.frombuffer(x.as_buffer(), np.int32) if x.is_valid else None for x in table.column("ref")]
    code = np.concatenate([(np.frombuffer(k.as_buffer(), np.uint32).astype(np.uint64) << np.uint64(32)) | np.frombuffer(f.as_buffer(), np.uint32) for k, f in zip(keys, phrases)])
    who = np.concatenate([np.frombuffer(x.as_buffer(), _ID) for x in ids])
    of = _rank(who)
    rank, open_, at, before = np.empty(len(code), dtype=np.int32), np.zeros(len(code), dtype=bool), 0, 0
    for i, (state, ref) in enumerate(zip(local, refs)):
        n, asks = len(keys[i].as_buffer()) // 4, state >= _ASK
        own, index = np.unique(_undelta(table.column("own")[i].as_buffer())[asks], return_inverse=True)
        index = (index + before).astype(np.int32)
        before += len(own)
        place = slice(None) if ref is None else ref
        open_[at : at + n][place] |= state[asks] == _ASK_OPEN
        rank[at : at + n][place] = of[index]
        at += n
    del who, of
    told = batches_of(code, rank, open_)
    out, at = [], 0
    for i, x in enumerate(keys):
        n = len(x.as_buffer()) // 4
        mine = told[at : at + n]
        at += n
        state = local[i]
        state[state >= _ASK] = mine if refs[i] is None else mine[refs[i]]
        out.append(state.tobytes())
    return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "docs": table.column("docs"), "own": table.column("own"), "state": pa.array(out, pa.binary())})


def _gather(table: pa.Table) -> pa.Table:
    """(id, fit, state) of the chunk's documents that have any state; states are ordered by partition, then place."""
    order = np.argsort(table.column("part").to_numpy())
    own = np.concatenate([_undelta(table.column("own")[int(i)].as_buffer()) for i in order])
    state = np.concatenate([np.frombuffer(table.column("state")[int(i)].as_buffer(), np.uint8) for i in order])
    docs = np.frombuffer(next(d for d in table.column("docs") if d.is_valid).as_py(), _DOC)
    by = np.argsort(own, kind="stable")
    cuts = np.searchsorted(own[by], np.arange(len(docs) + 1))
    state = state[by]
    kept = np.unique(own[by][state > 0])
    which = docs[kept]
    return pa.table({"i": pa.array(which["id"].copy(), mask=which["none"].astype(bool)), "f": pa.array(which["fit"].copy()), "state": pa.array([state[cuts[k] : cuts[k + 1]].tobytes() for k in kept], pa.binary())})


def _exchange(sent: DataFrame, name: str) -> DataFrame:
    replies = sent.groupBy("part").applyInArrow(frugal_group(_answer), _BACK)
    found = replies.groupBy("chunk").applyInArrow(frugal_group(_gather), "i long, f long, state binary")
    return found.groupBy("i", "f").agg(F.first("state").alias(name))  # rows that repeat id and text have the same states


class _Sender:
    """Suffixes gathered into chunks and sent; a chunk's number is unique in the job."""

    def __init__(self, parts: int):
        self.parts, self.chunk = parts, TaskContext.get().partitionId() << 32
        self.clear()

    def clear(self) -> None:
        self.docs: list = []
        self.found: list = []
        self.rows, self.held = 0, 0

    def add(self, docs: np.ndarray, own: np.ndarray, key: np.ndarray, phrase: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
        self.docs.append(docs)
        self.found.append((own + self.rows, key, phrase))
        self.rows += len(docs)
        self.held += size
        if self.held >= CHUNK:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield _send(self.chunk, self.parts, np.concatenate(self.docs), *(np.concatenate(x) for x in zip(*self.found)))
            self.chunk += 1
            self.clear()


def substring_duplicates(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs.

    A byte goes if a string of `length` bytes around it also starts in a document with a smaller id. 1. Chunks of documents
    send their sampled suffixes, 8 bytes each, to the partition of their key, and of each key only the least document's.
    There batches of documents in ascending order are sorted, scanned against the levels that stand, and added; levels merge
    geometrically. The answer is which phrases an earlier document has whole, and which share a suffix with another phrase.
    2. Only for the latter, at the edges of repeated passages, the hashes of single windows go the same way. 3. Each
    document's windows are marked and its bytes counted. The number of partitions follows the bytes of text, so none grows
    with the input. Strings are compared by 64 bits of hash within a partition.

    Null text counts as empty; texts shorter than `length` lose nothing; long ones are looked at in pieces. A null id ranks
    last. Rows with the same id are never earlier than each other. Extra columns are ignored; an empty table gives no rows.
    """
    from .tokens import slices

    bounded_batches(docs.sparkSession)
    parts = max(8, -(-text_bytes(docs, text_col) // PART))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text")).select("id", F.xxhash64("text").alias("fit"), "text")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Sender(parts)
        for batch in batches:
            for part in slices(batch, most=4 * PIECE):
                data, off = buffer_of(part.column("text"))
                p = Pieces(data, off, length, gram)
                yield from out.add(_docs(part.column("id"), part.column("fit")), p.text, p.key, p.phrase, int(off[-1] - off[0]))
        yield from out.flush()

    states = materialize(_exchange(rows.mapInArrow(frugal(send), _SENT), "state"), "states")
    matched = F.col("id").eqNullSafe(F.col("i")) & (F.col("fit") == F.col("f"))
    told = rows.join(states.hint("merge"), matched, "left").select("id", "fit", "text", "state")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Sender(parts)
        for batch in batches:
            for part in slices(batch.filter(pa.compute.is_valid(batch.column("state"))), most=4 * PIECE):
                p = Pieces(*buffer_of(part.column("text")), length, gram)
                text, _, h = p.windows(p.known(part.column("state").to_pylist(), parts) == _OPEN)
                yield from out.add(_docs(part.column("id"), part.column("fit")), text, h, mix(h ^ _ODD), 16 * len(h))
        yield from out.flush()

    single = _exchange(told.mapInArrow(frugal(compare), _SENT), "more")
    both = told.join(single.hint("merge"), matched, "left").select("id", "text", "state", "more")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=4 * PIECE):
                yield _cut(part, parts, length, gram)

    return both.mapInArrow(frugal(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _cut(rows: pa.RecordBatch, parts: int, length: int, gram: int) -> pa.RecordBatch:
    """What is left of some documents."""
    data, off = buffer_of(rows.column("text"))
    removed, spans = np.zeros(len(off) - 1, dtype=np.int64), np.zeros(len(off) - 1, dtype=np.int64)
    begin, end, cuts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    states = rows.column("state").to_pylist()
    if any(s is not None for s in states):
        p = Pieces(data, off, length, gram)
        known = p.known(states, parts)
        full = known == _FULL
        text, first, last = p.text[full], p.first[full], p.last[full]
        if (known == _OPEN).any():
            own, start, h = p.windows(known == _OPEN)
            more = rows.column("more").to_pylist()
            order = np.lexsort((_part(h, parts), own))
            count = np.bincount(own, minlength=len(states))
            repeats = np.zeros(len(h), dtype=bool)
            repeats[order] = np.frombuffer(b"".join(s if s is not None else bytes(int(c)) for s, c in zip(more, count)), np.uint8) == _FULL
            text, first, last = (np.concatenate(x) for x in ((text, own[repeats]), (first, start[repeats]), (last, start[repeats])))
        order = np.lexsort((first, text))
        text, first, last = text[order], first[order], last[order]
        if len(text):
            apart = last + text * (length + 1)  # windows of different texts never touch
            reach = np.maximum.accumulate(apart)
            new = np.ones(len(text), dtype=bool)
            new[1:] = first[1:] + text[1:] * (length + 1) > reach[:-1] + length
            new[1:] |= text[1:] != text[:-1]
            at = np.flatnonzero(new)
            owner, begin = text[at], first[at]
            end = np.append(reach[at[1:] - 1], reach[-1]) - owner * (length + 1) + length
            np.add.at(removed, owner, end - begin)
            np.add.at(spans, owner, 1)
            cuts = np.searchsorted(owner, np.arange(len(off)))
    shas, view = [], memoryview(data)
    for i in range(len(off) - 1):
        left, sha = int(off[i]), hashlib.sha256()
        for k in range(cuts[i], cuts[i + 1]):
            sha.update(view[left : int(begin[k])])
            left = int(end[k])
        sha.update(view[left : int(off[i + 1])])
        shas.append(sha.hexdigest())
    return pa.RecordBatch.from_arrays([rows.column("id"), pa.array(np.diff(off)), pa.array(removed), pa.array(spans), pa.array(shas, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 50-byte strings of all documents."""
    return substring_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
