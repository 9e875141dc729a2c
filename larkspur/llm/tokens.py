"""Token ids of whole texts, and token files: Parquet lists with page indexes for selective reads."""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain, count, groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import bounded_batches, frugal, materialize, memory_of, new_path, whole

#: Appended to each document.
END_ID = 2
#: Bytes of text handled at once in a Python worker, and when encoding.
SLICE, ENCODED = 1 << 20, 1 << 20
#: Pre-tokens that a worker remembers, the first it sees (bounds memory, changes no result).
REMEMBERED = 250_000
#: Fixed value: the pattern by which the public byte-level vocabulary splits texts before merging bytes; Encoder._cut() does it.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that libraries disagree on as white space: texts with them are encoded whole.
DISPUTED = re.compile("[\x1c-\x1f\x85]")
#: Characters encoded at once, and where longer texts may be cut: after a word, before a space.
RUN, BETWEEN = 1 << 20, re.compile(r"[A-Za-z](?= )")
#: Kinds of characters, and what PRETOKEN takes off after an apostrophe, as code points.
SPACES, LETTER, NUMBER, OTHER = range(4)
SHORT, LONG = [ord(c) for c in "stmd"], [tuple(map(ord, x)) for x in ("re", "ve", "ll")]
#: How byte-level vocabularies write the space, the line end, and each byte; here the line end stays, it separates words.
SPACE, LINE_END = "\u0120", "\u010a"
LETTERS, _REST = np.arange(256, dtype="<u2"), np.setdiff1d(np.arange(256), [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])
LETTERS[_REST] = 256 + np.arange(len(_REST))
LETTERS[ord("\n")] = ord("\n")


def default_tokenizer() -> str:
    """Path of the public byte-level vocabulary; pass another path to the operators to use another one."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def kinds() -> np.ndarray:
    """Kind of each code point, by the classes of PRETOKEN."""
    import regex

    every = "".join(map(chr, range(0x110000)))
    out = np.full(len(every), OTHER, dtype=np.uint8)
    for kind, pattern in ((SPACES, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for run in regex.finditer(pattern, every):
            out[run.start() : run.end()] = kind
    return out


#: Words that the library gets in one call; its own memory serves short calls better.
_CALL = 250


class Encoder:
    """Ids of texts exactly as the tokenizers library gives them.

    A byte-level vocabulary merges bytes within pre-tokens only, so each is encoded by the library once and remembered: a
    text is the numbers of its pre-tokens, and its ids are gathered from one table. Texts are cut by arithmetic on arrays, many
    at once, not by matching; a test compares with PRETOKEN. Texts that hold an added token, such as
    the vocabulary's mark for the end of a text, are encoded by the library whole, as it cuts them there first.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = Tokenizer(self.tokenizer.model)  # the same model for words that are cut and written as letters already
        self.merges.pre_tokenizer = CharDelimiterSplit(" ")
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.spaced[[i for token, i in vocabulary.items() if token[0] == SPACE]] = True
        self.line_end = vocabulary.get(LINE_END, -1)
        self.index = defaultdict(count().__next__)  # a pre-token without a number gets the next
        self.ids, self.starts = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _uncut(self, text: str) -> bool:
        """Whether the text must be encoded by the library as it is."""
        return any(token in text for token in self.added) or DISPUTED.search(text) is not None

    def _cut(self, texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
        """(pre-tokens of all texts end to end, how many each has): where PRETOKEN begins a match, decided for all characters at once."""
        text = "".join(texts)
        points, bounds = np.frombuffer(text.encode("utf-32-le"), dtype="<u4"), np.cumsum([0, *map(len, texts)])
        kind, n = kinds()[points], len(points)
        edge = np.zeros(n + 1, dtype=bool)  # a text begins, or the last one has ended
        edge[bounds] = True
        space, begins = kind == SPACES, edge.copy()
        begins[1:n] |= (kind[1:] != kind[:-1]) & (points[:-1] != 32)  # a space goes with what follows it
        begins[1 : n - 1] |= space[:-2] & space[1:-1] & ~space[2:] & ~edge[2:n]  # the last of several goes on its own
        marks = np.flatnonzero(points == 39)
        marks = marks[begins[marks] & ~edge[marks + 1]]
        one, two = points[marks + 1], points[np.minimum(marks + 2, n - 1)]
        short, long = np.isin(one, SHORT), np.zeros(len(marks), dtype=bool)
        for a, b in LONG:
            long |= (one == a) & (two == b) & ~edge[marks + 2]
        begins[marks[short | long] + 1] = False
        begins[marks[short] + 2] = True
        begins[marks[long] + 3] = True
        at = np.flatnonzero(begins)
        counts = np.diff(np.searchsorted(at, bounds))
        if not text.isascii():
            more = (points > 0x7F).astype(np.uint8) + (points > 0x7FF) + (points > 0xFFFF)  # bytes beyond the first
            at = at + np.concatenate([[0], np.cumsum(more, dtype=np.int64)])[at]
        return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(text.encode())), counts

    def _joined(self, words: list, mark: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids end to end, how many each has) of words that all begin with a space, or that get a line end before each.

        Only the first id of each word can hold its mark; None if the library gave others.
        """
        if self.tokenizer.normalizer is not None:
            return None
        words = LETTERS[np.frombuffer("\n".join(words).encode(), dtype=np.uint8)].tobytes().decode("utf-16-le").split("\n")
        lead, between = (f"{LINE_END} ", f" {LINE_END} ") if mark else ("", " ")
        calls = [lead + between.join(words[k : k + _CALL]) for k in range(0, len(words), _CALL)]
        ids = np.array(list(chain.from_iterable(e.ids for e in self.merges.encode_batch_fast(calls, add_special_tokens=False))), dtype="<u4")
        first = np.flatnonzero(ids == self.line_end if mark else self.spaced[ids])
        if len(first) != len(words):
            return None
        sizes = np.diff(first, append=len(ids))
        return (np.delete(ids, first), sizes - 1) if mark else (ids, sizes)

    def _learn(self, new: list) -> None:
        """Ids of new pre-tokens go to the end of the table. All but white space are encoded many in a call."""
        blank = np.array([w.isspace() for w in new], dtype=bool)
        spaced = np.array([w[0] == " " for w in new], dtype=bool) & ~blank
        sizes, parts = np.zeros(len(new), dtype=np.int64), []
        for chosen, mark in ((spaced, False), (~spaced & ~blank, True), (blank, None)):
            at = np.flatnonzero(chosen)
            words = [new[i] for i in at.tolist()]
            got = self._joined(words, mark) if mark is not None and words else None
            if got is None:
                each = [self._ids(w) for w in words]
                got = np.concatenate([np.zeros(0, dtype="<u4"), *each]), np.array([len(x) for x in each], dtype=np.int64)
            sizes[at] = got[1]
            parts.append((at, *got))
        ends = np.cumsum(sizes)
        ids = np.zeros(int(ends[-1]), dtype="<u4")
        for at, some, n in parts:
            ids[np.repeat(ends[at] - np.cumsum(n), n) + np.arange(len(some))] = some
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + ends])

    def _runs(self, text: str) -> list[str]:
        """A long text in runs that begin with the space after a word, where a pre-token always ends; whole if it has an added token."""
        if len(text) <= RUN or any(token in text for token in self.added) or DISPUTED.search(text):
            return [text]
        runs, a = [], 0
        for cut in BETWEEN.finditer(text):
            if cut.end() - a > RUN:
                runs.append(text[a : cut.end()])
                a = cut.end()
        return [*runs, text[a:]]

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, where each text's begin and the last one's end), with `end` after each text if given."""
        runs = [self._runs(t) for t in texts]
        done, group, size = [], [], 0
        for run in chain.from_iterable(runs):
            if group and size + len(run) > RUN:
                done.append(self._encode(group))
                group, size = [], 0
            group.append(run)
            size += len(run)
        done.append(self._encode(group))
        ids, sizes = (np.concatenate(x) for x in zip(*done))
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum([len(x) for x in runs])]).astype(np.int64)]
        if end is not None:
            ids, bounds = np.insert(ids, bounds[1:], np.uint32(end)), bounds + np.arange(len(bounds))
        return ids, bounds

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, how many each has)."""
        parts = []
        for uncut, some in groupby(texts, self._uncut):
            if uncut:
                each = [self._ids(t) for t in some]
                parts.append((np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)))
            else:
                parts.append(self._gathered(list(some)))
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64))

    def _gathered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that can be cut into pre-tokens; only different ones are looked up."""
        words, counts = self._cut(texts)
        coded, known = words.dictionary_encode(), len(self.index)
        numbers = np.fromiter(map(self.index.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(coded.dictionary))
        which = numbers[coded.indices.to_numpy()]
        new = list(islice(reversed(self.index), len(self.index) - known))[::-1]
        if new:
            self._learn(new)
        size = self.starts[which + 1] - self.starts[which]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.starts[which] - ends[:-1], size) + np.arange(int(ends[-1]))]
        bounds = ends[np.concatenate([[0], np.cumsum(counts)])]
        if len(self.index) > REMEMBERED:
            for w in new:
                del self.index[w]
            self.index.default_factory = count(known).__next__
            self.ids, self.starts = self.ids[: self.starts[known]], self.starts[: known + 1]
        return ids, np.diff(bounds)


_ENCODERS: dict[str, Encoder] = memory_of("tokens")


def encoder(path: str) -> Encoder:
    """This process's encoder for the vocabulary at this path."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `most` bytes of text each; one long text may be more."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), dtype=np.int64)
    step = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def token_rows(texts: list[str | None], path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts with the end id after each, for null as for the empty text, and their bounds."""
    return encoder(path).encode([t or "" for t in texts], end_id)


def write_tokens(docs: DataFrame, target: str, path: str | None = None, end_id: int = END_ID, row_group: int = 32 << 20, page: int = 64 << 10, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ids of all rows in ascending id order to `target`: (part, doc_id, part_start, n_tokens, tokens).

    Files follow each other by `part`; part_start counts the ids before a document in its part, so a reader gets global
    offsets from one sum a part. Token lists are dictionary-encoded, falling back to delta encoding (format version 2);
    row groups and pages are bounded, and page indexes let a reader fetch some columns or documents only. Nulls sort
    first; rows that repeat an id are ordered by a hash of their text.
    """
    path = path or default_tokenizer()
    schema = "part int, doc_id long, part_start long, n_tokens int, tokens array<int>"
    arrow = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("part_start", pa.int64()), ("n_tokens", pa.int32()), ("tokens", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, most=ENCODED):
                ids, bounds = token_rows(rows.column("text").to_pylist(), path, end_id)
                n, ends = np.diff(bounds), bounds[1:]
                offsets = pa.array(bounds.astype(np.int32))
                values = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), rows.column("doc_id"), pa.array(at + ends - n), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(offsets, values)], schema=arrow)
                at += int(ends[-1])

    bounded_batches(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    writer = dealt.mapInArrow(frugal(encode, "tokens"), schema).write.option("compression", "zstd")
    for key, value in {"parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.block.size": row_group, "parquet.page.size": page, "parquet.page.row.count.limit": 20000}.items():
        writer = writer.option(key, value)
    writer.parquet(target)


def read_tokens(spark: SparkSession, source: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of write_tokens() with `start`, the ids of all documents before each; only the columns asked for are read."""
    files = spark.read.parquet(source)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "token-parts")
    wanted = columns or ["doc_id", "n_tokens", "tokens"]
    return files.join(F.broadcast(bases), "part").select((F.col("base") + F.col("part_start")).alias("start"), *wanted)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets, counts and checksums of all documents, read back from the token files."""
    target = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), target)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            at = np.asarray(lists.offsets, dtype=np.int64) * 4
            data = memoryview(np.ascontiguousarray(np.asarray(lists.values, dtype="<u4"))).cast("B")
            crc = [zlib.crc32(data[a:b]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.compute.cast(batch.column("n_tokens"), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_tokens(spark, target).mapInArrow(frugal(digest), "doc_id long, start long, n_tokens long, ids_crc32 long")
