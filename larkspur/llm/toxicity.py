"""Toxicity: a lexicon trie met by Levenshtein automata, and context windows around its hits."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, frugal, materialize, memory_of, whole

#: At most so many labelled rows of each class (least hash of their id) are learned from, and so many terms kept.
TRAIN_TOXIC, TRAIN_CLEAN, TERMS = 4000, 6000, 3000
#: Share of chance finds that is borne among the terms, as thousands are tried (the step-up rule for false discoveries); with
#: few labelled rows, so many of the best are terms all the same.
CHANCE, LEAST_TERMS = 0.02, 10
SAMPLE_PARTS = 24
#: Words that a worker remembers as met with the lexicon (bounds memory, changes no result).
REMEMBERED = 100_000
#: Words on either side of a hit that make up its context; what a hit within quotation marks counts, and how much more one
#: counts for each of up to CROWD other hits in its context that aren't quoted.
WINDOW, QUOTED, CROWD, MORE = 10, 0.1, 2, 0.5
_QUOTE = re.compile(r'["“][^"“”\n]{1,400}["”]')
#: Log odds from which a term may be misspelled in a Lexicon made without another bound; score() and keep_clean() set none.
FUZZY_ODDS = 4.0
#: Letters of the beginnings that count as terms beside whole words.
STEM = 5
_WORD = re.compile(r"[^\W\d_]+(?:[0-9@$!*][^\W\d_]+)*")
_SPLIT = r"[^\p{L}]+"
N_FEATURES = 8


def shortened(word: str) -> set[str]:
    """The word without each one of its letters."""
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


class Lexicon:
    """Terms with weights in a trie. match() meets it with the Levenshtein automaton of a word, of distance at most one."""

    def __init__(self, terms: dict[str, float], least_odds: float = FUZZY_ODDS):
        self.words = {t: w for t, w in terms.items() if not t.endswith("*")}
        self.stems = {t[:-1]: w for t, w in terms.items() if t.endswith("*")}
        self.root: dict = {}
        self.near: set[str] = set()
        for t, w in self.words.items():
            if w >= least_odds:
                node = self.root
                for c in t:
                    node = node.setdefault(c, {})
                node[""] = w
                self.near.add(t)
                self.near |= shortened(t)
        self.longest = max(map(len, self.near), default=-1) + 1
        self.memo: dict[str, float] = {}

    def match(self, word: str) -> float:
        """The largest weight of a term one edit away, 0 if there is none.

        A word one edit from a term equals it, or lacks a letter to equal it, or both lack a letter to be equal; other words
        are passed over before the trie is walked.
        """
        best = self.memo.get(word)
        if best is None:
            best = self._walk(word) if self._near(word) else 0.0
            if len(self.memo) < REMEMBERED:
                self.memo[word] = best
        return best

    def _near(self, word: str) -> bool:
        return len(word) <= self.longest and (word in self.near or not self.near.isdisjoint(shortened(word)))

    def _walk(self, word: str) -> float:
        best, stack = 0.0, [(self.root, frozenset({(0, 0), (1, 1)}))]
        n = len(word)
        while stack:
            node, states = stack.pop()
            if "" in node and any(e + n - i <= 1 for i, e in states):
                best = max(best, node[""])
            for c, child in node.items():
                if not c:
                    continue
                after = set()
                for i, e in states:
                    if i < n and word[i] == c:
                        after.add((i + 1, e))
                    elif e == 0:
                        after |= {(i, 1), (i + 1, 1)} if i < n else {(i, 1)}
                        if i + 1 < n and word[i + 1] == c:
                            after.add((i + 2, 1))
                if after:
                    stack.append((child, frozenset(after)))
        return best

    def features(self, text: str) -> list[float]:
        """What the classifier sees of a text: its hits, each weighed by its context, in all, by length and in the densest window;
        its five worst terms; its stems; and its distinct terms, in all and by length.

        Exact and misspelled terms are hits alike. Within quotation marks on a line a hit counts QUOTED; beside other hits
        that aren't quoted, more.
        """
        lower = text.lower()
        distinct = set(_WORD.findall(lower))
        exact = distinct & self.words.keys()
        stems = sum(self.stems[s] for w in distinct if len(w) > STEM and (s := w[:STEM]) in self.stems)
        known, terms = self.memo, {w: self.words[w] for w in exact}
        for w in distinct:
            v = known.get(w)
            if v is None:
                v = self.match(w)
            if v and w not in exact:
                terms[w] = v
        out = [0.0] * N_FEATURES
        out[4] = np.log1p(stems)
        out[5] = np.log1p(100 * stems / max(len(distinct), 20))
        if not terms:
            return out
        n, places, values, starts = 0, [], [], []
        for n, m in enumerate(_WORD.finditer(lower), 1):
            if m[0] in terms:
                places.append(n - 1)
                values.append(terms[m[0]])
                starts.append(m.start())
        place, value = np.array(places), np.array(values)
        plain = np.ones(len(place), dtype=bool)
        for m in _QUOTE.finditer(lower):
            plain[bisect_left(starts, m.start()) : bisect_left(starts, m.end())] = False
        before = np.concatenate([[0], np.cumsum(plain)])
        a, b = np.searchsorted(place, place - WINDOW), np.searchsorted(place, place + WINDOW, side="right")
        others = before[b] - before[a] - plain
        value = value * np.where(plain, 1.0, QUOTED) * (1 + MORE * np.minimum(others, CROWD))
        sums = np.concatenate([[0.0], np.cumsum(value)])
        total = float(sums[-1])
        out[0] = np.log1p(total)
        out[1] = np.log1p(100 * total / max(n, 20))
        out[2] = np.log1p(float((sums[b] - sums[np.arange(len(place))]).max()))
        worst: dict[str, float] = {}
        for k, v in zip(starts, value.tolist()):
            w = _WORD.match(lower, k)[0]
            worst[w] = max(worst.get(w, 0.0), v)
        out[3] = np.log1p(sum(sorted(worst.values(), reverse=True)[:5]))
        out[6] = np.log1p(sum(worst.values()))
        out[7] = np.log1p(100 * sum(worst.values()) / max(len(distinct), 20))
        return out


_LEXICONS: dict[int, Lexicon] = memory_of("toxicity")


def lexicon_of(terms: dict[str, float]) -> Lexicon:
    """This process's lexicon of these terms; the last one is kept for later tasks."""
    key = hash(frozenset(terms.items()))
    if key not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[key] = Lexicon(terms, least_odds=0.0)
    return _LEXICONS[key]


def _fit(x: np.ndarray, y: np.ndarray, steps: int = 1500, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient steps with momentum; features are scaled within. No weight is negative: more of any
    feature is more evidence."""
    scale = np.maximum(x.std(axis=0), 1e-3)
    z = x / scale
    w, b, vw, vb = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        gap = y - 1 / (1 + np.exp(-((z * w).sum(axis=1) + b).clip(-30, 30)))
        vw, vb = 0.9 * vw + (z * gap[:, None]).mean(axis=0) - decay * w, 0.9 * vb + gap.mean()
        w, b = w + rate * vw, b + rate * vb
        vw[w < 0] = 0
        w = np.maximum(w, 0)
    return w / scale, float(b)


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], np.ndarray, float]:
    """(lexicon, weights, bias) from rows of labels whose crc32(doc_id as text) mod 5 isn't 0.

    A bounded sample of each class is joined to the texts by broadcast. Terms come from one half of it, the classifier from
    the other, so terms that are toxic by chance don't count; the bias is set back to the true share of the class.
    """
    rows = labels.select(F.col("doc_id").alias("d"), F.col("toxic").cast("int").alias("toxic")).where((F.crc32(F.col("d").cast("string").cast("binary")) % 5 != 0) & F.col("toxic").isin(0, 1))
    share = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = [rows.where(F.col("toxic") == k).orderBy(F.xxhash64("d"), "d").limit(n) for k, n in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))]
    chosen = F.broadcast(taken[0].unionByName(taken[1]).dropDuplicates(["d"]))
    sample = materialize(docs.join(chosen, F.col("doc_id") == F.col("d")).select("d", "toxic", "text", (F.xxhash64("d") % 2 == 0).alias("half")), "labelled")
    half = sample.where("half")
    sizes = {r["toxic"]: r["n"] for r in half.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0) + 1, sizes.get(0, 0) + 1
    words = F.split(F.lower("text"), _SPLIT)
    listed = half.select("toxic", F.explode(F.array_distinct(words)).alias("w")).where("w != ''")
    whole_words = listed.select("toxic", F.col("w").alias("term"))
    stems = half.select("toxic", F.explode(F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > STEM), lambda w: F.concat(F.substring(w, 1, STEM), F.lit("*"))))).alias("term"))
    counted = whole_words.unionByName(stems).groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / n1) - F.log((F.col("b") + 0.5) / n0)
    spread = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = counted.where("a >= 3").withColumn("odds", odds).withColumn("z", odds / spread).where("odds > 1.5 and z > 2.5").orderBy(F.desc("z"), "term").limit(TERMS)
    tried = max(counted.where("a >= 3").count(), 1)
    ranked = best.select("term", "odds", "z").collect()
    good = [k for k, r in enumerate(ranked, 1) if math.erfc(r["z"] / math.sqrt(2)) / 2 <= CHANCE * k / tried]
    lexicon = {r["term"]: float(r["odds"]) for r in ranked[: max([LEAST_TERMS, *good])]}
    seen = _featured(sample.where("not half").select("d", "toxic", "text").repartition(SAMPLE_PARTS), lexicon).collect()
    if not seen or len({r["toxic"] for r in seen}) < 2:
        return lexicon, np.zeros(N_FEATURES), -3.0
    x, y = np.array([r["features"] for r in seen], dtype=float), np.array([r["toxic"] for r in seen], dtype=float)
    weights, bias = _fit(x, y)
    drawn = y.mean() / (1 - y.mean())
    true = max(share.get(1, 0), 1) / max(share.get(0, 0), 1)
    return lexicon, weights, bias + float(np.log(true / drawn))


def _featured(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon_of(lexicon)
        for batch in batches:
            values = [known.features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("toxic"), pa.array(values, pa.list_(pa.float64()))], names=["d", "toxic", "features"])

    return rows.mapInArrow(frugal(run, "toxicity"), "d long, toxic int, features array<double>")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; the score depends on the text alone.

    Null and empty texts get the score of a text without hits. A row without an id is not held out. Rows that repeat an id are scored each; extra columns are
    ignored; an empty table gives no rows. Without labels of both classes every score is low. Texts aren't shuffled.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    lexicon, weights, bias = train(rows, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon_of(lexicon)
        for batch in batches:
            x = np.array([known.features(t) for t in batch.column("text").to_pylist()], dtype=float).reshape(-1, N_FEATURES)
            p = 1 / (1 + np.exp(-((x * weights).sum(axis=1) + bias).clip(-30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return rows.mapInArrow(frugal(run, "toxicity"), "doc_id long, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for all documents."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold; nothing is shuffled.

    Null and empty texts stay. The classifier is trained as in score(), on rows of docs.
    """
    bounded_batches(docs.sparkSession)
    lexicon, weights, bias = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(text_col).alias("text")), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon_of(lexicon)
        for batch in batches:
            x = np.array([known.features(t or "") for t in batch.column(text_col).to_pylist()], dtype=float).reshape(-1, N_FEATURES)
            p = 1 / (1 + np.exp(-((x * weights).sum(axis=1) + bias).clip(-30, 30)))
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(frugal(run, "toxicity"), docs.schema)
