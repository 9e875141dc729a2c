"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, whole

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LABELS = ("other", *KINDS)
#: The field is trained on the nodes of all documents, as counts of distinct patterns; at most so many patterns, the most frequent.
PATTERNS_KEPT = 20_000
#: A node is labelled if its belief reaches this.
BELIEF = 0.9
_ANY = re.compile(r"[0-9@]")
_NODE = re.compile(r"[^\s,;:\"'<>|]*@[^\s,;:\"'<>|]*[^\s,;:\"'<>|.]|[+(]?[0-9][0-9().\x20-]*[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _valid(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    if kind == "email":
        return True
    digits = "".join(c for c in text if "0" <= c <= "9")
    return 10 <= len(digits) <= 15 if kind == "phone" else 14 <= len(digits) <= 19 and _luhn(digits)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As finditer() of the pattern, without trying each letter of a text as a start: only near each @."""
    domain = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and (text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-")):
            begin -= 1
        m = domain.match(text, at) if begin < at else None
        if m:
            yield begin, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns: leftmost, not overlapping within a kind, failing matches dropped."""
    if not _ANY.search(text):
        return []
    found = []
    for k, kind in enumerate(KINDS):
        if kind == "email":
            spans = list(_emails(text))
        elif kind == "phone" and "+" not in text:
            continue
        else:
            spans = [m.span() for m in PATTERNS[kind].finditer(text)]
        found += [(a, k, b) for a, b in spans if _valid(kind, text[a:b])]
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


def _features(text: str, a: int, b: int) -> list[float]:
    s = text[a:b]
    digits, dots = sum(c.isdigit() for c in s), s.count(".")
    before, after = text[max(0, a - 1) : a], text[b : b + 1]
    return [1, "@" in s, "@" in s and "." in s.rpartition("@")[2], s[0] == "+", "(" in s, dots == 3, 0 < dots < 3, "-" in s, " " in s, digits < 7, 7 <= digits < 10, 10 <= digits < 14, digits >= 14, digits == len(s), digits > 19, before.isalnum(), after.isalnum(), dots == 3 and all(len(p) <= 3 for p in s.split("."))]


def _graph(text: str) -> tuple[list[tuple[int, int]], np.ndarray, list[tuple[int, int, int]]]:
    """Nodes (spans that may be personal data), their features, and edges (i, j, kind): 0 neighbours, 1 distant and similar.

    Skip edges link a node to the last node before it with the same last seven digits or the same word before the @, so
    their number is linear in the nodes.
    """
    nodes = [m.span() for m in _NODE.finditer(text)]
    edges, last = [], {}
    for i, (a, b) in enumerate(nodes):
        if i and a - nodes[i - 1][1] <= 40:
            edges.append((i - 1, i, 0))
        s = text[a:b]
        digits = "".join(c for c in s if "0" <= c <= "9")
        key = s.partition("@")[0].lower() if "@" in s else digits[-7:] if len(digits) >= 7 else ""
        if key:
            if key in last:
                edges.append((last[key], i, 1))
            last[key] = i
    return nodes, np.array([_features(text, a, b) for a, b in nodes], dtype=float).reshape(len(nodes), 18), edges


def _targets(text: str, nodes: list[tuple[int, int]], base: list[tuple[int, int, str]]) -> list[int]:
    """Weak labels: the kind of a base span that overlaps the node by half of either.

    A node that no base span covers but which looks like one (a card number that fails its checksum, a phone number without
    the plus sign, an address without a dot) has no label, -1: there the field decides. Others are none of the kinds.
    """
    out = []
    for a, b in nodes:
        best = 0
        for x, y, kind in base:
            if min(b, y) - max(a, x) > 0.5 * min(b - a, y - x):
                best = LABELS.index(kind)
        s = text[a:b]
        digits = sum("0" <= c <= "9" for c in s)
        if not best and ("@" in s[1:-1] or 14 <= digits <= 19 or 10 <= digits <= 15 and len(s) > digits and "." not in s):
            best = -1
        out.append(best)
    return out


_FEATURES = 18


def patterns(texts: Iterator[str | None]) -> dict[tuple[int, int, int], int]:
    """How often each (features as bits, labels of the neighbours by kind of edge as digits, weak label) occurs among labelled nodes."""
    out: dict[tuple[int, int, int], int] = {}
    for text in texts:
        if not text or not _ANY.search(text):
            continue
        nodes, features, edges = _graph(text)
        y = _targets(text, nodes, base_spans(text))
        near = [0] * len(nodes)
        for i, j, kind in edges:
            if y[j] >= 0:
                near[i] += 8 ** (kind * len(LABELS) + y[j])
            if y[i] >= 0:
                near[j] += 8 ** (kind * len(LABELS) + y[i])
        bits = (features.astype(np.int64) << np.arange(_FEATURES)).sum(axis=1).tolist() if nodes else []
        for key in zip(bits, near, y):
            if key[2] >= 0:
                out[key] = out.get(key, 0) + 1
    return out


def train(counts: dict[tuple[int, int, int], int], steps: int = 400, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(node weights, weights of agreement on the two kinds of edge) by pseudo-likelihood of the counted patterns().

    Kinds weigh alike, however rare they are; a node has at most two neighbours by each kind of edge.
    """
    weights, agree = np.zeros((len(LABELS), _FEATURES)), np.zeros(2)
    if not counts:
        return weights, agree
    keys = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[tuple(k)] for k in keys.tolist()], dtype=float)
    x = ((keys[:, 0][:, None] >> np.arange(_FEATURES)) & 1).astype(float)
    near = ((keys[:, 1][:, None] >> (3 * np.arange(2 * len(LABELS)))) & 7).reshape(-1, 2, len(LABELS)).astype(float)
    y = np.eye(len(LABELS))[keys[:, 2]]
    share = n[:, None] * y
    n = n / np.maximum(share.sum(axis=0), 1)[keys[:, 2]]
    n /= n.sum()
    for _ in range(steps):
        logits = np.stack([(x * w).sum(axis=1) for w in weights], axis=1) + (near * agree[None, :, None]).sum(axis=1)
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        gap = (y - p) * n[:, None]
        weights += rate * (np.stack([(x * gap[:, k, None]).sum(axis=0) for k in range(len(LABELS))]) - decay * weights)
        agree += rate * ((near * gap[:, None, :]).sum(axis=(0, 2)) - decay * agree)
    return weights, np.clip(agree, 0.5 * np.arange(2), 2.0)


def beliefs(features: np.ndarray, edges: list[tuple[int, int, int]], weights: np.ndarray, agree: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Marginals of each node's label by loopy message passing."""
    own = np.exp(np.stack([(features * w).sum(axis=1) for w in weights], axis=1).clip(-30, 30))
    own /= own.sum(axis=1, keepdims=True)
    if edges:
        tails = np.array([e[0] for e in edges] + [e[1] for e in edges])
        heads = np.array([e[1] for e in edges] + [e[0] for e in edges])
        gain = np.exp(agree[np.array([e[2] for e in edges] * 2)])[:, None] - 1
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        sent = np.full((len(tails), len(LABELS)), 1 / len(LABELS))
        for _ in range(rounds):
            log = np.log(own)
            np.add.at(log, heads, np.log(sent))
            out = log[tails] - np.log(sent[back])
            out = np.exp(out - out.max(axis=1, keepdims=True))
            out = out.sum(axis=1, keepdims=True) + gain * out
            sent = out / out.sum(axis=1, keepdims=True)
        log = np.log(own)
        np.add.at(log, heads, np.log(sent))
        own = np.exp(log - log.max(axis=1, keepdims=True))
    return own / own.sum(axis=1, keepdims=True)


def all_spans(text: str, weights: np.ndarray, agree: np.ndarray) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, base spans and those that the field adds, by start and kind)."""
    base = base_spans(text)
    if not _ANY.search(text):
        return base, base
    nodes, features, edges = _graph(text)
    more = []
    if nodes:
        p = beliefs(features, edges, weights, agree)
        starts = np.array([a for a, _, _ in base] + [1 << 60])
        for (a, b), row in zip(nodes, p):
            k = int(row.argmax())
            if k and row[k] >= BELIEF:
                i = int(np.searchsorted(starts, b))
                if not any(y > a for _, y, _ in base[max(0, i - 8) : i]):
                    more.append((a, b, LABELS[k]))
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", patterns_kept: int = PATTERNS_KEPT) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) for every row of docs.

    n_email to n_phone and base_sha256 are of the base spans; spans has those and what the field adds, n_spans their number.
    The field is trained on all documents: tasks count the distinct patterns of their nodes, and the driver gets the
    patterns_kept most frequent ones, no texts. Null text counts as empty: no spans. Rows that repeat an id are answered
    each; extra columns are ignored; an empty table gives no rows. Texts aren't shuffled.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = patterns(t for batch in batches for t in batch.column("text").to_pylist())
        keys = list(found)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[c] for k in keys], pa.int64()) for c in range(3)), pa.array([found[k] for k in keys], pa.int64())], names=["bits", "near", "label", "n"])

    counted = rows.select("text").mapInArrow(count, "bits long, near long, label long, n long").groupBy("bits", "near", "label").agg(F.sum("n").alias("n"))
    kept = counted.orderBy(F.desc("n"), "bits", "near", "label").limit(patterns_kept).collect()
    weights, agree = train({(r["bits"], r["near"], r["label"]): r["n"] for r in kept})
    show = lambda spans: ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], [], []]
            shas, spans = [], []
            for text in batch.column("text").to_pylist():
                base, found = all_spans(text, weights, agree)
                for c, kind in zip(counts, KINDS):
                    c.append(sum(k == kind for _, _, k in base))
                counts[4].append(len(found))
                shas.append(hashlib.sha256(show(base).encode()).hexdigest())
                spans.append(show(found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts[:4]), pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(counts[4], pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    return rows.mapInArrow(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
