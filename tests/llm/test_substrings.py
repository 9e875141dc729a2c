"""Repeated byte strings against brute force, in many small pieces, chunks, partitions and batches."""

import hashlib
import random

import numpy as np
import pytest

from larkspur.llm import substring_dedup as s


def brute(rows, length=50):
    """(n_bytes, n_removed, n_spans, sha) of each (id, text); rows of one id don't count as earlier than each other."""
    last = 1 << 62
    seen, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            seen[w] = min(seen.get(w, last + 1), last if i is None else i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] < (last if i is None else i):
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def texts(seed):
    r = random.Random(seed)
    say = lambda n: " ".join("".join(r.choice("abcdefgé") for _ in range(r.randint(2, 7))) for _ in range(n))
    base = [say(40) for _ in range(8)]
    passage, line = say(25), say(12)
    rows = [(1, None), (2, ""), (3, "short"), (4, "a" * 300), (5, "ab" * 200)]
    for i in range(10, 50):
        t = r.choice(base)
        if r.random() < 0.6:
            w = t.split()
            w[r.randrange(len(w))] = "other"
            t = " ".join(w)
        if r.random() < 0.5:
            t = say(r.randint(0, 9)) + passage + say(r.randint(0, 9)) + passage
        if r.random() < 0.3:
            t = line + t + line + line
        rows.append((i, t))
    rows += [rows[20], (rows[21][0], rows[25][1]), (None, base[0]), (None, base[0]), (None, say(30) + passage), (60, say(1500) + passage + say(1500))]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_in_small_pieces(spark, monkeypatch, seed):
    rows = texts(seed)
    if seed:
        for name, value in (("CHUNK", 1500), ("PART", 1000), ("PIECE", 700)):
            monkeypatch.setattr(s, name, value)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fit int, state string").repartition(3)
    got = sorted((tuple(x) for x in s.substring_duplicates(df).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("seed", range(4))
def test_levels_answer_as_all_earlier_batches(seed):
    r = np.random.default_rng(seed)
    key, phrase, rank = r.integers(0, 40, 600).astype(np.uint64), r.integers(0, 3, 600).astype(np.uint64), r.integers(0, 90, 600)
    code = (key << np.uint64(32)) | phrase
    for batch in (1, 7, 64, 1000):
        got = s.batches_of(code, rank, np.zeros(600, dtype=bool), batch)
        for k in range(600):
            earlier = rank < rank[k]
            whole = bool((code[earlier] == code[k]).any())
            other = bool(((key == key[k]) & (code != code[k]) & (rank != rank[k])).any())
            assert (got[k] == s._FULL) == whole and (whole or not other or got[k] == s._OPEN)
            assert got[k] == s._EMPTY or (key[rank != rank[k]] == key[k]).any()


def test_levels_stay_logarithmic():
    index = s.Levels()
    for k in range(200):
        index.add(np.arange(k * 100, k * 100 + 100, dtype=np.uint64))
        assert all(len(a) > 2 * len(b) for a, b in zip(index.levels, index.levels[1:])) and len(index.levels) <= 9
    assert index.scan(np.arange(0, 20000, 7, dtype=np.uint64))[0].all()
