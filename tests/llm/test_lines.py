"""Repeated passages against brute force, with repeated ids and texts, and passages that begin within lines."""

import collections
import random
import re

import pytest

from larkspur.llm import line_dedup

UNIT = re.compile(r"[^\s.!?。！？][^\n.!?。！？]*[.!?。！？]*")


def brute(rows, least):
    """Spans of each distinct (id, text)."""
    keys = sorted({(i is None, i or 0, t or "") for i, t in rows})
    places = collections.defaultdict(list)
    for none, i, t in keys:
        for m in UNIT.finditer(t):
            places[" ".join(m[0].lower().split())].append((none, i, t, m.start()))
    copies = collections.Counter((i is None, i or 0, t or "") for i, t in rows)
    out = {}
    for key in keys:
        spans, run, size = [], None, 0
        for m in [*UNIT.finditer(key[2]), None]:
            unit = " ".join(m[0].lower().split()) if m else None
            if m and (*key, m.start()) != min(places[unit], key=lambda p: (p[0], p[1], FIT[p[2]], p[3])):
                run, size = (run[0] if run else m.start(), m.end()), size + len(unit.encode())
            else:
                if run and size >= least:
                    spans.append(run)
                run, size = None, 0
        out[key] = spans
    return out


FIT: dict = {}


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    say = lambda n: " ".join("".join(r.choice("abcdef日") for _ in range(r.randint(2, 6))) for _ in range(n))
    sentences = [say(r.randint(1, 12)) + r.choice([".", "!", "。", "\n"]) for _ in range(30)]
    rows = [(1, None), (2, ""), (3, " .. \n")]
    rows += [(i, r.choice([" ", "\n"]).join(r.choice(sentences) if r.random() < 0.6 else say(9) + "." for _ in range(r.randint(1, 25)))) for i in range(10, 40)]
    rows += [rows[8], (rows[9][0], rows[10][1]), (None, rows[11][1]), (None, rows[11][1]), (None, say(20))]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, 0, 0, "x") for i, t in rows], "doc_id long, text string, start int, fit int, spans string").repartition(3)
    FIT.update({x[0] or "": x[1] for x in df.selectExpr("text", "xxhash64(coalesce(text, ''))").collect()})
    for least in (1, 60):
        want = brute(rows, least)
        got = line_dedup.line_duplicates(df, least).collect()
        assert len(got) == len(rows)
        for x in got:
            assert any([(s["start"], s["end"]) for s in x["spans"]] == w for k, w in want.items() if (k[0], k[1], len(k[2])) == (x["doc_id"] is None, x["doc_id"] or 0, x["n_chars"]))
            assert x["n_removed"] == len(x["spans"]) and x["removed_chars"] == sum(s["end"] - s["start"] for s in x["spans"]) <= x["n_chars"]


def test_rows_that_repeat_an_id_keep_one_survivor(spark):
    text = "One sentence that nothing else has but which is long enough to be looked at. " * 2
    other = "short"
    df = spark.createDataFrame([(2, text), (2, text), (3, text), (3, other), (4, "x " + text)], "doc_id long, text string")
    got = sorted((x["doc_id"], x["n_chars"], [tuple(s) for s in x["spans"]]) for x in line_dedup.line_duplicates(df, 60).collect())
    half = len(text) // 2
    assert got == [(2, len(text), [(half, 2 * half - 1)]), (2, len(text), [(half, 2 * half - 1)]), (3, 5, []), (3, len(text), [(0, 2 * half - 1)]), (4, len(text) + 2, [(2 + half, 2 * half + 1)])]


def test_empty_and_remove(spark):
    assert line_dedup.line_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert line_dedup.remove_spans("abcdef", [(1, 2), (4, 9)]) == "acd"
