"""The stages, and run(), against brute force on small tables with nulls, repeated ids and rows, and clashing names."""

import collections
import random

import pytest

from test_operators import LOW, _ids, _shingles  # noqa: F401

import corpus_pipeline as p

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _documents():
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    item = say(30)
    rows = []
    for i in range(300):
        t = say(r.randint(30, 60))
        if i % 4 == 0:
            w = t.split()
            w[3] = w[8] = w[15] = "dreadful"
            t = " ".join(w)
        rows.append((i, t))
    texts = [t for i, t in rows if i % 4]
    rows += [(400 + k, t) for k, t in enumerate(texts[:10])]
    rows += [(420 + k, t + " end") for k, t in enumerate(texts[5:20])]
    rows += [(450, "x " + item), (451, say(12) + " " + " ".join(item.split()[4:20])), (None, item + " y"), (None, texts[30]), (None, say(40)), (460, None), (461, ""), (1, say(45)), (2, texts[40])]
    rows += [rows[3], rows[-3]]
    return rows, item


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    rows, item = _documents()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(300)], "doc_id long, toxic int, quality int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def _key(row):
    return (row[0] is None, row[0] or 0, row[1] or "")


def _toxic(rows):
    return [r for r in rows if "dreadful" not in (r[1] or "")]


def _exact(rows):
    best = {}
    for i, t in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    return [r for r in rows if (-1 if r[0] is None else r[0]) == best[r[1] or ""]]


def _near(rows, fit):
    keys = sorted({_key(r) for r in rows})
    sets, up = {k: _shingles(k[2]) for k in keys}, {k: k for k in keys}

    def root(k):
        return k if up[k] == k else root(up[k])

    order = lambda k: (k[0], k[1], fit[k[2]])
    for a in keys:
        for b in keys:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                if x != y:
                    up[max(x, y, key=order)] = min(x, y, key=order)
    return [r for r in rows if root(_key(r)) == _key(r)]


def _clean(rows, item):
    w = item.split()
    windows = [" ".join(w[k : k + 10]) for k in range(len(w) - 9)]
    return [r for r in rows if not any(f" {x} " in f" {r[1] or ''} " for x in windows)]


def _shown(rows):
    return collections.Counter((r[0], r[1]) for r in rows)


def test_each_stage_and_all(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    _, item = _documents()
    now = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fit = {r[0]: r[1] for r in docs.selectExpr("coalesce(text, '')", "xxhash64(coalesce(text, ''))").collect()}
    for (name, stage), expected in zip(p.STAGES, (_toxic, _exact, lambda rows: _near(rows, fit), lambda rows: _clean(rows, item))):
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns, name
        now = expected(now)
        assert _shown((r["doc_id"], r["text"]) for r in out.collect()) == _shown(now), name
        docs = p.materialize(out, "test")
    got = collections.Counter()
    for r in p.run(spark, tables).collect():
        got[r["doc_id"]] += r["length"]
    assert got == sum((collections.Counter({i: len(_ids(t))}) for i, t in now), collections.Counter())


def test_stages_carry_clashing_columns_and_empty_tables(spark, tables):
    rows, _ = _documents()
    extra = "doc_id long, text string, _id int, _fit int, __own int, fit string, mark string, kept int, hits int, toxic int, n int"
    docs = spark.createDataFrame([(i, t, 1, 2, 3, "f", "m", 0, 0, 9, 5) for i, t in rows], extra)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns and {tuple(r)[2:] for r in out.collect()} == {(1, 2, 3, "f", "m", 0, 0, 9, 5)}, name
        assert stage(spark, docs.limit(0), tables).count() == 0, name
    assert p.packing(spark, docs.limit(0), tables).count() == 0
