"""Import of raw tables, street operators and the catalogue against DuckDB."""

import os

import duckdb
import pytest

from larkspur.plans.catalogue import CATALOGUE
from larkspur.sources import psv

DATA = "/root/testdata/sf0.001"


def test_psv_rows(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "VIC_LOCALITY_psv.psv").write_text("A|B|C\n1||x\n\"\"|'|  y\ntoo|few\na|b|c|d\n")
    (tmp_path / "NSW_LOCALITY_psv.psv").write_text("A|B|C\n2|q|z\n")
    (tmp_path / "Authority_Code_FLAT_TYPE_AUT_psv.psv").write_text("CODE|NAME\nU|UNIT\n")
    files = psv.list_files(spark, str(tmp_path))
    assert [os.path.basename(f) for f in psv.state_files(files, "LOCALITY", ["VIC"])] == ["VIC_LOCALITY_psv.psv"]
    assert len(psv.national_files(files, "LOCALITY")) == 2 and len(psv.authority_files(files, "FLAT_TYPE_AUT")) == 1
    rows = psv.read_psv(spark, psv.state_files(files, "LOCALITY", psv.chosen_states(" vic, nsw ")))
    assert sorted((r.a, r.b, r.c) for r in rows.collect() if r.a) == [("1", None, "x"), ("2", "q", "z")]
    assert rows.count() == 3 and psv.read_psv(spark, []) is None


def test_shards_and_pointer(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "s string, v int")
    psv.write_shards(df, "s", str(tmp_path / "out"))
    assert psv.read_shard(spark, str(tmp_path / "out"), "s", "a").count() == 2
    psv.publish(spark, {"version": "v1", "datum": "x"}, str(tmp_path / "pub"))
    assert psv.latest_version(spark, str(tmp_path / "pub")) == "v1"


@pytest.mark.parametrize("name", [n for n, (_, sql) in CATALOGUE.items() if sql])
def test_catalogue(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "part", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    run, sql = CATALOGUE[name]
    df, rel = run(spark, DATA), con.sql(sql)
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    expected = rel.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, expected))


def test_every_short_query_is_answered(spark):
    from larkspur.functions.parse import parse, score
    from larkspur.operators import search
    from larkspur.plans.catalogue import _entries, _streets

    limit, threshold = 4, 3
    streets, entries = _streets(spark, DATA).persist(), _entries(spark, DATA).persist()
    got = {}
    for r in search.precomputed(streets, entries, limit, threshold).collect():
        got.setdefault((r.q, r.kind), []).append((r.place, r.street_id, r.gnaf_pid, r.score))
    rows, by_street = sorted(streets.collect(), key=lambda r: r.street_id), {}
    for e in entries.collect():
        by_street.setdefault(e.street_key, []).append(e)
    universe = [r.q for r in search.short_queries(spark).collect()]
    assert len(universe) == 3672 and {q for q, _ in got} <= set(universe)
    digit = lambda e: None if e.number_first is None else str(e.number_first)[0]
    for q in [*universe[:712], *universe[712:812], *universe[812::7], "1 m", "05 r", "5 r", "se"]:
        p = parse(q)
        number = p.street if p else int(q) if q.isdigit() else None
        hits = []
        for s in rows if p or q.isdigit() else []:
            w = p.words[0] if p else ""
            fits = number is None or (s.num_min is not None and s.num_min <= number <= s.num_max)
            if fits and any((x or "").startswith(w) for x in (s.street_name, s.locality_name, s.state)):
                points = 0 if not p else (115 if s.street_name == w else 10 if (s.street_name or "").startswith(w) else 0) + next((v for k, v in ((2000, 20), (500, 15), (100, 10), (20, 5)) if s.address_count >= k), 0) + (200 if number is not None else 0)
                hits.append((-points, -s.address_count, s.street_id, s))
        hits = sorted(hits, key=lambda h: h[:3])[: limit if number is None else 30]
        assert sorted(got.get((q, "street"), [])) == [(i + 1, h[2], None, -h[0]) for i, h in enumerate(hits[:limit])], q
        found = []
        for rank, (*_, s) in enumerate(hits):
            every = by_street[s.street_key]
            split = len(every) > threshold and any(digit(e) for e in every)
            least = min((digit(e) for e in every if digit(e)), default=None)
            ranked = []
            for e in every:
                if split and not (digit(e) in (None, least) if number is None else digit(e) == str(number)[0]):
                    continue
                if p:
                    v = score(dict(d=e.display_prefix, n=e.number_first, n2=e.number_last, f=e.flat_number, l=e.level_number), p)
                else:
                    bare = e.flat_number is None and e.level_number is None
                    v = (100 if bare else 90) if e.number_first == number else 50 if None not in (e.number_first, e.number_last) and e.number_first <= number <= e.number_last else 0
                if v:
                    ranked.append((-v, rank, e.gnaf_pid, s.street_id))
            found += [(int(k > 0 and not (p and p.numbers)), *x) for k, x in enumerate(sorted(ranked))]
        assert sorted(got.get((q, "address"), [])) == [(i + 1, x[4], x[3], -x[1]) for i, x in enumerate(sorted(found)[:limit])], q
    assert not any((q, k) in got for q in ("m", "1 m", "12 l", "se") for k in ("street", "address"))


def test_archives_versions_and_counts(spark, tmp_path):
    rows = [("GDA94 feb", "ZIP", "active", "2024-02-01T00:00:00", "2020-01-01T00:00:00"), ("gda94 new", "ZIP", "active", None, "2024-05-01T00:00:00"), ("GDA94 old", "ZIP", "deleted", "2025-01-01T00:00:00", None), ("GDA2020", "ZIP", "active", "2025-01-01T00:00:00", None), ("GDA94 txt", "TXT", "active", "2025-01-01T00:00:00", None)]
    df = spark.createDataFrame(rows, "name string, format string, state string, last_modified string, created string")
    assert [r.name for r in psv.newest_archive(df, "GDA94").collect()] == ["gda94 new"] and psv.newest_archive(df, "AGD66").count() == 0
    assert psv.version_of("2024-05-06T07:08:09Z", "GDA94") == "v20240506-gda94"
    assert not psv.exists(spark, str(tmp_path / "none")) and not psv.exists(spark, str(tmp_path))
    (tmp_path / "x").write_text("1")
    assert psv.exists(spark, str(tmp_path)) and psv.exists(spark, str(tmp_path / "x"))
    parts = spark.createDataFrame([(100, 3, 2), (100, 5, 1)], "totalAddresses long, totalShards long, totalLotDpShards long")
    assert [tuple(r) for r in psv.merged_counts(parts).collect()] == [(100, 8, 3)]
    shards = spark.createDataFrame([("a01",), ("b22",), ("a9f",)], "s string")
    assert psv.with_prefix(shards, "s", "a").count() == 2 and psv.with_prefix(shards, "s", None).count() == 3


def test_sql_script(spark):
    import sqlite3

    from larkspur.plans.catalogue import _script_rows

    rows = _script_rows(spark, DATA).withColumn("display", psv.F.concat(psv.F.lit("O'"), "display")).persist()
    script = "\n".join(r.value for r in psv.sql_script(rows, 7).orderBy("statement").collect())
    con = sqlite3.connect(":memory:")
    con.executescript(script)
    assert sorted(map(repr, con.execute(f"SELECT {', '.join(psv.STREET_COLUMNS)} FROM streets").fetchall())) == sorted(repr(tuple(r)) for r in rows.select(*psv.STREET_COLUMNS).collect())


def test_layer_settings():
    from larkspur.operators.lookup import layer_settings

    assert layer_settings('[{"name": "a"}]') == layer_settings('[{\\"name\\": \\"a\\"}]') == [{"name": "a"}]
    assert layer_settings("no") == layer_settings("{}") == []


def test_whole_answers(spark, tmp_path):
    from larkspur.functions.highlight import highlight
    from larkspur.operators import search
    from larkspur.operators.answer import answer, checked
    from larkspur.plans.catalogue import _entries, _streets

    streets, entries = _streets(spark, DATA).persist(), _entries(spark, DATA).persist()
    index = search.postings(streets).persist()
    ask = lambda q, limit=5, **more: answer(spark, streets, index, entries, q, limit, 20, **more)
    with pytest.raises(ValueError):
        ask("  ")
    assert checked(" a ", "99") == ("a", 50) and ask("q") == ask("--") == {"streets": [], "addresses": []}
    got = ask("5 red st")
    assert 0 < len(got["streets"]) <= 5 and 0 < len(got["addresses"]) <= 5
    assert [a["gnaf_pid"] for a in got["addresses"]] == [r.gnaf_pid for r in search.search(streets, index, entries, "5 red st", 5, 20).collect()]
    for s in got["streets"]:
        assert "RED" in [s["display"][a:b] for a, b in s["highlight"]]
    for a in got["addresses"]:
        assert a["highlight"] and all(0 <= x < y <= len(a["sla"]) for x, y in a["highlight"])
    assert ask("12")["streets"] == [] and ask("12")["addresses"]
    assert highlight("5 RED ST, X", {"prefix": "5", "street_name": "RED", "street_type": "ST", "street_suffix": None, "locality": "X", "state": "S", "postcode": None}, "5 re") == [(0, 1), (2, 4)]
    where = str(tmp_path / "ready")
    ready = search.precomputed(streets, entries, 4, 20).where("q in ('r', '12')")
    psv.write_answers(ready, where)
    assert psv.read_answer(spark, where, "r").count() == ready.where("q = 'r'").count() and psv.read_answer(spark, str(tmp_path / "no"), "r") is None
    short = ask("R", precomputed=where)
    assert [x["text"] for x in short["streets"]] == [r.text for r in ready.where("q = 'r' and kind = 'street'").orderBy("place").collect()]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    from larkspur.streaming.warm import answer_stream, write_queue

    queue, target, mark = (str(tmp_path / x) for x in ("queue", "answers", "mark"))
    write_queue(spark.createDataFrame([(f"q{i}",) for i in range(20)], "q string"), queue, 5)
    run = lambda: answer_stream(spark, queue, lambda b: b.selectExpr("q", "length(q) as n"), target, mark).awaitTermination(120)
    run()
    assert spark.read.parquet(target).count() == 20 and spark.read.parquet(target).select("batch").distinct().count() > 1
    spark.createDataFrame([("new",)], "q string").write.mode("append").parquet(queue)
    run()
    assert sorted(r.q for r in spark.read.parquet(target).collect()) == sorted([*(f"q{i}" for i in range(20)), "new"])


_FRESH = """
import sys
from pyspark.sql import SparkSession
from larkspur.plans.catalogue import CATALOGUE
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
df = CATALOGUE["polygon_overlay"][0](spark, sys.argv[1])
plan = df._jdf.queryExecution().optimizedPlan().toString()
print("rows", len(df.collect()), plan.count("!Filter"), plan.count("zip_with"))
"""


def test_overlay_as_first_query():
    """A session's first overlay: the optimizer, by the numbers of its columns, once restated ray casting over keys not joined yet."""
    import subprocess
    import sys

    where = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", _FRESH, DATA], cwd=where, capture_output=True, text=True, timeout=300, env=os.environ | {"TZ": "UTC"})
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "part", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    n = con.sql(f"SELECT count(*) FROM ({CATALOGUE['polygon_overlay'][1]})").fetchall()[0][0]
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.split("rows ")[-1].split() == [str(n), "0", "1"]
