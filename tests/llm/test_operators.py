"""The operators on small documents: edge cases, and brute force where SQL can't say it."""

import collections
import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from larkspur.llm import decontamination, exact_dedup, line_dedup, ngram_join, packing, pii, sharding, substring_dedup, tokens, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _texts() -> list[tuple]:
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = [say(60) + "." for _ in range(12)]
    passage = say(60)
    out = [None, "", " ", "word", "Two words", "two WORDS", *base, *base[:3], base[0]]
    for b in base[:6]:
        for _ in range(3):
            ws = b.split(" ")
            ws[r.randrange(len(ws))] = "changed"
            out.append(" ".join(ws))
    out += [say(30) + ". " + passage + ". " + say(20) + "." for _ in range(5)]
    out += [say(9000), "é" * 200 + "日本語" * 80, "a" * 500, "\n\n..!! \n", say(5) + "\n" + say(8) + ".\n" + passage]
    return [(i, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y", 1) for i, t in _texts()]
    rows.append(rows[8])  # a repeated row
    schema = "doc_id long, text string, name string, size string, _n int"  # names that operators might use themselves
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def _rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_sharding(docs, empty):
    out = _rows(sharding.shard_documents(docs, 4))
    text, slots = dict(_texts()), collections.defaultdict(list)
    where = collections.defaultdict(set)
    for r in out:
        t = (text[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t)
        slots[r["shard"]].append(r["slot"])
        where[t].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())
    assert sharding.shard_documents(empty).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_smallest_capacity(seed):
    r = random.Random(seed)
    sizes, shards = [r.randint(0, 30) for _ in range(9)], 3
    best = min(max(sum(sizes[a:b]) for a, b in itertools.pairwise([0, *cuts, 9])) for cuts in itertools.combinations_with_replacement(range(10), shards - 1))
    assert sharding.smallest_capacity(sizes, shards) == best


def test_one_hot_group_leaves_others_even():
    to = sharding.assign([10] * 50 + [1000] + [10] * 50, 4)
    loads = collections.Counter()
    for s, k in zip([10] * 50 + [1000] + [10] * 50, to):
        loads[int(k)] += s
    assert sorted(loads.values())[-1] == 1000 and min(loads.values()) >= 320


def _ids(text):
    """By a tokenizer of the library as it comes."""
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokens.default_tokenizer()).encode(text or "", add_special_tokens=False).ids, 2]


def test_tokens(spark, docs, empty, tmp_path):
    tokens.write_tokens(docs, f"file://{tmp_path}/a")
    got = sorted(_rows(tokens.read_tokens(spark, f"file://{tmp_path}/a")), key=lambda r: r["start"])
    text, at = dict(_texts()), 0
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got) and len(got) == docs.count()
    for r in got:
        assert r["tokens"] == _ids(text[r["doc_id"]]) and r["start"] == at and r["n_tokens"] == len(r["tokens"])
        at += r["n_tokens"]
    tokens.write_tokens(empty, f"file://{tmp_path}/b")
    assert tokens.read_tokens(spark, f"file://{tmp_path}/b").count() == 0


def test_encoder_is_exact(monkeypatch):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_tokenizer())
    e = tokens.Encoder(tokens.default_tokenizer())
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    r = random.Random(5)
    pieces = [*" \n\t'sabé1²_.!-  ", "  ", " \n", "\n ", "\r\n", "\u3000", "\u00a0 ", "it's ", "日本 ", "<|endoftext|>", " <|endoftext|> ", "word ", "two words "]
    texts = ["", " ", "  a", "a ", "it's 've", "²x ½_y", "a　b", "x\x1cy", "x\x85 y", "日本 語", "a<|endoftext|>b", *("".join(r.choice(pieces) for _ in range(40)) for _ in range(600))]
    for some in (texts[:20], texts, texts):
        expected = [x.ids for x in plain.encode_batch(some, add_special_tokens=False)]
        ids, at = e.encode(some)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == expected
        ids, at = e.encode(some, 2)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [[*x, 2] for x in expected]


def test_packing(docs, empty):
    text = dict(_texts())
    pieces, fill = collections.defaultdict(list), collections.defaultdict(list)
    for r in _rows(packing.pack(docs)):
        ids = _ids(text[r["doc_id"]])[r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, p in pieces.items():
        n = 2 if i == 8 else 1
        assert sum(x[2] for x in p) == n * len(_ids(text[i])) and all(x[2] == 1024 for x in p if x[0])
    for f in fill.values():
        ends = [0, *itertools.accumulate(x[1] for x in sorted(f))]
        assert [x[0] for x in sorted(f)] == ends[:-1] and ends[-1] <= 1024
    assert packing.pack(empty).count() == 0


def test_packing_plan_is_tight():
    r = random.Random(2)
    counts = collections.Counter(r.randint(1, 1023) for _ in range(20000))
    runs, used = packing.best_plan(dict(counts))
    assert packing.TRIED and all(large < 1 for _, large in packing.TRIED)
    assert used <= 1.01 * -(-sum(k * n for k, n in counts.items()) // 1024)
    assert collections.Counter({int(k): int(sum(x[2] for x in runs if x[0] == k)) for k in counts}) == counts


def _shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates(docs, empty):
    sets = {i: _shingles(t) for i, t in _texts()}
    up = {i: i for i in sets}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = _rows(ngram_join.near_duplicates(docs))
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), root(r["doc_id"]))
    assert ngram_join.near_duplicates(empty).count() == 0


def test_large_groups_in_blocks(spark, docs, monkeypatch):
    expected = sorted(map(str, _rows(ngram_join.near_duplicates(docs))))
    monkeypatch.setattr(ngram_join, "FEW_EDGES", 0)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 100)
    assert sorted(map(str, _rows(ngram_join.near_duplicates(docs)))) == expected


@pytest.mark.parametrize("seed", range(4))
def test_trie_search(seed):
    import numpy as np

    r = random.Random(seed)
    sets = []
    for _ in range(30):
        base = r.sample(range(60), r.randint(1, 20)) if not sets or r.random() < 0.4 else [x for x in r.choice(sets) if r.random() < 0.95] + [r.randrange(60)]
        sets.append(sorted(set(base)))
    trie = ngram_join.Trie([np.array(s) for s in sets], 60)
    for s in sets:
        expected = {k for k, o in enumerate(sets) if 100 * len({*s} & {*o}) >= 80 * len({*s} | {*o})}
        assert set(trie.search(np.array(s), 80).tolist()) == expected


def test_exact_duplicates(docs, empty):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    rows = con.sql(exact_dedup.OP7_SQL).fetchall()
    got = [tuple(r) for r in exact_dedup.exact_duplicates(docs, block=64).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(map(str, got)) == sorted(map(str, rows))
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_contamination(spark, docs, empty):
    text = dict(_texts())
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    passage = words(text[max(text)])
    items = [(1, " ".join(passage[20:45])), (2, "Two Words"), (3, None), (4, "..."), (5, "never seen words at all in any of the texts here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    for r in _rows(decontamination.decontaminate(docs, bench)):
        w, hit, found = words(text[r["doc_id"]]), set(), set()
        for x, ids in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found |= ids
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(found), sha, bool(hit))
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_benchmark_too_large_to_broadcast(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(1, dict(_texts())[6]), (2, "Two Words"), (3, dict(_texts())[7]), (4, dict(_texts())[max(dict(_texts()))])], "item_id long, text string")
    expected = sorted(map(str, _rows(decontamination.decontaminate(docs, bench))))
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    assert sorted(map(str, _rows(decontamination.decontaminate(docs, bench)))) == expected


def test_substrings(docs, empty):
    text, seen, expected = dict(_texts()), set(), {}
    for i in sorted(text):
        b = (text[i] or "").encode()
        gone = bytearray(len(b))
        own = {b[k : k + 50] for k in range(len(b) - 49)}
        for k in range(len(b) - 49):
            if b[k : k + 50] in seen:
                gone[k : k + 50] = b"\1" * 50
        seen |= own
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        expected[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    got = _rows(substring_dedup.substring_duplicates(docs))
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == expected[r["doc_id"]]
    assert substring_dedup.substring_duplicates(empty).count() == 0


PII = "Call +1 (743) 555-3824 or mail ann.b@mail1.example.com, card 4465758382889437, host 10.0.0.255, not 10.0.0.256 nor 1234567890123456. Later: 1 (743) 555-3824 again."


def test_pii(spark, empty):
    df = spark.createDataFrame([(1, PII), (2, None), (3, ""), (4, "no data"), (None, "a@b.c @ a@@b.c x@y 1.2.3.4.5.6.7.8")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in _rows(pii.find_pii(df))}
    for i, t in ((1, PII), (2, ""), (4, "no data"), (None, "a@b.c @ a@@b.c x@y 1.2.3.4.5.6.7.8")):
        base = sorted((m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in pii.PATTERNS[kind].finditer(t) if pii._valid(kind, m[0]))
        shown = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert got[i]["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert set(shown.split(",")) <= set(got[i]["spans"].split(","))
    assert [got[1][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1]
    assert pii.find_pii(empty).count() == 0


def test_distant_repeats_share_a_label():
    texts = [f"dial +1 (7{i:02d}) 555-38{i:02d} now or {i} times" for i in range(40)] + [f"item {i}00 of {i}12345 and 7{i:02d}5553" for i in range(40)]
    weights, agree = pii.train(pii.patterns(texts))
    nodes, x, edges = pii._graph("at +1 (743) 555-3824 and later (743) 555-3824 too")
    assert [e[2] for e in edges if e[2]] == [1]
    alone = pii.beliefs(x, [], weights, agree)
    together = pii.beliefs(x, edges, weights, agree)
    assert together[1][pii.LABELS.index("phone")] > alone[1][pii.LABELS.index("phone")]


def test_field_adds_what_the_patterns_miss():
    texts = [f"pay {4000000000000000 + 7919 * i} or dial +1 (7{i:02d}) 555-38{i:02d}, version {i}.0" for i in range(200)]
    weights, agree = pii.train(pii.patterns(texts))
    text = "the number 9807915762804490 fails its check, and nothing else here, not 12 or 3.0 or 2024, is one"
    base, found = pii.all_spans(text, weights, agree)
    assert base == [] and [(text[a:b], k) for a, b, k in found] == [("9807915762804490", "card")]


@pytest.mark.parametrize("seed", range(5))
def test_beliefs_equal_enumeration_on_trees(seed):
    import numpy as np

    r = np.random.default_rng(seed)
    n, labels = 5, len(pii.LABELS)
    x, weights, agree = r.integers(0, 2, (n, 18)).astype(float), r.normal(0, 0.4, (labels, 18)), r.uniform(0, 1.5, 2)
    edges = [(int(r.integers(0, i)), i, int(r.integers(0, 2))) for i in range(1, n)]
    total = np.zeros((n, labels))
    for y in itertools.product(range(labels), repeat=n):
        p = math.exp(sum(float(x[i] @ weights[k]) for i, k in enumerate(y)) + sum(agree[kind] for i, j, kind in edges if y[i] == y[j]))
        for i, k in enumerate(y):
            total[i, k] += p
    assert np.allclose(pii.beliefs(x, edges, weights, agree), total / total.sum(axis=1, keepdims=True), atol=1e-6)


def test_pii_ignores_clashing_columns(spark):
    df = spark.createDataFrame([(None, "a@b.cd", 1, "x"), (None, "a@b.cd", 2, "y"), (5, "x" * 100_000 + " 10.0.0.1", 3, None)], "doc_id long, text string, n_ip int, spans string")
    got = sorted((r["doc_id"] or 0, r["n_email"], r["n_ip"], r["spans"]) for r in _rows(pii.find_pii(df)))
    assert got == [(0, 1, 0, "email:0:6")] * 2 + [(5, 0, 1, "ip:100001:100009")]


def test_automaton():
    lexicon = toxicity.Lexicon({"worthless": 4.0, "stupid": 4.5, "sometimes": 2.0})
    for word, value in (("worthles", 4.0), ("wortthless", 4.0), ("w0rthless", 4.0), ("stupld", 4.5), ("xworthless", 4.0), ("wrthles", 0.0), ("student", 0.0), ("sometims", 0.0)):
        assert lexicon.match(word) == value


def test_automaton_meets_the_whole_lexicon():
    terms = {"worthless": 2.0, "stupid": 1.0, "sometimes": 1.6, "idiot": 3.0, "scum": 1.5, "scums": 2.5}
    lexicon = toxicity.lexicon_of(terms)
    edits = lambda w: {w[:i] + c + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) for c in ("", "a", "0", "m", "s") if j <= len(w)}
    for word in set().union(*map(edits, terms)) | {"wrthles", "student", "ido", "", "u"}:
        assert lexicon.match(word) == max((v for t, v in terms.items() if _one_edit(word, t)), default=0.0), word
    assert lexicon.match("sometims") == 1.6 and lexicon.match("1diot") == 3.0 and lexicon.match("scvm") == 1.5


def _one_edit(a: str, b: str) -> bool:
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a == b or a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def test_hits_count_by_their_context():
    lexicon = toxicity.lexicon_of({"worthless": 4.0, "stupid": 4.5})
    total = lambda text: math.expm1(lexicon.features(text)[0])
    for word in ("worthless", "worthles"):  # misspelled terms are hits like others, quoted and beside others too
        assert total(f"you are {word}") == pytest.approx(4.0)
        assert total(f'they said "{word}" once') == pytest.approx(4.0 * toxicity.QUOTED)
        assert total(f'a "quote" and {word}') == pytest.approx(4.0) == total(f'5" long\n{word} "x"')
        assert total(f"{word} stupld") == pytest.approx(8.5 * (1 + toxicity.MORE))
        assert total(f"{word} " + "word " * 30 + "stupld") == pytest.approx(8.5)
    assert lexicon.features("a word") == [0.0] * toxicity.N_FEATURES == lexicon.features("")


def test_misspelling_quotation_and_context_decide(spark):
    """An ablation: the same learned weights with each of the three taken away give other decisions on the cases they are for."""
    r = random.Random(1)
    calm = ["the", "house", "river", "green", "walks", "table", "morning", "window"]
    say = lambda n: [r.choice(calm) for _ in range(n)]
    rows, labels = [], []
    for i in range(600):
        w = say(60)
        if i % 3 == 0:  # abuse: terms close together
            at = r.randrange(50)
            for k in (0, 2, 4):
                w[at + k] = r.choice(["dreadful", "horrible", "worthless"])
        elif i % 12 == 1:  # a clean text that quotes
            w[r.randrange(60)] = r.choice(['"dreadful"', '"horrible"', '"worthless"'])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    rows += [(1000, None), (None, "house"), (1001, " ".join(say(30) + ["dreadfull", "of", "horible", "the", "wortless"] + say(25))), (1002, " ".join(say(20) + ['"dreadful horrible worthless"'] + say(35)))]
    docs = spark.createDataFrame([(*x, 1.0, "s", 7) for x in rows], "doc_id long, text string, score double, toxic string, d int")
    marks = spark.createDataFrame([(*x, 0.5) for x in labels], "doc_id long, toxic int, text double")
    got = {x["doc_id"]: x for x in _rows(toxicity.score(docs, marks))}
    assert sum(got[i]["predicted"] == y for i, y in labels) >= 0.98 * len(labels)
    assert (got[1001]["predicted"], got[1002]["predicted"], got[1000]["predicted"], got[None]["predicted"], got[None]["held_out"]) == (1, 0, 0, 0, False)
    lexicon, weights, bias = toxicity.train(docs.select("doc_id", "text"), marks)
    chance = lambda text: 1 / (1 + math.exp(-float((toxicity.lexicon_of(lexicon).features(text) * weights).sum() + bias)))
    exact = toxicity.Lexicon(lexicon, least_odds=math.inf)  # without misspellings
    assert 1 / (1 + math.exp(-float((exact.features(dict(rows)[1001]) * weights).sum() + bias))) < 0.5 <= chance(dict(rows)[1001])
    assert chance(dict(rows)[1002]) < 0.5 <= chance(dict(rows)[1002].replace('"', ""))  # without quotation
    near, apart = say(28) + ["dreadful", "horrible"] + say(30), ["dreadful"] + say(58) + ["horrible"]
    assert chance(" ".join(near)) > chance(" ".join(apart))  # without context they would be alike


def test_toxicity_learns(spark, empty):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = [r.choice(["the", "house", "river", "green", "walks", "table"]) for _ in range(30)]
        if bad:
            w[r.randrange(30)] = w[r.randrange(30)] = "dreadful"
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in _rows(toxicity.score(docs, marks))}
    assert all(got[i]["predicted"] == y for i, y in labels) and got[1000]["predicted"] == got[1001]["predicted"] == 0
    assert got[0]["held_out"] == (zlib.crc32(b"0") % 5 == 0)
    assert {r["doc_id"] for r in _rows(toxicity.keep_clean(docs, marks))} == {i for i, _ in rows} - {i for i, y in labels if y}
    assert toxicity.score(empty, marks.limit(0)).count() == 0


def test_encoder_in_runs(monkeypatch):
    """Texts cut into runs, words learned many at a time, and words beyond those remembered give the library's ids."""
    import random

    from tokenizers import Tokenizer

    from larkspur.llm import tokens

    monkeypatch.setattr(tokens, "RUN", 200)
    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    plain, ours, rng = Tokenizer.from_file(tokens.default_tokenizer()), tokens.Encoder(tokens.default_tokenizer()), random.Random(3)
    odd = ["word", "Ünï", " ", "  ", "\n", "\n\n", "x1", "'s", "it's", "...", "日本語", "42", "\t", " a", " the", "é", " !?", "d'll"]
    texts = ["".join(rng.choices([*odd, "<|endoftext|>", "\x1d"] if i % 3 else [*odd, " b ", f" w{i}"], k=rng.choice([0, 1, 5, 50, 900]))) for i in range(300)]
    assert sum(len(ours._runs(t)) > 1 for t in texts) > 10
    for some in (texts[:7], texts, texts[::-1]):
        ids, bounds = ours.encode(some, 2)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [plain.encode(t, add_special_tokens=False).ids + [2] for t in some]


def test_workers_forget(spark):
    """A task of one operator empties what another kept in the same Python worker, and leaves its own."""
    import pyarrow as pa

    from larkspur.llm import shared

    def keep(batches):
        for batch in batches:
            shared.memory_of("one")["kept"] = shared.memory_of("two")["kept"] = 1
            yield batch

    def left(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"one": [len(shared.memory_of("one"))], "two": [len(shared.memory_of("two"))]})

    def both(batches):  # one task, so one worker, as two tasks would be that share it
        rows = list(shared.frugal(keep)(batches))
        yield from shared.frugal(left, "two")(rows)

    assert [tuple(r) for r in spark.range(1).coalesce(1).mapInArrow(both, "one long, two long").collect()] == [(0, 1)]


def test_pretokens_are_cut_as_the_pattern_does():
    import random

    import regex

    from larkspur.llm import tokens

    e, pattern, rng = tokens.Encoder(tokens.default_tokenizer()), regex.compile(tokens.PRETOKEN), random.Random(5)
    bits = ["'", "'s", "'re", "'ll", "'ve", "'d", " ", "  ", "\n", " \n", "\t", "a", "e", "l", "r", "s", "S", "1", "٣", "\xb2", "!", ".", "\xe9", "\xaa", "中", "\U0001f600", "　", "\xa0", "​", "́", "\0"]
    for _ in range(4000):
        texts = ["".join(rng.choices(bits, k=rng.randint(0, 9))) for _ in range(rng.randint(0, 4))]
        words, counts = e._cut(texts)
        expected = [pattern.findall(t) for t in texts]
        assert (words.to_pylist(), counts.tolist()) == ([w for x in expected for w in x], [len(x) for x in expected])


def test_a_word_is_looked_up_once_in_a_run():
    from collections import defaultdict
    from itertools import count

    from tokenizers import Tokenizer

    from larkspur.llm import tokens

    class Counting(defaultdict):
        asked = 0

        def __getitem__(self, word):
            self.asked += 1
            return super().__getitem__(word)

    plain, e = Tokenizer.from_file(tokens.default_tokenizer()), tokens.Encoder(tokens.default_tokenizer())
    e.index = Counting(count().__next__)
    texts = ["one two, it's žluva " * 1000, "", "two<|endoftext|> one", "one\x1ctwo", "two  \n one " * 500]
    ids, bounds = e.encode(texts, 2)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert e.index.asked < 50
