"""Parsing, scoring and highlighting of queries."""

import random

import pytest

from larkspur.functions.highlight import highlight, merge
from larkspur.functions.parse import Term, is_short, normalise, parse, score
from larkspur.functions.words import FULL, SYNONYMS


@pytest.mark.parametrize(
    ("query", "words", "flat", "level", "street", "suffix"),
    [
        ("9 elm st", ("ELM", "ST"), None, None, 9, None),
        ("9C elm st", ("ELM", "ST"), None, None, 9, "C"),
        ("4/9 elm", ("ELM",), 4, None, 9, None),
        ("unit 4 9 elm", ("ELM",), 4, None, 9, None),
        ("level 2 9 elm", ("ELM",), None, 2, 9, None),
        ("level 2 suite 7 9 elm", ("ELM",), 7, 2, 9, None),
        ("unit 4 elm", ("ELM",), 4, None, None, None),
        ("9 elm st 3121", ("ELM", "ST"), None, None, 9, None),
        ("3121 elm st", ("ELM", "ST"), None, None, 3121, None),
        ("unit 5 5 elm", ("ELM",), 5, None, None, None),
        ("G2/9 elm", ("ELM",), 2, None, 9, None),
        ("lobby 3 elm", ("ELM",), None, 3, None, None),
    ],
)
def test_hints(query, words, flat, level, street, suffix):
    q = parse(query)
    assert (q.words, q.flat, q.level, q.street, q.suffix) == (words, flat, level, street, suffix)


@pytest.mark.parametrize("query", ["", "12", "m", "1 m", "12 l", "se", "unit 4"])
def test_no_words(query):
    assert parse(query) is None


def test_groups():
    first, last = parse("st kilda rd").groups[0], parse("st kilda rd").groups[-1]
    assert first == (Term("STREET"), Term("ST"))
    assert last == (Term("ROAD"), Term("RD", True))
    assert parse("elm road").groups[-1] == (Term("ROAD"),)
    assert parse("or").groups == ((Term("OR", True),),)


def test_words_in_two_tables():
    assert SYNONYMS["LOBBY"] == ("LB", "LOBBY") and SYNONYMS["SE"][:2] == ("SE", "SUITE")
    assert FULL["DE"] == "DEVIATION" and FULL["AVE"] == "AVENUE" and "U" not in FULL


@pytest.mark.parametrize(
    ("query", "entry", "expected"),
    [
        ("elm", {}, 2),
        ("elm", {"f": 1}, 1),
        ("4/9 elm", {"n": 9, "f": 4}, 200),
        ("level 2 suite 7 9 elm", {"n": 9, "f": 7}, 150),
        ("4/9 elm", {"n": 9}, 100),
        ("4/9 elm", {"n": 9, "f": 5}, 90),
        ("4/9 elm", {"n": 8, "f": 4}, 70),
        ("9 elm", {"n": 7, "n2": 11}, 100),
        ("9 elm", {"n": 9, "f": 1}, 90),
        ("9C elm", {"n": 9, "d": "9C"}, 110),
        ("9C elm", {"n": 9, "d": "9D"}, 90),
        ("G2/9 elm", {"n": 9, "f": 2, "d": "UNIT G2, 9"}, 200),
        ("9 elm", {"n": 1, "f": 9}, 80),
        ("unit 4 elm", {"n": 4}, 50),
        ("9 elm", {"n": 99, "d": "99"}, 30),
        ("9 elm", {"n": 1, "d": "1"}, 0),
        ("level 2 elm", {"n": 1, "l": 2, "d": "LEVEL 2, 1"}, 30),
    ],
)
def test_score(query, entry, expected):
    assert score(entry, parse(query)) == expected


def test_score_column_agrees(spark):
    from larkspur.functions.columns import score_column

    r = random.Random(7)
    pick = lambda: r.choice([None, 1, 2, 4, 7, 9, 12])
    rows = [(r.choice([None, "", "9C", "UNIT 4, 9", "LEVEL 2, 12", "UNIT G2, 9"]), pick(), pick(), pick(), pick()) for _ in range(300)]
    df = spark.createDataFrame(rows, "display_prefix string, number_first int, number_last int, flat_number int, level_number int")
    queries = ["elm", "9 elm", "9C elm", "4/9 elm", "level 2 9 elm", "level 2 suite 7 9 elm", "unit 4 elm", "G2/9 elm", "a/9 elm", "level 2 elm"]
    got = df.select(*[score_column(parse(q)).alias(f"q{i}") for i, q in enumerate(queries)]).collect()
    for row, values in zip(got, rows):
        assert list(row) == [score(dict(zip(("d", "n", "n2", "f", "l"), values)), parse(q)) for q in queries]


def test_highlight():
    parts = {"street_name": "O'BRIEN", "street_type": "ROAD", "locality": "FORREST HILL", "state": "VIC", "postcode": "3131"}
    text = "O'BRIEN ROAD, FORREST HILL, VIC, 3131"
    assert highlight(text, parts, "obr rd") == [(0, 4), (8, 12)]
    assert highlight(text, parts, "st") == []
    assert highlight("UNIT 3, 28 " + text, parts | {"prefix": "UNIT 3, 28"}, "3/28 o'brien") == [(5, 6), (8, 10), (11, 18)]
    assert merge([(5, 6), (0, 3), (2, 5)]) == [(0, 6)]


def test_normalise(spark):
    df = spark.createDataFrame([("  1 M!",), ("ab",), ("abc",)], "q string")
    assert [(r[0], r[1]) for r in df.select(normalise(df.q).alias("n"), is_short(normalise(df.q))).collect()] == [("1 m", True), ("ab", True), ("abc", False)]
