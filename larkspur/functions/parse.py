"""Free-text address queries: tokens, number hints and search terms."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import FULL, LEVEL_WORDS, SYNONYMS, UNIT_WORDS

# What counts as a number, as a flat, and as a flat before a number.
_NUMBER = re.compile(r"\d+[A-Z]?", re.A)
_FLAT_ID = re.compile(r"[A-Z]|[A-Z]{1,3}\d+", re.A)
_FLAT_LEAD = re.compile(r"\s*[A-Z]{1,3}\d*\s*[/,]\s*\d", re.A | re.I)


@dataclass(frozen=True)
class Term:
    """One alternative of a group: a word or phrase, taken as a prefix or whole."""

    text: str
    prefix: bool = False


@dataclass(frozen=True)
class Query:
    """A parsed query: which words must match, and which numbers hint at the street number, flat or level."""

    numbers: tuple[str, ...]
    words: tuple[str, ...]
    unit_word: bool
    flat: int | None = None
    level: int | None = None
    street: int | None = None
    suffix: str | None = None
    flat_id: str | None = None
    groups: tuple[tuple[Term, ...], ...] = field(default=())


def tokens(query: str) -> list[str]:
    """Upper-case tokens: split at white space, hyphens, commas and slashes; other marks removed."""
    return [t for t in (re.sub(r"[^A-Za-z0-9_]", "", p) for p in re.split(r"[-\s,/]+", query.upper())) if t]


def is_number(token: str) -> bool:
    """Digits with at most one letter after them."""
    return _NUMBER.fullmatch(token) is not None


def _value(token: str) -> int:
    return int(re.match(r"\d+", token)[0])


def _letter(token: str) -> str | None:
    return token[-1] if token[-1].isalpha() else None


def _group(word: str, last: bool) -> tuple[Term, ...]:
    """Alternatives for a word: full forms of its synonyms and itself; the last word is a prefix unless it is a full form."""
    group = SYNONYMS.get(word, (word,))
    if not last:
        return tuple(Term(t) for t in dict.fromkeys([*(FULL.get(s, s) for s in group), word]))
    fulls = list(dict.fromkeys(FULL[s] for s in group if s in FULL))
    return tuple([Term(t) for t in fulls] + ([] if word in fulls else [Term(word, True)]))


def parse(query: str) -> Query | None:
    """The parsed query; None if no word is left to search for."""
    every = tokens(query)
    numeric = [is_number(t) for t in every]
    last_word = max((i for i, n in enumerate(numeric) if not n), default=-1)
    last_at = {t: i for i, t in enumerate(every)}
    first_at = {t: i for i, t in reversed(list(enumerate(every)))}
    numbers = [t for t, n in zip(every, numeric) if n and not (len(t) == 4 and t.isdigit() and last_at[t] >= last_word)]
    plain = [t for t, n in zip(every, numeric) if not n]
    unit_word = any(t in UNIT_WORDS for t in plain)
    words = [t for t in plain if t not in UNIT_WORDS]
    flat_id = None
    if unit_word or _FLAT_LEAD.match(query):
        at = next((i for i, t in enumerate(words) if _FLAT_ID.fullmatch(t)), None)
        if at is not None:
            flat_id = words.pop(at)
    if not words:
        return None
    paired: dict[bool, str] = {}
    places = set()
    for i, (word, following) in enumerate(zip(every, every[1:])):
        if word in UNIT_WORDS and is_number(following):
            paired[word in LEVEL_WORDS] = following
            places.add(i + 1)
    free = [t for t in numbers if first_at[t] not in places]
    flat = _value(paired[False]) if False in paired else None
    level = _value(paired[True]) if True in paired else None
    street: str | None = None
    if flat_id is not None:
        digits = flat_id.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        flat = int(digits) if digits else flat
        street = free[-1] if free else None
    elif paired:
        street = free[0] if free else None
    elif len(numbers) >= 2:
        flat, street = _value(numbers[0]), numbers[-1]
    elif numbers and unit_word:
        flat = _value(numbers[0])
    elif numbers:
        street = numbers[0]
    groups = tuple(_group(w, i == len(words) - 1) for i, w in enumerate(words))
    return Query(tuple(numbers), tuple(words), unit_word, flat, level, _value(street) if street else None, _letter(street) if street else None, flat_id, groups)


def normalise(text: Column) -> Column:
    """Trimmed, letters and digits only, single spaces, lower case: the key of a precomputed query."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(text), "[^a-zA-Z0-9\\s]", ""), "\\s+", " "))


def is_short(text: Column) -> Column:
    """Whether a normalised query is one of those answered in advance."""
    return text.rlike("^([a-z0-9]|[a-z]{2}|[0-9]{2}|[0-9]{1,2} [a-z])$")


def token_column(text: Column) -> Column:
    """tokens() as a column."""
    return F.filter(F.transform(F.split(F.upper(text), "[-\\s,/]+"), lambda t: F.regexp_replace(t, "[^A-Za-z0-9_]", "")), lambda t: t != "")


def score(entry: dict, q: Query) -> int:
    """How well an address entry (d, n, n2, f, l) fits the hints; score_column() is the same over columns."""
    d, n, n2, f, lv = (entry.get(k) for k in ("d", "n", "n2", "f", "l"))
    if not q.numbers:
        return 2 if f is None and lv is None else 1
    unit = f if q.level is not None or f is not None else lv
    at = q.street is not None and n is not None and (n == q.street or n2 is not None and n <= q.street <= n2)
    hints = [(h, v) for h, v in ((q.flat, unit), (q.level, lv)) if h is not None]
    if q.street is not None and hints:
        good, bad = sum(v == h for h, v in hints), sum(v is not None and v != h for h, v in hints)
        if at:
            return 200 if good == len(hints) else 150 if good and not bad else 100 if f is None and lv is None else 90
        if good == len(hints):
            return 70
    elif q.street is not None:
        if at and q.flat_id:
            return 110 if _has_unit(d, q.flat_id) else 90
        if at and q.suffix:
            return 110 if _shows(d, f"{q.street}{q.suffix}") else 90
        if at:
            return 90 if unit is not None else 100
        if unit == q.street:
            return 80
    elif q.flat is not None:
        if unit == q.flat:
            return 80
        if n == q.flat:
            return 50
    return 30 if any(t in (d or "") for t in q.numbers) else 0


def _shows(display: str | None, token: str) -> bool:
    d = display or ""
    return d == token or d.startswith(f"{token},") or f", {token}" in d


def _has_unit(display: str | None, unit: str) -> bool:
    lead = (display or "").split(",")[0].strip()
    return lead == unit or lead.endswith(f" {unit}")
