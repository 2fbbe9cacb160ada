"""Text functions that built-ins cannot express, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOWEL = re.compile(r"[aeiouy]")


def porter_like(word: str) -> str:
    """Stem of an English word by the published suffix rules of Porter's algorithm, steps 1a to 1c, 2 and 3 on common suffixes."""
    w = word
    if len(w) <= 2 or not w.isascii():
        return w
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    for end in ("eed", "ed", "ing"):
        if w.endswith(end):
            stem_ = w[: -len(end)]
            if end == "eed":
                w = stem_ + "ee" if _VOWEL.search(stem_) else w
            elif _VOWEL.search(stem_):
                w = stem_
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "lsz":
                    w = w[:-1]
            break
    if w.endswith("y") and _VOWEL.search(w[:-1]):
        w = w[:-1] + "i"
    for end, new in (("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("icate", "ic"), ("ative", ""), ("alize", "al"), ("ical", "ic"), ("ness", ""), ("ful", "")):
        if w.endswith(end) and len(re.findall(r"[aeiouy]+[^aeiouy]+", w[: -len(end)])) > 0:
            return w[: -len(end)] + new
    return w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem(words: pd.Series) -> pd.Series:
    return words.map(lambda a: None if a is None else [porter_like(w) for w in a])


@F.pandas_udf(T.StringType())
def nfd(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else unicodedata.normalize("NFD", t))


def lcs(a, b) -> int:
    """Length of the longest common subsequence, in memory of the shorter side."""
    if len(a) < len(b):
        a, b = b, a
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs(list(x), list(y)) if x is not None and y is not None else 0 for x, y in zip(a, b)], dtype="int32")


def exact_meteor(output, expected) -> float:
    """METEOR with exact matches alone: recall-weighted mean times the penalty for scattered chunks."""
    free = [*expected]
    at, matches = -2, []
    for w in output:
        follow = at + 1
        k = follow if 0 <= follow < len(free) and free[follow] == w else next((i for i, v in enumerate(free) if v == w), None)
        if k is not None:
            free[k] = None
            matches.append(k)
            at = k
    if not matches:
        return 0.0
    p, r = len(matches) / len(output), len(matches) / len(expected)
    chunks = 1 + sum(b != a + 1 for a, b in zip(matches, matches[1:]))
    return 10 * p * r / (r + 9 * p) * (1 - 0.5 * (chunks / len(matches)) ** 3)


@F.pandas_udf(T.DoubleType())
def meteor(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([exact_meteor(list(x), list(y)) if x is not None and y is not None and len(x) and len(y) else 0.0 for x, y in zip(a, b)])


def best_window_ratio(a: str, b: str) -> float:
    """100 times the best ratio of the shorter text to a window of its length in the longer one."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    best = 0.0
    for block in SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks():
        start = max(0, block.b - block.a)
        best = max(best, SequenceMatcher(None, short, long[start : start + len(short)], autojunk=False).ratio())
    return 100 * best


@F.pandas_udf(T.DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([best_window_ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


def first_object(text: str) -> str | None:
    """The first balanced {...}; braces within quoted strings don't count."""
    start = text.find("{")
    if start < 0:
        return None
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if escaped:
            escaped = False
        elif quoted:
            escaped, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


@F.pandas_udf(T.StringType())
def extract_json(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else first_object(t))


#: Months by their first three letters.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def date_parts(text: str) -> tuple[int | None, int | None, int | None]:
    """(year, month, day) named in a text, in ISO form or with the month as a word."""
    t = re.sub(r"^(?:(?:on|in|around|about|by|before)\s+)+", "", text.lower().strip())
    iso = re.search(r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})", t)
    if iso:
        return int(iso[1]), int(iso[2]), int(iso[3])
    year = re.search(r"\b(?:19|20)\d{2}\b", t)
    month = next((k for k, m in enumerate(MONTHS, 1) if re.search(rf"\b{m}[a-z]*", t)), None)
    day = next((int(x) for x in re.findall(r"\b\d{1,2}(?=\b|st|nd|rd|th)", t) if 1 <= int(x) <= 31), None)
    return int(year[0]) if year else None, month, day


@F.pandas_udf(T.BooleanType())
def temporal_match(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two texts name the same date, as far as both name year, month and day."""

    def same(x, y):
        if x is None or y is None:
            return False
        p, q = date_parts(x), date_parts(y)
        both = [(i, j) for i, j in zip(p, q) if i is not None and j is not None]
        return bool(both) and all(i == j for i, j in both) and any(v is not None for v in q)

    return pd.Series([same(x, y) for x, y in zip(a, b)])
