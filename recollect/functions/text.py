"""Scalar text functions as Column expressions. Everything runs on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Punctuation that string matching ignores.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CJK_PUNCTUATION = "，。！？、；：（）【】《》·…—～－–"
#: Number words with their digits.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
#: Phrases that say that nothing is known.
NEGATIVE_PHRASES = (
    "no information available", "not mentioned", "cannot be determined", "not enough information", "no information", "not answerable",
    "cannot answer", "don't have information", "no relevant information", "not provided", "unknown", "n/a",
)
#: Stop words of the keyword tokenizer.
STOP_WORDS = "a an the and or but in on at to for of with by is are was were be been it this that as from".split()


def char_class(chars: str) -> str:
    """A regular-expression class of exactly these characters."""
    return "[" + "".join("\\" + c if c in "[]\\^-&~|#" else c for c in chars) + "]"


def normalize_text(x: Column) -> Column:
    """Without ASCII and CJK punctuation and without white space, in lower case. Null stays null."""
    return F.lower(F.regexp_replace(F.regexp_replace(x, char_class(ASCII_PUNCTUATION + CJK_PUNCTUATION), ""), r"(?U)\s+", ""))


def normalize_answer(x: Column) -> Column:
    """Without commas, lower case, without ASCII punctuation, articles and 'and', with single blanks."""
    y = F.regexp_replace(F.lower(F.regexp_replace(x, ",", "")), char_class(ASCII_PUNCTUATION), "")
    y = F.regexp_replace(y, r"(?U)\b(a|an|the|and)\b", " ")
    return F.trim(F.regexp_replace(y, r"(?U)\s+", " "))


def tokens(x: Column) -> Column:
    """Words of a text split at white space; an empty array for a blank text."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda t: t != "")


def answer_tokens(x: Column) -> Column:
    return tokens(normalize_answer(x))


def keyword_tokens(x: Column) -> Column:
    """Lower-case runs of letters and digits that are no stop words and longer than one."""
    return F.filter(F.regexp_extract_all(F.lower(x), F.lit(r"[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))


def mixed_tokens(x: Column) -> Column:
    """Lower-case ASCII words; for text of other scripts, single Han characters too."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"[a-z0-9]+|[\x{4e00}-\x{9fff}]"), F.lit(0))


def han_share(x: Column) -> Column:
    """Share of Han characters among all characters; 0 for an empty text."""
    return F.length(F.regexp_replace(x, r"[^\x{4e00}-\x{9fff}]", "")) / F.greatest(F.length(x), F.lit(1))


def option_letters(x: Column) -> Column:
    """Option letters A..F named in an answer, sorted: standing alone, after 选 or 答案, or before 选项."""
    up = F.upper(x)
    found = [F.regexp_extract_all(up, F.lit(p), F.lit(1)) for p in (r"(?U)\b([A-F])\b", "选([A-F])", r"答案[是为：:]*\s*([A-F])", "([A-F])选项")]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def leading_letter(x: Column) -> Column:
    """The letter that an option text starts with, or an empty string."""
    return F.regexp_extract(x, r"^([A-F])[.、:\s]", 1)


def count_of(values: Column, value: Column) -> Column:
    return F.size(F.filter(values, lambda v: v == value))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, t: n + F.least(count_of(a, t), count_of(b, t)))


def f1_of(a: Column, b: Column) -> Column:
    """Harmonic mean of precision and recall of two token arrays as multisets; 0 without overlap."""
    return F.coalesce(F.try_divide(2.0 * multiset_overlap(a, b), F.size(a) + F.size(b)), F.lit(0.0))


def set_f1(a: Column, b: Column) -> Column:
    """The same of two token arrays as sets; 0 without overlap."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    same = F.size(F.array_intersect(a, b))
    return F.when(same > 0, 2.0 * same / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def ngrams(values: Column, n: int) -> Column:
    """Runs of n tokens joined by blanks."""
    starts = F.when(F.size(values) >= n, F.sequence(F.lit(1), F.size(values) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(values, i, n), " "))


def number_words(x: Column) -> Column:
    """zero .. twenty as digits, where they stand as words."""
    for digit, word in enumerate(NUMBER_WORDS):
        x = F.regexp_replace(x, rf"(?U)\b{word}\b", str(digit))
    return x


def says_nothing(x: Column) -> Column:
    """Whether an answer holds one of the phrases for missing knowledge."""
    y = F.lower(x)
    out = F.lit(False)
    for p in NEGATIVE_PHRASES:
        out = out | F.contains(y, F.lit(p))
    return out


def contains_all(output: Column, expected: Column) -> Column:
    """Whether every expected string that is not empty after normalizing is found; never for an empty list or string."""
    norm = F.transform(expected, normalize_text)
    return (F.size(norm) > 0) & F.forall(norm, lambda e: (e != "") & F.contains(normalize_text(output), e))


def equals_any(output: Column, expected: Column) -> Column:
    return F.exists(expected, lambda e: normalize_text(e) == normalize_text(output))


def option_match(output: Column, correct: Column) -> Column:
    """Whether the letters an answer names are those of the correct options. Two empty sets match."""
    gold = F.filter(F.transform(correct, leading_letter), lambda c: c != "")
    return F.array_sort(F.array_distinct(gold)) == option_letters(output)


def dice_chars(a: Column, b: Column) -> Column:
    """Dice coefficient of the character sets."""
    x, y = (F.array_distinct(F.filter(F.split(c, ""), lambda t: t != "")) for c in (a, b))
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(x, y)), F.size(x) + F.size(y)), F.lit(0.0))


def char_bigrams(x: Column) -> Column:
    starts = F.when(F.length(x) >= 2, F.sequence(F.lit(1), F.length(x) - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(x, i, F.lit(2))))


def bigram_jaccard(a: Column, b: Column) -> Column:
    x, y = char_bigrams(a), char_bigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0))


def tfidf_chars(a: Column, b: Column, shared: float = 1.0, single: float = 1.5) -> Column:
    """Cosine of character counts; a character in both texts weighs ``shared``, one in only one of them ``single``."""
    x, y = (F.filter(F.split(c, ""), lambda t: t != "") for c in (a, b))
    zero = F.lit(0.0)
    weight = lambda own, other: F.aggregate(F.array_distinct(own), zero, lambda s, t: s + F.pow(count_of(own, t) * F.when(F.array_contains(other, t), shared).otherwise(single), F.lit(2.0)))
    dot = F.aggregate(F.array_intersect(x, y), zero, lambda s, t: s + count_of(x, t) * count_of(y, t) * (shared * shared))
    return F.coalesce(F.try_divide(dot, F.sqrt(weight(x, y)) * F.sqrt(weight(y, x))), zero)


def preview(x: Column, length: int = 500) -> Column:
    return F.when(F.length(x) > length, F.concat(F.left(x, F.lit(length)), F.lit("..."))).otherwise(x)


def name_key(x: Column) -> Column:
    """Lower-case words without punctuation, joined by underscores."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(x, char_class(ASCII_PUNCTUATION), "")), r"\s+", "_"))


def estimated_tokens(x: Column, per: int = 4) -> Column:
    return F.floor(F.length(x) / per).cast("long")


def date_range(phrase: Column, now: Column) -> Column:
    """struct<from_ts, to_ts> of the first time phrase found, in this order of precedence; null without one.

    today, yesterday, last N days, last week (7 days), this week (from Monday), last month (30 days), this month, last N weeks,
    last N months (30 days each). All end with the last microsecond of today, yesterday with its own.
    """
    p, day = F.lower(phrase), F.date_trunc("day", now)
    number = lambda unit: F.regexp_extract(p, rf"\blast\s+(\d+)\s+{unit}s?\b", 1).try_cast("int")
    back = lambda n: day - F.make_dt_interval(n)
    has = lambda words: p.rlike(rf"\b{words}\b")
    start = (
        F.when(has("today"), day).when(has("yesterday"), back(F.lit(1))).when(number("day").isNotNull(), back(number("day"))).when(has(r"last\s+week"), back(F.lit(7))).when(has(r"this\s+week"), F.date_trunc("week", now))
        .when(has(r"last\s+month"), back(F.lit(30))).when(has(r"this\s+month"), F.date_trunc("month", now)).when(number("week").isNotNull(), back(7 * number("week"))).when(number("month").isNotNull(), back(30 * number("month")))
    )
    tick = F.expr("interval 1 microsecond")
    end = F.when(has("yesterday") & ~has("today"), day - tick).when(start.isNotNull(), day + F.expr("interval 1 day") - tick)
    return F.struct(start.alias("from_ts"), end.alias("to_ts"))


def filled_template(templates: dict[str, str], key: Column, values: dict[str, Column], missing: str = "-") -> Column:
    """The template of a key, or the one named default, with each {name} replaced, in the order of ``values``; null values by ``missing``."""
    known = F.create_map(*(F.lit(x) for pair in templates.items() for x in pair))
    out = F.coalesce(F.try_element_at(known, key), F.lit(templates["default"]))
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit(missing)))
    return out


def config_hash(values: dict[str, Column]) -> Column:
    """The first 16 digits of the MD5 of a JSON object with sorted keys, a blank after colons and commas."""
    shown = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', 1), F.lit(""))
    parts = [F.concat(F.lit(f'"{k}": '), F.when(v.isNull(), "null").otherwise(shown(v))) for k, v in sorted(values.items())]
    return F.left(F.md5(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))), F.lit(16))


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (version 5) of a namespace given as 32 hexadecimal digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def has_text(x: Column) -> Column:
    """Whether a text has more than blanks of any kind."""
    return x.rlike(r"[^\s\p{Z}]")
