"""Problem 3: texts cut off by a field's length or on the way.

1. A source's limit in a table is the length at which its texts pile up with next to none longer.
2. Intact texts are cut artificially, at any place, with what systems put after a break (nothing, a blank, dots, a broken
   character); some are made to end at a limit. These are positives, the texts as they stand negatives; texts at their
   source's limit take no part.
3. A logistic regression on hashed features of the closing characters, words, punctuation and the distance to the limit is
   fitted on all texts and scores every record: the texts are dealt by a hash into parts of about ``PART``, each part is
   fitted in a task, and the weights are the mean of the parts' weights. So no text is left out, and log-odds mean the same
   for tables of any size.
4. The threshold lets all but a hundredth of the cuts of all texts pass (``threshold_of``), each scored by fits that its text
   took no part in: by the mean of the other parts' weights or, with less than ``FOLDS`` parts, of fits without a fifth of
   each part's texts. ``holdout`` reports, of a fifth of the texts of each part, how many of these cuts lie above it.

Lengths and sentence counts are those of whole texts, cuts fall anywhere in them, and the lexicon (part of the fit) is
counted on all whole texts, in Spark, and taken per ``PART`` texts where there are more. Nulls, blanks and texts
without a letter or digit are no case. Repeated rows of a key and text count once. A null source has no limit. Where there
are no examples of both kinds nothing is learnt, and only a text that fills its source's field without a full stop is
called truncated. An empty table: no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from recollect.llm.fitting import logistic_fit, logistic_scores
from recollect.llm.words import HAN, U, mix, offsets, slices
from recollect.runtime import discard, materialize

#: Texts of a part that is fitted by itself.
PART = 12_000
#: With fewer parts than this, each is fitted so many times more, each time without another fold of its texts.
FOLDS = 5
WIDTH = 1 << 18
MIXED = mix(np.arange(1, WIDTH + 2, dtype=U))
TAIL = 90
#: Shorter fields than this aren't told from short texts.
SHORTEST = 20
#: What may stand after a break.
AFTER = ("",) * 14 + (" ", "...", "...", "…", "�", "\\u4", "&am", "<b")
#: Share of the cuts below the threshold, its upper bound, and the threshold without enough cuts.
LOSS, HIGHEST, THRESHOLD, LEAST_HELD = 0.01, -1.7, -1.7, 400
END = "。.!?！？"
MARK = re.compile(r"(?:\.{3}|…+|�+|\\u?[0-9a-fA-F]{0,3}|&#?\w{0,6}|</?\w{0,6})$")
PIECE = re.compile(rf"[a-zA-Z]+[^\W\d_{HAN}]*|[{HAN}]|[^\W\d_{HAN}]+|\d+|[^\w\s]|_")  # the first alternative is there for speed
HAS = re.compile(rf"[{HAN}]")
STOP = re.compile(rf"[{END}\n](?=\D|$)")


def source_key(source: Column) -> Column:
    """Spellings of a source unified: case, blanks and separators don't count. Null and blank: null."""
    key = F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]+", "")
    return F.when(key != "", key)


def limits(df: DataFrame, by: list[str], length: str = "len") -> DataFrame:
    """(by, field_limit): the length, of SHORTEST or more, at which a source's texts pile up, if there is one. ``df`` may have a column ``count``."""
    times = F.sum("count") if "count" in df.columns else F.count("*")
    counts = df.where(F.col(length) >= SHORTEST).groupBy(*by, F.col(length).cast("int").alias("at")).agg(times.alias("count"))
    w = Window.partitionBy(*by).orderBy("at")
    counts = counts.select(
        *by,
        "at",
        (F.col("count") + F.coalesce(F.sum("count").over(w.rangeBetween(-1, -1)), F.lit(0))).alias("pile"),
        F.coalesce(F.sum("count").over(w.rangeBetween(-41, -2)), F.lit(0)).alias("before"),
        F.coalesce(F.sum("count").over(w.rangeBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("longer"),
        "count",
    )
    spikes = counts.where((F.col("pile") >= 3) & (F.col("pile") >= 4 * (1 + F.col("before")) / 20) & (F.col("longer") <= 0.1 * F.col("pile")) & (F.col("count") * 2 >= F.col("pile")))
    return spikes.groupBy(*by).agg(F.max_by("at", "pile").alias("field_limit"))


class Kinds(dict):
    """Character -> number of its kind, 1 to 11."""

    def __missing__(self, c: str) -> int:
        value = self[c] = 1 + "EC9HAa)- oe".index(kind(c))
        return value


def kind(c: str) -> str:
    if c in END:
        return "E"
    if c in ",，;；:：、":
        return "C"
    if c.isdigit():
        return "9"
    if HAS.match(c):
        return "H"
    if c.isalpha():
        return "A" if c.isupper() else "a"
    if c in ")）]】}\"'”’」』":
        return ")"
    return "-" if c in "-–—/|~+=_&(（[【{" else " " if c.isspace() else "o" if ord(c) < 0x2600 else "e"


class Masks(dict):
    """Piece -> hash of the piece with digits, and capital letters of codes, made alike. Emptied when it grows beyond 100,000 entries."""

    def __missing__(self, x: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        value = self[x] = xxhash.xxh64_intdigest("9" * min(len(x), 5) if x[0].isdigit() else "AA" if len(x) == 2 and x.isupper() else x.lower())
        return value


KINDS, MASKS = Kinds(), Masks()
HAN_KIND, DIGIT_KIND, END_KIND = KINDS["药"], KINDS["9"], KINDS["."]
SLASH, SEMICOLON = MASKS["/"], MASKS[";"]


def lexicon(batches):
    """(word, seen, stops): how often each word (for Chinese, pair of characters; hashed) stands inside a text, and how often before punctuation."""
    for batch in batches:
        for _, texts in slices(batch, "_text"):
            rows = [PIECE.findall(t.lower()) for t in texts]
            size = np.fromiter(map(len, rows), np.int64, len(rows))
            number = defaultdict(count().__next__)
            ids = np.fromiter(map(number.__getitem__, chain.from_iterable(rows)), np.int64, int(size.sum()))
            names = [*number]
            han, letter, alnum = (np.array(x, bool) for x in ([KINDS[w[0]] == HAN_KIND for w in names], [w[0].isalpha() for w in names], [w[0].isalnum() for w in names]))
            first, last = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
            ends = np.cumsum(size)[size > 0]
            last[ends - 1] = True
            first[ends[:-1]] = True
            first[:1] = True
            pair = np.zeros(len(ids), np.int64)  # the Han character before, if both are such: 1 and more
            pair[1:] = np.where(han[ids[1:]] & han[ids[:-1]] & ~first[1:], ids[:-1] + 1, 0)
            at = np.flatnonzero(letter[ids] & ~last)
            word, of, seen = np.unique(pair[at] << 32 | ids[at], return_inverse=True, return_counts=True)
            stops = np.bincount(of, ~alnum[ids[at + 1]], len(word)).astype(np.int64)
            found = [names[(w >> 32) - 1] + names[w & 0xFFFFFFFF] if w >> 32 else names[w] for w in word.tolist()]
            columns = [pa.array([word_hash(w) for w in found], pa.int64()), pa.array(seen, pa.int64()), pa.array(stops)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "seen", "stops"])


def word_hash(word: str) -> int:
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


class Lexicon:
    """How often a word stands inside texts (0 never, 1 to 3), and how often of that before punctuation (0 never, 1 to 5): 9 bytes a word."""

    def __init__(self, words: np.ndarray, codes: np.ndarray):
        order = np.argsort(words)
        self.words, self.codes, self.known = words[order], codes[order], {}

    def __reduce__(self):
        return Lexicon, (self.words, self.codes)

    def code(self, word: str) -> int:
        """Ten times the first of the two, plus the second."""
        out = self.known.get(word)
        if out is None:
            if len(self.known) >= 200_000:
                self.known.clear()
            h = word_hash(word)
            at = int(np.searchsorted(self.words, h))
            out = self.known[word] = int(self.codes[at]) if at < len(self.words) and self.words[at] == h else 0
        return out

    def __getitem__(self, word: str) -> str:
        code = self.code(word)
        return f"{code // 10}p{code % 10}"


def lexicon_of(texts: DataFrame, scale: float) -> Lexicon:
    """Of the words of all ``texts`` (_text); how often they are seen is multiplied by ``scale``. Less than a half is never, so that it doesn't grow with the texts."""
    count = texts.select("_text").mapInArrow(lexicon, "word long, seen long, stops long").groupBy("word").agg(F.sum("seen").alias("seen"), F.sum("stops").alias("stops"))
    often = F.when(F.col("seen") * scale < 3, 1).when(F.col("seen") * scale < 30, 2).otherwise(3)
    share = 1 + sum((F.col("stops") >= x * F.col("seen")).cast("int") for x in (0.02, 0.1, 0.3, 0.6))
    t = count.where(F.col("seen") * scale >= 0.5).select("word", (10 * often + F.when(F.col("stops") > 0, share).otherwise(0)).cast("byte").alias("code")).toArrow()  # 9 bytes a word, of at most twice as many words as a part has
    return Lexicon(t.column(0).to_numpy(), t.column(1).to_numpy())


#: Places of missing words.
ABSENT = (0, 0, 0, 0, 0, 0)


def last_pieces(core: str, han: bool) -> list[str]:
    """The last seven pieces, read from the last characters alone where these hold more: only the first piece depends on what is before."""
    most = 12 if han else 56
    parts = PIECE.findall(core[-most:])
    return (parts if len(parts) > 7 or len(core) <= most else PIECE.findall(core))[-7:]


def closing(tail: str, length: int, field_limit: int | None, known: Lexicon) -> tuple[tuple[int, ...], list[int]]:
    """What the features of a text with these last characters, length and limit of its source are made of, and, of a text that ends in a digit, the words of its sentence."""
    text = tail.rstrip()
    end = text[-9:]
    m = MARK.search(text) if end[-1:] in "…�" or end[-3:] == "..." or "&" in end or "<" in end or "\\" in end else None
    mark = 0 if not m else 1 if m[0][0] in ".…" else 2
    core = text[: m.start()].rstrip() if m else text
    gap = 99 if not field_limit else field_limit - length
    near = 0 if 0 <= gap <= 1 else 1 if gap < 0 else 2 if gap <= 4 else 3
    shape = 0
    for c in core[-5:]:
        shape = shape << 4 | KINDS[c]
    last = shape & 15
    inside = [] if last == END_KIND else PIECE.findall(STOP.split(core)[-1])
    parts = inside[-7:] if len(inside) >= 7 else last_pieces(core, last == HAN_KIND)
    mask = [*map(MASKS.__getitem__, parts[-6:])]
    word = parts[-1].lower() if parts else ""
    if word[:1].isalpha():
        pair = len(parts) > 1 and KINDS[word[0]] == HAN_KIND and KINDS[parts[-2][0]] == HAN_KIND
        often = known.code(parts[-2].lower() + word if pair else word)
    else:
        often = 63
    own = [*dict.fromkeys(map(MASKS.__getitem__, inside))]
    upper = 2 if not parts else 1 if parts[-1][0].isupper() else 0
    marks = (SLASH in own) << 1 | (SLASH in own or SEMICOLON in own)
    row = (mark, len(text) < len(tail), near, shape, often, upper, length // 8 if length < 99 else 12, len(own) // 3 if len(own) < 24 else 8, marks, *(own[:2] if len(own) > 1 else (own + [0, 0])[:2]), *ABSENT[len(mask) :], *mask)
    return row, own[-18:-1] if last == DIGIT_KIND else []


#: Features that each text has, and what tells their values apart.
FEATURES = 22
SALT = np.arange(1, FEATURES + 2, dtype=U) * U(0x9E3779B97F4A7C15)


def feature_rows(rows: list[tuple[str, int, int | None]], known: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    found, more, extra = [], [], []
    for r in rows:
        row, others = closing(*r, known)
        found += row
        more.append(len(others))
        extra += others
    mark, blank, near, shape, often, upper, length, size, marks, one, two, *mask = np.array(found, U).reshape(-1, 17).T
    last = shape & U(15)
    pairs = [x << U(4) | last for x in (mark, blank, near, often, length, size, marks)]
    chains = [mask[-1]]
    for x in mask[-2::-1]:
        chains.append(mix(chains[-1]) + x)
    values = [
        *(np.zeros_like(last), *pairs, pairs[2] << U(2) | mark, last, (pairs[3] << U(2) | upper) << U(2) | mark),
        *(shape & U(0xFF), (shape & U(0xFFF)) << U(2) | mark, shape, *chains, mix(one) + last, mix(mix(one) + two) + last),
    ]
    count = np.array(more, np.int64) + FEATURES
    start = np.cumsum(count) - count
    cols = np.empty(int(count.sum()), np.int64)
    own = np.zeros(len(cols), bool)
    place = start[:, None] + np.arange(FEATURES)
    own[place] = True
    cols[place] = mix(np.stack(values, 1) + SALT[:FEATURES]) % U(WIDTH)
    cols[~own] = mix(np.array(extra, U) + SALT[FEATURES]) % U(WIDTH)
    return np.repeat(np.arange(len(rows)), count), cols


def cut(text: str, place: float, after: float) -> tuple[str, int] | None:
    """The text broken off at a place: its tail and length; None if it comes to an end there. The draws are from 0 to 1."""
    if len(text) < 24:
        return None
    at = 12 + int(place * (len(text) - 14))
    core, rest = text[:at].rstrip(), text[at:].lstrip()
    mark = AFTER[int(after * len(AFTER))]
    if not core or core[-1] in END + "\n" or len(rest[:200].strip(END + " \n)")) < 2 or not (core[-1].isalnum() or any(c.isalnum() for c in core[-TAIL:])):
        return None
    if core[-1] in ",，;；:：、" and mark[:1] in (".", "…"):  # as texts that trail off on purpose
        return None
    whole = text[max(0, at - TAIL) : at] + mark
    return whole[-TAIL:], at + len(mark)


def packed(columns: np.ndarray, count: np.ndarray) -> pa.Array:
    """The features of each row as a binary value, three bytes a feature."""
    data = np.ascontiguousarray(columns.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3])
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer((3 * offsets(count)).astype(np.int32)), pa.py_buffer(data)])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of such values."""
    place = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = np.frombuffer(column.buffers()[2], np.uint8)[place[0] : place[-1]] if place[-1] > place[0] else np.zeros(0, np.uint8)
    wide = np.zeros((len(data) // 3, 4), np.uint8)
    wide[:, :3] = data.reshape(-1, 3)
    return np.repeat(np.arange(len(column)), np.diff(place) // 3), wide.view("<i4").ravel().astype(np.int64)


def limits_of(part: pa.RecordBatch, by: list[str], lim: dict) -> list[int | None]:
    """The limit of each row's source."""
    return [lim.get(k) for k in zip(*(part.column(part.schema.get_field_index(b)).to_pylist() for b in by))] if by and lim else [None] * part.num_rows


def examples(batches, by: list[str], known: Lexicon, lim: dict):
    """(h, by .., cut, columns): the features of each of (h, by .., _text) as it stands, unless it fills its field, and of two cuts."""
    for batch in batches:
        for part, texts in slices(batch, "_text"):
            take, cuts, rows = [], [], []
            draws = (mix((part.column(0).to_numpy().view(U) << U(3))[:, None] + np.arange(7, dtype=U)) >> U(11)) * 2.0**-53
            for i, (t, limit, d) in enumerate(zip(texts, limits_of(part, by, lim), draws.tolist())):
                if limit is None or len(t) < limit - 1:
                    take.append(i)
                    cuts.append(False)
                    rows.append((t[-TAIL:], len(t), len(t) if d[0] < 0.03 and t[-TAIL:].rstrip()[-1:] in END else limit))
                for place, after, full in (d[1:4], d[4:7]):
                    if x := cut(t, place, after):
                        take.append(i)
                        cuts.append(True)
                        rows.append((*x, x[1] if full < 0.35 else None))
            r, c = feature_rows(rows, known)
            out = part.take(pa.array(take, pa.int64())).drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cuts, pa.bool_()), packed(c, np.bincount(r, minlength=len(rows)))], names=[*out.schema.names, "cut", "columns"])


def chosen(r: np.ndarray, c: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of the rows to keep, renumbered."""
    take = keep[r]
    return (np.cumsum(keep) - 1)[r[take]], c[take]


def merged(r: np.ndarray, c: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """(r, c, y, weight) with rows of the same features and kind made one of their weights' sum, which is fitted alike."""
    key = np.add.reduceat(MIXED[c], np.searchsorted(r, np.arange(len(y)))) << U(1) | y.astype(U)
    _, at, of = np.unique(key, return_index=True, return_inverse=True)
    keep = np.zeros(len(y), bool)
    keep[at] = True
    total = np.bincount(of, weight)
    return *chosen(r, c, keep), y[keep], total[of[keep]]


def fit(r: np.ndarray, c: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """Weights from the features of texts as they stand (0) and cuts (1); None without both.

    As a few of these texts are cut themselves, those that a first fit, on common features, finds cut take no part in the
    second. Rare features have no weight, so that no example is learnt by heart.
    """
    if not len(y) or y.min() == y.max():
        return None
    for least in (60, 6):
        rare = np.bincount(c, minlength=WIDTH) < min(least, len(y) / 8)
        rows, columns, kinds, weight = merged(r, np.where(rare[c], WIDTH, c), y, np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())))
        own = columns < WIDTH
        w = logistic_fit(rows[own], columns[own], kinds, WIDTH, weight, also=np.bincount(rows[~own], minlength=len(kinds)))
        w[rare] = 0
        keep = (y > 0) | (logistic_scores(r, c, len(y), w) < 0)
        if keep.all() or not (keep & (y == 0)).any():
            continue
        (r, c), y = chosen(r, c, keep), y[keep]
    return w


def fit_part(h: np.ndarray, r: np.ndarray, c: np.ndarray, y: np.ndarray, folds: int) -> list[tuple[int, np.ndarray]]:
    """(-1, weights of all examples of a part), and (fold, weights without the texts of that fold)."""
    fits = [(-1, fit(r, c, y))]
    for f in range(folds):
        keep = h % folds != f
        fits.append((f, fit(*chosen(r, c, keep), y[keep])))
    return [(f, w) for f, w in fits if w is not None]


def threshold_of(cuts: dict[float, int], least: int = LEAST_HELD) -> float:
    """The log-odds that all but LOSS of the cuts, scored crosswise, pass, and HIGHEST at most. ``cuts`` counts them by their log-odds.

    Texts cut in earnest score lower than artificial cuts, as the few among the texts of the fit count as intact there; so the
    threshold stays below what the cuts alone would allow.
    """
    n = sum(cuts.values())
    if n < least:
        return THRESHOLD
    odds = sorted(cuts)
    upto = np.cumsum([cuts[x] for x in odds])
    place = (n - 1) * LOSS
    low, high = (odds[int(np.searchsorted(upto, at, "right"))] for at in (int(place), min(int(place) + 1, n - 1)))
    return min(HIGHEST, low + (high - low) * (place - int(place)))


def fitted(t: DataFrame, keys: list[str], by: list[str], part: int) -> tuple[np.ndarray | None, Lexicon, dict, float, DataFrame]:
    """(weights, lexicon, limits, threshold, examples as (by .., cut, shown, odds)) for texts (keys, by, _text, _len).

    The examples, all cuts and the texts that are ``shown`` by ``holdout``, are scored by fits without their texts.
    """
    sc = t.sparkSession.sparkContext
    counts = materialize(t.groupBy(*by, "_len").count(), "lengths")
    lim = {tuple(r[b] for b in by): r["field_limit"] for r in limits(counts, by, "_len").collect()} if by else {}  # one row per source that has a limit
    texts = materialize(t.select(F.xxhash64(*keys, "_text").alias("h"), *by, "_text").dropDuplicates(["h"]), "texts")
    n = texts.count()
    parts = max(1, -(-n // part))
    known = lexicon_of(texts, min(1.0, part / max(n, 1)))
    model = sc.broadcast((known, lim))
    sources = [StructField(f.name, f.dataType) for f in t.select(*by).schema]
    folds = FOLDS if parts < FOLDS else 0
    schema = StructType([*sources]).add("cut", "boolean").add("columns", "binary").add("shown", "boolean").add("fold", "integer").add("own", "double").add("at", ArrayType(IntegerType())).add("w", ArrayType(DoubleType()))
    arrow = to_arrow_schema(schema)

    def record(values, n):
        return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if x is None else x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(values, arrow)], schema=arrow)

    def learn(batches):  # a partition is a part
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found).combine_chunks()
        rows = lambda: unpacked(table.column("columns").chunk(0))
        r, c = rows()
        key = np.add.reduceat(MIXED[c], np.searchsorted(r, np.arange(table.num_rows)))
        table = table.take(pa.array(np.lexsort((key, table.column("cut").to_numpy(), table.column("h").to_numpy())))).combine_chunks()  # in an order that a retried task repeats
        (r, c), h, cuts = rows(), table.column("h").to_numpy(), table.column("cut").to_numpy()
        fits = fit_part(h, r, c, cuts.astype(float), folds)
        for f, w in fits:
            at = np.flatnonzero(w).astype(np.int32)
            yield record([*[None] * len(by), None, None, None, [f], None, [at], [w[at]]], 1)
        whole = dict(fits).get(-1)
        shown = h % FOLDS == 0
        fold = h % FOLDS if folds else np.full(len(h), -1)
        own = None if folds or whole is None else logistic_scores(r, c, len(h), whole)
        take = np.flatnonzero(cuts | shown)
        for part in np.split(take, range(10_000, len(take), 10_000)) if len(take) else ():
            some = table.take(pa.array(part)).combine_chunks()
            yield record([*(some.column(b).combine_chunks() for b in by), cuts[part], some.column("columns").combine_chunks(), shown[part], fold[part], None if own is None else own[part], None, None], len(part))

    made = StructType([f for f in texts.schema if f.name != "_text"]).add("cut", "boolean").add("columns", "binary")
    shown = texts.mapInArrow(lambda batches: examples(batches, by, *model.value), made)
    learnt = materialize(shown.repartitionById(parts, F.pmod(F.shiftright("h", 20), F.lit(parts)).cast("int")).mapInArrow(learn, schema), "fits")
    discard(texts)
    weights = learnt.where("w is not null")
    times = np.zeros(FOLDS + 1)  # by fold, and first the fits of all examples
    for row in weights.groupBy("fold").count().collect():
        times[row["fold"] + 1] = row["count"]
    sums = np.zeros((folds + 1, WIDTH))
    total = weights.select("fold", F.explode(F.arrays_zip("at", "w")).alias("w")).groupBy("fold", "w.at").agg(F.sum("w.w").alias("w")).toArrow()  # WIDTH rows a fold at most
    sums[total.column("fold").to_numpy() + 1, total.column("at").to_numpy()] = total.column("w").to_numpy()
    shared = sc.broadcast((sums, times))

    def score(batches):
        sums, times = shared.value
        for batch in batches:
            (r, c), own = unpacked(batch.column(len(by) + 1)), batch.column(len(by) + 4)
            fold = batch.column(len(by) + 3).to_numpy() + 1
            others = times[fold] - own.is_valid().to_numpy(zero_copy_only=False)
            odds = np.bincount(r, sums[fold[r], c], batch.num_rows) - own.fill_null(0).to_numpy()
            out = pa.RecordBatch.from_arrays([*batch.columns[: len(by) + 1], batch.column(len(by) + 2), pa.array(odds / np.maximum(others, 1))], names=[*batch.schema.names[: len(by) + 1], "shown", "odds"])
            yield out.filter(pa.array(others > 0))

    scored = StructType([*sources]).add("cut", "boolean").add("shown", "boolean").add("odds", "double")
    held = learnt.where("w is null").drop("at", "w").mapInArrow(score, scored)
    cuts = {r["at"]: r["count"] for r in held.where("cut").groupBy(F.round("odds", 3).alias("at")).count().collect()}  # log-odds by thousandths
    return sums[0] / times[0] if times[0] else None, known, lim, threshold_of(cuts), held


def prepared(df: DataFrame, keys: list[str], text_col: str, by: list[str]) -> DataFrame:
    text = F.col(text_col)
    names = [*keys, *[b for b in by if b not in keys]]
    return df.where(text.isNotNull() & text.rlike(r"[\p{L}\p{N}]")).select(*names, text.alias("_text"), F.length(text).alias("_len"), F.right(text, F.lit(TAIL)).alias("_tail"))


def holdout(df: DataFrame, keys: list[str], text_col: str, by: list[str], part: int = PART) -> DataFrame:
    """by, cuts, found, recall, texts, called, threshold: of the held-out cuts how many are found, and of the texts as they stand (a few of them cut) how many are called truncated."""
    *_, threshold, held = fitted(prepared(df, keys, text_col, by), keys, by, part)
    cut, over = F.col("cut").cast("int"), (F.col("odds") > threshold).cast("int")
    sums = held.where("shown").groupBy(*by).agg(F.sum(cut).alias("cuts"), F.sum(cut * over).alias("found"), F.sum(1 - cut).alias("texts"), F.sum((1 - cut) * over).alias("called"))
    recall = F.round(F.try_divide("found", "cuts"), 6)
    return sums.where("cuts + texts > 0").select(*by, "cuts", "found", recall.alias("recall"), "texts", "called", F.lit(threshold).alias("threshold"))


def truncated(df: DataFrame, keys: list[str], text_col: str, by: list[str], part: int = PART, threshold: float | None = None) -> DataFrame:
    """keys, by, truncated (boolean), odds of each distinct text of ``df``; ``by`` names the columns a limit belongs to."""
    spark = df.sparkSession
    t = prepared(df, keys, text_col, by)
    names = [*keys, *[b for b in by if b not in keys]]
    weights, words, lim, found, _ = fitted(t, keys, by, part)
    bar = found if threshold is None else threshold
    model = spark.sparkContext.broadcast((None if weights is None else weights.astype(np.float32), words, lim))
    schema = t.select(*names).schema

    def score(batches):
        w, words, lim = model.value
        w = None if w is None else w.astype(np.float64)
        for batch in batches:
            for part, tails in slices(batch, "_tail"):
                size = part.column(len(names)).to_pylist()
                of = limits_of(part, by, lim)
                if w is None:
                    full = [k is not None and n >= k - 1 and x.rstrip()[-1:] not in END for x, n, k in zip(tails, size, of)]
                    odds = np.where(np.array(full, bool), bar + 1, bar - 1)
                else:
                    r, c = feature_rows([*zip(tails, size, of)], words)
                    odds = logistic_scores(r, c, len(tails), w)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(odds > bar), pa.array(odds)], names=[*names, "truncated", "odds"])

    out = t.select(*names, "_len", "_tail").mapInArrow(score, schema.add("truncated", "boolean").add("odds", "double"))
    return out.groupBy(*names).agg(F.max("truncated").alias("truncated"), F.max("odds").alias("odds"))
