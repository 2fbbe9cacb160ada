"""Problem 8: reading level of documents, from acquisition grades of words.

1. Ratings are cleaned; each rated document weighs 1, shared among its ratings.
2. A word's grade is the mean level (0 plain .. 3 specialist) under which rated texts use it, with levels weighing alike
   whatever their number of texts. Words of Latin script count as such, Chinese ones as pairs of adjacent characters.
   Words of fewer than ``SUPPORT`` rated documents, digits and punctuation have no grade.
3. A document is described by quantiles of its known words' grades; these are calibrated against the ratings, per script
   of the document, by a multinomial logistic regression. Grades are fitted crosswise for that: rated documents fall into
   two halves by a hash, and those of one half are described by the grades that the other gives, so that no document is
   calibrated on grades that it had a part in. ``agreement`` measures the whole on ratings that it never saw.

Words are counted over all rated documents, in Spark; their grades are sent as one number a word of ``SUPPORT`` documents, so
they grow with the vocabulary. The regression alone is fitted on about ``MOST_RATED`` rated documents at most, chosen by a
hash of their id. Every document is scored on its whole text. Documents with no known
word get the most frequent rated level; without any usable rating there are no rows. Null texts and documents below the
length: no row. Repeated documents give one row each time.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.fitting import softmax_classes, softmax_fit
from recollect.llm.words import HAN, sampled, slices
from recollect.runtime import materialize

LEVELS = ("plain", "general", "advanced", "specialist")
MOST_RATED = 20_000
SUPPORT = 4
QUANTILES = np.array((0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95))
RUN = re.compile(rf"[{HAN}]+|[^\W\d_{HAN}]+")
LEAST_FEATURES = 40
#: Sums by level and number of documents, of the first half (a) and the second (b).
COUNTS = [f"{h}{j}" for h in "ab" for j in range(5)]


def units(text: str) -> tuple[list[str], int, int]:
    """Words, number of Han characters, number of other letters."""
    out: list[str] = []
    han = other = 0
    for w in RUN.findall(text.lower()):
        if is_han(w[0]):
            han += len(w)
            out += map("".join, zip(w, w[1:]))
        else:
            other += len(w)
            out.append(w)
    return out, han, other


def is_han(c: str) -> bool:
    return "一" <= c <= "鿿" or "㐀" <= c <= "䶿" or c == "〇" or "豈" <= c <= "﫿" or c >= "\U00020000"


def features(texts: list, index: dict[str, int], grades: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, number of known words, whether mostly Chinese, code points) of each text. ``grades``: by index of the word, NaN for none."""
    known, counts, chinese = [], [], []
    get = index.get
    for t in texts:
        words, han, other = units(t or "")
        own = [g for g in map(get, words) if g is not None]
        known += own
        counts.append(len(own))
        chinese.append(han > other)
    n = np.array(counts, np.int64)
    value = grades[np.array(known, np.int64)].astype(np.float64)
    doc = np.repeat(np.arange(len(n)), n)
    ok = ~np.isnan(value)
    value, doc = value[ok], doc[ok]
    n = np.bincount(doc, minlength=len(n))
    order = np.lexsort((value, doc))
    value = np.concatenate((value[order], [0.0]))
    first = np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else n
    place = np.maximum(n - 1, 0)[:, None] * QUANTILES
    low = np.floor(place).astype(np.int64)
    a, b = value[first[:, None] + low], value[first[:, None] + np.minimum(low + 1, np.maximum(n - 1, 0)[:, None])]
    x = a + (b - a) * (place - low)
    mean = np.bincount(doc, value[:-1], len(n)) / np.maximum(n, 1)
    x = np.c_[x, mean]
    x[n == 0] = 0
    return x, n, np.array(chinese, bool), np.array([len(t or "") for t in texts], np.int64)


def clean_ratings(ratings: DataFrame) -> DataFrame:
    """doc_id, level (0..3), weight: spelling of levels unified, others dropped; a document's ratings share a weight of 1."""
    level = F.lower(F.trim("reading_level"))
    number = F.array_position(F.array(*map(F.lit, LEVELS)), level) - 1
    r = ratings.select("doc_id", number.cast("int").alias("level"), "rater").where("level >= 0 and doc_id is not null").distinct()
    r = r.groupBy("doc_id", "level").count()
    total = r.groupBy("doc_id").agg(F.sum("count").alias("n"))
    return r.join(total, "doc_id").select("doc_id", "level", (F.col("count") / F.col("n")).alias("weight"))


def reading_levels(docs: DataFrame, ratings: DataFrame, most_rated: int = MOST_RATED) -> DataFrame:
    """(doc_id, level) of every document of at least 250 code points, or 100 if it is mostly Chinese."""
    spark = docs.sparkSession
    src = docs.select("doc_id", "text").where("text is not null")
    kind = src.schema["doc_id"].dataType.simpleString()
    votes = clean_ratings(ratings)
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2))
    rated = src.join(votes.groupBy("doc_id").agg(F.collect_list(F.struct("level", "weight")).alias("votes")), "doc_id").dropDuplicates(["doc_id"])
    rated = materialize(rated.withColumn("half", half.cast("int")), "rated")

    def count(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                rows: dict[str, list[float]] = {}
                totals = np.zeros((2, 2, 4))
                for t, votes, h in zip(texts, part.column(2).to_pylist(), part.column(3).to_pylist()):
                    words, han, other = units(t)
                    size = max(1, len(words))
                    w = np.zeros(4)
                    for v in votes:
                        w[v["level"]] += v["weight"]
                    each: dict[str, int] = {}
                    for x in words:
                        each[x] = each.get(x, 0) + 1
                    for x, k in each.items():
                        row = rows.setdefault(x, [0.0] * 10)
                        for j in range(4):
                            row[5 * h + j] += w[j] * k / size
                        row[5 * h + 4] += 1
                    totals[int(han > other), h] += w
                for k, name in enumerate(("\x00en", "\x00zh")):
                    rows[name] = [*totals[k, 0], SUPPORT, *totals[k, 1], SUPPORT]
                v = np.array([*rows.values()])
                yield pa.RecordBatch.from_arrays([pa.array([*rows]), *(pa.array(v[:, j]) for j in range(10))], names=["word", *COUNTS])

    table = rated.mapInArrow(count, "word string, " + ", ".join(f"{c} double" for c in COUNTS))
    table = table.groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS)).where(F.col("a4") + F.col("b4") >= SUPPORT)
    table = materialize(table, "words")
    totals = {r["word"]: np.array(r[1:], float) for r in table.where(F.col("word").isin("\x00en", "\x00zh")).collect()}
    total = np.stack([np.maximum(totals.get(k, np.zeros(10)), 1e-9) for k in ("\x00en", "\x00zh")])

    def grade(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            v = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1).reshape(-1, 10)
            of = total[[int(is_han(w[0])) for w in words]].reshape(-1, 10)
            out = []
            for c, least in ((v[:, :5] + v[:, 5:], SUPPORT), (v[:, :5], SUPPORT / 2), (v[:, 5:], SUPPORT / 2)):
                t = of[:, :5] + of[:, 5:] if not out else of[:, :5] if len(out) == 1 else of[:, 5:]
                share = c[:, :4] / t[:, :4]
                each = share.sum(axis=1)
                out.append(np.where((each > 0) & (c[:, 4] >= least), share @ np.arange(4) / np.maximum(each, 1e-300), np.nan).astype(np.float32))
            keep = pa.array(np.array([w[0] != "\x00" for w in words], bool))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], names=["word", "whole", "first", "second"]).filter(keep)

    graded = table.mapInArrow(grade, "word string, whole float, first float, second float").toArrow()  # the vocabulary
    index = {w: i for i, w in enumerate(graded["word"].to_pylist())}
    shared = spark.sparkContext.broadcast((index, [graded[c].to_numpy() for c in ("whole", "first", "second")]))

    def describe(batches):
        index, (_, first, second) = shared.value
        for batch in batches:
            for part, texts in slices(batch, "text"):
                h = part.column(3).to_numpy()
                a, b = features(texts, index, second), features(texts, index, first)  # each half by the other's grades
                x, n, zh = (np.where((h == 0).reshape(-1, *[1] * (i.ndim - 1)), i, j) for i, j in zip(a[:3], b[:3]))
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array([*x], pa.list_(pa.float64())), pa.array(n), pa.array(zh)], names=["votes", "x", "n", "zh"])

    fit = sampled(rated, ["doc_id"], rated.count(), most_rated)
    sample = fit.mapInArrow(describe, "votes array<struct<level:int,weight:double>>, x array<double>, n long, zh boolean").collect()  # about most_rated rows at most
    prior = np.zeros(4)
    models = {}
    for zh in (False, True, None):
        x, y, w = [], [], []
        for r in sample:
            if r["n"] >= 5 and zh in (None, r["zh"]):
                for v in r["votes"]:
                    x.append(r["x"])
                    y.append(v["level"])
                    w.append(v["weight"])
        if zh is None:
            for level, weight in zip(y, w):
                prior[level] += weight
        if len(x) >= (1 if zh is None else LEAST_FEATURES):
            models[zh] = softmax_fit(np.array(x), np.array(y), np.array(w), 4)
    fitted = spark.sparkContext.broadcast((models, int(prior.argmax())))

    def score(batches):
        by_script, usual = fitted.value
        index, (whole, *_) = shared.value
        for batch in batches:
            for part, texts in slices(batch, "text"):
                if None not in by_script:
                    continue
                x, n, zh, size = features(texts, index, whole)
                level = np.full(len(texts), usual)
                for script in (False, True):
                    pick = (zh == script) & (n > 0)
                    if pick.any():
                        level[pick] = softmax_classes(by_script.get(script, by_script[None]), x[pick])
                keep = pa.array((size >= 250) | (size >= 100) & zh)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([LEVELS[k] for k in level], pa.string())], names=["doc_id", "level"]).filter(keep)

    return src.mapInArrow(score, f"doc_id {kind}, level string")


def agreement(docs: DataFrame, ratings: DataFrame, most_rated: int = MOST_RATED) -> DataFrame:
    """rated, documents, agreeing, share: how the levels agree with a fifth of the ratings, when all is fitted on the other documents' ratings."""
    out = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)) == 0
    levels = reading_levels(docs, ratings.where(~out), most_rated)
    held = clean_ratings(ratings.where(out)).withColumn("rated", F.element_at(F.array(*map(F.lit, LEVELS)), F.col("level") + 1))
    both = held.select("doc_id", "rated").join(levels.dropDuplicates(["doc_id"]), "doc_id")
    s = both.groupBy("rated").agg(F.count("*").alias("documents"), F.count_if(F.col("rated") == F.col("level")).alias("agreeing"))
    return s.withColumn("share", F.round(F.col("agreeing") / F.col("documents"), 6))
