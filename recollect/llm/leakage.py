"""Problem 7: held-out evaluation passages inside training documents, by spaced-seed hashing.

1. A held-out text that opens with a sentence which several of them share (a general instruction) loses it.
2. Fixed masks slide over the words of both sides; a mask hashes five words and ignores those at its zeros, so a
   substituted word at an ignored place doesn't spoil the hit.
3. Hashes of the held-out side are joined with those of the documents. The held-out side is the stated query set: it is
   sent to the tasks in blocks of at most ``MOST_SEEDS`` seeds (one block for thousands of items), so the broadcast is
   bounded and the documents' hashes never leave their task.
4. Around the hits of a document and item, the diagonals are compared word by word; runs of equal words are chained over
   small substitutions, insertions and losses and over at most one longer interruption, of any length. The pair is a case if
   the chain covers at least ``share`` of the passage's words, and ``telling`` of them weighted by how few of all passages
   have a word, so that a phrase common to many passages doesn't make a case. ``share`` is a little under a third, as
   edited words inside a stretch don't count as covered. How many passages have a word is counted over the whole
   held-out side, in Spark, so results don't depend on the blocks.

Null, empty or wordless texts on either side: no case. Passages under five words: found only as whole seeds, so never.
Repeated documents with one id give one row. An empty table on either side: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.words import U, Vocabulary, hashed, mix, offsets, slices
from recollect.runtime import materialize

#: Five words each, at fixed places.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 5, 6), (0, 2, 3, 4, 6))
MOST_SEEDS = 4_000_000
MOST_INSTRUCTED = 3
FILTER_BITS = 22
SMALL = 6


def seeds(tokens: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """Hash at each place where the mask fits into the array."""
    n = len(tokens) - mask[-1]
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, U(number + 1))
    for at in mask:
        out = out * U(0x9E3779B97F4A7C15) + tokens[at : at + n]
    return mix(out)


def passages(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, passage): the texts without an opening sentence that at least three of them have."""
    t = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("t")).where("t is not null")
    t = t.withColumn("head", F.regexp_extract("t", r"^\s*[^.!?。！？]{3,200}(?:[.!?](?=\s)|[。！？])\s*", 0))
    heads = t.where("head <> ''").groupBy(F.trim("head").alias("h")).agg(F.countDistinct("item_id").alias("k")).where(f"k >= {MOST_INSTRUCTED}").select("h")
    t = t.join(heads, F.trim(F.col("head")) == F.col("h"), "left")
    return t.select("item_id", F.when(F.col("h").isNull(), F.col("t")).otherwise(F.expr("substring(t, length(head) + 1)")).alias("passage"))


def weighed(passage: DataFrame) -> DataFrame:
    """Adds ``weights`` to (item_id, passage): for each word of the passage the logarithm of the share of all passages without it."""
    passage = passage.withColumn("k", F.xxhash64("item_id", "passage"))

    def split(batches):
        vocabulary = Vocabulary()
        for batch in batches:
            for part, texts in slices(batch, "passage"):
                tokens, counts = hashed(texts, vocabulary)
                of = np.repeat(np.arange(len(counts)), counts)
                at = np.arange(len(tokens)) - offsets(counts)[:-1][of]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(at), pa.array(tokens.view(np.int64))], names=["k", "at", "word"])

    words = passage.select("k", "passage").mapInArrow(split, "k long, at long, word long")
    items = passage.agg(F.count("*").alias("items"))
    df = words.select("word", "k").distinct().groupBy("word").agg(F.count("*").alias("df")).join(F.broadcast(items))  # one row
    weight = words.join(df.select("word", F.log((1 + F.col("items")) / F.col("df")).alias("weight")), "word")
    lists = weight.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "weight"))), lambda x: x.weight).alias("weights"))  # as long as a passage
    return passage.join(lists, "k").select("item_id", "passage", "weights")


class Index:
    """The held-out side: words of all passages in one array, and their seeds in order of the hash."""

    def __init__(self, ids: list, texts: list, weights: list):
        self.ids = ids
        self.words, counts = hashed(texts, Vocabulary())
        self.start = offsets(counts)
        item = np.repeat(np.arange(len(ids)), counts)
        keys, of, at = [], [], []
        for m, mask in enumerate(MASKS):
            h = seeds(self.words, mask, m)
            n = len(h)
            fit = item[:n] == item[mask[-1] : mask[-1] + n]
            keys.append(h[fit])
            of.append(item[:n][fit])
            at.append(np.arange(n)[fit])
        key, self.of, self.at = (np.concatenate(x) for x in (keys, of, at))
        order = np.argsort(key, kind="stable")
        self.key, self.of, self.at = key[order], self.of[order], self.at[order]
        self.weight = np.concatenate([np.zeros(0), *weights])
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.key >> U(64 - FILTER_BITS)).astype(np.int64)] = True

    def hits(self, tokens: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, place in the documents' array, place in the items' array) of every equal seed."""
        found = [(np.zeros(0, np.int64),) * 2]
        for m, mask in enumerate(MASKS):
            h = seeds(tokens, mask, m)
            n = len(h)
            if not n:
                continue
            at = np.flatnonzero(self.filter[(h >> U(64 - FILTER_BITS)).astype(np.int64)] & (doc[:n] == doc[mask[-1] : mask[-1] + n]))
            low, high = np.searchsorted(self.key, h[at], "left"), np.searchsorted(self.key, h[at], "right")
            k = high - low
            rows = np.repeat(low, k) + (np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k))
            found.append((np.repeat(at, k), rows))
        place, rows = (np.concatenate(x) for x in zip(*found))
        return doc[place], self.of[rows], place, self.at[rows]


def runs(equal: np.ndarray, least: int = 3) -> list[tuple[int, int]]:
    """Stretches [i, j) of a diagonal with at least ``least`` equal words without a break."""
    edge = np.diff(np.concatenate(([0], equal.astype(np.int8), [0])))
    i, j = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = j - i >= least
    return [*zip(i[keep].tolist(), j[keep].tolist())]


def covered(item: np.ndarray, weight: np.ndarray, doc: np.ndarray, diagonals: np.ndarray) -> tuple[int, float]:
    """(words, weight) of the item in the chain of runs on the given diagonals that covers most words.

    A diagonal is the place in the document minus that in the item. Between runs, up to SMALL words of either side may
    be changed, lost or put in; once, any number of words may be put in.
    """
    parts = []
    sums = np.concatenate(([0], np.cumsum(weight)))
    for d in diagonals.tolist():
        low, high = max(0, -d), min(len(item), len(doc) - d)
        if high > low:
            parts += [(i + low, j + low, i + low + d, j + low + d) for i, j in runs(item[low:high] == doc[low + d : high + d])]
    parts.sort(key=lambda p: (p[2], p[0]))
    best: list[list[tuple]] = []
    top = (0, 0.0)
    for k, (i, j, x, y) in enumerate(parts):
        own = (j - i, sums[j] - sums[i])
        got = [own, own]  # without and with the one longer interruption
        for m in range(k - 1, -1, -1):
            pi, pj, px, py = parts[m]
            gap_item, gap_doc = i - pj, x - py
            if pj >= j or py >= y or not -SMALL <= gap_item <= SMALL or gap_doc < -SMALL:
                continue
            cut = max(0, pj - i, py - x)
            if cut >= j - i:
                continue
            new = (j - i - cut, sums[j] - sums[i + cut])
            if gap_doc <= SMALL:
                got = [max(g, (best[m][n][0] + new[0], best[m][n][1] + new[1])) for n, g in enumerate(got)]
            else:
                got[1] = max(got[1], (best[m][0][0] + new[0], best[m][0][1] + new[1]))
        best.append(got)
        top = max(top, got[1])
    return top


def leaks(docs: DataFrame, items: DataFrame, share: float = 0.32, telling: float = 0.25, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, covered, passage_words, told): one row per document and held-out item whose passage it holds."""
    spark = docs.sparkSession
    passage = materialize(weighed(passages(items).distinct()), "passages")
    total = passage.select(F.sum(F.length("passage")).alias("n")).first()["n"] or 0
    if total * len(MASKS) > MOST_SEEDS:
        parts = int(total * len(MASKS) // MOST_SEEDS) + 1
        blocks = [passage.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p) for p in range(parts)]
    else:
        blocks = [passage]
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    kinds = src.schema["doc_id"].dataType.simpleString(), passage.schema["item_id"].dataType.simpleString()
    out = None
    for block in blocks:
        rows = block.collect()  # at most MOST_SEEDS / len(MASKS) code points of held-out text
        index = spark.sparkContext.broadcast(Index([r["item_id"] for r in rows], [r["passage"] for r in rows], [r["weights"] for r in rows]))

        def run(batches, index=index):
            vocabulary, ix = Vocabulary(), index.value
            for batch in batches:
                for part, texts in slices(batch, "text"):
                    tokens, counts = hashed(texts, vocabulary)
                    doc = np.repeat(np.arange(len(counts)), counts)
                    start = offsets(counts)
                    d, i, x, p = ix.hits(tokens, doc)
                    pair = d * len(ix.ids) + i
                    diagonal = (x - start[d]) - (p - ix.start[i])
                    near = np.unique(np.unique(pair * (1 << 24) + p) >> 24, return_counts=True)
                    third = share * np.diff(ix.start)[near[0] % max(1, len(ix.ids))]
                    # a chain that long has at least so many seeds' places; one of up to six words may have a single one
                    pairs = near[0][near[1] >= np.maximum(np.where(third > 6, 2, 1), third / 4 - 2)]
                    order = np.argsort(pair, kind="stable")
                    low, high = np.searchsorted(pair[order], pairs, "left"), np.searchsorted(pair[order], pairs, "right")
                    result = []
                    for k, a, b in zip(pairs.tolist(), low.tolist(), high.tolist()):
                        dd, ii = divmod(k, len(ix.ids))
                        item = ix.words[ix.start[ii] : ix.start[ii + 1]]
                        weight = ix.weight[ix.start[ii] : ix.start[ii + 1]]
                        got, told = covered(item, weight, tokens[start[dd] : start[dd + 1]], np.unique(diagonal[order[a:b]]))
                        if got >= share * len(item) and told >= telling * weight.sum():
                            result.append((dd, ii, got, len(item), told / weight.sum()))
                    take = pa.array([r[0] for r in result], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(take), pa.array([ix.ids[r[1]] for r in result], passage_type), pa.array([r[2] for r in result], pa.int32()), pa.array([r[3] for r in result], pa.int32()), pa.array([r[4] for r in result], pa.float64())],
                        names=["doc_id", "item_id", "covered", "passage_words", "told"],
                    )

        passage_type = pa.int64() if kinds[1] == "bigint" else pa.int32() if kinds[1] == "int" else pa.string()
        found = src.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, covered int, passage_words int, told double")
        out = found if out is None else out.union(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("covered").alias("covered"), F.max("passage_words").alias("passage_words"), F.max("told").alias("told"))
