"""Retrieval: BM25, dense search, fusion, reranking, deduplication and packing of results.

Searches take a stated set of queries against all rows. The query side is held in blocks of a checked size, so the rows are
never crossed with each other and never shuffled for scoring.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators import scoring
from recollect.operators.scoring import DOCS, MOST_TERMS, Best, best_by_terms, matrix_of, nine_digits, occurrences, ranked_best, summed, units
from recollect.runtime import materialize

#: Most query vectors that are sent to the tasks at once.
BLOCK = 16_384


def rounded(x: Column) -> Column:
    """To nine digits, in floating point; ``round`` of a double goes through decimals, which is slow over many rows."""
    return F.floor(x * 1e9 + 0.5).cast("double") / 1e9


def lookup_vectors(vectors: DataFrame, condition: Column, most: int = 16) -> list[Column]:
    """A few vectors as literals, by id."""
    rows = vectors.where(condition).orderBy("vec_id").limit(most).collect()
    return [F.array(*map(F.lit, map(float, r["v"]))) for r in rows]


def dense(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", threshold: float | None = None) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest vectors of each query; ties go to the least vec_id.

    ``queries`` (query_id, v) are read in blocks of at most BLOCK and scored by matrix products with blocks of ``corpus``
    (vec_id, v), which is in order of vec_id in a task; each task keeps k per query, so that the shuffle carries k rows per query and task. Null vectors, those of
    another length and, for the cosine, zero vectors are left out. With a threshold, k may be None: all pairs above it.
    """
    spark = corpus.sparkSession
    schema = "query_id long, vec_id long, score double"
    out = spark.createDataFrame([], schema)
    rows = queries.where("v is not null").toLocalIterator()
    while b := [*islice(rows, BLOCK)]:
        ids = [r["query_id"] for r in b]
        q = np.array([r["v"] for r in b], float).reshape(len(b), -1)
        if metric == "cosine":
            n = np.linalg.norm(q, axis=1)
            ids, q = [i for i, x in zip(ids, n) if x > 0], q[n > 0] / n[n > 0][:, None]
        shared = spark.sparkContext.broadcast((np.array(ids, dtype=np.int64), q))

        def score(batches, shared=shared):
            ids, q = shared.value
            best = None if k is None else Best(len(ids), k, -np.inf)
            for batch in batches:
                if not len(ids) or not batch.num_rows:
                    continue
                ok, m = matrix_of(batch.column(1), q.shape[1])
                vec = batch.column(0).filter(pa.array(ok))
                if metric == "cosine":
                    n = np.linalg.norm(m, axis=1)
                    vec, m = vec.filter(pa.array(n > 0)), m[n > 0] / n[n > 0][:, None]
                for lo in range(0, len(vec), DOCS):
                    part = m[lo : lo + DOCS]
                    for start in range(0, len(ids), scoring.QUERIES):
                        x = q[start : start + scoring.QUERIES]
                        s = x @ part.T if metric != "l2" else -np.sqrt(np.maximum((x**2).sum(1)[:, None] + (part**2).sum(1)[None] - 2 * x @ part.T, 0))
                        if best is not None:
                            if threshold is not None:
                                s[nine_digits(s) < threshold] = -np.inf
                            best.add(start, s, best.seen + lo)
                            continue
                        a, c = np.nonzero(s >= threshold - 1e-9)
                        v = nine_digits(s[a, c])
                        a, c, v = a[v >= threshold], c[v >= threshold], v[v >= threshold]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[a + start]), vec.take(pa.array(c + lo)), pa.array(v)], names=["query_id", "vec_id", "score"])
                if best is not None:
                    best.ids.append(vec)
                    best.seen += len(vec)
            if best is not None:
                yield from best.rows(pa.array(ids), pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

        vecs = corpus.select(F.col("vec_id").cast("long"), "v")
        found = (vecs if k is None else vecs.sortWithinPartitions("vec_id")).mapInArrow(score, schema)
        out = out.union(found)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def similar_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """src, dst, sim: every pair src < dst of ``vectors`` (vec_id, v) with a cosine of at least ``threshold``, once.

    All vectors are the left side, read by blocks as in ``dense``.
    """
    pairs = dense(vectors.select(F.col("vec_id").alias("query_id"), "v"), vectors.select("vec_id", "v"), None, threshold=threshold)
    return pairs.where("query_id < vec_id").select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), F.col("score").alias("sim"))


class Index:
    """The words of a corpus by document, written once and read by every search, with its statistics."""

    def __init__(self, docs: DataFrame, tokens: Callable[[Column], Column], beside: tuple[str, ...] = ()):
        """``beside``: columns that hang on the document and are kept with its words."""
        self.tokens = tokens
        # parts: the words of each row of a document; a document with rows of several lengths has a posting per term and length
        self.docs = materialize(docs.select("doc_id", *beside, tokens(F.coalesce("text", F.lit(""))).alias("t")).groupBy("doc_id").agg(F.collect_list("t").alias("parts"), *(F.first(c).alias(c) for c in beside)), "index")
        self.stats = self.docs.agg(
            F.coalesce(F.sum(F.size("parts")), F.lit(0)).alias("N"), F.coalesce(F.sum(F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.size(p))), F.lit(0)).alias("words")
        ).select("N", F.coalesce(F.try_divide(F.col("words").cast("double"), F.col("N")), F.lit(0.0)).alias("avgdl"))
        self.df = materialize(self.docs.select("parts").mapInArrow(frequencies, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")), "frequencies")

    def postings(self, docs: DataFrame | None = None) -> DataFrame:
        """(term, doc_id, tf, dl) of all documents, or of those that ``docs`` (doc_id) has."""
        d = self.docs if docs is None else self.docs.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        p = d.select("doc_id", F.explode("parts").alias("t")).select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
        return p.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))


def frequencies(batches):
    """(term, df): in how many documents, of one length, a word stands; per batch."""
    for batch in batches:
        if batch.num_rows:
            words = pc.unique(batch.column(0).flatten().flatten())
            *_, code, _ = occurrences(batch.column(0), words)
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(code, minlength=len(words)).astype(np.int64))], names=["term", "df"])


_INDEXES: dict[tuple, Index] = {}


def index_of(spark, folder: str, name: str, docs: Callable[[], DataFrame], tokens: Callable[[Column], Column]) -> Index:
    """The index of a named corpus, built on its first use in an application."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _INDEXES:
        _INDEXES[key] = Index(docs(), tokens)
    return _INDEXES[key]


def bm25(queries: DataFrame, docs: DataFrame | Index, tokens: Callable[[Column], Column], k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, unique: bool = False, change: Callable | None = None) -> DataFrame:
    """query_id, doc_id, score, rank by Okapi BM25; scores of 0 or less are dropped after ranking.

    Negative idf values are replaced by ``epsilon`` times the mean idf of all terms. Terms repeated in a query count
    repeatedly unless ``unique``. All documents are scored, block by block (``best_by_terms``); statistics cover all of them.
    ``docs`` may be an index that is there already; ``change`` is that of ``best_by_terms``.
    """
    index = docs if isinstance(docs, Index) else Index(docs, tokens)
    q, avgdl = query_weights(queries, index, epsilon, unique), index.stats.first()["avgdl"]
    return ranked_best(best_by_terms(q, index.docs, k, weighted(avgdl, k1, b), change=change), k)


def near_ends(vectors: DataFrame, ends: tuple[str, ...], threshold: float) -> Callable:
    """The change of ``best_by_terms`` that leaves out pairs unless the cosine of one of the query's vectors (query_id, v) and one of
    the document's (columns ``ends``) reaches the threshold."""
    rows = vectors.where("v is not null").collect()  # a stated query set
    layers: list[dict] = []  # a query with several texts has a vector in each of several layers
    for r in rows:
        place = next((x for x in layers if r["query_id"] not in x), None)
        if place is None:
            layers.append(place := {})
        place[r["query_id"]] = r["v"]
    shared = vectors.sparkSession.sparkContext.broadcast(layers)
    known: dict = {}

    def change(query_ids, batch):
        if known.get("ids") is not query_ids:
            size = len(next(iter(shared.value[0].values()))) if shared.value else 1
            zero = [0.0] * size
            known.update(ids=query_ids, size=size, q=[units(np.array([x.get(i, zero) for i in query_ids.to_pylist()], float)) for x in shared.value])
        sides = []
        for c in ends:
            ok, m = matrix_of(batch.column(batch.schema.get_field_index(c)), known["size"])
            v = np.zeros((batch.num_rows, known["size"]))
            v[ok] = units(m)
            sides.append(v)

        def changed(start, lo, s, low):
            size, width = s.shape
            at = np.flatnonzero((s > (low + 4e-10)[:, None]).ravel())
            if at.size * 16 < s.size:  # few pairs count at all
                a, c = np.divmod(at, width)
                near = np.zeros(at.size, bool)
                for q in known["q"]:
                    for v in sides:
                        near |= np.einsum("ij,ij->i", q[a + start], v[c + lo]) >= threshold - 5e-10
                s.ravel()[at[~near]] = 0
                return
            near = np.zeros(s.shape, bool)
            for q in known["q"]:
                for v in sides:
                    near |= q[start : start + size] @ v[lo : lo + width].T >= threshold - 5e-10  # to nine digits
            s[~near] = 0

        return changed

    return change


def query_weights(queries: DataFrame, index: Index, epsilon: float = 0.25, unique: bool = False) -> DataFrame:
    """query_id, term, w: idf times the term's number in the query."""
    idf = index.df.join(F.broadcast(index.stats)).select("term", F.log((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))  # stats is one row
    mean = idf.agg(F.avg("raw").alias("mean"))
    q = queries.select("query_id", F.explode(F.array_distinct(index.tokens(F.col("text"))) if unique else index.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    q = q.join(idf, "term").join(F.broadcast(mean)).select("query_id", "term", (F.col("qtf") * F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw"))).alias("w"))
    return materialize(q, "terms")


def weighted(avgdl: float, k1: float = 1.5, b: float = 0.75) -> Callable:
    """The hits of ``best_by_terms`` with BM25's weight of a term in a document."""

    def hits(batch, vocabulary):
        of, length, part, code, tf = occurrences(batch.column(batch.schema.get_field_index("parts")), vocabulary)
        w = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[part] / (avgdl or 1)))
        return (of[part], code, w) if len(of) == batch.num_rows else summed(of[part], code, w, len(vocabulary))

    return hits


def minmax(df: DataFrame, by: str, value: str, name: str, slack: float = 1e-6) -> DataFrame:
    w = Window.partitionBy(by)
    return df.withColumn(name, (F.col(value) - F.min(value).over(w)) / (F.max(value).over(w) - F.min(value).over(w) + slack))


def scaled(df: DataFrame, by: str, value: str, name: str, slack: float = 1e-6) -> DataFrame:
    """``minmax`` where a group may hold a third of all rows: bounds by a combined aggregation, joined back, so that no group is one task."""
    bounds = df.groupBy(by).agg(F.min(value).alias("_low"), F.max(value).alias("_high")).withColumnRenamed(by, "_by")
    return df.join(bounds, df[by].eqNullSafe(F.col("_by"))).withColumn(name, (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low") + slack)).drop("_low", "_high", "_by")


def ranked(df: DataFrame, by: str, order: list[Column], name: str) -> DataFrame:
    """Adds the running number of each row within its group, for groups of any size.

    Rows are put in order over all tasks by range; a row's number is its number within its task and group plus the rows of the group
    in earlier tasks, which one row per task and group tells.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = materialize(df.repartitionByRange(tasks, F.col(by), *order).withColumn("_task", F.spark_partition_id()), "ranked")
    counts = part.groupBy("_task", by).agg(F.count("*").alias("_rows"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.partitionBy(by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(F.col("_task").alias("_t"), F.col(by).alias("_b"), "_before")
    own = F.row_number().over(Window.partitionBy("_task", by).orderBy(*order))
    return part.withColumn("_own", own).join(before, (F.col("_task") == F.col("_t")) & F.col(by).eqNullSafe(F.col("_b"))).withColumn(name, (F.col("_own") + F.col("_before")).cast("int")).drop("_own", "_before", "_task", "_t", "_b")


def hybrid(lexical: DataFrame, semantic: DataFrame, alpha: float, k: int) -> DataFrame:
    """alpha * normalized lexical + (1 - alpha) * semantic score, over documents found by either; a missing score is 0."""
    lex = minmax(lexical, "query_id", "score", "lex").select("query_id", "doc_id", "lex")
    sem = semantic.select("query_id", "doc_id", F.col("score").alias("sem"))
    s = lex.join(sem, ["query_id", "doc_id"], "full").fillna(0.0, ["lex", "sem"]).withColumn("score", F.round(alpha * F.col("lex") + (1 - alpha) * F.col("sem"), 9))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank) of each document over ranked lists (query_id, doc_id, rank)."""
    u = lists[0].select("query_id", "doc_id", "rank")
    for x in lists[1:]:
        u = u.union(x.select("query_id", "doc_id", "rank"))
    return u.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def recency(score: Column, age_days: Column, half_life: float = 14.0) -> Column:
    return score * (0.3 + 0.7 * F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life))


def ranked_per_query(hits: DataFrame, per_query: Callable[[pd.DataFrame], list[int]], vectors: DataFrame, most: int) -> DataFrame:
    """Applies a sequential choice among the best ``most`` hits of each query, so that a group never exceeds that bound."""
    best = hits.where(F.col("rank") <= most).join(vectors.select(F.col("vec_id").alias("doc_id"), "v"), "doc_id", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        out = pdf.loc[per_query(pdf), ["query_id", "doc_id", "score"]].reset_index(drop=True)
        out["rank"] = np.arange(1, len(out) + 1)
        return out

    return best.groupBy("query_id").applyInPandas(run, "query_id long, doc_id long, score double, rank int")


def similarities(pdf: pd.DataFrame) -> np.ndarray:
    """Cosine of every two rows' vectors; 0 where one is missing."""
    size = max([len(v) for v in pdf["v"] if v is not None], default=1)
    m = np.array([np.zeros(size) if v is None else np.asarray(v, float) for v in pdf["v"]])
    n = np.linalg.norm(m, axis=1)
    m = m / np.where(n > 0, n, 1)[:, None]
    return m @ m.T


def choose_dissimilar(limit: float = 0.92) -> Callable[[pd.DataFrame], list[int]]:
    """Greedily by score: a row stays if it is no nearer than ``limit`` to any row kept before."""

    def choose(pdf: pd.DataFrame) -> list[int]:
        s, kept = similarities(pdf), []
        for i in range(len(pdf)):
            if all(s[i, j] <= limit for j in kept):
                kept.append(i)
        return kept

    return choose


def choose_mmr(k: int, weight: float = 0.7, prefill: int = 0, steep: float | None = None, knee: float = 0.9) -> Callable[[pd.DataFrame], list[int]]:
    """Maximal marginal relevance; with ``steep``, similarity beyond ``knee`` is punished exponentially. First maximum wins."""

    def choose(pdf: pd.DataFrame) -> list[int]:
        s, score = similarities(pdf), pdf["score"].to_numpy()
        kept = [*range(min(prefill, len(pdf)))]
        while len(kept) < min(k, len(pdf)):
            rest = [i for i in range(len(pdf)) if i not in kept]
            near = np.array([max([0.0, *(s[i, j] for j in kept)]) for i in rest])
            cost = near if steep is None else np.where(near > knee, near * np.exp(steep * (near - knee)), near)
            kept.append(rest[int(np.argmax(weight * score[rest] - (1 - weight) * cost))])
        return kept

    return choose


def packed_context(hits: DataFrame, budget: int, header: int, size: str = "tokens", least: int = 100) -> DataFrame:
    """Documents by rank until the budget is used; the first that passes it is cut if over ``least`` tokens remain, later ones drop."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    cost = F.col(size) + header
    h = hits.withColumn("before", F.coalesce(F.sum(cost).over(w), F.lit(0)))
    whole = F.col("before") + cost <= budget
    left = budget - F.col("before") - header
    return h.withColumn("used", F.when(whole, F.col(size)).when(left > least, left).otherwise(F.lit(0))).where("used > 0").select("query_id", "doc_id", "rank", "used")


def kept_suffix(rows: DataFrame, by: str, order: str, size: str, budget: int) -> DataFrame:
    """The latest rows whose sizes add up to at most the budget."""
    w = Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_upto", F.sum(size).over(w)).where(F.col("_upto") <= budget).drop("_upto")


def tfidf_weights(index: Index, docs: DataFrame | None = None) -> DataFrame:
    """term, doc_id, w, df: tf * (ln((1 + N) / (1 + df)) + 1), each document (of ``docs``, if given) scaled to length 1."""
    w = index.postings(docs).join(index.df, "term").join(F.broadcast(index.stats))  # one row
    w = w.select("term", "doc_id", "df", (F.col("tf") * (F.log((1 + F.col("N")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "doc_id").select("term", "doc_id", "df", (F.col("w") / F.col("norm")).alias("w"))


def tfidf_rerank(queries: DataFrame, hits: DataFrame, index: Index, k: int, weight: float = 0.7) -> DataFrame:
    """query_id, doc_id, score, rank: ``weight`` * score + (1 - weight) * tf-idf cosine over the candidates, the best k of each query."""
    w = tfidf_weights(index, hits)  # a document's weights rest on its own words and the corpus' frequencies alone
    q = queries.select("query_id", F.explode(index.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    q = q.join(index.df, "term").join(F.broadcast(index.stats)).select("query_id", "term", (F.col("qtf") * (F.log((1 + F.col("N")) / (1 + F.col("df"))) + 1)).alias("qw"))
    norm = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("norm"))
    q = q.join(norm, "query_id").select("query_id", "term", (F.col("qw") / F.col("norm")).alias("qw"))
    cos = hits.select("query_id", "doc_id").join(q, "query_id").join(w, ["doc_id", "term"]).groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("w")).alias("cos"))
    s = hits.select("query_id", "doc_id", "score").join(cos, ["query_id", "doc_id"], "left").select("query_id", "doc_id", rounded(weight * F.col("score") + (1 - weight) * F.coalesce("cos", F.lit(0.0))).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)


def tfidf_pairs(index: Index, threshold: float) -> DataFrame:
    """a, b: the documents a < b whose tf-idf cosine reaches the threshold, exactly.

    With the terms in order of rarity, two such documents share a term before the point from which the rest of either's vector is
    shorter than the threshold; only these prefixes, which leave the frequent terms out, are joined.
    """
    w = tfidf_weights(index)
    later = Window.partitionBy("doc_id").orderBy("df", "term").rowsBetween(0, Window.unboundedFollowing)
    prefix = w.withColumn("rest", F.sqrt(F.sum(F.col("w") * F.col("w")).over(later))).where(F.col("rest") >= threshold - 1e-9).select("term", "doc_id")
    pairs = prefix.withColumnRenamed("doc_id", "a").join(prefix.withColumnRenamed("doc_id", "b"), "term").where("a < b").select("a", "b").distinct()
    va, vb = w.select(F.col("doc_id").alias("a"), "term", F.col("w").alias("wa")), w.select(F.col("doc_id").alias("b"), "term", F.col("w").alias("wb"))
    return pairs.join(va, "a").join(vb, ["b", "term"]).groupBy("a", "b").agg(rounded(F.sum(F.col("wa") * F.col("wb"))).alias("cos")).where(F.col("cos") >= threshold).select("a", "b")


def keep_first(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, kept: in order of the ids, one stays unless an earlier one that stays is paired with it (a < b).

    Rounds decide every id whose earlier neighbours are decided; each is written, and they are as many as the longest chain.
    """
    pairs = materialize(pairs.select("a", "b").distinct(), "pairs")
    state = materialize(ids.select("id").distinct().join(pairs.select(F.col("b").alias("id")).distinct(), "id", "left_anti").withColumn("kept", F.lit(True)), "kept")
    open_ = materialize(pairs.select(F.col("b").alias("id")).distinct(), "open")
    while not open_.isEmpty():
        known = pairs.join(open_.withColumnRenamed("id", "b"), "b", "left_semi").join(state.select(F.col("id").alias("a"), "kept"), "a", "left")
        g = known.groupBy("b").agg(F.coalesce(F.bool_or("kept"), F.lit(False)).alias("beside"), F.count_if(F.col("kept").isNull()).alias("unknown"))
        new = materialize(g.where("beside or unknown = 0").select(F.col("b").alias("id"), (~F.col("beside")).alias("kept")), "kept")
        state, open_ = state.unionByName(new), materialize(open_.join(new, "id", "left_anti"), "open")
    return state


def word_search(queries: DataFrame, fields: DataFrame, tokens: Callable[[Column], Column], limit: int, prefix: int = 3) -> DataFrame:
    """query_id, doc_id, score, mode: documents with all words of a query, or, where those are fewer than the limit, with any.

    ``fields``: doc_id, text, weight. A query's word of at least ``prefix`` letters matches every word that it begins. The score sums
    each word's heaviest field and is brought below 1 by x / (x + 1); the best ``limit`` of a query, ties by doc_id.
    The documents are scored by blocks, once for both modes and for each different set of words, however many queries ask for it.
    """
    d = fields.select("doc_id", "weight", tokens(F.coalesce("text", F.lit(""))).alias("t")).groupBy("doc_id").agg(F.collect_list("t").alias("parts"), F.collect_list(F.col("weight").cast("double")).alias("weights"))
    d = materialize(d, "fields")
    q = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("w")).select("query_id", F.size("w").alias("words"), F.explode("w").alias("term"))
    q = q.groupBy("query_id", "words").agg(F.array_sort(F.collect_set("term")).alias("terms"))  # a set of words
    q = materialize(q.withColumn("set", F.concat_ws("#", F.col("words").cast("string"), F.array_join("terms", "\x01"))), "words")
    sets = q.groupBy("set").agg(F.first("terms").alias("terms")).select(F.col("set").alias("query_id"), F.explode("terms").alias("term"), F.lit(1.0).alias("w"))
    best = best_by_terms(materialize(sets, "terms"), d, limit, field_hits(prefix), split=split_hits)
    best = best.withColumn("score", rounded(F.col("score") / (F.col("score") + 1)))
    first = lambda by: F.row_number().over(Window.partitionBy(by, "mode").orderBy(F.desc("score"), "doc_id"))
    best = best.withColumn("n", first("query_id")).where(F.col("n") <= limit).select(F.col("query_id").alias("set"), "doc_id", "score", "mode")  # ``limit`` rows of each task
    found = materialize(q.select("query_id", "set").join(best, "set").withColumn("n", first("query_id")).where(F.col("n") <= limit).select("query_id", "doc_id", "score", "mode"), "best")
    whole = found.where("mode = 'and'")
    enough = whole.groupBy("query_id").agg(F.count("*").alias("whole")).where(F.col("whole") >= limit).select("query_id")
    return whole.join(enough, "query_id", "left_semi").union(found.where("mode = 'or'").join(enough, "query_id", "left_anti"))


#: What a word that is found adds to the sum of weights, so that one product tells both; sums of weights stay below.
FOUND = 1024.0


def field_hits(prefix: int) -> Callable:
    """The hits of ``best_by_terms`` for columns parts and weights: FOUND and the heaviest weight of a part with a word that begins so."""

    def hits(batch, vocabulary):
        parts, weights = (batch.column(batch.schema.get_field_index(c)) for c in ("parts", "weights"))
        own = {w: i for i, w in enumerate(vocabulary.to_pylist())}
        inner = parts.flatten()
        row = np.repeat(np.arange(len(parts)), parts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        heavy = weights.flatten().to_numpy(zero_copy_only=False)
        part = np.repeat(np.arange(len(row)), inner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        words = inner.flatten().dictionary_encode()
        match = [[i for i in (own.get(x) for x in (w, *(w[:n] for n in range(prefix, len(w))))) if i is not None] for w in words.dictionary.to_pylist()]
        times = np.array([len(m) for m in match], np.int64)
        codes, begin = np.array([i for m in match for i in m], np.int64), np.cumsum(times) - times
        word = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        each = times[word]
        code = codes[np.repeat(begin[word] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]
        part = np.repeat(part, each)
        row, code, weight = summed(row[part], code, heavy[part], len(own), np.maximum)
        return row, code, weight + FOUND

    return hits


def split_hits(sets) -> Callable:
    """The split of ``best_by_terms``: from sums with FOUND to sums of weights where all words of a set (``words#..``) are found, and where any."""
    words = np.array([int(x.partition("#")[0]) for x in sets.to_pylist()])

    def divided(start, s):
        flat = s.ravel()
        at = np.flatnonzero(flat)
        found = np.floor(flat[at] / FOUND)
        flat[at] -= found * FOUND
        every = at[found == words[at // s.shape[1] + start]]
        whole = np.zeros_like(s)
        whole.ravel()[every] = flat[every]
        return {"and": whole, "or": s}

    return divided


def encoded_cursor(values: list) -> str:
    """An opaque cursor of a row's sort value and id."""
    return base64.urlsafe_b64encode(json.dumps(values).encode()).decode()


def cursor_page(rows: DataFrame, sort: str, id_col: str, allowed: tuple[str, ...], cursor: str | None, limit: int, most: int = 100) -> tuple[list, str | None]:
    """(rows, next cursor): at most ``most`` rows after the cursor, by ``sort`` descending and id; one row more tells whether there is a next page."""
    if sort not in allowed:
        raise ValueError(f"sort by one of {allowed}")
    limit = max(1, min(limit, most))
    if cursor:
        value, last = json.loads(base64.urlsafe_b64decode(cursor))
        at = F.lit(value).cast(rows.schema[sort].dataType)
        rows = rows.where((F.col(sort) < at) | ((F.col(sort) == at) & (F.col(id_col) > last)))
    page = rows.orderBy(F.desc(sort), id_col).limit(limit + 1).collect()  # at most 101 rows
    more = len(page) > limit
    return page[:limit], encoded_cursor([page[limit - 1][sort], page[limit - 1][id_col]]) if more else None


def middle_page(rows: DataFrame, order: list[Column], after: Column, before: Column, limit: int) -> DataFrame:
    """Of the first 2 * limit rows between two bounds, the ``limit`` in the middle."""
    few = rows.where(after & before).orderBy(*order).limit(2 * limit)  # bounded, so the windows hold at most 2 * limit rows
    w = Window.orderBy(*order)
    few = few.withColumn("_n", F.row_number().over(w) - 1).withColumn("_all", F.count("*").over(Window.partitionBy()))
    start = F.greatest(F.lit(0), F.floor((F.col("_all") - limit) / 2))
    return few.where((F.col("_n") >= start) & (F.col("_n") < start + limit)).drop("_n", "_all")
