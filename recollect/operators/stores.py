"""Tables that change: operation logs folded into a state, upserts, eviction, sessions of turns, value updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_log(log: DataFrame, key: str, order: list[str], op: str, value: str) -> DataFrame:
    """key, value, version: the state after all operations ADD, UPDATE, DELETE and NONE in order.

    The state of a key is its last ADD or UPDATE if no DELETE follows; an UPDATE of an unknown key adds it, a DELETE of one
    is skipped. Blank values and NONE change nothing. One aggregation with map-side combination; nothing is collected.
    """
    at = F.struct(*order)
    writes = F.col(op).isin("ADD", "UPDATE") & (F.trim(F.col(value).cast("string")) != "")
    g = log.groupBy(key).agg(
        F.max_by(F.when(writes, F.struct(F.col(value).alias("value"))), F.when(writes, at)).alias("w"), F.max(F.when(writes, at)).alias("wa"), F.max(F.when(F.col(op) == "DELETE", at)).alias("da"), F.count_if(writes).alias("version")
    )
    return g.where(F.col("wa").isNotNull() & (F.col("da").isNull() | (F.col("wa") > F.col("da")))).select(key, F.col("w.value").alias(value), "version")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their keys; keys are unique in each."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def sessionized(turns: DataFrame, by: list[str], ts: str, gap_seconds: int) -> DataFrame:
    """Adds ``segment``: a new one begins after more than ``gap_seconds`` without a row."""
    w = Window.partitionBy(*by).orderBy(ts, *[c for c in turns.columns if c.endswith("_id") and c not in by][:1])
    new = (F.col(ts).cast("timestamp").cast("double") - F.lag(F.col(ts).cast("timestamp").cast("double")).over(w)) > gap_seconds
    return turns.withColumn("segment", F.sum(F.coalesce(new.cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def q_learning(rewards: DataFrame, key: str, order: str, reward: str, alpha: float = 0.3, decay: float = 0.2) -> DataFrame:
    """key, q, visits, average: the ordered fold q += alpha * (r - q) and an exponential mean of the rewards, per key.

    The order matters, so a key's rewards form one ordered array, folded by the engine.
    """
    g = rewards.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, reward))).alias("r"))
    zero = F.struct(F.lit(0.0).alias("q"), F.lit(0.0).alias("m"))
    step = lambda s, x: F.struct(((1 - alpha) * s.q + alpha * x[reward]).alias("q"), ((1 - decay) * s.m + decay * x[reward]).alias("m"))
    return g.select(key, F.size("r").alias("visits"), F.aggregate("r", zero, step).alias("s")).select(key, "visits", F.col("s.q").alias("q"), F.col("s.m").alias("average"))


def evicted(rows: DataFrame, by: str, newest: list[Column], limit: int, share: float = 0.8) -> DataFrame:
    """Where a group holds at least ``share`` of the limit, its latest ``limit`` rows; other groups whole."""
    w = Window.partitionBy(by)
    r = rows.withColumn("_size", F.count("*").over(w)).withColumn("_n", F.row_number().over(w.orderBy(*newest)))
    return r.where((F.col("_size") < share * limit) | (F.col("_n") <= limit)).drop("_size", "_n")


class Collection:
    """A vector collection held as one DataFrame (vec_id, v, payload columns): the operations of a vector store, each a plan.

    Changes replace the frame; ``save`` writes it, after which later plans start from the table.
    """

    def __init__(self, rows: DataFrame, key: str = "vec_id"):
        self.rows, self.key = rows, key

    def insert(self, rows: DataFrame) -> Collection:
        """Rows of new keys; those of known keys are left as they are."""
        return Collection(self.rows.unionByName(rows.join(self.rows.select(self.key), self.key, "left_anti")), self.key)

    def update(self, rows: DataFrame) -> Collection:
        """Rows of known keys are replaced, others left out."""
        return Collection(upsert(self.rows, rows.join(self.rows.select(self.key), self.key, "left_semi"), [self.key]), self.key)

    def delete(self, condition: Column) -> Collection:
        return Collection(self.rows.where(~F.coalesce(condition, F.lit(False))), self.key)

    def get(self, *keys: int) -> DataFrame:
        return self.rows.where(F.col(self.key).isin(*keys))

    def list(self, condition: Column | None = None, limit: int | None = None) -> DataFrame:
        rows = self.rows if condition is None else self.rows.where(condition)
        return rows if limit is None else rows.orderBy(self.key).limit(limit)

    def search(self, queries: DataFrame, k: int, condition: Column | None = None) -> DataFrame:
        """query_id, vec_id, score, rank of the k nearest by cosine among the rows that meet the condition."""
        from recollect.operators.retrieval import dense

        return dense(queries, self.list(condition).select(F.col(self.key).alias("vec_id"), "v"), k)

    def save(self, name: str) -> Collection:
        from recollect.runtime import materialize

        return Collection(materialize(self.rows, name), self.key)


def retained(old: DataFrame, new: DataFrame, by: str, key: str, keep: int, capacity: int) -> DataFrame:
    """by, key, score, recordings: a monitor after an update.

    ``old`` (by, key, score, recordings) and ``new`` (by, key, score): keys of both take the new score and count one more, new ones count
    one; of the old ones that didn't come again the best ``keep`` stay, with score 0 and a count of one; the best ``capacity`` remain.
    """
    both = old.withColumnsRenamed({"score": "_old"}).join(new, [by, key], "full")
    seen = both.where("score is not null").select(by, key, "score", (F.coalesce("recordings", F.lit(0)) + 1).alias("recordings"))
    w = Window.partitionBy(by)
    gone = both.where("score is null").withColumn("n", F.row_number().over(w.orderBy(F.desc("_old"), key))).where(F.col("n") <= keep)
    rows = seen.unionByName(gone.select(by, key, F.lit(0.0).alias("score"), F.lit(1).cast(seen.schema["recordings"].dataType).alias("recordings")))
    return rows.withColumn("n", F.row_number().over(w.orderBy(F.desc("score"), F.desc("recordings"), key))).where(F.col("n") <= capacity).drop("n")


def history(log: DataFrame, key: str, order: str, op: str, value: str) -> DataFrame:
    """Adds ``old``: what a key held before each operation; nothing before its first write and after a DELETE."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(op).isin("ADD", "UPDATE", "DELETE"), F.struct(F.col(op).alias("op"), F.col(value).alias("value"))), ignorenulls=True).over(w)
    return log.withColumn("_last", last).withColumn("old", F.when(F.col("_last.op") != "DELETE", F.col("_last.value"))).drop("_last")


def resumed(queries: DataFrame, persona: str, query: str, stopped_at: int, finished: int) -> DataFrame:
    """query, runs: how often each query is evaluated when a run stops within a persona and is resumed.

    The list of finished queries is cleared with the persona at hand, so its first ``finished`` queries are evaluated again; earlier
    personas are skipped. Results are upserted by query, so each keeps one.
    """
    n = F.row_number().over(Window.partitionBy(persona).orderBy(query))
    before = queries.where(F.col(persona) <= stopped_at).withColumn("n", n).where((F.col(persona) < stopped_at) | (F.col("n") <= finished)).select(query)
    after = queries.where(F.col(persona) >= stopped_at).select(query)
    return before.union(after).groupBy(query).agg(F.count("*").alias("runs"))


def resolved(rows: DataFrame, key: str, order: str, value: str, verdict: str) -> DataFrame:
    """key, value, duplicates, archived, last_conflict: a memory's history by the verdict on each new text against what it held.

    An 'entailment' adds a duplicate, any other verdict archives the present text and puts the new one in its place.
    """
    changes = F.col(verdict) != "entailment"
    return rows.groupBy(key).agg(
        F.max_by(F.when(changes, F.col(value)), F.when(changes, F.col(order))).alias(value), F.count_if(~changes).alias("duplicates"), F.greatest(F.count_if(changes) - 1, F.lit(0)).alias("archived"),
        F.max(F.when(F.col(verdict) == "contradiction", F.col(order))).alias("last_conflict"),
    )
