"""Units of evaluation, curation of knowledge points and events, and injection of noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that mark a knowledge point as a trap, in its category or name, and in its content.
TRAP_KEYWORDS = (
    "过敏", "allergy", "用药史", "药物史", "medication_history", "用药记录", "长期用药", "疾病史", "病史", "既往史", "disease_history", "给药偏好", "服药偏好",
    "medication_preference", "剂型偏好", "饮食偏好", "饮食习惯", "diet_preference", "食物偏好", "生活经济", "经济情况", "医保", "lifestyle_economic", "经济", "医保情况",
)
TRAP_INDICATORS = ("过敏", "禁忌", "不能吃", "不能用", "会过敏", "禁用")
#: Types an event may have; others count as health.
EVENT_TYPES = ("health", "life", "work", "allergy", "medication_history", "disease_history", "medication_preference", "diet_preference", "lifestyle_economic")


def any_contains(x: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.coalesce(x, F.lit("")), F.lit(w))
    return out


def is_trap() -> Column:
    return any_contains(F.col("category"), TRAP_KEYWORDS) | any_contains(F.col("name"), TRAP_KEYWORDS) | any_contains(F.col("content"), TRAP_INDICATORS)


def memory_points(kps: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Points that are traps or score above the threshold, the first of each (persona, category, name, content)."""
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("persona_id", "category", "name", "content")]
    w = Window.partitionBy(*key).orderBy("session_id", "kp_id")
    kept = kps.where(is_trap() | (F.coalesce("trap_score", F.lit(0.5)) > threshold))
    return kept.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_points(kps: DataFrame, up_to: int | None = None) -> DataFrame:
    """Points of the latest session of each (persona, category, name); ties stay."""
    k = kps if up_to is None else kps.where(F.col("session_id") <= up_to)
    return k.withColumn("_last", F.max("session_id").over(Window.partitionBy("persona_id", "category", "name"))).where("session_id = _last").drop("_last")


def units(sessions: DataFrame, interval: int, boundaries: DataFrame | None = None) -> DataFrame:
    """persona_id, session_id, pos, unit, boundary: count-based windows of each persona's sessions.

    Every ``interval``-th session that is no noise closes a unit; sessions after the last boundary have a null unit. With
    ``boundaries`` (persona_id, session_id) units whose boundary isn't among them are dropped.
    """
    order = [F.col("original_index").asc_nulls_last(), "session_id"]
    w = Window.partitionBy("persona_id").orderBy(*order)
    s = sessions.withColumn("pos", F.row_number().over(w) - 1)
    s = s.withColumn("_c", F.sum((~F.col("is_noise")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("boundary", (F.col("_c") % interval == 0) & ~F.col("is_noise"))
    s = s.withColumn("unit", F.coalesce(F.sum(F.col("boundary").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = Window.partitionBy("persona_id", "unit")
    s = s.withColumn("unit", F.when(F.max(F.col("boundary").cast("int")).over(last) == 1, F.col("unit")))
    if boundaries is not None:
        close = s.where("boundary").join(boundaries.select("persona_id", "session_id").distinct(), ["persona_id", "session_id"], "left_semi").select("persona_id", "unit")
        s = s.join(close, ["persona_id", "unit"], "left_semi")
    return s.select("persona_id", "session_id", "pos", "unit", "boundary")


def packed(turns: DataFrame, limit: int) -> DataFrame:
    """session_id, pack, turns, chars: consecutive turns of a session packed greedily; a pack closes before it would pass the limit.

    The fold needs the order of one session's turns, so each session is one ordered array.
    """
    size = F.coalesce(F.length("content"), F.lit(0))
    g = turns.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", size.alias("n")))).alias("t"))
    start = F.struct(F.lit(0).alias("pack"), F.lit(0).alias("acc"), F.array().cast("array<struct<pack:int,n:int>>").alias("out"))

    def step(acc, x):
        full = (acc.acc > 0) & (acc.acc + x.n > limit)
        pack = acc.pack + full.cast("int")
        return F.struct(pack.alias("pack"), F.when(full, x.n).otherwise(acc.acc + x.n).alias("acc"), F.array_append(acc.out, F.struct(pack.alias("pack"), x.n.alias("n"))).alias("out"))

    p = g.select("session_id", F.explode(F.aggregate("t", start, step)["out"]).alias("x"))
    return p.groupBy("session_id", F.col("x.pack").alias("pack")).agg(F.count("*").alias("turns"), F.sum("x.n").alias("chars"))


def edges(nodes: DataFrame) -> DataFrame:
    """src, dst: what triggered what; repeated links once, self links dropped."""
    e = nodes.select(F.explode("triggered_by").alias("src"), F.col("event_id").alias("dst"))
    return e.where("src is not null and src <> dst").distinct()


def injected(originals: DataFrame, noise: DataFrame, key: str, order: str, spread: float = 0.2, seed: int = 42) -> DataFrame:
    """Noise rows placed among the originals of a key: row i goes to a place up to max(1, N * (i + 1) * spread), before what stands there.

    The place is drawn from a hash of key, row and seed, so that a rerun after a lost task places it alike.
    """
    w = Window.partitionBy(key).orderBy(order)
    o = originals.select(key, order).withColumn("place", F.row_number().over(w) - 1).withColumn("kind", F.lit(1)).withColumn("i", F.col("place"))
    n = noise.select(key, order).withColumn("i", F.row_number().over(w) - 1).join(o.groupBy(key).agg(F.count("*").alias("N")), key)
    top = F.greatest(F.lit(1), (F.least(F.col("N"), F.col("N") * (F.col("i") + 1) * spread)).cast("int"))
    n = n.withColumn("place", F.pmod(F.xxhash64(key, order, F.lit(seed)), top + 1).cast("int")).withColumn("kind", F.lit(0)).drop("N")
    both = o.unionByName(n)
    return both.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("place", "kind", "i")) - 1).select(key, order, (F.col("kind") == 0).alias("is_noise"), "position")


def drawn(*parts: Column | str) -> Column:
    """A number from 0 to 2^32 - 1 drawn from the parts: the first eight digits of an MD5, so that a rerun draws it again."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.conv(F.left(F.md5(F.concat_ws(":", *cols)), F.lit(8)), 16, 10).cast("long")


#: Tenths of the noise that go to places within the first 20, 40, 60, 80 and 100 per cent.
NOISE_WEIGHTS = (3, 3, 2, 1, 1)


def interleaved(originals: DataFrame, noise: DataFrame, key: str, order: str, seed: str) -> DataFrame:
    """key, order, is_noise, position: all noise rows placed among a key's originals, more of it early (``NOISE_WEIGHTS``).

    ``originals`` has ``at``, the running number from 0. A noise row draws a place up to its share's bound, before what stands there;
    the places are sorted, so that the noise rows keep their order. Keys without originals get none.
    """
    w = Window.partitionBy(key)
    sizes = originals.groupBy(key).agg(F.count("*").alias("_all"))
    n = noise.select(key, order).withColumn("i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_noise", F.count("*").over(w)).join(sizes, key)
    share, ends = F.lit(len(NOISE_WEIGHTS) - 1), F.lit(0)
    for k, weight in enumerate(NOISE_WEIGHTS[:-1]):
        ends = ends + F.floor(F.col("_noise") * weight / sum(NOISE_WEIGHTS))
        share = F.least(share, F.when(F.col("i") < ends, k).otherwise(len(NOISE_WEIGHTS) - 1))
    bound = F.greatest(F.lit(1), F.floor(F.col("_all") * (share + 1) / len(NOISE_WEIGHTS)))
    places = n.withColumn("place", drawn(F.col(key), F.col("i"), seed) % (bound + 1)).withColumn("r", F.row_number().over(w.orderBy("place", "i")) - 1).select(key, "place", F.col("r").alias("i"))
    placed = n.select(key, order, "i").join(places, [key, "i"]).withColumn("kind", F.lit(0))
    both = originals.select(key, order, F.col("at").alias("place"), F.col("at").alias("i"), F.lit(1).alias("kind")).unionByName(placed.select(key, order, F.col("place").cast("int").alias("place"), "i", "kind"))
    return both.withColumn("position", F.row_number().over(w.orderBy("place", "kind", "i")) - 1).select(key, order, (F.col("kind") == 0).alias("is_noise"), "position")


def merged_units(sessions: DataFrame, queries: DataFrame, interval: int) -> DataFrame:
    """unit, persona_id, eval_session_id, sessions, queries: units counted on over all personas, in their order.

    Every ``interval``-th clean session ends a unit, which takes all sessions since the last end; it counts only if queries belong
    to that session. Each persona's running numbers start from the counts before it, so no task sorts all sessions.
    """
    w = Window.partitionBy("persona_id")
    s = sessions.select("persona_id", "session_id", "original_index", "is_noise").distinct().withColumn("clean", (~F.col("is_noise")).cast("int"))
    base = s.groupBy("persona_id").agg(F.sum("clean").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("persona_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a persona
    run = F.sum("clean").over(w.orderBy(F.col("original_index").asc_nulls_last(), "session_id", "is_noise").rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("run", run).join(base, "persona_id").withColumn("c", F.col("base") + F.col("run"))
    s = s.withColumn("block", F.floor((F.col("c") - F.col("clean")) / interval)).withColumn("ends", (F.col("clean") == 1) & (F.col("c") % interval == 0))
    u = s.groupBy("block").agg(F.count("*").alias("sessions"), F.max(F.when(F.col("ends"), F.col("session_id"))).alias("eval_session_id"), F.max(F.when(F.col("ends"), F.col("persona_id"))).alias("persona_id"))
    asked = queries.groupBy(F.col("session_id").alias("eval_session_id")).agg(F.countDistinct("query_id").alias("queries"))
    u = u.where("eval_session_id is not null").join(asked, "eval_session_id")
    return u.withColumn("unit", F.row_number().over(Window.orderBy("block")) - 1).select("unit", "persona_id", "eval_session_id", "sessions", "queries")  # one row a unit


def traps_inserted(originals: DataFrame, traps: DataFrame, key: str) -> DataFrame:
    """key, event_id, event_date, is_trap, position: traps at drawn places, each with a drawn date between a key's first and last original.

    ``originals``: key, event_id, event_date (yyyy-MM-dd). Places are drawn independently among the gaps of the originals; traps in one
    gap keep the order of their ids. Keys without originals get no traps.
    """
    w = Window.partitionBy(key)
    o = originals.withColumn("place", (F.row_number().over(w.orderBy("event_date", "event_id")) - 1).cast("long")).withColumn("kind", F.lit(1))
    phase = originals.groupBy(key).agg(F.to_date(F.min("event_date")).alias("a"), F.to_date(F.max("event_date")).alias("b"), F.count("*").alias("_all"))
    t = traps.join(phase, key).select(
        key, "event_id", F.date_add("a", (drawn(F.col("event_id"), "date") % (F.date_diff("b", "a") + 1)).cast("int")).cast("string").alias("event_date"), (drawn(F.col("event_id"), "place") % (F.col("_all") + 1)).alias("place"), F.lit(0).alias("kind")
    )
    both = o.select(key, "event_id", "event_date", "place", "kind").unionByName(t)
    return both.select(key, "event_id", "event_date", (F.col("kind") == 0).alias("is_trap"), (F.row_number().over(w.orderBy("place", "kind", "event_id")) - 1).alias("position"))
