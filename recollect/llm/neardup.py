"""Problem 1: records that say nearly the same, by one-permutation hashing with optimal densification.

A text is the multiset of its words (``words.py``), held as a set of (word, occurrence) hashes. Two texts are
near-duplicates if they share at least ``threshold`` of the longer one's words.

1. Texts with the same multiset collapse into one class; everything below works on classes.
2. A count sketch of fixed size (2^16 cells, gathered on the driver whatever the input) tells how common words are.
3. One permutation throws the words of a class into ``BINS`` bins; a bin keeps its rarest word (ties by the permutation),
   where plain one-permutation hashing keeps the least: templates that thousands of texts share would fill the bands
   otherwise. Empty bins borrow from a bin chosen by a hash of bin and attempt alone, so two texts borrow alike (optimal
   densification). The sketch is that of the table at hand, so bands of one run aren't compared with those of another.
4. Bands are groups of four bins that pairwise share at most one bin. Classes with an equal band share a bucket.
5. A bucket of m classes gives m-1 candidate edges: a star around its least class, found by a map-side combined
   aggregation; the join with its centre is left to AQE, which splits a hot bucket, so none is gathered in a task.
6. Edges are deduplicated and checked word by word, on 32-bit hashes (a pair's count is off by one with a chance of less
   than one in a million). Within the search a class is a 64-bit hash of its words.
7. Classes that turn out to be no near-duplicate of their centre: up to ``FAILING`` of them in a bucket are compared with the
   whole bucket, lengths first. A bucket with more is split by one more bin, in every way, and its parts are starred in turn,
   until few fail or no bin is left. So boilerplate that fills a band costs a multiple of its rows, not their square, and
   a pair is lost only if it shares nothing but the band.
8. For pairs, classes with a common neighbour are checked against each other until no new link turns up, which returns the
   pairs inside a group that the stars skip. Two classes with the same neighbours need no such look, so a group of k that
   all resemble each other costs about its k * k pairs. For groups, the stars are enough.

Null, blank and wordless texts are no case. Rows that repeat a key count once; a key with several texts takes part with
each. Ties, extra columns and empty tables need no special treatment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.words import U, Vocabulary, hashed, list_array, mix, offsets, slices
from recollect.runtime import discard, materialize

CELLS = 1 << 16
BINS = 21
#: Offsets whose differences modulo BINS are all distinct, so two bands share at most one bin.
BAND = (0, 1, 4, 14)
#: Most members of a bucket beside its centre's near-duplicates that are compared with the whole bucket.
FAILING = 64


def bags(batches):
    """(id, b1, b2, n, tokens) of each text with at least one word; tokens are 32 bits of the sorted hashes; b1 and b2 hash all of them."""
    vocabulary = Vocabulary()
    for batch in batches:
        for part, texts in slices(batch, "text"):
            flat, counts = hashed(texts, vocabulary)
            doc = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((flat, doc))
            flat, doc = flat[order], doc[order]
            new = np.ones(len(flat), bool)
            new[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
            at = np.arange(len(flat))
            occurrence = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(U)
            tokens = mix(flat + occurrence * U(0x9E3779B97F4A7C15))
            order = np.lexsort((tokens, doc))
            tokens = tokens[order]
            has = counts > 0
            starts = offsets(counts)[:-1][has]
            if not has.any():
                continue
            b1 = mix(np.add.reduceat(mix(tokens + U(1)), starts))
            b2 = mix(np.add.reduceat(mix(tokens ^ U(0x5851F42D4C957F2D)), starts))
            keep = pa.array(has)
            short = (tokens >> U(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).filter(keep), part.column(1).filter(keep), pa.array(b1.view(np.int64)), pa.array(b2.view(np.int64)), pa.array(counts[has].astype(np.int32)), list_array(short, counts[has])],
                names=["tbl", "id", "b1", "b2", "n", "tokens"],
            )


def sketch(tokens: np.ndarray, counts: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The bins (columns) of each text (rows; each has a word). ``common``: log2 of a word's count, by cell."""
    n = len(counts)
    cells, tokens = tokens.astype(np.int64) % CELLS, mix(tokens.astype(U))
    doc = np.repeat(np.arange(n), counts)
    slot = (mix(tokens ^ U(0xA24BAED4963EE407)) % U(BINS)).astype(np.int64)
    rank = (common[cells].astype(np.int64) << 56) | (mix(tokens) >> U(8)).astype(np.int64)
    at = doc * BINS + slot
    order = np.lexsort((rank, at))
    cell = at[order]
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    value = np.zeros(n * BINS, U)
    full = np.zeros(n * BINS, bool)
    value[cell[first]], full[cell[first]] = tokens[order][first], True
    value, full = value.reshape(n, BINS), full.reshape(n, BINS)
    out = value.copy()
    rows, bins = np.nonzero(~full)
    attempt = 0
    while len(rows):
        attempt += 1
        source = (mix(bins.astype(U) * U(0x100000001B3) + U(attempt)) % U(BINS)).astype(np.int64)
        hit = full[rows, source]
        out[rows[hit], bins[hit]] = value[rows[hit], source[hit]] + U(attempt)
        rows, bins = rows[~hit], bins[~hit]
    return out


def band_keys(tokens: np.ndarray, counts: np.ndarray, common: np.ndarray) -> np.ndarray:
    """One hash per band (columns) and text (rows)."""
    bins = sketch(tokens, counts, common)
    keys = []
    for i in range(BINS):
        key = np.full(len(bins), U(i + 1))
        for a in BAND:
            key = mix(key + bins[:, (i + a) % BINS])
        keys.append(key)
    return np.stack(keys, axis=1)


def checked(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of ``classes`` (c, n, tokens) that share enough words."""
    side = lambda x: classes.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
    most = F.greatest("na", "nb")
    enough = F.size(F.array_intersect("ta", "tb")) >= threshold * most
    return pairs.join(side("a"), "a").join(side("b"), "b").where((F.least("na", "nb") >= threshold * most) & enough).select("a", "b")


def alike(x: str, y: str, threshold: float) -> Column:
    """Whether two numbers of words allow a near-duplicate."""
    return F.least(x, y) >= threshold * F.greatest(x, y)


def star(bucket: DataFrame, name: str) -> DataFrame:
    """band, hub, nh, c, n: the members of each bucket (band, c, n) of two or more beside its least class, the hub."""
    hubs = bucket.groupBy("band").agg(F.min("c").alias("hub"), F.min_by("n", "c").alias("nh"), F.max("c").alias("top")).where("hub <> top").select("band", "hub", "nh")
    return materialize(bucket.join(hubs, "band").where("c <> hub"), name)


def two_way(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def near_duplicates(records: DataFrame, threshold: float = 0.8, closed: bool = True) -> tuple[DataFrame, DataFrame]:
    """``records`` (tbl, id, text; ids are strings) -> (members, links).

    members: tbl, id, cls: one row per record and class. links: tbl, a, b: near-duplicate classes, a < b; all of them if
    ``closed``, else those that the stars check, which connect the same groups. Classes are named after their least id.
    Copies within a class are near-duplicates of each other without a link.
    """
    spark = records.sparkSession
    rows = materialize(records.select("tbl", "id", "text").mapInArrow(bags, "tbl string, id string, b1 long, b2 long, n int, tokens array<int>"), "bags")
    named = rows.groupBy("tbl", "b1", "b2").agg(F.min("id").alias("cls"))
    members = materialize(rows.select("tbl", "id", "b1", "b2").distinct().join(named, ["tbl", "b1", "b2"]).select("tbl", "id", "cls"), "members")
    # within the search a class is a hash of its table and words: eight bytes, instead of names in every row
    classes = rows.join(named.withColumnRenamed("cls", "id"), ["tbl", "b1", "b2", "id"]).select(F.xxhash64("tbl", "b1", "b2").alias("c"), "tbl", F.col("id").alias("cls"), "n", "tokens").dropDuplicates(["c"])
    classes = materialize(classes, "classes")
    discard(rows)
    counts = classes.select(F.explode("tokens").alias("t")).groupBy(F.expr(f"t & {CELLS - 1}").alias("cell")).count().collect()  # at most CELLS rows
    common = np.zeros(CELLS, np.uint8)
    for cell, count in counts:
        common[cell] = min(63, int(count).bit_length())
    shared = spark.sparkContext.broadcast(common)

    def hashes(of):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    column = batch.column(3)
                    tokens = column.flatten().to_numpy().view(np.uint32)
                    n = np.diff(column.offsets.to_numpy()).astype(np.int64)
                    keys = of(tokens, n, shared.value)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], list_array(keys.reshape(-1).view(np.int64), np.full(len(n), keys.shape[1]))], names=["c", "tbl", "n", "keys"])

        return run

    keyed = lambda of, df: df.select("c", "tbl", "n", "tokens").mapInArrow(hashes(of), "c long, tbl string, n int, keys array<long>")
    # a bucket's key ends in five bits for the band's number and five for the last bin that it was split by, from 1
    key = lambda h, of, last: h.bitwiseAND(F.lit(-1024)).bitwiseOR((of * 32 + last).cast("long"))
    banded = keyed(band_keys, classes).select("c", "n", F.xxhash64("tbl").alias("of_tbl"), F.posexplode("keys").alias("pos", "h"))
    bucket = materialize(banded.select(key(F.col("h").bitwiseXOR(F.col("of_tbl")), F.col("pos"), F.lit(0)).alias("band"), "c", "n"), "bands")
    links, tested, left = None, None, [classes]
    while True:
        rays = star(bucket, "rays")
        discard(bucket)
        edges = rays.where(alike("n", "nh", threshold)).select(F.col("hub").alias("a"), F.col("c").alias("b")).distinct()
        edges = materialize(edges.join(tested, ["a", "b"], "left_anti") if tested is not None else edges, "edges")
        if tested is None:
            ends = rays.select("c").union(rays.select(F.col("hub").alias("c"))).distinct()
            classes = materialize(classes.join(ends, "c", "left_semi"), "classes")
            discard(left.pop())
            left.append(classes)
        good = materialize(checked(edges, classes, threshold), "links")
        tested, links = (edges, good) if tested is None else (tested.union(edges), links.union(good))
        failed = rays.join(links.withColumnsRenamed({"a": "hub", "b": "c"}), ["hub", "c"], "left_anti").select("band", F.col("c").alias("x"), F.col("n").alias("nx"))
        failed = materialize(failed, "failed")
        last = F.col("band").bitwiseAND(F.lit(31))
        many = materialize(failed.where(last < BINS).groupBy("band").agg(F.count("*").alias("m")).where(F.col("m") > FAILING).select("band"), "many")  # buckets to be split
        more = None if many.isEmpty() else many
        few = failed if more is None else failed.join(more, "band", "left_anti")
        rest = few.join(rays.select("band", F.col("c").alias("y"), F.col("n").alias("ny")), "band").where((F.col("x") != F.col("y")) & alike("nx", "ny", threshold))
        rest = materialize(rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"), "edges")
        links, tested = links.union(materialize(checked(rest, classes, threshold), "links")), tested.union(rest)
        left += [edges, rest]
        if more is None:
            discard(rays)
            break
        split = rays.join(more, "band", "left_semi").select("band", "c", "n")
        bins = keyed(sketch, classes.join(split.select("c").distinct(), "c", "left_semi")).select("c", F.posexplode("keys").alias("pos", "value"))
        of = F.shiftright("band", 5).bitwiseAND(F.lit(31))
        inside = F.pmod(F.col("pos") - of, F.lit(BINS)).isin(*BAND)
        bucket = split.join(bins, "c").where(~inside & (F.col("pos") >= last)).select(key(F.xxhash64("band", "pos", "value"), of, F.col("pos") + 1).alias("band"), "c", "n")
        bucket = materialize(bucket, "bands")
        discard(rays)
        discard(failed)
    fresh = links
    while closed:
        both = two_way(links)
        # a class's neighbours and itself as one number; of two linked classes with the same, neither has a neighbour to show the other
        sign = both.groupBy("a").agg(F.sum(F.pmod(F.xxhash64("b"), F.lit(1 << 40))).alias("s")).select("a", (F.col("s") + F.pmod(F.xxhash64("a"), F.lit(1 << 40))).alias("s"))
        news = two_way(fresh).join(sign.withColumnRenamed("s", "sa"), "a").join(sign.select(F.col("a").alias("b"), F.col("s").alias("sb")), "b").where("sa <> sb")
        two = news.select(F.col("a").alias("mid"), F.col("b").alias("x")).join(both.select(F.col("a").alias("mid"), F.col("b").alias("y")), "mid").where("x <> y")
        two = materialize(two.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"), "edges")
        left.append(two)
        fresh = materialize(checked(two, classes, threshold), "links")
        if fresh.isEmpty():
            break
        links, tested = links.union(fresh), tested.union(two)
    name = lambda x: classes.select(F.col("c").alias(x), "tbl", F.col("cls").alias(f"_{x}")) if x == "a" else classes.select(F.col("c").alias(x), F.col("cls").alias(f"_{x}"))
    named = links.join(name("a"), "a").join(name("b"), "b").select("tbl", F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    named = materialize(named, "links")
    for done in left:
        discard(done)
    return members, named


def pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of different keys, id_a < id_b: those of linked classes and those within a class."""
    one = members.select("tbl", F.col("cls").alias("a"), F.col("id").alias("x"))
    two = members.select("tbl", F.col("cls").alias("b"), F.col("id").alias("y"))
    across = links.join(one, ["tbl", "a"]).join(two, ["tbl", "b"])
    within = one.join(two, (one.tbl == two.tbl) & (one.a == two.b) & (one.x < two.y)).select(one.tbl, "x", "y")
    return across.where("x <> y").select("tbl", "x", "y").union(within).select("tbl", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def groups(members: DataFrame, links: DataFrame, counted: bool = True) -> DataFrame:
    """tbl, id, class_id, group_id, copies (and, if ``counted``, n_links): one row per record. group_id is the least class reachable over links.

    Least-label propagation with pointer jumping; each round is written to the shared folder, and the rounds grow with
    the logarithm of a group's diameter. Nothing is gathered on the driver. ``n_links`` is a record's number of
    near-duplicates and wants links that are closed; group and class need only those of the stars.
    """
    both = materialize(links.union(links.select("tbl", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = materialize(both.groupBy("tbl", F.col("a").alias("cls")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(label, [both.tbl == label.tbl, both.b == label.cls]).groupBy(both.tbl, both.a).agg(F.min("label").alias("near"))
        best = label.join(near.select("tbl", F.col("a").alias("cls"), "near"), ["tbl", "cls"]).select("tbl", "cls", "label", F.least("label", "near").alias("new"))
        jump = label.select("tbl", F.col("cls").alias("new"), F.col("label").alias("far"))
        step = materialize(best.join(jump, ["tbl", "new"], "left").select("tbl", "cls", F.col("label").alias("old"), F.least("new", F.coalesce("far", "new")).alias("label")), "labels")
        discard(label)
        label = step.select("tbl", "cls", "label")
        if step.where("old <> label").isEmpty():
            break
    sizes = members.groupBy("tbl", "cls").agg(F.count("*").alias("copies"))
    out = members.join(sizes, ["tbl", "cls"]).join(label, ["tbl", "cls"], "left")
    columns = ["tbl", "id", F.col("cls").alias("class_id"), F.coalesce("label", "cls").alias("group_id"), "copies"]
    if counted:
        linked = both.join(sizes.select("tbl", F.col("cls").alias("b"), F.col("copies").alias("m")), ["tbl", "b"]).groupBy("tbl", F.col("a").alias("cls")).agg(F.sum("m").alias("m"))
        out = out.join(linked, ["tbl", "cls"], "left")
        columns.append((F.col("copies") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))
    return out.select(*columns)
