"""Graphs as two tables, nodes and edges (src, dst): neighbourhoods, paths, components, ranks and measures.

Iterations write each round to the shared folder, so that lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.runtime import discard, materialize


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, once."""
    e = edges.select("src", "dst")
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def neighbours(edges: DataFrame, nodes: DataFrame, direction: str = "both") -> DataFrame:
    """node, neighbour of the given nodes along out, in or both directions."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"))
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"))
    e = out if direction == "out" else back if direction == "in" else out.union(back)
    return e.join(nodes.select("node").distinct(), "node", "left_semi").distinct()


def k_hop(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """start, node, hop: nodes within ``hops`` steps along the edges, with the least number of steps; the start has 0."""
    e = materialize(edges.select("src", "dst").distinct(), "edges")
    seen = materialize(starts.select(F.col("node").alias("start"), "node").distinct().withColumn("hop", F.lit(0)), "hops")
    front = seen
    for hop in range(1, hops + 1):
        new = front.join(e, front.node == e.src).select("start", F.col("dst").alias("node")).distinct()
        front = materialize(new.join(seen, ["start", "node"], "left_anti").withColumn("hop", F.lit(hop)), "hops")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def paths(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, node, path (array): simple paths of one to ``depth`` edges; a node comes up once in a path."""
    e = materialize(edges.select("src", "dst").distinct(), "edges")
    front = starts.select(F.col("node").alias("start"), "node", F.array("node").alias("path")).distinct()
    out = None
    for _ in range(depth):
        front = front.join(e, front.node == e.src).where(~F.array_contains("path", F.col("dst"))).select("start", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        front = materialize(front, "paths")
        out = front if out is None else out.union(front)
    return out


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component: the least node that can be reached, by least labels with pointer jumping.

    The edges are put in both directions once; a round joins the labels with them once, and the labels of the round before are deleted.
    """
    both = materialize(undirected(edges), "edges")
    label = materialize(nodes.select("node").distinct().withColumn("component", F.col("node")), "components")
    while True:
        # a node's own label and those of its neighbours are one union, so one aggregation finds the least
        near = both.join(label.select(F.col("node").alias("src"), "component"), "src").select(F.col("dst").alias("node"), F.lit(None).cast(label.schema["component"].dataType).alias("old"), "component")
        best = near.union(label.select("node", "component", "component")).groupBy("node").agg(F.max("old").alias("old"), F.min("component").alias("best")).where("old is not null")
        jump = label.select(F.col("node").alias("best"), F.col("component").alias("far"))
        step = materialize(best.join(jump, "best", "left").select("node", "old", F.least("best", F.coalesce("far", "best")).alias("component")), "components")
        discard(label)
        label = step.select("node", "component")
        if step.where("old <> component").isEmpty():
            discard(both)
            return label


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20, personal: DataFrame | None = None) -> DataFrame:
    """node, rank by the power method; dangling mass returns to the start vector, which ``personal`` (node, weight) may give."""
    e = materialize(edges.select("src", "dst").distinct(), "edges")
    n = nodes.select("node").distinct()
    if personal is None:
        start = n.withColumn("weight", F.lit(1.0))
    else:
        start = n.join(personal, "node", "left").select("node", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = start.agg(F.sum("weight")).first()[0] or 1.0
    degree = e.groupBy("src").agg(F.count("*").alias("degree"))
    base = materialize(start.join(degree, start.node == degree.src, "left").select("node", (F.col("weight") / total).alias("start"), F.coalesce("degree", F.lit(0)).alias("degree")), "rank")
    rank = base.select("node", "start", "degree", F.col("start").alias("rank"))
    for _ in range(rounds):
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("degree") == 0, F.col("rank"))), F.lit(0.0)).alias("lost"))  # one row
        sent = rank.join(e, rank.node == e.src).groupBy("dst").agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        rank = rank.join(sent, rank.node == sent.dst, "left").join(F.broadcast(lost)).select("node", "start", "degree", ((1 - damping) * F.col("start") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("start"))).alias("rank"))
        last, rank = base, materialize(rank, "rank")  # it is read three times in the next round
        discard(last)
        base = rank
    return rank.select("node", "rank")


def triangles(edges: DataFrame) -> DataFrame:
    """node, triangles. Edges point from the lower degree to the higher, which bounds the pairs a hub gives."""
    both = undirected(edges)
    degree = both.groupBy("src").agg(F.count("*").alias("d"))
    e = both.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("d2")), "dst")
    e = e.where((F.col("d") < F.col("d2")) | (F.col("d") == F.col("d2")) & (F.col("src") < F.col("dst"))).select("src", "dst")
    wedge = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(e.select(F.col("src").alias("a"), F.col("dst").alias("c")), "a")
    full = wedge.join(e.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"])
    return full.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))


def measures(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges, mean degree, density, self loops, components, largest component, mean clustering, in one row."""
    n = nodes.select("node").distinct()
    both = undirected(edges)
    comp = components(n, edges).groupBy("component").agg(F.count("*").alias("size")).agg(F.count("*").alias("components"), F.max("size").alias("largest"))
    deg = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"))
    clus = n.join(deg, "node", "left").join(triangles(edges), "node", "left")
    clus = clus.agg(F.avg(F.when(F.col("d") > 1, 2 * F.coalesce("triangles", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)).alias("clustering"))
    loops = edges.agg(F.count_if(F.col("src") == F.col("dst")).alias("self_loops"))
    size = n.agg(F.count("*").alias("nodes"))
    links = both.agg((F.count("*") / 2).cast("long").alias("edges"))
    one = size.join(links).join(loops).join(comp).join(clus)  # one row each
    density = F.coalesce(F.try_divide(2.0 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)), F.lit(0.0))
    return one.select("nodes", "edges", F.round(2.0 * F.col("edges") / F.col("nodes"), 6).alias("mean_degree"), F.round(density, 9).alias("density"), "self_loops", "components", "largest", F.round("clustering", 6).alias("clustering"))


def expanded(starts: DataFrame, edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """query_id, node, order: best-first expansion from each query's seeds; a node is expanded only if it brings new concepts.

    ``starts``: query_id, node, score; ``edges``: src, dst, weight; ``concepts``: node, concepts. Steps cost more than nothing,
    so nodes come up in the order of their least cost. A round expands, in every query at once, the first node after the last
    expanded one that brings a new concept; there are at most as many rounds as a query meets concepts, and one.
    """
    least = F.lit(1e-10)
    known_of = concepts.select("node", F.coalesce("concepts", F.array().cast(concepts.schema["concepts"].dataType)).alias("concepts"))
    none = F.array().cast(concepts.schema["concepts"].dataType)
    e = edges.select("src", "dst", (1 / F.greatest(F.col("weight"), least)).alias("step"))
    front = starts.where("score is not null").groupBy("query_id", "node").agg(F.min(1 / F.greatest(F.col("score"), least)).alias("cost"))
    reach = materialize(front, "reach")
    known = None
    while True:
        left = reach.join(known_of, "node", "left").withColumn("concepts", F.coalesce("concepts", none)).withColumn("at", F.struct("cost", "node"))
        if known is not None:
            left = left.join(known.select("query_id", F.col("at").alias("last"), "known"), "query_id").where((F.col("at") > F.col("last")) & (F.size(F.array_except("concepts", "known")) > 0))
            left = left.withColumn("known", F.array_union("known", "concepts"))
        else:
            left = left.withColumn("known", F.col("concepts"))
        known = materialize(left.groupBy("query_id").agg(F.min("at").alias("at"), F.min_by("known", "at").alias("known")), "known")
        if known.isEmpty():
            order = F.row_number().over(Window.partitionBy("query_id").orderBy("cost", "node"))
            return reach.select("query_id", "node", order.alias("order"))
        new = known.join(e, F.col("at.node") == e.src).select("query_id", F.col("dst").alias("node"), (F.col("at.cost") + F.col("step")).alias("cost"))
        reach = materialize(reach.unionByName(new).groupBy("query_id", "node").agg(F.min("cost").alias("cost")), "reach")


def recursive_clusters(vectors: DataFrame, most: int = 60, least: int = 10, branches: int = 4, seed: int = 42) -> DataFrame:
    """vec_id, cluster: k-means repeated within clusters of over ``most`` rows, all of a level in one pass.

    Each level seeds ``branches`` centres per large cluster by the order of a hash and takes three rounds of assignment and
    averaging as joins and aggregations, so the number of clusters doesn't matter to the plan. Clusters under ``least``
    keep together with what they came from. Levels go on until no cluster is over ``most``; a part with over 95 % of what it
    came from is cut by a hash of ids instead, so that every level makes headway. No group is gathered in a task.
    """


    from recollect.functions.vectors import dot

    state = materialize(vectors.select("vec_id", "v", F.lit("0").alias("cluster")), "clusters")
    for level in count():
        sizes = state.groupBy("cluster").agg(F.count("*").alias("size"))
        sized = state.join(sizes.where(F.col("size") > most), "cluster", "left")
        large = materialize(sized.where("size is not null"), "large")
        if large.isEmpty():
            break
        draw = F.xxhash64("vec_id", F.lit(seed + level))
        # each row stands for one of the branches, by its hash; the least hash of a branch gives its first centre
        first = large.groupBy("cluster", F.pmod(F.xxhash64("vec_id", F.lit(seed - 1 - level)), F.lit(branches)).cast("int").alias("c")).agg(F.min_by("v", F.struct(draw, "vec_id")).alias("centre"))
        near = None
        for turn in range(3):
            # at most ``branches`` centres of a cluster form one row, so that a vector finds its nearest without a shuffle of its own
            centres = materialize(first.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("c", "centre"))).alias("centres")), "centres")
            away = F.transform("centres", lambda s: F.struct((dot(s.centre, s.centre) - 2 * dot(F.col("v"), s.centre)).alias("d"), s.c.alias("c")))
            near = large.join(centres, "cluster").select("cluster", "size", "vec_id", "v", F.array_min(away).getField("c").alias("c"))
            if turn < 2:
                sums = near.select("cluster", "c", F.posexplode("v").alias("i", "x")).groupBy("cluster", "c", "i").agg(F.avg("x").alias("x"))
                first = sums.groupBy("cluster", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("centre"))  # one vector
        near = materialize(near, "near")
        parts = near.groupBy("cluster", "c").agg(F.count("*").alias("k"))
        split = near.join(parts, ["cluster", "c"])
        stuck = (F.col("k") > most) & (F.col("k") > 0.95 * F.col("size"))
        piece = F.when(stuck, F.pmod(draw, F.ceil(F.col("k") * 1.5 / most)).cast("string"))  # null is left out of the name
        split = split.select("vec_id", "v", F.concat_ws(".", "cluster", F.when(F.col("k") >= least, F.col("c").cast("string")).otherwise("r"), piece).alias("cluster"))
        state = materialize(sized.where("size is null").select("vec_id", "v", "cluster").unionByName(split), "clusters")
    return state.select("vec_id", "cluster")




class Graph:
    """Nodes (node) and edges (src, dst) with the changes of a graph store; each returns a new graph and is one plan."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes.select("node").distinct(), edges.select("src", "dst").distinct()

    def add_nodes(self, nodes: DataFrame) -> Graph:
        return Graph(self.nodes.union(nodes.select("node")), self.edges)

    def add_edges(self, edges: DataFrame) -> Graph:
        """Adds edges, once each, and the nodes that they need."""
        e = edges.select("src", "dst")
        return Graph(self.nodes.union(e.select("src")).union(e.select("dst")), self.edges.union(e))

    def delete_nodes(self, condition: Column) -> Graph:
        """Deletes nodes and the edges at them."""
        gone = self.nodes.where(condition)
        e = self.edges.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")
        return Graph(self.nodes.join(gone, "node", "left_anti"), e)

    def delete_edges(self, edges: DataFrame) -> Graph:
        return Graph(self.nodes, self.edges.join(edges.select("src", "dst"), ["src", "dst"], "left_anti"))

    def merge(self, into: Column) -> Graph:
        """Each node becomes the one that ``into`` (of column node) names, which inherits its edges; loops that arise are dropped."""
        m = self.nodes.select("node", into.alias("to"))
        e = self.edges.join(m.select(F.col("node").alias("src"), F.col("to").alias("a")), "src").join(m.select(F.col("node").alias("dst"), F.col("to").alias("b")), "dst")
        return Graph(m.select(F.col("to").alias("node")), e.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")))

    def degrees(self) -> DataFrame:
        """node, predecessors, successors; 0 for nodes without."""
        ends = self.edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(self.edges.select("dst", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
        return self.nodes.join(ends, "node", "left").select("node", F.coalesce("i", F.lit(0)).alias("predecessors"), F.coalesce("o", F.lit(0)).alias("successors"))

    def disconnected(self) -> DataFrame:
        return self.degrees().where("predecessors + successors = 0").select("node")
