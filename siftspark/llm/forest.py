"""Spanning forests and connected components by rounds of minimum-edge contraction (Boruvka's scheme).

In each round every component picks its least edge to another one; the picks, which form no cycle but pairs that chose
the same edge, are part of the forest. Components are then merged along them by pointer doubling, edges are renamed,
and those inside a component drop out. The number of components with edges at least halves each round. All state lives
in tables of the shared folder; only a row count per round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.runtime import stage


def _picks(edges: DataFrame) -> DataFrame:
    """(node, other, a, b): each node's least edge by (weight, lesser end, greater end, original ends)."""
    both = edges.select(F.col("x").alias("node"), F.col("y").alias("other"), "w", "a", "b").unionByName(
        edges.select(F.col("y").alias("node"), F.col("x").alias("other"), "w", "a", "b")
    )
    least = F.min(F.struct("w", F.least("node", "other").alias("lo"), F.greatest("node", "other").alias("hi"), "a", "b", "other"))
    return both.groupBy("node").agg(least.alias("e")).select("node", "e.other", "e.a", "e.b")


def _flatten(parents: DataFrame) -> DataFrame:
    """Pointer doubling until each node points at its root, which points at itself."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        doubled = stage(parents.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), "parents")
        parents = doubled.select("node", "parent")
        if not doubled.where("moved").limit(1).count():
            return parents


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forest, roots) of undirected edges (a, b, w).

    forest: (a, b), one row per edge of a minimum spanning forest by (w, a, b). roots: (node, root) for every node with
    an edge, the root being the least node of its component. Loops, repeated and reversed edges and nulls are allowed
    and change nothing; no edges give two empty tables.
    """
    clean = (
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
        .groupBy("a", "b")
        .agg(F.min("w").alias("w"))
    )
    live = stage(clean.select("a", "b", "w", F.col("a").alias("x"), F.col("b").alias("y")), "edges")
    names = live.select(F.col("a").alias("node")).union(live.select("b")).distinct().select("node", F.col("node").alias("root"))
    forest = live.select("a", "b").limit(0)
    while live.limit(1).count():
        picks = stage(_picks(live), "picks")
        forest = forest.union(picks.select("a", "b").distinct())
        back = picks.select(F.col("node").alias("other"), F.col("other").alias("back"))
        parents = picks.join(back, "other").select(
            "node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("other")), F.col("node")).otherwise(F.col("other")).alias("parent")
        )
        flat = _flatten(stage(parents, "parents"))
        names = stage(
            names.join(flat.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("parent", "root").alias("root")), "names"
        )
        fx, fy = flat.select(F.col("node").alias("x"), F.col("parent").alias("nx")), flat.select(F.col("node").alias("y"), F.col("parent").alias("ny"))
        renamed = (
            live.join(fx, "x").join(fy, "y").where(F.col("nx") != F.col("ny"))
            .groupBy(F.least("nx", "ny").alias("x"), F.greatest("nx", "ny").alias("y"))
            .agg(F.min(F.struct("w", "a", "b")).alias("e"))
            .select("e.a", "e.b", "e.w", "x", "y")
        )
        live = stage(renamed, "edges")
    least = names.groupBy("root").agg(F.min("node").alias("least"))
    return stage(forest, "forest"), names.join(least, "root").select("node", F.col("least").alias("root"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of links (a, b), the root being the least node of the component."""
    return spanning_forest(links.select("a", "b", F.lit(0).alias("w")))[1]
