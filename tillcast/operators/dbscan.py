"""DBSCAN on a graph of cells: exact neighbourhoods without all pairs of a crowded spot.

Points share a cell of side eps / sqrt(d), so all points of a cell are within eps of each
other. A cell is known by the box around its points, and its box's distance to a point or
to another box has a least and a greatest value: a cell that lies wholly within eps counts
as a whole, one wholly beyond it not at all, and only one that the bounds leave undecided
is opened into cells of half the side, whose boxes are asked again. A box of one point (or
of equal ones) is always decided. Which boxes to ask at all is found by a join on grid
cells of side eps in the first ``grid_dims`` coordinates.

A cell of min_samples points or more is crowded: all its points are core and of one
component. Cells are linked where some of their points are within eps of each other, which
the same halving finds. The other points are few to a cell and are paired one by one.

Clusters: core points (>= min_samples neighbours, self included) linked by core-core
edges form components, found until nothing moves (``components``, logarithmic
rounds). Border points join the smallest adjacent core label; the rest are noise (-1).
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.operators.components import connected_components
from tillcast.session import written

DEEPEST = 30  # halvings after which an undecided cell's points are looked at one by one


def eps_neighbours(df: DataFrame, key: str, feats: list[str], eps: float, grid_dims: int = 3) -> DataFrame:
    """(a, b, dist) for all pairs within eps, self pairs included, by a join on adjacent grid cells."""
    g = min(grid_dims, len(feats))
    cells = [F.floor(F.col(c) / F.lit(eps)).cast("long") for c in feats[:g]]
    pts = df.select(F.col(key).alias("_id"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(feats)],
                    *[c.alias(f"_g{i}") for i, c in enumerate(cells)])
    offsets = F.array(*[F.array(*[F.lit(o) for o in off]) for off in itertools.product((-1, 0, 1), repeat=g)])
    probe = pts.select("*", F.explode(offsets).alias("_off")).select(
        F.col("_id").alias("a"), *[F.col(f"_x{i}").alias(f"a{i}") for i in range(len(feats))],
        *[(F.col(f"_g{i}") + F.col("_off")[i]).alias(f"_g{i}") for i in range(g)])
    right = pts.select(F.col("_id").alias("b"), *[F.col(f"_x{i}").alias(f"b{i}") for i in range(len(feats))],
                       *[F.col(f"_g{i}") for i in range(g)])
    j = probe.join(right, [f"_g{i}" for i in range(g)])
    d2 = sum(((F.col(f"a{i}") - F.col(f"b{i}")) * (F.col(f"a{i}") - F.col(f"b{i}")) for i in range(len(feats))),
             F.lit(0.0))
    return j.select("a", "b", F.sqrt(d2).alias("dist")).where(F.col("dist") <= eps)


def _cell(side: float, level: int) -> Column:
    return F.transform("x", lambda v: F.floor(v / F.lit(side / 2 ** level)).cast("long"))


def _boxes(points: DataFrame, cell: Column, d: int, by: list[str] = ()) -> DataFrame:
    return points.withColumn("cell", cell).groupBy(*by, "cell").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.min(F.col("x")[j]) for j in range(d)]).alias("lo"),
        F.array(*[F.max(F.col("x")[j]) for j in range(d)]).alias("hi"))


def _norm(terms: list[Column]) -> Column:
    return F.sqrt(sum((t * t for t in terms), F.lit(0.0)))


def _bounds(d: int, a: tuple[str, str], b: tuple[str, str]) -> tuple[Column, Column]:
    """Least and greatest distance between boxes given by the names of their corners."""
    (alo, ahi), (blo, bhi) = ((F.col(x), F.col(y)) for x, y in (a, b))
    gap = [F.greatest(blo[j] - ahi[j], alo[j] - bhi[j], F.lit(0.0)) for j in range(d)]
    reach = [F.greatest(F.abs(bhi[j] - alo[j]), F.abs(ahi[j] - blo[j])) for j in range(d)]
    return _norm(gap), _norm(reach)


def _around(boxes: DataFrame, eps: float, g: int) -> DataFrame:
    """boxes with column ``grid``: every grid cell in which a point within eps of the box can lie (its side is eps at most)."""
    offsets = F.array(*[F.array(*[F.lit(o).cast("long") for o in off]) for off in itertools.product((-1, 0, 1, 2), repeat=g)])
    at = F.array(*[F.floor(F.col("lo")[j] / F.lit(eps)).cast("long") for j in range(g)])
    return boxes.withColumn("_at", at).withColumn("_off", F.explode(offsets)).withColumn(
        "grid", F.zip_with("_at", "_off", lambda p, q: p + q)).drop("_at", "_off")


def _grid(eps: float, g: int) -> Column:
    return F.array(*[F.floor(F.col("x")[j] / F.lit(eps)).cast("long") for j in range(g)])


def _points(df: DataFrame, key: str, feats: list[str]) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.array(*[F.col(c).cast("double") for c in feats]).alias("x"))


def near_cells(queries: DataFrame, points: DataFrame, d: int, eps: float, side: float, grid_dims: int = 3) -> DataFrame:
    """(a, root, n): how many points of the cell ``root`` are within eps of query a, cells without any left out.

    ``queries`` and ``points`` are (id, x); a root may give several rows to a query.
    """
    g = min(grid_dims, d)
    base = points.withColumn("root", _cell(side, 0))
    boxes = _around(_boxes(base, F.col("root"), d).withColumnRenamed("cell", "root"), eps, g)
    asked = queries.select(F.col("id").alias("a"), F.col("x").alias("q"), _grid(eps, g).alias("grid")).join(boxes, "grid")
    found, level = [], 0
    while True:
        low, high = _bounds(d, ("q", "q"), ("lo", "hi"))
        asked = written(asked.withColumn("_low", low).where(F.col("_low") <= eps).withColumn("_in", high <= eps).drop("_low")
                        .select("a", "q", "root", *([] if not level else ["cell"]), "n", "_in"))
        found.append(asked.where("_in").select("a", "root", "n"))
        left = asked.where("not _in").select("a", "q", "root", F.col("cell" if level else "root").alias("parent"))
        if not left.limit(1).count():
            break
        level += 1
        wanted = left.select("root", "parent").distinct()
        inside = base.withColumn("parent", _cell(side, level - 1)).join(wanted, ["root", "parent"], "left_semi")
        if level > DEEPEST:
            one = left.join(inside.select("root", "parent", "x"), ["root", "parent"])
            far = _norm([F.col("q")[j] - F.col("x")[j] for j in range(d)])
            found.append(one.where(far <= eps).groupBy("a", "root").agg(F.count(F.lit(1)).alias("n")))
            break
        asked = left.join(_boxes(inside, _cell(side, level), d, ["root", "parent"]), ["root", "parent"])
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def linked_cells(crowded: DataFrame, d: int, eps: float, side: float, grid_dims: int = 3) -> DataFrame:
    """(a, b): pairs of crowded cells, by their heads, with points within eps of each other. ``crowded`` is (head, x)."""
    g = min(grid_dims, d)
    sides = _boxes(crowded, _cell(side, 0), d, ["head"])
    one = _around(sides, eps, g).select(F.col("head").alias("a"), F.col("cell").alias("ca"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), "grid")
    # the other cell's points lie in the grid cell of its least corner or the next
    offsets = F.array(*[F.array(*[F.lit(o).cast("long") for o in off]) for off in itertools.product((0, 1), repeat=g)])
    at = F.array(*[F.floor(F.col("lo")[j] / F.lit(eps)).cast("long") for j in range(g)])
    two = sides.withColumn("_at", at).withColumn("_off", F.explode(offsets)).select(
        F.col("head").alias("b"), F.col("cell").alias("cb"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"),
        F.zip_with("_at", "_off", lambda p, q: p + q).alias("grid"))
    asked = one.join(two, "grid").where("a < b").drop("grid").distinct()
    found, level = None, 0
    while True:
        low, high = _bounds(d, ("alo", "ahi"), ("blo", "bhi"))
        asked = written(asked.withColumn("_low", low).where(F.col("_low") <= eps).withColumn("_in", high <= eps).select("a", "b", "ca", "cb", "_in"))
        new = asked.where("_in").select("a", "b").distinct()
        found = new if found is None else found.unionByName(new)
        left = asked.where("not _in").join(new, ["a", "b"], "left_anti").select("a", "b", F.col("ca").alias("pa"), F.col("cb").alias("pb"))
        if not left.limit(1).count():
            return found
        level += 1
        needed = left.select(F.col("a").alias("head"), F.col("pa").alias("parent")).union(left.select("b", "pb")).distinct()
        inside = crowded.withColumn("parent", _cell(side, level - 1)).join(needed, ["head", "parent"], "left_semi")
        if level > DEEPEST:
            p, q = (inside.select(F.col("head").alias(h), F.col("parent").alias(f"p{h}"), F.col("x").alias(f"x{h}")) for h in "ab")
            far = _norm([F.col("xa")[j] - F.col("xb")[j] for j in range(d)])
            return found.unionByName(left.join(p, ["a", "pa"]).join(q, ["b", "pb"]).where(far <= eps).select("a", "b").distinct())
        boxes = _boxes(inside, _cell(side, level), d, ["head", "parent"])
        p, q = (boxes.select(F.col("head").alias(h), F.col("parent").alias(f"p{h}"), F.col("cell").alias(f"c{h}"), F.col("lo").alias(f"{h}lo"),
                             F.col("hi").alias(f"{h}hi")) for h in "ab")
        asked = left.join(p, ["a", "pa"]).join(q, ["b", "pb"])


def _side(eps: float, d: int) -> float:
    return eps / math.sqrt(d) * (1 - 1e-9)


def core_points(df: DataFrame, key: str, feats: list[str], eps: float, min_samples: int) -> DataFrame:
    """(key, n_neighbours, is_core): points within eps, self included; whole cells are counted where bounds decide them."""
    pts = written(_points(df, key, feats))
    cnt = near_cells(pts, pts, len(feats), eps, _side(eps, len(feats))).groupBy("a").agg(F.sum("n").alias("n_neighbours"))
    return df.select(key).join(cnt.withColumnRenamed("a", key), key, "left").select(
        key, F.coalesce("n_neighbours", F.lit(0)).alias("n_neighbours"),
        (F.coalesce("n_neighbours", F.lit(0)) >= min_samples).alias("is_core"))


def dbscan(df: DataFrame, key: str, feats: list[str], eps: float, min_samples: int) -> DataFrame:
    """(key, cluster): cluster ids 0.. in order of their smallest member, noise -1."""
    from pyspark.sql import Window

    d = len(feats)
    side = _side(eps, d)
    pts = _points(df, key, feats).withColumn("root", _cell(side, 0))
    full = pts.groupBy("root").agg(F.count(F.lit(1)).alias("_c"), F.min("id").alias("head")).where(F.col("_c") >= min_samples).drop("_c")
    pts = written(pts.join(full, "root", "left"))
    full = written(full)
    crowd, rest = pts.where("head is not null").select("id", "x", "head"), pts.where("head is null").select("id", "x")
    nb = written(eps_neighbours(rest.select("id", *[F.col("x")[j].alias(f"x{j}") for j in range(d)]), "id", [f"x{j}" for j in range(d)], eps))
    beside = written(near_cells(rest, crowd.select("id", "x"), d, eps, side).groupBy("a", "root").agg(F.sum("n").alias("n"))
                     .join(full, "root").select("a", F.col("head").alias("b"), "n"))
    cnt = nb.groupBy("a").agg(F.count(F.lit(1)).alias("n")).unionByName(beside.select("a", "n")).groupBy("a").agg(F.sum("n").alias("n"))
    some = written(cnt.where(F.col("n") >= min_samples).select(F.col("a").alias("id")))
    core = some.unionByName(crowd.select("id"))
    edges = (nb.join(some.withColumnRenamed("id", "a"), "a", "left_semi")
             .join(some.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b"))
    edges = edges.unionByName(beside.join(some.withColumnRenamed("id", "a"), "a", "left_semi").select("a", "b"))
    edges = edges.unionByName(linked_cells(crowd.select("head", "x"), d, eps, side))
    edges = edges.unionByName(crowd.select(F.col("id").alias("a"), F.col("head").alias("b")))
    edges = edges.unionByName(core.select(F.col("id").alias("a"), F.col("id").alias("b")))
    labels = written(connected_components(edges).withColumnRenamed("component", "label"))
    border = (nb.select("a", "b").unionByName(beside.select("a", "b")).join(labels.withColumnRenamed("id", "b"), "b")
              .join(core.withColumnRenamed("id", "a"), "a", "left_anti")
              .groupBy("a").agg(F.min("label").alias("label")).withColumnRenamed("a", "id"))
    all_labels = labels.unionByName(border)
    rank = all_labels.select("label").distinct().select(
        "label", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("int").alias("cluster"))
    out = df.select(key).join(all_labels.join(rank, "label").select(F.col("id").alias(key), "cluster"), key, "left")
    return out.select(key, F.coalesce("cluster", F.lit(-1)).alias("cluster"))
