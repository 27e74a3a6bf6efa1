"""Neighbours, density clusters and connected regions of points and grids, by cells and tiles of bounded size."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaseloom.operators.relational import dealt_join
from phaseloom.sources.readers import checkpointed

#: Points of a cell that are compared with each other in one task.
LEAF = 2_000


# --- connected components ---------------------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b): the smallest node that can be reached.

    Every round each node points to the smallest node beside it, pointers are followed twice as far as before, and the
    links are drawn between what their ends point to, until no link joins two different ones.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = checkpointed(both.filter("a <> b").distinct(), "links")
    roots = checkpointed(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    while not rest.isEmpty():
        to = checkpointed(rest.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), "to")
        while True:
            next_ = to.select(F.col("a").alias("to"), F.col("to").alias("further"))
            jumped = to.join(next_, "to").select("a", F.col("further").alias("new"), (F.col("further") != F.col("to")).alias("moved"))
            jumped = checkpointed(jumped, "jumped")
            to = jumped.select("a", F.col("new").alias("to"))
            if jumped.filter("moved").isEmpty():
                break
        root = to.select(F.col("a").alias("root"), F.col("to").alias("above"))
        roots = checkpointed(roots.join(root, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots")
        ends = rest.join(to, "a").select(F.col("to").alias("a"), "b").join(to.select(F.col("a").alias("b"), F.col("to").alias("other")), "b")
        rest = checkpointed(ends.select("a", F.col("other").alias("b")).filter("a <> b").distinct(), "links")
    return roots


# --- nearest neighbours -----------------------------------------------------------------------------------------------


def _cells(points: DataFrame, keys: list[str], leaf: int) -> tuple[DataFrame, DataFrame]:
    """points with cell, and the tree (keys, cell, parent): cells of over leaf points are cut at the median of their widest dimension.

    A cell is named by the cuts that lead to it. One whose points are all equal is not cut.
    """
    rows = checkpointed(points.withColumn("cell", F.lit("")), "cells")
    done, tree = None, rows.select(*keys, "cell", F.lit(None).cast("string").alias("parent")).distinct()
    while True:
        if rows.groupBy(*keys, "cell").agg(F.count("*").alias("n")).filter(F.col("n") > leaf).isEmpty():
            return (rows if done is None else done.unionByName(rows)), checkpointed(tree, "tree")
        dims = rows.select(*keys, "cell", F.posexplode("v").alias("i", "x"))
        spread = dims.groupBy(*keys, "cell", "i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.percentile_approx("x", 0.5, 1_000).alias("mid"), F.count("*").alias("n"))
        cut = spread.groupBy(*keys, "cell").agg(F.max_by(F.struct("i", "lo", "mid"), F.col("hi") - F.col("lo")).alias("at"), F.max(F.col("hi") - F.col("lo")).alias("width"), F.max("n").alias("n"))
        cut = cut.filter((F.col("n") > leaf) & (F.col("width") > 0)).select(*keys, "cell", "at")
        if cut.isEmpty():
            return (rows if done is None else done.unionByName(rows)), checkpointed(tree, "tree")
        marked = rows.join(F.broadcast(cut) if cut.count() <= 10_000 else cut, [*keys, "cell"], "left")
        x = F.get("v", F.col("at.i"))
        low = F.when(F.col("at.mid") > F.col("at.lo"), x < F.col("at.mid")).otherwise(x <= F.col("at.lo"))
        marked = checkpointed(marked.withColumn("below", low), "cells")
        ready = marked.filter("at is null").drop("at", "below")
        done = ready if done is None else done.unionByName(ready)
        rows = checkpointed(marked.filter("at is not null").withColumn("cell", F.concat("cell", F.when(F.col("below"), "0").otherwise("1"))).drop("at", "below"), "cells")
        tree = tree.unionByName(rows.select(*keys, "cell", F.expr("left(cell, length(cell) - 1)").alias("parent")).distinct())


def _gap(a_lo: str, a_hi: str, b_lo: str, b_hi: str) -> Column:
    """Squared distance between two boxes."""
    apart = F.zip_with(F.zip_with(F.col(b_lo), F.col(a_hi), lambda x, y: x - y), F.zip_with(F.col(a_lo), F.col(b_hi), lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(apart, F.lit(0.0), lambda t, x: t + x * x)


def _least(a: np.ndarray, b: np.ndarray, same: bool) -> np.ndarray:
    """Distance of each row of a to the nearest row of b; same: b is a, and a row is not its own neighbour."""
    if not len(b) or same and len(b) < 2:
        return np.full(len(a), np.inf)
    middle = b.mean(0)
    a, b = a - middle, b - middle
    d = (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T
    if same:
        np.fill_diagonal(d, np.inf)
    return np.sqrt(((a - b[d.argmin(1)]) ** 2).sum(1))


def nearest_distances(points: DataFrame, keys: list[str], row: str, vector: str, leaf: int = LEAF) -> DataFrame:
    """(keys, row, d): the distance to the nearest other row of the same keys; null where there is none.

    Cells of a k-d tree, cut until they are small, give each point a first neighbour in its own cell. Pairs of cells are
    then followed down the tree, level by level, where the boxes lie nearer than a first neighbour found so far; only
    points nearer to a cell's box than to their first neighbour are compared with that cell's points, block against block.
    Rows with a null vector or key are left out; equal rows are neighbours at distance 0.
    """
    usable = points.filter(F.expr(" and ".join(f"`{k}` is not null" for k in [*keys, vector])))
    placed, tree = _cells(usable.select(*keys, row, F.col(vector).cast("array<double>").alias("v")), keys, leaf)
    placed = checkpointed(placed.withColumn("part", F.lit(0)), "placed")
    sizes = placed.groupBy(*keys, "cell").agg(F.count("*").alias("n"))
    # cells that could not be cut hold equal points: two rows of them tell all
    types = dict(placed.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"{row} {types[row]}", "cell string", "v array<double>", "d double"])

    def own(part: pa.Table) -> pa.Table:
        x = np.array(part["v"].to_pylist(), float)
        return part.select([*keys, row, "cell", "v"]).append_column("d", pa.array(_least(x, x, True)))

    small = placed.join(sizes.filter(F.col("n") <= leaf).select(*keys, "cell"), [*keys, "cell"], "left_semi")
    first = small.groupBy(*keys, "cell").applyInArrow(own, schema)
    equal = placed.join(sizes.filter(F.col("n") > leaf).select(*keys, "cell"), [*keys, "cell"], "left_semi").select(*keys, row, "cell", "v", F.lit(0.0).alias("d"))
    first = checkpointed(first.unionByName(equal), "first")
    known = F.when(F.col("d") < float("inf"), F.col("d"))
    if tree.filter("parent is not null").isEmpty():  # every group is one cell
        return first.select(*keys, row, known.alias("d"))

    bounds = first.select(*keys, "cell", "d", F.posexplode("v").alias("i", "x")).groupBy(*keys, "cell", "i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.max("d").alias("d"))
    boxed = lambda b: b.groupBy(*keys, "cell").agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("x"), F.max("d").alias("reach")).select(*keys, "cell", F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi"), "reach")
    levels = bounds.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.length("cell")), lambda k: F.substring("cell", F.lit(1), k))).alias("cell"), "i", "lo", "hi", "d")
    boxes = checkpointed(boxed(levels.groupBy(*keys, "cell", "i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("d").alias("d"))), "boxes")
    inner = tree.filter("parent is not null").select(*keys, F.col("parent").alias("cell"), F.col("cell").alias("child"))
    side = lambda df, s: df.select(*keys, *(F.col(c).alias(f"{s}_{c}") for c in df.columns if c not in keys))
    pairs = boxes.filter("cell = ''").select(*keys, F.lit("").alias("a"), F.lit("").alias("b"))
    found = None
    while True:
        for s in ("a", "b"):
            down = inner.select(*keys, F.col("cell").alias(s), "child")
            pairs = pairs.join(down, [*keys, s], "left").withColumn(s, F.coalesce("child", s)).drop("child")
        boxed_pairs = pairs.join(side(boxes, "a").withColumnRenamed("a_cell", "a"), [*keys, "a"]).join(side(boxes, "b").withColumnRenamed("b_cell", "b"), [*keys, "b"])
        pairs = boxed_pairs.filter(_gap("a_lo", "a_hi", "b_lo", "b_hi") < F.col("a_reach") * F.col("a_reach")).select(*keys, "a", "b")
        leaf_a, leaf_b = (inner.select(*keys, F.col("cell").alias(s), F.lit(True).alias(f"open_{s}")).distinct() for s in ("a", "b"))
        pairs = checkpointed(pairs.join(leaf_a, [*keys, "a"], "left").join(leaf_b, [*keys, "b"], "left"), "pairs")
        ready = pairs.filter("open_a is null and open_b is null and a <> b").select(*keys, "a", "b")
        found = ready if found is None else found.unionByName(ready)
        pairs = pairs.filter("open_a is not null or open_b is not null").select(*keys, "a", "b")
        if pairs.isEmpty():
            break

    # points that may have a nearer neighbour in another cell, in blocks, each with that cell's points
    targets = side(boxes, "b").withColumnRenamed("b_cell", "b")
    near = found.join(first.withColumnRenamed("cell", "a"), [*keys, "a"]).join(targets, [*keys, "b"]).withColumn("p_lo", F.col("v"))
    near = checkpointed(near.filter(_gap("v", "p_lo", "b_lo", "b_hi") < F.col("d") * F.col("d")).select(*keys, row, "v", F.col("b").alias("cell")), "near")
    counts = near.groupBy(*keys, "cell").agg(F.ceil(F.count("*") / leaf).cast("int").alias("blocks"))
    asked = near.join(counts, [*keys, "cell"]).withColumn("part", F.pmod(F.xxhash64(row), "blocks").cast("int")).select(*keys, row, "v", "cell", "part", F.lit(True).alias("asks"))
    given = placed.join(counts, [*keys, "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*keys, row, "v", "cell", "part", F.lit(False).alias("asks"))

    def across(part: pa.Table) -> pa.Table:
        asks = part["asks"].to_numpy(zero_copy_only=False)
        x = np.array(part["v"].to_pylist(), float).reshape(len(asks), -1)
        return part.filter(pa.array(asks)).select([*keys, row, "cell", "v"]).append_column("d", pa.array(_least(x[asks], x[~asks], False)))

    more = asked.unionByName(given).groupBy(*keys, "cell", "part").applyInArrow(across, schema)
    best = first.select(*keys, row, "d").unionByName(more.select(*keys, row, "d")).groupBy(*keys, row).agg(F.min("d").alias("d"))
    return best.withColumn("d", known)


# --- density clusters -------------------------------------------------------------------------------------------------

#: Pairs of points of two cells that are compared as they are; larger pairs of cells are cut into boxes first.
DIRECT = 10_000


def _linked_cells(cores: DataFrame, keys: list[str], pairs: DataFrame, eps: float) -> DataFrame:
    """(keys, a, b): pairs of cells with cores within eps of each other.

    Boxes around a cell's cores decide most pairs: farthest corners within eps link them, boxes further apart do not.
    Pairs that stay open are cut into four times four boxes a side, until the boxes are points.
    """
    at = cores.select(*keys, "cell", F.col("cell").alias("box"), "x", "y")
    open_ = pairs.select(*keys, "a", "b", F.col("a").alias("box_a"), F.col("b").alias("box_b"))
    found = None
    while True:
        boxes = checkpointed(at.groupBy(*keys, "cell", "box").agg(*(f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max)))), "boxes")
        side = lambda s: boxes.select(*keys, F.col("cell").alias(s), F.col("box").alias(f"box_{s}"), *(F.col(c).alias(f"{s}_{c}") for c in ("lox", "hix", "loy", "hiy")))  # noqa: B023, E731
        both = open_.join(side("a"), [*keys, "a", "box_a"]).join(side("b"), [*keys, "b", "box_b"])
        least = [F.greatest(F.lit(0.0), F.col(f"b_lo{c}") - F.col(f"a_hi{c}"), F.col(f"a_lo{c}") - F.col(f"b_hi{c}")) for c in "xy"]
        most = [F.greatest(F.col(f"b_hi{c}") - F.col(f"a_lo{c}"), F.col(f"a_hi{c}") - F.col(f"b_lo{c}")) for c in "xy"]
        length = lambda d: F.sqrt(d[0] * d[0] + d[1] * d[1])
        both = checkpointed(both.withColumn("near", length(least)).withColumn("far", length(most)).filter(F.col("near") <= eps).select(*keys, "a", "b", "box_a", "box_b", "far"), "pairs")
        sure = checkpointed(both.filter(F.col("far") <= eps).select(*keys, "a", "b").distinct(), "sure")
        found = sure if found is None else found.unionByName(sure)
        open_ = checkpointed(both.join(sure, [*keys, "a", "b"], "left_anti").select(*keys, "a", "b", "box_a", "box_b"), "open")
        if open_.isEmpty():
            return found
        used = open_.select(*keys, F.col("a").alias("cell"), F.col("box_a").alias("box")).unionByName(open_.select(*keys, F.col("b").alias("cell"), F.col("box_b").alias("box"))).distinct()
        cut = lambda c: F.when(F.col(f"hi{c}") > F.col(f"lo{c}"), F.least(F.lit(3), F.floor((F.col(c) - F.col(f"lo{c}")) / (F.col(f"hi{c}") - F.col(f"lo{c}")) * 4))).otherwise(0)
        at = at.join(used, [*keys, "cell", "box"]).join(boxes, [*keys, "cell", "box"])
        at = checkpointed(at.select(*keys, "cell", F.concat_ws("/", "box", cut("x").cast("string"), cut("y").cast("string")).alias("box"), "x", "y", F.col("box").alias("above")), "points")
        children = at.select(*keys, "cell", "above", "box").distinct()
        for s in ("a", "b"):
            open_ = open_.join(children.select(*keys, F.col("cell").alias(s), F.col("above").alias(f"box_{s}"), F.col("box").alias("new")), [*keys, s, f"box_{s}"]).withColumn(f"box_{s}", F.col("new")).drop("new")
        at = at.drop("above")


def density_clusters(points: DataFrame, keys: list[str], eps: float, least: int) -> DataFrame:
    """(keys, id, cluster): cores have at least `least` points, themselves included, within eps; borders join the smallest cluster near them; the rest is null.

    points(keys, id, x, y), ids unique within keys; a cluster is named by its smallest core. Cells are so small that their
    points lie within eps of each other: a cell with `least` points has cores only, one with fewer has few points to look
    around for, so each point is looked at a bounded number of times and cells, not points, are linked into clusters.
    """
    side = eps / math.sqrt(2) * (1 - 1e-12)
    index = lambda c: F.floor(F.col(c) / side).cast("long")
    p = points.select(*keys, "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumn("i", index("x")).withColumn("j", index("y"))
    p = checkpointed(p.withColumn("cell", F.concat_ws(",", F.col("i").cast("string"), F.col("j").cast("string"))).withColumn("key", F.struct(*keys, "i", "j")), "points")
    full = p.groupBy("key").agg((F.count("*") >= least).alias("full"))
    p = checkpointed(dealt_join(p, full, "key", F.col("id")), "points")
    steps = F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in range(-2, 3) for b in range(-2, 3) if abs(a) + abs(b) < 4))

    def around(df: DataFrame) -> DataFrame:
        s = df.select(*keys, F.col("id").alias("of"), F.col("x").alias("ox"), F.col("y").alias("oy"), "i", "j", F.explode(steps).alias("__s"))
        return s.select(*keys, "of", "ox", "oy", (F.col("i") + F.col("__s.di")).alias("i"), (F.col("j") + F.col("__s.dj")).alias("j")).withColumn("key", F.struct(*keys, "i", "j")).select("key", "of", "ox", "oy")

    within = F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2) <= eps
    seen = dealt_join(p.select("key", "id", "x", "y"), around(p.filter("not full")), "key", F.col("id")).filter(within)
    names = [F.col("key")[k].alias(k) for k in keys]
    more = seen.groupBy(*names, F.col("of").alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(*keys, "id")
    cores = checkpointed(p.filter("full").select(*keys, "id", "x", "y", "i", "j", "cell").unionByName(p.join(more, [*keys, "id"], "left_semi").select(*keys, "id", "x", "y", "i", "j", "cell")), "cores")
    cells = checkpointed(cores.groupBy(*keys, "i", "j", "cell").agg(F.count("*").alias("n"), F.min("id").alias("first")), "core-cells")
    half = F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in range(-2, 3) for b in range(-2, 3) if abs(a) + abs(b) < 4 and (a, b) > (0, 0)))
    beside = cells.select(*keys, F.col("cell").alias("a"), F.col("n").alias("n_a"), "i", "j", F.explode(half).alias("__s")).select(*keys, "a", "n_a", (F.col("i") + F.col("__s.di")).alias("i"), (F.col("j") + F.col("__s.dj")).alias("j"))
    beside = checkpointed(beside.join(cells.select(*keys, "i", "j", F.col("cell").alias("b"), F.col("n").alias("n_b")), [*keys, "i", "j"]).select(*keys, "a", "b", (F.col("n_a") * F.col("n_b") <= DIRECT).alias("direct")), "beside")
    direct = beside.filter("direct").join(cores.select(*keys, F.col("cell").alias("a"), F.col("x").alias("ox"), F.col("y").alias("oy")), [*keys, "a"]).join(cores.select(*keys, F.col("cell").alias("b"), "x", "y"), [*keys, "b"]).filter(within)
    linked = direct.select(*keys, "a", "b").distinct()
    large = beside.filter("not direct")
    if not large.isEmpty():
        linked = linked.unionByName(_linked_cells(cores, keys, large, eps))
    node = lambda c: F.struct(*keys, F.col(c).alias("cell"))
    roots = components(linked.select(node("a").alias("a"), node("b").alias("b")))
    named = cells.select(*keys, "cell", "first", node("cell").alias("node")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = checkpointed(dealt_join(named, named.groupBy("root").agg(F.min("first").alias("cluster")), "root", F.col("cell")).select(*keys, "cell", "cluster"), "named")
    own = cores.select(*keys, "id", F.struct(*keys, "cell").alias("key")).join(named.select(F.struct(*keys, "cell").alias("key"), "cluster"), "key").select(*keys, "id", "cluster")
    rest = checkpointed(p.join(cores.select(*keys, "id"), [*keys, "id"], "left_anti"), "rest")
    reach = dealt_join(cores.join(named, [*keys, "cell"]).select(F.struct(*keys, "i", "j").alias("key"), "id", "x", "y", "cluster"), around(rest), "key", F.col("id")).filter(within)
    border = reach.groupBy(*names, F.col("of").alias("id")).agg(F.min("cluster").alias("cluster"))
    return own.unionByName(rest.select(*keys, "id").join(border, [*keys, "id"], "left").select(*keys, "id", "cluster"))


# --- regions of grids -------------------------------------------------------------------------------------------------

#: Cells of a tile along a side.
TILE = 64


def label_tile(on: np.ndarray) -> np.ndarray:
    """The smallest place in each 8-connected region, -1 outside regions."""
    n = on.size
    label = np.where(on, np.arange(n).reshape(on.shape), n)
    while True:
        wide = np.pad(label, 1, constant_values=n)
        least = np.minimum.reduce([wide[a : a + on.shape[0], b : b + on.shape[1]] for a in range(3) for b in range(3)])
        new = np.where(on, least, n)
        flat = np.append(new.ravel(), n)
        new = np.where(on, flat[new], n)  # follow the label of the label
        if (new == label).all():
            return np.where(on, label, -1)
        label = new


def betti_numbers(cells: DataFrame, keys: list[str], thresholds: list[float], value: str = "theta", tile: int = TILE) -> DataFrame:
    """(keys, threshold, beta0, beta1) of the cells at or below each threshold: regions and loops of unit squares with their edges and corners.

    cells(keys, i, j, value), each once; null and NaN values are above all thresholds. Tiles are labelled apart; regions
    that touch across the borders of tiles are then joined as components. Corners and edges are counted by the tile that
    holds the cell after them, which gets the row and column of cells before it too. beta1 = beta0 - (V - E + F).
    """
    types = dict(cells.dtypes)
    c = cells.select(*keys, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col(value).cast("double").alias("v"))
    ahead = lambda x: F.when(F.pmod(F.col(x), F.lit(tile)) == tile - 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    c = c.withColumn("__di", F.explode(ahead("i"))).withColumn("__dj", F.explode(ahead("j")))
    c = c.withColumn("__ti", F.floor(F.col("i") / tile) + F.col("__di")).withColumn("__tj", F.floor(F.col("j") / tile) + F.col("__dj"))
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "threshold double, i long, j long, label string, regions long, euler long"])

    def run(part: pa.Table) -> pa.Table:
        at = [part["__ti"][0].as_py() * tile, part["__tj"][0].as_py() * tile]
        grid = np.full((tile + 1, tile + 1), np.inf)  # the first row and column belong to the tiles before
        v = part["v"].to_numpy(zero_copy_only=False).astype(float)
        grid[part["i"].to_numpy() - at[0] + 1, part["j"].to_numpy() - at[1] + 1] = np.where(np.isnan(v), np.inf, v)
        rows = []
        for t in thresholds:
            wide = grid <= t
            on, up, left, corner = wide[1:, 1:], wide[:-1, 1:], wide[1:, :-1], wide[:-1, :-1]
            label = label_tile(on)
            euler = int((on | up | left | corner).sum()) - int((on | up).sum()) - int((on | left).sum()) + int(on.sum())
            rows.append((t, None, None, None, len(np.unique(label[label >= 0])), euler))
            edge = np.zeros_like(on)
            edge[[0, -1], :] = edge[:, [0, -1]] = True
            for i, j in np.argwhere(on & edge).tolist():
                a, b = divmod(int(label[i, j]), tile)
                rows.append((t, at[0] + i, at[1] + j, f"{at[0] + a},{at[1] + b}", 0, 0))
        head = [pa.array([part[k][0].as_py()] * len(rows), part.schema.field(k).type) for k in keys]
        kinds = [pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([*head, *(pa.array([r[n] for r in rows], k) for n, k in enumerate(kinds))], names=[*keys, "threshold", "i", "j", "label", "regions", "euler"])

    found = checkpointed(c.select(*keys, "i", "j", "v", "__ti", "__tj").groupBy(*keys, "__ti", "__tj").applyInArrow(run, schema), "tiles")
    border = found.filter("label is not null").select(*keys, "threshold", "i", "j", "label")
    steps = F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) > (0, 0)))
    other = border.select(*keys, "threshold", "i", "j", F.col("label").alias("from"), F.explode(steps).alias("__s"))
    other = other.withColumn("ni", F.col("i") + F.col("__s.di")).withColumn("nj", F.col("j") + F.col("__s.dj"))
    other = other.filter((F.floor(F.col("i") / tile) != F.floor(F.col("ni") / tile)) | (F.floor(F.col("j") / tile) != F.floor(F.col("nj") / tile)))
    touch = other.select(*keys, "threshold", F.col("ni").alias("i"), F.col("nj").alias("j"), "from").join(border, [*keys, "threshold", "i", "j"])
    node = lambda x: F.struct(*keys, "threshold", F.col(x).alias("label"))
    joined = components(touch.select(node("from").alias("a"), node("label").alias("b")))
    fewer = joined.filter(F.col("node") != F.col("root")).groupBy(*(F.col("node")[k].alias(k) for k in [*keys, "threshold"])).agg(F.count("*").alias("fewer"))
    total = found.groupBy(*keys, "threshold").agg(F.sum("regions").alias("regions"), F.sum("euler").alias("euler"))
    out = total.join(fewer, [*keys, "threshold"], "left").withColumn("beta0", F.col("regions") - F.coalesce("fewer", F.lit(0)))
    return out.select(*keys, "threshold", "beta0", (F.col("beta0") - F.col("euler")).alias("beta1"))
