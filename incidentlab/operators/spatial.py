"""Neighbour features over an edge table, and joins of points with polygons."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import COLUMNS, Columns
from ..functions.geo import area_centroid, ring_bounds
from ..functions.scalar import col, haversine_km
from .scale import settle, with_stats


def _neighbour_mean(unit_year: DataFrame, edges: DataFrame, value: str, name: str, cols: Columns) -> DataFrame:
    other = unit_year.select(F.col(cols.unit).alias("dst"), F.col(cols.year), F.col(value).alias("_v"))
    means = (
        other.join(edges, "dst")
        .groupBy(F.col("src").alias(cols.unit), cols.year).agg(F.avg("_v").alias(name))
    )
    return unit_year.join(means, [cols.unit, cols.year], "left")


def neighbor_mean(unit_year: DataFrame, edges: DataFrame, value: str, cols: Columns = COLUMNS,
                  name: str = "neighbor_risk") -> DataFrame:
    """J2. Mean of the neighbours' ``value`` in the same year; NULL without any."""
    return _neighbour_mean(unit_year, edges, value, name, cols)


def spatial_lag(unit_year: DataFrame, edges: DataFrame, rate: str, cols: Columns = COLUMNS,
                name: str = "spatial_lag") -> DataFrame:
    """J3. As :func:`neighbor_mean` on a rate; neighbours without a rate are skipped."""
    return _neighbour_mean(unit_year, edges, rate, name, cols)


def with_z_score(df: DataFrame, value: Column | str, name: str = "z") -> DataFrame:
    """W15. Standard score over the whole table; a constant column gives 0."""
    df = with_stats(df, "_stats", df.agg(F.avg(col(value)).alias("mean"), F.stddev_samp(col(value)).alias("sd")))
    spread = F.when(F.col("_stats.sd") == 0, F.lit(1.0)).otherwise(F.col("_stats.sd"))
    return df.withColumn(name, (col(value) - F.col("_stats.mean")) / spread).drop("_stats")


def local_moran_proxy(unit_year: DataFrame, edges: DataFrame, rate: str, count: str, cols: Columns = COLUMNS,
                      name: str = "local_moran") -> DataFrame:
    """J4. Own standard score times the neighbours' mean score; NULL without neighbours."""
    scored = with_z_score(unit_year, F.coalesce(F.col(rate), F.col(count).cast("double")), "_z")
    paired = _neighbour_mean(scored, edges, "_z", "_nz", cols)
    return paired.withColumn(name, F.col("_z") * F.col("_nz")).drop("_z", "_nz")


# --- shapes ------------------------------------------------------------------


def whole_shapes(polys: DataFrame) -> DataFrame:
    """(name, rings): all parts and holes of a name in one row. ``polys`` has a ``ring`` or an array ``rings`` a row."""
    rings = F.flatten(F.collect_list("rings")) if "rings" in polys.columns else F.collect_list("ring")
    return polys.groupBy("name").agg(rings.alias("rings"))


#: Cells of a grid that are cut finer at most, the most crowded first; candidates a row from which a cell is cut once, and how many
#: times as many for each further cut in half.
CROWDED_CELLS, CROWDED_FROM, CROWDED_STEP = 65_536, 320, 8
_CELL = ("_level", "_bx", "_by")


def _on_grids(boxes: DataFrame, tol: float, some: Column | None, home: bool) -> DataFrame:
    """``boxes`` by the cells (_level, _bx, _by) they touch: as a home on the grid of its own size class, else there and on all coarser ones."""
    side = F.greatest(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")) + F.lit(2 * tol)
    sized = boxes.withColumn("_size", F.ceil(F.log2(F.greatest(side, F.lit(1e-9)))).cast("int"))
    coarsest = sized.agg(F.max("_size")).scalar()
    level = F.col("_size") if home else F.explode(F.sequence(F.col("_size"), coarsest))
    step = F.pow(F.lit(2.0), F.col("_level"))
    return (
        (sized if some is None else sized.filter(some)).withColumn("_level", level)
        .withColumn("_bx", F.explode(F.sequence(_cell("x_min", -tol, step), _cell("x_max", tol, step))))
        .withColumn("_by", F.explode(F.sequence(_cell("y_min", -tol, step), _cell("y_max", tol, step))))
    )


def _cell(bound: str, grown: float, step: Column) -> Column:
    """The cell in which a grown bound lies. A little more is added, so that rounding never parts two boxes that just meet."""
    slack = F.pow(F.lit(2.0), F.col("_level") - 20)
    return F.floor((F.col(bound) + F.lit(grown) + (slack if bound.endswith("max") else -slack)) / step)


def _crowded_cells(boxes: DataFrame, tol: float) -> DataFrame:
    """(_level, _bx, _by, _depth): cells of the grids with many candidates a row, and how often to halve their sides."""
    homes, visits = (_on_grids(boxes, tol, None, home).groupBy(*_CELL).agg(F.count(F.lit(1)).cast("double").alias(n))
                     for home, n in ((True, "_h"), (False, "_v")))
    each = F.col("_h") * F.col("_v") / (F.col("_h") + F.col("_v"))
    depth = 1 + F.floor(F.log2(each / CROWDED_FROM) / F.log2(F.lit(float(CROWDED_STEP)))).cast("int")
    crowded = homes.join(visits, [*_CELL]).filter(each >= CROWDED_FROM)
    return crowded.orderBy((F.col("_h") * F.col("_v")).desc(), *_CELL).limit(CROWDED_CELLS).select(*_CELL, depth.alias("_depth"))


def _near_boxes(boxes: DataFrame, tol: float, homes: Column | None = None, visits: Column | None = None,
                near: Callable[[str, str], Column] | None = None, crowded: DataFrame | None = None) -> DataFrame:
    """Pairs a, b (aliases) of the rows of ``boxes`` (name, x_min, x_max, y_min, y_max, ...) with other names whose boxes, each grown by
    ``tol``, meet. ``homes`` and ``visits`` narrow the rows that serve as a and as b, ``near`` the pairs.

    Each box lives on the grid of its own size class (cell side: the power of
    two above its grown box, so it touches at most nine cells) and looks for
    others there and on all coarser grids. Candidates thus are near a box of at
    least their own size, however the boxes crowd. Cells with many candidates
    (``crowded``, the same for all calls on one table) are cut finer.

    A pair comes once, from the cell that holds the lower left corner of the
    common part. A box is of one of four classes in a cell: it starts there
    along x and y, along one of them, or along none. The corner is in the cell
    if one of the two starts there along x, and one along y; only such classes
    are joined. b is the smaller box, or that of the later class or name.
    """
    crowded = F.broadcast(_crowded_cells(boxes, tol) if crowded is None else crowded)

    def in_cells(home: bool, some: Column | None) -> DataFrame:
        rows = _on_grids(boxes, tol, some, home).join(crowded, [*_CELL], "left").withColumn("_depth", F.coalesce("_depth", F.lit(0)))
        parts = F.pow(F.lit(2.0), F.col("_depth"))
        step = F.pow(F.lit(2.0), F.col("_level") - F.col("_depth"))
        for c in ("x", "y"):
            first, last = F.floor(F.col(f"_b{c}") * parts), F.floor((F.col(f"_b{c}") + 1) * parts) - 1
            begins = _cell(f"{c}_min", -tol, step)
            rows = rows.withColumn(f"_{c}", F.explode(F.sequence(F.greatest(begins, first), F.least(_cell(f"{c}_max", tol, step), last))))
            rows = rows.withColumn(f"_s{c}", F.col(f"_{c}") == begins)
        starts = F.when(F.col("_sx"), F.lit(2)).otherwise(0) + F.when(F.col("_sy"), F.lit(1)).otherwise(0)
        same = F.col("_size") == F.col("_level")
        classes = lambda *found: F.array(*map(F.lit, found))
        with_homes = (F.when(starts == 3, F.when(same, classes(3)).otherwise(classes(0, 1, 2, 3)))
                      .when(starts == 2, F.when(same, classes(3)).otherwise(classes(1, 3)))
                      .when(starts == 1, classes(2, 3)).otherwise(classes(3)))
        rows = rows.withColumn("_free", ~same | (starts != 3)).withColumn("_class", starts if home else F.explode(with_homes))
        return rows.select(*boxes.columns, "_level", "_depth", "_x", "_y", "_class", *([] if home else ["_free"]))

    home, visit = in_cells(True, homes).alias("a"), in_cells(False, visits).alias("b")
    same_cell = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("_x", "_y", "_class", "_level", "_depth")]
    reach = 2 * tol
    boxes_meet = (
        (F.col("a.x_min") - F.col("b.x_max") <= reach) & (F.col("b.x_min") - F.col("a.x_max") <= reach)
        & (F.col("a.y_min") - F.col("b.y_max") <= reach) & (F.col("b.y_min") - F.col("a.y_max") <= reach)
    )
    once = (F.col("b._free") | (F.col("a.name") < F.col("b.name"))) & (F.col("a.name") != F.col("b.name"))
    met = boxes_meet if near is None else boxes_meet & near("a", "b")
    return home.join(visit, [*same_cell, met & once])


def _segments_near(a: Column, b: Column, reach: float) -> Column:
    """True when two segments (ax, ay, bx, by) cross or come within ``reach`` of each other."""
    def side(e: Column, x: Column, y: Column) -> Column:
        return (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])

    crosses = ((side(a, b["ax"], b["ay"]) * side(a, b["bx"], b["by"]) < 0)
               & (side(b, a["ax"], a["ay"]) * side(b, a["bx"], a["by"]) < 0))
    ends = [_edge_distance(e, o[f"{end}x"], o[f"{end}y"]) <= reach for e, o in ((a, b), (b, a)) for end in ("a", "b")]
    return crosses | ends[0] | ends[1] | ends[2] | ends[3]


def _edge_distance(e: Column, x: Column, y: Column) -> Column:
    """Distance of a point to a segment (ax, ay, bx, by), in coordinate units."""
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    along = F.coalesce(F.try_divide((x - e["ax"]) * dx + (y - e["ay"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.hypot(e["ax"] + s * dx - x, e["ay"] + s * dy - y)


#: Edges of a piece of a border. A ring of no more edges is one piece.
PIECE_EDGES = 8


def border_pieces(polys: DataFrame) -> DataFrame:
    """(name, own, x_min, x_max, y_min, y_max): every ring cut into pieces of ``PIECE_EDGES`` edges. ``own`` has the edges, the first
    vertex and whether the piece is a whole ring."""
    ring, part = F.col("ring"), F.col("_part")
    starts = F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1)), F.lit(PIECE_EDGES))
    pieces = polys.filter(F.size(ring) > 0).select(
        "name", (F.size(ring) <= PIECE_EDGES + 1).alias("_whole"),
        F.explode(F.transform(starts, lambda i: F.slice(ring, i, F.lit(PIECE_EDGES + 1)))).alias("_part"))
    edges = F.transform(F.slice(part, F.lit(1), F.size(part) - 1), lambda p, i: F.struct(
        p["x"].alias("ax"), p["y"].alias("ay"), F.get(part, i + 1)["x"].alias("bx"), F.get(part, i + 1)["y"].alias("by")))
    own = F.struct(edges.alias("edges"), part[0].alias("first"), F.col("_whole").alias("whole"))
    return pieces.select("name", own.alias("own"), *[c.alias(n) for n, c in ring_bounds("_part").items()])


#: What stands for a part that a shape does not have: nothing is near it.
_NOWHERE = {"min": float("inf"), "max": float("-inf")}


def _with_cores(pieces: DataFrame) -> DataFrame:
    """Border pieces with a rectangle (cx_min, cx_max, cy_min, cy_max) inside the shape, as far as one is known, and ``rough``.

    The core of a closed ring in one piece is its box, shrunk around the centre
    until no edge enters it; it is inside if the centre is. A ring that runs
    along its box alone is that rectangle: it is not ``rough``, its core is the
    box, and its edges are not kept. All other cores are a little smaller than
    they could be, so that rounding never makes them too large. Pieces of longer
    rings and shapes around whose centre there is nothing have none.
    """
    own, edges = F.col("own"), F.col("own")["edges"]
    half = {c: (F.col(f"{c}_max") - F.col(f"{c}_min")) / 2 for c in ("x", "y")}
    mid = {c: F.col(f"{c}_min") + half[c] for c in ("x", "y")}
    last = F.try_element_at(edges, F.lit(-1))
    closed = own["whole"] & (F.size(edges) > 2) & (half["x"] > 0) & (half["y"] > 0) & (
        own["first"]["x"] == last["bx"]) & (own["first"]["y"] == last["by"])
    finite = F.forall(edges, lambda e: F.abs(e["ax"]) + F.abs(e["ay"]) < 1e150)
    along = F.forall(edges, lambda e: (
        ((e["ax"] == e["bx"]) & ((e["ax"] == F.col("x_min")) | (e["ax"] == F.col("x_max"))))
        | ((e["ay"] == e["by"]) & ((e["ay"] == F.col("y_min")) | (e["ay"] == F.col("y_max"))))))

    def free(e: Column) -> Column:
        """Up to which share of the box nothing of the edge is met: it is apart along x, along y or across the edge."""
        u, v = (lambda c, n: (e[n] - mid[c]) / half[c]), F.abs
        ax, ay, bx, by = u("x", "ax"), u("y", "ay"), u("x", "bx"), u("y", "by")
        across = F.coalesce(F.try_divide(v(ax * by - bx * ay), v(bx - ax) + v(by - ay)), F.lit(0.0))
        return F.greatest(F.least(ax, bx), -F.greatest(ax, bx), F.least(ay, by), -F.greatest(ay, by), across)

    share = F.array_min(F.transform(edges, free)) - 1e-9
    inner = closed & finite & _held(mid["x"], mid["y"], 0.0, edges)
    pieces = pieces.withColumn("_inner", F.coalesce(inner, F.lit(False)))
    pieces = pieces.withColumn("rough", ~(F.col("_inner") & F.coalesce(along, F.lit(False))))
    pieces = pieces.withColumn("_share", F.when(F.col("rough") & F.col("_inner"), share))
    ends = {f"c{c}_{n}": F.when(~F.col("rough"), F.col(f"{c}_{n}")).when(F.col("_share") > 0, mid[c] + way * F.col("_share") * half[c])
            .otherwise(F.lit(_NOWHERE[n])) for c in ("x", "y") for n, way in (("min", -1), ("max", 1))}
    return pieces.withColumns(ends).withColumn("own", F.when(F.col("rough"), own)).drop("_inner", "_share")


def _apart(a: str, b: str, core: str = "") -> Column:
    """Distance of two boxes, or of their cores."""
    gap = lambda c: F.greatest(
        F.col(f"{a}.{core}{c}_min") - F.col(f"{b}.{core}{c}_max"), F.col(f"{b}.{core}{c}_min") - F.col(f"{a}.{core}{c}_max"), F.lit(0.0))
    return F.sqrt(gap("x") * gap("x") + gap("y") * gap("y"))


def _piece(side: str) -> Column:
    """A border piece with its edges; those of a rectangle are its box."""
    c = {n: F.col(f"{side}.{n}") for n in ("x_min", "x_max", "y_min", "y_max")}
    corners = [(c["x_min"], c["y_min"]), (c["x_max"], c["y_min"]), (c["x_max"], c["y_max"]), (c["x_min"], c["y_max"])]
    edges = F.array(*[F.struct(p[0].alias("ax"), p[1].alias("ay"), q[0].alias("bx"), q[1].alias("by"))
                      for p, q in zip(corners, [*corners[1:], corners[0]], strict=True)])
    box = F.struct(edges.alias("edges"), F.struct(c["x_min"].alias("x"), c["y_min"].alias("y")).alias("first"), F.lit(True).alias("whole"))
    return F.struct(F.coalesce(F.col(f"{side}.own"), box).alias("own"), *[v.alias(n) for n, v in c.items()])


def _pieces_meet(a: Column, b: Column, tol: float) -> Column:
    """True when an edge of one piece is within ``2 * tol`` of an edge of the other, or one of two whole rings lies in the other."""
    reach = 2 * tol

    def apart(e: Column, x_min: Column, x_max: Column, y_min: Column, y_max: Column) -> Column:
        return ((F.least(e["ax"], e["bx"]) - x_max > reach) | (x_min - F.greatest(e["ax"], e["bx"]) > reach)
                | (F.least(e["ay"], e["by"]) - y_max > reach) | (y_min - F.greatest(e["ay"], e["by"]) > reach))

    def edges_near(e: Column, o: Column) -> Column:
        box = (F.least(o["ax"], o["bx"]), F.greatest(o["ax"], o["bx"]), F.least(o["ay"], o["by"]), F.greatest(o["ay"], o["by"]))
        return ~apart(e, *box) & _segments_near(e, o, reach)

    def inside(p: Column, q: Column) -> Column:
        x, y = p["own"]["first"]["x"], p["own"]["first"]["y"]
        return x.between(q["x_min"], q["x_max"]) & y.between(q["y_min"], q["y_max"]) & _held(x, y, 0.0, q["own"]["edges"])

    near = F.exists(a["own"]["edges"], lambda e: ~apart(e, b["x_min"], b["x_max"], b["y_min"], b["y_max"])
                    & F.exists(b["own"]["edges"], lambda o: edges_near(e, o)))
    rings = a["own"]["whole"] & b["own"]["whole"] & (inside(a, b) | inside(b, a))
    return F.coalesce(near, F.lit(False)) | F.coalesce(rings, F.lit(False))


def _long_rings_inside(polys: DataFrame) -> DataFrame | None:
    """(src, dst) of shapes with a ring inside a ring of the other, where one of the two rings is more than a piece; None where no
    ring is. Where no edges meet, a ring lies inside another as a whole or not at all: one of its vertices tells."""
    long = F.size("ring") > PIECE_EDGES + 1
    if polys.filter(long).isEmpty():
        return None
    each = polys.select("name", "ring").filter(F.size("ring") > 0).dropDuplicates(["name", "ring"])
    rings = each.select(F.struct("name", F.xxhash64("ring").alias("ring")).alias("name"), "ring")
    first = each.select(F.col("name").alias("_of"), F.col("ring")[0]["x"].alias("_x"), F.col("ring")[0]["y"].alias("_y"), "ring")
    found = [point_in_polygon(points.drop("ring"), of, cols=replace(COLUMNS, lon="_x", lat="_y")).select(
        F.col("_of").alias("src"), F.col("name")["name"].alias("dst"))
        for points, of in ((first, rings.filter(long)), (first.filter(long), rings.filter(~long)))]
    return found[0].unionByName(found[1])


def adjacency(polys: DataFrame, tol: float, exact: bool = False) -> DataFrame:
    """J5. Edges (src, dst), both ways, of shapes that meet when each grows by ``tol``.

    By bounding boxes, or with ``exact`` by their borders: an edge within
    ``2 * tol`` of an edge of the other, or a ring inside a ring of the other.
    Borders are cut into pieces of a few edges, each a small box on the grids,
    so the work follows the pieces that lie close together and not the product
    of two shapes' vertices. A shape of several parts has a row for each; parts
    of one name are no neighbours, and an edge comes once however many parts
    meet.

    A pair of boxes comes once from the grids. Two names with one box each are
    thus told where they meet, whatever their number: only the pairs of names
    with several boxes are shuffled, to be made distinct.

    Shapes whose cores (rectangles inside them) are near are neighbours, and
    two rectangles are so exactly if their boxes are near. Only the pairs that
    this does not tell are tested edge by edge.
    """
    boxes = _with_cores(border_pieces(polys)) if exact else polys.select("name", *[c.alias(n) for n, c in ring_bounds("ring").items()])
    several = boxes.groupBy("name").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("name", F.lit(True).alias("_several"))
    boxes = boxes.filter(F.col("name").isNotNull()).join(several, "name", "left")
    boxes = settle(boxes.withColumn("_several", F.coalesce("_several", F.lit(False))))
    crowded = settle(_crowded_cells(boxes, tol))
    reach, many = 2 * tol, F.col("_several")
    forth = F.struct(F.col("a.name").alias("src"), F.col("b.name").alias("dst"))
    back = F.struct(F.col("b.name").alias("src"), F.col("a.name").alias("dst"))

    def found(homes: Column, visits: Column, near: Callable[[str, str], Column] | None, test: bool, *ways: Column) -> DataFrame:
        met = _near_boxes(boxes, tol, homes, visits, near, crowded)
        if not test:
            return met.select(F.inline(F.array(*ways)))
        met = met.select(F.array(*ways).alias("_ways"), cores("a", "b").alias("_told"), _piece("a").alias("_a"), _piece("b").alias("_b"))
        # a generator, so that the costly test stays out of the join over all in a cell
        return met.select(F.inline(F.when(F.col("_told") | _pieces_meet(F.col("_a"), F.col("_b"), tol), F.col("_ways"))))

    cores = lambda a, b: _apart(a, b, "c") <= reach
    near = lambda a, b: (_apart(a, b) <= reach * (1 + 1e-9)) & (F.col(f"{a}.rough") | F.col(f"{b}.rough") | cores(a, b))
    # joins of kinds of boxes that do not occur are not planned
    any_many, any_rough = boxes.agg(F.bool_or(many), F.bool_or("rough") if exact else F.lit(False)).first()
    once = found(~many, ~many, cores if exact else None, False, forth, back)
    if any_rough:
        once = once.unionByName(found(~many, ~many, lambda a, b: near(a, b) & ~cores(a, b), True, forth, back))
    again = [found(*sides, near if exact else None, exact, forth) for sides in ((many, F.lit(True)), (~many, many))] if any_many else []
    inside = _long_rings_inside(polys) if exact else None
    if inside is not None:
        again.append(inside)
    if not again:
        return once
    several = reduce(DataFrame.unionByName, again).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    several = several.filter(F.col("src") != F.col("dst")).distinct()
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return once.unionByName(several.select(F.inline(both)))


#: Edges a band should hold on average, beside those that only pass through.
BAND_EDGES = 8


def shape_edges(polys: DataFrame) -> DataFrame:
    """(name, ax, ay, bx, by): every edge of every ring, part or hole. ``polys`` has a ``ring`` or an array ``rings`` a row."""
    rings = polys.select("name", F.explode("rings").alias("ring")) if "rings" in polys.columns else polys.select("name", "ring")
    ring = F.col("ring")
    edges = F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(
        F.element_at(ring, i)["x"].alias("ax"), F.element_at(ring, i)["y"].alias("ay"),
        F.element_at(ring, i + 1)["x"].alias("bx"), F.element_at(ring, i + 1)["y"].alias("by")))
    return rings.filter(F.size(ring) > 1).select("name", F.inline(edges))


def banded_shapes(polys: DataFrame, tol: float) -> tuple[DataFrame, DataFrame]:
    """Shapes (name, box, y_step, bands) and their edges by horizontal band (name, band, edges).

    A shape's height is cut into equal bands, so many that a band holds about
    ``BAND_EDGES`` edges besides those passing through; an edge is listed in the
    bands it comes within ``tol`` of, and the lists hold at most some twice the
    shape's edges together, however long these are.
    """
    edges = shape_edges(polys)
    high, low = F.greatest("ay", "by"), F.least("ay", "by")
    box = edges.groupBy("name").agg(
        F.min(F.least("ax", "bx")).alias("x_min"), F.max(F.greatest("ax", "bx")).alias("x_max"), F.min(low).alias("y_min"),
        F.max(high).alias("y_max"), F.count(F.lit(1)).alias("_edges"), F.sum(high - low + 2 * tol).alias("_rise"))
    height = F.col("y_max") - F.col("y_min")
    passing = F.greatest(F.lit(1.0), F.coalesce(F.try_divide(F.col("_rise"), height), F.lit(1.0)))
    shapes = box.withColumn("bands", F.ceil(F.col("_edges") / (BAND_EDGES * passing)).cast("long")).select(
        "name", "x_min", "x_max", "y_min", "y_max", "bands", F.when(height > 0, height / F.col("bands")).otherwise(1.0).alias("y_step"))
    reached = F.explode(F.sequence(band_of(low - tol), band_of(high + tol)))
    listed = edges.join(shapes.select("name", "y_min", "y_step", "bands"), "name").withColumn("band", reached)
    return shapes, listed.groupBy("name", "band").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("edges"))


def band_of(y: Column) -> Column:
    """The band of a shape in which a height lies; those above and below count to the outer bands."""
    return F.greatest(F.lit(0), F.least(F.col("bands") - 1, F.floor((y - F.col("y_min")) / F.col("y_step")).cast("long"))).cast("long")


def _held(x: Column, y: Column, tol: float, edges: Column | str = "edges") -> Column:
    """Even-odd test against ``edges`` (those of the point's band), or an edge within ``tol``."""
    def crosses(e: Column) -> Column:
        at = F.try_divide((e["bx"] - e["ax"]) * (y - e["ay"]), e["by"] - e["ay"]) + e["ax"]
        return ((e["ay"] > y) != (e["by"] > y)) & F.coalesce(x < at, F.lit(False))

    inside = F.aggregate(edges, F.lit(False), lambda odd, e: F.when(crosses(e), ~odd).otherwise(odd))
    return inside | F.exists(edges, lambda e: _edge_distance(e, x, y) <= tol) if tol > 0 else inside


def point_in_polygon(points: DataFrame, polys: DataFrame, tol: float = 0.0, cols: Columns = COLUMNS) -> DataFrame:
    """J6. Points with the ``name`` of each polygon holding them (within ``tol``); points outside all drop out.

    Parts and holes of a name are one shape. An equi-join on grid buckets
    finds the boxes around a point: a shape lives on the grid of its size class
    (bucket side: the power of eight above its grown box, so it touches at most
    nine buckets); a point looks on each grid in use, which for shapes of like
    size is one. A second equi-join on (name, band) brings the few edges at the
    point's height: no ring travels, and the test does not grow with the
    vertices of the shape.
    """
    x, y = F.col(cols.lon), F.col(cols.lat)
    shapes, edges = banded_shapes(polys, tol)
    side = F.greatest(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")) + F.lit(2 * tol)
    shapes = shapes.withColumn("_level", F.ceil(F.log2(F.greatest(side, F.lit(1e-9))) / 3).cast("int"))
    levels = [r[0] for r in shapes.select("_level").distinct().collect()]  # a few powers of eight
    step = F.pow(F.lit(8.0), F.col("_level"))
    bucket = lambda c, d=0.0: F.floor((c + F.lit(d)) / step)
    covers = (
        shapes.withColumn("_bx", F.explode(F.sequence(bucket(F.col("x_min"), -tol), bucket(F.col("x_max"), tol))))
        .withColumn("_by", F.explode(F.sequence(bucket(F.col("y_min"), -tol), bucket(F.col("y_max"), tol))))
    )
    in_box = x.between(F.col("x_min") - tol, F.col("x_max") + tol) & y.between(F.col("y_min") - tol, F.col("y_max") + tol)
    grids = F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))
    located = points.withColumn("_level", grids).withColumns({"_bx": bucket(x), "_by": bucket(y)})
    boxed = located.join(covers, ["_level", "_bx", "_by"]).filter(in_box).withColumn("band", band_of(y))
    return boxed.join(edges, ["name", "band"]).filter(_held(x, y, tol)).select(*points.columns, "name")


def outside_claimed(points: DataFrame, polys: DataFrame, tol: float, cols: Columns = COLUMNS) -> DataFrame:
    """J6 / V14. One row: points tested, points outside the polygon of their own unit, and the share."""
    x, y = F.col(cols.lon), F.col(cols.lat)
    shapes, edges = banded_shapes(polys, tol)
    tested = points.join(shapes, F.col(cols.unit) == F.col("name")).withColumn("band", band_of(y)).select(
        "name", "band", x.alias("_x"), y.alias("_y"))
    held = tested.join(edges, ["name", "band"], "left").withColumn("_in", F.coalesce(_held(F.col("_x"), F.col("_y"), tol), F.lit(False)))
    return held.agg(F.count(F.lit(1)).alias("tested"), F.count_if(~F.col("_in")).alias("outside")).withColumn(
        "failure_share", F.try_divide(F.col("outside").cast("double"), F.col("tested")))


def bbox(features: DataFrame, ring: str = "ring") -> DataFrame:
    """A27. One row with the bounds of all rings, zeros when there are none."""
    b = ring_bounds(ring)
    pick = lambda f, c, n: F.coalesce(f(c), F.lit(0.0)).alias(n)
    return features.agg(pick(F.min, b["x_min"], "min_lon"), pick(F.min, b["y_min"], "min_lat"),
                        pick(F.max, b["x_max"], "max_lon"), pick(F.max, b["y_max"], "max_lat"))


# --- name resolution ---------------------------------------------------------


def crosswalk(units: DataFrame, mapping: DataFrame) -> DataFrame:
    """J7. Each unit ``name`` with its source names and an approximate flag.

    ``mapping`` has (name, source, approximate), one row per source name; a
    unit without a mapping is its own, exact source.
    """
    grouped = mapping.groupBy("name").agg(
        F.array_sort(F.collect_set("source")).alias("_s"), F.bool_or("approximate").alias("_a"))
    return units.join(grouped, "name", "left").select(
        "name", F.coalesce("_s", F.array("name")).alias("sources"),
        F.coalesce("_a", F.lit(False)).alias("approximate"))


def unresolved(walked: DataFrame, polys: DataFrame) -> DataFrame:
    """J8. Units none of whose source names has a polygon."""
    known = (
        walked.select("name", F.explode("sources").alias("source"))
        .join(polys.select(F.col("name").alias("source")), "source", "left_semi").select("name")
    )
    return walked.join(known, "name", "left_anti").select("name")


def attach_centroid(df: DataFrame, centroids: DataFrame, on: str) -> DataFrame:
    """J9. Inner join with a centroid table; rows without one drop out."""
    return df.join(centroids, on)


def distance_to_centre(points: DataFrame, polys: DataFrame, cols: Columns = COLUMNS, name: str = "distance_to_centre_km") -> DataFrame:
    """J9. Great-circle distance of each point to the centre of area of its own unit; NULL without a shape."""
    centre = whole_shapes(polys).select(F.col("name").alias(cols.unit), area_centroid("rings").alias("_c"))
    far = haversine_km(F.col(cols.lat), F.col(cols.lon), F.col("_c.y"), F.col("_c.x"))
    known = F.col("_c").isNotNull() & F.col(cols.lat).isNotNull() & F.col(cols.lon).isNotNull()
    return points.join(centre, cols.unit, "left").withColumn(name, F.when(known, far)).drop("_c")


def lookup_default(df: DataFrame, dim: DataFrame, on: str, value: str, default: Column | str | float) -> DataFrame:
    """J10. Left join with a lookup table; a missing value becomes ``default``."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    joined = df.join(dim.select(on, F.col(value).alias("_v")), on, "left")
    return joined.withColumn(value, F.coalesce("_v", fallback)).drop("_v")


def attach_unit_features(incidents: DataFrame, unit_year: DataFrame, cols: Columns = COLUMNS) -> DataFrame:
    """J1. Yearly unit features on every incident; incidents without a match stay."""
    return incidents.join(unit_year, cols.unit_year_keys, "left")
