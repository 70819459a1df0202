"""Cells, spans, controlled loss and survival.

A page is a table of cells (page_id, y, x); a region is a label on cells or spans. Images are never
decoded: on text a page is a document, y a line, x a word in it, and a region a line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import choice, stable_digest, stable_seed, uniform
from ..functions.statistics import share
from ..functions.text import survival_category
from ..session import shared_folder, staged

# Fixed values of the shape families.
EDGES = ["top", "bottom", "left", "right"]
CORNERS = ["top_left", "top_right", "bottom_left", "bottom_right"]
PLACEMENTS = ["start_edge", "interior", "end_edge"]
LOBES = ((0.28, 0.31, 1.0, 0.8), (0.50, 0.49, 0.85, 1.0), (0.71, 0.69, 1.0, 0.85))
SEVERITY_TOLERANCE = 0.005

# Fixed values of the cuts: least area and ink of a piece; between which shares a layout's two cuts fall.
PIECE_AREA, PIECE_INK = 0.18, 0.04
LAYOUTS = {"T": ((0.36, 0.58), (0.38, 0.62)), "L": ((0.34, 0.56), (0.38, 0.62))}


def text_cells(docs: DataFrame, page: str, text: str, *, tasks: int | None = None, **more: Column) -> DataFrame:
    """One cell for each word: (page_id, y, x, width, height), region = line y; no cell for an empty word.

    Width is the most words of any line, height the number of lines. With ``tasks`` the texts are dealt by page to that many
    tasks, so that what is grouped by page later needs no shuffle of cells. ``more``: columns of a page, made once a page.
    """
    pages = docs.select(F.col(page).alias("page_id"), F.col(text).alias("t"))
    pages = pages if tasks is None else pages.repartition(tasks, "page_id")
    lines = F.transform(F.split(F.coalesce("t", F.lit("")), "\n", -1), lambda l: F.split(l, " ", -1))
    sized = pages.select("page_id", lines.alias("l"), *[c.alias(name) for name, c in more.items()])
    sized = sized.select("page_id", F.array_max(F.transform("l", lambda w: F.size(w))).alias("width"), F.size("l").alias("height"), *more, F.posexplode("l").alias("y", "w"))
    return sized.select("page_id", "y", F.posexplode("w").alias("x", "word"), "width", "height", *more).where("word != ''").drop("word")


def spans_from_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Half-open runs (…, y, x0, x1) of neighbouring cells."""
    row = Window.partitionBy(*keys, "y").orderBy("x")
    return cells.withColumn("_i", F.col("x") - F.row_number().over(row)).groupBy(*keys, "y", "_i").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("_i")


def cells_from_spans(spans: DataFrame) -> DataFrame:
    """R1, the other way."""
    return spans.select("*", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x")).drop("x0", "x1")


def area(spans: DataFrame, keys: list[str]) -> DataFrame:
    """R2."""
    return spans.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))


def scale_spans(spans: DataFrame, from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> DataFrame:
    """R2: nearest-neighbour restore of spans to another page size: target pixel t shows source floor(t * from / to)."""
    first = lambda v, a, b: F.ceil(v * b / a).cast("int")
    rows = F.sequence(first(F.col("y"), from_h, to_h), first(F.col("y") + 1, from_h, to_h) - 1)
    kept = spans.where(first(F.col("y") + 1, from_h, to_h) > first(F.col("y"), from_h, to_h))
    out = kept.withColumn("_y", F.explode(rows)).withColumn("x0", first(F.col("x0"), from_w, to_w)).withColumn("x1", first(F.col("x1"), from_w, to_w))
    return out.withColumn("y", F.col("_y")).drop("_y").where("x1 > x0").select(*spans.columns)


def union_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping or touching spans of a row merged, so that every pixel counts once."""
    order = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = spans.withColumn("_new", F.when(reach.isNull() | (F.col("x0") > reach), 1).otherwise(0))
    grouped = flagged.withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "y", "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_g")


def newly_covered(keys: list[str]) -> Column:
    """How many cells of its row a span covers that no earlier span of the row does; these add up to the area of the union."""
    # Ordered by row rather than partitioned by it: what lies by ``keys`` stays where it is.
    before = F.max(F.struct("y", "x1")).over(Window.partitionBy(*keys).orderBy("y", "x0", "x1").rowsBetween(Window.unboundedPreceding, -1))
    return F.greatest(F.lit(0), F.col("x1") - F.greatest(before, F.struct("y", F.col("x0").alias("x1")))["x1"])


def span_overlap(regions: DataFrame, survivors: DataFrame) -> DataFrame:
    """(page_id, region_id, area, surviving, fraction, category); no overlap counts as 0.

    An equi-join on page and row, with the overlap as a condition on it.
    """
    a, b = regions.alias("a"), union_spans(survivors, ["page_id"]).alias("b")
    on = (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1"))
    width = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")
    kept = a.join(b, on).groupBy(F.col("a.page_id").alias("page_id"), F.col("a.region_id").alias("region_id")).agg(F.sum(width).alias("_s"))
    whole = area(regions, ["page_id", "region_id"])
    return _survival(whole.join(kept, ["page_id", "region_id"], "left").withColumn("surviving", F.coalesce("_s", F.lit(0))).drop("_s"))


def _survival(df: DataFrame) -> DataFrame:
    return df.withColumn("fraction", share(F.col("surviving"), F.col("area"))).withColumn("category", survival_category(F.col("fraction")))


def box_survival(boxes: DataFrame, survivors: DataFrame) -> DataFrame:
    """R4, the older estimator: clipped boxes (page_id, region_id, x0, y0, x1, y1), 0.0 and not null on an empty one, 8 places."""
    rows = boxes.where("x1 > x0 and y1 > y0").select("page_id", "region_id", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"), "x0", "x1")
    found = span_overlap(rows, survivors).select("page_id", "region_id", "surviving", "area")
    out = boxes.select("page_id", "region_id").join(found, ["page_id", "region_id"], "left")
    fraction = F.bround(F.coalesce(share(F.col("surviving"), F.col("area")), F.lit(0.0)), 8)
    return out.select("page_id", "region_id", F.coalesce("area", F.lit(0)).alias("area"), F.coalesce("surviving", F.lit(0)).alias("surviving"), fraction.alias("fraction"), (F.coalesce("surviving", F.lit(0)) == 0).alias("completely_lost"))


def visibility(survival: DataFrame, key: str = "page_id") -> DataFrame:
    """Regions by visibility, and the labels that are lost completely or in part."""
    lost = F.col("surviving") == 0
    by_label = survival.groupBy(key, "label").agg(F.bool_and(lost).alias("_all"), F.bool_or(lost).alias("_any"), F.count("*").alias("_n"), F.count(F.when(lost, 1)).alias("_l"), F.count(F.when(F.col("surviving") == F.col("area"), 1)).alias("_v"))
    return by_label.groupBy(key).agg(
        F.sum("_n").alias("regions"), F.sum("_v").alias("visible"), (F.sum("_n") - F.sum("_v") - F.sum("_l")).alias("partial"), F.sum("_l").alias("lost"),
        F.array_sort(F.collect_set(F.when(F.col("_all"), F.col("label")))).alias("labels_lost"), F.array_sort(F.collect_set(F.when(F.col("_any"), F.col("label")))).alias("labels_with_loss"),
    )


def shape_score(family: str, seed: Column) -> tuple[Column, Column]:
    """(score, guarded) of a cell (x, y) on a page (width, height); small scores go first.

    Guarded cells keep a shape off the page edges it must not touch. Which edge, corner or direction
    a page loses follows from the seed (P31).
    """
    x, y = (F.col("x") + 0.5) / F.col("width"), (F.col("y") + 0.5) / F.col("height")
    left, right, top, bottom = F.col("x") == 0, F.col("x") == F.col("width") - 1, F.col("y") == 0, F.col("y") == F.col("height") - 1
    if family in ("edge_loss", "edge_tear"):
        edge = choice(seed, EDGES)
        flat = edge.isin("top", "bottom")
        depth = F.when(edge == "top", y).when(edge == "bottom", 1 - y).when(edge == "left", x).otherwise(1 - x)
        if family == "edge_tear":
            along, phase = F.when(flat, x).otherwise(y), F.pmod(F.shiftright(seed, 8), F.lit(6284)) / 1000
            turn = 6.283185307179586
            depth = depth / (F.lit(0.85) + 0.15 * F.sin(turn * 2 * along + phase) + 0.10 * F.sin(turn * 5 * along + phase))
        opposite = F.when(edge == "top", bottom).when(edge == "bottom", top).when(edge == "left", right).otherwise(left)
        return depth, F.when(flat, left | right).otherwise(top | bottom) | opposite
    if family == "corner_loss":
        corner = choice(seed, CORNERS)
        ratio = F.lit(0.90) + F.pmod(F.shiftright(seed, 8), F.lit(21)) / 100
        u, v = F.when(corner.endswith("right"), 1 - x).otherwise(x), F.when(corner.startswith("bottom"), 1 - y).otherwise(y)
        return F.greatest(u / ratio, v * ratio), F.when(corner.startswith("bottom"), top).otherwise(bottom) | F.when(corner.endswith("right"), left).otherwise(right)
    if family == "internal_hole":
        cx, cy = F.lit(0.48) + F.pmod(F.shiftright(seed, 8), F.lit(5)) / 100, F.lit(0.48) + F.pmod(F.shiftright(seed, 16), F.lit(5)) / 100
        ratio = F.lit(0.95) + F.pmod(F.shiftright(seed, 24), F.lit(11)) / 100
        a, b = (x - cx) / ratio, (y - cy) * ratio
        return a * a + b * b, left | right | top | bottom
    if family == "strip_loss":
        along = F.when(choice(seed, ["vertical", "horizontal"]) == "vertical", x).otherwise(y)
        place = choice(seed, PLACEMENTS, 8)
        return F.abs(along - F.when(place == "start_edge", 0.0).when(place == "interior", 0.5).otherwise(1.0)), F.lit(False)
    if family == "connected_piece_loss":
        up = choice(seed, ["descending", "ascending"]) == "ascending"
        lobes = []
        for cx, cy, rx, ry in LOBES:
            a, b = (x - cx) / rx, (y - F.when(up, 1 - cy).otherwise(cy)) / ry
            lobes.append(a * a + b * b)
        return F.least(*lobes), F.lit(False)
    raise ValueError(f"unknown family: {family}")


def damage_seed(family: str, page: Column, severity: Column | float) -> Column:
    return stable_seed(family, page.cast("string"), F.lit(severity).cast("string") if not isinstance(severity, Column) else severity.cast("string"))


def remove_share(cells: DataFrame, family: str, severity: float, *, content: Column | None = None, seed: str | None = None) -> DataFrame:
    """R12 (W7): every cell with ``removed``, and its page's ``status``.

    Exactly the rounded share of a page's cells goes: the lowest scores, ties row by row. A page whose
    share rounds to none or all, or exceeds its unguarded cells, is rejected, never relaxed.
    With ``content`` (R13, W8) the share is of the content cells: the last of them fixes the threshold
    score and place, and every cell up to it goes, content or not.
    Scores are rounded to 9 places, so that the last bits of a sum decide no tie. ``seed``: the column with the page's
    ``damage_seed``, if the cells have one; it is dropped. All counts share one order, so a page's cells are sorted once.
    """
    if seed is None:
        cells, seed = cells.withColumn("_seed", damage_seed(family, F.col("page_id"), severity)), "_seed"
    score, guarded = shape_score(family, F.col(seed))
    df = cells.withColumn("guarded", guarded).withColumn("score", F.round(score, 9)).withColumn("content", F.lit(True) if content is None else content).drop(seed)
    order = Window.partitionBy("page_id").orderBy("_blocked", "score", "y", "x")
    page = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("_blocked", F.when(F.col("guarded"), 1).otherwise(0))
    total = F.count(F.when(F.col("content"), 1)).over(page)
    room = F.count(F.when(F.col("content") & ~F.col("guarded"), 1)).over(page)
    goal = F.bround(total * F.lit(severity), 0).cast("long")
    df = df.withColumn("total", total).withColumn("goal", goal).withColumn("room", room)
    status = F.when(~((F.col("goal") > 0) & (F.col("goal") < F.col("total"))), "target_too_small_or_empty").when(F.col("goal") > F.col("room"), "requested_area_exceeds_capacity").otherwise("ok")
    # Content cells at or before each cell: it goes while fewer than the goal came before it.
    before = F.coalesce(F.sum(F.when(F.col("content"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("status", status).withColumn("_before", before)
    gone = (F.col("status") == "ok") & ~F.col("guarded") & (F.col("_before") < F.col("goal"))
    return df.withColumn("removed", gone).drop("_blocked", "_before", "room")


def removal_report(removed: DataFrame, severity: float) -> DataFrame:
    """Per page total, removed, measured severity and its error, status."""
    by = removed.groupBy("page_id", "status").agg(F.count("*").alias("cells"), F.count(F.when(F.col("removed"), 1)).alias("removed_cells"), F.count(F.when(F.col("removed") & F.col("content"), 1)).alias("removed_content"), F.max("total").alias("content_cells"))
    loss = share(F.col("removed_content"), F.col("content_cells"))
    return by.select("page_id", "status", "cells", "removed_cells", F.bround(loss, 9).alias("content_loss"), F.bround(share(F.col("removed_cells"), F.col("cells")), 9).alias("page_loss"), F.bround(F.abs(loss - severity), 9).alias("error"))


def region_survival(removed: DataFrame, region: str = "y") -> DataFrame:
    """R3 on cells: area, surviving cells, fraction and category of every region."""
    by = removed.groupBy("page_id", F.col(region).alias("region_id")).agg(F.count("*").alias("area"), F.count(F.when(~F.col("removed"), 1)).alias("surviving"))
    return _survival(by)


def topology(removed: DataFrame) -> DataFrame:
    """R15 without labelling: edges touched, bounding box, fill, depth levels, contiguous rows."""
    gone = removed.where("removed")
    rows = gone.groupBy("page_id", "y").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"), F.max("width").alias("width"), F.max("height").alias("height"))
    cells = removed.groupBy("page_id").agg(F.count("*").alias("cells"))
    by = rows.groupBy("page_id").agg(
        F.sum("n").alias("removed_cells"), F.min("y").alias("top"), F.max("y").alias("bottom"), F.min("a").alias("left"), F.max("b").alias("right"),
        F.count_distinct("n").alias("depth_levels"), F.bool_and(F.col("b") - F.col("a") + 1 == F.col("n")).alias("contiguous_rows"), F.max("width").alias("width"), F.max("height").alias("height"),
    )
    box = (F.col("bottom") - F.col("top") + 1) * (F.col("right") - F.col("left") + 1)
    touched = F.array_join(F.array_compact(F.array(F.when(F.col("top") == 0, "top"), F.when(F.col("bottom") == F.col("height") - 1, "bottom"), F.when(F.col("left") == 0, "left"), F.when(F.col("right") == F.col("width") - 1, "right"))), ",")
    return by.join(cells, "page_id").select("page_id", "removed_cells", touched.alias("touched_edges"), box.alias("box_cells"), F.bround(F.col("removed_cells") / box, 9).alias("fill"), "depth_levels", "contiguous_rows", (F.col("removed_cells") == F.col("cells")).alias("whole_page"))


def complement_errors(cells: DataFrame, damage: DataFrame, survivors: DataFrame) -> DataFrame:
    """(page_id, y, x, problem): cells in both or in neither of damage and survivors."""
    keys = ["page_id", "y", "x"]
    d, s = damage.select(*keys, F.lit(1).alias("d")), survivors.select(*keys, F.lit(1).alias("s"))
    both = cells.select(*keys, F.lit(1).alias("c")).join(d, keys, "full_outer").join(s, keys, "full_outer")
    problem = F.when(F.col("c").isNull(), "not_a_cell").when(F.col("d").isNotNull() & F.col("s").isNotNull(), "both").when(F.col("d").isNull() & F.col("s").isNull(), "neither")
    return both.select(*keys, problem.alias("problem")).where("problem is not null")


def survival_window(pages: DataFrame, fraction: float, tolerance: float = 0.02) -> DataFrame:
    """A seeded rectangle (page_id, x0, y0, x1, y1) of about that share of a page (page_id, width, height)."""
    aspect = F.lit(0.8) + 0.4 * uniform("aspect", F.col("page_id"))
    w = F.greatest(F.lit(1), F.least(F.col("width"), F.round(F.sqrt(F.col("width") * F.col("height") * fraction * aspect)))).cast("int")
    sized = pages.withColumn("w", w).withColumn("h", F.greatest(F.lit(1), F.least(F.col("height"), F.round(F.col("width") * F.col("height") * fraction / F.col("w")))).cast("int"))
    x0, y0 = F.floor(uniform("x", F.col("page_id")) * (F.col("width") - F.col("w") + 1)).cast("int"), F.floor(uniform("y", F.col("page_id")) * (F.col("height") - F.col("h") + 1)).cast("int")
    measured = F.col("w") * F.col("h") / (F.col("width") * F.col("height"))
    return sized.withColumn("x0", x0).withColumn("y0", y0).select("page_id", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"), F.bround(measured, 9).alias("measured"), F.when(F.abs(measured - fraction) <= tolerance, "ok").otherwise("outside_tolerance").alias("status"))


# A page of at most so many spans is labelled by one task, row by row; larger ones in rounds of joins.
SPANS_IN_TASK = 200_000


def _page_components(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """The least number (from 1, in the order given) of the component of every span of a page; spans are sorted by y and x0 and one row's do not overlap."""
    parent = list(range(len(y)))

    def top(u: int) -> int:
        while parent[u] != u:
            parent[u] = u = parent[parent[u]]
        return u

    rows = [*np.flatnonzero(np.diff(y, prepend=y[0] - 1)).tolist(), len(y)]
    left, right = x0.tolist(), x1.tolist()
    for at in range(1, len(rows) - 1):
        above, u, end = rows[at - 1], rows[at], rows[at + 1]
        if y[u] != y[above] + 1:
            continue
        while above < rows[at] and u < end:
            if left[above] < right[u] and left[u] < right[above]:
                a, b = top(above), top(u)
                parent[max(a, b)] = min(a, b)
            if right[above] < right[u]:
                above += 1
            else:
                u += 1
    return np.array([top(u) + 1 for u in range(len(y))], np.int32)


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, span, component) of batches sorted by page and span; a page may lie in several batches."""

    def labelled(table: pa.Table) -> pa.RecordBatch:
        span, y, x0, x1 = (table.column(c).to_numpy() for c in ("span", "y", "x0", "x1"))
        firsts = [*np.flatnonzero(span == 1).tolist(), len(span)]
        own = [_page_components(y[a:b], x0[a:b], x1[a:b]) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
        pages = table.column("page_id").combine_chunks()
        return pa.RecordBatch.from_arrays([pages, pa.array(span, pa.int32()), pa.array(np.concatenate(own), pa.int32())], ["page_id", "span", "component"])

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        firsts = np.flatnonzero(table.column("span").to_numpy() == 1)
        # The last page may go on in the next batch.
        cut = int(firsts[-1]) if len(firsts) else 0
        if cut:
            yield labelled(table.slice(0, cut))
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield labelled(held)


def span_components(spans: DataFrame, max_rounds: int = 200, in_task: int = SPANS_IN_TASK) -> DataFrame:
    """(page_id, span, component): 4-neighbour components of spans (page_id, y, x0, x1).

    A span's number is its order on the page; touching spans of neighbouring rows are edges. Pages of up to ``in_task`` spans lie in one task,
    sorted, and are labelled there in one go along the rows; larger ones are labelled in rounds (``_components_in_rounds``). Spans of one row that
    overlap, or empty ones, go in rounds too.
    """
    page = Window.partitionBy("page_id")
    order = page.orderBy("y", "x0")
    overlaps = (F.lag("y").over(order) == F.col("y")) & (F.lag("x1").over(order) > F.col("x0"))
    odd = F.col("y").isNull() | F.coalesce(F.col("x0") >= F.col("x1"), F.lit(True)) | F.coalesce(overlaps, F.lit(False))
    placed = spans.select("page_id", "y", "x0", "x1", F.row_number().over(order).alias("span"), odd.alias("_odd"))
    small = (F.count("*").over(page) <= in_task) & ~F.bool_or("_odd").over(page) & F.col("page_id").isNotNull()
    nodes = staged(placed.withColumn("_small", small).drop("_odd"))
    rest = nodes.where(~F.col("_small")).drop("_small")
    own = nodes.where("_small").select("page_id", "span", *[F.col(c).cast("long") for c in ("y", "x0", "x1")])
    own = own.repartition("page_id").sortWithinPartitions("page_id", "span").mapInArrow(_whole_pages, f"page_id {nodes.schema['page_id'].dataType.simpleString()}, span int, component int")
    return own if rest.isEmpty() else own.unionByName(_components_in_rounds(rest, max_rounds))


def _components_in_rounds(nodes: DataFrame, max_rounds: int) -> DataFrame:
    """(page_id, span, component) of numbered spans, however many a page has: every round takes the smallest label next to each span, then the
    label of that label; long chains so halve, and lineage is cut by checkpoint() every four rounds."""
    shared_folder(nodes.sparkSession)
    a, b = nodes.alias("a"), nodes.alias("b")
    touch = (F.col("a.page_id") == F.col("b.page_id")) & (F.col("b.y") == F.col("a.y") + 1) & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1"))
    down = a.join(b, touch).select(F.col("a.page_id").alias("page_id"), F.col("a.span").alias("u"), F.col("b.span").alias("v"))
    edges = down.union(down.select("page_id", "v", "u")).checkpoint()
    labels = nodes.select("page_id", "span", F.col("span").alias("component"))
    for k in range(1, max_rounds + 1):
        near = edges.join(labels.select("page_id", F.col("span").alias("v"), "component"), ["page_id", "v"]).groupBy("page_id", F.col("u").alias("span")).agg(F.min("component").alias("low"))
        new = labels.join(near, ["page_id", "span"], "left").select("page_id", "span", F.least("component", F.coalesce("low", "component")).alias("component"))
        up = new.select("page_id", F.col("span").alias("component"), F.col("component").alias("top"))
        new = new.join(up, ["page_id", "component"]).select("page_id", "span", F.col("top").alias("component"))
        if k % 4 == 0:
            new = new.checkpoint()
            moved = new.alias("n").join(labels.alias("o"), ["page_id", "span"]).where("n.component != o.component").limit(1).count()
            if moved == 0:
                return new
        labels = new
    raise RuntimeError("components did not settle")


def three_way_partition(cells: DataFrame, *, pages: DataFrame | None = None, attempts: int = 40, least_area: float = PIECE_AREA, least_ink: float = PIECE_INK, ink: Column | None = None, ink_shares: tuple[float, ...] = ()) -> DataFrame:
    """R18 (W9): (page_id, layout, attempt, area_1, area_2, area_3): the first valid seeded cut of every page.

    Layout T cuts across, then the lower part down; layout L cuts down, then the right part across. A cut is
    valid if every piece has its least area and the least ink a cell. With ``ink_shares`` the least ink is at
    most that share of the page's own ink a cell; the shares are tried in their order. Within a share the
    layout drawn for the page goes first, then early attempts. A page without a valid cut, or without an id, has no row.
    The lines of all attempts are drawn once a page (of ``pages``, else of the cells) and joined to its runs of neighbouring cells of one ink.
    """
    ids = (cells if pages is None else pages).select("page_id").distinct()
    tries = ids.select("page_id", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("attempt"))
    lines = [(F.lit(low) + F.lit(high - low) * _draw(f"{layout}{k}", "attempt")).alias(f"{layout}{k}") for layout, cuts in LAYOUTS.items() for k, (low, high) in enumerate(cuts)]
    row = ["page_id", "y", "width", "height", "ink"]
    along = Window.partitionBy(*row).orderBy("x")
    placed = cells.select("page_id", "y", "x", "width", "height", (F.lit(1) if ink is None else ink.cast("int")).alias("ink"))
    apart = placed.withColumn("_new", F.when(F.col("x") == F.lag("x").over(along) + 1, 0).otherwise(1))
    runs = apart.withColumn("_g", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))).groupBy(*row, "_g").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))
    # Never broadcast: there are forty rows of every page.
    cut = runs.join(tries.select("page_id", "attempt", *lines).hint("merge"), "page_id")
    own = F.col("x1") - F.col("x0")

    def before(line: str) -> Column:
        """How many cells of a run lie left of the line: those with (x + 0.5) / width < line, by that very comparison."""
        left = lambda x: ((x + 0.5) / F.col("width") < F.col(line)).cast("long")
        at = F.floor(F.col(line) * F.col("width") - 0.5)
        return F.greatest(F.lit(0), F.least(at + left(at) + left(at + 1), F.col("x1")) - F.col("x0"))

    above = lambda line: (F.col("y") + 0.5) / F.col("height") < F.col(line)
    cut = cut.select("page_id", "attempt", "ink", own.alias("own"), above("T0").alias("T_up"), above("L1").alias("L_up"), before("T1").alias("T_left"), before("L0").alias("L_left"))
    none, (T_up, L_up) = F.lit(0), (F.col("T_up"), F.col("L_up"))
    pieces = {
        "T": (F.when(T_up, F.col("own")).otherwise(none), F.when(T_up, none).otherwise(F.col("T_left")), F.when(T_up, none).otherwise(F.col("own") - F.col("T_left"))),
        "L": (F.col("L_left"), F.when(L_up, F.col("own") - F.col("L_left")).otherwise(none), F.when(L_up, none).otherwise(F.col("own") - F.col("L_left"))),
    }
    sums, stats = [F.sum("own").alias("n"), F.sum(F.col("own") * F.col("ink")).alias("i")], []
    for layout, held in pieces.items():
        for k, inside in enumerate(held, 1):
            sums += [F.sum(inside).alias(f"{layout}n{k}"), F.sum(F.when(inside == 0, 0).otherwise(inside * F.col("ink"))).alias(f"{layout}i{k}")]
        stats.append(F.struct(F.lit(layout).alias("layout"), *[F.col(f"{layout}{c}{k}").alias(f"{c}{k}") for k in (1, 2, 3) for c in "ni"]))
    by = cut.groupBy("page_id", "attempt").agg(*sums).select("page_id", "attempt", "n", "i", F.explode(F.array(*stats)).alias("p")).select("page_id", "attempt", "n", "i", "p.*")

    def valid(least: Column) -> Column:
        return F.least(*[(F.col(f"n{k}") >= F.col("n") * least_area) & (share(F.col(f"i{k}"), F.col(f"n{k}")) >= least) for k in (1, 2, 3)])

    floors = [F.least(F.lit(least_ink), F.lit(s) * (F.col("i") / F.col("n"))) for s in ink_shares] or [F.lit(least_ink)]
    level = F.coalesce(*[F.when(valid(floor), k) for k, floor in enumerate(floors)])
    best = Window.partitionBy("page_id").orderBy("_level", F.col("layout") != choice(stable_seed("layout", F.col("page_id")), list(LAYOUTS)), "attempt")
    ranked = by.withColumn("_level", level).where("_level is not null").withColumn("_r", F.row_number().over(best))
    return ranked.where("_r = 1").select("page_id", "layout", "attempt", *[F.col(f"n{k}").alias(f"area_{k}") for k in (1, 2, 3)])


def _draw(name: str, attempt: str) -> Column:
    """A seeded number in [0, 1) for a page and attempt, on a grid of 2^16."""
    return F.conv(F.substring(stable_digest(name, F.col("page_id"), F.col(attempt)), 1, 4), 16, 10).cast("int") / 65536


def effect_coverage(cells: DataFrame, affected: str, content: str) -> DataFrame:
    """The share of content, and of the page, that an effect touches."""
    by = cells.groupBy("page_id").agg(F.count("*").alias("n"), F.count(F.when(F.col(content), 1)).alias("c"), F.count(F.when(F.col(affected), 1)).alias("a"), F.count(F.when(F.col(affected) & F.col(content), 1)).alias("both"))
    return by.select("page_id", share(F.col("both"), F.col("c")).alias("content_coverage"), share(F.col("a"), F.col("n")).alias("page_coverage"))
