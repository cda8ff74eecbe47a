"""Rows in reading order: visual lines, cells, batches, first occurrences, strongest of neighbours.

Order-dependent operators need a total order: the id is the last sort key everywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograph.functions.geometry import Box, clamp

PAGE = ("doc_id", "page_index")


def visual_lines(boxes: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Boxes with ``line``, from 1 on each page: a box goes on with its predecessor's line if they are about as
    tall, level, and near."""
    order = Window.partitionBy(*keys).orderBy("top", "x0", "id")
    before = F.lag(F.struct(*Box._fields)).over(order)
    a, b = Box.of(before), Box.flat()
    low, high = F.least(a.height, b.height), F.greatest(a.height, b.height)
    gap = b.x0 - a.x1
    goes_on = (high / F.greatest(F.lit(0.1), low) <= 1.35) & (F.abs(b.top - a.top) <= 0.4 * low) & (gap >= -1) & (gap <= F.greatest(F.lit(4.0), 1.5 * low))
    return boxes.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("line", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def group_boxes(boxes: DataFrame, group: list[str], text: str = "source_text") -> DataFrame:
    """One block for each group: union box, fill of it, text parts in order, median size, font and turn (the most
    frequent, first seen on ties). Boxes have an ordinal ``ord`` in their group's order."""
    b = Box.flat()
    whole = boxes.groupBy(*group).agg(
        F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"),
        F.sum(b.area).alias("_area"), F.count("*").alias("boxes"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", text))), lambda x: x[text]).alias("texts"),
        F.median(F.when(F.col("font_size") > 0, F.col("font_size"))).alias("_size"),
    )
    u = Box.flat()
    whole = whole.withColumn("geometry_fill_ratio", F.least(F.lit(1.0), F.col("_area") / F.greatest(F.lit(0.1), u.area)))
    whole = whole.withColumn("font_size", F.when(F.col("_size").isNotNull(), clamp(F.col("_size"), 5.0, 36.0)).otherwise(clamp(u.height, 6.0, 18.0)))
    for value in ("font_name", "rotation"):
        if value in boxes.columns:
            whole = whole.join(first_mode(boxes, group, value), group)
    return whole.drop("_area", "_size")


def first_mode(rows: DataFrame, group: list[str], value: str, order: str = "ord") -> DataFrame:
    """The most frequent value of each group, the first seen on ties."""
    counted = rows.groupBy(*group, value).agg(F.count("*").alias("_n"), F.min(order).alias("_at"))
    return counted.groupBy(*group).agg(F.max(F.struct("_n", (-F.col("_at")).alias("_first"), value))[value].alias(value))


def median_color(characters: DataFrame, group: list[str]) -> DataFrame:
    """Channel medians of unit colours (struct ``rgb``)."""
    return characters.where("rgb is not null").groupBy(*group).agg(*(F.median(f"rgb.{c}").alias(c) for c in "rgb"))


def merge_orphans(lines: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Lines (line, text, box) of a page after a lone kana or Han box has joined the nearest line above that ends in
    such a character. Lines change as they are visited in order, so this is one pass for each page."""
    fields = [*(T.StructField(k, lines.schema[k].dataType) for k in keys), T.StructField("line", T.LongType()), T.StructField("into", T.LongType())]
    script = r"[ぁ-ヿ㐀-鿿]"

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        import re

        ends, lone = re.compile(script + r"\Z"), re.compile(script)
        held: dict[int, list] = {}
        into: dict[int, int] = {}
        for r in rows.sort_values(["line"]).itertuples():
            middle, high = (r.x0 + r.x1) / 2, max(1.0, r.bottom - r.top)
            best = None
            if r.boxes == 1 and lone.fullmatch(r.text.strip()):
                for line, (x0, _, x1, bottom, text) in held.items():
                    gap = r.top - bottom
                    near = 0 <= gap <= 0.65 * high and x0 - 0.5 * high <= middle <= x1 + 0.5 * high
                    if near and ends.search(text) and (best is None or gap < best[0]):
                        best = (gap, line)
            if best:
                line = best[1]
                x0, top, x1, bottom, text = held[line]
                held[line] = [min(x0, r.x0), min(top, r.top), max(x1, r.x1), max(bottom, r.bottom), text + r.text.strip()]
            else:
                line = r.line
                held[line] = [r.x0, r.top, r.x1, r.bottom, r.text.strip()]
            into[r.line] = line
        first = rows.iloc[0]
        return pd.DataFrame({**{k: first[k] for k in keys}, "line": list(into), "into": list(into.values())})

    return lines.groupBy(*keys).applyInPandas(page, T.StructType(fields))


def cell_groups(boxes: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Groups of boxes of the same table cell, numbered by their first box; boxes in order within."""
    cell = [f"cell.{n}" for n in Box._fields]
    grouped = boxes.where("cell is not null").groupBy(*keys, "cell").agg(F.array_sort(F.collect_list(F.struct("top", "x0", "id"))).alias("members"))
    order = Window.partitionBy(*keys).orderBy(F.col("members")[0]["top"], F.col("members")[0]["x0"], *cell)
    return grouped.withColumn("number", F.row_number().over(order))


def greedy_batches(blocks: DataFrame, most_characters: int = 2400, most_blocks: int = 24, keys: tuple[str, ...] = PAGE, text: str = "source_text") -> DataFrame:
    """Blocks with ``batch``, from 0 on each page: a batch closes before the block that would exceed either bound.
    A block beyond the bound stands alone. Folded in the JVM over each page's blocks in order."""
    row = F.struct("reading_order", "top", "x0", "id", F.length(text).alias("n"))
    pages = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    # The state holds where batches start; only a full batch adds to it, so a page of n blocks takes about n steps.
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("chars"), F.lit(0).alias("count"), F.array(F.lit(1)).alias("starts"))

    def step(s: Column, r: Column) -> Column:
        full = (s["count"] > 0) & ((s["chars"] + r["n"] > most_characters) | (s["count"] >= most_blocks))
        return F.struct(
            (s["at"] + 1).alias("at"),
            F.when(full, r["n"]).otherwise(s["chars"] + r["n"]).alias("chars"),
            F.when(full, F.lit(1)).otherwise(s["count"] + 1).alias("count"),
            F.when(full, F.array_append(s["starts"], s["at"] + 1)).otherwise(s["starts"]).alias("starts"),
        )

    starts = pages.withColumn("_starts", F.aggregate("_rows", start, step, lambda s: s["starts"]))
    own = starts.select(*keys, "_rows", "_starts", F.posexplode("_starts").alias("batch", "_from"))
    end = F.coalesce(F.get("_starts", F.col("batch") + 1), F.size("_rows") + 1)
    return own.select(*keys, F.explode(F.slice("_rows", F.col("_from"), end - F.col("_from"))).alias("_b"), "batch").select(*keys, F.col("_b.id").cast("string").alias("id"), "batch")


def greedy_batches_streamed(blocks: DataFrame, most_characters: int = 2400, most_blocks: int = 24, keys: tuple[str, ...] = PAGE, text: str = "source_text") -> DataFrame:
    """The same batches for pages too long to fold as one array: each task reads its pages' rows in order and keeps
    three numbers."""
    ordered = blocks.select(*keys, "reading_order", "top", "x0", "id", F.length(text).alias("n")).repartition(*keys).sortWithinPartitions(*keys, "reading_order", "top", "x0", "id")
    schema = T.StructType([*(T.StructField(k, blocks.schema[k].dataType) for k in keys), T.StructField("id", T.StringType()), T.StructField("batch", T.IntegerType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, batch, chars, count = None, 0, 0, 0
        for part in parts:
            out = []
            for now, n in zip(part[list(keys)].itertuples(index=False, name=None), part["n"], strict=True):
                if now != page:
                    page, batch, chars, count = now, 0, 0, 0
                elif chars + n > most_characters or count >= most_blocks:
                    batch, chars, count = batch + 1, 0, 0
                chars, count = chars + n, count + 1
                out.append(batch)
            yield part[[*keys, "id"]].assign(id=part["id"].astype(str), batch=pd.array(out, dtype="int32"))

    return ordered.mapInPandas(run, schema)


def first_seen(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key. One row a key is kept as rows are combined, before anything is dealt out."""
    packed = rows.select(F.struct(*order).alias("_at"), F.struct("*").alias("_row"), key.alias("_key"))
    return packed.groupBy("_key").agg(F.min_by("_row", "_at").alias("_row")).select("_row.*")


def strongest_of_neighbours(candidates: DataFrame, keys: list[str], reach: int = 2) -> DataFrame:
    """Of candidates (position, score) that follow each other within ``reach``, the strongest, the first on ties."""
    order = Window.partitionBy(*keys).orderBy("position")
    new = F.coalesce(F.col("position") - F.lag("position").over(order) > reach, F.lit(True)).cast("int")
    runs = candidates.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = runs.groupBy(*keys, "_run").agg(F.max(F.struct("score", (-F.col("position")).alias("_p"))).alias("_b"))
    return best.select(*keys, (-F.col("_b._p")).alias("position"), F.col("_b.score").alias("score"))
