"""Scans. Outside parsers are functions that are passed in; where one fails, a page-size scan stands in, so a
document is never lost. Files are read one a task by ``binaryFile``: parsers need no lock."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions.geometry import Box, line_font_size, page_share
from foliograph.functions.text import ascii_lower, newline_count, strip, strip_markup

MOST_BYTES = 200 << 20
BLOCK_FIELDS = "page_index int, id string, source_text string, x0 double, top double, x1 double, bottom double, font_size double, source_type string"
ITEM = "struct<type:string,text:string,table_body:string,table_caption:array<string>,image_caption:array<string>,content:string,bbox:array<double>,page_idx:int>"
Parser = Callable[[bytes], list[dict]]


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def uploads(found: DataFrame) -> DataFrame:
    """Files with ``reject``: why one isn't taken, null if it is. Only the first bytes are looked at."""
    reason = F.when(F.col("length") == 0, "empty").when(F.col("length") > MOST_BYTES, "too_large").when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "not_pdf")
    return found.withColumn("reject", reason)


def native_blocks(found: DataFrame, parse: Parser, page_sizes: Parser | None = None) -> DataFrame:
    """Blocks of each file by a parser (bytes -> dicts of BLOCK_FIELDS); a file that it fails on gives its pages without
    text (``page_sizes``: bytes -> dicts of page_index, width, height as x1, bottom) under source_type ``page``."""
    names = [f.split()[0] for f in BLOCK_FIELDS.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, data in zip(part["path"], part["content"], strict=True):
                try:
                    own = parse(bytes(data))
                except Exception:  # noqa: BLE001 - any parser error means the degraded scan
                    own = [{**p, "source_type": "page"} for p in (page_sizes(bytes(data)) if page_sizes else [])]
                rows += [(path, *(b.get(n) for n in names)) for b in own]
            yield pd.DataFrame(rows, columns=["path", *names])

    return found.select("path", "content").mapInPandas(run, "path string, " + BLOCK_FIELDS)


def parsed_documents(found: DataFrame, service: Callable[[bytes, str], bytes], method: str) -> DataFrame:
    """path and reply (bytes) of a structure service; ``method`` is txt for native-first documents, else auto."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"path": part["path"], "reply": [service(bytes(c), method) for c in part["content"]]})

    return found.select("path", "content").mapInPandas(run, "path string, reply binary")


def search_json(value: object, keys: tuple[str, ...], good: Callable[[object], object]) -> object:
    """The first value under one of the keys, depth first, that ``good`` accepts; it may accept bare lists, too."""
    if isinstance(value, dict):
        for k in keys:
            if k in value and (hit := good(value[k])):
                return hit
        children = list(value.values())
    elif isinstance(value, list):
        if not keys or (hit := good(value)):
            return good(value)
        children = value
    else:
        return None
    for child in children:
        if hit := search_json(child, keys, good):
            return hit
    return None


def good_items(value: object) -> list[dict] | None:
    if not isinstance(value, list):
        return None
    kept = [v for v in value if isinstance(v, dict) and isinstance(v.get("bbox"), list) and isinstance(v.get("page_idx"), int) and not isinstance(v.get("page_idx"), bool)]
    return kept or None


def read_result(reply: bytes) -> tuple[str, list[dict]]:
    """Markdown and content list of a service's archive (shortest names first) or JSON; an error if both are empty."""
    if zipfile.is_zipfile(io.BytesIO(reply)):
        with zipfile.ZipFile(io.BytesIO(reply)) as z:
            pick = lambda end, but="\0": min((n for n in z.namelist() if n.lower().endswith(end) and not n.lower().endswith(but)), key=len, default=None)
            text, items = pick(".md"), pick("_content_list.json", "_content_list_v2.json")
            markdown = z.read(text).decode() if text else ""
            found = good_items(json.loads(z.read(items))) if items else None
    else:
        payload = json.loads(reply)
        markdown = search_json(payload, ("md_content", "markdown", "full_md"), lambda v: v if isinstance(v, str) and v.strip() else None) or ""
        found = search_json(payload, ("content_list", "content_list_data"), good_items)
    if not str(markdown).strip() and not found:
        raise ValueError("the service's result has neither text nor placed content")
    return str(markdown), found or []


def result_items(replies: DataFrame) -> DataFrame:
    """path, markdown and items (JSON array) of service replies."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [read_result(bytes(r)) for r in part["reply"]]
            yield pd.DataFrame({"path": part["path"], "markdown": [m for m, _ in got], "items": [json.dumps(i, ensure_ascii=False) for _, i in got]})

    return replies.mapInPandas(run, "path string, markdown string, items string")


def valid_items(items: Column) -> Column:
    """Items of a content list that have a place and a page."""
    parsed = F.from_json(items, f"array<{ITEM}>")
    return F.filter(parsed, lambda i: i["bbox"].isNotNull() & i["page_idx"].isNotNull())


def item_text(item: Column) -> Column:
    """The first of text, table body and content that says something without markup, else the captions."""
    said = lambda c: F.nullif(strip_markup(F.coalesce(c, F.lit(""))), F.lit(""))
    captions = F.array_join(F.concat(F.coalesce(item["table_caption"], F.array()), F.coalesce(item["image_caption"], F.array())), "\n")
    return F.coalesce(said(item["text"]), said(item["table_body"]), said(item["content"]), said(captions), F.lit(""))


def table_html(item: Column) -> Column:
    """A table body that has both its tags, else empty."""
    body = F.coalesce(item["table_body"], F.lit(""))
    return F.when(F.lower(body).contains("<table") & F.lower(body).contains("</table"), body).otherwise(F.lit(""))


def layout_from_items(docs: DataFrame, pages: DataFrame, items: str = "items") -> DataFrame:
    """One block for each item with text on an existing page; boxes come in thousandths of the page."""
    from foliograph.operators.blocks import parsed_region_type

    at = docs.select("doc_id", F.posexplode(valid_items(F.col(items))).alias("ord", "i"))
    rows = at.where(F.size("i.bbox") == 4).select("doc_id", "ord", F.col("i.page_idx").alias("page_index"), F.col("i.bbox").alias("b"), item_text(F.col("i")).alias("source_text"), parsed_region_type(F.coalesce("i.type", F.lit(""))).alias("region_type"), table_html(F.col("i")).alias("table_html")).where("source_text <> ''")
    placed = rows.join(pages.select("doc_id", "page_index", "width", "height"), ["doc_id", "page_index"])
    x = lambda i: (F.col("b")[i] / 1000 * F.col("width"))
    y = lambda i: (F.col("b")[i] / 1000 * F.col("height"))
    out = placed.select("doc_id", "page_index", "ord", "source_text", "region_type", "table_html", x(0).alias("x0"), y(1).alias("top"), x(2).alias("x1"), y(3).alias("bottom"))
    return out.withColumns({
        "id": F.format_string("p%04d-m%04d", F.col("page_index") + 1, F.col("ord") + 1),
        "font_size": line_font_size(F.col("bottom") - F.col("top"), newline_count(F.col("source_text"))),
        "fragment_confidence": F.lit(0.85), "source_type": F.lit("mineru"),
    })


def image_regions(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Embedded images large enough to hold text: 1 % of the page, 80 by 40 points; numbered by page."""
    from pyspark.sql import Window

    b = Box.flat()
    rows = images.join(pages.select("doc_id", "page_index", "width", "height"), ["doc_id", "page_index"])
    large = rows.where((page_share(b, F.col("width"), F.col("height")) >= 0.01) & (b.width >= 80) & (b.height >= 40))
    n = F.row_number().over(Window.partitionBy("doc_id", "page_index").orderBy("ord"))
    return large.withColumn("id", F.format_string("p%04d-i%04d", F.col("page_index") + 1, n)).drop("width", "height")


def full_pages(docs: DataFrame, sizes: str = "page_sizes") -> DataFrame:
    """One region for each page of a document."""
    rows = docs.select("doc_id", F.posexplode(sizes).alias("page_index", "s"))
    zero = F.lit(0.0)
    return rows.select("doc_id", "page_index", F.format_string("p%04d-full", F.col("page_index") + 1).alias("id"), zero.alias("x0"), zero.alias("top"), F.col("s.width").alias("x1"), F.col("s.height").alias("bottom"))


def rendered_regions(found: DataFrame, regions: DataFrame, render: Callable[[bytes, list[dict], int], list[bytes]], resolution: int = 144) -> DataFrame:
    """Crops (PNG) of the regions of each file by a renderer; an error names the region that can't be cut."""
    rows = regions.groupBy("path").agg(F.collect_list(F.struct("id", "page_index", *Box._fields)).alias("regions")).join(found.select("path", "content"), "path")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, asked, data in zip(part["path"], part["regions"], part["content"], strict=True):
                asked = [dict(a) for a in asked]
                crops = render(bytes(data), asked, resolution)
                if len(crops) != len(asked):
                    raise ValueError(f"{path}: {len(asked)} regions, {len(crops)} crops")
                for a, png in zip(asked, crops, strict=True):
                    if not png:
                        raise ValueError(f"{path}: region {a['id']} has no crop")
                    out.append((path, a["id"], a["page_index"], png))
            yield pd.DataFrame(out, columns=["path", "id", "page_index", "image_png"])

    return rows.select("path", "regions", "content").mapInPandas(run, "path string, id string, page_index int, image_png binary")


def newest_first(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), "job_id")


def placed(jobs: DataFrame) -> DataFrame:
    """Jobs with ``place`` in the list of the newest first, from 1: numbered within each day and offset by the later days'
    counts, so the list is never in one task."""
    from pyspark.sql import Window

    days = jobs.withColumn("_day", F.to_date("created_at"))
    later = Window.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    before = days.groupBy("_day").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(later), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_day").orderBy(F.desc("created_at"), "job_id"))
    before = before.withColumnRenamed("_day", "_of")
    return days.withColumn("_at", within).join(before, F.col("_day").eqNullSafe(F.col("_of"))).withColumn("place", F.col("_at") + F.col("_before")).drop("_day", "_of", "_at", "_before")


def glossary_places(terms: DataFrame) -> DataFrame:
    """Terms with ``place`` in the list of the last changed first, then by source up to ASCII case: numbered among those
    changed at the same time and offset by the later ones' counts, combined before they are summed."""
    from pyspark.sql import Window

    later = Window.orderBy(F.desc("_of")).rowsBetween(Window.unboundedPreceding, -1)
    before = terms.groupBy(F.col("updated_at").alias("_of")).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(later), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("updated_at").orderBy(ascii_lower(F.col("source_text")), "source_text"))
    return terms.withColumn("_at", within).join(before, F.col("updated_at").eqNullSafe(F.col("_of"))).withColumn("place", (F.col("_at") + F.col("_before")).cast("int")).drop("_of", "_at", "_before")


def candidates(rows: DataFrame, status: str | None = None) -> DataFrame:
    """All glossary candidates, or those of a status; newest first."""
    return (rows if status is None else rows.where(F.col("status") == status)).orderBy(F.desc("created_at"), "id")


def archive_members(rows: DataFrame, key: str, name: str, end: str, but: str | None = None) -> DataFrame:
    """The shortest name of each archive with an ending (and without another)."""
    fits = F.lower(name).endswith(end)
    fits = fits & ~F.lower(name).endswith(but) if but else fits
    return rows.where(fits).groupBy(key).agg(F.min(F.struct(F.length(name).alias("n"), F.col(name).alias("name")))["name"].alias("name"))


def spoken(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit("")))
