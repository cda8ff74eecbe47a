"""HTML tables as logical cells: a UDTF, one table in, a row for each cell out."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

SCHEMA = StructType(
    [StructField(n, IntegerType()) for n in ("row", "column", "row_span", "column_span")]
    + [StructField("source_text", StringType()), StructField("is_header", BooleanType())]
    + [StructField(n, IntegerType()) for n in ("rows", "columns")]
)
MOST_SPAN = 100


def has_table(html: str | None) -> bool:
    low = (html or "").lower()
    return "<table" in low and "</table" in low


class _Rows(HTMLParser):
    """Rows of (text parts, row span, column span, header). A cell counts when it ends, in the row that is open then;
    a cell that never ends and a row without cells do not."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list]] = [[]]
        self.cell: list | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            at = dict(attrs)
            self.cell = [[], _span(at.get("rowspan")), _span(at.get("colspan")), tag == "th"]
        elif tag == "br" and self.cell is not None:
            self.cell[0].append("\n")

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell[0].append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append(self.cell)
            self.cell = None


def _span(value: str | None) -> int:
    try:
        return min(max(int(value or 1), 1), MOST_SPAN)
    except ValueError:
        return 1


def cell_text(parts: list[str]) -> str:
    lines = (" ".join(line.split()) for line in "".join(parts).splitlines())
    return "\n".join(line for line in lines if line)


def grid(html: str | None) -> tuple[list[dict], int, int]:
    """Cells with the row and column that they take when earlier spans have taken theirs; rows and columns in all."""
    if "<table" not in (html or "").lower():
        return [], 0, 0
    parser = _Rows()
    parser.feed(html)
    parser.close()
    taken: set[tuple[int, int]] = set()
    out: list[dict] = []
    rows = columns = 0
    for y, row in enumerate(r for r in parser.rows if r):
        x = 0
        for parts, down, across, header in row:
            while (y, x) in taken:
                x += 1
            taken.update((y + i, x + j) for i in range(down) for j in range(across))
            out.append({"row": y, "column": x, "row_span": down, "column_span": across, "source_text": cell_text(parts), "is_header": header or y == 0})
            x += across
            rows, columns = max(rows, y + down), max(columns, x)
    return out, rows, columns


@udtf(returnType=SCHEMA)
class TableCells:
    """``SELECT t.*, c.* FROM tables t, LATERAL table_cells(t.html) c`` once registered."""

    def eval(self, html: str):  # noqa: A003
        cells, rows, columns = grid(html)
        for c in cells:
            yield c["row"], c["column"], c["row_span"], c["column_span"], c["source_text"], c["is_header"], rows, columns


def register(spark) -> None:
    spark.udtf.register("table_cells", TableCells)
