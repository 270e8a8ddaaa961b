"""Reports of summaries: Markdown, HTML and text for a terminal, written whole or not at all."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from html import escape

from pyspark.sql import DataFrame, SparkSession

from quillon.sources.settings import markdown_table, padded, width
from quillon.streaming.progress import put_text

#: Rows that a table of a report may have; more is an error, as a report is no place for data.
MOST_ROWS = 10_000
_PAGE = '<!DOCTYPE html><html><head><meta charset="utf-8"><title>{0}</title><style>table{{border-collapse:collapse}}td,th{{border:1px solid #999;padding:2px 8px}}</style></head><body><h1>{0}</h1>\n{1}\n</body></html>'


def _rows(df: DataFrame) -> list[tuple]:
    rows = [tuple(r) for r in df.limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a table of a report has more than {MOST_ROWS} rows")
    return rows


def shown(value: object) -> str:
    return "—" if value is None else f"{value:.4f}" if isinstance(value, float) else str(value)


def html_table(columns: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{escape(shown(v))}</{tag}>" for v in values) + "</tr>"
    return "<table>\n" + "\n".join([cells("th", columns), *(cells("td", r) for r in rows)]) + "\n</table>"


def text_table(columns: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    """Columns of even width, ideographs counting twice."""
    told = [list(columns), *([shown(v).replace("\n", " ") for v in r] for r in rows)]
    widths = [max(width(r[i]) for r in told) for i in range(len(columns))]
    return "\n".join("  ".join(padded(v, w) for v, w in zip(r, widths, strict=True)).rstrip() for r in told)


def write_report(spark: SparkSession, path: str, title: str, tables: Mapping[str, DataFrame], notes: Sequence[str] = ()) -> str:
    """Writes ``path``.md and ``path``.html of the tables by their headings, and returns the text for a terminal.

    All tables are collected before anything is written; each file is replaced in one rename.
    """
    found = {name: (df.columns, _rows(df)) for name, df in tables.items()}
    parts = [f"# {title}", *notes, *(f"## {name}\n\n{markdown_table(c, r)}" for name, (c, r) in found.items())]
    body = "\n".join([*(f"<p>{escape(n)}</p>" for n in notes), *(f"<h2>{escape(name)}</h2>\n{html_table(c, r)}" for name, (c, r) in found.items())])
    put_text(spark, f"{path}.md", "\n\n".join(parts) + "\n")
    put_text(spark, f"{path}.html", _PAGE.format(escape(title), body))
    return "\n\n".join([title, *notes, *(f"{name}\n{text_table(c, r)}" for name, (c, r) in found.items())])
