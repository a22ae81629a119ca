"""Pages of HTML to rows: tables, links and label-value pairs, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Reader(HTMLParser):
    """Cells of table rows and links with their text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.links, self.row, self.cell, self.link, self.skip = [], [], None, None, None, 0
        self.title, self.in_title = "", False

    def handle_starttag(self, tag, attrs):
        if tag in ("td", "th", "tr") and self.cell is not None:  # cells and rows may be left open
            self.handle_endtag("td")
        if tag == "tr" and self.row:
            self.handle_endtag("tr")
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th"):
            self.cell = ""
            if self.row is None:
                self.row = []
        elif tag == "a":
            self.link = [dict(attrs).get("href") or "", ""]
        elif tag == "br" and self.cell is not None:
            self.cell += "\n"
        self.in_title = tag == "title" or (self.in_title and tag != "body")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th") and self.cell is not None:
            self.row.append(" ".join(self.cell.split()))
            self.cell = None
        elif tag in ("tr", "table") and self.row is not None:
            if self.cell is not None:
                self.handle_endtag("td")
            if self.row:
                self.rows.append(self.row)
            self.row = None
        elif tag == "a" and self.link is not None:
            self.links.append((self.link[0], " ".join(self.link[1].split())))
            self.link = None
        elif tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.skip:
            return
        if self.in_title:
            self.title += data
        if self.cell is not None:
            self.cell += data
        if self.link is not None:
            self.link[1] += data


def _read(text) -> _Reader:
    reader = _Reader()
    reader.feed(text or "")
    reader.close()
    return reader


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def table_rows(pages: pd.Series) -> pd.Series:
    """Cells of every table row that has any."""
    return pages.map(lambda x: _read(x).rows)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())])))
def links(pages: pd.Series) -> pd.Series:
    """Links with white space in their text collapsed, in order."""
    return pages.map(lambda x: [{"href": h, "text": t} for h, t in _read(x).links])


#: Pages whose links a worker holds at a time.
_PAGES = 64


def link_rows(df: DataFrame, page: str) -> DataFrame:
    """``df`` without ``page``, one row for each link of it: pos (from 0), href and text, as ``links`` gives them. Rows
    leave a worker after each ``_PAGES`` pages, so its memory depends neither on the table nor on the batch it is sent."""
    kept = [c for c in df.columns if c != page]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _PAGES):
                some = batch.slice(at, _PAGES)
                found = [(i, n, h, t) for i, x in enumerate(some.column(page)) for n, (h, t) in enumerate(_read(x.as_py()).links)]
                rows = pa.array([f[0] for f in found], pa.int64())
                own = [pa.array([f[k] for f in found], kind) for k, kind in ((1, pa.int32()), (2, pa.string()), (3, pa.string()))]
                yield pa.RecordBatch.from_arrays([*[some.column(c).take(rows) for c in kept], *own], names=[*kept, "pos", "href", "text"])

    schema = df.select(*kept, F.lit(0).alias("pos"), F.lit("").alias("href"), F.lit("").alias("text")).schema
    return df.mapInArrow(run, schema)


def labelled_values(rows: Column) -> Column:
    """Label-value rows of two or four cells as a map; the first value of a label stays."""
    from noticeflow.functions.text import label_key
    from noticeflow.sources.paged import name_value_map

    pair = lambda r, i: F.struct(label_key(F.get(r, F.lit(i))).alias("name"), F.get(r, F.lit(i + 1)).alias("value"))
    pairs = F.flatten(F.transform(F.filter(rows, lambda r: F.size(r).isin(2, 4)), lambda r: F.when(F.size(r) == 4, F.array(pair(r, 0), pair(r, 2))).otherwise(F.array(pair(r, 0)))))
    return name_value_map(F.filter(pairs, lambda p: p["name"] != ""))


def column_by_header(rows: Column, header: str) -> Column:
    """The values of the column whose header, without white space, is ``header``; the first row holds the headers."""
    from noticeflow.functions.text import squeeze

    at = F.array_position(F.transform(F.get(rows, F.lit(0)), squeeze), F.lit(header))
    body = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
    return F.when(at > 0, F.transform(body, lambda r: F.get(r, (at - 1).cast("int"))))


def mapped_rows(mapping: dict[str, str]):
    """A column function: one map per table row of a page, by a mapping of field to place.

    Places: ``column(n)`` the text of the n-th cell, ``link@href`` and ``link::text`` of the row's first link, and an
    address template with {name} places that stand for the row's other fields. Rows without any field are left out.
    """
    direct = {f: p for f, p in mapping.items() if "{" not in p}
    templates = {f: p for f, p in mapping.items() if "{" in p}

    @F.pandas_udf(T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    def rows(pages: pd.Series) -> pd.Series:
        def one(x):
            reader, out = _RowReader(), []
            reader.feed(x or "")
            reader.close()
            for cells, first in reader.found:
                fields = {}
                for field, place in direct.items():
                    if place.startswith("column("):
                        n = int(place[7:-1])
                        fields[field] = cells[n - 1] if n <= len(cells) else None
                    else:
                        fields[field] = (first or (None, None))[place == "link::text"]
                for field, template in templates.items():
                    known = {k: v for k, v in fields.items() if v}
                    fields[field] = template.format(**known) if all("{%s}" % k not in template or k in known for k in direct) else None
                if any(fields.values()):
                    out.append(fields)
            return out

        return pages.map(one)

    return rows


class _RowReader(_Reader):
    """Rows that have data cells, each with its first link."""

    def __init__(self):
        super().__init__()
        self.found, self.heads, self.before = [], False, 0

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        if tag == "tr":
            self.heads, self.before = True, len(self.links)
        elif tag == "td":
            self.heads = False

    def handle_endtag(self, tag):
        row = self.row
        super().handle_endtag(tag)
        if tag in ("tr", "table") and row and self.row is None and not self.heads:
            self.found.append((row, self.links[self.before] if len(self.links) > self.before else None))
