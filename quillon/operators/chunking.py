"""Documents to chunks: headings, entries, paragraphs, long blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions.text import let, strip

LEVELS = 4


def lines_of(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, pos, line), pos from 0."""
    return docs.select(F.col(doc), F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def heading_sections(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, section, path, body): text between headings under the titles that hold there.

    A title holds until a heading of its own or a higher level follows: the
    last title of a level counts if it comes after the last one of every level
    above it.  Sections without text are left out; text before any heading has
    an empty path.
    """
    w = Window.partitionBy(doc).orderBy("pos")
    marks = F.regexp_extract("line", r"^(#{1,4})\s+\S", 1)
    level, title = F.length(marks), strip(F.regexp_replace("line", r"^#{1,4}\s+", ""))
    rows = lines.withColumn("level", level).withColumn("title", title)
    for n in range(1, LEVELS + 1):
        at = F.when(F.col("level") == n, F.struct("pos", "title"))
        rows = rows.withColumn(f"last{n}", F.last(at, ignorenulls=True).over(w))
    rows = rows.withColumn("section", F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).over(w))
    holds = []
    for n in range(1, LEVELS + 1):
        alive = F.col(f"last{n}").isNotNull()
        for above in range(1, n):
            alive &= F.coalesce(F.col(f"last{n}.pos") > F.col(f"last{above}.pos"), F.lit(True))
        holds.append(F.when(alive, F.col(f"last{n}.title")))
    rows = rows.where("level = 0").withColumn("path", F.array_join(F.array_compact(F.array(*holds)), " / "))
    text = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line)
    body = rows.groupBy(doc, "section").agg(F.max("path").alias("path"), strip(F.array_join(text, "\n")).alias("body"))
    return body.where("body <> ''").withColumn("section", F.col("section").cast("long"))


def entry_blocks(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, block, entry, body): blocks that begin with an entry mark 【name】; text before the first is block 0."""
    w = Window.partitionBy(doc).orderBy("pos")
    entry = F.regexp_extract("line", "^【([^】]+)】", 1)
    rows = lines.withColumn("entry", entry).withColumn("block", F.sum(F.when(entry != "", 1).otherwise(0)).over(w))
    text = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line)
    body = rows.groupBy(doc, "block").agg(F.max("entry").alias("entry"), strip(F.array_join(text, "\n")).alias("body"))
    return body.where("body <> ''").withColumn("block", F.col("block").cast("long"))


def _between(lines: Column, marks: Column, make) -> Column:
    """Array of ``make(mark, number, text)`` of marks with a ``pos``, the text being the lines from one mark's ``first`` to the next one's ``pos``, stripped; blank ones are left out."""
    def text(m: Column, i: Column) -> Column:
        end = F.coalesce(F.get(marks, i + 1)["pos"], F.size(lines))
        return strip(F.array_join(F.slice(lines, m["first"] + 1, F.greatest(F.lit(0), end - m["first"])), "\n"))

    return F.filter(F.transform(marks, lambda m, i: make(m, i, text(m, i))), lambda x: x["body"] != "")


def sections_of(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, section, path, body): what ``heading_sections`` gives, folded within each row, so that no line is shuffled."""
    titles, mark = "array<string>", "struct<pos:int,first:int,path:string>"

    def headings(lines: Column) -> Column:
        told = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), F.length(F.regexp_extract(x, r"^(#{1,4})\s+\S", 1)).alias("level"), strip(F.regexp_replace(x, r"^#{1,4}\s+", "")).alias("title")))
        return F.filter(told, lambda h: h["level"] > 0)

    def step(done: Column, h: Column) -> Column:
        held = F.transform(F.sequence(F.lit(1), F.lit(LEVELS)), lambda n: F.when(n < h["level"], F.get(done["held"], n - 1)).when(n == h["level"], h["title"]))
        return let(held, lambda t: F.struct(t.cast(titles).alias("held"), F.concat(done["marks"], F.array(F.struct(h["pos"].alias("pos"), (h["pos"] + 1).alias("first"), F.array_join(t, " / ").alias("path")).cast(mark))).alias("marks")))

    def sections(lines: Column) -> Column:
        start = F.struct(F.array_repeat(F.lit(None).cast("string"), LEVELS).alias("held"), F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("first"), F.lit("").alias("path")).cast(mark)).alias("marks"))
        make = lambda m, i, body: F.struct(i.cast("long").alias("section"), m["path"].alias("path"), body.alias("body"))
        return let(F.aggregate(headings(lines), start, step)["marks"], lambda marks: _between(lines, marks, make))

    return docs.select(F.col(doc), F.explode(let(F.split(text, "\n"), sections)).alias("_s")).select(doc, "_s.section", "_s.path", "_s.body")


def entries_of(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, block, entry, body): what ``entry_blocks`` gives, within each row."""
    def blocks(lines: Column) -> Column:
        named = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("pos"), i.alias("first"), F.regexp_extract(x, "^【([^】]+)】", 1).alias("entry"))), lambda m: m["entry"] != "")
        start = F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).alias("first"), F.lit("").alias("entry")))
        make = lambda m, i, body: F.struct(i.cast("long").alias("block"), m["entry"].alias("entry"), body.alias("body"))
        return let(F.concat(start, named), lambda marks: _between(lines, marks, make))

    return docs.select(F.col(doc), F.explode(let(F.split(text, "\n"), blocks)).alias("_s")).select(doc, "_s.block", "_s.entry", "_s.body")


def template_sections(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, name, body) of a file whose sections begin with ``## name``."""
    w = Window.partitionBy(doc).orderBy("pos")
    name = F.regexp_extract("line", r"^##\s+(\S.*)$", 1)
    rows = lines.withColumn("name", F.last(F.when(name != "", strip(name)), ignorenulls=True).over(w)).where((name == "") & F.col("name").isNotNull())
    text = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line)
    return rows.groupBy(doc, "name").agg(strip(F.array_join(text, "\n")).alias("body"))


def pack_paragraphs(paragraphs: Column, most: int = 500, gap: str = "\n\n") -> Column:
    """Greedy: a paragraph joins the current pack unless that would pass ``most``; a longer one is a pack of its own."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
    kind = "struct<done:array<string>,cur:string>"

    def step(s: Column, p: Column) -> Column:
        fits = (s["cur"] != "") & (F.length(s["cur"]) + len(gap) + F.length(p) <= most)
        done = F.when(fits | (s["cur"] == ""), s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"])))
        return F.struct(done.alias("done"), F.when(fits, F.concat(s["cur"], F.lit(gap), p)).otherwise(p).alias("cur")).cast(kind)

    return F.aggregate(
        F.filter(F.transform(paragraphs, strip), lambda p: p != ""), start.cast(kind), step, lambda s: F.when(s["cur"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"])))
    )


def long_split(text: Column, size: int = 600, overlap: int = 80) -> Column:
    """Windows of ``size`` that overlap; a text within the size is one window. The plain form, by position alone."""
    stride = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / stride)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * stride + 1, F.lit(size)))


# Where a long block may be cut, the best places first.
SEPARATORS = ("\n\n", "\n", "。", "；", "，", ",", " ", "")


def recursive_split(text: str, size: int = 600, overlap: int = 80, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of ``size`` characters at most, cut at the first separator that occurs, its pieces split further if too long.

    Neighbouring pieces are put together while they fit, and a piece begins
    with as much of the end of the one before as ``overlap`` allows.
    """
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, finer = separators[at], separators[at + 1 :]
    parts = list(text) if mark == "" else [p if not i else mark + p for i, p in enumerate(text.split(mark))]
    out: list[str] = []
    window: list[str] = []

    def flush() -> None:
        joined = "".join(window).strip()
        if joined:
            out.append(joined)

    for part in (p for p in parts if p):
        if len(part) > size and finer:
            flush()
            window = []
            out.extend(recursive_split(part, size, overlap, finer))
            continue
        if sum(map(len, window)) + len(part) > size:
            flush()
            while window and (sum(map(len, window)) > overlap or sum(map(len, window)) + len(part) > size):
                window.pop(0)
        window.append(part)
    flush()
    return out


def split_blocks(docs: DataFrame, doc: str, text: str, size: int = 600, overlap: int = 80) -> DataFrame:
    """(doc, seq, piece) by ``recursive_split``, a bounded part of a batch at once: a worker holds the pieces of about half a megabyte of text, or of one longer text."""
    from collections.abc import Iterator

    import pyarrow as pa

    from quillon.functions.batches import parts

    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            found = [(row, i, p) for row, t in enumerate(part.column("text")) for i, p in enumerate(recursive_split(t.as_py() or "", size, overlap), 1)]
            rows, seqs, pieces = zip(*found, strict=True) if found else ((), (), ())
            doc_of = part.column("doc").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([doc_of, pa.array(seqs, pa.int64()), pa.array(pieces, part.schema.field("text").type)], ["doc", "seq", "piece"])

    found = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).mapInArrow(run, f"doc {kind}, seq long, piece string")
    return found.withColumnRenamed("doc", doc)
