"""Tables from files: CSV without guessed types, Markdown, JSON, BibTeX, the newest file of a series."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid.functions.keys import na_to_null, trimmed
from lodegrid.session import scratch, short_batches


def csv(spark: SparkSession, path: str, columns: list[str] | None = None, blanks: bool = False, missing_tokens: bool = False, required: list[str] = ()) -> DataFrame:
    """All columns are strings. ``blanks`` makes nulls empty, ``missing_tokens`` makes N/A and the like null."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    df = reader.csv(path)
    if lost := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} has no column {', '.join(lost)}")
    if missing_tokens:
        df = df.select(*[na_to_null(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return df.na.fill("") if blanks else df


def seed_tables(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """Tables kept by hand, one file or folder a seed (<seed>.csv): columns as strings, and the seed."""
    rows = spark.read.option("recursiveFileLookup", True).option("header", True).option("multiLine", True).option("escape", '"').schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(folder)
    return rows.select(F.regexp_extract(F.input_file_name(), r"/([^/]+)\.csv(/|$)", 1).alias("seed"), *columns)


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed without regard to case."""
    low = {k.lower(): v for k, v in names.items()}
    return df.toDF(*[low.get(c.lower().strip(), c) for c in df.columns])


def export_table(spark: SparkSession, path: str, names: dict[str, str], start: str = "page_start", end: str = "page_end") -> DataFrame:
    """A web export: renamed, with first and last page joined to pageRange where both are known."""
    df = renamed(csv(spark, path), names)
    if start in df.columns and end in df.columns:
        both = F.nullif(F.col(start), F.lit("")).isNotNull() & F.nullif(F.col(end), F.lit("")).isNotNull()
        df = df.withColumn("pageRange", F.when(both, F.concat_ws("-", start, end)).otherwise(F.coalesce(start, F.lit(""))))
    return df


def newest(spark: SparkSession, folder: str, prefix: str) -> str:
    """The path of the last name with the prefix: names carry their date."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    names = sorted(s.getPath().toString() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path) if s.getPath().getName().startswith(prefix))
    if not names:
        raise FileNotFoundError(f"{folder}/{prefix}*")
    return names[-1]


def json_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records; a missing or broken file is an empty table."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def workbook_rows(content: bytes, sheet: str) -> list[list[str | None]]:
    """The cells of a sheet of an .xlsx workbook as strings, row by row: shared and inline strings, numbers as written, blanks as None."""
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        part = lambda name: ElementTree.fromstring(z.read(name))
        link = next((s.get(_LINK) for s in part("xl/workbook.xml").iter(f"{_MAIN}sheet") if s.get("name") == sheet), None)
        if link is None:
            raise ValueError(f"the workbook has no sheet {sheet}")
        target = next(r.get("Target") for r in part("xl/_rels/workbook.xml.rels") if r.get("Id") == link)
        text = lambda x: "".join(t.text or "" for t in x.iter(f"{_MAIN}t"))
        shared = [text(x) for x in part("xl/sharedStrings.xml").iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        rows = []
        for row in part(target.lstrip("/") if target.startswith("/") else f"xl/{target}").iter(f"{_MAIN}row"):
            cells: list[str | None] = []
            for c in row.iter(f"{_MAIN}c"):
                letters = re.match("[A-Z]+", c.get("r") or "")
                at = reduce(lambda n, x: 26 * n + ord(x) - 64, letters.group(), 0) - 1 if letters else len(cells)
                cells += [None] * (at + 1 - len(cells))
                v = c.find(f"{_MAIN}v")
                value = text(c) if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                cells[at] = value or None
            rows.append(cells)
    return rows


def sheets(spark: SparkSession, path: str, names: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Sheets of a workbook by name, with the given columns as strings; the first row names the columns. A workbook is one file, parsed in one task."""
    book = spark.read.format("binaryFile").load(path).select("content")

    def reader(sheet: str, columns: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for content in pdf["content"]:
                    header, *rows = workbook_rows(bytes(content), sheet) or [[]]
                    at = [header.index(c) for c in columns]
                    yield pd.DataFrame([[r[k] if k < len(r) else None for k in at] for r in rows], columns=columns, dtype=object)

        return run

    return {n: book.mapInPandas(reader(n, c), ", ".join(f"`{x}` string" for x in c)) for n, c in names.items()}


def passages(spark: SparkSession, path: str) -> DataFrame:
    """file, passage (P and digits), text of Markdown files with "## P001" blocks; text is what stands up to the next block."""
    files = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), "value")
    return passage_blocks(files, "file", "value")


def passage_blocks(df: DataFrame, file: str, text: str) -> DataFrame:
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.col(text)), r"\n(?=## P\d)"), lambda b: b.rlike(r"^## P\d"))
    blocks = df.select(F.col(file).alias("file"), F.explode(parts).alias("b"))
    return blocks.select("file", F.regexp_extract("b", r"^## (P\d+)", 1).alias("passage"), trimmed(F.regexp_replace("b", r"^## P\d+[^\n]*\n?", "")).alias("text"))


def sections(df: DataFrame, file: str, text: str, level: int = 2) -> DataFrame:
    """file, at, title, body of Markdown headings of a level."""
    mark = "#" * level
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.col(text)), rf"\n(?={mark} )"), lambda b: b.startswith(f"{mark} "))
    out = df.select(F.col(file).alias("file"), F.posexplode(parts).alias("at", "b"))
    return out.select("file", "at", F.trim(F.regexp_extract("b", rf"^{mark} ([^\n]*)", 1)).alias("title"), trimmed(F.regexp_replace("b", r"^[^\n]*\n?", "")).alias("body"))


def bold_field(body: Column, name: str) -> Column:
    """What follows "**name:**" up to the next bold field or heading."""
    return trimmed(F.regexp_extract(body, rf"(?s)\*\*{name}:?\*\*:?\s*(.*?)(?=\n\*\*|\n#|\z)", 1))


def table_labels(sections_: DataFrame) -> DataFrame:
    """label, section: first cells of Markdown tables in section bodies; a label's first section counts."""
    rows = sections_.select("file", "at", "title", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?m)^\|\s*([^|\n]+?)\s*\|"), 1)).alias("k", "label"))
    rows = rows.filter(~F.col("label").rlike(r"^:?-+:?$"))
    return rows.groupBy("label").agg(F.min_by("title", F.struct("file", "at", "k")).alias("section"))


_ENTRY = re.compile(r"@(\w+)\s*\{\s*([^,\s}]+)\s*,")
_FIELD = re.compile(r"(\w+)\s*=\s*")
BIBTEX_SCHEMA = "file string, at int, type string, citekey string, raw string, fields map<string, string>"


def _closing(text: str, at: int) -> int:
    """Place of the brace that closes the one at ``at``; the last place if none does."""
    depth = 0
    for m in re.compile("[{}]").finditer(text, at):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.start()
    return len(text) - 1


def bibtex_entries(text: str) -> list[dict]:
    """type, citekey, raw and fields of the entries of a file: values in braces of any depth, quotes, or bare."""
    return list(each_entry(text))


def each_entry(text: str) -> Iterator[dict]:
    """The same one by one."""
    at = 0
    while m := _ENTRY.search(text, at):
        end = _closing(text, text.index("{", m.start()))
        fields, k = {}, m.end()
        while (f := _FIELD.search(text, k, end)) is not None:
            if text[f.end()] == "{":
                stop = _closing(text, f.end())
                value = text[f.end() + 1 : stop]
            elif text[f.end()] == '"':
                stop = text.find('"', f.end() + 1, end)
                stop = end if stop < 0 else stop
                value = text[f.end() + 1 : stop]
            else:
                stop = min(x for x in (text.find(",", f.end(), end), end) if x >= 0)
                value = text[f.end() : stop]
            fields[f.group(1).lower()] = value.strip()
            k = stop + 1
        yield {"type": m.group(1).lower(), "citekey": m.group(2), "raw": text[m.start() : end + 1], "fields": fields}
        at = max(end + 1, m.end())


#: Bytes of a block. A file of more is cut into blocks, and parsed by as many tasks as there are safe places to part it.
BLOCK_BYTES = 1 << 20

#: Entries that a task hands on at once, of however many files; or as many as have BLOCK_BYTES characters.
ENTRIES_AT_ONCE = 2000


def _blocks(files: DataFrame, path: str) -> DataFrame:
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("content") - 1) / BLOCK_BYTES).cast("int")), lambda k: F.substring(F.col("content"), k * BLOCK_BYTES + 1, F.lit(BLOCK_BYTES)))
    files.select("path", F.posexplode(cut).alias("block", "bytes")).write.parquet(path)
    return files.sparkSession.read.parquet(path)


def _depths(blocks: DataFrame) -> DataFrame:
    """path, block, base (how deep in braces the block begins) and least (the lowest depth before it): sums over the blocks before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            depths = [(int(d[-1]), int(d.min())) for d in map(_running, pdf["bytes"])]  # one block's at a time
            yield pd.DataFrame({"path": pdf["path"], "block": pdf["block"], "total": [t for t, _ in depths], "low": [low for _, low in depths]})

    own = blocks.mapInPandas(run, "path string, block int, total long, low long")
    order = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    based = own.withColumn("base", F.coalesce(F.sum("total").over(order), F.lit(0)))
    return based.select("path", "block", "base", F.least(F.lit(0), F.coalesce(F.min(F.col("base") + F.col("low")).over(order), F.lit(0))).alias("least"))


def _running(content: bytes) -> np.ndarray:
    """Depth in braces before each byte and at the end, from 0."""
    b = np.frombuffer(content, dtype=np.uint8)
    return np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum((b == 123).astype(np.int8) - (b == 125), dtype=np.int64)])


def bibtex_segments(files: DataFrame) -> DataFrame:
    """path, segment, content: files (path, content) parted where no entry goes on, each segment from such a place to the next.

    An entry lasts until the depth in braces falls back to what it was before. Where the depth is as low as it has ever been in
    the file, no entry is open, whatever stray braces stand between entries; and before an @ no head of an entry is cut. The first such
    place of each block parts the file. Depths are running sums over blocks, so blocks are looked at side by side.
    """
    blocks = _blocks(files, scratch(files.sparkSession))

    def cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for content, base, least in zip(pdf["bytes"], pdf["base"], pdf["least"], strict=True):
                depth = _running(content)[:-1] + base
                lowest = np.minimum(np.minimum.accumulate(depth), least)
                at = np.flatnonzero((depth == lowest) & (np.frombuffer(content, dtype=np.uint8) == 64))
                found.append(int(at[0]) if len(at) else -1)
            yield pd.DataFrame({"path": pdf["path"], "block": pdf["block"], "cut": found})

    path = scratch(files.sparkSession)
    blocks.join(_depths(blocks), ["path", "block"]).mapInPandas(cuts, "path string, block int, cut int").write.parquet(path)
    starts = F.sum((F.col("cut") >= 0).cast("int")).over(Window.partitionBy("path").orderBy("block"))
    placed = files.sparkSession.read.parquet(path).withColumn("segment", starts)  # no bytes: a row a block
    both = blocks.join(placed, ["path", "block"])
    cut = F.col("cut")
    head = F.struct((F.col("segment") - (cut >= 0).cast("int")).alias("segment"), F.when(cut >= 0, F.expr("substring(bytes, 1, cut)")).otherwise(F.col("bytes")).alias("bytes"))
    tail = F.struct(F.col("segment"), F.when(cut >= 0, F.expr("substring(bytes, cut + 1)")).alias("bytes"))
    pieces = both.select("path", "block", F.posexplode(F.array(head, tail)).alias("part", "x")).select("path", "block", "part", "x.*").filter("bytes is not null")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part", "bytes"))), lambda x: x["bytes"].cast("string")), "")
    return pieces.groupBy("path", "segment").agg(whole.cast("binary").alias("content"))


_TEXT = pa.string()
_ENTRIES = pa.schema([("path", _TEXT), ("segment", pa.int64()), ("large", pa.bool_()), ("k", pa.int32()), ("type", _TEXT), ("citekey", _TEXT), ("raw", _TEXT), ("fields", pa.map_(_TEXT, _TEXT))])


def _entries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of segments (path, segment, content, utf8, large). Those of many short ones go on together: a batch costs a millisecond, whatever it holds."""
    rows, held = [], 0
    for batch in batches:
        for name, segment, content, utf8, large in zip(*(batch[c] for c in ("path", "segment", "content", "utf8", "large")), strict=True):
            of = {"path": name.as_py(), "segment": segment.as_py(), "large": large.as_py()}
            for k, e in enumerate(each_entry(content.as_py().decode("utf-8" if utf8.as_py() else "latin-1"))):
                rows.append({**of, "k": k, **e, "fields": list(e["fields"].items())})
                held += len(e["raw"])
                if len(rows) >= ENTRIES_AT_ONCE or held >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _ENTRIES)
                    rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _ENTRIES)


def parsed_bibtex(files: DataFrame) -> DataFrame:
    """Entries of files (path, content), UTF-8 or else Latin-1, numbered in each file. Balanced braces aren't regular, so
    segments of files are parsed in Python: a file of up to BLOCK_BYTES is one, a larger one many."""
    short_batches(files.sparkSession)
    files = files.select("path", "content").filter("content is not null")
    small = files.filter(F.length("content") <= BLOCK_BYTES).select("path", F.lit(0).cast("long").alias("segment"), "content", F.is_valid_utf8(F.col("content").cast("string")).alias("utf8"), F.lit(False).alias("large"))
    cores = files.sparkSession.sparkContext.defaultParallelism
    if small.rdd.getNumPartitions() < cores:  # short texts of a table may all be in one part of its file
        small = small.repartition(cores)
    large = files.filter(F.length("content") > BLOCK_BYTES)
    segments, any_large = small, not large.isEmpty()
    if any_large:
        path = scratch(files.sparkSession)
        bibtex_segments(large).withColumn("valid", F.is_valid_utf8(F.col("content").cast("string"))).write.parquet(path)
        parts = files.sparkSession.read.parquet(path)
        kinds = parts.groupBy("path").agg(F.min("valid").alias("utf8"))  # a file is of one kind throughout
        segments = small.unionByName(parts.join(kinds, "path").select("path", "segment", "content", "utf8", F.lit(True).alias("large")).repartition("path", "segment"))

    path = scratch(files.sparkSession)
    segments.mapInArrow(_entries_of, "path string, segment long, large boolean, k int, type string, citekey string, raw string, fields map<string, string>").write.parquet(path)
    entries = files.sparkSession.read.parquet(path)
    first = F.lit(0)  # a file that is one segment has nothing to count
    if any_large:
        before = Window.partitionBy("path").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
        firsts = entries.filter("large").groupBy("path", "segment").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))  # a row a segment
        entries = entries.filter("large").join(firsts.select("path", "segment", "first"), ["path", "segment"]).unionByName(entries.filter("not large").withColumn("first", F.lit(0).cast("long")))
        first = F.col("first")
    return entries.select(F.element_at(F.split("path", "/"), -1).alias("file"), (first + F.col("k")).cast("int").alias("at"), "type", "citekey", "raw", "fields")


def bibtex(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all .bib files of a folder."""
    return parsed_bibtex(spark.read.format("binaryFile").option("pathGlobFilter", "*.bib").load(path))


def file_fields(entries: DataFrame) -> DataFrame:
    """citekey, file of entries that name attached files; the last entry of a key counts."""
    return entries.filter("fields['file'] is not null").groupBy("citekey").agg(F.max_by(F.col("fields")["file"], F.struct("file", "at")).alias("attached"))


def from_mark(text: Column, mark: str) -> Column:
    """The text from a mark on; empty without it."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at, F.length(text))).otherwise("")


def paged_source(fetch, schema: str, page_rows: int, name: str = "paged"):
    """A data source over a service that answers by pages: fetch(offset, rows) gives (list of tuples, number of all rows).

    Pages are partitions, read in parallel. Register it with spark.dataSource.register and read with format(name).
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def partitions(self):
            _, total = fetch(0, 1)
            return [InputPartition(k) for k in range(0, total, page_rows)]

        def read(self, partition):
            yield from fetch(partition.value, page_rows)[0]

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    return Paged
