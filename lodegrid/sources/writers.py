"""Files from tables: quoted CSV, provenance, BibTeX, passages, requests."""

from __future__ import annotations

import io
import json
import subprocess
import zipfile
from datetime import UTC, datetime
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegrid.functions.text import escaped_for_bibtex
from lodegrid.operators.windows import numbered


def quoted_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def workbook_bytes(tables: dict[str, list[list[str | None]]]) -> bytes:
    """An .xlsx workbook of small tables (rows of strings, the first one the header) with inline strings."""
    letter = lambda k: (letter(k // 26 - 1) if k > 25 else "") + chr(65 + k % 26)
    main, rels = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/package/2006/relationships"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda r, k, v: "" if v is None else f'<c r="{letter(k)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        ns = range(1, len(tables) + 1)
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{kind}.worksheet+xml"/>' for n in ns)
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{rels}"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{rels}">' + "".join(f'<Relationship Id="r{n}" Type="{office}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in ns) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name={quoteattr(name)} sheetId="{n}" r:id="r{n}"/>' for n, name in zip(ns, tables, strict=True)) + "</sheets></workbook>")
        for n, rows in zip(ns, tables.values(), strict=True):
            body = "".join(f'<row r="{r}">{"".join(cell(r, k, v) for k, v in enumerate(row))}</row>' for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{n}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def write_bytes(spark: SparkSession, content: bytes, path: str) -> None:
    """A small file at any path that Spark can write to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(content))
    stream.close()


def append_csv(df: DataFrame, path: str) -> None:
    """Add rows to a table of quoted files; each file has the header, which a reader of the folder skips."""
    quoted_csv(df, path, "append")


def code_version() -> str:
    try:
        return subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def provenance(script: str, inputs: list[str], seed: int | None = None, **figures) -> str:
    """What made a table, as JSON to be put beside it."""
    return json.dumps({"script": script, "inputs": inputs, "git_sha": code_version(), "created": datetime.now(UTC).isoformat(timespec="seconds"), "seed": seed, **figures}, indent=2)


def passage_files(passages: DataFrame) -> DataFrame:
    """file, value: Markdown with a block for each passage, from file, title, passage, section, relevance, quote."""
    block = F.concat_ws("\n", F.concat(F.lit("## "), F.col("passage")), F.concat(F.lit("**Section:** "), F.coalesce("section", F.lit(""))), F.concat(F.lit("**Relevance:** "), F.coalesce("relevance", F.lit(""))), F.lit(""), F.concat(F.lit("> "), F.coalesce("quote", F.lit(""))))
    many = passages.groupBy("file").agg(F.min("title").alias("title"), F.array_sort(F.collect_list(F.struct("passage", block.alias("b")))).alias("bs"))
    return many.select("file", F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n"), F.lit("\n")).alias("value"))


def citekeys(df: DataFrame, surname: Column, year: Column, title: Column, order: list[Column]) -> DataFrame:
    """df plus citekey: surname, year, first word; the second and later with one key get a, b, ... behind."""
    clean = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    base = F.concat(clean(surname), F.coalesce(year, F.lit("")), clean(F.split_part(F.trim(F.coalesce(title, F.lit(""))), F.lit(" "), F.lit(1))))
    keyed = df.withColumn("__base", F.when(base == "", "ref").otherwise(base))
    n = F.row_number().over(Window.partitionBy("__base").orderBy(*order))
    suffix = F.when(n == 1, "").when(n <= 27, F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), n - 1, F.lit(1))).otherwise(F.concat(F.lit("_"), n.cast("string")))
    return keyed.withColumn("citekey", F.concat("__base", suffix)).drop("__base")


def bibtex_text(kind: Column, citekey: Column, fields: dict[str, Column]) -> Column:
    """An entry; blank fields are left out."""
    lines = [F.when(F.trim(F.coalesce(v, F.lit(""))) != "", F.concat(F.lit(f"  {name} = {{"), escaped_for_bibtex(v) if name not in ("doi", "url") else v, F.lit("}"))) for name, v in fields.items()]
    return F.concat(F.lit("@"), kind, F.lit("{"), citekey, F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))


def batched(df: DataFrame, size: int, order: list[Column]) -> DataFrame:
    """df plus batch (from 0) of so many rows in the given order."""
    return numbered(df, order, "__n", 0).withColumn("batch", F.floor(F.col("__n") / size).cast("int")).drop("__n")


def request_lines(df: DataFrame, id_col: str, system: str, user: Column, model: str) -> DataFrame:
    """custom_id, value: one JSON request a row."""
    body = F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content"))).alias("messages"))
    return df.select(F.col(id_col).alias("custom_id"), F.to_json(F.struct(F.col(id_col).alias("custom_id"), F.lit("POST").alias("method"), body.alias("body"))).alias("value"))
