"""Reference lists: lines to references, and which way of reading them gives a usable list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
NUMBERED = r"^\s*\[(\d{1,3})\]"
YEAR = r"\b(?:19|20)\d{2}\b"
AUTHOR_START = r"^[A-ZÀ-Þ][\p{L}'’-]+,\s*(?:[A-Z]\.[\s-]*)+"
SHORTEST = 30
FURTHEST_STEP = 5


def _reference_starts(lines: DataFrame) -> DataFrame:
    """doc, at of the lines that begin a numbered reference: the first numbered line, then one whose number is one to FURTHEST_STEP
    above that of the last beginning, or 1 after one over 100. A fold over a document's numbered lines in their order, in the JVM."""
    number = F.nullif(F.regexp_extract(F.coalesce("line", F.lit("")), NUMBERED, 1), F.lit("")).cast("int")
    held = lines.select("doc", "at", number.alias("n")).filter("n is not null")
    ordered = held.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("held"))
    place = lines.schema["at"].dataType

    def step(s: Column, x: Column) -> Column:
        begins = s["last"].isNull() | ((x["n"] > s["last"]) & (x["n"] <= s["last"] + FURTHEST_STEP)) | ((x["n"] == 1) & (s["last"] > 100))
        return F.struct(F.when(begins, x["n"]).otherwise(s["last"]).alias("last"), F.when(begins, F.array_append(s["starts"], x["at"])).otherwise(s["starts"]).alias("starts"))

    none = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast(T.ArrayType(place)).alias("starts"))
    return ordered.select("doc", F.explode(F.aggregate("held", none, step)["starts"]).alias("at"))


def numbered_references(lines: DataFrame) -> DataFrame:
    """doc, ref, raw from lines (doc, at, line; a place once a document): a reference is the text from one beginning to the next,
    without lines of digits only. Lines before the first one don't count; running sums number the references."""
    starts = _reference_starts(lines).withColumn("__start", F.lit(1))
    text = lines.select("doc", "at", F.regexp_replace(F.coalesce("line", F.lit("")), r"(?U)^\s+|\s+$", "").alias("t")).join(starts, ["doc", "at"], "left")
    order = Window.partitionBy("doc").orderBy("at")
    numbered = text.withColumn("ref", F.coalesce(F.sum("__start").over(order), F.lit(0)).cast("int")).filter((F.col("ref") > 0) & (F.col("t") != "") & ~F.col("t").rlike(r"(?U)^\d+$"))
    raw = F.array_join(F.array_sort(F.collect_list(F.struct("at", "t")))["t"], " ")
    return _plausible(numbered.groupBy("doc", "ref").agg(raw.alias("raw")))


def author_references(lines: DataFrame) -> DataFrame:
    """doc, ref, raw: a line that begins with a surname and initials begins a reference. Running sums, no Python."""
    order = Window.partitionBy("doc").orderBy("at")
    text = lines.withColumn("t", F.trim(F.coalesce("line", F.lit("")))).filter("t != ''")
    numbered = text.withColumn("ref", F.sum(F.col("line").rlike(AUTHOR_START).cast("int")).over(order).cast("int")).filter((F.col("ref") > 0) & ~F.col("t").rlike(r"^\d+$"))
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), " ")
    return _plausible(numbered.groupBy("doc", "ref").agg(raw.alias("raw")))


def _plausible(refs: DataFrame) -> DataFrame:
    return refs.filter(F.col("raw").rlike(YEAR) & (F.length("raw") > SHORTEST))


def chosen_references(numbered: DataFrame, by_author: DataFrame, manual: DataFrame, enough: int = 20) -> DataFrame:
    """doc, ref, raw, strategy: the first way that gives enough references, else the one that gives most, of equals the first."""
    parts = [df.select("doc", "ref", "raw", F.lit(name).alias("strategy"), F.lit(k).alias("k")) for k, (name, df) in enumerate([("numbered", numbered), ("author", by_author), ("manual", manual)])]
    all_ = parts[0].unionByName(parts[1]).unionByName(parts[2])
    counts = all_.groupBy("doc", "k").agg(F.count("*").alias("n"))
    best = counts.groupBy("doc").agg(F.coalesce(F.min(F.when(F.col("n") >= enough, F.col("k"))), F.max_by("k", F.struct("n", -F.col("k")))).alias("k"))
    return all_.join(best, ["doc", "k"]).drop("k")


# When a page has two columns.
ROW_HEIGHT = 3
LEAST_WORDS, LEAST_ROWS, LEAST_STARTS = 30, 10, 3
LEAST_GAP = 30.0
MIDDLE = (0.20, 0.70)


def _rows(words: DataFrame) -> DataFrame:
    return words.withColumn("row", F.bround(F.col("top") / ROW_HEIGHT).cast("long") * ROW_HEIGHT)


def column_gap(words: DataFrame) -> DataFrame:
    """page, split: where the second column begins, for pages that have two. words: page, x0, top, width (of the page).

    Words of about one height are a row. The widest gap between rows' beginnings that ends in the middle of the
    page, the first of equals, parts two columns if it is wide enough and both have rows enough.
    """
    from pyspark.sql import Window

    starts = _rows(words).groupBy("page", "row").agg(F.min("x0").alias("x0"), F.count("*").alias("n"), F.max("width").alias("width"))
    page, order = Window.partitionBy("page"), Window.partitionBy("page").orderBy("x0", "row")
    starts = starts.withColumns({"words": F.sum("n").over(page), "rows": F.count("*").over(page), "left": F.lag("x0").over(order)}).filter((F.col("words") >= LEAST_WORDS) & (F.col("rows") >= LEAST_ROWS))
    inside = F.col("x0").between(F.col("width") * MIDDLE[0], F.col("width") * MIDDLE[1]) & F.col("left").isNotNull()
    gap = F.when(inside, F.struct((F.col("x0") - F.col("left")).alias("gap"), (-F.col("x0")).alias("first"), ((F.col("x0") + F.col("left")) / 2).alias("split")))
    found = starts.withColumn("g", F.max(gap).over(page)).filter(F.col("g.gap") >= LEAST_GAP)
    sides = found.groupBy("page").agg(F.first("g.split").alias("split"), F.count_if(F.col("x0") < F.col("g.split")).alias("before"), F.count_if(F.col("x0") >= F.col("g.split")).alias("after"))
    return sides.filter(F.least("before", "after") >= LEAST_STARTS).select("page", "split")


def page_lines(words: DataFrame) -> DataFrame:
    """page, at, line: the lines of each page, the left column before the right one. words: page, x0, top, width, text."""
    from pyspark.sql import Window

    split = column_gap(words)
    placed = _rows(words).join(split, "page", "left").withColumn("side", F.coalesce((F.col("x0") >= F.col("split")).cast("int"), F.lit(0)))
    lines = placed.groupBy("page", "side", "row").agg(F.array_join(F.array_sort(F.collect_list(F.struct("x0", "text")))["text"], " ").alias("line"))
    return lines.withColumn("at", F.row_number().over(Window.partitionBy("page").orderBy("side", "row")) - 1).select("page", "at", "line")


def chunk_references(found: DataFrame) -> DataFrame:
    """References of overlapping chunks (doc, chunk, at, title, year), each once: the first with the same beginning of the title and year."""
    keyed = found.withColumn("__title", F.lower(F.substring(F.trim("title"), 1, 80)))
    first = keyed.groupBy("doc", "__title", "year").agg(F.min_by(F.struct(*found.columns), F.struct("chunk", "at")).alias("r"))
    return first.select("r.*")


def rewritten_citekeys(texts: DataFrame, id_col: str, text: str, mapping: DataFrame) -> DataFrame:
    """id, text, replaced: keys in citation brackets, one or several, exchanged by mapping (old, new); others stay. A null text stays null."""
    bracket = r"\[[a-z][a-z0-9_;\s]+\]"
    pieces = texts.select(F.col(id_col), F.posexplode_outer(F.split(F.col(text), rf"(?={bracket})|(?<=\])")).alias("at", "piece"))
    is_cited = F.col("piece").rlike(f"^{bracket}$")
    inner = F.when(is_cited, F.split(F.expr("substring(piece, 2, length(piece) - 2)"), ";"))
    words = pieces.select(id_col, "at", "piece", F.posexplode_outer(inner).alias("k", "key")).withColumn("key", F.trim("key"))
    joined = words.join(mapping.select(F.col("old").alias("key"), "new"), "key", "left")
    whole = joined.groupBy(id_col, "at").agg(F.first("piece").alias("piece"), F.sort_array(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", F.coalesce("new", "key").alias("w"))))).alias("ws"), F.count("new").alias("n"))
    shown = F.when(F.size("ws") > 0, F.concat(F.lit("["), F.array_join(F.transform("ws", lambda x: x["w"]), "; "), F.lit("]"))).otherwise(F.col("piece"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", shown.alias("s")))), lambda x: x["s"]), "")
    return whole.groupBy(id_col).agg(F.when(F.count("piece") > 0, joined).alias("text"), F.sum("n").alias("replaced"))
