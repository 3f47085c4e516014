"""Ingestion: cells to rows, texts to chunks and sections, vectors, and what happens to them when documents change."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

SIZE, OVERLAP = 1000, 150
#: Tokens whose slots a task remembers, and texts that it turns into vectors at a time.
TOKENS, VECTORS = 1 << 16, 256


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def column_index(letters: Column) -> Column:
    """A is 1, Z 26, AA 27."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))


# cell tables: document, sheet, row, col, value ------------------------------------------------------------------------


def detect_headers(cells: DataFrame) -> DataFrame:
    """document, sheet and header_row: of the first 8 rows with a value, the first with two cells or more.

    A first row of one cell is a title and is passed over when such a row follows; a sheet without one has no header."""
    rows = cells.where("trim(value) <> ''").groupBy("document", "sheet", "row").agg(F.count("*").alias("filled"))
    early = rows.withColumn("k", F.row_number().over(Window.partitionBy("document", "sheet").orderBy("row"))).where("k <= 8")
    return early.where("filled >= 2").groupBy("document", "sheet").agg(F.min("row").alias("header_row"))


def flatten_headers(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """document, sheet, header_row, col, name and header_rows (1 or 2) of every column.

    The row after the header names sub-columns if it is sparser (top below 0.75 of the columns filled, sub at least 0.5,
    or sub with fewer cells); then a name is group-sub with the group carried on, else top, else sub, else 列n."""
    at = cells.join(headers, ["document", "sheet"])
    width = at.groupBy("document", "sheet").agg(F.max("col").alias("width"))
    pick = lambda off: F.max(F.when((F.col("row") == F.col("header_row") + off) & (F.trim("value") != ""), F.trim("value")))
    columns = at.groupBy("document", "sheet", "header_row", "col").agg(pick(0).alias("top"), pick(1).alias("sub"))
    whole = Window.partitionBy("document", "sheet")
    counted = columns.join(width, ["document", "sheet"]).withColumns({"tops": F.count("top").over(whole), "subs": F.count("sub").over(whole)})
    two = (F.col("tops") < 0.75 * F.col("width")) & (F.col("subs") >= 0.5 * F.col("width"))
    carried = F.last("top", ignorenulls=True).over(whole.orderBy("col"))
    name = F.when(two & F.col("sub").isNotNull() & carried.isNotNull(), F.concat_ws("-", carried, "sub")).otherwise(F.coalesce("top", F.when(two, F.col("sub")), F.concat(F.lit("列"), F.col("col"))))
    return counted.select("document", "sheet", "header_row", "col", name.alias("name"), F.when(two, 2).otherwise(1).alias("header_rows"))


def cells_to_rows(cells: DataFrame, names: DataFrame) -> DataFrame:
    """document, sheet, row_number, row and row_keys of every row below the header with a value."""
    found = cells.join(names, ["document", "sheet", "col"]).where(F.col("row") >= F.col("header_row") + F.col("header_rows"))
    rows = found.groupBy("document", "sheet", F.col("row").alias("row_number")).agg(F.array_sort(F.collect_list(F.struct("col", "name", "value"))).alias("c"), F.count_if(F.trim("value") != "").alias("filled")).where("filled > 0")
    return rows.select("document", "sheet", "row_number", F.map_from_entries(F.transform("c", lambda x: F.struct(x["name"], x["value"]))).alias("row"), F.transform("c", lambda x: x["name"]).alias("row_keys"))


def read_csv_rows(spark: SparkSession, path: str, document: str) -> DataFrame:
    """Rows of a CSV file: headers without white space (blank ones 列n), rows without a value dropped, row numbers kept.

    Rows are numbered within the tasks that read them and shifted by the counts of the tasks before."""
    raw = spark.read.option("header", False).option("multiLine", True).csv(path).withColumn("at", F.monotonically_increasing_id())
    columns = [c for c in raw.columns if c != "at"]
    first = raw.orderBy("at").limit(1).collect()  # one row
    names = [("".join((first[0][c] or "").split()) if first else "") or f"列{k}" for k, c in enumerate(columns, 1)]
    # a task's ids are its number in the upper bits and its rows' numbers in the lower 33
    tasks = raw.groupBy(F.shiftright("at", 33).alias("task")).agg(F.count("*").alias("n"))
    before = tasks.select("task", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a task
    numbered = raw.withColumn("task", F.shiftright("at", 33)).join(before, "task").withColumn("row_number", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).cast("int")).where("row_number > 1")
    values = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in columns])
    return numbered.where(F.exists(values, lambda v: F.trim(v) != "")).select(F.lit(document).alias("document"), F.lit("CSV").alias("sheet"), "row_number", F.map_from_arrays(F.array(*map(F.lit, names)), values).alias("row"), F.array(*map(F.lit, names)).alias("row_keys"))


@F.pandas_udf(StringType())
def _gb18030(content: pd.Series) -> pd.Series:
    return content.map(lambda b: bytes(b).decode("gb18030", errors="replace"))


def read_text_docs(spark: SparkSession, path: str) -> DataFrame:
    """path, text and valid (is it UTF-8) of each file, one row a file; a byte order mark goes, and what is no UTF-8 is read
    as GB18030, for which there is no SQL function."""
    files = spark.read.format("binaryFile").load(path).select("path", "content", F.is_valid_utf8(F.col("content").cast("string")).alias("valid"))
    marked = F.hex(F.substring("content", 1, 3)) == "EFBBBF"
    plain = F.decode(F.when(marked, F.expr("substring(content, 4)")).otherwise(F.col("content")), "UTF-8")
    good = files.where("valid").select("path", plain.alias("text"), "valid")
    return good.unionByName(files.where("not valid").select("path", _gb18030("content").alias("text"), "valid"))


def parse_row_lines(pages: DataFrame) -> DataFrame:
    """Rows in lines like `表格行: Excel行=3 | a=1 | b=`: document, sheet, row_number and fields without empty ones.

    A line `[name]` sets the sheet for the lines after it; a cell `工作表` or `sheet` sets it for its line."""
    lines = pages.select("document", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    named = F.nullif(F.regexp_extract("line", r"^\[(.+)\]\s*$", 1), F.lit(""))
    carried = lines.withColumn("sheet", F.last(named, ignorenulls=True).over(Window.partitionBy("document").orderBy("pos")))
    body = F.regexp_extract("line", r"^(?:表格行|row)[:：]\s*(.*)$", 1)
    pairs = F.filter(F.transform(F.split(body, r"\s*\|\s*"), lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("name"), F.when(F.contains(x, F.lit("=")), F.trim(F.substring(x, F.locate("=", x) + 1, F.length(x)))).otherwise("").alias("value"))), lambda p: p["value"] != "")
    rows = carried.where(body != "").withColumn("pairs", pairs)
    value = lambda *names: F.get(F.filter("pairs", lambda p: p["name"].isin(*names)), 0)["value"]
    own = F.filter("pairs", lambda p: ~p["name"].isin("Excel行", "CSV行", "工作表", "sheet"))
    return rows.select("document", F.coalesce(value("工作表", "sheet"), "sheet", F.lit("Sheet1")).alias("sheet"), value("Excel行", "CSV行").try_cast("int").alias("row_number"), own.alias("fields"))


def with_row_key(rows: DataFrame, preferred: list[str]) -> DataFrame:
    """rows and row_key: the first non-empty preferred column, else sheet:row_number, else sheet:json."""
    chosen = F.coalesce(*[F.nullif(F.trim(F.element_at("row", F.lit(k))), F.lit("")) for k in preferred])
    return rows.withColumn("row_key", F.coalesce(chosen, F.concat_ws(":", "sheet", F.col("row_number").cast("string")), F.concat_ws(":", "sheet", F.to_json("row"))))


def table_row_records(rows: DataFrame, preferred: list[str]) -> DataFrame:
    """Rows as stored records: key, JSON in column order, text, whether it is the header, and order in the source."""
    text = F.array_join(F.transform("row_keys", lambda k: F.concat(k, F.lit("="), F.element_at("row", k))), " | ")
    order = F.row_number().over(Window.partitionBy("document").orderBy("sheet", "row_number"))
    return with_row_key(rows, preferred).select("document", "sheet", "row_number", "row_key", F.to_json("row").alias("row_json"), text.alias("row_text"), (F.col("row_number") == 1).alias("is_header"), order.alias("source_order"))


# texts -----------------------------------------------------------------------------------------------------------------


def chunk_text(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, page, chunk_index and content: windows of the text with white space squeezed; the last one reaches its end."""
    step, n = size - overlap, F.length("t")
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    spots = pages.withColumn("t", collapsed(F.col("text"))).where(F.col("t") != "").withColumn("chunk_index", F.explode(F.sequence(F.lit(0), last)))
    return spots.select("doc_id", "page", "chunk_index", F.substring(F.col("t"), F.col("chunk_index") * step + 1, F.lit(size)).alias("content"))


def chunk_lines(pages: DataFrame, size: int = 1800, headers: int = 3, header: str = "表头") -> DataFrame:
    """Chunks of whole lines up to a size, header lines (among the first few) repeated in each later chunk.

    The filling is a fold over a page's lines; pages are independent."""
    lines = F.split("text", "\n")
    head = F.array_join(F.filter(F.slice(lines, 1, headers), lambda x: F.startswith(x, F.lit(header))), "\n")
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("now"))

    def add(s: Column, line: Column) -> Column:
        full = (F.length(s["now"]) + F.length(line) + 1 > size) & (s["now"] != "")
        fresh = F.when(F.col("head") != "", F.concat_ws("\n", "head", line)).otherwise(line)
        return F.struct(F.when(full, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"), F.when(full, fresh).when(s["now"] == "", line).otherwise(F.concat_ws("\n", s["now"], line)).alias("now"))

    packed = pages.withColumn("head", head).withColumn("c", F.aggregate(lines, start, add, lambda s: F.filter(F.concat(s["done"], F.array(s["now"])), lambda x: x != "")))
    return packed.select("doc_id", "page", F.posexplode("c").alias("chunk_index", "content"))


def number_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks numbered from 0 over all pages of a document."""
    return chunks.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "chunk_index")) - 1)


def embedding_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[一-鿿]|[a-z0-9_]+"), F.lit(0))


def hash_embed(df: DataFrame, key: str, text: str, dim: int = 512) -> DataFrame:
    """key, slot and weight: tokens hashed into signed slots, scaled to length one; empty texts have no rows."""
    tokens = df.select(key, F.explode(embedding_tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    slot = F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long") % dim
    sign = F.when(F.conv(F.substring(F.md5("token"), 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    slots = tokens.select(key, slot.alias("slot"), (sign * F.col("n")).alias("w")).groupBy(key, "slot").agg(F.sum("w").cast("double").alias("w")).where("w <> 0")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return slots.select(key, "slot", (F.col("w") / norm).alias("weight"))


def hash_vectors(df: DataFrame, keys: list[str], text: str, dim: int = 512) -> DataFrame:
    """keys and embedding, an array of what hash_embed gives (slot and weight) with a key's tokens counted in one task; texts
    of equal keys count as one, and those without tokens have no rows."""
    pattern, schema = re.compile("[一-鿿]|[a-z0-9_]+"), f"{', '.join(f'{c} {df.schema[c].dataType.simpleString()}' for c in keys)}, embedding array<struct<slot:int,weight:double>>"
    whole = df.groupBy(*keys).agg(F.lower(F.array_join(F.collect_list(text), " ")).alias("text_"))

    def signed(token: str) -> tuple[int, int]:
        found = hashlib.md5(token.encode()).hexdigest()
        return int(found[:8], 16) % dim, 1 - 2 * (int(found[8:10], 16) % 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(TOKENS)(signed)
        for whole in batches:
            for batch in (whole.slice(a, VECTORS) for a in range(0, whole.num_rows, VECTORS)):
                found = [pattern.findall(x) for x in batch.column("text_").to_pylist()]
                row = np.repeat(np.arange(len(found)), [len(x) for x in found])
                pairs = np.array([known(t) for x in found for t in x], np.int64).reshape(-1, 2)
                w = np.bincount(row * dim + pairs[:, 0], pairs[:, 1], len(found) * dim).reshape(-1, dim)
                rows, slots = np.nonzero(w)
                weights = w[rows, slots] / np.sqrt((w * w).sum(axis=1))[rows]
                own = np.bincount(rows, minlength=len(found))
                some = np.flatnonzero(own)
                flat = pa.StructArray.from_arrays([pa.array(slots, pa.int32()), pa.array(weights)], ["slot", "weight"])
                lists = pa.ListArray.from_arrays(pa.array([0, *np.cumsum(own[some])], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(some)) for c in keys], lists], [*keys, "embedding"])

    return whole.mapInArrow(run, schema)


def flag_low_text(pages: DataFrame, least: int = 80) -> DataFrame:
    chars = F.sum(F.length(F.trim(F.coalesce("text", F.lit("")))))
    return pages.groupBy("doc_id").agg(chars.alias("chars")).withColumn("flag", F.when(F.col("chars") == 0, "no_text").when(F.col("chars") < least, F.concat(F.lit("low_text:"), F.col("chars"))))


#: First bytes of file types; types without an entry are texts.
MAGIC = {".pdf": "25504446", ".xlsx": "504B0304", ".docx": "504B0304", ".pptx": "504B0304", ".png": "89504E47"}


def admit_files(files: DataFrame, allowed: list[str], longest: int = 180) -> DataFrame:
    """name and reason (null: admitted) of files (name, content)."""
    ext = F.lower(F.regexp_extract("name", r"(\.[A-Za-z0-9]+)$", 1))
    magic = reduce(lambda c, x: c.when(ext == x[0], F.hex(F.substring("content", 1, len(x[1]) // 2)) == x[1]), list(MAGIC.items())[1:], F.when(ext == ".pdf", F.hex(F.substring("content", 1, 4)) == MAGIC[".pdf"])).otherwise(F.is_valid_utf8(F.col("content").cast("string")))
    return files.select("name", F.when(F.length("name") > longest, "name_too_long").when(~ext.isin(*allowed), "bad_extension").when(F.length("content") == 0, "empty").when(~magic, "bad_content").alias("reason"))


# sections --------------------------------------------------------------------------------------------------------------


#: Spaces of all scripts (Unicode's Zs).
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def page_sections(pages: DataFrame, flat_up_to: int = 20, group: int = 5, named: bool = True) -> DataFrame:
    """Sections of paged documents: a page each, or, beyond flat_up_to pages, groups of pages above them.

    A title is the first line that isn't blank, without spaces of any script around it. A page without one is named by its
    number, or, unless named, has an empty title (null for null texts); a group has the first title that isn't null."""
    line = F.btrim(F.regexp_extract("text", r"^[ \t\n\f\r]*([^\n]+)", 1), F.lit(SPACES))
    title = F.left(F.coalesce(F.nullif(line, F.lit("")), F.concat(F.lit("page "), F.col("page"))) if named else line, F.lit(80))
    # texts are clipped before the pages of a document meet
    short = pages.select("doc_id", "page", title.alias("title"), F.left(collapsed(F.col("text")), F.lit(500)).alias("summary"))
    sized = short.withColumn("pages", F.count("*").over(Window.partitionBy("doc_id")))
    parent = F.when(F.col("pages") > flat_up_to, F.expr(f"cast((page - 1) div {group} as int)"))
    leaves = sized.select("doc_id", F.lit("page").alias("level"), F.col("page").alias("start"), F.col("page").alias("end"), parent.alias("parent"), "title", "summary")
    groups = leaves.where("parent is not null").groupBy("doc_id", "parent").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("title", F.when(F.col("title").isNotNull(), F.col("start"))).alias("title"), F.min_by(F.left("summary", F.lit(350)), "start").alias("summary"))
    return leaves.unionByName(groups.select("doc_id", F.lit("group").alias("level"), "start", "end", F.lit(None).cast("int").alias("parent"), "title", "summary"))


#: Levels of headings.
LEVELS = range(1, 7)


def heading_sections(docs: DataFrame) -> DataFrame:
    """doc_id, line, level, title and end (the line before the next heading of its level or a higher one) of `#` headings.

    One pass over a document's headings from the last to the first keeps the nearest one of each level or a higher one."""
    split = docs.select("doc_id", F.split("text", "\n").alias("lines"))
    lines = split.select("doc_id", (F.size("lines") - 1).alias("final"), F.posexplode("lines").alias("line", "body"))
    marks = F.length(F.regexp_extract("body", r"^(#{1,6})\s+\S", 1))
    heads = lines.where(marks > 0).select("doc_id", "final", "line", marks.alias("level"), F.trim(F.regexp_replace("body", r"^#+\s+", "")).alias("title"))
    later = Window.partitionBy("doc_id").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    following = F.array(*[F.last(F.when(F.col("level") <= n, F.col("line")), ignorenulls=True).over(later) for n in LEVELS])
    nearest = heads.withColumn("following", following)
    return nearest.select("doc_id", "line", "level", "title", F.coalesce(F.get("following", F.col("level") - 1) - 1, "final").alias("end"))


def section_paths(sections: DataFrame) -> DataFrame:
    """Each section with the titles above it, joined by slashes.

    One pass over a document's sections keeps the last one of each level; those after which no higher one came are open."""
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda met: F.last(F.when(met, F.struct("line", "title")), ignorenulls=True).over(before)
    higher = lambda n: F.last(F.when(F.col("level") < n, F.col("line")), ignorenulls=True).over(before)
    above = sections.withColumn("above", F.array(*[F.struct(last(F.col("level") == n).alias("own"), higher(n).alias("cut")) for n in LEVELS]))
    open_ = F.filter("above", lambda x, i: (i < F.col("level") - 1) & x["own"].isNotNull() & (x["own"]["line"] > F.coalesce(x["cut"], F.lit(-1))))
    return above.select("doc_id", "line", F.array_join(F.concat(F.transform(open_, lambda x: x["own"]["title"]), F.array("title")), " / ").alias("path"))


def section_stats(sections: DataFrame) -> DataFrame:
    return sections.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.max("level").alias("deepest"), F.max(F.col("end") - F.col("line") + 1).alias("longest"))


def section_status(docs: DataFrame, pages: DataFrame, sections: DataFrame, least: int = 200) -> DataFrame:
    """ready, not_built, or not_eligible (extension or too little text) for each document (doc_id, filename)."""
    size = pages.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"))
    built = sections.groupBy("doc_id").agg(F.count("*").alias("nodes"))
    both = docs.join(size, "doc_id", "left").join(built, "doc_id", "left")
    fits = F.lower(F.regexp_extract("filename", r"(\.[a-z0-9]+)$", 1)).isin(".txt", ".md", ".pdf") & (F.coalesce("chars", F.lit(0)) >= least)
    return both.select("doc_id", F.when(~fits, "not_eligible").when(F.col("nodes") > 0, "ready").otherwise("not_built").alias("status"), F.coalesce("nodes", F.lit(0)).alias("nodes"))


def pages_to_markdown(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One markdown text a document: its title, then a sub-heading a page (slides and sheets named so)."""
    word = F.when(F.endswith("filename", F.lit(".pptx")), "Slide").when(F.endswith("filename", F.lit(".xlsx")) | F.endswith("filename", F.lit(".csv")), "Sheet").otherwise("Page")
    parts = pages.join(docs.select("doc_id", "title", "filename"), "doc_id").select("doc_id", "title", "page", F.concat(F.lit("## "), word, F.lit(" "), "page", F.lit("\n\n"), F.trim("text")).alias("part"))
    return parts.groupBy("doc_id", "title").agg(F.array_sort(F.collect_list(F.struct("page", "part"))).alias("p")).select("doc_id", F.concat(F.lit("# "), "title", F.lit("\n\n"), F.array_join(F.transform("p", lambda x: x["part"]), "\n\n")).alias("markdown"))


# changes ---------------------------------------------------------------------------------------------------------------


def replace_by_document(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """old with all rows of the documents in new replaced by those of new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def write_by_document(new: DataFrame, path: str, partition: str) -> None:
    """Overwrites the partitions that new has rows for, and no others."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def purge_documents(tables: dict[str, DataFrame], ids: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Every table without rows of some documents."""
    gone = ids.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}


def repair_references(child: DataFrame, parent: DataFrame, key: str, required: bool) -> DataFrame:
    """child without rows whose required key has no parent, or with such a key set to null."""
    known = parent.select(key).distinct()
    if required:
        return child.join(known, key, "left_semi")
    found = child.join(known.withColumn("known", F.lit(True)), key, "left")
    return found.withColumn(key, F.when(F.col("known"), F.col(key))).drop("known").select(*child.columns)


def validate_vectors(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """For each group: vectors, empty ones, ones with a number that isn't finite, and how many dimensions there are."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.groupBy(key).agg(F.count("*").alias("vectors"), F.count_if(F.size(column) == 0).alias("empty"), F.count_if(bad).alias("not_finite"), F.countDistinct(F.size(column)).alias("dimensions"))


def apply_chunk_edits(chunks: DataFrame, edits: DataFrame) -> DataFrame:
    """chunks with new contents (doc_id, chunk_index, new_content) and a mark on those that need a new vector."""
    both = chunks.join(edits, ["doc_id", "chunk_index"], "left")
    return both.select("doc_id", "chunk_index", F.coalesce("new_content", "content").alias("content"), F.coalesce(F.col("new_content") != F.col("content"), F.lit(False)).alias("stale"))
