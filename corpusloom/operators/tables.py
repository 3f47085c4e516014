"""Analytics over schema-on-read rows: columns are found by meaning, filtered, grouped, compared and ranked.

A rows table has document, sheet, row_number, row (a map from column name to cell text) and row_keys (names in column
order). Lexicons are arguments: a dict from a meaning to the words that name it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType
from pyspark.sql.window import Window

from .patterns import Count, topk

Lexicon = dict[str, list[str]]
MISSING = "not stated"
#: Cell texts that say nothing.
PLACEHOLDERS = ("", "-", "--", "/", "n/a", "N/A", "none", "no", "无", "暂无", "否", "未开设")


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def compact(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


#: Parts over which the rows of one document are dealt where they meet what is known of it.
PARTS = 64


def dealt_join(rows: DataFrame, known: DataFrame, how: str = "inner") -> DataFrame:
    """rows and what is known of their documents (a few rows each). A document's rows are dealt out by what they hold, so
    that a document of many rows makes no large group."""
    plain = [f.name for f in rows.schema.fields if isinstance(f.dataType, AtomicType)]
    placed = rows.withColumn("dealt_", F.pmod(F.xxhash64(*plain), F.lit(PARTS)).cast("int"))
    copied = known.withColumn("dealt_", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return placed.join(copied, ["document", "dealt_"], how).drop("dealt_")


# meanings of columns ---------------------------------------------------------------------------------------------------


def first_values(cells: DataFrame, keys: list[str], order: list[str], value: str, k: int) -> DataFrame:
    """keys, value and order of the k first different values of each group of keys that a task sees: all that a later
    choice of the k first of all tasks can need, so at most k rows a group and task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, schema = None, None
        for batch in batches:
            schema = batch.schema
            new = batch.to_pandas(integer_object_nulls=True)
            both = new if held is None else pd.concat([held, new])
            ordered = both.sort_values([*keys, *order, value], na_position="first", kind="stable").drop_duplicates([*keys, value])
            held = ordered.groupby(keys, sort=False, dropna=False).head(k)
        if held is not None:
            yield pa.RecordBatch.from_pandas(held, schema, preserve_index=False)

    return cells.select(*keys, *order, value).mapInArrow(run, ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in [*keys, *order, value]))


def column_samples(rows: DataFrame, limit: int = 8) -> DataFrame:
    """document, raw_name, pos (of the column) and samples, the first different values by sheet and row."""
    names = rows.select("document", F.posexplode("row_keys").alias("pos", "raw_name")).groupBy("document", "raw_name").agg(F.min("pos").alias("pos"))
    cells = rows.select("document", "sheet", "row_number", F.explode("row_keys").alias("raw_name"), "row").select("document", "sheet", "row_number", "raw_name", clean(F.element_at("row", F.col("raw_name"))).alias("value"))
    few = first_values(cells.where("value <> ''"), ["document", "raw_name"], ["sheet", "row_number"], "value", limit)
    values = few.groupBy("document", "raw_name", "value").agg(F.min(F.struct("sheet", "row_number")).alias("at"))
    first = values.withColumn("k", F.row_number().over(Window.partitionBy("document", "raw_name").orderBy("at", "value"))).where(F.col("k") <= limit)
    samples = first.groupBy("document", "raw_name").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("s"))
    return names.join(samples, ["document", "raw_name"], "left").select("document", "raw_name", "pos", F.coalesce(F.transform("s", lambda x: x["value"]), F.array().cast("array<string>")).alias("samples"))


def semantic_scores(columns: DataFrame, lexicon: Lexicon, hints: dict[str, tuple[float, list[str]]] | None = None) -> DataFrame:
    """document, raw_name, pos, samples, semantic and score of each column and meaning.

    Each word adds 3 if it is the name, 1.6 if one holds the other; a hint adds its weight if a sample holds one of its
    words."""
    key, text = compact(F.col("raw_name")), F.array_join("samples", " ")

    def score(meaning: str) -> Column:
        total = F.lit(0.0)
        for word in lexicon[meaning]:
            w = F.lit(word.lower().replace(" ", ""))
            total = total + F.when(key == w, 3.0).when(F.contains(key, w) | F.contains(w, key), 1.6).otherwise(0.0)
        weight, words = (hints or {}).get(meaning, (0.0, []))
        return total + F.when(any_of([F.contains(text, F.lit(x)) for x in words]), weight).otherwise(0.0)

    scored = F.explode(F.array(*[F.struct(F.lit(m).alias("semantic"), F.round(score(m), 4).alias("score")) for m in lexicon]))
    return columns.select("*", scored.alias("x")).select("document", "raw_name", "pos", "samples", "x.semantic", "x.score")


def infer_semantics(rows: DataFrame, lexicon: Lexicon, hints: dict[str, tuple[float, list[str]]] | None = None, least: float = 1.0) -> DataFrame:
    """The best column of each document and meaning, with a score of least or more; of equal scores the first column."""
    scored = semantic_scores(column_samples(rows), lexicon, hints).where(F.col("score") >= least)
    best = scored.groupBy("document", "semantic").agg(F.max_by(F.struct("raw_name", "score", "samples"), F.struct("score", -F.col("pos"))).alias("x"))
    return best.select("document", "semantic", "x.raw_name", "x.score", "x.samples")


def apply_aliases(semantics: DataFrame, aliases: DataFrame, rows: DataFrame, least: float = 9.0) -> DataFrame:
    """Meanings with people's decisions (document, raw_name, semantic, status) applied.

    Confirmed ones score least or more and replace inferred ones, if their column is still there; ignored ones go."""
    present = rows.select("document", F.explode("row_keys").alias("raw_name")).distinct()
    confirmed = aliases.where("status = 'confirmed'").join(present, ["document", "raw_name"], "left_semi").groupBy("document", "semantic").agg(F.min("raw_name").alias("chosen"))
    kept = semantics.join(aliases.where("status = 'ignored'"), ["document", "raw_name", "semantic"], "left_anti")
    both = kept.join(confirmed, ["document", "semantic"], "full_outer")
    return both.select("document", "semantic", F.coalesce("chosen", "raw_name").alias("raw_name"), F.when(F.col("chosen").isNotNull(), F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(least))).otherwise(F.col("score")).alias("score"))


def upsert_aliases(base: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("document", "raw_name", "semantic"), at: str = "updated_at") -> DataFrame:
    """The latest row of each key."""
    latest = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc("status"))
    return base.unionByName(changes).withColumn("k", F.row_number().over(latest)).where("k = 1").drop("k")


def schema_suggestions(semantics: DataFrame, samples: int = 3) -> DataFrame:
    """Meanings with a stable key, scores from strong to weak, and a few samples."""
    return semantics.select(F.concat_ws(":", "document", "raw_name", "semantic").alias("suggestion"), "document", "raw_name", "semantic", "score", F.array_join(F.slice("samples", 1, samples), "|").alias("samples"))


def alias_list(aliases: DataFrame, status: str | None = None) -> DataFrame:
    """Decisions with their suggestion key, those of one status if asked for."""
    found = aliases if status is None else aliases.where(F.col("status") == status)
    return found.select(F.concat_ws(":", "document", "raw_name", "semantic").alias("suggestion"), "document", "raw_name", "semantic", "status", "updated_at")


def with_semantics(rows: DataFrame, semantics: DataFrame) -> DataFrame:
    """rows and semantic, a map from each meaning of the document to the name of its column."""
    maps = semantics.groupBy("document").agg(F.map_from_entries(F.collect_list(F.struct("semantic", "raw_name"))).alias("semantic"))
    return dealt_join(rows, maps, "left")


# values of a meaning ---------------------------------------------------------------------------------------------------


def named_values(meaning: str, lexicon: Lexicon) -> Column:
    """Non-empty values of the columns whose name holds a word of the meaning, in column order."""
    named = F.filter("row_keys", lambda k: any_of([F.contains(F.lower(k), F.lit(w.lower())) for w in lexicon.get(meaning, [])]))
    return F.filter(F.transform(named, lambda k: clean(F.element_at("row", k))), lambda v: v != "")


def semantic_value(meaning: str, lexicon: Lexicon) -> Column:
    """The value of the mapped column, else of the first column named so that isn't empty, else null."""
    mapped = clean(F.element_at("row", F.element_at("semantic", F.lit(meaning))))
    return F.when(mapped != "", mapped).otherwise(F.get(named_values(meaning, lexicon), 0))


def candidates(meaning: str, lexicon: Lexicon, fallback: bool = True) -> Column:
    """Different values of the mapped column and of columns named so; with fallback, of all columns if there are none."""
    name = F.element_at("semantic", F.lit(meaning))
    mapped = F.when(F.array_contains("row_keys", name), F.array(clean(F.element_at("row", name)))).otherwise(F.array().cast("array<string>"))
    found = F.array_distinct(F.concat(F.coalesce(mapped, F.array().cast("array<string>")), named_values(meaning, lexicon)))
    every = F.array_distinct(F.transform("row_keys", lambda k: clean(F.element_at("row", k))))
    return F.when(F.size(found) > 0, found).otherwise(every) if fallback else found


def concrete(value: Column) -> Column:
    return ~value.isin(*PLACEHOLDERS)


def numeric(value: Column) -> Column:
    """The first signed decimal, thousands separators dropped, or null."""
    return F.regexp_extract(F.replace(value, F.lit(","), F.lit("")), r"-?[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")


def comparable(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9.\-]", "").try_cast("double")


def compared(value: Column, operator: str, expected: str) -> Column:
    """gt, gte, lt or lte: as numbers if both sides hold one, else as texts."""
    ops = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}
    right = F.lit(expected)
    return F.when(comparable(value).isNotNull() & comparable(right).isNotNull(), ops[operator](comparable(value), comparable(right))).otherwise(ops[operator](value, right))


def completed(positive: list[str], negative: list[str], value: Column) -> Column:
    """A positive word and no negative one."""
    return any_of([F.contains(value, F.lit(w)) for w in positive]) & ~any_of([F.contains(value, F.lit(w)) for w in negative])


# declarative queries ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Filter:
    meaning: str
    operator: str
    value: str = ""


@dataclass(frozen=True)
class TableQuery:
    """A question about rows: filters (all of where, or any group of groups), periods, and what to make of the rest.

    synonyms names texts that stand for one another. fallback lets a filter on a meaning that a row lacks look at all of
    its values."""

    lexicon: Lexicon
    filters: tuple[Filter, ...] = ()
    groups: tuple[tuple[Filter, ...], ...] = ()
    months: tuple[str, ...] = ()
    years: tuple[str, ...] = ()
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    fallback: bool = True

    def where(self, meaning: str, operator: str, value: str = "") -> TableQuery:
        return replace(self, filters=(*self.filters, Filter(meaning, operator, value)))

    def any_of(self, *groups: list[Filter]) -> TableQuery:
        return replace(self, groups=tuple(map(tuple, groups)))

    def in_months(self, *months: str) -> TableQuery:
        return replace(self, months=months)

    def in_years(self, *years: str) -> TableQuery:
        return replace(self, years=years)

    def condition(self, f: Filter) -> Column:
        found = candidates(f.meaning, self.lexicon, self.fallback)
        words = [f.value, *self.synonyms.get(f.value, [])]
        joined = F.array_join(found, " ")
        if f.operator == "contains":
            return any_of([F.contains(joined, F.lit(w)) for w in words])
        if f.operator == "not_contains":
            return ~any_of([F.contains(joined, F.lit(w)) for w in words])
        if f.operator == "eq":
            return F.exists(found, lambda v: v.isin(*words))
        if f.operator == "ne":
            return F.forall(found, lambda v: v != f.value)
        if f.operator == "is_empty":
            return F.forall(found, lambda v: v == "")
        if f.operator == "is_not_empty":
            return F.exists(found, lambda v: v != "")
        if f.operator == "is_concrete":
            return F.exists(found, concrete)
        return F.exists(found, lambda v: compared(v, f.operator, f.value))

    def predicate(self) -> Column:
        kept = all_of([self.condition(f) for f in self.filters])
        if self.groups:
            kept = kept & any_of([all_of([self.condition(f) for f in g]) for g in self.groups])
        if self.months:
            kept = kept & any_of([F.contains("sheet", F.lit(m)) | F.contains(F.lit(m), F.col("sheet")) for m in self.months])
        if self.years:
            kept = kept & any_of([F.contains("sheet", F.lit(y)) for y in self.years])
        return kept

    def rows(self, rows: DataFrame) -> DataFrame:
        """The rows (with their semantic map) that pass."""
        return rows.where(self.predicate())

    def value(self, meaning: str) -> Column:
        return semantic_value(meaning, self.lexicon)

    def count(self, rows: DataFrame) -> DataFrame:
        return self.rows(rows).agg(F.count("*").alias("n"))

    def aggregate(self, rows: DataFrame, measure: str) -> DataFrame:
        """Sum, mean, least and largest of the numbers in a meaning's values, and how many there are."""
        return self.rows(rows).select(numeric(self.value(measure)).alias("x")).agg(*measures("x"))

    def group_count(self, rows: DataFrame, meaning: str) -> DataFrame:
        return self.rows(rows).groupBy(F.coalesce(self.value(meaning), F.lit(MISSING)).alias("key")).agg(F.count("*").alias("n"))

    def group_aggregate(self, rows: DataFrame, meaning: str, measure: str) -> DataFrame:
        """As aggregate for each value of a meaning; groups without a number are dropped. n counts the group's rows."""
        found = self.rows(rows).select(F.coalesce(self.value(meaning), F.lit(MISSING)).alias("key"), numeric(self.value(measure)).alias("x"))
        return found.groupBy("key").agg(F.count("*").alias("n"), *measures("x")).where("numbers > 0")

    def distinct(self, rows: DataFrame, meaning: str) -> DataFrame:
        return self.rows(rows).select(self.value(meaning).alias("value")).where("value is not null").distinct()

    def select(self, rows: DataFrame, *meanings: str) -> DataFrame:
        return self.rows(rows).select("document", "sheet", "row_number", *[F.coalesce(self.value(m), F.lit("")).alias(m) for m in meanings])


def measures(x: str) -> list[Column]:
    return [F.count(x).alias("numbers"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("largest")]


def top(grouped: DataFrame, by: str, n: int, descending: bool = True, key: str = "key") -> DataFrame:
    """The n (1 to 100) first groups by a number, equal ones by key."""
    return grouped.orderBy(F.desc(by) if descending else F.asc(by), key).limit(max(1, min(100, n)))


def collapse_filters(filters: DataFrame) -> DataFrame:
    """Filters (query, meaning, operator, value) without those whose value another of the same kind holds."""
    other = filters.select("query", "meaning", "operator", F.col("value").alias("longer"))
    held = filters.join(other, ["query", "meaning", "operator"]).where(F.contains("longer", F.col("value")) & (F.col("longer") != F.col("value"))).select("query", "meaning", "operator", "value").distinct()
    return filters.join(held, ["query", "meaning", "operator", "value"], "left_anti")


def soft_filter(df: DataFrame, condition: Column, *by: str) -> DataFrame:
    """The rows of each group that meet the condition, or all rows of a group in which none does."""
    met = F.coalesce(condition, F.lit(False))
    some = df.where(met).select(*by).distinct().withColumn("some", F.lit(True))
    return df.join(some, list(by), "left").where(met | F.col("some").isNull()).drop("some")


def dedupe_complete(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The first row of each complete key; rows in which a key is null or empty all stay."""
    complete = all_of([F.coalesce(F.col(k), F.lit("")) != "" for k in keys])
    first = rows.where(complete).withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("k = 1").drop("k")
    return first.unionByName(rows.where(~complete))


def focus_columns(rows: DataFrame, identity: list[str], markers: list[str]) -> DataFrame:
    """Rows cut down to columns whose name holds an identity word or a focus marker, as name=value texts."""
    kept = F.filter("row_keys", lambda k: any_of([F.contains(F.lower(k), F.lit(w)) for w in [*identity, *markers]]))
    return rows.select("document", "sheet", "row_number", F.array_join(F.transform(kept, lambda k: F.concat(k, F.lit("="), clean(F.element_at("row", k)))), "|").alias("focus"))


def compare_periods(rows: DataFrame, key: str) -> DataFrame:
    """For each document and key over its sheets: each field's different values, and whether they changed.

    rows has document, sheet, row_number, the key column, row and row_keys; the first row of a sheet counts, and keys in
    one sheet alone are left out."""
    cells = F.transform(F.array_distinct("row_keys"), lambda f: F.struct(f.alias("field"), clean(F.element_at("row", f)).alias("value")))
    own = rows.select("document", key, "sheet", "row_number", cells.alias("cells")).repartition("document", key, "sheet")
    first = own.withColumn("k", F.row_number().over(Window.partitionBy("document", key, "sheet").orderBy("row_number"))).where("k = 1")
    fields = first.select("document", key, "sheet", F.explode("cells").alias("x")).select("document", key, "sheet", "x.*")
    # a sheet has one row of a key, so its rows are its periods
    found = fields.groupBy("document", key, "field").agg(F.count("sheet").alias("periods"), F.countDistinct("value").alias("different"))
    return found.where("periods >= 2").withColumn("changed", F.col("different") > 1)


def hit_columns(rows: DataFrame, preferred: list[str], n: int = 12) -> DataFrame:
    """Column names of each document, preferred ones first, then by position, at most n."""
    names = rows.select("document", F.posexplode("row_keys").alias("pos", "name")).groupBy("document", "name").agg(F.min("pos").alias("pos"))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, preferred)), F.col("name")), F.lit(0)), F.lit(1 << 20))
    ranked = names.withColumn("k", F.row_number().over(Window.partitionBy("document").orderBy(rank, "pos", "name")))
    return ranked.where(F.col("k") <= n).select("document", "name", "k")


def with_headers(selected: DataFrame, headers: DataFrame, per_document: int = 2) -> DataFrame:
    """The header rows (document, row_number, content) to show with selected rows: the first different ones of each document."""
    own = headers.join(selected.select("document").distinct(), "document", "left_semi").groupBy("document", "content").agg(F.min("row_number").alias("row_number"))
    return own.withColumn("k", F.row_number().over(Window.partitionBy("document").orderBy("row_number", "content"))).where(F.col("k") <= per_document).drop("k")


def row_contexts(rows: DataFrame) -> DataFrame:
    """Rows as evidence: their text, place and score (0.82; header rows 0.45)."""
    text = F.array_join(F.transform("row_keys", lambda k: F.concat(k, F.lit("="), clean(F.element_at("row", k)))), " | ")
    return rows.select("document", F.concat_ws(" / ", "document", "sheet", F.concat(F.lit("row "), F.col("row_number"))).alias("place"), text.alias("content"), F.when(F.col("row_number") <= 1, 0.45).otherwise(0.82).alias("score"))


def has_columns(rows: DataFrame, markers: list[str]) -> DataFrame:
    """Documents and whether a row of theirs has a column whose name holds a marker."""
    return rows.groupBy("document").agg(F.max(F.exists("row_keys", lambda k: any_of([F.contains(F.lower(k), F.lit(m)) for m in markers]))).alias("present"))


def sheet_digest(rows: DataFrame, n: int = 80) -> DataFrame:
    """Rows of each sheet, and how many of the first n are shown."""
    return rows.groupBy("document", "sheet").agg(F.count("*").alias("n"), F.least(F.count("*"), F.lit(n)).alias("shown"), F.min("row_number").alias("first_row"))


def normalize_fields(records: DataFrame, field: str = "field", value: str = "value") -> DataFrame:
    """Serial dates (days from 1899-12-30) in fields named date become ISO dates, shares in fields named ratio percents."""
    serial, number = F.col(value).try_cast("int"), F.col(value).try_cast("double")
    date = F.when(serial.between(20000, 80000), F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), serial), "yyyy-MM-dd"))
    share = F.when(number.between(0, 1), F.concat(F.round(number * 100, 2).cast("decimal(9,2)").cast("string"), F.lit("%")))
    return records.withColumn("normal", F.coalesce(F.when(F.contains(F.lower(field), F.lit("date")), date), F.when(F.contains(F.lower(field), F.lit("ratio")), share), F.col(value)))


def records_from_pairs(texts: DataFrame, fields: list[str], least: int = 3) -> DataFrame:
    """`field: value` lines as a map, for texts that hold least or more of the known fields; the first line of a field counts."""
    pattern = "(?m)^(" + "|".join(fields) + "): *(.+)$"
    names, values = F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), F.regexp_extract_all("text", F.lit(pattern), F.lit(2))
    pairs = F.zip_with(names, values, lambda a, b: F.struct(a.alias("name"), F.trim(b).alias("value")))
    first = F.filter(pairs, lambda p, i: F.array_position(names, p["name"]) == i + 1)
    return texts.select("doc_id", first.alias("fields")).where(F.size("fields") >= least)


def group_fields(records: DataFrame, rules: list[tuple[str, list[str]]], other: str = "other") -> DataFrame:
    """Fields with the first group of which a word is in their name."""
    group = reduce(lambda c, r: c.when(any_of([F.contains(F.lower("field"), F.lit(w)) for w in r[1]]), r[0]), rules[1:], F.when(any_of([F.contains(F.lower("field"), F.lit(w)) for w in rules[0][1]]), rules[0][0]))
    return records.withColumn("group", group.otherwise(other))


def dedupe_records(records: DataFrame, key: str, content: str, order: str) -> DataFrame:
    """The first record of each natural key, or of each content where the key is empty."""
    identity = F.coalesce(F.nullif(F.col(key), F.lit("")), F.concat(F.lit("text:"), F.col(content)))
    return records.withColumn("k", F.row_number().over(Window.partitionBy(identity).orderBy(order))).where("k = 1").drop("k")


def month_tokens(texts: DataFrame, column: str) -> DataFrame:
    """Months that a text names as 2025-03, 202503, 2025/3 or 2025年3月, as yyyyMM."""
    pattern = F.lit(r"(?<![0-9])([0-9]{4})[-/年]?(1[0-2]|0?[1-9])(?![0-9])")
    years, months = F.regexp_extract_all(column, pattern, F.lit(1)), F.regexp_extract_all(column, pattern, F.lit(2))
    return texts.withColumn("months", F.array_sort(F.array_distinct(F.zip_with(years, months, lambda y, m: F.concat(y, F.lpad(m, 2, "0"))))))


@dataclass(frozen=True)
class Bonus:
    """Points for a question with some of the topics and a table with some of the fields: once, or (every) once if it has
    all of them, or (each) for each of them up to most."""

    topics: tuple[str, ...]
    fields: tuple[str, ...]
    points: float
    every: bool = False
    each: bool = False
    most: float = float("inf")

    def of(self, asks: Column, fields: Column) -> Column:
        held = [F.array_contains(fields, f) for f in self.fields]
        if self.each:
            gain = F.least(F.lit(self.most), self.points * sum((h.cast("int") for h in held), F.lit(0)))
        else:
            gain = F.when(all_of(held) if self.every else any_of(held), self.points).otherwise(0.0)
        return F.when(any_of([F.array_contains(asks, t) for t in self.topics]), gain).otherwise(0.0)


def topic_bonus(asks: Column, fields: Column, bonuses: list[Bonus]) -> Column:
    """The sum of what a question's topics (asks) give where a table has the fields that a topic is about."""
    return sum((b.of(asks, fields) for b in bonuses), F.lit(0.0))


def rank_rows(questions: DataFrame, ranked: DataFrame, rows: DataFrame, bonuses: list[Bonus], n: int = 20) -> DataFrame:
    """For each question (question_id, places, month, tokens, asks) the n best rows of its documents (ranked: question_id,
    document, doc_rank from 0, and title); equal scores by doc_rank, document, sheet and row.

    0.4 less 0.05 a rank; 0.6 a place that the row names; for a month 8 on its sheet, 1.5 in the row, else -1.25, and
    without one 0.35 on a sheet of a month that the title names; a token 0.18, or 0.28 beyond three characters; and what
    topics give. A row's text takes in its sheet, its cells and its document's title. Header rows (is_header) score -1.
    rows: document, sheet, row_number, row, row_keys, fields and, where there are such, is_header."""
    if "title" not in ranked.columns:
        ranked = ranked.withColumn("title", F.lit(""))
    ranked = month_tokens(ranked, "title").withColumnRenamed("months", "title_months")
    cells = F.lower(F.concat_ws(" ", "sheet", F.array_join("row_keys", " "), F.array_join(F.transform("row_keys", lambda k: clean(F.element_at("row", k))), " ")))
    header = F.coalesce(F.col("is_header"), F.lit(False)) if "is_header" in rows.columns else F.lit(False)
    pairs = dealt_join(rows.select("document", "sheet", "row_number", "fields", cells.alias("cells"), header.alias("header")), ranked.join(questions, "question_id"))
    pairs = pairs.withColumn("text", F.concat_ws(" ", "cells", F.lower("title")))
    total = lambda c, f: F.aggregate(F.transform(c, f), F.lit(0.0), lambda a, x: a + x)
    held = lambda t: F.contains("text", F.lower(t))
    titled = F.when(F.array_contains("title_months", F.col("sheet")), 0.35).otherwise(0.0)
    month = F.when(F.col("month").isNull(), titled).when(F.col("sheet") == F.col("month"), 8.0).when(held(F.col("month")), 1.5).otherwise(-1.25)
    score = 0.4 - 0.05 * F.col("doc_rank") + total("places", lambda p: F.when(held(p), 0.6).otherwise(0.0)) + month + total("tokens", lambda t: F.when(held(t), F.when(F.length(t) <= 3, 0.18).otherwise(0.28)).otherwise(0.0)) + topic_bonus(F.col("asks"), F.col("fields"), bonuses)
    scored = pairs.withColumn("score", F.when(F.col("header"), -1.0).otherwise(F.round(score, 4)))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_rank", "document", "sheet", "row_number")))
    return best.where(F.col("rank") <= n).select("question_id", "document", "sheet", "row_number", "score", "rank")


def rank_tables(questions: DataFrame, docs: DataFrame, bonuses: list[Bonus], least: float = 0.45, n: int = 3) -> DataFrame:
    """Documents (document, title, samples, months, fields) for each question (question_id, terms, months, asks).

    0.04; a term 0.12 in the title and 0.03 in the samples, or 0.18 and 0.05 beyond three characters; 0.32 for a month
    that title or samples name, 0.5 for one that a sheet is of (months); and what topics give. Of those with least or more
    the n best, the newest (created_at, where docs have it) of equal ones first, then by document."""
    rules = list(bonuses)
    low = lambda c: F.transform(c, F.lower)
    asked = questions.select("question_id", low("terms").alias("terms"), low("months").alias("months"), F.array_join("asks", "\x00").alias("asks"), F.array_join("months", "\x00").alias("sheets"))
    newest = "created_at" if "created_at" in docs.columns else None
    texts = docs.select("document", *([newest] if newest else []), F.lower("title").alias("title"), F.lower("samples").alias("samples"), F.array_join("months", "\x00").alias("of_months"), F.array_join("fields", "\x00").alias("of_fields"))
    short = lambda a, b: lambda t: a if len(t) <= 3 else b
    counts = {"titled": Count("terms", ("title",), short(0.12, 0.18)), "sampled": Count("terms", ("samples",), short(0.03, 0.05)), "named": Count("months", ("title", "samples"))}

    def score(c: dict, q: dict, texts: dict) -> tuple[np.ndarray, np.ndarray]:
        parts = lambda x: [{*y.split("\x00")} - {""} if y else set() for y in x]
        asks, sheets, fields, months = parts(q["asks"]), parts(q["sheets"]), parts(texts["of_fields"]), parts(texts["of_months"])
        given = np.array([[sum(_points(b, a, f) for b in rules) for a in asks] for f in fields]).reshape(c["named"].shape)
        of_sheet = np.array([[not s.isdisjoint(m) for s in sheets] for m in months]).reshape(c["named"].shape)
        total = 0.04 + c["titled"] + c["sampled"] + 0.32 * (c["named"] > 0) + 0.5 * of_sheet + given
        return total, np.floor(total * 1e4 + 0.5) / 1e4 >= least

    return topk(asked, texts, n, counts, score, ["document"], columns=("of_months", "of_fields"), digits=4, newest=newest).select("question_id", "document", "score", "rank")


def _points(b: Bonus, asks: set[str], fields: set[str]) -> float:
    """What Bonus.of gives, for sets."""
    if asks.isdisjoint(b.topics):
        return 0.0
    held = len(fields.intersection(b.fields))
    return min(b.most, b.points * held) if b.each else b.points if held == len(b.fields) or held and not b.every else 0.0


@dataclass(frozen=True)
class Step:
    """A filter of a table query: rows that meet condition stay, for questions that ask for it (a boolean column; none: all).

    A soft step is passed over where no row that is left meets it."""

    name: str
    condition: Column
    asked: Column | None = None
    soft: bool = False


def _meets(bit: int, counted: Column) -> Column:
    return counted["met"].bitwiseAND(bit) != 0


def table_query(questions: DataFrame, ranked: DataFrame, rows: DataFrame, steps: list[Step], distinct: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that all steps leave for each question, and a row of counters for each question.

    questions has what the steps' asked columns read; ranked: question_id and document, the documents that a question
    looks at; rows: document and what the conditions read. Counters: documents, rows, how many rows met each step when its
    turn came (0 if it isn't asked for), matched (rows left) and, with distinct, different (its different values among
    them; nulls and empty texts aren't counted). Rows are read once for the counters: they are counted by the set of steps
    that they meet, and a question's steps are decided on these counts, of which there are 2 ** len(steps) at most."""
    mask = sum((F.when(F.coalesce(s.condition, F.lit(False)), 1 << k).otherwise(0) for k, s in enumerate(steps)), F.lit(0))
    value = F.nullif(distinct.cast("string"), F.lit("")) if distinct is not None else F.lit(None).cast("string")
    few = ranked.select("question_id", "document").distinct()
    marked = dealt_join(rows.select("*", mask.alias("met"), value.alias("held")), few)
    sets = marked.groupBy("question_id", "met").agg(F.count("*").alias("n")).groupBy("question_id").agg(F.collect_list(F.struct("met", "n")).alias("left"))
    looked = ranked.select("question_id", "document").distinct().groupBy("question_id").agg(F.count("*").alias("documents"))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y["n"])
    state = questions.join(looked, "question_id", "left").join(sets, "question_id", "left").withColumn("left", F.coalesce("left", F.array().cast(sets.schema["left"].dataType))).fillna({"documents": 0}).withColumn("rows", total("left"))
    for k, s in enumerate(steps):
        asked = F.coalesce(s.asked, F.lit(False)) if s.asked is not None else F.lit(True)
        bit = 1 << k
        met = F.filter("left", lambda y: _meets(bit, y))  # noqa: B023
        state = state.withColumn("next", met).withColumn("asked_", asked)
        state = state.withColumn(s.name, F.when(F.col("asked_"), total("next")).otherwise(0))
        passed = F.col("asked_") & (F.size("next") > 0) if s.soft else F.col("asked_")
        state = state.withColumn("left", F.when(passed, F.col("next")).otherwise(F.col("left"))).drop("next", "asked_")
    state = state.withColumn("matched", total("left"))
    kept = marked.join(state.select("question_id", F.explode("left").alias("x")).select("question_id", "x.met"), ["question_id", "met"])
    counters = state.select("question_id", "documents", "rows", *[s.name for s in steps], "matched")
    if distinct is not None:
        different = kept.groupBy("question_id").agg(F.countDistinct("held").alias("different"))
        counters = counters.join(different, "question_id", "left").fillna({"different": 0})
    return kept.drop("met", "held"), counters


def table_counters(rows: DataFrame, ranked: DataFrame, filters: dict[str, Column], distinct: Column) -> DataFrame:
    """For each question the rows of its documents (ranked: question_id, document), how many are left after each filter in
    turn, and how many different values these have."""
    both = dealt_join(rows, ranked.select("question_id", "document"))
    flags, met = {}, F.lit(True)
    for name, condition in filters.items():
        met = met & F.coalesce(condition, F.lit(False))
        flags[name] = met
    return both.groupBy("question_id").agg(F.count("*").alias("rows"), *[F.count_if(c).alias(name) for name, c in flags.items()], F.countDistinct(F.when(met, distinct)).alias("distinct"))


def split_cells(text: Column) -> Column:
    """cell and value of texts like `A1: name | B1: sum A2: x`: a value ends before the next cell's name."""
    marked = F.split(F.regexp_replace(text, r"\s*(?:\|\s*)?\b([A-Z]{1,3}[0-9]+)\s*[:：]\s*", "\n$1\t"), "\n")
    pairs = F.transform(F.filter(marked, lambda x: F.contains(x, F.lit("\t"))), lambda x: F.struct(F.substring_index(x, "\t", 1).alias("cell"), clean(F.substring(x, F.locate("\t", x) + 1, F.length(x))).alias("value")))
    return F.filter(pairs, lambda p: p["value"] != "")


def records_from_cells(chunks: DataFrame, least: int = 4) -> DataFrame:
    """doc_id, row_number and fields (name=value, in column order) of rows told as cells in overlapping chunks.

    Row 1 names the columns: the shortest name that any chunk gives. Of repeated cells the last chunk's counts, and rows
    with fewer than least fields are pieces of broken chunks and are left out."""
    cells = chunks.select("doc_id", "chunk_index", F.posexplode(split_cells(F.col("content"))).alias("pos", "x"))
    placed = cells.select("doc_id", "chunk_index", "pos", F.regexp_extract("x.cell", "[0-9]+", 0).cast("int").alias("row_number"), F.regexp_extract("x.cell", "[A-Z]+", 0).alias("col"), "x.value")
    names = placed.where("row_number = 1").groupBy("doc_id", "col").agg(F.min_by("value", F.struct(F.length("value"), "value")).alias("name"))
    values = placed.where("row_number > 1").groupBy("doc_id", "row_number", "col").agg(F.max_by("value", F.struct("chunk_index", "pos")).alias("value"))
    named = values.join(names, ["doc_id", "col"], "left").join(names.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = named.groupBy("doc_id", "row_number").agg(F.array_sort(F.collect_list(F.struct("col", F.concat_ws("=", F.coalesce("name", "col"), "value").alias("field")))).alias("f"))
    return rows.where(F.size("f") >= least).select("doc_id", "row_number", F.transform("f", lambda x: x["field"]).alias("fields"))
