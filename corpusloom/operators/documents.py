"""Documents: classification by markers and rules, chunk and page profiles, quality issues, grades and actions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import any_of

KINDS = ("spreadsheet", "form", "workorder", "guide", "policy", "general")
SEVERITY = {"critical": 0, "warning": 1, "info": 2}
#: Points that an issue of a severity takes from 100.
COST = {"critical": 35, "warning": 15, "info": 5}
ACTIONS = {"file_missing": "reupload", "file_empty": "reupload", "processing_failed": "reparse", "no_chunks": "reparse", "very_low_text": "reparse", "empty_chunks": "reparse", "many_short_chunks": "reparse", "duplicate_chunks": "reparse", "page_index_stale": "rebuild_page_index", "page_index_missing": "rebuild_page_index", "page_index_failed": "rebuild_page_index"}


def first_of(cases: list[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first condition that holds."""
    return reduce(lambda c, x: c.when(x[0], x[1]), cases[1:], F.when(cases[0][0], cases[0][1])).otherwise(otherwise)


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"(\.[A-Za-z0-9]+)$", 1))


def infer_kind(docs: DataFrame, markers: dict[str, list[str]]) -> DataFrame:
    """docs (title, filename, sample) and kind: spreadsheets are forms or tables, others the first kind with a marker."""
    text = F.lower(F.concat_ws(" ", "title", "sample"))
    has = lambda kind: any_of([F.contains(text, F.lit(m)) for m in markers.get(kind, [])])
    sheet = extension(F.col("filename")).isin(".xlsx", ".xls", ".csv")
    return docs.withColumn("kind", first_of([(sheet & has("form"), "form"), (sheet, "table"), *[(has(k), k) for k in KINDS[1:5]]], "general"))


def score_kinds(docs: DataFrame, rules: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """doc_id, kind, score and reasons: the best of the rules (kind, extensions, markers), in order for equal scores.

    An extension gives 0.52, markers 0.34 and 0.12 for each further one up to 0.68, the kind general 0.18; below 0.2
    the kind is general with 0.2."""
    text = F.lower(F.concat_ws(" ", "title", "sample"))

    def scored(k: int, kind: str, extensions: list[str], markers: list[str]) -> Column:
        hits = F.filter(F.array(*[F.when(F.contains(text, F.lit(m)), m) for m in markers] or [F.lit(None).cast("string")]), lambda m: m.isNotNull())
        ext = extension(F.col("filename")).isin(*extensions) if extensions else F.lit(False)
        score = F.when(ext, 0.52).otherwise(0.0) + F.when(F.size(hits) > 0, F.least(F.lit(0.68), 0.34 + 0.12 * (F.size(hits) - 1))).otherwise(0.0) + (0.18 if kind == "general" else 0.0)
        reasons = F.concat(F.when(ext, F.array(F.lit("extension"))).otherwise(F.array().cast("array<string>")), hits)
        return F.struct(F.round(score, 4).alias("score"), F.lit(-k).alias("order"), F.lit(kind).alias("kind"), F.array_join(reasons, ",").alias("reasons"))

    best = docs.select("doc_id", F.array_max(F.array(*[scored(k, *r) for k, r in enumerate(rules)])).alias("x"))
    weak = F.col("x.score") < 0.2
    return best.select("doc_id", F.when(weak, "general").otherwise(F.col("x.kind")).alias("kind"), F.when(weak, 0.2).otherwise(F.col("x.score")).alias("score"), "x.reasons")


def kind_status(scored: DataFrame, current: DataFrame, threshold: float = 0.55) -> DataFrame:
    """The new kind and status of each document; one that people confirmed keeps its kind."""
    both = scored.join(current.select("doc_id", F.col("kind").alias("old_kind"), F.col("status").alias("old_status")), "doc_id", "left")
    fixed = F.coalesce(F.col("old_status") == "confirmed", F.lit(False))
    return both.select("doc_id", F.when(fixed, F.col("old_kind")).otherwise(F.col("kind")).alias("kind"), "old_kind", F.when(fixed, "confirmed").when(F.col("score") < threshold, "needs_review").otherwise("auto").alias("status"))


def reclassify_report(statuses: DataFrame) -> DataFrame:
    return statuses.agg(F.count("*").alias("total"), F.count_if(F.col("kind") != F.coalesce("old_kind", F.lit(""))).alias("changed"), F.count_if(F.col("status") == "needs_review").alias("needs_review"))


def allowed_kinds(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """query_id and the kinds of the first rule (priority, topic, route, kinds; null matches all) that a query meets.

    A rule with a null is found under a mark, and a query looks under its own values and the mark, so that rules of any
    number meet queries by equal keys. A null topic or route of a query meets rules without one alone."""
    mark = "\0"
    key = lambda a, b: F.concat_ws("\1", F.coalesce(a, F.lit(mark)), F.coalesce(b, F.lit(mark)))
    asked = queries.select("query_id", F.explode(F.array_distinct(F.array(*[key(t, r) for t in (F.col("topic"), F.lit(None).cast("string")) for r in (F.col("route"), F.lit(None).cast("string"))]))).alias("key"))
    met = asked.join(rules.select(key(F.col("topic"), F.col("route")).alias("key"), "priority", "kinds"), "key", "left")
    return met.groupBy("query_id").agg(F.min_by("kinds", "priority").alias("kinds"))


def sanitize_rules(rules: DataFrame, known: list[str]) -> DataFrame:
    """Rules (priority, name, kinds, threshold) with slugs for names, known kinds alone, thresholds in 0.05 to 0.95, and
    the first of each name; rules without a kind are dropped."""
    slug = F.btrim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "_"), F.lit("_"))
    cleaned = rules.select("priority", slug.alias("name"), F.array_intersect("kinds", F.array(*map(F.lit, known))).alias("kinds"), F.least(F.lit(0.95), F.greatest(F.lit(0.05), "threshold")).alias("threshold"))
    return cleaned.where((F.size("kinds") > 0) & (F.col("name") != "")).withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("priority"))).where("k = 1").drop("k")


def normalize_kind(kind: Column, aliases: dict[str, str], otherwise: str = "general") -> Column:
    """A kind by its alias table; unknown ones become the given kind."""
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.element_at(table, F.trim(F.lower(kind))), F.lit(otherwise))


def effective_kind(docs: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """The stored kind where there is one, else the inferred one."""
    return docs.withColumn("effective", F.when(F.coalesce(F.trim("stored"), F.lit("")) != "", normalize_kind(F.col("stored"), aliases)).otherwise(F.col("kind")))


def sample_text(chunks: DataFrame, n: int = 3, chars: int = 4000) -> DataFrame:
    """The first n chunks of each document, at most so many characters."""
    first = chunks.where(F.col("chunk_index") < n).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("c"))
    return first.select("doc_id", F.left(F.array_join(F.transform("c", lambda x: x["content"]), "\n"), F.lit(chars)).alias("sample"))


def chunk_profile(chunks: DataFrame, short: int = 80) -> DataFrame:
    """Counts and lengths of each document's chunks, and how many are short, empty, or repeat another but for case and space."""
    size = F.length(F.trim("content"))
    same = chunks.groupBy("doc_id", F.md5(F.lower(F.regexp_replace("content", r"\s+", ""))).alias("key")).agg(F.count("*").alias("n"), F.sum(size).alias("chars"), F.min(size).alias("lo"), F.max(size).alias("hi"), F.count_if((size > 0) & (size < short)).alias("short"), F.count_if(size == 0).alias("empty"))
    return same.groupBy("doc_id").agg(F.sum("n").alias("chunks"), F.sum("chars").alias("chars"), (F.sum("chars") / F.sum("n")).alias("mean_chars"), F.min("lo").alias("least_chars"), F.max("hi").alias("most_chars"), F.sum("short").alias("short"), F.sum("empty").alias("empty"), F.sum(F.col("n") - 1).alias("repeated"))


def table_profile(rows: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """Figures of each document and of each of its sheets (sheet not null): header and data rows, different layouts, columns,
    sparse data rows (one value at most), rows that could not be read (row is null), and the semantic fields found.

    rows: document, sheet, row, row_keys and is_header; fields: for each semantic field the column names that mean it."""
    filled = F.size(F.filter(F.map_values("row"), lambda v: F.trim(F.coalesce(v, F.lit(""))) != ""))
    known = F.array_compact(F.array(*[F.when(F.arrays_overlap(F.transform("row_keys", F.lower), F.array(*map(F.lit, names))), F.lit(field)) for field, names in fields.items()]))
    flags = rows.select("document", "sheet", "is_header", F.col("row").isNull().alias("failed"), filled.alias("filled"), "row_keys", known.alias("known"))
    plain = ~F.col("is_header") & ~F.col("failed")
    found = flags.rollup("document", "sheet").agg(F.count("*").alias("rows"), F.count_if("is_header").alias("headers"), F.count_if(plain).alias("data"), F.countDistinct("row_keys").alias("layouts"), F.max(F.size("row_keys")).alias("columns"), F.count_if(plain & (F.col("filled") <= 1)).alias("sparse"), F.count_if("failed").alias("failed"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("known")))), ",").alias("fields"))
    return found.where("document is not null")


def parse_diagnostics(statuses: DataFrame) -> DataFrame:
    """reason, extracted, threshold and after_ocr that a status message names as key=value."""
    number = lambda key: F.regexp_extract("message", key + r"=([0-9]+)", 1).try_cast("int").alias(key)
    return statuses.select("doc_id", F.nullif(F.regexp_extract("message", r"reason=(\w+)", 1), F.lit("")).alias("reason"), number("extracted"), number("threshold"), number("after_ocr"))


def document_issues(docs: DataFrame) -> DataFrame:
    """doc_id, code and severity of every issue.

    docs: doc_id, file_exists, file_bytes, status, chunks, chars, short, empty, repeated, is_table, table_rows,
    header_rows, semantic_columns, sparse, page_index; null counts are 0."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    issues = [
        ("file_missing", "critical", ~F.col("file_exists")),
        ("file_empty", "critical", F.col("file_exists") & (n("file_bytes") == 0)),
        ("processing_failed", "critical", F.col("status") == "failed"),
        ("processing_not_finished", "warning", F.col("status").isin("pending", "running")),
        ("no_chunks", "critical", n("chunks") == 0),
        ("very_low_text", "warning", (n("chunks") > 0) & (n("chars") < 80)),
        ("empty_chunks", "warning", n("empty") > 0),
        ("many_short_chunks", "info", (n("short") > 0) & (n("short") >= F.greatest(F.lit(3), F.floor(n("chunks") / 2)))),
        ("duplicate_chunks", "info", n("repeated") > 0),
        ("no_table_rows", "critical", F.col("is_table") & (n("table_rows") == 0)),
        ("no_header_rows", "warning", F.col("is_table") & (n("table_rows") > 0) & (n("header_rows") == 0)),
        ("no_semantic_columns", "warning", F.col("is_table") & (n("table_rows") > 0) & (n("semantic_columns") == 0)),
        ("sparse_table_rows", "info", F.col("is_table") & (n("sparse") > 0)),
        ("page_index_failed", "warning", F.col("page_index") == "failed"),
        ("page_index_stale", "info", F.col("page_index") == "stale"),
        ("page_index_missing", "info", F.col("page_index") == "not_built"),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, c in issues]))
    return docs.select("doc_id", F.explode(found).alias("i")).select("doc_id", "i.code", "i.severity")


def grade(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """score (100 less each issue's cost) and grade of every document: blocked, good from 85, needs_review from 65, poor."""
    costs = issues.groupBy("doc_id").agg(F.sum(first_of([(F.col("severity") == s, c) for s, c in COST.items()], 0)).alias("cost"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count("*").alias("issues"))
    both = docs.select("doc_id").join(costs, "doc_id", "left").select("doc_id", F.greatest(F.lit(0), 100 - F.coalesce("cost", F.lit(0))).cast("long").alias("score"), F.coalesce("critical", F.lit(0)).alias("critical"), F.coalesce("issues", F.lit(0)).alias("issues"))
    return both.select("doc_id", "score", "issues", first_of([(F.col("critical") > 0, "blocked"), (F.col("score") >= 85, "good"), (F.col("score") >= 65, "needs_review")], "poor").alias("grade"))


def recommended_actions(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """The actions that a document's issues ask for, joined by commas, or none."""
    action = first_of([(F.col("code") == k, v) for k, v in ACTIONS.items()], None)
    found = issues.select("doc_id", action.alias("action")).where("action is not null").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("action")), ",").alias("actions"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("actions", F.lit("none")).alias("actions"))


def select_reparse(graded: DataFrame, docs: DataFrame, tasks: DataFrame, grades: list[str]) -> DataFrame:
    """Documents of some grades with what keeps them from being parsed again, or null."""
    busy = tasks.where(F.col("status").isin("pending", "running")).select("doc_id").distinct().withColumn("busy", F.lit(True))
    found = graded.where(F.col("grade").isin(*grades)).join(docs.select("doc_id", "filename", "source_type", "file_exists"), "doc_id").join(busy, "doc_id", "left")
    reason = first_of([(F.startswith("source_type", F.lit("chat_")), "not_reparseable"), (F.col("busy").isNotNull(), "pending_task"), (~F.col("file_exists"), "missing_file"), (~extension(F.col("filename")).isin(".txt", ".md", ".pdf", ".xlsx", ".csv"), "bad_extension")], None)
    return found.select("doc_id", "grade", reason.alias("skipped"))


def quality_signal(graded: DataFrame) -> DataFrame:
    """What a grade takes from a retrieval score."""
    return graded.select("doc_id", "grade", first_of([(F.col("grade") == "blocked", 0.45), (F.col("grade") == "poor", 0.18)], 0.0).alias("penalty"))


def quality_rows(docs: DataFrame, profile: DataFrame, issues: DataFrame, graded: DataFrame) -> DataFrame:
    """One report row a document: its profile, issue codes from severe to mild, score, grade and actions."""
    rank = first_of([(F.col("severity") == s, r) for s, r in SEVERITY.items()], 9)
    codes = issues.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "code"))).alias("i")).select("doc_id", F.array_join(F.transform("i", lambda x: x["code"]), ",").alias("codes"))
    return docs.select("doc_id", "title").join(profile.select("doc_id", "chunks", "chars"), "doc_id", "left").join(codes, "doc_id", "left").join(graded.select("doc_id", "score", "grade"), "doc_id").join(recommended_actions(docs, issues), "doc_id").fillna({"chunks": 0, "chars": 0, "codes": ""})


def document_diagnostics(docs: DataFrame, chunks: DataFrame, graded: DataFrame, n: int = 5, chars: int = 60) -> DataFrame:
    """Title, grade and a preview of the first n chunks of each document."""
    first = chunks.where(F.col("chunk_index") < n).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.left("content", F.lit(chars)).alias("p")))).alias("c"))
    return docs.select("doc_id", "title").join(graded.select("doc_id", "grade"), "doc_id").join(first, "doc_id", "left").select("doc_id", "title", "grade", F.coalesce(F.array_join(F.transform("c", lambda x: x["p"]), "|"), F.lit("")).alias("preview"))


def apply_kind_overrides(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """docs (doc_id, kind, score, status) with people's decisions (doc_id, new_kind): sure and confirmed."""
    both = docs.join(changes, "doc_id", "left")
    by_hand = F.col("new_kind").isNotNull()
    return both.select("doc_id", F.coalesce("new_kind", "kind").alias("kind"), F.when(by_hand, 1.0).otherwise(F.col("score")).alias("score"), F.when(by_hand, "confirmed").otherwise(F.col("status")).alias("status"))
