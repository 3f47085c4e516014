"""Wiki pages: compiled from documents with citations, checked for health, linked into a graph, and searched.

Pages have slug, title, page_type, confidence, summary and body (markdown).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected, keep
from .documents import first_of
from .held import held_parts
from .retrieval import cjk_grams, sentences

MARK, LINK = r"\[S([0-9]+)\]", r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"
#: Points that a finding of a severity takes from 100.
COST = {"error": 6.0, "warning": 2.0, "info": 0.5}
#: Weights of what an edge says, and how near the types of its pages are (0.5 where nothing is said).
SIGNALS = {"direct_link": 3.0, "further_link": 0.25, "source_overlap": 4.0, "title_mention": 2.0, "common_neighbor": 1.5, "type_affinity": 1.0}
AFFINITY = {
    "entity": {"concept": 1.2, "entity": 0.8, "source": 1.0, "rule": 1.0, "overview": 0.8},
    "concept": {"entity": 1.2, "concept": 0.8, "source": 1.0, "rule": 1.2, "overview": 1.0},
    "source": {"entity": 1.0, "concept": 1.0, "source": 0.5, "rule": 1.0, "overview": 0.8},
    "rule": {"concept": 1.2, "entity": 1.0, "source": 1.0, "rule": 0.8, "overview": 1.0},
    "overview": {"concept": 1.0, "entity": 0.8, "source": 0.8, "rule": 1.0, "overview": 0.5},
}
#: Groups in which nodes are numbered, and the bit of a node's number above which its degree stands.
NODE_GROUPS, DEGREE_AT = 4096, 38
#: Pages that stand for the structure, not for a topic.
STRUCTURAL_SLUGS, STRUCTURAL_TYPES = ("index", "overview", "log", "schema", "purpose"), ("overview",)


def slugify(text: Column, most: int = 120) -> Column:
    return F.left(F.btrim(F.regexp_replace(F.lower(text), r"[^a-z0-9一-鿿]+", "-"), F.lit("-")), F.lit(most))


# compilation -----------------------------------------------------------------------------------------------------------


def page_sentences(chunks: DataFrame, per_chunk: int) -> DataFrame:
    """doc_id, chunk_index, pos and sentence: the first ones of each chunk."""
    return chunks.select("doc_id", "chunk_index", F.posexplode(F.slice(sentences(F.col("content")), 1, per_chunk)).alias("pos", "sentence"))


def summaries(chunks: DataFrame, per_chunk: int = 3, per_doc: int = 5, chars: int = 1200) -> DataFrame:
    """The first sentences of each document with the marker of their chunk, clipped."""
    order = Window.partitionBy("doc_id").orderBy("chunk_index", "pos")
    first = page_sentences(chunks, per_chunk).withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_doc)
    marked = F.concat("sentence", F.lit(" [S"), F.col("chunk_index") + 1, F.lit("]"))
    return first.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", marked.alias("s")))).alias("s")).select("doc_id", F.left(F.array_join(F.transform("s", lambda x: x["s"]), " "), F.lit(chars)).alias("summary"))


def fact_bullets(chunks: DataFrame, n: int = 12, prefix: int = 80) -> DataFrame:
    """The first sentence of each chunk, each prefix once, at most n a document."""
    first = page_sentences(chunks, 1).withColumn("key", F.lower(F.left("sentence", F.lit(prefix))))
    once = first.groupBy("doc_id", "key").agg(F.min(F.struct("chunk_index", "sentence")).alias("x"))
    return once.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("x.chunk_index"))).where(F.col("k") <= n).select("doc_id", "k", "x.chunk_index", "x.sentence")


def wiki_checksum(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """A digest of a document's id and its chunks in order; documents without chunks have one too."""
    parts = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("c"))
    body = F.coalesce(F.array_join(F.transform("c", lambda x: F.concat(x["chunk_index"].cast("string"), F.lit(":"), x["content"])), "\n"), F.lit(""))
    return docs.select("doc_id").join(parts, "doc_id", "left").select("doc_id", F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("\n"), body), 256).alias("checksum"))


def derived_pages(chunks: DataFrame, families: dict[str, list[str]], n: int = 8) -> DataFrame:
    """doc_id, page_type, chunk_index, score and k: the n chunks with most of a family's words, later ones first among equals."""
    scores = [F.struct(F.lit(name).alias("page_type"), sum((F.when(F.contains(F.lower("content"), F.lit(w)), 1).otherwise(0) for w in words), F.lit(0)).alias("score")) for name, words in families.items()]
    hits = chunks.select("doc_id", "chunk_index", F.explode(F.array(*scores)).alias("x")).select("doc_id", "chunk_index", "x.*").where("score > 0")
    return hits.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "page_type").orderBy(F.desc("score"), F.desc("chunk_index")))).where(F.col("k") <= n)


def page_confidence(chunks: Column, derived: Column) -> Column:
    """0.68 for derived pages, else 0.74 and 0.01 a chunk up to 0.86."""
    return F.when(derived, 0.68).otherwise(F.least(F.lit(0.86), 0.74 + 0.01 * chunks))


#: What a page is made by, and the words of its fixed parts; other languages may be passed.
COMPILER, PROMPT, DERIVED_CONFIDENCE = "rules-2", "derived-1", 0.68
LABELS = {
    "note": "This page is compiled from its document by rules. Marks such as [S1] name the sources below.", "summary": "Summary", "no_summary": "Not enough text for a summary.", "facts": "Key facts", "no_facts": "No facts were found.",
    "notes": "Notes", "kind": "Page type", "document": "Document", "scope": "Scope", "compiler": "Compiler", "rule": "Answers rest on facts with a source mark; what no mark supports is not known.", "excerpts": "Excerpts", "chunk": "chunk", "page": "page", "no_page": "no page",
    "sources": "Sources", "evidence": "Evidence", "id": "Document id", "file": "File", "made": "Extracted by rules from", "related": "Related pages",
}


def quoted(text: Column) -> Column:
    """A text as a scalar of front matter."""
    return F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def excerpt(text: Column, most: int = 700) -> Column:
    """A text with white space squeezed, clipped at most characters."""
    flat = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.left(flat, F.lit(most))), F.lit("…")))


def _bullets(rows: DataFrame, by: list[str], order: str, line: Column, name: str) -> DataFrame:
    """The lines of each group in order, as one text."""
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), line.alias("l")))), lambda x: x["l"]), "\n").alias(name))


def _front(title: Column, kind: Column, at: str, confidence: Column, count: Column) -> Column:
    lines = {"title": quoted(title), "type": kind, "source_document_id": quoted(F.col("doc_id")), "knowledge_scope": quoted(F.col("scope")), "compiler_version": quoted(F.lit(COMPILER)), "prompt_version": quoted(F.lit(PROMPT)), "confidence": confidence, "source_chunk_count": count, "compiled_at": quoted(F.lit(at))}
    return F.concat(F.lit("---\n"), *[x for k, v in lines.items() for x in (F.lit(f"{k}: "), v.cast("string"), F.lit("\n"))], F.lit("---\n"))


def _place(label: dict[str, str]) -> Column:
    return F.when(F.coalesce("page", F.lit(0)) > 0, F.concat(F.lit(f"{label['page']} "), F.col("page").cast("string"))).otherwise(label["no_page"])


def _source_line(label: dict[str, str], marker: Column) -> Column:
    return F.concat(F.lit("- [S"), marker.cast("string"), F.lit(f"] {label['document']}: "), F.col("title"), F.lit(f"; {label['id']}: `"), F.col("doc_id").cast("string"), F.lit(f"`; {label['chunk']} "), F.col("chunk_index").cast("string"), F.lit("; "), _place(label), F.lit("."))


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def render_pages(docs: DataFrame, chunks: DataFrame, at: str, label: dict[str, str] = LABELS, sources: int = 24) -> DataFrame:
    """doc_id, slug and body of each document's page: front matter with its provenance, summary and facts with source marks,
    notes, excerpts and index of the first sources chunks, and the evidence. Documents without chunks have a page too.

    docs: doc_id, title, filename, scope; chunks: doc_id, chunk_index from 0, page, content."""
    own = docs.select("doc_id", F.coalesce(F.nullif("title", F.lit("")), "filename", F.lit("Untitled document")).alias("title"), F.coalesce("filename", F.lit("")).alias("filename"), F.coalesce("scope", F.lit("production")).alias("scope"))
    marked = F.concat(F.lit("- "), F.col("sentence"), F.lit(" [S"), F.col("chunk_index") + 1, F.lit("]"))
    first = page_sentences(chunks, 3).withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index", "pos"))).where("k <= 5")
    named = chunks.where(F.col("chunk_index") < sources).join(own, "doc_id")
    head = _text("### [S", F.col("chunk_index") + 1, f"] {label['chunk']} ", F.col("chunk_index"), " · ", _place(label), "\n", excerpt(F.col("content")))
    parts = [
        _bullets(first, ["doc_id"], "k", marked, "summary"), _bullets(fact_bullets(chunks.where(F.col("chunk_index") < sources)), ["doc_id"], "k", marked, "facts"), _bullets(named, ["doc_id"], "chunk_index", F.concat(F.lit("\n"), head), "excerpts"),
        _bullets(named, ["doc_id"], "chunk_index", _source_line(label, F.col("chunk_index") + 1), "index"), chunks.groupBy("doc_id").agg(F.count("*").alias("n")),
    ]
    both = own
    for p in parts:
        both = both.join(p, "doc_id", "left")
    or_else = lambda c, key: F.coalesce(c, F.lit(f"- {label[key]}"))
    n = F.coalesce("n", F.lit(0))
    section = lambda key: f"\n\n## {label[key]}\n"
    t = F.col("title")
    body = _text(
        _front(t, F.lit("source"), at, F.round(page_confidence(F.greatest(n - 1, F.lit(0)), F.lit(False)), 2), n), "\n# ", t, f"\n\n> {label['note']}",
        section("summary"), or_else("summary", "no_summary"), section("facts"), or_else("facts", "no_facts"),
        section("notes"), f"- {label['kind']}: source\n- {label['document']}: ", t, f"\n- {label['scope']}: ", F.col("scope"), f"\n- {label['compiler']}: {COMPILER}\n- {label['rule']}",
        section("excerpts"), F.coalesce("excerpts", F.lit("")), section("sources"), F.coalesce("index", F.lit("")),
        section("evidence"), f"- {label['document']}: ", t, f"\n- {label['id']}: `", F.col("doc_id"), f"`\n- {label['file']}: `", F.col("filename"), "`\n",
    )
    return both.select("doc_id", slugify(t).alias("slug"), body.alias("body"))


def render_derived(docs: DataFrame, chunks: DataFrame, derived: DataFrame, at: str, label: dict[str, str] = LABELS, links: int = 8) -> DataFrame:
    """doc_id, page_type, slug, summary and body of the pages derived from documents (derived: doc_id, page_type,
    chunk_index, k): up to eight facts of their chunks, links to the document's page and to its other derived pages, at
    most links, and an index of the chunks, whose marks are their places in the page."""
    own = docs.select("doc_id", "title", F.coalesce("scope", F.lit("production")).alias("scope"))
    chosen = derived.select("doc_id", "page_type", "chunk_index", "k").join(chunks.select("doc_id", "chunk_index", "page", "content"), ["doc_id", "chunk_index"]).join(own, "doc_id")
    by = ["doc_id", "page_type"]
    said = chosen.select(*by, "k", F.posexplode(F.slice(sentences(F.col("content")), 1, 2)).alias("pos", "sentence")).withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("k", "pos"))).where("place <= 8")
    line = F.concat(F.lit("- "), "sentence", F.lit(" [S"), F.col("k"), F.lit("]"))
    told = said.withColumn("first", F.min("place").over(Window.partitionBy(*by, "sentence"))).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", F.when(F.col("first") == F.col("place"), F.col("sentence")).alias("s")))).alias("t"))
    summary = told.select(*by, F.left(F.array_join(F.transform(F.filter("t", lambda x: x["s"].isNotNull()), lambda x: x["s"]), " "), F.lit(900)).alias("summary"))
    types = chosen.select(*by, "title", "scope").distinct()
    name = lambda t, kind: F.concat(t, F.lit(" "), kind)
    link = lambda t, s: F.concat(F.lit("- [["), t, F.lit("|"), s, F.lit("]]"))
    up = types.select(*by, F.lit(0).alias("k"), link(F.col("title"), slugify(F.col("title"))).alias("l"))
    others = types.select("doc_id", F.col("page_type").alias("other"))
    sibling = name(F.col("title"), F.col("other"))
    side = types.join(others, "doc_id").where("page_type <> other").select(*by, F.row_number().over(Window.partitionBy(*by).orderBy("other")).alias("k"), link(sibling, slugify(sibling)).alias("l"))
    related = up.unionByName(side.where(F.col("k") < links))
    parts = [_bullets(said, by, "place", line, "facts"), _bullets(said.where("place <= 5"), by, "place", line, "heads"), summary, _bullets(related, by, "k", F.col("l"), "links"), _bullets(chosen, by, "k", _source_line(label, F.col("k")), "index"), chosen.groupBy(*by).agg(F.count("*").alias("n"))]
    both = types
    for p in parts:
        both = both.join(p, by, "left")
    t, none = name(F.col("title"), F.col("page_type")), F.lit(f"- {label['no_facts']} [S1]")
    body = _text(
        _front(t, F.col("page_type"), at, F.lit(DERIVED_CONFIDENCE), F.col("n")), "\n# ", t, f"\n\n> {label['made']} [[", F.col("title"), "|", slugify(F.col("title")), "]].",
        f"\n\n## {label['summary']}\n", F.coalesce("heads", none), f"\n\n## {label['facts']}\n", F.coalesce("facts", none), f"\n\n## {label['related']}\n", F.col("links"), f"\n\n## {label['sources']}\n", F.col("index"), "\n",
    )
    return both.select(*by, slugify(t).alias("slug"), F.coalesce("summary", F.lit("")).alias("summary"), body.alias("body"))


def page_sources(chunks: DataFrame, n: int = 24, chars: int = 360) -> DataFrame:
    """The first n chunks of each document as its page's numbered sources, with quotes."""
    return chunks.where(F.col("chunk_index") < n).select("doc_id", (F.col("chunk_index") + 1).alias("marker"), F.left(F.trim("content"), F.lit(chars)).alias("quote"))


def page_links(derived: DataFrame) -> DataFrame:
    """Links between a document's main page and its derived pages, and among these (source, target, kind)."""
    types = derived.select("doc_id", "page_type").distinct()
    down = types.select("doc_id", F.lit("main").alias("source"), F.col("page_type").alias("target"), F.lit("derived").alias("kind"))
    siblings = types.join(types.select("doc_id", F.col("page_type").alias("other")), "doc_id").where("page_type <> other").select("doc_id", F.col("page_type").alias("source"), F.col("other").alias("target"), F.lit("sibling").alias("kind"))
    return down.unionByName(down.select("doc_id", F.col("target").alias("source"), F.col("source").alias("target"), "kind")).unionByName(siblings)


def stale_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pages of recompiled documents that the new compilation hasn't."""
    return old.join(new.select("doc_id").distinct(), "doc_id", "left_semi").join(new, ["doc_id", "page_type"], "left_anti").select("doc_id", "page_type")


def compile_status(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Whether a document's page could be compiled, and how many chunks and sources it has."""
    found = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.when(F.col("chunks") > 0, "compiled").otherwise("failed").alias("status"))


# citations and health --------------------------------------------------------------------------------------------------


def extract_links(pages: DataFrame) -> DataFrame:
    """slug, line and target of every [[link]]."""
    lines = pages.select("slug", F.posexplode(F.split("body", "\n")).alias("line", "text"))
    return lines.select("slug", "line", F.explode(F.regexp_extract_all("text", F.lit(LINK), F.lit(1))).alias("target"))


def extract_markers(pages: DataFrame) -> DataFrame:
    """slug, line and number of every source marker."""
    lines = pages.select("slug", F.posexplode(F.split("body", "\n")).alias("line", "text"))
    return lines.select("slug", "line", F.explode(F.regexp_extract_all("text", F.lit(MARK), F.lit(1))).alias("m")).select("slug", "line", F.col("m").cast("int").alias("marker"))


def claim_blocks(pages: DataFrame, excluded: tuple[str, ...] = ("sources", "links"), least: int = 12) -> DataFrame:
    """slug, block and claim: bullets and paragraphs outside front matter, code fences and excluded sections."""
    lines = pages.select("slug", F.posexplode(F.split("body", "\n")).alias("line", "text"))
    order = Window.partitionBy("slug").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.sum(F.when(F.startswith("text", F.lit("```")), 1).otherwise(0)).over(order)
    matter = F.sum(F.when(F.col("text") == "---", 1).otherwise(0)).over(order)
    fronted = F.max(F.when((F.col("line") == 0) & (F.col("text") == "---"), 1).otherwise(0)).over(order)
    heading = F.nullif(F.regexp_extract("text", r"^#{1,6}\s+(.*)$", 1), F.lit(""))
    marked = lines.withColumns({"code": (fence % 2 == 1) | F.startswith("text", F.lit("```")), "front": (fronted == 1) & (matter < 2), "section": F.lower(F.last(heading, ignorenulls=True).over(order)), "head": heading.isNotNull()})
    body = marked.where(~F.col("code") & ~F.col("front") & (F.col("text") != "---"))
    bullet = F.col("text").rlike(r"^\s*[-*]\s")
    order2 = Window.partitionBy("slug").orderBy("line")
    starts = F.when(F.col("head") | (F.trim("text") == "") | bullet | F.coalesce(F.lag(F.col("head") | (F.trim("text") == "") | bullet).over(order2), F.lit(True)), 1).otherwise(0)
    blocks = body.withColumn("block", F.sum(starts).over(order2.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("head") & (F.trim("text") != "") & ~F.coalesce(F.col("section").isin(*excluded), F.lit(False)))
    joined = blocks.groupBy("slug", "block").agg(F.array_sort(F.collect_list(F.struct("line", F.trim(F.regexp_replace("text", r"^\s*[-*]\s+", "")).alias("t")))).alias("l")).select("slug", "block", F.array_join(F.transform("l", lambda x: x["t"]), " ").alias("claim"))
    return joined.where(F.length("claim") >= least)


def citation_coverage(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims of each page, cited ones, their share, and markers beyond the page's sources."""
    claims = claim_blocks(pages).groupBy("slug").agg(F.count("*").alias("claims"), F.count_if(F.col("claim").rlike(MARK)).alias("cited"))
    limits = sources.groupBy("slug").agg(F.count("*").alias("sources"))
    outside = extract_markers(pages).join(limits, "slug", "left").where((F.col("marker") < 1) | (F.col("marker") > F.coalesce("sources", F.lit(0)))).groupBy("slug").agg(F.count("*").alias("outside"))
    both = pages.select("slug").join(claims, "slug", "left").join(limits, "slug", "left").join(outside, "slug", "left").fillna({"claims": 0, "cited": 0, "sources": 0, "outside": 0})
    return both.withColumn("coverage", F.when(F.col("claims") > 0, F.col("cited") / F.col("claims")).otherwise(1.0))


def resolve_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """links with the slug they lead to (null: broken), found by slug, slug of the title, or title without white space;
    of several pages the first."""
    keys = pages.select("slug", "position", F.explode(F.array_distinct(F.array("slug", slugify(F.col("title")), F.regexp_replace(F.lower("title"), r"\s+", "")))).alias("key"))
    first = keys.groupBy("key").agg(F.min_by("slug", "position").alias("leads_to"))
    return links.join(first, F.lower(F.trim(links["target"])) == F.col("key"), "left").drop("key")


def wiki_findings(pages: DataFrame, sources: DataFrame, page_links: DataFrame | None = None, statuses: DataFrame | None = None) -> DataFrame:
    """slug, rule and severity of everything that is wrong with pages.

    page_links (slug, target): links that were written with the pages; statuses (doc_id, scope, status): how documents
    were compiled. A document that failed is found under the slug `document:` and its id."""
    coverage, links = citation_coverage(pages, sources), resolve_links(pages, extract_links(pages))
    live = links.where("leads_to is not null and leads_to <> slug").select("slug", "leads_to")
    broken = links.where("leads_to is null").select("slug", F.lit("broken-wikilink").alias("rule"))
    if page_links is not None:
        known = page_links.join(pages.select(F.col("slug").alias("target"), F.lit(True).alias("there")), "target", "left")
        live = live.unionByName(known.where("there and target <> slug").select("slug", F.col("target").alias("leads_to")))
        broken = broken.unionByName(known.where("there is null").select("slug", F.lit("broken-page-link").alias("rule")))
    pairs = live.distinct()
    backlinks = pairs.groupBy(F.col("leads_to").alias("slug")).agg(F.count("*").alias("backlinks"))
    outlinks = pairs.groupBy("slug").agg(F.count("*").alias("outlinks"))
    titles = pages.groupBy(F.regexp_replace(F.lower("title"), r"\s+", "").alias("name")).agg(F.count("*").alias("same"))
    facts = pages.withColumn("name", F.regexp_replace(F.lower("title"), r"\s+", "")).join(coverage, "slug").join(backlinks, "slug", "left").join(outlinks, "slug", "left").join(titles, "name").fillna({"backlinks": 0, "outlinks": 0})
    rules = {
        "missing-source": F.col("sources") == 0,
        "missing-summary": F.trim("summary") == "",
        "empty-page": F.length(F.trim("body")) < 80,
        "low-confidence": F.col("confidence") < 0.45,
        "stale-page": F.col("stale"),
        "source-marker-out-of-range": F.col("outside") > 0,
        "low-citation-coverage": (F.col("sources") > 0) & (F.col("claims") > 0) & (F.col("coverage") < 0.55),
        "orphan-page": (F.col("backlinks") == 0) & (F.col("outlinks") == 0),
        "no-backlink": (F.col("backlinks") == 0) & (F.col("outlinks") > 0),
        "duplicate-title": (F.col("name") != "") & (F.col("same") > 1),
    }
    each = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))
    found = facts.select("slug", F.explode(each).alias("rule")).unionByName(broken)
    if statuses is not None:
        found = found.unionByName(statuses.where("status = 'failed'").select(F.concat(F.lit("document:"), "doc_id").alias("slug"), F.lit("compile-failed").alias("rule")))
    severity = first_of([(F.col("rule").isin("missing-source", "empty-page", "source-marker-out-of-range", "compile-failed"), "error"), (F.col("rule") == "no-backlink", "info")], "warning")
    return found.withColumn("severity", severity)


def wiki_health(pages: DataFrame, findings: DataFrame, coverage: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """For each scope its pages, the share of them with sources, claims and the share of them that is cited, findings by
    severity, and the score. coverage is that of citation_coverage; statuses (doc_id, scope) place failed documents."""
    cost = first_of([(F.col("severity") == s, c) for s, c in COST.items()], 0.0)
    where = pages.select("slug", "scope")
    if statuses is not None:
        where = where.unionByName(statuses.select(F.concat(F.lit("document:"), "doc_id").alias("slug"), "scope").distinct())
    found = where.join(findings, "slug").groupBy("scope").agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in COST], F.sum(cost).alias("cost"))
    held = pages.select("slug", "scope").join(coverage, "slug").groupBy("scope").agg(F.count("*").alias("pages"), F.avg((F.col("sources") > 0).cast("double")).alias("source_coverage"), F.sum("claims").alias("claims"), F.sum("cited").alias("cited"))
    both = held.join(found, "scope", "left").fillna(0)
    cited = F.when(F.col("claims") > 0, F.round(F.col("cited") / F.col("claims"), 4)).otherwise(1.0)
    return both.select("scope", "pages", F.round("source_coverage", 4).alias("source_coverage"), "claims", "cited", cited.alias("citation_coverage"), *[f"{s}s" for s in COST], F.greatest(F.lit(0.0), F.round(100 - F.col("cost"), 1)).alias("score"))


def lint_log(health: DataFrame, at: str) -> DataFrame:
    """Audit entries of a health run: its figures as JSON."""
    return health.select(F.lit("wiki_lint").alias("action"), F.lit(at).alias("created_at"), F.to_json(F.struct("scope", "pages", "errors")).alias("detail"))


def status_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("scope").agg(F.count("*").alias("pages"), F.count_if("stale").alias("stale"), F.count_if(F.col("confidence") < 0.45).alias("weak"))


def page_list(pages: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """The newest n pages with how many sources each has."""
    return pages.join(sources.groupBy("slug").agg(F.count("*").alias("sources")), "slug", "left").select("slug", "title", "position", F.coalesce("sources", F.lit(0)).alias("sources")).orderBy(F.desc("position")).limit(n)


# link graph ------------------------------------------------------------------------------------------------------------


def title_tokens(title: Column, stop: list[str]) -> Column:
    """What a title is about: words and numbers of 4 to 18 characters or with digits and letters, and CJK 2- to 4-grams."""
    words = F.filter(F.regexp_extract_all(F.lower(title), F.lit("[0-9a-z]{2,}"), F.lit(0)), lambda t: (F.length(t) <= 18) & ~((F.length(t) < 4) & (t.rlike("^[0-9]+$") | t.rlike("^[a-z]+$"))) & ~t.rlike("^(page|doc|wiki)[0-9]*$"))
    return F.array_except(F.array_distinct(F.concat(words, cjk_grams(title, 2, 4))), F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>"))


def mention_edges(pages: DataFrame, stop: list[str] = (), most: int = 8, titles: int = 64) -> DataFrame:
    """a, b and mentions: pages whose title, summary or body holds another page's title or words of it, in both directions.

    One direction counts with the whole title, a word of four characters or with a digit, or two others; it gives one for
    each of these, most at most. Words that more than titles pages have in their titles name no topic."""
    named = pages.select(F.col("slug").alias("b"), F.lower(F.trim("title")).alias("title"), F.explode(title_tokens(F.col("title"), list(stop))).alias("term"))
    topics = named.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") <= titles).select("term")
    named = keep(named.join(topics, "term"))  # read many times
    compact = lambda c: F.regexp_replace(c, r"\s+", "")
    text = F.lower(F.concat_ws(" ", "title", "summary", "body"))
    texts = lambda c: pages.select(F.col("slug").alias("key"), c.alias("text"))
    found = lambda of, part, rows: held_parts(texts(of), rows.select(F.col(part).alias("part"))).select(F.col("key").alias("a"), F.col("part").alias(part)).join(rows, part).where("a <> b")
    strong = (F.length("term") >= 4) | F.col("term").rlike("[0-9]")
    terms = found(text, "term", named).select("a", "b", "title", F.lit(1).alias("n"), strong.alias("strong"), (F.col("term") == F.col("title")).alias("same"), F.lit(False).alias("whole"))
    # a title with a topic is that of few pages, so its pairs are few as well
    whole = named.select("b", "title", compact(F.col("title")).alias("compact")).where(F.length("compact") >= 4).distinct()
    wholes = found(compact(text), "compact", whole).select("a", "b", "title", F.lit(0).alias("n"), F.lit(False).alias("strong"), F.lit(False).alias("same"), F.lit(True).alias("whole"))
    pairs = terms.unionByName(wholes).groupBy("a", "b", "title").agg(F.sum("n").alias("n"), *[F.max(c).alias(c) for c in ("strong", "same", "whole")]).where("n > 0")
    counted = pairs.where("whole or strong or n >= 2").withColumn("m", F.least(F.col("n") + F.when(F.col("whole") & ~F.col("same"), 1).otherwise(0), F.lit(most)))
    return counted.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.sum("m").alias("mentions")).select(F.col("x").alias("a"), F.col("y").alias("b"), "mentions")


def common_neighbors(edges: DataFrame) -> DataFrame:
    """a, b and near of the edges whose ends have common neighbours: the sum of 1 / ln(degree, 2 at least) of these.

    Nodes are numbers that begin with their degrees. A triangle is found once, from its least node, whose list of greater
    neighbours meets that of the middle one; so no list is long, and a hub's neighbours are not looked through."""
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"), F.pmod(F.xxhash64("node"), F.lit(NODE_GROUPS)).alias("group"))
    place = F.row_number().over(Window.partitionBy("group").orderBy("node")).cast("long")
    nodes = keep(degree.select("node", (F.shiftleft("degree", DEGREE_AT) + place * NODE_GROUPS + F.col("group")).alias("code")))
    of = lambda end: nodes.select(F.col("node").alias(end), F.col("code").alias(f"c{end}"))
    numbered = keep(edges.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", F.least("ca", "cb").alias("u"), F.greatest("ca", "cb").alias("v")))
    lists = numbered.groupBy("u").agg(F.collect_list("v").alias("out"))
    later = lists.select("u", "out", F.explode("out").alias("v")).select("u", "v", F.filter("out", lambda x: x > F.col("v")).alias("ends")).where(F.size("ends") > 0)
    found = later.join(lists.select(F.col("u").alias("v"), "out"), "v").select("u", "v", F.explode(F.array_intersect("ends", "out")).alias("w"))
    side = lambda u, v, mid: F.struct(F.col(u).alias("u"), F.col(v).alias("v"), F.shiftright(mid, DEGREE_AT).alias("degree"))
    sides = found.select(F.explode(F.array(side("u", "v", "w"), side("u", "w", "v"), side("v", "w", "u"))).alias("x")).select("x.*")
    near = sides.groupBy("u", "v").agg(F.sum(1 / F.log(F.greatest("degree", F.lit(2)).cast("double"))).alias("near"))
    return numbered.join(near, ["u", "v"]).select("a", "b", "near")


def wiki_edges(pages: DataFrame, sources: DataFrame, stop: list[str] = ()) -> DataFrame:
    """Undirected edges (a, b) of pages that link or mention each other, their signals, weight and strength.

    The signals: 3 for each direction that is linked and 0.25 for each further link; 4 for each shared source; 2 for each
    mention, five at most; 1.5 / ln(degree, 2 at least) for each common neighbour; and how near the page types are.
    Strong are weights from 8, medium from 5."""
    links = resolve_links(pages, extract_links(pages)).where("leads_to is not null and leads_to <> slug")
    each = links.groupBy("slug", "leads_to").agg(F.count("*").alias("n"))
    linked = each.groupBy(F.least("slug", "leads_to").alias("a"), F.greatest("slug", "leads_to").alias("b")).agg(F.count("*").alias("directions"), F.sum("n").alias("links"))
    # edges are read many times, so they are a table
    edges = keep(linked.join(mention_edges(pages, stop), ["a", "b"], "full").fillna(0))
    # sources are looked up for edges alone, so that one that many share makes no pairs
    own = sources.select("slug", "doc_id").distinct()
    shared = edges.select("a", "b").join(own.withColumnRenamed("slug", "a"), "a").join(own.withColumnRenamed("slug", "b"), ["b", "doc_id"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    common = common_neighbors(edges)
    types = lambda end: pages.select(F.col("slug").alias(end), F.lower(F.coalesce("page_type", F.lit("source"))).alias(f"t{end}"))
    all_ = edges.join(shared, ["a", "b"], "left").join(common, ["a", "b"], "left").join(types("a"), "a").join(types("b"), "b").fillna(0)
    affinity = first_of([((F.col("ta") == x) & (F.col("tb") == y), v) for x, row in AFFINITY.items() for y, v in row.items()], 0.5)
    signals = {
        "direct_link": SIGNALS["direct_link"] * F.col("directions") + SIGNALS["further_link"] * (F.col("links") - F.col("directions")),
        "source_overlap": SIGNALS["source_overlap"] * F.col("shared"),
        "title_mention": SIGNALS["title_mention"] * F.least("mentions", F.lit(5)),
        "common_neighbor": F.round(SIGNALS["common_neighbor"] * F.col("near"), 4),
        "type_affinity": SIGNALS["type_affinity"] * affinity,
    }
    weighed = all_.select("a", "b", "shared", *[x.cast("double").alias(k) for k, x in signals.items()]).withColumn("weight", F.round(sum((F.col(k) for k in signals), F.lit(0.0)), 4))
    return weighed.withColumn("strength", F.when(F.col("weight") >= 8, "strong").when(F.col("weight") >= 5, "medium").otherwise("weak"))


def wiki_nodes(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree of each page, pages that it links to or is linked from, its broken links, and whether it is an orphan."""
    links = resolve_links(pages, extract_links(pages))
    live = links.where("leads_to is not null and leads_to <> slug")
    out, into = live.groupBy("slug").agg(F.countDistinct("leads_to").alias("out")), live.groupBy(F.col("leads_to").alias("slug")).agg(F.countDistinct("slug").alias("into"))
    broken = links.where("leads_to is null").groupBy("slug").agg(F.count("*").alias("broken"))
    degree = edges.select(F.explode(F.array("a", "b")).alias("slug")).groupBy("slug").agg(F.count("*").alias("degree"))
    both = pages.select("slug", "title", "page_type").join(out, "slug", "left").join(into, "slug", "left").join(broken, "slug", "left").join(degree, "slug", "left").fillna(0, ["out", "into", "broken", "degree"])
    return both.withColumn("orphan", F.col("degree") == 0)


def communities(edges: DataFrame, nodes: DataFrame, least: float = 3.5) -> DataFrame:
    """node and component of every page: components over edges of a weight of at least the median and least."""
    median = edges.agg(F.percentile("weight", 0.5).alias("m"))
    strong = edges.join(F.broadcast(median)).where(F.col("weight") >= F.greatest(F.lit(least), "m"))  # one row
    found = connected(strong.select("a", "b"))
    return nodes.select(F.col("slug").alias("node")).join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def community_stats(found: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Size, inner edges, cohesion (their share of all possible), place (larger ones first, then those of higher degree),
    five titles of the highest degree, and pages by type of each community."""
    of = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    inner = edges.join(of("a"), "a").join(of("b"), "b").where("ca = cb").groupBy(F.col("ca").alias("component")).agg(F.count("*").alias("edges"))
    own = found.join(nodes.select(F.col("slug").alias("node"), "title", "page_type", "degree"), "node")
    best = own.withColumn("k", F.row_number().over(Window.partitionBy("component").orderBy(F.desc("degree"), "title", "node"))).where("k <= 5")
    tops = best.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "title"))), lambda x: x["title"]).alias("top"))
    kinds = own.groupBy("component", "page_type").agg(F.count("*").alias("n")).groupBy("component").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "page_type", F.col("n").cast("string")))), ",").alias("types"))
    sizes = own.groupBy("component").agg(F.count("*").alias("size"), F.sum("degree").alias("degrees"))
    both = sizes.join(inner, "component", "left").join(tops, "component").join(kinds, "component").withColumn("edges", F.coalesce("edges", F.lit(0)))
    cohesion = F.round(F.col("edges") / F.when(F.col("size") > 1, F.col("size") * (F.col("size") - 1) / 2).otherwise(1), 4)
    return both.select("component", "size", "edges", cohesion.alias("cohesion"), "degrees", "top", "types")


def community_order(stats: DataFrame, n: int = 200) -> DataFrame:
    """The n first communities with their place: larger ones first, then those of higher degree, then by title."""
    first = stats.orderBy(F.desc("size"), F.desc("degrees"), F.col("top")[0], "component").limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("size"), F.desc("degrees"), F.col("top")[0], "component")))  # n rows


def graph_insights(edges: DataFrame, nodes: DataFrame, found: DataFrame, stats: DataFrame, n: int = 8) -> DataFrame:
    """kind, a, b and score: the n most surprising edges, and gaps (pages of one edge or none, pages with broken links,
    sparse communities, and the three pages that lead to most other communities).

    An edge scores 3 between communities, 2 between types, 2 from the margin to a hub, 1 if weak, and 1 if pages of
    different types share a source; those of 2 or more count. Structural pages are left out."""
    plain = nodes.where(~F.lower("slug").isin(*STRUCTURAL_SLUGS) & ~F.lower(F.coalesce("page_type", F.lit(""))).isin(*STRUCTURAL_TYPES))
    placed = nodes.join(found.withColumnRenamed("node", "slug"), "slug")
    of = lambda end, table: table.select(F.col("slug").alias(end), F.col("title").alias(f"title_{end}"), F.col("page_type").alias(f"t{end}"), F.col("degree").alias(f"d{end}"), F.col("component").alias(f"c{end}"))
    top = nodes.agg(F.greatest(F.max("degree"), F.lit(1)).alias("top"))
    topical = placed.join(plain.select("slug"), "slug", "left_semi")
    both = edges.join(of("a", topical), "a").join(of("b", topical), "b").join(F.broadcast(top))  # one row
    one = lambda c, x: F.when(c, x).otherwise(0)
    differ = ~F.col("ta").eqNullSafe(F.col("tb"))
    margin = (F.least("da", "db") <= 1) & (F.greatest("da", "db") >= F.greatest(F.lit(2.0), 0.5 * F.col("top")))
    score = one(F.col("ca") != F.col("cb"), 3) + one(differ, 2) + one(margin, 2) + one(F.col("strength") == "weak", 1) + one(differ & (F.col("shared") > 0), 1)
    odd = both.withColumn("score", score.cast("double")).where("score >= 2").orderBy(F.desc("score"), F.desc("weight"), "title_a", "a", "b").limit(n).select(F.lit("surprising").alias("kind"), "a", "b", "score")
    gap = lambda table, kind, a, score: table.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.lit(None).cast("string").alias("b"), score.cast("double").alias("score"))
    sides = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = found.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    other = found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    reach = sides.join(own, "a").join(other, "b").groupBy("a").agg(F.countDistinct("cb").alias("all"), F.countDistinct(F.when(F.col("ca") != F.col("cb"), F.col("cb"))).alias("others"))
    bridges = reach.where("others >= 2").join(plain.select(F.col("slug").alias("a"), "degree", "title"), "a").orderBy(F.desc("all"), F.desc("degree"), "title", "a").limit(3)
    gaps = [gap(plain.where("degree <= 1"), "isolated-node", "slug", F.col("degree")), gap(nodes.where("broken > 0"), "broken-link", "slug", F.col("broken")), gap(stats.where("size >= 3 and cohesion < 0.15"), "sparse-community", "component", F.col("cohesion")), gap(bridges, "bridge-node", "a", F.col("others"))]
    for more in gaps:
        odd = odd.unionByName(more)
    return odd


def wiki_index(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Pages with their findings by severity and up to four rules to look at first."""
    rank = first_of([(F.col("severity") == s, k) for k, s in enumerate(COST)], 9)
    own = findings.groupBy("slug").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count("*").alias("findings"), F.slice(F.transform(F.array_sort(F.collect_set(F.struct(rank.alias("r"), "rule"))), lambda x: x["rule"]), 1, 4).alias("first"))
    return pages.select("slug", "page_type").join(own, "slug", "left").select("slug", "page_type", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce(F.array_join("first", ","), F.lit("")).alias("first"))


# search ----------------------------------------------------------------------------------------------------------------


def wiki_topk(questions: DataFrame, pages: DataFrame, k: int) -> DataFrame:
    """The k best pages of each question (question, terms), the slug deciding between equals.

    0.68 of coverage, 0.065 a title term up to 0.2, 0.04 a summary term up to 0.16, 0.07 a phrase of the question up to
    0.14, 0.06 of confidence and 0.04, less 0.01 for each power of ten of the length, up to 0.08; 0 to 0.99. Pages that hold
    less than 0.16 of the terms need one in the title. Terms and phrases, in any script, are found anywhere in the text
    without its white space."""
    from .patterns import Count, topk
    from .retrieval import phrases

    near = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    asked = questions.select("question_id", F.transform("terms", near).alias("terms"), F.array_distinct(F.transform(phrases(F.col("question")), near)).alias("said"))
    full = near(F.concat_ws(" ", "title", "summary", "body"))
    texts = pages.select("slug", F.coalesce("confidence", F.lit(0.0)).cast("double").alias("confidence"), near(F.coalesce("title", F.lit(""))).alias("title"), near(F.coalesce("summary", F.lit(""))).alias("summary"), full.alias("full"), F.length(full).alias("chars"))
    counts = {"n": Count("terms", ("full",)), "t": Count("terms", ("title",)), "s": Count("terms", ("summary",)), "p": Count("said", ("full",))}

    def score(n: dict, q: dict, texts: dict) -> tuple[np.ndarray, np.ndarray]:
        coverage = n["n"] / np.maximum(q["n_terms"], 1)
        penalty = np.minimum(0.08, 0.01 * np.log10(np.maximum(1000, texts["chars"].astype(float))))
        own = np.minimum(0.06, 0.06 * np.maximum(0.0, texts["confidence"])) + 0.04 - penalty
        total = 0.68 * coverage + np.minimum(0.2, 0.065 * n["t"]) + np.minimum(0.16, 0.04 * n["s"]) + np.minimum(0.14, 0.07 * n["p"]) + own[:, None]
        return np.clip(total, 0.0, 0.99), ((n["n"] > 0) & (coverage >= 0.16)) | (n["t"] > 0)

    return topk(asked, texts, k, counts, score, ["slug"], columns=("confidence", "chars"), digits=4)


def page_blocks(pages: DataFrame) -> DataFrame:
    """slug, block and text: whole parts between empty lines, the ones under a heading with it in front; front matter is left out."""
    parts = pages.select("slug", F.posexplode(F.split("body", r"\n\s*\n")).alias("block", "raw")).withColumn("raw", F.btrim("raw", F.lit(" \t\r\n"))).where(~F.startswith("raw", F.lit("---")) & (F.col("raw") != ""))
    head = F.when(F.startswith("raw", F.lit("#")), F.trim(F.element_at(F.split("raw", "\n"), 1)))
    carried = F.last(head, ignorenulls=True).over(Window.partitionBy("slug").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    text = F.when(head.isNotNull(), F.col("raw")).otherwise(F.concat_ws("\n", carried, "raw"))
    return parts.select("slug", "block", text.alias("text"), head.isNotNull().alias("head"))


def best_blocks(hits: DataFrame, pages: DataFrame, questions: DataFrame, n: int = 5) -> DataFrame:
    """The n blocks of each hit page with the best score, in the page's order.

    A question's term that occurs in a block gives 1 and a tenth a character (8 at most), up to three times; a source
    marker gives 0.5 and a heading 0.25. A page without such blocks gives its first."""
    blocks = page_blocks(pages.join(hits.select("slug").distinct(), "slug", "left_semi"))
    both = hits.select("question_id", "slug").join(questions.select("question_id", "terms"), "question_id").join(blocks, "slug").withColumn("low", F.regexp_replace(F.lower("text"), r"\s+", ""))
    often = lambda t: (F.length("low") - F.length(F.replace("low", t, F.lit("")))) / F.length(t)
    gain = F.aggregate(F.transform("terms", lambda t: F.least(F.lit(3.0), often(t)) * (1 + F.least(F.length(t), F.lit(8)) / 10)), F.lit(0.0), lambda a, x: a + x)
    score = gain + F.when(F.contains("low", F.lit("[s")), 0.5).otherwise(0.0) + F.when(F.col("head"), 0.25).otherwise(0.0)
    order = Window.partitionBy("question_id", "slug").orderBy(F.desc("score"), "block")
    return both.withColumn("score", F.round(score, 4)).withColumn("k", F.row_number().over(order)).where((F.col("k") <= n) & ((F.col("score") > 0) | (F.col("k") == 1))).select("question_id", "slug", "block", "score", "text")


def wiki_contexts(hits: DataFrame, pages: DataFrame, chars: int = 700) -> DataFrame:
    """Hit pages as contexts: title, summary and the beginning of the body."""
    return hits.join(pages, "slug").select("question_id", "slug", "rank", F.left(F.concat_ws("\n", "title", "summary", "body"), F.lit(chars)).alias("content"))
