"""Reports on conversations, feedback, operations and evaluation suites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .documents import first_of
from .tables import any_of

NOT_FOUND = ("not found", "no answer", "未找到")


def counts(df: DataFrame, column: str, labels: dict[str, str] | None = None) -> DataFrame:
    """Rows by a value, with its label."""
    label = F.element_at(F.create_map(*[F.lit(x) for kv in (labels or {"": ""}).items() for x in kv]), F.col("value"))
    return df.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n")).withColumn("label", F.coalesce(label, F.col("value")))


def feedback_stats(feedback: DataFrame, since: str) -> DataFrame:
    """Counts since a time by status, cause and category (by, value, n), and the unresolved ones (new or reviewed)."""
    recent = feedback.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    pairs = F.array(*[F.struct(F.lit(c).alias("by"), F.col(c).alias("value")) for c in ("status", "root_cause", "category")], F.struct(F.lit("unresolved").alias("by"), F.col("status").isin("new", "reviewed").cast("string").alias("value")))
    return recent.select(F.explode(pairs).alias("x")).groupBy("x.by", "x.value").agg(F.count("*").alias("n"))


def preceding_user(messages: DataFrame) -> DataFrame:
    """messages and question_turn, the turn of the last user message before each one in its session."""
    order = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("question_turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(order))


def source_list(sources: Column) -> Column:
    return F.coalesce(F.from_json(sources, "array<string>"), F.array().cast("array<string>"))


def unanswered(messages: DataFrame) -> DataFrame:
    """Answers without sources, or that say they found nothing, with the turn of their question."""
    empty = F.size(source_list(F.col("sources"))) == 0
    none = any_of([F.contains(F.lower("content"), F.lit(w)) for w in NOT_FOUND])
    return preceding_user(messages).where((F.col("role") == "assistant") & (empty | none)).select("session_id", "turn", "question_turn")


def chat_stats(messages: DataFrame) -> DataFrame:
    return messages.agg(F.count_if(F.col("role") == "user").alias("questions"), F.count_if(F.col("role") == "assistant").alias("answers"), F.countDistinct("session_id").alias("sessions"))


def adoption_stats(adoptions: DataFrame, n: int = 12) -> DataFrame:
    """Wins, last time and kinds of each template (adoptions: templates, kinds, created_at), the n with most wins."""
    each = adoptions.select(F.explode("templates").alias("template"), "kinds", "created_at")
    return each.groupBy("template").agg(F.count("*").alias("wins"), F.max("created_at").alias("latest"), F.size(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds")).orderBy(F.desc("wins"), "template").limit(n)


def recommend_templates(adoptions: DataFrame, templates: DataFrame, n: int = 3) -> DataFrame:
    """The n known templates of each kind with most wins, later ones first among equals."""
    each = adoptions.select(F.explode("templates").alias("template"), "kinds", "created_at").select("template", F.explode("kinds").alias("kind"), "created_at").join(templates.select("template"), "template", "left_semi")
    won = each.groupBy("kind", "template").agg(F.count("*").alias("wins"), F.max("created_at").alias("latest"))
    return won.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("wins"), F.desc("latest"), "template"))).where(F.col("rank") <= n).select("kind", "template", "wins", "rank")


def select_templates(contexts: DataFrame, recommended: DataFrame, kinds: int = 3, n: int = 4, general: str = "t0") -> DataFrame:
    """Templates for each question (contexts: question_id, kind): the recommended ones of its three most frequent kinds in
    turn, then the general one, each once, at most n."""
    top = contexts.groupBy("question_id", "kind").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("n"), "kind"))).where(F.col("k") <= kinds)
    offered = top.join(recommended, "kind").select("question_id", "template", "k", "rank").unionByName(contexts.select("question_id").distinct().select("question_id", F.lit(general).alias("template"), F.lit(1 << 20).alias("k"), F.lit(1).alias("rank")))
    once = offered.groupBy("question_id", "template").agg(F.min(F.struct("k", "rank")).alias("at"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("at", "template"))).where(F.col("place") <= n).select("question_id", "template", "place")


def feedback_search(feedback: DataFrame, text: str | None = None, since: str | None = None, until: str | None = None, **equal: str) -> DataFrame:
    """Feedback whose columns equal some values, of some days (the last one included), with a text in any column."""
    found = feedback
    for column, value in equal.items():
        found = found.where(F.col(column) == value)
    if since:
        found = found.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if until:
        found = found.where(F.col("created_at") < F.date_add(F.lit(until).cast("date"), 1).cast("timestamp"))
    if text:
        found = found.where(F.contains(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in feedback.columns])), F.lit(text.lower())))
    return found


def apply_updates(rows: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """rows with a column replaced where updates (key, new value in the column) has the key."""
    return rows.join(updates.select(key, F.col(column).alias("_new")), key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def feedback_snapshots(feedback: DataFrame, messages: DataFrame) -> DataFrame:
    """Feedback (feedback_id, session_id, turn) with the rated answer and its question as they stood."""
    asked = preceding_user(messages)
    question = messages.select("session_id", F.col("turn").alias("question_turn"), F.col("content").alias("question"))
    return feedback.join(asked.select("session_id", "turn", "question_turn", F.col("content").alias("answer")), ["session_id", "turn"]).join(question, ["session_id", "question_turn"], "left").select("feedback_id", "question", "answer")


def session_summaries(messages: DataFrame) -> DataFrame:
    """Title (first user message, 28 characters), preview (last message, 42) and length of each session."""
    user = F.when(F.col("role") == "user", F.col("turn"))
    return messages.groupBy("session_id").agg(F.left(F.min_by("content", user), F.lit(28)).alias("title"), F.left(F.max_by("content", "turn"), F.lit(42)).alias("preview"), F.count("*").alias("messages"))


def recent_turns(messages: DataFrame, n: int = 6) -> DataFrame:
    return messages.withColumn("back", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn")))).where(F.col("back") <= n)


def recent_sources(messages: DataFrame, answers: int = 4, n: int = 6) -> DataFrame:
    """Different sources of the last answers of each session, the latest first, at most n."""
    last = recent_turns(messages.where("role = 'assistant'"), answers).select("session_id", "back", F.posexplode(source_list(F.col("sources"))).alias("pos", "source"))
    once = last.groupBy("session_id", "source").agg(F.min(F.struct("back", "pos")).alias("at"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("at"))).where(F.col("place") <= n).select("session_id", "source", "place")


def message_view(messages: DataFrame) -> DataFrame:
    """Messages with sources on answers only, and whether all of these are overviews."""
    own = F.when(F.col("role") == "assistant", source_list(F.col("sources"))).otherwise(F.array().cast("array<string>"))
    return messages.select("session_id", "turn", F.size(own).alias("sources"), ((F.size(own) > 0) & F.forall(own, lambda s: F.endswith(s, F.lit("0")))).alias("overview"))


def evaluate(cases: DataFrame, contexts: DataFrame, profiles: DataFrame) -> DataFrame:
    """case_id, check, arg and passed for every expectation.

    cases: case_id, check, arg and top_n. Checks look at the first top_n contexts (case_id, rank, document, title, content,
    signals): top_doc (the first one's document), must_include and must_not_include (a document), must_match (a word in a
    content), title_group and content_group (one of several words, bars between them), signal; at how many contexts there
    are (max_contexts); and at profiles (case_id, profile)."""
    counts = contexts.groupBy("case_id").agg(F.count("*").alias("contexts"))
    both = cases.join(contexts, "case_id", "left").join(counts, "case_id", "left").join(profiles.select("case_id", "profile"), "case_id", "left")
    near = F.coalesce(F.col("rank") <= F.col("top_n"), F.lit(False))
    group = lambda c: F.exists(F.split("arg", r"\|"), lambda w: F.contains(F.lower(c), w))
    kinds = {
        "top_doc": (F.col("rank") == 1) & (F.col("document") == F.col("arg")),
        "must_match": near & F.contains("content", F.col("arg")),
        "title_group": near & group("title"),
        "content_group": near & group("content"),
        "signal": near & F.array_contains("signals", F.col("arg")),
        "max_contexts": F.coalesce("contexts", F.lit(0)) <= F.try_to_number("arg", F.lit("999999")),
        "profile": F.col("profile") == F.col("arg"),
    }
    hit = first_of([(F.col("check") == k, F.coalesce(c, F.lit(False))) for k, c in kinds.items()], near & F.coalesce(F.col("document") == F.col("arg"), F.lit(False)))
    found = both.groupBy("case_id", "check", "arg").agg(F.bool_or(hit).alias("hit"))
    return found.select("case_id", "check", "arg", F.when(F.col("check") == "must_not_include", ~F.col("hit")).otherwise(F.col("hit")).alias("passed"))


def suite_report(results: DataFrame) -> DataFrame:
    """Cases, passed ones (all of whose checks passed) and the pass rate."""
    cases = results.groupBy("case_id").agg(F.bool_and("passed").alias("passed"))
    return cases.agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed")).withColumn("rate", F.col("passed") / F.col("cases"))


def suite_failures(results: DataFrame, contexts: DataFrame, n: int = 5) -> DataFrame:
    """case_id, the checks that failed and the documents of the first n contexts, for each case that failed."""
    failed = results.where("not passed").groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "check", "arg"))), ",").alias("failed"))
    first = contexts.where(F.col("rank") <= n).groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "document"))), lambda x: x["document"]), ",").alias("documents"))
    return failed.join(first, "case_id", "left").fillna("", ["documents"])


def evaluate_answers(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """errors of each answer, joined by commas: required words it lacks, forbidden ones it has, too short, too long, and
    entries of the case's meta (a map) that the answer's meta hasn't."""
    both = cases.withColumnRenamed("meta", "wanted").join(answers, "case_id", "left").withColumn("answer", F.coalesce("answer", F.lit("")))
    missing = F.filter("required", lambda w: ~F.contains("answer", w))
    extra = F.filter("forbidden", lambda w: F.contains("answer", w))
    unlike = F.filter(F.array_sort(F.map_keys("wanted")), lambda k: ~F.coalesce(F.try_element_at("meta", k).eqNullSafe(F.element_at("wanted", k)), F.lit(False)))
    named = lambda words, name: F.transform(words, lambda w: F.concat(F.lit(f"{name}:"), w))
    errors = F.array_compact(F.concat(named(missing, "missing"), named(extra, "forbidden"), F.array(F.when(F.length("answer") < F.col("least"), "short"), F.when(F.length("answer") > F.col("most"), "long")), named(unlike, "meta")))
    return both.select("case_id", F.array_join(errors, ",").alias("errors"))


def evaluate_citations(citations: DataFrame, contexts: DataFrame) -> DataFrame:
    """Citations (case_id, document, snippet) with foreign (no context of the case is from the document) and absent (no such
    context holds the snippet)."""
    both = citations.join(contexts.select("case_id", "document", "content"), ["case_id", "document"], "left")
    return both.groupBy("case_id", "document", "snippet").agg((F.count("content") == 0).alias("foreign"), (~F.coalesce(F.bool_or(F.contains("content", F.col("snippet"))), F.lit(False))).alias("absent"))


def citation_counts(cases: DataFrame, citations: DataFrame) -> DataFrame:
    """Citations of each case (case_id, least, most), and whether they are as many as it asks for."""
    found = citations.groupBy("case_id").agg(F.count("*").alias("citations"))
    both = cases.join(found, "case_id", "left").withColumn("citations", F.coalesce("citations", F.lit(0)))
    return both.select("case_id", "citations", F.col("citations").between(F.col("least"), F.col("most")).alias("passed"))


def evaluate_groups(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Passed cases of each category: an answer must hold a word of every group of equivalent ones."""
    both = cases.join(answers, "case_id")
    ok = F.forall("groups", lambda g: F.exists(g, lambda w: F.contains("answer", w)))
    return both.groupBy("category").agg(F.count("*").alias("cases"), F.count_if(ok).alias("passed"), F.avg("elapsed").alias("elapsed"))


def source_overlap(before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents that two runs of a case share, and that only one of them has."""
    a, b = (x.groupBy("case_id").agg(F.collect_set("document").alias(n)) for x, n in ((before, "a"), (after, "b")))
    none = F.array().cast("array<string>")
    both = a.join(b, "case_id", "full_outer").select("case_id", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    return both.select("case_id", F.size(F.array_intersect("a", "b")).alias("shared"), F.size(F.array_except("a", "b")).alias("lost"), F.size(F.array_except("b", "a")).alias("gained"))


def answer_signals(answers: DataFrame) -> DataFrame:
    """Length, list structure, whether it says that it found nothing, and whether it names a source."""
    return answers.select("case_id", F.length("answer").alias("chars"), F.col("answer").rlike(r"(?m)^\s*([-*•]|[0-9]+[.)])\s").alias("structured"), any_of([F.contains(F.lower("answer"), F.lit(w)) for w in NOT_FOUND]).alias("empty"), F.exists("titles", lambda t: F.contains("answer", t)).alias("named"))


def compare_variants(contexts: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Signals of two variants' answers side by side, with the number of contexts that both stand on."""
    a, b = (answer_signals(x).select("case_id", F.col("chars").alias(f"chars_{n}"), F.col("structured").alias(f"structured_{n}")) for x, n in ((first, "a"), (second, "b")))
    return contexts.groupBy("case_id").agg(F.count("*").alias("contexts")).join(a, "case_id").join(b, "case_id")


def audit_slice(audit: DataFrame, actions: list[str], key: str, value: str, n: int) -> DataFrame:
    """The latest n entries of each action whose JSON detail has a value."""
    kept = audit.where(F.col("action").isin(*actions) & (F.get_json_object("detail", f"$.{key}") == value))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("action").orderBy(F.desc("created_at"), F.desc("audit_id")))).where(F.col("rank") <= n)


def latest_status(events: DataFrame, key: str, at: str) -> DataFrame:
    """The last row of each key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), F.struct(at, *[c for c in ("task_id",) if c in events.columns])).alias("x")).select(key, "x.*")


def clean_templates(templates: DataFrame, most: int = 4000) -> DataFrame:
    """Templates with slugs as keys, with contents of up to most characters, the first of each key."""
    slug = F.btrim(F.regexp_replace(F.lower("key"), "[^a-z0-9]+", "-"), F.lit("-"))
    kept = templates.withColumn("key", slug).where((F.col("key") != "") & F.length(F.trim("content")).between(1, most))
    return kept.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("position"))).where("k = 1").drop("k")


def append_adoptions(log: DataFrame, events: DataFrame, templates: DataFrame, n: int = 300) -> DataFrame:
    """The newest n adoptions of known templates, old and new."""
    both = log.unionByName(events).join(templates.select("template"), "template", "left_semi")
    return both.orderBy(F.desc("created_at"), F.desc("adoption_id")).limit(n)


def eval_cases(file: DataFrame, custom: DataFrame) -> DataFrame:
    """Cases of both, names clipped and top_k within 1 to 20, and whether an id was seen before (file cases first)."""
    both = file.withColumn("origin", F.lit(0)).unionByName(custom.withColumn("origin", F.lit(1)))
    sized = both.select("case_id", F.left("question", F.lit(200)).alias("question"), F.least(F.lit(20), F.greatest(F.lit(1), "top_k")).alias("top_k"), "origin")
    return sized.withColumn("repeated", F.row_number().over(Window.partitionBy("case_id").orderBy("origin", "question")) > 1)


def validate_feedback(feedback: DataFrame, messages: DataFrame, categories: list[str]) -> DataFrame:
    """feedback_id and why it is rejected, or null: rating and category vocabularies, length, and an answer of the user's own."""
    own = messages.where("role = 'assistant'").select("session_id", "turn", F.col("user_id").alias("asker"))
    both = feedback.join(own, ["session_id", "turn"], "left")
    return both.select("feedback_id", first_of([(~F.col("rating").isin("up", "down"), "rating"), (~F.col("category").isin(*categories), "category"), (F.length("note") > 1000, "too_long"), (F.col("asker").isNull(), "no_answer"), (F.col("asker") != F.col("user_id"), "not_own")], None).alias("reason"))


def task_list(tasks: DataFrame, docs: DataFrame, statuses: DataFrame) -> DataFrame:
    """Tasks with their document's title and state (doc_id, state); those of documents that are gone have neither."""
    both = tasks.join(docs.select("doc_id", "title"), "doc_id", "left").join(statuses.select("doc_id", "state"), "doc_id", "left")
    return both.select("task_id", "status", "title", "state")


def kind_mix(contexts: DataFrame) -> DataFrame:
    """How many contexts of a question are of each kind."""
    return contexts.groupBy("question_id", "kind").agg(F.count("*").alias("n"))


def feedback_view(feedback: DataFrame, content: int = 180, question: int = 220, answer: int = 260) -> DataFrame:
    """Feedback with content, question and answer clipped, the note (the review's where there is no other) clipped as the
    content is, and its first two sources."""
    clip = lambda c, n: F.left(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(n))
    note = F.coalesce(F.nullif(F.trim("admin_note"), F.lit("")), "review_note")
    return feedback.select("feedback_id", clip("content", content).alias("content"), clip("question", question).alias("question"), clip("answer", answer).alias("answer"), clip(note, content).alias("note"), F.slice(source_list(F.col("sources")), 1, 2).alias("sources"))


def overview(parts: dict[str, DataFrame]) -> DataFrame:
    """One row of the named one-row, one-number tables, and the names of those above zero among the risks."""
    out = None
    for name, df in parts.items():
        one = df.select(F.col(df.columns[0]).cast("long").alias(name))
        out = one if out is None else out.join(one)
    risks = [n for n in parts if n.startswith("risk_")]
    return out.withColumn("risks", F.array_join(F.array_compact(F.array(*[F.when(F.col(n) > 0, n) for n in risks])), ","))
