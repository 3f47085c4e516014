"""Quality rules: figures of each text, and lines that many documents of a host share.

Lines are normalised and hashed; a line's count is the number of different documents of its host that hold it. Lines
above the limits are removed, and a document of which too little is left is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh, let

#: A line is removed when more documents of its host hold it than MIN_DOCS and than MAX_SHARE of the host's documents.
MIN_DOCS, MAX_SHARE = 20, 0.001
#: A document is depleted when less than this share of its words is left.
MIN_LEFT = 0.3
#: Fixed values of the base rules.
SYMBOLS, MIN_WORDS, WINDOW, MAX_REPEATED = "#*$%&|<>", 20, 8, 30


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more among the tokens, first occurrences included.

    Windows are compared by 64-bit hash. Only texts in which a hash repeats sort (hash, position) pairs.
    """
    n = F.size(tokens)

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            same = lambda x, k: (k >= 0) & (F.get(p, k)["h"] == x["h"])
            return F.array_sort(F.transform(F.filter(p, lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False))), lambda x: x["i"]))

        gaps = lambda s: F.aggregate(F.transform(s, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(s, j + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x)
        return let(let(pairs, starts), gaps)

    hashes = F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.xxhash64(F.slice(tokens, i, window)))
    return F.when(n > window, let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))).otherwise(0)


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0 and white space squeezed, so that counters and dates don't hide a repeated line."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), f"[{SPACE}]+", " "))


def figures(docs: DataFrame) -> DataFrame:
    """docs and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed. Null text has no words."""
    text = F.coalesce("text", F.lit(""))
    tokens, lines, w = fresh(docs, "tokens", "lines", "w")
    with_words = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    out = docs.withColumns({tokens: words(text), lines: with_words})
    out = out.withColumn(w, F.struct(F.size(tokens).cast("long").alias("n"), repeated_words(F.col(tokens)).cast("long").alias("r")))
    return out.select(
        *docs.columns,
        F.col(w)["n"].alias("n_words"),
        F.length(F.array_join(tokens, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.col(w)["r"].alias("n_repeat_words"),
        ((F.col(w)["n"] < MIN_WORDS) | (100 * F.col(w)["r"] > MAX_REPEATED * F.col(w)["n"])).alias("base_failed"),
    )


def host_of(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit(""))


def own_lines(text: str = "text") -> Column:
    """The lines that hold a word, by their hash, with their words."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.struct(F.xxhash64(normal_line(x)).alias("line"), F.size(words(x)).alias("n")))
    return F.filter(lines, lambda x: x["n"] > 0)


def frequent_lines(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """host, line and docs of the lines above the limits; rows of one doc_id are one document, also those without."""
    lines = docs.select(host_of(host).alias("host"), "doc_id", F.explode(F.array_distinct(F.transform(own_lines(), lambda x: x["line"]))).alias("line"))
    # a frequent line's rows are dealt out by document first, so that no task counts all of them
    counts = lines.distinct().groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > min_docs)
    totals = docs.select(host_of(host).alias("host"), "doc_id").distinct().groupBy("host").agg(F.count("*").alias("of"))
    return counts.join(totals, "host").where(F.col("docs") > max_share * F.col("of")).select("host", "line", "docs")


def keyed(docs: DataFrame, names: list[str], host: str) -> DataFrame:
    """docs and two hashes of what a row's lines depend on; rows of equal hashes are equal in it."""
    one, two = names
    return docs.withColumns({one: F.xxhash64("doc_id", host_of(host), "text"), two: F.xxhash64("text", F.lit(1), host_of(host), "doc_id")})


def removable_words(docs: DataFrame, frequent: DataFrame, names: list[str], host: str = "source") -> DataFrame:
    """The hashes of each row that holds frequent lines, and the words that go when these are removed from it."""
    lines = keyed(docs, names, host).select(*names, host_of(host).alias("host"), F.posexplode(own_lines()).alias("at", "x")).select(*names, "host", "at", "x.line", "x.n")
    # repeated rows give the same lines at the same places
    found = lines.join(frequent.select("host", "line"), ["host", "line"]).groupBy(*names).agg(F.collect_set(F.struct("at", "n")).alias("gone"))
    return found.select(*names, F.aggregate("gone", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("removed"))


def judge(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """One row a document: the figures, n_removed_words, base_failed and kept.

    kept is false if base_failed, or if removing lines above the limits leaves less than min_left of the words. Null
    text has no words and fails; a null host is a host of its own. Every row loses its own lines alone; repeated rows
    and rows of one doc_id are one document where documents are counted, and all rows without a doc_id are another.
    Further columns of docs are left out. An empty table gives no rows.
    """
    rows, names = docs.select("doc_id", F.col(host).alias("host"), "text"), ["row_one", "row_two"]
    base = figures(keyed(rows, names, "host")).drop("host", "text")
    removed = removable_words(rows, frequent_lines(rows, "host", min_docs, max_share), names, "host")
    out = base.join(removed, names, "left").drop(*names).withColumn("n_removed_words", F.coalesce("removed", F.lit(0)).cast("long")).drop("removed")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= min_left * F.col("n_words")))
