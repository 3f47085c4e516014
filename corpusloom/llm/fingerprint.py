"""Document fingerprints by consistent weighted sampling.

A term is a word with the word after it (the last word stands alone), and its weight is how often the text holds it. For
each sample every term of weight w draws r and c from Gamma(2, 1), by tables of its quantiles, and b uniformly, all from the
term's hash alone, and

    t = floor(ln w / r + b),    ln a = ln c - r * (t + 1 - b).

The term of the least a is the sample, together with its t. Two texts agree in a sample with a probability equal to the
generalised Jaccard similarity of their weights: the sum of the minima over the sum of the maxima. A fingerprint holds
32 bits of each sample.

The next document is found by one shuffle of the texts. They are dealt into ranges of doc_id, and the first document of
each range is put at the end of the range before it too, so that all the rest happens where the texts already are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, let

SAMPLES = 32
#: Equally likely values of r, and bins of c.
QUANTILES = 256
#: Hexadecimal digits of a sample.
DIGITS = 8
#: Documents of a range as far as RANGES allows; RANGES bounds the ids in the plan, and beyond it ranges grow.
RANGE_ROWS, RANGES = 64, 1 << 14
#: Ids that are read for each bound, so that ranges are about even.
PER_BOUND = 8
#: Bounds that one look at the coarse bounds skips.
FAN = 128
#: The id that stands for none; it comes last in descending order.
NO_ID = -(1 << 63)


def quantile(u: float) -> float:
    """What Gamma(2, 1) stays below with probability u."""
    x = math.sqrt(2 * u) + 1e-9
    for _ in range(60):
        x = max(x / 2, x - (1 - (1 + x) * math.exp(-x) - u) / (x * math.exp(-x)))
    return x


#: Quantiles for r, and for ln c what they have beside half the logarithm of u, which alone makes the tail at 0 steep.
MIDDLES = [(k + 0.5) / QUANTILES for k in range(QUANTILES)]
OF_R = [quantile(u) for u in MIDDLES]
OF_C = [math.log(quantile(u)) - math.log(u) / 2 for u in MIDDLES]


def constant(values: list, kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def terms(text: Column) -> Column:
    """Hashes of a text's terms in ascending order, one for each word; of a text without words, one of its own."""
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    hashes = let(words, lambda w: F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1))))
    return F.sort_array(let(hashes, lambda h: F.when(F.size(h) > 0, h).otherwise(F.array(F.lit(0).cast("long")))))


def weighted(hashes: Column) -> Column:
    """term and n of each different hash among sorted ones."""
    ends = lambda h: F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: ~F.get(h, i).eqNullSafe(F.get(h, i + 1)))
    runs = lambda h, e: F.transform(e, lambda x, j: F.struct(F.get(h, x).alias("term"), (x - F.coalesce(F.get(e, j - 1), F.lit(-1))).alias("n")))
    return let(hashes, lambda h: let(ends(h), lambda e: runs(h, e)))


def draw(term: Column, log_weight: Column, sample: int) -> Column:
    """A long whose high half is in the order of ln a and whose low half names the term and its t."""
    x = F.xxhash64(term.bitwiseXOR(F.lit((sample + 1) * 0x1E3779B97F4A7C15 % (1 << 63))))
    bits = lambda at, n: F.shiftrightunsigned(x, at).bitwiseAND((1 << n) - 1)
    # 32 bits are u of c, of which the highest choose its quantile too
    r, u = F.get(constant(OF_R, "double"), bits(0, 8).cast("int")), (bits(32, 32).cast("double") + 0.5) / float(1 << 32)
    log_c = F.log(u) * 0.5 + F.get(constant(OF_C, "double"), bits(56, 8).cast("int"))
    b = (bits(8, 24).cast("double") + 0.5) / float(1 << 24)
    t = F.floor(log_weight / r + b)
    # ln a lies between -70 and 4
    order = F.floor((log_c - r * (t + 1 - b) + 100) * float(1 << 24)).cast("long")
    return F.shiftleft(order, 32).bitwiseOR(term.bitwiseXOR(t * 2654435761).bitwiseAND((1 << 32) - 1))


def sign(rows: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """keys and fingerprint of each row; keys must tell rows apart, and null text is empty.

    Nothing is shuffled where rows are already dealt out by some of the keys."""
    each = rows.select(*keys, F.explode(weighted(terms(F.coalesce(F.col(text), F.lit(""))))).alias("x")).select(*keys, "x.term", F.log(F.col("x.n").cast("double")).alias("log_weight"))
    least = each.groupBy(*keys).agg(*[F.min(draw(F.col("term"), F.col("log_weight"), d)).alias(f"s{d}") for d in range(samples)])
    return least.select(*keys, F.concat(*[F.lower(F.lpad(F.hex(F.col(f"s{d}").bitwiseAND((1 << 32) - 1)), DIGITS, "0")) for d in range(samples)]).alias("fingerprint"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples in which two fingerprints agree, an estimate of their texts' generalised Jaccard similarity."""
    part = lambda x, i: F.substring(x, i * DIGITS + 1, DIGITS)
    same = F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: part(a, i) == part(b, i))
    return F.size(same).cast("double") / samples


def bounds(ids: DataFrame, range_rows: int = RANGE_ROWS, ranges: int = RANGES) -> tuple[list[int], int]:
    """Ids in ascending order that cut all ids into about even ranges, and the largest id. About PER_BOUND ids a range, chosen
    by hash, reach the driver, so their number is bounded by ranges and not by the documents."""
    n, largest = ids.agg(F.count("*"), F.max("doc_id")).first()
    wanted = min(ranges, math.ceil(n / range_rows))
    if largest is None or wanted < 2:
        return [], NO_ID if largest is None else largest
    chosen = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // (PER_BOUND * wanted)))) == 0).where("doc_id is not null").distinct()
    return sorted(r[0] for r in chosen.collect())[PER_BOUND - 1 :: PER_BOUND], largest


def dealt(docs: DataFrame, range_rows: int = RANGE_ROWS, ranges: int = RANGES) -> DataFrame:
    """doc_id, text, id, part (a range of ids) and guest; guests are the first rows of the next range in descending order."""
    cuts, largest = bounds(docs.select(F.col("doc_id").cast("long").alias("doc_id")), range_rows, ranges)
    listed = lambda x: constant(x, "bigint")
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), ident.alias("id"))
    below = lambda x: F.size(F.filter(x, lambda y: y < F.col("id")))
    if cuts:
        group = below(listed(cuts[FAN - 1 :: FAN])) if len(cuts) >= FAN else F.lit(0)
        rows = rows.withColumn("group", group)
        rows = rows.withColumn("part", F.col("group") * FAN + below(F.slice(listed(cuts), F.col("group") * FAN + 1, FAN)))
        first = F.get(listed(cuts), F.col("part")) == F.col("id")
    else:
        rows, first = rows.withColumn("part", F.lit(0)), F.lit(False)
    place = lambda part, guest: F.struct(part.alias("part"), F.lit(guest).alias("guest"))
    # the document after the last one is the first of all
    places = F.array(place(F.col("part"), 0), F.when(first, place(F.col("part") + 1, 1)), F.when(F.col("id") == largest, place(F.lit(0), 1)))
    return rows.select("doc_id", "text", "id", F.explode(F.filter(places, lambda p: p.isNotNull())).alias("at")).select("doc_id", "text", "id", "at.part", "at.guest")


def edits(docs: DataFrame, samples: int = SAMPLES, range_rows: int = RANGE_ROWS, ranges: int = RANGES) -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text is the text with its last half replaced by as many characters from the start of the next document,
    in descending doc_id; after the last document comes the first. Null text is empty, and texts without words are all
    alike. Rows without a doc_id come last; rows of one doc_id follow each other by text, descending, each a document
    of its own. A single row is its own next. Further columns are left out. An empty table gives no rows.
    """
    order = Window.partitionBy("part").orderBy("guest", F.desc("id"), F.desc("text"))
    rows = dealt(docs, range_rows, ranges).withColumns({"pos": F.row_number().over(order), "next": F.lead("text").over(order), "n_chars": F.char_length("text").cast("long")})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    facts = ["part", "pos", "guest", "doc_id", "n_chars"]
    both = rows.select(*facts, "text", edited.alias("edited")).select(*facts, F.sha2("edited", 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("side", "said"))
    # rows go text, edited text, next text
    along = Window.partitionBy("part").orderBy("pos", "side")
    signed = sign(both, [*facts, "edited_sha256", "side"], "said", samples)
    seen = signed.withColumns({"edited_fingerprint": F.lead("fingerprint", 1).over(along), "next_fingerprint": F.lead("fingerprint", 2).over(along)}).where("side = 0 and guest = 0")
    return seen.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"),
    )
