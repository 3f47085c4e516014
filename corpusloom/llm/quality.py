"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each text. Expectation-maximisation over the counts of vote patterns
(of all documents; there are at most 3 ** 8 patterns) estimates how accurate each labeller is, which gives every
pattern a posterior. A linear scorer over hashed features of word shapes is trained on the posteriors of a bounded
sample, and scores every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, steps

#: Bound of the training sample, in documents.
SAMPLE = 4000
#: Hashed features of single words, and of neighbours.
WIDTH = 1024
DIMENSIONS = 2 * WIDTH + 8
#: Scores from here on are accepted: losing a good text counts more than keeping a poor one.
THRESHOLD = 0.3
GOOD, BAD, NONE = "1", "0", "-"
SYMBOLS = frozenset("#*$%&|<>!@^~=_{}[]\\/")
#: Words of which a Python task remembers the shape; beyond that it forgets all and goes on.
REMEMBERED = 400_000
UPPER, SYMBOL, PLAIN, LOWER = 1 << 16, 1 << 17, 1 << 18, 1 << 19
LABELLERS = 8


def runs(word: str) -> str:
    """The word's runs of upper case (A), lower case (a), digits (0) and other characters (themselves)."""
    core, tail = (word, "") if word.isalpha() else (word[:-1], word[-1])
    if core.isalpha() and not tail.isalnum():
        if core.islower():
            return "a" + tail
        if core.isupper():
            return "A" + tail
        if core[0].isupper() and core[1:].islower():
            return "Aa" + tail
    kinds, last = [], ""
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if kind != last:
            kinds.append(kind)
            last = kind
    return "".join(kinds)


@lru_cache(1 << 16)
def feature(shape: str, length: int) -> int:
    return zlib.crc32(f"{shape} {length}".encode()) % WIDTH


def shape(word: str) -> int:
    """Feature of a word's shape and length, and its marks. A plain word is letters and one other character at most."""
    kinds = runs(word)
    upper, lower = "A" in kinds, "a" in kinds
    plain = (upper or lower) and (word.isalpha() or word[:-1].isalpha() or word[1:].isalpha())
    return feature(kinds, len(word) // 4 if len(word) < 24 else 4 + (len(word) // 12).bit_length()) | UPPER * (upper and not lower and len(word) > 1) | SYMBOL * (not SYMBOLS.isdisjoint(word)) | PLAIN * plain | LOWER * lower


class Shapes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = shape(word)
        return found


def describe(text: str, shapes: Shapes, featured: bool = True) -> tuple[str, np.ndarray]:
    """The labellers' votes on a text, and its features, all zero if the text has no words or they aren't asked for."""
    words = text.split()
    n = len(words)
    features = np.zeros(DIMENSIONS, np.float32)
    if not n:
        return BAD * LABELLERS, features
    marks = np.fromiter(map(shapes.__getitem__, words), np.int64, n)
    hashes = np.fromiter(map(hash, words), np.int64, n)
    ids = marks & (WIDTH - 1)
    same = float((hashes[1:] == hashes[:-1]).mean()) if n > 1 else 0.0
    upper, symbols, plain, lower = (float((marks & m > 0).mean()) for m in (UPPER, SYMBOL, PLAIN, LOWER))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    again = 1 - len(set(lines)) / max(1, len(lines))
    distinct = len(set(words)) / n
    length = len(text) / n

    def vote(bad: bool, good: bool) -> str:
        return BAD if bad else GOOD if good else NONE

    poor = n > 40 and distinct < 0.2 + 2 / n**0.5
    votes = (
        vote(symbols > 0.3, False),
        vote(upper > 0.5, False),
        vote(n > 5 and same > 0.25, False),
        vote(len(lines) > 3 and again > 0.4, False),
        vote(poor or length > 20, False),
        vote(plain < 0.6, plain > 0.9),
        vote(lower < 0.5, lower > 0.85),
        vote(n > 5 and same > 0.15 or len(lines) > 3 and again > 0.3 or poor, n >= 3 and same < 0.05 and again < 0.2),
    )
    if not featured:
        return "".join(votes), features
    features[:WIDTH] = np.sqrt(np.bincount(ids, minlength=WIDTH) / n)
    if n > 1:
        features[WIDTH : 2 * WIDTH] = np.sqrt(np.bincount((ids[1:] * 31 + ids[:-1] * 17) % WIDTH, minlength=WIDTH) / (n - 1))
    features[2 * WIDTH :] = same, upper, symbols, plain, again, distinct, lower, 1.0
    return "".join(votes), features


def _described(docs: DataFrame, schema: str, row, featured: bool = True) -> DataFrame:
    """docs' columns, then those that row makes of a text's votes and features."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    columns = docs.columns
    added = StructType.fromDDL(schema)
    types = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in steps(batches):
            rows = [row(*describe(t or "", shapes, featured)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), types, strict=True)]], [*columns, *types.names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added.fields]))


def posteriors(counts: dict[str, int], rounds: int = 100) -> dict[str, float]:
    """The probability that a text is good, for each vote pattern, by expectation-maximisation.

    Labellers are taken as independent given the class, with a chance of each vote in each class of their own. They
    start as right more often than not, which names the classes."""
    if not counts:
        return {}
    patterns = sorted(counts)
    weight = np.array([counts[p] for p in patterns], float)
    votes = np.array([[(BAD, NONE, GOOD).index(v) for v in p] for p in patterns])
    each = np.eye(3)[votes]  # pattern, labeller, vote
    chance = np.tile(np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]])[:, None, :], (1, votes.shape[1], 1))
    prior = np.array([0.2, 0.8])
    for _ in range(rounds):
        log = np.log(prior) + np.einsum("plv,clv->pc", each, np.log(chance))
        p = np.exp(log - log.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        mass = p * weight[:, None]
        prior = (mass.sum(axis=0) + 1) / (mass.sum() + 2)
        got = np.einsum("pc,plv->clv", mass, each) + np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]])[:, None, :]
        chance = got / got.sum(axis=2, keepdims=True)
    return {name: float(x) for name, x in zip(patterns, p[:, 1], strict=True)}


def fit(features: np.ndarray, target: np.ndarray, steps_: int = 300, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer for soft targets, by full-batch Adam with both classes given equal mass."""
    w = np.zeros(features.shape[1], np.float32)
    target = target.astype(np.float32)
    good, bad = max(target.sum(), 1.0), max((1 - target).sum(), 1.0)
    weight = target / good + (1 - target) / bad
    weight *= len(target) / weight.sum() if len(target) else 1
    m = v = np.zeros_like(w)
    for k in range(1, steps_ + 1):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        g = features.T @ ((p - target) * weight) / max(1, len(target)) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - np.float32(rate) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def learn(docs: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], np.ndarray]:
    """Posteriors of the vote patterns of all docs, and the scorer's weights from about sample documents.

    The sample's documents are those whose hash of doc_id and text is below a share of all hashes, rows equal in both
    being one; a null doc_id is as good as any. Without documents nothing is learned, and every score is 0.5."""
    rows = docs.where("text is not null").select("doc_id", "text")
    counts = {r["votes"]: r["n"] for r in _described(rows, "votes string", lambda v, _: (v,), featured=False).groupBy("votes").agg(F.count("*").alias("n")).collect()}
    good = posteriors(counts)
    share = min(1.0, sample / max(1, sum(counts.values())))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct()
    taken = _described(chosen, "votes string, features binary", lambda v, x: (v, x.astype(np.float16).tobytes())).select("votes", "features").collect()
    x = np.array([np.frombuffer(bytes(r["features"]), np.float16) for r in taken], np.float32).reshape(-1, DIMENSIONS)
    return good, fit(x, np.array([good[r["votes"]] for r in taken]))


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray]) -> DataFrame:
    """docs, votes, posterior and score (0 to 1). Text without words, or null, gets 0 in both.

    New columns get longer names where docs has theirs; other columns pass unchanged, and repeated rows all stay."""
    good, weights = model
    names = fresh(docs, "votes", "posterior", "score")
    none = BAD * LABELLERS

    def row(votes: str, x: np.ndarray) -> tuple[str, float, float]:
        if not x.any():
            return votes, 0.0 if votes == none else good.get(votes, 0.5), 0.0
        return votes, good.get(votes, 0.5), float(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))))

    return _described(docs, f"{names[0]} string, {names[1]} double, {names[2]} double", row)


def accept(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with their columns, that a scorer learned from docs itself accepts. An empty table stays so."""
    scored = score(docs, learn(docs))
    return scored.where(F.col(scored.columns[-1]) >= threshold).select(*docs.columns)
