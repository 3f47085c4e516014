"""Benchmark decontamination with suffix arrays of the training text.

Every Spark task builds suffix arrays of the shards of documents it holds and looks up every suffix of the test items by
binary search; neighbouring hits grow into longest verbatim matches with their places. Nothing is shuffled. Only
suffixes that begin with enough words of the items' vocabulary can match and are sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, steps

WINDOW = 10
#: Bytes of test items that are sent to the tasks at once; more are matched in as many passes as needed.
ITEM_BYTES = 32 << 20
#: Lower case for A-Z, and a blank for every byte that no word holds.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORDS).split() if text else []


class TestSuffixes:
    """The windows of some items: vocabulary, and for each window its item, place and words."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        texts = [(name, w) for name, text in items if (w := words_of(text))]
        self.window = window
        self.names = [name for name, _ in texts]
        self.vocab = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(w for _, w in texts)), 1)}
        self.bits = max(1, len(self.vocab).bit_length())
        self.per_key = max(1, 62 // self.bits)
        item, place, rows, length = [], [], [], []
        for k, (_, w) in enumerate(texts):
            ids, n = [self.vocab[x] for x in w], min(window, len(w))
            for p in range(len(w) - n + 1):
                item.append(k)
                place.append(p)
                length.append(n)
                rows.append(ids[p : p + n] + [0] * (window - n))
        self.item, self.place, self.length = np.array(item, np.int64), np.array(place, np.int64), np.array(length, np.int64)
        low = np.array(rows, np.int64).reshape(-1, window)
        high = low.copy()
        high[np.arange(window)[None, :] >= self.length[:, None]] = (1 << self.bits) - 1
        self.low, self.high = self.pack(lambda k: low[:, k]), self.pack(lambda k: high[:, k])
        self.shortest = int(self.length.min()) if len(item) else window

    def pack(self, column: Callable[[int], np.ndarray]) -> list[np.ndarray]:
        """Columns of word ids, made one at a time, as a few integers that sort alike."""
        keys = []
        for a in range(0, self.window, self.per_key):
            key = column(a)
            for k in range(a + 1, min(a + self.per_key, self.window)):
                key = (key << self.bits) | column(k)
            keys.append(key)
        return keys


def bound(suffixes: list[np.ndarray], keys: list[np.ndarray], after: bool) -> np.ndarray:
    """For each key, how many sorted suffixes are below it, or with after not above it: a binary search for all at once."""
    lo, hi = np.zeros(len(keys[0]), np.int64), np.full(len(keys[0]), len(suffixes[0]), np.int64)
    while (go := lo < hi).any():
        mid = (lo + hi) // 2
        at = np.minimum(mid, len(suffixes[0]) - 1)
        less, equal = np.zeros(len(at), bool), np.ones(len(at), bool)
        for s, k in zip(suffixes, keys, strict=True):
            less |= equal & (s[at] < k)
            equal &= s[at] == k
        up = go & (less | equal if after else less)
        lo, hi = np.where(up, mid + 1, lo), np.where(go & ~up, mid, hi)
    return lo


def shard_matches(docs: list[list[bytes]], test: TestSuffixes) -> tuple[np.ndarray, ...]:
    """Document, item, place in the item, place in the document and length of every longest match in a shard."""
    ids = np.fromiter(chain.from_iterable(chain(map(test.vocab.get, d, repeat(0)), (0,)) for d in docs), np.int64, sum(map(len, docs)) + len(docs))
    none = (np.zeros(0, np.int64),) * 5
    if not len(ids) or not len(test.item):
        return none
    zeros = np.flatnonzero(ids == 0)
    starts = np.cumsum([0, *(len(d) + 1 for d in docs)])[:-1]
    known = np.flatnonzero(ids)
    room = zeros[np.searchsorted(zeros, known)] - known
    places = known[room >= test.shortest]
    if not len(places):
        return none
    padded = np.concatenate([ids, np.zeros(test.window, np.int64)])
    # a matrix of all windows would take ten times the words, twice
    keys = test.pack(lambda k: padded[places + k])
    order = np.lexsort(keys[::-1])
    suffixes = [k[order] for k in keys]
    first, last = bound(suffixes, test.low, after=False), bound(suffixes, test.high, after=True)
    n = np.maximum(last - first, 0)
    which = np.repeat(np.arange(len(n)), n)
    at = places[order[np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]]
    # a short window's match must not run over the end of a document or an unknown word
    ok = zeros[np.searchsorted(zeros, at)] - at >= test.length[which]
    which, at = which[ok], at[ok]
    doc = np.searchsorted(starts, at, side="right") - 1
    item, place, length, at = test.item[which], test.place[which], test.length[which], at - starts[doc]
    grow = np.lexsort((at, at - place, item, doc))
    doc, item, place, length, at = (x[grow] for x in (doc, item, place, length, at))
    if not len(doc):
        return none
    new = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(at - place) != 0) | (np.diff(at) != 1)])
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(doc)]]) - 1
    return doc[head], item[head], place[head], at[head], at[tail] - at[head] + length[tail]


_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("words", pa.int32())]))
MATCHES = "array<struct<item_id:string,item_start:int,doc_start:int,words:int>>"


def _pass(docs: DataFrame, items: list[tuple[str, str | None]], window: int, names: tuple[str, str], first: bool) -> DataFrame:
    count, matches = names
    test = docs.sparkSession.sparkContext.broadcast(TestSuffixes(items, window))
    columns = docs.columns

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = test.value
        for batch in steps(batches):
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            rows: list[list[dict]] = [[] for _ in words]
            for d, i, p, a, n in zip(*(x.tolist() for x in shard_matches(words, suffixes)), strict=True):
                rows[d].append({"item_id": suffixes.names[i], "item_start": p, "doc_start": a, "words": n})
            if first:
                arrays = [*batch.columns, pa.array(map(len, words), pa.int64()), pa.array(rows, _MATCHES)]
            else:
                held = batch.column(matches).to_pylist()
                arrays = [pa.array([a + b for a, b in zip(held, rows, strict=True)], _MATCHES) if c == matches else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, *names] if first else columns)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(match, f"{schema}, {count} bigint, {matches} {MATCHES}" if first else schema)


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """docs, n_words and matches: the longest verbatim runs of at least a window of words that a text shares with items.

    An item of fewer words than a window, but not none, must occur whole. Null texts have no words and no matches, on
    either side; a null item_id counts as `null`, and rows of one item_id are one item. Repeated documents all stay. New
    columns get longer names where docs has theirs. An empty benchmark matches nothing.
    """
    names = tuple(fresh(docs, "n_words", "matches"))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-total // item_bytes) or 1
    out = docs
    for k in range(passes):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k) if passes > 1 else items
        out = _pass(out, [tuple(r) for r in block.distinct().collect()], window, names, k == 0)
    return out


def covered(matches: Column) -> Column:
    """Words of the document inside any match."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_start"].alias("a"), (m["doc_start"] + m["words"]).alias("b"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    add = lambda s, m: F.struct((s["n"] + F.greatest(m["b"] - F.greatest(m["a"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], m["b"]).alias("end"))
    return F.aggregate(spans, start, add, lambda s: s["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with their columns, that hold no window of any item."""
    found = find_matches(docs, benchmark, window)
    return found.where(F.size(found.columns[-1]) == 0).select(*docs.columns)
