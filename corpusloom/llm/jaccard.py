"""N-gram Jaccard join with count-vector R-trees.

A document's set holds the hashes of its word n-grams; hashed into groups, its group counts are a point. The sum of the
coordinate minima of two points bounds the overlap of their sets, and of two boxes that of any two points in them.

One tree over all points would compare most pairs, as no few coordinates tell texts apart. The points are therefore put
into pages first: with the finest groups in a fixed order, rarest first, two sets that link must share one of the first
n - ceil(t n) + 1 coordinates of either, since the minima of the others sum to less than the overlap that is needed.
A page holds the points with one such coordinate. Then:

1. Equal sets are one node, so that copies are never compared.
2. Every point of a page is compared with the page's hub (the set whose n-grams are the most frequent, as an original
   among its edited copies is), and components are built from what links.
3. Pages that still hold several components are joined through an R-tree of their points, leaving out pairs of one
   component; large pages are split into blocks, and pairs of blocks are dealt out. Surviving pairs are verified on
   their sets, and components are built anew.

Every pair of linked nodes is thus either verified or already inside one component. Where links are counted, all pairs
inside each component are compared, as a link never leaves one. Tables used more than once are written to the shared
checkpoint folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared

WORDS, PERCENT = 4, 85
#: A point has a power of two of groups, so that about MEAN n-grams share one; points of other lengths are folded.
MEAN, LEAST_GROUPS, MOST_GROUPS = 2, 16, 1 << 16
#: Bits of the fine groups whose corpus counts order the coordinates, and pieces in which the counts are summed.
FINE_BITS, CHUNKS = 20, 64
#: Points of a page that are joined in one piece, points of a box, and bits of the filter for documents to verify.
BLOCK, LEAF, FILTER_BITS = 2048, 16, 24
#: Of sets whose links are counted in one piece, the n-grams, and those that a matrix has at a time.
GRAMS, WIDTH = 1 << 20, 4096
#: Bytes of text that are hashed at a time, and pairs whose points are unpacked at a time.
STEP, PAIRS = 1 << 18, 256
#: A coordinate that is too large for a byte: it stands for any number.
FULL = 255
#: Of the polynomials that hash words, modulo 2 ** 64.
BASE = 0xC2B2AE3D27D4EB4F
INVERSE = pow(BASE, -1, 1 << 64)


# hashing ---------------------------------------------------------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number spread over all its bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte (A-Z as a-z, 0 for white space), powers of an odd base, and their inverses."""
    byte = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    byte[65:91] = byte[97:123]
    byte[[32, *range(9, 14)]] = 0
    return byte, np.cumprod(np.full(2 * STEP, BASE, np.uint64)), np.cumprod(np.full(2 * STEP, INVERSE, np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word of UTF-8 text, in order: polynomials from prefix sums, so that no word is cut out."""
    byte, powers, inverse = _tables()
    raw, out, at = np.frombuffer(data, np.uint8), [], 0
    while at < len(raw):
        end = min(at + STEP, len(raw))
        while end < len(raw) and byte[raw[end]]:  # a piece ends at white space
            end += 1
        x = byte[raw[at:end]]
        if len(x) > len(powers):  # one word of more than a piece
            powers, inverse = (np.cumprod(np.full(len(x), b, np.uint64)) for b in (BASE, INVERSE))
        inside = np.concatenate([[False], x != 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers[: len(x)])])
            words = sums[ends] - sums[starts]
            out.append(mixed(words * inverse[starts]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(data: bytes, words: int = WORDS) -> np.ndarray:
    """Hashes of the word n-grams in order, repeats included; a text of fewer words, but some, is one n-gram."""
    w = word_hashes(data)
    if not len(w):
        return w
    n = min(words, len(w))
    out = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k])
    return out


# tables ----------------------------------------------------------------------------------------------------------------


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield i, text.as_buffer().to_pybytes() if text.is_valid else b""


def fine_counts(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Occurrences of n-grams in each fine group, over all documents: 2 ** FINE_BITS numbers, whatever the input.

    A task hands on at most 65535 for a group; only the order of coordinates depends on the numbers."""
    width = (1 << FINE_BITS) // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << FINE_BITS, np.int64)
        for _, data in _texts(batches):
            if len(h := shingles(data, words)):
                np.add.at(total, h >> np.uint64(64 - FINE_BITS), 1)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([np.minimum(total[k * width : (k + 1) * width], 65535).astype(np.uint16).tobytes() for k in range(CHUNKS)], pa.binary())], ["chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.uint16)
        return pa.table({"chunk": table.column("chunk")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select("doc_id", "text").mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary")
    out = np.zeros(1 << FINE_BITS, np.int64)
    for r in parts.collect():  # CHUNKS rows of one size
        out[r["chunk"] * width : (r["chunk"] + 1) * width] = np.frombuffer(bytes(r["counts"]), np.int64)
    return out


def points(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, node (a hash of the set), counts (the point), fame (how frequent its n-grams are) and pages (its leading
    coordinates) of each document. Without words n is 0 and node null."""
    order = docs.sparkSession.sparkContext.broadcast(fine_counts(docs, words))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order.value
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            ids, n, node, point, fame, pages = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(point, pa.binary()), pa.array(fame, pa.int32()), pa.array(pages, pa.list_(pa.int64()))], ["doc_id", "n", "node", "counts", "fame", "pages"])

        for i, data in _texts(batches):
            h = np.unique(shingles(data, words))
            if len(h):
                n = len(h)
                often = counts[h >> np.uint64(64 - FINE_BITS)]
                first = np.lexsort((h, often))[: n - -(-percent * n // 100) + 1]
                held.append((i, n, node_of(h), point_of(h), int(1000 * np.log1p(often).mean()), h[first].view(np.int64)))
            else:
                held.append((i, 0, None, None, None, None))
            if len(held) == 500:
                yield out()
                held.clear()
        if held:
            yield out()

    kind = docs.select("doc_id").schema.fields[0].dataType
    name, kind = kind.simpleString(), _arrow(kind)
    return docs.select("doc_id", "text").mapInArrow(make, f"doc_id {name}, n bigint, node bigint, counts binary, fame int, pages array<bigint>")


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def point_of(h: np.ndarray) -> bytes:
    """Group counts of a set, a byte each, packed: most are small, and rows with points are what grows fastest."""
    groups = min(max(1 << (len(h) // MEAN).bit_length(), LEAST_GROUPS), MOST_GROUPS)
    return zlib.compress(np.minimum(np.bincount((h & np.uint64(groups - 1)).astype(np.int64), minlength=groups), FULL).astype(np.uint8).tobytes(), 6)


def node_of(h: np.ndarray) -> int:
    """A hash of a sorted set."""
    with np.errstate(over="ignore"):
        return int(mixed((mixed(h) * (np.arange(len(h), dtype=np.uint64) * np.uint64(2) + np.uint64(1))).sum(keepdims=True))[0].astype(np.int64))


# R-tree ----------------------------------------------------------------------------------------------------------------


class Points:
    """Points of some rows at every number of groups, folded as asked for."""

    def __init__(self, counts: list[bytes]) -> None:
        self.counts = [zlib.decompress(c) for c in counts]
        self.groups = np.array([len(c) for c in self.counts])
        self.levels: dict[int, np.ndarray] = {}

    def at(self, groups: int) -> np.ndarray:
        """The points with that many groups, or more, which are folded; other rows are full."""
        if groups not in self.levels:
            out = np.full((len(self.counts), groups), FULL, np.uint8)
            for g in np.unique(self.groups[self.groups >= groups]):
                rows = np.flatnonzero(self.groups == g)
                x = np.frombuffer(b"".join([self.counts[r] for r in rows]), np.uint8).reshape(len(rows), -1, groups)
                out[rows] = np.where((x == FULL).any(axis=1), FULL, np.minimum(x.sum(axis=1, dtype=np.int32), FULL)).astype(np.uint8)
            self.levels[groups] = out
        return self.levels[groups]


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of coordinate minima; a full coordinate stands for any number."""
    low = np.minimum(a, b)
    return np.where((low == FULL).any(axis=-1), 1 << 40, low.sum(axis=-1, dtype=np.int64))


def allowed(x: np.ndarray, y: np.ndarray, one: Points, other: Points, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (x of one, y of other) reach the overlap that a link needs, at the finest groups that both have."""
    groups = np.minimum(one.groups[x], other.groups[y])
    ok = np.zeros(len(x), bool)
    for g in np.unique(groups):
        for at in np.array_split(rows := np.flatnonzero(groups == g), -(-len(rows) * int(g) // (1 << 20))):
            ok[at] = (100 + percent) * overlap_bound(one.at(g)[x[at]], other.at(g)[y[at]]) >= percent * (n[x[at]] + m[y[at]])
    return ok


def tree_join(points: Points, sizes: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs whose bound reaches the overlap that a link needs, found by joining a packed R-tree with itself.

    Points are sorted by size, then by their two widest coordinates, and packed into boxes of LEAF, these into boxes of
    LEAF, and so on up to one root. The join goes down level by level: a pair of boxes opens only if the minima of their
    largest coordinates reach what their smallest sets need, and if their sizes are near enough."""
    coarse = points.at(int(points.groups.min()))
    wide = np.argsort(np.ptp(coarse, axis=0))[::-1][:2]
    order = np.lexsort((coarse[:, wide[1]], coarse[:, wide[0]], sizes))
    levels = [(coarse[order], sizes[order], sizes[order])]  # largest coordinates, least and most size of each box
    while len(levels[-1][0]) > 1:
        top, least, most = levels[-1]
        heads = np.arange(0, len(top), LEAF)
        levels.append((np.maximum.reduceat(top, heads), np.minimum.reduceat(least, heads), np.maximum.reduceat(most, heads)))

    def open_pairs(x: np.ndarray, y: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """From pairs of boxes one level above depth, the pairs of points below them that pass."""
        top, least, most = levels[depth]
        inside = np.arange(LEAF)
        for at in np.array_split(np.arange(len(x)), -(-len(x) * LEAF * LEAF * top.shape[1] // (1 << 23))):
            a = np.repeat((x[at, None] * LEAF + inside)[:, :, None], LEAF, axis=2).ravel()
            b = np.repeat((y[at, None] * LEAF + inside)[:, None, :], LEAF, axis=1).ravel()
            keep = (a <= b if depth else a < b) & (b < len(top))
            a, b = a[keep], b[keep]
            # boxes are sorted by size, so the first of a pair holds the smaller sets
            keep = percent * least[b] <= 100 * most[a]
            a, b = a[keep], b[keep]
            keep = (100 + percent) * overlap_bound(top[a], top[b]) >= percent * (least[a] + least[b])
            a, b = a[keep], b[keep]
            if depth and len(a):
                yield from open_pairs(a, b, depth - 1)
            elif len(a):
                a, b = order[a], order[b]
                keep = allowed(a, b, points, points, sizes, sizes, percent)
                yield a[keep], b[keep]

    if len(levels) > 1:
        yield from open_pairs(np.zeros(1, np.int64), np.zeros(1, np.int64), len(levels) - 2)


def page_pairs(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: pairs of nodes of different components in one page whose bound allows a link; pairs may repeat.

    rows: page, i, j, block, node, n, counts, comp, first, sorted and dealt by page, i and j."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def pairs_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
            cols = {c: t.column(c).to_numpy() for c in ("page", "i", "j", "block", "node", "n", "comp", "first")}
            change = np.flatnonzero((np.diff(cols["page"]) != 0) | (np.diff(cols["i"]) != 0) | (np.diff(cols["j"]) != 0)) + 1
            counts = t.column("counts").combine_chunks()
            found_a, found_b = [], []
            for lo, hi in zip([0, *change], [*change, t.num_rows], strict=True):
                comp = cols["comp"][lo:hi]
                if hi - lo < 2 or (comp == comp[0]).all():
                    continue
                point = Points(counts[lo:hi].to_pylist())
                node, block, first = (cols[c][lo:hi] for c in ("node", "block", "first"))
                for x, y in tree_join(point, cols["n"][lo:hi], percent):
                    ok = (comp[x] != comp[y]) & (node[x] != first[x]) & (node[y] != first[y])
                    if cols["i"][lo] != cols["j"][lo]:
                        ok &= block[x] != block[y]
                    if ok.any():
                        a, b = node[x[ok]], node[y[ok]]
                        found_a.append(np.minimum(a, b))
                        found_b.append(np.maximum(a, b))
            if found_a:
                found = np.unique(np.stack([np.concatenate(found_a), np.concatenate(found_b)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            if not t.num_rows:
                continue
            last = t.slice(t.num_rows - 1)
            same = np.ones(t.num_rows, bool)
            for c in ("page", "i", "j"):
                same &= t.column(c).to_numpy() == last.column(c)[0].as_py()
            cut = t.num_rows - int(same[::-1].argmin() or (t.num_rows if same.all() else 0))
            if cut:
                yield from pairs_of(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield from pairs_of(rest)

    return rows.mapInArrow(join, "a bigint, b bigint")


# verification and components -------------------------------------------------------------------------------------------


def node_sets(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """node and its set, for the nodes in needed (node, doc_id).

    A bitmap of fixed size, however many documents are needed, keeps most others from being hashed again."""
    bits = needed.select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)).cast("int").alias("bit")).distinct()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch.column(0).to_numpy()
            for c in np.unique(x >> 14):
                seen.setdefault(int(c), np.zeros(1 << 14, bool))[x[x >> 14 == c] & 16383] = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([np.packbits(v).tobytes() for v in seen.values()], pa.binary())], ["chunk", "bits"])

    bitmap = np.zeros(1 << FILTER_BITS, bool)
    for r in bits.repartition(1 << 3, (F.col("bit") / (1 << 14)).cast("int")).mapInArrow(fold, "chunk int, bits binary").collect():
        bitmap[r["chunk"] << 14 : (r["chunk"] + 1) << 14] |= np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8)).astype(bool)
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.unpackbits(wanted.value).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(bitmap[batch.column(2).to_numpy()]))
            for at in range(0, batch.num_rows, 200):
                sets = [h for _, data in _texts([batch.slice(at, 200)]) if len(h := np.unique(shingles(data, words)))]
                if sets:
                    yield pa.RecordBatch.from_arrays([pa.array([node_of(h) for h in sets], pa.int64()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], ["node", "grams"])

    rows = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)).cast("int").alias("bit"))
    sets = rows.mapInArrow(make, "node bigint, grams array<bigint>")
    return sets.join(needed.select("node"), "node", "left_semi").groupBy("node").agg(F.first("grams").alias("grams"))


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, shared: Shared, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    needed = shared.keep(nodes.select("node", "doc_id").join(ends, "node", "left_semi"))
    sets = shared.keep(node_sets(docs, needed, words))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    same = F.size(F.array_intersect("x", "y"))
    return both.where(100 * same >= percent * (F.size("x") + F.size("y") - same)).select("a", "b")


def components(edges: DataFrame, shared: Shared) -> DataFrame:
    """node and comp, the least node it is connected with, for every node that has an edge (a, b).

    Large-star and small-star steps alternate until every edge leads to a least node; each step is a table."""
    edges = shared.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = shared.keep(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        edges = shared.keep(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "node")
        before = now


def overlaps(rows: np.ndarray, grams: np.ndarray, split: int, n: int) -> np.ndarray:
    """Sizes of the intersections of sets 0 to split with sets split to n, or of all n with each other if split is n.

    rows and grams: a set's number and one of its n-grams."""
    _, column, often = np.unique(grams, return_inverse=True, return_counts=True)
    number = np.cumsum(often > 1) - 1  # n-grams of one set alone meet no other
    rows, column = rows[often[column] > 1], number[column[often[column] > 1]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((split, n - split if split < n else n), np.int64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
        a, b = np.searchsorted(column, (lo, lo + WIDTH))
        x = np.zeros((n, WIDTH), np.float32)
        x[rows[a:b], column[a:b] - lo] = 1
        out += (x[:split] @ (x[split:] if split < n else x).T).astype(np.int64)
    return out


def link_counts(docs: DataFrame, labels: DataFrame, shared: Shared, words: int, percent: int) -> DataFrame:
    """node and links, the number of rows whose different sets it links with, for the nodes of components of several.

    labels: node, doc_id, n, copies (rows of the set) and comp. A component's sets are dealt into blocks, and each pair
    of blocks is compared in one place, so that every pair of sets is compared once."""
    large = labels.groupBy("comp").agg(F.count("*").alias("nodes"), F.sum("n").alias("grams")).where("nodes > 1")
    blocks = large.select("comp", F.greatest(F.ceil(F.col("nodes") / BLOCK), F.ceil(F.col("grams") / GRAMS)).cast("int").alias("blocks"))
    members = shared.keep(labels.join(blocks, "comp").select("node", "doc_id", "copies", "comp", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")))
    sets = shared.keep(node_sets(docs, members.select("node", "doc_id"), words))
    dealt = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("comp", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "copies").join(sets, "node")

    def count(t: pa.Table) -> pa.Table:
        block = t.column("block").to_numpy()
        t = t.take(pa.array(np.argsort(block, kind="stable")))
        node, copies, grams = t.column("node").to_numpy(), t.column("copies").to_numpy(), t.column("grams").combine_chunks()
        sizes = np.asarray(grams.value_lengths()).astype(np.int64)
        own = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        split = len(node) if own else int((block == t.column("i")[0].as_py()).sum())
        other = slice(0, None) if own else slice(split, None)
        same = overlaps(np.repeat(np.arange(len(node)), sizes), grams.flatten().to_numpy(), split, len(node)) if own or 0 < split < len(node) else np.zeros((split, len(node) - split), np.int64)
        link = 100 * same >= percent * (sizes[:split, None] + sizes[None, other] - same)
        if own:
            np.fill_diagonal(link, False)
            links = link @ copies
        else:
            links = np.concatenate([link @ copies[other], link.T @ copies[:split]])
        return pa.table({"node": pa.array(node, pa.int64()), "links": pa.array(links.astype(np.int64), pa.int64())})

    return dealt.groupBy("comp", "i", "j").applyInArrow(count, "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("links"))


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, links: bool = True) -> DataFrame:
    """doc_id, n_shingles, n_links and component_id (the least doc_id reachable by links, its own included) of each row.

    Two documents link when 100 * intersection >= percent * union of their sets; n_links counts the other rows that the
    row links with, and is left out without links, as counting compares all pairs of a component. Null text and text
    without words have no set and no links, and their component is their own doc_id. Rows of equal sets are linked. A
    null doc_id counts only if its whole component has no other. Columns besides doc_id and text aren't read. An empty
    table gives no rows.
    """
    shared = Shared(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    placed = shared.keep(points(docs, words, percent))
    nodes = shared.keep(placed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "counts", "fame", "pages")]))
    paged = shared.keep(open_entries(nodes, percent))

    stars = paged.where("star").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    edges = shared.keep(verified(docs, shared.keep(bounded(stars, nodes, percent)), nodes, shared, words, percent))
    comps = shared.keep(components(edges, shared))

    known = paged.join(comps, "node", "left").select("page", "node", "n", "size", "first", "near", F.coalesce("comp", "node").alias("comp"))
    open_pages = known.groupBy("page").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("page")
    # a page of two has had its only pair compared
    left = known.where("size > 2 and near").join(open_pages, "page", "left_semi")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = left.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("page", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "n", "comp", "first")
    dealt = dealt.join(nodes.select("node", "counts"), "node")
    rows = dealt.repartition("page", "i", "j").sortWithinPartitions("page", "i", "j")
    pairs = shared.keep(page_pairs(rows, percent).distinct())
    more = shared.keep(verified(docs, pairs, nodes, shared, words, percent))
    comps = components(edges.unionByName(more), shared)

    labels = nodes.select("node", "doc_id", "n", "copies").join(comps, "node", "left").select("node", "doc_id", "n", "copies", F.coalesce("comp", "node").alias("comp"))
    labels = shared.keep(labels) if links else labels
    least = labels.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_node = labels.join(least, "comp").select("node", "component_id", "copies")
    counted = []
    if links:
        of_node = of_node.join(link_counts(docs, labels, shared, words, percent), "node", "left")
        counted = [F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links")]
    return placed.select("doc_id", "n", "node").join(of_node, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), *counted, F.coalesce("component_id", "doc_id").alias("component_id"))


def open_entries(nodes: DataFrame, percent: int) -> DataFrame:
    """page, node, n, size, first, star and near of the entries that some other entry of their page might link with.

    first is the page's hub and size its number of entries; star marks entries that the hub's size allows a link with,
    near those that the next smaller or larger entry's size does. Entries of neither kind can't link in this page."""
    from pyspark.sql.window import Window

    entries = nodes.select(F.explode("pages").alias("page"), "node", F.col("n").cast("int").alias("n"), "fame")
    by_size, page = Window.partitionBy("page").orderBy("n"), Window.partitionBy("page")
    fits = lambda a, b: F.coalesce(100 * F.least(a, b) >= percent * F.greatest(a, b), F.lit(False))
    seen = entries.select("page", "node", "n", F.lag("n").over(by_size).alias("below"), F.lead("n").over(by_size).alias("above"), F.count("*").over(page).alias("size"), F.max(F.struct("fame", "node", "n")).over(page).alias("hub"))
    marked = seen.where("size > 1").select("page", "node", "n", "size", F.col("hub.node").alias("first"), (fits(F.col("n"), F.col("hub.n")) & (F.col("node") != F.col("hub.node"))).alias("star"), (fits(F.col("n"), F.col("below")) | fits(F.col("n"), F.col("above"))).alias("near"))
    return marked.where("star or near")


def bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose summed coordinate minima reach the overlap that a link needs."""
    of = nodes.select("node", "n", "counts")
    both = pairs.join(of.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("counts").alias("x")), "a").join(of.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("y")), "b")

    return both.mapInArrow(lambda batches: near_pairs(batches, percent), "a bigint, b bigint")


def near_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """a and b of the pairs whose points (x, y) and sizes (na, nb) allow a link.

    Points of all rows are unpacked to the most groups that one of them has, so rows are taken in small parts."""
    for whole in batches:
        for t in (whole.slice(at, PAIRS) for at in range(0, whole.num_rows, PAIRS)):
            k = np.arange(t.num_rows)
            ok = allowed(k, k, Points(t.column("x").to_pylist()), Points(t.column("y").to_pylist()), t.column("na").to_numpy(), t.column("nb").to_numpy(), percent)
            yield t.select(["a", "b"]).filter(pa.array(ok))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with their columns, that have the least doc_id of their component.

    Where rows share that doc_id, one with the least text stays; rows without words, or with a null doc_id, all stay."""
    from pyspark.sql.window import Window

    first = classes(docs, words, percent, links=False).where("doc_id = component_id").select("doc_id").distinct().withColumnRenamed("doc_id", "kept")
    kept = docs.join(first, F.col("doc_id") == F.col("kept"), "left_semi")
    numbered = kept.withColumn("kept", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
    return numbered.where("kept = 1").select(*docs.columns).unionByName(docs.where("doc_id is null"))
