"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units that no piece crosses: blanks and what follows them, and within that runs of characters that
occur beside each other in pieces (letters, or signs). The different units of the corpus are encoded once: their
substrings of bounded length are exploded and equi-joined to the piece table, the edges are grouped by unit, and a Spark
higher-order fold walks the lattice from left to right and keeps one edge for each position.

The model at hand merges pairs by rank, and the path of the largest summed score is not what merging gives. Edges
therefore carry the pieces that they get on with before them: two neighbours get on when merging their characters gives
just these two pieces. Of all paths only the merged one has no others beside it, so a position has one such edge, and
the result equals merging.

Documents are then put together from units: the most frequent ones (a bounded number) from a broadcast table, all
others by a join.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, fresh, let, steps

#: Units of the broadcast table at most.
HOT = 1 << 19
#: Counts from here on are alike, in steps of a sixteenth of a doubling, to the choice of the broadcast units.
RARE = 1 << 16
#: Shapes of pieces that a task remembers.
HELD = 80_000
#: Places for pairs of pieces that a task remembers.
PAIRS = 1 << 20
#: Units that a task turns into edges.
UNITS = 20_000
#: Characters of a unit that one row of the lattice holds; longer units take several rows.
LONG = 64
#: Characters that bound the length of the pieces that begin with them.
BEGIN = 4
#: Edges, and positions, that the fold takes at a time, so that its state stays small in units of any length.
BLOCK = 128
#: Bytes of text that a task cuts at a time.
STEP = 3 << 20
BLANK = "▁"
#: Shuffle files go with the query that wrote them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A run of blanks and what follows, where blanks were written as such or stand beside each other.
RUNS = re.compile("▁+[^▁]*")
#: Every byte that is no part of UTF-8 gives a U+FFFD of its own.
codecs.register_error("each", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class Model:
    """Pieces of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        self.bytes = {int(p[3:5], 16): k for k, p in enumerate(self.pieces) if model.is_byte(k)}
        self.of_byte = {k: b for b, k in self.bytes.items()}
        plain = [k for k in range(len(self.pieces)) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))]
        self.rank = {self.pieces[k]: (-model.get_score(k), k) for k in plain}
        self.longest = max(map(len, self.rank))
        self.units = self.unit_pattern()
        self.alone = _Memo(lambda p: self.merge([*p]) == [p])
        self.spines = _Memo(lambda k: (self.spine(self.pieces[k], 1), self.spine(self.pieces[k], 0)), len(self.pieces))
        self.pairs, self.fit = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self.said = self._said()
        self.words = pa.array([x.encode() for x in self.said], pa.binary())
        self.partial = np.array([k in self.of_byte and self.of_byte[k] > 127 for k in range(len(self.pieces))])

    def unit_pattern(self) -> re.Pattern:
        """Matches units: characters that are beside each other in some piece form a class, and no piece leaves a class."""
        if any(BLANK in p.lstrip(BLANK) or "\n" in p or len(p) > 1 and not self.rank.keys() >= {*p} for p in self.rank):
            raise ValueError("the model has pieces that cross units")
        of: dict[str, set[str]] = {}
        for p in self.rank:
            if len(p) > 1 and (core := p.lstrip(BLANK)):
                for other in [of.setdefault(c, {c}) for c in core]:
                    if other is not (own := of[core[0]]):
                        own |= other
                        of.update(dict.fromkeys(other, own))
        classes = sorted({id(s): sorted(s) for s in of.values()}.values(), key=lambda s: (-len(s), s))
        self.letters = "".join(map(re.escape, classes[0]))
        # most parts are letters, or letters and a sign, which is a unit of its own
        self.signs = [c for c in ".," if c in self.rank and c not in classes[0]]
        return re.compile("|".join([*("▁*[" + "".join(map(re.escape, s)) + "]+" for s in classes), "▁+", "[\\s\\S]"]))

    def merge(self, parts: list[str]) -> list[str]:
        """What merging makes of the characters of one or two pieces."""
        while len(parts) > 1:
            best = min(((self.rank[a + b][0], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                break
            parts = [*parts[: best[1]], parts[best[1]] + parts[best[1] + 1], *parts[best[1] + 2 :]]
        return parts

    def spine(self, piece: str, side: int) -> list[tuple[str, float]]:
        """The parts of a piece at its right (1) or left (0) edge, from the whole to one character, and the rank of the
        merge that takes each into the next larger one (none for the whole piece: a rank above all)."""
        out, taken = [], float("inf")
        while True:
            out.append((piece, taken))
            if len(piece) == 1:
                return out
            parts = [*piece]
            while len(parts) > 2:
                _, k = min((self.rank[a + b][0], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank)
                parts = [*parts[:k], parts[k] + parts[k + 1], *parts[k + 2 :]]
            taken, piece = self.rank[piece][0], parts[side]

    def crossed(self, a: int, b: int) -> bool:
        """Whether some merge over the border of two pieces comes before what takes its parts into the pieces.

        Parts of a piece have lower ranks than itself, so ranks order merges in time; of two equal ones the left is first."""
        rank, left = self.rank.get, self.spines[b][1]
        for x, before in self.spines[a][0]:
            for y, until in left:
                found = rank(x + y)
                if found is not None and found[0] < before and found[0] <= until:
                    return True
        return False

    def fits(self, pairs: np.ndarray) -> np.ndarray:
        """Whether the pieces of each pair, as one number, get on; pairs are different. Each is remembered until another takes its place."""
        place = (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIRS.bit_length() + 1)).astype(np.int64)
        known = self.pairs[place] == pairs
        out = known & self.fit[place]
        new = np.flatnonzero(~known)
        out[new] = [not self.crossed(ab >> 32, ab & 0xFFFFFFFF) for ab in pairs[new].tolist()]
        # of two pairs of one place the last is kept, in both tables
        self.pairs[place[new]], self.fit[place[new]] = pairs[new], out[new]
        return out

    def shapes(self, parts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Which parts are letters alone, and which are letters and a sign."""
        bare = pc.match_substring_regex(parts, f"^[{self.letters}]+$")
        signs = "".join(map(re.escape, self.signs))
        signed = pc.match_substring_regex(parts, f"^[{self.letters}]+[{signs}]$") if signs else pa.array(np.zeros(len(parts), bool))
        return bare, signed

    def units_of(self, part: str) -> list[str]:
        """Units of a blank and a part of a text."""
        return self.units.findall(BLANK + part)

    def single(self, unit: str) -> list[int]:
        """Ids of one character: its piece, or the pieces of its bytes."""
        return [self.rank[unit][1]] if unit in self.rank else [self.bytes[b] for b in unit.encode()]

    def _said(self) -> list[str]:
        """What each id stands for beside others; a byte above 127 says nothing alone, and a control id nothing at all."""
        return [chr(self.of_byte[k]) if self.of_byte.get(k, 128) < 128 else p.replace(BLANK, " ") if p in self.rank else "" for k, p in enumerate(self.pieces)]

    def text(self, ids: np.ndarray) -> str:
        """The text that ids stand for; bytes that are no UTF-8 stand for U+FFFD."""
        if self.partial[ids].any():
            out, run = [], bytearray()
            for k in ids.tolist():
                if k in self.of_byte:
                    run.append(self.of_byte[k])
                    continue
                out += (run.decode(errors="each"), self.said[k])
                run.clear()
            text = "".join([*out, run.decode(errors="each")])
        else:
            text = "".join(map(self.said.__getitem__, ids.tolist()))
        return text[1:] if text.startswith(" ") else text

    def texts(self, ids: pa.Array) -> pa.Array:
        """The text of each array of ids, empty for null."""
        bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        words = self.words.take(pa.array(flat))
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
        held = pa.Array.from_buffers(pa.string(), len(ids), [None, pa.py_buffer(offsets[bounds].astype(np.int32)), words.buffers()[2] or pa.py_buffer(b"")])
        held = pc.if_else(pc.starts_with(held, " "), pc.utf8_slice_codeunits(held, 1), held)
        seen = np.concatenate([[0], np.cumsum(self.partial[flat])])
        odd = np.flatnonzero(np.diff(seen[bounds]))
        if not len(odd):
            return held
        mask = np.zeros(len(ids), bool)
        mask[odd] = True
        return pc.replace_with_mask(held, pa.array(mask), pa.array([self.text(flat[bounds[k] : bounds[k + 1]]) for k in odd.tolist()], pa.string()))


class _Memo(dict):
    def __init__(self, make, most: int = HELD) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.make(key)
        return value


@cache
def model(path: str) -> Model:
    """One a process."""
    return Model(path)


def parts_of(text: str | None) -> list[str]:
    """The text between blanks; where blanks follow each other, all but the first belong to what follows."""
    if not text:
        return []
    if text[0] == " " or "  " in text or BLANK in text:
        return [run[1:] for run in RUNS.findall(BLANK + text.replace(" ", BLANK))]
    return text.split(" ")


def cut(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where each text's parts begin among all parts (and the end), each part's number, and the different parts."""
    odd = pc.or_(pc.or_(pc.match_substring(text, "  "), pc.match_substring(text, BLANK)), pc.or_(pc.starts_with(text, " "), pc.equal(text, "")))
    odd = pc.fill_null(odd, False)
    parts = pc.split_pattern(text, " ")
    if pc.any(odd).as_py():
        own = pa.array([parts_of(t) for t in text.filter(odd).to_pylist()], pa.list_(pa.string()))
        place = np.arange(len(text))
        place[odd.to_numpy(zero_copy_only=False)] = len(text) + np.arange(len(own))
        parts = pa.concat_arrays([parts, own]).take(pa.array(place))
    lengths = pc.fill_null(parts.value_lengths(), 0).to_numpy(zero_copy_only=False)
    flat = parts.flatten().dictionary_encode()
    return np.concatenate([[0], np.cumsum(lengths)]), flat.indices.to_numpy(), flat.dictionary


def vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """unit and n: how often each different unit of two characters or more occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in steps(batches, limit=STEP):
            _, number, parts = cut(batch.column("text"))
            n = pa.array(np.bincount(number, minlength=len(parts)), pa.int64())
            bare, signed = m.shapes(parts)
            odd = pc.invert(pc.or_(bare, signed))
            heads = pc.utf8_slice_codeunits(parts.filter(signed), 0, -1)
            others = [(u, k) for p, k in zip(parts.filter(odd).to_pylist(), n.filter(odd).to_pylist(), strict=True) for u in m.units_of(p) if len(u) > 1]
            units = pa.concat_arrays([*[pc.binary_join_element_wise(BLANK, x, "") for x in (parts.filter(bare), heads)], pa.array([u for u, _ in others], pa.string())])
            counts = pa.concat_arrays([n.filter(bare), n.filter(signed), pa.array([k for _, k in others], pa.int64())])
            held = pa.table({"unit": units, "n": counts}).group_by("unit").aggregate([("n", "sum")])
            yield from pa.table({"unit": held["unit"], "n": held["n_sum"]}).to_batches(max_chunksize=50_000)
            pa.default_memory_pool().release_unused()  # the same process sorts edges next

    return docs.select("text").mapInArrow(count, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n"))


def whole_units(units: DataFrame) -> DataFrame:
    """key, n, base, text and starts of short units: the unit itself, with edges from each of its characters.

    A task gets a bounded number of units, as they grow to many edges that it sorts."""
    short = units.where(F.char_length("unit") <= LONG)
    # edges are sorted by unit, which costs little if they are so already
    short = short.repartition(-(-units.count() // UNITS) or 1, "unit").sortWithinPartitions("unit")
    return short.select(F.col("unit").alias("key"), "n", F.lit(0).alias("base"), F.col("unit").alias("text"), F.char_length("unit").alias("starts"))


def cut_units(units: DataFrame, longest: int) -> DataFrame:
    """The same of long units, in rows of LONG characters and what a piece may take beyond; key is a hash of the unit."""
    rows = units.select(F.sha2("unit", 256).alias("key"), "n", "unit", F.explode(F.sequence(F.lit(0), F.char_length("unit") - 1, F.lit(LONG))).alias("base"))
    return rows.select("key", "n", "base", F.substring("unit", F.col("base") + 1, F.lit(LONG + longest - 1)).alias("text"), F.least(F.lit(LONG), F.char_length("unit") - F.col("base")).alias("starts"))


def lattice(units: DataFrame, path: str) -> DataFrame:
    """key, n and edges, sorted by end and start: numbers that hold end, length and id (see neighbours)."""
    m = model(path)
    # the piece table is as large as the model, whatever the corpus; a piece that merging takes apart is never an edge
    edges = [(p, k) for p, (_, k) in m.rank.items() if m.alone[p]]
    pieces = units.sparkSession.createDataFrame(edges, "piece string, id int")
    # the longest piece that begins with some characters bounds the substrings from there
    most: dict[str, int] = {}
    for p, _ in edges:
        if len(p) >= BEGIN:
            most[p[:BEGIN]] = max(most.get(p[:BEGIN], 0), len(p))
    begins = units.sparkSession.createDataFrame(list(most.items()), "begin string, most int")
    spots = units.select("*", F.explode(F.sequence(F.lit(1), F.col("starts"))).alias("start"))
    spots = spots.withColumn("begin", F.substring("text", F.col("start"), F.lit(BEGIN))).join(F.broadcast(begins), "begin", "left")
    spots = spots.select("*", F.explode(F.sequence(F.lit(1), F.least(F.coalesce("most", F.lit(BEGIN - 1)), F.char_length("text") - F.col("start") + 1))).alias("length"))
    spots = spots.select("key", "n", (F.col("base") + F.col("start") + F.col("length") - 1).alias("end"), "length", F.substring("text", F.col("start"), F.col("length")).alias("piece"))
    found = spots.join(F.broadcast(pieces), "piece")
    edge = F.shiftleft(F.col("end").cast("long"), 32) + F.shiftleft(F.lit(255) - F.col("length"), 20) + F.col("id")
    return found.select("key", "n", edge.alias("edge")).groupBy("key").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("edge")).alias("edges"))


def neighbours(edges: DataFrame, path: str) -> DataFrame:
    """The lattice with edges as end, start, key (of start and id) and after: keys of the edges that it gets on with.

    Edges that get on with nothing before them go. A unit's edges are cut into blocks, as an array within an array costs
    no more to reach when there are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            flat = batch.column("edges")
            x, bounds = flat.flatten().to_numpy(), flat.offsets.to_numpy()
            end = x >> 32
            start, ids = end - (255 - ((x >> 20) & 255)), x & 0xFFFFF
            unit = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            # edges are sorted by unit and end, so those that end at a place follow each other
            ends, starts = unit << 32 | end, unit << 32 | start
            lo, hi = np.searchsorted(ends, starts), np.searchsorted(ends, starts, side="right")
            n = hi - lo
            later = np.repeat(np.arange(len(x)), n)
            first = np.arange(len(later)) - np.repeat(np.cumsum(n) - n - lo, n)
            pairs, which = np.unique(ids[first] << 32 | ids[later], return_inverse=True)
            ok = m.fits(pairs)[which]
            key = start << 20 | ids
            often = np.bincount(later[ok], minlength=len(x))
            kept = np.flatnonzero((start == 0) | (often > 0))
            after = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(often[kept])]), pa.int32()), pa.array(key[first[ok]], pa.int64()))
            edges_ = pa.StructArray.from_arrays([pa.array(end[kept], pa.int32()), pa.array(start[kept], pa.int32()), pa.array(key[kept], pa.int64()), after], ["end", "start", "key", "after"])
            own = np.bincount(unit[kept], minlength=len(bounds) - 1)
            many = -(-own // BLOCK)
            block = np.concatenate([[0], np.cumsum(many)])
            cuts = np.repeat(np.cumsum(own) - own, many) + BLOCK * (np.arange(block[-1]) - np.repeat(block[:-1], many))
            blocks = pa.ListArray.from_arrays(pa.array([*cuts, len(kept)], pa.int32()), edges_)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.ListArray.from_arrays(pa.array(block, pa.int32()), blocks)], ["key", "n", "edges"])

    return edges.mapInArrow(run, "key string, n bigint, edges array<array<struct<end:int,start:int,key:bigint,after:array<bigint>>>>")


def best_path(edges: Column, longest: int) -> Column:
    """Ids along the path of the lattice: a fold from left to right keeps one edge a position, another walks back.

    Spark copies a fold's state at every step. Both folds of a unit of many edges therefore go in blocks, whose state is
    small, and hand on what is settled block by block, so that the cost is in proportion to the unit's length."""
    none, nones = F.expr("cast(array() as array<bigint>)"), F.expr("cast(array() as array<array<bigint>>)")

    def extend(kept: Column, e: Column, base: Column) -> Column:
        fits = (e["start"] == 0) | F.array_contains(e["after"], F.get(kept, e["start"] - 1 - base))
        return F.when((F.size(kept) + base < e["end"]) & fits, F.concat(kept, F.array(e["key"]))).otherwise(kept)

    def back(kept: Column, taken: Column, at: Column, spots: Column) -> Column:
        """taken with the kept edges that end at each other's starts, from position at on, in descending spots."""
        step = lambda x, k: F.when(F.coalesce(F.shiftright(F.element_at(F.when(F.size(x) > 0, x), -1), 20), at) == k, F.concat(x, F.array(F.get(kept, k - 1)))).otherwise(x)
        return F.aggregate(spots, taken, step)

    def forward(s: Column, block: Column) -> Column:
        def settle(kept: Column) -> Column:
            """All but the positions that a later edge may begin at are settled."""
            old = F.greatest(F.size(kept) - longest, F.lit(0))
            return F.struct(F.concat(s["done"], F.array(F.slice(kept, F.lit(1), old))).alias("done"), F.slice(kept, old + 1, F.lit(BLOCK + longest)).alias("kept"), (s["base"] + old).alias("base"))

        return F.aggregate(block, s["kept"], lambda kept, e: extend(kept, e, s["base"]), settle)

    def walk(kept: Column) -> Column:
        def block(s: Column, k: Column) -> Column:
            spots = F.sequence(F.size(kept) - k * BLOCK, F.greatest(F.size(kept) - (k + 1) * BLOCK + 1, F.lit(1)))
            end = lambda x: F.struct(F.coalesce(F.shiftright(F.element_at(F.when(F.size(x) > 0, x), -1), 20), s["at"]).alias("at"), F.concat(s["done"], F.array(x)).alias("done"))
            return let(back(kept, none, s["at"], spots), end)

        blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(kept) / BLOCK).cast("int") - 1, F.lit(0)))
        return F.aggregate(blocks, F.struct(F.size(kept).cast("long").alias("at"), nones.alias("done")), block, lambda s: F.flatten(s["done"]))

    state = F.struct(nones.alias("done"), none.alias("kept"), F.lit(0).alias("base"))
    whole = F.aggregate(edges, state, forward, lambda s: F.concat(F.flatten(s["done"]), s["kept"]))
    short = F.aggregate(F.get(edges, F.lit(0)), none, lambda kept, e: extend(kept, e, F.lit(0)))
    once = lambda kept: back(kept, none, F.size(kept).cast("long"), F.sequence(F.size(kept), F.lit(1)))
    path = F.when(F.size(edges) == 1, let(short, once)).otherwise(let(whole, walk))
    return F.reverse(F.transform(path, lambda x: x.bitwiseAND(0xFFFFF).cast("int")))


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def encode_units(docs: DataFrame, path: str, shared: Shared) -> DataFrame:
    """unit, n and ids of every different unit of two characters or more of the texts."""
    m = model(path)
    with setting(docs.sparkSession, CLEANUP, "true"):
        units = shared.keep(vocabulary(docs, path))
    walked = lambda rows: neighbours(lattice(rows, path), path).select("key", "n", best_path(F.col("edges"), m.longest).alias("ids"))
    # edges are sorted by unit, which spills, instead of held in a map of all units of a task
    with setting(docs.sparkSession, CLEANUP, "true"), setting(docs.sparkSession, "spark.sql.execution.useObjectHashAggregateExec", "false"), setting(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", "2000"):
        long = units.where(F.char_length("unit") > LONG)
        named = long.select("unit", F.sha2("unit", 256).alias("key"))
        found = shared.keep(walked(whole_units(units)).withColumnRenamed("key", "unit").unionByName(walked(cut_units(long, m.longest)).join(named, "key").drop("key")))
    shared.drop(units)
    return found


def frequent(encoded: DataFrame, hot: int) -> pa.Table:
    """unit and ids of the most frequent units, hot at most."""
    level = F.when(F.col("n") < RARE, F.col("n")).otherwise(RARE + F.floor(16 * F.log2(F.col("n") / RARE)))
    least, total = None, 0
    for r in encoded.groupBy(level.cast("int").alias("level")).agg(F.count("*").alias("units")).orderBy(F.desc("level")).collect():
        if least is not None and total + r["units"] > hot:
            break
        least, total = r["level"], total + r["units"]
    if least is None:
        return pa.table({"unit": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.int32()))})
    return encoded.where(level >= least).select("unit", "ids", "n").limit(hot).toArrow().sort_by([("n", "descending"), ("unit", "ascending")])


def hashed(units: pa.Array) -> np.ndarray:
    """A hash of each string, by sums of all bytes times powers of an odd number."""
    offsets = np.frombuffer(units.buffers()[1], np.int32)[units.offset : units.offset + len(units) + 1] if len(units) else np.zeros(1, np.int32)
    data = np.frombuffer(units.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    at, odd = offsets - offsets[0], 0x9E3779B97F4A7C15
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.cumprod(np.full(len(data), odd, np.uint64)))])
    back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), pow(odd, -1, 1 << 64), np.uint64)]))
    out = (sums[at[1:]] - sums[at[:-1]]) * back[at[:-1]]
    return (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


class Codes:
    """Numbers of single characters, bytes and frequent units, frequent ones small; 0 stands for any other unit."""

    def __init__(self, m: Model, top: pa.Table) -> None:
        own, lists = [(p, k) for p, (_, k) in m.rank.items() if len(p) == 1], top.column("ids").combine_chunks()
        # codes 1 to 256 are bytes
        self.names = pa.concat_arrays([pa.array([p for p, _ in own], pa.string()), top.column("unit").combine_chunks().cast(pa.string())])
        self.lengths = np.concatenate([[0], np.ones(256 + len(own), np.int64), np.asarray(lists.value_lengths(), dtype=np.int64)])
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.ids = np.concatenate([[m.bytes[b] for b in range(256)], [k for _, k in own], lists.flatten().to_numpy()]).astype(np.int32)

    @cached_property
    def places(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Sorted hashes of the names, the name of each, and the names that have the hash of another before them."""
        hashes = np.concatenate([np.zeros(0, np.uint64), *[hashed(self.names.slice(a, 50_000)) for a in range(0, len(self.names), 50_000)]])
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        return hashes, order, self.names.take(pa.array(order[1:][hashes[1:] == hashes[:-1]]))

    def find(self, units: pa.Array) -> np.ndarray:
        """The code of each unit, 0 for those that have none: names of equal hashes are compared."""
        hashes, order, twins = self.places
        if not len(hashes):
            return np.zeros(len(units), np.int64)
        own = hashed(units)
        spot = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        name = order[spot]
        same = np.flatnonzero(hashes[spot] == own)
        out = np.zeros(len(units), np.int64)
        equal = pc.equal(units.take(pa.array(same)), self.names.take(pa.array(name[same]))).to_numpy(zero_copy_only=False)
        out[same[equal]] = name[same[equal]] + 257
        if len(twins):
            more = np.flatnonzero(pc.is_in(units, value_set=twins).to_numpy(zero_copy_only=False))
            out[more] = pc.index_in(units.take(pa.array(more)), value_set=self.names).to_numpy(zero_copy_only=False).astype(np.int64) + 257
        return out

    def of_parts(self, m: Model, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """How many units each part has, all their codes, for each the place among the other units (-1: it has a code), and these."""
        bare, signed = m.shapes(parts)
        whole, heads = parts.filter(bare), parts.filter(signed)
        left = pc.invert(pc.or_(bare, signed))
        cut = [m.units_of(p) for p in parts.filter(left).to_pylist()]
        # a character without a piece is its bytes
        flat = [x for units in cut for u in units for x in ([u] if len(u) > 1 or u in m.rank else [*u.encode()])]
        bare, signed, left = (np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (bare, signed, left))
        sizes = np.ones(len(parts), np.int64)
        sizes[signed] = 2
        sizes[left] = [sum(1 if len(u) > 1 or u in m.rank else len(u.encode()) for u in units) for units in cut]
        begin = np.cumsum(sizes) - sizes
        spots = np.concatenate([begin[bare], begin[signed], np.repeat(begin[left] - (np.cumsum(sizes[left]) - sizes[left]), sizes[left]) + np.arange(len(flat))])
        names = pa.concat_arrays([*[pc.binary_join_element_wise(BLANK, x, "") for x in (whole, pc.utf8_slice_codeunits(heads, 0, -1))], pa.array(["" if isinstance(x, int) else x for x in flat], pa.string())])
        codes, place = np.zeros(int(sizes.sum()), np.int64), np.full(int(sizes.sum()), -1, np.int64)
        found, signs = np.split(self.find(pa.concat_arrays([names, pa.array(m.signs, pa.string())])), [len(names)])
        bytes_ = np.array([x + 1 if isinstance(x, int) else 0 for x in flat], np.int64)
        found[len(names) - len(flat) :] += bytes_
        codes[spots] = found
        for sign, code in zip(m.signs, signs.tolist(), strict=True):
            codes[begin[signed[pc.ends_with(heads, sign).to_numpy(zero_copy_only=False)]] + 1] = code
        rare = np.flatnonzero(found == 0)
        place[spots[rare]] = np.arange(len(rare))
        return sizes, codes, place, names.take(pa.array(rare))

    def of_texts(self, m: Model, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Where each text's codes begin (and the end), all codes, and the other units as above."""
        bounds, number, parts = cut(text)
        sizes, codes, place, names = self.of_parts(m, parts)
        own = sizes[number]
        ends = np.concatenate([[0], np.cumsum(own)])
        spots = np.repeat((np.cumsum(sizes) - sizes)[number] - ends[:-1], own) + np.arange(int(ends[-1]))
        return ends[bounds], codes[spots], place[spots], names

    def filled(self, codes: np.ndarray, sizes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each code's ids begin (and the end), and all ids; sizes and ids of the other units in order."""
        size = self.lengths[codes]
        spots = np.flatnonzero(codes == 0)
        size[spots] = sizes
        ends = np.concatenate([[0], np.cumsum(size)])
        out = self.ids[np.minimum(np.repeat(self.offsets[codes] - ends[:-1], size) + np.arange(int(ends[-1])), len(self.ids) - 1)]
        out[np.repeat(ends[spots] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(others))] = others
        return ends, out


def encode(docs: DataFrame, path: str, hot: int = HOT, decoded: str | None = None) -> DataFrame:
    """docs without text, and piece_ids: the ids of each whole text, without begin or end marks.

    Null and empty texts have no ids. Other columns pass unchanged, and repeated rows all stay; the new column gets a
    longer name where docs has one of that name. An empty table stays empty. doc_id and text, by two hashes, tell rows
    apart, so a null doc_id is as good as any. A column named decoded, if asked for, has the text that the ids stand for.
    """
    spark, shared = docs.sparkSession, Shared(docs.sparkSession)
    encoded = encode_units(docs, path, shared)
    table = spark.sparkContext.broadcast(Codes(model(path), frequent(encoded, hot)))
    name, one, two, packed, said, found = fresh(docs, "piece_ids", "row_one", "row_two", "packed", "said", "found")
    rest = [c for c in docs.columns if c.lower() != "text"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rest)
    keys = F.xxhash64("doc_id", "text").alias(one), F.xxhash64("text", F.lit(1), "doc_id").alias(two)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, press = model(path), zstandard.ZstdCompressor(level=1)
        for batch in steps(batches, limit=STEP):
            bounds, codes, place, names = table.value.of_texts(m, batch.column("text"))
            planes = [(codes >> k & 255).astype(np.uint8) for k in (0, 8, 16)]
            data = [press.compress(b"".join([p[a:b].tobytes() for p in planes])) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
            spots = np.flatnonzero(place >= 0)
            # no unit of two characters or more holds a line end (see unit_pattern)
            others = pa.ListArray.from_arrays(pa.array(np.searchsorted(spots, bounds), pa.int32()), names.take(pa.array(place[spots])))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in [*rest, one, two]], pa.array(data, pa.binary()), pc.binary_join(others, "\n")], [*rest, one, two, packed, said])
            pa.default_memory_pool().release_unused()

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.not_equal(batch.column(said), ""))
            units = pc.split_pattern(batch.column(said), "\n")
            row = pc.list_parent_indices(units)
            at = np.arange(len(row)) - np.searchsorted(row, row)
            out = pa.table([batch.column(one).take(row), batch.column(two).take(row), pa.array(at, pa.int32()), units.flatten()], ["one", "two", "at", "unit"])
            yield from out.to_batches(max_chunksize=50_000)

    # texts are cut once: both sides read all columns of one and the same shuffle, which Spark therefore makes once
    rows = docs.select("*", *keys).mapInArrow(pack, f"{schema}, {one} bigint, {two} bigint, {packed} binary, {said} string").repartition(one, two)
    others = rows.mapInArrow(rare, "one bigint, two bigint, at int, unit string")
    filled = others.join(encoded.select("unit", "ids"), "unit").groupBy("one", "two").agg(F.collect_set(F.struct("at", "ids")).alias(found))
    both = rows.join(filled, (F.col(one) == F.col("one")) & (F.col(two) == F.col("two")), "left").select(*rest, packed, said, found)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, codes, press = model(path), table.value, zstandard.ZstdDecompressor()
        for batch in steps(batches, packed, 1 << 18):
            planes = [np.frombuffer(press.decompress(x), np.uint8).reshape(3, -1) for x in batch.column(packed).to_pylist()]
            x = np.concatenate(planes, axis=1).astype(np.int64)
            more = batch.column(found).flatten()
            row = pc.list_parent_indices(batch.column(found)).to_numpy()
            held = more.field("ids").take(pa.array(np.lexsort((more.field("at").to_numpy(), row))))
            ends, ids = codes.filled(x[0] | x[1] << 8 | x[2] << 16, held.value_lengths().to_numpy(), held.flatten().to_numpy())
            bounds = np.concatenate([[0], np.cumsum([p.shape[1] for p in planes])])
            lists = pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], lists, *[m.texts(lists)] * bool(decoded)], [*rest, name, *[decoded] * bool(decoded)])

    return both.mapInArrow(unpack, f"{schema}, {name} array<int>" + (f", `{decoded}` string" if decoded else ""))


def decode(encoded: DataFrame, path: str, column: str = "piece_ids", name: str = "text") -> DataFrame:
    """The table with the text that each array of ids stands for in a further column; null ids give empty text."""
    columns = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([*part.columns, m.texts(part.column(column))], [*columns, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, {name} string")
