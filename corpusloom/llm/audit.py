"""How filters interact, over a sparse document-term matrix.

Texts are turned into blocks of a compressed sparse row matrix whose columns are numbered within the block. The words of
all blocks are numbered together, once for the corpus, and each block's columns are renumbered: a shard of the matrix.
Row sums and counts of nonzero cells decide the filters on length and variety; the others look at characters and at
equal texts. A document is then a set of failed filters, and all orders of the filters are counted from these sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Shared, lookup, steps

FILTERS = "ABCDE"
#: Fixed values of the filters: words at least, different words and capitals in a hundred, and characters of code.
MIN_WORDS, MIN_DIFFERENT, MAX_CAPITALS, CODE = 200, 50, 2, "#$%&*|"
#: Groups in which words are numbered; words of a group meet in one task.
GROUPS = 1024
#: Numbers of a row are held as bytes, which cost the JVM nothing to hand on.
NUMBER = np.int32

SPACE_BIT, CAPITAL, TRAIL, SIGN = 1, 2, 4, 8
#: What each byte of UTF-8 is; trailing bytes don't begin a character.
KINDS = np.zeros(256, np.uint8)
KINDS[[0x20, *range(0x09, 0x0E)]] = SPACE_BIT
KINDS[ord("A") : ord("Z") + 1] = CAPITAL
KINDS[0x80:0xC0] = TRAIL
KINDS[[ord(c) for c in CODE]] = SIGN
#: Odd multipliers of a word's bytes by their places.
POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def _summed(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of x between each two places of at."""
    total = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _strings(lengths: np.ndarray, chars: np.ndarray) -> pa.StringArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(chars))


def _chars(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words, and where each begins (and the end)."""
    _, offsets, chars = words.buffers()
    at = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return (np.frombuffer(chars, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)), at - at[0]


def _groups(words: pa.StringArray, groups: int) -> np.ndarray:
    """A group for each word, by its bytes alone."""
    chars, at = _chars(words)
    if not len(words):
        return np.zeros(0, np.int64)
    place = np.arange(len(chars)) - np.repeat(at[:-1], np.diff(at))
    mixed = np.add.reduceat((chars.astype(np.uint64) + np.uint64(1)) * POWERS[place & 63], at[:-1])
    return ((mixed ^ (mixed >> np.uint64(32))) * POWERS[0] >> np.uint64(33)).astype(np.int64) % groups


class Cells:
    """A block of the matrix: its texts' words, different ones numbered from 0, and the cells of each row."""

    def __init__(self, text: pa.Array) -> None:
        data, at = _chars(text.cast(pa.string()))
        kinds = KINDS[data]
        inside = (kinds & SPACE_BIT) == 0
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        # the texts lie against each other
        first, last = at[:-1][at[:-1] < len(data)], at[1:][at[1:] > 0] - 1
        begins[first], ends[last] = inside[first], inside[last]
        begin = np.flatnonzero(begins)
        coded = _strings(np.flatnonzero(ends) + 1 - begin, data[inside]).dictionary_encode()
        self.words, width = coded.dictionary, max(1, len(coded.dictionary))
        per_text = np.diff(np.searchsorted(begin, at))
        cells, self.counts = np.unique(np.repeat(np.arange(len(text)), per_text) * width + coded.indices.to_numpy(), return_counts=True)
        self.starts, self.columns = np.searchsorted(cells, np.arange(len(text) + 1) * width), cells % width
        capitals, signs, trails = (np.diff(np.searchsorted(np.flatnonzero(kinds == k), at)) for k in (CAPITAL, SIGN, TRAIL))
        self.capitals, self.code, self.chars = capitals, signs > 0, np.diff(at) - trails


def _bytes(x: np.ndarray) -> bytes:
    """Numbers as bytes, all lowest ones first, as the higher ones are mostly alike and are pressed well."""
    return np.ascontiguousarray(x.astype(NUMBER).view(np.uint8).reshape(-1, NUMBER().itemsize).T).tobytes()


def _numbers(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(NUMBER().itemsize, -1).T).view(NUMBER).ravel()


class Matrix:
    """A document-term matrix in shards, one for about 4 MB of text or one longer text.

    docs: text and other columns, which are kept for each row. Blocks with columns of their own, and their words by
    group, are written to the shared folder; drop deletes them."""

    def __init__(self, docs: DataFrame, shared: Shared, groups: int = GROUPS) -> None:
        self.shared, self.groups = shared, groups
        self.rest = [f for f in docs.schema.fields if f.name != "text"]
        self.facts = ", ".join([*(f"`{f.name}`: {f.dataType.simpleString()}" for f in self.rest), "capitals: long, chars: long, code: boolean"])
        names = [f.name for f in self.rest]
        rows = docs.select(*names, F.coalesce("text", F.lit("")).alias("text"))
        schema = f"block long, docs array<struct<{self.facts}>>, starts binary, columns binary, counts binary, part int, local binary, lengths binary, letters binary"
        self.kept = shared.keep(rows.mapInArrow(lambda b: Matrix._blocks(b, names, groups), schema))
        self.words = self.kept.where("part is not null").select("block", "part", "local", "lengths", "letters").repartition("part").sortWithinPartitions("part", "block")

    def drop(self) -> None:
        self.shared.drop(self.kept)

    @staticmethod
    def _blocks(batches: Iterator[pa.RecordBatch], rest: list[str], groups: int) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(steps(batches)):
            cells = Cells(batch.column("text"))
            facts = {"capitals": cells.capitals, "chars": cells.chars, "code": cells.code}
            docs = pa.StructArray.from_arrays([*[batch.column(c) for c in rest], *map(pa.array, facts.values())], [*rest, *facts])
            part = _groups(cells.words, groups)
            order = np.argsort(part, kind="stable")
            chars, at = _chars(cells.words.take(pa.array(order)))
            cuts = np.searchsorted(part[order], np.arange(groups + 1))
            some = np.flatnonzero(np.diff(cuts))
            spans = [(cuts[g], cuts[g + 1]) for g in some]
            none = [None] * len(some)
            values = [_bytes(x) for x in (cells.starts, cells.columns, cells.counts)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([first + k] * (len(some) + 1), pa.int64()),
                    pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), pa.nulls(len(some), pa.list_(docs.type))]),
                    *[pa.array([v, *none], pa.binary()) for v in values],
                    pa.array([None, *some.tolist()], pa.int32()),
                    pa.array([None, *[_bytes(order[a:b]) for a, b in spans]], pa.binary()),
                    pa.array([None, *[_bytes(np.diff(at[a : b + 1])) for a, b in spans]], pa.binary()),
                    pa.array([None, *[chars[at[a] : at[b]].tobytes() for a, b in spans]], pa.binary()),
                ],
                ["block", "docs", "starts", "columns", "counts", "part", "local", "lengths", "letters"],
            )

    @staticmethod
    def _numbered(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[tuple[list[dict], pa.DictionaryArray, np.ndarray]]:
        """For each group: its rows, their words, and the columns of the different ones among these."""
        rows = (r for batch in batches for r in batch.to_pylist())
        for part, own in groupby(rows, key=lambda r: r["part"]):
            held = list(own)
            lengths = np.concatenate([_numbers(r["lengths"]) for r in held])
            words = _strings(lengths, np.frombuffer(b"".join(r["letters"] for r in held), np.uint8)).dictionary_encode()
            columns = np.empty(len(words.dictionary), np.int64)
            # words of a group are numbered in their order, so that a repeated task gives the same numbers
            columns[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(len(columns)) * groups + part
            yield held, words, columns

    def dictionary(self) -> DataFrame:
        """word and column. Columns are unique numbers from 0, with gaps where groups of words are of unequal sizes."""
        groups = self.groups

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, words, columns in Matrix._numbered(batches, groups):
                yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(columns)], ["word", "column"])

        return self.words.mapInArrow(run, "word string, column long")

    def _streams(self) -> DataFrame:
        """Columns of each block's words, group by group, and then the block itself, one block after the other in a task."""
        groups = self.groups

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held, words, columns in Matrix._numbered(batches, groups):
                ids = columns[words.indices.to_numpy()]
                at = np.concatenate([[0], np.cumsum([len(r["local"]) // NUMBER().itemsize for r in held])])
                cut = [ids[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([r["block"] for r in held], pa.int64()), pa.array([r["local"] for r in held], pa.binary()), pa.array(cut, pa.binary())], ["block", "local", "ids"])

        ids = self.words.mapInArrow(run, "block long, local binary, ids binary")
        blocks = self.kept.where("part is null").select("block", "docs", "starts", "columns", "counts")
        both = blocks.withColumn("last", F.lit(1)).unionByName(ids.withColumn("last", F.lit(0)), allowMissingColumns=True)
        return both.repartition("block").sortWithinPartitions("block", "last").drop("last")

    @staticmethod
    def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.StructArray, np.ndarray, np.ndarray, np.ndarray]]:
        """block, docs, starts, columns and counts of each shard."""
        held: list[tuple[bytes, bytes]] = []
        for batch in batches:
            for k in range(batch.num_rows):
                block, local, ids, starts, columns, counts = (batch.column(c)[k].as_py() for c in ("block", "local", "ids", "starts", "columns", "counts"))
                if local is not None:
                    held.append((local, ids))
                    continue
                places = np.concatenate([np.zeros(0, NUMBER), *[_numbers(x) for x, _ in held]])
                new = np.empty(len(places), np.int64)
                new[places] = np.frombuffer(b"".join(x for _, x in held), np.int64)
                held.clear()
                yield block, batch.column("docs").slice(k, 1).flatten(), _numbers(starts), new[_numbers(columns)], _numbers(counts)

    def shards(self) -> DataFrame:
        """block, docs, starts (of the cells of each row, and their end), columns and counts: compressed sparse rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, docs, *numbers in Matrix._shards(batches):
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (docs, *(pa.array(x, pa.int64()) for x in numbers))]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *lists], ["block", "docs", "starts", "columns", "counts"])

        return self._streams().mapInArrow(run, f"block long, docs array<struct<{self.facts}>>, starts array<long>, columns array<long>, counts array<long>")

    def measured(self) -> DataFrame:
        """A row a document: its columns, capitals, chars, code, n_words (its row's sum) and n_different (its row's nonzero cells)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, docs, starts, columns, counts in Matrix._shards(batches):
                facts = {f.name: docs.field(k) for k, f in enumerate(docs.type)}
                # a column occurs once in a row, so a row's nonzero cells are its different words
                facts |= {"n_words": pa.array(_summed(counts, starts)), "n_different": pa.array(_summed(columns >= 0, starts))}
                yield pa.RecordBatch.from_arrays(list(facts.values()), list(facts))

        return self._streams().mapInArrow(run, f"{self.facts.replace(': ', ' ')}, n_words long, n_different long")


def failures(docs: DataFrame, labels: DataFrame, shared: Shared, part: str = "source", groups: int = GROUPS) -> DataFrame:
    """doc_id, part, failed (bits of FILTERS, A the lowest), good and toxic of each row of docs.

    Null text is empty and has no words; a null part is the empty string. Equal texts are told by SHA-256: E is failed
    by rows of a larger doc_id than the least one of their text, so rows of one doc_id don't fail for each other, and
    rows without a doc_id never fail it. A document is good or toxic if any of its labels says so; labels may be
    missing, null or repeated. Further columns are left out. An empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), "text")
    matrix = Matrix(rows, shared, groups)
    facts = shared.keep(matrix.measured())
    matrix.drop()
    total = facts.count()
    firsts = facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    said = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    tests = {
        "A": F.col("n_words") < MIN_WORDS,
        "B": 100 * F.col("n_different") < MIN_DIFFERENT * F.col("n_words"),
        "C": 100 * F.col("capitals") > MAX_CAPITALS * F.col("chars"),
        "D": F.col("code"),
        "E": F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)),
    }
    bits = [F.when(tests[f], 1 << k).otherwise(0) for k, f in enumerate(FILTERS)]
    failed = lookup(facts, firsts, "digest", total).select("doc_id", "part", sum(bits[1:], bits[0]).alias("failed"))
    return failed.join(said, "doc_id", "left").select("doc_id", "part", "failed", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def interactions(failed: DataFrame) -> DataFrame:
    """A row a part, filter_order and step, zeros included, from part, failed, good and toxic; see op13_filter_audit."""
    sets = failed.groupBy("part", "failed", "good", "toxic").agg(F.count("*").alias("n"))
    at = [f"{''.join(o)},{k + 1},{1 << FILTERS.index(o[k])},{sum(1 << FILTERS.index(f) for f in o[:k])}" for o in permutations(FILTERS) for k in range(len(FILTERS))]
    step = lambda x: F.struct(x[0].alias("filter_order"), x[1].cast("int").alias("step"), x[2].cast("int").alias("bit"), x[3].cast("int").alias("before"))
    rows = sets.withColumn("at", F.explode(F.transform(F.split(F.lit(";".join(at)), ";"), lambda x: step(F.split(x, ","))))).select("part", "failed", "good", "toxic", "n", "at.*")
    fails, earlier = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.col("before")) != 0
    out = fails & ~earlier
    of = lambda when, name: F.sum(F.when(when, F.col("n")).otherwise(0)).cast("long").alias(name)
    counts = rows.groupBy("part", "filter_order", "step", "bit").agg(
        of(~fails & ~earlier, "kept"), of(out, "removed"), of(fails & earlier, "redundant"), of(F.col("failed") == F.col("bit"), "unique_fails"), of(out & F.col("good"), "good_lost"), of(out & F.col("toxic"), "toxic_lost")
    )
    return counts.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit")).cast("long")).drop("bit")
