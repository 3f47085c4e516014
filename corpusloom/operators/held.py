"""Which of very many parts texts hold, parts of any script and length that are found in the data.

A bit map of hashes of the parts is sent to all tasks. A task runs over its texts, a few MB at a time, and hands on only
the stretches whose hashes are in the map; an equi-join with the parts then drops those that only look alike. So texts are
neither split into words nor shuffled, and what is shuffled grows with what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of more bytes are found by their first characters and compared again.
LONGEST = 32
#: Bits a part, and the powers of two of bits at least and at most (32 MB); more parts than fit only make more candidates.
BITS, LEAST_BITS, MOST_BITS = 32, 20, 28
#: Bits of a piece of the map, and bytes of text of a step.
PIECE, STEP = 1 << 20, 2 << 20
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
_SIZES = np.arange(LONGEST + 1, dtype=np.uint64) * _BASE
_POWERS = np.cumprod(np.full(LONGEST + 1, _BASE, np.uint64)) * np.uint64(0x632BE59BD9B4E019)


def _places(codes: np.ndarray, size: int, mix: int, bits: int) -> np.ndarray:
    """Where a hash has a bit of the map; codes are sums of bytes by _POWERS of stretches of size bytes."""
    x = codes + _SIZES[size]
    return ((x ^ (x >> np.uint64(32))) * np.uint64(mix)) >> np.uint64(64 - bits)


def _map(probes: DataFrame, bits: int) -> np.ndarray:
    """The map of the hashes of probes (probe), and after it 256 bits of the bytes in them and 256 of those that they begin with."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(0).to_pylist()]
            for n in {len(t) for t in texts}:
                x = np.frombuffer(b"".join(t for t in texts if len(t) == n), np.uint8).reshape(-1, n)
                codes = (x * _POWERS[:n]).sum(axis=1, dtype=np.uint64)
                places = [_places(codes, n, m, bits).astype(np.int64) for m in _MIX]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*places, *((1 << bits) + 256 * k + np.unique(b).astype(np.int64) for k, b in enumerate((x, x[:, 0])))]))], ["bit"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch.column(0).to_numpy()
            for piece in np.unique(x // PIECE):
                seen.setdefault(int(piece), np.zeros(PIECE, bool))[x[x // PIECE == piece] % PIECE] = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([np.packbits(v).tobytes() for v in seen.values()], pa.binary())], ["piece", "bits"])

    held = np.zeros(((1 << bits) + PIECE) // 8, np.uint8)
    marks = probes.mapInArrow(mark, "bit long")
    for r in marks.repartition(8, F.expr(f"bit div {PIECE}")).mapInArrow(fold, "piece int, bits binary").collect():
        held[r["piece"] * PIECE // 8 : (r["piece"] + 1) * PIECE // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return held


def held_parts(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """key and part of every pair of texts (key, text) and different parts (part) in which the text holds the part, once a text."""
    long = F.octet_length("part") > LONGEST
    asked = parts.where("part <> ''").select("part").distinct().select("part", F.when(long, F.left("part", F.lit(LONGEST // 4))).otherwise(F.col("part")).alias("probe"), long.alias("long"))
    figures = asked.groupBy(F.octet_length("probe").alias("size"), "long").agg(F.count("*").alias("n")).collect()  # LONGEST sizes at most, twice
    sizes, bits = {r["size"] for r in figures}, min(MOST_BITS, max(LEAST_BITS, (BITS * sum(r["n"] for r in figures)).bit_length()))
    shared = texts.sparkSession.sparkContext.broadcast(_map(asked.select("probe"), bits))

    def stretches(data: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Beginnings and sizes of the stretches of whole characters whose hashes are known; 255 stands between texts."""
        inner, first = np.unpackbits(known[(1 << bits) // 8 :][:64]).view(bool).reshape(2, 256)
        stops = np.flatnonzero(~inner[data]).astype(np.int32)
        ends = np.repeat(stops, np.diff(stops, prepend=-1))
        at = np.flatnonzero(first[data])
        at, codes, found = at[at + min(sizes, default=0) <= ends[at]], np.uint64(0), []
        for n in range(1, max(sizes, default=0) + 1):
            inside = at + n <= ends[at]
            at = at[inside]
            codes = (codes[inside] if n > 1 else codes) + data[at + n - 1] * _POWERS[n - 1]
            if n not in sizes:
                continue
            some = np.arange(len(at))
            for mix in _MIX:
                places = _places(codes[some], n, mix, bits)
                some = some[(known[places >> np.uint64(3)] >> (np.uint64(7) - (places & np.uint64(7))).astype(np.uint8)) & 1 == 1]
            begin = at[some]
            begin = begin[data[begin + n] & 0xC0 != 0x80]
            found.append((begin, np.full(len(begin), n)))
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, int), np.zeros(0, int))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            whole = [b"" if t is None else t for t in batch.column(1).cast(pa.binary()).to_pylist()]
            step = np.cumsum([len(t) + 1 for t in whole]) // STEP
            for k in np.unique(step):
                first, last = np.searchsorted(step, [k, k + 1])
                raw = b"\xff".join([*whole[first:last], b""])
                begin, size = stretches(np.frombuffer(raw, np.uint8), known)
                bounds = np.cumsum([len(t) + 1 for t in whole[first:last]])
                row = np.searchsorted(bounds, begin, "right") + first
                once = sorted({(r, raw[a : a + n]) for r, a, n in zip(row.tolist(), begin.tolist(), size.tolist(), strict=True)})
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r for r, _ in once], pa.int64())), pa.array([p for _, p in once], pa.binary()).cast(pa.string())], ["key", "probe"])

    found = texts.select("key", "text").mapInArrow(run, f"key {texts.schema['key'].dataType.simpleString()}, probe string").join(asked, "probe")
    short = found.where("not long").select("key", "part")
    if not any(r["long"] for r in figures):
        return short
    return short.unionByName(found.where("long").select("key", "part").join(texts, "key").where(F.contains("text", F.col("part"))).select("key", "part").distinct())
