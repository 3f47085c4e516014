"""Repair of conversation structure by the cheapest edits.

A conversation's rows become a signature, one letter a row: the class of its role and its fault. Signatures of all
conversations are read from the end, in the order of their reversed letters, so that neighbours share their suffixes.
Every suffix is a node of an automaton, and suffixes whose costs to go differ by a constant over all grammar states are
one node: the automaton is minimal, has a bounded number of nodes, and each node's costs and best first edit are worked
out once for each grammar state. The best edits of a signature are then read off the nodes from its start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lookup, steps

BLANK = " \t\n\x0b\f\r"
#: Neighbouring initials that are right, edit costs, and ends of sentences.
RIGHT_PAIRS, REROLE, DELETE, INSERT, TRUNCATED, ENDS = ("su", "ua", "au"), 3, 4, 3, 3, ".!?"
ROLES, FAULTS = "uas", ("none", "delete", "truncated")
#: Grammar states of (s?(ua)+)?: at the start, after s, after u, after a. A row's role as given leads on by GIVEN, and a chosen role by CHOSEN.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
GIVEN = {"u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}, "s": {START: AFTER_S}}
CHOSEN = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
NEVER = 1 << 30
#: Rows whose letters are gathered at a time.
PIECE = 256
NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def letter(role: int, fault: int) -> str:
    """The signature's letter of a role (its place in ROLES, 3 for others) and a fault (its place in FAULTS)."""
    return chr(ord("a") + 3 * role + fault)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy and dropped: the rows after damage by a checksum of `conv_id:turn`; nulls are one space.

    Dropped rows stay as rows with dropped set, so that no conversation is lost."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("kind") == 0).alias("dropped"))


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, pos (from 1, by turn), turn, role, text, fault, sign, illegal, new_turn and dropped of each row.

    rows: conv_id, turn, role, text and, where they are there, copy and dropped. Rows of one turn follow role, text and copy; a null turn comes first."""
    rows = rows.select("conv_id", "turn", "role", "text", *[c if c in rows.columns else F.lit(v).alias(c) for c, v in (("copy", 0), ("dropped", False))])
    again = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.asc_nulls_first("turn"), "copy")
    along = Window.partitionBy("conv_id").orderBy("dropped", F.asc_nulls_first("turn"), "role", "text", "copy")
    stripped = F.btrim("text", F.lit(BLANK))
    rows = rows.withColumn("seen", F.row_number().over(again) > 1).withColumns({"pos": F.row_number().over(along), "initial": F.substring("role", 1, 1), "stripped": stripped})
    fault = F.when(F.length("stripped") == 0, "blank").when(F.col("seen"), "duplicate").when(~F.right("stripped", F.lit(1)).isin(*ENDS), "truncated").otherwise("none")
    rows = rows.withColumns({"fault": fault, "before": F.lag("initial").over(along), "turn_before": F.lag("turn").over(along)})
    role = F.when(F.col("initial") == "u", 0).when(F.col("initial") == "a", 1).when(F.col("initial") == "s", 2).otherwise(3)
    place = F.when(F.col("fault").isin("blank", "duplicate"), 1).when(F.col("fault") == "truncated", 2).otherwise(0)
    return rows.select(
        "conv_id",
        F.col("pos").cast("long").alias("pos"),
        "turn",
        "role",
        "text",
        "fault",
        F.char(F.lit(ord("a")) + 3 * role + place).alias("sign"),
        F.coalesce(~F.concat("before", "initial").isin(*RIGHT_PAIRS), F.lit(False)).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))).alias("new_turn"),
        "dropped",
    )


def summary(rows: DataFrame) -> DataFrame:
    """conv_id, signature, gaps and the numbers of faults of each conversation, from numbered rows."""
    left = ~F.col("dropped")
    of = lambda when, name: F.sum(F.when(left & when, 1).otherwise(0)).alias(name)
    faults = [of(F.col("fault") == f, f) for f in ("blank", "duplicate", "truncated")]
    pieces = rows.groupBy("conv_id", F.floor((F.col("pos") - 1) / PIECE).alias("piece")).agg(
        *faults, of(F.col("illegal"), "illegal"), of(F.col("new_turn"), "turns"), F.min(F.when(left, F.col("turn"))).alias("low"), F.max(F.when(left, F.col("turn"))).alias("high"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(left, F.struct("pos", "sign")))), lambda x: x["sign"]), "").alias("signs"),
    )
    whole = pieces.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")], F.min("low").alias("low"), F.max("high").alias("high"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "signs"))), lambda x: x["signs"]), "").alias("signature"),
    )
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return whole.select("conv_id", "signature", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal")


class Node(NamedTuple):
    """Suffixes that are alike: costs to go from each grammar state, less the cheapest, and the first edit there. The end has no edit."""

    costs: tuple[int, ...]
    edits: tuple[str, ...]


def settled(costs: list[int], edits: list[str]) -> tuple[Node, int]:
    """The node, and what was taken off its costs, once rows may also be inserted."""
    for _ in range(len(costs)):
        for q, to in CHOSEN.items():
            costs[q], edits[q] = min((costs[q], edits[q]), (costs[to] + INSERT, "I"))
    least = min(costs)
    return Node(tuple(c - least for c in costs), tuple(edits)), least


END = settled([0, NEVER, NEVER, 0], [""] * 4)


@cache
def node(sign: str, after: Node) -> tuple[Node, int]:
    """The node of a row before a suffix. There are as many as different letters and nodes, whatever the conversations are."""
    role, fault = divmod(ord(sign) - ord("a"), 3)
    more = TRUNCATED if FAULTS[fault] == "truncated" else 0
    costs, edits = [], []
    for q in range(4):
        ways = [(after.costs[q] + DELETE, "D")]
        if FAULTS[fault] != "delete":
            ways.append((after.costs[CHOSEN[q]] + REROLE + more, "R"))
            if role < len(ROLES) and q in GIVEN[ROLES[role]]:
                ways.append((after.costs[GIVEN[ROLES[role]][q]] + more, "K"))
        cost, edit = min(ways)
        costs.append(cost)
        edits.append(edit)
    return settled(costs, edits)


def moved(q: int, edit: str, sign: str) -> int:
    """The grammar state after an edit."""
    if edit == "D":
        return q
    return GIVEN[ROLES[(ord(sign) - ord("a")) // 3]][q] if edit == "K" else CHOSEN[q]


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before, suffixes, spent = "", [END[0]], [END[1]]
    for batch in batches:
        costs, audits = [], []
        for signature in batch.column("signature").to_pylist():
            letters = signature[::-1]
            shared = next((k for k, (x, y) in enumerate(zip(before, letters, strict=False)) if x != y), min(len(before), len(letters)))
            del suffixes[shared + 1 :], spent[shared + 1 :]
            for sign in letters[shared:]:
                new, least = node(sign, suffixes[-1])
                suffixes.append(new)
                spent.append(spent[-1] + least)
            before, q, k, audit = letters, START, len(letters), []
            costs.append(suffixes[k].costs[q] + spent[k])
            while edit := suffixes[k].edits[q]:
                audit.append(edit)
                q = moved(q, edit, letters[k - 1] if k else "")
                k -= edit != "I"
            audits.append("".join(audit))
        yield pa.RecordBatch.from_arrays([batch.column("signature"), batch.column("copies"), pa.array(costs, pa.int64()), pa.array(audits)], ["signature", "copies", "cost", "audit"])


def audited(signatures: DataFrame) -> DataFrame:
    """signature, copies, cost and audit, from different signatures and their copies."""
    return signatures.repartitionByRange(F.reverse("signature")).sortWithinPartitions(F.reverse("signature")).select("signature", "copies").mapInArrow(_audited, "signature string, copies long, cost long, audit string")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, tuple[str, str, str] | None]]:
    """A conversation's header before its rows as they come: the edit, role and text of each row that stays or is put in."""
    q, edits = START, iter("")

    def inserted() -> Iterator[str]:
        """Roles of the rows put in before the next edit, which is left in `edit`."""
        nonlocal q, edit
        while (edit := next(edits, "")) == "I":
            q = CHOSEN[q]
            yield "user" if q == AFTER_U else "assistant"

    edit = ""
    for batch in steps(batches):
        for row in batch.to_pylist():
            if row["pos"] == 0:
                # what follows the last row of the conversation before
                yield from ((None, ("I", role, "")) for role in inserted())
                q, edits = START, iter(row["audit"])
                yield row, None
                continue
            yield from ((None, ("I", role, "")) for role in inserted())
            q = moved(q, edit, row["sign"])
            if edit != "D":
                yield None, (edit, row["role"] if edit == "K" else "user" if q == AFTER_U else "assistant", row["text"])
    yield from ((None, ("I", role, "")) for role in inserted())


def _rows(kind: pa.DataType, batches: Iterator[pa.RecordBatch], limit: int = 4096) -> Iterator[pa.RecordBatch]:
    conv, at, held = None, 0, []
    names = ["conv_id", "at", "edit", "role", "text"]

    def batch() -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (kind, pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names)

    for header, row in _repaired(batches):
        if header:
            conv, at = header["conv_id"], 0
        else:
            held.append((conv, at := at + 1, *row))
        if len(held) >= limit:
            yield batch()
            held.clear()
    yield batch()


def _digests(kind: pa.DataType, batches: Iterator[pa.RecordBatch], limit: int = 4096) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", *NUMBERS, "cost", "audit", "repaired_sha256"]
    done, current, digest, first = [], None, hashlib.sha256(), True

    def batch() -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        out = pa.RecordBatch.from_arrays([pa.array([r[n] for r in done], t) for n, t in zip(names, kinds, strict=True)], names)
        done.clear()
        return out

    for header, row in chain(_repaired(batches), [({}, None)]):
        if row:
            digest.update(f"{'' if first else chr(10)}{row[1]}:{row[2]}".encode())
            first = False
            continue
        if current is not None:
            done.append(current | {"repaired_sha256": digest.hexdigest()})
        if len(done) >= limit:
            yield batch()
        current, digest, first = header, hashlib.sha256(), True
    yield batch()


def streams(rows: DataFrame) -> DataFrame:
    """Each conversation's header (pos 0) with its numbers, cost and audit, then its numbered rows, one conversation after the other in a task."""
    heads = summary(rows)
    copies = heads.groupBy("signature").agg(F.count("*").alias("copies"))
    total = heads.count()
    heads = lookup(heads, audited(copies), "signature", total).select("conv_id", F.lit(0).cast("long").alias("pos"), *NUMBERS, "cost", "audit")
    both = heads.unionByName(rows.where("not dropped").select("conv_id", "pos", "role", "text", "sign"), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "pos")


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, at (from 1), edit (K kept, R given another role, I put in), role and text.

    conversations: conv_id, turn, role and text (see numbered). The edits are the cheapest that give role initials
    (s?(ua)+)?, and of these the least in the order of their letters. Blank rows and duplicates always go. A null
    conv_id is a conversation; conversations of which nothing is left have no rows. Null texts and roles are one space.
    Further columns are left out. Rows of a conversation are streamed through one task in order, never
    gathered."""
    kind = _arrow(conversations)
    said = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    return streams(numbered(said)).mapInArrow(lambda b: _rows(kind, b), f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, at long, edit string, role string, text string")


def audit(rows: DataFrame) -> DataFrame:
    """A row a conversation: gaps, faults, illegal, cost, audit and repaired_sha256, the digest of its repaired `role:text` lines; rows are numbered ones.

    A conversation all of whose rows are dropped has zeros, an empty audit and the digest of nothing."""
    kind = _arrow(rows)
    numbers = ", ".join(f"{n} long" for n in (*NUMBERS, "cost"))
    return streams(rows).mapInArrow(lambda b: _digests(kind, b), f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {numbers}, audit string, repaired_sha256 string")


def _arrow(df: DataFrame) -> pa.DataType:
    return pa.int64() if df.schema["conv_id"].dataType.simpleString() == "bigint" else pa.string() if df.schema["conv_id"].dataType.simpleString() == "string" else pa.int32()
