"""Conversation structure repair: weighted interval parsing of the turns' roles under a repair grammar."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import col, same
from corpusmill.session import materialize

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
#: Turns that one task parses before it passes on their cell.
BLOCK_TURNS = 4096

#: Places in the wanted form ``(s?(ua)+)?``: at its start, after s, after u, after a. A role leads from one place to another.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STEPS = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
ENDS = (START, AFTER_A)
NAMES = {"u": "user", "a": "assistant"}

#: What is known of a span: for each nonterminal (from, to) the least (cost, edits) that lead between these places.
Cell = dict[tuple[int, int], tuple[int, str]]


def _reachable() -> set[tuple[int, int]]:
    found = {(p, p) for p in range(4)} | {(p, q) for (p, _), q in STEPS.items()}
    while more := {(p, r) for p, q in found for q2, r in found if q == q2} - found:
        found |= more
    return found


#: The grammar's nonterminals and its rules (A, B, C), A to B C, in Chomsky normal form. Each derivation of a span can be cut
#: between any two of its turns, so the cells of the halves give the cell of the whole and no other split has to be tried.
NONTERMINALS = sorted(_reachable())
RULES = [((p, r), (p, q), (q, r)) for p, q in NONTERMINALS for q2, r in NONTERMINALS if q == q2]


def joined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans. Equal edits cost the same, so no least edits are the beginning of others and minima join to minima."""
    out: Cell = {}
    for whole, first, second in RULES:
        if first in left and second in right:
            a, b = left[first], right[second]
            found = (a[0] + b[0], a[1] + b[1])
            if whole not in out or found < out[whole]:
                out[whole] = found
    return out


def _closure() -> Cell:
    """The least insertions between every two places."""
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    single = cell | {(p, q): (COST[INSERT], INSERT) for (p, role), q in STEPS.items() if role in NAMES}
    while (wider := joined(cell, single)) != cell:
        cell = wider
    return cell


INSERTIONS = _closure()


def _leaf(initial: str, fault: str) -> Cell:
    cell: Cell = {(p, p): (COST[DELETE], DELETE) for p in range(4)}
    if fault in "tn":
        extra = TRUNCATED_COST if fault == "t" else 0
        for (p, role), q in STEPS.items():
            if role in NAMES:
                cell[p, q] = min(cell.get((p, q), (99, "")), (COST[REROLE] + extra, REROLE))
            if role == initial:
                cell[p, q] = min(cell.get((p, q), (99, "")), (COST[KEEP] + extra, KEEP))
    return joined(joined(INSERTIONS, cell), INSERTIONS)


#: Cells of one turn by its role's initial (x: any other) and its fault (b: blank, d: duplicate, t: truncated, n: none).
LEAVES = {i + f: _leaf(i, f) for i in "suax" for f in "bdtn"}


def parse(cells: list[Cell]) -> Cell:
    """The cell over all of these neighbouring spans, bottom-up: spans of two, of four, of eight and so on."""
    while len(cells) > 1:
        cells = [joined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else INSERTIONS


def best(cell: Cell) -> tuple[int, str]:
    return min(cell[START, q] for q in ENDS if (START, q) in cell)


def role_after(place: int, edit: str, initial: str) -> tuple[int, str | None]:
    """The place an edit leads to, and the role it gives; None keeps the turn's own."""
    if edit == DELETE:
        return place, None
    if edit == KEEP:
        return STEPS[place, initial], None
    new = next(r for r in NAMES if (place, r) in STEPS)
    return STEPS[place, new], NAMES[new]


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def placed(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, pos) written in order: ``pos`` rises with conv_id, turn, role and text, nulls first, by one within a range.

    Sorted by ranges, so a conversation of any length, and a turn repeated any
    number of times, lies in as many tasks as it needs.
    """
    space = F.lit(" ")
    rows = turns.select(
        col("conv_id").alias("conv_id"),
        col("turn").cast("long").alias("turn"),
        F.coalesce(col("role"), space).alias("role"),
        F.coalesce(col("text"), space).alias("text"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "_tie")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(rows.withColumn("pos", F.monotonically_increasing_id()).drop("_tie"), "repair-turns")


def marked(rows: DataFrame) -> DataFrame:
    """(pos, conv_id, initial, fault) of placed turns; the first fault counts: blank, duplicate of an earlier turn, truncated."""
    key = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), F.lit(1))
    light = rows.select("pos", "conv_id", _initial(F.col("role")).alias("initial"), key.alias("key"), last.alias("last"))
    # Only the least place of each key is shuffled by key, one per task; the join is by place, which is unique.
    first = light.groupBy("conv_id", "key").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("last") == "", "b").when(F.col("first").isNull(), "d").when(~F.col("last").isin(".", "!", "?"), "t").otherwise("n")
    return light.select("pos", "conv_id", "initial", "last").join(first, "pos", "left").select("pos", "conv_id", "initial", fault.alias("fault"))


_CELLS = "array<struct<start:int,stop:int,cost:long,edits:string>>"


def blocks(marks: DataFrame) -> DataFrame:
    """(conv_id, first, initials, faults, cells): neighbouring turns of a conversation, parsed together."""
    schema = f"conv_id {marks.schema['conv_id'].dataType.simpleString()}, first long, initials string, faults string, cells {_CELLS}"
    types = {"first": pa.int64(), "initials": pa.string(), "faults": pa.string()}
    cell_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, start, initials, faults, kind = None, 0, [], [], None

        def close() -> pa.RecordBatch:
            cell = parse([LEAVES[i + f] for i, f in zip(initials, faults, strict=True)])
            cells = [{"start": p, "stop": q, "cost": c, "edits": e} for (p, q), (c, e) in cell.items()]
            arrays = [pa.array([conv], kind), *(pa.array([v], t) for v, t in zip((start, "".join(initials), "".join(faults)), types.values(), strict=True)), pa.array([cells], cell_type)]
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *types, "cells"])

        for batch in batches:
            kind = batch.column(1).type
            for pos, c, i, f in zip(*(batch.column(n).to_pylist() for n in range(4)), strict=True):
                if initials and (c != conv or pos != start + len(initials) or len(initials) == BLOCK_TURNS):
                    yield close()
                    initials, faults = [], []
                if not initials:
                    conv, start = c, pos
                initials.append(i)
                faults.append(f)
        if initials:
            yield close()

    return marks.repartitionByRange("pos").sortWithinPartitions("pos").mapInArrow(run, schema)


def _parsed(parts: DataFrame) -> DataFrame:
    """One row per conversation from its blocks: counts of faults, cost and edits, and each block's share of the edits."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, pieces array<struct<first:long,place:int,initials:string,edits:string>>"
    piece = pa.list_(pa.struct([("first", pa.int64()), ("place", pa.int32()), ("initials", pa.string()), ("edits", pa.string())]))

    def one(held: list[dict]) -> tuple:
        cost, audit = best(parse([{(c["start"], c["stop"]): (c["cost"], c["edits"]) for c in b["cells"]} for b in held]))
        initials, faults = "".join(b["initials"] for b in held), "".join(b["faults"] for b in held)
        pieces, at, place = [], 0, START
        for b in held:
            begin, entered, turn = at, place, 0
            while turn < len(b["initials"]):
                place, _ = role_after(place, audit[at], b["initials"][turn])
                turn += audit[at] != INSERT
                at += 1
            pieces.append({"first": b["first"], "place": entered, "initials": b["initials"], "edits": audit[begin:at]})
        # Insertions after the last turn.
        pieces[-1]["edits"] += audit[at:]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        return faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                values = one(batch.column(1)[i].as_py())
                kinds = [pa.int64()] * 5 + [pa.string(), piece]
                arrays = [batch.column(0).slice(i, 1), *(pa.array([v], k) for v, k in zip(values, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "pieces"])

    gathered = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first", "initials", "faults", "cells"))).alias("blocks"))
    return gathered.mapInArrow(run, schema)


def _lines(parsed: DataFrame) -> DataFrame:
    """(pos, seq, edit, new_role) of every edit; insertions come at the place of the turn before which, or at the end after which, they stand."""
    schema = "pos long, seq int, edit string, new_role string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, place, initials, edits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turn, seq, out = 0, 0, []
                for edit in edits:
                    at = min(turn, len(initials) - 1)
                    place, role = role_after(place, edit, initials[at])
                    out.append((first + at, seq, edit, role))
                    turn += edit != INSERT
                    seq = 0 if edit != INSERT and turn < len(initials) else seq + 1
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["pos", "seq", "edit", "new_role"])

    pieces = parsed.select(F.explode("pieces").alias("p")).select("p.first", "p.place", "p.initials", "p.edits")
    return pieces.mapInArrow(run, schema)


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations of ``turns`` (conv_id, turn, role, text) and their repaired turns.

    First frame, one row per conv_id: gaps (turns missing between the first and
    the last), blank, duplicate, truncated (turns by their first fault), illegal
    (neighbouring roles that may not follow each other), cost, and audit, the
    initials of the cheapest edits in order, ASCII-least among equals. Second
    frame: conv_id, pos, seq (order), edit, turn, role, text of every turn that
    is kept, gets another role or is inserted (then turn is null, text empty).

    Turns are taken by number, nulls first, equal numbers by role and text.
    Null role or text counts as one space, a null conv_id is a conversation.
    Blank and repeated turns are always deleted. Texts of any length are never
    gathered: tasks parse blocks of turns, and only the blocks' cells, one
    letter per edit, meet by conversation, whose audit is one string anyhow.
    Other columns are ignored. An empty table gives two empty frames.
    """
    rows = placed(turns)
    parsed = materialize(_parsed(blocks(marked(rows))), "repair-parsed")
    numbers = rows.where("turn IS NOT NULL").select("conv_id", "turn").distinct().groupBy(F.col("conv_id").alias("_c"))
    numbers = numbers.agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("_gaps"))
    found = parsed.drop("pieces").join(numbers, same(F.col("conv_id"), F.col("_c")), "left").withColumn("gaps", F.coalesce("_gaps", F.lit(0).cast("long"))).drop("_c", "_gaps")
    lines = _lines(parsed).where(F.col("edit") != DELETE).join(rows, "pos")
    inserted = F.col("edit") == INSERT
    repaired = lines.select(
        "conv_id",
        "pos",
        "seq",
        "edit",
        F.when(~inserted, F.col("turn")).alias("turn"),
        F.coalesce("new_role", "role").alias("role"),
        F.when(inserted, F.lit("")).otherwise(F.col("text")).alias("text"),
    )
    return found, repaired


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) over the newline-joined ``role:text`` of each conversation. A digest has one order, so a task reads a conversation's lines one after the other and holds none."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, out, type_ = None, None, [], None
        for batch in batches:
            type_ = batch.column(0).type
            for c, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or c != conv:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], type_), pa.array([o[1] for o in out])], names=["conv_id", "repaired_sha256"])
                out = []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], type_), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

    lines = repaired.select("conv_id", F.concat("role", F.lit(":"), "text").alias("line"), "pos", "seq")
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "seq").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with planted faults that follow from crc32 of ``conv_id:turn``: one in twenty each is dropped, emptied, loses its end marks, is repeated, becomes a user's."""
    space = F.lit(" ")
    rows = turns.select(col("conv_id").alias("conv_id"), col("turn").alias("turn"), F.coalesce(col("role"), space).alias("role"), F.coalesce(col("text"), space).alias("text"))
    told = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    rows = rows.withColumn("_act", F.crc32(F.concat(told[0], F.lit(":"), told[1])) % 20).where(F.col("_act") != 0)
    text = F.when(F.col("_act") == 1, F.lit("")).when(F.col("_act") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_act") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("_act") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def summary(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``, damaged and repaired: what ``repair`` finds, and a digest of the repaired turns."""
    found, repaired = repair(damaged(conversations))
    every = conversations.select(col("conv_id").alias("conv_id")).distinct()
    found = found.select(F.col("conv_id").alias("_c"), *[c for c in found.columns if c != "conv_id"])
    told = digests(repaired).select(F.col("conv_id").alias("_d"), "repaired_sha256")
    zero = F.lit(0).cast("long")
    out = every.join(found, same(F.col("conv_id"), F.col("_c")), "left").join(told, same(F.col("conv_id"), F.col("_d")), "left")
    return out.select(
        "conv_id",
        *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
