"""Repair of conversations whose messages are blank, repeated, cut off or out of turn.

The edits are found by a bidirectional Dijkstra search (``lattice.py``) in chunks of at most
``2 ** BITS`` messages. A conversation of one chunk is solved at once. For a longer one each
chunk first tells the least cost from each state to each state; products of
these tables, by doubling, give the cost of all that follows a chunk. Each chunk then finds its best
path from each state, and doubling again tells which state it is entered in.
So the largest conversation is many tasks, and no task holds more than a chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemograph.llm.lattice import CLOSING, ROLE, START, Lattice, Message
from mnemograph.llm.scratch import Scratch

#: A chunk holds up to 2 ** BITS messages.
BITS = 8
#: Keys up to this number, some 16 MB, travel to the rows they select.
TRAVEL = 1_000_000

_WORD = r"[^\x20\x09-\x0D]"
_EDITS = "array<struct<mid:long,edit:string,role:string,before:array<string>,after:array<string>>>"
_EDIT = pa.list_(pa.struct([
    ("mid", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string())),
]))


@dataclass(frozen=True)
class Repaired:
    """``conversations``: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one row each.

    ``messages``: (conv_id, chunk, mid, place, edit, role, text) of what the repaired conversations hold,
    in the order of chunk, mid and place.
    """

    conversations: DataFrame
    messages: DataFrame


def repair(messages: DataFrame, scratch: Scratch, bits: int = BITS) -> Repaired:
    """The cheapest repair of each conversation of (conv_id, turn, role, text).

    Messages are ordered by turn (nulls first), then by role and text. A null role or text counts as one
    space; null conv_ids are one conversation. Equal messages of a turn are one row with a count
    from the start, so whatever number of them is no load. An empty text is a blank message, a very
    long one is only read by expressions and moved once to its edit. A role without a first character
    can't be kept. Ties take the ASCII-least audit. Other columns aren't read. An empty table
    gives empty tables.
    """
    rows = _faults(messages, scratch)
    ordered = rows.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    ordered = ordered.withColumn("mid", F.monotonically_increasing_id())
    ordered = scratch.keep(ordered.withColumn("chunk", F.shiftright("mid", bits)), "ordered")

    entry = F.struct("mid", F.substring("role", 1, 1).alias("initial"), "fault", "copies")
    cells = ordered.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    cells = scratch.keep(cells, "cells")
    chunks = cells.select("conv_id", "chunk", F.lag("chunk").over(Window.partitionBy("conv_id").orderBy("chunk")).alias("_before"))
    split = scratch.keep(chunks.where("_before is not null").select("conv_id").distinct(), "split")
    some = F.broadcast(split) if split.count() <= TRAVEL else split
    same = cells.conv_id.eqNullSafe(some.conv_id)
    solved = _solve(cells.join(some, same, "left_anti"), None)
    if not split.isEmpty():
        solved = solved.unionByName(_solve_split(cells.join(some, same, "left_semi"), scratch))
    solved = scratch.keep(solved, "solved")
    return Repaired(_conversations(ordered, cells, solved), _messages(ordered, solved))


def _faults(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, role, text, copies, fault) of the distinct messages; the copies after the first are duplicates."""
    full = messages.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    counted = scratch.keep(full.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")), "counted")
    counted = counted.withColumns({"_hash": F.md5(F.col("text").cast("binary")), "_when": F.struct(F.col("turn").isNotNull().alias("known"), "turn")})
    again = counted.groupBy("conv_id", "role", "_hash").agg(F.count(F.lit(1)).alias("_n"), F.min("_when").alias("_first")).where("_n > 1")
    again = scratch.keep(again.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("_hash").alias("_again"), "_first"), "again")
    again = F.broadcast(again) if again.count() <= TRAVEL // 4 else again
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("_hash") == F.col("_again"))
    joined = counted.join(again, same, "left")
    # Only words make a message; the last character of the last word tells whether it is whole.
    fault = (
        F.when(~F.col("text").rlike(_WORD), "blank")
        .when(F.col("_again").isNotNull() & (F.col("_when") != F.col("_first")), "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
        .otherwise("")
    )
    return joined.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def _chunk(rows: list[dict]) -> list[Message]:
    return [Message(r["initial"], r["fault"] in ("blank", "duplicate"), r["fault"] == "truncated", r["copies"]) for r in rows]


def _written(lattice: Lattice, rows: list[dict], entry: int, audit: str) -> tuple[list[dict], str]:
    """What becomes of each message, with the roles inserted before it (and after the last one), and the audit with all copies."""
    edits, letters, waiting = [], [], []
    for letter, state, at in lattice.walk(entry, audit):
        letters.append(letter)
        if letter == "I":
            waiting.append(ROLE[state])
            continue
        letters.append("D" * (rows[at]["copies"] - 1))
        edits.append({"mid": rows[at]["mid"], "edit": letter, "role": ROLE[state] if letter == "R" else None, "before": waiting, "after": []})
        waiting = []
    if waiting:
        edits[-1]["after"] = waiting
    return edits, "".join(letters)


def _solve(cells: DataFrame, togo: str | None) -> DataFrame:
    """(conv_id, chunk, entry, exit, cost, audit, edits) of each cell.

    Without ``togo`` a cell is a whole conversation. With it, a row for each state it may be entered in; the column
    ``togo`` holds the cost after the cell by exit state (null: no way), ``closes`` whether nothing follows.
    """
    kind = cells.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, chunk long, entry int, exit int, cost long, audit string, edits {_EDITS}"

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column(2)[i].as_py()
                last = togo is None or batch.column(4)[i].as_py()
                exits = CLOSING if last else {s: c for s, c in enumerate(batch.column(3)[i].as_py()) if c is not None}
                lattice, out = Lattice(_chunk(rows), last), []
                for entry in [START] if togo is None else range(4):
                    path = lattice.cheapest(entry, exits)
                    if path is not None:
                        edits, audit = _written(lattice, rows, entry, path.audit)
                        out.append((entry, path.exit, path.cost, audit, edits))
                if out:
                    entries, ends, costs, audits, edits = zip(*out, strict=True)
                    n = len(out)
                    keys = [pa.concat_arrays([batch.column(c).slice(i, 1)] * n) for c in (0, 1)]
                    values = [pa.array(entries, pa.int32()), pa.array(ends, pa.int32()), pa.array(costs, pa.int64()), pa.array(audits), pa.array(edits, _EDIT)]
                    yield pa.RecordBatch.from_arrays(keys + values, ["conv_id", "chunk", "entry", "exit", "cost", "audit", "edits"])

    names = ["conv_id", "chunk", "rows"] + ([togo, "closes"] if togo else [])
    return cells.select(*names).mapInArrow(work, schema)


def _tables(cells: DataFrame) -> DataFrame:
    """(conv_id, chunk, costs): least cost from state to state, row by row, null where no way leads."""
    kind = cells.schema["conv_id"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            found = []
            for rows in batch.column(2).to_pylist():
                lattice = Lattice(_chunk(rows), False)
                paths = [lattice.cheapest(a, {b: 0}) for a in range(4) for b in range(4)]
                found.append([None if p is None else p.cost for p in paths])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["conv_id", "chunk", "costs"])

    return cells.select("conv_id", "chunk", "rows").mapInArrow(work, f"conv_id {kind}, chunk long, costs array<long>")


def _then(a: str, b: str) -> Column:
    """Least costs through table ``a`` and then ``b``."""
    inner = f"array_min(transform(sequence(0, 3), k -> {a}[4 * (i div 4) + k] + {b}[int(4 * k + i % 4)]))"
    return F.expr(f"transform(sequence(0, 15), i -> {inner})")


def _doubled(links: DataFrame, value: str, joined: Column, back: bool, scratch: Scratch) -> DataFrame:
    """``links`` (conv_id, at, value) with the values of all chunks from each on (``back``: up to each) in one.

    ``joined`` combines ``value`` with ``_other``, the value as many chunks on as the first one covers.
    """
    most, reach = links.agg(F.max("at")).first()[0], 1
    while reach <= most:
        other = links.select(F.col("conv_id").alias("_conv"), (F.col("at") + (reach if back else -reach)).alias("_at"), F.col(value).alias("_other"))
        same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("at") == F.col("_at"))
        longer = links.join(other, same, "left").withColumn(value, F.when(F.col("_other").isNull(), F.col(value)).otherwise(joined))
        longer = scratch.keep(longer.select(*links.columns), "doubled")
        links, reach = longer, 2 * reach
    return links


def _solve_split(cells: DataFrame, scratch: Scratch) -> DataFrame:
    """As ``_solve`` for conversations of several chunks, each chunk with the entry that the whole path takes."""
    by_chunk = Window.partitionBy("conv_id").orderBy("chunk")
    tables = _tables(cells).withColumn("at", F.row_number().over(by_chunk) - 1)
    tables = scratch.keep(tables, "tables")
    whole = _doubled(tables.select("conv_id", "at", "costs"), "costs", _then("costs", "_other"), False, scratch)
    # After its last message a conversation is closed by inserts: none, two, one, none by state.
    ends = F.expr("transform(sequence(0, 3), s -> array_min(transform(sequence(0, 3), k -> costs[4 * s + k] + array(0L, 6L, 3L, 0L)[k])))")
    after = whole.select(F.col("conv_id").alias("_conv"), (F.col("at") - 1).alias("_at"), ends.alias("togo"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("at") == F.col("_at"))
    told = tables.join(after, same, "left").select("conv_id", "chunk", "at", "togo", F.col("togo").isNull().alias("closes"))
    told = scratch.keep(told, "told")
    known = told.select(F.col("conv_id").alias("_conv"), F.col("chunk").alias("_chunk"), "togo", "closes")
    paths = _solve(cells.join(known, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk"))), "togo")
    paths = scratch.keep(paths, "paths")

    leads = paths.groupBy("conv_id", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("entry", "exit"))).alias("_exits"))
    leads = leads.withColumn("leads", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.col("_exits")[s]))
    leads = leads.select("conv_id", (F.row_number().over(by_chunk) - 1).alias("at"), "chunk", "leads")
    leads = scratch.keep(leads, "leads")
    to_here = _doubled(leads.select("conv_id", "at", "leads"), "leads", F.transform("_other", lambda s: F.col("leads")[s]), True, scratch)
    entries = to_here.select(F.col("conv_id").alias("_conv"), (F.col("at") + 1).alias("_at"), F.col("leads")[START].alias("_entry"))
    entered = leads.join(entries, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("at") == F.col("_at")), "left")
    entered = entered.select(F.col("conv_id").alias("_conv"), F.col("chunk").alias("_chunk"), F.coalesce("_entry", F.lit(START)).alias("_entry"))
    taken = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk")) & (F.col("entry") == F.col("_entry"))
    return paths.join(entered, taken).select(*paths.columns)


def _conversations(ordered: DataFrame, cells: DataFrame, solved: DataFrame) -> DataFrame:
    turns = ordered.groupBy("conv_id", "turn").agg(F.lit(1).alias("_one")).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")
    )
    first = F.when(F.col("fault") == "blank", 0).otherwise(F.col("copies") - 1)
    counts = ordered.groupBy("conv_id").agg(
        F.sum(F.when(F.col("fault") == "blank", F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "duplicate", F.col("copies")).otherwise(first)).alias("duplicate"),
        F.count(F.when(F.col("fault") == "truncated", 1)).alias("truncated"),
    )
    pair = "concat(rows[i].initial, rows[i + 1].initial) NOT IN ('su', 'ua', 'au')"
    inside = f"size(filter(sequence(0, size(rows) - 2), i -> {pair}))"
    copied = "aggregate(rows, 0L, (n, r) -> n + r.copies - 1)"
    by_chunk = Window.partitionBy("conv_id").orderBy("chunk")
    ends = cells.select(
        "conv_id", "chunk", F.expr(f"CASE WHEN size(rows) > 1 THEN {inside} ELSE 0 END + {copied}").alias("_inside"),
        F.expr("rows[0].initial").alias("_first"), F.element_at("rows", -1)["initial"].alias("_last"),
    )
    border = F.concat(F.lag("_last").over(by_chunk), "_first")
    steps = ends.withColumn("_border", F.when(border.isin("su", "ua", "au") | border.isNull(), 0).otherwise(1))
    illegal = steps.groupBy("conv_id").agg(F.sum(F.col("_inside") + F.col("_border")).alias("illegal"))
    parts = F.array_sort(F.collect_list(F.struct("chunk", "audit")))
    audits = solved.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(parts, lambda p: p.audit), "").alias("audit"))
    found = turns
    for more in (counts, illegal, audits):
        more = more.withColumnRenamed("conv_id", "_conv")
        found = found.join(more, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    return found


def _messages(ordered: DataFrame, solved: DataFrame) -> DataFrame:
    edits = solved.select(F.explode("edits").alias("_e")).select(
        F.col("_e.mid").alias("_mid"), F.col("_e.edit").alias("_edit"), F.col("_e.role").alias("_role"), F.col("_e.before").alias("_before"), F.col("_e.after").alias("_after")
    )
    joined = ordered.join(edits, F.col("mid") == F.col("_mid"))
    added = lambda names: F.transform(names, lambda r: F.struct(F.lit("I").alias("edit"), r.alias("role"), F.lit("").alias("text")))
    own = F.struct(F.col("_edit").alias("edit"), F.coalesce("_role", "role").alias("role"), "text")
    left = F.filter(F.array(F.when(F.col("_edit") != "D", own)), lambda m: m.isNotNull())
    return joined.select("conv_id", "chunk", "mid", F.posexplode(F.concat(added("_before"), left, added("_after"))).alias("place", "_m")).select(
        "conv_id", "chunk", "mid", "place", "_m.*"
    )
