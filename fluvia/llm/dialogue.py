"""Repair of conversation structure along the cheapest edits.

A conversation's rows, in order, are letters of an automaton for ``(s?(ua)+)?``. Nodes are (rows used, state); arcs keep,
rerole or delete the next row, or insert an empty one. Forward and backward least costs show which arcs lie on a cheapest
path (tight arcs); a set of nodes, the frontier, then walks these arcs and takes the least edit letter at each step.
Insert alone uses no row, so all nodes of a frontier have used equally many.

Rows are dealt by ranges of (conversation, turn, role, text) and sorted, so a conversation of any length spreads over
partitions. One that lies inside a partition is repaired there, in one pass. One that may go on in the next partition, or
is longer than ``MOST_ROWS`` or ``MOST_BYTES``, is left open: its rows are cut into blocks, each block becomes a table of
least costs between states, the tables of a conversation are added up from both ends, and then every block is walked by
itself from each state that a cheapest path enters it with. Only the two things the contract wants whole, audit and hash,
go through one task a conversation: the audit as letters, the hash as a stream of rows that keeps none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import map_arrow, table, written

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
MOST_ROWS, MOST_BYTES = 20_000, 32_000_000
BLOCK_ROWS, BLOCK_BYTES = 4096, 16_000_000
NEVER = 1 << 30
#: States: nothing yet, after system, after user, after assistant. The role that may follow, and the state after it.
ROLES, AFTER = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
#: State after keeping a row of each initial; None where it may not stand.
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "?": (None,) * 4}
END = (0, 2 * INSERT, INSERT, 0)
GOOD_PAIRS = {"su", "ua", "au"}
START = (0, NEVER, NEVER, NEVER)

# A row is one character: its role's initial (s, u, a or another) and its fault (none, blank, duplicate, truncated).
FAULTS = ("", "blank", "duplicate", "truncated")


def code(role: str, fault: str) -> str:
    """The character of a row. An empty role has no initial, and like any other initial can't be kept."""
    return chr(65 + 4 * ("sua?".index(role[0]) if role[:1] in {"s", "u", "a"} else 3) + FAULTS.index(fault))


@lru_cache(maxsize=None)
def arcs(row: str) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """By state: (letter, cost, next state) of the arcs that use the row."""
    at = ord(row) - 65
    initial, fault = "sua?"[at // 4], FAULTS[at % 4]
    more = CUT_OFF if fault == "truncated" else 0
    out = []
    for q in range(4):
        here = [("D", DELETE, q)]
        if fault not in ("blank", "duplicate"):
            if KEPT[initial][q] is not None:
                here.append(("K", KEEP + more, KEPT[initial][q]))
            here.append(("R", REROLE + more, AFTER[q]))
        out.append(tuple(here))
    return tuple(out)


def _leveled(costs: list[int]) -> tuple[int, tuple[int, ...]]:
    low = min(costs)
    return low, tuple(NEVER if c >= NEVER else c - low for c in costs)


@lru_cache(maxsize=1 << 16)
def forward(costs: tuple[int, ...], row: str) -> tuple[int, tuple[int, ...]]:
    """Least costs from the start to the states after the row; inserts come before it. The least of them apart."""
    now = _inserted(costs)
    out = [NEVER] * 4
    for q, c in enumerate(now):
        for _, price, to in arcs(row)[q]:
            out[to] = min(out[to], c + price)
    return _leveled(out)


@lru_cache(maxsize=1 << 16)
def _inserted(costs: tuple[int, ...]) -> tuple[int, ...]:
    now = list(costs)
    for _ in range(2):
        for q in range(4):
            now[AFTER[q]] = min(now[AFTER[q]], now[q] + INSERT)
    return tuple(now)


@lru_cache(maxsize=1 << 16)
def backward(costs: tuple[int, ...], row: str) -> tuple[int, tuple[int, ...]]:
    """Least costs from each state before the row (and its inserts) to the end, the least of them apart."""
    out = [min(price + costs[to] for _, price, to in arcs(row)[q]) for q in range(4)]
    for _ in range(2):
        out = [min(out[q], INSERT + out[AFTER[q]]) for q in range(4)]
    return _leveled(out)


def tight_walk(rows: str, enter: tuple[int, ...], leave: tuple[int, ...], frontier: set[int], last: bool) -> tuple[list[str], set[int], int]:
    """Letters of each row (inserts before it first), the frontier after the rows, and the least total cost.

    ``enter``: least costs of the states at the beginning, ``leave``: those from the end of the rows on. Where the
    conversation ends here (``last``), the inserts after the last row join its letters; without rows they are one item.
    """
    ahead, base = [enter], [0]
    for row in rows:
        low, costs = forward(ahead[-1], row)
        ahead.append(costs)
        base.append(base[-1] + low)
    behind, rest = [leave], [0]
    for row in reversed(rows):
        low, costs = backward(behind[-1], row)
        behind.append(costs)
        rest.append(rest[-1] + low)
    behind.reverse()
    rest.reverse()
    total = min(a + b for a, b in zip(_inserted(enter), behind[0], strict=True)) + rest[0]
    letters: list[str] = []
    for i in range(len(rows) + last):
        here, reached = "", _inserted(ahead[i])
        steps = arcs(rows[i]) if i < len(rows) else ((),) * 4
        while True:
            best, following = "~", set()
            for q in frontier:
                so_far = reached[q] + base[i]
                for letter, price, to in steps[q]:
                    if letter <= best and so_far + price + behind[i + 1][to] + rest[i + 1] == total:
                        best, following = letter, (following | {to} if letter == best else {to})
                if best >= "I" and so_far + INSERT + behind[i][AFTER[q]] + rest[i] == total:
                    best, following = "I", (following | {AFTER[q]} if best == "I" else {AFTER[q]})
            if best == "~":  # the end: nothing is left to do
                break
            here, frontier = here + best, following
            if best != "I":
                break
        letters.append(here)
    if last and rows:
        end = letters.pop()
        letters[-1] += end
    return letters, frontier, total


def least_costs(rows: str) -> list[int]:
    """Least cost from each state to each state over the rows, by rows of four."""
    out = []
    for q in range(4):
        costs, total = tuple(0 if p == q else NEVER for p in range(4)), 0
        for row in rows:
            low, costs = forward(costs, row)
            total += low
        out += [min(NEVER, c + total) for c in costs]
    return out


class Writer:
    """The repaired rows of one conversation in order, given each row's letters."""

    def __init__(self):
        self.state, self.rows = 0, 0

    def lines(self, letters: str, copies: list[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
        """(role, text, letter) of what stays of the row's copies and of what is inserted before, between or after them."""
        rows = iter(copies)
        for letter in letters:
            role, text = (ROLES[self.state], "") if letter == "I" else next(rows)
            if letter == "D":
                continue
            if letter == "R":
                role = ROLES[self.state]
            self.state = KEPT[role[0]][self.state]
            self.rows += 1
            yield role, text, letter


def fault(text: str, seen: bool) -> str:
    end = text.rstrip(SPACE)
    return "blank" if not end else "duplicate" if seen else "" if end[-1] in ".!?" else "truncated"


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LINES = "place long, kept_role string, kept_text string, edit string"
OPEN = "seg long, blk long, i long, turn long, role string, text string, copies long, if_first string, if_later string"


def _illegal(rows: str) -> int:
    initials = ["sua?"[(ord(r) - 65) // 4] for r in rows]
    return sum(a + b not in GOOD_PAIRS for a, b in zip(initials, initials[1:], strict=False))


def _counts(rows: str) -> list[int]:
    faults = [(ord(r) - 65) % 4 for r in rows]
    return [faults.count(k) for k in (1, 2, 3)]


def _closed(conv: int | None, rows: list[tuple], lines: bool) -> list[dict]:
    """Result of a conversation that lies in one partition; rows: (turn, role, text, copies)."""
    codes, seen, live = [], set(), []
    for turn, role, text, copies in rows:
        own = ""
        for _ in range(copies):
            own += code(role, fault(text, (role, text) in seen))
            seen.add((role, text))
        codes.append(own)
        if copies:
            live.append(turn)
    joined = "".join(codes)
    letters, _, cost = tight_walk(joined, START, END, {0}, True) if joined else ([], set(), 0)
    writer, digest, at, out = Writer(), hashlib.sha256(), 0, []
    for (_, role, text, copies), own in zip(rows, codes, strict=True):
        for line in writer.lines("".join(letters[at : at + len(own)]), [(role, text)] * copies):
            if lines:
                out.append({"conv_id": conv, "place": writer.rows - 1, "kept_role": line[0], "kept_text": line[1], "edit": line[2]})
            digest.update(("\n" if writer.rows > 1 else "").encode() + f"{line[0]}:{line[1]}".encode())
        at += len(own)
    if lines:
        return out
    turns = [t for t in live if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    blank, duplicate, truncated = _counts(joined)
    return [
        {"conv_id": conv, "gaps": gaps, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": _illegal(joined), "cost": cost, "audit": "".join(letters), "repaired_sha256": digest.hexdigest()}
    ]


def _sweep(lines: bool, most_rows: int, block_rows: int):
    """One partition's sorted rows to results of closed conversations and rows of open ones, in one stream."""
    schema = _schema(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, i, blk, in_block, block_bytes = TaskContext.get().partitionId(), -1, -1, 0, 0
        key, first, opened, held, size, out = None, True, True, [], 0, []

        def open_rows(rows):
            nonlocal i, blk, in_block, block_bytes
            for turn, role, text, copies in rows:
                i += 1
                if in_block >= block_rows or block_bytes >= BLOCK_BYTES or blk < 0:
                    blk, in_block, block_bytes = blk + 1, 0, 0
                in_block, block_bytes = in_block + 1, block_bytes + len(text)
                fresh, later = code(role, fault(text, False)), code(role, fault(text, True))
                out.append({"conv_id": key, "seg": seg, "blk": blk, "i": i, "turn": turn, "role": role, "text": text, "copies": copies, "if_first": (fresh + later * (copies - 1)) if copies else "", "if_later": later * copies})

        def flush():
            rows = pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
            return rows

        began = False
        for batch in batches:
            cols = [batch.column(n) for n in ("conv_id", "turn", "role", "text", "copies")]
            for at in range(0, batch.num_rows, 256):
                for conv, *row in zip(*(c.slice(at, 256).to_pylist() for c in cols), strict=True):
                    if not began or conv != key:
                        if began:
                            if opened:
                                open_rows(held)
                            else:
                                out.extend(_closed(key, held, lines))
                            first, held, size = False, [], 0
                        key, opened, began = conv, first, True
                        in_block = block_rows  # no block holds rows of two conversations
                    held.append(tuple(row))
                    size += len(row[2])
                    if opened or len(held) > most_rows or size > MOST_BYTES:
                        opened = True
                        open_rows(held)
                        held, size = [], 0
                if out:
                    yield flush()
        if began:
            open_rows(held)  # the last one may go on in the next partition
        yield flush()

    return run


def _schema(lines: bool) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(f"{'conv_id long, ' + LINES if lines else RESULT}, {OPEN}"))


def _arrow(df: DataFrame, work, schema: str) -> DataFrame:
    """``work(columns)`` on each batch."""
    return map_arrow(df, lambda: work, schema, rows=64)


def _scan(blocks: DataFrame) -> DataFrame:
    """(seg, blk, enter, leave, last) of each block: its conversation's least costs up to it and from its end on. A row is a block's
    16 costs, so a conversation's task holds a few bytes for each of its rows."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.select(["seg", "blk", "costs"]).to_pylist(), key=lambda r: (r["seg"], r["blk"]))
        enter, now = [], list(START)
        for r in rows:
            enter.append(now)
            now = [min(NEVER, min(now[p] + r["costs"][4 * p + q] for p in range(4))) for q in range(4)]
        leave, now = [], list(END)
        for r in reversed(rows):
            leave.append(now)
            now = [min(r["costs"][4 * p + q] + now[q] for q in range(4)) for p in range(4)]
        leave.reverse()
        n = len(rows)
        return pa.table({"seg": [r["seg"] for r in rows], "blk": [r["blk"] for r in rows], "enter": enter, "leave": leave, "last": [k == n - 1 for k in range(n)], "cost": [now[0]] * n}, schema=out)

    schema = "seg long, blk long, enter array<long>, leave array<long>, last boolean, cost long"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))
    return blocks.groupBy("conv_id").applyInArrow(run, schema)


def _chosen(walks: DataFrame) -> DataFrame:
    """(seg, blk, enters): the state each block is entered with, following its conversation's blocks from the start."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.select(["seg", "blk", "exits"]).to_pylist(), key=lambda r: (r["seg"], r["blk"]))
        q, enters = 0, []
        for r in rows:
            enters.append(q)
            q = r["exits"][q]
        return pa.table({"seg": [r["seg"] for r in rows], "blk": [r["blk"] for r in rows], "enters": enters}, schema=out)

    out = pa.schema([("seg", pa.int64()), ("blk", pa.int64()), ("enters", pa.int32())])
    return walks.groupBy("conv_id").applyInArrow(run, "seg long, blk long, enters int")


def _open_letters(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Letters and places of the rows of open conversations, block by block, and the blocks' counts."""
    live = rows.where("copies > 0")
    first = live.groupBy("conv_id", "role", F.sha2("text", 256).alias("digest")).agg(F.min(F.struct("seg", "i")).alias("p")).select("p.seg", "p.i", F.lit(True).alias("first"))
    marked = rows.select("conv_id", "seg", "blk", "i", "if_first", "if_later").join(first, ["seg", "i"], "left")
    coded = marked.select("conv_id", "seg", "blk", "i", F.when(F.col("first"), F.col("if_first")).otherwise(F.col("if_later")).alias("code"))
    # at most BLOCK_ROWS rows a block
    packed = coded.groupBy("conv_id", "seg", "blk").agg(F.array_sort(F.collect_list(F.struct("i", "code"))).alias("rows"))
    packed = packed.select("conv_id", "seg", "blk", F.transform("rows", lambda r: r["i"]).alias("places"), F.transform("rows", lambda r: r["code"]).alias("codes"))

    def measure(cols: dict) -> dict:
        joined = ["".join(c) for c in cols["codes"]]
        counts = [_counts(j) for j in joined]
        return {
            **{k: cols[k] for k in ("conv_id", "seg", "blk", "places", "codes")},
            "costs": [least_costs(j) for j in joined],
            **{k: [c[n] for c in counts] for n, k in enumerate(("blank", "duplicate", "truncated"))},
            "illegal": [_illegal(j) for j in joined],
            "first_row": [j[:1] for j in joined],
            "last_row": [j[-1:] for j in joined],
        }

    schema = "conv_id long, seg long, blk long, places array<long>, codes array<string>, costs array<long>, blank long, duplicate long, truncated long, illegal long, first_row string, last_row string"
    blocks = written(_arrow(packed, measure, schema), "dialogue-blocks")

    def walk(cols: dict) -> dict:
        exits, letters = [], []
        for codes, enter, leave, last in zip(cols["codes"], cols["enter"], cols["leave"], cols["last"], strict=True):
            joined, ways, ends = "".join(codes), [], []
            enter, leave = tuple(enter), tuple(leave)
            rest = _from(joined, leave)
            total = min(a + b for a, b in zip(_inserted(enter), rest, strict=True))
            for q in range(4):
                if enter[q] + rest[q] != total:  # no cheapest path enters here
                    ways.append(None)
                    ends.append(q)
                    continue
                found, frontier, _ = tight_walk(joined, enter, leave, {q}, last)
                pieces, at = [], 0
                for own in codes:
                    pieces.append("".join(found[at : at + len(own)]))
                    at += len(own)
                pieces[-1] += "".join(found[at:])  # inserts after rows that were all dropped
                ways.append(pieces)
                ends.append(min(frontier))
            exits.append(ends)
            letters.append(ways)
        return {**{k: cols[k] for k in ("conv_id", "seg", "blk", "places", "cost")}, "exits": exits, "ways": letters}

    scanned = _scan(blocks.select("conv_id", "seg", "blk", "costs"))
    walks = _arrow(blocks.select("conv_id", "seg", "blk", "places", "codes").join(scanned, ["seg", "blk"]), walk, "conv_id long, seg long, blk long, places array<long>, cost long, exits array<int>, ways array<array<string>>")
    walks = written(walks, "dialogue-walks")
    took = walks.join(_chosen(walks.select("conv_id", "seg", "blk", "exits")), ["seg", "blk"]).select("conv_id", "seg", "blk", "cost", "places", F.get("ways", F.col("enters")).alias("letters"))
    return took, blocks


def _from(rows: str, leave: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs from each state before the rows to the end."""
    total, costs = 0, leave
    for row in reversed(rows):
        low, costs = backward(costs, row)
        total += low
    return tuple(c + total for c in costs)


def _stream(lines: bool):
    """Sorted rows of open conversations with their letters to hashes or lines; holds one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, writer, digest, began, out = None, Writer(), hashlib.sha256(), False, []
        names = ["conv_id", *(["place", "kept_role", "kept_text", "edit"] if lines else ["repaired_sha256"])]
        schema = pa.schema([(n, pa.int64() if n in ("conv_id", "place") else pa.string()) for n in names])

        def flush():
            rows = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(names), schema, strict=True)], schema=schema)
            out.clear()
            return rows

        for batch in batches:
            cols = [batch.column(n) for n in ("conv_id", "role", "text", "copies", "letters")]
            for at in range(0, batch.num_rows, 256):
                for conv, role, text, copies, letters in zip(*(c.slice(at, 256).to_pylist() for c in cols), strict=True):
                    if not began or conv != key:
                        if began and not lines:
                            out.append((key, digest.hexdigest()))
                        key, writer, digest, began = conv, Writer(), hashlib.sha256(), True
                    for line in writer.lines(letters or "", [(role, text)] * copies):
                        if lines:
                            out.append((conv, writer.rows - 1, *line))
                        else:
                            digest.update(("\n" if writer.rows > 1 else "").encode() + f"{line[0]}:{line[1]}".encode())
                if out:
                    yield flush()
        if began and not lines:
            out.append((key, digest.hexdigest()))
        yield flush()

    return run


def _swept(rows: DataFrame, lines: bool, most_rows: int, block_rows: int) -> DataFrame:
    start = F.substring("text", 1, 32)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), start, F.xxhash64("text"), F.col("_n")]
    # the running number lets even equal rows fall into several partitions
    dealt = rows.withColumn("_n", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"{'conv_id long, ' + LINES if lines else RESULT}, {OPEN}"
    return written(dealt.select("conv_id", "turn", "role", "text", "copies").mapInArrow(_sweep(lines, most_rows, block_rows), schema), "dialogues")


def _tidy(conversations: DataFrame) -> DataFrame:
    copies = F.col("copies").cast("int") if "copies" in conversations.columns else F.lit(1)
    text = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return conversations.select("conv_id", "turn", text("role"), text("text"), copies.alias("copies"))


def audit(conversations: DataFrame, most_rows: int = MOST_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row a conversation: its faults, the cost and letters of its cheapest edits and the hash of its repaired lines.

    Rows: conv_id, turn, role, text and, where there is such a column, copies (how often the row stands there; 0: it only
    names its conversation). Null roles and texts are one space; null turns come first; rows of one turn are ordered by
    role, the first 32 characters of their text and its hash. A null conv_id is a conversation like any other. An empty
    table gives no rows; other columns are ignored. A role that begins with none of s, u, a, or is empty, can't be kept.
    """
    swept = _swept(_tidy(conversations), False, most_rows, block_rows)
    closed = swept.where("seg IS NULL").select(*(c.split()[0] for c in RESULT.split(", ")))
    rows = swept.where("seg IS NOT NULL")
    took, blocks = _open_letters(rows)
    step = F.struct("seg", "blk", F.array_join("letters", "").alias("l"), "cost")
    letters = took.groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    # blocks whose rows were all dropped have no first row and don't part their neighbours
    ends = blocks.where("first_row <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg", "blk", "first_row", "last_row"))).alias("e"))
    seams = F.aggregate(
        F.when(F.size("e") > 1, F.sequence(F.lit(1), F.size("e") - 1)).otherwise(F.array().cast("array<int>")),
        F.lit(0).cast("long"),
        lambda n, k: n + F.when(_good(F.col("e")[k - 1]["last_row"], F.col("e")[k]["first_row"]), 0).otherwise(1),
    )
    turns = rows.where("copies > 0").groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
    sums = blocks.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    # whole texts, in order, past one hash a conversation
    pieces = took.select("seg", F.explode(F.arrays_zip(F.col("places").alias("i"), F.col("letters").alias("letters"))).alias("p")).select("seg", "p.i", "p.letters")
    lined = rows.join(pieces, ["seg", "i"]).select("conv_id", "seg", "i", "role", "text", "copies", "letters")
    hashes = lined.repartition("conv_id").sortWithinPartitions("conv_id", "seg", "i").drop("seg", "i").mapInArrow(_stream(False), "conv_id long, repaired_sha256 string")
    found = sums
    for more in (letters.select("conv_id", F.col("steps")[0]["cost"].alias("cost"), F.array_join(F.transform("steps", lambda s: s["l"]), "").alias("audit")), ends.select("conv_id", seams.alias("seams")), turns, hashes):
        more = more.withColumnRenamed("conv_id", "_c")
        found = found.join(more, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    found = found.select(
        "conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + F.coalesce("seams", F.lit(0))).alias("illegal"), "cost", "audit", "repaired_sha256",
    )
    return closed.unionByName(found)


def _good(before: Column, after: Column) -> Column:
    """Whether the initials of two rows' characters may follow each other."""
    initial = lambda c: F.substring(F.lit("sua?"), F.floor((F.ascii(c) - 65) / 4).cast("int") + 1, F.lit(1))
    return F.concat(initial(before), initial(after)).isin(*GOOD_PAIRS)


def repaired(conversations: DataFrame, most_rows: int = MOST_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The repaired rows: conv_id, place (from 0), role, text and edit (K, R or I). Rows and odd cases as in ``audit``."""
    swept = _swept(_tidy(conversations), True, most_rows, block_rows)
    names = ["conv_id", "place", "kept_role", "kept_text", "edit"]
    rows = swept.where("seg IS NOT NULL")
    took, _ = _open_letters(rows)
    pieces = took.select("seg", F.explode(F.arrays_zip(F.col("places").alias("i"), F.col("letters").alias("letters"))).alias("p")).select("seg", "p.i", "p.letters")
    lined = rows.join(pieces, ["seg", "i"]).select("conv_id", "seg", "i", "role", "text", "copies", "letters")
    lines = lined.repartition("conv_id").sortWithinPartitions("conv_id", "seg", "i").drop("seg", "i").mapInArrow(_stream(True), f"conv_id long, {LINES}")
    return swept.where("seg IS NULL").select(*names).unionByName(lines).withColumnsRenamed({"kept_role": "role", "kept_text": "text"})


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults planted by crc32 of ``conv_id:turn`` modulo 20: dropped, emptied, cut off, repeated, or given to the user.

    Nulls become one space, in that key too (turn itself stays null). Dropped and repeated rows have 0 and 2 copies.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def op11_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(damage(table(spark, sf_dir, "conversations")))
