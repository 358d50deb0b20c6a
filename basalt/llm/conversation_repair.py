"""Cheapest repair of broken conversations, by a scan of min-plus matrices.

A repaired conversation has roles whose initials read `(s?(ua)+)?`: at most one opening system turn, then pairs of
user and assistant, or nothing at all. The automaton of that grammar has four states (nothing yet, after s, after u,
after a). What may be done with a turn (keep, rerole, delete; any number of turns inserted in front of it) is a 4x4 matrix: from
state i to state j its cheapest cost with the edits' letters. Matrices are multiplied with (+, concatenation) and added with the
minimum of (cost, letters). That is associative, and it distributes: of two ways with equal cost neither's letters can begin with all of the other's, as
the longer would hold more paid insertions. So a conversation's turns may be multiplied in any grouping, as a tree.

Rows are dealt by ranges of (conversation, turn), so that a long conversation lies in many partitions. A conversation that lies within one partition
and is short is repaired there and then. Of all others (two a partition, and long ones) each chunk becomes one matrix;
chunks are multiplied level by level in Spark, and the edits go back to the chunks, which stay where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import scratch_table

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: What a truncated turn adds unless it is deleted.
CUT_COST = 1
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. Where an initial leads from each, and where a conversation may end.
STEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
ENDS = (0, 3)
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\v\f\r"
#: Children of a node of the tree.
FAN = 64

Element = tuple[int, str] | None
Matrix = list[list[Element]]


def least(a: Element, b: Element) -> Element:
    return b if a is None else a if b is None else min(a, b)


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for row in a:
        reached = [(k, x) for k, x in enumerate(row) if x is not None]
        line: list[Element] = []
        for j in range(4):
            ways = [(x[0] + y[0], x[1] + y[1]) for k, x in reached if (y := b[k][j]) is not None]
            line.append(min(ways) if ways else None)
        out.append(line)
    return out


def identity() -> Matrix:
    return [[(0, "") if i == j else None for j in range(4)] for i in range(4)]


def closure() -> Matrix:
    """Any number of inserted turns; more than three lead nowhere that fewer don't lead."""
    one: Matrix = [[None] * 4 for _ in range(4)]
    for role in "ua":
        for i, j in enumerate(STEP[role]):
            if j is not None:
                one[i][j] = least(one[i][j], (COST[INSERT], INSERT))
    total, power = identity(), identity()
    for _ in range(3):
        power = product(power, one)
        total = [[least(x, y) for x, y in zip(p, q, strict=True)] for p, q in zip(total, power, strict=True)]
    return total


CLOSURE = closure()
_MATRICES: dict[tuple[str, str], Matrix] = {}


def matrix_of(initial: str, fault: str) -> Matrix:
    """Insertions and one turn. fault: b (blank), d (duplicate), t (truncated) or -."""
    if (initial, fault) not in _MATRICES:
        turn: Matrix = [[(COST[DELETE], DELETE) if i == j else None for j in range(4)] for i in range(4)]
        if fault not in "bd":
            more = CUT_COST if fault == "t" else 0
            for letter, role in ((KEEP, initial), (REROLE, "u"), (REROLE, "a")):
                for i, j in enumerate(STEP.get(role, ())):
                    if j is not None:
                        turn[i][j] = least(turn[i][j], (COST[letter] + more, letter))
        _MATRICES[initial, fault] = product(CLOSURE, turn)
    return _MATRICES[initial, fault]


def tree_product(matrices: list[Matrix]) -> Matrix:
    while len(matrices) > 1:
        matrices = [product(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0] if matrices else identity()


def best_end(whole: Matrix) -> tuple[int, str]:
    """The cheapest way through a conversation, insertions after its last turn included."""
    closed = product(whole[:1], CLOSURE)[0]
    return min(x for j in ENDS if (x := closed[j]) is not None)


def fault_of(text: str, seen: bool) -> str:
    """The first fault of a turn."""
    stripped = text.rstrip(SPACE)
    return "b" if not stripped else "d" if seen else "-" if stripped[-1] in ".!?" else "t"


def faults_of(roles: list[str], texts: list[str], elsewhere: set[int] = frozenset()) -> tuple[str, list[int]]:
    """The turns' first faults, and which turns are the first here with their role and text. elsewhere: turns whose role and text were seen before the first of these."""
    seen, faults, new = set(), [], []
    for k, turn in enumerate(zip(roles, texts, strict=True)):
        known = turn in seen
        seen.add(turn)
        if not known:
            new.append(k)
        faults.append(fault_of(turn[1], known or k in elsewhere))
    return "".join(faults), new


class Node(NamedTuple):
    """What is known of a run of a conversation's turns."""

    matrix: list[Element]
    first: str | None  # initials of the first and last turn
    last: str | None
    illegal: int
    blank: int
    duplicate: int
    truncated: int
    low: int | None  # turn numbers: smallest, largest, how many
    high: int | None
    numbers: int
    chunks: list[dict]  # place and number of rows of each chunk, in order


_ELEMENT = pa.struct([("cost", pa.int64()), ("audit", pa.string())])
_CHUNK = pa.struct([("pid", pa.int32()), ("k", pa.int64()), ("n", pa.int64())])
_NODE = pa.struct(
    [("matrix", pa.list_(_ELEMENT)), ("first", pa.string()), ("last", pa.string()), *((c, pa.int64()) for c in ("illegal", "blank", "duplicate", "truncated", "low", "high", "numbers")), ("chunks", pa.list_(_CHUNK))]
)
_NODE_DDL = (
    "struct<matrix:array<struct<cost:bigint,audit:string>>,first:string,last:string,illegal:bigint,blank:bigint,duplicate:bigint,truncated:bigint,"
    "low:bigint,high:bigint,numbers:bigint,chunks:array<struct<pid:int,k:bigint,n:bigint>>>"
)


def node_of(roles: list[str], faults: str, turns: list[int | None], pid: int = 0, k: int = 0) -> Node:
    initials = [r[:1] for r in roles]
    known = [t for t in turns if t is not None]
    matrix = tree_product([matrix_of(r, f) for r, f in zip(initials, faults, strict=True)])
    return Node(
        [x for line in matrix for x in line], initials[0], initials[-1], sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        faults.count("b"), faults.count("d"), faults.count("t"), min(known, default=None), max(known, default=None), len(set(known)), [{"pid": pid, "k": k, "n": len(roles)}],
    )


def joined(nodes: list[Node]) -> Node:
    """The node of adjacent runs, whose turns are in order."""
    matrix = tree_product([[n.matrix[i : i + 4] for i in range(0, 16, 4)] for n in nodes])
    total = lambda field: sum(getattr(n, field) for n in nodes)
    known = [n for n in nodes if n.low is not None]
    same = sum(a.high == b.low for a, b in zip(known, known[1:], strict=False))
    border = sum((a.last or "") + (b.first or "") not in LEGAL for a, b in zip(nodes, nodes[1:], strict=False))
    return Node(
        [x for line in matrix for x in line], nodes[0].first, nodes[-1].last, total("illegal") + border, total("blank"), total("duplicate"), total("truncated"),
        known[0].low if known else None, known[-1].high if known else None, total("numbers") - same, [c for n in nodes for c in n.chunks],
    )


def totals(n: Node) -> dict[str, Any]:
    cost, audit = best_end([n.matrix[i : i + 4] for i in range(0, 16, 4)])
    gaps = 0 if n.low is None else n.high - n.low + 1 - n.numbers
    return {"gaps": gaps, "blank": n.blank, "duplicate": n.duplicate, "truncated": n.truncated, "illegal": n.illegal, "cost": cost, "audit": audit}


def repaired(roles: list[str], texts: list[str], audit: str, expected: str = "u") -> list[tuple[str, str, str]]:
    """(role, text, edit) of the turns that stay or are new. expected: the initial that a rerole or an insertion takes next."""
    out, k = [], 0
    for edit in audit:
        if edit == INSERT:
            out.append((ROLES[expected], "", edit))
        else:
            role, text = roles[k], texts[k]
            k += 1
            if edit == DELETE:
                continue
            out.append((role if edit == KEEP else ROLES[expected], text, edit))
        expected = "a" if out[-1][0][:1] == "u" else "u"
    return out


def slices(audit: str, sizes: list[int]) -> list[tuple[str, str]]:
    """(letters, initial expected first) for chunks of so many turns. Insertions go with the turn behind them, those at the end with the last chunk."""
    cuts, at = [], 0
    for n in sizes:
        for _ in range(n):
            while audit[at] == INSERT:
                at += 1
            at += 1
        cuts.append(at)
    cuts[-1] = len(audit)
    starts = [0, *cuts[:-1]]
    kept = [sum(c != DELETE for c in audit[lo:hi]) for lo, hi in zip(starts, cuts, strict=True)]
    # All turns but an opening system turn are pairs: an odd number ahead begins with the assistant.
    out, behind, before = [], sum(kept), 0
    for lo, hi, n in zip(starts, cuts, kept, strict=True):
        out.append((audit[lo:hi], "a" if before and behind % 2 else "u"))
        behind, before = behind - n, before + n
    return out


class Repaired(NamedTuple):
    conversations: DataFrame
    pieces: DataFrame


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_SORTED = "pid int, k bigint, closed boolean, roles array<string>, texts array<string>, turns array<bigint>, edits array<string>, audit string, " + ", ".join(f"{c} bigint" for c in _COUNTS)


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk_rows: int = 512, chunk_chars: int = 1 << 20) -> Repaired:
    """conversations: one row for each conversation (the id under its name, gaps, blank, duplicate, truncated, illegal, cost, audit). pieces: the repaired turns in order, (id, pid, k, whole, roles, texts, edits):
    whole if the piece is all of its conversation, else pieces are ordered by (pid, k); `turns` makes a row of each turn.

    Turns are in the order of turn, nulls first, ties in the order of the input, which must be read in the same order each time, as from files. Null roles and texts are one space; null ids are a
    conversation of their own; rows that repeat all values are duplicates. A role is known by its first character; one with none, or with another than s, u or a, can't be kept. Turn numbers that aren't whole are cut.
    An empty table gives empty results. Other columns aren't read, whatever their names.

    A chunk has chunk_rows turns at most, and one more than chunk_chars characters of text at most where no single turn has more.
    """
    kind = df.schema[conv_col].dataType
    place = F.monotonically_increasing_id()
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"), place.alias("place"))
    order = ["conv", "turn", "place"]  # ascending: nulls first
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, schema = TaskContext.get().partitionId(), None
        out: list[dict] = []
        conv: list | None = None  # the present id, in a list as it may be null
        chunk: list[tuple] = []
        chars, k, whole = 0, 0, False  # k counts all chunks of the partition, so that (pid, k) is one chunk

        def close(last: bool) -> None:
            """Put out what is held of the present conversation, which ends here unless it goes on in the next partition."""
            turns, roles, texts = (list(x) for x in zip(*chunk, strict=True))
            row = {"conv": conv[0], "pid": pid, "k": k, "closed": whole and not last}
            if row["closed"]:
                faults, _ = faults_of(roles, texts)
                row |= totals(node_of(roles, faults, turns))
                lines = repaired(roles, texts, row["audit"])
                row |= {"roles": [x[0] for x in lines], "texts": [x[1] for x in lines], "edits": [x[2] for x in lines]}
            else:
                row |= {"roles": roles, "texts": texts, "turns": turns}
            out.append(row)

        for batch in batches:
            if schema is None:
                schema = pa.schema([("conv", batch.schema.field(0).type), ("pid", pa.int32()), ("k", pa.int64()), ("closed", pa.bool_()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("turns", pa.list_(pa.int64())), ("edits", pa.list_(pa.string())), ("audit", pa.string()), *((c, pa.int64()) for c in _COUNTS)])
            for lo in range(0, len(batch), 1024):
                for own, turn, role, text in zip(*(c.to_pylist() for c in batch.slice(lo, 1024).columns), strict=True):
                    if conv is None or own != conv[0]:
                        if chunk:
                            close(last=False)
                        # The first conversation of a partition may have begun in the one before.
                        whole, conv, chunk, chars, k = conv is not None, [own], [], 0, k + 1
                    elif len(chunk) >= chunk_rows or chars + len(text) > chunk_chars and chunk:
                        whole = False
                        close(last=True)
                        chunk, chars, k = [], 0, k + 1
                    chunk.append((turn, role, text))
                    chars += len(text)
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if chunk:
            close(last=True)
            yield pa.RecordBatch.from_pylist(out, schema)

    ddl = f"conv {kind.simpleString()}"
    table = scratch_table(dealt.mapInArrow(scan, f"{ddl}, {_SORTED}"), "repair", partition_by=["closed"])
    closed, open_ = table.filter("closed"), table.filter("NOT closed").select("conv", "pid", "k", "roles", "texts", "turns")

    nodes = scratch_table(_open_nodes(open_, ddl), "repair-nodes")
    roots = scratch_table(_roots(nodes, ddl), "repair-roots")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for audit, chunks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = slices(audit, [c["n"] for c in chunks])
                yield pa.RecordBatch.from_pylist([{"pid": c["pid"], "k": c["k"], "conv_pieces": len(chunks), "letters": a, "expected": e} for c, (a, e) in zip(chunks, parts, strict=True)], pa.schema([("pid", pa.int32()), ("k", pa.int64()), ("conv_pieces", pa.int64()), ("letters", pa.string()), ("expected", pa.string())]))

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(len(batch)):
                row = batch.slice(lo, 1)
                roles, texts, letters, expected = (row.column(c).to_pylist()[0] for c in range(4, 8))
                lines = repaired(roles, texts, letters, expected)
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), row.column(2), row.column(3), *(pa.array([[x[f] for x in lines]], pa.list_(pa.string())) for f in range(3))], names=["conv", "pid", "k", "whole", "roles", "texts", "edits"])

    # A long conversation's letters come apart before the join: one row meets each chunk.
    cuts = roots.select("audit", "chunks").mapInArrow(cut, "pid int, k bigint, conv_pieces bigint, letters string, expected string")
    mended = open_.join(cuts, ["pid", "k"]).select("conv", "pid", "k", (F.col("conv_pieces") == 1).alias("whole"), "roles", "texts", "letters", "expected")
    mended = scratch_table(mended.mapInArrow(mend, f"{ddl}, pid int, k bigint, whole boolean, roles array<string>, texts array<string>, edits array<string>"), "repair-mended")

    columns = [F.col("conv").alias(conv_col), *_COUNTS, "audit"]
    conversations = closed.select(*columns).unionByName(roots.select(*columns))
    pieces = closed.select("conv", "pid", "k", F.lit(True).alias("whole"), "roles", "texts", "edits").unionByName(mended)
    return Repaired(conversations, pieces.withColumnRenamed("conv", conv_col))


def _open_nodes(chunks: DataFrame, ddl: str) -> DataFrame:
    """(conv, pid, k, node) of each chunk. A turn is a duplicate if its role and text are in an earlier chunk of its conversation: the first chunk of each, by a 128-bit hash, comes from an aggregate, and only what chunks hold different is joined with it."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, pid, k, roles, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                faults, new = faults_of(roles, texts)
                new = [i for i in new if faults[i] != "b"]
                digests = [xxhash.xxh3_128_digest(f"{conv!r}\0{len(roles[i])}\0{roles[i]}{texts[i]}".encode()) for i in new]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([pid] * len(new), pa.int32()), pa.array([k] * len(new), pa.int64()), pa.array(new, pa.int32())], names=["key", "pid", "k", "i"])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for pid, k, roles, texts, turns, elsewhere in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                faults, _ = faults_of(roles, texts, set(elsewhere or ()))
                found.append(_plain(node_of(roles, faults, turns, pid, k)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found, _NODE)], names=["conv", "pid", "k", "node"])

    held = scratch_table(chunks.select("conv", "pid", "k", "roles", "texts").mapInArrow(keys, "key binary, pid int, k bigint, i int"), "repair-keys")
    first = held.groupBy("key").agg(F.min(F.struct("pid", "k")).alias("first"), F.count(F.lit(1)).alias("chunks")).filter("chunks > 1").select("key", "first")
    seen = held.join(first, "key").filter("struct(pid, k) > first").groupBy("pid", "k").agg(F.collect_list("i").alias("elsewhere"))
    return chunks.join(seen, ["pid", "k"], "left").select("conv", "pid", "k", "roles", "texts", "turns", "elsewhere").mapInArrow(nodes, f"{ddl}, pid int, k bigint, node {_NODE_DDL}")


def _plain(node: Node) -> dict:
    return node._asdict() | {"matrix": [None if x is None else {"cost": x[0], "audit": x[1]} for x in node.matrix]}


def _node(x: dict) -> Node:
    return Node(**x | {"matrix": [None if y is None else (y["cost"], y["audit"]) for y in x["matrix"]]})


def _roots(nodes: DataFrame, ddl: str) -> DataFrame:
    """(conv, totals, audit, chunks) of each conversation: at each level up to FAN neighbours become one node, first within partitions, then across them."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(len(batch)):
                row = batch.slice(lo, 1)
                both = joined([_node(x["node"]) for x in row.column(3).to_pylist()[0]])
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), row.column(2), pa.array([_plain(both)], _NODE)], names=["conv", "pid", "k", "node"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n := _node(x)) and totals(n) | {"chunks": n.chunks} for x in batch.column(1).to_pylist()]
            arrays = [pa.array([r[c] for r in rows], pa.int64()) for c in _COUNTS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, pa.array([r["audit"] for r in rows], pa.string()), pa.array([r["chunks"] for r in rows], pa.list_(_CHUNK))], names=["conv", *_COUNTS, "audit", "chunks"])

    most = nodes.agg(F.max("k"), F.max("pid")).first()
    level = nodes
    for column, top in (("k", most[0] or 0), ("pid", most[1] or 0)):
        while True:
            # One round at least within partitions and one across, so that each conversation is one row in the end.
            level = level.withColumn("at", F.col(column)).withColumn(column, F.floor(F.col(column) / FAN).cast(nodes.schema[column].dataType))
            level = level.groupBy("conv", "pid", "k").agg(F.sort_array(F.collect_list(F.struct("at", "node"))).alias("children")).select("conv", "pid", "k", "children").mapInArrow(combine, f"{ddl}, pid int, k bigint, node {_NODE_DDL}")
            top //= FAN
            if not top:
                break
    return level.select("conv", "node").mapInArrow(finish, f"{ddl}, {', '.join(f'{c} bigint' for c in _COUNTS)}, audit string, chunks array<struct<pid:int,k:bigint,n:bigint>>")


def turns(pieces: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """A row for each turn of the repaired conversations: id, pid, k, i (the order), role, text, edit (K, R or I)."""
    zipped = F.posexplode(F.arrays_zip("roles", "texts", "edits"))
    return pieces.select(conv_col, "pid", "k", zipped.alias("i", "t")).select(conv_col, "pid", "k", "i", F.col("t.roles").alias("role"), F.col("t.texts").alias("text"), F.col("t.edits").alias("edit"))


def digests(pieces: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(id, repaired_sha256): SHA-256 of the repaired `role:text` joined by newlines. Whole conversations are hashed where they are. Pieces of others are sorted by conversation and read in order by a running hash, a piece in memory at a time; one conversation's
    bytes go through one task, as the digest of a stream needs."""
    lines = pieces.select(conv_col, "pid", "k", "whole", F.size("roles").alias("n"), F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n").alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, begun, out, kind = None, None, False, [], None
        for batch in batches:
            kind = batch.schema.field(0).type
            for own, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv is None or own != conv[0]:
                    if conv is not None:
                        out.append((conv[0], state.hexdigest()))
                    conv, state, begun = [own], hashlib.sha256(), False
                if n:
                    state.update(("\n" * begun + text).encode())
                    begun = True
        if conv is not None:
            out.append((conv[0], state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out])], names=[conv_col, "repaired_sha256"])

    whole = lines.filter("whole").select(conv_col, F.sha2("lines", 256).alias("repaired_sha256"))
    parts = lines.filter("NOT whole").repartition(conv_col).sortWithinPartitions(conv_col, "pid", "k").select(conv_col, "n", "lines")
    return whole.unionByName(parts.mapInArrow(run, f"`{conv_col}` {pieces.schema[conv_col].dataType.simpleString()}, repaired_sha256 string"))


def damaged(df: DataFrame) -> DataFrame:
    """conversations with the faults that a test of `repair` needs, by crc32(`conv_id:turn`) modulo 20: 0 drops a row, 1 empties its text, 2 removes its `[.!?]`, 3 repeats it, 4 makes its role user. Nulls count as one space, but ids and turns stay null."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    role = F.when(fault == 4, "user").otherwise(spaced("role"))
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    times = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    rows = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).drop("copy")
