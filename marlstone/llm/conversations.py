"""Conversation structure repair by the auction algorithm for shortest paths.

A conversation is a lattice: a node for each place between its rows and each state of the grammar ``(s?(ua)+)?`` of role
initials, an arc for each edit with its whole-number cost. An auction finds the cheapest edits: a path grows from the start;
at its end node the cheapest arc counts, price of the next node included; a node whose price is below that has its price
raised and the path contracts by it, else the path extends along the arc. At the end the prices are a dual solution, under
which the arcs of all cheapest paths, and of no others, are tight from the start to the exit; of these the path whose edits
are ASCII-least is traced.

Rows are cut into blocks, solved from the last to the first: the prices at a block's first place are what its predecessor
pays to leave. So time is in proportion to the rows. Conversations of up to ``LONG`` rows are a task's work each. Longer ones
are sorted over tasks and cut into pieces; a piece sends on what each way through it costs, 4 x 4 numbers, and later how each
way ends, 4 numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import shuffle_partitions, staged

#: Rows, and bytes of text, up to which a conversation is one piece.
LONG, LONG_BYTES = 16_384, 64_000_000
#: Rows of a block of an auction.
BLOCK = 64
SPACES = " \t\n\x0b\x0c\r"
ROLES = {1: "user", 2: "assistant"}
#: States by what was last: nothing, system, user, assistant; only nothing and assistant may be last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (NOTHING, ASSISTANT)
#: The state after a user or assistant, the one that is due.
DUE = (USER, USER, ASSISTANT, USER)
#: The state after a kept row, by state and initial (system, user, assistant, other); -1 where it can't be kept.
KEPT = ((SYSTEM, USER, -1, -1), (-1, USER, -1, -1), (-1, -1, ASSISTANT, -1), (-1, USER, -1, -1))
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: The code of a conversation's end; rows' codes are their initial plus 4 times their fault: none, truncated, to be deleted.
END = 12
#: Above the difference of the costs from any two states of one place to the end (at most 17: two inserts, a deletion and a truncated row).
CAP = 32
SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _arcs(code: int, state: int) -> list[tuple[int, str, int, int]]:
    """(cost, edit, rows passed, next state) from a place before a row of this code, in the order of the edits' letters."""
    insert = (INSERT, "I", 0, DUE[state])
    if code == END:
        return [(0, "", 1, state), insert] if state in FINAL else [insert]
    initial, fault = code % 4, code // 4
    out = [(DELETE, "D", 1, state), insert]
    if fault < 2:
        after = KEPT[state][initial]
        if after >= 0:
            out.append((TRUNCATED * fault, "K", 1, after))
        out.append((REROLE + TRUNCATED * fault, "R", 1, DUE[state]))
    return out


ARCS = [[_arcs(code, state) for state in range(4)] for code in range(END + 1)]
LEAST = [min(min(a[0] for a in arcs if a[2]) if any(a[2] for a in arcs) else 0 for arcs in of) for of in ARCS]


def auction(codes, exits, starts) -> list[int]:
    """Prices of all nodes of a block, node 4 * place + state: at its first place the exact costs from the states ``starts``.

    Prices begin at the least that the rows ahead can cost, and only rise."""
    m = len(codes)
    price = [min(exits)] * (4 * m + 4)
    for i in range(m - 1, -1, -1):
        price[4 * i : 4 * i + 4] = [price[4 * i + 4] + LEAST[codes[i]]] * 4
    for start in starts:
        path = [start]
        while True:
            node = path[-1]
            i, state = divmod(node, 4)
            if i == m:
                best, to = exits[state], -1
            else:
                best, to = 1 << 60, -1
                for cost, _, step, after in ARCS[codes[i]][state]:
                    ahead = cost + price[4 * (i + step) + after]
                    if ahead < best:
                        best, to = ahead, 4 * (i + step) + after
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            elif to < 0:
                break
            else:
                path.append(to)
    return price


def _leading(codes, price, exits) -> list[bool]:
    """Whether tight arcs lead from a node to the exit."""
    m = len(codes)
    out = [False] * (4 * m) + [price[4 * m + s] == exits[s] for s in range(4)]
    for i in range(m - 1, -1, -1):
        for state in (ASSISTANT, USER, SYSTEM, NOTHING, ASSISTANT):  # inserted rows lead from a state to one before it here
            here = 4 * i + state
            out[here] = any(price[here] == cost + price[to] and out[to] for cost, _, step, after in ARCS[codes[i]][state] for to in [4 * (i + step) + after])
    return out


class Lattice:
    """A run of rows, solved block by block from its last row, given what each state pays after it."""

    def __init__(self, codes, exits, starts=range(4)):
        self.blocks = []
        for at in range((len(codes) - 1) // BLOCK * BLOCK, -1, -BLOCK):
            part = codes[at : at + BLOCK]
            price = auction(part, exits, range(4) if at else starts)
            self.blocks.append((part, price, exits))
            exits = price[:4]
        self.blocks.reverse()
        self.costs = exits

    def trace(self, state: int) -> tuple[list[str], int]:
        """The edits up to and of each row, the ASCII-least of the cheapest, and the state after them."""
        edits = []
        for codes, price, exits in self.blocks:
            leads = _leading(codes, price, exits)
            i, before = 0, ""
            while i < len(codes):
                here = 4 * i + state
                cost, edit, step, state = next(a for a in ARCS[codes[i]][state] for to in [4 * (i + a[2]) + a[3]] if price[here] == a[0] + price[to] and leads[to])
                before += edit
                if step:
                    edits.append(before)
                    before = ""
                i += step
        return edits, state


def repaired_rows(edits: list[str], rows: list[tuple[str, str]], state: int):
    """role:text of each row that the edits leave, from a state."""
    for k, edit in enumerate(edits):
        for e in edit:
            if e == "K":
                role, text = rows[k]
                state = KEPT[state]["sua".find(role[:1]) if role[:1] else 3]
                yield f"{role}:{text}"
            elif e != "D":
                state = DUE[state]
                yield f"{ROLES[1 if state == USER else 2]}:{rows[k][1] if e == 'R' else ''}"


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, dropped): the rows after damage by crc32 of ``conv_id:turn``; a dropped row stays as a
    marker without role and text, so that its conversation is known."""
    space = F.lit(" ")
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, space).alias("role"), F.coalesce(text, space).alias("text"))
    mark = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    rows = rows.withColumn("mark", mark).withColumn("copy", F.explode(F.when(F.col("mark") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    dropped = F.col("mark") == 0
    text_after = F.when(dropped | (F.col("mark") == 1), F.lit("")).when(F.col("mark") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role_after = F.when(dropped, F.lit("")).when(F.col("mark") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role_after.alias("role"), text_after.alias("text"), dropped.alias("dropped"))


def _kind(initial: str) -> int:
    return {"s": 0, "u": 1, "a": 2}.get(initial, 3)


LEGAL = {(0, 1), (1, 2), (2, 1)}


def _summary(turns: list, kinds: list[int], faults: list[int]) -> dict:
    known = [t for t in turns if t is not None]
    return {
        "low": min(known, default=None), "high": max(known, default=None), "turns": len(set(known)), "blank": faults.count(2), "duplicate": faults.count(3), "truncated": faults.count(1),
        "illegal": sum((a, b) not in LEGAL for a, b in zip(kinds[:-1], kinds[1:])), "first": kinds[0] if kinds else -1, "last": kinds[-1] if kinds else -1,
    }


def _codes(kinds: list[int], faults: list[int]) -> list[int]:
    return [k + 4 * min(f, 2) for k, f in zip(kinds, faults)]


def _groups(batches, key: int):
    """Lists of columns of the rows of each run of equal keys; rows come sorted by key."""
    held, last = None, None
    for batch in batches:
        keys = batch.column(key).to_pylist()
        columns = [c.to_pylist() for c in batch.columns]
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held is not None and keys[a] == last:
                for h, c in zip(held, columns):
                    h.extend(c[a:b])
            else:
                if held is not None:
                    yield held
                held, last = [c[a:b] for c in columns], keys[a]
    if held is not None:
        yield held


def _batch(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _arrow(spec: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "ints": pa.list_(pa.int64())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in spec.split(", ")])


def _repair_short(batches):
    """One row for each conversation; its rows come together, in order."""
    schema, out = _arrow(SCHEMA), []
    for key, conv, turn, role, text, fault, dropped, *_ in _groups(batches, 0):
        at = [k for k in range(len(conv)) if not dropped[k]]
        rows = [(role[k], text[k]) for k in at]
        faults, seen = [fault[k] for k in at], set()
        for n, row in enumerate(rows):
            if faults[n] != 2 and row in seen:
                faults[n] = 3
            seen.add(row)
        kinds = [_kind(r[:1]) for r, _ in rows]
        found = _summary([turn[k] for k in at], kinds, faults)
        solved = Lattice([*_codes(kinds, faults), END], [0, CAP, CAP, 0], [NOTHING])
        edits, _ = solved.trace(NOTHING)
        whole = "\n".join(repaired_rows(edits, [*rows, ("", "")], NOTHING))
        out.append(_answer(conv[0], found, solved.costs[NOTHING], "".join(edits), hashlib.sha256(whole.encode()).hexdigest()))
        if len(out) >= 2048:
            yield _batch(schema, out)
            out = []
    yield _batch(schema, out)


def _answer(conv, found: dict, cost: int, audit: str, digest: str) -> dict:
    gaps = found["high"] - found["low"] + 1 - found["turns"] if found["turns"] else 0
    return {"conv_id": conv, "gaps": gaps, **{k: found[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit, "repaired_sha256": digest}


PIECE = "key string, conv_id long, piece int, codes binary, rows long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first long, last long"
WAYS = "key string, piece int, exits ints, start int, end int"


def _long_answers(rows: DataFrame) -> DataFrame:
    """Conversations that are many pieces each. Rows of one turn are sorted by role and a hash of the text."""
    spark = rows.sparkSession
    rows = staged(rows.where(~F.col("dropped")).withColumn("tie", F.monotonically_increasing_id()), "talk-long")
    digest = F.sha2("text", 256)
    first = rows.groupBy("key", "role", digest.alias("sha")).agg(F.min(F.struct("turn", "tie")).alias("seen"))
    marked = rows.withColumn("sha", digest).join(first, ["key", "role", "sha"])
    fault = F.when((F.col("fault") != 2) & (F.struct("turn", "tie") != F.col("seen")), F.lit(3)).otherwise(F.col("fault"))
    marked = staged(marked.select("key", "conv_id", "turn", "role", "text", fault.cast("int").alias("fault"), "digest", "tie"), "talk-marked")
    size = marked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    parts = max(1, -(-size["n"] * 2 // LONG), (size["chars"] or 0) * 2 // LONG_BYTES)
    order = ["key", "turn", "role", "digest", "tie"]

    def number(batches):
        from pyspark import TaskContext

        piece, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, piece, dtype=np.int32)), pa.array(np.arange(at, at + batch.num_rows))], names=[*batch.schema.names, "piece", "at"])
            at += batch.num_rows

    ordered = marked.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("key", "conv_id", "turn", "role", "text", "fault")
    numbered = staged(ordered.mapInArrow(number, "key string, conv_id long, turn long, role string, text string, fault int, piece int, at long"), "talk-numbered")

    def summarise(batches):
        schema = _arrow(PIECE)
        for own, key, conv, turn, role, fault, piece, _ in _groups(batches, 0):
            kinds = [_kind(r) for r in role]
            codes = _codes(kinds, fault)
            yield _batch(schema, [{"key": key[0], "conv_id": conv[0], "piece": piece[0], "codes": bytes(codes), "rows": len(codes), **_summary(turn, kinds, fault)}])

    own = F.concat(F.col("piece").cast("string"), F.lit(":"), F.col("key")).alias("own")
    light = numbered.select(own, "key", "conv_id", "turn", F.substring("role", 1, 1).alias("role"), "fault", "piece", "at")
    pieces = staged(light.repartition(parts, "own").sortWithinPartitions("own", "at").mapInArrow(summarise, PIECE), "talk-pieces")
    ends = pieces.groupBy("key").agg(F.max("piece").alias("end"))
    pieces = staged(pieces.join(ends, "key").withColumn("end", (F.col("end") == F.col("piece")).cast("int")), "talk-ends")

    def ways(batches):
        """What it costs to go from each state before a piece to each state after it."""
        for batch in batches:
            for r in batch.to_pylist():
                cost = [Lattice([*r["codes"]], [0 if s == t else CAP for s in range(4)]).costs for t in range(4)] if not r["end"] else [Lattice([*r["codes"], END], [0, CAP, CAP, 0]).costs] * 4
                yield _batch(_arrow("key string, piece int, costs ints, end int"), [{"key": r["key"], "piece": r["piece"], "costs": [cost[t][s] for s in range(4) for t in range(4)], "end": r["end"]}])

    def back(batches):
        """What each piece's states pay after it, from the last piece to the first."""
        schema = _arrow("key string, piece int, after ints")
        for key, piece, costs, _ in _groups(batches, 0):
            after = np.zeros(4, dtype=np.int64)
            out = []
            for k in range(len(piece) - 1, -1, -1):
                out.append({"key": key[0], "piece": piece[k], "after": after.tolist()})
                table = np.array(costs[k]).reshape(4, 4)
                after = table[:, 0] if k == len(piece) - 1 else (table + after[None, :]).min(axis=1)
            yield _batch(schema, out)

    few = pieces.select("key", "piece", "codes", "end")
    priced = few.repartition(parts, "key", "piece").mapInArrow(ways, "key string, piece int, costs array<long>, end int")
    after = staged(priced.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(back, "key string, piece int, after array<long>"), "talk-prices")

    def lattice(codes, end, after) -> Lattice:
        return Lattice([*codes, END], [0, CAP, CAP, 0]) if end else Lattice([*codes], after)

    def leave(batches):
        for batch in batches:
            for r in batch.to_pylist():
                solved = lattice(r["codes"], r["end"], r["after"])
                yield _batch(_arrow("key string, piece int, goes ints, costs ints"), [{"key": r["key"], "piece": r["piece"], "goes": [solved.trace(s)[1] for s in range(4)], "costs": solved.costs}])

    def forth(batches):
        schema = _arrow("key string, piece int, start int, cost long")
        for key, piece, goes, costs in _groups(batches, 0):
            state, out = NOTHING, []
            for k in range(len(piece)):
                out.append({"key": key[0], "piece": piece[k], "start": state, "cost": costs[0][NOTHING]})
                state = goes[k][state]
            yield _batch(schema, out)

    left = few.join(after, ["key", "piece"]).repartition(parts, "key", "piece").mapInArrow(leave, "key string, piece int, goes array<long>, costs array<long>")
    starts = left.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(forth, "key string, piece int, start int, cost long")
    known = staged(pieces.join(after, ["key", "piece"]).join(starts, ["key", "piece"]), "talk-starts")

    def write(left_table: pa.Table, right_table: pa.Table) -> pa.Table:
        """A piece's edits and what it leaves, hashed later."""
        r = right_table.to_pylist()[0]
        ordered = left_table.sort_by("at")
        rows = list(zip(ordered.column("role").to_pylist(), ordered.column("text").to_pylist()))
        edits, _ = lattice(r["codes"], r["end"], r["after"]).trace(r["start"])
        texts = list(repaired_rows(edits, [*rows, ("", "")], r["start"]))
        return pa.table({"key": [r["key"]], "piece": pa.array([r["piece"]], pa.int32()), "audit": ["".join(edits)], "left": pa.array([len(texts)], pa.int64()), "whole": pa.array(["\n".join(texts).encode()], pa.binary())})

    told = numbered.select("key", "piece", "at", "role", "text").groupBy("key", "piece").cogroup(known.select("key", "piece", "codes", "end", "after", "start").groupBy("key", "piece"))
    told = staged(told.applyInArrow(write, "key string, piece int, audit string, left long, whole binary"), "talk-told")
    told = told.join(known.drop("codes", "after", "start", "end"), ["key", "piece"])

    def finish(batches):
        """Pieces come in order; a hash reads them one after the other, and only edits and counts are kept."""
        schema = _arrow(SCHEMA)
        now = None
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                if now is None or now["key"] != r["key"]:
                    if now is not None:
                        yield _batch(schema, [_answer(now["conv_id"], now, now["cost"], "".join(now["audits"]), now["hash"].hexdigest())])
                    now = {**r, "audits": [], "hash": hashlib.sha256(), "any": False, "high": None, "low": None}
                    now |= {k: 0 for k in ("turns", "blank", "duplicate", "truncated", "illegal")} | {"last": -1}
                now["audits"].append(r["audit"])
                if r["left"]:
                    now["hash"].update((b"\n" if now["any"] else b"") + r["whole"])
                    now["any"] = True
                for k in ("turns", "blank", "duplicate", "truncated", "illegal"):
                    now[k] += r[k]
                now["illegal"] += now["last"] >= 0 and (now["last"], r["first"]) not in LEGAL
                now["last"] = r["last"]
                if r["low"] is not None:
                    now["turns"] -= now["high"] == r["low"]
                    now["low"], now["high"] = r["low"] if now["low"] is None else now["low"], r["high"]
        if now is not None:
            yield _batch(schema, [_answer(now["conv_id"], now, now["cost"], "".join(now["audits"]), now["hash"].hexdigest())])

    columns = ["key", "piece", "conv_id", "audit", "left", "whole", "cost", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "first", "last"]
    return told.select(*columns).repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", "piece").mapInArrow(finish, SCHEMA)


def repaired(rows: DataFrame, long: int = LONG, long_bytes: int = LONG_BYTES) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation of rows as
    ``damaged`` returns them.

    Rows go by turn, nulls first; rows of one turn by role, then by a hash of the text, so that equal rows stand together.
    A conversation all of whose rows are dropped has zeros, an empty audit and the hash of the empty string; a null id is a
    conversation of its own. Texts of any length are read whole; repeated rows are rows each on their own, as duplicates.
    An empty table gives no rows. A role's initial is its first character; an empty role has none that is legal.
    Conversations of more than ``long`` rows or ``long_bytes`` characters are spread over tasks piece by piece; only the hash
    of what is left reads them in turn, streaming, and their audit is one string.
    """
    end = F.rtrim("text", F.lit(SPACES))
    fault = F.when(end == "", 2).when(F.right(end, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1).cast("int")
    rows = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), "conv_id", "turn", "role", "text", fault.alias("fault"), "dropped", F.xxhash64("text").alias("digest"))
    rows = staged(rows, "talk-rows")
    sizes = rows.groupBy("key").agg(F.sum((~F.col("dropped")).cast("long")).alias("rows"), F.sum(F.length("text")).alias("chars"))
    large = staged(sizes.where((F.col("rows") > long) | (F.col("chars") > long_bytes)).select("key"), "talk-large")
    order = ["turn", "role", "digest"]
    if large.isEmpty():
        return rows.repartition("key").sortWithinPartitions("key", *order).mapInArrow(_repair_short, SCHEMA)
    rest = rows.join(large, "key", "left_anti").repartition("key").sortWithinPartitions("key", *order).mapInArrow(_repair_short, SCHEMA)
    return rest.unionByName(_long_answers(rows.join(large, "key", "left_semi")))


def query(spark, sf_dir: str) -> DataFrame:
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
