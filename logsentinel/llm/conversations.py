"""Conversation repair (operator 13): the cheapest edits as lightest derivations, by Knuth's agenda.

1. Rows are put in order by range partitions, so that a long conversation is spread over tasks, and cut into blocks of
   BLOCK rows. Only narrow columns move: a letter for the role and the fault of each row, and a digest for repeats.
2. In each block a weighted hypergraph of items is solved: an item says that the rows from some place on can be brought from one
   state of the role automaton to another. Deductions put an edit before such an item; their superior functions add costs and join audits.
   The agenda pops items in order of (cost, rows, audit), so the first derivation of an item is its lightest.
3. A conversation's blocks are chained by the same agenda, each block's item with the item of the rest (two antecedents).
4. The edits are applied to the texts, which are shuffled once and read as a stream in order; no task holds a conversation's texts.

Of two derivations of an item with equal cost neither audit can begin the other (the rest would be insertions, which cost), so
the lesser of two audits stays the lesser whatever is joined before or behind: blocks may keep only the least.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Callable, Hashable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .session import stored

INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
#: Rows of a block (a power of two).
BLOCK = 512
#: Blocks of up to so many rows are remembered by their letters.
SHORT = 32

# States of the roles so far: nothing, a system row, a user row last, an assistant row last; an end is allowed in NOTHING and ANSWERED.
NOTHING, SYSTEM, ASKED, ANSWERED = range(4)
STEP = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): ASKED, (SYSTEM, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
ENDS = (NOTHING, ANSWERED)
ROLES = {"s": 0, "u": 1, "a": 2}
NONE, BLANK, DUPLICATE, CUT = range(4)
LEGAL = {(0, 1), (1, 2), (2, 1)}

Weight = tuple[int, int, str]


def joined(a: Weight, b: Weight) -> Weight:
    """The superior function of all deductions: costs and rows are added, audits joined."""
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def lightest(axioms: dict[Hashable, Weight], deductions: Callable[[Hashable, dict], Iterator[tuple[Hashable, Weight]]], goals: set | None = None) -> dict[Hashable, Weight]:
    """The lightest weight of every item that can be derived, or until all ``goals`` are final.

    ``deductions(item, final)`` gives (consequent, weight) of the deductions whose last antecedent to become final is
    ``item``. Weights of consequents must be larger than those of antecedents, and grow with them.
    """
    agenda, final, open_goals = [(w, i) for i, w in axioms.items()], {}, set(goals or ())
    heapq.heapify(agenda)
    while agenda:
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        open_goals.discard(item)
        if goals and not open_goals:
            break
        for consequent, w in deductions(item, final):
            if consequent not in final:
                heapq.heappush(agenda, (w, consequent))
    return final


def edits_of(code: int) -> list[tuple[str, Weight]]:
    """(role that the row ends with, or nothing where it goes; weight) of each edit of a row; code is role + 4 * fault."""
    role, fault = "sua-"[code % 4], code // 4
    out = [("", (DELETE, 1, "D"))]
    if fault in (BLANK, DUPLICATE):
        return out
    more = TRUNCATED if fault == CUT else 0
    if role in "sua":
        out.append((role, (more, 1, "K")))
    return out + [(r, (REROLE + more, 1, "R")) for r in "ua"]


@lru_cache(maxsize=65536)
def _short(codes: bytes) -> dict[tuple[int, int], Weight]:
    return solve(codes)


def solve(codes: bytes) -> dict[tuple[int, int], Weight]:
    """Of a block's rows the lightest weight from each state to each state, where there is any."""
    out, edits = {}, [edits_of(c) for c in codes]
    before = defaultdict(list)
    for (state, role), after in STEP.items():
        before[after, role].append(state)
    insert = (INSERT, 0, "I")

    def deductions(item: tuple[int, int], final: dict) -> Iterator[tuple[tuple[int, int], Weight]]:
        (at, state), rest = item, final[item]
        for role in "ua":
            for earlier in before[state, role]:
                yield (at, earlier), joined(insert, rest)
        if at:
            for role, weight in edits[at - 1]:
                for earlier in before[state, role] if role else (state,):
                    yield (at - 1, earlier), joined(weight, rest)

    for end in range(4):
        found = lightest({(len(codes), end): (0, 0, "")}, deductions)
        out |= {(state, end): found[0, state] for state in range(4) if (0, state) in found}
    return out


def chained(blocks: list[dict[tuple[int, int], Weight]]) -> Weight:
    """The lightest weight of a conversation of blocks: deductions of a block's item and the item of the rest."""
    axioms = {("rest", len(blocks), s): (0, 0, "") for s in ENDS}
    axioms |= {("block", i, a, b): w for i, paths in enumerate(blocks) for (a, b), w in paths.items()}

    def deductions(item: tuple, final: dict) -> Iterator[tuple[tuple, Weight]]:
        if item[0] == "block":
            _, i, a, b = item
            rest = ("rest", i + 1, b)
            if rest in final:
                yield ("rest", i, a), joined(final[item], final[rest])
        elif item[1]:
            _, i, b = item
            for a in range(4):
                block = ("block", i - 1, a, b)
                if block in final:
                    yield ("rest", i - 1, a), joined(final[block], final[item])

    goal = ("rest", 0, NOTHING)
    return lightest(axioms, deductions, {goal})[goal]


def applied(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) rows of an audit."""
    state, ops = NOTHING, iter(audit)

    def due() -> str:
        return "assistant" if state == ASKED else "user"

    for role, text in rows:
        for op in ops:
            if op == "D":
                break
            if op == "K":
                state = STEP[state, role[0]]
                yield role, text
                break
            new = due()
            state = STEP[state, new[0]]
            yield new, "" if op == "I" else text
            if op == "R":
                break
    for _ in ops:  # insertions behind the last row
        new = due()
        state = STEP[state, new[0]]
        yield new, ""


ORDER = ["turn", "role", "head", "mark"]
SPACES = " \t\n\x0b\x0c\r"


def _faced(rows: DataFrame) -> DataFrame:
    """Rows with what decides their order and their faults: head, mark, code (without repeats)."""
    none = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", none("role").alias("role"), none("text").alias("text"))
    trimmed = F.rtrim("text", F.lit(SPACES))
    fault = F.when(trimmed == "", BLANK).when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), NONE).otherwise(CUT)
    kind = F.substring("role", 1, 1)
    role = F.when(kind == "s", 0).when(kind == "u", 1).when(kind == "a", 2).otherwise(3)
    mark = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    return rows.select("conv_id", "turn", "role", F.substring("text", 1, 32).alias("head"), mark.alias("mark"), (role + 4 * fault).cast("int").alias("code"), "text")


def plans(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has rows.

    Rows of a conversation are in order of turn (nulls first); rows of one turn in order of role, the text's first 32
    characters and a digest. A null role or text counts as one blank. Rows with a null conv_id are one conversation.
    """
    faced = _faced(rows).drop("text").withColumn("tie", F.monotonically_increasing_id())
    first = [F.col(c).asc_nulls_first() for c in ["conv_id", *ORDER]]
    ordered = faced.repartitionByRange(*first, "tie").sortWithinPartitions(*first)
    placed = stored(ordered.select("conv_id", "turn", "mark", "code", F.monotonically_increasing_id().alias("pos")))
    repeats = placed.groupBy(F.col("conv_id").alias("c"), F.col("mark").alias("m")).agg(F.min("pos").alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    seen = F.col("earliest").isNotNull() & (F.col("pos") > F.col("earliest"))
    role, fault = F.pmod("code", F.lit(4)), F.floor(F.col("code") / 4)
    known = placed.join(repeats, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("mark") == F.col("m")), "left")
    coded = known.select("conv_id", "turn", "pos", F.when(seen & (fault != BLANK), role + 4 * DUPLICATE).otherwise(F.col("code")).cast("int").alias("code"))
    blocks = coded.groupBy("conv_id", F.shiftright("pos", BLOCK.bit_length() - 1).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("rows"))
    kind = placed.schema["conv_id"].dataType
    state = T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("rows", T.LongType()), T.StructField("audit", T.StringType())]))
    counts = ["blank", "duplicate", "truncated", "illegal"]
    fields = [T.StructField("conv_id", kind), T.StructField("block", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in counts], T.StructField("paths", state)]
    solved_schema = T.StructType(fields)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])

    def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for codes in batch.column("codes").to_pylist():
                data = bytes(codes)
                roles = [c % 4 for c in data]
                paths = (_short if len(data) <= SHORT else solve)(data)
                faults = [sum(c // 4 == f for c in data) for f in (BLANK, DUPLICATE, CUT)]
                out.append((roles[0], roles[-1], *faults, sum(p not in LEGAL for p in zip(roles[:-1], roles[1:], strict=True)), [{"from": a, "to": b, "cost": w[0], "rows": w[1], "audit": w[2]} for (a, b), w in paths.items()]))
            columns = [batch.column("conv_id").cast(arrow.field("conv_id").type), batch.column("block")]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([o[i] for o in out], f.type) for i, f in enumerate(list(arrow)[2:])], schema=arrow)

    solved = blocks.select("conv_id", "block", F.transform("rows", lambda r: r["code"]).alias("codes")).mapInArrow(each_block, solved_schema)
    whole = solved.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in counts], F.sort_array(F.collect_list(F.struct("block", "first", "last", "paths"))).alias("blocks"))
    out_schema = T.StructType([T.StructField("conv_id", kind), *[T.StructField(c, T.LongType()) for c in (*counts, "cost")], T.StructField("audit", T.StringType())])
    out_arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out_schema.fields])

    def each_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            illegal, costs, audits = [], [], []
            for own, blocks in zip(batch.column("illegal").to_pylist(), batch.column("blocks"), strict=True):
                blocks = blocks.as_py()
                between = sum((a["last"], b["first"]) not in LEGAL for a, b in zip(blocks[:-1], blocks[1:], strict=True))
                weight = chained([{(p["from"], p["to"]): (p["cost"], p["rows"], p["audit"]) for p in b["paths"]} for b in blocks])
                illegal.append(own + between)
                costs.append(weight[0])
                audits.append(weight[2])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id").cast(out_arrow.field(0).type), *[batch.column(c) for c in counts[:3]], pa.array(illegal, pa.int64()), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], schema=out_arrow)

    found = whole.mapInArrow(each_conversation, out_schema)
    turns = placed.groupBy(F.col("conv_id").alias("c")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    return found.join(turns, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "gaps", *counts, "cost", "audit")


def _stream(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Each conversation's plan and behind it its rows in order, one conversation after the other, in any number of tasks."""
    faced = _faced(rows).select("conv_id", *ORDER, F.lit(1).alias("part"), "text", F.lit(None).cast("string").alias("audit"))
    both = faced.unionByName(planned.select("conv_id", F.lit(0).alias("part"), "audit"), allowMissingColumns=True)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "part", *ORDER)]
    return both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "part", "audit", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple[str, str]]]]:
    """(conv_id, its repaired rows) of a stream of plans and rows; the rows must be read before the next one."""

    def flat() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c) for c in ("conv_id", "part", "audit", "role", "text")), strict=True)

    items, held = flat(), []

    def rows() -> Iterator[tuple[str, str]]:
        for item in items:
            if item[1].as_py() == 0:
                held.append(item)
                return
            yield item[3].as_py(), item[4].as_py()

    head = next(items, None)
    while head is not None:
        yield head[0].as_py(), applied(head[2].as_py(), rows())
        head = held.pop() if held else next(items, None)


def repaired_rows(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations, by their plans; places count from 0."""
    schema = T.StructType([rows.schema["conv_id"], T.StructField("place", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conv, repaired in _conversations(batches):
            for place, (role, text) in enumerate(repaired):
                out.append((conv, place, role, text))
                size += len(text) + 64
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return _stream(rows, planned).mapInArrow(run, schema)


def repaired_digests(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of each repaired conversation's ``role:text`` lines, joined by newlines."""
    schema = T.StructType([rows.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    kind = to_arrow_type(rows.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, digests = [], []
        for conv, repaired in _conversations(batches):
            digest = hashlib.sha256()
            for place, (role, text) in enumerate(repaired):
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            keys.append(conv)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(digests, pa.string())], names=["conv_id", "repaired_sha256"])

    return _stream(rows, planned).mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted damage: by crc32 of ``conv_id:turn`` modulo 20 a row is dropped (0), emptied (1),
    loses its ends of sentences (2), is repeated (3) or says it is the user's (4). Nulls are written as one blank."""
    none = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(none("conv_id"), F.lit(":"), none("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", none("role").alias("role"), none("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans, repaired rows) of a table of conversations (conv_id, turn, role, text).

    Edits: keep (0), rerole to user or assistant (REROLE), delete (DELETE; blank and repeated rows must go), insert an
    empty user or assistant row (INSERT); a truncated row that stays costs TRUNCATED more. The repaired roles are nothing, or an optional
    system row and then pairs of user and assistant. Ties: the least audit. Nulls and ties of turns: see ``plans``. An empty table
    gives empty results; other columns are not read; texts of any length are read whole.
    """
    planned = stored(plans(rows))
    return planned, repaired_rows(rows, planned)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = damaged(conversations)
    planned = stored(plans(rows))
    digests = repaired_digests(rows, planned).withColumnRenamed("conv_id", "d")
    every = conversations.select(F.col("conv_id").alias("id")).distinct()
    full = planned.join(digests, F.col("conv_id").eqNullSafe(F.col("d"))).drop("d")
    joined_all = every.join(full, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined_all.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
