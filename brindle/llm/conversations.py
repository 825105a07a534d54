"""Conversation structure repair: the cheapest edits that give a conversation the shape system? (user assistant)*.

A conversation's rows and the shape's states (start, after system, after user, after assistant) span a graph: its nodes are
(row, state), its arcs the edits Keep 0, Rerole 1, Delete 2 (required for blank and repeated rows) and Insert 5; a truncated
row that stays costs 5 more. An arc is tight if the least cost forward to its tail, its own cost and the least cost backward
from its head make the least cost of all; tight arcs are the optimal edits. The walk from the first node takes the tight arc
with the least letter (D, I, K, R) at each step. A state and a letter give one next state, so the walk's frontier, the nodes
reached by the same letters, is always one node.

Nothing holds a whole conversation: equal rows of a turn are one row with a count, the sorted rows are cut into chunks of at
most ``CHUNK_ROWS`` rows, and a chunk is a 4 x 4 matrix of least costs. Chunks are chained forward, backward and along the
walk by one short row each; then every chunk gives its own edits. Only what is one value by its nature, a conversation's audit
and its digest, is put together conversation by conversation, chunk after chunk.

Defined results: null ids are one conversation; null turns come first; null roles and texts are one space. Rows of one turn
are in the order of a hash of role and text, equal ones adjacent. A turn may stand in any number of rows. A conversation
without rows after damage has zeros, an empty audit and the digest of nothing. No rows give no rows; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import table, written
from brindle.llm.worker import tidy

CHUNK_ROWS, CHUNK_BYTES = 512, 1 << 20
BLANKS = " \t\n\x0b\f\r"
# fixed values: costs of the edits, and the first letters of roles
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
INITIALS = "sua"
LEGAL = ("su", "ua", "au")
STATES = range(4)  # start, after system, after user, after assistant
WANTED = (1, 1, 2, 1)  # what comes next in each state: user or assistant, as places in INITIALS
REACHED = (2, 2, 3, 2)  # the state after that
ENDS = (0, 3)
FAR = 1 << 60
TRUNCATED_CODE, GONE_CODE = 4, 8  # beside the initial's place (3: another one)
ROLE = {1: "user", 2: "assistant"}

Costs = tuple[int, int, int, int]


def _kept(state: int, initial: int) -> int | None:
    """The state after a row that stays as it is."""
    return 1 if initial == 0 and state == 0 else REACHED[state] if initial == WANTED[state] else None


def _arcs(code: int, n: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, state after it, cost) of what may be done with a row, or with n rows that have to go."""
    yield "D", state, DELETE * n
    if code < GONE_CODE:
        more = TRUNCATED if code & TRUNCATED_CODE else 0
        if (to := _kept(state, code & 3)) is not None:
            yield "K", to, more
        yield "R", REACHED[state], REROLE + more


def _inserted(costs: list[int], back: bool = False) -> Costs:
    """Least costs when rows may be inserted here, at most two one after the other."""
    for _ in range(2):
        for state in STATES:
            to = REACHED[state]
            if back:
                costs[state] = min(costs[state], INSERT + costs[to])
            else:
                costs[to] = min(costs[to], INSERT + costs[state])
    return tuple(costs)


def _forward(entry: Costs, codes: bytes, counts: tuple[int, ...]) -> list[Costs]:
    """Least costs to each node, from the chunk's first row to behind its last."""
    out = [_inserted(list(entry))]
    for code, n in zip(codes, counts, strict=True):
        after = [FAR] * 4
        for state in STATES:
            for _, to, cost in _arcs(code, n, state):
                after[to] = min(after[to], out[-1][state] + cost)
        out.append(_inserted(after))
    return out


def _backward(leave: Costs, codes: bytes, counts: tuple[int, ...]) -> list[Costs]:
    """Least costs from each node to the end."""
    out = [_inserted(list(leave), back=True)]
    for code, n in zip(reversed(codes), reversed(counts), strict=True):
        out.append(_inserted([min(cost + out[-1][to] for _, to, cost in _arcs(code, n, state)) for state in STATES], back=True))
    return out[::-1]


@lru_cache(4096)
def matrix(codes: bytes, counts: tuple[int, ...]) -> tuple[Costs, ...]:
    """Least costs from each state before a chunk to each state behind it."""
    return tuple(_forward(tuple(0 if s == state else FAR for s in STATES), codes, counts)[-1] for state in STATES)


def _ahead(costs: Costs, m: tuple[Costs, ...]) -> Costs:
    return tuple(min(min(costs[s] + m[s][to] for s in STATES), FAR) for to in STATES)


def _behind(m: tuple[Costs, ...], costs: Costs) -> Costs:
    return tuple(min(min(m[s][to] + costs[to] for to in STATES), FAR) for s in STATES)


@lru_cache(4096)
def ways(codes: bytes, counts: tuple[int, ...], entry: Costs, leave: Costs, total: int, last: bool) -> tuple[tuple[str, int] | None, ...]:
    """For each state that an optimal walk may enter the chunk in: its letters and the state it leaves in."""
    before, after = _forward(entry, codes, counts), _backward(leave, codes, counts)
    out: list[tuple[str, int] | None] = []
    for state in STATES:
        if before[0][state] + after[0][state] != total:
            out.append(None)
            continue
        letters: list[str] = []
        at = state
        for i, (code, n) in enumerate(zip(codes, counts, strict=True)):
            while True:  # insertions stand before the row
                tight = [("I", REACHED[at], None)] if before[i][at] + INSERT + after[i][REACHED[at]] == total else []
                tight += [(letter, to, n) for letter, to, cost in _arcs(code, n, at) if before[i][at] + cost + after[i + 1][to] == total]
                letter, at, taken = min(tight)
                letters.append(letter * (taken or 1))
                if taken is not None:
                    break
        while last and not (at in ENDS and before[-1][at] == total):
            letters.append("I")
            at = REACHED[at]
        out.append(("".join(letters), at))
    return tuple(out)


# --- faults and damage, as expressions ------------------------------------------------------------------------------------


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults that follow from crc32 of ``conv:turn``, modulo 20: 0 goes, 1 loses its text, 2 its full stops, 3 comes
    twice, 4 gets the role user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = df.select(conv, turn, part(role).alias(role), part(text).alias(text), (F.crc32(F.concat(part(conv), F.lit(":"), part(turn))) % 20).alias("_w")).where("_w != 0")
    hurt = F.when(F.col("_w") == 1, "").when(F.col("_w") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(F.col(text))
    again = F.explode(F.when(F.col("_w") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return way.select(conv, turn, F.when(F.col("_w") == 4, "user").otherwise(F.col(role)).alias(role), hurt.alias(text), again.alias("_c")).drop("_c")


def _code(role: Column, text: Column) -> Column:
    first, shown = F.substring(role, 1, 1), F.rtrim(text, F.lit(BLANKS))
    initial = F.coalesce(F.nullif(F.position(F.when(first != "", first).otherwise("-"), F.lit(INITIALS)), F.lit(0)) - 1, F.lit(3))
    fault = F.when(shown == "", GONE_CODE).when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), TRUNCATED_CODE).otherwise(0)
    return (initial + fault).cast("int")


# --- chunks ---------------------------------------------------------------------------------------------------------------

_LONGS = pa.list_(pa.int64())


def _cut(columns: dict[str, list], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of chunks: one conversation each, bounded in rows and bytes (a longer row stands alone)."""
    start = size = 0
    for i, (conv, text) in enumerate(zip(columns["_conv"], columns["_text"], strict=True)):
        if i > start and (conv != columns["_conv"][start] or i - start == most or size + len(text) > CHUNK_BYTES):
            yield start, i
            start, size = i, 0
        size += len(text)
    if columns["_conv"]:
        yield start, len(columns["_conv"])


def _chunk_batches(conv_type: pa.DataType, most: int):
    schema = pa.schema([("conv", conv_type), ("chunk", pa.int64()), *[(c, _LONGS) for c in ("turns", "counts", "codes", "h1", "h2")], ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32  # range partitions are in order, so these ids are too
        for batch in batches:
            columns = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
            for start, end in _cut(columns, most):
                values = [[x] for x in (columns["_conv"][start], at, *(columns[c][start:end] for c in ("_turn", "_n", "_code", "_h1", "_h2", "_role", "_text")))]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)
                at += 1

    return run


def chunked(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Sorted rows in chunks whose ids grow with their order, written. Equal rows are counted in each task before they move."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = df.select(F.col(conv).alias("_conv"), F.col(turn).cast("long").alias("_turn"), part(role).alias("_role"), part(text).alias("_text"))
    rows = named.groupBy("_conv", "_turn", "_role", "_text").agg(F.count("*").alias("_n"))
    rows = rows.withColumns({"_code": _code(F.col("_role"), F.col("_text")), "_h1": F.xxhash64("_role", "_text"), "_h2": F.xxhash64(F.lit("row"), "_text", "_role")})
    order = [F.col("_conv").asc_nulls_first(), F.col("_turn").asc_nulls_first(), "_h1", "_h2"]
    dealt = rows.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    kind = named.schema["_conv"].dataType.simpleString()
    arrays = ", ".join(f"{c} array<bigint>" for c in ("turns", "counts", "codes", "h1", "h2"))
    made = dealt.mapInArrow(_chunk_batches(_arrow_type(kind), chunk_rows), f"conv {kind}, chunk bigint, {arrays}, roles array<string>, texts array<string>")
    return written(made, "chunks")


def _arrow_type(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(T.DataType.fromDDL(kind))


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turn_count")
_CODED = "conv {kind}, chunk bigint, codes binary, counts array<bigint>, " + ", ".join(f"{c} bigint" for c in (*_COUNTS, "turn_min", "turn_max", "first_turn", "last_turn", "first_initial", "last_initial"))


def _illegal(pair: tuple[int, int]) -> int:
    return "".join((*INITIALS, "-")[i] for i in pair) not in LEGAL


def _coded(row: dict) -> dict:
    """A chunk's rows as edit classes: repeated rows have to go, rows that must go are counted together."""
    own = {(x["h1"], x["h2"]) for x in row["own"] or ()}
    codes, counts, seen = bytearray(), [], set()
    blank = duplicate = truncated = illegal = 0
    initials = [code & 3 for code in row["codes"]]
    for code, n, key in zip(row["codes"], row["counts"], zip(row["h1"], row["h2"], strict=True), strict=True):
        fresh = key in own and key not in seen
        seen.add(key)
        if code >= GONE_CODE:
            blank += n
        else:
            duplicate += n - fresh
            truncated += fresh and code >= TRUNCATED_CODE
        stays = fresh and code < GONE_CODE
        illegal += n - 1  # no initial may follow itself
        for c, k in ((code, 1), (GONE_CODE, n - 1)) if stays else ((GONE_CODE, n),):
            if k:
                codes.append(c)
                counts.append(k)
    illegal += sum(map(_illegal, zip(initials, initials[1:], strict=False)))
    turns = [t for t in row["turns"] if t is not None]
    return {
        "conv": row["conv"], "chunk": row["chunk"], "codes": bytes(codes), "counts": counts, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal,
        "turn_count": len(set(turns)), "turn_min": min(turns, default=None), "turn_max": max(turns, default=None), "first_turn": row["turns"][0], "last_turn": row["turns"][-1],
        "first_initial": initials[0], "last_initial": initials[-1],
    }


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield from batch.slice(at, 1024).to_pylist()


def _packed(rows: Iterator[dict], schema: pa.Schema, most: int = 1024) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _mapped(df: DataFrame, make, schema: str) -> DataFrame:
    """``make``, from an iterator of rows to one of rows, over each partition."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.DataType.fromDDL(schema))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(make(_rows(batches)), arrow)

    return df.mapInArrow(run, schema)


def _code_chunks(rows: Iterator[dict]) -> Iterator[dict]:
    return map(_coded, rows)


def _go_forward(rows: Iterator[dict]) -> Iterator[dict]:
    """Costs before each chunk, and what only shows at its edge: an illegal pair, a turn that goes on."""
    before, costs = None, None
    for row in rows:
        if before is None or before["conv"] != row["conv"]:
            costs = (0, FAR, FAR, FAR)
        else:
            row["illegal"] += _illegal((before["last_initial"], row["first_initial"]))
            row["turn_count"] -= row["first_turn"] is not None and before["last_turn"] == row["first_turn"]
        before = row
        yield {**row, "entry": list(costs)}
        costs = _ahead(costs, matrix(row["codes"], tuple(row["counts"])))


def _go_backward(rows: Iterator[dict]) -> Iterator[dict]:
    """Costs behind each chunk, from the last one on, and with them the ways through it."""
    none, conv, costs, total = True, None, None, 0
    for row in rows:
        codes, counts, entry = row["codes"], tuple(row["counts"]), tuple(row["entry"])
        m = matrix(codes, counts)
        last = none or conv != row["conv"]
        if last:
            costs = tuple(0 if s in ENDS else FAR for s in STATES)
            total = min(a + b for a, b in zip(_ahead(entry, m), costs, strict=True))
        none, conv = False, row["conv"]
        found = ways(codes, counts, entry, costs, total, last)
        yield {**row, "letters": [w and w[0] for w in found], "leave": [w and w[1] for w in found], "cost": total if last else 0}
        costs = _behind(m, _inserted(list(costs), back=True))


def _walk(rows: Iterator[dict]) -> Iterator[dict]:
    none, conv, state = True, None, 0
    for row in rows:
        if none or conv != row["conv"]:
            state = 0
        none, conv = False, row["conv"]
        yield {**row, "piece": row["letters"][state], "entered": state}
        state = row["leave"][state]


def walked(chunks: DataFrame) -> DataFrame:
    """For each chunk its piece of the audit, the state it is entered in, and its counts, written."""
    kind = chunks.schema["conv"].dataType.simpleString()
    each = chunks.select("conv", "chunk", F.inline(F.arrays_zip("h1", "h2")))
    firsts = each.groupBy("conv", "h1", "h2").agg(F.min("chunk").alias("chunk")).groupBy("chunk").agg(F.collect_list(F.struct("h1", "h2")).alias("own"))  # at most a chunk's rows
    narrow = chunks.select("conv", "chunk", "turns", "counts", "codes", "h1", "h2").join(firsts, "chunk", "left")
    coded = _mapped(narrow, _code_chunks, _CODED.format(kind=kind))
    schema = _CODED.format(kind=kind) + ", entry array<bigint>"
    ahead = _mapped(coded.repartition("conv").sortWithinPartitions("conv", "chunk"), _go_forward, schema)
    schema += ", letters array<string>, leave array<int>, cost bigint"
    both = _mapped(ahead.repartition("conv").sortWithinPartitions("conv", F.desc("chunk")), _go_backward, schema)
    schema = f"conv {kind}, chunk bigint, piece string, entered int, cost bigint, turn_min bigint, turn_max bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS)
    return written(_mapped(both.repartition("conv").sortWithinPartitions("conv", "chunk"), _walk, schema), "walk")


def _edits(row: dict) -> Iterator[tuple[str, int | None, str, str]]:
    """(edit, row's place in the chunk, role, text) of the rows that stay or are new."""
    state, place, left = row["entered"], 0, row["counts"][0]
    for letter in row["piece"]:
        role, text, at = ROLE[WANTED[state]], "", None
        if letter != "I":
            at = place
            if letter != "D":
                text = row["texts"][place]
                role = row["roles"][place] if letter == "K" else role
            left -= 1
            if not left:
                place += 1
                left = row["counts"][place] if place < len(row["counts"]) else 0
        if letter == "K":
            state = _kept(state, row["codes"][at] & 3)
        elif letter != "D":
            state = REACHED[state]
        if letter != "D":
            yield letter, at, role, text


def _repaired(rows: Iterator[dict]) -> Iterator[dict]:
    for row in rows:
        for i, (edit, at, role, text) in enumerate(_edits(row)):
            yield {"conv": row["conv"], "chunk": row["chunk"], "place": i, "turn": None if at is None else row["turns"][at], "role": role, "text": text, "edit": edit}


def _bodies(rows: Iterator[dict]) -> Iterator[dict]:
    for row in rows:
        lines = [f"{role}:{text}" for _, _, role, text in _edits(row)]
        yield {"conv": row["conv"], "chunk": row["chunk"], "piece": row["piece"], "body": "\n".join(lines) if lines else None}


def _digests(rows: Iterator[dict]) -> Iterator[dict]:
    """Audit and digest of each conversation, fed chunk by chunk."""
    none, conv, audit, digest, empty = True, None, [], hashlib.sha256(), True
    for row in rows:
        if not none and conv != row["conv"]:
            yield {"conv": conv, "audit": "".join(audit), "digest": digest.hexdigest()}
            audit, digest, empty = [], hashlib.sha256(), True
        none, conv = False, row["conv"]
        audit.append(row["piece"])
        if row["body"] is not None:
            digest.update(("" if empty else "\n").encode() + row["body"].encode())
            empty = False
    if not none:
        yield {"conv": conv, "audit": "".join(audit), "digest": digest.hexdigest()}


def _edited(chunks: DataFrame, walk: DataFrame) -> DataFrame:
    return chunks.select("conv", "chunk", "turns", "counts", "codes", "roles", "texts").join(walk.select("chunk", "piece", "entered"), "chunk")


def repaired_rows(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The repaired conversations' rows: conv, (chunk, place) in their order, turn (null for inserted rows), role, text and the
    edit (K, R or I)."""
    chunks = chunked(df, conv, turn, role, text, chunk_rows)
    kind = chunks.schema["conv"].dataType.simpleString()
    return _mapped(_edited(chunks, walked(chunks)), _repaired, f"conv {kind}, chunk bigint, place int, turn bigint, role string, text string, edit string").withColumnRenamed("conv", conv)


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """A row a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    chunks = chunked(df, conv, turn, role, text, chunk_rows)
    kind = chunks.schema["conv"].dataType.simpleString()
    walk = walked(chunks)
    bodies = _mapped(_edited(chunks, walk), _bodies, f"conv {kind}, chunk bigint, piece string, body string")
    digests = _mapped(bodies.repartition("conv").sortWithinPartitions("conv", "chunk"), _digests, f"conv {kind}, audit string, digest string")
    counted = [c for c in _COUNTS if c != "turn_count"]
    both = walk.drop("chunk", "piece", "entered").unionByName(digests, allowMissingColumns=True)  # null ids meet in a group, not in a join
    summed = both.groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in (*counted, "cost")], F.min("turn_min").alias("_a"), F.max("turn_max").alias("_b"), F.sum("turn_count").alias("_k"),
        F.max("audit").alias("audit"), F.max("digest").alias("repaired_sha256"),
    )
    gaps = F.coalesce(F.col("_b") - F.col("_a") + 1 - F.col("_k"), F.lit(0)).alias("gaps")
    return summed.select(F.col("conv").alias(conv), gaps, *counted, "cost", "audit", "repaired_sha256")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair(damaged(rows))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    bare = [F.lit(0).cast("long").alias(c) for c in numbers]
    every = rows.select("conv_id", *bare, F.lit("").alias("audit"), F.lit("").alias("repaired_sha256")).distinct()  # conversations whose rows are all gone
    out = found.unionByName(every).groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in numbers], F.max("audit").alias("audit"), F.max("repaired_sha256").alias("_d"))
    return out.select("conv_id", *numbers, "audit", F.when(F.col("_d") == "", F.sha2(F.lit(""), 256)).otherwise(F.col("_d")).alias("repaired_sha256"))


OP11_SQL = r"""
with recursive crc_table as materialized (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) as crc),
keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
way as (
  select conv_id, turn, role, text,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(k)), '..'), lambda h: ('0x' || h)::bigint)),
      lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])), 4294967295) % 20 as w
  from keyed, crc_table),
hurt as (
  select conv_id, turn, case when w = 4 then 'user' else role end as role,
    case when w = 1 then '' when w = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from way, range(2) r(c) where w <> 0 and (c = 0 or w = 3)),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos, left(role, 1) as ini, rtrim(text, E' \t\n\x0B\f\r') as shown from hurt),
faulty as materialized (
  select *, case when shown = '' then 'b' when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'd'
      when right(shown, 1) not in ('.', '!', '?') then 't' else '-' end as fault,
    lag(ini) over (partition by conv_id order by pos) as prev from placed),
path(conv_id, pos, state, cost, audit, body) as (
  select distinct conv_id, 0::bigint, s.state, s.cost, s.audit, s.body from conversations,
    (values (0, 0, '', []::varchar[]), (2, 5, 'I', ['user:']), (3, 10, 'II', ['user:', 'assistant:'])) s(state, cost, audit, body)
  union all
  select conv_id, pos, state, best.cost, best.audit, best.body from (
    select conv_id, pos, state, min({'cost': cost, 'audit': audit, 'body': body}) as best from (
      with moved as (
        select p.conv_id, f.pos,
          case when e.edit = 'D' then p.state when e.edit = 'K' and f.ini = 's' then 1 when p.state = 2 then 3 else 2 end as state,
          p.cost + case e.edit when 'D' then 2 when 'K' then 0 else 1 end + case when e.edit <> 'D' and f.fault = 't' then 5 else 0 end as cost,
          p.audit || e.edit as audit,
          case e.edit when 'D' then p.body when 'K' then list_append(p.body, f.role || ':' || f.text)
            else list_append(p.body, case when p.state = 2 then 'assistant:' else 'user:' end || f.text) end as body
        from path p join faulty f on f.conv_id is not distinct from p.conv_id and f.pos = p.pos + 1, (values ('D'), ('K'), ('R')) e(edit)
        where e.edit = 'D' or f.fault in ('-', 't') and (e.edit = 'R' or f.ini = 's' and p.state = 0
          or f.ini = 'u' and p.state <> 2 or f.ini = 'a' and p.state = 2))
      select * from moved
      union all select conv_id, pos, case when state = 2 then 3 else 2 end, cost + 5, audit || 'I', list_append(body, case when state = 2 then 'assistant:' else 'user:' end) from moved
      union all select conv_id, pos, case when state = 2 then 2 else 3 end, cost + 10, audit || 'II',
        body || case when state = 2 then ['assistant:', 'user:'] else ['user:', 'assistant:'] end from moved)
    group by conv_id, pos, state)),
ended as (
  select p.conv_id, min({'cost': cost, 'audit': audit, 'body': body}) as best from path p
  where state in (0, 3) and pos = (select count(*) from faulty f where f.conv_id is not distinct from p.conv_id) group by p.conv_id),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
    count(*) filter (fault = 't') as truncated, count(*) filter (pos > 1 and prev || ini not in ('su', 'ua', 'au')) as illegal
  from faulty group by conv_id)
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, best.cost::bigint as cost, best.audit as audit, sha256(array_to_string(best.body, chr(10))) as repaired_sha256
from ended e left join counted c on c.conv_id is not distinct from e.conv_id
"""

QUERIES = {"op11_conversation_repair": op11_conversation_repair}
SQL = {"op11_conversation_repair": OP11_SQL}
