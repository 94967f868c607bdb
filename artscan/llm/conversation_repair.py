"""Conversation repair: the cheapest edits that give a conversation a legal order of roles.

Rows are first damaged by a rule (that is what the query is held against), then
each row gets its first fault (blank, duplicate, truncated).  The cheapest edits
come from dynamic programming over the rows and four states of the grammar
``(s?(ua)+)?``: nothing yet, after system, after user, after assistant.

Conversations of like length stand side by side in arrays with time as the first
axis.  Costs-to-go of all of them are updated at once, row by row from the end,
and kept; the edits are then read off from the start, again for all at once,
taking at each place the least letter that lies on a cheapest way.  A long
conversation is cut into blocks that are treated as conversations of their own
for each way to enter and leave them, and joined by min-plus products.

Texts are shuffled once.  The first pass has one code and one digest a row in
place of the text; the second streams each conversation's rows behind its edits
to hash the repaired text, which can only be done in order.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DROP, EMPTY, UNSTOP, REPEAT, TO_USER = range(5)
SPACE = " \t\n\x0b\x0c\r"
FAULTS = ("", "blank", "duplicate", "truncated")
#: Rows judged at once, and rows of one block of a long conversation.
ROWS, BLOCK = 1 << 18, 1 << 10

# --- tables of the grammar -----------------------------------------------------------
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 40
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: State after the user's or assistant's turn that a state needs next.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: Cost-to-go behind the last row: what is open is closed by insertions.
CLOSE = np.array([0, 2 * INSERT, INSERT, 0], dtype=np.int64)
#: Codes of a row: its role's letter (system, user, assistant, other) + 4 * fault; one more for padding, one bit for rows that were dropped.
PAD, DROPPED = 16, 32


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """[state, code]: costs of Keep and of Rerole."""
    keep, rerole = np.full((4, PAD + 1), NEVER), np.full((4, PAD + 1), NEVER)
    for fault, extra in ((0, 0), (3, TRUNCATED)):
        for letter, states in enumerate(([START], [START, SYSTEM, ASSISTANT], [USER])):
            keep[states, letter + 4 * fault] = extra
        rerole[:, [x + 4 * fault for x in range(4)]] = REROLE + extra
    return keep, rerole


KEEP_COST, REROLE_COST = _tables()


def backward(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """[rows + 1, state, conversation]: least cost from before a row on, given the cost behind the last one."""
    out = np.empty((len(codes) + 1, 4, codes.shape[1]), dtype=np.int64)
    out[-1] = end
    for t in range(len(codes) - 1, -1, -1):
        code, then = codes[t], out[t + 1]
        on = then[NEXT]
        kept = on + KEEP_COST[:, code]
        kept[START] = np.where(code & 3 == 0, then[SYSTEM], on[START]) + KEEP_COST[START, code]
        best = np.minimum(np.minimum(then + DELETE, on + REROLE_COST[:, code]), kept)
        user, assistant = np.minimum(best[USER], INSERT + best[ASSISTANT]), np.minimum(best[ASSISTANT], INSERT + best[USER])
        best[USER], best[ASSISTANT] = user, assistant
        best[:2] = np.minimum(best[:2], INSERT + user)
        out[t] = np.where(code == PAD, then, np.minimum(best, NEVER))
    return out


def trace(codes: np.ndarray, costs: np.ndarray, state: np.ndarray, closing: bool) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the edits, [place, conversation] with 0 for none, and the state behind the last row.

    Two insertions at most stand before a row: a third would undo what they did.
    """
    n, width = codes.shape
    out = np.zeros((3 * n + 2, width), dtype=np.uint8)
    state, each = state.copy(), np.arange(width)
    for t in range(n):
        open_ = codes[t] != PAD
        for step in range(3):
            here, then, nxt = costs[t][state, each], costs[t + 1], NEXT[state]
            delete = then[state, each] + DELETE == here
            insert = ~delete & (costs[t][nxt, each] + INSERT == here)
            system = (state == START) & (codes[t] & 3 == 0)
            to = np.where(system, SYSTEM, nxt)
            keep = ~delete & ~insert & (then[to, each] + KEEP_COST[state, codes[t]] == here)
            letter = np.where(delete, ord("D"), np.where(insert, ord("I"), np.where(keep, ord("K"), ord("R"))))
            out[3 * t + step] = np.where(open_, letter, 0)
            state = np.where(open_, np.where(delete, state, np.where(keep, to, nxt)), state)
            open_ = open_ & insert
            if not open_.any():
                break
    if closing:
        out[3 * n] = np.where((state == USER) | (state == SYSTEM), ord("I"), 0)
        out[3 * n + 1] = np.where(state == SYSTEM, ord("I"), 0)
    return out, state


def _padded(codes: np.ndarray, start: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    at = np.arange(most)[:, None]
    inside = at < size
    return np.where(inside, codes[np.where(inside, start + at, 0)] if len(codes) else PAD, PAD).astype(np.uint8)


def _buckets(size: np.ndarray):
    """Indexes of conversations of like length: padding adds a quarter at most."""
    order = np.argsort(size, kind="stable")
    while len(order):
        least = size[order[0]]
        n = int(np.searchsorted(size[order], least + least // 4, "right"))
        yield order[:n]
        order = order[n:]


def _letters(out: np.ndarray) -> list[bytes]:
    """The letters of each conversation in turn."""
    flat = np.ascontiguousarray(out.T)
    there = flat != 0
    cuts = np.cumsum(there.sum(axis=1))
    data = flat[there].tobytes()
    return [data[a:b] for a, b in zip(np.concatenate(([0], cuts[:-1])), cuts, strict=True)]


def _long(codes: np.ndarray) -> tuple[int, bytes]:
    """Cost and edits of one conversation of more than one block."""
    start = np.arange(0, len(codes), BLOCK)
    n, ways = len(start), 4
    size = np.minimum(BLOCK, len(codes) - start)
    ends = np.empty((n, 4), dtype=np.int64)
    ends[-1] = CLOSE
    unit = np.where(np.eye(4, dtype=bool), 0, NEVER)
    step = max(1, ROWS // BLOCK)
    across = np.empty((n, 4, ways), dtype=np.int64)  # [block, state before, state behind]
    for a in range(0, n, step):
        block = np.repeat(_padded(codes, start[a : a + step], size[a : a + step], BLOCK), ways, axis=1)
        across[a : a + step] = backward(block, np.tile(unit, (1, block.shape[1] // ways)))[0].reshape(4, -1, ways).transpose(1, 0, 2)
    for b in range(n - 2, -1, -1):
        ends[b] = np.minimum((across[b + 1] + ends[b + 1]).min(axis=1), NEVER)
    cost = int((across[0] + ends[0]).min(axis=1)[START])
    state, parts = START, []
    for a in range(0, n, step):
        block = np.repeat(_padded(codes, start[a : a + step], size[a : a + step], BLOCK), ways, axis=1)
        costs = backward(block, np.repeat(ends[a : a + step].T, ways, axis=1))
        out, behind = trace(block, costs, np.tile(np.arange(4), block.shape[1] // ways), False)
        letters = _letters(out)
        for i in range(0, len(letters), ways):
            parts.append(letters[i + state])
            state = int(behind[i + state])
    return cost, b"".join([*parts, {SYSTEM: b"II", USER: b"I"}.get(state, b"")])


def cheapest(codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Cost and edits of conversations that stand one after another in ``codes``."""
    start = np.cumsum(size) - size
    cost, audit = np.zeros(len(size), dtype=np.int64), [b""] * len(size)
    for i in np.flatnonzero(size > BLOCK):
        cost[i], audit[i] = _long(codes[start[i] : start[i] + size[i]])
    short = np.flatnonzero((size > 0) & (size <= BLOCK))
    for bucket in _buckets(size[short]):
        own = short[bucket]
        block = _padded(codes, start[own], size[own], int(size[own].max()))
        costs = backward(block, np.broadcast_to(CLOSE[:, None], (4, len(own))))
        cost[own] = costs[0][START]
        for i, letters in zip(own, _letters(trace(block, costs, np.full(len(own), START), True)[0]), strict=True):
            audit[i] = letters
    return cost, audit


# --- rows ----------------------------------------------------------------------------
def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped, after the damage that crc32(``conv_id:turn``) chooses; nulls are one space."""
    what = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    role = F.when(F.col("what") == TO_USER, "user").otherwise(_text("role"))
    text = F.when(F.col("what") == EMPTY, "").when(F.col("what") == UNSTOP, F.translate(_text("text"), ".!?", "")).otherwise(_text("text"))
    times = F.when(F.col("what") == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = rows.select("conv_id", "turn", "role", "text", what.alias("what"))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("what") == DROP).alias("dropped"), F.explode(times).alias("_copy")).drop("_copy")


def intact(rows: DataFrame) -> DataFrame:
    """The same columns for rows that are taken as they are."""
    return rows.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"), F.lit(False).alias("dropped"))


def _digest() -> Column:
    """Of role and text: what is equal is a duplicate."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))


def _order() -> list[Column]:
    """By turn, nulls first; rows of one turn by role and by the digest of role and text."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, turn, code: each row's code, the rows of a conversation one after another in their order."""
    stripped = F.rtrim("text", F.lit(SPACE))
    fault = F.when(stripped == "", 1).when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    letter = F.when(F.startswith("role", F.lit("s")), 0).when(F.startswith("role", F.lit("u")), 1).when(F.startswith("role", F.lit("a")), 2).otherwise(3)
    plain = rows.select("conv_id", "turn", "role", "dropped", _digest().alias("digest"), fault.alias("fault"), letter.alias("letter")).repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "dropped", "digest").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when((F.col("fault") != 1) & (F.col("seen") > 1), 2).otherwise(F.col("fault"))
    code = F.col("letter") + 4 * fault + F.when(F.col("dropped"), DROPPED).otherwise(0)
    lined = plain.withColumn("seen", seen).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *_order(), "seen")
    return lined.select("conv_id", "turn", code.cast("int").alias("code"))


def _first(conv: pa.Array) -> np.ndarray:
    """Which rows begin a conversation."""
    out = np.ones(len(conv), dtype=bool)
    if len(conv) > 1:
        a, b = conv.slice(1), conv.slice(0, len(conv) - 1)
        same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
        out[1:] = ~(same | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False)))
    return out


def _judged(conv, turn: np.ndarray, known: np.ndarray, code: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """A row for each conversation; ``conv`` has its id, the others a value a row."""
    n = len(conv)
    alive = code < DROPPED
    of = (np.cumsum(first) - 1)[alive]
    code, turn, known = code[alive], turn[alive], known[alive]
    letter, fault = code & 3, code >> 2
    counts = [np.bincount(of[fault == k], minlength=n) for k in (1, 2, 3)]
    legal = np.zeros((4, 4), dtype=bool)
    legal[[0, 1, 2], [1, 2, 1]] = True
    wrong = (of[1:] == of[:-1]) & ~legal[letter[:-1], letter[1:]]
    illegal = np.bincount(of[1:][wrong], minlength=n)
    owner, turn = of[known], turn[known]
    gaps = np.zeros(n, dtype=np.int64)
    if len(owner):
        begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        ends = np.concatenate((begins[1:], [len(owner)])) - 1
        new = np.concatenate(([True], (turn[1:] != turn[:-1]) | (owner[1:] != owner[:-1])))
        gaps[owner[begins]] = turn[ends] - turn[begins] + 1 - np.add.reduceat(new.astype(np.int64), begins)
    cost, audit = cheapest(code.astype(np.uint8), np.bincount(of, minlength=n))
    return pa.RecordBatch.from_arrays([conv, *map(pa.array, (gaps, *counts, illegal, cost)), pa.array([x.decode() for x in audit], pa.string())], names=["conv_id", *COUNTS, "cost", "audit"])


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def judge(batches):
    """Gathers rows up to a bound, cuts behind the last whole conversation and judges those."""
    held: list[pa.RecordBatch] = []
    names = ["conv_id", "turn", "code"]

    def out(last: bool):
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        ids = pa.concat_arrays(rows.column("conv_id").chunks)
        first = _first(ids)
        upto = len(first) if last else int(np.flatnonzero(first)[-1])
        if rest := rows.slice(upto).to_batches():
            held.extend(rest)
        rows, first = rows.slice(0, upto), first[:upto]
        turn = rows.column("turn")
        if upto:
            conv = ids.slice(0, upto).filter(pa.array(first))
            yield _judged(conv, pc.fill_null(turn.cast(pa.int64()), 0).to_numpy(), turn.is_valid().to_numpy(), rows.column("code").to_numpy().astype(np.int64), first)

    n, most = 0, ROWS
    for batch in batches:
        if batch.num_rows:
            held.append(batch.select(names))
            n += batch.num_rows
            if n >= most:
                yield from out(False)
                n = sum(x.num_rows for x in held)
                most = max(ROWS, 2 * n)  # one that is longer than that is looked at anew only when it has doubled
    if held:
        yield from out(True)


# --- repaired text -------------------------------------------------------------------
def _hashes(batches):
    """Follows each conversation's edits through its rows and hashes what stays.

    A conversation's first row has its edits, the others its rows in order.
    """
    names = [*COUNTS, "cost", "audit"]
    now = digest = None
    state = at = 0
    lead = b""

    def put(role: bytes, text: bytes):
        nonlocal lead, state
        digest.update(lead + role + b":" + text)
        lead = b"\n"
        state = SYSTEM if role[:1] == b"s" else NEXT[state]

    def role() -> bytes:
        return b"user" if NEXT[state] == USER else b"assistant"

    def inserted():
        nonlocal at
        while audit[at : at + 1] == b"I":
            at += 1
            put(role(), b"")

    done: list[tuple] = []
    for batch in batches:
        columns = [batch.column(x) for x in ("conv_id", "role", "text", "audit")]
        roles, texts = (c.cast(pa.binary()) for c in columns[1:3])
        starts = columns[3].is_valid().to_pylist()
        for i, begins in enumerate(starts):
            if begins:
                if now is not None:
                    inserted()
                    done.append((now, digest.hexdigest()))
                now = batch.slice(i, 1).select(["conv_id", *names])
                digest, state, at, lead, audit = hashlib.sha256(), START, 0, b"", columns[3][i].as_py().encode()
                continue
            inserted()
            op, at = audit[at : at + 1], at + 1
            if op != b"D":
                put(roles[i].as_py() if op == b"K" else role(), texts[i].as_py())
        if len(done) >= 4096:
            yield _rows(done)
            done = []
    if now is not None:
        inserted()
        done.append((now, digest.hexdigest()))
    if done:
        yield _rows(done)


def _rows(done: list[tuple]) -> pa.RecordBatch:
    table = pa.Table.from_batches([b for b, _ in done]).append_column("repaired_sha256", pa.array([h for _, h in done]))
    return table.combine_chunks().to_batches()[0]


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of rows as ``damaged`` or ``intact`` return them.

    gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    Rows without conv_id form one conversation.  Rows of one turn are ordered by
    role, then by the digest of role and text.  Null turns come first and count
    for no gap.  Other columns are ignored; an empty table gives no rows.

    A conversation is read by one task, as a stream: its text is hashed in order.
    That task holds its edits (a byte a row) and 25 bytes a row for the first pass.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in [*COUNTS, "cost"])
    audits = coded(rows).mapInArrow(judge, f"conv_id {kind}, {counts}, audit string")
    turn = rows.schema["turn"].dataType
    heads = audits.select("*", F.lit(0).alias("part"), F.lit(None).cast(turn).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("digest"))
    empty = [F.lit(None).cast("long").alias(c) for c in [*COUNTS, "cost"]]
    texts = rows.filter(~F.col("dropped")).select("conv_id", *empty, F.lit(None).cast("string").alias("audit"), F.lit(1).alias("part"), "turn", "role", "text", _digest().alias("digest"))
    lined = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", *_order())
    return lined.select("conv_id", *COUNTS, "cost", "audit", "role", "text").mapInArrow(_hashes, f"conv_id {kind}, {counts}, audit string, repaired_sha256 string")


def digest(conversations: DataFrame) -> DataFrame:
    """Damages the conversations and returns how each is repaired."""
    return repair(damaged(conversations))
