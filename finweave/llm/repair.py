"""Repair of conversations: the cheapest edits that give a legal order of roles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finweave.llm.shared import bounded, join_same, materialise, working

# Faults of a row, roles that edits give, and costs of edits.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\f\r"
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
LEGAL = ("su", "ua", "au")
STATES = 4
#: Costs (lanes of four bits, one bit a state) that a set reaches above its
#: least. From no state is the rest of a conversation dearer than from another
#: by more than 10, as a few edits lead from each to what the other does.
LANES = 16
_FULL = (1 << STATES * LANES) - 1
_S0, _S1, _S2, _S3 = (sum(1 << (STATES * k + q) for k in range(4 * LANES)) for q in range(STATES))
#: Rows and characters of a block.
BLOCK_ROWS, BLOCK_CHARS = 1024, 4_000_000


def before(initial: str, later: int) -> int:
    """The states from which a row of this role leads to one of ``later``, in all layers."""
    if initial == "u":
        y = later & _S2
        return y >> 2 | y >> 1 | y << 1
    return (later & _S3) >> 1 if initial == "a" else (later & _S1) >> 1 if initial == "s" else 0


def layers(initials: str, faults: bytes, end: int) -> tuple[list[int], list[int]]:
    """Before each row, and at the end: the layers of states from which ``end``
    is reached (bit q of lane c: from q at a cost of c above the base), and the
    bases. One shift of all layers takes an edit of any cost."""
    x, base = end, 0
    out, bases = [x], [0]
    for i in range(len(initials) - 1, -1, -1):
        reached = x << STATES * DELETE
        if faults[i] not in (BLANK, DUPLICATE):
            kept = before(initials[i], x) | (before("u", x) | before("a", x)) << STATES * REROLE
            reached |= kept << STATES * CUT_OFF if faults[i] == TRUNCATED else kept
        for _ in range(2):
            reached |= (before("u", reached) | before("a", reached)) << STATES * INSERT
        lane = ((reached & -reached).bit_length() - 1) // STATES
        x, base = reached >> STATES * lane & _FULL, base + lane
        out.append(x)
        bases.append(base)
    return out[::-1], bases[::-1]


def least(x: int, state: int) -> int | None:
    """The first layer that holds a state."""
    mine = x & (_S0, _S1, _S2, _S3)[state]
    return ((mine & -mine).bit_length() - 1) // STATES if mine else None


def vector(costs: list[int | None]) -> int:
    """Layers from the cost of each state (null: out of reach)."""
    return sum(1 << (STATES * c + q) for q, c in enumerate(costs) if c is not None)


#: Cost of ending from each state: empty and after a are ends, the rest is inserted.
END = vector([0, 2 * INSERT, INSERT, 0])


def to_each(initials: str, faults: bytes) -> list[int | None]:
    """Least costs over a block from each state (rows) to each (columns)."""
    found: list[list[int | None]] = []
    for q in range(STATES):
        x, base = (y[0] for y in layers(initials, faults, 1 << q))
        found.append([None if (c := least(x, p)) is None else c + base for p in range(STATES)])
    return [found[q][p] for p in range(STATES) for q in range(STATES)]


def trace(initials: str, faults: bytes, end: int, state: int, last: bool) -> tuple[str, int]:
    """The least audit, by code points, among the cheapest from a state to
    ``end``, and the state it ends in; ``last``: end by insertions.

    The edits before a row settle it: equal beginnings have one place and one
    state, as an edit's role follows from the state. So the least edit that
    keeps the cost is taken at each step, a set bit in the layer that is left.
    """
    sets, bases = layers(initials, faults, end)
    left = bases[0] + (least(sets[0], state) or 0)
    out: list[str] = []
    i, n = 0, len(initials)

    def holds(i: int, cost: int, state: int) -> bool:
        return cost >= bases[i] and sets[i] >> STATES * (cost - bases[i]) + state & 1 == 1

    while i < n:
        r, fault = initials[i], faults[i]
        other = NEXT[state].get("u", 3)
        if holds(i + 1, left - DELETE, state):
            out.append("D")
            left, i = left - DELETE, i + 1
        elif holds(i, left - INSERT, other):
            out.append("I")
            left, state = left - INSERT, other
        else:
            more = CUT_OFF if fault == TRUNCATED else 0
            if r in NEXT[state] and holds(i + 1, left - more, NEXT[state][r]):
                out.append("K")
                left, state, i = left - more, NEXT[state][r], i + 1
            else:
                out.append("R")
                left, state, i = left - more - REROLE, other, i + 1
    if last:
        while left:
            out.append("I")
            left, state = left - INSERT, NEXT[state].get("u", 3)
    return "".join(out), state


_PRICE = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}


def cost(audit: str, faults: bytes) -> int:
    """Of the edits, and of truncated rows that are not deleted."""
    cut_off = sum(e != "D" and f == TRUNCATED for e, f in zip(audit.replace("I", ""), faults, strict=True))
    return sum(n * audit.count(e) for e, n in _PRICE.items()) + CUT_OFF * cut_off


def edited(audit: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits of an audit that starts in a state."""
    out_roles, out_texts, i = [], [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        role, text = ("", "") if edit == "I" else (roles[i], texts[i])
        if edit == "K":
            state = NEXT[state][role[:1]]
        else:
            state = NEXT[state].get("u", 3)
            role = ROLES["u" if state == 2 else "a"]
        i += edit != "I"
        out_roles.append(role)
        out_texts.append(text)
    return out_roles, out_texts


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n (rows there are of it) after damage."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), (F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20).alias("kind"))
    kind = F.col("kind")
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("n"),
    )


BLOCK = "conv_id long, task int, block int, complete boolean, n_rows long, gap_turns array<long>, blank long, duplicate long, truncated long, illegal long, initials string, faults binary, roles array<string>, texts array<string>, matrix array<long>"
_ARROW_BLOCK = pa.schema(
    [
        ("conv_id", pa.int64()), ("task", pa.int32()), ("block", pa.int32()), ("complete", pa.bool_()), ("n_rows", pa.int64()), ("gap_turns", pa.list_(pa.int64())), ("blank", pa.int64()), ("duplicate", pa.int64()),
        ("truncated", pa.int64()), ("illegal", pa.int64()), ("initials", pa.string()), ("faults", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("matrix", pa.list_(pa.int64())),
    ]
)


class _Block:
    """Rows of a conversation on their way to a row of ``BLOCK``."""

    def __init__(self, conv_id: int | None, place: int, first: bool, most: int):
        self.conv_id, self.place, self.open, self.most = conv_id, place, first, most
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.faults = bytearray()
        self.turns: list[int] = []  # first, last and how many distinct ones
        self.chars = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        self.chars += len(role) + len(text)
        if turn is not None:
            t = self.turns or [turn, turn, 1]
            self.turns = [t[0], turn, t[2] + (turn != t[1])]

    @property
    def full(self) -> bool:
        return len(self.roles) >= self.most or self.chars >= BLOCK_CHARS

    def row(self, complete: bool, task: int) -> dict:
        initials = "".join(r[:1] or "\0" for r in self.roles)
        faults = bytes(self.faults)
        return {
            "conv_id": self.conv_id, "task": task, "block": self.place, "complete": complete, "n_rows": len(self.roles), "gap_turns": self.turns,
            "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
            "illegal": sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1)), "initials": initials, "faults": faults, "roles": self.roles, "texts": self.texts,
            "matrix": None if complete else to_each(initials, faults),
        }


def _as_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    working("repair")
    task = TaskContext.get().partitionId()
    now: _Block | None = None
    waiting: list[dict] = []
    chars = 0

    def flush() -> pa.RecordBatch:
        nonlocal waiting, chars
        out = pa.RecordBatch.from_pylist(waiting, _ARROW_BLOCK)
        waiting, chars = [], 0
        return out

    def close(complete: bool) -> None:
        nonlocal chars
        waiting.append(now.row(complete, task))
        chars += now.chars + 200

    for batch in batches:
        for conv_id, turn, role, text, n, first, fault in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "first", "fault")), strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    close(not now.open)  # whole in this task, in one block
                now = _Block(conv_id, 0, now is None, most)
            for k in range(n):
                if now.full:
                    close(False)
                    now = _Block(conv_id, now.place + 1, True, most)
                now.add(turn, role, text, BLANK if fault == BLANK else DUPLICATE if k or not first else fault)
                if chars > BLOCK_CHARS or len(waiting) >= 2000:
                    yield flush()
    if now is not None:
        close(False)  # may go on in the next task
        yield flush()


def blocks(conversations: DataFrame, most: int = BLOCK_ROWS) -> DataFrame:
    """Damaged conversations as blocks of their rows in order, with faults.

    A row is the first of its role and text if its turn is the least; least
    turns are an aggregate, so a turn that fills a conversation is no group.
    Rows are dealt out by ranges of conversation, turn, role and the text's
    beginning: a conversation of a third of all rows is a run of many tasks.
    """
    head, sha = F.substring("text", 1, 64).alias("head"), F.sha2("text", 256).alias("sha")
    rows = damaged(conversations).select("conv_id", "turn", "role", head, sha, "text", "n", F.lit(0).alias("first"))
    firsts = rows.filter("n > 0").groupBy("conv_id", "role", "head", "sha").agg(F.min(F.struct("turn"))["turn"].alias("turn"))
    firsts = firsts.select("conv_id", "turn", "role", "head", "sha", F.lit(None).cast("string").alias("text"), F.lit(0).alias("n"), F.lit(1).alias("first"))
    dealt = rows.unionByName(firsts).repartitionByRange("conv_id", "turn", "role", "head")
    dealt = dealt.groupBy("conv_id", "turn", "role", "head", "sha").agg(F.max("text").alias("text"), F.sum("n").alias("n"), F.max("first").alias("first"))
    tail = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    fault = F.when(tail == "", BLANK).when(~tail.isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    dealt = dealt.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", "n", (F.col("first") == 1).alias("first"), fault.alias("fault"))
    return bounded(dealt).sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(lambda batches: _as_blocks(batches, most), BLOCK)


PLACE = ["conv_id", "task", "block"]


def _ordered(table: pa.Table) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: (r["task"], r["block"]))


def _ends(table: pa.Table) -> pa.Table:
    """What remains to be paid after each block of one conversation, by state,
    less the least: from the last block to the first."""
    rows = _ordered(table)
    ahead = [0, 2 * INSERT, INSERT, 0]
    out = []
    for k in range(len(rows) - 1, -1, -1):
        out.append({**{c: rows[k][c] for c in PLACE}, "ahead": ahead, "last": k == len(rows) - 1})
        m = rows[k]["matrix"]
        sums = [min((m[STATES * p + q] + ahead[q] for q in range(STATES) if m[STATES * p + q] is not None and ahead[q] is not None), default=None) for p in range(STATES)]
        low = min(x for x in sums if x is not None)
        ahead = [None if x is None else x - low for x in sums]
    return pa.Table.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("task", pa.int32()), ("block", pa.int32()), ("ahead", pa.list_(pa.int64())), ("last", pa.bool_())]))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits of a block from each state it may be entered in, and where they end."""
    working("repair")
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            found = [trace(r["initials"], r["faults"], vector(r["ahead"]), q, r["last"]) for q in range(STATES)]
            out.append({**{c: r[c] for c in PLACE}, "audits": [a for a, _ in found], "to": [q for _, q in found]})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("task", pa.int32()), ("block", pa.int32()), ("audits", pa.list_(pa.string())), ("to", pa.list_(pa.int32()))]))


def _entered(table: pa.Table) -> pa.Table:
    """The state each block of one conversation is entered in, from the first on, and its audit."""
    state, out = 0, []
    for r in _ordered(table):
        out.append({**{c: r[c] for c in PLACE}, "state": state, "audit": r["audits"][state]})
        state = r["to"][state]
    return pa.Table.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("task", pa.int32()), ("block", pa.int32()), ("state", pa.int32()), ("audit", pa.string())]))


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    working("repair")
    for batch in batches:
        audits, costs, roles, texts = [], [], [], []
        given = batch["audit"].to_pylist(), batch["state"].to_pylist()
        for initials, faults, role, text, audit, state in zip(*(batch[c].to_pylist() for c in ("initials", "faults", "roles", "texts")), *given, strict=True):
            if audit is None:
                audit, state = trace(initials, faults, END, 0, True)[0], 0
            new = edited(audit, state, role, text)
            audits.append(audit)
            costs.append(cost(audit, faults))
            roles.append(new[0])
            texts.append(new[1])
        kept = ["conv_id", "task", "block", "complete", "n_rows", "gap_turns", "blank", "duplicate", "truncated", "illegal", "initials", "faults"]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(audits, pa.string()), pa.array(costs, pa.int64()), pa.array(roles, pa.list_(pa.string())), pa.array(texts, pa.list_(pa.string()))], names=[*kept, "audit", "cost", "roles", "texts"])


REPAIRED = "conv_id long, task int, block int, complete boolean, n_rows long, gap_turns array<long>, blank long, duplicate long, truncated long, illegal long, initials string, faults binary, audit string, cost long, roles array<string>, texts array<string>"


def repaired(conversations: DataFrame, most: int = BLOCK_ROWS) -> DataFrame:
    """Damaged conversations after the cheapest edits that make the initials
    of their roles ``(s?(ua)+)?``.

    Rows: a block (``most`` rows) of a conversation, in order of task and block; complete: the
    block is the whole of it. Beside counts of faults: the audit (an initial
    an edit: Delete, Insert, Keep, Rerole) and the block's repaired roles and
    texts. Among the cheapest the audit least by code points is taken.

    Costs are layers: a block is read from its end, and an integer holds, in
    one lane for each cost, the set of grammar states from which the end is
    reached at that cost; an edit shifts all lanes at once. The first lane
    with the starting state is the cost, and a walk along set bits gives the
    audit. Blocks of one conversation meet through four by four least costs:
    these are combined from the last to the first, paths from each of the four
    states are walked in all blocks at once, and one of them is taken from the
    first to the last. So no task holds the texts of a long conversation.

    Nulls in any column are one space, in roles, texts and the hash that deals
    out damage; null turns come first and null conv_ids are one conversation.
    Rows of one turn are in order of role and text. Roles with another first
    letter than s, u or a can't be kept. A conversation without rows after
    damage has one empty block, an empty table none; other columns are left
    out. Repeated rows count and are duplicates.
    """
    made = materialise(blocks(conversations, most), "conversation-blocks")
    parts = made.filter("not complete")
    ends = parts.select(*PLACE, "matrix").groupBy("conv_id").applyInArrow(_ends, "conv_id long, task int, block int, ahead array<long>, last boolean")
    walked = join_same(parts.select(*PLACE, "initials", "faults"), ends, PLACE).mapInArrow(_paths, "conv_id long, task int, block int, audits array<string>, to array<int>")
    taken = materialise(walked.groupBy("conv_id").applyInArrow(_entered, "conv_id long, task int, block int, state int, audit string"), "conversation-audits")
    whole = made.filter("complete").withColumns({"state": F.lit(0), "audit": F.lit(None).cast("string")})
    return bounded(whole.unionByName(join_same(parts, taken, PLACE))).drop("matrix").mapInArrow(_applied, REPAIRED)


def turns(fixed: DataFrame) -> DataFrame:
    """conv_id, task, block, place, role and text of what ``repaired`` gives."""
    each = fixed.select(*PLACE, F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "turn"))
    return each.select(*PLACE, "place", F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text"))


DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _gaps(turns: list[int]) -> int:
    return turns[1] - turns[0] + 1 - turns[2] if turns else 0


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose blocks come in order: one block at a time."""
    working("repair")
    names = [x.split()[0] for x in DIGEST.split(", ")]
    now: dict | None = None

    def closed() -> pa.RecordBatch:
        row = {**now["sums"], "conv_id": now["conv_id"], "gaps": _gaps(now["turns"]), "audit": "".join(now["audit"]), "repaired_sha256": now["sha"].hexdigest()}
        kinds = {"audit": pa.string(), "repaired_sha256": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([row[x]], kinds.get(x, pa.int64())) for x in names], names=names)

    for batch in batches:
        for r in batch.to_pylist():
            if now is None or now["conv_id"] != r["conv_id"]:
                if now is not None:
                    yield closed()
                now = {"conv_id": r["conv_id"], "sums": dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0), "turns": [], "audit": [], "sha": hashlib.sha256(), "any": False, "role": ""}
            for k in ("blank", "duplicate", "truncated", "illegal", "cost"):
                now["sums"][k] += r[k]
            if r["n_rows"]:
                now["sums"]["illegal"] += bool(now["role"]) and now["role"] + r["initials"][0] not in LEGAL
                now["role"] = r["initials"][-1]
            if r["gap_turns"]:
                a, b = now["turns"], r["gap_turns"]
                now["turns"] = [a[0], b[1], a[2] + b[2] - (a[1] == b[0])] if a else b
            now["audit"].append(r["audit"])
            for role, text in zip(r["roles"], r["texts"], strict=True):
                now["sha"].update((("\n" if now["any"] else "") + role + ":" + text).encode())
                now["any"] = True
    if now is not None:
        yield closed()


def digest(fixed: DataFrame) -> DataFrame:
    """One row a conversation: gaps in its turns, counts of faults and of
    neighbours out of order, cost, audit and the hash of the repaired text. A
    hash is made of a text from front to back, so a conversation's blocks
    stream through one task then, one at a time."""
    t = F.col("gap_turns")
    gaps = F.coalesce(F.try_element_at(t, F.lit(2)) - F.try_element_at(t, F.lit(1)) + 1 - F.try_element_at(t, F.lit(3)), F.lit(0))
    line: Column = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat(x["roles"], F.lit(":"), x["texts"])), "\n")
    whole = fixed.filter("complete").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(line, 256).alias("repaired_sha256"))
    parts = fixed.filter("not complete").repartition("conv_id").sortWithinPartitions(*PLACE)
    return whole.unionByName(bounded(parts).mapInArrow(_streamed, DIGEST))


#: The same by dynamic programming from the first row on: the cheapest and
#: least audit to each grammar state after each row; crc32 from its polynomial.
SQL = r"""
WITH RECURSIVE crc AS (
  SELECT [list_reduce(list_prepend(CAST(i AS UBIGINT), CAST(range(8) AS UBIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) FOR i IN range(256)] AS t
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         [CAST(ascii(x) AS UBIGINT) FOR x IN string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')] AS codes
  FROM conversations
), dealt AS (
  SELECT conv_id, turn, role, text, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, codes), lambda c, b: xor(t[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8))) % 20 AS kind FROM keyed, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM dealt, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) copies(k)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         right(regexp_replace(text, '[ \x09-\x0D]+$', ''), 1) AS tail
  FROM damaged
), faulty AS (
  SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair
  FROM placed
), told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS last
  FROM faulty GROUP BY conv_id
), inserted(q, ins, before, added) AS (
  VALUES (0, '', 0, []), (0, 'I', 2, ['user:']), (0, 'II', 3, ['user:', 'assistant:']), (1, '', 1, []), (1, 'I', 2, ['user:']), (1, 'II', 3, ['user:', 'assistant:']),
         (2, '', 2, []), (2, 'I', 3, ['assistant:']), (2, 'II', 2, ['assistant:', 'user:']), (3, '', 3, []), (3, 'I', 2, ['user:']), (3, 'II', 3, ['user:', 'assistant:'])
), edits(before, edit, initial, price, q2, given) AS (
  SELECT q, 'D', CAST(NULL AS VARCHAR), 4, q, CAST(NULL AS VARCHAR) FROM range(4) states(q)
  UNION ALL VALUES (0, 'K', 's', 0, 1, NULL), (0, 'K', 'u', 0, 2, NULL), (1, 'K', 'u', 0, 2, NULL), (2, 'K', 'a', 0, 3, NULL), (3, 'K', 'u', 0, 2, NULL),
                   (0, 'R', NULL, 3, 2, 'user'), (1, 'R', NULL, 3, 2, 'user'), (2, 'R', NULL, 3, 3, 'assistant'), (3, 'R', NULL, 3, 2, 'user')
), steps AS (
  SELECT q, ins || edit AS letters, edit, initial, 3 * length(ins) + price AS price, CAST(q2 AS INTEGER) AS q2, given, added FROM inserted JOIN edits USING (before)
), best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, {'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': CAST([] AS VARCHAR[])} AS b FROM told
  UNION ALL
  SELECT f.conv_id, f.i, s.q2, min({'cost': b.cost + s.price + CASE WHEN s.edit <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END, 'audit': b.audit || s.letters,
         'lines': list_concat(b.lines, s.added, CASE WHEN s.edit = 'D' THEN [] ELSE [coalesce(s.given, f.role) || ':' || f.text] END)})
  FROM best JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM best.conv_id AND f.i = best.i + 1 JOIN steps s ON s.q = best.q
  WHERE (s.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (s.initial IS NULL OR s.initial = f.role[1])
  GROUP BY f.conv_id, f.i, s.q2
), ended AS (
  SELECT best.conv_id, min({'cost': b.cost + CASE q WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END, 'audit': b.audit || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
         'lines': list_concat(b.lines, CASE q WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END)}) AS b
  FROM best JOIN told ON told.conv_id IS NOT DISTINCT FROM best.conv_id AND told.last = best.i GROUP BY best.conv_id
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM c.conv_id
"""
