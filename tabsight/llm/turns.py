"""Conversation structure repair: the cheapest edits that give every conversation the roles ``(s?(ua)+)?``.

Rows of a conversation are taken by ``turn`` (nulls first; ties by the ``order`` columns that the caller names, then by a hash of
role and text).  A row's first fault counts: blank (nothing but white space), duplicate (role and text seen earlier in the
conversation), truncated (the last character that is no white space is not one of ``.!?``).  Edits: Keep 0, Rerole to user or
assistant 3, Delete 4 (the only edit of blank and duplicate rows), Insert an empty user or assistant turn 3; a truncated
row that stays adds 3.  The result is the cheapest audit (edit initials in order), ties to the ASCII-least.

* :func:`align`: the alternating string of every feasible length is a target; the turns are aligned to it by
  Wagner-Fischer, inside the Ukkonen band that the best cost so far leaves, and the backtraced audits of equal cost are
  compared.  Rows travel to it as one letter each, and equal letter strings are aligned once a worker.
* Conversations of more than ``MAX_TURNS`` turns never meet in one group: their rows are range-partitioned by
  their order and cut into blocks; a block is a min-plus matrix over the grammar's four states, the blocks' matrices give each
  block the costs behind it, and each block writes its least audit for every state that it can be entered in.  Same result
  (tests hold both against each other).
* :func:`repaired_turns` and :func:`repaired_digests` stream sorted rows beside the audit of their conversation: a task
  holds one batch and one audit.  One hash over a conversation's whole text is sequential by definition.

Null role or text counts as one space, so a null text is blank; a null role's initial is no role.  Rows with a null
conv_id are one conversation.  ``gaps`` ignores null turns.  Repeated rows are duplicates of their first.  Very long texts are
hashed where they are; only hashes and flags are grouped.  Extra columns are not read, whatever their names.  An empty
table gives no rows; a conversation of which no row is ``present`` gives zeros, an empty audit and the empty digest.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.llm.staging import Stage, process_cache

#: conversations of more turns are aligned in blocks
MAX_TURNS = 256

#: rows of a block
BLOCK_ROWS = 1 << 14

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
INF = 1 << 40
_STATS = ("gaps", "blank", "duplicate", "truncated", "illegal")
_LEGAL = frozenset(("su", "ua", "au"))
#: state (0 start, 1 behind s, 2 behind u, 3 behind a) reached with a role's initial
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_INSERT_TO = {0: (2, "u"), 1: (2, "u"), 3: (2, "u"), 2: (3, "a")}


def target(length: int) -> str:
    """The grammar's role initials of a feasible length (0, 2, 3, 4, ...)."""
    return "s" * (length % 2) + "ua" * (length // 2)


def _wagner_fischer(sign: str, goal: str, low: int, high: int, limit: int) -> tuple[int, str] | None:
    """Cheapest cost and ASCII-least audit of turning ``sign`` into ``goal``, if at most ``limit``.

    Band: after ``r`` live rows the target position lies within ``r + low .. r + high``."""
    n, m = len(sign), len(goal)
    live = [0]
    for c in sign:
        live.append(live[-1] + (c != "x"))
    cost: list[dict] = [{} for _ in range(n + 1)]
    for i in range(n, -1, -1):
        row, below = cost[i], cost[i + 1] if i < n else {}
        c = sign[i] if i < n else ""
        role, add = c.lower(), CUT if c.isupper() else 0
        for j in range(min(m, live[i] + high), max(0, live[i] + low) - 1, -1):
            best = 0 if i == n and j == m else INF
            if i < n:
                best = DELETE + below.get(j, INF)
            if j < m:
                want = goal[j]
                if want != "s":
                    best = min(best, INSERT + row.get(j + 1, INF))
                if c and c != "x" and (role == want or want != "s"):
                    best = min(best, (KEEP if role == want else REROLE) + add + below.get(j + 1, INF))
            if best < INF:
                row[j] = best
    total = cost[0].get(0, INF)
    if total > limit:
        return None
    out, i, j = [], 0, 0
    while i < n or j < m:
        here = cost[i][j]
        if i < n and DELETE + cost[i + 1].get(j, INF) == here:
            out.append("D")
            i += 1
        elif j < m and goal[j] != "s" and INSERT + cost[i].get(j + 1, INF) == here:
            out.append("I")
            j += 1
        else:
            out.append("K" if sign[i].lower() == goal[j] else "R")
            i, j = i + 1, j + 1
    return total, "".join(out)


def align(sign: str) -> tuple[int, str]:
    """(cost, audit) of a conversation given one letter a row: ``x`` must be deleted; ``s u a o`` its role, upper case if truncated."""
    n, gone = len(sign), sign.count("x")
    stay = n - gone
    best = (DELETE * n, "D" * n)                              # the empty target

    def bound(m):
        return DELETE * gone + (INSERT * (m - stay) if m > stay else DELETE * (stay - m))

    lengths = sorted((m for m in range(2, stay + (DELETE * n) // INSERT + 1)), key=lambda m: (bound(m), m))
    for m in lengths:
        spare = best[0] - DELETE * gone
        if bound(m) > best[0]:
            break
        shift = m - stay
        # k columns off the diagonal and back to ``shift`` cost at least this
        ks = [k for k in range(-stay, m + 1)
              if INSERT * max(0, k) + DELETE * max(0, -k) + INSERT * max(0, shift - k) + DELETE * max(0, k - shift) <= spare]
        if not ks:
            continue
        got = _wagner_fischer(sign, target(m), ks[0], ks[-1], best[0])
        if got is not None and got < best:
            best = got
    return best


def align_cached(sign: str) -> tuple[int, str]:
    cache = process_cache().setdefault("audits", {})
    got = cache.get(sign)
    if got is None:
        if len(cache) >= 100_000:
            cache.clear()
        got = cache[sign] = align(sign)
    return got


# -- long conversations: blocks over the grammar's states -----------------------------------------------------------

def _end_costs() -> list[int]:
    """Cost behind the last row: inserts up to an accepting state."""
    return [0, 2 * INSERT, INSERT, 0]


def _relax(g: list[int]) -> list[int]:
    """Allow inserts in front."""
    u, a = min(g[2], INSERT + g[3]), min(g[3], INSERT + g[2])
    return [min(g[0], INSERT + u), min(g[1], INSERT + u), u, a]


def _step(c: str, after: list[int]) -> list[int]:
    """Costs from before a row, given those behind it."""
    out = [DELETE + g for g in after]
    if c != "x":
        role, add = c.lower(), CUT if c.isupper() else 0
        for (state, want), to in _NEXT.items():
            if role == want or want != "s":
                out[state] = min(out[state], (KEEP if role == want else REROLE) + add + after[to])
    return _relax(out)


def block_matrix(sign: str) -> list[int]:
    """Row-major 4 x 4: least cost of a block's rows from entry state to exit state."""
    cols = []
    for out in range(4):
        g = [0 if s == out else INF for s in range(4)]
        for c in reversed(sign):
            g = _step(c, g)
        cols.append([min(x, INF) for x in g])
    return [cols[out][state] for state in range(4) for out in range(4)]


def block_audits(sign: str, behind: list[int], last: bool) -> tuple[list[str], list[int]]:
    """For each entry state the ASCII-least audit of a block, given the costs behind it, and the exit state."""
    costs = [behind]
    for c in reversed(sign):
        costs.append(_step(c, costs[-1]))
    costs.reverse()
    audits, exits = [], []
    for state in range(4):
        out, i = [], 0
        while i < len(sign) or (last and state not in (0, 3)):
            here = costs[i][state]
            if here >= INF:
                break
            to, _ = _INSERT_TO[state]
            if i < len(sign) and DELETE + costs[i + 1][state] == here:
                out.append("D")
                i += 1
            elif INSERT + costs[i][to] == here:
                out.append("I")
                state = to
            else:
                c = sign[i]
                add = CUT if c.isupper() else 0
                for want in "sua":
                    to = _NEXT.get((state, want))
                    price = KEEP if c.lower() == want else REROLE if want != "s" else INF
                    if to is not None and price + add + costs[i + 1][to] == here:
                        out.append("K" if price == KEEP else "R")
                        state = to
                        break
                i += 1
        audits.append("".join(out))
        exits.append(state)
    return audits, exits


# -- Spark ----------------------------------------------------------------------------------------------------------

def _trimmed(c: Column) -> Column:
    return F.rtrim(c, F.lit(" \t\n\x0b\x0c\r"))


def _rows(turns: DataFrame, order: tuple[str, ...], present: str | None) -> DataFrame:
    """conv, turn, order columns, role, text (nulls as one space), present, and two hashes; under names of their own."""
    rows = turns.select(F.col("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
                        *(F.col(c).alias(f"by{k}") for k, c in enumerate(order)),
                        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
                        (F.coalesce(F.col(present), F.lit(True)) if present else F.lit(True)).alias("present"))
    return rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "text", "role")})


def _order(order: tuple[str, ...], *rest: str) -> list[str]:
    return ["turn", *(f"by{k}" for k in range(len(order))), *rest]


def _letters(ini: list, blank: list, cut: list, dup: list) -> str:
    return "".join("x" if b or d else (i if i in "sua" and i else "o").upper() if c else (i if i in "sua" and i else "o")
                   for i, b, c, d in zip(ini, blank, cut, dup))


def _illegal(ini: list) -> int:
    return sum(a + b not in _LEGAL for a, b in zip(ini, ini[1:]))


_AUDIT = "conv_id {}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def audit_conversations(spark: SparkSession, turns: DataFrame, order: tuple[str, ...] = (), present: str | None = None,
                        max_turns: int = MAX_TURNS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per conversation: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)."""
    stage = Stage(spark, "turns")
    rows = _rows(turns, order, present)
    tail = F.substring(_trimmed(F.col("text")), -1, 1)
    small = stage.put(rows.select(
        "conv", *_order(order), F.substring("role", 1, 1).alias("ini"), "h1", "h2", (tail == "").alias("blank"), (~tail.isin(".", "!", "?")).alias("cut"), "present"))
    by = _order(order, "h1", "h2")
    kind = small.schema["conv"].dataType.simpleString()
    sizes = small.filter("present").groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_turns).select(
        F.col("conv").alias("long_conv"))
    longs = stage.put(sizes)
    some = not longs.isEmpty()
    short = small.join(longs, small.conv.eqNullSafe(longs.long_conv), "left_anti") if some else small

    def audit(batches):
        for b in batches:
            lists = b.column(1)
            offs = lists.offsets.to_numpy()
            got = lists.flatten()
            turn, ini, h1, h2, blank, cut, here = (got.field(got.type.get_field_index(c)).to_pylist()
                                                   for c in ("turn", "ini", "h1", "h2", "blank", "cut", "present"))
            out = []
            for s, e in zip((offs - offs[0])[:-1].tolist(), (offs - offs[0])[1:].tolist()):
                at = [k for k in range(s, e) if here[k]]
                seen, dup = set(), []
                for k in at:
                    key = (h1[k], h2[k])
                    dup.append(not blank[k] and key in seen)
                    seen.add(key)
                roles, empty, open_ = [ini[k] for k in at], [blank[k] for k in at], [cut[k] for k in at]
                numbers = [turn[k] for k in at if turn[k] is not None]
                gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
                lost = sum(c and not m and not d for c, m, d in zip(open_, empty, dup))
                out.append((gaps, sum(empty), sum(dup), lost, _illegal(roles), *align_cached(_letters(roles, empty, open_, dup))))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.string())],
                                             names=["conv_id", *_STATS, "cost", "audit"])

    fields = F.struct(*by, "ini", "blank", "cut", "present")
    out = short.groupBy("conv").agg(F.sort_array(F.collect_list(fields)).alias("rows")).mapInArrow(audit, _AUDIT.format(kind))
    if some:
        kept = small.filter("present").join(longs, small.conv.eqNullSafe(longs.long_conv), "left_semi")
        out = out.unionByName(_long_audits(stage, kept, by, kind, block_rows))
    return out


def _long_audits(stage: Stage, rows: DataFrame, by: list[str], kind: str, block_rows: int) -> DataFrame:
    """The same of long conversations, in blocks of rows in order."""
    keys = ["conv", "h1", "h2"]
    rank = F.struct(*by)
    # exact repeats share their order: all but one of them are duplicates, told apart within their (equal) places below
    first = rows.groupBy(*keys).agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = first.select(*(F.col(k).alias(f"of_{k}") for k in keys), "first")
    on = [rows.conv.eqNullSafe(first.of_conv), rows.h1 == first.of_h1, rows.h2 == first.of_h2]
    flagged = rows.join(first, on, "left").select(
        "conv", *by, "ini", "blank", "cut", (F.col("first").isNotNull() & (rank > F.col("first"))).alias("dup"))
    placed = flagged.repartitionByRange("conv", *by).sortWithinPartitions("conv", *by)
    cols = ["conv", "turn", "h1", "h2", "ini", "blank", "cut", "dup"]
    schema = (f"conv {kind}, part int, block int, sign string, ini array<string>, turns array<bigint>, distinct_turns bigint, blank bigint, "
              "duplicate bigint, truncated bigint, illegal bigint, matrix array<bigint>")

    def cut_blocks(batches):
        from pyspark import TaskContext
        part, number, held, before = TaskContext.get().partitionId(), 0, [], (None, None)

        def flush():
            nonlocal number, held
            roles = [r[4] for r in held]
            sign = _letters(roles, [r[5] for r in held], [r[6] for r in held], [r[7] for r in held])
            numbers = [r[1] for r in held if r[1] is not None]
            row = (held[0][0], part, number, sign, [roles[0], roles[-1]], [min(numbers), max(numbers)] if numbers else [],
                   len(set(numbers)), sum(r[5] for r in held), sum(r[7] and not r[5] for r in held),
                   sum(r[6] and not r[5] and not r[7] for r in held), _illegal(roles), block_matrix(sign))
            number, held = number + 1, []
            return pa.RecordBatch.from_pydict({c.split()[0]: [v] for c, v in zip(schema.split(", "), row)}, schema=arrow)

        arrow = None
        for b in batches:
            if arrow is None:
                i64, lists = pa.int64(), pa.list_(pa.int64())
                arrow = pa.schema([("conv", b.schema.field(0).type), ("part", pa.int32()), ("block", pa.int32()), ("sign", pa.string()),
                                   ("ini", pa.list_(pa.string())), ("turns", lists), ("distinct_turns", i64), ("blank", i64),
                                   ("duplicate", i64), ("truncated", i64), ("illegal", i64), ("matrix", lists)])
            for row in zip(*(b.column(k).to_pylist() for k in range(len(cols)))):
                if held and (held[-1][0] != row[0] or len(held) >= block_rows):
                    yield flush()
                place = (row[0], *(row[k] for k in range(1, 4)))
                if place == before:                               # an exact repeat in the same place
                    row = (*row[:7], True)
                before = place
                held.append(row)
        if held:
            yield flush()

    blocks = stage.put(placed.select(*cols).mapInArrow(cut_blocks, schema))
    listed = blocks.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "block", "matrix"))).alias("blocks"))

    def chain(batches):
        names = ["part", "block", "behind", "last", "cost"]
        for b in batches:
            for items in b.column(1).to_pylist():
                g, out = _end_costs(), []
                for k in range(len(items) - 1, -1, -1):
                    m = items[k]["matrix"]
                    out.append((items[k]["part"], items[k]["block"], g, k == len(items) - 1))
                    g = [min(m[4 * s + t] + g[t] for t in range(4)) for s in range(4)]
                kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.bool_(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*((*x, g[0]) for x in out)), kinds)], names=names)

    costs = stage.put(listed.mapInArrow(chain, "part int, block int, behind array<bigint>, last boolean, cost bigint"))
    joined = blocks.join(costs, ["part", "block"]).select("sign", "behind", "last", "cost", *(c for c in blocks.columns if c not in ("sign", "matrix")))

    def write(batches):
        for b in batches:
            got = [block_audits(*x) for x in zip(*(b.column(k).to_pylist() for k in range(3)))]
            rest = [b.column(k) for k in range(3, b.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array([a for a, _ in got], pa.list_(pa.string())), pa.array([e for _, e in got], pa.list_(pa.int32()))],
                names=[*b.schema.names[3:], "audits", "exits"])

    drop = ("sign", "matrix")
    plain = ", ".join(c for c in schema.split(", ") if c.split()[0] not in drop)
    audits = joined.mapInArrow(write, f"cost bigint, {plain}, audits array<string>, exits array<int>")
    body = F.struct("part", "block", "cost", "ini", "turns", "distinct_turns", "blank", "duplicate", "truncated", "illegal", "audits", "exits")
    whole = audits.groupBy("conv").agg(F.sort_array(F.collect_list(body)).alias("blocks"))

    def finish(batches):
        for b in batches:
            for k, items in enumerate(b.column(1).to_pylist()):
                state, audit, cost = 0, [], items[0]["cost"]
                low = high = role = None
                total = dict.fromkeys(_STATS, 0)
                distinct = 0
                for x in items:
                    audit.append(x["audits"][state])
                    state = x["exits"][state]
                    for c in ("blank", "duplicate", "truncated", "illegal"):
                        total[c] += x[c]
                    if role is not None and role + x["ini"][0] not in _LEGAL:
                        total["illegal"] += 1
                    role = x["ini"][1]
                    if x["turns"]:
                        distinct += x["distinct_turns"] - (x["turns"][0] == high)
                        low, high = x["turns"][0] if low is None else low, x["turns"][1]
                if low is not None:
                    total["gaps"] = high - low + 1 - distinct
                text = "".join(audit)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(k, 1), *(pa.array([total[c]], pa.int64()) for c in _STATS), pa.array([cost], pa.int64()),
                     pa.array([text], pa.string())], names=["conv_id", *_STATS, "cost", "audit"])

    return whole.mapInArrow(finish, _AUDIT.format(kind))


def _edited(turns: DataFrame, audits: DataFrame, order: tuple[str, ...], present: str | None, fn, schema: str) -> DataFrame:
    """Stream every conversation's audit and then its rows, in order, through one ``fn`` object a conversation."""
    rows = _rows(turns, order, present).filter("present").drop("present")
    heads = audits.select(F.col("conv_id").alias("conv"), F.lit(0).alias("kind"), F.col("audit").alias("text"))
    names = ["conv", "kind", *_order(order), "h1", "h2"]
    both = rows.withColumn("kind", F.lit(1)).unionByName(heads, allowMissingColumns=True).select(*names, "role", "text")
    sorted_rows = both.repartition("conv").sortWithinPartitions(*names).select("conv", "kind", "role", "text")
    fields = [f.split() for f in schema.split(", ")]

    def run(batches):
        out, size, now, arrow = [], 0, None, None

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), arrow)], names=[n for n, _ in fields])

        for b in batches:
            arrow = [b.schema.field(0).type, *({"bigint": pa.int64(), "string": pa.string()}[t] for _, t in fields[1:])]
            for conv, kind, role, text in zip(*(b.column(k).to_pylist() for k in range(4))):
                if kind == 0:
                    if now is not None:
                        now.close()
                    now = fn(conv, text, out)
                else:
                    now.row(role, text)
                    size += len(text)
                if len(out) >= 4096 or (out and size >= 8 << 20):
                    yield flush()
                    out.clear()
                    size = 0
        if now is not None:
            now.close()
        if out:
            yield flush()

    return sorted_rows.mapInArrow(run, schema)


class _Edits:
    """Applies an audit to rows that come one by one; ``out`` gets the result's rows."""

    def __init__(self, conv, audit: str, out: list):
        self.conv, self.audit, self.out, self.at, self.position = conv, audit, out, 0, 0
        self.odd = (len(audit) - audit.count("D")) % 2
        self.begin()

    def begin(self) -> None:
        pass

    def put(self, role: str, text: str) -> None:
        raise NotImplementedError

    def end(self) -> None:
        pass

    def _put(self, role: str | None, text: str) -> None:
        if role is None:                              # what the grammar wants here
            role = "assistant" if (self.position + self.odd) % 2 else "user"
        self.put(role, text)
        self.position += 1

    def _inserts(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self._put(None, "")

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._put(role if edit == "K" else None, text)

    def close(self) -> None:
        self._inserts()
        self.end()


class _Turns(_Edits):
    def put(self, role, text):
        self.out.append((self.conv, self.position, role, text))


class _Digest(_Edits):
    def begin(self):
        self.hash = hashlib.sha256()

    def put(self, role, text):
        self.hash.update((("\n" if self.position else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))

    def end(self):
        self.out.append((self.conv, self.hash.hexdigest()))


def repaired_turns(turns: DataFrame, audits: DataFrame, order: tuple[str, ...] = (), present: str | None = None) -> DataFrame:
    """The repaired conversations as rows: (conv_id, position, role, text)."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    return _edited(turns, audits, order, present, _Turns, f"conv_id {kind}, position bigint, role string, text string")


def repaired_digests(turns: DataFrame, audits: DataFrame, order: tuple[str, ...] = (), present: str | None = None) -> DataFrame:
    """(conv, repaired_sha256): SHA-256 of the repaired ``role:text``, joined by newlines."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    return _edited(turns, audits, order, present, _Digest, f"conv {kind}, repaired_sha256 string")


def damaged(turns: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """Conversations with a quarter of their rows damaged by a hash of conversation and turn: dropped (``present`` false),
    emptied, without ``.!?``, repeated, or of role user; columns conv_id, turn, ``order``, role, text, copy, present."""
    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", *order, text("role").alias("role"), text("text").alias("text"), code.alias("code"))
    return rows.select(
        "conv_id", "turn", *order, F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        (F.col("code") != 0).alias("present"))
