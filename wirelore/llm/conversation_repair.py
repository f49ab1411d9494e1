"""Cheapest repair of a conversation's turns, by Four-Russians block tables.

A row becomes one of twelve symbols (initial of its role x sound, truncated or to be deleted). A repaired conversation
reads ``(s?(ua)+)?`` in role initials, so four states suffice: nothing yet, after s, after u, after a. The cost vector
at a place holds the least cost of finishing from each state. Cost vectors less their minimum are few (every
difference is bounded, as two inserts lead from any state to any other), so the step of a vector over a block of
``BLOCK`` symbols is a table entry: (vector, block) -> (vector, cost added). Blocks are processed from the right by
look-up alone. The trace goes from the left: it expands a block backward from its right vector, one symbol at a time,
and then takes the ASCII-least letter that stays on a cheapest path. As costs to go are exact at every place,
taking the least letter first gives the least of all cheapest audits.

Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (the only one for blank and repeated rows), Insert of an empty
user or assistant turn 5; a truncated row that isn't deleted adds 5.

Distribution: rows without their texts (role, digest, marks) are put in order by a range sort over (conversation,
turn), which splits a long conversation over tasks; repeated rows are found by an aggregate per (conversation,
digest), counters by sums per piece of ``PIECE`` rows. What meets per conversation is one character a row, as many as
the audit has. Texts move once, to the task that hashes their conversation as a stream, in bounded memory: SHA-256 has
no parts that could be worked out apart, so a conversation with a third of all rows is one long stream.

Defined results: a null role or text is one space, so a null text is blank; rows without conversation id are one conversation;
rows without turn come first; rows of one turn are ordered by the digest of role and text, so equal rows are
neighbours; a conversation without rows has zeros, an empty audit and the digest of the empty string; an empty table
gives an empty table. A span of turns beyond 64 bits gives null gaps. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tables import small_batches

WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a; and the state after a user or assistant turn is added to each.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: A symbol is a base-12 digit: 3 x (s, u, a or other) + (sound, truncated or to be deleted).
SYMBOLS, DIGITS = 12, "0123456789ab"
SOUND, TRUNCATED, DOOMED = range(3)
INITIALS = "sua"
LEGAL = {"su", "ua", "au"}
#: Rows per table look-up, rows per piece of a conversation.
BLOCK, PIECE = 4, 4096

Vector = tuple[int, ...]


def kept_state(state: int, initial: int) -> int | None:
    """The state after keeping a row whose role has this initial; None where that is illegal."""
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return None if state == USER else USER
    return ASSISTANT if initial == 2 and state == USER else None


def _settle(raw: list[float]) -> Vector:
    """Costs when turns may be inserted first."""
    user, assistant = min(raw[USER], INSERT + raw[ASSISTANT]), min(raw[ASSISTANT], INSERT + raw[USER])
    return tuple(int(x) for x in (min(raw[START], INSERT + user), min(raw[SYSTEM], INSERT + user), user, assistant))


def _choices(state: int, symbol: int, right: Vector) -> list[tuple[str, int, int]]:
    """(letter, cost to go, next state) of the edits that use up a row, in ASCII order."""
    initial, mark = divmod(symbol, 3)
    found = [("D", DELETE + right[state], state)]
    if mark != DOOMED:
        more, kept = (UNFINISHED if mark == TRUNCATED else 0), kept_state(state, initial)
        if kept is not None:
            found.append(("K", KEEP + more + right[kept], kept))
        found.append(("R", REROLE + more + right[AFTER[state]], AFTER[state]))
    return found


def _before(symbol: int, right: Vector) -> Vector:
    return _settle([min(cost for _, cost, _ in _choices(x, symbol, right)) for x in range(4)])


class Tables:
    """Vectors, single steps, block steps and the traces of single steps."""

    def __init__(self, block: int = BLOCK) -> None:
        self.block = block
        self.end = _settle([0, float("inf"), float("inf"), 0])
        low = min(self.end)
        vectors, number = [tuple(x - low for x in self.end)], {}
        number[vectors[0]] = 0
        step: list[tuple[int, int]] = []
        for v in vectors:  # grows while it is read
            for symbol in range(SYMBOLS):
                whole = _before(symbol, v)
                new = tuple(x - min(whole) for x in whole)
                if new not in number:
                    number[new] = len(vectors)
                    vectors.append(new)
                step.append((number[new], min(whole)))
        self.vectors, self.end_cost = vectors, low
        self.step = step
        self.trace = [self._trace(v, symbol, x) for v in vectors for symbol in range(SYMBOLS) for x in range(4)]
        # A block's code has its leftmost symbol first; steps run from the right.
        one = np.array([s for s, _ in step], np.int32).reshape(-1, SYMBOLS)
        cost = np.array([c for _, c in step], np.int32).reshape(-1, SYMBOLS)
        to, total = one, cost
        for _ in range(block - 1):  # the symbols to the right first, one more at the left
            more = cost[to]  # vector x right code x left symbol
            to, total = one[to], total[:, :, None] + more
            # codes with the new symbol as the most significant digit
            to = to.transpose(0, 2, 1).reshape(len(vectors), -1)
            total = total.transpose(0, 2, 1).reshape(len(vectors), -1)
        self.block_to, self.block_cost = to.tolist(), total.tolist()

    def _trace(self, right: Vector, symbol: int, state: int) -> tuple[str, int]:
        """Letters up to the one that uses up the row, and the state after it."""
        settled, letters = _before(symbol, right), ""
        while True:
            found = [c for c in _choices(state, symbol, right) if c[1] == settled[state]]
            if (not found or found[0][0] > "I") and INSERT + settled[AFTER[state]] == settled[state]:
                letters, state = letters + "I", AFTER[state]
            else:
                return letters + found[0][0], found[0][2]

    def repair(self, symbols: str) -> tuple[int, str]:
        """Least cost and the ASCII-least audit of a conversation's symbols."""
        n, block = len(symbols), self.block
        full = n - n % block
        at, cost = 0, self.end_cost
        rest = [0] * (n - full + 1)  # vectors right of the single symbols behind the last block
        for i in range(n - 1, full - 1, -1):
            at, added = self.step[at * SYMBOLS + DIGITS.index(symbols[i])]
            cost += added
            rest[i - full] = at
        rights = []  # the vector right of each block, from the last block to the first
        for i in range(full - block, -1, -block):
            rights.append(at)
            code = int(symbols[i:i + block], SYMBOLS)
            cost += self.block_cost[at][code]
            at = self.block_to[at][code]
        cost += self.vectors[at][START]
        letters, state = [], START
        for b in range(len(rights)):
            own = [DIGITS.index(c) for c in symbols[b * block:(b + 1) * block]]
            inner = [rights[len(rights) - 1 - b]]  # right of the last symbol, then further left
            for symbol in own[:0:-1]:
                inner.append(self.step[inner[-1] * SYMBOLS + symbol][0])
            for symbol, right in zip(own, reversed(inner)):
                text, state = self.trace[(right * SYMBOLS + symbol) * 4 + state]
                letters.append(text)
        for i in range(full, n):
            text, state = self.trace[(rest[i - full + 1] * SYMBOLS + DIGITS.index(symbols[i])) * 4 + state]
            letters.append(text)
        while state in (SYSTEM, USER):
            letters.append("I")
            state = AFTER[state]
        return cost, "".join(letters)


@functools.cache
def tables() -> Tables:
    return Tables()


def illegal_pairs(symbols: str) -> int:
    initials = [(INITIALS + "?")[DIGITS.index(c) // 3] for c in symbols]
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


class Replay:
    """Applies an audit to the rows of its conversation, given in order."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def _added(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at, self.state = self.at + 1, AFTER[self.state]
            yield NAMES[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._added()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "K":
            self.state = kept_state(self.state, INITIALS.index(role[0]))
            yield role, text
        elif letter == "R":
            self.state = AFTER[self.state]
            yield NAMES[self.state], text

    def rest(self) -> Iterator[tuple[str, str]]:
        yield from self._added()


def damage(turns: DataFrame) -> DataFrame:
    """The contract's damage by CRC of ``conv_id:turn``; dropped rows stay as rows that aren't ``present``."""
    named = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), *(
        F.coalesce(turns[c], F.lit(" ")).alias(c) for c in ("role", "text")))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = named.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("present"), F.explode(copies).alias("copy"))
    return rows.drop("copy")


def _rows(turns: DataFrame, present: str | None) -> DataFrame:
    there = F.lit(True) if present is None else F.coalesce(turns[present], F.lit(False))
    rows = turns.select(
        turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), F.coalesce(turns["role"], F.lit(" ")).alias("role"),
        F.coalesce(turns["text"], F.lit(" ")).alias("text"), there.alias("present"))
    return rows.withColumn("mark", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


def _ordered_marks(rows: DataFrame) -> DataFrame:
    """Rows without texts, numbered in their order. ``salt`` only lets equal rows lie on both sides of a cut."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(WHITE)), -1, 1)
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    light = rows.select(
        "conv_id", "turn", "mark", "present", number.alias("initial"), (last == "").alias("blank"), (~last.isin(*ENDS)).alias("cut"),
        (F.monotonically_increasing_id() % 1024).alias("salt"))
    order = ["conv_id", "turn", "mark", "salt"]
    ordered = light.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    return cut_lineage(ordered.withColumn("seq", F.monotonically_increasing_id()), "repair-order")


def find_repairs(turns: DataFrame, present: str | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation.

    ``present`` names a boolean column; a row where it isn't true only makes its conversation known.
    """
    small_batches(turns.sparkSession)
    return _repairs(_rows(turns, present))


def _repairs(rows: DataFrame) -> DataFrame:
    marks = _ordered_marks(rows)
    firsts = marks.filter("present").groupBy("conv_id", "mark").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("first"))
    faulty = marks.join(firsts, "seq", "left").withColumn(
        "fault", F.when(~F.col("present"), "-").when(F.col("blank"), "b").when(F.col("first").isNull(), "d").when(F.col("cut"), "t").otherwise("k"))
    kind = F.when(F.col("fault").isin("b", "d"), DOOMED).when(F.col("fault") == "t", TRUNCATED).otherwise(SOUND)
    symbol = F.substring(F.lit(DIGITS), F.col("initial") * 3 + kind + 1, F.lit(1))
    count = lambda letter: F.sum((F.col("fault") == letter).cast("long"))
    own_turn = F.when(F.col("present"), F.col("turn"))
    pieces = faulty.groupBy("conv_id", F.floor(F.col("seq") / PIECE).alias("piece")).agg(
        F.array_sort(F.collect_list(F.when(F.col("present"), F.struct("seq", symbol.alias("symbol"))))).alias("symbols"),
        F.min(own_turn).alias("low"), F.max(own_turn).alias("high"), F.size(F.collect_set(own_turn)).cast("long").alias("distinct"),
        count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"))
    pieces = pieces.withColumn("symbols", F.array_join(F.transform("symbols", lambda x: x.symbol), ""))
    whole = pieces.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("piece", "symbols", "low", "high", "distinct"))).alias("pieces"), F.min("low").alias("low"),
        F.max("high").alias("high"), *(F.sum(c).alias(c) for c in ("distinct", "blank", "duplicate", "truncated")))
    # A turn on both sides of a cut was counted in both pieces.
    whole = whole.withColumn("dated", F.expr("filter(pieces, p -> p.low is not null)"))
    shared = F.expr("size(filter(dated, (p, i) -> i > 0 and p.low = get(dated, i - 1).high))")
    gaps = F.when(F.col("low").isNull(), F.lit(0)).otherwise(F.expr("try_subtract(try_add(try_subtract(high, low), 1L), `distinct`)") + shared)

    @F.pandas_udf("cost long, audit string, illegal long")
    def solve(symbols: pd.Series) -> pd.DataFrame:
        found = [(*tables().repair(s), illegal_pairs(s)) for s in symbols]
        return pd.DataFrame(found, columns=["cost", "audit", "illegal"])

    solved = whole.select(
        "conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated",
        solve(F.array_join(F.transform("pieces", lambda p: p.symbols), "")).alias("solved"))
    return solved.select("conv_id", "gaps", "blank", "duplicate", "truncated", "solved.illegal", "solved.cost", "solved.audit")


COUNTERS = "gaps blank duplicate truncated illegal cost".split()


def _streams(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """Each conversation's repair, followed by its rows in order."""
    heads = repairs.withColumn("kind", F.lit(0)).withColumns({c: F.lit(None).cast(t) for c, t in (("turn", "long"), ("mark", "string"), ("role", "string"), ("text", "string"))})
    body = rows.filter("present").drop("present").withColumn("kind", F.lit(1)).withColumns({c: F.lit(None).cast("long") for c in COUNTERS}).withColumn("audit", F.lit(None).cast("string"))
    columns = ["conv_id", "kind", "turn", "mark", "role", "text", *COUNTERS, "audit"]
    both = heads.select(*columns).unionByName(body.select(*columns))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "mark").drop("turn", "mark")


RESULT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTERS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
RESULT_DDL = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTERS) + ", audit string, repaired_sha256 string"


class _Digest:
    """SHA-256 of lines joined by line feeds."""

    def __init__(self) -> None:
        self.sha, self.any = hashlib.sha256(), False

    def add(self, lines: Iterator[tuple[str, str]]) -> None:
        for role, text in lines:
            self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
            self.any = True


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    head, replay, digest, out = None, None, None, []

    def close() -> None:
        if head is not None:
            digest.add(replay.rest())
            out.append({**head, "repaired_sha256": digest.sha.hexdigest()})

    for batch in batches:
        kinds, roles, texts = (batch.column(c).to_pylist() for c in ("kind", "role", "text"))
        heads = batch.select(["conv_id", *COUNTERS, "audit"])
        for i, kind in enumerate(kinds):
            if kind == 0:
                close()
                head = heads.slice(i, 1).to_pylist()[0]
                replay, digest = Replay(head["audit"]), _Digest()
            else:
                digest.add(replay.row(roles[i], texts[i]))
        if out:
            yield pa.RecordBatch.from_pylist(out, RESULT)
            out.clear()
    close()
    if out:
        yield pa.RecordBatch.from_pylist(out, RESULT)


def repair_digests(turns: DataFrame, present: str | None = None) -> DataFrame:
    """:func:`find_repairs` with the SHA-256 of each repaired conversation (``role:text``, joined by line feeds)."""
    small_batches(turns.sparkSession)
    rows = _rows(turns, present)
    return _streams(rows, _repairs(rows)).mapInArrow(_digests, RESULT_DDL)


REPAIRED = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, replay, position = None, None, 0
    for batch in batches:
        out: list[tuple[int | None, int, str, str]] = []

        def put(lines: Iterator[tuple[str, str]]) -> None:
            nonlocal position
            for role, text in lines:
                out.append((conv, position, role, text))
                position += 1

        columns = [batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "audit")]
        for own, kind, role, text, audit in zip(*columns):
            if kind == 0:
                if replay is not None:
                    put(replay.rest())
                conv, replay, position = own, Replay(audit), 0
            else:
                put(replay.row(role, text))
        yield pa.RecordBatch.from_pylist([dict(zip(REPAIRED.names, x)) for x in out], REPAIRED)
    if replay is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "position": position + k, "role": r, "text": t} for k, (r, t) in enumerate(replay.rest())], REPAIRED)


def repaired_turns(turns: DataFrame, present: str | None = None) -> DataFrame:
    """The repaired conversations themselves: conv_id, position from 0, role and text."""
    small_batches(turns.sparkSession)
    rows = _rows(turns, present)
    return _streams(rows, _repairs(rows)).mapInArrow(_lines, "conv_id long, position long, role string, text string")


#: Plain forward dynamic program over one row at a time that keeps the least (cost, audit) of each state, in DuckDB.
REPAIR_SQL = r"""
    with recursive crc as materialized (
        select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: case when (c & 1) = 1 then xor(3988292384, c >> 1) else c >> 1 end, b)) as tab),
    named as (
        select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
            coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
    kinds as (
        select *, xor(4294967295, list_reduce(list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i::bigint, 1))::bigint),
            lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8), 4294967295)) % 20 as kind from named, crc),
    damaged as (
        select conv_id, turn, case kind when 4 then 'user' else role end as role,
            case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
            unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) as copy
        from kinds),
    numbered as materialized (
        select *, row_number() over (partition by conv_id order by turn nulls first, md5(length(role) || ':' || role || text), copy) as i,
            row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen,
            rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body
        from damaged),
    rows_ as materialized (
        select *, substr(role, 1, 1) as initial,
            case when body = '' then 'b' when seen > 1 then 'd' when right(body, 1) not in ('.', '!', '?') then 't' else 'k' end as fault
        from numbered),
    ids as materialized (select distinct conv_id from conversations),
    dp as (
        select conv_id, 0::bigint as i, b.st, struct_pack(cost := b.cost, audit := b.audit, made := b.made) as best
        from ids, (values ('0', 0, '', ''), ('u', 5, 'I', 'u'), ('a', 10, 'II', 'ua')) b(st, cost, audit, made)
        union all
        select conv_id, i, st, min(best) from (
            select c.conv_id, c.i, x.st, struct_pack(cost := c.cost + x.cost, audit := c.audit || x.audit, made := c.made || x.made) as best
            from (
                select d.conv_id, r.i, o.st, d.best.cost + o.cost as cost, d.best.audit || o.letter as audit, d.best.made || o.made as made
                from dp d join rows_ r on r.conv_id is not distinct from d.conv_id and r.i = d.i + 1,
                lateral (
                    select 'D' as letter, d.st as st, 2 as cost, '-' as made
                    union all select 'R', n.next, 1 + case r.fault when 't' then 5 else 0 end, n.next
                        from (values (case d.st when 'u' then 'a' else 'u' end)) n(next) where r.fault in ('k', 't')
                    union all select 'K', r.initial, case r.fault when 't' then 5 else 0 end, r.initial
                        where r.fault in ('k', 't') and d.st || r.initial in ('0s', '0u', 'su', 'ua', 'au')) o) c
            join (values ('0', '0', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('a', 'a', 0, '', ''),
                ('0', 'u', 5, 'I', 'u'), ('s', 'u', 5, 'I', 'u'), ('u', 'a', 5, 'I', 'a'), ('a', 'u', 5, 'I', 'u'),
                ('0', 'a', 10, 'II', 'ua'), ('s', 'a', 10, 'II', 'ua')) x(was, st, cost, audit, made) on x.was = c.st) s
        group by conv_id, i, st),
    lengths as (select ids.conv_id, count(r.i) as n from ids left join rows_ r on r.conv_id is not distinct from ids.conv_id group by ids.conv_id),
    solved as materialized (
        select d.conv_id, min(d.best) as best from dp d join lengths l on l.conv_id is not distinct from d.conv_id and l.n = d.i
        where d.st in ('0', 'a') group by d.conv_id),
    letters as (
        select conv_id, p, substr(best.audit, p, 1) as letter, substr(best.made, p, 1) as made,
            length(replace(substr(best.audit, 1, p), 'I', '')) as i
        from (select conv_id, best, unnest(range(1, length(best.audit) + 1)) as p from solved)),
    lines as (
        select l.conv_id, string_agg(case l.letter when 'K' then r.role || ':' || r.text else
            case l.made when 'u' then 'user:' else 'assistant:' end || case l.letter when 'R' then r.text else '' end end, chr(10) order by l.p) as body
        from letters l left join rows_ r on r.conv_id is not distinct from l.conv_id and r.i = l.i
        where l.letter <> 'D' group by l.conv_id),
    pairs as (
        select conv_id, turn, fault, lag(initial) over w || initial as pair, lag(i) over w is not null as inner_ from rows_ window w as (partition by conv_id order by i)),
    counts as (
        select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank,
            count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
            count(*) filter (inner_ and pair not in ('su', 'ua', 'au')) as illegal
        from pairs group by conv_id)
    select s.conv_id, coalesce(c.gaps, 0)::bigint as gaps, coalesce(c.blank, 0)::bigint as blank, coalesce(c.duplicate, 0)::bigint as duplicate,
        coalesce(c.truncated, 0)::bigint as truncated, coalesce(c.illegal, 0)::bigint as illegal, s.best.cost::bigint as cost, s.best.audit as audit,
        sha256(coalesce(l.body, '')) as repaired_sha256
    from solved s left join counts c on c.conv_id is not distinct from s.conv_id left join lines l on l.conv_id is not distinct from s.conv_id"""
