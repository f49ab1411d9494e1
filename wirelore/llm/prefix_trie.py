"""Prefix trie of conversations: double-array tries over prefix shards.

Every turn (role, text) is a 128-bit digest with its length; a conversation is the array of its turns. Equal
conversations are one sequence with a count. The distinct sequences are sorted and cut by range, so a shard holds all
sequences between two prefixes however popular a first turn is; tasks cut their ranges again at ``CELLS`` turns. In a
shard the turns get dense ids and the sequences a double-array trie: the child of state ``s`` by turn ``c`` is state
``t = BASE[s] + c`` if ``CHECK[t] = s``. Sequences are traversed through BASE and CHECK to count members, and states
in order of depth pass leaves and saved tokens up along CHECK.

Only prefixes of a shard's first and last sequence can occur in other shards. Their partial aggregates are summed up
by a chained digest of the prefix. What neighbouring shards both count (a shared node's one copy too many in
``n - 1``, a shared child, a leaf that goes on in the next shard) depends on the last sequence of one and the first of
the next alone and is added as a correction row, so no task ever walks the upper trie as a whole.

The digest of all ids that end at a node is a stream over (sequence, id) in order, in bounded memory; SHA-256 can't be
worked out in parts, so a sequence that a third of all conversations share is one long stream of ids. A conversation is
one cell of 24 bytes a turn; its texts are read once and never shuffled.

Defined results: rows are ordered by turn (null first), equal turns by the digest of role and text; null role or text
is empty; rows without conversation id belong to no conversation and are left out; ``conv_id % 100`` keeps the
sign of the id, as in SQL; an empty table has no nodes, not even a root; repeated rows are turns of their own; other
columns are ignored, whatever their names. Turns are equal when their 128-bit digests are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tables import small_batches

#: Turns per trie: the memory of a task. Bytes of a turn's digest; each is followed by eight bytes of length.
CELLS, DIGEST, TURN = 1 << 18, 16, 24
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _turn_cell(role: Column, text: Column) -> Column:
    """24 bytes: the digest of (role, text) and the length of the text in code points."""
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    return F.unhex(F.concat(digest, F.lpad(F.hex(F.length(text).cast("long")), 16, "0")))


def conversation_turns(turns: DataFrame) -> DataFrame:
    """conv_id and the array of its turn cells, in order."""
    role, text = (F.coalesce(turns[c], F.lit("")) for c in ("role", "text"))
    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), _turn_cell(role, text).alias("cell"))
    own = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "cell"))).alias("turns"))
    # array_sort puts a null field first, as the order by turn asks.
    return own.select("conv_id", F.transform("turns", lambda t: t.cell).alias("cells"))


def rebuild(conversations: DataFrame) -> DataFrame:
    """The contract's rebuilding: the first h turns of conversation c - c % 100, then c's own behind its first h."""
    conversations = cut_lineage(conversations, "trie-turns")
    heads = conversations.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("cells", 1, 5).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    joined = conversations.withColumn("base", F.expr("conv_id - conv_id % 100")).join(heads, "base", "left").withColumn("h", h)
    own = F.slice("cells", F.col("h") + 1, F.greatest(F.size("cells"), F.lit(1)))
    return joined.select("conv_id", F.concat(F.when(F.col("head").isNull(), F.expr("slice(cells, 1, 0)")).otherwise(F.slice("head", F.lit(1), F.col("h"))), own).alias("cells"))


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sequence key, id) in order -> smallest id, count and SHA-256 of the ids joined by commas, per key."""
    schema = pa.schema([("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])
    key = least = sha = None
    n = 0
    for batch in batches:
        out = []
        for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if k == key:
                n += 1
                sha.update(b",%d" % c)
                continue
            if key is not None:
                out.append({"conv_id": least, "n": n, "ends": sha.hexdigest()})
            key, least, n, sha = k, c, 1, hashlib.sha256(b"%d" % c)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if key is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": least, "n": n, "ends": sha.hexdigest()}], schema)


def distinct_sequences(rebuilt: DataFrame) -> DataFrame:
    """conv_id (the smallest), n, ends and cells of every distinct sequence."""
    rebuilt = cut_lineage(rebuilt, "trie-rebuilt")
    keys = rebuilt.select("conv_id", F.sha2(F.concat_ws("", F.transform("cells", F.hex)), 256).alias("key"))
    ends = keys.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_end_digests, "conv_id long, n long, ends string")
    return ends.join(rebuilt, "conv_id")


class DoubleArray:
    """A trie over sorted, distinct sequences of dense ids, packed into BASE and CHECK.

    ``base`` may be negative; a state is an index into the arrays, the root is 0. ``least`` is the first cell that
    may be free.
    """

    def __init__(self, sequences: list[list[int]]) -> None:
        self.base, self.check, self.least = [0], [0], 1  # the root is its own parent
        self.order = [0]  # states, parents first
        self._pack(sequences)

    def _free(self, cell: int) -> bool:
        return cell > 0 and (cell >= len(self.check) or self.check[cell] < 0)

    def _place(self, ids: list[int]) -> int:
        """A base that puts all ids on free cells: the first that fits among the next 64, else behind the array."""
        low, span, check = ids[0], ids[-1] - ids[0], self.check
        for cell in range(self.least, min(self.least + 64, len(check))):
            if check[cell] < 0 and all(self._free(cell + i - low) for i in ids[1:]):
                break
        else:
            cell = len(check)
        grow = cell + span + 1 - len(check)
        if grow > 0:
            check.extend([-1] * grow)
            self.base.extend([0] * grow)
        return cell - low

    def _pack(self, sequences: list[list[int]]) -> None:
        # (state, first and one past the last sequence, depth): the sequences share their first ``depth`` ids.
        todo = [(0, 0, len(sequences), 0)]
        while todo:
            state, low, high, depth = todo.pop()
            while low < high and len(sequences[low]) == depth:
                low += 1
            runs = []
            while low < high:
                turn, end = sequences[low][depth], low + 1
                if sequences[high - 1][depth] == turn:
                    end = high
                else:
                    while end < high and sequences[end][depth] == turn:
                        end += 1
                runs.append((turn, low, end))
                low = end
            if not runs:
                continue
            self.base[state] = base = self._place(sorted(r[0] for r in runs))
            for turn, first, end in runs:
                child = base + turn
                self.check[child] = state
                self.order.append(child)
                todo.append((child, first, end, depth + 1))
            while self.least < len(self.check) and self.check[self.least] >= 0:
                self.least += 1

    def step(self, state: int, turn: int) -> int:
        """The child, or -1."""
        child = self.base[state] + turn
        return child if 0 < child < len(self.check) and self.check[child] == state else -1


def _chain(cells: list[bytes]) -> list[bytes]:
    """Keys of all prefixes, the empty one first."""
    keys = [b""]
    for cell in cells:
        keys.append(hashlib.sha256(keys[-1] + cell).digest()[:DIGEST])
    return keys


def _length(cell: bytes) -> int:
    return int.from_bytes(cell[DIGEST:], "big")


Sequence = tuple[int, int, str, list[bytes]]
Node = tuple  # a row of NODES

#: ``key`` is set on nodes that other shards may have too, ``parent_key`` where the parent is such a node.
FIELDS = [
    ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()),
    ("edge", pa.int64()), ("cells", pa.list_(pa.binary()))]
NODES = pa.schema(FIELDS)
NODES_DDL = ("key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
             "saved_tokens long, ends string, edge long, cells array<binary>")


def shard_nodes(sequences: list[Sequence]) -> list[Node]:
    """Nodes of one shard from its sorted, distinct (conv_id, n, ends, cells)."""
    dense: dict[bytes, int] = {}
    ids = [[dense.setdefault(c, len(dense)) for c in cells] for *_, cells in sequences]
    lengths = [_length(c) for c in dense]
    trie = DoubleArray(ids)
    size = len(trie.check)
    members, least, depth, saved, leaves, children = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size, [0] * size
    ends: dict[int, str] = {}
    last_turn = [0] * size
    for (conv, n, digest, _), own in zip(sequences, ids):
        state, level = 0, 0
        members[0] += n
        least[0] = conv if least[0] is None or conv < least[0] else least[0]
        for turn in own:
            state, level = trie.step(state, turn), level + 1
            members[state] += n
            if least[state] is None:
                least[state], depth[state], last_turn[state] = conv, level, lengths[turn]
            elif conv < least[state]:
                least[state] = conv
        ends[state] = digest
    for state in reversed(trie.order):  # children before parents
        leaves[state] = leaves[state] or 1
        saved[state] += (members[state] - 1) * last_turn[state] if state else 0
        if state:
            parent = trie.check[state]
            leaves[parent] += leaves[state]
            saved[parent] += saved[state]
            children[parent] += 1
    open_keys = {}
    for which in (0, -1):
        state = 0
        keys = _chain(sequences[which][3])
        open_keys[0] = keys[0]
        for turn, key in zip(ids[which], keys[1:]):
            state = trie.step(state, turn)
            open_keys[state] = key
    rows = []
    for state in trie.order:
        parent = trie.check[state] if state else None
        parent_key = open_keys.get(parent) if state else None
        above = None if parent is None or parent_key is not None else least[parent]
        rows.append((open_keys.get(state), parent_key, least[state], depth[state], above, members[state], children[state], leaves[state],
                     saved[state], ends.get(state), None, None))
    return rows


def corrections(before: list[bytes], after: list[bytes]) -> list[Node]:
    """What the shards of two neighbouring sequences both count at the prefixes that they share."""
    shared = 0
    while shared < min(len(before), len(after)) and before[shared] == after[shared]:
        shared += 1
    keys, more, rows = _chain(before[:shared]), 0, []
    for level in range(shared, -1, -1):
        more += _length(before[level - 1]) if level else 0
        # The two shards count n - 1 each, so a text less is missing; a shared child is counted twice; the end of
        # ``before`` is no leaf if ``after`` goes on from it.
        rows.append((keys[level], keys[level - 1] if level else None, None, level, None, 0, -1 if level < shared else 0,
                     -1 if shared == len(before) else 0, more, None, None, None))
    return rows


def _batch(rows: list[Node]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, (_, kind) in zip(zip(*rows), FIELDS)], schema=NODES)


def _tries(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[Sequence] = []
        turns, first, last = 0, None, None
        task = None

        for batch in batches:
            for conv, n, ends, cells, part in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n", "ends", "cells", "part"))):
                if turns >= limit:
                    yield _batch(shard_nodes(shard) + corrections(last, cells))
                    shard, turns = [], 0
                if first is None:
                    first, task = cells, part
                shard.append((conv, n, ends, cells))
                turns, last = turns + 1 + len(cells), cells
        if shard:
            # The ends of the task's range go along: its neighbours are other tasks.
            yield _batch(shard_nodes(shard) + [(*[None] * 10, 2 * task + side, c) for side, c in enumerate((first, last))])

    return run


def _edge_corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [x for pair in zip(batch.column("before").to_pylist(), batch.column("cells").to_pylist()) for x in corrections(*pair)]
        if rows:
            yield _batch(rows)


def trie_nodes(sequences: DataFrame, cells: int = CELLS) -> DataFrame:
    """Nodes of the trie of all distinct sequences (conv_id, n, ends, cells). ``cells`` is the size of a shard in turns."""
    small_batches(sequences.sparkSession)
    ranges = sequences.repartitionByRange("cells").sortWithinPartitions("cells").withColumn("part", F.spark_partition_id().cast("long"))
    made = cut_lineage(ranges.mapInArrow(_tries(cells), NODES_DDL), "trie-nodes")
    # Two rows a task; the window over them all sees as many rows as there are tasks.
    edges = made.filter("edge is not null").select("edge", "cells")
    pairs = edges.withColumn("before", F.lag("cells").over(W.orderBy("edge"))).filter("edge % 2 = 0 and before is not null")
    fixes = pairs.select("before", "cells").mapInArrow(_edge_corrections, NODES_DDL)
    shared = made.filter("edge is null and key is not null").unionByName(fixes)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    upper = cut_lineage(shared.groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *sums, F.max("ends").alias("ends")), "trie-upper")
    parents = upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("upper_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")]
    lower = made.filter("edge is null and key is null")
    joined = lower.filter("parent_key is not null").drop("key", "edge", "cells", "parent_conv_id").unionByName(upper.drop("key"))
    joined = joined.join(parents, "parent_key", "left").withColumnRenamed("upper_conv_id", "parent_conv_id")
    return lower.filter("parent_key is null").select(*columns).unionByName(joined.select(*columns))


def conversation_trie(turns: DataFrame, cells: int = CELLS) -> DataFrame:
    """The prefix trie of the conversations as they are."""
    small_batches(turns.sparkSession)
    return trie_nodes(distinct_sequences(conversation_turns(turns)), cells)


def rebuilt_trie(turns: DataFrame, cells: int = CELLS) -> DataFrame:
    """The prefix trie of the rebuilt conversations."""
    small_batches(turns.sparkSession)
    return trie_nodes(distinct_sequences(rebuild(conversation_turns(turns))), cells)


#: All prefixes written out and joined with each other, in DuckDB.
TRIE_SQL = """
    with crc as materialized (
        select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: case when (c & 1) = 1 then xor(3988292384, c >> 1) else c >> 1 end, b)) as tab),
    cells as (
        select conv_id, turn, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) as cell from conversations where conv_id is not null),
    convs as materialized (
        select conv_id, list(cell order by turn nulls first, substr(sha256(length(cell.role) || ':' || cell.role || cell.text), 1, 32)) as own, conv_id::varchar as name from cells group by conv_id),
    cut as (
        select *, xor(4294967295, list_reduce(list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i::bigint, 1))::bigint),
            lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8), 4294967295)) % 6 as h from convs, crc),
    rebuilt as materialized (
        select c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) as turns from cut c left join convs b on b.conv_id = c.conv_id - c.conv_id % 100),
    prefixes as materialized (select conv_id, d, turns[1:d] as prefix, len(turns) = d as ends from (select *, unnest(range(0, len(turns) + 1)) as d from rebuilt)),
    nodes as materialized (
        select d, prefix, min(conv_id) as conv_id, count(*) as n,
            sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
        from prefixes group by d, prefix),
    named as materialized (
        select a.*, p.conv_id as parent_conv_id, (select count(*) from nodes c where c.d = a.d + 1 and c.prefix[1:a.d] = a.prefix) as kids
        from nodes a left join nodes p on p.d = a.d - 1 and p.prefix = a.prefix[1:a.d - 1]),
    below as (
        select a.d, a.prefix, count(*) filter (b.kids = 0) as n_leaves, sum(case when b.d = 0 then 0 else (b.n - 1) * length(b.prefix[b.d].text) end) as saved
        from named a join named b on b.d >= a.d and b.prefix[1:a.d] = a.prefix group by a.d, a.prefix)
    select n.conv_id, n.d::bigint as depth, n.parent_conv_id, n.n::bigint as n_convs, n.kids::bigint as n_children, b.n_leaves::bigint as n_leaves,
        b.saved::bigint as saved_tokens, n.ends_sha256
    from named n join below b on b.d = n.d and b.prefix = n.prefix"""
