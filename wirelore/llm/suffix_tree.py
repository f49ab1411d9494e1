"""A probabilistic suffix tree over words, grown level by level as Spark tables.

Words are lower-cased between ASCII white space; every text ends with one end token. Every word counts as itself, with its
exact training count and its smoothed unigram probability at the root. A context of up to ``DEPTH`` words is counted if it
occurs at least ``CONTEXT_LEAST`` times, a successor if it follows its context at least ``SUCCESSOR_LEAST`` times: counts
of occurrences, not shares, so what is learned from a passage does not depend on the size of the rest of the table. A
context stays in the tree if its next-word distribution diverges from that of its own suffix: the leave-one-out
log-likelihood ratio of its occurrences must reach ``GAIN`` each on average, or in total ``GAIN_TOTAL``. Suffixes of what
stays are kept too. Successors are discounted (``DISCOUNT``); what that leaves, and ``BLEND`` more, goes to the parent's
distribution. A text is scored at the longest suffix in the tree.

All counts cover all training documents, and words, contexts and successors stay in tables whose size follows the input.
Occurrences never become rows: a task counts the sequences of a slice of texts as arrays and deals them to buckets by
their hash, one binary row per slice and bucket; a bucket adds up its arrays and hands on the successors that are
frequent enough. Scoring goes the same way: ids to look up are dealt to the buckets of the value table, sums per document
come back to their slice. The number of buckets follows the size of the texts, so a bucket's size does not.
Bounded on driver and tasks are only two aids that change no result: the values of the ``HOT`` most frequent sequences and
``HOT_WORDS`` most frequent words, which need no look-up elsewhere, and a bitmap that spares those of sequences in no table.

Words go by a 64-bit hash of their bytes, sequences by one of their words' hashes; two different ones share theirs with a
chance of about n^2 / 2^65 among n.

Defined results: a null, empty or blank text is the end token alone. A null id counts as training. Repeated rows count and
come back repeatedly; an empty table gives an empty table; without training rows every word is unknown and N, V are 0.
Texts of any length are taken whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tables import Scratch, free_finished, id_and_text, id_bucket

CONTEXT_LEAST = 16
SUCCESSOR_LEAST = 2
DEPTH = 3
GAIN = 0.01
GAIN_TOTAL = 50.0
BLEND = 10.0
DISCOUNT = 0.75
SMOOTH = 0.1
HOT_WORDS, HOT = 1 << 17, 1 << 18  # looked up in the task; all others in their bucket
_SIEVE_BITS, _BLOCK_BITS = 26, 19
_TURN = 21
_END = b"\xff"  # a byte that no text holds
_BITS = 16
_SLICE, _PIECE = 4 << 20, 1 << 15  # characters of text worked on at once, bytes hashed at once
_BUCKET = 1 << 23  # bytes of text per bucket
_ASKED = 4  # of these in one bucket of the look-up: a slice's texts get one row of sums from each
_TABLE_ROWS = 1 << 19  # of the value table, dealt at once

# What a byte counts: one more than its lower-case form, nothing if it is white. The end byte's 256 does not fit in here.
_COUNTS = bytes(0 if b in b" \t\n\v\f\r" else min(b + 33 if 65 <= b < 91 else b + 1, 255) for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, as numbers of 64 bits."""
    out = []
    for base in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))):
        powers = np.full(length, base)
        powers[:1] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


_READY = _powers(2 * _PIECE)


def _hashes(text: bytes) -> np.ndarray:
    """Hash of each word of a text: a polynomial in its lower-cased bytes, mixed.

    Bytes are weighted by their place in the text, and a word's sum is divided by the power of its first place."""
    counts = np.frombuffer(text.translate(_COUNTS), np.uint8)
    inside = counts > 0
    first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(first):
        return np.zeros(0, np.uint64)
    powers, inverse = _READY if len(counts) <= len(_READY[0]) else _powers(len(counts))
    weighted = counts.astype(np.uint64)
    weighted[np.flatnonzero(np.frombuffer(text, np.uint8) == _END[0])] = 256
    weighted *= powers[:len(counts)]
    h = np.add.reduceat(weighted, first) * inverse[first]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


END = _hashes(_END)[0]
END_ID = int(END.view(np.int64))


@dataclass
class Slice:
    """Some texts in a row: their frame without the texts, the hash of each token and its text and place there."""

    frame: pd.DataFrame
    ids: np.ndarray
    own: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, frames: list[pd.DataFrame]) -> Slice:
        frame = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0].reset_index(drop=True)
        pieces, held, size = [], [], 0
        for text in frame["text"]:
            held.append(text.encode("utf-8", "surrogatepass"))
            size += len(held[-1])
            if size >= _PIECE:
                pieces.append(_hashes(b" \xff ".join([*held, b""])))
                held, size = [], 0
        ids = np.concatenate([*pieces, _hashes(b" \xff ".join([*held, b""]))])
        ends = np.flatnonzero(ids == END)
        sizes = np.diff(ends, prepend=-1)
        own = np.repeat(np.arange(len(ends)), sizes)
        place = np.arange(len(ids), dtype=np.int32) - np.repeat((ends + 1 - sizes).astype(np.int32), sizes)
        return cls(frame.drop(columns="text"), ids, own, place)

    def sequences(self, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of the sequences of 1, 2, ... words that end at each token, with the places of those inside their text."""
        out = [(self.ids, np.arange(len(self.ids)))]
        for length in range(2, longest + 1):
            before = np.concatenate([np.zeros(1, np.uint64), out[-1][0][:-1]])
            out.append((_joined(before, self.ids), np.flatnonzero(self.place >= length - 1)))
        return out


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[Slice]:
    frames, size = [], 0
    for batch in batches:
        while len(batch):
            room = np.searchsorted(np.cumsum(batch["text"].str.len().to_numpy()), _SLICE - size) + 1
            frames.append(batch.iloc[:room])
            size += int(frames[-1]["text"].str.len().sum())
            batch = batch.iloc[room:]
            if size >= _SLICE:
                yield Slice.of(frames)
                frames, size = [], 0
    if frames:
        yield Slice.of(frames)


def _joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Id of a sequence and one more word; ``_joined_column`` is the same for columns."""
    return ((context << np.uint64(_TURN)) | (context >> np.uint64(64 - _TURN))) ^ word


def _joined_column(context: str, word: str) -> Column:
    turned = F.shiftleft(context, _TURN).bitwiseOR(F.shiftrightunsigned(context, 64 - _TURN))
    return turned.bitwiseXOR(F.col(word))


def _nearly_sorted(ids: np.ndarray) -> np.ndarray:
    """An order by the leading bits of ids, with their places in the others: one sort of plain numbers, far faster than argsort."""
    low = np.uint64(max(1, len(ids).bit_length()))
    key = (ids >> low << low) | np.arange(len(ids), dtype=np.uint64)
    key.sort()
    return (key & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)


def _sorted(ids: np.ndarray) -> np.ndarray:
    order = _nearly_sorted(ids)
    found = ids[order]
    return order if (found[1:] >= found[:-1]).all() else np.argsort(ids)


def _runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of runs of equal ids."""
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(ids)), bool), ids[1:] != ids[:-1]]))
    return first, np.diff(first, append=len(ids))


def _cuts(ids: np.ndarray, buckets: int) -> np.ndarray:
    """Where ids that are sorted by their leading bits pass from bucket to bucket: buckets are equal ranges of the first 32 bits."""
    edges = np.array([((b << 32) // buckets) << 32 for b in range(1, buckets)], np.uint64)
    ids = ids >> np.uint64(32) << np.uint64(32)
    return np.concatenate([[0], np.searchsorted(ids, edges), [len(ids)]])


_CHUNK = "bucket int, kind int, unit long, a binary, b binary, c binary"


def _gaps(ids: np.ndarray) -> bytes:
    """The differences of nearly sorted ids, all first bytes before all second ones and so on: the leading ones are mostly zero, so files shrink."""
    gaps = np.concatenate([ids[:1], ids[1:] - ids[:-1]])
    return gaps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _of_gaps(raw: bytes) -> np.ndarray:
    gaps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)
    return np.cumsum(gaps, dtype=np.uint64)


def _chunks(buckets: int, kind: int, unit: int, ids: np.ndarray, *columns: np.ndarray, gaps: bool = False) -> pd.DataFrame:
    """One row per bucket that sorted ``ids`` fall into; ``gaps``: the first column, which is the ids, is written as such."""
    cuts = _cuts(ids, buckets)
    used = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
    out = {"bucket": used, "kind": kind, "unit": unit}
    for name, column in zip("abc", columns, strict=False):
        out[name] = [_gaps(part) if gaps and name == "a" else part.tobytes() for part in (column[cuts[b]:cuts[b + 1]] for b in used)]
    return pd.DataFrame({**out, **{x: None for x in "abc" if x not in out}})[["bucket", "kind", "unit", "a", "b", "c"]]


def _grouped(batches: Iterator[pd.DataFrame], by: str) -> Iterator[tuple[int, pd.DataFrame]]:
    """Consecutive rows that share ``by``."""
    held, key = [], None
    for batch in batches:
        for value, rows in batch.groupby(by, sort=True):
            if value != key and held:
                yield key, pd.concat(held, ignore_index=True)
                held = []
            key = value
            held.append(rows)
    if held:
        yield key, pd.concat(held, ignore_index=True)


def _array(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column if x is not None), kind)


def _dealt(chunks: DataFrame, buckets: int, *order: str) -> DataFrame:
    return chunks.repartition(buckets, order[0]).sortWithinPartitions(*order)


def _counted(texts: DataFrame, buckets: int, depth: int, sieve: Broadcast | None, least: int) -> DataFrame:
    """context, word, n of contexts of ``depth`` words that pass the sieve; without a context for depth 0."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _slices(batches):
            ids = part.sequences(depth + 1)
            sequence, inside = ids[depth]
            if depth:
                context = ids[depth - 1][0][inside - 1]
                passed = _passes(sieve.value, context)
                inside, context = inside[passed], context[passed]
            sequence = sequence[inside]
            order = _nearly_sorted(sequence)
            sequence = sequence[order]
            first, n = _runs(sequence)
            found, first = sequence[first], order[first]
            columns = (context[first], part.ids[inside[first]]) if depth else (found, found)
            yield _chunks(buckets, 0, 0, found, *columns, n.astype(np.uint32))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in _grouped(batches, "bucket"):
            context, word, n = _array(rows["a"], np.uint64), _array(rows["b"], np.uint64), _array(rows["c"], np.uint32)
            key = _joined(context, word) if depth else word
            order = _sorted(key)
            first, _ = _runs(key[order])
            total = np.add.reduceat(n[order].astype(np.int64), first)
            kept, total = order[first[total >= least]], total[total >= least]
            yield pd.DataFrame({"context": context[kept].view(np.int64), "word": word[kept].view(np.int64), "n": total})

    chunks = texts.filter("not held_out").select("text").mapInPandas(deal, _CHUNK)
    return _dealt(chunks, buckets, "bucket").mapInPandas(add, "context long, word long, n long")


def _sieve(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed length in which the bit of every id is set; the fuller it is, the more other ids pass.

    Tasks make its blocks; the driver only puts these in a row."""

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = batch["id"].to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - _SIEVE_BITS)
            for block in np.unique(slots >> np.uint64(_BLOCK_BITS)):
                own = slots[slots >> np.uint64(_BLOCK_BITS) == block] & np.uint64((1 << _BLOCK_BITS) - 1)
                blocks.setdefault(int(block), np.zeros(1 << _BLOCK_BITS, bool))[own.astype(np.int64)] = True
        yield pd.DataFrame({"block": list(blocks), "bits": [np.packbits(b, bitorder="little").tobytes() for b in blocks.values()]})

    block = F.shiftrightunsigned("id", 64 - _SIEVE_BITS + _BLOCK_BITS)
    made = ids.select("id").repartition(1 << (_SIEVE_BITS - _BLOCK_BITS - 3), block).mapInPandas(bits, "block long, bits binary")
    out = np.zeros(1 << (_SIEVE_BITS - 6), np.uint64)
    words = 1 << (_BLOCK_BITS - 6)
    for r in made.collect():  # 8 MB in all
        out[r["block"] * words:(r["block"] + 1) * words] = np.frombuffer(r["bits"], np.uint64)
    return out


def _passes(sieve: np.ndarray, ids: np.ndarray) -> np.ndarray:
    slot = ids >> np.uint64(64 - _SIEVE_BITS)
    return (sieve[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _grown(texts: DataFrame, words: DataFrame, buckets: int, depth: int, context_least: int, scratch: Scratch) -> DataFrame:
    """id, value, n, leads (whether it is a context): what a sequence adds to the log10 probability of a text at each of its places.

    A context of the tree hands what it leaves to its suffix's distribution: its value is the log of that share. A counted
    successor has its own probability instead: its value takes the share back and adds the ratio to the suffix's probability.
    So the values of the sequences that end at a place add up to its log-ratio to the root. ``words``: id, n, p of the root."""
    context = texts.sparkSession.sparkContext
    parents = words.select("id", "p")
    contexts = words.filter((F.col("n") >= context_least) & (F.col("id") != END_ID)).select(
        F.col("id").alias("context"), F.lit(0).cast("long").alias("suffix"), F.col("n").alias("total"))
    levels: list[tuple[DataFrame, DataFrame]] = []
    for d in range(1, depth + 1):
        sieve = context.broadcast(_sieve(contexts.select(F.col("context").alias("id"))))
        once = Scratch(texts.sparkSession)
        counted = once.cut(_counted(texts, buckets, d, sieve, SUCCESSOR_LEAST), f"suffix-counts-{d}")
        sieve.destroy()
        free_finished(context)
        left = F.lit(BLEND) + F.col("total") - F.col("kept") + DISCOUNT * F.col("kinds")
        states = contexts.join(counted.groupBy("context").agg(F.sum("n").alias("kept"), F.count(F.lit(1)).alias("kinds")), "context").select(
            "context", "suffix", "total", left.alias("left"))
        # Every successor of a context is a counted one of its suffix, so the join loses no row.
        rows = counted.join(states, "context").withColumn("parent", _joined_column("suffix", "word"))
        rows = rows.join(parents.select(F.col("id").alias("parent"), F.col("p").alias("q")), "parent")
        given, blended = F.col("left") * F.col("q"), F.col("total") + BLEND
        without = (F.greatest(F.col("n") - 1 - DISCOUNT, F.lit(0.0)) + given) / (blended - 1)
        rows = scratch.cut(rows.select(
            _joined_column("context", "word").alias("id"), "context", "parent", (F.col("word") == END_ID).alias("ends"), "n", "q",
            ((F.col("n") - DISCOUNT + given) / blended).alias("p"), (F.col("n") * F.log(without / F.col("q"))).alias("gain")), f"suffix-level-{d}")
        gains = rows.groupBy("context").agg(F.sum("gain").alias("gain"))
        diverges = (F.col("gain") >= GAIN * F.col("total")) | (F.col("gain") >= GAIN_TOTAL)
        states = scratch.cut(states.join(gains, "context").select(
            "context", "suffix", "total", F.log10(F.col("left") / blended).alias("share"), diverges.alias("stays")), f"suffix-states-{d}")
        once.discard()
        free_finished(context)
        levels.append((states, rows))
        parents = rows.select("id", "p")
        contexts = rows.filter((F.col("n") >= context_least) & ~F.col("ends")).select(
            F.col("id").alias("context"), F.col("parent").alias("suffix"), F.col("n").alias("total"))
    parts, needed = [], None
    for states, rows in reversed(levels):
        if needed is None:
            kept = states.filter("stays")
        else:
            kept = states.join(needed, "context", "left").filter("stays or needed")
        # Written, as it is read three times and the next level's is made of it.
        kept = scratch.cut(kept.select("context", "suffix", "total", "share"), "suffix-kept")
        needed = kept.select(F.col("suffix").alias("context")).distinct().withColumn("needed", F.lit(True))
        parts.append(kept.select(F.col("context").alias("id"), F.col("share").alias("value"), F.col("total").alias("n"), F.lit(True).alias("leads")))
        parts.append(rows.join(kept.select("context", "share"), "context").select(
            "id", (F.log10(F.col("p") / F.col("q")) - F.col("share")).alias("value"), "n", F.lit(False).alias("leads")))
    return reduce(DataFrame.unionAll, parts)


def _most_frequent(table: DataFrame, most: int) -> DataFrame:
    """The rows from a count on, at most ``most``: no sort of the table and no merge on the driver."""
    step = F.floor(F.log2("n") * 8)
    least, rows = None, 0
    for r in sorted(table.groupBy(step.alias("step")).count().collect(), reverse=True):
        rows += r["count"]
        if rows > most:
            break
        least = r["step"]
    return table.filter(F.lit(False) if least is None else step >= least)


class Values:
    """Sorted ids with what they add to a text's score, and for words the log10 probability at the root (else NaN)."""

    def __init__(self, ids: np.ndarray, value: np.ndarray, base: np.ndarray) -> None:
        order = _sorted(ids)
        self.ids, self.value, self.base = ids[order], value[order], base[order]

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found) of each id."""
        if not len(self.ids):
            return np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return at, self.ids[at] == ids

    def sums(self, ids: np.ndarray, own: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Per text (value, base, number of words found), and a mask of what was found."""
        at, found = self.find(ids)
        at, own = at[found], own[found]
        base = self.base[at]
        word = ~np.isnan(base)
        return np.stack([
            np.bincount(own, self.value[at], size), np.bincount(own[word], base[word], size), np.bincount(own[word], minlength=size).astype(float)]), found


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All rows of a task as three arrays of bytes: the driver gets some of these and not a row each."""
    rows = [(b["id"].to_numpy(np.int64).tobytes(), b["value"].to_numpy(float).tobytes(), b["base"].to_numpy(float).tobytes()) for b in batches]
    yield pd.DataFrame([[b"".join(x) for x in zip(*rows)] or [b"", b"", b""]], columns=["a", "b", "c"])


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(texts: DataFrame, values: DataFrame, buckets: int, longest: int, unknown: float, tokens: int) -> DataFrame:
    """Look up all sequences of all texts that follow a context of the tree. ``values``: id, value, base, n, leads."""
    context = texts.sparkSession.sparkContext
    frequent = _most_frequent(values.filter("base is not null"), HOT_WORDS).unionAll(_most_frequent(values.filter("base is null"), HOT))
    packed = frequent.select("id", "value", "base").coalesce(8).mapInPandas(_packed, "a binary, b binary, c binary").collect()
    hot = Values(*(np.frombuffer(b"".join(r[name] for r in packed), kind) for name, kind in (("a", np.uint64), ("b", float), ("c", float))))
    shared = context.broadcast((hot, _sieve(values), _sieve(values.filter("leads"))))
    del packed, hot
    free_finished(context, last=True)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums over what is at hand, for the slice's own bucket (kind 1), and ids to look up with their texts (kind 2)."""
        known, sieve, contexts = shared.value
        for part in _slices(batches):
            size = len(part.frame)
            ids, own, before = [], [], None
            for key, inside in part.sequences(longest):
                if before is not None:
                    # A successor of a context, or a context itself.
                    inside = inside[_passes(contexts, before[inside - 1]) | _passes(contexts, key[inside])]
                before, key = key, key[inside]
                maybe = _passes(sieve, key)
                ids.append(key[maybe])
                own.append(part.own[inside[maybe]].astype(np.uint32))
            ids, own = np.concatenate(ids), np.concatenate(own)
            order = _nearly_sorted(ids)
            ids, own = ids[order], own[order]
            total, found = known.sums(ids, own, size)
            ids, own = ids[~found], own[~found]
            unit = int(part.frame["row"].iloc[0])
            # Texts of a slice are numbered in two bytes where that is enough (kind 2), else in four (kind 3).
            kind, own = (2, own.astype(np.uint16)) if size <= 1 << 16 else (3, own)
            yield _chunks(buckets, kind, unit, ids, ids, own, gaps=True)
            ids_of = part.frame["doc_id"]
            facts = np.stack([
                ids_of.fillna(0).to_numpy(np.int64), ids_of.isna().to_numpy(np.int64), part.frame["held_out"].to_numpy(np.int64), np.bincount(part.own, minlength=size)])
            yield pd.DataFrame({"bucket": [unit % buckets], "kind": [1], "unit": [unit], "a": [facts.tobytes()], "b": [total.tobytes()], "c": [None]})

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pd.DataFrame:
            ids, value, base = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = _nearly_sorted(ids)
            return _chunks(buckets, 0, 0, ids[order], ids[order], value[order], base[order], gaps=True)

        for batch in batches:
            held.append((batch["id"].to_numpy(np.int64).view(np.uint64), batch["value"].to_numpy(float), batch["base"].to_numpy(float)))
            if sum(len(x) for x, *_ in held) >= _TABLE_ROWS:
                yield out()
        if held:
            yield out()

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Table rows come first in their bucket; answers are sums per text of the asking slice (kind 2), the rest goes on."""
        known, bucket, held = None, None, []
        for batch in batches:
            for own, rows in batch.groupby("bucket", sort=True):
                if own != bucket:
                    bucket, held, known = own, [], None
                held.append(rows[rows["kind"] == 0])
                asked = rows[rows["kind"] > 0]
                if not len(asked):
                    continue
                if known is None:
                    chunk = pd.concat(held, ignore_index=True)
                    known, held = Values(np.concatenate([np.zeros(0, np.uint64), *map(_of_gaps, chunk["a"])]), _array(chunk["b"], float), _array(chunk["c"], float)), []
                passed = asked[asked["kind"] == 1]
                if len(passed):
                    yield passed[["kind", "unit", "a", "b"]]
                sums_of = []
                for kind, unit, a, b in asked.loc[asked["kind"] > 1, ["kind", "unit", "a", "b"]].itertuples(index=False):
                    ids, own_text = _of_gaps(a), np.frombuffer(b, np.uint16 if kind == 2 else np.uint32).astype(np.int64)
                    places = np.flatnonzero(np.bincount(own_text)).astype(np.uint32)
                    sums, _ = known.sums(ids, own_text, int(places[-1]) + 1)
                    sums_of.append((2, unit, places.tobytes(), sums[:, places].tobytes()))
                if sums_of:
                    yield pd.DataFrame(sums_of, columns=["kind", "unit", "a", "b"])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in _grouped(batches, "unit"):
            own = rows[rows["kind"] == 1].iloc[0]
            facts = np.frombuffer(own["a"], np.int64).reshape(4, -1)
            total = np.frombuffer(own["b"], float).reshape(3, -1).copy()
            for a, b in rows.loc[rows["kind"] == 2, ["a", "b"]].itertuples(index=False):
                total[:, np.frombuffer(a, np.uint32)] += np.frombuffer(b, float).reshape(3, -1)
            value, base, met = total
            size, met = facts[3], met.astype(np.int64)
            base = base + (size - met) * unknown
            ids = pd.array(facts[0], dtype="Int64")
            ids[facts[1] == 1] = pd.NA
            yield pd.DataFrame({
                "doc_id": ids, "held_out": facts[2] == 1, "n_tokens": size, "n_known": met, "train_tokens": tokens, "base_score": base, "score": base + value})

    chunks = texts.select("row", "doc_id", "held_out", "text").mapInPandas(ask, _CHUNK).unionAll(
        values.select("id", "value", "base").mapInPandas(table, _CHUNK))
    answers = _dealt(chunks, buckets, "bucket", "kind").mapInPandas(answer, "kind int, unit long, a binary, b binary")
    return _dealt(answers, buckets, "unit", "kind").mapInPandas(finish, _SCORES)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context_least: int = CONTEXT_LEAST, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    texts = id_and_text(docs, id_col, text_col).withColumn("held_out", id_bucket(F.col("doc_id"), 10) == 0)
    texts = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    buckets = max(1, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // _BUCKET))
    counts = cut_lineage(_counted(texts, buckets, 0, None, 1).select(F.col("word").alias("id"), "n"), "suffix-words")
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, kinds = total["n"] or 0, total["v"]
    smoothed = tokens + SMOOTH * (kinds + 1)
    words = counts.withColumn("p", (F.col("n") + SMOOTH) / smoothed)
    scratch = Scratch(texts.sparkSession)
    grown = _grown(texts, words, buckets, depth, context_least, scratch)
    nothing = F.lit(None).cast("double")
    parts = grown.withColumn("base", nothing).unionByName(words.select("id", nothing.alias("value"), "n", F.lit(False).alias("leads"), F.log10("p").alias("base")))
    values = cut_lineage(parts.groupBy("id").agg(
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"), F.max("base").alias("base"), F.max("n").alias("n"), F.max("leads").alias("leads")), "suffix-values")
    scratch.discard()
    free_finished(texts.sparkSession.sparkContext)
    return _scored(texts, values, -(-buckets // _ASKED), depth + 1, float(np.log10(SMOOTH / smoothed)), tokens)


# The same tree in memory, over a small alphabet of numbered symbols: what the tables above are tested against.


def _keys(symbols: np.ndarray, depth: int) -> np.ndarray:
    """For each position from ``depth`` on: the ``depth`` symbols before it and the one there, 16 bits each."""
    n = len(symbols) - depth
    key = np.zeros(max(0, n), np.uint64)
    for i in range(depth + 1):
        key = (key << np.uint64(_BITS)) | symbols[i:i + max(0, n)].astype(np.uint64)
    return key


@dataclass(frozen=True)
class Level:
    """States of one depth: sorted contexts with their counts and what they leave to the parent; sorted (context, next) keys with counts."""

    contexts: np.ndarray
    totals: np.ndarray
    left: np.ndarray
    keys: np.ndarray
    counts: np.ndarray

    def find(self, context: np.ndarray) -> np.ndarray:
        """Index of each context, -1 where it is no state."""
        if not len(self.contexts):
            return np.full(len(context), -1)
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        return np.where(self.contexts[at] == context, at, -1)

    def count(self, key: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(key))
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.counts[at], 0).astype(float)


@dataclass(frozen=True)
class Tree:
    root: np.ndarray
    levels: list[Level]

    def probability(self, history: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Of each symbol after its history (``DEPTH`` symbols as one number; positions before the text hold no state)."""
        p = self.root[symbol.astype(np.int64)]
        alive = np.ones(len(symbol), bool)
        for d, level in enumerate(self.levels, 1):
            context = history & np.uint64((1 << (_BITS * d)) - 1)
            at = level.find(context)
            alive &= at >= 0
            if not alive.any():
                break
            c = level.count((context[alive] << np.uint64(_BITS)) | symbol[alive].astype(np.uint64))
            p[alive] = (np.maximum(c - DISCOUNT, 0) + level.left[at[alive]] * p[alive]) / (level.totals[at[alive]] + BLEND)
        return p


def _tables(counted: list[pd.DataFrame], symbol_counts: np.ndarray) -> list[Level]:
    levels: list[Level] = []
    for frame in counted:
        keys, n = frame["key"].to_numpy(np.int64).view(np.uint64), frame["n"].to_numpy(np.int64)
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        contexts, start = np.unique(keys >> np.uint64(_BITS), return_index=True)
        kept = np.add.reduceat(n, start) if len(n) else n
        kinds = np.diff(np.append(start, len(n)))
        # A context is counted as a sequence one level up; every sequence has a next symbol, as the end is in no context.
        totals = levels[-1].count(contexts) if levels else symbol_counts[contexts.astype(np.int64)].astype(float)
        levels.append(Level(contexts, totals, BLEND + totals - kept + DISCOUNT * kinds, keys, n))
    return levels


def grow(root: np.ndarray, symbol_counts: np.ndarray, counted: list[pd.DataFrame], gain: float = GAIN, gain_total: float = GAIN_TOTAL) -> Tree:
    """Keep the contexts whose distribution diverges from their suffix's, and the suffixes of these."""
    levels, kept = _tables(counted, symbol_counts), []
    parents = Tree(root, [])
    for level in levels:
        # The parent of every context is the tree of all shallower counted contexts.
        p = parents.probability(level.keys >> np.uint64(_BITS), level.keys & np.uint64((1 << _BITS) - 1))
        place = np.searchsorted(level.contexts, level.keys >> np.uint64(_BITS))
        without = (np.maximum(level.counts - 1 - DISCOUNT, 0) + level.left[place] * p) / (level.totals[place] - 1 + BLEND)
        divergence = np.bincount(place, level.counts * np.log(without / p), len(level.contexts))
        kept.append((divergence >= gain * level.totals) | (divergence >= gain_total))
        parents = Tree(root, [*parents.levels, level])
    for d in range(len(levels) - 1, 0, -1):
        suffix = levels[d].contexts[kept[d]] & np.uint64((1 << (_BITS * d)) - 1)
        at = levels[d - 1].find(suffix)
        kept[d - 1][at[at >= 0]] = True
    out = []
    for level, keep in zip(levels, kept, strict=True):
        rows = keep[np.searchsorted(level.contexts, level.keys >> np.uint64(_BITS))] if len(level.keys) else np.zeros(0, bool)
        out.append(Level(level.contexts[keep], level.totals[keep], level.left[keep], level.keys[rows], level.counts[rows]))
    return Tree(root, out)
