import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from wirelore.llm import mixture_shards as ms


def plain(rows, shards, seed=0):
    """(doc_id, text, source) rows -> Counter of (doc_id, size, crc, shard, slot), by sorting everything."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    by = defaultdict(list)
    for i, t, s in rows:
        by["" if s is None else "=" + s].append((md5(f"{seed}:{'' if i is None else i}:{md5(t or '')}"), i, t or ""))
    every = []
    for s, own in by.items():
        phase = int(md5(f"{seed}:{s}")[:8], 16) / 2**32
        own.sort(key=lambda x: (x[0], x[1] if x[1] is not None else -1))
        every += [((k + phase) / len(own), s, k, i, t) for k, (_, i, t) in enumerate(own)]
    every.sort(key=lambda x: x[:3])
    out, n = [], len(every)
    for p, (_, _, _, i, t) in enumerate(every):
        shard = p * shards // n
        out.append((i, len(t.encode()) + 16, zlib.crc32(t.encode()), shard, p - -(-shard * n // shards)))
    return Counter(out)


def test_equals_a_plain_sort_and_holds_the_mixture(spark):
    rows = [(i, f"text {i} é" * (i % 7), ["a", "a", "a", "b", "c", None, ""][i % 7]) for i in range(900)]
    rows += [(5000, "copy", "a")] * 400 + [(None, "x", "b")] * 3 + [(None, None, "c"), (6000 + 1, None, "c"), (7000, "one", "alone")]
    docs = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "doc_id long, text string, source string, rank int, slice int, size string")
    got = ms.assign_shards(docs, 40).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got) == plain(rows, 40)
    counts = Counter(r.shard for r in got)
    assert len(counts) == 40 and max(counts.values()) - min(counts.values()) <= 1
    for s, n in Counter("" if x[2] is None else "=" + x[2] for x in rows).items():
        own = Counter(r.shard for r in got if r.source_key == s)
        assert all(abs(own[k] - n / 40) <= 2 for k in range(40)), s
    for k in range(40):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(counts[k]))
    assert [r.asDict() for r in ms.digest(ms.assign_shards(docs, 40)).sort("shard", "slot").collect()] == [
        r.asDict() for r in ms.digest(ms.assign_shards(docs.repartition(7), 40)).sort("shard", "slot").collect()]


def test_seed_moves_rows(spark):
    docs = spark.createDataFrame([(i, str(i), "s") for i in range(200)], "doc_id long, text string, source string")
    a, b = ({r.doc_id: (r.shard, r.slot) for r in ms.assign_shards(docs, 4, seed).collect()} for seed in (0, 1))
    assert a != b and sorted(a.values()) == sorted(b.values())


def test_few_rows_and_none(spark, odd_docs, odd_rows):
    got = ms.digest(ms.assign_shards(odd_docs, 40)).collect()
    want = plain([(i, t, "s") for i, t in odd_rows], 40)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got) == want
    empty = ms.digest(ms.assign_shards(odd_docs.limit(0), 40))
    assert empty.collect() == [] and empty.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    with pytest.raises(ValueError):
        ms.assign_shards(odd_docs, 0)


def test_written_shards(spark, tmp_path, odd_docs, odd_rows):
    ms.write_shards(odd_docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter((r.doc_id, r.text or "") for r in back) == Counter((i, t or "") for i, t in odd_rows)
    assert len({(r.shard, r.slot) for r in back}) == len(odd_rows)
