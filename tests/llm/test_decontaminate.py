import duckdb
import pytest

from wirelore.llm import decontaminate as dc

ITEMS = [
    (1, "On Monday Alice Brown bought 12 red apples and 7 green pears for 30 dollars at the old market, then Alice gave 12 apples to her brother."),
    (2, "the quick brown fox jumps over the lazy dog while seven small birds watch from the tall tree nearby"),
    (3, "short item of five words"), (4, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"), (5, None), (5, ""), (None, "an item without an id that nobody can name in a report at all"),
    (6, "On Monday Alice Brown bought 12 red apples and 7 green pears for 30 dollars at the old market, then Alice gave 12 apples to her brother."),
]
CASES = {
    10: ("prose " * 9 + ITEMS[1][1] + " and more prose", {2}), 11: ("nothing to see here " * 20, set()),
    12: (ITEMS[0][1].replace("Alice Brown", "Bertha Stone").replace("Alice", "Bertha").replace("12", "15").replace("30", "44"), {1, 6}),
    13: (ITEMS[0][1].replace("bought 12", "bought 15"), set()),  # 12 becomes 15 in one place only
    14: (ITEMS[0][1].replace("12", "7"), set()),  # two values become one
    15: ("the quick brown fox jumps over the lazy dog", set()),  # too short a part
    16: ("x short item of five words y", {3}), 17: ("1 2 3 4 5 6 7 8 9 10 11 12 13 14 15", set()), 18: (None, set()), 19: ("", set()),
    20: (ITEMS[1][1].upper(), {2}), 21: ("long " * 40_000 + ITEMS[1][1], {2}),
    30: (ITEMS[0][1].upper(), {1, 6}), 31: (ITEMS[0][1].title(), {1, 6}), 32: (ITEMS[0][1].lower(), {1, 6}), 33: (ITEMS[1][1].title(), {2}),
    34: ("so " + ITEMS[0][1].upper().replace("30", "44") + " AND MORE", {1, 6}), 35: (ITEMS[0][1].upper().replace("BOUGHT 12", "BOUGHT 15"), set()),
    36: ("Before " + ITEMS[0][1].lower().replace("alice", "bertha"), {1, 6}),  # no capital tells the other name, but 16 words stand between the two
    22: ("a day at the zoo, " + " ".join(ITEMS[1][1].split()[:14]) + " was a line", {2}),
}


@pytest.fixture
def found(spark, make_docs):
    bench = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, position int")
    return lambda rows: dc.find_leaks(make_docs(rows), bench)


def test_cases(found):
    rows = found([(i, t) for i, (t, _) in CASES.items()]).collect()
    got = {i: {r.item_id for r in rows if r.doc_id == i} for i in CASES}
    assert got == {i: want for i, (_, want) in CASES.items()}
    changed = {r.doc_id: r.changed_slots for r in rows}
    assert changed[12] >= 4 and changed[10] == 0 and all(r.covered <= r.item_tokens for r in rows)


def test_edges(spark, found, odd_rows, make_docs):
    assert found(odd_rows).count() == 0 and found([]).count() == 0
    assert found([(7, ITEMS[1][1]), (7, ITEMS[1][1]), (7, "other text"), (None, ITEMS[1][1])]).count() == 1
    empty = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_leaks(make_docs([(1, ITEMS[1][1])]), empty).count() == 0


def test_a_large_benchmark_is_not_broadcast(found, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    assert {r.item_id for r in found([(1, CASES[12][0])]).collect()} == {1, 6}


def test_same_rows_as_sql(found):
    rows = [(i, t) for i, (t, _) in CASES.items() if i != 21]
    duck = duckdb.connect()
    duck.execute("create table documents (doc_id bigint, text varchar)")
    duck.executemany("insert into documents values (?, ?)", rows)
    duck.execute("create table benchmark (item_id bigint, text varchar)")
    duck.executemany("insert into benchmark values (?, ?)", ITEMS)
    assert sorted(map(tuple, found(rows).collect())) == sorted(duck.execute(dc.LEAKS_SQL).fetchall())


def test_no_python_in_the_plan(found):
    plan = found([(1, "a")])._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
