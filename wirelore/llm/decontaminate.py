"""Benchmark leaks by template windows, with DataFrame functions only.

Words become a template: numbers, names (capitalised inside a sentence) and units after a number turn into typed
placeholders. Windows of ``WINDOW`` template words of all documents are hash-joined with those of the benchmark, so
a question with other numbers or names still meets its original. As capitals tell names, every text is also read plainly,
names as lower-case words: so an item is found whatever the letter case of its copy. Matches of a document and an item at one
shift are put together, each reading apart; the words under them are compared again, and the placeholders must be filled
consistently: an item's value always becomes the same value, and two values never become one. An item is found if its
matches cover ``LEAST`` of its words in one reading, or all of a shorter item.

Defined results: a null, empty or wordless text matches nothing, nor does a row with a null id. Windows with fewer than
four plain words are not searched, so neither are items without any other window (a row of numbers says nothing). Items
shorter than a window are searched whole. Long texts are read whole. Repeated rows and repeated items give one row per
document id and item id (the longest cover, then the smallest shift, then the longest item and the most slots and changed
slots); rows that repeat an id are each compared by their own text. Empty tables give an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
LEAST = 13
PLAIN = 4
BROADCAST_ROWS = 300_000
NUMBER, NAME, UNIT = "<n>", "<name>", "<unit>"
_MARK = "\u0001"

# Units that count as such after a number.
UNITS = tuple("""
    mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres
    mg g kg lb lbs oz ton tons gram grams kilogram kilograms pound pounds ounce ounces ml l liter liters litre litres gallon gallons
    s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
    dollar dollars euro euros cent cents usd eur percent pct degree degrees c f k j w kw v hz kb mb gb tb
""".split())


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits; a mark stands before names. Digits of one number stay together."""
    marked = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _MARK, ""), r"([\p{Ll}\p{N},;:]) (\p{Lu})", f"$1 {_MARK}$2")
    joined = F.regexp_replace(marked, r"([0-9])[.,]([0-9])", "$1$2")
    return F.array_remove(F.split(F.lower(joined), rf"[^\p{{L}}\p{{N}}{_MARK}]+"), "")


def _numeric(word: Column) -> Column:
    return (word >= "0") & (word < ":")


def _bare(word: Column) -> Column:
    return F.when(word.startswith(_MARK), F.substring(word, 2, 1 << 30)).otherwise(word)


def _typed(words: Column, named: bool) -> Callable[[Column, Column], Column]:
    """The template word at a place; ``words`` must be a plain column, as it is looked up for every word."""

    def word_at(word: Column, i: Column) -> Column:
        after_number = (i > 0) & _numeric(F.get(words, i - 1))
        typed = F.when(_numeric(word), NUMBER)
        if named:
            return typed.when(word.startswith(_MARK), NAME).when(after_number & word.isin(*UNITS), UNIT).otherwise(word)
        return typed.when(after_number & _bare(word).isin(*UNITS), UNIT).otherwise(_bare(word))

    return word_at


def template_of(words: Column, named: bool = True) -> Column:
    """The template of a text in its typed reading, or in its plain one, where names are words."""
    return F.transform(words, _typed(words, named))


def _half(size: int) -> int:
    return 1 << ((size - 1).bit_length() - 1)


def _hash_of(window: Column, size: int, at: int = 0) -> Column:
    """Hash of a window: of the hashes of its two parts, down to words."""
    if size == 1:
        return F.xxhash64(F.get(window, at))
    return F.xxhash64(_hash_of(window, _half(size), at), _hash_of(window, size - _half(size), at + _half(size)))


def _with_hashes(df: DataFrame, name: str, size: int) -> DataFrame:
    """``df`` with the hashes of all windows of a size, made of those of its parts: two look-ups a window. ``name``1: hashes of words."""
    target, half = f"{name}{size}", _half(size) if size > 1 else 0
    if target in df.columns:
        return df
    df = _with_hashes(_with_hashes(df, name, half), name, size - half)
    left, right, last = F.col(f"{name}{half}"), F.col(f"{name}{size - half}"), F.size(f"{name}1") - size
    return df.withColumn(target, F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(left, i), F.get(right, i + half)))))


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, item_words (without marks), reading (0 typed, 1 plain), item_template, item_tokens."""
    items = benchmark.select(benchmark[id_col].cast("long").alias("item_id"), words_of(benchmark[text_col]).alias("words")).filter("item_id is not null").distinct()
    readings = F.array(*[F.struct(F.lit(r).alias("reading"), template_of(F.col("words"), not r).alias("template")) for r in (0, 1)])
    return items.select(
        "item_id", F.transform("words", _bare).alias("item_words"), F.size("words").cast("long").alias("item_tokens"), F.explode(readings).alias("r")).select(
        "item_id", "item_words", "item_tokens", F.col("r.reading").alias("reading"), F.col("r.template").alias("item_template"))


def item_windows(items: DataFrame, size: int, whole: bool) -> DataFrame:
    """hash, size, item_id, reading, item_position of the windows of one size; ``whole``: only of items that are just as long."""
    plain = lambda w: F.size(F.filter(w, lambda x: ~x.startswith("<"))) >= min(PLAIN, size)
    rows = items.filter(F.col("item_tokens") == size) if whole else items
    rows = rows.select("item_id", "reading", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("item_template") - size + 1)), lambda i: F.slice("item_template", i, size))).alias("item_position", "w"))
    return rows.filter((F.size("w") == size) & plain(F.col("w"))).select(
        _hash_of(F.col("w"), size).alias("hash"), F.lit(size).alias("size"), "item_id", "reading", "item_position").distinct()


def _matches(texts: DataFrame, items: DataFrame, sizes: list[int]) -> DataFrame:
    """Windows of the documents, of the first size and of items as short as the others, that meet one of the benchmark."""
    windows = reduce(DataFrame.unionAll, [item_windows(items, n, n != sizes[0]) for n in sizes])
    # The benchmark is small as a rule: its size decides, and a larger one is joined by a shuffle.
    if windows.count() <= BROADCAST_ROWS:
        windows = F.broadcast(windows)
    words = texts.select("doc_id", words_of(F.col("text")).alias("words"))
    word_hashes = lambda named: F.transform("words", lambda w, i: F.xxhash64(_typed(F.col("words"), named)(w, i)))
    marked = F.exists("words", lambda w: w.startswith(_MARK))
    hashed = words.select("doc_id", word_hashes(True).alias("t1"), F.when(marked, word_hashes(False)).alias("p1"))
    for n in sizes:
        hashed = _with_hashes(_with_hashes(hashed, "t", n), "p", n)
    # The plain reading is searched apart only where it differs: elsewhere the typed window stands for both.
    differing = lambda n: F.transform(f"p{n}", lambda x, i: F.when(x != F.get(F.col(f"t{n}"), i), x))
    # An array made here is exploded, not a computed column: Spark would filter that by its size first, and work the hashes out anew.
    lists = F.array(*[x for n in sizes for x in (F.col(f"t{n}"), differing(n))])
    hashed = hashed.select("doc_id", F.posexplode(lists).alias("list", "hashes")).select("doc_id", "list", F.posexplode("hashes").alias("position", "hash"))
    found = hashed.join(windows, "hash").filter((F.get(F.array(*[F.lit(n) for n in sizes]), F.floor(F.col("list") / 2).cast("int")) == F.col("size")) & (F.col("list") % 2 <= F.col("reading")))
    return found.select("doc_id", "item_id", "reading", (F.col("position") - F.col("item_position")).alias("shift"), "item_position", "size")


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start (word of the document, from 0), covered, item_tokens, slots and changed_slots of every leak."""
    items = _items(benchmark, item_id_col, item_text_col)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).filter("doc_id is not null")
    short = items.filter((F.col("item_tokens") < window) & (F.col("item_tokens") > 0)).select(F.col("item_tokens").alias("n")).distinct().collect()
    matches = _matches(texts, items, [window, *sorted(r["n"] for r in short)])

    # Word places of the item under the matches of one shift.
    places = matches.groupBy("doc_id", "item_id", "reading", "shift").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("item_position", F.col("item_position") + F.col("size") - 1))))).alias("places"))
    candidates = places.join(items, ["item_id", "reading"]).filter(F.size("places") >= F.least(F.lit(least), F.col("item_tokens")))

    suspects = texts.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", words_of(F.col("text")).alias("marked"))
    suspects = suspects.select(
        "doc_id", F.transform("marked", _bare).alias("words"), template_of(F.col("marked")).alias("typed"), template_of(F.col("marked"), False).alias("plain"))
    aligned = suspects.join(candidates, "doc_id").withColumn("template", F.when(F.col("reading") == 0, F.col("typed")).otherwise(F.col("plain")))
    here = lambda p: F.get("words", p + F.col("shift"))
    equal = F.forall("places", lambda p: F.coalesce(F.get("template", p + F.col("shift")) == F.get("item_template", p), F.lit(False)))
    slots = F.transform(
        F.filter("places", lambda p: F.get("item_template", p).isin(NUMBER, NAME, UNIT)), lambda p: F.struct(F.get("item_words", p).alias("old"), here(p).alias("new")))
    aligned = aligned.filter(equal).withColumn("all_slots", slots).withColumn("slots", F.array_distinct("all_slots"))
    # Consistent: as many distinct pairs as distinct old values, and as distinct new ones.
    pairs = F.size("slots")
    kept = aligned.filter((pairs == F.size(F.array_distinct("slots.old"))) & (pairs == F.size(F.array_distinct("slots.new"))))
    row = F.struct(
        F.size("places").cast("long").alias("covered"), (-F.col("shift")).cast("long").alias("minus_shift"), F.col("item_tokens"),
        F.size("all_slots").cast("long").alias("slots"), F.size(F.filter("all_slots", lambda s: s["old"] != s["new"])).cast("long").alias("changed_slots"))
    best = kept.groupBy("doc_id", "item_id").agg(F.max(row).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.minus_shift")).alias("start"), "best.covered", "best.item_tokens", "best.slots", "best.changed_slots")


def _sql_words(text: str) -> str:
    return rf"""list_filter(string_split_regex(lower(regexp_replace(regexp_replace(replace(coalesce({text}, ''), chr(1), ''),
            '([\p{{Ll}}\p{{N}},;:]) (\p{{Lu}})', '\1 ' || chr(1) || '\2', 'g'), '([0-9])[.,]([0-9])', '\1\2', 'g')), '[^\p{{L}}\p{{N}}\x01]+'), lambda w: w <> '')"""


def _sql_template(words: str) -> str:
    units = ", ".join(f"'{u}'" for u in UNITS)
    return f"""list_transform({words}, lambda w, i: case when w >= '0' and w < ':' then '{NUMBER}' when starts_with(w, chr(1)) then '{NAME}'
            when i > 1 and {words}[i - 1] >= '0' and {words}[i - 1] < ':' and w in ({units}) then '{UNIT}' else w end)"""


#: The same rows for DuckDB. Reading 0 has names; reading 1 is the same text with the marks before names taken out.
LEAKS_SQL = f"""
    with item_words as (select distinct item_id::bigint as item_id, {_sql_words('text')} as marked from benchmark where item_id is not null),
    item_readings as (select *, unnest([0, 1]) as reading, list_transform(marked, lambda w: replace(w, chr(1), '')) as words from item_words),
    item_said as (select *, case when reading = 0 then marked else words end as said, len(words)::bigint as item_tokens from item_readings),
    items as (select *, {_sql_template('said')} as template from item_said),
    doc_words as (select doc_id::bigint as doc_id, row_number() over () as row, {_sql_words('text')} as marked from documents where doc_id is not null),
    doc_readings as (select *, unnest([0, 1]) as reading, list_transform(marked, lambda w: replace(w, chr(1), '')) as words from doc_words),
    doc_said as (select *, case when reading = 0 then marked else words end as said from doc_readings),
    docs as (select *, {_sql_template('said')} as template from doc_said),
    item_starts as (select *, unnest(range(0, greatest(1, item_tokens - {WINDOW} + 1))) as item_position, least({WINDOW}, item_tokens) as size from items where item_tokens > 0),
    item_windows as (
        select distinct item_id, reading, item_position, size, array_to_string(template[item_position + 1:item_position + size], ' ') as key from item_starts
        where len(list_filter(template[item_position + 1:item_position + size], lambda x: not starts_with(x, '<'))) >= least({PLAIN}, size)),
    sizes as (select distinct size from item_windows),
    doc_starts as (select doc_id, row, reading, size, template, unnest(range(0, len(template) - size + 1)) as position from docs, sizes where len(template) >= size),
    matches as (
        select doc_id, row, item_id, reading, position - item_position as shift, unnest(range(item_position, item_position + size)) as place
        from (select *, array_to_string(template[position + 1:position + size], ' ') as key from doc_starts) join item_windows using (key, size, reading)),
    places as (select doc_id, row, item_id, reading, shift, list_sort(list(distinct place)) as places from matches group by all),
    slots as (
        select p.doc_id, p.item_id, shift, len(places)::bigint as covered, i.item_tokens,
            list_transform(list_filter(places, lambda p: i.template[p + 1] in ('{NUMBER}', '{NAME}', '{UNIT}')),
                lambda p: {{'old': i.words[p + 1], 'new': d.words[p + shift + 1]}}) as all_slots
        from places p join items i using (item_id, reading) join docs d using (row, reading) where len(places) >= least({LEAST}, i.item_tokens)),
    counted as (
        select *, len(all_slots)::bigint as slots, len(list_filter(all_slots, lambda s: s.old <> s.new))::bigint as changed_slots from slots
        where len(list_distinct(all_slots)) = len(list_distinct(list_transform(all_slots, lambda s: s.old)))
          and len(list_distinct(all_slots)) = len(list_distinct(list_transform(all_slots, lambda s: s.new)))),
    kept as (
        select *, row_number() over (partition by doc_id, item_id order by covered desc, shift, item_tokens desc, slots desc, changed_slots desc) as k from counted)
    select doc_id, item_id, shift::bigint as start, covered, item_tokens, slots, changed_slots from kept where k = 1"""
