"""Benchmark decontamination by template windows, with DataFrame functions alone.

A text becomes a template: numbers and units after numbers become typed slots, and in benchmark items names (capitalised words inside a sentence) too. A
name's slot takes any word of a document, so a document's case does not matter. Items are cut into windows; each is met by the rarest of its short runs,
hashed as a template or as the plain words that it is, and joined by that hash with the runs of the documents. The alignment that a run suggests is then
compared word by word: windows match where words agree and what fills the slots is consistent, that is, a value of the item always
stands for the same value of the document.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import settle

#: Words of a window; words of the shortest item that is also met as a template; share of slots in a window at most; share of an item's windows, or so many of them, that contaminate.
WINDOW, SHORTEST, SLOTS, SHARE, MANY = 8, 4, 0.6, 0.5, 16
#: Words of the windows of items below three windows' length, and below three of these: a changed word leaves half of an item's windows. Words
#: of an unbroken run that contaminates, whatever the item's length. Words of the runs that windows are met by.
MIDDLE, FEW, RUN, MET = 5, 4, 14, 4
#: Runs of the benchmark that are broadcast at most: some tens of megabytes. Beyond it Spark joins by shuffle.
BROADCAST = 1_000_000
#: Words of 64 bits of the filter of the benchmark's runs (least, most), bits for each run, and how far a hash is shifted for each of its bits.
FILTER, PER_RUN, SHIFTS = (1 << 10, 1 << 17), 48, (0, 20, 40)
#: Units that may follow a number.
UNITS = "km|cm|mm|m|kg|mg|g|lb|lbs|oz|ml|l|km/h|mph|s|ms|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|meters?|metres?|miles?|feet|inches|grams?|liters?|litres?|dollars?|euros?|cents?|percent|%|€|£|\\$|°C|°F"
#: What a slot begins with, then d (number), u (unit) or n (name), then what fills it; s marks a capitalised word that opens a sentence.
MARK = "\u0001"


def words(text: Column, names: bool = False) -> Column:
    """Lower-case words: letters, marks of letters, digits; slots begin with MARK. Digits hold together over a point, comma or stroke: 3.5, 3/4."""
    clean = F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(" "))
    if names:
        clean = F.regexp_replace(clean, r"[\s\p{Z}]+", " ")
        clean = F.regexp_replace(clean, r"(?<=[\p{Ll}\p{N},;] )(\p{Lu}[\p{Ll}\p{M}]+)", f"{MARK}n$1")
        clean = F.regexp_replace(clean, rf"(?<![\p{{L}}\p{{M}}\p{{N}}{MARK}])(?<!{MARK}n)(\p{{Lu}}[\p{{Ll}}\p{{M}}]+)", f"{MARK}s$1")
    united = F.regexp_replace(clean, rf"(?<=[0-9])[ ]?((?i:{UNITS}))(?![\p{{L}}\p{{N}}])", f" {MARK}u$1 ")
    slots = F.regexp_replace(F.regexp_replace(united, r"(?<![0-9])([0-9]+(?:[.,/][0-9]+)*)", f" {MARK}d$1 "), r"([€£$])", " $1 ")
    with_numbers = F.split(F.lower(slots), rf"(?:[^\p{{L}}\p{{M}}\p{{N}}{MARK}%€£$°.,/]|(?<![0-9])[.,/]|[.,/](?![0-9]))+")
    return F.array_remove(F.when(clean.rlike("[0-9]"), with_numbers).otherwise(F.split(F.lower(clean), rf"[^\p{{L}}\p{{M}}\p{{N}}{MARK}%€£$°]+")), "")


def _slot(x: Column) -> Column:
    return F.startswith(x, F.lit(MARK))


def _plain(x: Column) -> Column:
    return F.when(_slot(x), F.substring(x, 3, 1 << 30)).otherwise(x)


def _form(x: Column) -> Column:
    return F.when(_slot(x), F.substring(x, 1, 2)).otherwise(x)


def _size(n: Column, window: int) -> Column:
    """Words of the windows of an item of n words: the fewer, the shorter; below twice FEW words the item is its own window."""
    return F.when(n >= 3 * window - 1, window).when(n >= 3 * MIDDLE - 1, min(MIDDLE, window)).when(n >= 2 * FEW, min(FEW, window)).otherwise(n)


def _run(hashes: Column | str, i: Column, length: int) -> Column:
    """The hash of the run of ``length`` words from i on; runs of different lengths never meet."""
    return F.xxhash64(F.lit(length), *[F.get(hashes, i + k) for k in range(length)])


def _items(benchmark: DataFrame, window: int) -> DataFrame:
    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    items = items.select("item_id", F.explode(F.array(words(F.col("text"), names=True))).alias("w")).filter(F.size("w") > 0)
    # A capitalised word that opens a sentence is a name if it is one elsewhere in the item.
    known = F.transform(F.filter("w", lambda x: F.startswith(x, F.lit(f"{MARK}n"))), _plain)
    items = items.select("item_id", "w", F.explode(F.array(known)).alias("known"))
    opened = lambda x: F.when(F.array_contains("known", _plain(x)), F.concat(F.lit(f"{MARK}n"), _plain(x))).otherwise(_plain(x))
    items = items.select("item_id", F.transform("w", lambda x: F.when(F.startswith(x, F.lit(f"{MARK}s")), opened(x)).otherwise(x)).alias("item"))
    items = items.select("*", F.size("item").alias("n")).withColumn("size", _size(F.col("n"), window)).withColumn("met", F.least(F.col("size"), F.lit(MET)))
    return items.withColumn("text", F.xxhash64("item"))  # an item_id may stand for several texts


def _gapped(hashes: Callable[[int], Column], mask: Column | int) -> Column:
    """The hash of a run of MET words without those at the bits of ``mask``, which stand for names."""
    bit = lambda k: F.lit(mask >> k & 1 == 1) if isinstance(mask, int) else mask.bitwiseAND(F.lit(1 << k)) > 0
    return F.xxhash64(F.lit(-1) - mask, *[F.when(bit(k), F.lit(0).cast("long")).otherwise(hashes(k)) for k in range(MET)])


def _runs(items: DataFrame) -> DataFrame:
    """(hash, item_id, text, n, at, met, mask): for each window its rarest run as a template, of at most half slots, and its rarest run word for word.

    The run of a template holds no name, mask 0, unless every run of the window does: then names are gaps in it, and two plain words at least are left.
    """
    seq = F.sequence(F.lit(0), F.col("n") - F.col("met"))
    of = lambda form: F.xxhash64(F.col("met"), *[F.when(F.col("met") > k, F.get(form, F.col("at") + k)) for k in range(MET)])
    hashed = items.select("item_id", "text", "n", "size", "met", "item", F.transform("item", lambda x: F.xxhash64(_plain(x))).alias("p"), F.transform("item", lambda x: F.xxhash64(_form(x))).alias("f"), F.explode(seq).alias("at"))
    name = lambda x: F.startswith(x, F.lit(f"{MARK}n"))
    some = F.slice("item", F.col("at") + 1, F.col("met"))
    mask = reduce(lambda a, b: a + b, [F.when(name(F.get("item", F.col("at") + k)), 1 << k).otherwise(0) for k in range(MET)])
    hashed = hashed.select("*", F.explode(F.array(F.struct(some.alias("some"), F.when(F.exists(some, name), mask).otherwise(0).alias("mask")))).alias("y")).select(*hashed.columns, "y.*")
    slots = F.size(F.filter("some", _slot))
    template = F.when((F.col("mask") == 0) & (slots * 2 <= F.col("met")), of("f")).when((F.col("mask") > 0) & (F.col("met") == MET) & (F.size("some") - slots >= 2), _gapped(lambda k: F.get("f", F.col("at") + k), F.col("mask")))
    whole = F.array(F.struct(F.lit(0).alias("kind"), F.lit(0).alias("mask"), of("p").alias("hash")), F.struct(F.lit(1).alias("kind"), "mask", template.alias("hash")))
    runs = hashed.select("item_id", "text", "n", "size", "met", "at", F.explode(whole).alias("x")).select("item_id", "text", "n", "size", "met", "at", "x.*").filter("hash is not null")
    often = runs.groupBy("hash").agg(F.count_distinct("item_id").alias("items"))
    # A run at `at` lies in the windows from at + met - size to at.
    windows = runs.join(often, "hash").select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") + F.col("met") - F.col("size")), F.least(F.col("at"), F.col("n") - F.col("size")))).alias("window"))
    best = windows.groupBy("item_id", "text", "n", "met", "window", "kind").agg(F.min(F.struct("mask", "items", "at", "hash")).alias("x"))
    return best.select("x.hash", "item_id", "text", "n", "x.at", "met", "x.mask").distinct()


def _filter(runs: DataFrame, count: int) -> Callable[[int], Callable[[Column], Column]]:
    """Tells hashes by a bit map of the benchmark's runs, one literal: what it stops is in no run, what it lets through is joined. How many of a hash's bits are looked at is given."""
    size = FILTER[0]
    while size * 64 < count * PER_RUN and size < FILTER[1]:
        size *= 2
    place = lambda h, k: F.shiftright(h, k).bitwiseAND(F.lit(size * 64 - 1))
    places = runs.select(F.explode(F.array(*[place(F.col("hash"), k) for k in SHIFTS])).alias("place"))
    got = places.groupBy(F.shiftright("place", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).collect()
    bits = [0] * size
    for r in got:
        bits[r.word] = r.bits
    held = F.split(F.lit(",".join(map(str, bits))), ",").cast("array<long>")  # constant, so Spark makes it once
    test = lambda h, k: F.getbit(F.get(held, F.shiftright(place(h, k), 6).cast("int")), place(h, k).bitwiseAND(F.lit(63)).cast("int")) == 1
    return lambda most: lambda h: reduce(lambda a, b: a & b, [test(h, k) for k in SHIFTS[:most]])


def _found(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """(a, b, item_id, windows, matched, same): for each text, by two hashes of it, the items found in it."""
    items = settle(_items(benchmark, window), "items")
    runs = settle(_runs(items), "runs")
    count = runs.count()
    lengths = [r.met for r in items.select("met").distinct().collect()]
    masks = [r.mask for r in runs.filter("mask > 0").select("mask").distinct().collect()]  # ten at most: two words of four stay
    filtered = _filter(runs, count)
    hit, loose = filtered(len(SHIFTS)), filtered(1)
    # Exploding an array of one keeps what is computed once: projections are not merged across it.
    once = lambda df, **made: df.select(*df.columns, F.explode(F.array(F.struct(*[c.alias(k) for k, c in made.items()]))).alias("x")).select(*df.columns, "x.*")
    texts = docs.filter(F.col("text").isNotNull()).select(F.xxhash64("text").alias("a"), F.hash("text").alias("b"), "text")
    split = once(texts, w=words(F.col("text"))).drop("text")
    plain = F.when(F.exists("w", _slot), F.transform("w", lambda x: F.xxhash64(_plain(x)))).otherwise(F.transform("w", lambda x: F.xxhash64(x)))
    split = once(split, p=plain, f=F.when(F.exists("w", _slot), F.transform("w", lambda x: F.xxhash64(_form(x))))).drop("w")
    no_longs = F.array().cast("array<long>")
    every = lambda of, n, hashed: F.when(F.size(of) >= n, F.transform(F.sequence(F.lit(0), F.size(of) - n), hashed)).otherwise(no_longs)
    straight = lambda of, n: lambda i: _run(of, i, n)
    gapped = lambda m: lambda i: _gapped(lambda k: F.get("form", i + k), m)
    made = {f"{of}{n}": every(of, n, straight(of, n)) for n in lengths for of in ("p", "f")}
    split = split.withColumn("form", F.coalesce("f", "p"))
    made |= {f"m{m}": every("form", MET, gapped(m)) for m in masks}
    split = once(split, **made).select("a", "b", *made) if made else split.limit(0)
    met = lambda c: F.filter(F.transform(c, lambda h, i: F.struct(i.alias("i"), h.alias("hash"))), lambda x: loose(x["hash"]))
    found = split.filter(F.greatest(F.lit(0), F.lit(0), *[F.size(F.filter(c, hit)) for c in made]) > 0)
    found = found.select("a", "b", F.explode(F.array_distinct(F.concat(F.array().cast("array<struct<i:int,hash:bigint>>"), *map(met, made)))).alias("x")).select("a", "b", "x.*")
    runs = F.broadcast(runs) if count <= BROADCAST else runs
    # Which item may stand where in which text: rows of numbers. Only the texts that have any are split again, and each hit takes its own item's length of words.
    places = settle(found.join(runs, "hash").select("a", "b", "item_id", "text", "n", (F.col("i") - F.col("at")).alias("shift")).distinct(), "places")
    of = settle(places.groupBy("a", "b").agg(F.collect_list(F.struct("item_id", F.col("text").alias("item_text"), "n", "shift")).alias("hits")), "hits")
    keys = of.select("a", "b")
    own = texts.join(F.broadcast(keys) if of.count() <= BROADCAST else keys, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.first("text").alias("text"))  # copies collapse before they are dealt
    again = once(own.join(of, ["a", "b"]), w=words(F.col("text"))).drop("text")
    theirs = lambda h: F.transform(F.sequence(F.lit(0), h["n"] - 1), lambda k: F.get("w", k + h["shift"]))
    again = again.select("a", "b", F.explode(F.transform("hits", lambda h: F.struct(h["item_id"].alias("item_id"), h["item_text"].alias("text"), h["shift"].alias("shift"), theirs(h).alias("w")))).alias("x"))
    aligned = again.select("a", "b", "x.*").groupBy("a", "b", "item_id", "text", "shift").agg(F.first("w").alias("w"))
    aligned = aligned.join(F.broadcast(items) if count <= BROADCAST else items, ["item_id", "text"])

    # Of each word: is it the item's, and if not, may it fill the item's slot?
    word = lambda x, y: F.struct(
        (_plain(x) == _plain(y)).alias("same"), F.when(F.startswith(x, F.lit(f"{MARK}n")), ~_slot(y)).when(_slot(x), _form(x) == _form(y)).otherwise(x == y).alias("fits"), F.when(_slot(x), F.struct(_plain(x).alias("a"), _plain(y).alias("b"))).alias("pair"),
    )
    compared = aligned.select("a", "b", "item_id", "n", "size", F.explode(F.array(F.zip_with("item", "w", word))).alias("x"))
    at = lambda k: F.slice("x", k + 1, F.col("size"))
    every = F.sequence(F.lit(0), F.col("n") - F.col("size"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    same = F.filter(every, lambda k: F.forall(at(k), lambda x: yes(x["same"])))
    template = F.filter(every, lambda k: F.forall(at(k), lambda x: yes(x["fits"])) & F.exists(at(k), lambda x: x["pair"].isNotNull()) & (F.size(F.filter(at(k), lambda x: x["pair"].isNotNull())) <= F.col("size") * SLOTS) & (F.col("n") >= SHORTEST))
    compared = compared.select("*", F.explode(F.array(F.struct(same.alias("same"), template.alias("template")))).alias("y")).select("a", "b", "item_id", "n", "size", "x", "y.*").filter((F.size("same") > 0) | (F.size("template") > 0))
    pairs = F.array_distinct(F.flatten(F.transform("template", lambda k: F.transform(F.filter(at(k), lambda x: x["pair"].isNotNull()), lambda x: x["pair"]))))
    compared = compared.select("*", F.explode(F.array(pairs)).alias("pairs"))
    clash = F.transform(F.filter("pairs", lambda p: F.exists("pairs", lambda q: (q["a"] == p["a"]) & (q["b"] != p["b"]))), lambda p: p["a"])
    compared = compared.select("*", F.explode(F.array(clash)).alias("clash"))
    agree = F.filter("template", lambda k: ~F.exists(at(k), lambda x: x["pair"].isNotNull() & F.array_contains("clash", x["pair"]["a"])))
    compared = compared.select("a", "b", "item_id", "n", "size", F.array_union("same", agree).alias("at"), "same")
    more = F.greatest(F.lit(RUN) - F.col("size"), F.lit(0))  # windows of a run beside its first
    run = F.exists("at", lambda k: F.size(F.array_intersect("at", F.sequence(k, k + more))) == more + 1)
    count_of = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    whole = compared.groupBy("a", "b", "item_id").agg(F.max(F.col("n") - F.col("size") + 1).alias("windows"), count_of("at").alias("matched"), count_of("same").alias("same"), F.max(run).alias("run"))
    return whole.filter((F.col("matched") >= F.col("windows") * SHARE) | (F.col("matched") >= MANY) | F.col("run")).drop("run")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each document and benchmark item found in it: doc_id, item_id, windows (of the item), matched, share, exact (all of them as in the item).

    An item is found where SHARE of its windows, or MANY of them, or those of a run of RUN words match: word for word in whatever case, or as templates
    whose slots agree with all of their alignment; where a value of the item meets two values of the document, only the windows that hold it go. Windows of
    short items are shorter (_size). Only word for word match windows with more than SLOTS of slots and items below SHORTEST words; an item of a single
    word is found wherever that word stands. Null and empty texts match nothing; rows without doc_id or item_id are left out here;
    repeated rows count once; an empty table on either side finds nothing; texts of any length are compared whole. Other columns are not read.
    """
    rows = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = settle(_found(rows, benchmark, window), "found")
    out = rows.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("a"), F.hash("text").alias("b")).join(found, ["a", "b"])
    out = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "same", "windows")).alias("x")).select("doc_id", "item_id", "x.*")
    return out.select("doc_id", "item_id", F.col("windows").cast("long").alias("windows"), F.col("matched").cast("long").alias("matched"), F.round(F.col("matched") / F.col("windows"), 6).alias("share"), (F.col("same") == F.col("matched")).alias("exact"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows in whose texts no benchmark item is found, with all their columns, whatever their doc_id."""
    rows = docs.select(F.col("text").cast("string").alias("text"))
    bad = settle(_found(rows, benchmark, WINDOW).select("a", "b").distinct(), "found")  # written, so that Spark knows its size and can broadcast it
    own = docs.select(F.struct(*docs.columns).alias("own"), F.xxhash64(F.col("text").cast("string")).alias("a"), F.hash(F.col("text").cast("string")).alias("b"))
    return own.join(bad, ["a", "b"], "left_anti").select("own.*")
