"""What decontamination must still find: number-heavy, short, edited, partial and reformatted items."""

import random

import regex

from quillstone.llm import decontam


def found(spark, items, docs):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontam.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench).collect()}


NUMBERS = ["What is 12 + 30 + 45 + 7?", "Compute 3/4 + 5/6 - 7/8 + 9/10 + 11/12", "A box is 3.5 m by 2.5 m by 1.5 m and costs $4.50 per kg", "Add 2"]


def test_number_heavy_and_short_items_word_for_word(spark):
    docs = [f"so they said: {x} and went on with it" for x in NUMBERS] + ["What is 13 + 31 + 46 + 8? Add 3", "nothing here"]
    got = found(spark, NUMBERS, docs)
    assert set(got) == {(k, k) for k in range(4)} and all(r.exact and r.matched == r.windows for r in got.values())


LONG = "A farmer sells 12 apples in the morning at the old market by the river and later that same day 12 pears to a baker who lives behind the church and pays with coins"
BOX = "A wooden box is 3.5 m by 2.5 m by 1.5 m and the owner pays by its volume, so how much does he pay if each 1/2 cubic unit is worth 4.75 in all"


def test_one_conflict_does_not_discard_the_alignment(spark):
    got = found(spark, [LONG], ["So: " + LONG.replace("12 pears", "13 pears"), LONG.replace("12", "40")])
    assert set(got) == {(0, 0), (1, 0)} and got[0, 0].exact and not got[1, 0].exact and got[1, 0].matched == got[1, 0].windows
    assert got[0, 0].windows == 27 and got[0, 0].matched == 19


def test_a_decimal_or_fraction_is_one_slot(spark):
    new = BOX
    for a, b in (("3.5", "4.1"), ("2.5", "3.7"), ("1.5", "2.2"), ("1/2", "3/4"), ("4.75", "12.5")):
        new = new.replace(f" {a} ", f" {b} ")
    got = found(spark, [BOX], [new, BOX])
    assert set(got) == {(0, 0), (1, 0)} and got[1, 0].exact and not got[0, 0].exact and got[0, 0].matched == 25  # three windows hold more slots than words


def test_partial_and_edited_items(spark):
    long, other = [f"langwort{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}" for k in range(59)], "zzz".split()
    items, docs = [" ".join(long)], ["vorher " + " ".join(long[20:40]) + " nachher", "vorher " + " ".join(long[20:33]) + " nachher"]
    want = {(0, 0)}
    for n in range(11, 31):  # one word of each item changed, in each third of it
        own = [f"w{'abcdefghijklmnopqrstuvwxyz'[n - 11]}{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{'x' * (k // 26)}" for k in range(n)]
        items.append(" ".join(own))
        for k in (0, n // 3, 7, n // 2, n - 1):
            want.add((len(docs), len(items) - 1))
            docs.append("davor " + " ".join([*own[:k], *other, *own[k + 1 :]]) + " danach")
    assert set(found(spark, items, docs)) == want


def test_lower_case_and_wrapped_copies(spark):
    item = "If Tom has 12 apples and gives Anna 5 apples, then how many apples does Tom have left at the end of the day when Karl and Mia and Paul go home with Ben"
    wrapped = item
    for name in ("Tom", "Anna", "Karl", "Mia", "Paul", "Ben"):
        wrapped = wrapped.replace(f" {name}", f"\r\n    {name}")
    renamed = wrapped.replace("Anna", "Olga").replace("Tom", "Hugo").replace("Karl", "Nils").replace("Paul", "Otto").replace("12", "31")
    got = found(spark, [item], [item.lower(), wrapped, renamed, item.upper()])
    assert set(got) == {(k, 0) for k in range(4)} and all(r.matched == r.windows and r.exact == (r.doc_id != 2) for r in got.values())


UNIT = regex.compile(r"(?<=[0-9])[ ]?((?i:" + decontam.UNITS + r"))(?![\p{L}\p{N}])")


def plain_words(text, names):
    """Words of a text as (kind, content): w, d, u or n."""
    known = set()
    if names:
        name = regex.compile(r"(?<=[\p{Ll}\p{N},;][\s\p{Z}]+)\p{Lu}[\p{Ll}\p{M}]+")
        known = {x.lower() for x in name.findall(text)}
        text = regex.sub(r"(?<![\p{L}\p{M}\p{N}])\p{Lu}[\p{Ll}\p{M}]+", lambda m: "\x01n" + m[0] if m[0].lower() in known else m[0], text)
    if regex.search("[0-9]", text):
        text = UNIT.sub(" \x01u\\1 ", text)
        text = regex.sub(r"(?<![0-9])([0-9]+(?:[.,/][0-9]+)*)", " \x01d\\1 ", text)
        text = regex.sub(r"([€£$])", r" \1 ", text)
    out = [x for x in regex.split(r"(?:[^\p{L}\p{M}\p{N}\x01%€£$°.,/]|(?<![0-9])[.,/]|[.,/](?![0-9]))+", text.lower()) if x]
    return [(x[1], x[2:]) if x[0] == "\x01" else ("w", x) for x in out]


def plainly(text, item):
    """(matched, windows) by comparing every alignment, without any index."""
    a, b = plain_words(item, True), plain_words(text, False)
    n = len(a)
    s = 8 if n >= 23 else 5 if n >= 14 else 4 if n >= 8 else n
    at, run = set(), False
    for shift in range(1 - n, len(b)):
        same, form = [], []
        for k, (kind, x) in enumerate(a):
            y = b[k + shift] if 0 <= k + shift < len(b) else None
            same.append(y is not None and y[1] == x)
            form.append(y is not None and (y[0] == "w" if kind == "n" else y[0] == kind if kind != "w" else y == (kind, x)))
        slots = [kind != "w" for kind, _ in a]
        whole = {k for k in range(n - s + 1) if all(same[k : k + s])}
        likely = {k for k in range(n - s + 1) if all(form[k : k + s]) and 0 < sum(slots[k : k + s]) <= 0.6 * s and n >= 4}
        meant = {}
        for k in likely:
            for j in range(k, k + s):
                if slots[j]:
                    meant.setdefault(a[j][1], set()).add(b[j + shift][1])
        good = whole | {k for k in likely if all(len(meant[a[j][1]]) == 1 for j in range(k, k + s) if slots[j])}
        at |= good
        run |= any(all(j in good for j in range(k, k + max(14 - s, 0) + 1)) for k in good)
    return (len(at), n - s + 1) if 2 * len(at) >= n - s + 1 or len(at) >= 16 or run else None


def test_like_plain_comparison(spark):
    rng = random.Random(5)
    pool = "the a of river stone farmer sells gives takes apple box long short and then how many much does has left Tom Anna Karl 3 12 7.5 1/2 40 kg km".split()
    items = [" ".join(rng.choices(pool, k=rng.choice([1, 2, 3, 5, 9, 12, 16, 25, 40]))) for _ in range(40)]
    docs = []
    for _ in range(150):
        item = rng.choice(items).split()
        a, b = sorted(rng.randint(0, len(item)) for _ in range(2))
        part = item if rng.random() < 0.6 else item[a:b]
        part = [rng.choice(pool) if rng.random() < 0.06 else x for x in part]
        if rng.random() < 0.5:
            new = {"Tom": "Mia", "Anna": "Ben", "Karl": "Eva", "3": "5", "12": "99", "7.5": "8.25", "kg": "km"}
            part = [new.get(x, x) for x in part]
        text = " ".join([*rng.choices(pool, k=rng.randint(0, 15)), *part, *rng.choices(pool, k=rng.randint(0, 15))])
        docs.append(rng.choice([str, str.lower, str.upper])(text))
    want = {(k, i): p for k, d in enumerate(docs) for i, x in enumerate(items) if (p := plainly(d, x))}
    got = {k: (r.matched, r.windows) for k, r in found(spark, items, docs).items()}
    assert len(want) > 80 and got == want


def test_recall_on_changed_items(spark):
    """Items of the given table and of our own, in lower and upper case and with other names and numbers: at least nine of ten are found."""
    rows = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").orderBy("item_id").collect()
    own = [LONG, BOX, "If Tom has 12 apples and gives Anna 5 apples, then how many apples does Tom have left at the end of the day"]
    items = [r.text for r in rows] + own
    name = regex.compile(r"(?<=[\p{Ll}\p{N},;][\s\p{Z}]{1,16})\p{Lu}[\p{Ll}\p{M}]+")
    other = lambda t: regex.sub("[0-9]+", lambda m: str(int(m[0]) * 3 + 1), name.sub(lambda m: m[0][:1] + m[0][:0:-1].lower() + "o", t))
    forms = [str.lower, str.upper, other, lambda t: other(t).lower(), lambda t: other(t).upper()]
    for form in forms:
        got = found(spark, items, [f"words before it {form(x)} and some after" for x in items])
        assert sum((k, k) in got for k in range(len(items))) >= 0.9 * len(items)


def test_very_long_text(spark):
    got = found(spark, [LONG], ["word " * 200_000 + LONG.upper() + " word" * 200_000])
    assert set(got) == {(0, 0)}


def test_items_full_of_names(spark):
    """Every run of four words holds a name; other names and numbers, in any case."""
    rng = random.Random(11)
    people, verbs, things = "Anna Tom Karl Mia Paul Ben Olga Hugo Nils Otto Lisa Max Rosa Emil Ida Kurt".split(), "gives sells lends shows sends brings owes hands".split(), "apples pears coins books pens cups stones nuts".split()
    item = lambda who, n: f"{who[0]} {v[0]} {who[1]} {n[0]} {t[0]} and {who[1]} {v[1]} {who[2]} {n[1]} {t[1]} and {who[2]} {v[2]} {who[0]} {n[2]} {t[2]}"
    items, docs = ["Anna gives Tom 5 apples and Tom gives Anna 3 pears"], ["Once more Lisa gives Max 7 apples and Max gives Lisa 9 pears that day", "Lisa sells Max 7 pens and Max owes Karl 9 plums"]
    for _ in range(40):
        v, t = rng.sample(verbs, 3), rng.sample(things, 3)
        items.append(item(rng.sample(people, 3), rng.sample(range(2, 50), 3)))
        text = f"And then {item(rng.sample(people, 3), rng.sample(range(50, 99), 3))} as told"
        docs.append(rng.choice([str, str.lower, str.upper])(text))
    got = found(spark, items, docs)
    assert (0, 0) in got and not got[0, 0].exact and (1, 0) not in got
    assert sum((k + 1, k) in got for k in range(1, 41)) >= 36


def test_a_name_after_many_blanks(spark):
    item = "If Tom has 12 apples and gives Anna 5 apples, then how many apples does Tom have left at the end of the day"
    wide = item.replace(" Anna", " " * 40 + "Anna")
    assert set(found(spark, [wide], [item.replace("Anna", "Olga").replace("Tom", "Hugo")])) == {(0, 0)}
