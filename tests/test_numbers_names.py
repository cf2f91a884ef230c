"""Number words against numbers that are spelt here, names against plain searches."""

import random

import pytest
from pyspark.sql import functions as F

from quillmark.functions import json as js, numbers as N
from quillmark.operators import entities as E, names as G

SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "_ _ twenty thirty forty fifty sixty seventy eighty ninety".split()


def said(n, rng):
    """An English number, with and without "and" and hyphens, in Indian or Western groups."""
    if n < 20:
        return SMALL[n]
    if n < 100:
        return TENS[n // 10] + (rng.choice(" -") + SMALL[n % 10] if n % 10 else "")
    western = [(10**9, "billion"), (10**6, "million"), (10**3, "thousand"), (100, "hundred")]
    indian = [(10**7, "crore"), (10**5, "lakh"), (10**3, "thousand"), (100, "hundred")]
    for size, name in rng.choice([western, indian]) if n < 10**9 else western:
        if n >= size:
            head = said(n // size, rng) if n // size < 1000 else None
            if head is None:
                continue
            rest = n % size
            return f"{head} {name}" + (rng.choice([" ", " and ", "\n"] if rest < 100 else [" "]) + said(rest, rng) if rest else "")
    raise AssertionError(n)


def read(spark, texts, *languages):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.n for r in d.select("i", N.normalize_numbers("t", languages or N.LANGUAGES).alias("n")).orderBy("i").collect()]


def test_generated_numbers(spark):
    rng = random.Random(3)
    texts, want = [], []
    for _ in range(400):
        numbers = [rng.randrange(10 ** rng.randrange(1, 12)) for _ in range(rng.randrange(1, 5))]
        words = [rng.choice(["x", "costs,", "tenet", "Fiveish", "(", "12", "andy"]) for _ in numbers]
        texts.append("  ".join(f"{w} {rng.choice([str.upper, str.title, str])(said(n, rng))}" for w, n in zip(words, numbers, strict=True)))
        want.append("  ".join(f"{w} {n}" for w, n in zip(words, numbers, strict=True)))
    assert read(spark, texts, "en") == want


CASES = {
    "two hundred thirty five": "235", "do sau": "200", "Two Hundred Thirty-Five, please": "235, please", "five five": "5 5", "one hundred and two hundred": "100 and 200", "two lakh crore": "2000000000000",
    "one thousand and two thousand three": "1000 and 2003", "two hundred three hundred": "200 300", "one thousand two hundred and five thousand": "1000 205000", "nineteen ninety nine": "19 99", "twelve hundred": "1200",
    "two point five lakh": "250000", "three point one four one": "3.141", "one point two three four five million": "1.2345 1000000", "five and six": "5 and 6", "two hundred and": "200 and", "point five": "point 5",
    "sixteen sixteenth tens": "16 sixteenth tens", "5 hundred": "5 100", "five5 5five _ten": "five5 5five _ten", "पाँच हज़ार दो सौ": "5200", "दस": "10", "das hazaar paintees": "10035", "five\nsix": "5\n6", "zero zero seven": "0 0 7",
    "thousand million billion trillion crore lakh crore": "1000000000000000000 1000000000000 10000000 1000000000000", "a  ten  six": "a  10  6", "": "", " \n": " \n", None: None,
}


def test_cases(spark):
    assert read(spark, list(CASES)) == list(CASES.values())


def test_tables(spark):
    assert len(set(N.HINDI)) == len(set(N.ROMANISED)) == 100
    ids = spark.range(0, 10**6, 7919).union(spark.range(10**9, 10**12, 10**10 + 12345))
    for language in N.LANGUAGES:
        d = ids.withColumn("t", N.spelled("id", language)).withColumn("n", N.normalize_numbers("t", [language]))
        assert d.where("n <> cast(id as string) or t = ''").count() == 0
    d = spark.createDataFrame([("ten 3.5 and two hundred",)], "t string")
    assert d.select(N.numbers("t").alias("n")).first().n == ["10", "3.5", "200"]


def test_numbers_of_a_reply(spark):
    d = spark.createDataFrame([('so ```json\n{"numbers": ["10", "5.5"]}\n```',), ('{"numbers": null}',), ("none",), (None,)], "t string")
    assert [r.n for r in d.select(js.reply_numbers(F.col("t")).alias("n")).collect()] == [["10", "5.5"], [], [], []]


def plain_names(text, names):
    words = [w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()]
    hits = [(i, len(n), " ".join(n)) for n in {tuple(x.lower().split()) for x in names} for i in range(len(words) - len(n) + 1) if words[i : i + len(n)] == list(n)]
    return sorted(h for h in hits if not any((o[0] <= h[0] and o[0] + o[1] >= h[0] + h[1]) and o != h for o in hits))


@pytest.mark.parametrize("words", [3, 12])
def test_find_names(spark, words, monkeypatch):
    monkeypatch.setattr(G, "SPAN", 7)
    rng = random.Random(words)
    vocabulary = "ab cd ef gh ij kl mn op qr st uv wx".split()[:words]
    text = lambda n, sep=" ": sep.join(rng.choice(vocabulary) for _ in range(n))
    names = [text(rng.choice([1, 2, 3, 8, 9, 16, 17, 20] if words == 3 else [2, 3, 4])) for _ in range(40)]
    names = [n for n in names if len(set(n.split())) > 1] + ["ab cd " * 12]
    texts = [None, "", "...", "ab", "Ab, CD; ef", "ab cd " * 30] + [text(rng.randrange(1, 60), rng.choice([" ", ", ", "\n"])).title() for _ in range(40)]
    d = spark.createDataFrame(list(enumerate(texts)), "at int, text string").union(spark.createDataFrame([(5, texts[5])], "at int, text string"))
    known = spark.createDataFrame([(n, "X") for n in names] + [(names[0], "Y"), ("", "X"), (None, "X")], "name string, category string")
    got = G.find_names(d, "at", "text", known).collect()
    for i, t in enumerate(texts):
        assert sorted((r.start, r.n, r.name) for r in got if r["at"] == i and r.category == "X") == plain_names(t, names)
    assert {r.name for r in got if r.category == "Y"} <= {names[0]}
    assert G.find_names(d, "at", "text", known.limit(0)).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        last, row[0] = row[0], row[0] + 1
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("hot", [False, True])
def test_near_names(spark, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(G, "HOT_PAIRS", 4)
        monkeypatch.setattr(G, "HOT_ROWS", 2)
    rng = random.Random(7)
    base = ["".join(rng.choice("abcé") for _ in range(rng.choice([3, 5, 8, 9, 13, 20]))) for _ in range(60)]

    def spoilt(w):
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice("abx") + w[i:], w[:i] + w[i + 1 :], w[:i] + "y" + w[i + 1 :]])
        return w

    left, right = base, [spoilt(w) for w in base for _ in range(3)] + base[:5]
    got = {(r.name, r.other): r.distance for r in G.near_names(*(spark.createDataFrame([(w,) for w in x] + [(None,)], "name string") for x in (left, right))).collect()}
    most = lambda n: 0 if n < 5 else 1 if n < 9 else 2
    want = {(a, b): edits(a, b) for a in set(left) for b in set(right) if a != b and edits(a, b) <= most(min(len(a), len(b)))}
    assert got == want and len(want) > 50


def test_places_of_names_stay_where_their_texts_are(spark):
    """The only rows that finding names shuffles are texts, dealt by their key before any place is looked at."""
    d = spark.createDataFrame([(i, "Ab cd ef gh " * 5) for i in range(40)], "k int, t string")
    known = spark.createDataFrame([("ab cd", "X"), ("gh", "Y"), ("ab cd ef gh " * 4, "X")], "name string, category string")
    found = G.find_names(d, "k", "t", known)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(k#" in plan
    assert found.count() == found.where("n = 16").count() == 80  # the others lie within the long name


def test_recall_of_texts_is_that_of_their_rows(spark):
    rng = random.Random(11)
    pool = "Alpha Bravo Charlie Deltas Echoing Foxtrot Golfing Hotels Indias Juliett Kilowatt".split()

    def spoilt(w):
        i = rng.randrange(len(w))
        return rng.choice([w, w, w.lower(), w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:7], ""])

    texts = [[rng.choice(pool) if rng.random() < 0.7 else "and" for _ in range(rng.randrange(40))] for _ in range(50)]
    rows = [(k, " ".join(t), " ".join(map(spoilt, t))) for k, t in enumerate(texts)] + [(50, None, "Alpha Bravo"), (51, "Alpha Bravo", None)]
    d = spark.createDataFrame(rows, "k int, r string, h string")
    known = spark.createDataFrame([(w, E.CATEGORIES[len(w) % 5]) for w in pool] + [("alpha bravo charlie", "ORG"), ("alpha", "PRODUCT")], "name string, category string")
    same = spark.createDataFrame([("alpha bravo", "alpha bravo charlie"), ("kilowat", "kilowatt"), ("golfing", "hotels")], "alias string, name string")
    want = E.entity_rows(d, "k", E.entities(d, "k", "r", known), E.entities(d, "k", "h", known), same)
    got = E.text_recall(d.repartition(3, "k"), "k", "r", "h", known, same, d, 3)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert got.where("n_missing > 0").count() > 20 and got.where("n_matched > 0").count() > 20
