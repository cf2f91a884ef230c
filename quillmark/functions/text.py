"""Text functions over columns. Words are split at Unicode white space; classes are spelt out, as engines disagree on \\w."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD_CHAR = r"[\p{L}\p{N}_]"
#: Runs of capitalised ASCII words: a fixed value.
NOUN = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"
PUNCTUATION = r"[.,!?;:]"
FRAGMENT = "[।|.!?]+|[^।|.!?]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a, b) -> Column:
    """a / b as a double; 0 where b is not above 0."""
    a, b = _col(a), _col(b)
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def bound(c: Column, f) -> Column:
    """f(c) with ``c`` made once, however often ``f`` uses it."""
    return F.transform(F.array(c), f)[0]


def tokens(c) -> Column:
    """Words; null gives null, blank text gives an empty array."""
    return F.filter(F.split(_col(c), r"(?U)\s+"), lambda x: x != "")


def strip(c) -> Column:
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def collapse(c) -> Column:
    return strip(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def word_count(c) -> Column:
    return F.size(tokens(c))


def mean_word_length(words) -> Column:
    words = _col(words)
    return ratio(F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)), F.size(words))


def drop_labels(c) -> Column:
    """Without a leading ``label:`` on each line and without ``(m:s-m:s)`` stamps."""
    c = F.regexp_replace(_col(c), rf"(?m)^{WORD_CHAR}+:\s*", "")
    return F.regexp_replace(c, r"\(\p{Nd}+:\p{Nd}+\.?\p{Nd}*-\p{Nd}+:\p{Nd}+\.?\p{Nd}*\)", "")


def preprocess(c) -> Column:
    """What word error rates are computed on, after numbers were normalised."""
    return F.lower(collapse(drop_labels(c)))


def adjacent_repetition(words) -> Column:
    """Share of words that equal the next one, lower-cased, times 5."""
    words = F.transform(_col(words), F.lower)
    n = F.size(words)
    same = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: (a == b).cast("int"))
    return ratio(F.aggregate(same, F.lit(0), lambda a, x: a + x) * 5, n)


def global_repetition(words) -> Column:
    """Distinct words that occur more than once, over words. Sorted, a word's repeats follow each other."""

    def repeated(s: Column) -> Column:
        rest = F.greatest(F.size(s) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(s, F.lit(1), rest), F.slice(s, F.lit(2), rest), lambda a, b: F.when(a == b, a))
        return ratio(F.size(F.array_compact(F.array_distinct(pairs))), F.greatest(F.size(s), F.lit(1)))

    return bound(F.sort_array(_col(words)), repeated)


def char_diversity(c) -> Column:
    c = _col(c)
    return F.when(F.length(c) > 0, ratio(F.size(F.array_distinct(F.split(c, ""))), F.length(c))).otherwise(F.lit(0.0))


def class_ratio(c, pattern: str) -> Column:
    c = _col(c)
    return ratio(F.regexp_count(c, F.lit(pattern)), F.greatest(F.length(c), F.lit(1)))


def punct_ratio(c) -> Column:
    return class_ratio(c, PUNCTUATION)


def digit_ratio(c) -> Column:
    return class_ratio(c, r"\p{Nd}")


def special_ratio(c) -> Column:
    return class_ratio(c, r"(?U)[^\p{L}\p{N}\s]")


def syllables(c) -> Column:
    """Runs of ASCII vowels in the whole text, one less if it ends with e, at least 1."""
    low = F.lower(_col(c))
    return F.greatest(F.regexp_count(low, F.lit("[aeiou]+")) - F.when(F.endswith(low, F.lit("e")), 1).otherwise(0), F.lit(1))


def compound_nouns(c) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(NOUN), F.lit(0))


def compound_noun_hits(c) -> Column:
    """array<struct<noun, start_pos, end_pos>>: the text is marked around each noun, once; what is before a mark is as long as
    the noun's place and the marks before it."""
    marked = F.regexp_replace(F.translate(_col(c), "\u0001\u0002", ".."), NOUN, "\u0001$1\u0002")

    def hit(m: Column, noun: Column, i: Column) -> Column:
        at = F.length(F.call_function("substring_index", m, F.lit("\u0001"), i + 1)) - 2 * i
        return F.struct(noun.alias("noun"), at.alias("start_pos"), (at + F.length(noun)).alias("end_pos"))

    return bound(marked, lambda m: F.transform(compound_nouns(m), lambda noun, i: hit(m, noun, i)))


def noun_variants(noun) -> Column:
    """The noun, its first two words, its initials."""
    w = tokens(noun)
    return F.array(_col(noun), F.array_join(F.slice(w, 1, 2), " "), F.array_join(F.transform(w, lambda x: F.substring(x, 1, 1)), ""))


def fragments(c) -> Column:
    """Sentences and their end marks, each trimmed; blanks are left out."""
    return F.filter(F.transform(F.regexp_extract_all(_col(c), F.lit(FRAGMENT), F.lit(0)), strip), lambda x: x != "")


def chunks(items, size: int, step: int | None = None) -> Column:
    """Runs of ``size`` items, a new one each ``step`` items, joined by blanks."""
    items, step = _col(items), step or size
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(items, i + 1, F.lit(size)), " "))


def chunk_count(n, step: int) -> Column:
    return ((_col(n) + (step - 1)) / step).cast("long")


def replace_first(text, old, new) -> Column:
    """The first occurrence of ``old`` replaced; text unchanged where there is none."""
    text, old, new = _col(text), _col(old), _col(new)
    at = F.position(old, text)
    return F.when((at > 0) & (F.length(old) > 0), F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))).otherwise(text)


def replace_nouns(text, fixes, most: int = 10) -> Column:
    """``fixes``: array of struct(old, new); the first ``most`` are applied one after the other, each to its first occurrence."""
    return F.aggregate(F.slice(_col(fixes), 1, most), _col(text), lambda acc, f: replace_first(acc, f["old"], f["new"]))


def char_diff(a, b) -> Column:
    """Places of the common length at which two texts differ; 0 if either is null."""
    a, b = _col(a), _col(b)
    m = F.least(F.length(a), F.length(b))
    letters = lambda c: F.slice(F.split(c, ""), F.lit(1), m)
    found = F.aggregate(F.zip_with(letters(a), letters(b), lambda x, y: (x != y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    return F.when((m > 0) & a.isNotNull() & b.isNotNull(), found).otherwise(F.lit(0))


def change_percentage(diff, original) -> Column:
    return ratio(_col(diff) * 100, F.length(_col(original)))


def clean(c) -> Column:
    """Letters, digits, underscore, hyphen and single blanks, lower-cased."""
    return F.lower(collapse(F.regexp_replace(_col(c), r"(?U)[^\p{L}\p{N}_\s-]", "")))


def corrupted(words, drop: int | None = 7, swap: int | None = 11, double: int | None = 13, filler: str = "the") -> Column:
    """Words by a rule on their index: every ``drop``-th left out, ``swap``-th replaced by a filler, ``double``-th doubled (None: never)."""

    def step(w, i):
        out = F.array(w) if double is None else F.when(i % double == 6, F.array(w, w)).otherwise(F.array(w))
        out = out if swap is None else F.when(i % swap == 5, F.array(F.lit(filler))).otherwise(out)
        return out if drop is None else F.when(i % drop == 3, F.array().cast("array<string>")).otherwise(out)

    return F.flatten(F.transform(_col(words), step))
