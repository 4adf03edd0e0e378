"""Text functions: folding, titles, similarity, as Catalyst expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that decomposition leaves alone, and their plain forms.
SPECIAL = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "ħ": "h"}
# Articles that titles are compared without.
ARTICLES = ["a", "az", "the", "der", "die", "das", "le", "la", "les", "il", "el"]
# Ordinal words that number a volume, from one to ten.
ORDINALS = ["elso", "masodik", "harmadik", "negyedik", "otodik", "hatodik", "hetedik", "nyolcadik", "kilencedik", "tizedik"]


def _accented() -> tuple[str, str]:
    """Lower-case letters with one combining mark, and the letters below the marks, by Unicode's decompositions."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(a, b[0]) for a, b in pairs if len(b) > 1 and a == a.lower() and b[0].isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accented()


def fold(c: Column) -> Column:
    """Lower case without accents; null becomes empty; white space collapsed and trimmed, signs kept."""
    c = F.translate(F.lower(F.coalesce(c, F.lit(""))), _FROM, _TO)
    for a, b in SPECIAL.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\p{M}+", ""), r"\s+", " "))


def fold_for_search(c: Column) -> Column:
    """``fold`` with everything but letters and digits turned into single spaces."""
    return F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", " "))


def fold_for_compare(c: Column) -> Column:
    """As for search, but apostrophes vanish instead of parting words."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(c), "['’‘`´ʼ]", ""), r"[^\p{L}\p{N}]+", " "))


def without_article(folded: Column) -> Column:
    """A folded string without its leading article, unless that is all of it."""
    return F.regexp_replace(folded, f"^(?:{'|'.join(ARTICLES)}) (?=.)", "")


def title_key(c: Column) -> Column:
    return without_article(fold_for_compare(c))


def words(folded: Column) -> Column:
    return F.filter(F.split(folded, " "), lambda w: w != "")


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / greater length; 1 for two empty strings."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / most)


def trigrams(folded: Column) -> Column:
    """Distinct three-letter pieces of each word, a space standing before and after it."""
    padded = F.transform(words(folded), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    pieces = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))


def volume_numbers(c: Column) -> Column:
    """Distinct numbers, rising, that mark a volume: digits, Roman numerals to 39, ordinal words."""
    roman = {("x" * t) + o: 10 * t + n for t in range(4) for n, o in enumerate(["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"])}
    known = {**{k: v for k, v in roman.items() if k}, **{w: i + 1 for i, w in enumerate(ORDINALS)}}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    number = lambda w: F.when(w.rlike(r"^\d{1,9}$"), w.try_cast("int")).otherwise(F.try_element_at(table, w))
    return F.array_sort(F.array_distinct(F.filter(F.transform(words(fold_for_compare(c)), number), lambda n: n.isNotNull())))


def volumes_conflict(a: Column, b: Column) -> Column:
    """True if both have volume numbers and these differ."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (a != b)


def matches_query(haystack: Column, query: str) -> Column:
    """True if each word of ``query`` stands in the folded haystack, with or without its spaces."""
    compact = F.replace(haystack, F.lit(" "), F.lit(""))
    terms = F.filter(F.split(fold_for_search(F.lit(query)), " "), lambda t: t != "")
    return F.forall(terms, lambda t: F.contains(haystack, t) | F.contains(compact, t))


def haystack(*columns: Column) -> Column:
    return fold_for_search(F.concat_ws("  ", *[F.when(c != "", c) for c in columns]))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Edit ratio of two folded titles whose words are first put in the same order: equal ones lead, then similar ones side by side."""
    left, right = F.array_distinct(words(a)), F.array_distinct(words(b))
    both = F.array_sort(F.array_intersect(left, right))
    l, r = F.array_except(left, right), F.array_except(right, left)
    near = F.flatten(F.transform(l, lambda x: F.transform(r, lambda y: F.struct((-edit_ratio(x, y)).alias("m"), x.alias("x"), y.alias("y")))))
    near = F.array_sort(F.filter(near, lambda p: (F.least(F.length(p["x"]), F.length(p["y"])) >= 3) & (p["m"] <= -0.75)))
    none = F.array().cast("array<struct<x:string,y:string>>")
    fresh = lambda acc, p: ~F.exists(acc, lambda q: (q["x"] == p["x"]) | (q["y"] == p["y"]))
    pairs = F.array_sort(F.aggregate(near, none, lambda acc, p: F.when(fresh(acc, p), F.concat(acc, F.array(F.struct(p["x"].alias("x"), p["y"].alias("y"))))).otherwise(acc)))
    xs, ys = F.transform(pairs, lambda p: p["x"]), F.transform(pairs, lambda p: p["y"])
    first = F.array_join(F.concat(both, xs, F.array_sort(F.array_except(l, xs))), " ")
    second = F.array_join(F.concat(both, ys, F.array_sort(F.array_except(r, ys))), " ")
    return F.when((F.size(left) == 0) | (F.size(right) == 0), (left == right).cast("double")).otherwise(edit_ratio(first, second))


def title_similarity(a: Column, b: Column) -> Column:
    """Greater of edit ratio and token-set ratio of two title keys; 0 if either is empty."""
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.greatest(edit_ratio(a, b), token_set_ratio(a, b)))


def title_cover(a: Column, b: Column) -> Column:
    """Share of the longer title key's letters that the shorter one has, if the longer one has all its words, else 0.

    Each word of the shorter title, in order, takes the word most like it of those left (ratio 0.8 at least; words
    under three letters must be equal); fewer than four letters cover nothing.
    """
    letters = lambda t: F.length(F.replace(t, F.lit(" "), F.lit("")))
    small, large = F.when(letters(a) <= letters(b), a).otherwise(b), F.when(letters(a) <= letters(b), b).otherwise(a)
    alike = lambda t, p: F.when(t == p, 1.0).when((F.length(t) >= 3) & (F.length(p) >= 3), edit_ratio(t, p)).otherwise(0.0)

    def taken(left: Column, t: Column) -> Column:
        scores = F.transform(left, lambda p: alike(t, p))
        # Without a fitting word there is nothing left, for this word and all that follow.
        best = F.filter(F.array(F.struct(F.array_max(scores).alias("s"), F.array_position(scores, F.array_max(scores)).cast("int").alias("at"))), lambda x: x["s"] >= 0.8)
        rest = lambda x: F.concat(F.slice(left, F.lit(1), x["at"] - 1), F.slice(left, x["at"] + 1, F.size(left)))
        return F.get(F.transform(best, rest), 0)

    left = F.aggregate(words(small), words(large), taken)
    fits = (small != "") & (F.size(words(small)) <= F.size(words(large))) & (letters(small) >= 4) & left.isNotNull()
    return F.when(fits, F.least(F.lit(1.0), letters(small) / F.greatest(F.lit(1), letters(large)))).otherwise(0.0)


def split_authors(c: Column) -> Column:
    """Names of an author field parted by ``;`` or by a spaced ``&`` or ``+``."""
    parts = F.split(F.coalesce(c, F.lit("")), r"\s*(?:;|\s&\s|\s\+\s)\s*")
    return F.filter(F.transform(parts, F.trim), lambda a: a != "")


def guarded_formula(c: Column) -> Column:
    """An apostrophe before text that a spreadsheet would run."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def csv_field(c: Column, delimiter: str) -> Column:
    """Text of a CSV field: null is empty; quoted if it holds the delimiter, a quote or a line end."""
    text = guarded_formula(F.coalesce(c.cast("string"), F.lit("")))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike(f'[{delimiter}"\r\n]'), quoted).otherwise(text)
