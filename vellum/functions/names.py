"""Author and title names as Catalyst expressions: parting, order, index letters, case, likeness.

Arrays of names and tokens are rebuilt by higher-order functions, so nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import text

# Letters of two or three signs that count as one in the alphabet of the index, longest first.
DIGRAPHS = ["dzs", "cs", "dz", "gy", "ly", "ny", "sz", "ty", "zs"]
# The index alphabet with these letters.
ALPHABET = "A B C Cs D Dz Dzs E F G Gy H I J K L Ly M N Ny O P Q R S Sz T Ty U V W X Y Z Zs".split()
# Small words of names that stay small.
PARTICLES = ["de", "da", "di", "du", "del", "della", "der", "den", "van", "von", "le", "la", "y", "e", "és"]
# Articles that a title is sorted without.
SORT_ARTICLES = ["a", "az", "the", "an", "der", "die", "das", "le", "la", "les"]
# Spellings of one sound, replaced in this order.
SOUNDS = [
    ("tsch", "c"), ("sch", "s"), ("kh", "h"), ("sz", "s"), ("cz", "c"), ("cs", "c"), ("ch", "c"), ("zs", "z"), ("tz", "c"), ("ts", "c"), ("ck", "k"),
    ("ph", "f"), ("th", "t"), ("qu", "kv"), ("x", "ks"), ("w", "v"), ("ou", "u"), ("[yj]", "i"),
]


def first_author(author: Column) -> Column:
    """The first name of an author field, null without one."""
    return F.get(text.split_authors(author), 0)


def tokens(name: Column) -> Column:
    """Runs of letters and digits of a name, accents kept."""
    return F.filter(F.split(name, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _placed(keys: Column, pool: Column) -> Column:
    """struct(out, left, ok): for each key the first token of ``pool`` that folds to it, taken out of the pool."""
    known = F.transform(pool, lambda w: F.struct(w.alias("w"), text.fold_for_search(w).alias("k")))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), known.alias("left"), F.lit(True).alias("ok"))

    def taken(acc: Column, at: Column) -> Column:
        left = F.concat(F.slice(acc["left"], F.lit(1), at - 1), F.slice(acc["left"], at + 1, F.size(acc["left"])))
        return F.struct(F.concat(acc["out"], F.array(F.get(acc["left"], at - 1)["w"])).alias("out"), left.alias("left"), F.lit(True).alias("ok"))

    def step(acc: Column, key: Column) -> Column:
        at = F.when(acc["ok"], F.array_position(F.transform(acc["left"], lambda t: t["k"]), key)).otherwise(0).cast("int")
        return let(at, lambda i: F.when(i > 0, taken(acc, i)).otherwise(F.struct(acc["out"].alias("out"), acc["left"].alias("left"), F.lit(False).alias("ok"))))

    return let(F.aggregate(keys, start, step), lambda d: F.struct(d["out"].alias("out"), F.transform(d["left"], lambda t: t["w"]).alias("left"), d["ok"].alias("ok")))


def sort_name(author: Column, author_sort: Column) -> Column:
    """The first author's name, family name first, accents kept.

    The sort key tells the order, the author field the spelling; words that the key lacks
    follow.  Without an author the folded key, without a key the name as it is; a key that
    names somebody else stands for itself.
    """

    def of(p: Column) -> Column:
        name, key = p["name"], p["key"]
        named = let(_placed(F.split(key, " "), tokens(name)), lambda done: F.when(done["ok"], F.concat_ws(" ", done["out"], done["left"])).otherwise(key))
        return F.when(name.isNull(), F.when(key != "", key)).when(key == "", name).otherwise(named)

    return let(F.struct(first_author(author).alias("name"), text.fold_for_search(author_sort).alias("key")), of)


def family_name(author: Column, author_sort: Column) -> Column:
    """Family name of the first author by the order that the sort key tells; the whole name where it tells none."""
    name = first_author(author)
    shown, ordered = tokens(name), F.filter(F.split(F.coalesce(sort_name(author, author_sort), F.lit("")), " "), lambda w: w != "")
    shown_keys, keys = F.transform(shown, text.fold_for_search), F.transform(ordered, text.fold_for_search)
    given = F.array_position(keys, F.get(shown_keys, 0)).cast("int")
    unknown = F.coalesce(text.fold_for_search(author_sort) == "", F.lit(True)) | (F.size(shown) < 2) | (F.size(ordered) < 2)
    return (
        F.when(name.isNull(), None)
        .when(unknown, name)
        .when(F.array_join(shown_keys, " ") == F.array_join(keys, " "), F.array_join(F.slice(shown, F.lit(1), F.greatest(F.size(shown) - 1, F.lit(0))), " "))
        .when(given <= 1, name)
        .otherwise(F.array_join(F.slice(ordered, F.lit(1), F.greatest(given - 1, F.lit(0))), " "))
    )


def guessed_sort_name(name: Column, language: Column, country: Column, keeps: str = "HU") -> Column:
    """A name with its last word in front, unless the country (or, where that is unknown, the language) writes family names first."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    code = F.upper(F.trim(F.coalesce(country, F.lit(""))))
    kept = F.when(code != "", code == keeps).otherwise(F.coalesce(F.lower(language) == keeps.lower(), F.lit(False)))
    turned = F.concat(F.slice(words, F.size(words), F.lit(1)), F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))
    return F.when(F.size(words) < 2, F.trim(name)).otherwise(F.array_join(F.when(kept, words).otherwise(turned), " "))


def index_letter(name: Column, digraphs: bool = True) -> Column:
    """Letter under which a name is listed: its first without accents, a digraph as one, ``#`` for anything else."""
    trimmed = F.regexp_replace(F.coalesce(name, F.lit("")), r"^[\s\"'„“”‚‘’«»‹›()\[\]{}<>¿¡*_\-–—.,:;!?]+", "")
    folded = text.fold(F.substring(trimmed, 1, 3))
    out = F.when(~trimmed.rlike(r"^\p{L}") | ~folded.rlike(r"^\p{L}"), "#")
    for d in DIGRAPHS if digraphs else []:
        out = out.when(folded.startswith(d), d.capitalize())
    return out.otherwise(F.upper(F.substring(folded, 1, 1)))


def letter_order(letter: Column) -> Column:
    """Place of an index letter in the alphabet; other letters after it, ``#`` last."""
    known = F.create_map(*[F.lit(x) for i, a in enumerate(ALPHABET) for x in (a, i)])
    return F.when(letter == "#", len(ALPHABET) + 1).otherwise(F.coalesce(F.try_element_at(known, letter), F.lit(len(ALPHABET))))


def title_sort_name(title: Column) -> Column:
    """A title without opening quotes and its leading article, unless that is all of it."""
    t = F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), r"^[\"'„“‚‘«»(\[]+", "")
    bare = F.trim(F.regexp_replace(t, rf"(?i)^(?:(?:{'|'.join(SORT_ARTICLES)})\s+|l['’])", ""))
    return F.when(bare != "", bare).otherwise(t)


def collation_key(c: Column) -> Column:
    """A key that sorts without accents and case first, digits by value, and by the text itself at last."""

    def of(t: Column) -> Column:
        parts = F.regexp_extract_all(text.fold(t), F.lit(r"(\d+|\D+)"), 1)
        return F.struct(F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 12, "0")).otherwise(p)), ""), t.alias("text"))

    return let(c, of)


def is_all_capitals(s: Column) -> Column:
    """True for a text of capitals with two or more of them."""
    return F.coalesce((F.upper(s) == s) & (F.length(F.regexp_replace(s, r"[^\p{Lu}]", "")) >= 2), F.lit(False))


def _capitalised(word: Column) -> Column:
    """First letters of a word and of its parts after hyphens, apostrophes, points and brackets as capitals."""
    cut = F.regexp_extract_all(word, F.lit(r"([\-'’.(]*[^\-'’.(]*)"), 1)
    lead = lambda p: F.regexp_extract(p, r"^([\-'’.(]*)", 1)
    rest = lambda p: F.regexp_replace(p, r"^[\-'’.(]*", "")
    return F.array_join(F.transform(cut, lambda p: F.concat(lead(p), F.upper(F.substring(rest(p), 1, 1)), rest(p).substr(F.lit(2), F.length(p)))), "")


def name_case(s: Column) -> Column:
    """A name in capitals in mixed case, its particles small; other names as they are."""
    words = F.split(F.lower(s), " ")
    cased = F.transform(words, lambda w, i: F.when((i > 0) & w.isin(PARTICLES), w).otherwise(_capitalised(w)))
    return F.when(is_all_capitals(s), F.array_join(cased, " ")).otherwise(s)


def sentence_case(s: Column) -> Column:
    """A title in capitals in sentence case, Roman numerals kept, a capital after a sentence's end; other titles as they are."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(True).alias("up"))

    def step(acc: Column, w: Column) -> Column:
        core = F.regexp_replace(w, r"[^\p{L}\p{N}]", "")
        numeral = (core != "") & core.rlike(r"^(?:X{0,3}(?:IX|IV|V?I{0,3})|\d+)$")
        small = F.lower(w)
        at = F.regexp_instr(small, F.lit(r"\p{L}"))
        raised = F.when(at > 0, F.concat(F.expr("''"), small.substr(F.lit(1), at - 1), F.upper(small.substr(at, F.lit(1))), small.substr(at + 1, F.length(small)))).otherwise(small)
        word = F.when(numeral, w).when(acc["up"], raised).otherwise(small)
        ends = w.rlike(r"[!?:]$") | (w.rlike(r"\.$") & ~numeral & (F.length(core) > 1)) | w.rlike("^[-–—]$")
        return F.struct(F.concat(acc["out"], F.array(word)).alias("out"), F.when((core != "") | w.rlike("[-–—]"), ends).otherwise(acc["up"]).alias("up"))

    done = F.aggregate(F.split(s, " "), start, step)
    return F.when(is_all_capitals(s), F.array_join(done["out"], " ")).otherwise(s)


def phonetic(folded: Column) -> Column:
    """A folded family name as it sounds, about alike in several languages."""
    for pattern, sound in SOUNDS:
        folded = F.regexp_replace(folded, pattern, sound)
    return F.regexp_replace(folded, r"(.)\1+", "$1")


def family_similarity(a: Column, b: Column) -> Column:
    """Greater edit ratio of two folded family names, as written and as they sound; 0 if either is empty."""
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.greatest(text.edit_ratio(a, b), text.edit_ratio(phonetic(a), phonetic(b))))


def last_first(name: Column) -> Column:
    """"Name of one or more given words" turned: the last word in front, as importers of Western order want it."""
    words = F.split(F.trim(name), r"\s+")
    return F.array_join(F.concat(F.slice(words, -1, 1), F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))), " ")


def accents(c: Column) -> Column:
    """How many letters carry an accent."""
    c = F.lower(F.coalesce(c, F.lit("")))
    return F.length(c) - F.length(F.translate(c, text._FROM, ""))


def is_title_prefix(a: Column, b: Column) -> Column:
    """True if the shorter title key is the longer one's beginning, word for word, and has six letters or more."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (short != long) & (F.length(F.replace(short, F.lit(" "), F.lit(""))) >= 6) & F.startswith(long, F.concat(short, F.lit(" ")))


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), f), 0)


def _name_tokens(part: Column) -> Column:
    """Words of a name: as written without a closing point, folded, and whether an initial."""

    def token(t: Column) -> Column:
        initial = lambda f: (F.length(f) == 1) | t.rlike(r"^\p{L}{1,3}\.$")
        return let(F.replace(text.fold_for_compare(t), F.lit(" "), F.lit("")), lambda f: F.struct(F.regexp_replace(t, r"[.,]$", "").alias("raw"), f.alias("folded"), initial(f).alias("initial")))

    return F.filter(F.transform(F.split(F.trim(part), r"[\s]+"), token), lambda t: t["folded"] != "")


def person(name: Column, local: list[str], foreign: list[str], families: list[str]) -> Column:
    """struct(words, family_first, sure, comma) of one name.

    ``local``: given names of the language that writes family names first; ``foreign``: given names
    of others; ``families``: family names of the former (all folded; the caller's lists).  A comma
    parts family and given names.  Else known given names, then initials, tell the order; where two
    rules are of equal right the answer is not sure, and Western order is taken.
    """
    within = lambda w, known: F.coalesce(w.isin(known), F.lit(False)) if known else F.lit(False)
    inverted = F.contains(name, F.lit(","))
    parts = F.struct(_name_tokens(F.when(inverted, F.substring_index(name, ",", 1)).otherwise(name)).alias("head"), _name_tokens(F.when(inverted, F.substring_index(name, ",", -1)).otherwise("")).alias("tail"), inverted.alias("inverted"))

    def ends_of(p: Column) -> Column:
        full = lambda every: F.filter(every, lambda t: ~t["initial"])
        return let(F.concat(p["head"], p["tail"]), lambda every: let(F.when(F.size(full(every)) > 0, full(every)).otherwise(every), lambda words: F.struct(
            words.alias("words"), F.coalesce(F.get(every, 0)["initial"], F.lit(False)).alias("lead"), F.coalesce(F.get(every, F.size(every) - 1)["initial"], F.lit(False)).alias("end"),
            F.get(words, 0)["folded"].alias("first"), F.get(words, F.size(words) - 1)["folded"].alias("last"), p["inverted"].alias("inverted"), F.size(full(p["head"])).alias("front"),
        )))

    def known(e: Column) -> Column:
        f_local, l_local = within(e["first"], local), within(e["last"], local)
        return F.struct(
            e.alias("e"), f_local.alias("fl"), l_local.alias("ll"), (f_local | within(e["first"], foreign)).alias("fg"), (l_local | within(e["last"], foreign)).alias("lg"),
            within(e["first"], families).alias("ff"), within(e["last"], families).alias("lf"),
        )

    def judged(k: Column) -> Column:
        e, neither = k["e"], ~k["fg"] & ~k["lg"]
        rules = [
            (F.size(e["words"]) <= 1, ~e["lead"]), (k["ll"] & ~k["fg"], F.lit(True)), (e["lead"] & ~e["end"], F.lit(False)), (e["end"] & ~e["lead"], F.lit(True)), (k["fg"] & ~k["lg"], F.lit(False)),
            (k["ll"] & ~k["fl"], F.lit(True)), (k["fl"] & ~k["ll"], F.lit(False)), (neither & k["ff"] & ~k["lf"], F.lit(True)), (neither & k["lf"] & ~k["ff"], F.lit(False)),
        ]
        order, sure = F.when(e["inverted"], F.lit(True)), F.when(e["inverted"], F.lit(True))
        for when, then in rules:
            order, sure = order.when(when, then), sure.when(when, F.lit(True))
        comma = F.when(e["inverted"], e["front"]).otherwise(0)
        return F.when(F.size(e["words"]) > 0, F.struct(e["words"].alias("words"), order.otherwise(k["fl"] & k["ll"]).alias("family_first"), sure.otherwise(F.lit(False)).alias("sure"), comma.alias("comma")))

    return let(let(let(parts, ends_of), known), judged)


def families_of(p: Column) -> Column:
    """Folded strings that may be the family name of a ``person``: the likely one, the other end where that is not sure, and double names as one."""
    w = F.transform(p["words"], lambda t: t["folded"])
    n = F.size(w)
    front, back = F.get(w, 0), F.element_at(w, -1)
    likely = F.when(p["family_first"], front).otherwise(back)
    other = F.when(~p["sure"] & (n >= 2), F.when(p["family_first"], back).otherwise(front))
    double = F.when((n >= 3) | ((n >= 2) & ~p["sure"]), F.when(p["family_first"], F.array_join(F.slice(w, 1, 2), "")).otherwise(F.array_join(F.slice(w, F.greatest(n - 1, F.lit(1)), F.lit(2)), "")))
    before = F.slice(w, F.lit(1), F.greatest(p["comma"], F.lit(0)))
    told = F.array_union(F.array(F.array_join(before, "")), before)
    return F.array_distinct(F.when(p["comma"] > 0, told).otherwise(F.array_compact(F.array(likely, other, double))))


def authors_compatible(a: Column, b: Column, local: list[str], foreign: list[str], families: list[str], least: float = 0.8) -> Column:
    """True if either field names nobody, or a family name of one is like one of the other (``least``)."""
    keys = lambda c: F.array_distinct(F.flatten(F.transform(text.split_authors(c), lambda n: let(person(n, local, foreign, families), families_of))))
    near = lambda x, y: F.exists(x, lambda p: F.exists(y, lambda q: family_similarity(p, q) >= least))
    return let(F.struct(keys(a).alias("x"), keys(b).alias("y")), lambda k: (F.size(k["x"]) == 0) | (F.size(k["y"]) == 0) | F.coalesce(near(k["x"], k["y"]), F.lit(False)))


def local_order(name: Column, local: list[str]) -> Column:
    """A name of two words whose first is a given name of the local language and whose last is none, turned: family name first."""
    w = F.split(F.trim(name), r"\s+")
    given = lambda i: text.fold_for_compare(F.get(w, i)).isin(local)
    turned = (F.size(w) == 2) & ~F.contains(name, F.lit(",")) & given(0) & ~given(1)
    return F.when(turned, F.concat_ws(" ", F.get(w, 1), F.get(w, 0))).otherwise(F.trim(name))


def sort_key(author: Column, local: list[str], foreign: list[str], families: list[str]) -> Column:
    """Folded key of an author field, family name first, people parted by ``; ``; null without one."""

    def of(p: Column) -> Column:
        w = F.transform(p["words"], lambda t: t["folded"])
        turned = F.concat(F.slice(w, F.greatest(F.size(w), F.lit(1)), F.lit(1)), F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))))
        return F.array_join(F.when(p["family_first"], w).otherwise(turned), " ")

    def one(n: Column) -> Column:
        return let(person(n, local, foreign, families), of)

    key = F.array_join(F.filter(F.transform(text.split_authors(author), one), lambda k: k.isNotNull() & (k != "")), "; ")
    return F.when(key != "", key)
