"""A catalogue of records with authors, topics, tags and states: facets, groups, sorts, candidates, exports.

A record is a row with the columns of ``COLUMNS``; other columns stay or are ignored.  Groups
are aggregated before they are shuffled; lists that are short by nature (facets, letters,
statuses) come out small, lists that grow with the catalogue stay tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions import names, numbers, text
from vellum.storage import staged

COLUMNS = (
    "id", "title", "author", "author_sort", "category", "topics", "tags", "language", "original_language", "country", "year", "status", "pages", "rating",
    "favourite", "needs_review", "reviewed", "lent_to", "lent_at", "confidence", "source", "source_id", "shelf", "created",
)
# Reading states in the order in which they are shown.
STATUSES = ["unknown", "read", "reading", "to_read", "abandoned"]


@dataclass
class Filters:
    """What a reader asks for: values of one facet are alternatives, facets add up; empty ones do not restrict."""

    q: str = ""
    topics: list[str] = field(default_factory=list)
    statuses: list[str] = field(default_factory=list)
    authors: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    decades: list[int] = field(default_factory=list)
    needs_review: bool = False
    favourites: bool = False
    lent: bool = False

    def active(self) -> int:
        """Number of facets that restrict."""
        return sum(bool(v.strip() if isinstance(v, str) else v) for v in vars(self).values())


def topic_keys() -> Column:
    """Category first, then topics, each once."""
    category = F.when(F.coalesce("category", F.lit("")) != "", F.array("category")).otherwise(F.array().cast("array<string>"))
    topics = F.filter(F.coalesce("topics", F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))
    return F.array_distinct(F.concat(category, topics))


def primary_category() -> Column:
    """The category, else the first topic, else null."""
    return F.get(topic_keys(), 0)


def pending_review() -> Column:
    return F.coalesce(F.col("needs_review") & ~F.coalesce("reviewed", F.lit(False)), F.lit(False))


def lent() -> Column:
    return F.coalesce(F.trim("lent_to") != "", F.lit(False)) | F.col("lent_at").isNotNull()


def language_code(c: str) -> Column:
    """Trimmed lower-case code, null if empty."""
    code = F.lower(F.trim(F.col(c)))
    return F.when(code != "", code)


def _any(values: list, keys: Column) -> Column:
    return F.arrays_overlap(keys, F.array(*[F.lit(v) for v in values]))


def _folded(keys: Column) -> Column:
    return F.transform(keys, text.fold_for_search)


def _fold_values(values: list[str]) -> list[Column]:
    return [text.fold_for_search(F.lit(v)) for v in values]


def predicate(f: Filters) -> Column:
    """All facets of ``f`` as one condition; what can be pushed to the scan is written so."""
    out = F.lit(True)
    if f.q.strip():
        out &= text.matches_query(text.haystack(F.col("title"), F.col("author")), f.q)
    if f.topics:
        hit = _any(f.topics, topic_keys())
        out &= (hit | (F.size(topic_keys()) == 0)) if "other" in f.topics else hit
    if f.statuses:
        out &= F.col("status").isin(f.statuses)
    if f.authors:
        wanted = F.array(*_fold_values(f.authors))
        out &= F.arrays_overlap(F.concat(F.array(text.fold_for_search(F.col("author"))), _folded(text.split_authors(F.col("author")))), wanted)
    if f.tags:
        out &= F.coalesce(F.arrays_overlap(_folded(F.col("tags")), F.array(*_fold_values(f.tags))), F.lit(False))
    if f.sources:
        out &= F.col("source_id").isin(f.sources)
    if f.languages:
        out &= F.lower("language").isin([x.lower() for x in f.languages])
    if f.decades:
        out &= F.coalesce(numbers.decade(F.col("year")).isin(f.decades), F.lit(False))
    if f.needs_review:
        out &= pending_review()
    if f.favourites:
        out &= F.col("favourite")
    if f.lent:
        out &= lent()
    return F.coalesce(out, F.lit(False))


def credits(books: DataFrame, *keep: str) -> DataFrame:
    """One row for each distinct author of each record: id, key (folded), name, place (from 0) and ``keep``."""
    parted = books.select("id", *keep, F.posexplode(text.split_authors(F.col("author"))).alias("place", "name"))
    keyed = parted.withColumn("key", text.fold_for_search(F.col("name"))).where("key != ''")
    return keyed.groupBy("id", "key", *keep).agg(F.min(F.struct("place", "name")).alias("_n")).select("id", "key", *keep, "_n.place", "_n.name")


def author_groups(books: DataFrame) -> DataFrame:
    """(key, author, n, sort_name): one row an author, spelt and sorted as in the record that comes first on the shelf."""
    rows = credits(books.withColumn("_sort", names.sort_name(F.col("author"), F.col("author_sort"))), "shelf", "_sort")
    spelt = F.struct("shelf", "id", "name", F.when(F.col("place") == 0, F.coalesce("_sort", "name")).otherwise(F.col("name")).alias("sort_name"))
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.min(spelt).alias("_f")).select("key", F.col("_f.name").alias("author"), "n", F.col("_f.sort_name").alias("sort_name"))


def author_entries(books: DataFrame) -> DataFrame:
    """author_groups with index letter, the country named most often and languages by use."""
    guessed = names.guessed_sort_name(F.col("name"), F.col("language"), F.col("country"))
    rows = credits(books.withColumn("_sort", names.sort_name(F.col("author"), F.col("author_sort"))), "shelf", "_sort", "author_sort", "language", "country")
    rows = rows.withColumn("_l", language_code("language")).withColumn("_c", F.when((F.col("place") == 0) & (F.trim("country") != ""), F.upper(F.trim("country"))))
    known = (F.col("place") == 0) & (F.coalesce("author_sort", F.lit("")) != "")
    first, told = F.struct("shelf", "id", "name", guessed.alias("g")), F.when(known, F.struct("shelf", "id", "_sort"))
    one = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(first).alias("_f"), F.min(told).alias("_t"))
    one = one.select("key", F.col("_f.name").alias("author"), "n", F.coalesce("_t._sort", "_f.g").alias("sort_name"))
    by_use = F.struct((-F.col("m")).alias("m"), "v")
    languages = rows.where("_l is not null").groupBy("key", F.col("_l").alias("v")).agg(F.count("*").alias("m")).groupBy("key").agg(F.sort_array(F.collect_list(by_use)).alias("_ls"))
    countries = rows.where("_c is not null").groupBy("key", F.col("_c").alias("v")).agg(F.count("*").alias("m")).groupBy("key").agg(F.min(by_use).alias("_cs"))
    out = one.join(languages, "key", "left").join(countries, "key", "left")
    listed = F.coalesce(F.transform("_ls", lambda x: x["v"]), F.array().cast("array<string>"))
    return out.select("key", "author", "n", "sort_name", names.index_letter(F.col("sort_name")).alias("letter"), F.col("_cs.v").alias("country"), listed.alias("languages"))


def anonymous(books: DataFrame) -> DataFrame:
    """Records without an author."""
    return books.where(F.size(text.split_authors(F.col("author"))) == 0)


def tag_counts(books: DataFrame) -> DataFrame:
    """(tag, n): tags that fold alike are one, spelt as on the first shelf place; a record counts once a spelling."""
    rows = books.select("shelf", "id", F.explode(F.array_distinct("tags")).alias("tag")).withColumn("k", text.fold(F.col("tag")))
    return rows.groupBy("k").agg(F.min(F.struct("shelf", "id", "tag"))["tag"].alias("tag"), F.count("*").alias("n")).drop("k")


def facets(books: DataFrame) -> DataFrame:
    """(facet, key, n) of topics, statuses, languages, decades, tags, authors and the three flags."""
    flags = {"pending_review": pending_review(), "favourite": F.col("favourite"), "lent": lent()}
    found = [("status", F.col("status")), ("language", language_code("language")), ("decade", numbers.decade(F.col("year")).cast("string")), *[("flag", F.when(c, F.lit(n))) for n, c in flags.items()]]
    flat = F.array(*[F.struct(F.lit(n).alias("facet"), c.alias("key")) for n, c in found])
    keys = F.when(F.size(topic_keys()) > 0, topic_keys()).otherwise(F.array(F.lit("other")))
    both = F.concat(flat, F.transform(keys, lambda k: F.struct(F.lit("topic").alias("facet"), k.alias("key"))))
    one = books.select(F.explode(both).alias("x")).where("x.key is not null").groupBy("x.facet", "x.key").agg(F.count("*").alias("n"))
    authors = author_groups(books).select(F.lit("author").alias("facet"), F.col("author").alias("key"), "n")
    tags = tag_counts(books).select(F.lit("tag").alias("facet"), F.col("tag").alias("key"), "n")
    return one.unionByName(authors).unionByName(tags)


def header_counts(books: DataFrame) -> DataFrame:
    """One row: records, authors, topics, pages (unknown ones as the median) and whether any was unknown."""
    known = F.when(F.col("pages") > 0, F.col("pages"))
    totals = books.agg(F.count("*").alias("books"), F.sum(known).alias("_sum"), F.count(known).alias("_known"), F.round(F.median(known)).alias("_median"))
    authors = credits(books).agg(F.countDistinct("key").alias("authors"))
    topics = books.select(F.explode(topic_keys()).alias("t")).agg(F.countDistinct("t").alias("topics"))
    each = F.when(F.col("_known") >= 3, F.col("_median")).otherwise(250)
    pages = F.round(F.coalesce("_sum", F.lit(0)) + (F.col("books") - F.col("_known")) * each).cast("long")
    return totals.join(authors).join(topics).select("books", "authors", "topics", pages.alias("pages"), (F.col("books") > F.col("_known")).alias("estimated"))


def translation(books: DataFrame) -> DataFrame:
    """One row: translated, known, share, of the records whose two languages are known; regions of a language are alike."""
    base = lambda c: F.element_at(F.split(language_code(c), "-"), 1)
    known = base("language").isNotNull() & base("original_language").isNotNull()
    out = books.agg(F.count(F.when(known & (base("language") != base("original_language")), 1)).alias("translated"), F.count(F.when(known, 1)).alias("known"))
    return out.select("translated", "known", numbers.share(F.col("translated"), F.col("known")).alias("share"))


def category_slices(books: DataFrame, palette: DataFrame, slots: int = 7) -> DataFrame:
    """(key, n, share, slot): categories that rank in ``palette`` keep their slot there; the others and records without one fold."""
    count = lambda df: df.groupBy(primary_category().alias("key")).agg(F.count("*").alias("n"))
    # The slots' keys: a top-k of the palette's categories.
    top = count(palette).where("key is not null").orderBy(F.desc("n"), "key").limit(slots)
    slot = top.select("key", (F.row_number().over(Window.orderBy(F.desc("n"), "key")) - 1).alias("slot"))
    rows = count(books).join(F.broadcast(slot), "key", "left")
    name = F.when(F.col("key").isNull(), "__none").when(F.col("slot").isNull(), "__other").otherwise(F.col("key"))
    out = rows.groupBy(name.alias("key"), "slot").agg(F.sum("n").alias("n"))
    return out.join(books.agg(F.count("*").alias("_all"))).select("key", "n", numbers.share(F.col("n"), F.col("_all")).alias("share"), "slot")


def with_sort_keys(books: DataFrame) -> DataFrame:
    """``books`` with the keys of all orders as columns, worked out once a record: no sort works them out in its comparisons."""
    author = names.sort_name(F.col("author"), F.col("author_sort"))
    by_author = names.let(author, lambda a: F.when(a.isNotNull(), names.collation_key(a)))
    return books.withColumns({"_author_key": by_author, "_title_key": names.collation_key(names.title_sort_name(F.col("title"))), "_year_key": numbers.valid_year(F.col("year"))})


def sort_order(key: str) -> list[Column]:
    """Order of ``with_sort_keys`` by ``author``, ``title``, ``year``, ``added``, ``rating`` or ``shelf``; missing values last, then the shelf."""
    by_author, by_title = F.asc_nulls_last("_author_key"), F.asc("_title_key")
    shelf = [F.col("shelf").asc(), F.col("created").asc(), F.col("id").asc()]
    rating = [F.desc_nulls_last("rating"), F.desc("favourite"), by_title]
    found = {"author": [by_author, by_title], "title": [by_title, by_author], "year": [F.asc_nulls_last("_year_key"), by_author, by_title], "added": [F.desc_nulls_last("created")], "rating": rating, "shelf": []}
    return [*found[key], *shelf]


def letter_groups(books: DataFrame) -> DataFrame:
    """(letter, place, n, first): index letters of the authors with their place in the alphabet, ``first`` the least sort name."""
    name = names.sort_name(F.col("author"), F.col("author_sort"))
    rows = books.select(names.index_letter(name).alias("letter"), name.alias("name"))
    return rows.groupBy("letter").agg(F.count("*").alias("n"), F.min("name").alias("first")).withColumn("place", names.letter_order(F.col("letter")))


def index_rail(spark, groups: DataFrame) -> DataFrame:
    """(letter, place, enabled): the whole alphabet, further letters that occur and ``#``."""
    every = spark.createDataFrame([(a,) for a in [*names.ALPHABET, "#"]], "letter string").union(groups.select("letter")).distinct()
    return every.join(groups.select("letter", F.lit(True).alias("enabled")), "letter", "left").select("letter", names.letter_order(F.col("letter")).alias("place"), F.coalesce("enabled", F.lit(False)).alias("enabled"))


def topic_sections(books: DataFrame, least: int = 2) -> DataFrame:
    """(category, topic, n): topics within each main category; those of fewer than ``least`` records fold into ``other``, a record once."""
    keyed = books.select("id", topic_keys().alias("_keys")).select("id", F.coalesce(F.get("_keys", 0), F.lit("other")).alias("category"), F.slice("_keys", F.lit(2), F.greatest(F.size("_keys"), F.lit(1))).alias("_rest"))
    rows = keyed.select("id", "category", F.explode_outer("_rest").alias("topic"))
    counts = rows.where("topic is not null").groupBy("category", "topic").agg(F.count("*").alias("m"))
    named = rows.join(counts, ["category", "topic"], "left").select("id", "category", F.when(F.coalesce("m", F.lit(0)) >= least, F.col("topic")).otherwise("other").alias("topic"))
    return named.distinct().groupBy("category", "topic").agg(F.count("*").alias("n"))


def unread_pool(books: DataFrame) -> DataFrame:
    """Records to be read, or, if there is none, those without a state."""
    any_ = books.agg(F.max(F.col("status") == "to_read").alias("_any"))
    return books.join(any_).where((F.col("status") == "to_read") | (~F.col("_any") & (F.col("status") == "unknown"))).drop("_any")


def recommendation_pool(books: DataFrame) -> DataFrame:
    """``books`` of the first tier that is not empty, with ``tier``: to read, without a state, unfinished, favourites, all."""
    tier = F.when(F.col("status") == "to_read", 1).when((F.col("status") == "unknown") | ~F.col("status").isin(STATUSES) | F.col("status").isNull(), 2).when(F.col("status").isin("reading", "abandoned"), 3).when(F.col("favourite"), 4).otherwise(5)
    ranked = books.withColumn("tier", tier)
    return ranked.join(ranked.agg(F.min("tier").alias("_t"))).where("tier = _t").drop("_t")


def owner_data() -> Column:
    """True if the owner has put something of their own on the record."""
    filled = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    return (F.coalesce("rating", F.lit(0)) > 0) | F.coalesce("favourite", F.lit(False)) | (F.coalesce("status", F.lit("unknown")) != "unknown") | filled("lent_to") | F.col("lent_at").isNotNull() | (F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0)


def survivor_score() -> Column:
    """Which of several alike records is kept: the owner's data, then no open review, then a source by hand, then confidence."""
    return F.when(owner_data(), 8).otherwise(0) + F.when(pending_review(), 0).otherwise(4) + F.when(F.col("source") == "manual", 1).otherwise(0) + F.col("confidence")


def survivors(books: DataFrame, group: Column) -> DataFrame:
    """(g, keep): of each group the id of the record to keep; ties go to the shelf."""
    best = F.struct((-survivor_score()).alias("s"), "shelf", "id")
    return books.select(group.alias("g"), best.alias("b")).groupBy("g").agg(F.min("b")["id"].alias("keep"))


def duplicates(books: DataFrame, least: float = 0.85, compatible: Callable[[Column, Column], Column] | None = None, original: str | None = None) -> DataFrame:
    """(a, b, kind, score), a < b: records of one title key (exact), or of keys that are similar or begin with each other (similar).

    Titles with different volume numbers never match as similar ones, nor do keys under four signs.  With ``compatible``, a
    condition on two author fields, records of authors that do not agree never match; with ``original``, a column of
    original titles, a record also is an exact match of those whose title is its original one.  Keys and authors are
    compared once, whatever number of records bears them; records of one key and author meet through the first of
    them (by id), not in pairs.  A pair that is exact is not told as similar.
    """
    from vellum.operators.joins import similar_pairs

    author = F.col("author") if compatible else F.lit(None).cast("string")
    keyed = books.select("id", author.alias("w"), text.title_key(F.col("title")).alias("k"), text.volume_numbers(F.col("title")).alias("v"), (text.title_key(F.col(original)) if original else F.lit("")).alias("o"))
    keyed = keyed.where(F.length(F.replace("k", F.lit(" "), F.lit(""))) >= 2)
    heads = staged(keyed.groupBy("k", "w").agg(F.min(F.struct("id", "v")).alias("h")).select("k", "w", F.col("h.id").alias("head"), F.col("h.v").alias("v")))
    agree = (lambda x, y: compatible(F.col(x), F.col(y))) if compatible else (lambda x, y: F.lit(True))
    pair = lambda df, kind, score: df.where("ia != ib").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), F.lit(kind).alias("kind"), score.alias("score"))
    same = keyed.join(heads.select("k", F.col("w").alias("_w"), "head"), (keyed["k"] == heads["k"]) & keyed["w"].eqNullSafe(F.col("_w"))).select(F.col("id").alias("ia"), F.col("head").alias("ib"))
    exact = pair(same, "exact", F.lit(1.0))
    x, y = heads.toDF("k", "wa", "ia", "va"), heads.toDF("k", "wb", "ib", "vb")
    if compatible:
        exact = exact.unionByName(pair(x.join(y, "k").where("ia < ib").where(agree("wa", "wb")), "exact", F.lit(1.0)))
    if original:
        told = keyed.where("o != '' and o != k").select(F.col("id").alias("ia"), F.col("w").alias("wa"), F.col("o").alias("k"))
        exact = exact.unionByName(pair(told.join(y, "k").where(agree("wa", "wb")), "exact", F.lit(1.0)))
    exact = exact.distinct()
    names_ = heads.where(F.length("k") >= 4).select("k").distinct()
    found = similar_pairs(names_, "k", "k", 0.3, least, "edit").select("a", "b")
    # Beginnings of a key, word by word, meet the keys that they are.
    words = F.split("k", " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    begun = names_.where(F.contains("k", F.lit(" "))).select(F.col("k").alias("b"), F.explode(starts).alias("a")).join(names_.toDF("a"), "a", "left_semi").where(names.is_title_prefix(F.col("a"), F.col("b")))
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(begun.select(F.least("a", "b"), F.greatest("a", "b"))).distinct()
    met = found.join(x.withColumnRenamed("k", "a"), "a").join(y.withColumnRenamed("k", "b"), "b").where(~text.volumes_conflict(F.col("va"), F.col("vb"))).where(agree("wa", "wb"))
    similar = pair(met.withColumn("_s", text.edit_ratio(F.col("a"), F.col("b"))).drop("a", "b"), "similar", F.col("_s"))
    return exact.unionByName(similar.join(exact.select("a", "b"), ["a", "b"], "left_anti"))


def reader_row() -> list[Column]:
    """Columns of a reading tracker's import: author in Western order, exclusive shelf, all shelves."""
    shelf = F.when(F.col("status") == "read", "read").when(F.col("status") == "reading", "currently-reading").otherwise("to-read")
    more = [F.when(F.col("favourite"), "favorites"), F.when(F.col("status") == "abandoned", "did-not-finish")]
    rating = F.when(F.col("rating") > 0, F.least(F.round("rating"), F.lit(5)).cast("int")).otherwise(0)
    return [F.col("title"), F.coalesce(names.first_author(F.col("author")), F.lit("")).alias("author"), rating.alias("rating"), F.col("year"), shelf.alias("exclusive_shelf"), F.concat_ws(", ", shelf, *more).alias("shelves")]


def words_of_titles(books: DataFrame, stop: list[str], least: int = 3) -> DataFrame:
    """(word, n): words of titles with ``least`` letters or more that are neither numbers nor among ``stop`` (the caller's list), once a record."""
    found = F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)
    rows = books.select(F.explode(F.array_distinct(found)).alias("word")).where((F.length("word") >= least) & ~F.col("word").rlike(r"^\p{N}+$"))
    return rows.where(~F.col("word").isin(stop)).groupBy("word").agg(F.count("*").alias("n"))


def fun_facts(books: DataFrame, stop: list[str], a_day: int = 30) -> DataFrame:
    """One row: oldest and newest record, longest title, most common title word, unread pages and the days they take, fullest decade."""
    year = numbers.valid_year(F.col("year"))
    title = F.trim(F.coalesce("title", F.lit("")))
    pick = lambda rank, what="id": F.min(F.when(rank.isNotNull(), F.struct(rank.alias("r"), F.lower("title").alias("t"), "id")))["id"].alias(what)
    known = F.when(F.col("pages") > 0, F.col("pages"))
    unread = F.coalesce("status", F.lit("unknown")) != "read"
    one = books.agg(
        pick(year, "oldest"), pick(-year, "newest"), pick(F.when(F.length(title) > 0, -F.length(title)), "longest"), F.count_if(unread).alias("unread"),
        F.sum(F.when(unread, known)).alias("_sum"), F.count(F.when(unread, known)).alias("_known"), F.count(known).alias("_all"), F.round(F.median(known)).alias("_median"),
    )
    best = lambda df, *order: df.orderBy(*order).limit(1)
    word = best(words_of_titles(books, stop).where("n >= 2"), F.desc("n"), F.desc(F.length("word")), "word").select("word", F.col("n").alias("word_count"))
    decade = best(books.select(numbers.decade(F.col("year")).alias("decade")).where("decade is not null").groupBy("decade").agg(F.count("*").alias("decade_count")), F.desc("decade_count"), F.desc("decade"))
    each = F.when(F.col("_all") >= 3, F.col("_median")).otherwise(250)
    pages = F.round(F.coalesce("_sum", F.lit(0)) + (F.col("unread") - F.col("_known")) * each).cast("long")
    out = one.join(word, F.lit(True), "left").join(decade, F.lit(True), "left")  # one row each
    return out.select("oldest", "newest", "longest", "word", "word_count", "decade", "decade_count", "unread", pages.alias("unread_pages"), F.ceil(pages / a_day).cast("long").alias("reading_days"))


def dashboard(books: DataFrame) -> DataFrame:
    """(name, key, value) of a catalogue: totals, shares, states, confidence bands, sources, and the ten foremost authors."""
    quality = F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    band = F.when(quality < 0.6, "low").when(quality < 0.8, "medium").otherwise("high")
    status = F.when(F.col("status").isin(STATUSES), F.col("status")).otherwise("unknown")
    one = lambda name, key: F.struct(F.lit(name).alias("name"), key.alias("key"))
    hits = F.array(one("total", F.lit("books")), one("total", F.when(F.col("favourite"), "favourites")), one("total", F.when(pending_review(), "pending")), one("total", F.when(F.col("reviewed"), "reviewed")), one("status", status), one("confidence", band), one("source", F.col("source")))
    counts = books.select(F.explode(hits).alias("x")).where("x.key is not null").groupBy("x.name", "x.key").agg(F.count("*").cast("double").alias("value"))
    # States that no record has are there with 0.
    dense = books.sparkSession.createDataFrame([("status", s) for s in STATUSES], "name string, key string").join(counts.where("name = 'status'"), ["name", "key"], "left").select("name", "key", F.coalesce("value", F.lit(0.0)).alias("value"))
    read = books.agg((F.count_if(F.col("status") == "read") / F.count("*")).alias("read"), F.avg(F.when(F.col("source") != "manual", quality)).alias("confidence"))
    shares = read.select(F.explode(F.array(*[F.struct(F.lit("mean").alias("name"), F.lit(c).alias("key"), F.col(c).alias("value")) for c in ("read", "confidence")])).alias("x")).select("x.*")
    groups = author_groups(books)
    top = groups.orderBy(F.desc("n"), "key").limit(10).select(F.lit("author").alias("name"), F.col("author").alias("key"), F.col("n").cast("double").alias("value"))
    many = groups.agg(F.count("*").cast("double").alias("value")).select(F.lit("total").alias("name"), F.lit("authors").alias("key"), "value")
    return counts.where("name <> 'status'").unionByName(dense).unionByName(shares).unionByName(top).unionByName(many)


def read_model(books: DataFrame, owner: Column, private: list[str]) -> DataFrame:
    """Records as a reader sees them: the owner's own columns are null for everyone else."""
    return books.select(*[F.when(owner, F.col(c)).alias(c) if c in private else F.col(c) for c in books.columns])


def unassigned(detections: DataFrame, record: str, books: DataFrame, key: str = "id") -> DataFrame:
    """Detections whose record is missing or gone."""
    return detections.join(books.select(F.col(key).alias("_k")), F.col(record) == F.col("_k"), "left_anti")


def incomplete(books: DataFrame, columns: list[str]) -> DataFrame:
    """Records that lack one of ``columns`` and have not been gone through, in shelf order."""
    lacks = F.lit(False)
    for c in columns:
        lacks |= F.col(c).isNull()
    return books.where(lacks & ~F.coalesce("reviewed", F.lit(False)))
