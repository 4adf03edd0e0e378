"""Queries over a catalogue of records, made from ``part`` by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions import names, numbers, text
from vellum.operators import catalogue as C
from vellum.storage import staged, table

QUERIES, ORACLE_SQL = {}, {}

#: Given and family names of the made-up authors.
GIVEN = ["Anna", "Péter", "Émile", "Zsófia", "John"]
FAMILY = ["Kovács", "Szabó", "Tolkien", "Müller", "Gyarmati", "Østergård", "Lem", "Christie", "Csáth", "Dzsida", "Ady"]


def _pick(values: list[str], n: str) -> str:
    return f"CASE {n} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_K = "p_partkey"
_THIRD = f"CAST(floor({_K} / 3.0) AS BIGINT)"
_G, _FAM, _G2, _F2 = _pick(GIVEN, f"{_K} % 5"), _pick(FAMILY, f"{_THIRD} % 11"), _pick(GIVEN, f"({_K} + 2) % 5"), _pick(FAMILY, f"({_THIRD} + 4) % 11")
#: Column of a record: expression over ``part``; arrays are texts parted by ``;`` here.
RECORD = {
    "id": _K,
    "title": f"CASE WHEN {_K} % 6 = 0 THEN 'The ' || p_name WHEN {_K} % 6 = 1 THEN 'Az ' || p_name ELSE p_name END",
    "author": f"CASE WHEN {_K} % 13 = 0 THEN NULL WHEN {_K} % 6 = 0 THEN {_G} || ' ' || {_FAM} || '; ' || {_G2} || ' ' || {_F2} WHEN {_K} % 7 = 0 THEN {_FAM} || ' ' || {_G} ELSE {_G} || ' ' || {_FAM} END",
    "author_sort": f"CASE WHEN {_K} % 4 = 1 OR {_K} % 13 = 0 THEN NULL ELSE {_FAM} || ' ' || {_G} END",
    "category": f"CASE WHEN {_K} % 9 = 0 THEN NULL ELSE lower(p_type) END",
    "topics": f"CASE WHEN {_K} % 10 = 0 THEN '' WHEN {_K} % 4 = 0 THEN lower(p_type) || ';' || p_brand ELSE p_brand END",
    "tags": f"CASE {_K} % 5 WHEN 0 THEN 'Gift' WHEN 1 THEN 'gift;Új' WHEN 2 THEN 'ÚJ' ELSE '' END",
    "language": f"CASE {_K} % 6 WHEN 0 THEN 'hu' WHEN 1 THEN 'en' WHEN 2 THEN 'EN ' WHEN 3 THEN NULL WHEN 4 THEN 'de' ELSE 'en-GB' END",
    "original_language": f"CASE {_K} % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'hu' WHEN 2 THEN 'de' WHEN 3 THEN NULL ELSE 'fr' END",
    "country": f"CASE {_THIRD} % 4 WHEN 0 THEN 'hu' WHEN 1 THEN 'GB' WHEN 2 THEN NULL ELSE 'de' END",
    "year": f"CAST(CASE WHEN {_K} % 17 = 0 THEN NULL ELSE 1700 + ({_K} * 37) % 325 END AS INT)",
    "status": _pick(C.STATUSES, f"({_K} * 3) % 5"),
    "pages": f"CASE WHEN {_K} % 3 = 0 THEN NULL ELSE 80 + p_size * 9 END",
    "rating": f"CAST(CASE WHEN {_K} % 4 = 0 THEN NULL ELSE {_K} % 6 END AS INT)",
    "favourite": f"{_K} % 10 = 3",
    "needs_review": f"{_K} % 7 = 2",
    "reviewed": f"{_K} % 14 = 2",
    "lent_to": f"CASE WHEN {_K} % 23 = 5 THEN 'Kata' WHEN {_K} % 23 = 6 THEN ' ' END",
    "lent_at": f"CASE WHEN {_K} % 29 = 5 THEN '2024-01-05' END",
    "confidence": f"CAST(({_K} % 101) / 100.0 AS DOUBLE)",
    "source": f"CASE WHEN {_K} % 20 = 0 THEN 'manual' WHEN {_K} % 20 = 1 THEN 'image' ELSE 'video' END",
    "source_id": f"'s' || CAST({_K} % 12 AS STRING)",
    "shelf": f"({_K} * 7919) % 2003",
    "created": f"{_K} % 1000",
}


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(*[F.expr(e).alias(c) for c, e in RECORD.items()])
    parted = lambda c: F.filter(F.split(c, ";"), lambda x: x != "").alias(c)
    return part.withColumn("topics", parted("topics")).withColumn("tags", parted("tags"))


#: DuckDB's view of the records: arrays, authors, folded names; ``fold`` as the library does it for these letters.
_BOOKS = "WITH r AS (SELECT " + ", ".join(f"{e.replace('AS STRING', 'AS VARCHAR')} AS {c}" for c, e in RECORD.items()) + """ FROM part),
b AS (SELECT * REPLACE (list_filter(string_split(topics, ';'), lambda x: x <> '') AS topics, list_filter(string_split(tags, ';'), lambda x: x <> '') AS tags),
 list_distinct(list_filter(list_concat([category], list_filter(string_split(topics, ';'), lambda x: x <> '')), lambda x: x IS NOT NULL)) AS keys,
 coalesce(category, list_filter(string_split(topics, ';'), lambda x: x <> '')[1]) AS prime,
 CASE WHEN author IS NULL THEN [] ELSE string_split(author, '; ') END AS authors, CAST(floor(year / 10.0) * 10 AS INT) AS decade,
 needs_review AND NOT reviewed AS pending, coalesce(trim(lent_to) <> '', false) OR lent_at IS NOT NULL AS lent, nullif(lower(trim(language)), '') AS lang FROM r),
a AS (SELECT id, shelf, p - 1 AS place, authors[p] AS name, strip_accents(lower(replace(authors[p], 'Ø', 'o'))) AS key, author_sort, country, lang FROM b, range(1, 3) t(p) WHERE p <= len(authors)),
s AS (SELECT id, CASE WHEN author_sort IS NULL THEN authors[1] ELSE author_sort END AS sort_name FROM b)
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = _BOOKS + sql
        return f

    return add


@query("""SELECT id, title FROM b WHERE (list_contains(keys, 'economy') OR list_contains(keys, 'Brand#17') OR len(keys) = 0) AND status IN ('read', 'unknown', 'to_read')
AND len(list_filter(tags, lambda t: strip_accents(lower(t)) IN ('gift', 'uj'))) > 0 AND contains(lower(title), 'e')""")
def filter_topics_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = C.Filters(q="É", topics=["economy", "Brand#17", "other"], statuses=["read", "unknown", "to_read"], tags=["GIFT", "új"])
    rows = books(spark, sf_dir)
    return rows.withColumn("author", F.lit(None).cast("string")).where(C.predicate(wanted)).select("id", "title")


@query("""SELECT id FROM b WHERE EXISTS (SELECT 1 FROM a WHERE a.id = b.id AND key IN ('anna szabo', 'john tolkien', 'ostergard zsofia', 'peter muller')) AND lower(language) IN ('hu', 'en', 'en-gb') AND decade BETWEEN 1800 AND 1990""")
def filter_authors_decades(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = C.Filters(authors=["anna SZABÓ", "John Tolkien", "Østergård Zsófia", "Péter Müller"], languages=["HU", "en", "en-gb"], decades=list(range(1800, 2000, 10)))
    return books(spark, sf_dir).where(C.predicate(wanted)).select("id")


@query("""SELECT id, 'review' AS flag FROM b WHERE pending UNION ALL SELECT id, 'favourite' FROM b WHERE favourite UNION ALL SELECT id, 'lent' FROM b WHERE lent UNION ALL SELECT id, 'source' FROM b WHERE source_id IN ('s1', 's7')""")
def filter_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = books(spark, sf_dir)
    asked = {"review": C.Filters(needs_review=True), "favourite": C.Filters(favourites=True), "lent": C.Filters(lent=True), "source": C.Filters(sources=["s1", "s7"])}
    hits = F.array(*[F.when(C.predicate(f), F.lit(n)) for n, f in asked.items()])
    return rows.select("id", F.explode(hits).alias("flag")).where("flag is not null")


@query("""SELECT key, count(DISTINCT id) AS n, arg_min(name, (shelf, id)) AS author, arg_min(CASE WHEN place = 0 THEN coalesce(author_sort, name) ELSE name END, (shelf, id)) AS sort_name FROM a GROUP BY key""")
def author_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.author_groups(books(spark, sf_dir))


@query("""SELECT facet, key, count(*) AS n FROM (
SELECT 'status' AS facet, status AS key FROM b UNION ALL SELECT 'language', lang FROM b UNION ALL SELECT 'decade', CAST(decade AS VARCHAR) FROM b UNION ALL SELECT 'flag', 'pending_review' FROM b WHERE pending
UNION ALL SELECT 'flag', 'favourite' FROM b WHERE favourite UNION ALL SELECT 'flag', 'lent' FROM b WHERE lent UNION ALL SELECT 'topic', unnest(CASE WHEN len(keys) = 0 THEN ['other'] ELSE keys END) FROM b) WHERE key IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT 'author', arg_min(name, (shelf, id)), count(DISTINCT id) FROM a GROUP BY key
UNION ALL SELECT 'tag', arg_min(tag, (shelf, id, tag)), count(*) FROM (SELECT id, shelf, unnest(list_distinct(tags)) AS tag FROM b) GROUP BY strip_accents(lower(tag))""")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.facets(books(spark, sf_dir))


@query("""SELECT arg_min(tag, (shelf, id, tag)) AS tag, count(*) AS n FROM (SELECT id, shelf, unnest(list_distinct(tags)) AS tag FROM b) GROUP BY strip_accents(lower(tag))""")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tag_counts(books(spark, sf_dir))


@query("""SELECT count(*) AS books, (SELECT count(DISTINCT key) FROM a) AS authors, (SELECT count(DISTINCT k) FROM (SELECT unnest(keys) AS k FROM b)) AS topics,
CAST(round(sum(pages) + (count(*) - count(pages)) * round(median(pages))) AS BIGINT) AS pages, count(*) > count(pages) AS estimated FROM b""")
def header_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.header_counts(books(spark, sf_dir))


@query("""SELECT count(*) FILTER (string_split(lang, '-')[1] <> original_language) AS translated, count(*) FILTER (lang IS NOT NULL AND original_language IS NOT NULL) AS known,
count(*) FILTER (string_split(lang, '-')[1] <> original_language) / count(*) FILTER (lang IS NOT NULL AND original_language IS NOT NULL) AS share FROM b""")
def translation_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.translation(books(spark, sf_dir))


_NAMES = """, first AS (SELECT key, count(DISTINCT id) AS n, arg_min(name, (shelf, id)) AS author, arg_min(CASE WHEN upper(country) = 'HU' OR (country IS NULL AND lang = 'hu') THEN name
 ELSE string_split(name, ' ')[2] || ' ' || string_split(name, ' ')[1] END, (shelf, id)) AS guess, arg_min(author_sort, (shelf, id)) FILTER (place = 0 AND author_sort IS NOT NULL) AS told FROM a GROUP BY key),
langs AS (SELECT key, list(lang ORDER BY m DESC, lang) AS languages FROM (SELECT key, lang, count(*) AS m FROM a WHERE lang IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
lands AS (SELECT key, arg_min(c, (-m, c)) AS country FROM (SELECT key, upper(country) AS c, count(*) AS m FROM a WHERE place = 0 AND country IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
named AS (SELECT key, author, n, coalesce(told, guess) AS sort_name, lands.country, languages FROM first LEFT JOIN langs USING (key) LEFT JOIN lands USING (key))
"""
_LETTER = """CASE WHEN {0} IS NULL THEN '#' WHEN starts_with(lower({0}), 'dzs') THEN 'Dzs' WHEN lower(substr({0}, 1, 2)) IN ('cs', 'dz', 'gy', 'ly', 'ny', 'sz', 'ty', 'zs')
 THEN upper(substr({0}, 1, 1)) || lower(substr({0}, 2, 1)) ELSE upper(strip_accents(replace(substr({0}, 1, 1), 'Ø', 'O'))) END"""


@query(_NAMES + f"SELECT key, author, n, sort_name, {_LETTER.format('sort_name')} AS letter, country, array_to_string(languages, ',') AS languages FROM named")
def author_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.author_entries(books(spark, sf_dir)).withColumn("languages", F.when(F.size("languages") > 0, F.array_join("languages", ",")))


@query("""SELECT id, sort_name, CASE WHEN b.author IS NULL THEN NULL WHEN b.author_sort IS NULL OR b.authors[1] = b.author_sort THEN CASE WHEN b.author_sort IS NULL THEN b.authors[1] ELSE string_split(b.author_sort, ' ')[1] END
 ELSE string_split(b.author_sort, ' ')[1] END AS family FROM b JOIN s USING (id)""")
def author_sort_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    author, key = F.col("author"), F.col("author_sort")
    return books(spark, sf_dir).select("id", names.sort_name(author, key).alias("sort_name"), names.family_name(author, key).alias("family"))


@query(f"SELECT letter, count(*) AS n, min(sort_name) AS first FROM (SELECT sort_name, {_LETTER.format('sort_name')} AS letter FROM s) GROUP BY 1")
def letter_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.letter_groups(books(spark, sf_dir)).drop("place")


_RAIL = ", ".join(f"('{a}', {i})" for i, a in enumerate(names.ALPHABET))


@query(f""", l AS (SELECT DISTINCT {_LETTER.format('sort_name')} AS letter FROM s), k AS (SELECT * FROM (VALUES {_RAIL}, ('#', {len(names.ALPHABET) + 1})) v(letter, place))
SELECT coalesce(k.letter, l.letter) AS letter, coalesce(place, {len(names.ALPHABET)}) AS place, l.letter IS NOT NULL AS enabled FROM k FULL JOIN l ON k.letter = l.letter""")
def index_rail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.index_rail(spark, C.letter_groups(books(spark, sf_dir)))


@query("SELECT id, CASE WHEN title LIKE 'The %' THEN substr(title, 5) WHEN title LIKE 'Az %' THEN substr(title, 4) ELSE title END AS sort_title FROM b")
def title_sort_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books(spark, sf_dir).select("id", names.title_sort_name(F.col("title")).alias("sort_title"))


_FOLD = "strip_accents(lower(replace({0}, 'Ø', 'o')))"
_BY_AUTHOR = f"sort_name IS NULL, {_FOLD.format('sort_name')}, sort_name"
_BY_TITLE = "lower(sort_title), sort_title"
_ORDERS = {
    "author": f"{_BY_AUTHOR}, {_BY_TITLE}",
    "title": f"{_BY_TITLE}, {_BY_AUTHOR}",
    "year": f"year IS NULL, year, {_BY_AUTHOR}, {_BY_TITLE}",
    "added": "created DESC",
    "rating": f"rating IS NULL, rating DESC, favourite DESC, {_BY_TITLE}",
    "shelf": "",
}


@query(", t AS (SELECT *, CASE WHEN title LIKE 'The %' THEN substr(title, 5) WHEN title LIKE 'Az %' THEN substr(title, 4) ELSE title END AS sort_title FROM b JOIN s USING (id)) "
       + " UNION ALL ".join(f"(SELECT '{k}' AS sort, id, CAST(row_number() OVER (ORDER BY {o + ', ' if o else ''}shelf, created, id) AS INT) AS place FROM t ORDER BY place LIMIT 40)" for k, o in _ORDERS.items()))
def library_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each of the six orders."""
    keys = ["id", "shelf", "created", "rating", "favourite", "_author_key", "_title_key", "_year_key"]
    rows, out = staged(C.with_sort_keys(books(spark, sf_dir)).select(*keys)), None
    for key in _ORDERS:
        page = rows.orderBy(*C.sort_order(key)).limit(40)  # a page: a top-k, not a sort of all
        placed = page.select(F.lit(key).alias("sort"), "id", F.row_number().over(Window.orderBy(*C.sort_order(key))).alias("place"))
        out = placed if out is None else out.unionByName(placed)
    return out


@query(""", k AS (SELECT id, coalesce(prime, 'other') AS category, list_filter(keys, lambda k: k <> prime) AS rest FROM b), e AS (SELECT id, category, unnest(CASE WHEN len(rest) = 0 THEN [NULL] ELSE rest END) AS topic FROM k),
c AS (SELECT category, topic, count(*) AS m FROM e WHERE topic IS NOT NULL GROUP BY 1, 2), n AS (SELECT DISTINCT e.id, e.category, CASE WHEN m >= 2 THEN e.topic ELSE 'other' END AS topic FROM e LEFT JOIN c ON c.category = e.category AND c.topic = e.topic)
SELECT category, topic, count(*) AS n FROM n GROUP BY 1, 2""")
def topic_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.topic_sections(books(spark, sf_dir))


@query(""", p AS (SELECT prime, count(*) AS n FROM b WHERE id % 2 = 0 GROUP BY 1), t AS (SELECT prime, row_number() OVER (ORDER BY n DESC, prime) - 1 AS slot FROM p WHERE prime IS NOT NULL ORDER BY slot LIMIT 3)
SELECT CASE WHEN b.prime IS NULL THEN '__none' WHEN slot IS NULL THEN '__other' ELSE b.prime END AS key, slot, count(*) AS n, count(*) / (SELECT count(*) FROM b) AS share FROM b LEFT JOIN t ON b.prime = t.prime GROUP BY 1, 2""")
def category_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = books(spark, sf_dir)
    return C.category_slices(rows, rows.where("id % 2 = 0"), 3)


@query("SELECT id, 'unread' AS pool, 0 AS tier FROM b WHERE status = 'to_read' UNION ALL SELECT id, 'next', CASE WHEN status IN ('reading', 'abandoned') THEN 3 END FROM b WHERE status IN ('reading', 'abandoned')")
def reading_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to read; and what to read when nothing waits: the unfinished ones."""
    rows = books(spark, sf_dir)
    one = C.unread_pool(rows).select("id", F.lit("unread").alias("pool"), F.lit(0).alias("tier"))
    return one.unionByName(C.recommendation_pool(rows.where("status in ('read', 'reading', 'abandoned')")).select("id", F.lit("next").alias("pool"), "tier"))


@query("SELECT id, lead(id) OVER w AS next, lag(id) OVER w AS previous, coalesce(lead(id) OVER w, lag(id) OVER w) AS after_removal FROM b WHERE pending WINDOW w AS (PARTITION BY source_id ORDER BY shelf, created, id)")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open reviews of each source in shelf order, with the one that follows when a record leaves."""
    w = Window.partitionBy("source_id").orderBy("shelf", "created", "id")
    rows = books(spark, sf_dir).where(C.pending_review())
    return rows.select("id", F.lead("id").over(w).alias("next"), F.lag("id").over(w).alias("previous"), F.coalesce(F.lead("id").over(w), F.lag("id").over(w)).alias("after_removal"))


@query("""SELECT title AS g, arg_min(id, (-(CASE WHEN coalesce(rating, 0) > 0 OR favourite OR status <> 'unknown' OR lent OR len(tags) > 0 THEN 8 ELSE 0 END + CASE WHEN pending THEN 0 ELSE 4 END
+ CASE WHEN source = 'manual' THEN 1 ELSE 0 END + confidence), shelf, id)) AS keep FROM b GROUP BY title""")
def survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.survivors(books(spark, sf_dir), F.col("title"))


_KEYS = """, k AS (SELECT id, author, lower(CASE WHEN title LIKE 'The %' THEN substr(title, 5) WHEN title LIKE 'Az %' THEN substr(title, 4) ELSE title END) AS t FROM b)"""
_ALIKE = "(1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t)) >= 0.75 OR (starts_with(y.t, x.t || ' ') AND length(replace(x.t, ' ', '')) >= 6) OR (starts_with(x.t, y.t || ' ') AND length(replace(y.t, ' ', '')) >= 6))"


@query(_KEYS + f""", h AS (SELECT t, min(id) AS head FROM k GROUP BY t)
SELECT head AS a, id AS b, 'exact' AS kind, CAST(1.0 AS DOUBLE) AS score FROM k JOIN h USING (t) WHERE id <> head
UNION ALL SELECT least(x.head, y.head), greatest(x.head, y.head), 'similar', round(1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t)), 9) FROM h x JOIN h y ON x.t < y.t AND {_ALIKE}""")
def duplicate_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.duplicates(books(spark, sf_dir), 0.75).withColumn("score", F.round("score", 9))


@query(_KEYS + f""", e AS (SELECT id, author, CASE WHEN id % 3 = 0 THEN t[:position(' ' IN t || ' ') - 1] || ' ' || split_part(t, ' ', 2) ELSE t END AS t, CASE WHEN id % 5 = 0 THEN t END AS o FROM k), h AS (SELECT t, author, min(id) AS head FROM e GROUP BY 1, 2),
x AS (SELECT least(id, head) AS a, greatest(id, head) AS b FROM e JOIN h ON h.t = e.t AND h.author IS NOT DISTINCT FROM e.author WHERE id <> head
UNION SELECT x.head, y.head FROM h x JOIN h y ON x.t = y.t AND x.head < y.head AND (x.author IS NULL OR y.author IS NULL OR x.author = y.author)
UNION SELECT least(id, head), greatest(id, head) FROM e JOIN h ON h.t = e.o AND e.o <> e.t AND id <> head AND (h.author IS NULL OR e.author IS NULL OR h.author = e.author)),
z AS (SELECT least(x.head, y.head) AS a, greatest(x.head, y.head) AS b, round(1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t)), 9) AS score FROM h x JOIN h y ON x.t < y.t AND (x.author IS NULL OR y.author IS NULL OR x.author = y.author) AND {_ALIKE})
SELECT a, b, 'exact' AS kind, CAST(1.0 AS DOUBLE) AS score FROM x UNION ALL SELECT a, b, 'similar', score FROM z WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.a = z.a AND x.b = z.b)""")
def duplicate_suggestions_of_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of which a third is cut to two words, original titles, authors that must be the same or unknown."""
    key = text.title_key(F.col("title"))
    rows = books(spark, sf_dir).withColumn("original", F.when(F.col("id") % 5 == 0, key)).withColumn("title", F.when(F.col("id") % 3 == 0, F.array_join(F.slice(F.split(key, " "), 1, 2), " ")).otherwise(key))
    out = C.duplicates(rows, 0.75, lambda a, b: a.isNull() | b.isNull() | (a == b), "original")
    return out.withColumn("score", F.round("score", 9))


@query("""SELECT id, title, coalesce(authors[1], '') AS author, CASE WHEN rating > 0 THEN least(rating, 5) ELSE 0 END AS rating, year, CASE status WHEN 'read' THEN 'read' WHEN 'reading' THEN 'currently-reading' ELSE 'to-read' END AS exclusive_shelf,
concat_ws(', ', CASE status WHEN 'read' THEN 'read' WHEN 'reading' THEN 'currently-reading' ELSE 'to-read' END, CASE WHEN favourite THEN 'favorites' END, CASE WHEN status = 'abandoned' THEN 'did-not-finish' END) AS shelves FROM b""")
def tracker_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books(spark, sf_dir).select("id", *C.reader_row())


@query("SELECT id, length(title) - length(regexp_replace(strip_accents(title), '[^ -~]', '', 'g')) AS accents, strip_accents(lower(CASE WHEN author IS NULL THEN '' ELSE replace(authors[1], 'Ø', 'o') END)) AS folded, CASE WHEN upper(authors[1]) IS NULL THEN NULL ELSE authors[1] END AS cased FROM b")
def name_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in capitals in mixed case again."""
    first = names.first_author(F.col("author"))
    return books(spark, sf_dir).select("id", names.accents(F.col("title")).alias("accents"), text.fold(first).alias("folded"), names.name_case(F.upper(first)).alias("cased"))


STOP = ["the", "az", "red", "blue"]


@query(""", d AS (SELECT decade, count(*) AS n FROM b WHERE decade IS NOT NULL GROUP BY 1 ORDER BY n DESC, decade DESC LIMIT 1),
w AS (SELECT word, count(*) AS n FROM (SELECT id, unnest(list_distinct(string_split(lower(title), ' '))) AS word FROM b) WHERE length(word) >= 3 AND word NOT IN ('the', 'az', 'red', 'blue') GROUP BY 1 ORDER BY n DESC, length(word) DESC, word LIMIT 1),
p AS (SELECT CAST(round(sum(CASE WHEN status <> 'read' THEN coalesce(pages, (SELECT round(median(pages)) FROM b)) END)) AS BIGINT) AS pages FROM b)
SELECT (SELECT arg_min(id, (year, lower(title), id)) FROM b WHERE year IS NOT NULL) AS oldest, (SELECT arg_min(id, (-year, lower(title), id)) FROM b WHERE year IS NOT NULL) AS newest, (SELECT arg_min(id, (-length(title), lower(title), id)) FROM b) AS longest,
word, w.n AS word_count, decade, d.n AS decade_count, (SELECT count(*) FROM b WHERE status <> 'read') AS unread, pages AS unread_pages, CAST(ceil(pages / 30.0) AS BIGINT) AS reading_days FROM w, d, p""")
def fun_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fun_facts(books(spark, sf_dir), STOP)


@query(""", u AS (SELECT 'total' AS name, 'books' AS key FROM b UNION ALL SELECT 'total', 'favourites' FROM b WHERE favourite UNION ALL SELECT 'total', 'pending' FROM b WHERE pending UNION ALL SELECT 'total', 'reviewed' FROM b WHERE reviewed
 UNION ALL SELECT 'confidence', CASE WHEN confidence < 0.6 THEN 'low' WHEN confidence < 0.8 THEN 'medium' ELSE 'high' END FROM b UNION ALL SELECT 'source', source FROM b),
g AS (SELECT key AS k, arg_min(name, (shelf, id)) AS author, count(DISTINCT id) AS n FROM a GROUP BY 1)
SELECT name, key, CAST(count(*) AS DOUBLE) AS value FROM u GROUP BY 1, 2 UNION ALL SELECT 'status', s, CAST((SELECT count(*) FROM b WHERE status = s) AS DOUBLE) FROM (VALUES ('unknown'), ('read'), ('reading'), ('to_read'), ('abandoned')) v(s)
UNION ALL SELECT 'mean', 'read', count(*) FILTER (status = 'read') / count(*) FROM b UNION ALL SELECT 'mean', 'confidence', avg(confidence) FROM b WHERE source <> 'manual'
UNION ALL SELECT 'total', 'authors', CAST(count(*) AS DOUBLE) FROM g UNION ALL (SELECT 'author', author, CAST(n AS DOUBLE) FROM g ORDER BY n DESC, k LIMIT 10)""")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dashboard(books(spark, sf_dir))


@query("SELECT id, title, CASE WHEN source_id = 's3' THEN rating END AS rating, CASE WHEN source_id = 's3' THEN lent_to END AS lent_to FROM b")
def read_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.read_model(books(spark, sf_dir), F.col("source_id") == "s3", ["rating", "lent_to"]).select("id", "title", "rating", "lent_to")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT id FROM b WHERE NOT favourite) GROUP BY 1, 2")
def unassigned_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = books(spark, sf_dir).where("not favourite")
    return C.unassigned(table(spark, sf_dir, "lineitem"), "l_partkey", kept).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT id FROM b WHERE (language IS NULL OR year IS NULL OR category IS NULL) AND NOT reviewed")
def pending_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.incomplete(books(spark, sf_dir), ["language", "year", "category"]).select("id")


@query("""SELECT id, CASE WHEN lower(trim(language)) LIKE '__' OR lower(trim(language)) LIKE '__-%' THEN substr(lower(trim(language)), 1, 2) END AS lang, upper(country) AS land, CASE WHEN rating > 0 THEN repeat('★', rating) || repeat('☆', 5 - rating) ELSE '' END AS stars,
CAST(floor(ceil(coalesce(pages, 0) / 3.0) / 365) AS BIGINT) AS years, CAST(ceil(coalesce(pages, 0) / 3.0) % 365 AS BIGINT) AS days, lent_at IS NOT NULL AS dated FROM b""")
def code_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = books(spark, sf_dir)
    left = numbers.split_days(F.coalesce("pages", F.lit(0)) / 3)
    return rows.select("id", numbers.language(F.col("language")).alias("lang"), numbers.country(F.col("country")).alias("land"), numbers.stars(F.col("rating")).alias("stars"), *left, numbers.iso_valid(F.col("lent_at")).alias("dated"))


_EXPORT = """, x AS (SELECT b.*, CASE WHEN b.id % 4 = 0 THEN 'Part ' || b.id % 10 WHEN b.id % 4 = 1 THEN '' END AS subtitle, CASE b.id % 3 WHEN 0 THEN '978-0-306-40615-7' WHEN 1 THEN '0-306-40615-2' ELSE '12' END AS isbn, CASE WHEN b.id % 5 = 0 THEN NULL ELSE 'House ' || b.id % 3 END AS publisher, CASE WHEN b.id % 6 = 0 THEN NULL ELSE 1990 + b.id % 30 END AS edition_year,
DATE '2024-01-01' + CAST(b.id % 300 AS INT) AS day, 'note ' || b.id AS notes, b.id % 7 = 0 AS family_first FROM b)
"""
_SHELF = "CASE status WHEN 'read' THEN 'read' WHEN 'reading' THEN 'currently-reading' ELSE 'to-read' END"
_SHELVES = f"concat_ws(', ', {_SHELF}, CASE WHEN favourite THEN 'favorites' END, CASE WHEN status = 'abandoned' THEN 'did-not-finish' END)"


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    more = {
        "subtitle": F.when(k % 4 == 0, F.concat(F.lit("Part "), k % 10)).when(k % 4 == 1, ""), "isbn": F.when(k % 3 == 0, "978-0-306-40615-7").when(k % 3 == 1, "0-306-40615-2").otherwise("12"), "publisher": F.when(k % 5 != 0, F.concat(F.lit("House "), k % 3)),
        "edition_year": F.when(k % 6 != 0, 1990 + k % 30), "created": F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")), "notes": F.concat(F.lit("note "), k), "family_first": k % 7 == 0, "copies": F.when(k % 9 == 0, 2), "original_title": F.lit(None).cast("string"),
    }
    return books(spark, sf_dir).withColumns(more)


@query(_EXPORT + f"""SELECT CASE WHEN coalesce(subtitle, '') <> '' THEN title || ': ' || subtitle ELSE title END AS "Title", CASE WHEN family_first AND contains(coalesce(authors[1], ''), ' ') THEN regexp_replace(authors[1], '^(.*) ([^ ]+)$', '\\2 \\1') ELSE coalesce(authors[1], '') END AS "Author",
CASE id % 3 WHEN 0 THEN '9780306406157' WHEN 1 THEN '0306406152' ELSE '' END AS "ISBN", CAST(CASE WHEN rating > 0 THEN least(5, rating) ELSE 0 END AS VARCHAR) AS "My Rating", '' AS "Average Rating", coalesce(publisher, '') AS "Publisher", '' AS "Binding", coalesce(CAST(edition_year AS VARCHAR), '') AS "Year Published",
coalesce(CAST(year AS VARCHAR), '') AS "Original Publication Year", '' AS "Date Read", strftime(day, '%Y/%m/%d') AS "Date Added", {_SHELVES} AS "Shelves", {_SHELVES} AS "Bookshelves", notes AS "My Review" FROM x""")
def tracker_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reading tracker's import file as its owner gets it."""
    from vellum.sources import export

    return _exported(spark, sf_dir).select(*export.tracker_columns(True, F.col("family_first")))


@query(_EXPORT + """SELECT author, title, subtitle, CAST(NULL AS VARCHAR) AS original_title, publisher, year, edition_year, CASE language WHEN 'hu' THEN 'Hungarian' ELSE language END AS language, prime AS topic, array_to_string(list_filter(keys, lambda k: k <> prime), ', ') AS other_topics, array_to_string(tags, ', ') AS tags,
CASE status WHEN 'unknown' THEN NULL WHEN 'to_read' THEN 'To read' ELSE status END AS status, CASE WHEN rating > 0 THEN rating END AS rating, CASE WHEN favourite THEN 'yes' END AS favourite, CASE WHEN id % 9 = 0 THEN 2 ELSE 1 END AS copies, isbn, pages, CAST(round(confidence * 100) AS INT) AS confidence, CASE WHEN needs_review THEN 'yes' ELSE 'no' END AS needs_review,
source, strftime(day, '%Y-%m-%d') AS added FROM x""")
def catalogue_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue's table for spreadsheets as a visitor gets it."""
    from vellum.sources import export

    labels = F.create_map(F.lit("hu"), F.lit("Hungarian"), F.lit("to_read"), F.lit("To read"))
    return _exported(spark, sf_dir).select(*export.catalogue_columns(False, labels))
