"""The write path of a catalogue: steps that take its tables and give the changed ones, to be committed together.

Books: ``BOOK``.  Detections: id, source, book_id and whatever else they carry.  Each step is a few
joins by id; nothing is collected, and a commit (``vellum.tableset``) makes the tables change as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BOOK = (
    "id long, collection long, title string, author string, publisher string, origin string, confidence double, needs_review boolean, reviewed boolean, "
    "detections long, first_source long, shelf long, tags array<string>, edited array<string>, duplicate_of long, best long, copies int"
)
#: Fields that the owner may change, and those that become protected by it.
PATCHABLE, BIBLIOGRAPHIC = ["title", "author", "publisher", "needs_review", "reviewed", "copies"], ["title", "author", "publisher"]


def _tags(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def appended(books: DataFrame, new: DataFrame, most: int) -> DataFrame:
    """``books`` with those that owners add by hand (id, collection, title, author, publisher), in order of their ids, at the end of the shelf.

    A collection holds ``most`` books; what has no room left is refused.  What the owner gave counts as edited.
    """
    ends = books.groupBy("collection").agg(F.count("*").alias("_n"), F.max("shelf").alias("_end"))
    placed = new.withColumn("_i", F.row_number().over(Window.partitionBy("collection").orderBy("id"))).join(ends, "collection", "left")
    fit = placed.where(F.coalesce("_n", F.lit(0)) + F.col("_i") <= most)
    given = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in BIBLIOGRAPHIC]), lambda f: f.isNotNull())
    none = F.array().cast("array<string>")
    rows = fit.select(
        "id", "collection", "title", "author", "publisher", F.lit("manual").alias("origin"), F.lit(1.0).alias("confidence"), F.lit(False).alias("needs_review"), F.lit(True).alias("reviewed"), F.lit(0).cast("long").alias("detections"),
        F.lit(None).cast("long").alias("first_source"), (F.coalesce("_end", F.lit(-1)) + F.col("_i")).alias("shelf"), none.alias("tags"), given.alias("edited"), F.lit(None).cast("long").alias("duplicate_of"), F.lit(None).cast("long").alias("best"), F.lit(1).alias("copies"),
    )
    return books.unionByName(rows)


def patched(books: DataFrame, patches: DataFrame) -> DataFrame:
    """``books`` after patches (id, fields, and the new values in columns of ``PATCHABLE``): one patch a book; ``fields`` names what it sets.

    What is bibliographic and really changes is marked as edited; accepting a book closes its review unless the patch says otherwise.
    """
    new = patches.select(F.col("id"), F.struct(*[c for c in patches.columns if c != "id"]).alias("_p"))
    rows = books.join(new, "id", "left")
    has = lambda c: F.coalesce(F.array_contains("_p.fields", c), F.lit(False))
    changes = lambda c: has(c) & ~F.col(f"_p.{c}").eqNullSafe(F.col(c))
    values = {c: F.when(has(c), F.col(f"_p.{c}")).otherwise(F.col(c)) for c in PATCHABLE}
    accepted = has("reviewed") & F.coalesce(F.col("_p.reviewed"), F.lit(False)) & ~has("needs_review")
    values["needs_review"] = F.when(accepted, False).otherwise(values["needs_review"])
    changed = F.filter(F.array(*[F.when(changes(c), F.lit(c)) for c in BIBLIOGRAPHIC]), lambda f: f.isNotNull())
    values["edited"] = F.array_union(_tags("edited"), changed)
    return rows.select(*[values.get(c, F.col(c)).alias(c) for c in books.columns])


def merged(books: DataFrame, detections: DataFrame, found: DataFrame, readings: DataFrame, tags: DataFrame, most: int) -> dict[str, DataFrame]:
    """Books and detections after recordings were resolved.

    ``found``: (record, collection, source, place, title, author, publisher, confidence, needs_review, best, matched), the records
    of the recordings, ``matched`` the known book or null; ``readings``: (record, detection), with ``source`` where records of different
    recordings may have the same number; ``tags``: (source, tags) of the recordings.
    New books get the ids of their records while the collection has room, in shelf order; the others stay unassigned.  A matched
    book counts the new readings, keeps the greater confidence with its evidence, takes what it lacks and the owner has not
    edited, loses an open review that the new reading settles, and gets the recording's tags.  Detections that belong to a
    book already keep it.
    """
    key = [c for c in ("source", "record") if c in readings.columns]
    counts = readings.groupBy(*key).agg(F.count("*").alias("_n"))
    found = found.join(counts, key).join(tags.select("source", F.col("tags").alias("_tags")), "source", "left")
    sizes = books.groupBy("collection").agg(F.count("*").alias("_size"))
    order = Window.partitionBy("collection").orderBy("source", "place", "record")
    fresh = found.where("matched is null").withColumn("_i", F.row_number().over(order)).join(sizes, "collection", "left").where(F.coalesce("_size", F.lit(0)) + F.col("_i") <= most)
    none, no = F.array().cast("array<string>"), F.lit(None).cast("long")
    added = fresh.select(
        F.col("record").alias("id"), "collection", "title", "author", "publisher", F.lit("video").alias("origin"), "confidence", "needs_review", F.lit(False).alias("reviewed"), F.col("_n").alias("detections"), F.col("source").alias("first_source"),
        (F.col("source") * 100_000 + F.col("place")).alias("shelf"), _tags("_tags").alias("tags"), none.alias("edited"), no.alias("duplicate_of"), "best", F.lit(1).alias("copies"),
    )
    # Several records of a recording may be one book: they come in order, the first that fills a field wins.
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("source", "place", "record"))).alias(c)
    known = found.where("matched is not null").groupBy(F.col("matched").alias("id")).agg(
        F.sum("_n").alias("_n"), F.max_by(F.struct("confidence", "best"), F.struct("confidence", -F.col("source"), -F.col("place"))).alias("_b"), F.min("needs_review").alias("_open"), F.min("source").alias("_source"), first("author"), first("publisher"),
        F.array_distinct(F.flatten(F.collect_list(F.coalesce("_tags", none)))).alias("_tags"),
    )
    k = known.select("id", F.struct("*").alias("_k"))
    rows, hit, better = books.join(k, "id", "left"), F.col("_k").isNotNull(), F.coalesce(F.col("_k._b.confidence") > F.col("confidence"), F.lit(False))
    free = lambda c: ~F.array_contains(_tags("edited"), c) & F.col(c).isNull()
    values = {
        "detections": F.col("detections") + F.coalesce("_k._n", F.lit(0)), "confidence": F.when(better, F.col("_k._b.confidence")).otherwise(F.col("confidence")),
        "best": F.when(hit & F.col("_k._b.best").isNotNull() & (better | F.col("best").isNull()), F.col("_k._b.best")).otherwise(F.col("best")), "first_source": F.coalesce("first_source", "_k._source"),
        "author": F.when(free("author"), F.col("_k.author")).otherwise(F.col("author")), "publisher": F.when(free("publisher"), F.col("_k.publisher")).otherwise(F.col("publisher")),
        "needs_review": F.when(hit & ~F.col("reviewed") & ~F.col("_k._open"), False).otherwise(F.col("needs_review")), "tags": F.when(hit, F.array_union(_tags("tags"), _tags("_k._tags"))).otherwise(F.col("tags")),
    }
    after = rows.select(*[values.get(c, F.col(c)).alias(c) for c in books.columns]).unionByName(added.select(*books.columns))
    of = fresh.select(*key, F.col("record").alias("_book")).unionByName(found.where("matched is not null").select(*key, F.col("matched").alias("_book")))
    to = readings.join(of, key).select(F.col("detection").alias("id"), "_book")
    pointed = detections.join(to, "id", "left").withColumn("book_id", F.coalesce("book_id", "_book")).select(*detections.columns)
    return {"books": after, "detections": pointed}


def duplicates_settled(books: DataFrame, detections: DataFrame, answers: DataFrame) -> dict[str, DataFrame]:
    """Books and detections after the owner's answers (id, answer) on books that may be there already.

    ``different`` keeps both; ``same`` and ``copy`` merge the book into the earlier one, which takes what it lacks, the
    detections and the tags, and with ``copy`` one copy more for each.  A book whose earlier one goes itself is merged into
    nothing: it waits for the next answer.
    """
    said = books.where("duplicate_of is not null").join(answers, "id").select("id", "answer", "duplicate_of")
    merging = said.where("answer in ('same', 'copy')")
    pairs = merging.join(merging.select(F.col("id").alias("duplicate_of")), "duplicate_of", "left_anti").join(books.select(F.col("id").alias("duplicate_of")), "duplicate_of", "left_semi")
    gone = books.join(pairs.select("id", "answer", F.col("duplicate_of").alias("_into")), "id")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c)
    sums = gone.groupBy(F.col("_into").alias("id")).agg(
        first("author"), first("publisher"), first("best"), F.sum("detections").alias("detections"), F.count_if(F.col("answer") == "copy").cast("int").alias("copies"), F.array_distinct(F.flatten(F.collect_list(_tags("tags")))).alias("tags")
    )
    k = sums.select("id", F.struct("*").alias("_k"))
    rows = books.join(pairs.select("id"), "id", "left_anti").join(k, "id", "left").join(said.where("answer = 'different'").select("id", F.lit(True).alias("_apart")), "id", "left")
    values = {c: F.coalesce(c, f"_k.{c}") for c in ("author", "publisher", "best")}
    values |= {c: F.col(c) + F.coalesce(f"_k.{c}", F.lit(0)) for c in ("detections", "copies")}
    values["tags"] = F.when(F.col("_k").isNotNull(), F.array_union(_tags("tags"), _tags("_k.tags"))).otherwise(F.col("tags"))
    values["duplicate_of"] = F.when(F.col("_apart").isNull(), F.col("duplicate_of"))
    after = rows.select(*[values.get(c, F.col(c)).alias(c) for c in books.columns])
    to = pairs.select(F.col("id").alias("book_id"), F.col("duplicate_of").alias("_into"))
    pointed = detections.join(to, "book_id", "left").withColumn("book_id", F.coalesce("_into", "book_id")).select(*detections.columns)
    return {"books": after, "detections": pointed}


def reset(books: DataFrame, detections: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """Books and detections without the results of ``sources``: their detections go, with the books that nothing else shows.

    Books added by hand or reviewed stay; those that stay count what is left (one at least) and lose evidence that is gone.
    """
    bad = detections.join(sources.select("source").distinct(), "source", "left_semi")
    rest = detections.join(sources.select("source").distinct(), "source", "left_anti")
    hit = bad.where("book_id is not null").select(F.col("book_id").alias("id")).distinct()
    left = rest.groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias("_left"))
    rows = books.join(hit.withColumn("_hit", F.lit(True)), "id", "left").join(left, "id", "left").join(bad.select(F.col("id").alias("best"), F.lit(True).alias("_lost")), "best", "left")
    touched = F.col("_hit").isNotNull()
    kept = rows.where(~(touched & F.col("_left").isNull() & (F.col("origin") != "manual") & ~F.col("reviewed")))
    values = {"detections": F.when(touched, F.greatest(F.lit(1), F.coalesce("_left", F.lit(0)))).otherwise(F.col("detections")), "best": F.when(~(touched & F.col("_lost").isNotNull()), F.col("best"))}
    return {"books": kept.select(*[values.get(c, F.col(c)).alias(c) for c in books.columns]), "detections": rest.select(*detections.columns)}
