"""Sinks: CSV lines with spreadsheet guards, nested JSON, attachments within a cap."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import csv_field


def csv_lines(df: DataFrame, columns: list[str], delimiter: str = ",") -> DataFrame:
    return df.select(F.concat_ws(delimiter, *[csv_field(F.col(c), delimiter) for c in columns]).alias("line"))


def write_csv(df: DataFrame, columns: list[str], path: str, delimiter: str = ",") -> None:
    """Files of lines, each beginning with the line of column names, as Spark's own CSV files do."""
    head = delimiter.join(columns)

    def run(parts):
        begun = False
        for part in parts:
            if not begun:
                yield pa.RecordBatch.from_arrays([pa.array([head], part.schema.field(0).type)], schema=part.schema)
                begun = True
            yield part

    csv_lines(df, columns, delimiter).mapInArrow(run, "line string").write.option("lineSep", "\r\n").text(path)


def nested(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, items): values of each key in rising order."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("items"))


def visible(column: Column, owner: Column) -> Column:
    """An owner's column: null for everyone else; rows stay."""
    return F.when(owner, column)


def within_cap(files: DataFrame, cap: int) -> DataFrame:
    """(name, kind, size): all if they fit the cap, else all but the PDF if that fits, else none."""
    totals = files.agg(F.sum("size").alias("_all"), F.sum(F.when(F.col("kind") != "pdf", F.col("size")).otherwise(0)).alias("_rest"))
    keep = (F.col("_all") <= cap) | ((F.col("_rest") <= cap) & (F.col("kind") != "pdf"))
    return files.join(F.broadcast(totals)).where(keep).drop("_all", "_rest")  # totals: one row


# The columns of the reading tracker's import file, in its order.
TRACKER = [
    "Title", "Author", "ISBN", "My Rating", "Average Rating", "Publisher", "Binding", "Year Published", "Original Publication Year", "Date Read", "Date Added", "Shelves", "Bookshelves", "My Review",
]
# The mark that tells spreadsheets of UTF-8.
MARK = "\ufeff"


def tracker_columns(owner: bool, family_first: Column) -> list[Column]:
    """``TRACKER`` of a record with title, subtitle, author, isbn, rating, publisher, edition_year, year, created (date), status, favourite, notes.

    Names that are written with the family name first are turned for the importer; both shelf columns tell all shelves, since
    importers read one or the other; notes go out to their owner alone.
    """
    from vellum.functions import names, numbers

    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    none = F.lit("")
    author = F.coalesce(names.first_author(F.col("author")), none)
    shelf = F.when(F.col("status") == "read", "read").when(F.col("status") == "reading", "currently-reading").otherwise("to-read")
    shelves = F.concat_ws(", ", shelf, F.when(F.col("favourite"), "favorites"), F.when(F.col("status") == "abandoned", "did-not-finish"))
    title = F.when(F.coalesce("subtitle", none) != "", F.concat_ws(": ", "title", "subtitle")).otherwise(F.col("title"))
    rating = F.when(F.col("rating") > 0, F.least(F.lit(5), F.round("rating")).cast("int")).otherwise(0)
    values = [
        title, F.when(F.coalesce(family_first, F.lit(False)), names.last_first(author)).otherwise(author), F.coalesce(numbers.clean_isbn(F.col("isbn")), none), rating.cast("string"), none, told("publisher"), none, told("edition_year"), told("year"), none,
        F.coalesce(F.date_format("created", "yyyy/MM/dd"), none), shelves, shelves, told("notes") if owner else none,
    ]
    return [v.alias(c) for c, v in zip(TRACKER, values, strict=True)]


def catalogue_columns(owner: bool, labels: Column, yes: str = "yes", no: str = "no") -> list[Column]:
    """Columns of a catalogue's table for spreadsheets; ``labels``, a map, names languages, topics, states and sources; what it lacks stays as it is.

    Columns of the owner's (notes, lent_to, lent_on) are there for the owner alone; unknown states, no favourite and no rating are empty.
    """
    from vellum.operators.catalogue import topic_keys

    named = lambda c: F.coalesce(F.try_element_at(labels, c), c)
    keys = topic_keys()
    private = [F.col("notes"), F.col("lent_to"), F.date_format("lent_at", "yyyy-MM-dd").alias("lent_on")] if owner else []
    return [
        F.col("author"), F.col("title"), F.col("subtitle"), F.col("original_title"), F.col("publisher"), F.col("year"), F.col("edition_year"), named(F.col("language")).alias("language"), named(F.get(keys, 0)).alias("topic"),
        F.array_join(F.transform(F.slice(keys, F.lit(2), F.greatest(F.size(keys), F.lit(1))), named), ", ").alias("other_topics"), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", ").alias("tags"),
        F.when(F.col("status") != "unknown", named(F.col("status"))).alias("status"), F.when(F.col("rating") > 0, F.col("rating")).alias("rating"), F.when(F.col("favourite"), yes).alias("favourite"), F.coalesce("copies", F.lit(1)).alias("copies"), *private,
        F.col("isbn"), F.col("pages"), F.round(F.coalesce("confidence", F.lit(0.0)) * 100).cast("int").alias("confidence"), F.when(F.col("needs_review"), yes).otherwise(no).alias("needs_review"), named(F.col("source")).alias("source"), F.date_format("created", "yyyy-MM-dd").alias("added"),
    ]


def exported(books: DataFrame, kind: str, path: str, owner: bool = False, family_first: Column | None = None, labels: Column | None = None, delimiter: str = ",") -> None:
    """Writes a catalogue as ``csv`` (for spreadsheets), ``tracker`` (for a reading tracker) or ``json`` (a record a line); another kind is an error."""
    if kind == "tracker":
        write_csv(books.select(*tracker_columns(owner, F.lit(False) if family_first is None else family_first)), TRACKER, path)
    elif kind == "csv":
        rows = books.select(*catalogue_columns(owner, F.create_map().cast("map<string,string>") if labels is None else labels))
        columns = rows.columns
        marked = rows.toDF(MARK + columns[0], *columns[1:])
        write_csv(marked, marked.columns, path, delimiter)
    elif kind == "json":
        books.write.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"no export of kind {kind!r}")
