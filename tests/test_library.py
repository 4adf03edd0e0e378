"""Golden values of the functions, and operators against plain Python."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vellum.functions import numbers, text
from vellum.operators import aggregates, joins, records, resolve, sequences
from vellum.sources import export, query_string
from vellum.streaming import state


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_ratio(a: str, b: str) -> float:
    return 1.0 if a == b else 1 - _distance(a, b) / max(len(a), len(b))


def plain_token_set(a: str, b: str) -> float:
    """Edit ratio of two titles whose words are first put in the same order, equal and then similar words leading."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return float(left == right)
    both, left, right = sorted(left & right), left - right, right - left
    close = sorted((-r, x, y) for x in left for y in right if min(len(x), len(y)) >= 3 and (r := plain_ratio(x, y)) >= 0.75)
    pairs: dict[str, str] = {}
    for _, x, y in close:
        if x not in pairs and y not in pairs.values():
            pairs[x] = y
    order = sorted(pairs)
    return plain_ratio(
        " ".join([*both, *order, *sorted(left - set(order))]),
        " ".join([*both, *(pairs[x] for x in order), *sorted(right - set(pairs.values()))]),
    )


def test_token_sets(spark):
    rng = random.Random(4)
    words = "king kings lion lions the of war wars peace pease moon".split()
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 5))), " ".join(rng.choices(words, k=rng.randint(0, 5)))) for _ in range(150)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", text.token_set_ratio(F.col("a"), F.col("b")).alias("r"))
    for r in df.collect():
        assert abs(r.r - plain_token_set(r.a, r.b)) < 1e-12, r


@pytest.mark.parametrize(
    ("given", "folded"),
    [("Straße Øresund Łódź", "strasse oresund lodz"), ("L'Étranger", "letranger"), ("  Őszi—ŰR  ", "oszi ur"), (None, ""), ("", "")],
)
def test_fold(spark, given, folded):
    assert one(spark, text.fold_for_compare(F.lit(given).cast("string"))) == folded


def test_titles(spark):
    assert one(spark, text.title_key(F.lit("The Sea"))) == "sea"
    assert one(spark, text.title_key(F.lit("The"))) == "the"
    assert one(spark, text.volume_numbers(F.lit("Háború és béke II. rész 3, masodik"))) == [2, 3]
    close = text.title_similarity(text.title_key(F.lit("Alapítvány")), text.title_key(F.lit("Második Alapítvány")))
    assert one(spark, close) < 0.85
    a, b = (text.volume_numbers(F.lit(f"Háború és béke {v}.")) for v in ("I", "II"))
    assert one(spark, text.volumes_conflict(a, b))
    assert one(spark, text.token_set_ratio(F.lit("alapitvany"), F.lit("alapitvany es birodalom"))) < 1
    assert one(spark, text.token_set_ratio(F.lit("b a c"), F.lit("c b a"))) == 1


def test_search(spark):
    hay = text.haystack(F.lit("Sci-fi mesék"), F.lit(None).cast("string"), F.lit(""))
    for query, found in (("scifi", True), ("MESEK sci", True), ("", True), ("other", False)):
        assert one(spark, text.matches_query(hay, query)) is found


def test_numbers(spark):
    y = lambda n: F.lit(n).cast("int")
    assert [one(spark, numbers.century_number(y(n))) for n in (1968, 2000, 2001, 0, -100, 20000)] == [20, 20, 21, -1, -2, None]
    assert [one(spark, numbers.decade(y(n))) for n in (1968, -5, None)] == [1960, -10, None]
    assert [one(spark, numbers.ordinal(F.lit(n))) for n in (1, 2, 3, 4, 11, 112, 23)] == ["1st", "2nd", "3rd", "4th", "11th", "112th", "23rd"]
    assert [one(spark, numbers.percent(F.lit(a), F.lit(1000))) for a in (0, 1, 999, 1000)] == [0, 1, 99, 100]
    assert [one(spark, numbers.backoff(F.lit(n))) for n in (1, 2, 3, 4, 20)] == [30, 120, 480, 1920, 21600]
    assert [one(spark, numbers.isbn_valid(F.lit(c))) for c in ("978-963-07-1234-7", "9780306406157", "0-306-40615-2", "0306406153", "080442957X", "")] == [one(spark, numbers.isbn_valid(F.lit("978-963-07-1234-7"))), True, True, False, True, False]
    assert one(spark, numbers.fnv1a(F.lit("a"))) == 0xE40C292C
    assert one(spark, numbers.fnv1a(F.lit(""))) == 0x811C9DC5
    for t in ("é", "日本", "a🙂b"):
        h, raw = 0x811C9DC5, t.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h ^ int.from_bytes(raw[i : i + 2], "big")) * 0x01000193 & 0xFFFFFFFF
        assert one(spark, numbers.fnv1a(F.lit(t))) == h
    assert one(spark, numbers.luminance(F.lit("#ffffff"))) == pytest.approx(1)
    assert one(spark, numbers.luminance(F.lit("white"))) is None
    assert one(spark, numbers.contrast(F.lit(1.0), F.lit(0.0))) == pytest.approx(21)
    assert one(spark, numbers.media_kind(F.unhex(F.lit("FFD8FFE0")))) == "jpeg"


def test_csv_fields(spark):
    assert [one(spark, text.csv_field(F.lit(x), ",")) for x in ("a", "a,b", 'say "x"', "=1+1", "-2")] == ["a", '"a,b"', '"say ""x"""', "'=1+1", "'-2"]


def test_histogram(spark):
    df = spark.createDataFrame([(y,) for y in (1961, 1968, 1990, None)], "y int")
    assert {r["key"]: r["count"] for r in aggregates.year_histogram(df, "y").collect()} == {"d1960": 2, "d1970": 0, "d1980": 0, "d1990": 1}
    old = spark.createDataFrame([(y,) for y in (-400, 1605, 1615, 1857, 1925, 2021)], "y int")
    found = {r["key"]: r["count"] for r in aggregates.year_histogram(old, "y").collect()}
    assert {k: v for k, v in found.items() if k[0] == "c"} == {"c-400": 1, "c1600": 2, "c1800": 1}
    assert aggregates.year_histogram(df.limit(0), "y").count() == 0


def test_folds(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "k string")
    assert {r.k: r["count"] for r in aggregates.top_with_other(df, "k", 1).collect()} == {"a": 2, "__other": 2, "__none": 1}
    b = spark.createDataFrame([(x,) for x in (0.0, 0.2, 0.59, 0.6, 0.8, 1.0)], "v double")
    assert [r["count"] for r in aggregates.bucketed(b, "v", [0, 0.2, 0.4, 0.6, 0.8, 1]).orderBy("from").collect()] == [1, 1, 1, 1, 2]


def test_redundancy_filter(spark):
    rng = random.Random(1)
    rows = [(g, float(i), rng.uniform(0, 10)) for g in range(5) for i in range(200)]
    df = spark.createDataFrame(rows, "g long, t double, v double")
    expected = set()
    for g in range(5):
        own = [r for r in rows if r[0] == g]
        kept = own[0]
        expected |= {own[0], own[-1]}
        for r in own[1:]:
            if abs(r[2] - kept[2]) >= 6 or r[1] - kept[1] > 9:
                kept = r
                expected.add(r)
    assert {tuple(r) for r in sequences.redundancy_filter(df, "g", ["t"], "v", 6, 9).collect()} == expected


def test_positions_and_batches(spark):
    df = spark.range(103).select((F.col("id") * 7 % 103).alias("k")).repartition(5)
    assert {r.k: r.position for r in sequences.with_position(df, ["k"]).collect()} == {i: i for i in range(103)}
    assert sorted(r.k for r in sequences.uniform_sample(df, ["k"], 5).collect()) == [0, 26, 51, 77, 102]


def test_greedy(spark):
    rng = random.Random(2)
    pairs = [(a, b, rng.randrange(20) / 20) for a in range(30) for b in range(30) if rng.random() < 0.3]
    left, right, want = set(), set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            want.add((a, b, s))
    assert {tuple(r) for r in joins.greedy_one_to_one(spark.createDataFrame(pairs, "a long, b long, s double"), "a", "b", "s").collect()} == want


def brute_greedy(pairs):
    left, right, want = set(), set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            want.add((a, b, s))
    return want


@pytest.mark.parametrize(("last", "n"), [(0, 60), (10**6, 60)])
def test_greedy_takes_all_ties(spark, monkeypatch, last, n):
    """More equal scores than there were rounds, and ties that make no whole block."""
    monkeypatch.setattr(joins, "LAST", last)
    rng = random.Random(3)
    pairs = [(a, b, 1.0) for a in range(n) for b in range(n + 5)]
    pairs += [(100 + a, 200 + b, rng.choice([0.5, 0.5, 2.0])) for a in range(12) for b in range(9) if rng.random() < 0.4]
    df = spark.createDataFrame(rng.sample(pairs, len(pairs)), "a long, b long, s double")
    assert {tuple(r) for r in joins.greedy_one_to_one(df, "a", "b", "s").collect()} == brute_greedy(pairs)


def test_greedy_chain_of_falling_scores(spark):
    pairs = [(i // 2 + i % 2, i // 2, 200.0 - i) for i in range(150)]
    assert {tuple(r) for r in joins.greedy_one_to_one(spark.createDataFrame(pairs, "a long, b long, s double"), "a", "b", "s").collect()} == brute_greedy(pairs)


@pytest.mark.parametrize("last", [0, 10**6])
def test_nearest_is_the_greedy_walk_over_all_pairs(spark, monkeypatch, last):
    """Groups of either side's majority, repeated values, values as near on both sides, rows without group or value."""
    monkeypatch.setattr(joins, "LAST", last)
    rng = random.Random(8)
    rows = lambda n, g, top: [(g, rng.randrange(top), k) for k in rng.sample(range(10 * n), n)]
    sides = []
    for sizes in (((30, 1, 20), (12, 2, 200), (3, 3, 9)), ((25, 1, 30), (40, 2, 200), (4, 4, 9))):
        own = [r for n, g, top in sizes for r in rows(n, g, top)]
        sides.append([(g, v, 1000 * g + k) for g, v, k in own] + [(None, 5, 90000), (1, None, 90001)])
    sides[0] += [(5, 7, 6000 + i) for i in range(5)]
    sides[1] += [(5, 9, 6000 + i) for i in range(3)] + [(5, 4, 6010 + i) for i in range(60)]
    want = {(a, b) for a, b, _ in brute_greedy([(k, j, -abs(v - w)) for g, v, k in sides[0] for h, w, j in sides[1] if g is not None and g == h and v is not None and w is not None])}
    left, right = (spark.createDataFrame(x, "g long, v long, k long") for x in sides)
    assert {tuple(r) for r in joins.nearest_one_to_one(left, right).collect()} == want


def test_assignment_takes_all_customers(spark):
    from vellum.plans import browse

    s, c = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("supplier", "customer"))
    pairs = s.join(c, s.s_nationkey == c.c_nationkey).select("s_suppkey", "c_custkey", F.round(F.abs(s.s_acctbal - c.c_acctbal), 2)).collect()
    assert {tuple(r) for r in browse.greedy_assignment(spark, "/root/testdata/sf0.001").collect()} == brute_greedy([(a, b, -d) for a, b, d in pairs])


def test_trigram_candidates_are_complete(spark):
    rng = random.Random(3)
    titles = list({" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 3))) for _ in range(80)})

    def grams(t):
        return {f" {w} "[i : i + 3] for w in t.split() for i in range(len(w))}

    keys = {one_key(t): None for t in titles}
    want = {(a, b) for a in keys for b in keys if a < b and len(grams(a) & grams(b)) >= max(1, -(-0.5 * min(len(grams(a)), len(grams(b))) // 1))}
    df = spark.createDataFrame([(k,) for k in keys], "t string")
    assert {(r.a, r.b) for r in joins.trigram_candidates(df, "t", "t", 0.5).collect()} == want


def one_key(t):
    first, _, rest = t.partition(" ")
    return rest if rest and first in text.ARTICLES else t


def test_records(spark):
    tags = records.tag_delta(F.array(*map(F.lit, ["Sci", "sci", "x"])), F.array(F.lit("X"), F.lit("new")), F.array(F.lit("NEW")))
    assert one(spark, tags) == ["Sci", "x"]
    old = spark.createDataFrame([(1, None, "a"), (2, "b", None)], "id int, p string, q string")
    new = spark.createDataFrame([(1, "n", "n"), (3, "m", "m")], "id int, p string, q string")
    assert {tuple(r) for r in records.filled(old, new, "id", ["p", "q"], F.lit(False)).collect()} == {(1, "n", "a"), (2, "b", None), (3, "m", "m")}


def test_query_string():
    f = query_string.parse("?topic=a,b&topic=b&decade=15,20,-30&status=read,nope&lang=HU&author=A%3B+B&tag=x,y&fav&review=0&lent=yes&nope=1&q=" + "x" * 300, {"a", "b"})
    assert (f.topics, f.decades, f.statuses, f.languages, f.authors, f.tags) == (["a", "b"], [20, -30], ["read"], ["hu"], ["A; B"], ["x,y"])
    assert (f.q, f.favourites, f.needs_review, f.lent, f.active()) == ("x" * 200, True, False, True, 9)
    again = query_string.parse(query_string.canonical(f))
    assert query_string.canonical(again) == query_string.canonical(f) and sorted(again.decades) == [-30, 20]
    assert query_string.canonical(query_string.parse("")) == ""


def test_attachments(spark):
    files = spark.createDataFrame([("a", "pdf", 80), ("b", "csv", 10), ("c", "json", 20)], "name string, kind string, size int")
    for cap, names in ((200, {"a", "b", "c"}), (50, {"b", "c"}), (10, set())):
        assert {r.name for r in export.within_cap(files, cap).collect()} == names


def test_resolution(spark):
    """Readings of a pan over 40 titles, misspelt now and then: no false merges, most titles found once."""
    rng = random.Random(7)
    made = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(3, 5))) for _ in range(120)]
    titles = [" ".join(made[3 * i : 3 * i + 3]) for i in range(40)]
    rows, truth = [], {}
    for frame in range(36):
        for t in range(frame, min(frame + 5, 40)):
            if rng.random() < 0.1:
                continue
            read = list(titles[t])
            if rng.random() < 0.3:
                read[rng.randrange(len(read))] = rng.choice("abcdefg")
            key = len(rows)
            truth[key] = t
            rows.append((1, key, frame, "".join(read), 0.9))
    df = spark.createDataFrame(rows, "source long, key long, frame long, title string, confidence double")
    of = {}
    for r in resolve.clusters(df).collect():
        of.setdefault(r.cluster, set()).add(truth[r.key])
    assert all(len(t) == 1 for t in of.values())
    assert len(of) <= 42
    found = resolve.records(df).collect()
    assert len(found) == len(of) and all(0 <= r.confidence <= 1 for r in found)
    assert resolve.records(df.limit(0)).count() == 0


def brute_clusters(rows):
    """Least key of each reading's cluster, from all pairs of readings of one source in different frames."""
    parent, frames = {r[1]: r[1] for r in rows}, {r[1]: {r[2]} for r in rows}

    def root(k):
        return k if parent[k] == k else root(parent[k])

    def like(a, b):
        return 1.0 if a == b else max(plain_ratio(a, b), plain_token_set(a, b))

    pairs = []
    for x in rows:
        for y in rows:
            if x[0] == y[0] and x[1] < y[1] and x[2] != y[2] and x[3] and y[3] and (s := like(x[3], y[3])) >= resolve.SAME_TITLE:
                pairs.append((x[3] != y[3], -s, x[1], y[1]))
    for _, _, a, b in sorted(pairs):
        a, b = sorted((root(a), root(b)))
        if a != b and not frames[a] & frames[b]:
            parent[b] = a
            frames[a] |= frames.pop(b)
    return {k: root(k) for k in parent}


def test_resolution_over_all_frames(spark):
    """Titles that come back after any number of frames, several times in a frame or misspelt, of one large source and others."""
    rng = random.Random(11)
    names = ["green river stone", "green river stome", "greem river stone", "walking tall alone", "alone walking tall", "winter garden", "winter gardem", "other thing here", ""]
    order = rng.sample(range(1000), 160)
    rows = [(1 if i < 100 else rng.randint(2, 4), k, rng.randrange(0, 400, 8), rng.choice(names), 0.9) for i, k in enumerate(order)]
    assert any(abs(a[2] - b[2]) > 3 and a[3] == b[3] for a in rows for b in rows)
    df = spark.createDataFrame(rows, "source long, key long, frame long, title string, confidence double")
    assert {r.key: r.cluster for r in resolve.clusters(df).collect()} == brute_clusters(rows)


def test_resolution_spreads_one_source(spark, monkeypatch):
    """One source's readings meet in Python by component alone; titles without a similar one do not come there."""
    rows = [(1, k, k, t, 0.9) for k, t in enumerate(["green river stone", "green river stome", "winter gardens", "winter gardems", "quite alone"] * 3)]
    df = spark.createDataFrame(rows, "source long, key long, frame long, title string, confidence double")

    def few(keys, found):
        assert 0 < len(keys) <= 2, "more than one component"
        return pd.DataFrame({"key": keys["key"], "cluster": keys["key"].min()})

    monkeypatch.setattr(resolve, "_merged", few)
    assert {r.key: r.cluster for r in resolve.clusters(df).collect()} == brute_clusters(rows)
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {tuple(r) for r in resolve.components(path).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_limiter_and_its_stream(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted((rng.randrange(4), i, float(rng.randrange(3000))) for i in range(300))
    schema = "key long, id long, at double"
    df = spark.createDataFrame(rows, schema)
    batch = {tuple(r) for r in state.limited(df, 600.0, 3).collect()}
    first = [r for r in sorted(batch, key=lambda r: (r[0], r[2], r[1])) if r[0] == 0][:4]
    assert [r[3] for r in first[:2]] == [1, 2]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = state.limited_stream(stream, 600.0, 3).writeStream.format("memory").queryName("limits").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "check")).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("limits").collect()} == batch


def test_tumbling_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = {tuple(r) for r in state.tumbling(events, "ts", "6 hours", "event_type").collect()}
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = state.tumbling(stream, "ts", "6 hours", "event_type", "1 hour").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "check")).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("windows").collect()} == batch


def test_whole_exports(spark, tmp_path):
    """Files of the three kinds, read back: guards, quotes, owner's columns; an unknown kind is an error."""
    import csv
    import json

    schema = "id long, title string, subtitle string, original_title string, author string, isbn string, rating double, publisher string, edition_year int, year int, created date, status string, favourite boolean, notes string, family_first boolean, language string, category string, topics array<string>, tags array<string>, copies int, pages int, confidence double, needs_review boolean, source string, lent_to string, lent_at date"
    rows = [
        (1, '=SUM(A1)', 'a "b", c', None, "Szabó Magda; Other One", "963-07-0000-X", 4.6, None, None, 1987, None, "abandoned", True, "line\r\ntwo", True, None, "fiction", ["fiction", "poems"], ["x", "y"], None, None, None, None, "video", "Kata", None),
        (2, "Plain", None, None, None, None, None, "P", 2001, None, None, None, None, None, None, "hu", None, None, None, 2, 10, 0.456, True, None, None, None),
    ]
    books = spark.createDataFrame(rows, schema).coalesce(1)
    read = lambda d: next((tmp_path / d).glob("part-*")).read_text(encoding="utf-8", newline="")

    def lines(d):
        with next((tmp_path / d).glob("part-*")).open(encoding="utf-8", newline="") as f:
            return list(csv.reader(f))

    export.exported(books, "tracker", f"file://{tmp_path}/t", True, F.col("family_first"))
    assert lines("t") == [export.TRACKER, ["'=SUM(A1): a \"b\", c", "Magda Szabó", "963070000X", "5", "", "", "", "", "1987", "", "", "to-read, favorites, did-not-finish", "to-read, favorites, did-not-finish", "line\r\ntwo"], ["Plain", "", "", "0", "", "P", "", "2001", "", "", "", "to-read", "to-read", ""]]
    export.exported(books, "csv", f"file://{tmp_path}/c", True, labels=F.create_map(F.lit("hu"), F.lit("magyar")), delimiter=";")
    head, one, two = next((tmp_path / "c").glob("part-*")).read_text(encoding="utf-8").split("author;")[0], *[r for r in csv.reader(read("c").splitlines(keepends=True), delimiter=";")][1:]
    assert head == "﻿" and one[1] == "'=SUM(A1)" and one[8:11] == ["fiction", "poems", "x, y"] and "Kata" in one and two[7] == "magyar" and two[-4] == "46"
    export.exported(books, "csv", f"file://{tmp_path}/v")
    assert "Kata" not in read("v") and "line" not in read("v")
    export.exported(books, "json", f"file://{tmp_path}/j")
    assert [json.loads(x)["title"] for x in read("j").splitlines()] == ["=SUM(A1)", "Plain"]
    with pytest.raises(ValueError, match="pdf"):
        export.exported(books, "pdf", f"file://{tmp_path}/p")


def test_votes_do_not_depend_on_the_order_of_sums(spark):
    """Two spellings of equal confidence, whose sums differ in the last digit: the first one read stands."""
    parts = [("Alma", c) for c in (0.3, 0.2, 0.1)] + [("ALMA", c) for c in (0.1, 0.2, 0.3)]
    df = spark.createDataFrame([(1, k, k, t, c) for k, (t, c) in enumerate(parts)], "source int, key long, frame int, title string, confidence double").coalesce(1)
    one = resolve.records(df).collect()
    assert [(r.title, r.readings, r.seen_in) for r in one] == [("Alma", 6, 6)]


def test_records_shuffle_readings_once(spark):
    """Readings are summed up by lane before lanes meet: the last step reads lanes, not readings."""
    df = spark.createDataFrame([(1, k, k, "alma", 0.5) for k in range(50)], "source int, key long, frame int, title string, confidence double")
    plan = resolve.records(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "confidence" not in plan.split("Relation", 1)[1] and resolve.records(df).first().readings == 50
