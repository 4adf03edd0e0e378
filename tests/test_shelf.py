"""Shelves from readings: clusters, double readings, order; beside plain versions and on simulated recordings."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.functions import text
from vellum.operators import shelf

PEOPLE = shelf.People(local=("zsigmond", "peter", "eva", "istvan", "geza"), foreign=("john", "elena", "salman", "alan"), families=("moricz", "esterhazy"))
SCHEMA = "source string, key long, frame int, place int, title string, author string, confidence double"

COPY, BLONDES, STUPID = ("Anya, taníts engem!", "Deákné B. Katalin"), ("A szőkékkel mindig baj van", "Vaszary Gábor"), ("Az emberi butaság", "Ráth-Végh István")
OLD, TALES, FILM = ("Új és régi", "Jókai Anna"), ("Válogatott elbeszélések", "Erdélyi János"), ("Spielberg", "John Baxter")
ROW = [("Az új név története", "Elena Ferrante"), ("Aki megszökik és aki marad", "Elena Ferrante"), ("Az elvesztett gyerek története", "Elena Ferrante"), ("Az Alapítvány barátai", "Asimov"), ("Rokonok", "Móricz Zsigmond"), ("Levelek Lilynek", "Alan Macfarlane")]
POEMS, STARS, MARSH = ("Versek", "Petőfi Sándor"), ("Egri csillagok", "Gárdonyi Géza"), ("Tüskevár", "Fekete István")
WAR, PAINTER, PIRATES, SAGAS = ("Teller háborúja", "William J. Broad"), ("Gauguin élete", "H. Perruchot"), ("Pápai vizeken ne kalózkodj!", "Esterházy Péter"), ("Régi magyar mondák", "Lengyel Dénes")

#: Frames of a source, and the records (title, readings) that must come out, in order.
CASES = {
    "pan": ([ROW[f : f + 4] for f in range(3)], [(ROW[0][0], 1), (ROW[1][0], 2), (ROW[2][0], 3), (ROW[3][0], 3), (ROW[4][0], 2), (ROW[5][0], 1)]),
    "pan to the left": ([ROW[f : f + 4] for f in (2, 1, 0)], [(ROW[0][0], 1), (ROW[1][0], 2), (ROW[2][0], 3), (ROW[3][0], 3), (ROW[4][0], 2), (ROW[5][0], 1)]),
    "nobody's poems": ([[("Versek", "Petőfi Sándor")], [("Versek", None)], [("Versek", "Ady Endre")]], [("Versek", 2), ("Versek", 1)]),
    "volumes": ([[("Háború és béke I.", "Tolsztoj")], [("Háború és béke II.", "Tolsztoj")], [("HÁBORÚ ÉS BÉKE II", "Lev Tolsztoj")]], [("Háború és béke I.", 1), ("Háború és béke II.", 2)]),
    "copies": ([[("Rokonok", "Móricz Zsigmond"), COPY, COPY, FILM], [COPY, COPY, FILM], [(COPY[0], None), FILM]], [("Rokonok", 1), (COPY[0], 3), (COPY[0], 2), (FILM[0], 3)]),
    "double reading": ([[OLD, TALES, BLONDES], [OLD, TALES, BLONDES], [TALES, TALES, BLONDES, STUPID], [TALES, BLONDES, STUPID]], [(OLD[0], 2), (TALES[0], 5), (BLONDES[0], 4), (STUPID[0], 2)]),
    "double reading, bled": ([[BLONDES, STUPID, FILM], [BLONDES, STUPID, FILM], [(STUPID[0], BLONDES[1]), (STUPID[0], "Ráth-Végh"), FILM], [(STUPID[0], "Ráth-Végh"), FILM]], [(BLONDES[0], 2), (STUPID[0], 5), (FILM[0], 4)]),
    "no double reading": ([[POEMS, STARS], [POEMS, ("Versek", "Ady Endre"), STARS], [POEMS, STARS, MARSH], [POEMS, STARS, MARSH]], [("Versek", 4), ("Versek", 1), (STARS[0], 4), (MARSH[0], 2)]),
    "part of a title": ([[PAINTER, PIRATES, SAGAS], [PAINTER, ("PAPAI VIZEKEN", None), SAGAS]], [(PAINTER[0], 2), (PIRATES[0], 2), (SAGAS[0], 2)]),
    "another short title": ([[WAR, ("Mozart, az Isten kegyeltje", None), SAGAS], [WAR, ("Mozart", "Sadie"), SAGAS]], [(WAR[0], 2), ("Mozart, az Isten kegyeltje", 1), ("Mozart", 1), (SAGAS[0], 2)]),
    "frame read twice": ([[PAINTER, PIRATES], [PAINTER, PIRATES, PAINTER, PIRATES]], [(PAINTER[0], 3), (PIRATES[0], 3)]),
    "typing errors": ([[("PAPAI VIZEKEN NE KALOZKODJ", "ESTERHAZY PETER"), PAINTER], [PIRATES, ("GAUGIN ELETE", None)], [(PIRATES[0], None), ("Gauguin élete", "Henri Perruchot")]], [(PIRATES[0], 3), (PAINTER[0], 3)]),
}


def observations(spark, sources):
    rows, key = [], 0
    for source, frames in sources.items():
        for f, row in enumerate(frames):
            again = len(row) // 2 if len(row) > 1 and row[: len(row) // 2] == row[len(row) // 2 :] and source == "frame read twice" else len(row)
            for i, (title, author) in enumerate(row):
                rows.append((source, key, f, i % again + 1, title, author, 0.9))
                key += 1
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def cases(spark):
    more = spark.createDataFrame([("odd", 10_001, 0, 1, "", None, 0.5), ("odd", 10_002, 0, 2, None, "A B", None), ("odd", 10_003, None, 1, "Rokonok", None, 0.5), (None, 10_004, 0, 1, "Rokonok", None, 0.5), ("odd", 10_005, 0, 3, "Rokonok", None, None)], SCHEMA)
    _, records = shelf.resolved(observations(spark, {k: f for k, (f, _) in CASES.items()}).unionByName(more), PEOPLE)
    out = {}
    for r in records.orderBy("source", "position").collect():
        out.setdefault(r.source, []).append(r)
    return out


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(cases, name):
    fold = lambda t: t.lower().translate(str.maketrans("áéíóöőúüű", "aeiooouuu")).rstrip("!")
    assert [(fold(r.title), r.readings) for r in cases[name]] == [(fold(t), n) for t, n in CASES[name][1]]
    assert [r.position for r in cases[name]] == list(range(len(cases[name])))


def test_odd_readings(cases):
    assert [(r.title, r.readings) for r in cases["odd"]] == [("Rokonok", 1)]
    assert cases["nobody's poems"][0].author == "Petőfi Sándor" and cases["double reading, bled"][1].author == "Ráth-Végh István"
    assert not any(r.needs_review for n in CASES for r in cases[n]) and cases["pan"][1].confidence == 1.0 and cases["pan"][0].confidence == 0.9


def test_forced_links(spark):
    df = observations(spark, {"s": [[("Rudolf, a trónörökös", "Brigitte Hamann")], [PAINTER], [("Rudolf", None)]]})
    assert shelf.resolved(df, PEOPLE)[1].count() == 3
    assert shelf.resolved(df, PEOPLE, spark.createDataFrame([(0, 2)], "x long, y long"))[1].count() == 2
    assert shelf.resolved(df.where("false"), PEOPLE)[1].count() == 0


def cover(a, b):
    """Greedy cover word by word."""

    def ratio(x, y):
        if x == y:
            return 1.0
        if min(len(x), len(y)) < 3:
            return 0.0
        row = list(range(len(y) + 1))
        for i, c in enumerate(x):
            new = [i + 1]
            for j, d in enumerate(y):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (c != d)))
            row = new
        return 1 - row[-1] / max(len(x), len(y))

    small, large = sorted((a.split(), b.split()), key=lambda w: len("".join(w))) if len(a.replace(" ", "")) != len(b.replace(" ", "")) else (a.split(), b.split())
    if not small or not large or len(small) > len(large) or len("".join(small)) < 4:
        return 0.0
    pool = list(large)
    for t in small:
        scores = [ratio(t, p) for p in pool]
        if max(scores, default=0) < 0.8:
            return 0.0
        pool.pop(scores.index(max(scores)))
    return min(1.0, len("".join(small)) / len("".join(large)))


def test_title_cover(spark):
    rng = random.Random(4)
    words = ["pool", "pools", "harbour", "harbor", "of", "the", "mill", "mills", "old", "stone", "stones", "a", "river"]
    pairs = [(" ".join(rng.choices(words, k=rng.randint(0, 4))), " ".join(rng.choices(words, k=rng.randint(0, 6)))) for _ in range(400)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").select("i", text.title_cover(F.col("a"), F.col("b")).alias("c")).collect()
    got = {r.i: r.c for r in rows}
    assert all(abs(got[i] - cover(a, b)) < 1e-9 for i, (a, b) in enumerate(pairs))
    assert sum(1 for v in got.values() if v) > 20


def test_order_by_exchanges(spark):
    """Positions equal those of exchanges of neighbours over the whole source."""
    rng = random.Random(8)
    rows, at = [], []
    for s in range(6):
        for v in range(8):
            at.append((s, v, float(v * 2)))
            seen = sorted(rng.sample(range(14), 6), key=lambda c: c + rng.gauss(0, 2.5))
            rows += [(s, 100 + c, v, i, rng.random() < 0.1) for i, c in enumerate(seen)]
    df = spark.createDataFrame(rows, "source int, cluster long, vframe int, rank int, double boolean")
    got = {(r.source, r.cluster): r.position for r in shelf.in_order(df, spark.createDataFrame(at, "source int, vframe int, offset double")).collect()}
    for s in range(6):
        mine = [r for r in rows if r[0] == s]
        offset = {v: o for q, v, o in at if q == s}

        def place(c, mine=mine, offset=offset):
            x = [r for r in mine if r[1] == c]
            x = [r for r in x if not r[4]] or x
            return round(sum(r[3] + offset[r[2]] for r in x) / len(x), 6), min((r[2], r[3]) for r in mine if r[1] == c), c

        order = sorted({r[1] for r in mine}, key=place)
        ranks = {c: {r[2]: r[3] for r in mine if r[1] == c and not r[4]} for c in order}
        for _ in order:
            swapped = False
            for i in range(len(order) - 1):
                a, b = ranks[order[i]], ranks[order[i + 1]]
                lead = sum(1 if a[v] < b[v] else -1 for v in a.keys() & b.keys())
                if lead < 0:
                    order[i], order[i + 1], swapped = order[i + 1], order[i], True
            if not swapped:
                break
        assert [got[s, c] for c in order] == list(range(len(order)))


def test_simulated_recordings(spark):
    """Noisy pans along made-up shelves: books come back, none are joined wrongly, and the order holds."""
    rng = random.Random(12)
    syllables = ["ka", "lo", "mer", "ti", "sza", "bol", "fen", "gor", "ha", "ny", "per", "dus", "vi", "rel", "zot"]
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    rows, truth, shelves, key = [], {}, {}, 0
    for s in range(4):
        books = [(f"{word(3).capitalize()} {word(2)} {word(3)}", f"{word(2).capitalize()} {word(3).capitalize()}") for _ in range(30)]
        shelves[f"s{s}"] = books
        for f in range(0, 27):
            place = 0
            for i in range(f, min(f + 5, 30)):
                if rng.random() < 0.08:
                    continue
                title, author = books[i]
                if rng.random() < 0.25:
                    at = rng.randrange(len(title))
                    title = title[:at] + rng.choice("abcdeix") + title[at + 1 :]
                title = title.upper() if rng.random() < 0.2 else title
                place += 1
                rows.append((f"s{s}", key, f, place, title, None if rng.random() < 0.3 else author, 0.6 + 0.4 * rng.random()))
                truth[key] = (f"s{s}", i)
                key += 1
    found, records = shelf.resolved(spark.createDataFrame(rows, SCHEMA))
    of = {}
    for r in found.collect():
        of.setdefault(r.cluster, set()).add(truth[r.key])
    assert all(len(books) == 1 for books in of.values())
    assert len(of) <= 1.05 * len(set(truth.values())) and set().union(*of.values()) == set(truth.values())
    for s in shelves:
        placed = [next(iter(of[r.cluster]))[1] for r in records.where(F.col("source") == s).orderBy("position").collect()]
        assert sum(a <= b for a, b in zip(placed, placed[1:], strict=False)) >= 0.97 * (len(placed) - 1)


def test_steps_leave_no_shuffle_files(spark):
    from pathlib import Path

    from vellum.storage import CLEANUP, staged

    files = lambda: set(Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data"))
    before, setting = files(), spark.conf.get(CLEANUP, None)
    out = staged(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    assert out.agg(F.sum("count")).first()[0] == 1000
    assert len(files() - before) <= 1  # that of the sum above
    assert spark.conf.get(CLEANUP, None) == setting


def test_frames_meet_before_titles(spark):
    """What alignments shuffle does not grow with the titles that are like a reading's own."""
    words = ["alma", "alam", "almak", "almaa", "aalma", "allma", "almma", "alman", "almat", "almas"]
    kinds = [f"{w} kert haz" for w in words]
    placed = spark.createDataFrame([(1, k, k, k, 0, kinds[k % 10], "", [], k) for k in range(400)], "source int, key long, frame int, vframe int, rank int, t string, n string, a array<string>, node long")
    scores = shelf.title_scores(placed)
    assert scores.count() == 90
    plan = shelf.alignments(placed, shelf.staged(scores))._jdf.queryExecution().optimizedPlan().toString()
    frames, titles = plan.index("array_contains(near"), plan.rindex("Relation")
    assert frames < titles and shelf.alignments(placed, scores).count() == 399 + 398


def test_frames_of_a_source_walk_together(spark):
    """Offsets equal those of a plain walk, and no local read, which leaves rows where they were, comes before the walk when joins become broadcasts at run time."""
    rng = random.Random(3)
    sizes = {(s, v): rng.randint(1, 4) for s in range(5) for v in range(60)}
    found = [(s, v - d, v, p, p + rng.randint(-2, 1), 1.0) for s, v in sizes for d in (1, 2) if v >= d and rng.random() < 0.4 for p in range(2)]
    placed = spark.createDataFrame([(s, v, r) for (s, v), n in sizes.items() for r in range(n)], "source int, vframe int, rank int")
    pairs = spark.createDataFrame(found, "source int, u int, v int, p int, q int, score double")
    setting = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in setting.items():
        spark.conf.set(k, v)
    try:
        out = shelf.offsets(placed, pairs)
        got = {(r.source, r.vframe): r.offset for r in out.collect()}
        walk = out._jdf.queryExecution().executedPlan().toString().split("MapInPandas", 1)[1]
    finally:
        for k in setting:
            spark.conf.unset(k)

    assert "AQEShuffleRead local" not in walk[: walk.index("ShuffleQueryStage")]

    def shift(s, u, v):
        x = sorted(p - q for t, a, b, p, q, _ in found if (t, a, b) == (s, u, v))
        return (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2 if x else None

    for s in range(5):
        ones = [x for v in range(60) if (x := shift(s, v - 1, v)) is not None]
        right, at = sum(x > 0 for x in ones) >= sum(x < 0 for x in ones), {0: 0.0}
        low, high = 0.0, sizes[s, 0] - 1.0
        for v in range(1, 60):
            one, two = shift(s, v - 1, v), shift(s, v - 2, v)
            at[v] = at[v - 1] + one if one is not None else at[v - 2] + two if two is not None else high + 1 if right else low - sizes[s, v]
            low, high = min(low, at[v]), max(high, at[v] + sizes[s, v] - 1)
        assert [got[s, v] for v in range(60)] == [at[v] for v in range(60)]
