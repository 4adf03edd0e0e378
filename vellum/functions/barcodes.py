"""Bar codes of thirteen digits in grey lines: drawing them as expressions, reading them in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from vellum.functions.names import let

# Widths in modules of the four runs of each digit, 0 to 9; the left half has them as they are (L) or
# turned round (G), and which of both, digit by digit, tells the first digit.
WIDTHS = ["3211", "2221", "2122", "1411", "1132", "1231", "1114", "1312", "1213", "3112"]
SETS = ["LLLLLL", "LLGLGG", "LLGGLG", "LLGGGL", "LGLLGG", "LGGLLG", "LGGGLL", "LGLGLG", "LGLGGL", "LGGLGL"]
# Runs and modules of a symbol, places of its guards' runs, greatest error of a digit, modules of the quiet zone.
RUNS, MODULES, GUARDS, ERROR, QUIET = 59, 95, [0, 1, 2, 27, 28, 29, 30, 31, 56, 57, 58], 1.4, 3
#: Difference of grey below which a line shows nothing.
CONTRAST = 40


def drawn(code: Column, scale: int = 2, dark: int = 20, light: int = 230) -> Column:
    """The grey line, an array of ints, of a code of thirteen digits with quiet zones."""
    digit = lambda i: F.substring(code, i, F.lit(1)).cast("int")
    widths = lambda d: F.get(F.array(*[F.lit(w) for w in WIDTHS]), d)
    sets = F.get(F.array(*[F.lit(s) for s in SETS]), digit(F.lit(1)))
    left = F.array_join(F.transform(F.sequence(F.lit(2), F.lit(7)), lambda i: F.when(F.substring(sets, i - 1, F.lit(1)) == "G", F.reverse(widths(digit(i)))).otherwise(widths(digit(i)))), "")
    right = F.array_join(F.transform(F.sequence(F.lit(8), F.lit(13)), lambda i: widths(digit(i))), "")
    runs = F.concat(F.lit("9111"), left, F.lit("11111"), right, F.lit("1119"))  # a quiet zone, then bars and spaces in turn
    pixels = lambda r, i: F.array_repeat(F.when(i % 2 == 0, dark).otherwise(light), F.substring(r, i, F.lit(1)).cast("int") * scale)
    # The runs are bound, or they would be worked out again for each of them.
    return let(runs, lambda r: F.flatten(F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: pixels(r, i))))


_L = np.array([[int(c) for c in w] for w in WIDTHS], float)
_LEFT, _RIGHT = np.concatenate((_L, _L[:, ::-1])), _L
#: First digit by which of the left digits are turned round, as bits; -1 for none.
_FIRST = np.full(64, -1)
_FIRST[[int(s.replace("L", "0").replace("G", "1"), 2) for s in SETS]] = range(10)
#: Lines that are read at once.
LINES = 512


def _digits(runs: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows of 24 runs the pattern nearest to each four, and whether none is too far from all."""
    four = runs.reshape(-1, 6, 4)
    norm = four * 7 / four.sum(axis=2, keepdims=True)
    errors = np.abs(norm[:, :, None, :] - patterns).sum(axis=3)
    return errors.argmin(axis=2), (errors.min(axis=2) <= ERROR).all(axis=1)


def _symbols(runs: np.ndarray, quiet: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Which of the windows of runs, the first of which is a bar, hold a code, and the codes; ``quiet``: the run before, negative for none."""
    module = runs.sum(axis=1) / MODULES
    at = np.flatnonzero((np.abs(runs[:, GUARDS] - module[:, None]) <= np.maximum(1.2, 0.7 * module)[:, None]).all(axis=1) & ((quiet < 0) | (quiet >= QUIET * module)))
    (left, near), (right, close) = _digits(runs[at, 3:27], _LEFT), _digits(runs[at, 32:56], _RIGHT)
    first = _FIRST[(left >= 10) @ (1 << np.arange(5, -1, -1))]
    digits = np.concatenate((first[:, None], left % 10, right), axis=1)
    good = near & close & (first >= 0) & (digits @ np.array([1, 3] * 6 + [1]) % 10 == 0)
    return at[good], ["".join(map(str, d)) for d in digits[good].tolist()]


def lines_codes(lines: list[np.ndarray]) -> list[list[str]]:
    """Every code on each line, read from the left and then from the right; all lines are cut into runs at once."""
    out: list[list[str]] = [[] for _ in lines]
    which = [i for i, line in enumerate(lines) if len(line)]
    if not which:
        return out
    flat, sizes = np.concatenate([lines[i] for i in which]), np.array([len(lines[i]) for i in which])
    starts = np.cumsum(sizes) - sizes
    low, high = np.minimum.reduceat(flat, starts), np.maximum.reduceat(flat, starts)
    dark = flat < np.repeat((low.astype(float) + high) / 2, sizes)
    change = np.append(True, dark[1:] != dark[:-1])
    change[starts] = True
    edges = np.flatnonzero(change)
    runs, of = np.diff(np.append(edges, len(flat))), np.searchsorted(starts, edges, side="right") - 1
    # A window begins at a dark run of a line that shows something and ends within the line.
    s = np.arange(len(runs) - RUNS + 1)
    s = s[(of[s] == of[s + RUNS - 1]) & dark[edges[s]] & (high.astype(float) - low >= CONTRAST)[of[s]]] if len(s) > 0 else np.empty(0, int)
    windows = runs[s[:, None] + np.arange(RUNS)]
    before, after = s - 1, s + RUNS
    left = np.where((before >= 0) & (of[before] == of[s]), runs[before], -1)
    inside = np.minimum(after, len(runs) - 1)
    right = np.where((after < len(runs)) & (of[inside] == of[s]), runs[inside], -1)
    found = [(*_symbols(windows, left), 1), (*_symbols(windows[:, ::-1], right), -1)]
    for at, codes_, way in found:
        for k, code in list(zip(at.tolist(), codes_, strict=True))[::way]:
            out[which[of[s[k]]]].append(code)
    return out


def line_codes(line: np.ndarray) -> list[str]:
    """Every code on a line, read from the left and then from the right."""
    return lines_codes([line])[0]


@F.pandas_udf(ArrayType(StringType()))
def codes(lines: pd.Series) -> pd.Series:
    """``line_codes`` of a column of grey lines; null has none."""
    every = [np.empty(0, int) if x is None else np.asarray(x) for x in lines]
    return pd.Series([c for i in range(0, len(every), LINES) for c in lines_codes(every[i : i + LINES])], index=lines.index, dtype=object)


def voted(lines: DataFrame, image: str, line: str) -> DataFrame:
    """(image, code): the code on which two lines or more agree, or the only one found; of equal votes the one found first.

    ``lines`` has the column ``y``, the order of an image's lines.
    """
    seen = lines.select(image, "y", F.posexplode(F.array_distinct(codes(F.col(line)))).alias("_i", "code"))
    votes = seen.groupBy(image, "code").agg(F.count("*").alias("n"), F.min(F.struct("y", "_i")).alias("_first"))
    best = votes.groupBy(image).agg(F.min_by(F.struct("code", "n"), F.struct((-F.col("n")).alias("m"), "_first")).alias("_b"), F.count("*").alias("_kinds"))
    return best.where((F.col("_b.n") >= 2) | (F.col("_kinds") == 1)).select(image, F.col("_b.code").alias("code"))
