"""Texts that end in one passage over and over, as a generator's do that has fallen into a loop."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

# Copies and visible weight (characters outside ASCII weigh two) from which a repetition is a loop, the same for
# passages of mostly punctuation or table rows, the bytes of the shortest period, those that are searched for a period, passes.
COPIES, WEIGHT, PLAIN_COPIES, PLAIN_WEIGHT, PERIOD, SCAN, PASSES = 6, 120, 64, 1024, 16, 256 << 10, 3


def _loops(unit: str, copies: int) -> bool:
    solid = [c for c in unit if not c.isspace()]
    rows = all(line.lstrip().startswith("|") for line in unit.split("\n") if line.strip())
    plain = rows or sum(map(str.isalnum, solid)) * 2 < len(solid)
    weight = sum(1 if c.isascii() else 2 for c in solid)
    return bool(solid) and copies >= (PLAIN_COPIES if plain else COPIES) and copies * weight >= (PLAIN_WEIGHT if plain else WEIGHT)


def _agreeing(x: np.ndarray, period: int) -> int:
    """How many of the first values of x equal those a period later; looked at in growing steps."""
    n, at, step = len(x) - period, 0, 256
    while at < n:
        differ = np.flatnonzero(x[at : min(at + step, n)] != x[at + period : min(at + step, n) + period])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 4
    return n


def period_of(data: bytes) -> tuple[int, int]:
    """The period of PERIOD bytes or more whose run at the end of data is the longest of those with COPIES, and the run's length;
    (0, 0) if there is none, or a longer run of a shorter period. The period is looked for within SCAN bytes, the run is followed through all of data."""
    back = np.frombuffer(data, np.uint8)[::-1]
    near = data[-SCAN:][::-1]
    best = (0, 0)  # length, -period
    short = max((p + _agreeing(back, p) for p in range(1, min(PERIOD, len(back)))), default=0)
    at = near.find(near[:PERIOD], PERIOD) if len(near) >= 2 * PERIOD else -1
    while at > 0:
        run = at + _agreeing(back, at)
        if run >= COPIES * at:
            best = max(best, (run, -at))
        # what is periodic as far as twice the period only has multiples of it as further periods there
        at = near.find(near[:PERIOD], max(at + 1, run - at if run >= 2 * at else 0))
    return (-best[1], best[0]) if best[0] > short else (0, 0)


def _lines(text: str) -> tuple[str, int, int] | None:
    """The last line, how often it ends the text with nothing but blank lines between, and where the first of these begins."""
    end, copies, unit = len(text), 0, None
    first = end
    while end >= 0:
        at = text.rfind("\n", 0, end) + 1
        line = text[at:end].rstrip()
        if line.strip():
            if unit is None:
                unit = line
            if line != unit:
                break
            copies, first = copies + 1, at
        end = at - 1
    return (unit, copies, first) if unit and copies > 1 else None


def _held(unit: str, source: str, whole_lines: bool) -> int:
    words = lambda x: " ".join(x.split())
    if not source or not words(unit):
        return 0
    return sum(words(x) == words(unit) for x in source.split("\n")) if whole_lines else words(source).count(words(unit))


def salvaged(answer: str, source: str = "") -> tuple[str, int, int, int] | None:
    """(text, copies, kept, removed characters) of an answer that ends in a loop: one copy of the passage stays, or as many as
    the source has. What stays can end in a loop of its own, so there are up to PASSES. None if there is no loop."""
    text, first = answer.rstrip(), None
    before = len(text)
    for _ in range(PASSES):
        lines = _lines(text)
        if lines and _loops(lines[0], lines[1]):
            unit, copies, start = lines
            kept = max(1, _held(unit, source, True))
            if kept >= copies:
                break
            text = text[:start] + "\n".join([unit] * kept)
        else:
            data = text.encode()
            period, run = period_of(data)
            copies = run // period if period else 0
            cut = len(data) - copies * period
            while period and cut < len(data) and data[cut] & 0xC0 == 0x80:  # a run that begins within a character
                cut += 1
            unit = data[cut : cut + period].decode("utf-8", "ignore") if period else ""
            if not period or not _loops(unit, copies):
                break
            kept = max(1, _held(unit, source, False))
            if kept >= copies:
                break
            text = data[: cut + kept * period].decode("utf-8", "ignore").rstrip()
        first = first or (copies, kept)
    return (text, *first, before - len(text)) if first else None


_KIND = T.StructType().add("text", T.StringType()).add("copies", T.IntegerType()).add("kept", T.IntegerType()).add("removed", T.IntegerType())


@F.pandas_udf(_KIND)
def salvage(answer: pd.Series, source: pd.Series) -> pd.DataFrame:
    """salvaged() of each answer; nulls where there is no loop, or no answer."""
    found = [salvaged(a, s or "") if a else None for a, s in zip(answer, source)]
    return pd.DataFrame([x or (None, None, None, None) for x in found], columns=["text", "copies", "kept", "removed"], dtype=object)
