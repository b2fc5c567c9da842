"""Drawn tables against drawings of known cells, and notes of markup."""

import random

from pyspark.sql import functions as F

from quillflow.operators.routing import with_reader
from quillflow.sources import files, grids as G


def drawn(rows, cols, spans, rng):
    """A drawing of a grid whose cells (top, left, bottom, right in grid units) are `spans`, and the rows that it means."""
    wide, high = [rng.randint(3, 7) for _ in range(cols)], [rng.randint(1, 2) for _ in range(rows)]
    x, y = [0], [0]
    for w in wide:
        x.append(x[-1] + w + 1)
    for h in high:
        y.append(y[-1] + h + 1)
    area = [[" "] * (x[-1] + 1) for _ in range(y[-1] + 1)]
    want = [[""] * cols for _ in range(rows)]
    for t, a, b, r in spans:
        for c in range(x[a], x[r] + 1):
            for at in (y[t], y[b]):
                area[at][c] = "+" if c in (x[a], x[r]) or area[at][c] == "+" else "-"
        for k in range(y[t], y[b] + 1):
            for c in (x[a], x[r]):
                area[k][c] = "+" if k in (y[t], y[b]) or area[k][c] == "+" else "|"
        word = "".join(rng.choice("abcxyz") for _ in range(rng.randint(0, 3)))
        area[y[t] + 1][x[a] + 1 : x[a] + 1 + len(word)] = word
        want[t][a] = word
    return ["".join(line) for line in area], want


def test_grids_of_random_spans():
    rng = random.Random(3)
    for _ in range(400):
        rows, cols = rng.randint(1, 4), rng.randint(1, 4)
        free, spans = {(r, c) for r in range(rows) for c in range(cols)}, []
        while free:
            t, a = min(free)
            r = a + 1
            while r < cols and (t, r) in free and rng.random() < 0.3:
                r += 1
            b = t + 1
            while b < rows and all((b, c) in free for c in range(a, r)) and rng.random() < 0.3:
                b += 1
            spans.append((t, a, b, r))
            free -= {(k, c) for k in range(t, b) for c in range(a, r)}
        lines, want = drawn(rows, cols, spans, rng)
        used_rows, used_cols = sorted({s[0] for s in spans}), sorted({s[1] for s in spans})
        if G.is_grid(lines[0]) and G.is_grid(lines[-1]):
            assert G.grid(lines) == ([[want[r][c] for c in used_cols] for r in used_rows], 0), lines


def test_header_and_odd_drawings():
    lines = ["+---+---+", "| a | b |", "+===+===+", "| c | d |", "|   | e |", "+---+---+"]
    assert G.grid(lines) == ([["a", "b"], ["c", "d\ne"]], 1)
    assert G.grid(["+---+---+", "| a | b |", "+---+"]) is None and G.grid(["+---+", "| a  ", "+---+"]) is None and G.grid(["+--+"]) is None
    assert G.simple(["===  ===", "a    b", "===  ===", "c    d d", "     more", "e    \\", "===  ==="]) == ([["a", "b"], ["c", "d d\nmore"], ["e", ""]], 1)
    assert G.simple(["==  ==  ==", "a b     c", "------  --", "1   2   3", "==  ==  =="]) == ([["a b", "", "c"], ["1", "2", "3"]], 0)


def test_markup_files(spark):
    rst = "Title\n=====\n\nSee [1]_ and [#]_ and |x| [9]_.\n\n+---+---+\n| a | b |\n+===+===+\n| c     |\n+---+---+\n\n===  ===\nh    i\n===  ===\n1    2\n===  ===\n\n.. [1] First *note*\n   goes on.\n.. [#] Second.\n.. |x| replace:: the words\n"
    org = "* T\nA[fn:1] b[fn:2]\n\n| a | b |\n|---+---|\n| 1 | 2 |\n\n| c |\n\n[fn:1] The note.\n"
    rows = [("/in/a.rst", rst.encode()), ("/in/b.org", org.encode())]
    df = with_reader(spark.createDataFrame(rows, "path string, content binary").withColumn("length", F.octet_length("content").cast("long")), "path")
    out = {r["path"]: r["markdown"] for r in files.convert(df).collect()}
    assert out["/in/a.rst"] == "# Title\n\nSee [^1] and [^2] and the words [9].\n\n| a | b |\n| --- | --- |\n| c |  |\n\n| h | i |\n| --- | --- |\n| 1 | 2 |\n\n[^1]: First *note* goes on.\n\n[^2]: Second.\n"
    assert out["/in/b.org"] == "# T\n\nA[^1] b[fn:2]\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n| c |\n| --- |\n\n[^1]: The note.\n"
