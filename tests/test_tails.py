"""Looping ends against a plain search over all periods."""

import random

from pyspark.sql import functions as F

from quillflow.functions import tails as T


def brute_period(data):
    best, short = (0, 0), 0
    for p in range(1, len(data)):
        run = p
        while run < len(data) and data[-1 - run] == data[-1 - run + p]:
            run += 1
        if p < T.PERIOD:
            short = max(short, run)
        elif run >= T.COPIES * p:
            best = max(best, (run, -p))
    return (-best[1], best[0]) if best[0] > short else (0, 0)


def test_periods():
    rng = random.Random(6)
    for _ in range(300):
        unit = bytes(rng.choice(b"ab ") for _ in range(rng.randint(10, 40)))
        data = bytes(rng.choice(b"ab ") for _ in range(rng.randint(0, 30))) + unit * rng.randint(3, 9) + unit[: rng.randint(0, 9)]
        assert T.period_of(data) == brute_period(data), data
    assert T.period_of(b"") == (0, 0) and T.period_of(b"x" * 5000) == (0, 0)


def test_salvage():
    sentence = "The same sentence comes again and again. "
    text, copies, kept, removed = T.salvaged("Start. " + sentence * 30)
    assert text == "Start. " + sentence.strip() or text.startswith("Start. The same") and text.count("same sentence") == 1
    assert (copies, kept) == (30, 1) and removed == 29 * len(sentence)
    assert T.salvaged("Start. " + sentence * 5) is None and T.salvaged("No loop here at all.") is None and T.salvaged("") is None
    line = "This line is said over and over"
    assert T.salvaged("Head\n" + f"{line}\n\n" * 8) == (f"Head\n{line}", 8, 1, 7 * (len(line) + 2))
    assert T.salvaged("Head\n" + f"{line}\n" * 8, f"{line}\n" * 3)[:3] == ("Head\n" + "\n".join([line] * 3), 8, 3)
    assert T.salvaged("Head\n" + f"{line}\n" * 8, f"{line}\n" * 9) is None
    assert T.salvaged("| a | b |\n" * 20) is None and T.salvaged("Form\n" + "| name | value |\n" * 90)[1:3] == (90, 1)
    assert T.salvaged("x" * 900) is None and T.salvaged("....." * 200) is None
    long = "".join(chr(97 + (k * 7 + k // 26) % 26) for k in range(60_000)) + " "
    assert T.salvaged("A " + long * 7)[1] == 7  # a run beyond what is searched for the period
    han = "同じ文が何度も続きます。"
    assert T.salvaged("始め。" + han * 20)[:3] == ("始め。" + han, 20, 1)
    nested = "An inner loop of some words. " * 12
    assert T.salvaged("Go. " + (nested.strip() + "\n") * 7)[0].count("inner loop") == 14  # the first line has a start of its own, and the last one lacks a blank at its end


def test_column(spark):
    df = spark.createDataFrame([("A. " + "one passage of some words. " * 9, None), (None, "x"), ("fine", ""), ("", None)], "a string, s string")
    out = [r[0] for r in df.select(T.salvage("a", "s")).collect()]
    assert (out[0]["copies"], out[0]["kept"]) == (9, 1) and all(r is None or r["text"] is None for r in out[1:])
    assert df.limit(0).select(F.col("a"), T.salvage("a", "s")).count() == 0
