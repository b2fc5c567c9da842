"""Operator 3: line dedup by a deletion-neighbourhood join.

Two lines are one edit apart if deleting the same place of both leaves the same (a substitution) or deleting a place of the
longer leaves the shorter (an insertion). So a line's deletion variants, hashed, join it to its near-equals: equal
(variant, place) for the first, variant equal to a whole line for the second. Before that, lines that share neither their
first nor their second half with another line of fitting length are left out: one edit cannot touch both halves. Equal
lines are one from the start. Of lines within one edit the earliest stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import bundles as B
from .bitmaps import might_be_in
from .stored import stored

MIN_CHARS = 16
ROWS = 1 << 17  # variants in one batch
STEP = 1 << 16  # characters whose variants are hashed at a time
P = (1 << 31) - 1
BASES = (1_284_865_837, 1_610_612_741)
_NULL_ID = (1 << 63) - 1
LINE = ["at", "th", "n"]  # name of a line: the id and a hash of the text of its document, and its number there


def _blank(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r")) == ""


def _placed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df with at and th, which name its documents in their order: by id, then (for rows that share one) by a hash of the text."""
    text = F.col(f"`{text_col}`")
    return df.withColumns({"__at": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NULL_ID)), "__th": F.xxhash64(text)})


def _lines(placed: DataFrame, text_col: str) -> DataFrame:
    """at, th, n, line, h1 of every line that is not blank."""
    cut = placed.select(F.col("__at").alias("at"), F.col("__th").alias("th"), F.posexplode(F.split(F.col(f"`{text_col}`"), "\n", -1)).alias("n", "line"))
    return cut.filter(~_blank(F.col("line"))).withColumn("h1", F.xxhash64("line"))


def _tables() -> list[np.ndarray]:
    out = []
    for base in BASES:
        power = np.ones(STEP, np.int64)
        for k in range(1, STEP):
            power[k] = int(power[k - 1]) * base % P
        out.append(power)
    return out


_powers: list[np.ndarray] = []


def variants(line: str):
    """The line's hash; then slab by slab the first place and the hashes of the line without each character from there on.

    Polynomials at two points modulo the prime 2^31 - 1: lines of n characters agree by chance once in (2^31 / n)^2.
    """
    if not _powers:
        _powers.extend(_tables())
    x = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(x)

    def sums(k, at):
        power = _powers[k] if not at else _powers[k] * pow(BASES[k], at, P) % P
        v = x[at : at + STEP].astype(np.int64) + 1
        return np.cumsum(v * power[: len(v)] % P) % P

    def named(a, b, size):
        return B.mix((a << 31 | b).astype(np.uint64) + B.mix(np.array([size], np.uint64)))

    first = [sums(k, 0) for k in (0, 1)]
    total = [sum(int((first[k] if not at else sums(k, at))[-1]) for at in range(0, n, STEP)) % P for k in (0, 1)]
    yield 0, named(*(np.array([t], np.int64) for t in total), n)
    carry = [0, 0]
    for at in range(0, n, STEP):
        less = []
        for k in (0, 1):
            upto = (carry[k] + (first[k] if not at else sums(k, at))) % P
            before = np.concatenate([[carry[k]], upto[:-1]])
            less.append((before + (total[k] - upto + P) % P * pow(BASES[k], -1, P)) % P)
            carry[k] = int(upto[-1])
        yield at, named(*less, n - 1)


def _variant_rows(batches):
    """Variants of the lines; where one half is known to be shared, only those without a character of the other.

    A line's variants may span several batches: a task holds ROWS + STEP of them, whatever the lines' number and length.
    """

    def flush(batch, held):
        at = pa.array(np.repeat([k for k, *_ in held], [len(key) for _, key, _ in held]))
        role = np.repeat(np.array([r for *_, r in held], np.int8), [len(key) for _, key, _ in held])
        cols = [pa.array(np.concatenate([key for _, key, _ in held]).view(np.int64)), pa.array(role), *(batch.column(i).take(at) for i in (5, 6, 7))]
        return pa.RecordBatch.from_arrays(cols, names=["key", "role", *LINE])

    for batch in batches:
        held, size = [], 0  # roles, 0: whole, 1: one deleted, 2: one deleted at a place
        for k in range(batch.num_rows):
            line, same0, same1, longer0, longer1 = (batch.column(i)[k].as_py() for i in range(5))
            slabs, n = variants(line), len(line)
            half, own = n // 2, (n - 1) // 2
            held.append((k, next(slabs)[1], 0))
            size += 1
            for at, less in slabs:
                end = at + len(less)
                if longer0 or longer1:
                    a, b = max(at, 0 if longer1 else own), min(end, n if longer0 else n - own)
                    held.append((k, less[max(a - at, 0) : max(b - at, 0)], 1))
                if same0 or same1:
                    a, b = max(at, 0 if same1 else half), min(end, n if same0 else half)
                    place = np.arange(a, max(a, b))
                    held.append((k, B.mix(less[place - at] ^ B.mix(place.astype(np.uint64))), 2))
                size += 2 * len(less)
                if size >= ROWS:
                    yield flush(batch, held)
                    held, size = [], 0
        if held:
            yield flush(batch, held)


def _halves(first: DataFrame) -> DataFrame:
    """key, slot, h1: the halves of every line that may be edited, named by length, side and text.

    Slots 0 and 1: left and right half of lines of the key's length; 2 and 3: those of lines one character longer.
    """
    slots = F.array(*[F.struct(F.col(f"k{k}").alias("key"), F.lit(k).cast("byte").alias("slot")) for k in range(4)])
    return first.filter("k0 is not null").select(F.explode(slots).alias("half"), "h1").select("half.*", "h1")


def _near(placed: DataFrame, first: DataFrame, text_col: str) -> DataFrame:
    """LINE of the distinct lines that have an earlier line within one edit."""
    halves = _halves(first)
    # distinct lines only, and a line has one half a slot: counts are enough to know of partners
    shared = halves.groupBy("key").agg(F.count_if(F.col("slot") < 2).alias("own"), F.count_if(F.col("slot") > 1).alias("longer"))
    shared = shared.filter("own > 1 or (own > 0 and longer > 0)")
    hit = halves.join(shared, "key")
    flags = {f"same{side}": (F.col("slot") == side) & (F.col("own") > 1) for side in (0, 1)}
    flags |= {f"longer{side}": F.col("slot") == 2 + side for side in (0, 1)}
    # lines whose h1 agree by chance share their flags, which only adds variants
    flagged = hit.groupBy("h1").agg(*[F.max(x).alias(c) for c, x in flags.items()])
    some = stored(first.select(*LINE, "h1").join(flagged, "h1"))
    # the texts of those lines, from the document where each stands first
    maybe = might_be_in(some, "h1")
    lines = _lines(placed, text_col).filter(maybe(F.col("h1"))).drop("h1")
    texts = stored(lines.join(some, LINE).dropDuplicates(LINE).select("line", *flags, *LINE))
    met = texts.mapInArrow(_variant_rows, "key long, role byte, at long, th long, n int").withColumn("deal", F.col("role") == 2)
    # every member of a group of role 2 is one substitution from every other; of roles 0 and 1, one insertion from the whole line
    counts = met.groupBy("key", "deal").agg(F.count_if(F.col("role") == 0).alias("whole"), F.count_if(F.col("role") > 0).alias("less"))
    counts = counts.filter(F.when(F.col("deal"), F.col("less") > 1).otherwise((F.col("whole") > 0) & (F.col("less") > 0)))
    meeting = stored(met.join(counts.select("key", "deal"), ["key", "deal"]).withColumn("who", F.struct(*LINE)))
    groups = meeting.groupBy("key", "deal").agg(
        F.min("who").alias("least"), F.min(F.when(F.col("role") == 0, F.col("who"))).alias("whole"), F.min(F.when(F.col("role") == 1, F.col("who"))).alias("deleted")
    )
    # the earliest partner: of a whole line the earliest that is one longer, of a longer one the whole line
    partner = F.when(F.col("role") == 2, F.col("least")).when(F.col("role") == 1, F.col("whole")).otherwise(F.col("deleted"))
    paired = meeting.join(groups, ["key", "deal"]).withColumn("p", partner).filter(F.col("p") < F.col("who"))
    pairs = paired.groupBy(*LINE).agg(F.min("p").alias("p")).select(*LINE, *[F.col(f"p.{c}").alias(f"p_{c}") for c in LINE])
    a, b = texts.select(*LINE, "line"), texts.select(*[F.col(c).alias(f"p_{c}") for c in LINE], F.col("line").alias("other"))
    checked = pairs.join(a, LINE).join(b, [f"p_{c}" for c in LINE])
    return checked.filter(F.levenshtein("line", "other", 1) >= 0).select(*LINE)


def _first(placed: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """LINE and h1 of the distinct lines, each where it stands first, and k0 to k3, hashes of their halves (null: too short)."""
    size = F.length("line")
    keys = []
    for pair in (size, size - 1):  # lengths of the shorter of two lines that may be one edit apart
        half = F.floor(pair / 2).cast("int")
        keys += [F.xxhash64(F.lit(1), pair, F.left("line", half)), F.xxhash64(F.lit(2), pair, F.right("line", half))]
    named = {f"k{k}": F.when(size >= min_chars, x) for k, x in enumerate(keys)}
    keyed = _lines(placed, text_col).withColumns({"h2": F.xxhash64(F.lit(3), F.col("line")), **named})
    low = keyed.groupBy("h1", "h2").agg(F.min(F.struct(*LINE)).alias("who"), *[F.max(c).alias(c) for c in named])
    return low.select("who.*", "h1", *named)


def _staying(first: DataFrame, near: DataFrame) -> DataFrame:
    """at, th, and for each of the document's lines up to the last that stays whether it does (blank lines: false)."""
    tagged = first.select(*LINE, F.lit(True).alias("first")).unionByName(near.select(*LINE, F.lit(False).alias("first")))
    lists = [F.collect_list(F.when(x, F.col("n"))) for x in (F.col("first"), ~F.col("first"))]
    doc = tagged.groupBy("at", "th").agg(F.sort_array(F.array_except(*lists)).alias("stay"))
    before = F.slice(F.concat(F.array(F.lit(-1)), F.col("stay")), F.lit(1), F.size("stay"))
    runs = F.zip_with("stay", before, lambda x, p: F.concat(F.array_repeat(F.lit(False), x - p - 1), F.array(F.lit(True))))
    return doc.select(F.col("at").alias("__at"), F.col("th").alias("__th"), F.flatten(runs).alias("__stay"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """df, all columns, with text_col less its repeated lines, plus n_lines and n_removed (columns of these names go).

    A line, the text between line feeds, goes if the same line stands earlier: in a document with a smaller id or further
    up; or if, both having min_chars characters or more, one within an edit distance of 1 does. Shorter lines, such as
    numbers and list marks, differ from others by one character and still say something else; min_chars=1 compares all.
    Earlier lines count whether they stay or not. Blank lines stay. Null texts stay null, with no line; an empty text has
    one blank line. Documents without an id come last. Rows that share an id, or have none, are ordered by a hash of their
    texts; where the texts are equal too they are one document, whose copies keep the same lines. An empty table gives an
    empty result.
    """
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("n_lines", "n_removed")])
    placed = _placed(base, id_col, text_col)
    first = stored(_first(placed, text_col, min_chars))
    text, cut = F.col(f"`{text_col}`"), F.col("__lines")
    out = placed.join(_staying(first, _near(placed, first, text_col)), ["__at", "__th"], "left").withColumn("__lines", F.split(text, "\n", -1))
    out = out.withColumn("__kept", F.filter(cut, lambda x, i: _blank(x) | F.coalesce(F.get(F.col("__stay"), i), F.lit(False))))
    n = lambda x: F.when(text.isNull(), 0).otherwise(F.size(x)).cast("int")
    out = out.withColumns({text_col: F.array_join("__kept", "\n"), "n_lines": n(cut), "n_removed": n(cut) - n(F.col("__kept"))})
    return out.select(*[F.col(f"`{c}`") for c in base.columns], "n_lines", "n_removed")
