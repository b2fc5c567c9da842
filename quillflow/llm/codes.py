"""Operator 13: vector code compression (product quantisation) with exact whole-number distances.

A vector's parts are coded by the nearest entry of their position's codebook. A float32 matrix product screens all entries
at once; its rounding errors are bounded rigorously, so only entries whose interval overlaps the best one's are evaluated
again, in int64, and ties go to the lower index. A pass over the table ends in at most parts x entries partial sums a task;
the codebooks, the only thing that the driver holds, do not grow with the table.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .stored import stored
from .vectors import lengths, sound, whole

SLAB = 4096  # vectors that are screened at a time
HOT = 1000  # labels of more than one in HOT rows are joined by broadcast, at most HOT of them
UNIT = 2.0**-24  # rounding error of float32


def edges(dim: int, parts: int) -> list[int]:
    """Where parts begin and end: equal ones, or a component more or less where dim is no multiple."""
    return [dim * p // parts for p in range(parts + 1)]


def screened(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores |c|^2 - 2xc (float32, rows x entries) that order entries as distances do, and for each row an upper bound of
    the least score and of the error of each of its scores.

    A product x_j c_j passes at most w + 3 roundings (two conversions, product and sums in any order or fused, the last
    subtraction), |c|^2 two; doubling is exact, and whole numbers neither underflow nor reach float32's range.
    """
    width = book.shape[1]
    gamma = (width + 4) * UNIT / (1 - (width + 4) * UNIT)
    norm = (book * book).sum(1)
    score = norm.astype(np.float32) - 2 * (x.astype(np.float32) @ book.astype(np.float32).T)
    longest = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    error = gamma * (1 + 2.0**-20) * (norm.max() + 2 * longest * np.sqrt(float(norm.max())))
    return score, score.min(1).astype(np.float64) + error, error


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties: the lowest) and squared distance, exact, of rows of whole numbers."""
    score, best, error = screened(x, book)
    most = np.nextafter((best + error).astype(np.float32), np.float32(np.inf))
    row, entry = np.nonzero(score <= most[:, None])  # intervals that overlap the best one's
    index = np.zeros(len(x), np.int64)
    alone = np.bincount(row, minlength=len(x)) == 1
    index[row[alone[row]]] = entry[alone[row]]
    row, entry = row[~alone[row]], entry[~alone[row]]
    if len(row):
        far = ((x[row] - book[entry]) ** 2).sum(1)
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.repeat(np.minimum.reduceat(far, begin), np.diff(np.append(begin, len(row))))
        hit = np.flatnonzero(far == least)  # in the order of entries
        first = hit[np.diff(row[hit], prepend=-1) > 0]
        index[row[first]] = entry[first]
    return index, ((x - book[index]) ** 2).sum(1)


def _coded(x: np.ndarray, books: list[np.ndarray], cut: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and errors of vectors."""
    code, error = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
    for at in range(0, len(x), SLAB):
        part = slice(at, at + SLAB)
        for p, book in enumerate(books):
            index, far = nearest_entries(x[part, cut[p] : cut[p + 1]], book)
            code[part, p] = index
            error[part] += far
    return code, error


def _partial(books: list[np.ndarray], cut: list[int]):
    """Of each task: members of every entry that has any, and the sums of their components."""

    def go(batches):
        count = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            x = whole(batch.column(0), cut[-1])
            code, _ = _coded(x, books, cut)
            for p, book in enumerate(books):
                order = np.argsort(code[:, p], kind="stable")
                own, begin = np.unique(code[order, p], return_index=True)
                if len(own) and book.shape[1]:
                    total[p][own] += np.add.reduceat(x[order, cut[p] : cut[p + 1]], begin, axis=0)
                count[p] += np.bincount(code[:, p], minlength=len(book))
        found = [(p, e) for p in range(len(books)) for e in np.flatnonzero(count[p]).tolist()]
        cols = [pa.array([p for p, _ in found], pa.int32()), pa.array([e for _, e in found], pa.int32()), pa.array([int(count[p][e]) for p, e in found], pa.int64())]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([total[p][e].tolist() for p, e in found], pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return go


def _next(rows: DataFrame, books: list[np.ndarray], cut: list[int]) -> list[np.ndarray]:
    """The codebooks after a round over rows.v."""
    partial = rows.select("v").mapInArrow(_partial(books, cut), "part int, entry int, n long, sums array<long>")
    each = [F.sum(F.get("sums", F.lit(j)).cast("decimal(20,0)")).alias(f"s{j}") for j in range(max(b.shape[1] for b in books))]
    books = [b.copy() for b in books]
    for part, entry, n, *sums in partial.groupBy("part", "entry").agg(F.sum("n"), *each).collect():
        books[part][entry] = [int(s) // n for s in sums[: books[part].shape[1]]]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def _of_one_length(rows: DataFrame, dim: int, parts: int, entries: int, rounds: int) -> DataFrame:
    rows, cut = rows.filter(F.size("v") == dim), edges(dim, parts)
    first = rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    seeds = whole(pa.array([r["v"] for r in first], pa.list_(pa.float64())), dim)
    books = [seeds[:, a:b].copy() for a, b in zip(cut, cut[1:])]
    for _ in range(rounds):
        books = _next(rows, books, cut)

    def go(batches):
        for batch in batches:
            code, error = _coded(whole(batch.column(2), dim), books, cut)
            text = pa.array([c.tobytes().hex() for c in code], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, pa.array(error)], names=["vec_id", "label", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(go, f"vec_id long, label {label}, code string, error long").withColumn("codebooks_sha256", F.lit(digest(books)))


def compress(
    df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256 of every sound vector's whole numbers.

    Vectors that are null or empty, or hold a null, non-finite or out-of-range component (beyond +-2^20 or so: distances
    must fit a long) have no row. Vectors of each length are coded by themselves, with codebooks of their own; where the
    length is no multiple of `parts`, parts differ by one component. Codebooks start from the smallest ids (null ones last,
    equal ones by the vector); fewer vectors than `entries` make fewer entries. Every row keeps its own code, also those that
    share an id or have none. label_error sums over rows of equal label, null ones together, and is null beyond a long.
    Other columns are not read, and an empty table gives an empty result.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256: a code has two hex digits a part")
    v = F.col(f"`{vector_col}`")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), v.alias("v")).filter(sound(v))
    coded = [_of_one_length(rows, dim, parts, entries, rounds) for dim in lengths(rows, "v")]
    if not coded:
        return df.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = stored(reduce(DataFrame.unionByName, coded))
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.expr("try_cast(sum(cast(error AS decimal(20,0))) AS bigint)").alias("label_error"), F.count("*").alias("n"))
    sums = stored(sums)
    # a hot label never meets its rows in one task: those of over one in HOT rows, HOT at most, go to the rows instead
    hot = F.col("n") * HOT > (sums.agg(F.sum("n")).first()[0] or 0)
    near = coded.join(F.broadcast(sums.filter(hot)), F.col("label").eqNullSafe(F.col("of")), "left").filter("n is not null")
    rest = coded.join(F.broadcast(sums.filter(hot).select("of")), F.col("label").eqNullSafe(F.col("of")), "left_anti")
    rest = rest.join(sums.filter(~hot), F.col("label").eqNullSafe(F.col("of")))
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return near.select(*columns).unionByName(rest.select(*columns))
