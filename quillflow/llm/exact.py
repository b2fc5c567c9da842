"""Operator 10: exact deduplication by composable polynomial fingerprints.

A text's UTF-8 bytes are digits of 16 bits; its fingerprint is the polynomial of the digits at two random points modulo
2^31 - 1, with the length. Fingerprints of neighbouring chunks compose: that of the left one is multiplied by the point
to the power of the right one's digits. Huge texts are therefore hashed chunk by chunk on many tasks. Texts whose
fingerprint occurs once are distinct for certain. The rest meet, sorted by fingerprint, and are compared chunk by chunk
as they stream past; a chance agreement of fingerprints only opens another class.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .batches import small_batches
from .bitmaps import bitmap, looked_up
from .stored import stored

P = (1 << 31) - 1
POINTS = (1_284_865_837, 1_610_612_741)
CHUNK = 1 << 16  # bytes; 2^15 digits of 16 bits times 31 bits stay below 2^63
HUGE = 1 << 20  # bytes; longer texts are cut and their chunks dealt out
GROUP_ROWS = 2000  # rows of one fingerprint that one sorted run compares, at least
HOT_GROUPS = 10_000  # fingerprints with more rows than a run, at most: a run has this share of all rows or GROUP_ROWS
_powers = None


def _tables() -> list[np.ndarray]:
    global _powers
    if _powers is None:
        _powers = []
        for x in POINTS:
            p = np.empty(CHUNK // 2, np.int64)
            value = 1
            for k in range(len(p)):
                p[k] = value
                value = value * x % P
            _powers.append(p[::-1].copy())
    return _powers


def chunk_hash(chunk) -> tuple[int, int, int]:
    """(digits, polynomial at the first point, at the second) of at most CHUNK bytes."""
    if len(chunk) % 2:
        chunk = bytes(chunk) + b"\0"
    digits = np.frombuffer(chunk, "<u2").astype(np.int64)
    n = len(digits)
    return (n, *(int(digits @ p[len(p) - n :]) % P if n else 0 for p in _tables()))


def compose(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """Fingerprint of two neighbouring chunks from theirs."""
    return (left[0] + right[0], *((a * pow(x, right[0], P) + b) % P for a, b, x in zip(left[1:], right[1:], POINTS)))


def fingerprint(data) -> tuple[int, int, int]:
    out = (0, 0, 0)
    for at in range(0, len(data), CHUNK):
        out = compose(out, chunk_hash(data[at : at + CHUNK]))
    return out


KEY = ["n_bytes", "h1", "h2"]
_KEY = "n_bytes long, h1 long, h2 long"


def _fingerprints(df: DataFrame) -> DataFrame:
    """df: doc_id, sha, data binary. Returns doc_id, sha and the fingerprint."""

    def go(batches):
        for batch in batches:
            n, found = [], []
            for x in batch.column(2):
                x = x.as_buffer()
                n.append(len(x)), found.append(fingerprint(x)[1:])
            cols = [pa.array(n, pa.int64()), *(pa.array([h[k] for h in found], pa.int64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *cols], names=["doc_id", "sha", *KEY])

    return df.mapInArrow(go, f"doc_id long, sha string, {_KEY}")


def _repeated(df: DataFrame, groups: DataFrame) -> DataFrame:
    """df: doc_id, data. The rows, with their fingerprint, that may have one of `groups`."""
    bits = bitmap(groups.withColumn("h", F.col("h1").bitwiseXOR(F.shiftleft("h2", 20))), "h")

    def go(batches):
        for batch in batches:
            found = np.array([(len(x := v.as_buffer()), *fingerprint(x)[1:]) for v in batch.column(1)], np.int64).reshape(-1, 3)
            some = np.flatnonzero(looked_up(bits, found[:, 1] ^ found[:, 2] << 20))
            kept = batch.take(pa.array(some))
            yield pa.RecordBatch.from_arrays([kept.column(0), *(pa.array(found[some, k]) for k in range(3)), kept.column(1)], names=["doc_id", *KEY, "data"])

    return df.mapInArrow(go, f"doc_id long, {_KEY}, data binary")


def _huge(df: DataFrame) -> DataFrame:
    """Fingerprints of huge texts, whose chunks are dealt to all tasks and composed again by length-shifted sums."""
    def go(batches):
        for batch in batches:
            rest, rows = batch.column(2).to_pylist(), []
            for x, tail in zip(batch.column(1), rest):
                k, *h = chunk_hash(x.as_buffer().to_pybytes())
                rows.append([a * pow(p, tail, P) % P for a, p in zip(h, POINTS)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1))], names=["key", "h1", "h2"]
            )

    key = F.struct("rid", "doc_id", "sha", "n_bytes")
    size, at = F.octet_length("data"), F.col("k") * CHUNK
    tail = F.floor((size + 1) / 2) - F.floor((F.least(at + CHUNK, size) + 1) / 2)
    chunks = (
        df.withColumn("rid", F.monotonically_increasing_id())
        .withColumn("n_bytes", size.cast("long"))
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / CHUNK).cast("int"))))
        .select(key.alias("key"), F.expr(f"substring(data, k * {CHUNK} + 1, {CHUNK})").alias("data"), tail.cast("long").alias("tail"), "k")
        .repartition(F.col("key.rid"), F.col("k"))
        .select("key", "data", "tail")
    )
    parts = chunks.mapInArrow(go, f"key struct<rid:long,doc_id:long,sha:string,n_bytes:long>, h1 long, h2 long")
    total = parts.groupBy("key").agg(*[(F.sum(h) % P).alias(h) for h in ("h1", "h2")])
    return total.select("key.doc_id", "key.sha", "key.n_bytes", "h1", "h2")


def _compare(df: DataFrame) -> DataFrame:
    """Sorted by fingerprint: gives each row the digest of the first text of its run that equals it chunk by chunk."""

    def go(batches):
        key, known = None, []
        for batch in batches:
            labels = []
            for k, x in zip(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))), batch.column(5)):
                data = x.as_buffer()
                if k != key:
                    key, known = k, []
                for label, other in known:
                    if all(data[i : i + CHUNK] == other[i : i + CHUNK] for i in range(0, max(len(data), 1), CHUNK)):
                        break
                else:
                    label, own = hashlib.sha256(data).hexdigest(), data.to_pybytes()
                    known.append((label, memoryview(own)))
                labels.append(label)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(labels)], names=["doc_id", *KEY, "run", "label"])

    return df.mapInArrow(go, f"doc_id long, {_KEY}, run long, label string")


def _dealt(df: DataFrame, hot: DataFrame) -> DataFrame:
    """df with `run`: rows of a hot fingerprint are dealt to its runs by their place, all others are in run 0."""
    dealt = df.withColumn("__place", F.monotonically_increasing_id()).join(F.broadcast(hot), KEY, "left")  # at most HOT_GROUPS rows
    return dealt.withColumn("run", F.coalesce(F.pmod(F.xxhash64("__place"), F.col("runs")), F.lit(0).cast("long"))).drop("__place", "runs")


def _for_all_runs(groups: DataFrame, hot: DataFrame) -> DataFrame:
    """groups with `run`: a row for each run of its fingerprint."""
    runs = F.sequence(F.lit(0).cast("long"), F.coalesce("runs", F.lit(1).cast("long")) - 1)
    return groups.join(F.broadcast(hot), KEY, "left").withColumn("run", F.explode(runs)).drop("runs")


def equal_text_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. keep_id is the largest doc_id of the texts equal to this
    one (null ids only: null), group_size the number of their rows. A row that is repeated with its doc_id is kept or
    dropped with its repeats (`deduplicate` then leaves one). An empty table gives an empty result.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    id_, data = F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.encode(text, "UTF-8").alias("data")
    base = small_batches(df).select(id_, F.sha2(text, 256).alias("sha"), data)
    huge = F.octet_length("data") > HUGE
    rows = _fingerprints(base.filter(~huge)).unionByName(_huge(base.filter(huge)))
    groups = stored(rows.groupBy(*KEY).agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"), F.first("sha").alias("sha")))
    several = groups.filter("group_size > 1").select(*KEY, "group_size")
    # fingerprints of more rows than one run compares; at most HOT_GROUPS of them, as each has its share of the rows
    n = groups.agg(F.sum("group_size")).first()[0] or 0
    most = max(GROUP_ROWS, n // HOT_GROUPS)
    hot = several.filter(F.col("group_size") > most).select(*KEY, F.ceil(F.col("group_size") / most).alias("runs"))
    # equal fingerprints: the texts themselves meet, those of a hot one in runs that neither meet nor travel as one
    order = [*KEY, "run"]
    members = _dealt(_repeated(df.select(id_, data), several), hot).join(_for_all_runs(several.select(*KEY), hot), order)
    met = members.repartition(*[F.col(c) for c in order]).sortWithinPartitions(*order).select("doc_id", *order, "data")
    labelled = stored(_compare(met))
    classes = labelled.groupBy(*KEY, "label").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
    repeated = labelled.join(_for_all_runs(classes, hot), [*order, "label"])
    alone = groups.filter("group_size = 1").select(F.col("keep_id").alias("doc_id"), "keep_id", "group_size", F.col("sha").alias("label"))
    out = alone.unionByName(repeated.select(*alone.columns))
    kept: Column = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("label").alias("text_sha256"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of df whose text no row with a larger id has; one of each set of wholly equal (id, text) rows."""
    keep = equal_text_groups(df, id_col, text_col).filter("kept").select("doc_id", "text_sha256").distinct()
    sha = F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)
    keyed = df.withColumns({"__id": F.col(f"`{id_col}`").cast("long"), "__sha": sha}).dropDuplicates(["__id", "__sha"])
    hit = keyed["__id"].eqNullSafe(keep["doc_id"]) & (keyed["__sha"] == keep["text_sha256"])
    return keyed.join(keep, hit, "left_semi").drop("__id", "__sha")
