"""Operator 4: approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (random signs, fast Hadamard transform, three times) takes a unit vector to the nearest of the signed
axes. A bucket's name is the axes that one or several rotations give, as many as keep buckets at some thousand rows however
long the table is; several such names give several tables. A row stands in one bucket of each table, a query visits the
buckets of its nearest axes, and of the nearest combinations of axes. How many of them is measured: the true neighbours of
a bounded sample of queries tell how far the others must go. Within a bucket all visiting queries meet its rows in blocks and
the exact inner product on the original vectors ranks them.

The angle orders rows as the inner product does only where they are about equally long. So rows are hashed in groups of
one dimension and similar length, and a query visits every group of its dimension; small groups it meets whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from .stored import stored

TABLES, ROUNDS = 16, 3
BUCKET = 4096  # rows that a bucket is planned for, where one rotation's axes do not suffice
SAMPLE = 128  # queries whose true neighbours are sought to measure how many probes the others need
RECALL = 0.97  # share of the sample's neighbours that the probes must reach
MOST_PROBES = 1024  # combinations that a query is given in order, at most; if RECALL needs more, the dimension is searched whole
BAND = np.log(1.1)  # rows of a hashed group differ in length by at most a factor of 1.1
WHOLE = 2048  # bands of at most so many rows are not hashed; neighbouring ones are met together, up to CHUNK rows
CHUNK = 8192  # rows of a bucket that meet the queries in one unit of work


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal fast Hadamard transform of each row; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def layout(n: int, width: int) -> tuple[int, int]:
    """Rotations that name a bucket, and the axes that count of the last one, for n rows."""
    functions, buckets = 1, 2 * width
    while n > BUCKET * buckets:
        last = 1
        while last < width and n > BUCKET * buckets * 2 * last:
            last *= 2
        functions, buckets = functions + 1, buckets * 2 * last
    return functions, width if functions == 1 else last


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows as unit vectors whose width is a power of two."""
    x = np.zeros((len(v), 1 << (v.shape[1] - 1).bit_length()))
    x[:, : v.shape[1]] = v / np.abs(v).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _signs(width: int, functions: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, width)).choice(np.array([-1.0, 1.0]), (functions, TABLES, ROUNDS, width))


def names(x: np.ndarray, functions: int, last: int, probes: int, seed: int) -> np.ndarray:
    """Buckets of unit vectors in each table, nearest first: rows x tables x probes (fewer where there are fewer)."""
    width, out = x.shape[1], []
    every = _signs(width, functions, seed)
    for t in range(TABLES):
        name, loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for f in range(functions):
            y = x
            for s in every[f, t]:
                y = hadamard(y * s)
            own = last if f == functions - 1 else width
            both = np.concatenate([y[:, :own], -y[:, :own]], 1)
            few = min(probes, 2 * own)
            axis = np.argpartition(-both, few - 1, axis=1)[:, :few]
            value = np.take_along_axis(both, axis, 1)
            gap = (value.max(1, keepdims=True) - value) ** 2
            name = (name[:, :, None] * (2 * own) + axis[:, None, :]).reshape(len(x), -1)
            loss = (loss[:, :, None] + gap[:, None, :]).reshape(len(x), -1)
            if loss.shape[1] > probes:
                best = np.argpartition(loss, probes - 1, axis=1)[:, :probes]
                name, loss = np.take_along_axis(name, best, 1), np.take_along_axis(loss, best, 1)
        out.append(np.take_along_axis(name, np.argsort(loss, axis=1, kind="stable"), 1) * TABLES + t)
    return np.stack(out, 1)


def _buckets(seed: int, probes: dict[int, int]):
    """Adds buckets (array<long>) to vectors: that of each table, or those that queries visit; -1 for a group met whole."""

    def go(batches):
        for batch in batches:
            query, dims, functions, last = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("query", "dim", "functions", "last"))
            vectors, found = batch.column(batch.schema.get_field_index("v")), [[-1]] * batch.num_rows
            key = np.stack([dims, functions, last, query.astype(np.int64)], 1)
            for dim, f, axes, asks in np.unique(key[functions > 0], axis=0).tolist():
                at = np.flatnonzero((key == (dim, f, axes, asks)).all(1))
                v = np.stack([_vector(vectors[i], dim) for i in at.tolist()])
                for i, x in zip(at.tolist(), names(_unit(v), f, axes, probes[dim] if asks else 1, seed)):
                    found[i] = x.ravel()
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "query", "v", "dim", "group")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found, pa.list_(pa.int64()))], names=["id", "query", "v", "dim", "group", "buckets"])

    return go


def _vector(packed, dim: int) -> np.ndarray:
    """A vector from its bytes: floats or doubles, as the table has them."""
    data = packed.as_buffer() if isinstance(packed, pa.Scalar) else packed
    return np.frombuffer(data, np.float32 if len(data) == 4 * dim else np.float64).astype(np.float64)


def _packed(single: bool):
    """Vectors as bytes (floats stay floats), their dimension and the band of their length."""
    return lambda batches: _pack(batches, single)


def _pack(batches, single: bool):
    for batch in batches:
        packed, dims, bands = [], [], []
        for v in batch.column(2):
            x = np.asarray(v.as_py(), np.float64)
            top = np.abs(x).max()
            packed.append((x.astype(np.float32) if single else x).tobytes()), dims.append(len(x))
            bands.append(int(np.floor((np.log(top) + np.log(((x / top) ** 2).sum()) / 2) / BAND + 0.5)))  # equal lengths are often 1
        cols = [*batch.columns[:2], pa.array(packed, pa.binary()), pa.array(dims, pa.int32()), pa.array(bands, pa.int32())]
        yield pa.RecordBatch.from_arrays(cols, names=["id", "query", "v", "dim", "band"])


def _groups(sizes: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(dim, band, rows) to (dim, band, group, rotations, axes of the last): a band of over WHOLE rows is a group, smaller
    neighbours share one that is met whole (no rotation)."""
    out, group, open_, last, held = [], -1, False, None, 0
    for dim, band, n in sorted(sizes):
        small = n <= WHOLE
        if not (small and open_ and dim == last and held + n <= CHUNK):
            group, held = group + 1, 0
        out.append((dim, band, group, *((0, 0) if small else layout(n, 1 << (dim - 1).bit_length()))))
        open_, last, held = small, dim, held + n
    return out


def _probes(rows: DataFrame, groups: list[tuple[int, int, int, int, int]], k: int, seed: int) -> dict[int, int]:
    """By dimension, the buckets of each table that a query visits: so many that RECALL of the true k nearest of at most SAMPLE
    queries stand in one of them; 0 where MOST_PROBES are not enough. The sample's neighbours, SAMPLE x k vectors, are found in one pass over all rows."""
    sample = rows.filter("query").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "v", "dim").collect()
    asked = {d: (np.array([r["id"] for r in sample if r["dim"] == d]), np.stack([_vector(r["v"], d) for r in sample if r["dim"] == d])) for d in {r["dim"] for r in sample}}

    def go(batches):
        best: dict[int, list] = {}
        for batch in batches:
            ids, dims = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("id", "dim"))
            for d in set(dims.tolist()) & set(asked):
                at = np.flatnonzero(dims == d)
                packed = [batch.column(batch.schema.get_field_index("v"))[i].as_py() for i in at.tolist()]
                bands = batch.column(batch.schema.get_field_index("band")).to_numpy()[at]
                score = asked[d][1] @ np.stack([_vector(x, d) for x in packed]).T
                score[asked[d][0][:, None] == ids[at][None, :]] = -np.inf
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                for q, row in enumerate(top):
                    held = best.setdefault((d, q), [])
                    held += [(float(score[q, j]), int(ids[at[j]]), packed[j], int(bands[j])) for j in row if score[q, j] > -np.inf]
                    held.sort(key=lambda x: (-x[0], x[1]))
                    del held[k:]
        rows_ = [(int(asked[d][0][q]), i, s, v, d, b) for (d, q), held in best.items() for s, i, v, b in held]
        cols = list(zip(*rows_)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["query_id", "vec_id", "score", "v", "dim", "band"])

    near = rows.mapInArrow(go, f"{_FOUND}, v binary, dim int, band int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).collect()
    of = {(d, b): (f, last) for d, b, _, f, last in groups}
    out = {d: 8 for d, *_ in groups}
    for d, (ids, v) in asked.items():
        needed = []
        for f, last in {x for (dim, _), x in of.items() if dim == d}:
            own = [r for r in near if r["dim"] == d and of[d, r["band"]] == (f, last)]
            if not own or not f:
                needed += [1] * len(own)
                continue
            visits = dict(zip(ids.tolist(), names(_unit(v), f, last, MOST_PROBES, seed)))
            stands = names(_unit(np.stack([_vector(r["v"], d) for r in own])), f, last, 1, seed)[:, :, 0]
            for r, bucket in zip(own, stands):
                hit = (visits[r["query_id"]] == bucket[:, None]).any(0)
                needed.append(int(hit.argmax()) + 1 if hit.any() else MOST_PROBES + 1)
        if needed:
            enough = int(np.sort(needed)[min(int(np.ceil(RECALL * len(needed))), len(needed)) - 1])
            out[d] = enough if enough <= MOST_PROBES else 0
    return out


def _meet(k: int):
    """Rows sorted by (bucket, chunk, query first): each query's k best of the unit's rows."""

    def settle(rows):
        own = [np.concatenate(c) for c in zip(*[(i, q) for i, q, _ in rows])]
        ids, query = own
        v = np.concatenate([x for *_, x in rows])
        qi, qv, pi, pv = ids[query], v[query], ids[~query], v[~query]
        order = np.argsort(pi, kind="stable")
        pi, pv = pi[order], pv[order]
        for a in range(0, len(qi) if len(pi) else 0, 1024):
            s = qv[a : a + 1024] @ pv.T
            s[qi[a : a + 1024, None] == pi[None, :]] = -np.inf
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]  # ties: smaller id first
            score = np.take_along_axis(s, best, 1)
            r, c = np.nonzero(score > -np.inf)
            cols = [pa.array(qi[a : a + 1024][r]), pa.array(pi[best[r, c]])]
            exact = np.einsum("ij,ij->i", qv[a : a + 1024][r], pv[best[r, c]])
            yield pa.RecordBatch.from_arrays([*cols, pa.array(exact)], names=["query_id", "vec_id", "score"])

    def go(batches):
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, chunk, ids, query, dims = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 5))
            v = [_vector(x, d) for x, d in zip(batch.column(4), dims.tolist())]
            cut = np.flatnonzero((bucket[1:] != bucket[:-1]) | (chunk[1:] != chunk[:-1])) + 1
            for a, b in zip([0, *cut], [*cut, len(bucket)]):
                if (now := (bucket[a], chunk[a])) != key and held:
                    yield from settle(held)
                    held = []
                key = now
                held.append((ids[a:b], query[a:b], np.stack(v[a:b])))
        if held:
            yield from settle(held)

    return go


_FOUND = "query_id long, vec_id long, score double"


def _best(found: DataFrame, k: int) -> DataFrame:
    """found holds at most tables x probes x k rows of a query, with the chunks of a bucket."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(
    df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 23
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row where `queries` holds, its k nearest others found.

    Nearness is the largest inner product, in double precision; ties go to the smaller id. Vectors that are null, zero or
    hold null or non-finite components take no part, nor do null ids; the others meet those of their own dimension. Rows
    with the same id are one row (the first vector in order). A query that met fewer than k rows is searched exactly,
    against all rows in blocks, so it has k results or all candidates; so are all queries of a dimension where a sample shows
    that the probes would not reach RECALL. Every row is indexed; no bucket is capped.
    """
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("query"), v.alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = rows.groupBy("id").agg(F.min(F.struct("v", "query")).alias("x")).select("id", "x.query", "x.v")
    single = df.schema[vector_col].dataType.elementType == T.FloatType()
    rows = stored(rows.mapInArrow(_packed(single), "id long, query boolean, v binary, dim int, band int"))
    # one row for each dimension and tenth of length
    sizes = [tuple(r) for r in rows.groupBy("dim", "band").count().collect()]
    spark = df.sparkSession
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    groups = _groups(sizes)
    probes = _probes(rows, groups, k, seed)
    groups = [(d, b, g, *((f, last) if probes[d] else (0, 0))) for d, b, g, f, last in groups]  # a group without rotations is met whole
    layouts = "group int, functions int, last int"
    of_band = F.broadcast(spark.createDataFrame(groups, f"dim int, band int, {layouts}"))
    of_dim = F.broadcast(spark.createDataFrame(sorted({(d, *g) for d, _, *g in groups}), f"dim int, {layouts}"))
    cols = ["id", "query", "v", "dim", "group", "functions", "last"]
    placed = rows.withColumn("query", F.lit(False)).join(of_band, ["dim", "band"]).select(*cols).unionByName(rows.filter("query").join(of_dim, "dim").select(*cols))
    hashed = placed.mapInArrow(_buckets(seed, probes), "id long, query boolean, v binary, dim int, group int, buckets array<long>")
    hashed = stored(hashed)
    spread = hashed.select("id", "query", "v", "dim", "group", F.explode("buckets").alias("bucket"))
    spread = spread.select("id", "query", "v", "dim", F.xxhash64("group", "bucket").alias("bucket"))
    # only buckets of more than a chunk are named here: TABLES x rows / CHUNK of them at most
    chunks = spread.filter("not query").groupBy("bucket").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).filter("chunks > 1")
    placed = spread.join(chunks, "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    chunk = F.when(F.col("query"), every).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")))
    units = placed.select("bucket", F.explode(chunk).alias("chunk"), "id", "query", "v", "dim")
    found = stored(_best(_search(units, k), k))
    others = {}
    for dim, _, n in sizes:
        others[dim] = others.get(dim, -1) + n
    due = F.broadcast(spark.createDataFrame([(dim, min(k, n)) for dim, n in others.items()], "dim int, due int"))
    met = found.groupBy("query_id").count()
    asked = rows.filter("query").select("id", "dim").join(due, "dim")
    short = asked.join(met, asked["id"] == met["query_id"], "left").filter(F.coalesce("count", F.lit(0)) < F.col("due"))
    short = stored(short.select("id", "dim"))
    lacking = short.count()
    if lacking:
        exact = _best(_exact(rows, short, lacking, sum(n for *_, n in sizes), k), k)
        found = found.join(short, found["query_id"] == short["id"], "left_anti").unionByName(exact)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(units: DataFrame, k: int) -> DataFrame:
    met = units.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk", F.desc("query"))
    return met.mapInArrow(_meet(k), _FOUND)


def _exact(rows: DataFrame, short: DataFrame, lacking: int, n: int, k: int) -> DataFrame:
    """A stated set of queries against all rows of their dimension, both in blocks."""
    q_blocks, p_blocks = -(-lacking // 2048), -(-n // CHUNK)
    block = lambda x: F.col("dim").cast("long") * q_blocks + x
    q = rows.join(short.select("id"), "id", "left_semi").withColumn("bucket", block(F.pmod(F.xxhash64("id"), F.lit(q_blocks))))
    q = q.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(p_blocks - 1)))).withColumn("query", F.lit(True))
    p = rows.join(short.select("dim").distinct(), "dim", "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    p = p.withColumn("bucket", block(F.col("block"))).withColumn("query", F.lit(False))
    p = p.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(p_blocks)).cast("int"))
    cols = ["bucket", "chunk", "id", "query", "v", "dim"]
    return _search(q.select(*cols).unionByName(p.select(*cols)), k)
