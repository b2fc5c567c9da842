"""Operator 5: mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A flow routes words from patterns to
the sources' targets: the first use of a pattern's words is cheap, each further use dearer, so repetition is spread and
never above the bound. The flow's graph has a node for each pattern and source, not for each document; a source that
overlaps no other has its flow in closed form, so the graph holds the overlapping ones only. Which documents make up a
partial use is then drawn by a seeded hash, with a cut found from a histogram of hash buckets.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .stored import stored

WORD = r"[^\x20\x09-\x0D]+"
#: The flow of overlapping sources runs on the driver; more membership patterns of these are an error, not a silent cut.
MAX_PATTERNS = 20_000
BROADCAST = 20_000  # patterns up to which the plan is broadcast
BUCKETS = 1 << 14
CUTS = 3  # the first cut leaves less than one row's size open, each further one fills that with smaller rows


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def route(patterns: list[tuple[tuple, int]], targets: dict, repeats: int) -> dict[tuple[int, int], int]:
    """Min-cost flow: (pattern's index, source) -> words. patterns: (sources, words). The k-th use of words costs 2k - 1.

    Only the arcs into patterns cost, so a cheapest path is one that begins with the cheapest use: uses are opened one after
    another, and each time the flow is raised to its maximum by blocking flows over shortest paths.
    """
    source_of = {s: len(patterns) + 1 + k for k, s in enumerate(targets)}
    end = len(patterns) + len(targets) + 1
    head, room, arcs = [], [], [[] for _ in range(end + 1)]

    def arc(a, b, size):
        for x, y, z in ((a, b, size), (b, a, 0)):
            arcs[x].append(len(head))
            head.append(y), room.append(z)

    for k, (_, words) in enumerate(patterns):
        arc(0, k + 1, 0)  # number 2k
    for s, t in targets.items():
        arc(source_of[s], end, round(t))
    links = []
    for k, (sources, words) in enumerate(patterns):
        for s in sources:
            links.append((k, s, len(head)))
            arc(k + 1, source_of[s], repeats * words)

    def blocking() -> bool:
        """Fills all shortest paths; false if there is none."""
        depth, queue = [-1] * (end + 1), deque([0])
        depth[0] = 0
        while queue and depth[end] < 0:
            a = queue.popleft()
            for e in arcs[a]:
                if room[e] and depth[head[e]] < 0:
                    depth[head[e]] = depth[a] + 1
                    queue.append(head[e])
        if depth[end] < 0:
            return False
        at, path = [0] * (end + 1), []
        while True:
            a = head[path[-1]] if path else 0
            if a == end:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                path = path[: next(k for k, e in enumerate(path) if not room[e])]
                continue
            while at[a] < len(arcs[a]) and not (room[e := arcs[a][at[a]]] and depth[head[e]] == depth[a] + 1):
                at[a] += 1
            if at[a] < len(arcs[a]):
                path.append(arcs[a][at[a]])
            elif path:
                at[head[path.pop() ^ 1]] += 1
            else:
                return True

    for _ in range(repeats):
        for k, (_, words) in enumerate(patterns):
            room[2 * k] += words
        while blocking():
            pass
    return {(k, s): room[e ^ 1] for k, s, e in links if room[e ^ 1]}


def draw(id_col: Column, text: Column, seed: int) -> Column:
    """Seeded draw of a row, 0 to 2^62; wholly equal (id, text) rows share it."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col, text), 2)


def _ranked(sources: DataFrame) -> DataFrame:
    """source, size: with rank, from 0, by code point and null last; the ranks of a sorted table's partitions are joined up."""
    placed = stored(sources.orderBy(F.col("source").isNull(), "source").withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).count().collect())  # one row for each partition
    before, upto = [], 0
    for p, n in sizes:
        before.append((p, upto))
        upto += n
    if not before:
        return placed.withColumn("rank", F.lit(0).cast("long"))
    offset = F.broadcast(sources.sparkSession.createDataFrame(before, "part long, before long"))
    within = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(offset, part == F.col("part")).select("source", "size", (F.col("before") + within).alias("rank"))


def _targets(sizes: DataFrame, weights: tuple[int, ...], total: float, most: float) -> DataFrame:
    """source, size: with target. `total` is split by weight; no target is above most x size, and what is over is split
    again by weight. A round is one aggregate over the sources; only its two sums come to the driver."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    ranked = stored(_ranked(sizes).withColumn("weight", weight))
    limit, full = most * F.col("size"), 0
    share = total / (ranked.agg(F.sum("weight")).first()[0] or 1.0)
    while True:
        over = F.col("weight") * share > limit
        r = ranked.agg(F.sum(F.when(~over, F.col("weight"))).alias("w"), F.sum(F.when(over, limit)).alias("taken"), F.count_if(over).alias("n")).first()
        if r["n"] == full or not r["w"]:
            break
        full, share = r["n"], (total - r["taken"]) / r["w"]
    return ranked.select("source", "size", F.least(F.col("weight") * share, limit).alias("target"))


def _cut(rows: DataFrame, budgets: DataFrame, some) -> DataFrame:
    """rows: sources, size, u; budgets: sources, part. Returns sources, cut and gap: rows whose draw is below cut have no more
    than `part` words, and gap is what is still open (less than the size of the next row, where there is one)."""
    width = (1 << 62) // BUCKETS
    bucket = F.floor(F.col("u") / width).cast("int").alias("bucket")
    hist = rows.groupBy("sources", bucket).agg(F.sum("size").alias("size"))
    run = F.sum("size").over(Window.partitionBy("sources").orderBy("bucket"))  # at most BUCKETS rows of a pattern
    same = lambda a, b: F.col(f"{a}.sources").eqNullSafe(F.col(f"{b}.sources"))
    placed = hist.withColumn("before", run - F.col("size")).alias("h").join(some(budgets).alias("p"), same("h", "p"))
    at = placed.filter("before <= part and before + h.size > part").select("h.sources", "bucket", "before", "part")
    # within the bucket where the budget ends, rows are taken in the order of their draws while they fit
    near = rows.withColumn("bucket", bucket).alias("w").join(some(at).alias("c"), same("w", "c") & (F.col("w.bucket") == F.col("c.bucket")))
    sums = near.groupBy(F.col("w.sources").alias("sources"), "u", "before", "part").agg(F.sum("size").alias("size"))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("sources").orderBy("u"))
    fits = F.col("upto") <= F.col("part")
    cut = sums.withColumn("upto", upto).groupBy("sources").agg(
        F.coalesce(F.min(F.when(~fits, F.col("u"))), F.max("u") + 1).alias("cut"),
        (F.max("part") - F.coalesce(F.max(F.when(fits, F.col("upto"))), F.max("before"))).alias("gap"),
    )
    # a budget beyond all rows takes them all
    whole = placed.groupBy("h.sources").agg(F.max(F.col("before") + F.col("h.size")).alias("all"), F.max("part").alias("part")).filter("all <= part")
    return cut.unionByName(whole.select("sources", F.lit(1 << 62).alias("cut"), (F.col("part") - F.col("all")).alias("gap")))


def plan(words: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """words: sources array<string>, size, u. One row per pattern: sources, whole uses, cuts (an array of struct<cut, gap>: see
    `_more`), source_size and target (of a pattern with one source)."""
    spark = words.sparkSession
    totals = stored(words.groupBy("sources").agg(F.sum("size").alias("size")))
    source = totals.select(F.explode("sources").alias("source"), "size")
    sizes = source.groupBy("source").agg(F.sum("size").alias("size"))
    total = totals.agg(F.sum("size")).first()[0] or 0
    targets = stored(_targets(sizes, weights, share * total, repeats))
    own = totals.filter(F.size("sources") == 1).withColumn("source", F.get("sources", F.lit(0)))
    t = targets.withColumnRenamed("size", "source_size").alias("t")
    own = own.join(t, own["source"].eqNullSafe(F.col("t.source"))).select("sources", "size", "t.source", "source_size", "target")
    mixed = totals.filter(F.size("sources") > 1)
    shared = mixed.select(F.explode("sources").alias("shared")).distinct()
    if not mixed.isEmpty():
        # the flow of sources that share words with others
        tied = own.join(shared, own["source"].eqNullSafe(F.col("shared")), "left_semi")
        rows = mixed.select("sources", "size").unionByName(tied.select("sources", "size")).limit(MAX_PATTERNS + 1).collect()
        if len(rows) > MAX_PATTERNS:
            raise ValueError(f"more than {MAX_PATTERNS} membership patterns of overlapping sources")
        rows = sorted(rows, key=lambda r: [(s is None, s or "") for s in r["sources"]])
        quotas = {r["source"]: r["target"] for r in targets.join(shared, targets["source"].eqNullSafe(F.col("shared")), "left_semi").orderBy("source").collect()}
        flow = route([(tuple(r["sources"]), r["size"]) for r in rows], quotas, repeats)
        used = [0] * len(rows)
        for (k, _), v in flow.items():
            used[k] += v
        routed = spark.createDataFrame([(r["sources"], r["size"], u) for r, u in zip(rows, used)], "sources array<string>, size long, used long")
        about = own.select(F.col("sources").alias("__s"), "source_size", "target")
        routed = routed.join(about, routed["sources"].eqNullSafe(F.col("__s")), "left").drop("__s")
        own = own.join(shared, own["source"].eqNullSafe(F.col("shared")), "left_anti")
    closed = own.select("sources", "size", F.least(F.round("target").cast("long"), F.col("size") * repeats).alias("used"), "source_size", "target")
    uses = closed if mixed.isEmpty() else closed.unionByName(routed)
    whole = F.when(F.col("size") > 0, F.least(F.floor(F.col("used") / F.col("size")), F.lit(repeats))).otherwise(0).cast("int")
    uses = stored(uses.select("sources", whole.alias("whole"), (F.col("used") - whole * F.col("size")).alias("part"), "source_size", "target"))
    some = _small(uses)
    same = lambda a, b: F.col(f"{a}.sources").eqNullSafe(F.col(f"{b}.sources"))
    rest, budgets, cuts = words, uses.filter("part > 0").select("sources", "part"), uses.select("sources", F.array().cast("array<struct<cut:long,gap:long>>").alias("cuts"))
    for _ in range(CUTS):
        cut = stored(_cut(rest, budgets, some))
        cuts = cuts.alias("a").join(some(cut).alias("b"), same("a", "b"), "left")
        cuts = cuts.select("a.sources", F.when(F.col("cut").isNull(), F.col("cuts")).otherwise(F.array_append("cuts", F.struct("cut", "gap"))).alias("cuts"))
        rest = rest.alias("w").join(some(cut).alias("c"), same("w", "c")).filter("u >= cut and w.size <= gap and w.size > 0").select("w.sources", "w.size", "w.u")
        budgets = cut.filter("gap > 0").select("sources", F.col("gap").alias("part"))
    return stored(uses.alias("u").join(some(cuts).alias("c"), same("u", "c")).select("u.sources", "whole", "cuts", "source_size", "target"))


def _small(table: DataFrame):
    """broadcast for tables of one row a pattern, if there are few patterns; else nothing."""
    few = table.limit(BROADCAST + 1).count() <= BROADCAST
    return F.broadcast if few else lambda x: x


def _more(u: Column, size: Column, cuts: Column) -> Column:
    """1 where a row is used once more than the whole uses of its pattern: its draw is below the first cut, or, of the rows
    that fit what the cuts before left open, below a later one."""
    none = F.struct(F.lit(False).alias("hit"), F.lit((1 << 62) - 1).cast("long").alias("fits"))

    def step(state: Column, c: Column) -> Column:
        hit = state["hit"] | ((u < c["cut"]) & (size <= state["fits"]))
        return F.struct(hit.alias("hit"), F.least(state["fits"], c["gap"]).alias("fits"))

    return F.aggregate(cuts, none, step)["hit"].cast("int")


def uses_of(words: DataFrame, plan_: DataFrame) -> DataFrame:
    """Adds whole uses of each row: `uses`, and source_size and target of its pattern."""
    hit = words["sources"].eqNullSafe(plan_["sources"])
    joined = words.join(_small(plan_)(plan_), hit)
    uses = F.col("whole") + _more(words["u"], words["size"], F.col("cuts"))
    return joined.select(*[words[c] for c in words.columns], uses.alias("uses"), "source_size", "target")


def mix_report(
    df: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """doc_id, size (words), source_size, target (words of its source) and taken (words the mix takes, repeats counted).

    Null text: size 0, never taken. A null source is a source of its own, the last one. Reruns agree; rows equal in id
    and text share a draw. An empty table gives an empty result.
    """
    id_, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    words = stored(
        df.select(
            id_.alias("doc_id"), F.array(F.col(f"`{source_col}`").cast("string")).alias("sources"),
            n_words(text).alias("size"), draw(id_, text, seed).alias("u"),
        )
    )
    used = uses_of(words, plan(words, weights, share, repeats))
    return used.select("doc_id", "size", "source_size", "target", (F.col("uses") * F.col("size")).cast("long").alias("taken"))


def mix(
    df: DataFrame, sources: Column, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The mixed table: rows of df, each as often as it is taken. sources: array<string> of the row's sources."""
    id_, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    words = df.select(F.array_sort(F.array_distinct(sources)).alias("sources"), n_words(text).alias("size"), draw(id_, text, seed).alias("u"))
    plan_ = plan(stored(words), weights, share, repeats)
    keyed = df.withColumns({"__s": F.array_sort(F.array_distinct(sources)), "__u": draw(id_, text, seed), "__size": n_words(text)})
    p = _small(plan_)(plan_.select(*[F.col(c).alias(f"__{c}") for c in ("sources", "whole", "cuts")]))
    taken = keyed.join(p, F.col("__s").eqNullSafe(F.col("__sources")))
    uses = F.col("__whole") + _more(F.col("__u"), F.col("__size"), F.col("__cuts"))
    again = taken.filter(uses > 0).withColumn("__k", F.explode(F.sequence(F.lit(1), uses)))
    return again.select(*[F.col(f"`{c}`") for c in df.columns])
