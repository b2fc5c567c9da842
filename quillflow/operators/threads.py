"""Threads: replies as trees, from indents or from parents, and what a message quotes of earlier ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Indents beyond this count as it: no page shows more.
DEEPEST = 64


def with_parents(items: DataFrame, thread: str, pos: str, indent: str) -> DataFrame:
    """Adds `parent_pos`: the position of the last item before that is indented less, null where there is none.

    An item asks each level above its own for the last item there, so no thread is ever held: indents are bounded. Null
    indents count as 0, items without a position have no parent and are none.
    """
    level = F.least(F.greatest(F.coalesce(F.col(indent), F.lit(0)), F.lit(0)), F.lit(DEEPEST)).cast("int")
    own = items.select(F.col(thread).alias("_t"), F.col(pos).cast("long").alias("_p"), level.alias("_d")).filter("_p is not null").distinct()
    says = own.select("_t", F.col("_d").alias("_level"), "_p", F.lit(True).alias("_stands"), F.col("_p").alias("_last"))
    asks = own.filter("_d > 0").select("_t", F.explode(F.sequence(F.lit(0), F.col("_d") - 1)).alias("_level"), "_p", F.lit(False).alias("_stands"), F.lit(None).cast("long").alias("_last"))
    before = Window.partitionBy("_t", "_level").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    met = says.unionByName(asks).withColumn("_at", F.max("_last").over(before)).filter("not _stands and _at < _p")
    found = met.groupBy("_t", "_p").agg(F.max("_at").alias("parent_pos"))
    joined = items.join(found, F.col(thread).eqNullSafe(F.col("_t")) & (F.col(pos) == F.col("_p")), "left")
    return joined.drop("_t", "_p")


def trees(items: DataFrame, thread: str, pos: str, parent: str) -> DataFrame:
    """Adds depth (0 for what answers nothing), root (position of the tree's first item), number (from 1, depth first: every
    item before its answers, answers of an item in their order) and n_below (all that answer it, directly or not).

    A parent that is missing, or does not come before, is none, so there are no cycles. Ancestors are found by doubling: a
    round joins what is known of an item with what is known of its farthest known ancestor, so a chain of a thousand replies
    takes ten rounds. Items that share a position are one place in the tree.
    """
    t, p, up = F.col(thread), F.col(pos).cast("long"), F.col(parent).cast("long")
    own = items.select(t.alias("_t"), p.alias("_p"), F.when(up < p, up).alias("_up")).filter("_p is not null").groupBy("_t", "_p").agg(F.min("_up").alias("_up"))
    known = own.select(F.col("_t").alias("_kt"), F.col("_p").alias("_kp"))
    own = own.join(known, F.col("_t").eqNullSafe(F.col("_kt")) & (F.col("_up") == F.col("_kp")), "left").select("_t", "_p", F.col("_kp").alias("_up"))
    paths = own.withColumn("_path", F.array("_p"))
    while not paths.filter("_up is not null").isEmpty():
        above = paths.select(F.col("_t").alias("_at"), F.col("_p").alias("_ap"), F.col("_up").alias("_aup"), F.col("_path").alias("_apath"))
        met = paths.join(above, F.col("_t").eqNullSafe(F.col("_at")) & (F.col("_up") == F.col("_ap")), "left")
        paths = met.select("_t", "_p", F.col("_aup").alias("_up"), F.when(F.col("_ap").isNull(), F.col("_path")).otherwise(F.concat("_apath", "_path")).alias("_path"))
        paths = _cut(paths)
    order = F.row_number().over(Window.partitionBy("_t").orderBy("_path")).cast("int")
    below = paths.select("_t", F.explode(F.slice("_path", 1, F.size("_path") - 1)).alias("_p")).groupBy("_t", "_p").agg(F.count("*").alias("n_below"))
    placed = paths.select("_t", "_p", (F.size("_path") - 1).alias("depth"), F.element_at("_path", 1).alias("root"), order.alias("number"))
    below = below.select(F.col("_t").alias("_bt"), F.col("_p").alias("_bp"), "n_below")
    placed = placed.join(below, F.col("_t").eqNullSafe(F.col("_bt")) & (F.col("_p") == F.col("_bp")), "left").drop("_bt", "_bp").withColumn("n_below", F.coalesce("n_below", F.lit(0)))
    return items.join(placed, t.eqNullSafe(F.col("_t")) & (p == F.col("_p")), "left").drop("_t", "_p")


def _cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut, where the session has a folder for checkpoints."""
    sc = df.sparkSession.sparkContext
    where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if where and sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return df.checkpoint() if where else df


def quoted(text: Column, depth: Column, body: Column | None = None) -> Column:
    """A reply as nested quotation of Markdown, one mark for every level above it."""
    return F.when(depth > 0, F.regexp_replace(text, "(?m)^", F.concat(F.repeat(F.lit("> "), depth)))).otherwise(text)


# How clients open what they quote.
_WROTE = "^(?:(?:On|Le|El) [^\\n]{4,120}(?:wrote|a écrit|escribió)\\s*:?|Am [^\\n]{4,120}schrieb[^\\n]{0,80}:)\\s*$"
_HEADER = "^(?:-{3,} ?(?:Original Message|Forwarded message) ?-{3,}|_{10,})\\s*$"


def without_history(text: Column) -> Column:
    """A plain-text message without the history at its end: an attribution or a client's header line and all below it, or a
    tail of `>` lines. Quotes that the message answers below stay, and so does a message that is all quotation."""
    lines = F.split(F.regexp_replace(text, "\\r\\n?", "\n"), "\n")
    opens = lambda x: F.trim(x).rlike(_WROTE) | F.trim(x).rlike(_HEADER)
    quote = lambda x: x.rlike("^\\s*>") | (F.trim(x) == "")
    size = F.size(lines)
    # the first line from which on everything is an opening, a quote or blank; a header line opens whatever follows
    tail = F.aggregate(F.reverse(lines), F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"), F.lit(0).alias("quotes")), lambda s, x: F.struct(
        F.when(s["open"] & (quote(x) | opens(x)), s["n"] + 1).otherwise(s["n"]).alias("n"), (s["open"] & (quote(x) | opens(x))).alias("open"),
        F.when(s["open"] & (x.rlike("^\\s*>") | opens(x)), s["quotes"] + 1).otherwise(s["quotes"]).alias("quotes"),
    ))
    header = F.array_position(F.transform(lines, lambda x: F.trim(x).rlike(_HEADER)), True).cast("int")
    keep = F.least(F.when(tail["quotes"] > 0, size - tail["n"]).otherwise(size), F.when(header > 0, header - 1).otherwise(size))
    kept = F.rtrim(F.regexp_replace(F.array_join(F.slice(lines, 1, F.greatest(keep, F.lit(0))), "\n"), "\\s+$", ""))
    return F.when(F.trim(kept) == "", text).otherwise(kept)
