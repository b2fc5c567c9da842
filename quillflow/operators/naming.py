"""Names: collisions, conflict policies, and URL lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


_VERSION = "(?s)^(.*)\\.v([0-9]{1,9})$"


def unique_names(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Adds `unique_name`: the second and later rows of a name, letter case aside, get .v2, .v3 and so on, passing over what
    the table itself has as a name. One window numbers a name's rows, one counts the versions that are taken."""
    lower = F.lower(name)
    rows = df.withColumn("__base", lower).withColumn("__k", F.row_number().over(Window.partitionBy("__base").orderBy(*order)) - 1)
    # the j-th row to be renamed gets j + 1 and one more for every taken version before that: the i-th of them, t, counts if t - 1 - i < j
    own = df.select(lower.alias("n")).distinct()
    own = own.select(F.regexp_extract("n", _VERSION, 1).alias("__base"), F.nullif(F.regexp_extract("n", _VERSION, 2), F.lit("")).cast("int").alias("t"), "n")
    own = own.filter((F.col("t") > 1) & (F.col("n") == F.concat("__base", F.lit(".v"), F.col("t").cast("string"))))
    taken = own.select("__base", (F.col("t") - 1 - F.row_number().over(Window.partitionBy("__base").orderBy("t"))).alias("__k"), F.lit(1).alias("__taken"))
    both = rows.withColumn("__taken", F.lit(0)).unionByName(taken, allowMissingColumns=True)
    before = F.sum("__taken").over(Window.partitionBy("__base").orderBy("__k", "__taken").rowsBetween(Window.unboundedPreceding, 0))
    numbered = both.withColumn("__before", before).filter("__taken = 0")
    versioned = F.concat(F.col(name), F.lit(".v"), (F.col("__k") + 1 + F.col("__before")).cast("string"))
    return numbered.withColumn("unique_name", F.when(F.col("__k") > 0, versioned).otherwise(F.col(name))).select(*df.columns, "unique_name")


def plan_outputs(items: DataFrame, existing: DataFrame, name: str, policy: str) -> DataFrame:
    """Adds `action` (write, replace, skip) and `target` under a policy (rename, overwrite, skip) against existing names.

    existing: name. One left join by name in lower case; an existing name stands for itself and, if it ends in .vN, for a
    version of what is before that. rename takes the number after the last version.
    """
    if policy not in ("rename", "overwrite", "skip"):
        raise ValueError(policy)
    low = F.lower(F.col("name"))
    itself = existing.select(low.alias("__base"), F.lit(1).alias("version"), F.lit(True).alias("itself"))
    number = F.nullif(F.regexp_extract(low, _VERSION, 2), F.lit(""))
    version = existing.filter(number.isNotNull()).select(F.regexp_extract(low, _VERSION, 1).alias("__base"), number.cast("int").alias("version"), F.lit(False).alias("itself"))
    taken = itself.unionByName(version).groupBy("__base").agg(F.max("version").alias("__last"), F.max("itself").alias("__there"))
    joined = items.join(taken, F.lower(name) == F.col("__base"), "left")
    clash = F.coalesce("__there", F.lit(False))
    action = F.when(~clash | F.lit(policy == "rename"), "write").otherwise("replace" if policy == "overwrite" else "skip")
    versioned = F.concat(F.col(name), F.lit(".v"), (F.col("__last") + 1).cast("string"))
    target = F.when(clash & F.lit(policy == "rename"), versioned).otherwise(F.col(name))
    return joined.withColumns({"action": action, "target": target}).drop("__base", "__last", "__there")


def parse_url_list(df: DataFrame, list_id: str, text: str) -> DataFrame:
    """list_id, place, url, name of URL lists: lines `URL [name]`, or a JSON array of addresses and {url, output_name}.

    Comments, blank lines and JSON entries of another shape are passed over; quotes of names are trimmed.
    """
    body = F.trim(F.regexp_replace(text, "^\ufeff", ""))
    lists = df.select(F.col(list_id).alias("list_id"), body.alias("body"))
    json = F.col("body").startswith("[")
    lines = lists.filter(~json).select("list_id", F.posexplode(F.split("body", "\r?\n")).alias("pos", "raw"))
    lines = lines.withColumn("line", F.trim("raw")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    name = F.nullif(F.trim(F.regexp_replace(F.regexp_extract("line", "^\\S+\\s+(.*)$", 1), "^['\"]|['\"]$", "")), F.lit(""))
    plain = lines.select("list_id", (F.col("pos") + 1).alias("place"), F.regexp_extract("line", "^(\\S+)", 1).alias("url"), name.alias("name"))
    items = lists.filter(json).select("list_id", F.posexplode(F.from_json("body", "array<string>")).alias("pos", "item"))
    entry = F.from_json(F.when(F.col("item").startswith("{"), F.col("item")), "url string, output_name string")
    items = items.withColumn("e", entry).withColumn("url", F.coalesce("e.url", F.when(~F.col("item").startswith("{"), F.col("item"))))
    return plain.unionByName(items.filter("url is not null").select("list_id", (F.col("pos") + 1).alias("place"), "url", F.col("e.output_name").alias("name")))


def first_of_each(entries: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first entry of each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return entries.withColumn("__n", n).filter("__n = 1").drop("__n")
