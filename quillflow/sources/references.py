"""References of a document to what it holds elsewhere: notes and assets.

A reader writes a reference to a note as a mark (`mark`) with what to show if nothing is found, the blocks of a definition as
kind `note` (`note_text`), an image by its part's name as `(cid:name)`, and a part as kind `asset` (`name U+001F file name`).
Here the two sides meet, with windows over the document: references with a readable definition become `[^n]`, numbered in
the order of the definitions, and these go to the end; all others stay where and what they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

OPEN, SPLIT, CLOSE = "\x0e", "\x10", "\x0f"
MARK = f"{OPEN}([^{SPLIT}{CLOSE}]*){SPLIT}([^{SPLIT}{CLOSE}]*){SPLIT}([^{CLOSE}]*){CLOSE}"
LAST = 1 << 30  # position of the first definition
OUTSIDE = -1  # level of a definition that stands outside the article: it goes where nothing refers to it


def mark(name: str, label: str, otherwise: str) -> str:
    """A reference to the note `name`; label is what the page shows, otherwise its Markdown if there is no such note."""
    clean = lambda x: x.replace(OPEN, "").replace(SPLIT, "").replace(CLOSE, "")
    return f"{OPEN}{clean(name)}{SPLIT}{clean(label)}{SPLIT}{clean(otherwise)}{CLOSE}"


def note_text(name: str, kind: str, level: int, text: str) -> str:
    return f"{name}\x1f{kind}\x1f{level}\x1f{text}"


def _let(value: Column, f) -> Column:
    """f(value), the value worked out once: an expression that names another several times would hold it as often."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _marks(text: Column, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(MARK), F.lit(group))


def _written(text: Column, ids: Column) -> Column:
    """The text with its marks as `[^n]`, n the place in ids, or as what they are otherwise."""
    bare = F.regexp_replace(text, f"\\[({OPEN}[^{CLOSE}]*{CLOSE})\\]", "$1")
    place = lambda m: F.array_position(ids, F.regexp_extract(m, MARK, 1))
    new = lambda m: F.when(place(m) > 0, F.concat(F.lit("[^"), place(m), F.lit("]"))).otherwise(F.regexp_extract(m, MARK, 3))
    done = F.aggregate(F.array_distinct(F.regexp_extract_all(text, F.lit(MARK), F.lit(0))), bare, lambda t, m: F.replace(t, m, new(m)))
    return F.when(F.contains(text, F.lit(OPEN)), done).otherwise(text)


def _assets(text: Column, assets: Column) -> Column:
    """The text with `(cid:name)` as the asset's file below assets/; images without one leave their label."""
    name = lambda m: F.regexp_extract(m, "\\(cid:([^)\\s]*)\\)", 1)
    new = lambda m: F.when(F.map_contains_key(assets, name(m)), F.concat(F.regexp_extract(m, "^(!\\[[^\\]]*\\]\\()", 1), F.lit("assets/"), F.try_element_at(assets, name(m)), F.lit(")"))).otherwise(
        F.regexp_extract(m, "^!\\[([^\\]]*)\\]", 1)
    )
    images = F.array_distinct(F.regexp_extract_all(text, F.lit("(!\\[[^\\]]*\\]\\(cid:[^)\\s]*\\))"), F.lit(1)))
    return F.when(F.contains(text, F.lit("(cid:")), F.aggregate(images, text, lambda t, m: F.replace(t, m, new(m)))).otherwise(text)


def resolved(blocks: DataFrame, markdown_of) -> DataFrame:
    """Blocks with all references resolved: key, pos, kind, level, text. markdown_of(kind, level, text) writes a block.

    Repeated references share a definition; of several definitions of a name all blocks belong to the first. A definition
    without a letter or digit is none. Its first block follows `[^n]: `, without the number that its references show; further
    ones are indented. References within definitions are not followed: they show what they are otherwise."""
    page = Window.partitionBy("key")
    note = F.col("kind") == "note"
    parts = F.split("text", "\x1f", 4)
    b = blocks.withColumn("_part", F.when(note, F.struct(parts[0].alias("name"), parts[1].alias("kind"), parts[2].try_cast("int").alias("level"), parts[3].alias("body"))))
    readable = F.regexp_replace("_part.body", MARK, "").rlike("[\\p{L}\\p{N}]")
    # what the document defines, what it asks for, and its assets: empty for most
    asset = F.split("text", "\x1f", 2)
    asks = F.when(~note & F.contains("text", F.lit(OPEN)), F.arrays_zip(_marks(F.col("text"), 1).alias("name"), _marks(F.col("text"), 2).alias("label")))
    b = b.withColumns({
        "_notes": F.collect_list(F.when(note, F.struct("pos", "_part", readable.alias("readable")))).over(page), "_asked": F.collect_list(asks).over(page),
        "_assets": F.collect_list(F.when(F.col("kind") == "asset", F.struct(asset[0].alias("k"), asset[1].alias("v")))).over(page),
    })
    b = b.withColumn("_asked", F.flatten("_asked"))
    some = (F.size("_notes") > 0) & (F.size("_asked") > 0)
    names = F.array_distinct(F.transform(F.filter(F.array_sort("_notes"), lambda n: n["readable"]), lambda n: n["_part"]["name"]))
    once = F.aggregate("_assets", F.slice("_assets", 1, 0), lambda out, x: F.when(F.exists(out, lambda o: o["k"] == x["k"]), out).otherwise(F.concat(out, F.array(x))))
    b = b.withColumns({
        "_ids": F.when(some, F.filter(names, lambda n: F.exists("_asked", lambda a: a["name"] == n))).otherwise(F.array().cast("array<string>")), "_files": F.map_from_entries(once),
    }).drop("_assets")
    b = b.withColumn("_place", F.when(note & some, F.array_position("_ids", F.col("_part.name"))).otherwise(0))
    found = F.col("_place") > 0
    own = F.array_sort(F.filter("_notes", lambda n: n["_part"]["name"] == F.col("_part.name")))
    labels = F.transform(F.filter("_asked", lambda a: a["name"] == F.col("_part.name")), lambda a: F.regexp_replace(a["label"], "[^\\p{L}\\p{N}*†‡§]", ""))
    b = b.withColumns({"_own": F.when(found, own), "_labels": F.when(found, labels)}).drop("_notes", "_asked")
    b = b.filter(~(found & (F.col("pos") != F.get("_own", F.lit(0))["pos"])) & ~(note & ~found & (F.col("level") == OUTSIDE)) & (F.col("kind") != "asset"))
    none, numbered = F.array().cast("array<string>"), "^\\*{0,2}[\\[(]?([\\p{L}\\p{N}*†‡§]{1,8}?)[\\])]?[.:]?\\*{0,2}[\\])]?\\s+"
    listed = lambda kind: kind.isin("ordered", "item")
    # a definition's first block without the number that its references show, then the others
    bare = lambda head: F.when(head["kind"] == "ordered", F.regexp_replace(head["body"], "^-?[0-9]+\\. ", "")).otherwise(head["body"])
    lead = lambda text: F.when(F.array_contains("_labels", F.regexp_extract(text, numbered, 1)), F.regexp_replace(text, numbered, "")).otherwise(text)
    shown = lambda kind, level, text: _let(text, lambda t: F.when(listed(kind), t).otherwise(markdown_of(kind, level, t)))
    first = _let(F.get("_own", F.lit(0))["_part"], lambda head: shown(head["kind"], head["level"], _let(bare(head), lead)))
    more = F.transform(F.slice("_own", 2, F.greatest(F.size("_own") - 1, F.lit(0))), lambda n: markdown_of(n["_part"]["kind"], n["_part"]["level"], n["_part"]["body"]))
    # a mark within a definition is shown as what it is otherwise
    body = _let(F.array_join(F.concat(F.array(first), more), "\n\n"), lambda t: _written(t, none))
    written = F.regexp_replace(F.concat(F.lit("[^"), "_place", F.lit("]: "), body), "\n(?=[^\n])", "\n    ")
    text = F.when(found, written).when(note, _written(F.col("_part.body"), F.col("_ids"))).otherwise(_written(F.col("text"), F.col("_ids")))
    return b.select(
        "key", F.when(found, LAST + F.col("_place")).otherwise(F.col("pos")).cast("int").alias("pos"), F.when(found, "definition").when(note, F.col("_part.kind")).otherwise(F.col("kind")).alias("kind"),
        F.when(found, 0).when(note, F.coalesce("_part.level", F.lit(0))).otherwise(F.col("level")).cast("int").alias("level"), _let(text, lambda t: _assets(t, F.col("_files"))).alias("text"),
    )
