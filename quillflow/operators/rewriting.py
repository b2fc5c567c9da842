"""Rewriting what documents refer to: files that moved, visible asset folders, page markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import targets as G

#: Mappings of at most so many rows are broadcast.
FEW = 200_000
FORMS = ("inline", "definition", "wiki", "attribute", "srcset", "css")


def rewritten(docs: DataFrame, key: str, text: str, moved: DataFrame) -> DataFrame:
    """docs with `text` naming the new paths: moved has target and path, and `key` as well if it holds for one document only.

    Targets are compared decoded, without query and fragment, which stay; all forms of Markdown and HTML are followed, code
    never. Null texts stay null, documents without a known target as they are; of several paths of a target the least counts.
    Documents that share a key must be told apart by it: a key is one row.
    """
    by = [c for c in (key, "target") if c in moved.columns]
    once = moved.groupBy(*by).agg(F.min("path").alias("_path"))
    parts = docs.select(key, F.posexplode(G.tokens_of(F.col(text))).alias("_pos", "_t"))
    named = parts.withColumn("target", F.when(F.col("_t.form").isin(*FORMS), G.path_of(F.col("_t.form"), F.col("_t.text"))))
    if once.limit(FEW + 1).count() <= FEW:
        once = F.broadcast(once)
    found = named.join(once, by, "left")
    new = F.when(F.col("_path").isNull(), F.col("_t.text")).otherwise(G.written(F.col("_t.form"), F.col("_t.text"), F.col("_path")))
    whole = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", new.alias("text")))).alias("_parts"))
    out = docs.join(whole.select(F.col(key).alias("_key"), G.joined(F.col("_parts")).alias("_new")), F.col(key).eqNullSafe(F.col("_key")), "left")
    return out.withColumn(text, F.when(F.col(text).isNotNull(), F.coalesce("_new", text))).drop("_key", "_new")


def _each(text: Column, change) -> Column:
    """The text with its tokens changed; texts without any are left as they are."""
    return G.joined(F.transform(G.tokens_of(text), lambda t: F.struct(change(t["form"], t["text"]).alias("text"))))


_PAGE = "^<!-- (?:Page|Slide) number: ([0-9]+) -->$"


def without_page_markers(text: Column) -> Column:
    """Without page comments and the line ends behind them; those in code stay."""
    gone = "\u001a"
    out = _each(text, lambda form, t: F.when((form == "comment") & t.rlike(_PAGE), gone).otherwise(F.replace(t, F.lit(gone), F.lit(""))))
    return F.replace(F.regexp_replace(out, f"(?m)^{gone}\\n*", ""), F.lit(gone), F.lit(""))


def rag_markers(text: Column) -> Column:
    """Page comments in the spelling that chunkers keep as provenance, and assets below a visible folder."""
    return _each(text, lambda form, t: F.when(form == "comment", F.regexp_replace(t, "^<!-- Page number: ([0-9]+) -->$", "<!-- page: $1 -->")).otherwise(_visible(form, t)))


def _visible(form: Column, target: Column) -> Column:
    return F.when(form.isin(*FORMS), F.regexp_replace(target, "^(<?(?:\\./)?)\\.[a-z]+/assets/", "$1assets/")).otherwise(target)


def obsidian_images(text: Column) -> Column:
    """Images of the visible asset folder as `![[assets/name]]`, but in code and where the name would not read as one."""
    shown = _each(text, lambda form, t: F.when(form == "inline", F.concat(F.lit("\u001a"), _visible(form, t), F.lit("\u001a"))).otherwise(_visible(form, F.replace(t, F.lit("\u001a"), F.lit("")))))
    wiki = F.regexp_replace(shown, "!\\[[^\\]\\n]*\\]\\(\u001a(assets/[^)\\s\u001a\\[\\]|#^%]+)\u001a\\)", "![[$1]]")
    return F.replace(wiki, F.lit("\u001a"), F.lit(""))
