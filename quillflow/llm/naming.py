"""Names of rows: an id alone does not tell rows without an id, or rows that share one, apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NAME = ["__no_id", "__id", "__text"]


def named(df: DataFrame, id_col: str, text_col: str) -> tuple[dict[str, Column], Column]:
    """Columns that name a row by its id and a hash of its text, in the order of preference, and the text."""
    id_, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    return dict(zip(NAME, (id_.isNull(), F.coalesce(id_, F.lit(0).cast("long")), F.xxhash64(text, text.isNull())))), F.coalesce(text, F.lit(""))


def first_rows(df: DataFrame, first: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of df that `first` names, one of those with the same name."""
    names, _ = named(df, id_col, text_col)
    return df.withColumns(names).join(first, NAME, "left_semi").dropDuplicates(NAME).drop(*NAME)
