"""Label text as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import NON_MEME, REJECT_TOKENS, TEMPLATE_FREE, TEMPLATED

# Spellings that mean the two special classes, as keys.
NON_MEME_KEYS = ["non_meme", "nonmeme", "not_meme", "not_a_meme", "no_meme"]
TEMPLATE_FREE_KEYS = ["templateless", "template_less", "template_free", "templatefree", "no_template", "non_templated", "not_templated", "untemplated"]
# What counts as no label at all, and as not available.
EMPTY_KEYS = ["", "none", "null", "nan"]
NOT_AVAILABLE = ["na", "n/a", "none", "nan", "null"]


def trimmed(c: Column) -> Column:
    """Text without white space of any kind at its ends: blanks, tabs, line ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def normal_key(c: Column, joint: str = "_") -> Column:
    """Trimmed, lower case, runs of other than a-z and 0-9 made one ``joint``, none at the ends; null: empty."""
    low = F.lower(trimmed(F.coalesce(c, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", joint), f"^{joint}+|{joint}+$", "")


def slug(c: Column) -> Column:
    return normal_key(c, "-")


def lenient_key(c: Column) -> Column:
    return normal_key(c, " ")


def canonical_label(labels: DataFrame, column: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """``canonical``: one of the special classes by its aliases, else the vocabulary's spelling, else the trimmed text.

    vocabulary: (name); where several names have one key, the first in order.
    """
    key = normal_key(F.col(column))
    out = labels.withColumn("__key", key)
    if vocabulary is not None:
        names = vocabulary.groupBy(normal_key(F.col("name")).alias("__key")).agg(F.min("name").alias("__name"))
        out = out.join(names, "__key", "left")
    else:
        out = out.withColumn("__name", F.lit(None).cast("string"))
    text = trimmed(F.coalesce(F.col(column), F.lit("")))
    value = F.when(F.col("__key").isin(NON_MEME_KEYS), NON_MEME).when(F.col("__key").isin(TEMPLATE_FREE_KEYS), TEMPLATE_FREE).otherwise(F.coalesce("__name", text))
    return out.withColumn("canonical", value).drop("__key", "__name")


def label_kind(c: Column) -> Column:
    """NON_MEME, TEMPLATELESS (empty words too) or TEMPLATE."""
    key = normal_key(c)
    return F.when(key.isin(NON_MEME_KEYS), "NON_MEME").when(key.isin(TEMPLATE_FREE_KEYS + EMPTY_KEYS), "TEMPLATELESS").otherwise("TEMPLATE")


def coarse(c: Column) -> Column:
    return F.when(c.isin(NON_MEME, TEMPLATE_FREE), c).otherwise(TEMPLATED)


def map_rejects(c: Column, to: str = TEMPLATE_FREE) -> Column:
    return F.when(c.isin(REJECT_TOKENS), to).otherwise(c)


def clean(c: Column) -> Column:
    """Trimmed text; null where empty or a word for not available."""
    t = trimmed(c)
    return F.when(F.lower(t).isin(NOT_AVAILABLE) | (t == ""), None).otherwise(t)


def to_float(c: Column) -> Column:
    return clean(c).try_cast("double")


def lenient_lookup(names: DataFrame, column: str) -> DataFrame:
    """(key, name) of lenient keys that belong to one name only."""
    return names.groupBy(lenient_key(F.col(column)).alias("key")).agg(F.count_distinct(column).alias("n"), F.min(column).alias("name")).filter("n = 1").drop("n")


def label_index(rows: DataFrame, column: str = "template") -> DataFrame:
    """(label, label_idx): distinct labels in order, from 0. One partition ranks the labels, of which there are few."""
    from pyspark.sql import Window

    return rows.select(F.col(column).alias("label")).distinct().withColumn("label_idx", F.dense_rank().over(Window.orderBy("label")) - 1)
