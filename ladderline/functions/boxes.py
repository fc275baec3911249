"""Elements of pages as intervals, and which of them contain others, in built-in expressions: no tree is built.

A page is cut at its tags; a running sum of lengths places each tag, a running sum of openings and closings of a kind of tag gives its level, and at one
level of a kind an opening tag is followed by its closing tag. An element lies in another if it begins before the furthest end
that an earlier one has reached. Windows are by page, whose tags are as many as the page holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What holds no tags although it may look so.
OPAQUE = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
_TAG = "^/?([a-zA-Z][a-zA-Z0-9]*)"


def elements(pages: DataFrame, key: str, html: str, names: Sequence[str]) -> DataFrame:
    """key, name, css_class, start and end (characters of the page without comments, scripts and styles, end exclusive) of every element of these kinds.

    An element that is not closed reaches to the page's end; a closing tag without an opening one is left out. A null page has no elements.
    """
    page = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), OPAQUE, "")
    # size and pieces come before the rows are made, as what stands beside a generator is computed again for each of its rows
    cleared = pages.select(key, F.length(page).alias("_size"), F.split(page, "<").alias("_pieces"))
    rows = cleared.select(key, "_size", F.posexplode("_pieces").alias("_at", "_piece"))
    before = Window.partitionBy(key).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("_piece")).over(before), F.lit(0)) + F.col("_at") - 1).withColumn("name", F.lower(F.regexp_extract("_piece", _TAG, 1)))
    rows = rows.where((F.col("_at") > 0) & F.col("name").isin(*names)).withColumn("_closes", F.startswith("_piece", F.lit("/")))
    of_kind = Window.partitionBy(key, "name").orderBy("_at")
    depth = F.sum(F.when(F.col("_closes"), -1).otherwise(1)).over(of_kind)
    rows = rows.withColumn("_level", depth + F.col("_closes").cast("int"))
    at_level = Window.partitionBy(key, "name", "_level").orderBy("_at")
    after = F.col("start") + F.instr("_piece", ">") + 1
    closed_at = F.lead(F.when(F.col("_closes"), after)).over(at_level)
    rows = rows.withColumn("end", F.coalesce(closed_at, F.col("_size"))).where(~F.col("_closes"))
    css_class = F.regexp_extract("_piece", r"""^[^>]*?\sclass\s*=\s*["']([^"'>]*)["']""", 1)
    return rows.select(key, "name", css_class.alias("css_class"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def with_containment(found: DataFrame, key: str, within: Column, name: str) -> DataFrame:
    """Adds a column that is true where no earlier element of the same page and group contains the element."""
    earlier = Window.partitionBy(key, within).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn(name, F.col("start") >= F.coalesce(F.max("end").over(earlier), F.lit(0)))


def outermost(found: DataFrame, key: str) -> DataFrame:
    """The elements with of_kind (in none of its own kind) and outer (in none of any of the kinds)."""
    return with_containment(with_containment(found, key, F.col("name"), "of_kind"), key, F.lit(0), "outer")
