"""Paginated provider responses (A1): landed rows (request_id, page_no, page text).

Every page must be a JSON array; its items are flattened in page then item order.
An empty response has no rows. A page that is not an array is an error naming its
1-based page number. ``from_json(obj, array<struct>)`` would silently wrap an object
into a one-element array, so the shape is tested on the VARIANT first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_pages(pages: DataFrame, item_schema: T.StructType, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Returns (items(request_id, page_no, item_pos, <item fields>), rejects)."""
    v = F.try_parse_json(F.col("page"))
    is_array = F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    staged = pages.select("request_id", "page_no", v.alias("_v"), is_array.alias("_ok"))
    rejects = staged.where(~F.col("_ok")).select(
        "request_id", "page_no",
        F.concat(F.lit("paginated response page "), F.col("page_no").cast("string"),
                 F.lit(" was not a JSON array")).alias("reason"))
    if strict:
        bad = rejects.orderBy("request_id", "page_no").limit(1).collect()
        if bad:
            raise ValueError(bad[0]["reason"])
    items = staged.where(F.col("_ok")).select(
        "request_id", "page_no",
        F.posexplode(F.try_variant_get("_v", "$", "array<variant>")).alias("item_pos", "_item"))
    typed = items.select("request_id", "page_no", F.col("item_pos").cast("long").alias("item_pos"),
                         *[F.try_variant_get("_item", f"$.{f.name}", f.dataType.simpleString()).alias(f.name)
                           for f in item_schema.fields])
    return typed, rejects
