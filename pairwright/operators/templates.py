"""Template lookups and keyword previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions import values as V
from pairwright.functions.prompts import fill
from pairwright.functions.text import as_column, join_keywords, slug_to_name
from pairwright.sources import catalog as C


def template_lookup_strict(requests: DataFrame, catalog: DataFrame, slug: str = "slug") -> DataFrame:
    """Requests with their template; an unknown slug drops the request."""
    return requests.join(catalog.withColumnRenamed("slug", slug), slug)


def template_lookup_fallback(
    requests: DataFrame, catalog: DataFrame, slug: str = "slug", brand: str = V.BRAND
) -> DataFrame:
    """Requests with their template, or the generic one named after the slug.

    Adds the page metadata: ``page_title``, ``page_description`` and
    ``page_keywords``; a generic page has no keywords.
    """
    found = catalog.withColumnRenamed("slug", slug).withColumn("known", F.lit(True))
    rows = requests.join(found, slug, "left").withColumn("known", F.coalesce("known", F.lit(False)))
    generic = dict(zip(C.CATALOG_SCHEMA.names, C.fallback_record(), strict=True))
    shown = slug_to_name(slug)
    rows = rows.withColumns(
        {
            "name": F.coalesce("name", shown),
            "title": F.coalesce("title", F.concat(F.lit(C.FALLBACK_TITLE), shown)),
            **{
                n: F.when(F.col("known"), F.col(n)).otherwise(
                    C.literal(generic[n], C.CATALOG_SCHEMA[n].dataType)
                )
                for n in ("subtitle", "keywords", "pro_tips", "template")
            },
        }
    )
    parts = {"title": F.col("title"), "slug": F.col(slug), "brand": F.lit(brand)}
    return rows.withColumns(
        {
            "page_title": F.when(F.col("known"), fill(C.PAGE_TITLE, **parts)).otherwise(
                fill(C.FALLBACK_PAGE_TITLE, **parts)
            ),
            "page_description": F.when(
                F.col("known"), fill(C.PAGE_DESCRIPTION, **parts)
            ).otherwise(fill(C.FALLBACK_PAGE_DESCRIPTION, **parts)),
            "page_keywords": F.when(F.col("known"), join_keywords("keywords")),
        }
    )


def nest(children: DataFrame, key: str, order: tuple[str, ...], value: Column, out: str) -> DataFrame:
    """(key, out): the children of each key as an ordered list, to become a field of their parent.

    Lists are packed by task before they meet, and each is as long as the record shows it.  Nesting what was
    nested before gives records of any depth.
    """
    item = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], value.alias("v"))
    packed = children.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("__p"))
    return packed.select(key, F.transform("__p", lambda x: x["v"]).alias(out))


def keyword_preview(keywords: Column | str, shown: int = 3) -> Column:
    """struct(preview, more): the first keywords, and ``+N`` for the rest if any."""
    k = as_column(keywords)
    return F.struct(
        F.slice(k, 1, shown).alias("preview"),
        F.when(F.size(k) > shown, F.concat(F.lit("+"), (F.size(k) - shown).cast("string"))).alias(
            "more"
        ),
    )
