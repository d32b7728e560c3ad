"""The library's functions by name in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from sitewarden.functions.html import decode_entities, inner_text
from sitewarden.functions.robots import decide, parse, product_token, select_group
from sitewarden.functions.sitemaps import SitemapLocations
from sitewarden.functions.urls import identity, resolve, without_parameters


def register(spark: SparkSession) -> list[str]:
    """Register scalar functions and table functions; gives their names."""
    scalars = {
        "url_identity": (identity, StringType()),
        "url_resolve": (resolve, StringType()),
        "url_without_parameters": (lambda u, names: without_parameters(u, names.split(",")), StringType()),
        "html_decode_entities": (decode_entities, StringType()),
        "html_inner_text": (inner_text, StringType()),
        "robots_allowed": (lambda body, agent, path: decide(select_group(parse(body), product_token(agent)), path)[0], BooleanType()),
    }
    for name, (function, kind) in scalars.items():
        spark.udf.register(name, F.udf(function, kind, useArrow=True))
    spark.udtf.register("sitemap_locations", SitemapLocations)
    return [*scalars, "sitemap_locations"]
