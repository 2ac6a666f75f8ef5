"""Stored pages, JSON payloads and roster tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtura import schemas
from fixtura.operators.form import union_all
from fixtura.operators.ordered import keep_first

# Fixed value: profile links of the search pages.
PROFILE_LINK = r'(?s)<a\s[^>]*?href="[^"]*/profil/spieler/(\d+)[^"]*"[^>]*>(.*?)</a>'


def extract_links(pages: DataFrame, pattern: str = PROFILE_LINK) -> DataFrame:
    """(page_id, link, text): first occurrence per page and link that shows any text.

    ``pattern`` captures the link key and the anchor's inner HTML.
    """
    found = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("link"),
        F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("inner"),
    )
    text = F.regexp_replace(F.regexp_replace("_l.inner", "<[^>]*>", ""), r"^\s+|\s+$", "")
    links = (
        pages.select("page_id", F.posexplode(found).alias("pos", "_l"))
        .select("page_id", F.col("_l.link").alias("link"), text.alias("text"), "pos")
        .filter(F.col("text") != "")
    )
    return keep_first(links, ["page_id", "link"], ["pos"])


def value_points(payloads: DataFrame, entity: str, payload: str, order: str) -> DataFrame:
    """One row per valuation in a JSON history: (entity, order, pos, value_date, value)."""
    points = F.from_json(payload, schemas.VALUE_HISTORY).getField("list")
    return payloads.select(entity, order, F.posexplode(points).alias("pos", "_p")).select(
        entity,
        order,
        "pos",
        F.try_to_timestamp("_p.datum_mw", F.lit("dd/MM/yyyy")).cast("date").alias("value_date"),
        F.col("_p.y").alias("value"),
    )


def stack_rosters(tables: Iterable[tuple[DataFrame, str, str]]) -> DataFrame:
    """Union of (table, country, tournament) rosters whose columns may differ."""
    return union_all(
        [df.withColumn("country", F.lit(c)).withColumn("tournament", F.lit(t)) for df, c, t in tables]
    )
