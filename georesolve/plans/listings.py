"""Stage 2: from landed pages to stored, placed and grouped listings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import Grid, to_l93
from ..functions.text import commune_mentions
from ..operators import resolution, store, tables
from ..sources import listings as sources


@dataclass(frozen=True)
class Tables:
    """Stored tables as DataFrames: listing, geocode, commune (code, name, lat, lon, status, p90, area_good_ha), cells, zones."""

    listing: DataFrame
    geocode: DataFrame
    commune: DataFrame
    cells: DataFrame
    zones: DataFrame


def placed(pages: DataFrame, tables: Tables, grid: Grid, least_score: float = 20) -> DataFrame:
    """Well placed listings of a batch of pages (source, url, html, seen_at)."""
    found = sources.parsed(pages).join(pages.select("url", "seen_at"), "url")
    found = store.wanted(found).withColumns({c: F.lit(None).cast("double") for c in ("lat", "lon") if c not in found.columns})
    mentions = found.select("key", commune_mentions(F.concat_ws(" ", "title", "description")).alias("mentions"))
    named = store.reconciled(found, mentions, tables.commune.select("code", "name")).withColumn("commune_code", F.col("found_code"))
    located = store.located(named, tables.geocode, tables.commune)
    x, y = to_l93(F.col("lon"), F.col("lat"))
    found = store.placed(located.withColumn("x", x).withColumn("y", y), tables.cells, tables.zones, tables.commune, grid)
    return store.well_placed(found, least_score)


def collected(pages: DataFrame, tables: Tables, grid: Grid, least_score: float = 20) -> DataFrame:
    """The listing table after a batch of pages (source, url, html, seen_at)."""
    return store.upserted(tables.listing, placed(pages, tables, grid, least_score))


def regrouped(listings: DataFrame, decisions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(dup_link, dup_candidate) tables over all active listings."""
    active = listings.where("active") if "active" in listings.columns else listings
    groups, links, candidates = resolution.grouped(active, decisions)
    return resolution.dup_links(groups, links), candidates


def collected_into(stored: tables.Tables, pages: DataFrame, places: Tables, grid: Grid, least_score: float = 20) -> None:
    """Pages (source, url, html, seen_at) to the stored listing, photo and price tables; the same batch again changes nothing."""
    stored.put_listings(placed(pages, places, grid, least_score))
