"""A small set of made-up listings with planted facts: one house at two agencies, a look-alike, a poor place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "key string, ord int, source string, title string, description string, price int, area_m2 double, land_m2 double, rooms int, bedrooms int, commune_name string, commune_code string, photo_seeds array<int>"
#: Rows 1 and 2 are one house; row 3 resembles it and is another; row 6 lies in a poor place.
ROWS = [
    ("d1", 1, "n", "Longère au calme", "Longère de 176 m², 7 pièces, 5 chambres, verger, terrain de 2600 m²", 287000, 176.0, 2600.0, 7, 5, "Arlay", "39017", [301, 302, 303]),
    ("d2", 2, "p", "Grande longère", "Longère rénovée de 175 m² avec verger, terrain de 2600 m²", 279500, 175.0, 2600.0, 7, 5, "Arlay", "39017", [301, 302, 309]),
    ("d3", 3, "n", "Maison contemporaine", "Maison de 177 m², toit plat, carport, terrain de 2500 m²", 291000, 177.0, 2500.0, 7, 5, "Arlay", "39017", [320, 321]),
    ("d4", 4, "q", "Chalet", "Chalet de 94 m², poêle à bois, balcon", 186500, 94.0, 1150.0, 4, 3, "Poligny", "39434", [330]),
    ("d5", 5, "p", "Maison de ville", "Maison de ville de 88 m², cour, à rafraîchir", 129000, 88.0, 60.0, 3, 2, "Salins", "39500", [340, 341]),
    ("d6", 6, "q", "Plain-pied", "Plain-pied de 81 m², voie rapide à 90 m, 480 m² clos", 114000, 81.0, 480.0, 4, 2, "Dole", "39198", [350, 351]),
    ("d7", 7, "n", "Corps de ferme", "Corps de ferme de 260 m², dépendances, 2,3 ha de prés", 412000, 260.0, 23000.0, 9, 6, "Bletterans", "39056", [360]),
]


def listings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, SCHEMA)
