"""Points against polygons, neighbourhood names, and simplified shapes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.functions.geo import bounds, in_multipolygon
from hearthlake.functions.scalars import group, matches
from hearthlake.operators import dictionary

CELL = 0.02


def locate(points: DataFrame, polygons: DataFrame, lat: str = "latitude", lng: str = "longitude", cell: float = CELL) -> DataFrame:
    """``points`` with ``area``: the first polygon (by ord) that contains them, null if none does.

    Polygons are dealt to the grid cells that their bounds touch, so points and
    polygons meet in an equi-join on the cell instead of all with all.
    """
    box = polygons.withColumn("b", bounds(F.col("coordinates")))
    span = lambda a, b: F.sequence(F.floor(F.col(f"b.{a}") / cell), F.floor(F.col(f"b.{b}") / cell))
    cells = box.withColumn("cx", F.explode(span("west", "east"))).withColumn("cy", F.explode(span("south", "north"))).select("cx", "cy", "ord", "name", "coordinates")
    keyed = points.withColumn("__id", F.monotonically_increasing_id()).withColumns({"cx": F.floor(F.col(lng) / cell), "cy": F.floor(F.col(lat) / cell)})
    inside = in_multipolygon(F.col(lng), F.col(lat), F.col("coordinates"))
    met = keyed.join(cells, ["cx", "cy"], "left")
    hit = F.when(F.col("coordinates").isNotNull() & inside, F.struct("ord", "name"))
    found = met.withColumn("__hit", hit).groupBy("__id").agg(*(F.first(c).alias(c) for c in points.columns), F.min("__hit").alias("__hit"))
    return found.select(*points.columns, F.col("__hit.name").alias("area"))


def clean_area(raw: Column) -> Column:
    """Location text without city, state and brackets."""
    text = F.regexp_replace(F.lower(raw), r"\bsan francisco\b|,?\s*\bca\b\.?", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[()]", " "), r"\s+", " "))


def match_area(rows: DataFrame, text: Column, areas: DataFrame, out: str = "area", least: int = 4) -> DataFrame:
    """``rows`` with the area whose name or alias is the text, else the longest one of ``least`` letters that it contains.

    areas (name, ord, aliases): of equally long names the smaller ``ord`` counts.
    """
    names = areas.select(F.explode(F.array_distinct(F.transform(F.array_append("aliases", F.col("name")), lambda a: F.lower(a)))).alias("key"), "name", "ord")
    listed = [tuple(r) for r in names.collect()]
    return rows.withColumn(out, dictionary.best_name(rows.sparkSession, clean_area(text), listed, least))


# Towns around the city.
NEARBY = r"\b(oakland|berkeley|daly city|alameda|emeryville|richmond,|san mateo|pacifica|brisbane|sausalito|mill valley|san rafael|redwood city|palo alto|san jose|hayward|walnut creek|vallejo|treasure island annex)"


def in_city(text: Column, area: Column) -> Column:
    """Whether location text lies in the city; ``area``: what ``match_area`` found in it."""
    low = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    south = matches(low, r"south san francisco|\bssf\b")
    return F.coalesce(~south & ~(matches(low, NEARBY) & area.isNull()) & (F.contains(low, F.lit("san francisco")) | area.isNotNull()), F.lit(False))


def geocode(rows: DataFrame, cache: DataFrame, key: Column) -> DataFrame:
    """``rows`` with what the cache knows: latitude, longitude, precision, and ``cached`` (also for known failures)."""
    hit = cache.select(F.col("address_key").alias("__key"), F.col("latitude").alias("hit_latitude"), F.col("longitude").alias("hit_longitude"), F.col("precision").alias("hit_precision"))
    met = rows.withColumn("__at", key).join(hit, F.col("__at") == F.col("__key"), "left")
    return met.withColumn("cached", F.col("__key").isNotNull()).drop("__at", "__key")


def simplify_ring(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Points of a line that lie further than the tolerance from the chord of those kept around them."""
    keep = np.zeros(len(ring), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(ring) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        chord, rest = ring[b] - ring[a], ring[a + 1 : b] - ring[a]
        length = np.hypot(*chord)
        off = np.abs(chord[0] * rest[:, 1] - chord[1] * rest[:, 0]) / length if length else np.hypot(*rest.T)
        far = int(off.argmax())
        if off[far] > tolerance:
            keep[a + 1 + far] = True
            todo += [(a, a + 1 + far), (a + 1 + far, b)]
    return ring[keep]


def simplify(polygons: DataFrame, tolerance: float = 0.0001, digits: int = 5) -> DataFrame:
    """Shapes with fewer points: simplified, rounded, closed; rings of fewer than four points go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for shape in rows["coordinates"]:
                polygons_out = []
                for rings in shape:
                    made = []
                    for ring in rings:
                        r = np.round(simplify_ring(np.array([list(p) for p in ring], dtype=float), tolerance), digits)
                        r = r[np.r_[True, (np.diff(r, axis=0) != 0).any(axis=1)]]
                        if len(r) and (r[0] != r[-1]).any():
                            r = np.vstack([r, r[0]])
                        if len(r) >= 4:
                            made.append(r.tolist())
                    if made:
                        polygons_out.append(made)
                out.append(polygons_out)
            yield rows.assign(coordinates=out)

    return polygons.mapInPandas(run, polygons.schema)


def short_code(text: Column) -> Column:
    return group(text, r"([A-Za-z0-9]+)$")
