"""Extraction strategies as compositions over the input tables.

Inputs: ``pages(doc_id, page_no, text, n_drawings, width_px, height_px)``,
``regions(doc_id, page_no, x, y, w, h)``, ``table_cells(...)`` and
``responses(doc_id, page_no, region_no, source, raw_text, error)``, where
``region_no`` counts regions, tiles or crops of a page from 1 and 0 is the whole
page. A strategy takes a dict of these tables and returns units.

Several strategies over the same drawings need not read the same responses again:
``units`` is ``response_units`` of the responses and ``crops`` is ``numbered_regions`` of
the regions, made once and staged; a strategy that is not given them makes its own.
``table_documents`` has a row per table row or more, with ``doc_id``, and is cheaper to
count than ``table_cells``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from fenestra.functions import geometry as ge
from fenestra.functions.model_json import find_json
from fenestra.functions.text import is_vector_page
from fenestra.operators.consensus import consensus, with_unit_ids
from fenestra.operators.ordered import row_numbers
from fenestra.operators.overlaps import dedup_overlaps
from fenestra.operators.responses import anchor_units, read_units
from fenestra.operators.schedules import table_units
from fenestra.session import stage

Tables = dict[str, DataFrame]
_PAGE = ["doc_id", "page_no"]
_ORDER = ["page_no", "region_no", "item_no"]


def _sorted(df: DataFrame) -> DataFrame:
    """A side that grows with the input. Spark sees the compressed size of its few columns, which is a small part of what a
    broadcast of it takes in the driver; so both sides are shuffled and merged."""
    return df.hint("merge")


def usable(responses: DataFrame) -> DataFrame:
    """Answered calls; failed ones are counted elsewhere."""
    return responses.where(F.col("error").isNull())


def response_units(responses: DataFrame) -> DataFrame:
    """Usable items of answered calls, with the columns of their response, in crop coordinates."""
    return read_units(usable(responses))


def numbered_regions(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """Regions large enough to read, numbered top to bottom and left to right."""
    sized = regions.join(_sorted(pages.select(*_PAGE, "width_px", "height_px")), _PAGE)
    kept = sized.where(ge.is_region(F.col("w"), F.col("h"), F.col("width_px"), F.col("height_px")))
    order = [F.floor(F.col("y") / 50).asc(), F.col("x").asc(), F.col("y").asc(), F.col("w").asc(), F.col("h").asc()]
    return row_numbers(kept.drop("width_px", "height_px"), _PAGE, order, "region_no",
                       bound_by=regions)


def page_tiles(pages: DataFrame, tile: int = ge.TILE_PX, overlap: float = ge.TILE_OVERLAP) -> DataFrame:
    """Tiles of vector pages, numbered per page; scanned pages are left out before the explode."""
    vector = pages.where(is_vector_page(F.col("text"), F.col("n_drawings")))
    return vector.select(*_PAGE, F.posexplode(ge.tiles(F.col("width_px"), F.col("height_px"), tile, overlap))
                         .alias("_i", "t")).select(*_PAGE, (F.col("_i") + 1).alias("region_no"), "t.*")


def skipped_pages(pages: DataFrame) -> DataFrame:
    """Scanned pages per document that tiling leaves out, with the reason."""
    vector = is_vector_page(F.col("text"), F.col("n_drawings"))
    return pages.groupBy("doc_id").agg(
        F.count_if(~vector).alias("n_skipped"), F.count(F.lit(1)).alias("n_pages")).where(
        "n_skipped > 0").withColumn("reason", F.when(
            F.col("n_skipped") == F.col("n_pages"), "all_pages_raster").otherwise("raster pages skipped"))


def _crops(tables: Tables) -> DataFrame:
    return tables["crops"] if "crops" in tables else numbered_regions(tables["regions"], tables["pages"])


def _crop_units(tables: Tables, crops: DataFrame) -> DataFrame:
    """Units of cropped responses in page coordinates."""
    key, spots = [*_PAGE, "region_no"], _sorted(crops.select(*_PAGE, "region_no", "x", "y"))
    if "units" in tables:
        units = tables["units"].join(spots, key)
    else:
        units = read_units(usable(tables["responses"]).join(spots, key))
    return anchor_units(units, "page_no", F.col("x").cast("double"), F.col("y").cast("double")).drop("x", "y")


def whole_page(tables: Tables) -> DataFrame:
    """A: one response per page."""
    whole = "region_no = 0"
    units = tables["units"].where(whole) if "units" in tables else read_units(usable(tables["responses"]).where(whole))
    return anchor_units(units)


def region_crops(tables: Tables) -> DataFrame:
    """B: one response per drawing region."""
    return _crop_units(tables, _crops(tables))


def tiled(tables: Tables) -> DataFrame:
    """C: overlapping tiles of vector pages, then one unit per overlapping detection."""
    # an answer may hold any number of units, so they are counted after they were read; staged, so that they are read once
    units = stage(_crop_units(tables, page_tiles(tables["pages"])), "tiles")
    return dedup_overlaps(units, ["doc_id"], _ORDER, bound_by=units)


def coarse_crops(coarse: DataFrame, pages: DataFrame) -> DataFrame:
    """Regions proposed by a coarse reading, in pixels of the fine page; tiny ones are dropped."""
    listed = coarse.withColumn("_json", find_json(F.col("raw_text"))).select(
        *_PAGE, F.posexplode(F.try_variant_get("_json", "$", "array<struct<bbox_pct:array<double>>>")).alias("_i", "_r"))
    boxed = listed.join(_sorted(pages.select(*_PAGE, "width_px", "height_px")), _PAGE).withColumn(
        "b", ge.percent_box(F.col("_r.bbox_pct"), F.col("width_px"), F.col("height_px")))
    large = (F.col("b.w") >= ge.MIN_CROP_SIDE) & (F.col("b.h") >= ge.MIN_CROP_SIDE)
    return boxed.where(large).select(*_PAGE, (F.col("_i") + 1).alias("region_no"), "b.*")


def coarse_to_fine(tables: Tables) -> DataFrame:
    """D: fine responses on the regions of the coarse reading of the same page."""
    return _crop_units(tables, coarse_crops(usable(tables["coarse"]), tables["pages"]))


def tables_first(tables: Tables, vocab: str = "v1") -> DataFrame:
    """E: units of vector tables; documents without any fall back to region crops."""
    vector_docs = tables["pages"].where(is_vector_page(F.col("text"), F.col("n_drawings"))).select(
        "doc_id").distinct()
    cells = tables["table_cells"].join(_sorted(vector_docs), "doc_id", "left_semi")
    # what was read also tells which documents need the fallback; staged, so that tables are read once
    read = stage(table_units(cells, vocab, tables.get("table_documents")), "table_units")
    shared = ["doc_id", "page_no", "unit_id", "kind", "panels", "qty", "source_marks", "confidence"]
    rest = {n: t.join(_sorted(read.select("doc_id").distinct()), "doc_id", "left_anti") for n, t in tables.items()
            if n in ("responses", "regions", "units", "crops")}
    fallback = region_crops({**tables, **rest})
    return read.select(*shared, F.lit("vector").alias("mode")).unionByName(
        fallback.select(*shared, F.lit("fallback B").alias("mode")))


def agents(tables: Tables) -> DataFrame:
    """F: several prompts per region, reconciled per spec group and checked by the geometry rules."""
    units = region_crops(tables)
    return with_unit_ids(consensus(units, ["doc_id"], _ORDER), ["doc_id"])


#: strategy letter -> plan; extend to add a strategy
STRATEGIES: dict[str, Callable[[Tables], DataFrame]] = {
    "A": whole_page, "B": region_crops, "C": tiled, "D": coarse_to_fine, "E": tables_first, "F": agents}
