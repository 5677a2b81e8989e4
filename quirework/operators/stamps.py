"""Page geometry, stamps, numbering and image pages: column expressions over joined tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import one_space, settings, trimmed

# A4 in points, the nine anchors, and the long side of a page made to an image's shape.
A4 = (595.28, 841.89)
ANCHORS = ("top-left", "top-center", "top-right", "middle-left", "center", "middle-right", "bottom-left", "bottom-center", "bottom-right")
LONG_SIDE = 842.0


def normalized(angle: Column) -> Column:
    return F.pmod(F.round(angle).cast("int"), F.lit(360))


def _point(vx: Column, vy_down: Column) -> tuple[Column, Column]:
    """A point of the page as shown (down from the top left) in the page's own space; columns x, y, width, height, angle."""
    x, y, w, h, a = (F.col(c) for c in ("x", "y", "width", "height", "angle"))
    px = F.when(a == 90, x + vy_down).when(a == 180, x + w - vx).when(a == 270, x + w - vy_down).otherwise(x + vx)
    py = F.when(a == 90, y + vx).when(a == 180, y + vy_down).when(a == 270, y + h - vx).otherwise(y + h - vy_down)
    return px, py


def page_display_boxes(pages: DataFrame) -> DataFrame:
    """The pages with angle (0, 90, 180, 270), shown_width and shown_height, and the place of the shown top left corner."""
    rows = pages.withColumn("angle", normalized(F.col("rotation")))
    turned = F.col("angle") % 180 != 0
    rows = rows.withColumn("shown_width", F.when(turned, F.col("height")).otherwise(F.col("width"))).withColumn("shown_height", F.when(turned, F.col("width")).otherwise(F.col("height")))
    cx, cy = _point(F.lit(0.0), F.lit(0.0))
    return rows.withColumns({"corner_x": cx, "corner_y": cy})


def _placed(rows: DataFrame) -> DataFrame:
    """Adds px, py, rotate to rows with a display box and columns anchor, margin, tilt, cw, ch (the block's size)."""
    vw, vh, cw, ch, m = (F.col(c) for c in ("shown_width", "shown_height", "cw", "ch", "margin"))
    left, right = F.col("anchor").endswith("-left"), F.col("anchor").endswith("-right")
    top, bottom = F.col("anchor").startswith("top-"), F.col("anchor").startswith("bottom-")
    bx = F.when(left, m).when(right, vw - cw - m).otherwise((vw - cw) / 2)
    by = F.when(bottom, m).when(top, vh - ch - m).otherwise((vh - ch) / 2)
    zero = F.lit(0.0)
    bx, by = F.least(F.greatest(bx, zero), F.greatest(vw - cw, zero)), F.least(F.greatest(by, zero), F.greatest(vh - ch, zero))
    cos, sin = F.cos(F.radians("tilt")), F.sin(F.radians("tilt"))
    ox, oy = bx + cw / 2 - (cw / 2 * cos - ch / 2 * sin), by + ch / 2 - (cw / 2 * sin + ch / 2 * cos)
    px, py = _point(ox, vh - oy)
    return rows.withColumns({"px": F.round(px, 6), "py": F.round(py, 6), "rotate": F.col("angle") + F.col("tilt")})


def place_stamps(pages: DataFrame, stamps: DataFrame) -> DataFrame:
    """(doc_id, ordinal, anchor, tilt, px, py, rotate): where each stamp (anchor, tilt, margin, cw, ch) starts on each page, tilted about its centre.

    A block larger than the page sits at its edge. stamps is a short table of settings.
    """
    return _placed(page_display_boxes(pages).join(settings(stamps))).select("doc_id", "ordinal", "anchor", "tilt", "px", "py", "rotate")


def number_pages(pages: DataFrame, start_at: int = 1, of_word: str | None = None) -> DataFrame:
    """(doc_id, ordinal, label): numbers from the final order of the given pages, plain or with the last number behind a word."""
    own = Window.partitionBy("doc_id")
    value = F.row_number().over(own.orderBy("ordinal")) + start_at - 1
    rows = pages.select("doc_id", "ordinal", value.alias("v"), (F.count("*").over(own) + start_at - 1).alias("last"))
    label = F.col("v").cast("string") if of_word is None else F.concat_ws(" ", F.col("v").cast("string"), F.lit(of_word), F.col("last").cast("string"))
    return rows.select("doc_id", "ordinal", label.alias("label"))


def watermark_plan(pages: DataFrame, text: str, scope: DataFrame | None = None) -> DataFrame:
    """(doc_id, ordinal, text): pages that a watermark covers, all if there is no scope (doc_id, page); its text with single spaces."""
    covered = pages if scope is None else pages.join(scope.select("doc_id", F.col("page").alias("ordinal")).distinct(), ["doc_id", "ordinal"], "left_semi")
    return covered.select("doc_id", "ordinal", trimmed(one_space(F.lit(text))).alias("text"))


def image_stamp_plan(pages: DataFrame, stamps: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placements, distinct images): an image as wide as a fraction of each page as shown, each image stored once.

    stamps is (doc_id, asset, fraction, anchor, margin, tilt).
    """
    met = page_display_boxes(pages).join(stamps, "doc_id").join(images.select("asset", "img_w", "img_h"), "asset")
    met = met.withColumn("cw", F.col("shown_width") * F.col("fraction")).withColumn("ch", F.col("cw") * F.col("img_h") / F.col("img_w"))
    return _placed(met).select("doc_id", "ordinal", "asset", F.round("cw", 6).alias("cw"), F.round("ch", 6).alias("ch"), "px", "py", "rotate"), met.select("asset").distinct()


def image_page_plan(images: DataFrame, mode: str = "a4", padding: float = 0.0) -> DataFrame:
    """(asset, page_w, page_h, w, h, x, y): a page for each image, A4 turned to its shape with the image fitted inside a margin, or the image's own shape with a long side of 842."""
    w, h = F.col("img_w"), F.col("img_h")
    if mode == "a4":
        wide = w > h
        page_w, page_h = F.when(wide, A4[1]).otherwise(A4[0]), F.when(wide, A4[0]).otherwise(A4[1])
        scale = F.least((page_w - 2 * padding) / w, (page_h - 2 * padding) / h)
    else:
        scale = F.lit(LONG_SIDE) / F.greatest(w, h)
        page_w, page_h = w * scale, h * scale
    fw, fh = w * scale, h * scale
    r = lambda c: F.round(c, 6)
    return images.select("asset", r(page_w).alias("page_w"), r(page_h).alias("page_h"), r(fw).alias("w"), r(fh).alias("h"), r((page_w - fw) / 2).alias("x"), r((page_h - fh) / 2).alias("y"))


def normalize_gestures(strokes: DataFrame, least: float = 3.0) -> DataFrame:
    """(id, x, y, width, height): rectangles from two corners in any order; those under three points on a side are misfires."""
    rows = strokes.select("id", F.least("x1", "x2").alias("x"), F.least("y1", "y2").alias("y"), F.abs(F.col("x2") - F.col("x1")).alias("width"), F.abs(F.col("y2") - F.col("y1")).alias("height"))
    return rows.where((F.col("width") >= least) & (F.col("height") >= least))
