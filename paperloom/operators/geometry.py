"""Units and page geometry.  1 pt = 12700 EMU, 1 twip = 635 EMU, 1 mm = 36000 EMU, 1 in = 914400 EMU."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EMU_PT, EMU_TWIP, EMU_MM, EMU_IN, EMU_CM = 12700, 635, 36000, 914400, 360000
#: Margins (top, bottom, left, right) by page size; millimetres, inches for Letter.
MARGINS = {"A4": (37, 19, 20, 20), "JACoW": (19, 19, 20, 20), "Letter": (0.75, 0.75, 0.79, 1.02)}
SIDES = ("top", "bottom", "left", "right")
GUTTER_CM = 0.51


def points(emu: Column) -> Column:
    return emu / EMU_PT


def twips_to_cm(twips: Column) -> Column:
    return F.bround(twips * (EMU_TWIP / EMU_CM), 2)


def page_class(width: Column, height: Column) -> Column:
    """A4, JACoW (A4's width, 279.5 mm high), Letter, or the size in words; to the nearest 10 000 EMU, half to even."""
    near = lambda c: F.bround(c, -4)
    return (
        F.when(near(width) == round(210 * EMU_MM, -4), F.when(near(height) == round(279.5 * EMU_MM, -4), "JACoW").otherwise("A4"))
        .when(near(width) == round(8.5 * EMU_IN, -4), "Letter")
        .otherwise(F.format_string("%s x %s mm", F.bround(width / EMU_MM, 0).cast("int").cast("string"), F.bround(height / EMU_MM, 0).cast("int").cast("string")))
    )


def check_sections(sections: DataFrame) -> DataFrame:
    """``sections`` with page_size, the margins in the page's unit, margins_ok and columns_ok.

    Margins of an unknown size are null and not in order.  One column is in order, two with a
    gutter of 0.51 cm are.
    """
    page = sections.withColumn("page_size", page_class(F.col("page_w"), F.col("page_h")))
    good = F.lit(True)
    for n, side in enumerate(SIDES):
        letter, metric = F.bround(F.col(side) / EMU_IN, 2), F.bround(F.col(side) / EMU_MM, 0)
        page = page.withColumn(f"{side}_margin", F.when(F.col("page_size") == "Letter", letter).when(F.col("page_size").isin("A4", "JACoW"), metric))
        wanted = F.when(F.col("page_size") == "A4", MARGINS["A4"][n] * 1.0).when(F.col("page_size") == "JACoW", MARGINS["JACoW"][n] * 1.0).otherwise(MARGINS["Letter"][n])
        good = good & F.coalesce(F.col(f"{side}_margin") == wanted, F.lit(False))
    gutter = twips_to_cm(F.col("cols_space_twips"))
    number = F.coalesce("cols_num", F.lit(1))
    columns = (number == 1) | F.coalesce((number == 2) & (gutter == GUTTER_CM), F.lit(False))
    return page.withColumn("margins_ok", good).withColumn("gutter_cm", gutter).withColumn("columns_ok", columns)
