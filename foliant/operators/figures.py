"""Figures: which plate may answer, and what it carries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import vocab


def lookup(figures: DataFrame, names: DataFrame, limit: int = 4) -> DataFrame:
    """name, figure_id, caption, asset_path, ocr_text, readable: figures whose caption or words hold a name, those with most words first.

    Names are few and stated; they are matched by words of captions, an equi-join, then verified.
    """
    words = lambda c: F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), " "))
    text = F.concat_ws(" ", "caption", "ocr_text")
    rows = figures.select("*", F.explode(words(text)).alias("word"))
    asked = names.select("name").distinct().withColumn("word", words(F.col("name"))[0])
    met = rows.join(asked, "word").filter(F.contains(F.lower(text), F.lower("name"))).drop("word")
    order = Window.partitionBy("name").orderBy(F.desc(F.length(F.coalesce("ocr_text", F.lit("")))), "figure_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked.select("name", "figure_id", "caption", "asset_path", "ocr_text", (F.length(F.trim(F.coalesce("ocr_text", F.lit("")))) > 0).alias("readable"))


def attribute_of_title(title: Column) -> Column:
    """The attribute a chart plots: the longest label in its title after " - ", or in all of it."""
    tail = F.lower(F.regexp_replace(title, r"^.*\s-\s", ""))
    out = F.lit(None).cast("string")
    for label, attribute in sorted(vocab.PLATE_LABELS.items(), key=lambda x: len(x[0])):
        out = F.when(F.contains(tail, F.lit(label)), F.lit(attribute)).otherwise(out)
    return out


def bars(image: np.ndarray, least_long: int = 30, least_thick: int = 12, gap: int = 3, solid: float = 0.85) -> list[tuple[int, int, int, int, tuple[int, int, int]]]:
    """(left, top, length, thickness, colour) of the horizontal bars of a decoded picture (height, width, 3).

    Each dominant colour that is not the ground's is a mask; its rows make bands, parted by more than ``gap`` rows
    without it; a band's bar is its longest run of columns that are filled to the share ``solid``.
    """
    flat = image.reshape(-1, 3).astype(np.int64)
    code = (flat[:, 0] >> 4) << 8 | (flat[:, 1] >> 4) << 4 | flat[:, 2] >> 4
    shades, count = np.unique(code, return_counts=True)
    ground, out = shades[count.argmax()], []
    for shade in shades[(count >= least_long * least_thick) & (shades != ground)].tolist():
        mask = (code == shade).reshape(image.shape[:2])
        rows = np.flatnonzero(mask.any(axis=1))
        for band in np.split(rows, np.flatnonzero(np.diff(rows) > gap + 1) + 1):
            top, bottom = int(band[0]), int(band[-1]) + 1
            full = mask[top:bottom].mean(axis=0) >= solid
            edges = np.flatnonzero(np.diff(np.concatenate([[False], full, [False]]).astype(np.int8)))
            runs = edges.reshape(-1, 2)
            if len(runs) and bottom - top >= least_thick:
                left, right = runs[(runs[:, 1] - runs[:, 0]).argmax()].tolist()
                if right - left >= least_long:
                    colour = tuple(int(x) for x in np.median(image[top:bottom, left:right].reshape(-1, 3), axis=0))
                    out.append((left, top, right - left, bottom - top, colour))
    return sorted(out, key=lambda b: b[1])


def routed(attribute: str) -> bool:
    """Whether plates may answer for an attribute."""
    return attribute in vocab.FIGURE_ATTRIBUTES or attribute in vocab.VISUAL_ATTRIBUTES


def answers(attribute) -> tuple:
    """Whether an attribute is one that plates print, and one that only looking at the picture tells."""
    return attribute.isin(*vocab.FIGURE_ATTRIBUTES), attribute.isin(*vocab.VISUAL_ATTRIBUTES)
