"""What platforms do to the geometry of media: canvases, variants. Re-encoding needs codecs and is left to them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import CANVAS


def fitted(width: Column, height: Column, canvas: tuple[int, int]) -> Column:
    """An image fitted into a canvas and centred on it: struct of width, height, left, top. Small ones are not enlarged."""
    most_w, most_h = canvas
    scale = F.least(F.lit(1.0), most_w / width, most_h / height)
    w, h = (F.greatest(F.lit(1), F.round(x * scale)).cast("int") for x in (width, height))
    return F.struct(w.alias("width"), h.alias("height"), F.floor((most_w - w) / 2).cast("int").alias("left"), F.floor((most_h - h) / 2).cast("int").alias("top"))


def variants(width: Column, height: Column) -> Column:
    """The original and one variant for each platform, as an array to be exploded: platform, width, height, left, top."""
    own = F.struct(F.lit("original").alias("platform"), F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"), F.lit(0).alias("left"), F.lit(0).alias("top")).alias("at"))
    return F.array(own, *[F.struct(F.lit(name).alias("platform"), fitted(width, height, canvas).alias("at")) for name, canvas in CANVAS.items()])
