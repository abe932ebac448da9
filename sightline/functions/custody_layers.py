"""Layers of custody in image files: a sealed chunk and a metadata packet, written and read."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import container, png

#: Kinds of the private chunk and of the text chunk, and what the packet's text begins with.
PRIVATE, TEXT, PREFIX = b"dnAx", b"iTXt", b"XML:com.adobe.xmp\x00\x00\x00\x00\x00"


def built(pixels: str, sealed: Column, packet_: Column) -> Column:
    """Square gray images with a private chunk and a metadata packet."""

    @F.pandas_udf("binary")
    def made(px: pd.Series, sealed: pd.Series, text: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for p, s, t in zip(px, sealed, text):
            side = int(len(p) ** 0.5)
            data = png.encode(np.array(p).reshape(side, side))
            data = data if s is None else png.with_chunk(data, PRIVATE, bytes(s))
            out.append(data if t is None else png.with_chunk(data, TEXT, PREFIX + t.encode()))
        return pd.Series(out)

    return made(pixels, sealed, packet_)


def boxed(ids: str) -> Column:
    """Containers of a short image; those of ids that are no multiple of 7 lack their end."""

    @F.pandas_udf("binary")
    def made(ids: pd.Series) -> pd.Series:
        import uuid

        whole = [container.pack(str(uuid.UUID(int=i)), str(uuid.UUID(int=1)), "org", i, b"image", {}) for i in ids.tolist()]
        return pd.Series([data if i % 7 == 0 else data[:-4] for i, data in zip(ids.tolist(), whole)])

    return made(ids)


def chunk(image: str) -> Column:
    """The private chunk of each image; null without one."""

    @F.pandas_udf("binary")
    def read(images: pd.Series) -> pd.Series:
        return images.map(lambda x: None if x is None else container.png_chunk(bytes(x), PRIVATE))

    return read(image)


def packet(image: str) -> Column:
    """The metadata packet of each image; null without one."""

    @F.pandas_udf("string")
    def read(images: pd.Series) -> pd.Series:
        found = images.map(lambda x: None if x is None else container.png_chunk(bytes(x), TEXT))
        return found.map(lambda x: x[len(PREFIX) :].decode("utf-8", "replace") if x is not None and x.startswith(PREFIX) else None)

    return read(image)
