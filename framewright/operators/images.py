"""Images as arrays: layouts, 8-bit values, and resizing without distortion with zero padding.

The resampling is the usual two-pass bilinear one with a triangle that widens when an image shrinks; weights are fixed-point numbers of ``BITS`` bits and every pass is rounded to 8 bits, so results are integers and equal everywhere.
A batch of images of one size is resized by two products with small integer matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 22
#: Pixels that a task resizes at once, before and after.
PIXELS_A_PART = 1 << 22


def to_bytes(pixels: Column) -> Column:
    """Values of 0..1 as 0..255, cut off, not rounded; integers are taken as they are."""
    return F.transform(pixels, lambda x: F.least(F.greatest(F.floor(x.cast("double") * 255), F.lit(0)), F.lit(255)).cast("int"))


def channels_last(pixels: Column, channels: int) -> Column:
    """Channel by channel (CHW) to pixel by pixel (HWC)."""
    area = (F.size(pixels) / channels).cast("int")
    return F.transform(F.sequence(F.lit(0), F.size(pixels) - 1), lambda i: F.get(pixels, ((i % channels) * area + F.floor(i / channels)).cast("int")))


@cache
def weights(before: int, after: int) -> np.ndarray:
    """after x before, in fixed point: how much each old line gives to each new one."""
    scale = before / after
    widen = max(scale, 1.0)
    out = np.zeros((after, before), np.int64)
    for i in range(after):
        center = (i + 0.5) * scale
        lo, hi = max(0, int(center - widen + 0.5)), min(before, int(center + widen + 0.5))
        raw = [max(0.0, 1 - abs((x - center + 0.5) / widen)) for x in range(lo, hi)]
        total = sum(raw)
        out[i, lo:hi] = [int(r / total * (1 << BITS) + 0.5) for r in raw]
    return out


def placed(height: int, width: int, to_height: int, to_width: int) -> tuple[int, int, int, int]:
    """The size of the resized image, one line at least, and where it stands in the padded one."""
    ratio = max(width / to_width, height / to_height)
    h, w = max(1, int(height / ratio)), max(1, int(width / ratio))
    return h, w, max(0, int((to_height - h) / 2)), max(0, int((to_width - w) / 2))


def resize_with_pad(images: np.ndarray, to_height: int, to_width: int) -> np.ndarray:
    """images: n x height x width x channels of 0..255."""
    n, height, width, channels = images.shape
    if (height, width) == (to_height, to_width):
        return images
    h, w, top, left = placed(height, width, to_height, to_width)
    half = 1 << (BITS - 1)
    x = images.astype(np.int64)
    if w != width:
        x = np.clip((np.einsum("nyxc,ox->nyoc", x, weights(width, w)) + half) >> BITS, 0, 255)
    if h != height:
        x = np.clip((np.einsum("nyxc,oy->noxc", x, weights(height, h)) + half) >> BITS, 0, 255)
    out = np.zeros((n, to_height, to_width, channels), np.uint8)
    out[:, top : top + h, left : left + w] = x
    return out


def resized(df: DataFrame, pixels: str, height: int, width: int, channels: int, to_height: int, to_width: int) -> DataFrame:
    """df with the images (arrays of 0..255, pixel by pixel) of one size resized; a null image stays null, one of another length is an error."""
    size, most = height * width * channels, max(1, PIXELS_A_PART // max(height * width * channels, to_height * to_width * channels))
    at = df.columns.index(pixels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, most):
                batch = whole.slice(start, most)
                column = batch.column(at)
                known = np.asarray(column.is_valid())
                lengths = np.asarray(column.drop_null().value_lengths())
                if (lengths != size).any():
                    raise ValueError(f"an image of {lengths[lengths != size][0]} values instead of {size}")
                flat = column.flatten().to_numpy(zero_copy_only=False)
                new = resize_with_pad(flat.reshape(-1, height, width, channels), to_height, to_width).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(np.where(known, to_height * to_width * channels, 0))]).astype(np.int32)
                mask = pa.array(~known) if not known.all() else None
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(new.ravel()), mask=mask)
                yield pa.RecordBatch.from_arrays([made if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    schema = ", ".join(f"`{n}` {'array<int>' if n == pixels else t}" for n, t in df.dtypes)
    return df.mapInArrow(run, schema)
