"""Resizing with padding against a plain version, pixel by pixel, and the buffer's order against a plain buffer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import images, sampling


def line(values, after):
    """One line resampled, in whole numbers."""
    before = len(values)
    scale = before / after
    widen = max(1.0, scale)
    out = []
    for i in range(after):
        center = (i + 0.5) * scale
        near = range(max(0, int(center - widen + 0.5)), min(before, int(center + widen + 0.5)))
        raw = [max(0.0, 1 - abs((x - center + 0.5) / widen)) for x in near]
        fixed = [int(r / sum(raw) * 4_194_304 + 0.5) for r in raw]
        out.append(min(255, max(0, (2_097_152 + sum(f * values[x] for f, x in zip(fixed, near))) >> 22)))
    return out


def plain(image, to_height, to_width):
    """image: rows of pixels of channels."""
    height, width, channels = len(image), len(image[0]), len(image[0][0])
    if (height, width) == (to_height, to_width):
        return image
    ratio = max(width / to_width, height / to_height)
    h, w = max(1, int(height / ratio)), max(1, int(width / ratio))
    out = [[[0] * channels for _ in range(to_width)] for _ in range(to_height)]
    top, left = int((to_height - h) / 2), int((to_width - w) / 2)
    for c in range(channels):
        rows = [[p[c] for p in row] for row in image]
        rows = [line(r, w) if w != width else r for r in rows]
        columns = [[r[x] for r in rows] for x in range(w)]
        columns = [line(col, h) if h != height else col for col in columns]
        for y in range(h):
            for x in range(w):
                out[top + y][left + x][c] = columns[x][y]
    return out


@pytest.mark.parametrize("before, after, channels", [((8, 8), (5, 12), 1), ((4, 6), (9, 9), 3), ((10, 3), (3, 3), 2), ((3, 3), (3, 3), 1), ((1, 5), (4, 4), 1), ((7, 9), (14, 18), 3), ((20, 20), (1, 1), 1)])
def test_resizing(spark, monkeypatch, before, after, channels):
    monkeypatch.setattr(images, "PIXELS_A_PART", 300)
    draw = np.random.default_rng(sum(before))
    batch = draw.integers(0, 256, (6, *before, channels)) if channels > 1 else draw.choice([0, 255], (6, *before, channels))
    want = [plain(i.tolist(), *after) for i in batch]
    assert images.resize_with_pad(batch.astype(np.uint8), *after).tolist() == want
    rows = [(i, x.ravel().tolist(), "kept") for i, x in enumerate(batch)] + [(9, None, "null")]
    df = spark.createDataFrame(rows, "id long, pixels array<int>, size string").repartition(2)
    got = {r.id: r for r in images.resized(df, "pixels", *before, channels, *after).collect()}
    assert all(got[i].pixels == np.ravel(want[i]).tolist() and got[i].size == "kept" for i in range(6)) and got[9].pixels is None and got[9].size == "null"


def test_images_of_another_size_are_refused(spark):
    df = spark.createDataFrame([(1, [1, 2, 3])], "id long, pixels array<int>")
    with pytest.raises(Exception, match="3 values instead of 4"):
        images.resized(df, "pixels", 2, 2, 1, 1, 1).collect()
    assert images.resized(df.limit(0), "pixels", 2, 2, 1, 1, 1).collect() == []


def test_layouts_and_bytes(spark):
    chw = np.arange(24).reshape(2, 3, 4)
    df = spark.createDataFrame([(chw.ravel().tolist(), [0.0, 0.5, 0.999, 1.0, -0.1, 2.0])], "a array<int>, b array<float>")
    row = df.select(images.channels_last(F.col("a"), 2).alias("a"), images.to_bytes(F.col("b")).alias("b")).first()
    assert row.a == chw.transpose(1, 2, 0).ravel().tolist() and row.b == [0, 127, 254, 255, 0, 255]


@pytest.mark.parametrize("n, slots, epochs", [(40, 7, 1), (40, 7, 3), (5, 50, 2), (5, 50, 1), (12, 1, 2), (9, 9, 1), (0, 4, 2), (6, 12, 2)])
def test_a_buffer_gives_out_what_a_plain_one_does(spark, n, slots, epochs):
    draws = [r[0] for r in spark.range(n * epochs).select(sampling.draw(3, "id")).collect()]
    held, out = [], []
    for step in range(n * epochs):
        item = (step // n, step % n)
        if len(held) < slots:
            held.append(item)
            continue
        at = draws[step] % slots
        out.append(held[at])
        held[at] = item
    out += held
    rows = sampling.shuffle_buffer(spark.range(n).withColumnRenamed("id", "i").repartition(3), "i", slots, 3, epochs).collect()
    assert sorted((r.position, r.epoch, r.i) for r in rows) == [(p, *x) for p, x in enumerate(out)]
