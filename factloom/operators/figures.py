"""Figures: panel detection, swappable panels and labels, size limits.

Pixels are worked on with numpy in mapInPandas, one image at a time; everything about boxes and sizes is Column expressions.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as tx

#: Grey value below which a pixel is ink; least gutter as a share of the axis and in pixels; least panel as a share of the axis.
INK, GUTTER_SHARE, GUTTER_PIXELS, PANEL_SHARE = 245, 0.012, 6, 0.10
SIZE_TOLERANCE, HEIGHT_TOLERANCE, WIDTH_TOLERANCE, ALIGNED_PIXELS, LEAST_CONFIDENCE = 0.15, 0.20, 0.30, 12.0, 0.35
PANELS = "array<struct<x0:int,y0:int,x1:int,y1:int>>"


def bands(ink: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of an axis between gutters: blank runs inside the inked part, at least the least width. Slivers are dropped."""
    n = len(ink)
    inked = np.flatnonzero(ink)
    if not len(inked):
        return [(0, n)] if n else []
    least = max(GUTTER_PIXELS, int(n * GUTTER_SHARE))
    jumps = np.flatnonzero(np.diff(inked) - 1 >= least)
    starts = np.concatenate([[0], inked[jumps + 1]])
    ends = np.concatenate([inked[jumps] + 1, [n]])
    return [(int(a), int(b)) for a, b in zip(starts, ends, strict=True) if b - a >= n * PANEL_SHARE]


def detect_panels(grey: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(x0, y0, x1, y1) of the panels: a grid if all row bands have the same number (two at least) of columns, else the row bands."""
    ink = grey < INK
    rows = bands(ink.any(axis=1))
    columns = [bands(ink[a:b].any(axis=0)) for a, b in rows]
    grid = bool(columns) and len(columns[0]) >= 2 and len({len(c) for c in columns}) == 1
    width = grey.shape[1]
    return [(x0, a, x1, b) for (a, b), cs in zip(rows, columns, strict=True) for x0, x1 in (cs if grid else [(0, width)])]


def to_grey(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Luma of an image in the layout of Spark's image source (BGR)."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    if channels == 1:
        return pixels[:, :, 0]
    return np.round(pixels[:, :, 0] * 0.114 + pixels[:, :, 1] * 0.587 + pixels[:, :, 2] * 0.299)


def swap_channels(data: bytes, channels: int) -> bytes:
    """RGB pixels as BGR ones, or back."""
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, channels)[:, ::-1]).tobytes()


def png(data: bytes, height: int, width: int, channels: int) -> bytes:
    """Pixels (grey, or RGB) as a PNG file."""
    rows = np.frombuffer(data, np.uint8).reshape(height, width * channels)
    raw = np.hstack([np.zeros((height, 1), np.uint8), rows]).tobytes()  # no filter in front of each row
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    header = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def with_panels(images: DataFrame) -> DataFrame:
    """(image_id, panels) of images (image_id, height, width, channels, data); the pixels go no further."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [[dict(zip(("x0", "y0", "x1", "y1"), p, strict=True)) for p in detect_panels(to_grey(*x))] for x in zip(f["height"], f["width"], f["channels"], f["data"], strict=True)]
            yield pd.DataFrame({"image_id": f["image_id"], "panels": found})

    return images.select("image_id", "height", "width", "channels", "data").mapInPandas(run, f"image_id string, panels {PANELS}")


def _near(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= tolerance * F.greatest(a, b)


def swappable_pairs(panels: Column, tolerance: float = SIZE_TOLERANCE) -> Column:
    """(i, j), i < j: panels of nearly the same width and height. An array of one image's panels; images never meet."""
    size = F.transform(panels, lambda p, i: F.struct(i.cast("int").alias("i"), (p["x1"] - p["x0"]).cast("double").alias("w"), (p["y1"] - p["y0"]).cast("double").alias("h")))
    pair = lambda a: F.transform(F.filter(size, lambda b: (b["i"] > a["i"]) & _near(a["w"], b["w"], tolerance) & _near(a["h"], b["h"], tolerance)), lambda b: F.struct(a["i"].alias("i"), b["i"].alias("j")))
    return F.flatten(F.transform(size, pair))


def category_pairs(boxes: Column) -> Column:
    """(i, j), i < j: text boxes of one row or column, alike in size, with different texts that aren't numbers."""
    numbered = F.transform(boxes, lambda b, i: F.struct(i.cast("int").alias("i"), b.alias("b")))
    words = F.filter(numbered, lambda x: ~tx.looks_numeric(x["b"]["text"]))

    def fits(a: Column, b: Column) -> Column:
        differ = F.lower(tx.strip(a["text"])) != F.lower(tx.strip(b["text"]))
        aligned = (F.abs(a["cy"] - b["cy"]) <= ALIGNED_PIXELS) | (F.abs(a["x0"] - b["x0"]) <= ALIGNED_PIXELS)
        return differ & _near(a["h"], b["h"], HEIGHT_TOLERANCE) & _near(a["w"], b["w"], WIDTH_TOLERANCE) & aligned

    return F.flatten(F.transform(words, lambda x: F.transform(F.filter(words, lambda y: (y["i"] > x["i"]) & fits(x["b"], y["b"])), lambda y: F.struct(x["i"].alias("i"), y["i"].alias("j")))))


def confident(boxes: Column) -> Column:
    """Boxes read with enough confidence that aren't blank."""
    return F.filter(boxes, lambda b: (b["conf"] >= LEAST_CONFIDENCE) & (tx.strip(b["text"]) != ""))


def exchange(pixels: np.ndarray, a: tuple[int, int, int, int], b: tuple[int, int, int, int]) -> np.ndarray:
    """The image with two boxes' contents exchanged, each resized to the other's place by nearest neighbour."""

    def fit(part: np.ndarray, height: int, width: int) -> np.ndarray:
        return part[np.arange(height) * part.shape[0] // height][:, np.arange(width) * part.shape[1] // width]

    out = pixels.copy()
    cut = lambda box: pixels[box[1] : box[3], box[0] : box[2]]
    for to, source in ((a, b), (b, a)):
        out[to[1] : to[3], to[0] : to[2]] = fit(cut(source), to[3] - to[1], to[2] - to[0])
    return out


def swap_figures(images: DataFrame) -> DataFrame:
    """(image_id, operation, box_a, box_b, data): panels exchanged where two are alike, else two text labels, else operation null.

    images: image_id, height, width, channels, data, boxes (texts read, may be null). Which pair is taken follows from the id's hash.
    """
    with_pairs = images.join(with_panels(images), "image_id")
    labels = confident(F.coalesce(F.col("boxes"), F.array().cast("array<struct<text:string,conf:double,x0:double,y0:double,x1:double,y1:double,w:double,h:double,cx:double,cy:double>>")))
    rows = with_pairs.withColumn("_labels", labels).withColumn("_p", swappable_pairs(F.col("panels"))).withColumn("_c", category_pairs(F.col("_labels")))
    pick = lambda c: F.get(F.col(c), F.pmod(F.xxhash64("image_id"), F.greatest(F.size(c), F.lit(1))).cast("int"))
    box = lambda c, i: F.get(F.col(c), i)
    whole = lambda b: F.struct(*[b[k].cast("int").alias(k) for k in ("x0", "y0", "x1", "y1")])
    chosen = F.when(F.size("_p") > 0, F.struct(F.lit("Graph Swap").alias("operation"), whole(box("panels", pick("_p")["i"])).alias("a"), whole(box("panels", pick("_p")["j"])).alias("b"))).when(
        F.size("_c") > 0, F.struct(F.lit("Category Swap").alias("operation"), whole(box("_labels", pick("_c")["i"])).alias("a"), whole(box("_labels", pick("_c")["j"])).alias("b"))
    )
    rows = rows.withColumn("_x", chosen).select("image_id", "height", "width", "channels", "data", F.col("_x.operation").alias("operation"), F.col("_x.a").alias("box_a"), F.col("_x.b").alias("box_b"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = ("x0", "y0", "x1", "y1")
        for f in frames:
            data = []
            for h, w, c, raw, op, a, b in zip(*(f[k] for k in ("height", "width", "channels", "data", "operation", "box_a", "box_b")), strict=True):
                pixels = np.frombuffer(raw, np.uint8).reshape(h, w, c)
                data.append(exchange(pixels, tuple(int(a[k]) for k in order), tuple(int(b[k]) for k in order)).tobytes() if op is not None else None)
            yield f.assign(data=data)[["image_id", "operation", "box_a", "box_b", "data"]]

    kind = "struct<x0:int,y0:int,x1:int,y1:int>"
    return rows.mapInPandas(run, f"image_id string, operation string, box_a {kind}, box_b {kind}, data binary")


def cap_side(height: Column, width: Column, most: int = 2048) -> Column:
    """Scale that brings the longer side to at most `most`; never above 1."""
    return F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(height, width))


def cap_pixels(height: Column, width: Column, most: float = 3e6) -> Column:
    return F.least(F.lit(1.0), F.sqrt(F.lit(most) / (height * width)))


def cap_box(height: Column, width: Column, most_height: int = 1536, most_width: int = 1240) -> Column:
    return F.least(F.lit(most_height) / height, F.lit(most_width) / width, F.lit(1.0))


def megapixels(height: Column, width: Column, scale: Column) -> Column:
    """Area after scaling, sides rounded down to whole pixels, in millions."""
    return F.floor(height * scale) * F.floor(width * scale) / 1e6


def table_layout(table: Column, most: int = 40) -> Column:
    """Width of each column of a table in characters: its longest cell, at most `most`."""
    columns = F.coalesce(F.array_max(F.transform(table, F.size)), F.lit(0))
    longest = lambda j: F.coalesce(F.array_max(F.transform(table, lambda r: F.length(tx.squeeze(F.get(r, j))))), F.lit(0))
    return F.when(columns > 0, F.transform(F.sequence(F.lit(0), columns - 1), lambda j: F.least(longest(j), F.lit(most)))).otherwise(F.array().cast("array<int>"))


def wrapped(text: str, width: int) -> list[str]:
    """Lines of at most `width` characters, broken at blanks, within words only where one is longer than a line."""
    out, line = [], ""
    for word in text.split():
        while len(word) > width:
            if line:
                out.append(line)
                line = ""
            out.append(word[:width])
            word = word[width:]
        if line and len(line) + 1 + len(word) > width:
            out.append(line)
            line = word
        elif word:
            line = f"{line} {word}" if line else word
    return [*out, line] if line or not out else out
