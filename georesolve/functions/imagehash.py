"""Perceptual hashes of photos, from the rows of Spark's ``image`` source.

The middle of the frame counts, so corner logos and borders matter little. Sizes are reduced by area
means; the cosine transform is a product with a constant matrix. Unreadable images have no hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Part of the frame that is hashed, and the weights of red, green and blue.
CROP = 0.86
LUMA = (0.299, 0.587, 0.114)


def hashed(images: DataFrame) -> DataFrame:
    """origin, width, height, phash, dhash of images (column image, as the source gives it)."""
    crop, luma = CROP, LUMA

    def shares(n: int, m: int) -> np.ndarray:
        """Matrix m × n of the means of n pixels over m equal stretches."""
        edges, out = np.linspace(0, n, m + 1), np.zeros((m, n))
        for i in range(m):
            at = np.arange(int(edges[i]), min(n, int(np.ceil(edges[i + 1]))))
            out[i, at] = np.minimum(at + 1, edges[i + 1]) - np.maximum(at, edges[i])
        return out / out.sum(axis=1, keepdims=True)

    k = np.arange(32)
    cosines = np.cos(np.pi * (k[None, :] + 0.5) * k[:, None] / 32) * np.where(k == 0, np.sqrt(1 / 32), np.sqrt(2 / 32))[:, None]

    def packed(bits: np.ndarray) -> str:
        return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"

    def hashes(data: bytes, height: int, width: int, channels: int) -> tuple[str | None, str | None]:
        if data is None or height <= 0 or width <= 0 or channels not in (1, 3, 4) or len(data) < height * width * channels:
            return None, None
        a = np.frombuffer(data, dtype=np.uint8, count=height * width * channels).reshape(height, width, channels).astype(float)
        grey = a[:, :, 0] if channels == 1 else a[:, :, 2] * luma[0] + a[:, :, 1] * luma[1] + a[:, :, 0] * luma[2]
        dy, dx = int(height * (1 - crop) / 2), int(width * (1 - crop) / 2)
        grey = grey[dy : height - dy, dx : width - dx]
        sized = lambda h, w: shares(grey.shape[0], h) @ grey @ shares(grey.shape[1], w).T
        d = sized(8, 9)
        low = (cosines @ sized(32, 32) @ cosines.T)[:8, :8].ravel()[1:]
        return packed(low > np.median(low)), packed((d[:, 1:] > d[:, :-1]).ravel())

    def of(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [hashes(*x) for x in zip(b["data"], b["height"], b["width"], b["channels"], strict=True)]
            yield b[["origin", "width", "height"]].assign(phash=[p for p, _ in found], dhash=[d for _, d in found])

    rows = images.select("image.origin", "image.data", "image.height", "image.width", F.col("image.nChannels").alias("channels"))
    return rows.mapInPandas(of, "origin string, width int, height int, phash string, dhash string")
