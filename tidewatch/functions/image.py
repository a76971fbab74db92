"""Image functions over the rows of Spark's ``image`` source (height, width, nChannels, BGR bytes), as Arrow functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The mean and deviation that networks' inputs are normalised with.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
MIN_SIDE, MIN_DEVIATION = 64, 2.0


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """RGB, height x width x 3."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, 2::-1]


def gray(rgb: np.ndarray) -> np.ndarray:
    """Luma of ITU-R 601, in whole numbers."""
    return ((rgb.astype(np.int64) @ np.array([19595, 38470, 7471]) + 0x8000) >> 16).astype(np.uint8)


def _weights(size: int, to: int, reach: float, kernel) -> np.ndarray:
    scale = max(size / to, 1.0)
    centres = (np.arange(to) + 0.5) * size / to
    at = (np.arange(size) + 0.5)[None, :] - centres[:, None]
    w = np.where(np.abs(at) < reach * scale, kernel(at / scale), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(x: np.ndarray, height: int, width: int, lanczos: bool) -> np.ndarray:
    """Separable resampling of a plane or of planes in the last axis."""
    kernel = (lambda t: np.sinc(t) * np.sinc(t / 3)) if lanczos else (lambda t: 1 - np.abs(t))
    reach = 3.0 if lanczos else 1.0
    a, b = _weights(x.shape[0], height, reach, kernel), _weights(x.shape[1], width, reach, kernel)
    return np.clip(np.rint(np.tensordot(a, np.tensordot(b, x.astype(float), (1, 1)), (1, 1))), 0, 255)


def dhash(plane: np.ndarray, size: int = 8) -> str:
    """Whether each of 9 x 8 resampled pixels is brighter than the next, row by row, as hex digits."""
    small = resize(plane, size, size + 1, True)
    bits = (small[:, :-1] > small[:, 1:]).reshape(-1)
    return np.packbits(bits).tobytes().hex()


def inspect(height: int, width: int, channels: int, data: bytes | None, min_side: int = MIN_SIDE, min_deviation: float = MIN_DEVIATION) -> tuple:
    """(error, dhash, width, height, deviation)."""
    if data is None or height <= 0 or width <= 0:
        return "invalid_screenshot", None, None, None, None
    if width < min_side or height < min_side:
        return "screenshot_too_small", None, width, height, None
    plane = gray(pixels(height, width, channels, data))
    deviation = float(plane.std())
    if int(plane.max()) - int(plane.min()) <= 2 or deviation < min_deviation:
        return "blank_or_monochrome_screenshot", None, width, height, deviation
    return None, dhash(plane), width, height, deviation


def inspected():

    @F.pandas_udf("error string, dhash string, width int, height int, deviation double")
    def of(images: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([inspect(r.height, r.width, r.nChannels, r.data) for r in images.itertuples()], columns=["error", "dhash", "width", "height", "deviation"])

    return lambda image: of(F.struct(*(image[k].alias(k) for k in ("height", "width", "nChannels", "data"))))


def letterbox(rgb: np.ndarray, size: int) -> np.ndarray:
    """I4: scaled to fit a white square, normalised, channels first."""
    h, w = rgb.shape[:2]
    f = min(size / h, size / w, 1.0)
    nh, nw = max(1, round(h * f)), max(1, round(w * f))
    small = np.stack([resize(rgb[:, :, c], nh, nw, False) for c in range(3)], axis=2) if f < 1 else rgb
    out = np.full((size, size, 3), 255.0)
    top, left = (size - nh) // 2, (size - nw) // 2
    out[top : top + nh, left : left + nw] = small
    return ((out / 255 - MEAN) / DEVIATION).transpose(2, 0, 1).astype(np.float32)


def tensors(size: int = 128):
    """The letterboxed image as a flat array of floats."""

    @F.pandas_udf("array<float>")
    def of(images: pd.DataFrame) -> pd.Series:
        return pd.Series([letterbox(pixels(r.height, r.width, r.nChannels, r.data), size).reshape(-1) for r in images.itertuples()])

    return lambda image: of(F.struct(*(image[k].alias(k) for k in ("height", "width", "nChannels", "data"))))


def hash_column(h: Column) -> Column:
    """The 16 hex digits as a signed number."""
    return F.conv(h, 16, -10).cast("bigint")
