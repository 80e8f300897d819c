"""Tile perturbations and quality metrics.

What is a permutation of pixels or a function of one pixel is a Column on pixel arrays. The rest are small numpy
kernels that one Arrow job runs over the grid of tiles, perturbations and severities; random ones are seeded by tile,
perturbation and severity, so a task that is run again gives the same pixels.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedaudit.functions.text import param_of

from . import families

EDGE = 8
SEVERITIES = ("mild", "moderate", "severe")
BRIGHTNESS = dict(zip(SEVERITIES, (0.7, 1.0, 1.3), strict=True))


def _moved(pixels: str | Column, place, edge: int = EDGE) -> Column:
    """Pixel i of the result is the input's pixel ``place(row, column)``."""
    return F.transform(F.sequence(F.lit(0), F.lit(edge * edge - 1)), lambda i: F.get(pixels, place(F.floor(i / edge), i % edge).cast("int")))


def flip_h(pixels: str, edge: int = EDGE) -> Column:
    return _moved(pixels, lambda r, c: r * edge + (edge - 1 - c), edge)


def flip_v(pixels: str, edge: int = EDGE) -> Column:
    return _moved(pixels, lambda r, c: (edge - 1 - r) * edge + c, edge)


def rotate90(pixels: str, edge: int = EDGE) -> Column:
    return _moved(pixels, lambda r, c: c * edge + (edge - 1 - r), edge)


def solarize(pixels: str) -> Column:
    return F.transform(pixels, lambda v: F.when(v < 128, v).otherwise(255 - v))


def brightness(pixels: str, factor: Column) -> Column:
    return F.transform(pixels, lambda v: F.least(F.lit(255), F.floor(v * factor + 0.5)).cast("int"))


def channel_shift(pixels: str, shift: Column) -> Column:
    return F.transform(pixels, lambda v: F.least(F.lit(255), v + shift).cast("int"))


def composite_white(pixels: str, alpha: str) -> Column:
    """A channel with opacity 0..255 laid on white, rounded half up."""
    return F.zip_with(pixels, alpha, lambda v, a: F.floor(v * (a / F.lit(255.0)) + 255 * (1 - a / F.lit(255.0)) + 0.5).cast("int"))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def mean_intensity(pixels: str) -> Column:
    return _mean(F.transform(pixels, lambda v: v.cast("double")))


def std_intensity(pixels: str) -> Column:
    """Population standard deviation."""
    mean = mean_intensity(pixels)
    return F.sqrt(_mean(F.transform(pixels, lambda v: (v - mean) * (v - mean))))


def is_background(pixels: str, mean_max: float = 222, std_min: float = 8) -> Column:
    """Bright and flat, both."""
    return (mean_intensity(pixels) > mean_max) & (std_intensity(pixels) < std_min)


def psnr(a: str, b: str) -> Column:
    mse = _mean(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("double")))
    return F.when(mse == 0, float("inf")).otherwise(10 * F.log10(F.lit(65025.0) / mse))


def mean_abs_diff(a: str, b: str) -> Column:
    return _mean(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")))


def entropy(tiles: DataFrame, key: str, pixels: str) -> DataFrame:
    """Shannon entropy in bits of each tile's values, from its histogram."""
    counts = tiles.select(key, F.explode(pixels).alias("v"), F.size(pixels).alias("n")).groupBy(key, "v").agg((F.count("*") / F.first("n")).alias("p"))
    return counts.groupBy(key).agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"))


def grid_means(pixels: str, edge: int = EDGE, cells: int = 4) -> Column:
    """Means of the cells of a ``cells`` x ``cells`` grid, row by row."""
    side = edge // cells
    offsets = [r * edge + c for r in range(side) for c in range(side)]
    first = [(k // cells) * side * edge + (k % cells) * side for k in range(cells * cells)]
    return F.array(*[F.round(sum((F.get(pixels, F.lit(f + o)) for o in offsets[1:]), F.get(pixels, F.lit(f + offsets[0]))) / float(side * side), 4) for f in first])


# --- numpy kernels: (..., rows, columns, 3) floats in 0..255, one tile or a stack of them, and the severity's place, 0 to 2


class Draws:
    """Numbers drawn by counting on from a text's digest: the same for a text in every run, task and engine. Of several
    texts each draws the numbers of a stack's tile, the first axis of a shape."""

    def __init__(self, text: str | list[str]):
        self.stack = not isinstance(text, str)
        seeds = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) << 32 for t in (text if self.stack else [text])]
        self.seed, self.at = np.array(seeds, dtype=np.uint64)[:, None], 0

    def random(self, shape) -> np.ndarray:
        """Uniform in (0, 1)."""
        n = int(np.prod(shape[1:] if self.stack else shape))
        z = self.seed + np.arange(self.at, self.at + n, dtype=np.uint64)
        self.at += n
        # fixed values of the published mixing function (SplitMix64)
        z = z + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        return (((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53).reshape(shape)

    def normal(self, mean: float, sigma: float, shape) -> np.ndarray:
        """Two uniform draws for each value."""
        u = self.random((*shape, 2))
        return mean + sigma * (np.sqrt(-2 * np.log(u[..., 0])) * np.cos(2 * np.pi * u[..., 1]))


def _hsv(x: np.ndarray) -> np.ndarray:
    """Hue in degrees, saturation and value in 0..1."""
    x = x / 255.0
    top, low = x.max(-1), x.min(-1)
    span = np.where(top > low, top - low, 1)
    r, g, b = np.moveaxis(x, -1, 0)
    hue = np.select([top == low, top == r, top == g], [0, (g - b) / span % 6, (b - r) / span + 2], (r - g) / span + 4) * 60
    return np.stack([hue, np.where(top > 0, (top - low) / np.where(top > 0, top, 1), 0), top], -1)


def _rgb(x: np.ndarray) -> np.ndarray:
    h, s, v = np.moveaxis(x, -1, 0)
    part = lambda n: v - v * s * np.clip(np.minimum((k := (n + h / 60) % 6), 4 - k), 0, 1)
    return np.stack([part(5), part(3), part(1)], -1) * 255


def _in_hsv(change):
    def kernel(x, s, rng):
        y = _hsv(x)
        change(y, s)
        y[..., 0] %= 360
        return _rgb(np.clip(y, 0, [360, 1, 1]))

    return kernel


def _scaled(place: int, factors: tuple[float, float, float]):
    def change(y, s):
        y[..., place] *= factors[s]

    return _in_hsv(change)


def _hue(y, s):
    y[..., 0] += (10, 30, 60)[s]


def _stain(x, s, rng):
    y = _hsv(x)
    y[..., 0] = (y[..., 0] + 15) % 360
    y[..., 2] *= 0.85
    share = (0.10, 0.25, 0.40)[s]
    return (1 - share) * x + share * _rgb(y)


def _filtered(x: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    reach = len(taps) // 2
    pad = [(0, 0)] * x.ndim
    pad[axis] = (reach, len(taps) - 1 - reach)
    y = np.pad(x, pad, mode="reflect")
    return sum(t * np.take(y, np.arange(k, k + x.shape[axis]), axis) for k, t in enumerate(taps))


def _gaussian(x, s, rng):
    size, sigma = ((3, 1), (5, 2), (7, 3))[s]
    taps = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    return _filtered(_filtered(x, taps / taps.sum(), -3), taps / taps.sum(), -2)


def _motion(x, s, rng):
    return _filtered(x, np.full((5, 10, 15)[s], 1 / (5, 10, 15)[s]), -2)


def _salt_pepper(x, s, rng):
    draw, share = rng.random(x.shape), (0.01, 0.03, 0.05)[s]
    return np.where(draw < share / 2, 0, np.where(draw < share, 255, x))


def _sampled(x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Bilinear values at fractional places, edges repeated; places are a stack's own or common to it."""
    n, m = x.shape[-3:-1]
    rows, cols = np.clip(rows, 0, n - 1), np.clip(cols, 0, m - 1)
    r, c = np.floor(rows).astype(int), np.floor(cols).astype(int)
    r1, c1 = np.minimum(r + 1, n - 1), np.minimum(c + 1, m - 1)
    fr, fc = (rows - r)[..., None], (cols - c)[..., None]
    own = np.arange(len(x))[:, None, None] if rows.ndim == 3 else ...
    at = lambda i, j: x[own, i, j, :]
    return (1 - fr) * ((1 - fc) * at(r, c) + fc * at(r, c1)) + fr * ((1 - fc) * at(r1, c) + fc * at(r1, c1))


def _scale(x, s, rng):
    factor = (0.8, 1.2, 1.5)[s]
    n, m = x.shape[-3:-1]
    rows, cols = np.meshgrid((np.arange(n) - (n - 1) / 2) / factor + (n - 1) / 2, (np.arange(m) - (m - 1) / 2) / factor + (m - 1) / 2, indexing="ij")
    inside = (rows > -0.5) & (rows < n - 0.5) & (cols > -0.5) & (cols < m - 0.5)
    return np.where(inside[..., None], _sampled(x, rows, cols), 255)


def _mirrored(x: np.ndarray, n: int) -> np.ndarray:
    """Places outside 0 to n - 1 reflected at the outermost pixels."""
    period = max(2 * (n - 1), 1)
    x = np.abs(x) % period
    return np.where(x > n - 1, period - x, x)


def _elastic(x, s, rng):
    n, m = x.shape[-3:-1]
    moves = rng.normal(0, (0.5, 1.25, 2.0)[s], (*x.shape[:-3], 3, 3, 2))
    at = np.meshgrid(np.linspace(0, 2, n), np.linspace(0, 2, m), indexing="ij")
    field = _sampled(moves, *at)
    rows, cols = np.meshgrid(np.arange(n), np.arange(m), indexing="ij")
    return _sampled(x, _mirrored(rows + field[..., 0], n), _mirrored(cols + field[..., 1], m))


def _area(x: np.ndarray, by: int) -> np.ndarray:
    n, m = x.shape[-3] // by, x.shape[-2] // by
    return x[..., : n * by, : m * by, :].reshape(*x.shape[:-3], n, by, m, by, 3).mean((-4, -2))


def _coarse(x, s, rng):
    """Area means over blocks, then bilinear back."""
    by = (2, 4, 8)[s]
    rows, cols = np.meshgrid((np.arange(x.shape[-3]) + 0.5) / by - 0.5, (np.arange(x.shape[-2]) + 0.5) / by - 0.5, indexing="ij")
    return _sampled(_area(x, by), rows, cols)


def _cubic(x: np.ndarray, a: float) -> np.ndarray:
    x = np.abs(x)
    return np.where(x <= 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, (((x - 5) * x + 8) * x - 4) * a, 0))


def _cubic_weights(size: int, into: int, a: float, smooth: bool) -> np.ndarray:
    """Weights of ``size`` pixels (columns) in each of ``into`` (rows). With ``smooth`` the kernel widens when pixels
    become fewer and weights of what lies outside are dealt to the rest; else outer pixels are repeated."""
    step = size / into
    wide = max(step, 1.0) if smooth else 1.0
    out = np.zeros((into, size))
    for k in range(into):
        centre = (k + 0.5) * step - 0.5
        at = np.arange(int(np.floor(centre - 2 * wide)), int(np.ceil(centre + 2 * wide)) + 1)
        w = _cubic((at - centre) / wide, a)
        if smooth:
            w = np.where((at >= 0) & (at < size), w, 0)
        np.add.at(out[k], np.clip(at, 0, size - 1), w)
        out[k] /= out[k].sum()
    return out


def _coarse_cubic(x, s, rng):
    """Area means over blocks, then bicubic back."""
    small = _area(x, (2, 4, 8)[s])
    rows, cols = (_cubic_weights(small.shape[k], x.shape[k], -0.75, False) for k in (-3, -2))
    return np.einsum("ra,...abc,sb->...rsc", rows, small, cols, optimize=True)


def fit_tile(x: np.ndarray, edge: int = 224) -> np.ndarray:
    """An image of any size, or a stack of such, as ``edge`` x ``edge`` pixels, bicubic; one of that size stays as it is."""
    if x.shape[-3:-1] == (edge, edge):
        return x
    rows, cols = (_cubic_weights(x.shape[k], edge, -0.5, True) for k in (-3, -2))
    return _bytes(np.einsum("ra,...abc,sb->...rsc", rows, x.astype(float), cols, optimize=True))


def fine_rotation(x: np.ndarray, s: int) -> np.ndarray:
    """5, 10 or 15 degrees counter-clockwise about the centre, bilinear, white outside; not part of the registry."""
    angle = np.radians((5, 10, 15)[s])
    n, m = x.shape[-3:-1]
    dr, dc = np.meshgrid(np.arange(n) - (n - 1) / 2, np.arange(m) - (m - 1) / 2, indexing="ij")
    rows, cols = dr * np.cos(angle) + dc * np.sin(angle) + (n - 1) / 2, dc * np.cos(angle) - dr * np.sin(angle) + (m - 1) / 2
    inside = (rows >= 0) & (rows <= n - 1) & (cols >= 0) & (cols <= m - 1)
    return _bytes(np.where(inside[..., None], _sampled(x.astype(float), rows, cols), 255))


def sharpened(x: np.ndarray, factor: float) -> np.ndarray:
    """A blend with the 3 x 3 smoothed tile (centre weight 5 of 13), edges kept; factor 1 is the tile itself."""
    y = x.copy()
    n, m = x.shape[-3:-1]
    y[..., 1:-1, 1:-1, :] = (sum(x[..., 1 + a : n - 1 + a, 1 + b : m - 1 + b, :] for a in (-1, 0, 1) for b in (-1, 0, 1)) + 4 * x[..., 1:-1, 1:-1, :]) / 13
    return factor * x + (1 - factor) * y


def _smoother(x, s, rng):
    return sharpened(x, (0.5, 0.25, 0.05)[s])


def gray(x: np.ndarray) -> np.ndarray:
    return x @ np.array([0.299, 0.587, 0.114])


def _contrast(x, s, rng):
    factor, level = (0.7, 1.0, 1.3)[s], np.floor(np.round(gray(x).mean((-2, -1)), 9) + 0.5)[..., None, None, None]
    return level + factor * (x - level)


# The quantisation tables of the JPEG standard's annex, luma and chroma.
LUMA = """16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"""
CHROMA = """17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99"""
#: Rows: luma and the two chroma planes of red, green and blue.
PLANES = ((0.299, 0.587, 0.114), (-0.168736, -0.331264, 0.5), (0.5, -0.418688, -0.081312))
JPEG_QUALITY = (80, 50, 20)


def jpeg_steps(table: str, quality: int) -> list[int]:
    """A table's 64 quantisation steps at a quality from 1 to 100."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [min(max((int(v) * scale + 50) // 100, 1), 255) for v in table.split()]


def _jpeg(x, s, rng):
    """The lossy part of a JPEG round trip: 8 x 8 cosine coefficients of luma and chroma, quantised by quality. Sides
    that are no multiple of 8 are continued by their last pixels. Chroma keeps its resolution."""
    k = np.arange(8)
    basis = np.sqrt(np.where(k[:, None] == 0, 1, 2) / 8) * np.cos((2 * k + 1) * k[:, None] * np.pi / 16)
    steps = np.stack([np.reshape(jpeg_steps(t, JPEG_QUALITY[s]), (8, 8)) for t in (LUMA, CHROMA, CHROMA)], -1)
    to = np.array(PLANES)
    n, m = x.shape[-3:-1]
    y = np.pad(x, [(0, 0)] * (x.ndim - 3) + [(0, -n % 8), (0, -m % 8), (0, 0)], mode="edge") @ to.T
    y[..., 0] -= 128
    blocks = y.reshape(*y.shape[:-3], y.shape[-3] // 8, 8, y.shape[-2] // 8, 8, 3)
    c = np.einsum("ia,...pajbc,kb->...pijkc", basis, blocks, basis, optimize=True) / steps[None, :, None]
    c = np.floor(np.round(c, 6) + 0.5) * steps[None, :, None]
    y = np.einsum("ia,...pijkc,kb->...pajbc", basis, c, basis, optimize=True).reshape(y.shape)
    y[..., 0] += 128
    return (y @ np.linalg.inv(to).T)[..., :n, :m, :]


#: id -> name, category, kernel. Ids, names and categories are those of the audited study.
REGISTRY = {
    1: ("HE_Intensity_Variation", "colour_staining", _scaled(2, (1.10, 1.25, 1.40))),
    2: ("Colour_Channel_Shift", "colour_staining", lambda x, s, rng: x + (5, 15, 30)[s]),
    3: ("Saturation_Adjustment", "colour_staining", _scaled(1, (0.7, 1.0, 1.3))),
    4: ("Hue_Rotation", "colour_staining", _in_hsv(_hue)),
    5: ("Stain_Normalisation_Failure", "colour_staining", _stain),
    6: ("Gaussian_Blur", "imaging_artefacts", _gaussian),
    7: ("Motion_Blur", "imaging_artefacts", _motion),
    8: ("Gaussian_Noise", "imaging_artefacts", lambda x, s, rng: x + rng.normal(0, (5, 15, 30)[s], x.shape)),
    9: ("Salt_Pepper_Noise", "imaging_artefacts", _salt_pepper),
    10: ("JPEG_Compression", "imaging_artefacts", _jpeg),
    11: ("Rotation", "geometric", lambda x, s, rng: np.rot90(x, s + 1, (-3, -2))),
    12: ("Scaling", "geometric", _scale),
    13: ("Elastic_Deformation", "geometric", _elastic),
    14: ("Downsample_Upsample", "resolution_quality", _coarse),
    15: ("Resolution_Degradation_MPP", "resolution_quality", _coarse_cubic),
    16: ("Sharpness_Reduction", "resolution_quality", _smoother),
    17: ("Brightness_Adjustment", "lighting", lambda x, s, rng: x * (0.7, 1.0, 1.3)[s]),
    18: ("Contrast_Adjustment", "lighting", _contrast),
}
#: Kernels that take a stack of tiles at once; those registered later take one tile.
_STACKED = {k: v[2] for k, v in REGISTRY.items()}


def register(perturbation_id: int, name: str, category: str, kernel) -> None:
    """Adds a kernel ``(pixels, severity's place, draws) -> pixels`` to the registry, which jobs carry to their workers.
    An id that is taken is an error."""
    if perturbation_id in REGISTRY:
        raise ValueError(f"perturbation {perturbation_id} is {REGISTRY[perturbation_id][0]}")
    REGISTRY[perturbation_id] = (name, category, kernel)


def _bytes(x: np.ndarray) -> np.ndarray:
    """Rounded half up; what differs from a half by rounding errors only counts as one."""
    return np.clip(np.floor(np.round(x, 6) + 0.5), 0, 255).astype(np.uint8)


# Rows beside the grid, which compare another factor and the tile itself with perturbation 16.
EXTRA = {(16, "severe_alt_0.10"): 0.10, (16, "reference_1.0"): 1.0}
#: Kernels of rows beside the grid, by perturbation and label.
VARIANTS = {cell: (lambda x, factor=factor: sharpened(x, factor)) for cell, factor in EXTRA.items()}


def apply(tile: np.ndarray, perturbation_id: int, severity: str, seed: str | list[str] = "", registry: dict | None = None) -> np.ndarray:
    """One tile (rows, columns, 3) of bytes through one kernel, or a variant beside the grid; the same seed gives the same
    bytes. A stack of tiles has a list of seeds and a kernel that takes stacks."""
    if (perturbation_id, severity) in VARIANTS:
        return _bytes(VARIANTS[perturbation_id, severity](tile.astype(float)))
    place = SEVERITIES.index(severity)
    if perturbation_id == 3 and place == 1:
        return tile  # as defined: moderate saturation is the identity
    of = lambda name: f"{name}|{perturbation_id}|{severity}"
    draws = Draws(of(seed) if isinstance(seed, str) else [of(x) for x in seed])
    return _bytes((registry or REGISTRY)[perturbation_id][2](tile.astype(float), place, draws))


def laplacian_var(x: np.ndarray) -> np.ndarray:
    g = np.pad(gray(x), [(0, 0)] * (x.ndim - 3) + [(1, 1)] * 2, mode="reflect")
    return (g[..., :-2, 1:-1] + g[..., 2:, 1:-1] + g[..., 1:-1, :-2] + g[..., 1:-1, 2:] - 4 * g[..., 1:-1, 1:-1]).var((-2, -1))


def ssim(a: np.ndarray, b: np.ndarray, window: int = 7) -> np.ndarray:
    """Mean over channels and all windows of the structural similarity with sample covariances."""
    view = lambda x: np.lib.stride_tricks.sliding_window_view(x.astype(float), (window, window), (-3, -2))
    p, q, of, n = view(a), view(b), (-2, -1), window * window
    mp, mq = p.mean(of), q.mean(of)
    dp, dq = p - mp[..., None, None], q - mq[..., None, None]
    vp, vq, cov = ((x * y).sum(of) / (n - 1) for x, y in ((dp, dp), (dq, dq), (dp, dq)))
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return ((2 * mp * mq + c1) * (2 * cov + c2) / ((mp**2 + mq**2 + c1) * (vp + vq + c2))).mean((-3, -2, -1))


def _measured(a: np.ndarray, b: np.ndarray) -> list[pa.Array]:
    """Columns of the metrics of a stack against another."""
    base, var, gap, g = laplacian_var(a), laplacian_var(b), a.astype(float) - b, gray(b.astype(float))
    mse, size = (gap**2).mean((-3, -2, -1)), g[0].size
    levels = np.floor(np.round(g, 6) + 0.5).astype(int).reshape(len(b), -1) + 256 * np.arange(len(b))[:, None]
    share = np.bincount(levels.ravel(), minlength=256 * len(b)).reshape(len(b), 256) / size
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(-1)
    percent = np.where(base > 0, 100 * var / np.where(base > 0, base, 1), np.nan)
    decibels = np.where(mse > 0, 10 * np.log10(65025 / np.where(mse > 0, mse, 1)), np.inf)
    return [pa.array(x) for x in (var, percent, ssim(a, b), decibels, np.abs(gap).mean((-3, -2, -1)), entropy, g.mean((-2, -1)), g.std((-2, -1)))]


_METRICS = ["laplacian_var", "laplacian_pct_of_orig", "ssim", "psnr", "mean_abs_diff", "entropy", "mean_intensity", "std_intensity"]
#: Pixel values of the tiles that are worked on at once, about.
_AT_ONCE = 1 << 17


def _packed(made: np.ndarray) -> list[pa.Array]:
    flat = np.ascontiguousarray(made).reshape(len(made), -1)
    return [pa.FixedSizeBinaryArray.from_buffers(pa.binary(flat.shape[1]), len(flat), [None, pa.py_buffer(flat)]).cast(pa.binary())]


def _job(tiles: DataFrame, grid: DataFrame, names: list[str], kinds: list, work, done: DataFrame | None = None) -> DataFrame:
    """Every tile through every cell of the grid (a table of some dozen rows) but those in ``done``; an exception is an
    ERROR row. A tile comes to its task once, with the numbers of its cells, and a cell's kernel takes tiles in stacks."""
    spark = tiles.sparkSession
    cells = [tuple(r) for r in grid.select("perturbation_id", "severity").collect()]
    rows, every = tiles.select("sample_id", "red", "green", "blue"), F.array(*map(F.lit, range(len(cells))))
    if done is None:
        rows = rows.withColumn("cells", every)
    else:
        numbered = spark.createDataFrame([(*c, k) for k, c in enumerate(cells)], "perturbation_id int, severity string, cell int")
        held = done.join(F.broadcast(numbered), ["perturbation_id", "severity"]).groupBy("sample_id").agg(F.collect_set("cell").alias("held"))
        left = F.coalesce(F.array_except(every, "held"), every)
        rows = rows.join(held, "sample_id", "left").select("sample_id", "red", "green", "blue", left.alias("cells")).filter(F.size("cells") > 0)

    registry = dict(REGISTRY)  # as it is now, on the driver
    stacked = {k for k, v in registry.items() if v[2] is _STACKED.get(k)}

    def each(stack, cell, seeds):
        """Status, notes and columns of a stack's tiles in one cell: at once, or, if that fails, one by one."""
        pid, severity = cell
        try:
            if cell in VARIANTS or pid in stacked:
                return ["DONE"] * len(stack), [""] * len(stack), work(stack, apply(stack, pid, severity, seeds, registry))
        except (ValueError, IndexError, KeyError, FloatingPointError):
            pass
        out = []
        for tile, seed in zip(stack, seeds, strict=True):
            try:
                out.append(("DONE", "", work(tile[None], apply(tile, pid, severity, seed, registry)[None])))
            except (ValueError, IndexError, KeyError, FloatingPointError) as error:
                out.append(("ERROR", str(error)[:200], [pa.nulls(1, k) for k in kinds]))
        status, notes, columns = zip(*out, strict=True)
        return status, notes, [pa.concat_arrays(x) for x in zip(*columns, strict=True)]

    def run(batches):
        for batch in batches:
            channels = [np.array(batch.column(c).flatten()).reshape(batch.num_rows, -1) for c in ("red", "green", "blue")]
            edge = int(round(channels[0].shape[1] ** 0.5))
            step = max(1, _AT_ONCE // max(1, 3 * edge * edge))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, tile = part.column("sample_id").to_pylist(), np.stack([c[at : at + step].reshape(-1, edge, edge) for c in channels], -1).astype(np.uint8)
                wanted = part.column("cells")
                owner, number = np.array(wanted.value_parent_indices()), np.array(wanted.flatten())
                out = []
                for cell in np.unique(number).tolist():
                    mine = owner[number == cell]
                    seeds = [ids[k] for k in mine]
                    status, notes, columns = each(tile[mine], cells[cell], seeds)
                    pid, severity = cells[cell]
                    out.append([pa.array(seeds, pa.string()), pa.array([pid] * len(mine), pa.int32()), pa.array([severity] * len(mine)), pa.array(status), pa.array(notes, pa.string()), *columns])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*out, strict=True)], ["sample_id", "perturbation_id", "severity", "status", "notes", *names])

    types = {pa.binary(): "binary", pa.float64(): "double"}
    schema = ", ".join(["sample_id string, perturbation_id int, severity string, status string, notes string", *(f"{n} {types[k]}" for n, k in zip(names, kinds, strict=True))])
    return rows.mapInArrow(run, schema)


def perturb(tiles: DataFrame, grid: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """``sample_id, perturbation_id, severity, status, notes, data``: pixels row by row, three bytes each.

    Cells that ``done`` (an earlier result) holds with status DONE are not computed again: their rows say
    SKIPPED_EXISTING and have no data."""
    made = lambda d: _job(tiles, grid, ["data"], [pa.binary()], lambda a, b: _packed(b), d)
    if done is None:
        return made(None)
    held = done.filter("status = 'DONE'").select("sample_id", "perturbation_id", "severity").distinct()
    skipped = held.select("*", F.lit("SKIPPED_EXISTING").alias("status"), F.lit("").alias("notes"), F.lit(None).cast("binary").alias("data"))
    return made(held).unionByName(skipped)


def diagnostics(tiles: DataFrame, grid: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """The eight quality metrics of every tile and cell against the unperturbed tile; rows that ``done`` has, with
    whatever status, are not computed again."""
    keys = None if done is None else done.select("sample_id", "perturbation_id", "severity").distinct()
    return _job(tiles, grid, _METRICS, [pa.float64()] * len(_METRICS), _measured, keys)


def extra_cells(spark) -> DataFrame:
    """The cells beside the grid: two rows."""
    return spark.createDataFrame(list(EXTRA), "perturbation_id int, severity string")


def report(tiles: DataFrame, grid: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Rows of the diagnostics' report that ``done`` lacks: a cell's name, category and parameter, status OK or ERROR with
    its notes (metrics are null then), and the metrics, for the grid and the cells beside it."""
    cells = grid.select("perturbation_id", "severity").unionByName(extra_cells(tiles.sparkSession))
    made = diagnostics(tiles, cells, done)
    p = F.col("perturbation_id")
    named = F.create_map(*[x for k, v in REGISTRY.items() for x in (F.lit(k), F.array(F.lit(v[0]), F.lit(v[1])))])
    beside = F.create_map(*[x for (k, label), v in EXTRA.items() for x in (F.lit(f"{k} {label}"), F.lit(v))])
    cell = F.concat_ws(" ", p, "severity")
    status = F.when(F.col("status") == "DONE", "OK").otherwise(F.col("status"))
    notes = F.when((status == "OK") & F.map_contains_key(beside, cell), "diagnostic-only comparison row").otherwise(F.col("notes"))
    value = F.coalesce(F.try_element_at(beside, cell), F.when(status == "OK", param_of(p, F.col("severity"))))
    return made.select(
        "sample_id", "perturbation_id", F.get(F.try_element_at(named, p), F.lit(0)).alias("name"), F.get(F.try_element_at(named, p), F.lit(1)).alias("category"), "severity",
        value.alias("param_value"), status.alias("status"), notes.alias("notes"), *_METRICS,
    )


def resume_report(tiles: DataFrame, grid: DataFrame, path: str) -> int:
    """Appends to the report at ``path`` the rows it lacks, and says how many these are. Rows of errors are kept and not
    tried again."""
    spark = tiles.sparkSession
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
    before = spark.read.parquet(path).count() if there else 0
    report(tiles, grid, spark.read.parquet(path) if there else None).write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def held_out_test(tiles: DataFrame, decimals: int = 6) -> DataFrame:
    """The paired test of horizontal against vertical flips by cohort, on similarities of pixel vectors."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    t = tiles.withColumn("h", flip_h("red")).withColumn("v", flip_v("red"))
    conditions = F.array(F.struct(F.lit("flip_h").alias("condition"), F.round(dot("red", "h") / dot("red", "red"), decimals).alias("similarity")), F.struct(F.lit("flip_v").alias("condition"), F.round(dot("red", "v") / dot("red", "red"), decimals).alias("similarity")))
    long = t.select("sample_id", "cohort", F.explode(conditions).alias("c")).select("sample_id", "cohort", "c.*")
    return families.wilcoxon_signed_rank(families.paired_conditions(long, ["cohort"], "sample_id", "condition", "flip_h", "flip_v", "similarity"), ["cohort"])
