"""Image degradation as column expressions over arrays of pixels, in row order; no Python worker.

Grey images are one plane of height x width numbers from 0 to 255, colour images three planes, red,
green and blue, one after another. A re-encoding is what a block codec loses: 8 x 8 blocks, a cosine
transform, rounding to the steps of a quality, and back; no codec is needed for that.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash_uniform
from .signals import _with, normal

MENU = ("jpeg", "rescale", "blur", "noise", "contrast", "saturation", "jpeg2")
# The public luminance steps of quality 50, in row order.
STEPS_50 = (
    (16, 11, 10, 16, 24, 40, 51, 61),
    (12, 12, 14, 19, 26, 58, 60, 55),
    (14, 13, 16, 24, 40, 57, 69, 56),
    (14, 17, 22, 29, 51, 87, 80, 62),
    (18, 22, 37, 56, 68, 109, 103, 77),
    (24, 35, 55, 64, 81, 104, 113, 92),
    (49, 64, 78, 87, 103, 121, 120, 101),
    (72, 92, 95, 98, 112, 100, 103, 99),
)
# Severity -> operators, quality, scale, blur radius and noise of a recipe, from and to.
SEVERITIES = {
    "light": {"k": (1, 2), "jpeg": (80, 95), "rescale": (0.85, 1.0), "blur": (0.0, 0.5), "noise": (0.0, 2.0)},
    "medium": {"k": (2, 3), "jpeg": (55, 80), "rescale": (0.6, 0.9), "blur": (0.3, 1.2), "noise": (1.0, 5.0)},
    "heavy": {"k": (3, 5), "jpeg": (25, 55), "rescale": (0.35, 0.7), "blur": (0.8, 2.5), "noise": (3.0, 10.0)},
}
ENHANCE = (0.8, 1.25)
# The qualities of a robustness curve.
QUALITIES = (95, 85, 75, 65, 55, 45, 35, 25)


def dct_matrix(n: int = 8) -> np.ndarray:
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * x + 1) * k / (2 * n))
    m[0] /= np.sqrt(2)
    return m


def _literal(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in np.asarray(values).ravel()))


def _sum(n: int, term) -> Column:
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda s, i: s + term(i))


def _each(n: int | Column, f) -> Column:
    last = F.lit(n - 1) if isinstance(n, int) else n - 1
    return F.transform(F.sequence(F.lit(0), last), f)


def product(left: Column, x: Column, right: Column, n: int = 8) -> Column:
    """left * x * right' for n x n matrices in row order: one side after the other."""
    at = lambda m, i, j: m[i * n + j]
    half = _with(x, lambda x: _each(n * n, lambda p: _sum(n, lambda i: at(left, F.floor(p / n).cast("int"), i) * at(x, i, p % n))))
    return _with(half, lambda y: _each(n * n, lambda p: _sum(n, lambda j: at(y, F.floor(p / n).cast("int"), j) * at(right, p % n, j))))


def steps(quality: Column) -> Column:
    """The 64 rounding steps of a quality from 1 to 100."""
    scale = F.when(quality < 50, F.floor(5000 / quality)).otherwise(200 - 2 * quality)
    return F.transform(_literal(STEPS_50), lambda b: F.greatest(F.lit(1.0), F.least(F.lit(255.0), F.floor((b * scale + 50) / 100).cast("double"))))


def requantised(block: Column, quality: Column) -> Column:
    """An 8 x 8 block (64 numbers) after transform, rounding (half to even) and back, clipped to whole pixels."""
    m = dct_matrix()
    to, back = _literal(m), _literal(m.T)
    spectrum = product(to, F.transform(block, lambda v: v.cast("double") - 128), to)
    kept = _with(steps(quality), lambda q: _with(spectrum, lambda y: F.zip_with(y, q, lambda c, s: F.rint(c / s) * s)))
    return F.transform(product(back, kept, back), lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(v + 128))))


def reencoded(x: Column, height: int, width: int, quality: Column) -> Column:
    """A plane put through `requantised` block by block; sides are multiples of 8."""
    if height % 8 or width % 8:
        raise ValueError("sides must be multiples of 8")
    if (height, width) == (8, 8):
        return requantised(x, quality)
    across = width // 8
    cut = lambda x, b: _each(64, lambda p: x[(F.floor(b / across).cast("int") * 8 + F.floor(p / 8).cast("int")) * width + b % across * 8 + p % 8])
    blocks = _with(x, lambda x: _each(height * across // 8, lambda b: requantised(cut(x, b), quality)))
    place = lambda p: (F.floor(p / (8 * width)).cast("int") * across + F.floor(p % width / 8).cast("int"), F.floor(p / width).cast("int") % 8 * 8 + p % 8)
    return _with(blocks, lambda all_: _each(height * width, lambda p: all_[place(p)[0]][place(p)[1]]))


def bilinear(x: Column, h: int | Column, w: int | Column, to_h: Column, to_w: Column) -> Column:
    """Sampled between the four nearest pixels, edges held."""
    h, w = (F.lit(v) if isinstance(v, int) else v for v in (h, w))
    inside = lambda v, n: F.greatest(F.lit(0.0), F.least(v, (n - 1).cast("double")))

    def one(x, p):
        r = inside((F.floor(p / to_w) + 0.5) * h / to_h - 0.5, h)
        c = inside((p % to_w + 0.5) * w / to_w - 0.5, w)
        r0, c0 = F.floor(r).cast("int"), F.floor(c).cast("int")
        r1, c1 = F.least(r0 + 1, h - 1), F.least(c0 + 1, w - 1)
        fr, fc = r - r0, c - c0
        return (x[r0 * w + c0] * (1 - fc) + x[r0 * w + c1] * fc) * (1 - fr) + (x[r1 * w + c0] * (1 - fc) + x[r1 * w + c1] * fc) * fr

    return _with(x, lambda x: _each(to_h * to_w, lambda p: one(x, p)))


def rescaled(x: Column, height: int, width: int, factor: Column) -> Column:
    """Down to factor (8 pixels a side at least) and up again."""
    h, w = (F.greatest(F.lit(8), F.floor(n * factor).cast("int")) for n in (height, width))
    return _with(F.struct(h.alias("h"), w.alias("w")), lambda s: bilinear(bilinear(x, height, width, s["h"], s["w"]), s["h"], s["w"], F.lit(height), F.lit(width)))


def blurred(x: Column, height: int, width: int, radius: Column) -> Column:
    """Gaussian of a deviation, cut at three deviations (one pixel at least), by rows and by columns; edges held."""
    n = F.greatest(F.lit(1), F.floor(3 * radius).cast("int"))
    raw = F.transform(F.sequence(-n, n), lambda i: F.exp(-0.5 * (i / F.greatest(radius, F.lit(1e-6))) * (i / F.greatest(radius, F.lit(1e-6)))))
    kernel = _with(raw, lambda k: _with(F.aggregate(k, F.lit(0.0), lambda s, v: s + v), lambda t: F.transform(k, lambda v: v / t)))

    def along(x, k, rows: bool):
        reach = F.floor(F.size(k) / 2).cast("int")
        held = lambda v, top: F.greatest(F.lit(0), F.least(v, F.lit(top - 1)))
        row, col = (lambda p: F.floor(p / width).cast("int")), (lambda p: p % width)
        at = (lambda p, i: held(row(p) + i - reach, height) * width + col(p)) if rows else (lambda p, i: row(p) * width + held(col(p) + i - reach, width))
        return _each(height * width, lambda p: F.aggregate(F.sequence(F.lit(0), F.size(k) - 1), F.lit(0.0), lambda s, i: s + k[i] * x[at(p, i)]))

    return _with(kernel, lambda k: _with(_with(x, lambda x: along(x, k, True)), lambda y: along(y, k, False)))


def _byte(v: Column) -> Column:
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))).cast("double")


def noisy(x: Column, sigma: Column, seed: Column) -> Column:
    """Normal noise of hashes of the seed and the pixel's number, cut to whole pixels."""
    return F.transform(x, lambda v, i: _byte(v + sigma * normal(seed, i.cast("string"))))


def contrasted(x: Column, factor: Column) -> Column:
    """Away from (or towards) the rounded mean by a factor."""
    mean = F.rint(F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x))
    return _with(mean, lambda m: F.transform(x, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), m + (v - m) * factor))))


def saturated(x: Column, pixels: int, factor: Column) -> Column:
    """Three planes away from (or towards) their grey by a factor; a grey image stays as it is."""
    grey = lambda x, p: 0.299 * x[p] + 0.587 * x[p + pixels] + 0.114 * x[p + 2 * pixels]
    one = lambda x, i: F.greatest(F.lit(0.0), F.least(F.lit(255.0), _with(grey(x, i % pixels), lambda g: g + (x[i] - g) * factor)))
    return _with(x, lambda x: F.when(F.size(x) == 3 * pixels, _each(3 * pixels, lambda i: one(x, i))).otherwise(x))


def moire(x: Column, width: int, period: Column, amplitude: Column) -> Column:
    """A sine field across the columns, as of a photographed screen, cut to whole pixels."""
    return F.transform(x, lambda v, p: _byte(v + F.sin(p % width * F.lit(2 * math.pi) / period) * amplitude))


def screenshot(x: Column, height: int, width: int, period: Column, amplitude: Column, factor: Column, quality: Column) -> Column:
    """A moire field, a slight rescale, a re-encoding."""
    return reencoded(rescaled(moire(x, width, period, amplitude), height, width, factor), height, width, quality)


def _planes(x: Column, pixels: int, f) -> Column:
    """f on each plane of an image."""
    return _with(x, lambda x: F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / pixels).cast("int") - 1), lambda c: f(F.slice(x, c * pixels + 1, F.lit(pixels))))))


def recipe_steps(row_id: Column, seed: int = 0, p_screenshot: float = 0.1) -> Column:
    """severity and the steps (op, p: its parameter; text as it is logged) of a row, drawn from hashes of its id.

    Severities at 0.4, 0.4, 0.2. A screenshot may come first. Then operators of the menu without
    replacement, in the order of their hashes; `jpeg2` stands for a re-encoding at the very end. Blurs
    and noises too weak to see are left out.
    """
    u = lambda what: hash_uniform(F.lit(f"{seed}|{what}"), row_id.cast("string"))
    of = lambda what, i: F.when(u("severity") < 0.4, SEVERITIES["light"][what][i]).when(u("severity") < 0.8, SEVERITIES["medium"][what][i]).otherwise(SEVERITIES["heavy"][what][i])
    between = lambda what, op: of(what, 0) + (of(what, 1) - of(what, 0)) * u(f"p|{op}")
    quality = lambda op: F.floor(between("jpeg", op)).cast("double")
    enhance = lambda op: ENHANCE[0] + (ENHANCE[1] - ENHANCE[0]) * u(f"p|{op}")
    k = of("k", 0) + F.floor(u("k") * (of("k", 1) - of("k", 0) + 1))
    what = {
        "jpeg": ("jpeg", quality("jpeg"), "jpeg(q=%.0f)"),
        "rescale": ("rescale", between("rescale", "rescale"), "rescale(%.2f)"),
        "blur": ("blur", between("blur", "blur"), "blur(%.2f)"),
        "noise": ("noise", between("noise", "noise"), "noise(%.1f)"),
        "contrast": ("contrast", enhance("contrast"), "contrast(%.2f)"),
        "saturation": ("saturation", enhance("saturation"), "sat(%.2f)"),
        "jpeg2": ("jpeg", quality("jpeg2"), "jpeg(q=%.0f)"),
    }
    menu = [F.struct(u(f"order|{m}").alias("u"), (F.lit(m) == "jpeg2").alias("last"), F.lit(op).alias("op"), p.cast("double").alias("p"), F.format_string(text, p.cast("double")).alias("text")) for m, (op, p, text) in what.items()]
    picked = F.slice(F.array_sort(F.array(*menu)), F.lit(1), k.cast("int"))
    seen = F.filter(picked, lambda s: ~((s["op"] == "blur") & (s["p"] <= 0.05)) & ~((s["op"] == "noise") & (s["p"] <= 0.1)))
    bare = lambda s: F.struct(s["op"].alias("op"), s["p"].alias("p"), s["text"].alias("text"))
    ordered = _with(seen, lambda s: F.concat(F.transform(F.filter(s, lambda x: ~x["last"]), bare), F.transform(F.filter(s, lambda x: x["last"]), bare)))
    shot = F.when(u("screenshot") < p_screenshot, F.array(F.struct(F.lit("screenshot").alias("op"), F.lit(0.0).alias("p"), F.lit("screenshot_sim").alias("text")))).otherwise(F.array().cast("array<struct<op:string,p:double,text:string>>"))
    severity = F.when(u("severity") < 0.4, "light").when(u("severity") < 0.8, "medium").otherwise("heavy")
    return F.struct(severity.alias("severity"), F.concat(shot, ordered).alias("steps"))


def recipes(df: DataFrame, row_id: str, seed: int = 0, p_screenshot: float = 0.1) -> DataFrame:
    """id, severity, recipe: what each row goes through, with its parameters, as one line."""
    out = df.select(row_id, recipe_steps(F.col(row_id), seed, p_screenshot).alias("r"))
    text = F.concat_ws("|", F.concat(F.array(F.concat(F.lit("severity="), F.col("r.severity"))), F.transform("r.steps", lambda s: s["text"])))
    return out.select(row_id, F.col("r.severity").alias("severity"), text.alias("recipe"))


def degraded(df: DataFrame, row_id: str, pixels: str, height: int, width: int, seed: int = 0, p_screenshot: float = 0.1) -> DataFrame:
    """id, pixels, recipe: each image through the steps of its own recipe, a fold over them."""
    i, n = F.col(row_id), height * width
    u = lambda what: hash_uniform(F.lit(f"{seed}|{what}"), i.cast("string"))
    shot = (2.5 + 2.5 * u("s|period"), 2 + 4 * u("s|amplitude"), 0.7 + 0.25 * u("s|factor"), F.floor(55 + 30 * u("s|quality")))
    key = F.concat_ws("|", F.lit(f"{seed}|pixel"), i.cast("string"))

    def step(x, s):
        op, p = s["op"], s["p"]
        out = F.when(op == "jpeg", _planes(x, n, lambda y: reencoded(y, height, width, p))).when(op == "rescale", _planes(x, n, lambda y: rescaled(y, height, width, p)))
        out = out.when(op == "blur", _planes(x, n, lambda y: blurred(y, height, width, p))).when(op == "noise", noisy(x, p, key)).when(op == "contrast", contrasted(x, p))
        return out.when(op == "saturation", saturated(x, n, p)).otherwise(_planes(x, n, lambda y: screenshot(y, height, width, *shot)))

    drawn = df.select(row_id, F.transform(pixels, lambda v: v.cast("double")).alias("__x"), recipe_steps(i, seed, p_screenshot).alias("__r"))
    text = F.concat_ws("|", F.concat(F.array(F.concat(F.lit("severity="), F.col("__r.severity"))), F.transform("__r.steps", lambda s: s["text"])))
    return drawn.select(row_id, F.aggregate("__r.steps", F.col("__x"), step).alias(pixels), text.alias("recipe"))


def sweep(df: DataFrame, row_id: str, pixels: str, height: int, width: int, qualities: tuple[int, ...] = QUALITIES) -> DataFrame:
    """id, quality, pixels: each image re-encoded at every quality; a curve, not a number."""
    rows = df.select(row_id, F.col(pixels).alias("__x"), F.explode(F.array(*map(F.lit, qualities))).alias("quality"))
    return rows.select(row_id, "quality", reencoded(F.col("__x"), height, width, F.col("quality")).alias(pixels))
