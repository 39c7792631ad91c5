"""Column expressions: everything that needs one row only. All stay in code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names and the order that results are reported in.
DIMENSIONS = ("ai_model", "spectral", "diffusion", "temporal", "exif", "web_intel")

# A generator's family is that of the first name here that its lower-cased name holds.
FAMILIES = {
    "stylegan": "gan",
    "stylegan2": "gan",
    "stylegan3": "gan",
    "progan": "gan",
    "sdxl": "diffusion",
    "sd15": "diffusion",
    "midjourney": "diffusion",
    "flux": "diffusion",
    "dalle": "diffusion",
    "dit": "diffusion",
    "faceswap": "faceswap",
    "deepfacelab": "faceswap",
    "simswap": "faceswap",
    "inswapper": "faceswap",
    "faceshifter": "faceswap",
    "reenact": "reenactment",
    "fomm": "reenactment",
    "heygen": "reenactment",
    "wav2lip": "lipsync",
    "authentic": "authentic",
    "kokoro": "tts_styletts2",
    "piper": "tts_vits",
}


def clip(x: Column, lo: float, hi: float) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    p = clip(p, eps, 1 - eps)
    return F.log(p / (1 - p))


def sigmoid(z: Column) -> Column:
    """In two branches, so that exp never overflows."""
    return F.when(z >= 0, 1 / (1 + F.exp(-F.abs(z)))).otherwise(F.exp(-F.abs(z)) / (1 + F.exp(-F.abs(z))))


def verdict(p: Column, synthetic: float = 0.85, suspicious: float = 0.5) -> Column:
    return F.when(p >= synthetic, "SYNTHETIC").when(p >= suspicious, "SUSPICIOUS").otherwise("AUTHENTIC")


def card_verdict(p: Column, available: Column, dimension: Column) -> Column:
    return F.when(available, verdict(p)).when(dimension == "exif", "STRIPPED").otherwise("PLAUSIBLE")


def quality_bucket(q: Column) -> Column:
    return F.when(q.isNull(), "native").when(q >= 90, "q_high").when(q >= 65, "q_mid").otherwise("q_low")


def family_of(generator: Column, families: dict[str, str] = FAMILIES) -> Column:
    low, out = F.lower(generator), F.lit("unknown")
    for name, family in reversed(families.items()):
        out = F.when(F.instr(low, name) > 0, family).otherwise(out)
    return out


def normalise_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def normalise_text(text: Column) -> Column:
    """Sentence case with a full stop unless it ends a sentence; empty texts raise."""
    t = F.trim(text)
    s = F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 2147483647)))
    return F.when(F.length(t) == 0, F.raise_error(F.lit("empty text"))).otherwise(F.when(s.rlike("[.?!]$"), s).otherwise(F.concat(s, F.lit("."))))


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def ece_bin(p: Column, n_bins: int = 15) -> Column:
    """0-based bin of (lo, hi], the first one closed below."""
    edges = [i / float(n_bins) for i in range(1, n_bins)]
    return sum((F.when(p > e, 1).otherwise(0) for e in edges), F.lit(0))


def gaussian_llr(z: Column, m0: Column, s0: Column, m1: Column, s1: Column) -> Column:
    def density(m, s):
        return -0.5 * F.log(2 * math.pi * s * s) - 0.5 * ((z - m) / s) * ((z - m) / s)

    return density(m1, s1) - density(m0, s0)


def band(posterior: Column, sigma0: Column, sigma1: Column, threshold: float = 0.5, abstain_sigma: float = 3.0) -> Column:
    return F.when(F.least(sigma0, sigma1) > abstain_sigma, "ABSTAIN").when(posterior >= threshold, "SYNTHETIC").otherwise("AUTHENTIC")


def cosine_schedule(step: Column, total: int, warmup_frac: float = 0.1) -> Column:
    """Learning-rate multiplier: linear from 0 over the warm-up, then half a cosine down to 0."""
    warm = max(1, int(total * warmup_frac))
    progress = (step - warm) / F.lit(float(max(1, total - warm)))
    return F.when(step < warm, step / F.lit(float(warm))).otherwise(0.5 * (1 + F.cos(math.pi * F.least(F.lit(1.0), progress))))


def mu_law(x: Column, mu: float = 255.0) -> Column:
    """Compand, round half to even on the 8-bit grid, expand."""
    x = clip(x, -1, 1)
    y = F.signum(x) * F.log1p(mu * F.abs(x)) / math.log1p(mu)
    q = F.rint((y + 1) / 2 * mu) / mu * 2 - 1
    return F.signum(q) * F.expm1(F.abs(q) * math.log1p(mu)) / mu


def hash_uniform(*parts) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by '|': 8 hexadecimal digits of it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
