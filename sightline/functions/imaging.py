"""Image transforms over arrays: frequency signatures, gradients, moments, watermarks, wavelets.

Pixels come decoded (Spark's image source or arrays). Resizing keeps to block means, so signatures
are equivalents of the algorithm, not bit-exact copies of a library's kernel.
"""

from __future__ import annotations

import hashlib
import math
import struct

import numpy as np

#: Watermark strength, bands of an 8x8 block, seed of the common sequence, wavelet step.
ALPHA, MASTER_SEED, WAVELET_STEP = 0.08, 0xDEADBEEF, 5.0
BANDS = (((2, 1), (1, 2), (3, 0), (0, 3)), ((1, 1), (2, 0), (0, 2)))


def dct_matrix(n: int) -> np.ndarray:
    """Orthonormal DCT-II."""
    k = np.arange(n)
    out = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n)) * math.sqrt(2 / n)
    out[0] /= math.sqrt(2)
    return out


def dct2(block: np.ndarray) -> np.ndarray:
    return dct_matrix(block.shape[0]) @ block @ dct_matrix(block.shape[1]).T


def idct2(block: np.ndarray) -> np.ndarray:
    return dct_matrix(block.shape[0]).T @ block @ dct_matrix(block.shape[1])


def unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v)
    return v / size if size > 0 else v


def resized(gray: np.ndarray, size: int) -> np.ndarray:
    """Mean of the pixels that fall into each of size x size cells; nearest pixel where there are fewer."""
    def edges(n: int) -> np.ndarray:
        return np.floor(np.arange(size + 1) * n / size).astype(int)

    sums = np.pad(np.asarray(gray, dtype=float).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    y, x = edges(gray.shape[0]), edges(gray.shape[1])
    y2, x2 = np.maximum(y[1:], y[:-1] + 1), np.maximum(x[1:], x[:-1] + 1)
    area = (y2 - y[:-1])[:, None] * (x2 - x[:-1])[None, :]
    return (sums[y2][:, x2] - sums[y[:-1]][:, x2] - sums[y2][:, x[:-1]] + sums[y[:-1]][:, x[:-1]]) / area


def signature_128(gray: np.ndarray) -> np.ndarray:
    """8 low frequencies of each of 16 regions, unit length."""
    whole = resized(gray, 256)
    regions = [whole[i : i + 64, j : j + 64] for i in range(0, 256, 64) for j in range(0, 256, 64)]
    values = np.concatenate([dct2(r)[:3, :3].ravel()[1:] for r in regions])
    return values / (np.linalg.norm(values) + 1e-8)


def signature_512(gray: np.ndarray) -> np.ndarray:
    """The first half of a 32x32 spectrum, unit length."""
    return unit(dct2(resized(gray, 32)).ravel()[:512])


def gradients_128(gray: np.ndarray) -> np.ndarray:
    """Histograms of 8 gradient directions in 16 cells, each normalized with clipping, then unit length."""
    g = resized(gray, 256)
    gy, gx = np.zeros_like(g), np.zeros_like(g)
    gy[1:-1], gx[:, 1:-1] = g[2:] - g[:-2], g[:, 2:] - g[:, :-2]
    size, angle = np.hypot(gx, gy), np.rad2deg(np.arctan2(gy, gx)) % 180
    cells = []
    for i in range(0, 256, 64):
        for j in range(0, 256, 64):
            bins = np.minimum((angle[i : i + 64, j : j + 64] / 22.5).astype(int), 7)
            h = np.bincount(bins.ravel(), weights=size[i : i + 64, j : j + 64].ravel(), minlength=8) / 4096
            h = np.minimum(h / math.sqrt((h * h).sum() + 1e-10), 0.2)
            cells.append(h / math.sqrt((h * h).sum() + 1e-10))
    return unit(np.concatenate(cells))


def color_moments(hsv: np.ndarray) -> np.ndarray:
    """Mean, deviation and skewness of each channel, unit length; a constant channel has skewness 0."""
    out = []
    for c in range(3):
        x = np.asarray(hsv[..., c], dtype=float).ravel()
        d = x - x.mean()
        s = x.std()
        out += [x.mean(), s, float((d**3).mean() / s**3) if s > 0 else 0.0]
    return unit(np.array(out))


def perceptual_hashes(gray: np.ndarray) -> tuple[str, str, str]:
    """Hashes of 64 bits by spectrum, by differences of neighbours, by mean."""
    spectrum = dct2(resized(gray, 32))[:8, :8]
    wide = resized(gray, 72)
    small, row = resized(gray, 8), np.column_stack([wide.reshape(8, 9, 72).mean(1)[:, k * 8 : (k + 1) * 8].mean(1) for k in range(9)])
    bits = (spectrum > np.median(spectrum), row[:, 1:] > row[:, :-1], small > small.mean())
    return tuple(f"{int(''.join('1' if b else '0' for b in x.ravel()), 2):016x}" for x in bits)


def wavelet_hash(gray: np.ndarray) -> str:
    """A hash of 64 bits by the third low band of a 64x64 image: above its median or not."""
    low = resized(gray, 64)
    for _ in range(3):
        low = haar(low)[0]
    return f"{int(''.join('1' if b else '0' for b in (low > np.median(low)).ravel()), 2):016x}"


def edges(gray: np.ndarray, low: float = 50.0, high: float = 150.0) -> np.ndarray:
    """Edges after Canny: gradients of the smoothed image, thinned along their direction, strong ones and weak ones joined to them."""
    line = np.array([1, 4, 6, 4, 1]) / 16
    g = np.pad(np.asarray(gray, dtype=float), 2, mode="edge")
    g = sum(w * g[:, k : g.shape[1] - 4 + k] for k, w in enumerate(line))
    g = sum(w * g[k : g.shape[0] - 4 + k] for k, w in enumerate(line))
    p = np.pad(g, 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    size, sector = np.hypot(gx, gy), np.round(np.rad2deg(np.arctan2(gy, gx)) / 45).astype(int) % 4
    s = np.pad(size, 1)
    ahead = [s[1:-1, 2:], s[2:, 2:], s[2:, 1:-1], s[2:, :-2]]
    behind = [s[1:-1, :-2], s[:-2, :-2], s[:-2, 1:-1], s[:-2, 2:]]
    thin = (size >= np.choose(sector, ahead)) & (size >= np.choose(sector, behind))
    strong, weak = thin & (size >= high), thin & (size >= low)
    while True:
        near = np.pad(strong, 1)
        grown = weak & np.logical_or.reduce([near[y : y + strong.shape[0], x : x + strong.shape[1]] for y in range(3) for x in range(3)])
        if (grown == strong).all():
            return strong
        strong = grown | strong


def edge_gradients_128(gray: np.ndarray) -> np.ndarray:
    """Gradient histograms of the edges alone."""
    return gradients_128(edges(resized(gray, 256)) * 255.0)


def layers(gray: np.ndarray, hsv: np.ndarray) -> dict:
    """All layers that pixels give: hashes, frequencies, gradients, colours. Embedding and attention come from models."""
    phash, dhash, ahash = perceptual_hashes(gray)
    return {"phash": phash, "dhash": dhash, "ahash": ahash, "whash": wavelet_hash(gray), "dct": signature_128(gray).tolist(), "hog": gradients_128(gray).tolist(), "color": color_moments(hsv).tolist()}


# ---- watermarks -------------------------------------------------------------------------------


def payload_bits(asset: int, owner: int, timestamp: int, seed: int) -> np.ndarray:
    """256 bits: seed, asset, owner, time, and 8 bytes of a hash of them."""
    meta = struct.pack(">QQI", asset, owner, timestamp)
    check = hashlib.sha256(struct.pack(">I", seed) + meta).digest()[:8]
    return np.unpackbits(np.frombuffer(struct.pack(">I", seed) + meta + check, dtype=np.uint8))


def _signs(seed: int) -> np.ndarray:
    return np.concatenate([np.random.default_rng(MASTER_SEED).choice([-1, 1], size=32), np.random.default_rng(seed).choice([-1, 1], size=224)])


def embed_spectrum(luma: np.ndarray, asset: int, owner: int, timestamp: int, seed: int, alpha: float = ALPHA) -> np.ndarray:
    """One bit for each 8x8 block, row by row: seven coefficients grow or shrink with the bit's sign."""
    change = (payload_bits(asset, owner, timestamp, seed).astype(int) * 2 - 1) * _signs(seed) * alpha
    out, wide = np.asarray(luma, dtype=float).copy(), luma.shape[1] // 8
    for i in range(min(256, (luma.shape[0] // 8) * wide)):
        at = slice(i // wide * 8, i // wide * 8 + 8), slice(i % wide * 8, i % wide * 8 + 8)
        block = dct2(out[at])
        for place in BANDS[0] + BANDS[1]:
            block[place] += change[i] * abs(block[place])
        out[at] = idct2(block)
    return out


def extract_spectrum(luma: np.ndarray) -> dict | None:
    """Seed first, by the common sequence; the rest by the seed's. None for images of under 256 blocks."""
    wide, values = luma.shape[1] // 8, []
    for i in range(min(256, (luma.shape[0] // 8) * wide)):
        block = dct2(np.asarray(luma[i // wide * 8 : i // wide * 8 + 8, i % wide * 8 : i % wide * 8 + 8], dtype=float))
        values.append(sum(sum(block[p] for p in band) for band in BANDS) / 2)
    if len(values) < 256:
        return None
    found = np.array(values)
    raw = np.packbits(found[:32] * np.random.default_rng(MASTER_SEED).choice([-1, 1], size=32) > 0).tobytes()
    seed = struct.unpack(">I", raw)[0]
    meta = np.packbits(found[32:] * np.random.default_rng(seed).choice([-1, 1], size=224) > 0).tobytes()
    asset, owner, timestamp = struct.unpack(">QQI", meta[:20])
    good = hashlib.sha256(struct.pack(">I", seed) + meta[:20]).digest()[:8] == meta[20:28]
    return {"seed": seed, "asset": asset, "owner": owner, "timestamp": timestamp, "valid": good, "confidence": float(np.abs(found).mean())}


def haar(plane: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One level of the two-dimensional Haar transform (orthonormal); odd edges are dropped."""
    p = np.asarray(plane, dtype=float)[: plane.shape[0] // 2 * 2, : plane.shape[1] // 2 * 2]
    a, b, c, d = p[::2, ::2], p[::2, 1::2], p[1::2, ::2], p[1::2, 1::2]
    return (a + b + c + d) / 2, ((a + b - c - d) / 2, (a - b + c - d) / 2, (a - b - c + d) / 2)


def unhaar(low: np.ndarray, high: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    h, v, d = high
    out = np.zeros((low.shape[0] * 2, low.shape[1] * 2))
    out[::2, ::2], out[::2, 1::2] = (low + h + v + d) / 2, (low + h - v - d) / 2
    out[1::2, ::2], out[1::2, 1::2] = (low - h + v - d) / 2, (low - h - v + d) / 2
    return out


def _wavelet_bits(asset: int, owner: int, timestamp: int) -> np.ndarray:
    check = (asset ^ owner ^ timestamp) & 0xFFFF
    packed = struct.pack(">QIIH", asset & (1 << 64) - 1, owner & 0xFFFFFFFF, timestamp & 0xFFFFFFFF, check)
    return np.unpackbits(np.frombuffer(packed, dtype=np.uint8))


def embed_wavelet(luma: np.ndarray, asset: int, owner: int, timestamp: int, step: float = WAVELET_STEP) -> np.ndarray:
    """144 bits, repeated over the second low band: each coefficient moves to the nearest multiple of the step with the bit's parity."""
    one, high1 = haar(luma)
    two, high2 = haar(one)
    bits = np.resize(_wavelet_bits(asset, owner, timestamp), two.size).reshape(two.shape)
    two = (2 * np.round((two / step - bits) / 2) + bits) * step
    return unhaar(unhaar(two, high2), high1)


def extract_wavelet(luma: np.ndarray, step: float = WAVELET_STEP) -> dict:
    """Bits by majority of their repetitions; valid if the check agrees."""
    two = haar(haar(luma)[0])[0]
    odd = np.round(two / step).astype(np.int64).ravel() % 2 * 2 - 1
    votes = np.bincount(np.arange(odd.size) % 144, weights=odd, minlength=144)
    asset, owner, timestamp, check = struct.unpack(">QIIH", np.packbits(votes > 0).tobytes())
    return {"asset": asset, "owner": owner, "timestamp": timestamp, "valid": (asset ^ owner ^ timestamp) & 0xFFFF == check}


def _places(asset_id: str, pixels: int) -> np.ndarray:
    return np.random.default_rng(int(asset_id[:8], 16)).choice(pixels, size=256, replace=False)


def embed_low_bits(pixels: np.ndarray, bits: str, asset_id: str) -> np.ndarray:
    """256 bits in the lowest bit of the third channel, at places that follow from the asset id. Fewer than three channels: unchanged."""
    if len(bits) != 256:
        raise ValueError("256 bits are needed")
    out = pixels.copy()
    if pixels.shape[2] >= 3:
        at = np.unravel_index(_places(asset_id, pixels.shape[0] * pixels.shape[1]), pixels.shape[:2])
        out[(*at, 2)] = (out[(*at, 2)] & 0xFE) | np.array([int(b) for b in bits], dtype=pixels.dtype)
    return out


def extract_low_bits(pixels: np.ndarray, asset_id: str) -> str | None:
    if pixels.shape[2] < 3:
        return None
    at = np.unravel_index(_places(asset_id, pixels.shape[0] * pixels.shape[1]), pixels.shape[:2])
    return "".join(str(int(b)) for b in pixels[(*at, 2)] & 1)


def stream_variant(frame: np.ndarray, segment: int, variant: int) -> np.ndarray:
    """The A (0) or B (1) form of a frame: B adds a small patch whose place and pattern follow from the segment."""
    draw = np.random.RandomState(segment * 1000 + variant)
    y, x = draw.randint(0, frame.shape[0] - 8), draw.randint(0, frame.shape[1] - 8)
    pattern, out = draw.choice([-2, 2], size=(8, 8, 3)), frame.astype(int)
    out[y : y + 8, x : x + 8] = np.clip(out[y : y + 8, x : x + 8] + pattern * variant, 0, 255)
    return out.astype(np.uint8)


def similarity_index(a: np.ndarray, b: np.ndarray, peak: float = 255.0) -> float:
    """Structural similarity with an 11x11 Gaussian window of deviation 1.5."""
    line = np.exp(-((np.arange(11) - 5) ** 2) / (2 * 1.5**2))
    line /= line.sum()

    def smooth(x: np.ndarray) -> np.ndarray:
        rows = np.apply_along_axis(lambda r: np.convolve(r, line, "valid"), 1, x)
        return np.apply_along_axis(lambda c: np.convolve(c, line, "valid"), 0, rows)

    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    ma, mb, c1, c2 = smooth(a), smooth(b), (0.01 * peak) ** 2, (0.03 * peak) ** 2
    va, vb, vab = smooth(a * a) - ma * ma, smooth(b * b) - mb * mb, smooth(a * b) - ma * mb
    return float((((2 * ma * mb + c1) * (2 * vab + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


def manipulation_score(gray: np.ndarray) -> float:
    """1 less a thousandth of the Laplacian's variance, clamped: a heuristic for smoothed images."""
    g = np.asarray(gray, dtype=float)
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(min(1.0, max(0.0, 1 - lap.var() / 1000)))


def diffusion_score(gray: np.ndarray) -> float:
    """1 less the third low band's deviation over 120, clipped: a heuristic for generated images."""
    low = np.asarray(gray, dtype=float)
    for _ in range(3):
        low = haar(low)[0]
    return float(np.clip(1 - low.std() / 120, 0, 1))


def chi_square_p(chi2: float, free: int) -> float:
    """Upper tail of the chi-square distribution: the incomplete gamma function by series or continued fraction."""
    a, x = free / 2, chi2 / 2
    if x <= 0 or a <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-15:
                break
        return max(0.0, 1 - total * scale)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, scale * h)
