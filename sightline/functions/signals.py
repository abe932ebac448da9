"""Luminance and audio signals: modulation, demodulation, spectra."""

from __future__ import annotations

import hashlib

import numpy as np

#: Luminance carrier (Hz), strength, frames of a symbol, frame rate; audio carrier (Hz), shift of a one, strength, bits a second.
CARRIER, AMPLITUDE, SYMBOL, FPS = 12.0, 0.008, 15, 25.0
AUDIO_CARRIER, AUDIO_SHIFT, AUDIO_AMPLITUDE, AUDIO_BITS = 18500, 200, 0.0003, 8


def luminance_payload(asset_id: str, stream_id: str) -> str:
    """64 bits: the first 32 of each id's hash."""
    return "".join(f"{int(hashlib.sha256(x.encode()).hexdigest()[:8], 16):032b}" for x in (asset_id, stream_id))


def luminance_factor(frames: int, payload: str) -> np.ndarray:
    """What each frame's luminance is multiplied by: a carrier whose phase turns for a zero."""
    k = np.arange(frames)
    turned = np.array([payload[i] == "0" for i in (k // SYMBOL) % len(payload)]) if frames else np.zeros(0, dtype=bool)
    return 1 + AMPLITUDE * np.sin(2 * np.pi * CARRIER * k / FPS + np.pi * turned)


def band_pass(series: np.ndarray, low: float = 10.0, high: float = 14.0, rate: float = FPS) -> np.ndarray:
    """The part of a series between two frequencies; those above half the rate do not exist."""
    spectrum, at = np.fft.rfft(series), np.fft.rfftfreq(len(series), 1 / rate)
    return np.fft.irfft(np.where((at >= low) & (at <= high), spectrum, 0), len(series))


def symbol_bits(filtered: np.ndarray) -> str:
    """The sign of each symbol's mean; the last symbol is left out, even if it fits exactly."""
    return "".join("1" if filtered[i : i + SYMBOL].mean() > 0 else "0" for i in range(0, len(filtered) - SYMBOL, SYMBOL))


def coherent_bits(series: np.ndarray) -> str:
    """Each whole symbol against the carrier itself, which tells the phases apart."""
    count = len(series) // SYMBOL
    carrier = np.sin(2 * np.pi * CARRIER * np.arange(count * SYMBOL) / FPS)
    own = band_pass(np.asarray(series, dtype=float) - np.mean(series))[: count * SYMBOL] if count else np.zeros(0)
    return "".join("1" if (own * carrier)[i : i + SYMBOL].sum() > 0 else "0" for i in range(0, count * SYMBOL, SYMBOL))


def audio_bits(asset_id: str, stream_id: str) -> np.ndarray:
    return np.unpackbits(np.frombuffer(hashlib.sha256(f"{asset_id}{stream_id}".encode()).digest(), dtype=np.uint8))[:64]


def embed_audio(audio: np.ndarray, rate: int, asset_id: str, stream_id: str) -> np.ndarray:
    """Add 64 bits as tones; the second channel gets half. Clipped to -1..1."""
    mark, size, t = np.zeros(len(audio)), rate // AUDIO_BITS, np.arange(len(audio)) / rate
    for i, bit in enumerate(audio_bits(asset_id, stream_id)):
        at = slice(i * size, min((i + 1) * size, len(audio)))
        mark[at] = AUDIO_AMPLITUDE * np.sin(2 * np.pi * (AUDIO_CARRIER + AUDIO_SHIFT * int(bit)) * t[at])
    if audio.ndim == 2:
        mark = np.column_stack([mark, mark * 0.5])
    return np.clip(audio.astype(np.float32) + mark, -1.0, 1.0)


def extract_audio(audio: np.ndarray, rate: int, count: int = 64) -> np.ndarray:
    """Each bit by the energy at its two tones."""
    mono, size = (audio[:, 0] if audio.ndim == 2 else audio).astype(float), rate // AUDIO_BITS
    out = []
    for i in range(min(count, len(mono) // size)):
        part, t = mono[i * size : (i + 1) * size], np.arange(i * size, (i + 1) * size) / rate
        energy = [abs(np.exp(-2j * np.pi * f * t) @ part) for f in (AUDIO_CARRIER, AUDIO_CARRIER + AUDIO_SHIFT)]
        out.append(int(energy[1] > energy[0]))
    return np.array(out, dtype=np.uint8)


def mel_bands(audio: np.ndarray, rate: int = 22050, bands: int = 128, size: int = 2048, hop: int = 512) -> np.ndarray:
    """Power in triangular mel bands, one column for each frame."""
    padded = np.pad(np.asarray(audio, dtype=float), (0, max(0, size - len(audio))))
    frames = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop] * np.hanning(size)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), bands + 2) / 2595) - 1)
    at = np.fft.rfftfreq(size, 1 / rate)
    up = (at[None, :] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - at[None, :]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) @ power.T


def mel_embedding(audio: np.ndarray, rate: int = 22050) -> np.ndarray:
    """Mean and deviation of each band over time, unit length."""
    bands = np.log1p(mel_bands(audio, rate))
    v = np.concatenate([bands.mean(1), bands.std(1)])
    size = np.linalg.norm(v)
    return v / size if size > 0 else v


def chroma(audio: np.ndarray, rate: int = 22050, size: int = 4096, hop: int = 2048) -> np.ndarray:
    """Power of the twelve pitch classes, one column for each frame, each of unit sum."""
    padded = np.pad(np.asarray(audio, dtype=float), (0, max(0, size - len(audio))))
    frames = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop] * np.hanning(size)
    power, at = np.abs(np.fft.rfft(frames, axis=1)) ** 2, np.fft.rfftfreq(size, 1 / rate)
    heard = (at >= 27.5) & (at <= 4186.0)
    pitch = np.round(12 * np.log2(at[heard] / 440.0)).astype(int) % 12
    out = np.stack([power[:, heard][:, pitch == c].sum(axis=1) for c in range(12)])
    return out / np.maximum(out.sum(axis=0, keepdims=True), 1e-12)


def mel_signature(audio: np.ndarray, rate: int = 22050) -> np.ndarray:
    """Mean of each mel band in decibels below the loudest, over time; of mean 0 and deviation 1."""
    power = np.maximum(mel_bands(audio, rate), 1e-10)
    mean = np.maximum(10 * np.log10(power / power.max()), -80.0).mean(axis=1)
    return (mean - mean.mean()) / (mean.std() + 1e-8)


def wav(audio: np.ndarray, rate: int) -> bytes:
    """Samples from -1 to 1 as a file of 16 bits, one column for each channel."""
    import io
    import wave

    samples = np.asarray(audio, dtype=float)
    with wave.open(buffer := io.BytesIO(), "wb") as out:
        out.setnchannels(1 if samples.ndim == 1 else samples.shape[1])
        out.setsampwidth(2)
        out.setframerate(rate)
        out.writeframes(np.round(np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return buffer.getvalue()


def samples(content: bytes) -> tuple[np.ndarray, int] | None:
    """A file's samples from -1 to 1 (a column for each channel if there are several) and its rate; None for what is no such file of 16 bits."""
    import io
    import wave

    try:
        with wave.open(io.BytesIO(content)) as f:
            if f.getsampwidth() != 2:
                return None
            raw = np.frombuffer(f.readframes(f.getnframes()), dtype="<i2") / 32767.0
            return (raw.reshape(-1, f.getnchannels()) if f.getnchannels() > 1 else raw), f.getframerate()
    except (wave.Error, EOFError):
        return None
