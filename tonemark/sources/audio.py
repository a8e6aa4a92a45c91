"""Audio files to feature rows. Samples are reduced where the file is read and never shuffled."""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tonemark.schemas import AUDIO_FEATURES

PEAK = 0.999


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] of a PCM file, channels averaged, and the sample rate."""
    with wave.open(io.BytesIO(content)) as clip:
        width, channels, rate = clip.getsampwidth(), clip.getnchannels(), clip.getframerate()
        raw = clip.readframes(clip.getnframes())
    if width == 1:
        samples = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        triples = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        padded = np.zeros((len(triples), 4), np.uint8)
        padded[:, 1:] = triples
        samples = padded.view("<i4").ravel().astype(np.float32) / 2**31
    else:
        samples = np.frombuffer(raw, f"<i{width}").astype(np.float32) / 2 ** (8 * width - 1)
    return samples.reshape(-1, channels).mean(axis=1), rate


def features(content: bytes) -> dict:
    samples, rate = decode_wav(content)
    count = len(samples)
    return {
        "sample_rate": rate,
        "n_samples": count,
        "duration_s": count / rate if rate else 0.0,
        "rms": float(np.sqrt(np.mean(samples.astype(np.float64) ** 2))) if count else None,
        "clip_ratio": float(np.mean(np.abs(samples) >= PEAK)) if count else None,
        "sha1": hashlib.sha1(content).hexdigest(),
    }


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [{"path": p, **features(c)} for p, c in zip(batch["path"], batch["content"])]
        yield pd.DataFrame(rows, columns=AUDIO_FEATURES.names)


def audio_features(files: DataFrame) -> DataFrame:
    """SRC7: sample rate, samples, duration, loudness, clipping and digest of (path, content)."""
    return files.select("path", "content").mapInPandas(_rows, AUDIO_FEATURES)


def read_audio_features(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    """SRC7 over all matching files below a folder."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return audio_features(files)
