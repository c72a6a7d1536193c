"""Levels of audio samples, and WAV files from PCM pieces."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = 24_000


def audio_stats(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Least, largest and root mean square of the samples of every key; nulls don't count."""
    v = F.col(value)
    return samples.groupBy(key).agg(F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.sqrt(F.avg(v * v)), 6).alias("rms"))


def wav_bytes(pcm: bytes, rate: int = RATE) -> bytes:
    """Mono 16-bit PCM with its RIFF header."""
    head = b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16)
    return head + b"data" + struct.pack("<I", len(pcm)) + pcm


def wav(pcm: Column) -> Column:
    @F.pandas_udf("binary")
    def run(s):
        return s.map(lambda b: None if b is None else wav_bytes(b))

    return run(pcm)
