"""Audio features from decoded samples (media_id, i, y)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import amplitude_to_db
from .series import rescale


def audio_amp(samples: DataFrame, sr: int = 8000, max_samples: int = 200_000, normalize: bool = True) -> DataFrame:
    """(media_id, time, y): at most max_samples even points of each media, linear between samples; rescaled if asked."""
    n = samples.groupBy("media_id").agg(F.count("*").alias("n")).withColumn("m", F.least(F.col("n"), F.lit(max_samples)))
    grid = n.select("media_id", "n", "m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)).alias("k"))
    place = F.coalesce(F.try_divide((F.col("k") * (F.col("n") - 1)).cast("double"), (F.col("m") - 1).cast("double")), F.lit(0.0))
    # places of samples are whole numbers, so a point joins the two samples beside it, by weight
    at = grid.select("media_id", (F.col("k") * F.col("n") / F.col("m") / float(sr)).alias("time"), F.floor(place).alias("i"), (place - F.floor(place)).alias("part"))
    sides = at.select("media_id", "time", F.explode(F.array(F.struct("i", (1 - F.col("part")).alias("w")), F.struct((F.col("i") + 1).alias("i"), F.col("part").alias("w")))).alias("s"))
    met = sides.select("media_id", "time", "s.i", "s.w").where("w > 0").join(samples.select("media_id", F.col("i").cast("bigint").alias("i"), "y"), ["media_id", "i"])
    out = met.groupBy("media_id", "time").agg(F.sum(F.col("y") * F.col("w")).alias("y"))
    return rescale(out, keys=("media_id",), normalize=normalize)


def _framed(samples: DataFrame, frame: int, hop: int) -> DataFrame:
    """Each sample with the centred windows k that hold it: hop * k - frame / 2 <= i < hop * k + frame / 2, k <= n / hop."""
    n = samples.groupBy("media_id").agg(F.max("i").alias("_last"))
    half = frame // 2
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("i") - (frame - half)) / hop) + 1)
    last = F.least(F.floor((F.col("i") + half) / hop), F.floor((F.col("_last") + 1) / hop))
    met = samples.join(n, "media_id").where(first <= last)
    return met.select("media_id", "i", "y", F.explode(F.sequence(first, last)).alias("k"))


def audio_rms(samples: DataFrame, sr: int = 8000, hop: int = 512, frame: int = 2048, normalize: bool = True) -> DataFrame:
    """(media_id, k, time, y): root mean square of centred windows, zeros outside; time = k * hop / sr."""
    windows = _framed(samples, frame, hop).groupBy("media_id", "k").agg(F.sqrt(F.sum(F.col("y") * F.col("y")) / frame).alias("y"))
    out = windows.select("media_id", "k", (F.col("k") * hop / float(sr)).alias("time"), "y")
    return rescale(out, keys=("media_id",), normalize=normalize)


def audio_freq(samples: DataFrame, sr: int = 8000, n_fft: int = 256, hop: int | None = None, normalize: bool = True) -> DataFrame:
    """(media_id, time, bin, value): decibels under the media's loudest bin (not under -80), rescaled over all bins if asked.

    Hann windows of n_fft samples, centred; time is k * hop / sr. Windows are gathered one by one, so a media is never one value.
    """
    hop = hop or n_fft // 4
    framed = _framed(samples, n_fft, hop)
    gathered = framed.groupBy("media_id", "k").agg(F.collect_list(F.struct((F.col("i") - F.col("k") * hop + n_fft // 2).cast("int").alias("p"), F.coalesce(F.col("y").cast("double"), F.lit(0.0)).alias("y"))).alias("s")).select("media_id", "k", "s.p", "s.y")
    window = np.hanning(n_fft + 1)[:-1]

    def transform(frames):
        for f in frames:
            x = np.zeros((len(f), n_fft))
            row = np.repeat(np.arange(len(f)), f.p.map(len).to_numpy())
            if len(row):
                x[row, np.concatenate(f.p.to_numpy())] = np.concatenate(f.y.to_numpy())
            mag = np.abs(np.fft.rfft(x * window, axis=1))
            yield pd.DataFrame({"media_id": f.media_id, "k": f.k, "m": list(mag)})

    mags = gathered.mapInPandas(transform, f"media_id {dict(samples.dtypes)['media_id']}, k long, m array<double>")
    bins = mags.select("media_id", "k", F.posexplode("m").alias("bin", "mag"))
    top = bins.groupBy("media_id").agg(F.max("mag").alias("top"))
    db = bins.join(top, "media_id").select("media_id", (F.col("k") * hop / float(sr)).alias("time"), "bin", amplitude_to_db(F.col("mag"), F.col("top")).alias("value"))
    return rescale(db, keys=("media_id",), y="value", normalize=normalize)
