"""Streaming: drafts scored against static calibrations; windowed rates of the event trail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.functions import patterns as P
from inkgauge.operators import calibrate as C
from inkgauge.operators import features as X


def score_stream(drafts: DataFrame, fp: DataFrame, base: DataFrame) -> DataFrame:
    """Stateless: features of each arriving draft, its distance and fit; a stream joined with static rows."""
    x = C.with_distance(X.with_features(drafts).drop("text"), fp, P.SURFACE).join(base.select("voice", "self_baseline", "fit_threshold"), "voice")
    return x.select("cand_id", "voice", "created_at", "rmsz", C.fit_state(F.col("rmsz"), F.col("fit_threshold"), F.col("self_baseline")).alias("fit"))


def fit_rates(scored: DataFrame, late: str = "1 day", window: str = "7 days") -> DataFrame:
    """Windowed counts by fit; drafts later than ``late`` behind the newest are left out."""
    w = scored.withWatermark("created_at", late).groupBy(F.window("created_at", window), "fit").agg(F.count("*").alias("n"), F.avg("rmsz").alias("mean_rmsz"))
    return w.select(F.col("window.start").alias("from"), F.col("window.end").alias("to"), "fit", "n", "mean_rmsz")


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """All that has arrived, in batches, to Parquet; restarts go on where the checkpoint ends."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
