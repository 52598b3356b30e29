"""Icons and colours against references: masked correlation less a colour penalty, in two channel orders."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import nearest

# Weight of the colour distance, lowest score of a match, mask values above which a pixel counts.
COLOUR_PENALTY, LEAST_SCORE, SOLID = 1.5, 0.20, 127
#: Icons, and references, of one task.
ICONS, REFS = 4_000, 1_000


def masked_scores(icons: np.ndarray, icon_masks: np.ndarray, refs: np.ndarray, ref_masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores (icon x reference) of the channels as they are, and in reverse order.

    icons, refs: n x channels x pixels; masks: n x pixels. A pixel counts where both masks are solid. The correlation is over all channels of those
    pixels around their common mean, 0 without any or without variation; the colour distance is between the channels' means, as a share of
    the largest one. All of it comes from sums over common pixels, which are matrix products.
    """
    a, b = (icon_masks > SOLID).astype(float), (ref_masks > SOLID).astype(float)
    x, y = icons * a[:, None], refs * b[:, None]
    channels = icons.shape[1]
    pixels = a @ b.T
    sx, sy = [x[:, c] @ b.T for c in range(channels)], [a @ y[:, c].T for c in range(channels)]
    n, whole_x, whole_y = np.maximum(pixels * channels, 1), sum(sx), sum(sy)
    spread = np.sqrt(np.maximum((x * x).sum(1) @ b.T - whole_x**2 / n, 0) * np.maximum(a @ (y * y).sum(1).T - whole_y**2 / n, 0))
    out = []
    for order in (range(channels), range(channels - 1, -1, -1)):
        both = sum(x[:, o] @ y[:, c].T for c, o in enumerate(order)) - whole_x * whole_y / n
        apart = np.sqrt(sum(((sx[o] - sy[c]) / np.maximum(pixels, 1)) ** 2 for c, o in enumerate(order))) / (np.sqrt(channels) * 255)
        out.append(np.where(spread < 1e-10, 0.0, both / np.maximum(spread, 1e-300)) - COLOUR_PENALTY * apart)
    return out[0], out[1]


def match_icons(icons: DataFrame, key: str, refs: DataFrame, label: str, mask: str = "mask", channels: Sequence[str] = ("b", "g", "r"), least: float = LEAST_SCORE) -> DataFrame:
    """key, label, score and channel_order (native, swapped) of the best reference of each icon; the label is NULL below the least score.

    Both sides have a mask and a channel each as arrays of one length. In either order the reference with the highest score
    is the best, the smaller label on ties; the swapped order counts only if it is better. Icons and references meet in blocks, whose number
    is that of the rows, so no task holds more of either than a block. Without references label and score are NULL.
    """
    cols = [mask, *channels]
    parts, blocks = (max(1, -(-d.count() // n)) for d, n in ((icons, ICONS), (refs, REFS)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = icons.select(F.col(key).alias("_key"), *cols).withColumn("_p", deal("_key", parts)).withColumn("_b", every(blocks))
    right = refs.select(F.col(label).alias("_label"), *[F.col(c).alias(f"_r{i}") for i, c in enumerate(cols)]).withColumn("_rb", deal("_label", blocks)).withColumn("_rp", every(parts))

    def run(some: pd.DataFrame, those: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(those):
            return pd.DataFrame({c: [] for c in ("_key", "native", "native_label", "swapped", "swapped_label")})
        those = those.sort_values("_label", kind="stable")
        stack = lambda d, names: np.stack([np.stack(d[c].to_numpy()).astype(float) for c in names], 1)
        x, y = stack(some, cols), stack(those, [f"_r{i}" for i in range(len(cols))])
        found = {"_key": some["_key"].to_numpy()}
        for name, s in zip(("native", "swapped"), masked_scores(x[:, 1:], x[:, 0], y[:, 1:], y[:, 0]), strict=True):
            s = np.round(s, 9)
            at = s.argmax(1)  # the first, so the smaller label, on ties
            found[name], found[f"{name}_label"] = s[np.arange(len(s)), at], those["_label"].to_numpy()[at]
        return pd.DataFrame(found)

    kind, key_kind = refs.schema[label].dataType.simpleString(), icons.schema[key].dataType.simpleString()
    got = left.groupBy("_p", "_b").cogroup(right.groupBy("_rp", "_rb")).applyInPandas(run, f"_key {key_kind}, native double, native_label {kind}, swapped double, swapped_label {kind}")
    best = got.groupBy("_key").agg(*[F.min(F.struct((-F.col(n)).alias("s"), F.col(f"{n}_label").alias("l"))).alias(n) for n in ("native", "swapped")])
    turned = F.col("swapped.s") < F.col("native.s")
    one = F.when(turned, F.col("swapped")).otherwise(F.col("native"))
    best = best.select("_key", one.alias("_x"), F.when(turned, "swapped").otherwise("native").alias("channel_order"))
    best = best.select("_key", F.when(-F.col("_x.s") >= least, F.col("_x.l")).alias(label), (-F.col("_x.s")).alias("score"), "channel_order")
    return icons.select(key).distinct().join(best, F.col(key) == F.col("_key"), "left").drop("_key")


def nearest_colour(rows: DataFrame, row_key: Sequence[str], channels: Sequence[str], refs: DataFrame, label: str, order: str) -> DataFrame:
    """row_key, label, channel_order (BGR, RGB) and distance of the nearest reference colour by squared distance, rows read in both orders.

    On ties the order as given comes first, then the first reference in order. References have the channels under the same names.
    """
    turned = list(reversed(channels))
    both = refs.select(F.struct(F.col(label).alias("l"), F.lit("BGR").alias("o")).alias("_l"), F.struct(F.lit(0), F.col(order)).alias("_o"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(channels)]).unionByName(
        refs.select(F.struct(F.col(label).alias("l"), F.lit("RGB").alias("o")).alias("_l"), F.struct(F.lit(1), F.col(order)).alias("_o"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(turned)])
    )
    distance = lambda r: sum((F.col(c).cast("double") - r[f"_c{i}"]) * (F.col(c).cast("double") - r[f"_c{i}"]) for i, c in enumerate(channels))
    got = nearest(rows, both, distance, row_key, "_l", "_o")
    return got.select(*row_key, F.col("_l.l").alias(label), F.col("_l.o").alias("channel_order"), "distance")
