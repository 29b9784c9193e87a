"""Measures of coding quality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def bd_rate(reference: tuple, test: tuple) -> float | None:
    """Mean difference in size at equal quality, in percent, of (sizes, PSNRs): cubic fits of log size over PSNR, integrated
    over the qualities that both cover. None without four points or a common range."""
    (ra, pa), (rb, pb) = reference, test
    low, high = max(min(pa), min(pb)), min(max(pa), max(pb))
    if min(len(pa), len(pb)) < 4 or high <= low:
        return None
    area = []
    for r, p in ((ra, pa), (rb, pb)):
        whole = np.polyint(np.polyfit(p, np.log(r), 3))
        area.append(np.polyval(whole, high) - np.polyval(whole, low))
    return float((np.exp((area[1] - area[0]) / (high - low)) - 1) * 100)


def bd_rates(points: DataFrame, key: str, coder: str, reference: str) -> DataFrame:
    """(key, coder, bd_rate) of points(key, coder, bytes, psnr) against one coder; a group is a few points of one picture."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        by = {c: (g["bytes"].to_numpy(float), g["psnr"].to_numpy(float)) for c, g in frame.groupby(coder)}
        rows = [(frame[key].iloc[0], c, bd_rate(by[reference], x)) for c, x in sorted(by.items()) if reference in by and c != reference]
        return pd.DataFrame(rows, columns=[key, coder, "bd_rate"])

    kinds = dict(points.dtypes)
    return points.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {coder} {kinds[coder]}, bd_rate double")
