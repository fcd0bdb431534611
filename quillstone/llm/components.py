"""Connected components of a graph that is a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from quillstone.llm.common import Scratch
from quillstone.operators import components


def local_roots(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each, when a and b are joined in a forest of roots."""
    while True:
        x, y = roots[a], roots[b]
        open_ = x != y
        if not open_.any():
            return roots
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        low = np.minimum(x, y)
        np.minimum.at(roots, x, low)
        np.minimum.at(roots, y, low)
        while True:
            up = roots[roots]
            if (up == roots).all():
                break
            roots = up


def star_forest(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root for each node of links(a, b) that is not the smallest of its component; each round is a table of the scratch folder."""
    return components.star_forest(links, scratch.table)
