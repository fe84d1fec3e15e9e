"""BM25 as column expressions, under the statistics profiles that a caller chooses."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Documents assumed where no statistics are at hand.
ASSUMED_DOCS = 1 << 31
#: Single precision widened to double, as stored parameters are.
K1, B = struct.unpack("ff", struct.pack("ff", 1.2, 0.75))


@dataclass(frozen=True)
class Statistics:
    """Documents, their mean length, and the column that holds each one's length (None: every length is 1)."""

    n_docs: int
    mean_length: float
    length: str | None = "dl"

    def defaulted(self) -> Statistics:
        return Statistics(self.n_docs or ASSUMED_DOCS, self.mean_length if self.mean_length > 0 else 1.0, self.length)


#: No statistics: length normalisation has no effect.
FALLBACK = Statistics(0, 0.0, None)


def idf(n_docs: Column, ft: Column) -> Column:
    n, f = n_docs.cast("double"), ft.cast("double")
    return F.log((n - f + 0.5) / (f + 0.5) + 1.0)


def tf_factor(tf: Column, length: Column, mean_length: float, k1: float = K1, b: float = B) -> Column:
    denominator = tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * length / F.lit(mean_length))
    return tf * F.lit(k1 + 1.0) / F.when(denominator > 0, denominator).otherwise(F.lit(1.0))


def contribution(tf: Column, ft: Column, stats: Statistics, k1: float = K1, b: float = B) -> Column:
    """What one term adds to a document's score. A missing length counts as 1."""
    stats = stats.defaulted()
    length = F.lit(1.0) if stats.length is None else F.coalesce(F.col(stats.length).cast("double"), F.lit(1.0))
    return idf(F.lit(stats.n_docs), ft) * tf_factor(tf.cast("double"), length, stats.mean_length, k1, b)
