"""authorscan: detection of edited sentences in machine-written text, as Spark jobs.

Every operator is a plain function DataFrame -> DataFrame. The heavy steps
(sentence split, n-gram scoring, null fit, p-values, per-document tests,
calibration) are joins, aggregations and range-partitioned scans that Catalyst
plans; Python runs only inside optional user scorers (``score_with``).
"""

from authorscan.params import Params

__all__ = ["Params"]
