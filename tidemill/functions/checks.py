"""Guards on arguments, and validators that give issue rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import uncommented

#: The formats of reports.
OUTPUTS = ("diff", "json", "markdown", "patch")


def require_version(version: str) -> str:
    """``version`` if it is two or three numbers with points between."""
    if not re.fullmatch(r"\d+\.\d+(\.\d+)?", version):
        raise ValueError(f"not a version: {version}")
    return version


def require_output(kind: str, known: tuple[str, ...] = OUTPUTS) -> str:
    if kind not in known:
        raise ValueError(f"unsupported output {kind}: one of {', '.join(known)}")
    return kind


def require_shares(train: float, val: float, test: float) -> float:
    """The share of the second split in what the first leaves; the three must sum to 1."""
    if abs(train + val + test - 1) > 1e-9:
        raise ValueError("shares must sum to 1")
    return val / (val + test) if val + test else 0.0


def pattern_issues(lines: DataFrame, validator: str, pattern: str, severity: str) -> DataFrame:
    """Lines that match outside comments, with validator and severity."""
    hits = lines.filter(uncommented(F.col("line_text")).rlike(pattern))
    return hits.withColumns({"validator": F.lit(validator), "severity": F.lit(severity)})
