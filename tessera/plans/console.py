"""The questions of a console by name, each answered by one of the pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import questions

CONSOLE = {
    "two-districts": 2, "repeat-at-station": 16, "co-accused": 31, "undetected-for-identity": 46, "most-renderings": 108, "offence-signature": 149,
    "travelling": 3, "recovered-links": 35, "active-window": 51, "undetected-at-station": 22, "cross-script": 109, "largest-merges": 113,
    "station-load": 20, "undetected-by-offence": 52, "solo": 37,
}


def ask(spark: SparkSession, name: str, **values) -> DataFrame:
    """Answer a named question on the registered tables."""
    if name not in CONSOLE:
        raise KeyError(f"no question {name!r}; there are {', '.join(sorted(CONSOLE))}")
    return questions.ask(spark, CONSOLE[name], **values)
