"""Row counts of joins, measured in the job that runs them."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, functions as F

from .dedup import duplicate_keys


def _rows(seen: Observation) -> int | None:
    """The count, or None where Spark found the plan empty and dropped the count with it."""
    try:
        return seen.get.get("rows")
    except Py4JJavaError:
        return None


class JoinGuard:
    """Finds joins that multiplied the rows of their left side, without a job of its own.

    ``left_join`` counts the rows before and after each join while the caller's own action runs; ``verify`` reads
    the counts afterwards. A task that is run again after an executor is lost may be counted twice, so counts
    that differ are a suspicion only: the keys of that right side are then looked at before an error is raised.
    """

    def __init__(self) -> None:
        self._steps: list[tuple[Observation, Observation, DataFrame, list[str]]] = []
        self._last: Observation | None = None

    @staticmethod
    def _counted(df: DataFrame) -> tuple[DataFrame, Observation]:
        seen = Observation()
        return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen

    def left_join(self, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        if self._last is None:
            left, self._last = self._counted(left)
        joined, after = self._counted(left.join(right, keys, "left"))
        self._steps.append((self._last, after, right, keys))
        self._last = after
        return joined

    def verify(self) -> None:
        """Raise ``ValueError`` if a join multiplied rows. Call it after an action on the joined frame, never before."""
        for before, after, right, keys in self._steps:
            rows = _rows(before), _rows(after)
            if rows[0] != rows[1] and not duplicate_keys(right.dropna(subset=keys), keys).isEmpty():
                raise ValueError(f"keys {keys} are not unique: {rows[0]} rows became {rows[1]}")
