"""Matchers by priority, and the pipeline that runs them one after another."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import EngineError, PluginError
from tidemark.operators import exact
from tidemark.operators.keepers import KeeperStrategy
from tidemark.operators.models import backend
from tidemark.schemas import RECORD

__all__ = ["ExactMatcher", "Matcher", "Pipeline", "VisionMatcher", "backend"]


class Matcher(ABC):
    """A tier: which files it looks at, and the duplicate records it finds among them."""

    name: str
    priority: int
    match_type: str

    def supported(self) -> Column:
        return F.lit(True)

    def available(self) -> tuple[bool, str]:
        """Whether the tier can run here, and why not."""
        return True, "Ready"

    @abstractmethod
    def records(self, files: DataFrame, keeper: KeeperStrategy | None = None) -> DataFrame:
        """Records with ``rank``, ``size_bytes`` and ``member_no``; group ids and member numbers from 1."""


class ExactMatcher(Matcher):
    name, priority, match_type = "exact_hash", 10, exact.EXACT

    def supported(self) -> Column:
        return F.col("size_bytes") > 0

    def records(self, files: DataFrame, keeper: KeeperStrategy | None = None) -> DataFrame:
        return exact.duplicate_records(files, keeper=keeper)


class VisionMatcher(Matcher):
    """The visual tier at parity: it looks at media and finds nothing; see ``similarity`` for what does."""

    name, priority, match_type = "photo_vision", 20, "VISUAL_AI_NEAR_DUPLICATE"

    def __init__(self, threshold: float = 0.85):
        self.threshold = threshold

    def supported(self) -> Column:
        return F.col("is_media")

    def records(self, files: DataFrame, keeper: KeeperStrategy | None = None) -> DataFrame:
        return files.sparkSession.createDataFrame([], RECORD).withColumns({"rank": F.lit(0), "size_bytes": F.lit(0).cast("long"), "member_no": F.lit(0).cast("long")})


@dataclass
class Pipeline:
    """Runs matchers in order of priority; a file that one has matched is not shown to the next."""

    matchers: list[Matcher] = field(default_factory=list)
    keeper: KeeperStrategy | None = None

    def register(self, matcher: Matcher) -> Pipeline:
        self.matchers = sorted([*self.matchers, matcher], key=lambda m: m.priority)
        return self

    def records(self, files: DataFrame) -> DataFrame:
        out = None
        left = files
        for m in self.matchers:
            if not m.available()[0]:
                continue
            try:
                found = m.records(left.where(m.supported()), self.keeper)
            except EngineError:
                raise
            except Exception as e:
                raise PluginError(m.name, str(e)) from e
            if out is None:
                out = found
            else:
                last = out.agg(F.coalesce(F.max("group_id"), F.lit(0)).alias("g"), F.coalesce(F.max("member_no"), F.lit(0)).alias("m")).withColumn("j", F.lit(1))
                moved = found.withColumn("j", F.lit(1)).join(last, "j").withColumns({"group_id": F.col("group_id") + F.col("g"), "member_no": F.col("member_no") + F.col("m")})
                out = out.unionByName(moved.drop("j", "g", "m"))
            left = exact.prune_matched(left, found)
        return out
