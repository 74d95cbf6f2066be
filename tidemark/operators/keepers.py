"""How a cluster's file to keep is chosen: a score and an order, both as columns, so that ranking stays one window."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import exprs as X


class KeeperStrategy(ABC):
    """The member of the greatest score is kept; of equal ones the first in ``order``."""

    @abstractmethod
    def score(self) -> Column:
        """A long over the columns of a member."""

    def order(self) -> list[Column]:
        return [X.path_order(F.col("path"))]


class PathKeeper(KeeperStrategy):
    """By marks of trash folders, copies, thumbnails and edits in the path."""

    def score(self) -> Column:
        return X.keeper_score(F.col("path"))


class NewestKeeper(KeeperStrategy):
    """The file changed last."""

    def score(self) -> Column:
        return F.col("modified_epoch").cast("long")
