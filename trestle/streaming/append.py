"""Pipelines over streams: the stages that need no order or groups run on a streaming DataFrame in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..errors import NotImplementedStage
from ..plans import parser as P
from ..plans import planner
from ..sources.catalog import Catalog


def run(spark: SparkSession, catalog: Catalog, source: str | bytes) -> DataFrame:
    """A streaming result of filters, derivations, projections and joins with tables at rest."""
    for stage in P.parse(source):
        if not isinstance(stage, (P.From, P.Filter, P.Derive, P.Project, P.Join)):
            raise NotImplementedStage(type(stage).__name__)
    frame = planner.Planner(spark, catalog)
    stages = P.parse(source)
    used = {planner.ID} | {x for s in stages for x in planner._names(s)}
    s = None
    with planner.wrapping(spark):
        for k, stage in enumerate(stages):
            s = frame.step(s, stage, stages[k + 1 :], used, False)
        s.moved = False
        return frame.finish(s)
