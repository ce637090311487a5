"""How far running queries are."""

from __future__ import annotations

from pyspark.sql import SparkSession


def progress(spark: SparkSession, group: str | None = None) -> float:
    """The share, 0 to 1, of finished tasks in the stage that is furthest, of all running jobs or those of a job group; 1 if none runs.

    Rough, as the number of stages to come isn't known: a query consists of several."""
    tracker = spark.sparkContext.statusTracker()
    jobs = tracker.getActiveJobsIds() if group is None else tracker.getJobIdsForGroup(group)
    running = [info for j in jobs if (info := tracker.getJobInfo(j)) is not None and info.status == "RUNNING"]
    stages = [s for info in running for i in info.stageIds if (s := tracker.getStageInfo(i)) is not None]
    if not running:
        return 1.0
    return max((s.numCompletedTasks / s.numTasks for s in stages if s.numTasks and s.numCompletedTasks < s.numTasks), default=0.0)
