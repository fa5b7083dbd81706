"""Run plans and report times, rows and tasks of each step, by Observations inside the plans."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quern.operators.run_length import marked
from quern.order import BUCKET, bucket_offsets, bucket_totals, dealt_by_range, one_window
from quern.sequence import Sequence


@dataclass(frozen=True)
class Span:
    label: str
    duration: float
    rows: int
    #: Spark's tasks, over all stages that ran for it.
    tasks: int = 0


@dataclass
class Profile:
    """elapsed: from the first begin to the last end. stage_time: the sum of the spans."""

    elapsed: float = 0.0
    spans: list[Span] = field(default_factory=list)

    @property
    def stage_time(self) -> float:
        return sum(s.duration for s in self.spans)

    def labelled(self, prefix: str) -> list[Span]:
        return [s for s in self.spans if s.label.startswith(prefix)]

    def of_any_size(self) -> list[Span]:
        """The spans that a chain has whether its rows take one window or not: all but those of DEALT."""
        return [s for s in self.spans if s.label not in DEALT]


def _tasks(sc, group: str) -> int:
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(j)) for s in info.stageIds}
    return sum(info.numTasks for s in stages if (info := tracker.getStageInfo(s)))


def _run(label: str, df: DataFrame) -> Span:
    sc, group, seen = df.sparkSession.sparkContext, f"quern-{uuid.uuid4().hex}", Observation()
    sc.setJobGroup(group, label)
    try:
        began = time.perf_counter()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        return Span(label, time.perf_counter() - began, seen.get["rows"], _tasks(sc, group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)


def profile(steps: list[tuple[str, DataFrame]] | DataFrame) -> Profile:
    """Each step is executed by a no-op write and gives one span, in order; no steps, an empty profile."""
    steps = [("plan", steps)] if isinstance(steps, DataFrame) else steps
    out, first = Profile(), time.perf_counter()
    for label, df in steps:
        out.spans.append(_run(label, df))
        out.elapsed = time.perf_counter() - first
    return out


def phases(label: str, seq: Sequence, bucket: int = BUCKET, strategy: str = "auto") -> list[tuple[str, DataFrame]]:
    """What an operator of that label does to seq before its result is there, as plans of their own: bucket totals
    and their offsets for scans and run lengths, heads of runs, ranges for sorts. Others have one phase only."""
    single = one_window(seq.rows, seq.known_capacity(), strategy)
    if label == "scan" and not single:
        totals = bucket_totals(seq.reindexed().rows, "pos", F.col("value"), bucket)
        return [("scan.level.0", totals), ("scan.level.1", bucket_offsets(totals))]
    if label == "run_length":
        heads = marked(seq.reindexed(), strategy, bucket)
        found = [("run_length.mark", heads)]
        return found if single else [*found, ("run_length.scan.level.0", bucket_totals(heads, "pos", F.col("__head"), bucket))]
    if label == "sort" and not single:
        return [("sort.range", dealt_by_range(seq.rows, seq.order))]
    if label == "compact":
        return [("compact.count", seq.rows.filter("mask = 1").agg(F.count(F.lit(1)).alias("n")))]
    return []


#: Phases of which rows in one window have no need.
DEALT = {"scan.level.0", "scan.level.1", "run_length.scan.level.0", "sort.range"}

#: Label of the span in which an operator's result is made.
RESULT = {"scan": "scan.add.0", "run_length": "run_length.finalize", "sort": "sort.within", "compact": "compact.scatter", "histogram": "histogram.count"}


def profile_steps(seq: Sequence, steps: list[tuple[str, Callable]], **how) -> Profile:
    """Run operators one by one, each on the kept rows of the one before, with a span for each phase of each.

    steps: (label, operator), an operator from a sequence to a sequence or, as the last, to a DataFrame. how: bucket
    and strategy of the phases. What was kept is given back at the end.
    """
    out, first, held = Profile(), time.perf_counter(), []
    try:
        for label, f in steps:
            out.spans += [_run(phase, df) for phase, df in phases(label, seq, **how)]
            made = f(seq)
            df = (made.df if isinstance(made, Sequence) else made).persist()
            held.append(df)
            out.spans.append(_run(RESULT.get(label, label), df))
            seq = made.with_df(df) if isinstance(made, Sequence) else seq
            out.elapsed = time.perf_counter() - first
    finally:
        for df in held:
            df.unpersist()
    return out


def immediate(df: DataFrame) -> DataFrame:
    """Execute now and keep the rows for what reads them next; unpersist() gives them back."""
    kept = df.persist()
    kept.write.format("noop").mode("overwrite").save()
    return kept
