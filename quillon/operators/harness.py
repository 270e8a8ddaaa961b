"""A run of stages: each stage's table is published as it is finished, a run that stops goes on with the next one."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from quillon.streaming.progress import RunState, current, publish

Stage = Callable[[Mapping[str, DataFrame]], DataFrame]


def run_stages(spark: SparkSession, folder: str, stages: Sequence[tuple[str, Stage]], state: RunState | None = None) -> dict[str, DataFrame]:
    """The tables of all stages by name; a stage gets those of the stages before it.

    A stage whose table is in ``folder`` is not run again.  ``state`` has the
    stage that runs, how many are done, and how the run ended; a failure is kept
    there and raised.  Names of stages are unique.
    """
    if len({name for name, _ in stages}) != len(stages):
        raise ValueError("two stages have one name")
    tell = (lambda **x: None) if state is None else state.update
    done: dict[str, DataFrame] = {}
    for number, (name, stage) in enumerate(stages):
        found = current(spark, f"{folder}/{name}")
        if found is None:
            tell(stage=name, stages_done=number, status="running")
            try:
                publish(stage(dict(done)), f"{folder}/{name}", "v")
            except Exception as error:
                tell(status="failed", error=f"{type(error).__name__}: {error}"[:500])
                raise
            found = current(spark, f"{folder}/{name}")
        done[name] = found
    tell(stage=None, stages_done=len(stages), status="done")
    return done
