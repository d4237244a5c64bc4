"""A user measurement over pairs of binary frames, at scale, with errors as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

MEASURE_COLUMNS = "value double, rest_value double, quality string, notes string, error string"


def measure_pairs(frames: DataFrame, keys: list[str], measure: Callable[[bytes, bytes | None], dict],
                  done: DataFrame | None = None) -> DataFrame:
    """Applies ``measure(frame, rest)`` to every row of ``frames`` (keys, content, rest).

    The function returns value, rest_value, quality and notes; an exception becomes the
    row's ``error``. Finished keys are dropped before the Python stage, because filters
    do not move through it.
    """
    todo = frames.join(done.select(*keys), keys, "left_anti") if done is not None else frames
    todo = todo.select(*keys, "content", "rest")
    ddl = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for content, rest in zip(b["content"], b["rest"]):
                try:
                    out.append({**measure(content, rest), "error": None})
                except Exception as e:
                    out.append({"quality": "none", "error": f"{type(e).__name__}: {e}"})
            res = pd.DataFrame(out, columns=["value", "rest_value", "quality", "notes", "error"])
            yield pd.concat([b[keys].reset_index(drop=True), res], axis=1)

    return todo.mapInPandas(run, f"{ddl}, {MEASURE_COLUMNS}")
