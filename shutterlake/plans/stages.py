"""A registry of named image stages and the fold that runs a job's stages over one image after the other.

A stage is a callable ``(image, context) -> (image, report)`` or ``-> image``.
The fold runs inside Arrow batches: a row is a job's image, and stages never see
more than one image at a time.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

IMAGE = "struct<h:int,w:int,c:int,data:binary>"
REPORT = "array<struct<name:string,applied:boolean,skipped:boolean,error:string,reason:string,duration_ms:double,metrics:map<string,double>,artifacts:map<string,string>>>"


@dataclass
class Context:
    job_id: str
    stage: str
    params: dict
    seed: int | None = None


@dataclass
class Outcome:
    name: str
    applied: bool = True
    skipped: bool = False
    error: str | None = None
    reason: str = ""
    duration_ms: float = 0.0
    metrics: dict = field(default_factory=dict)
    artifacts: dict = field(default_factory=dict)


class Registry:
    def __init__(self):
        self._stages: dict[str, Callable] = {}

    def register(self, name: str, stage: Callable | None = None):
        """Adds a stage or replaces the one of that name; a decorator if no stage is given."""
        if stage is None:
            return lambda f: self.register(name, f)
        self._stages[name] = stage
        return stage

    def snapshot(self) -> dict[str, Callable]:
        return dict(self._stages)

    def run(self, image: np.ndarray, names: list[str], params: dict | None = None, job_id: str = "", seed: int | None = None, halt: bool = False, strict: bool = False) -> tuple[np.ndarray, list[Outcome]]:
        """The image after all stages, and an outcome for each.

        An unknown stage is skipped (or a KeyError if ``strict``); a failing one
        leaves the image as it was, and with ``halt`` ends the job.
        """
        outcomes: list[Outcome] = []
        for name in names:
            stage = self._stages.get(name)
            if stage is None:
                if strict:
                    raise KeyError(name)
                outcomes.append(Outcome(name, applied=False, skipped=True, reason="unknown stage"))
                continue
            begun = time.perf_counter()
            try:
                made = stage(image, Context(job_id, name, (params or {}).get(name, {}), seed))
                made, told = made if isinstance(made, tuple) else (made, Outcome(name))
                if not isinstance(made, np.ndarray):
                    told = Outcome(name, applied=False, skipped=True, reason="no image")
                else:
                    image = made
            except Exception as e:  # a stage's failure is its outcome
                told = Outcome(name, applied=False, error=f"{type(e).__name__}: {e}"[:256])
            told.name, told.duration_ms = name, (time.perf_counter() - begun) * 1000
            outcomes.append(told)
            if told.error and halt:
                break
        return image, outcomes


def to_array(image) -> np.ndarray:
    return np.frombuffer(image["data"], np.uint8).reshape((image["h"], image["w"], image["c"]) if image["c"] > 1 else (image["h"], image["w"]))


def to_struct(array: np.ndarray) -> dict:
    return {"h": array.shape[0], "w": array.shape[1], "c": array.shape[2] if array.ndim == 3 else 1, "data": np.ascontiguousarray(array, np.uint8).tobytes()}


def run_jobs(jobs: DataFrame, registry: Registry, *, halt: bool = False) -> DataFrame:
    """``job_id, image, report, halted`` of jobs (job_id, image, stages array<string>, params JSON string, seed).

    Images are large: keep ``spark.sql.execution.arrow.maxRecordsPerBatch`` low.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for job in batch.itertuples(index=False):
                seed = None if pd.isna(job.seed) else int(job.seed)
                image, outcomes = registry.run(to_array(job.image), list(job.stages), json.loads(job.params or "{}"), job.job_id, seed, halt)
                rows.append((job.job_id, to_struct(image), [vars(o) for o in outcomes], bool(halt and outcomes and outcomes[-1].error)))
            yield pd.DataFrame(rows, columns=["job_id", "image", "report", "halted"])

    return jobs.select("job_id", "image", "stages", "params", "seed").mapInPandas(run, f"job_id string, image {IMAGE}, report {REPORT}, halted boolean")


def builtin() -> Registry:
    """Stages over the imaging kernels; a stage's parameters are the kernel's."""
    from shutterlake.functions import imaging

    registry = Registry()
    for name in ("highlights", "shadows", "saturation", "vibrance", "unsharp", "gamma", "white_balance", "texture", "clarity", "gray_world"):
        registry.register(name, lambda image, context, f=getattr(imaging, name): f(image, **context.params))
    return registry
