"""Topologies: named sources and tasks, each task fed by one of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.sources.sinks import wipe, write_stream


@dataclass(frozen=True)
class Config:
    """dry_run writes nothing; persist keeps frames that feed several tasks; target_root is where target streams go.

    A cold start deletes what was written there before.
    """

    topology: str = "topology"
    dry_run: bool = False
    cold_start: bool = False
    persist: bool = True
    target_root: str | None = None
    requester: str | None = None
    requestees: tuple[str, ...] = ()


@dataclass
class _Task:
    fn: Callable
    source: str
    options: dict
    target: str | None
    windowed: bool


@dataclass
class Pipeline:
    config: Config = field(default_factory=Config)
    sources: dict[str, DataFrame] = field(default_factory=dict)
    tasks: dict[str, _Task] = field(default_factory=dict)

    def source(self, name: str, df: DataFrame) -> Pipeline:
        self._new(name)
        if self.config.requestees:
            df = df.filter(F.col("user_key").cast("string").isin(*self.config.requestees))
        self.sources[name] = df
        return self

    def task(self, name: str, fn: Callable[..., DataFrame], *, source: str, window: str | None = None, target: str | None = None, **options) -> Pipeline:
        """``fn(df, **options)``; ``window`` is given on as ``unit`` and only to tasks that take one."""
        self._new(name)
        if source not in self.sources and source not in self.tasks:
            raise ValueError(f"{name}: no source {source!r}")
        takes = "unit" in fn.__code__.co_varnames[: fn.__code__.co_argcount + fn.__code__.co_kwonlyargcount]
        if window is not None:
            if not takes:
                raise TypeError(f"{name} has no window")
            options = options | {"unit": window}
        self.tasks[name] = _Task(fn, source, options, target, takes)
        return self

    def _new(self, name: str) -> None:
        if name in self.sources or name in self.tasks:
            raise ValueError(f"{name!r} is taken")

    def origins(self, name: str) -> list[str]:
        while name in self.tasks:
            name = self.tasks[name].source
        return [name]

    def build(self) -> dict[str, DataFrame]:
        """Every task's result, with where it comes from; lazy but for what is persisted."""
        frames, raw = {}, dict(self.sources)
        fed = [t.source for t in self.tasks.values()]
        for name, task in self.tasks.items():
            out = task.fn(raw[task.source], **task.options)
            if self.config.persist and fed.count(name) > 1:
                out = out.persist()
            raw[name] = out
            frames[name] = out.withColumn("generator", F.struct(F.lit(self.config.topology).alias("topology"), F.lit(name).alias("component"), F.array(*map(F.lit, self.origins(name))).alias("sources")))
        return frames

    def run(self) -> dict[str, DataFrame]:
        """Builds, and writes the tasks that have a target."""
        frames = self.build()
        for name, task in self.tasks.items():
            if task.target and self.config.target_root:
                frame = frames[name]
                at = next((c for c in ("ts", "first_ts", "at", "win_begin") if c in frame.columns), None)
                keyed = frame.withColumn("ts", F.col(at)) if at else frame
                if self.config.cold_start and not self.config.dry_run:
                    wipe(frame.sparkSession, f"{self.config.target_root}/{task.target}")
                # A record has a time.
                keyed = keyed.withColumn("ts", F.coalesce("ts", F.raise_error(F.lit(f"{name}: a record without a time")).cast("timestamp")))
                keyed = keyed if "seq" in keyed.columns else keyed.withColumn("seq", F.lit(0))
                write_stream(keyed, f"{self.config.target_root}/{task.target}", dry_run=self.config.dry_run)
        return frames
