"""A source that is asked, user by user, for what is new: subclass ``PollingSource`` and register it.

    class Steps(PollingSource):
        def users(self): ...
        def latest(self, user): ...
        def fetch(self, user, since_ms, until_ms): ...

    spark.dataSource.register(Steps)
    spark.readStream.format("steps").option("since", "2024-01-01T00:00:00Z").load()

A stream's offset holds for each user the time of the last record taken. Each
user is a partition of its own, so executors fetch side by side. A poll begins
at that time again, since more records may bear it; the gate drops what comes
twice. A new user begins at ``since``.

That offset grows with the users. For many of them, name a folder that driver and executors
share, as ``state``: then the offset is one number, the time of the poll, and what each user has been
asked for lies there, a file for each poll and group of users. A poll takes at most ``max_records`` of a user
and goes on where it stopped; ``groups`` tasks read side by side, and the driver asks no user
anything. No record is taken twice or left out, as long as what a user has up to the time of a poll, and its order, stays.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "user_key string, seq long, ts timestamp, tz string, data string"


class UserSpan(InputPartition):
    def __init__(self, user: str, since_ms: int, until_ms: int) -> None:
        self.user, self.since_ms, self.until_ms = user, since_ms, until_ms


class PollingSource(DataSource):
    """The hooks; the name of the format is the class's in lower case."""

    @classmethod
    def name(cls) -> str:
        return cls.__name__.lower()

    def schema(self) -> str:
        return SCHEMA

    def users(self) -> list[str]:
        """Whom to ask for; may grow from poll to poll."""
        raise NotImplementedError

    def latest(self, user: str) -> int | None:
        """Epoch milliseconds of the user's last record at present, None without any."""
        raise NotImplementedError

    def fetch(self, user: str, since_ms: int, until_ms: int) -> Iterator[tuple]:
        """The user's records between two times, both inclusive, in order: rows of the schema. Runs on executors."""
        raise NotImplementedError

    def since_ms(self) -> int:
        text = self.options.get("since")
        return int(datetime.fromisoformat(text).astimezone(timezone.utc).timestamp() * 1000) if text else 0

    def ends(self) -> dict[str, int]:
        found = {user: self.latest(user) for user in self.users()}
        return {user: at for user, at in found.items() if at is not None}

    def reader(self, schema) -> DataSourceReader:
        return _Once(self)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _BoundedPolls(self) if self.options.get("state") else _Polls(self)

    def now_ms(self) -> int:
        return int(time.time() * 1000)

    def users_of(self, group: int, groups: int) -> list[str]:
        """The users of one of so many groups, always the same ones. Runs on executors; a service that can list a part at once should."""
        return [u for u in self.users() if zlib.crc32(u.encode()) % groups == group]


class _Once(DataSourceReader):
    def __init__(self, source: PollingSource) -> None:
        self.source = source

    def partitions(self) -> list[InputPartition]:
        since = self.source.since_ms()
        return [UserSpan(user, since, at) for user, at in sorted(self.source.ends().items()) if at >= since]

    def read(self, partition: UserSpan) -> Iterator[tuple]:
        return iter(self.source.fetch(partition.user, partition.since_ms, partition.until_ms)) if partition else iter(())


class _Polls(DataSourceStreamReader):
    def __init__(self, source: PollingSource) -> None:
        self.source = source

    def initialOffset(self) -> dict:
        return {"users": "{}"}

    def latestOffset(self) -> dict:
        return {"users": json.dumps(self.source.ends(), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, now, since = json.loads(start["users"]), json.loads(end["users"]), self.source.since_ms()
        spans = [UserSpan(user, max(since, before.get(user, since)), at) for user, at in sorted(now.items()) if before.get(user) != at]
        return [s for s in spans if s.since_ms <= s.until_ms]

    def read(self, partition: UserSpan) -> Iterator[tuple]:
        return iter(self.source.fetch(partition.user, partition.since_ms, partition.until_ms))


class Group(InputPartition):
    def __init__(self, group: int, start: int, end: int) -> None:
        self.group, self.start, self.end = group, start, end


class _State:
    """What users have been asked for: user -> (time of the last record taken, records taken of that time)."""

    def __init__(self, uri: str) -> None:
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")

    def folder(self, poll: int) -> str:
        return f"{self.root}/poll={poll:020d}"

    def load(self, poll: int, group: int) -> dict[str, list[int]]:
        with self.fs.open_input_stream(f"{self.folder(poll)}/{group}.json") as f:
            return json.loads(f.read())

    def save(self, poll: int, group: int, taken: dict[str, list[int]]) -> None:
        """Whole or not at all; a task that is run again replaces its file."""
        self.fs.create_dir(self.folder(poll), recursive=True)
        part = f"{self.folder(poll)}/.{group}-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as f:
            f.write(json.dumps(taken).encode())
        self.fs.move(part, f"{self.folder(poll)}/{group}.json")

    def drop_before(self, poll: int) -> None:
        """Polls older than the one before ``poll``, which a query that starts again may still read."""
        found = sorted(x.path for x in self.fs.get_file_info(pyarrow.fs.FileSelector(self.root, allow_not_found=True)) if x.path < self.folder(poll))
        for path in found[:-1]:
            self.fs.delete_dir(path)


class _BoundedPolls(DataSourceStreamReader):
    def __init__(self, source: PollingSource) -> None:
        self.source = source
        self.groups = int(source.options.get("groups", "8"))
        self.most = int(source.options.get("max_records", "10000"))

    def initialOffset(self) -> dict:
        return {"poll": -1}

    def latestOffset(self) -> dict:
        return {"poll": self.source.now_ms()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Group(g, start["poll"], end["poll"]) for g in range(self.groups)] if end["poll"] > start["poll"] else []

    def read(self, partition: Group) -> Iterator[tuple]:
        state, since = _State(self.source.options["state"]), self.source.since_ms()
        taken = state.load(partition.start, partition.group) if partition.start >= 0 else {}
        for user in self.source.users_of(partition.group, self.groups):
            at, n = taken.get(user, (since, 0))
            skip, rows = n, 0
            if partition.end < at:
                continue
            for row in self.source.fetch(user, at, partition.end):
                if skip:
                    skip -= 1
                    continue
                if rows == self.most:
                    break
                t = round(row[2].timestamp() * 1000)
                at, n, rows = t, n + 1 if t == at else 1, rows + 1
                yield row
            if rows:
                taken[user] = [at, n]
        state.save(partition.end, partition.group, taken)

    def commit(self, end: dict) -> None:
        _State(self.source.options["state"]).drop_before(end["poll"])
