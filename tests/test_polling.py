import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from strandline.operators import ordering
from strandline.session import with_workers
from strandline.sources.polling import PollingSource
from strandline.sources.sinks import read_target
from strandline.streaming.stateful import run_to_target, stream_gate


class Steps(PollingSource):
    """A service that is a file: user -> number of records, one a minute."""

    def _all(self):
        with open(self.options["at"]) as f:
            return json.load(f)

    def users(self):
        return list(self._all())

    def latest(self, user):
        n = self._all()[user]
        return (n - 1) * 60_000 if n else None

    def fetch(self, user, since_ms, until_ms):
        zero = datetime(1970, 1, 1, tzinfo=timezone.utc)
        for i in range(self._all()[user]):
            if since_ms <= i * 60_000 <= until_ms:
                yield user, i, zero + timedelta(minutes=i), "+00:00", str(i)


def test_polls_go_on_per_user(spark, tmp_path):
    import test_polling
    from pyspark import cloudpickle

    # Workers cannot import a module of tests.
    cloudpickle.register_pickle_by_value(test_polling)
    with_workers(spark)
    spark.dataSource.register(Steps)
    service = tmp_path / "service.json"

    def run(state):
        service.write_text(json.dumps(state))
        stream = spark.readStream.format("steps").option("at", str(service)).option("since", "1970-01-01T00:02:00Z").load()
        run_to_target(stream_gate(stream), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        return {r.user_key: r.n for r in read_target(spark, f"{tmp_path}/out").groupBy("user_key").agg(F.count("*").alias("n")).collect()}

    assert run({"a": 5, "b": 3, "c": 0}) == {"a": 3, "b": 1}
    assert run({"a": 5, "b": 6, "c": 4}) == {"a": 3, "b": 4, "c": 2}
    assert run({"a": 5, "b": 6, "c": 4}) == {"a": 3, "b": 4, "c": 2}
    whole = spark.read.format("steps").option("at", str(service)).load()
    assert whole.count() == 15 and ordering.monotonic_gate(whole).count() == 15
