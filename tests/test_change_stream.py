"""The stream of changes against changes of one snapshot after another, however the snapshots are split into batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marquee.operators import changes
from marquee.streaming import jobs

KEYS = ["source", "external_id"]
SCHEMA = "source string, external_id string, title string, category string, start_at timestamp_ntz, price_text string, ticket_url string, ord long, seen_at timestamp_ntz"
AT = datetime(2026, 8, 1, 12)


def snapshots(seed, n=4):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        rows = []
        for s in "ab":
            for x in [str(i) for i in range(9)] + [None]:
                if rng.random() < 0.7:
                    rows.append((s, x, rng.choice(["T", "U", None]), "c", AT + timedelta(hours=rng.randint(0, 1), microseconds=rng.choice([0, 250])), rng.choice(["5", "6"]), rng.choice([None, "", "u", "v"]), k, AT + timedelta(days=k)))
        out.append(rows)
    return out


@pytest.mark.parametrize("files", [1, 2, 4])
def test_stream_equals_batch_in_any_split(spark, tmp_path, files):
    some = snapshots(files)
    for k, rows in enumerate(some):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(f"{tmp_path}/in")
    jobs.change_stream(stream, KEYS).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(300)
    out = spark.read.parquet(f"{tmp_path}/out")
    got = sorted(map(tuple, out.where("change_type <> 'seen'").select("ord", *KEYS, "change_type", "field_name", "old_value", "new_value").collect()), key=str)
    names = SCHEMA.replace(", ord long, seen_at timestamp_ntz", "")
    old, want = spark.createDataFrame([], names), []
    for k, rows in enumerate(some):
        new = spark.createDataFrame([r[:7] for r in rows], names)
        want += [(k, *r) for r in changes.changes(old, new, KEYS).select(*KEYS, "change_type", "field_name", "old_value", "new_value").collect()]
        old = spark.createDataFrame(changes.upserted(old, new, KEYS, ()).collect(), names)
    assert got == sorted(want, key=str) and len(got) > 40
    seen = {(r.source, r.external_id): (r.first, r.last) for r in out.groupBy(*KEYS).agg(F.min("first_seen_at").alias("first"), F.max("last_seen_at").alias("last")).collect()}
    times = {}
    for rows in some:
        for r in rows:
            times.setdefault(r[:2], []).append(r[8])
    assert seen == {k: (min(v), max(v)) for k, v in times.items()}


def test_late_rows_change_nothing(spark, tmp_path):
    row = lambda title, k: ("a", "1", title, None, AT, None, None, k, AT + timedelta(days=k))
    start = lambda: jobs.change_stream(jobs.stream_of(spark, f"{tmp_path}/in", SCHEMA), KEYS).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(300)
    for rows in ([row("B", 2)], [row("A", 1), row("C", 3)], [row("X", 3)]):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        start()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.ord, r.change_type, r.new_value) for r in got.where("change_type <> 'seen'").collect()) == [(2, "event_created", None), (3, "field_changed", "C")]
    last = got.where("change_type = 'seen'").orderBy(F.desc("ord"), "first_seen_at").first()
    assert (last.first_seen_at, last.last_seen_at) == (AT + timedelta(days=1), AT + timedelta(days=3))
