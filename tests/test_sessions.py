"""The stream of click sessions gives what the batch gives, with late and repeated events."""

import random

from rasterloom.streaming import sessions as S

SCHEMA = "key string, ts timestamp, seq long, kind string, x double, y double, iou double, area double, corners int"


def events(rng, n):
    kinds = ["start", "start", "refine", "refine", "confirm", "cancel"]
    return [(rng.choice("abc"), t, i, rng.choice(kinds), float(i), float(-i), rng.choice([None, 0.4, 0.5, 0.9, 0.9, 0.9]), rng.choice([0.1, 0.2, 0.7, 0.71, None]), rng.choice([2, 3, 8, 8, None])) for i, t in enumerate(sorted(rng.randrange(3000) for _ in range(n)))]


def by_hand(rows):
    out, open_ = [], {}
    for key, ts, _, kind, x, y, iou, area, corners in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if kind == "start" and None not in (iou, area) and iou >= 0.5 and area <= 0.7:
            open_[key] = [ts, x, y, 1, corners]
        elif kind == "refine" and open_.get(key):
            open_[key][3:] = [open_[key][3] + 1, corners]
        elif kind in ("confirm", "cancel"):
            s = open_.pop(key, None)
            if s and kind == "confirm" and (s[4] or 0) >= 3:
                out.append((key, s[0], ts, *s[1:]))
    return sorted(out)


def plain(df):
    return sorted((r.key, int(r.started.timestamp()), int(r.ended.timestamp()), r.x, r.y, r.points, r.corners) for r in df.collect())


def table(spark, rows):
    raw = spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts long"))
    return raw.selectExpr("key", "timestamp_seconds(ts) ts", "seq", "kind", "x", "y", "iou", "area", "corners")


def test_batch(spark):
    rows = events(random.Random(1), 400)
    want = by_hand(rows)
    assert len(want) > 10
    assert plain(S.confirmed(table(spark, rows + rows[::7]).repartition(5))) == want
    assert S.confirmed(table(spark, rows).limit(0)).count() == 0


def test_stream_is_the_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = events(rng, 500)
    end = [("z", 100_000, 10_000, "cancel", 0.0, 0.0, None, None, None), ("z", 200_000, 10_001, "cancel", 0.0, 0.0, None, None, None)]
    arrived = sorted(rows, key=lambda r: r[1] + rng.randrange(500))  # less late than the watermark allows
    arrived = [r for r in arrived for _ in range(2 if r[2] % 5 == 0 else 1)]
    parts = [arrived[i : i + 40] for i in range(0, len(arrived), 40)] + [end[:1], end[1:]]
    for part in parts:
        table(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        stream = spark.readStream.schema(table(spark, end).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = S.confirmed_stream(stream).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = by_hand(rows)
    assert plain(spark.read.parquet(f"{tmp_path}/out")) == want and len(want) > 15
