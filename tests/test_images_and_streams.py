"""Packed image files, mosaics' pixels, and streams of requests that keep what they have given."""

import gzip
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodequery.operators.multiprobe import MultiProbe
from lodequery.sources import datasets, imagefiles
from lodequery.streaming import ingest


def idx(x: np.ndarray) -> bytes:
    return struct.pack(f">BBBB{x.ndim}I", 0, 0, 8, x.ndim, *x.shape) + x.astype(">u1").tobytes()


def test_reading_packed_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = {name: rng.integers(0, 256, (n, 3, 2)) for name, n in (("train/a", 50), ("train/b", 7), ("valid/c", 20))}
    y = {name: rng.integers(0, 10, len(v)) for name, v in x.items()}
    for name, v in x.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        if name == "train/b":
            (tmp_path / f"{name}.idx3.gz").write_bytes(gzip.compress(idx(v)))  # and no labels
        else:
            (tmp_path / f"{name}.idx3").write_bytes(idx(v))
            (tmp_path / f"{name}.idx1").write_bytes(idx(y[name]))
    df = imagefiles.read(spark, str(tmp_path), range_bytes=60)
    assert df.rdd.getNumPartitions() == 5 + 1 + 2  # ten images of 6 bytes each
    rows = {r.id: r for r in df.collect()}
    at = 0
    for name in ("train/a", "train/b", "valid/c"):
        for k, v in enumerate(x[name]):
            r = rows[at + k]
            assert (r.split, r.label, r.height, r.width) == (name[:5], None if name == "train/b" else y[name][k], 3, 2)
            assert r.pixels == v.reshape(-1).tolist()
        at += len(x[name])
    assert len(rows) == at
    few = imagefiles.read(spark, str(tmp_path), "id long, label int")
    assert few.columns == ["id", "label"] and few.count() == at
    assert {r.split for r in df.where("split = 'valid'").select("split").collect()} == {"valid"} and df.where("split in ('valid', 'x') and label > 4").count() == int((y["valid/c"] > 4).sum())
    reader = imagefiles.ImageReader(df.schema, {"path": str(tmp_path), "rangebytes": "60"})
    left = list(reader.pushFilters([imagefiles.EqualTo(("split",), "valid"), imagefiles.EqualTo(("label",), 3)]))
    assert [f.attribute for f in left] == [("label",)] and {p.split for p in reader.partitions()} == {"valid"}
    assert [p.id for p in reader.partitions()] == [57, 67]  # ids don't depend on what is left out


def test_writing_packed_images(spark, tmp_path):
    rows = [((1 << 60) + k, "train" if k % 3 else "test", k % 4, [float(k), -1.5, 0.25, k / 8]) for k in range(50)]
    df = spark.createDataFrame(rows, "id long, split string, label int, pixels array<float>").repartition(3)
    imagefiles.write(df, str(tmp_path / "out"), 2, 2, 7)
    got = imagefiles.read(spark, str(tmp_path / "out"))
    assert sorted((r.id, r.split, r.label, r.pixels) for r in got.collect()) == sorted(rows)
    imagefiles.write(df.limit(0), str(tmp_path / "none"), 2, 2)
    for wrong in (df.withColumn("label", F.lit(None).cast("int")), df.withColumn("pixels", F.array(F.lit(1.0)))):
        with pytest.raises(Exception, match="label|pixels"):
            imagefiles.write(wrong, str(tmp_path / "wrong"), 2, 2)
    (tmp_path / "bad" / "x").mkdir(parents=True)
    (tmp_path / "bad" / "x" / "a.idx3").write_bytes(b"nothing")
    with pytest.raises(Exception, match="IDX"):
        imagefiles.read(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "empty").mkdir()
    assert imagefiles.read(spark, str(tmp_path / "empty")).collect() == []


def test_mosaics_have_their_parts_pixels(spark):
    h, w = 3, 5
    images = {k: np.arange(h * w).reshape(h, w) + 100.0 * k for k in range(9)}
    df = spark.createDataFrame([(k, v.reshape(-1).tolist()) for k, v in images.items()], "part long, x array<double>")
    slots = datasets.mosaics(df, "part", 20, 6, 4, 3)
    got = datasets.mosaic_images(slots, df, h, w, across=2, down=3).collect()
    assert len(got) == 20
    for r in got:
        want = np.block([[images[p] for p in r.parts[2 * y : 2 * y + 2]] for y in range(3)])
        assert r.x == want.reshape(-1).tolist()
    for lacking in (df.where("part <> 4"), df.withColumn("x", F.slice("x", 1, 4))):
        with pytest.raises(Exception, match="lacks"):
            datasets.mosaic_images(slots, lacking, h, w, across=2, down=3).collect()


def test_batches_of_mosaics(spark):
    df = spark.createDataFrame([(k, [100.0 * k + j for j in range(6)]) for k in range(30)], "part long, x array<double>")
    q, d, rel = datasets.mosaic_batch(df, 40, 2, 3, seed=8)
    parts = {r.doc: r.parts for r in d.collect()}
    queries = {r.q: r for r in q.collect()}
    assert set(parts) == set(queries) == set(range(40)) and all(queries[k].part in parts[k] for k in parts)
    assert all(r.x == [100.0 * r.part + j for j in range(6)] for r in queries.values())
    assert len({parts[k].index(queries[k].part) for k in parts}) > 1  # the slot is drawn
    assert {(r.q, r.doc): r.r for r in rel.collect()} == {(i, j): queries[i].part in parts[j] for i in parts for j in parts}
    noisy, _, _ = datasets.mosaic_batch(df, 40, 2, 3, 0.1, 8)
    off = [a - b for r in noisy.collect() for a, b in zip(r.x, queries[r.q].x)]
    assert 0.05 < np.std(off) < 0.15


def test_requests_in_three_batches_and_a_restart(spark, tmp_path):
    r = random.Random(9)
    docs = spark.createDataFrame([(k, [r.gauss(0, 1) for _ in range(5)]) for k in range(120)], "doc long, logits array<double>")
    q = docs.where("doc % 10 = 0").withColumnRenamed("doc", "q")
    s = MultiProbe(spark, 5, 2, 3).insert(docs)

    def run():
        requests = spark.readStream.schema("q long, logits array<double>, first int, after int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "requests"))
        out = ingest.first_hits(requests, s, 8, shards=3).writeStream.format("parquet").option("path", str(tmp_path / "hits")).option("checkpointLocation", str(tmp_path / "offsets"))
        out.trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(x) for x in spark.read.parquet(str(tmp_path / "hits")).select("q", "step", "doc").collect())

    ask = lambda first, after: q.select("q", "logits", F.lit(first).alias("first"), F.lit(after).alias("after")).coalesce(1).write.mode("append").parquet(str(tmp_path / "requests"))
    want = sorted(tuple(x) for x in s.candidates(q, 8).select("q", "step", "doc").collect())
    ask(0, 4)
    ask(2, 9)
    assert run() == [x for x in want if x[1] < 9]
    ask(9, 16)
    assert run() == want  # after a restart
    ask(0, 16)
    assert run() == want  # asked again, given nothing
