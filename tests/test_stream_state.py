"""Requests on a stream: what is kept between batches, and what is given whatever the order of the steps."""

import random

import pytest
from pyspark.sql import functions as F

from lodequery.operators.multiprobe import MultiProbe
from lodequery.streaming import ingest


def documents(spark, nbits, n, seed=3):
    r = random.Random(seed)
    return spark.createDataFrame([(k, [r.gauss(0, 1) if i < 5 else 50.0 for i in range(nbits)]) for k in range(n)], "doc long, logits array<double>")


def stream(spark, path, s, limit, asked, **more):
    """Rows given, by batch, for lists of requests(q frame, first, after) that come one list a batch; and the last batch's state rows."""
    given, state = [], 0
    for k, requests in enumerate(asked):
        frames = [q.select("q", "logits", F.lit(a).alias("first"), F.lit(b).alias("after")) for q, a, b in requests]
        for f in frames[1:]:
            frames[0] = frames[0].union(f)
        frames[0].coalesce(1).write.mode("append").parquet(f"{path}/requests")
        source = spark.readStream.schema("q long, logits array<double>, first int, after int").parquet(f"{path}/requests")
        out = ingest.first_hits(source, s, limit, **more).writeStream.format("parquet").option("path", f"{path}/hits").option("checkpointLocation", f"{path}/offsets")
        run = out.trigger(availableNow=True).start()
        run.awaitTermination()
        state = max([o["numRowsTotal"] for p in run.recentProgress for o in p["stateOperators"]])
        rows = [tuple(x) for x in spark.read.schema("q long, step long, doc long").parquet(f"{path}/hits").collect()]
        given.append(rows)
    return given, state


def wanted(s, q, limit, ranges):
    """By the plain definition: of each query the steps in the order of the batches, each document once."""
    keys = {}
    for t, c, d in s.index.collect():
        keys.setdefault((t, c), []).append(d)
    probes, out, had = sorted(tuple(x) for x in s.probes(q, limit).select("q", "step", "table_no", "code").collect()), [], set()
    for first, after in ranges:
        for a, step, t, c in probes:
            if first <= step < after:
                out += [(a, step, d) for d in keys.get((t, c), []) if (a, d) not in had]
                had |= {(a, d) for d in keys.get((t, c), [])}
    return sorted(out)


@pytest.mark.parametrize("nbits", [5, 63])  # keys of one number, and of two
def test_state_is_a_row_for_each_query(spark, tmp_path, nbits):
    docs = documents(spark, nbits, 150)
    q = docs.where("doc % 10 = 0").withColumnRenamed("doc", "q")
    s = MultiProbe(spark, nbits, 2, 3).insert(docs)
    given, state = stream(spark, str(tmp_path), s, 6, [[(q, 4, 9)], [(q, 0, 3), (q, 2, 6)], [(q, 0, 12)]])
    assert sorted(given[0]) == wanted(s, q, 6, [(4, 9)]) and sorted(given[1]) == wanted(s, q, 6, [(4, 9), (0, 6)])
    assert sorted(given[2]) == wanted(s, q, 6, [(4, 9), (0, 12)])  # later steps first, two requests in a batch, steps asked for again
    assert state == 15


def test_growing_index_keeps_documents(spark, tmp_path):
    docs = documents(spark, 5, 90)
    q = docs.where("doc % 10 = 0").withColumnRenamed("doc", "q")
    some, whole = (MultiProbe(spark, 5, 2, 3).insert(d) for d in (docs.where("doc < 60"), docs))
    stream(spark, str(tmp_path), some, 6, [[(q, 0, 12)]], growing=True)
    given, _ = stream(spark, str(tmp_path), whole, 6, [[(q, 0, 12)]], growing=True)
    assert sorted(given[-1]) == sorted(tuple(x) for x in whole.candidates(q, 6).collect())
    assert whole.few(32) and not whole.few(33) and not whole.few(None)


def test_other_logits_give_no_document_again(spark, tmp_path):
    docs = documents(spark, 5, 120)
    q = docs.where("doc % 10 = 0").withColumnRenamed("doc", "q")
    turned = q.select("q", F.transform("logits", lambda x: -x).alias("logits"))
    s = MultiProbe(spark, 5, 2, 3).insert(docs)
    given, _ = stream(spark, str(tmp_path), s, 4, [[(q, 0, 8)], [(turned, 0, 8)], [(q, 0, 8)]])
    assert len(given[2]) == len(given[1]) > 0 and len({(a, d) for a, _, d in given[2]}) == len(given[2])
    both = {(a, d) for x in (q, turned) for a, _, d in s.candidates(x, 4).collect()}
    assert {(a, d) for a, _, d in given[2]} == both
