"""Stages of the pipeline judge rows, not ids: repeated and null ids."""

import corpus_pipeline as C

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def words(name, n=40):
    return " ".join(f"{name}{k}" for k in range(n))


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c, d = (words(x) for x in "abcd")
    rows = [(5, a), (5, b), (2, b + " end"), (7, c), (7, c), (8, c), (9, d), (None, d), (None, "x"), (4, ""), (4, None)]
    want = [(2, b + " end"), (4, ""), (4, ""), (5, a), (7, c), (9, d), (None, d), (None, "x")]
    got = [(i, t or "") for i, t in left(C.near_duplicates(spark, table(spark, rows), SF))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_decontamination_of_null_and_repeated_ids(spark):
    passage = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect() if len(r.text.split()) >= 10)
    bad, good = f"before {passage} after", words("clean")
    got = left(C.decontamination(spark, table(spark, [(None, bad), (None, good), (1, bad), (1, good), (2, bad), (3, None)]), SF))
    assert got == [(1, good), (3, None), (None, good)]


def test_row_keys_are_places(spark, tmp_path):
    """No two rows share a key, whatever they hold and wherever they are read from; a key is the same at each reading."""
    docs = table(spark, [(k % 3, "same") for k in range(50)])
    plain, split = str(tmp_path / "plain"), str(tmp_path / "split")
    docs.repartition(3).write.parquet(plain)
    docs.repartition(2).write.option("maxRecordsPerFile", 10).parquet(split)  # files that share a number
    for d in (docs, spark.read.parquet(plain), spark.read.parquet(split), docs.limit(0)):
        rows = C._keyed(d)
        keys = [r._key for r in rows.collect()]
        assert rows.columns == [*C.COLUMNS, "_key"] and None not in keys and len(set(keys)) == len(keys) == d.count()
        assert sorted(keys) == sorted(r._key for r in rows.where("text = 'same'").collect())
