import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from lodequery.llm import jaccard, phrase_index, quality

from .test_classifiers import plain_quality
from .test_jaccard import brute as plain_groups
from .test_mixture import brute as plain_mixture

SF = "/root/testdata/sf0.001"


def test_stages_keep_and_drop_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = C.quality(spark, docs, SF)
    assert kept.columns == C.COLUMNS
    assert ids(kept) == sorted(r.doc_id for r in quality.quality_scores(docs, labels, cut=C.SURELY_BAD).where("keep").collect())
    clean = {r.doc_id for r in labels.where("quality = 1").collect()} & set(ids(docs))
    assert len(clean & set(ids(kept))) >= 0.98 * len(clean)
    one = C.near_duplicates(spark, docs, SF)
    groups = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(docs).collect()}
    assert one.columns == C.COLUMNS and ids(one) == sorted(set(groups.values()))
    free = C.decontamination(spark, docs, SF)
    hit = {r.doc_id for r in phrase_index.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
    assert free.columns == C.COLUMNS and hit and ids(free) == sorted(set(ids(docs)) - hit)
    mixed = C.mixing(spark, docs, SF)
    assert mixed.columns == C.COLUMNS and set(ids(mixed)) == set(ids(docs)) and len(ids(mixed)) >= docs.count()


def test_token_files_keep_the_mixtures_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 10 == 0, "rare").otherwise("usual"))
    C.mixing(spark, docs, SF).write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    laid = [r.doc_id for name in sorted(os.listdir(tmp_path / "mixed")) if name.endswith(".parquet") for r in spark.read.parquet(str(tmp_path / "mixed" / name)).collect()]
    out = [r.doc_id for r in C.token_planes(spark, mixed, SF).orderBy("start").collect()]
    assert out == laid and out != sorted(out)
    again = [k for k in range(1, len(out)) if out[k] == out[k - 1]]
    assert len(out) > len(set(out)) and len(again) < (len(out) - len(set(out))) / 4  # repeats lie apart


@pytest.mark.parametrize("stage", [s for _, s in C.STAGES], ids=[n for n, _ in C.STAGES])
def test_stages_take_nulls_repeats_and_nothing(spark, stage):
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (None, "x y z", None, None, None), (2, None, "en", "s", None), (3, "", "en", "t", 0), (4, "w " * 20_000, "en", "t", 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = stage(spark, docs, SF).collect()
    assert len(got) >= 2
    assert stage(spark, docs.limit(0), SF).collect() == []


def test_run_against_brute_force(spark):
    """Every stage again in plain Python; the rows of the last one, and which documents each stage leaves."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = plain_quality(spark)
    left = {i for i in docs if good[i] >= C.SURELY_BAD}
    assert left < set(docs)
    groups, *_ = plain_groups([(i, docs[i].text) for i in sorted(left)])
    left = {i for i, n, first in groups if i == first or not n}
    assert len(left) < len(groups)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
    runs = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    windows = set().union(*(runs(w, min(len(w), 10)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (w := words(r.text))))
    sizes = {len(w) for w in windows}
    hit = {i for i in left if any(runs(words(docs[i].text), n) & windows for n in sizes)}
    assert hit
    left -= hit
    drawn, *_ = plain_mixture([(i, docs[i].text, docs[i].source) for i in sorted(left)])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, *_ in drawn:
        ids = np.asarray([*library.encode(docs[i].text or "", add_special_tokens=False).ids, 2], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    out = C.run(spark, SF).orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    assert [r.start for r in out] == np.cumsum([0, *(r.n_tokens for r in out)])[:-1].tolist()
    assert 4 <= len(C.STAGES) <= 5
