import io
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodequery.llm import bpe
from lodequery.llm.bpe import UnitEncoder
from lodequery.llm.planes import PlaneReader, PlaneWriter, from_planes, plane_output, to_planes, write_planes
from lodequery.llm.token_counts import ChunkCounter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = UnitEncoder(PATH, memo=50)
PIECES = [" ", "  ", "\n", "\n\n", "\t", " \n", "\u00a0", "\u2003", "\u3000", "\x1c", "a", "don't", "'s", "'", "''ll", "é", "×", "÷", "ȡ", "ɐ", "日本", "12", "²", "...", "e\u0301", "<|endoftext|>", "<|endoftext", "x" * 60, "🙂", "ñandú", "\u0085"]
ids = lambda t: LIBRARY.encode(t, add_special_tokens=False).ids
TEXT = st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=4)), max_size=30).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_units_give_the_librarys_ids(texts):
    got, at = ENCODER.encode(pa.array(texts, pa.string()))
    assert [got[a:b].tolist() for a, b in zip(at, at[1:])] == [ids(t or "") for t in texts]
    assert ENCODER.counts(pa.array(texts, pa.string())).tolist() == np.diff(at).tolist()


def test_chunks_of_a_text_and_units_longer_than_a_chunk(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 64)
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(PIECES + ["word", "and "] * 9) for _ in range(rnd.choice([0, 3, 400]))) for _ in range(60)]
    texts += ["y" * 500, " " * 300 + "z", "日" * 100 + " <|endoftext|> " + "<|endoftext|>" * 9, "", None]
    for encoder in (ENCODER, UnitEncoder(PATH, memo=4), UnitEncoder(PATH, longest=3)):
        got, at = encoder.encode(pa.array(texts, pa.string()).slice(1))
        assert [got[a:b].tolist() for a, b in zip(at, at[1:])] == [ids(t or "") for t in texts[1:]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES + ["word ", "and ", "the "] * 5), min_size=20, max_size=200).map("".join))
def test_spliced_chunks_count_as_the_whole_text(text):
    assert ChunkCounter(ENCODER, 10, 40, 12).count(text) == len(ids(text))


def test_counts_of_a_slice_with_huge_texts_in_it():
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(PIECES + ["word "] * 9) for _ in range(rnd.choice([3, 20, 300]))) for _ in range(80)] + [None, ""]
    column = pa.array(texts, pa.string()).slice(11)
    assert ChunkCounter(ENCODER, 200, 80, 20).counts(column).tolist() == [len(ids(t or "")) for t in texts[11:]]


def test_overlap_widens_where_nothing_aligns():
    counter = ChunkCounter(ENCODER, 10, 40, 8)
    text = "plain words first " * 5 + "x" * 300 + " and some words after that " * 5
    assert counter.count(text) == len(ids(text)) and counter.widened
    with pytest.raises(ValueError):
        ChunkCounter(ENCODER, 10, 8, 8)


ROWS = [(3, "b c", "x"), (None, "no id", "x"), (1, None, "y"), (2, "", "z"), (3, "a", "x"), (3, "b c", "x"), (7, "word " * 9000, "x")]


def test_counts_with_nulls_ties_and_extra_columns(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, token_counts(docs, PATH, huge=1000, chunk=500, overlap=50).collect()), key=str)
    assert got == sorted([(i, len((t or "").encode()), len(ids(t or "")), len(ids(t or "")) > 512) for i, t, _ in ROWS], key=str)
    assert token_counts(docs.limit(0), PATH).collect() == []


@pytest.mark.parametrize("mode", ["bit", "byte"])
def test_planes_round_trip(mode):
    r = np.random.default_rng(5)
    for n in (0, 1, 7, 8, 1000):
        x = r.integers(0, 2**32, n, dtype=np.uint32)
        assert (from_planes(to_planes(x, mode), n, mode) == x).all()
    f, docs, rnd = io.BytesIO(), [], random.Random(3)
    w = PlaneWriter(f, mode, block=16)
    for k in range(60):
        docs.append((None if k == 0 else k, [rnd.randrange(70000) for _ in range(rnd.choice([0, 1, 5, 16, 100]))]))
        w.add(docs[-1][0], np.asarray(docs[-1][1], "<u4").tobytes())
    w.close()
    reader = PlaneReader(f)
    assert [(d, i.tolist()) for d, _, i in reader.documents()] == docs
    whole = [i for _, x in docs for i in x]
    for a, b in ((0, 5), (3, 40), (17, 17), (len(whole) - 3, len(whole) + 9)):
        assert reader.read(a, b).tolist() == whole[a:b]
    f.seek(0)
    with pytest.raises(ValueError):
        PlaneReader(io.BytesIO(f.read()[:-3]))


def test_planes_in_a_given_order_and_ids_that_are_no_numbers(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k}", (k * 7) % 10) for k in range(10)], "doc_id long, text string, at int")
    got = plane_output(docs, PATH, folder=str(tmp_path / "a"), order=[F.col("at")]).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(range(10), key=lambda k: (k * 7) % 10)
    with pytest.raises(TypeError):
        plane_output(docs.withColumn("doc_id", F.lit("a")), PATH)


def test_parts_follow_the_size_of_the_texts(spark, tmp_path):
    docs = spark.createDataFrame([(k, "many words here " * 20) for k in range(40)], "doc_id long, text string")
    assert len(write_planes(docs, str(tmp_path / "a"), PATH)) == 1
    manifest = write_planes(docs, str(tmp_path / "b"), PATH, part_bytes=2000)
    assert len(manifest) > 3 and [m["start"] for m in manifest] == np.cumsum([0, *(m["n_tokens"] for m in manifest)])[:-1].tolist()


def test_plane_files_hold_all_documents_in_order(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, start string")
    got = [tuple(r) for r in plane_output(docs, PATH, folder=str(tmp_path / "a"), block=64).orderBy("start").collect()]
    want, start = [], 0
    for i, t in sorted(((r[0], r[1]) for r in ROWS), key=lambda x: (x[0] is not None, x[0] or 0)):
        want.append((i, ids(t or "") + [2]))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == np.cumsum([0, *(g[2] for g in got)])[:-1].tolist()
    assert sorted(map(str, ((g[0], g[2], g[3]) for g in got))) == sorted(str((i, len(x), zlib.crc32(np.asarray(x, "<u4").tobytes()))) for i, x in want)
    assert write_planes(docs.limit(0), str(tmp_path / "b"), PATH) == []
    assert plane_output(docs.limit(0), PATH, folder=str(tmp_path / "c")).collect() == []
