"""An interpolated modified Kneser-Ney model of a corpus, of any order from 2 on.

Counting, for order 2: tasks hash the words of their texts, count pairs of neighbours
within about 2 million tokens, and send binary blocks of distinct pairs to shards by
the pair's first word; pairs of the words that alone make up a fair share of a shard
are spread by both words.  A shard merges its pairs and writes them as sorted
64-bit hashes with counts.  What its pairs say of single words, as contexts and
as continuations, goes on to the lexicon, sharded by word, whose files hold the
sorted word hashes with their counts and context statistics.

For a higher order the same is done with a hash of the order - 1 words before in the
first word's place.  What the grams of a level say of their contexts goes to files of
contexts, and with each gram's first word left out they are the grams of the level
below, each counted as often as there are words that come before it.

Scoring: tasks memory-map the files, find every token in the lexicon and every
gram among the grams by bucketed search, and add up the log probabilities of a
text.  A model of more files than a task should map, or whose folder isn't mounted,
is searched file by file instead: slices of text send their different grams there
and get the counts back.  With c the count of a gram, t, n1, n2, n3 its context's number of
grams, and of those seen once, twice, more:

    p(w | v) = max(c - D(c), 0) / t + (D1 n1 + D2 n2 + D3 n3) / t * p(w | shorter v)

and at last p(w) from the number of words that precede w, interpolated with
1 / (V + 1), so that an unknown word has a share too.  A text starts after
order - 1 start marks, which are no tokens, and ends with an end token.

The files hold every gram of the corpus and grow with it; nothing but S counts
and the hot words (under 8 S of them) passes through the driver, with S shards: a
power of two, about one for every ``shard_bytes`` of text, so that a shard's size
doesn't grow with the corpus until there are 2**18.  A model knows which shards it
has written; one that can't be read later is an error, not a count of zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .wordhash import BLANK, U64, cut_rows, mix, runs, split

START, END = U64(0x5A17A57D1B54A32D), U64(0xE4D70CE2A0761D64)
#: Bytes of text handled at once, for counting and for scoring.
COUNT_BYTES, SCORE_BYTES = 12 << 20, 3 << 20
#: Files that a task keeps mapped; and how many ways, at most, requests are sent to the files' tasks.
MOST_MAPS, MOST_ROUTES = 4096, 4096


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * U64(0x9E3779B97F4A7C15) + mix(w))


def _tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, an END after each, and where each text's tokens begin."""
    w = split(texts, BLANK)
    return np.insert(w.hashes, w.bounds[1:], END), w.bounds + np.arange(len(w.bounds))


def _before(tokens: np.ndarray, begins: np.ndarray, start) -> np.ndarray:
    v = np.empty_like(tokens)
    v[1:] = tokens[:-1]
    v[begins[:-1]] = start
    return v


def _contexts(tokens: np.ndarray, begins: np.ndarray, order: int, start) -> list[np.ndarray]:
    """Hashes of the order - 1 words before each token, of the order - 2 before it, ... and of the one before it."""
    before = _before(tokens, begins, start)
    out = [before]
    for _ in range(order - 2):
        before = _before(before, begins, start)
        out.append(_pair(before, out[-1]))
    return out[::-1]


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys)
    found, starts = runs(keys[order])
    return found, *(np.add.reduceat(v[order], starts[:-1]) if len(found) else v[:0] for v in values)


_zstd, _unzstd = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _small(x: np.ndarray) -> bytes:
    """Counts, mostly tiny, as compressed byte planes."""
    return _zstd.compress(np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unsmall(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unzstd.decompress(b), np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def _all(t: pa.Table, name: str, small: bool = False) -> np.ndarray:
    parts = [_unsmall(x) if small else np.frombuffer(x, U64) for x in t.column(name).to_pylist() if x is not None]
    return np.concatenate(parts) if parts else np.zeros(0, U64)


def _buckets(keys: np.ndarray, skip: int) -> np.ndarray:
    """Where the keys of each range of leading bits begin, about two keys a range; skip leading bits are the same in all."""
    bits = max(1, int(len(keys)).bit_length() - 2)
    lead = ((keys << U64(skip)) >> U64(64 - bits)).astype(np.int64)
    return np.concatenate([[0], np.cumsum(np.bincount(lead, minlength=1 << bits))]).astype(np.uint32)


def find(keys: np.ndarray, buckets: np.ndarray, skip: int, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted key is among the sorted keys, or -1."""
    if not len(keys) or not len(wanted):
        return np.full(len(wanted), -1, np.int64)
    bits = (len(buckets) - 1).bit_length() - 1
    lead = ((wanted << U64(skip)) >> U64(64 - bits)).astype(np.int64)
    lo, hi = buckets[lead].astype(np.int64), buckets[lead + 1].astype(np.int64)
    for _ in range(int((hi - lo).max(initial=0)).bit_length()):
        mid = (lo + hi) >> 1
        less = (lo < hi) & (keys[np.minimum(mid, len(keys) - 1)] < wanted)
        lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
    at = np.minimum(lo, len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@lru_cache(MOST_MAPS)
def _pack(path: str) -> dict[str, np.ndarray]:
    return store.mapped_pack(path)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard.astype(np.uint16) if shard.max(initial=0) < 1 << 16 else shard, kind="stable")
    which, starts = runs(shard[order])
    for k, a, b in zip(which.tolist(), starts, starts[1:]):
        yield k, order[a:b]


def _discounts(n: list[float]) -> list[float]:
    """D1, D2, D3+ from the numbers of things seen once to four times; 0.75 each where those can't say."""
    if min(n[:3]) <= 0:
        return [0.75, 0.75, 0.75]
    y = n[0] / (n[0] + 2 * n[1])
    return [float(np.clip(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.0, k + 1)) for k in range(3)]


#: What a look-up gives, by kind of file, and what a score adds to a row.
LEXICON, GRAM = ("counts", "kinds", "total", "n1", "n2", "n3"), ("counts",)
OUT = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """Rows (row, text) of the batch's last column, whole texts, SCORE_BYTES at a time; row is the place in the batch."""
    return cut_rows(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(batch.num_columns - 1)], names=["row", "text"])]), SCORE_BYTES)


class KneserNey:
    """A fitted model: where its files are and a few totals.  Small enough for any closure."""

    def __init__(self, folder: str, order: int, bits: int, hot: np.ndarray, tokens: int, words: int, grams: dict[int, list[float]], single: list[float], written: dict[str, np.ndarray]):
        self.folder, self.order, self.bits, self.hot, self.tokens, self.words, self.written = folder, order, bits, hot, tokens, words, written
        self.d, self.d1, self.kinds = {m: _discounts(n[:4]) for m, n in grams.items()}, _discounts(single[:4]), single[5]
        self.open_mass = sum(d * n for d, n in zip(self.d1, (single[0], single[1], single[4] - single[0] - single[1])))

    @staticmethod
    def fit(texts: DataFrame, *, text_col: str = "text", order: int = 2, shard_bytes: int = 1 << 24) -> KneserNey:
        """Count every row of texts."""
        if order < 2:
            raise ValueError("order must be at least 2")
        spark = texts.sparkSession
        folder = store.new_folder(spark, "kneser-ney")
        rows = texts.select(F.col(text_col).cast("string").alias("text"))
        size = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
        bits = min(18, max(3, (size // shard_bytes).bit_length()))
        tokens, words, hot, own = _count_words(rows, folder, bits)
        blocks, sums, written = _count_grams(rows, bits, hot, order), {}, {}
        for m in range(order, 1, -1):
            saved = _merge_grams(spark, blocks, folder, bits, hot, m)
            r = saved.where("sums is not null").agg(*[F.sum(F.col("sums")[k]) for k in range(4)]).first()
            sums[m], written[f"grams-{m}"] = [float(x or 0) for x in r], _written(saved.select("made"), bits)
            if m > 2:
                written[f"contexts-{m}"] = _merge_contexts(saved.where("ctx is not null"), folder, bits, m)
                blocks = saved.where("w is not null").select("shard", "n", *[f"k{j}" for j in range(m - 1, 1, -1)], "w", "c")
        single, written["lexicon"] = _lexicon(spark, folder, bits, own)
        return KneserNey(folder, order, bits, hot, tokens, words, sums, single, written)

    def _lookup(self, kind: str, shard: np.ndarray, keys: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
        out = [np.zeros(len(keys), np.int64) for _ in names]
        skip = 0 if kind.startswith("grams") else self.bits  # leading bits that are the same in all of a shard
        for k, own in _by_shard(shard):
            if not self.written[kind][k]:
                continue
            p = _pack(f"{self.folder}/{kind}/{k}.pack")
            at = find(p["keys"], p["buckets"], skip, keys[own])
            have = at >= 0
            for o, name in zip(out, names):
                o[own[have]] = p[name][at[have]]
            if kind.startswith("grams") and len(p["many"]):
                big = own[have][p["counts"][at[have]] == 255]
                if len(big):
                    out[0][big] = p["many"][np.searchsorted(p["many_keys"], keys[big])]
        return out

    def token_logs(self, tokens: np.ndarray, begins: np.ndarray, lookup: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
        """log10 p of each token after those before it in its text, and each one's count in the corpus; lookup reads the files unless another is given."""
        names, of, lookup = LEXICON, U64(64 - self.bits), lookup or self._lookup
        found = lookup("lexicon", tokens >> of, tokens, names)
        start = lookup("lexicon", np.asarray([START >> of]), np.asarray([START]), names)
        kinds = found[1]
        p = 1 / (self.words + 1) if not self.kinds else (np.maximum(kinds - np.asarray([0.0, *self.d1])[np.minimum(kinds, 3)], 0) + self.open_mass / (self.words + 1)) / self.kinds
        contexts = _contexts(tokens, begins, self.order, START)
        v = contexts[-1]
        for m in range(2, self.order + 1):
            ctx = contexts[self.order - m]
            total, n1, n2, n3 = (_before(x, begins, s[0]) for x, s in zip(found[2:], start[2:])) if m == 2 else lookup(f"contexts-{m}", ctx >> of, ctx, names[2:])
            c = lookup(f"grams-{m}", _shard_of(ctx, v, tokens, self.hot, self.bits), _pair(ctx, tokens), GRAM)[0]
            d = self.d[m]
            p = np.where(total > 0, (np.maximum(c - np.asarray([0.0, *d])[np.minimum(c, 3)], 0) + (d[0] * n1 + d[1] * n2 + d[2] * n3) * p) / np.maximum(total, 1), p)
        return np.log10(p), found[0]

    def _sums(self, tokens: np.ndarray, begins: np.ndarray, lookup: Callable | None = None) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score and score of each text."""
        logs, counts = self.token_logs(tokens, begins, lookup)
        base = np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.words + 1)))
        at = begins[:-1]
        return np.diff(begins), np.add.reduceat((counts > 0).astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(logs, at)

    def _scored(self, kept: list[pa.Array], keep: list[str], sums: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        n, known, base, score = sums
        return pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), self.tokens), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())], names=[*keep, *OUT])

    @property
    def files(self) -> int:
        """How many files a scoring task may have to map."""
        return int(sum(x.sum() for x in self.written.values()))

    def score(self, docs: DataFrame, keep: list[str], *, text_col: str = "text", most_maps: int = MOST_MAPS) -> DataFrame:
        """The columns keep, and n_tokens, n_known, train_tokens, base_score, score of every row's whole text.

        Tasks map the model's files where they are while those are at most most_maps and lie in a mounted folder; else
        the grams of the texts are sent to the files, see _score_by_shard().  The result is the same.
        """
        rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
        schema = f"{kinds}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        if self.files > most_maps or not store.mounted(self.folder):
            return self._score_by_shard(rows, keep, schema)
        n_keep = len(keep)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = [self._sums(*_tokens(t.column("text"))) for t in _slices(batch)]
                yield self._scored(batch.columns[:n_keep], keep, tuple(np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0),) * 4)
            _pack.cache_clear()  # a mapped file keeps its space on disk
            store.release_memory()

        return rows.mapInArrow(look, schema)

    def _score_by_shard(self, rows: DataFrame, keep: list[str], schema: str) -> DataFrame:
        """Scores for a model of more files than a task should map.

        A slice of text asks for each different gram once: its keys go to the tasks of the files, some shards in a row by
        one of MOST_ROUTES ways, in that order, so a file is mapped once a task; the counts go back to the slice, which
        waits as word hashes and places among them.  Requests and slices are written to the shared folder, so a lost
        executor costs no other task its work.
        """
        spark, folder = rows.sparkSession, store.new_folder(rows.sparkSession, "kneser-ney-asked")
        n_keep, wide = len(keep), max(0, self.bits - (MOST_ROUTES.bit_length() - 1))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 32
            for batch in batches:
                for t in _slices(batch):
                    tokens, begins = _tokens(t.column("text"))
                    asked: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

                    def note(kind: str, shard: np.ndarray, keys: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
                        asked.setdefault(kind, []).append((shard.astype(np.int64), keys))
                        return [np.zeros(len(keys), np.int64) for _ in names]

                    self.token_logs(tokens, begins, note)
                    out: list[tuple] = []
                    for kind, parts in asked.items():
                        keys, first = np.unique(np.concatenate([k for _, k in parts]), return_index=True)
                        shard = np.concatenate([s for s, _ in parts])[first]
                        order = np.argsort(shard, kind="stable")
                        keys, shard = keys[order], shard[order]
                        which, starts = runs(shard >> wide)
                        out += [(kind, int(r), _small(shard[a:b]), keys[a:b].tobytes()) for r, a, b in zip(which.tolist(), starts, starts[1:])]
                    words, place = np.unique(tokens, return_inverse=True)
                    kept = pa.RecordBatch.from_arrays([c.take(t.column("row").combine_chunks()) for c in batch.columns[:n_keep]], names=keep)
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, kept.schema) as w:
                        w.write_batch(kept)
                    body = (words.tobytes(), place.astype(np.uint32).tobytes(), begins.astype(np.int64).tobytes(), sink.getvalue().to_pybytes())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number] * (len(out) + 1), pa.int64()), pa.array([r[0] for r in out] + [None], pa.string()), pa.array([r[1] for r in out] + [None], pa.int64())]
                        + [pa.array([r[k] for r in out] + [None], pa.binary()) for k in (2, 3)]
                        + [pa.array([None] * len(out) + [list(body)], pa.list_(pa.binary()))],
                        names=["slice", "kind", "route", "shards", "keys", "body"],
                    )
                    number += 1
            store.release_memory()

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here = None
            for batch in batches:
                values = []
                for kind, route, shards, keys in zip(*(c.to_pylist() for c in batch.columns[1:])):
                    if (kind, route) != here:
                        _pack.cache_clear()  # the last way's files
                        here = kind, route
                    names = GRAM if kind.startswith("grams") else LEXICON if kind == "lexicon" else LEXICON[2:]
                    values.append([_small(x) for x in self._lookup(kind, _unsmall(shards).astype(np.int64), np.frombuffer(keys, U64), names)])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array(values, pa.list_(pa.binary()))], names=["slice", "kind", "keys", "body"])
            _pack.cache_clear()
            store.release_memory()

        def finish(key, t):
            found: dict[str, tuple[np.ndarray, list[np.ndarray]]] = {}
            of_kind: dict[str | None, list[tuple]] = {}
            for kind, keys, values in zip(*(t.column(c).to_pylist() for c in ("kind", "keys", "body"))):
                of_kind.setdefault(kind, []).append((keys, values))
            words, place, begins, kept = of_kind.pop(None)[0][1]
            for kind, parts in of_kind.items():
                keys = np.concatenate([np.frombuffer(k, U64) for k, _ in parts])
                order = np.argsort(keys)
                found[kind] = keys[order], [np.concatenate([_unsmall(x).astype(np.int64) for x in column])[order] for column in zip(*(v for _, v in parts))]

            def lookup(kind: str, shard: np.ndarray, keys: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
                have, values = found[kind]
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                if not (have[at] == keys).all():
                    raise RuntimeError(f"answers of {kind} are missing")
                return [x[at] for x in values]

            tokens = np.frombuffer(words, U64)[np.frombuffer(place, np.uint32)]
            kept = pa.ipc.open_stream(kept).read_all().combine_chunks()
            return pa.Table.from_batches([self._scored([c.chunk(0) for c in kept.columns], keep, self._sums(tokens, np.frombuffer(begins, np.int64), lookup))])

        asked = rows.mapInArrow(ask, "slice long, kind string, route long, shards binary, keys binary, body array<binary>")
        asked.write.option("compression", "none").parquet(folder)
        asked = spark.read.schema(asked.schema).parquet(folder)
        sent = asked.where("kind is not null").select("slice", "kind", "route", "shards", "keys").repartition("kind", "route").sortWithinPartitions("kind", "route")
        answers = sent.mapInArrow(answer, "slice long, kind string, keys binary, body array<binary>")
        return answers.union(asked.where("kind is null").select("slice", "kind", "keys", "body")).groupBy("slice").applyInArrow(finish, schema)


def _shard_of(ctx: np.ndarray, v: np.ndarray, w: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    """By the context, and where the word before, v, is hot by the word too."""
    key = ctx.copy()
    if len(hot):
        at = np.minimum(np.searchsorted(hot, v), len(hot) - 1)
        spread = hot[at] == v
        key[spread] = mix(ctx[spread] ^ w[spread])
    return (key >> U64(64 - bits)).astype(np.int64)


def _written(shards: DataFrame, bits: int) -> np.ndarray:
    """Which shards there are, from a column of their numbers."""
    out = np.zeros(1 << bits, bool)
    out[shards.distinct().toArrow().column(0).to_numpy()] = True  # 2**18 numbers at most
    return out


def _count_words(rows: DataFrame, folder: str, bits: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered = (pa.RecordBatch.from_arrays([b.column(0), b.column(0)], names=["t", "text"]) for b in batches)
        for t in cut_rows(numbered, COUNT_BYTES):
            tokens = np.sort(_tokens(t.column("text"))[0])
            words, starts = runs(tokens)
            n = np.diff(starts)
            which, at = runs((words >> U64(64 - bits)).astype(np.int64))
            yield pa.RecordBatch.from_pydict({"shard": pa.array(which, pa.int64()), "words": pa.array([words[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()), "counts": pa.array([_small(n[a:b]) for a, b in zip(at, at[1:])], pa.binary())})

    most = 1 << bits

    def merge(key, t):
        shard = key[0].as_py()
        words, counts = _sum_by(_all(t, "words"), _all(t, "counts", True))
        store.put_pack(f"{folder}/words/{shard}.pack", keys=words, counts=counts)
        top = np.argsort(counts)[::-1][:most]
        return pa.table({"shard": pa.array([shard], pa.int64()), "n": pa.array([int(counts.sum())], pa.int64()), "v": pa.array([len(words)], pa.int64()), "top": pa.array([words[top].view(np.int64)], pa.list_(pa.int64())), "top_n": pa.array([counts[top].astype(np.int64)], pa.list_(pa.int64()))})

    got = rows.mapInArrow(count, "shard long, words binary, counts binary").groupBy("shard").applyInArrow(merge, "shard long, n long, v long, top array<long>, top_n array<long>")
    got.write.parquet(f"{folder}/words-list")
    got = rows.sparkSession.read.schema(got.schema).parquet(f"{folder}/words-list")
    sums = got.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = int(sums.n or 0), int(sums.v or 0)
    each = got.select(F.explode(F.arrays_zip("top", "top_n")).alias("x")).where(F.col("x.top_n") * (8 << bits) > n).select("x.top")
    hot = np.asarray([r.top for r in each.collect()], np.int64).astype(np.int64).view(U64)  # under 8 S words
    return n, v, np.unique(np.append(hot, START)), _written(got.select("shard"), bits)


def _blocks(k: list[np.ndarray], w: np.ndarray, c: np.ndarray, hot: np.ndarray, bits: int) -> dict[str, list]:
    """Grams as binary blocks, one for each shard: k are the contexts' hashes, the longest first, and the word before last."""
    order = np.argsort(k[0])
    k, w, c = [x[order] for x in k], w[order], c[order]
    out: dict[str, list] = {x: [] for x in ("shard", "n", *(f"k{j}" for j in range(len(k) + 1, 1, -1)), "w", "c")}
    for shard, own in _by_shard(_shard_of(k[0], k[-1], w, hot, bits)):
        each, starts = runs(k[0][own])
        for name, x in zip(out, (shard, _small(np.diff(starts)), each.tobytes(), *(y[own].tobytes() for y in k[1:]), w[own].tobytes(), _small(c[own]))):
            out[name].append(x)
    return out


def _block_types(m: int) -> str:
    return f"shard long, n binary, {', '.join(f'k{j} binary' for j in range(m, 1, -1))}, w binary, c binary"


def _distinct(ctx: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of grams: the sorted distinct keys, where one of each is, and the sum of each one's counts."""
    keys = _pair(ctx, w)
    order = np.argsort(keys)
    keys, starts = runs(keys[order])
    return keys, order[starts[:-1]], np.add.reduceat(c[order], starts[:-1]) if len(keys) else c[:0]


def _count_grams(rows: DataFrame, bits: int, hot: np.ndarray, order: int) -> DataFrame:
    """Blocks of the distinct grams of each stretch of text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered = (pa.RecordBatch.from_arrays([b.column(0), b.column(0)], names=["t", "text"]) for b in batches)
        for t in cut_rows(numbered, COUNT_BYTES):
            w, begins = _tokens(t.column("text"))
            k = _contexts(w, begins, order, START)
            _, first, c = _distinct(k[0], w, np.ones(len(w), np.int64))
            out = _blocks([x[first] for x in k], w[first], c, hot, bits)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if name == "shard" else pa.binary()) for name, x in out.items()], names=list(out))
        store.release_memory()

    return rows.mapInArrow(count, _block_types(order))


def _merge_grams(spark: SparkSession, blocks: DataFrame, folder: str, bits: int, hot: np.ndarray, m: int) -> DataFrame:
    """Write each shard's grams of m words; and as rows what they say of contexts, of words or of the grams below, counts of counts, and which shards there are."""
    names = ["v", "total", "n1", "n2", "n3", "w", "kinds"] if m == 2 else ["ctx", "total", "n1", "n2", "n3", "n", *(f"k{j}" for j in range(m - 1, 1, -1)), "w", "c"]

    def merge(key, t):
        shard = key[0].as_py()
        ctx = np.concatenate([np.repeat(np.frombuffer(a, U64), _unsmall(b).astype(np.int64)) for a, b in zip(t.column(f"k{m}").to_pylist(), t.column("n").to_pylist())])
        k, w = [_all(t, f"k{j}") for j in range(m - 1, 1, -1)], _all(t, "w")
        keys, first, c = _distinct(ctx, w, _all(t, "c", True))
        ctx, k, w = ctx[first], [x[first] for x in k], w[first]
        many = c >= 255
        store.put_pack(f"{folder}/grams-{m}/{shard}.pack", keys=keys, buckets=_buckets(keys, 0), counts=np.minimum(c, 255).astype(np.uint8), many_keys=keys[many], many=c[many].astype(np.int64))
        rows: list[dict] = []
        tables = [(("ctx" if m > 2 else "v", "total", "n1", "n2", "n3"), _sum_by(ctx, c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64)))]
        if m == 2:
            tables.append((("w", "kinds"), _sum_by(w, np.ones(len(w), np.int64))))
        for head, arrays in tables:
            which, at = runs((arrays[0] >> U64(64 - bits)).astype(np.int64))
            for s, a, b in zip(which.tolist(), at, at[1:]):
                rows.append({"shard": s} | {name: x[a:b].tobytes() if j == 0 else _small(x[a:b]) for j, (name, x) in enumerate(zip(head, arrays))})
        if m > 2:
            _, below, n = _distinct(k[0], w, np.ones(len(w), np.int64))
            out = _blocks([x[below] for x in k], w[below], n, hot, bits)
            rows += [dict(zip(out, x)) for x in zip(*out.values())]
        sums = pa.array([[int((c == j).sum()) for j in (1, 2, 3, 4)]] + [None] * (len(rows) - 1), pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array([r["shard"] for r in rows], pa.int64()), *(pa.array([r.get(x) for r in rows], pa.binary()) for x in names), sums, pa.array(np.full(len(rows), shard), pa.int64())], names=["shard", *names, "sums", "made"])

    schema = f"shard long, {', '.join(f'{x} binary' for x in names)}, sums array<long>, made long"
    blocks.groupBy("shard").applyInArrow(merge, schema).write.option("compression", "none").parquet(f"{folder}/stats-{m}")
    return spark.read.schema(schema).parquet(f"{folder}/stats-{m}")


def _merge_contexts(stats: DataFrame, folder: str, bits: int, m: int) -> np.ndarray:
    """Write the contexts of m - 1 words of each shard; which shards there are."""

    def merge(key, t):
        shard = key[0].as_py()
        keys, total, *n = _sum_by(_all(t, "ctx"), *(_all(t, x, True) for x in ("total", "n1", "n2", "n3")))
        store.put_pack(f"{folder}/contexts-{m}/{shard}.pack", keys=keys, buckets=_buckets(keys, bits), total=total.astype(np.int64), **{f"n{j + 1}": x.astype(np.uint32) for j, x in enumerate(n)})
        return pa.table({"shard": pa.array([shard], pa.int64())})

    got = stats.select("shard", "ctx", "total", "n1", "n2", "n3").groupBy("shard").applyInArrow(merge, "shard long")
    return _written(got, bits)


def _lexicon(spark: SparkSession, folder: str, bits: int, written: np.ndarray) -> tuple[list[float], np.ndarray]:
    """Merge what the pairs say of words; n1..n4 of the words' kinds of predecessors, their number, and the sum."""

    def merge(key, t):
        shard = key[0].as_py()
        own = store.mapped_pack(f"{folder}/words/{shard}.pack") if written[shard] else {"keys": np.zeros(0, U64), "counts": np.zeros(0, np.int64)}
        contexts = _sum_by(_all(t, "v"), *(_all(t, k, True) for k in ("total", "n1", "n2", "n3")))
        words, kinds = _sum_by(_all(t, "w"), _all(t, "kinds", True))
        keys = np.unique(np.concatenate([own["keys"], contexts[0], words]))
        arrays = {"counts": (own["keys"], own["counts"]), "kinds": (words, kinds)} | {k: (contexts[0], x) for k, x in zip(("total", "n1", "n2", "n3"), contexts[1:])}
        out = {}
        for name, (at, values) in arrays.items():
            out[name] = np.zeros(len(keys), np.int64 if name in ("counts", "total") else np.uint32)
            out[name][np.searchsorted(keys, at)] = values
        store.put_pack(f"{folder}/lexicon/{shard}.pack", keys=keys, buckets=_buckets(keys, bits), **out)
        k = out["kinds"]
        return pa.table({"shard": pa.array([shard], pa.int64()), "x": pa.array([[*(float((k == j).sum()) for j in (1, 2, 3, 4)), float((k > 0).sum()), float(k.sum())]], pa.list_(pa.float64()))})

    stats = spark.read.parquet(f"{folder}/stats-2").drop("sums", "made").where("shard is not null")
    got = stats.groupBy("shard").applyInArrow(merge, "shard long, x array<double>")
    got.write.parquet(f"{folder}/lexicon-list")
    got = spark.read.schema(got.schema).parquet(f"{folder}/lexicon-list")
    r = got.agg(*[F.sum(F.col("x")[k]) for k in range(6)]).first()
    return [float(x or 0) for x in r], _written(got.select("shard"), bits)


def language_model_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1, order: int = 2, most_maps: int = MOST_MAPS) -> DataFrame:
    """Learn from the rows whose crc32(id as text) mod folds is not held, with grams of up to order words, and score every row.

    Returns the id, held_out, n_tokens, n_known, train_tokens, base_score and score.  A null or empty
    text is an end token only; a null id is never held out; repeated rows count and are scored each;
    extra columns don't matter.  With nothing to learn from, every token has probability 1 / (V + 1)
    with V = 0; an empty table gives an empty result.
    """
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    model = KneserNey.fit(rows.where(~F.col("held_out")), order=order)
    return model.score(rows, ["id", "held_out"], most_maps=most_maps).withColumnRenamed("id", id_col)
