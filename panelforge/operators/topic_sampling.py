"""Topic models by Gibbs sampling, with documents and counts in blocks of the shared folder; the driver holds a few numbers for each topic."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.storage import discard, materialize, shared_folder

POSTINGS, TERMS, CHUNK = 3_000_000, 50_000, 2048
BETA, ALPHA_SUM = 0.01, 5.0
STATE = "part int, documents long, postings long, terms long, n array<long>, gain array<double>, total double"


class _Blocks:
    """Arrays by name below a folder that all executors share."""

    def __init__(self, uri: str):
        self.fs, self.root = pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))

    def write(self, name: str, array: np.ndarray) -> None:
        path = f"{self.root}/{name}"
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        with self.fs.open_output_stream(path) as out:
            out.write(np.ascontiguousarray(array).data.cast("B") if array.size else b"")

    def read(self, name: str, kind: type) -> np.ndarray:
        with self.fs.open_input_file(f"{self.root}/{name}") as f:
            return np.frombuffer(f.read(), kind)

    def drop(self, name: str) -> None:
        if self.fs.get_file_info(f"{self.root}/{name}").type != pafs.FileType.NotFound:
            self.fs.delete_dir(f"{self.root}/{name}")


def _rows(**columns: list) -> pa.RecordBatch:
    numbers = pa.schema([("part", pa.int32()), *((x, pa.int64()) for x in ("documents", "postings", "terms")), ("n", pa.list_(pa.int64())), ("gain", pa.list_(pa.float64())), ("total", pa.float64())])
    return pa.RecordBatch.from_pydict(columns, schema=numbers)


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _write_counts(blocks: _Blocks, turn: int, part: int, r: int, term: np.ndarray, z: np.ndarray, k: int) -> None:
    keys, n = np.unique(term.astype(np.int64) * k + z, return_counts=True)
    blocks.write(f"counts-{turn}/{r}/{part}", np.concatenate([keys.astype(np.uint32), n.astype(np.uint32)]))


def _own_terms(ids: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (row, token of its term): the row, and the place in `known`, which is sorted."""
    a, b = np.searchsorted(known, ids, "left"), np.searchsorted(known, ids, "right")
    row = np.repeat(np.arange(len(ids)), b - a)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[row]


def _first(uri: str, words: list[str], ranges: int, k: int, seed: int):
    """Reads a part's documents, writes its postings by range and term, and gives each token a random topic."""

    def run(batches):
        import pyarrow.parquet as pq

        blocks, part = _Blocks(uri), TaskContext.get().partitionId()
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        doc = ids = n = np.zeros(0, np.int64)
        if table is not None and len(table):
            doc = pc.dictionary_encode(table["doc"].combine_chunks()).indices.to_numpy(zero_copy_only=False).astype(np.int64)
            ids, n = table["term_id"].to_numpy().astype(np.int64), table["n"].to_numpy().astype(np.int64)
        if len(ids):
            order = np.lexsort((-n, ids, doc))  # of repeats the greatest count
            doc, ids, n = doc[order], ids[order], n[order]
            keep = np.r_[True, (doc[1:] != doc[:-1]) | (ids[1:] != ids[:-1])]
            doc, ids, n = doc[keep], ids[keep], n[keep]
            files = [pafs.FileSystem.from_uri(w.replace("s3a://", "s3://", 1)) for w in words]
            known = pa.concat_tables([pq.read_table(p, filesystem=f, columns=["term_id", "i"]) for f, p in files])
            term_id, i = known["term_id"].to_numpy().astype(np.int64), known["i"].to_numpy().astype(np.int64)
            at = np.argsort(term_id, kind="stable")
            row, place = _own_terms(ids, term_id[at])
            token = i[at][place]
            # terms of one token are summed; sorted by range and term
            size = int(doc.max()) + 1
            keys, n = _merged(((token % ranges) * (int(i.max()) + 1) + token) * size + doc[row], n[row])
            doc, token = keys % size, keys // size % (int(i.max()) + 1)
            used, doc = np.unique(doc, return_inverse=True)
        else:
            token, used = ids, ids
        z = np.random.default_rng([seed, 0, part]).integers(0, k, int(n.sum()), dtype=np.uint16)
        for name, x in (("docs", doc.astype(np.uint32)), ("terms", token.astype(np.uint32)), ("n", n.astype(np.uint32)), ("z-0", z)):
            blocks.write(f"{name}/{part}", x)
        ends = np.cumsum(n)
        for r in range(ranges):
            a, b = np.searchsorted(token % ranges, [r, r + 1])
            s, e = (int(ends[x - 1]) if x else 0 for x in (a, b))
            _write_counts(blocks, 0, part, r, np.repeat(token[a:b] // ranges, n[a:b]), z[s:e], k)
        yield _rows(part=[part], documents=[len(used)], postings=[len(n)], terms=[0], n=[np.bincount(z, minlength=k).tolist()], gain=[[]], total=[0.0])

    return run


def _sum(uri: str, parts: int, turn: int, k: int):
    """Counts by (term, topic) of a range, summed over the parts."""

    def run(batches):
        blocks = _Blocks(uri)
        for r in (x for batch in batches for x in batch.column(0).to_pylist()):
            each = [blocks.read(f"counts-{turn}/{r}/{p}", np.uint32) for p in range(parts)]
            keys, n = _merged(np.concatenate([x[: len(x) // 2] for x in each]), np.concatenate([x[len(x) // 2 :] for x in each]))
            blocks.write(f"sums-{turn}/{r}", np.concatenate([keys, n.astype(np.uint32)]))
            yield _rows(part=[r], documents=[0], postings=[0], terms=[len(np.unique(keys // k))], n=[[]], gain=[[]], total=[0.0])

    return run


def _sweep(uri: str, ranges: int, turn: int, k: int, seed: int, alpha: np.ndarray, n_k: np.ndarray, terms: int):
    """New topics of a part's tokens: by the counts of the sweep before for terms and by the running ones for documents, both without the posting's own."""

    def run(batches):
        blocks = _Blocks(uri)
        for part in (x for batch in batches for x in batch.column(0).to_pylist()):
            rng = np.random.default_rng([seed, turn, part])
            doc, token, n = (blocks.read(f"{x}/{part}", np.uint32).astype(np.int64) for x in ("docs", "terms", "n"))
            z, ends = blocks.read(f"z-{turn - 1}/{part}", np.uint16).copy(), np.r_[0, np.cumsum(n)]
            of = np.zeros(((int(doc.max()) + 1 if len(doc) else 0), k), np.float32)
            for a in range(0, len(n), CHUNK * 64):
                b = min(len(n), a + CHUNK * 64)
                np.add.at(of.reshape(-1), np.repeat(doc[a:b], n[a:b]) * k + z[ends[a] : ends[b]], np.float32(1))
            prior, share = alpha.astype(np.float32), (1 / (n_k + terms * BETA)).astype(np.float32)
            for r in range(ranges):
                first, last = np.searchsorted(token % ranges, [r, r + 1])
                if first == last:
                    _write_counts(blocks, turn, part, r, token[:0], z[:0], k)
                    continue
                own = token[first:last] // ranges
                x = blocks.read(f"sums-{turn - 1}/{r}", np.uint32)
                phi = np.zeros((int(x[: len(x) // 2].max()) // k + 1, k), np.float32)
                phi.reshape(-1)[x[: len(x) // 2]] = x[len(x) // 2 :]
                phi += np.float32(BETA)
                phi *= share
                for a in range(first, last, CHUNK):
                    b = min(last, a + CHUNK)
                    here, s, e = doc[a:b], ends[a], ends[b]
                    row, old = np.repeat(np.arange(b - a), n[a:b]), z[s:e].astype(np.int64)
                    w, d, cell = phi[own[a - first : b - first]], of[here], row * k + old
                    np.subtract.at(w.reshape(-1), cell, share[old])
                    np.subtract.at(d.reshape(-1), cell, np.float32(1))
                    np.maximum(w, np.float32(BETA) * share, out=w)
                    np.maximum(d, np.float32(0), out=d)
                    d += prior
                    d *= w
                    up = np.cumsum(d.reshape(-1), dtype=np.float64)
                    top = up[k - 1 :: k]
                    low = np.r_[0.0, top[:-1]]
                    new = np.searchsorted(up, low[row] + rng.random(e - s) * (top - low)[row], "right") - row * k
                    new = np.clip(new, 0, k - 1)
                    np.subtract.at(of.reshape(-1), here[row] * k + old, np.float32(1))
                    np.add.at(of.reshape(-1), here[row] * k + new, np.float32(1))
                    z[s:e] = new
                _write_counts(blocks, turn, part, r, np.repeat(own, n[first:last]), z[ends[first] : ends[last]], k)
            blocks.write(f"z-{turn}/{part}", z)
            # sums of digamma(n + a) - digamma(a) over documents, for each topic and for whole documents
            steps = np.arange(int(of.max()) if of.size else 0)
            table = np.concatenate([np.zeros((k, 1)), np.cumsum(1 / (steps + alpha[:, None]), axis=1)], axis=1)
            gain = np.zeros(k)
            for a in range(0, len(of), 20_000):
                rows, topic = np.nonzero(of[a : a + 20_000])
                gain += np.bincount(topic, table[topic, of[a : a + 20_000][rows, topic].astype(np.int64)], minlength=k)
            length = of.sum(axis=1, dtype=np.float64).astype(np.int64)
            whole = np.r_[0.0, np.cumsum(1 / (np.arange(int(length.max()) if len(length) else 0) + alpha.sum()))]
            yield _rows(part=[part], documents=[len(of)], postings=[len(n)], terms=[0], n=[np.bincount(z, minlength=k).tolist()], gain=[gain.tolist()], total=[float(whole[length].sum())])

    return run


def _heaviest(uri: str, ranges: int, turn: int, k: int, top: int, n_k: np.ndarray, terms: int):
    """(topic_id, i, weight) of a range: each topic's heaviest terms, and for topics with few terms the commonest of all."""

    def run(batches):
        blocks, share = _Blocks(uri), 1 / (n_k + terms * BETA)
        for r in (x for batch in batches for x in batch.column(0).to_pylist()):
            x = blocks.read(f"sums-{turn}/{r}", np.uint32).astype(np.int64)
            if not len(x):
                continue
            keys, n = x[: len(x) // 2], x[len(x) // 2 :]
            order = np.lexsort((keys, -n, keys % k))
            topic = keys[order] % k
            rank = np.arange(len(topic)) - np.searchsorted(topic, topic)
            best = keys[order][rank < top]
            all_terms, total = _merged(keys // k, n)
            common = all_terms[np.lexsort((all_terms, -total))[:top]]
            wanted = np.unique(np.concatenate([best, (common[:, None] * k + np.arange(k)).ravel()]))
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            weight = (np.where(keys[at] == wanted, n[at], 0) + BETA) * share[wanted % k]
            yield pa.RecordBatch.from_pydict({"topic_id": (wanted % k).astype(np.int32), "i": wanted // k * ranges + r, "weight": weight})

    return run


def sampled_topics(postings: DataFrame, words: DataFrame, doc: str, k: int, n: int, sweeps: int = 20, seed: int = 42) -> DataFrame:
    """(topic_id, term, weight): the `n` heaviest terms of each of `k` topics of postings (doc, term_id, term_count) with words (term_id, token).

    Of repeats of a document's term the greatest count goes, terms of equal tokens are one. Each of `sweeps` passes draws a topic for every token;
    then the counts are summed by ranges of terms, and the documents' asymmetric priors take one step of their fixed point. Symmetric prior of words
    0.01, sum of the documents' 5 at first. Parts and ranges follow from the data and the cores; a part holds its documents by `k` numbers, a range its terms by `k`.
    """
    spark = postings.sparkSession
    folder = f"{shared_folder(spark)}/topics-{uuid.uuid4().hex}"
    tokens = words.select("token").where("token is not null").distinct().withColumn("i", F.row_number().over(Window.orderBy("token")).cast("long") - 1)
    tokens = materialize(tokens, "tokens")
    coded = materialize(words.join(tokens.hint("merge"), "token").select("term_id", "i", "token"), "coded")
    rows, vocabulary = postings.count(), tokens.count()
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(rows / POSTINGS))
    ranges = max(spark.sparkContext.defaultParallelism, math.ceil(vocabulary / TERMS))
    each = lambda m: spark.range(0, m, 1, m)

    def gathered(df: DataFrame, run) -> list:
        return df.mapInArrow(run, STATE).collect()

    blocks = _Blocks(folder)
    try:
        known = postings.select(F.col(doc).alias("doc"), "term_id", F.col("term_count").cast("int").alias("n"))
        state = gathered(known.repartition(parts, "doc"), _first(folder, coded.inputFiles(), ranges, k, seed))
        terms = sum(x.terms for x in gathered(each(ranges), _sum(folder, parts, 0, k)))
        alpha, n_k = np.full(k, ALPHA_SUM / k), np.sum([x.n for x in state], axis=0)
        for turn in range(1, sweeps + 1):
            state = gathered(each(parts), _sweep(folder, ranges, turn, k, seed, alpha, n_k, terms))
            for old in ("z", "counts", "sums"):
                blocks.drop(f"{old}-{turn - 1}")
            gathered(each(ranges), _sum(folder, parts, turn, k))
            n_k, total = np.sum([x.n for x in state], axis=0), sum(x.total for x in state)
            if total:
                alpha = np.maximum(alpha * np.sum([x.gain for x in state], axis=0) / total, 1e-6)
        best = each(ranges).mapInArrow(_heaviest(folder, ranges, sweeps, k, n, n_k, terms), "topic_id int, i long, weight double")
        order = Window.partitionBy("topic_id").orderBy(F.desc("weight"), "i")
        best = best.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
        return materialize(best.join(tokens.hint("merge"), "i").select("topic_id", F.col("token").alias("term"), "weight"), "topics")
    finally:
        discard(spark, folder)
