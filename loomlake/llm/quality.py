"""Quality classifier: a convolutional network over bytes, trained and run in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import held_out, parts, table, text_bytes, trim
from .fitting import labelled_sample

#: At most so many documents of each label are learnt from, all their chunks, each document as much as another.
SAMPLE = {0: 1500, 1: 1500}
#: Chunks are two blocks long and start every block: each byte lies in two chunks.
BLOCK = 256
WIDTH, STRIDE, FILTERS = 8, 4, 8
#: The second input plane: how many of 8 pairs of bytes equal those some lag before, at the best lag.
LAGS, SPAN = range(2, 49), 8
#: Zeros after each text: more than any filter or lag reaches.
GAP = 64
THRESHOLD = 0.3


def blocks_of(raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, each filled up to whole blocks with GAP zeros at least, and the first block of each."""
    lengths = np.diff(bounds)
    n = (lengths + GAP + BLOCK - 1) // BLOCK
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(int(first[-1]) * BLOCK, np.uint8)
    data = np.frombuffer(raw, np.uint8)
    for k, (a, size) in enumerate(zip(bounds[:-1].tolist(), lengths.tolist(), strict=True)):
        out[first[k] * BLOCK : first[k] * BLOCK + size] = data[a : a + size]
    return out, first


def repetition(data: np.ndarray, part: int = 1 << 17) -> np.ndarray:
    """For every STRIDE-th byte, the most of SPAN pairs of bytes from it (0 to 8) that equal those one lag before."""
    reach, span = LAGS[-1] + 2, 2 * SPAN
    padded = np.concatenate([np.zeros(reach, np.uint8), data, np.zeros(span + 2, np.uint8)])
    out = []
    for a in range(0, len(data), part):
        own = padded[a : a + reach + min(part, len(data) - a) + span]
        pairs = [own[: len(own) // 2 * 2].view(np.uint16), own[1 : 1 + (len(own) - 1) // 2 * 2].view(np.uint16)]
        here = pairs[0][reach // 2 :]
        best = np.zeros(len(here), np.uint8)
        for lag in LAGS:
            before = pairs[lag % 2][(reach - lag) // 2 :][: len(here)]
            same = (here[: len(before)] == before).view(np.uint8)
            two = same[:-1] + same[1:]
            four = two[:-2] + two[2:]
            eight = four[:-4] + four[4:]
            np.maximum(best[: len(eight)], eight, out=best[: len(eight)])
        n = min(part, len(data) - a) // 2
        best = np.where(here[:n] == 0, 0, best[:n])
        out.append(best[:: STRIDE // 2])
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


@dataclass
class ByteNet:
    """Filters as tables: a filter's response is the sum over its WIDTH bytes of a weight for each byte and place.

    bytes: WIDTH x 256 x FILTERS; repeats: (SPAN + 1) x FILTERS. Responses are max-pooled
    over a chunk and go through tanh; `out` and `bias` make a chunk's logit, and the mean
    logit of all chunks, with `scale` and `shift`, gives the document's probability.
    """

    bytes: np.ndarray
    repeats: np.ndarray
    out: np.ndarray
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def responses(self, data: np.ndarray, start: int = 0, end: int | None = None, repeats: np.ndarray | None = None) -> np.ndarray:
        """Of the filters that start at every STRIDE-th byte from `start` to `end`."""
        end = len(data) if end is None else end
        n = (end - start) // STRIDE
        padded = np.concatenate([data[start : end + WIDTH], np.zeros(WIDTH, np.uint8)])
        got = self.repeats[repetition(data) if repeats is None else repeats[start // STRIDE : end // STRIDE]]
        for j in range(WIDTH):
            got += self.bytes[j][padded[j : j + n * STRIDE : STRIDE]]
        return got

    def logits(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The mean chunk logit of each text; a text of one block is one chunk."""
        per = (1 << 18) // BLOCK
        repeats = repetition(data)
        final = np.zeros(int(first[-1]), bool)
        final[first[1:] - 1] = True
        top = []
        for a in range(0, int(first[-1]), per):
            r = self.responses(data, a * BLOCK, min(a + per, int(first[-1])) * BLOCK, repeats).reshape(-1, BLOCK // STRIDE, FILTERS)
            # a text's last window would read the next text; like the one before, it is to read zeros
            r[final[a : a + per], -1] = r[final[a : a + per], -2]
            top.append(r.max(1))
        top = np.concatenate(top)
        chunk = np.maximum(top, np.concatenate([top[1:], top[-1:]]))
        last = first[1:] - 1
        alone = np.diff(first) == 1
        chunk[last] = top[last]
        logit = np.tanh(chunk) @ self.out + self.bias
        logit[last[~alone]] = 0  # the last block has been in the chunk before it
        return np.add.reduceat(logit, first[:-1]) / np.maximum(1, np.diff(first) - 1)

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -40, 40)))


def pooled(net: ByteNet, chunks: np.ndarray) -> np.ndarray:
    """Responses of each chunk (n x places x FILTERS): at its own bytes, with its neighbours' read but not pooled."""
    return net.responses(chunks.reshape(-1)).reshape(len(chunks), -1, FILTERS)[:, GAP // STRIDE : (GAP + 2 * BLOCK) // STRIDE]


def train(chunks: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 3, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> ByteNet:
    """Adam on the weighted logistic loss of chunks (n x GAP + 2 * BLOCK + GAP bytes), each with its document's label."""
    rng = np.random.default_rng(seed)
    net = ByteNet((rng.normal(size=(WIDTH, 256, FILTERS)) * 0.05).astype(np.float32), np.zeros((SPAN + 1, FILTERS), np.float32), (rng.normal(size=FILTERS) * 0.3).astype(np.float32))
    weights = [net.bytes, net.repeats, net.out]
    m, v, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    size, f = 64, np.arange(FILTERS)
    balance = weight * np.where(y == 1, 0.5 / weight[y == 1].sum(), 0.5 / weight[y == 0].sum()) * len(y)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), size):
            pick = order[a : a + size]
            x = chunks[pick]
            flat = x.reshape(-1)
            r = pooled(net, x)
            at = r.argmax(1)
            h = np.tanh(np.take_along_axis(r, at[:, None], 1)[:, 0])
            p = 1 / (1 + np.exp(-np.clip(h @ net.out + net.bias, -30, 30)))
            g = (p - y[pick]) * balance[pick] / len(pick)
            back = g[:, None] * net.out * (1 - h * h)
            grads = [np.zeros_like(w) for w in weights]
            place = at * STRIDE + GAP + (np.arange(len(pick)) * x.shape[1])[:, None]
            ends = np.concatenate([flat, np.zeros(WIDTH, np.uint8)])
            for j in range(WIDTH):
                np.add.at(grads[0][j], (ends[place + j], f), back)
            np.add.at(grads[1], (repetition(flat)[place // STRIDE], f), back)
            grads[2] = h.T @ g
            net.bias -= rate * float(g.sum())
            t += 1
            for k, w in enumerate(weights):
                d = grads[k] + decay * w
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                w -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def calibrate(net: ByteNet, logit: np.ndarray, y: np.ndarray, counts: dict[int, int]) -> None:
    """Scale and shift of the mean logit by logistic regression, with classes weighted as they are among all labels."""
    n = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    total = max(1, sum(counts.values()))
    weight = np.where(y == 1, counts.get(1, 0) / total / n[1], counts.get(0, 0) / total / n[0])
    scale, shift = 1.0, 0.0
    for _ in range(100):  # Newton, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(scale * logit + shift, -30, 30)))
        x = np.stack([logit, np.ones_like(logit)], 1)
        g = x.T @ (weight * (p - y)) + 1e-3 * np.array([scale, shift])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        scale, shift = np.array([scale, shift]) - np.linalg.solve(h, g)
    net.scale, net.shift = float(scale), float(shift)


def _training_chunks(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in parts(batches):
        raw, at = text_bytes(batch.column("text"))
        data, first = blocks_of(raw, at)
        data = np.concatenate([np.zeros(GAP, np.uint8), data, np.zeros(2 * BLOCK + GAP, np.uint8)])
        ids, ys = batch.column("doc_id").to_pylist(), batch.column("y").to_pylist()
        out = []
        for k in range(batch.num_rows):
            for s in range(first[k], max(first[k] + 1, first[k + 1] - 1)):
                x = data[s * BLOCK : (s + 2) * BLOCK + 2 * GAP].copy()
                x[GAP + (min(s + 2, first[k + 1]) - s) * BLOCK :] = 0  # what follows the last block is another's
                out.append((ids[k], ys[k], x.tobytes()))
        yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "y", "x"), r, strict=True)) for r in out], schema=pa.schema([("doc_id", batch.schema.field("doc_id").type), ("y", pa.int32()), ("x", pa.binary())]))


def fit_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "quality", sample: dict[int, int] = SAMPLE) -> ByteNet:
    """Learns from all chunks of at most `sample` documents of each label.

    Without labels of both kinds, the net gives every text the share of label 1 (0.5 without labels).
    """
    ship(spark)
    rows, counts = labelled_sample(spark, docs, labels, label, sample)
    schema = T.StructType([docs.schema["doc_id"]] + T.DataType.fromDDL("y int, x binary").fields)
    got = rows.mapInArrow(_training_chunks, schema).orderBy("doc_id", "x").toArrow()
    y = np.array(got.column("y").to_pylist(), float)
    if len(set(y.tolist())) < 2:
        share = (counts.get(1, 0) + 1e-3) / (sum(counts.values()) + 2e-3)
        return ByteNet(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros((SPAN + 1, FILTERS), np.float32), np.zeros(FILTERS, np.float32), shift=float(np.log(share / (1 - share))))
    chunks = np.frombuffer(b"".join(x for c in got.column("x").chunks for x in c.to_pylist()), np.uint8).reshape(len(y), -1)
    ids = np.array(got.column("doc_id").to_pylist())
    del got
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    size = np.diff(np.r_[first, len(ids)])
    net = train(chunks, y, np.repeat(1.0 / size, size))
    logit = np.concatenate([np.tanh(pooled(net, c).max(1)) @ net.out + net.bias for c in np.array_split(chunks, max(1, len(chunks) // 512))])
    calibrate(net, np.add.reduceat(logit, first) / size, y[first], counts)
    del chunks
    trim()
    return net


def score_quality(docs: DataFrame, net: ByteNet, text: str = "text", into: str = "score") -> DataFrame:
    """Adds the probability of label 1 of each whole text (null as empty: a chunk of zeros).

    Rows and other columns stay, a column named `into` is replaced. No shuffle; the net
    (16,000 numbers) is broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(net)
    docs = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() != into.lower()))
    schema = T.StructType(docs.schema.fields + [T.StructField(into, T.DoubleType())])

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = shared.value
        for part in parts(batches, text=text):
            p = own.probability(own.logits(*blocks_of(*text_bytes(part.column(text)))))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], names=schema.names)

    return docs.mapInArrow(score, schema)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit_quality(spark, docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = score_quality(docs, net)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
