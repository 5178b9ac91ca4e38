"""Toxicity: a noisy-channel decoder restores disguised words, and the restored text is scored."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import held_out, table, text_bytes
from .fitting import labelled_sample

#: At most so many documents of each label are learnt from.
SAMPLE = {0: 4000, 1: 2000}
#: Symbols of the character model: 0 no letter, 1-26 a-z, 27-58 the letters of U+00E0-00FF, 59 any other letter.
SYMBOLS = 60
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "€": "e", "£": "l", "(": "c", "*": "abcdefghijklmnopqrstuvwxyz", "#": "abcdefghijklmnopqrstuvwxyz"}
LEET_COST, ANY_COST, DROP_COST, BREAK_COST = -1.0, -4.0, -1.5, -6.0
THRESHOLD = 0.5
FEATURES = 1 << 20
CACHE = 150_000
_LUT = np.zeros(0x180, np.uint8)
_LUT[97:123] = np.arange(1, 27)
_LUT[0xE0:0x100] = np.arange(27, 59)
_LUT[[0xD7, 0xF7]] = 0
_LUT[0x100:] = 59


def symbols_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.where(codes < 0x180, _LUT[np.minimum(codes, 0x17F)], np.where((codes >= 0x2000) & (codes < 0x3040), 0, 59)).astype(np.int64)


def _count_trigrams(batches: Iterator) -> Iterator:
    import pyarrow as pa

    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            raw, at = text_bytes(batch.column(0).slice(start, 512))
            if len(raw):
                s = symbols_of(_apart(raw, at).decode().lower())
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["gram", "n"])


def _apart(raw: bytes, at: np.ndarray) -> bytes:
    return b"  ".join([b"", *(raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)), b""])


def fit_characters(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of character trigrams over all texts: SYMBOLS cubed, summed in tasks before the shuffle."""
    ship(docs.sparkSession)
    grams = docs.select(text).mapInArrow(_count_trigrams, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SYMBOLS**3, np.int64)
    out[np.array(grams.column("gram"))] = np.array(grams.column("n"))
    return out.reshape((SYMBOLS,) * 3)


@dataclass
class Decoder:
    """Viterbi over the readings of a token; its score is the model's log-probability plus the channel's costs."""

    counts: np.ndarray
    logp: list = field(init=False)

    def __post_init__(self) -> None:
        c3 = self.counts.astype(float)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 0.5) / (c1 + 0.5).sum()
        p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2[None]) / (c3.sum(2, keepdims=True) + 5)
        self.logp = np.log(p3).astype(np.float32).tolist()

    def readings(self, token: str) -> list[list[tuple[str, float]]]:
        """For each run of equal characters, what it may stand for: letters, nothing, or a blank."""
        out: list[list[tuple[str, float]]] = []
        for m in re.finditer(r"(.)\1*", token, re.S):
            ch, n = m[1], len(m[0])
            if ch.isalpha():
                out += [[(ch, 0.0), (ch * 2, 0.0)]] if n >= 3 else [[(ch, 0.0)]] * n
            elif ch == " ":
                out.append([("", 0.0), (" ", BREAK_COST)])
            elif ch in LEET and (n == 1 or ch not in "*#!|+("):
                own = [(x, ANY_COST if ch in "*#" else LEET_COST) for x in LEET[ch]]
                drop = [] if ch.isdigit() else [("", DROP_COST)]
                out += [own + drop] if n >= 3 else [own + drop] * n
            else:
                out.append([("", DROP_COST)])
        return out

    def restore(self, token: str) -> str:
        """Linear in the token's length: states are pairs of symbols, and each keeps a chain of the readings before it."""
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        logp = self.logp
        for options in [*self.readings(token), [("\0\0", 0.0)]]:
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, chain) in best.items():
                for read, cost in options:
                    x, y, total = a, b, score + cost
                    for ch in read:
                        k = _symbol(ch)
                        total += logp[x][y][k]
                        x, y = y, k
                    if (x, y) not in new or total > new[x, y][0]:
                        new[x, y] = (total, (chain, read) if read else chain)
            best = new
        ((_, chain),) = best.values()  # the end of the text leads to one state
        out = []
        while chain:
            chain, read = chain
            out.append(read)
        return "".join(reversed(out)).rstrip("\0")


def _symbol(ch: str) -> int:
    o = ord(ch)
    return int(_LUT[o]) if o < 0x180 else 59


_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "$@") + "«»„“”‘’…–—¿¡"
_CLEAN = re.compile(r"[^\W\d_]+\Z")
_RUN = re.compile(r"(.)\1\1")


class Restorer:
    """Words of restored tokens, kept for those seen already."""

    def __init__(self, decoder: Decoder) -> None:
        self.decoder, self.cache = decoder, {}

    def token(self, raw: bytes) -> tuple[str, ...]:
        """A token of letters has one reading. Punctuation at its ends isn't part of it; one without letters has no word."""
        token = raw.decode().lower().strip(_EDGES)
        while len(token) > 1 and token[-1] in "$@" and token[-2] in "$@":
            token = token.rstrip("$@")
        if _CLEAN.match(token) and not _RUN.search(token):
            return (token,)
        if not any(ch.isalpha() for ch in token):
            return tuple(x for x in re.split(r"[\W\d_]+", token) if x)
        return tuple(self.decoder.restore(token).split())

    def words(self, raw: bytes) -> Iterator[tuple[str, ...]]:
        """Words of each distinct token, and of each whole run of three and more single characters between blanks.

        Words split into pieces of two and more characters aren't joined.
        """
        tokens = raw.split()
        for t in set(tokens):
            if (got := self.cache.get(t)) is None:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                got = self.cache[t] = self.token(t)
            yield got
        # a character of several bytes is one too
        single = np.fromiter((len(t) == 1 or (len(t) < 5 and t[0] > 127 and len(t.decode()) == 1) for t in tokens), bool, len(tokens))
        ones = np.flatnonzero(single)
        for run in np.split(ones, np.flatnonzero(np.diff(ones) > 1) + 1) if len(ones) > 2 else ():
            if len(run) > 2:
                spaced = b" ".join(tokens[run[0] : run[-1] + 1]).decode().lower()
                if sum(ch.isalpha() for ch in spaced) > 1:
                    yield tuple(self.decoder.restore(spaced).split())


def word_features(word: str) -> list[int]:
    """Hashed: the word, and its first three to six letters."""
    return [crc32(f"{k}:{word[:k]}".encode()) % FEATURES for k in (3, 4, 5, 6) if len(word) > k] + [crc32(f"w:{word}".encode()) % FEATURES]


@dataclass
class ToxicModel:
    counts: np.ndarray
    weights: dict[int, float]
    bias: float


def _features(shared) :
    def extract(batches: Iterator) -> Iterator:
        import pyarrow as pa

        restorer = Restorer(Decoder(shared.value))
        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            out = []
            for k in range(batch.num_rows):
                found = {f for words in restorer.words(raw[at[k] : at[k + 1]]) for w in words for f in word_features(w)}
                out.append(np.array(sorted(found), "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(out, pa.binary())], names=["y", "f"])

    return extract


def fit_weights(rows: list[tuple[int, np.ndarray]], counts: dict[int, int]) -> tuple[dict[int, float], float]:
    """Logistic regression with weights of 0 and above on features that speak for label 1.

    A feature stays if at least 4 documents of label 1 have it and it is at least 8 times
    as frequent there as among label 0. Classes count as often as among all labels.
    """
    y = np.array([r[0] for r in rows], float)
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    prior = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    flat = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, int)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    of1 = np.bincount(flat, weights=y[row], minlength=FEATURES) if rows else np.zeros(FEATURES)
    of0 = np.bincount(flat, minlength=FEATURES) - of1 if rows else np.zeros(FEATURES)
    chosen = np.flatnonzero((of1 >= 4) & (of1 / n1 >= 8 * (of0 + 0.5) / n0))
    number = np.full(FEATURES, -1)
    number[chosen] = np.arange(len(chosen))
    keep = number[flat] >= 0
    f, r = number[flat][keep], row[keep]
    weight = np.where(y == 1, prior / n1, (1 - prior) / n0) * 1000
    w, b = np.full(len(chosen), 1.0), np.log(prior / (1 - prior)) - 1
    cache, seen = np.full(len(chosen), 1e-8), 1e-8
    for _ in range(300):
        z = b + np.bincount(r, weights=w[f], minlength=len(rows))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gw = np.bincount(f, weights=g[r], minlength=len(chosen)) + 0.02
        gb = g.sum()
        cache += gw**2
        seen += gb**2
        w = np.maximum(0, w - 0.5 * gw / np.sqrt(cache))
        b -= 0.5 * gb / np.sqrt(seen)
    return {int(k): float(x) for k, x in zip(chosen, w, strict=True) if x > 0.05}, float(b)


def fit_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: dict[int, int] = SAMPLE) -> ToxicModel:
    """The character model counts all texts; weights are learnt from at most `sample` documents of each label.

    Without labels all weights are 0 and every score is the prior.
    """
    ship(spark)
    counts = fit_characters(docs)
    rows, of = labelled_sample(spark, docs, labels, label, sample)
    got = rows.select("y", "text").mapInArrow(_features(spark.sparkContext.broadcast(counts)), "y int, f binary").toArrow()
    found = sorted(zip(got.column("y").to_pylist(), got.column("f").to_pylist(), strict=True))
    weights, bias = fit_weights([(y, np.frombuffer(x, "<i4")) for y, x in found], of)
    return ToxicModel(counts, weights, bias)


def score_toxicity(docs: DataFrame, model: ToxicModel, text: str = "text", into: str = "score") -> DataFrame:
    """Adds the probability of label 1 of each whole restored text (null as empty: no words).

    Each distinct token counts once. Rows and other columns stay, a column named `into`
    is replaced. No shuffle; the model (counts of fixed size, weights of at most the
    sample's features) is broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() != into.lower()))
    schema = T.StructType(docs.schema.fields + [T.StructField(into, T.DoubleType())])

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        restorer = _Scorer(shared.value)
        for batch in batches:
            raw, at = text_bytes(batch.column(text))
            z = np.array([sum(restorer.words(raw[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]) + shared.value.bias
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], names=schema.names)

    return docs.mapInArrow(score, schema)


class _Scorer(Restorer):
    """As a Restorer, but with the weight of a token's words in place of the words."""

    def __init__(self, model: ToxicModel) -> None:
        super().__init__(Decoder(model.counts))
        self.weights = model.weights

    def token(self, raw: bytes) -> float:
        return sum(self.weights.get(f, 0.0) for w in super().token(raw) for f in word_features(w))

    def words(self, raw: bytes) -> Iterator[float]:
        for got in super().words(raw):
            yield got if isinstance(got, (int, float)) else sum(self.weights.get(f, 0.0) for w in got for f in word_features(w))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(spark, docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
