"""Token counts: whole texts are encoded once, and token spans are joined with spans of sections."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import ship
from .common import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "majority", "split")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def _encoder(key: str, pattern: str, ranks: tuple) -> tuple:
    import tiktoken

    known = dict(ranks)
    lengths = np.zeros(max(known.values()) + 1, np.int64)
    for token, i in known.items():
        lengths[i] = len(token)
    return tiktoken.Encoding(key, pat_str=pattern, mergeable_ranks=known, special_tokens={}), lengths


def token_spans(encoding, lengths: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids and the bounds of tokens in UTF-8 bytes: token i is bytes bounds[i] to bounds[i + 1]."""
    ids = np.array(encoding.encode_ordinary(text), np.int64)
    return ids, np.concatenate([[0], np.cumsum(lengths[ids])])


def char_spans(raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans (end exclusive) of tokens: from the character of the first byte to that of the last."""
    first = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    number = np.cumsum(first) - 1
    return number[bounds[:-1]], number[bounds[1:] - 1] + 1


def line_sections(raw: bytes) -> np.ndarray:
    """Sections are lines, each with the newline that ends it: their bounds in bytes."""
    at = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.unique(np.concatenate([[0], at, [len(raw)]]))


def allocate(bounds: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a bound. The sum over sections is the count of tokens.

    start: a token belongs where it starts. majority: where most of its bytes lie, the
    first such section in a tie. split: to each section the share of its bytes there.
    """
    starts, ends, n = bounds[:-1], bounds[1:], len(sections) - 1
    a, b = np.searchsorted(sections, starts, "right") - 1, np.searchsorted(sections, ends, "left") - 1
    crossing = np.flatnonzero(a != b)
    out = np.bincount(a, minlength=n).astype(float)
    if rule != "start":
        for t in crossing:
            parts = [min(ends[t], sections[s + 1]) - max(starts[t], sections[s]) for s in range(a[t], b[t] + 1)]
            out[a[t]] -= 1
            if rule == "majority":
                out[a[t] + int(np.argmax(parts))] += 1
            else:
                out[a[t] : b[t] + 1] += np.array(parts) / (ends[t] - starts[t])
    return out, len(crossing)


def count_tokens(docs: DataFrame, ranks: dict[bytes, int], rule: str = "start", pattern: str = PATTERN, text: str = "text", sections=line_sections) -> DataFrame:
    """Adds n_tokens, n_sections, section_tokens (doubles for `split`, else longs) and n_crossing.

    sections(raw) gives the bounds of sections that tile the UTF-8 bytes of a text. Null
    and empty texts have no tokens and no sections. Rows and other columns stay (columns
    of the four names are replaced); texts are encoded whole, once, without a shuffle.
    The vocabulary (its size is fixed) is broadcast.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship(docs.sparkSession)
    kind = "double" if rule == "split" else "long"
    keep = [c for c in docs.columns if c.lower() not in ("n_tokens", "n_sections", "section_tokens", "n_crossing")]
    docs = docs.select(*(f"`{c}`" for c in keep))
    schema = T.StructType(docs.schema.fields + T.DataType.fromDDL(f"n_tokens long, n_sections long, section_tokens array<{kind}>, n_crossing long").fields)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(ranks.items()))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        encoding, lengths = _encoder("own", pattern, shared.value)
        target = to_arrow_schema(schema)
        for batch in batches:
            n_tokens, n_sections, tokens, crossing = [], [], [], []
            for value in batch.column(text):
                body = value.as_py() or ""
                raw = body.encode()
                ids, bounds = token_spans(encoding, lengths, body)
                cuts = sections(raw)
                got, over = allocate(bounds, cuts, rule) if len(raw) else (np.zeros(0), 0)
                n_tokens.append(len(ids))
                n_sections.append(len(got))
                tokens.append(got if rule == "split" else got.astype(np.int64))
                crossing.append(over)
            new = [pa.array(v, target.field(c).type) for c, v in (("n_tokens", n_tokens), ("n_sections", n_sections), ("section_tokens", tokens), ("n_crossing", crossing))]
            yield pa.RecordBatch.from_arrays(list(batch.columns) + new, names=target.names)

    return docs.mapInArrow(count, schema)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, load_ranks(VOCABULARY)).drop("text")
