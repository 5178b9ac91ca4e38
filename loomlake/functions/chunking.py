"""Text to rows: chunks of fixed size, by separators, by lines, and of conversations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", ". ", ", ", " ", "")


def _chunked(docs: DataFrame, id: str, text: str, cut: Callable[[str], Iterator[str]]) -> DataFrame:
    """(id, chunk_index, content) of a function from a text to its chunks: what it cuts depends on the cut before, so Python walks it."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for key, body in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = list(cut(body)) if body and body.strip() else []
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(own), batch.schema.field(0).type), pa.array(range(len(own)), pa.int32()), pa.array(own, pa.string())], names=["id", "chunk_index", "content"])

    return docs.select(F.col(id).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, chunk_index int, content string")


def fixed_chunks(docs: DataFrame, id: str, text: str, size: int = 2048, overlap: int = 200) -> DataFrame:
    """(id, chunk_index, content): pieces of at most `size` characters, each `overlap` into the one before.

    A piece that isn't the last ends at the last blank of its second half, if there is one.
    Contents are trimmed; null and blank texts, and blank pieces, give none.
    """
    if not 0 <= overlap < size // 2:
        raise ValueError("overlap must be below half the size")

    def cut(body: str) -> Iterator[str]:
        start = 0
        while start < len(body):
            end = min(start + size, len(body))
            if end < len(body) and (blank := body.rfind(" ", start + size // 2, end)) > start:
                end = blank
            if piece := body[start:end].strip():
                yield piece
            start = end - overlap if end < len(body) else end

    return _chunked(docs, id, text, cut)


def recursive_chunks(docs: DataFrame, id: str, text: str, size: int = 512, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """(id, chunk_index, content): parts between the first separator, too long ones between the next, packed up to `size` tokens.

    A token is four characters. Each chunk but the first begins with the last `overlap`
    tokens' characters of the one before. Contents are trimmed.
    """
    tokens = lambda s: len(s) // 4

    def split(body: str, level: int) -> Iterator[str]:
        if level == len(separators):
            yield body
        elif separators[level] == "":
            yield from body
        else:
            parts = body.split(separators[level])
            for k, part in enumerate(parts):
                part += separators[level] if k < len(parts) - 1 else ""
                if not part.strip():
                    continue
                if tokens(part) <= size or level + 1 == len(separators):
                    yield part
                else:
                    yield from split(part, level + 1)

    def cut(body: str) -> Iterator[str]:
        held, count = "", 0
        for part in split(body, 0):
            n = tokens(part)
            if count + n <= size:
                held, count = held + part, count + n
                continue
            if held.strip():
                yield held.strip()
            held = (held[-4 * overlap :] if overlap and held else "") + part
            count = tokens(held)
        if held.strip():
            yield held.strip()

    return _chunked(docs, id, text, cut)


def conversation_chunks(messages: DataFrame, by: str, ts: str, id: str, gap_minutes: int = 15, most: int = 50, session_minutes: int = 30) -> DataFrame:
    """(by, id, chunk, session) of each message: chunks end at gaps and after `most` messages, sessions at longer gaps.

    A chunk of one message joins the one before, and the second joins the first if that has
    one message; so no chunk has one but a conversation's only one. Messages of one time
    come by id.
    """
    w = Window.partitionBy(by).orderBy(ts, id)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gap = us(ts) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    marked = messages.select(by, id, ts, F.coalesce((gap > gap_minutes * 60_000_000).cast("int"), F.lit(0)).alias("g"))
    marked = marked.withColumn("g", F.sum("g").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.row_number().over(Window.partitionBy(by, "g").orderBy(ts, id)) - 1
    # one number for each run of a gap and a piece of `most`, then the runs' sizes
    cutters = marked.withColumn("p", F.floor(at / most)).withColumn("k", F.dense_rank().over(Window.partitionBy(by).orderBy("g", "p")) - 1)
    runs = cutters.groupBy(by, "k").agg(F.count("*").alias("n"), F.min(ts).alias("a"), F.max(ts).alias("b"))
    wr = Window.partitionBy(by).orderBy("k")
    opens = (F.col("k") == 0) | ((F.col("n") > 1) & ~((F.col("k") == 1) & (F.lag("n").over(wr) == 1)))
    runs = runs.withColumn("chunk", F.sum(opens.cast("int")).over(wr.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    whole = runs.groupBy(by, "chunk").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    wc = Window.partitionBy(by).orderBy("chunk")
    far = us("a") - F.unix_micros(F.lag("b").over(wc).cast("timestamp")) > session_minutes * 60_000_000
    whole = whole.withColumn("session", F.sum(F.coalesce(far.cast("int"), F.lit(0))).over(wc.rowsBetween(Window.unboundedPreceding, 0)))
    return cutters.select(by, id, "k").join(runs.select(by, "k", "chunk"), [by, "k"]).join(whole.select(by, "chunk", "session"), [by, "chunk"]).select(by, id, "chunk", "session")


def line_chunks(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, chunk_index, content): the paragraphs of a text, blank ones left out but counted."""
    rows = docs.select(F.col(id).alias("id"), F.posexplode(F.split(text, "\n")).alias("chunk_index", "content"))
    return rows.where(F.trim("content") != "")
