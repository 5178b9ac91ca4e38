"""Benchmark decontamination: a generalised suffix automaton of test items reads training words."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import Workspace, byte_table, let_go, table, text_bytes, trim

WINDOW = 10
#: Bytes of item texts in one automaton: some 35 MB of a task's memory, 120 MB of the driver's while it is built.
BLOCK_BYTES = 1 << 20
#: More items make more automata. So many are read in one pass over the documents; then the table is written.
CHAIN = 4


class SuffixAutomaton:
    """Of several word sequences; the state after a word stands for the longest suffix that an item holds."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, nexts: dict[int, int], link: int) -> int:
        self.next.append(nexts)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        cur, p = self._state(self.length[last] + 1, {}, 0), last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return cur

    def freeze(self) -> FrozenAutomaton:
        return FrozenAutomaton(self)


class FrozenAutomaton:
    """A finished automaton in flat arrays: about 25 bytes a state and arc instead of the 500 of sets and dictionaries."""

    def __init__(self, grown: SuffixAutomaton) -> None:
        self.base = 1 + max((max(x, default=0) for x in grown.next), default=0)
        arcs = sorted((s * self.base + w, to) for s, own in enumerate(grown.next) for w, to in own.items())
        self.arcs, self.to = array("q", (a for a, _ in arcs)), array("i", (t for _, t in arcs))
        self.link, self.length = array("i", grown.link), array("i", grown.length)
        self.items: dict[int, tuple[int, ...]] = {}

    def after(self, state: int, w: int) -> int:
        """The state that an arc leads to, or -1."""
        if not 0 <= w < self.base:
            return -1
        at = bisect_left(self.arcs, key := state * self.base + w)
        return self.to[at] if at < len(self.arcs) and self.arcs[at] == key else -1

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """After one more word: the state and the length of the longest match that ends there."""
        while (to := self.after(state, w)) < 0:
            if not state:
                return 0, 0
            state = self.link[state]
            length = self.length[state]
        return to, length + 1


class ItemMatcher:
    """The windows of items: each run of `window` words, or the whole of a shorter item."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int) -> None:
        self.window, self.vocabulary, self.names = window, {}, []
        self.short: dict[tuple[int, ...], set[int]] = {}
        automaton, kept = SuffixAutomaton(), []
        for name, text in items:
            words = text.translate(byte_table("alnum")).split()
            if not words:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            k = len(self.names)
            self.names.append(name)
            kept.append(ids)
            if len(ids) < window:
                self.short.setdefault(tuple(ids), set()).add(k)
            last = 0
            for w in ids:
                last = automaton.extend(last, w)
        self.automaton = automaton = automaton.freeze()
        windows: dict[int, set[int]] = {}
        for k, ids in enumerate(kept):  # a state's windows: those of the items that pass it at the window's length
            state = length = 0
            for w in ids if len(ids) >= window else ():
                state, length = automaton.step(state, length, w)
                if length >= window:
                    windows.setdefault(self._at(state), set()).add(k)
        automaton.items = {s: tuple(sorted(x)) for s, x in windows.items()}
        self.short_lengths = sorted({len(x) for x in self.short})
        self.least = min([window, *self.short_lengths])
        pairs = {(a, b) for ids in kept for a, b in zip(ids, ids[1:])}
        self.base = max(1, len(self.vocabulary))
        self.pairs = np.array(sorted(a * self.base + b for a, b in pairs), np.int64)

    def _at(self, state: int) -> int:
        """The suffix of `window` words of what a state stands for."""
        a = self.automaton
        while a.link[state] >= 0 and a.length[a.link[state]] >= self.window:
            state = a.link[state]
        return state

    def read(self, words: list[bytes]) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Words hit, spans of words hit (end exclusive, merged), items whose windows occur."""
        ids = np.fromiter(map(self.vocabulary.get, words, [-1] * len(words)), np.int64, len(words))
        if self.least > 1:  # matches of two words and more lie where pairs of neighbours are known
            near = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            code = ids[near] * self.base + ids[near + 1]
            spot = np.minimum(np.searchsorted(self.pairs, code), max(0, len(self.pairs) - 1))
            near = near[self.pairs[spot] == code] if len(self.pairs) else near[:0]
        else:
            near = np.flatnonzero(ids >= 0)
        if not len(near):
            return 0, [], set()
        cuts = np.flatnonzero(np.diff(near) > 1) + 1
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        over = 1 if self.least > 1 else 0
        firsts, lasts = near[np.r_[0, cuts]], near[np.r_[cuts - 1, len(near) - 1]] + 1 + over
        for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True):
            if b - a >= self.least:
                self._run(ids, a, b, spans, found)
        return sum(b - a for a, b in spans), spans, found

    def _run(self, ids: np.ndarray, a: int, b: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        automaton, state, length, run = self.automaton, 0, 0, ids[a:b].tolist()

        def hit(start: int, end: int) -> None:
            while spans and start <= spans[-1][1]:
                s, e = spans.pop()
                start, end = min(start, s), max(end, e)
            spans.append((start, end))

        for i, w in enumerate(run):
            state, length = automaton.step(state, length, w)
            if length >= self.window:
                found.update(automaton.items[self._at(state)])
                hit(a + i + 1 - self.window, a + i + 1)
            for n in self.short_lengths:
                if n > length:
                    break
                if (items := self.short.get(tuple(run[i + 1 - n : i + 1]))) is not None:
                    found |= items
                    hit(a + i + 1 - n, a + i + 1)


def _blocks(items: DataFrame, item_id: str, item_text: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    block, held = [], 0
    rows = items.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").cast("binary").alias("t"))
    for r in rows.toLocalIterator():
        if r.t is not None:
            if block and held + len(r.t) > block_bytes:
                yield block
                block, held = [], 0
            block.append(("" if r.i is None else r.i, bytes(r.t)))
            held += len(r.t)
    yield block


def benchmark_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds n_words, n_hit, spans (of words, end exclusive) and items (sorted distinct ids as text) to each row.

    Words are runs of digits, a-z (after lower-casing A-Z) and non-ASCII characters. A
    window is `window` consecutive words of an item, or all of a shorter one; a word
    inside any occurrence is hit. Null or wordless texts have no words, items without
    words no windows, equal items all count, a null item id is the empty string. Every
    row and column stays (columns of the four names are replaced); texts are read whole.

    The automaton of at most `block_bytes` of item texts (one longer item is a block of its
    own) goes to each task; beyond that bound more automata follow, CHAIN in a pass, each
    adding to the spans so far. Docs aren't shuffled.
    """
    return _read_items(docs, items, window, text, item_id, item_text, block_bytes, None)


def _read_items(docs: DataFrame, items: DataFrame, window: int, text: str, item_id: str, item_text: str, block_bytes: int, finish) -> DataFrame:
    """As benchmark_spans; with `finish`, a (schema, function) pair, the last automaton's pass returns what that makes of each part."""
    spark = docs.sparkSession
    ship(spark)
    keep = [c for c in docs.columns if c.lower() not in ("n_words", "n_hit", "spans", "items")]
    out = docs.select(*(F.col(f"`{c}`") for c in keep))
    added = T.DataType.fromDDL("n_words long, n_hit long, spans array<struct<start: int, end: int>>, items array<string>")
    first, ws = True, None
    blocks = _blocks(items, item_id, item_text, block_bytes)
    block, number = next(blocks), 0
    while block is not None:
        following = next(blocks, None)
        if number and number % CHAIN == 0:
            ws = ws or Workspace(spark, "spans")
            out = ws.cut(out, str(number))
        shared = spark.sparkContext.broadcast(ItemMatcher(block, window))
        schema = T.StructType(list(out.schema.fields) + (list(added.fields) if first else []))
        last = finish if following is None else None
        out = out.mapInArrow(_reader(shared, text, first, schema, last and last[1]), last[0] if last else schema)
        first, block, number = False, following, number + 1
    return out


def _reader(shared, text: str, first: bool, schema: T.StructType, finish=None):
    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        let_go()
        matcher, target = shared.value, to_arrow_schema(schema)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                raw, at = text_bytes(part.column(text))
                raw = raw.translate(byte_table("alnum"))
                n_words, n_hit, spans, items = [], [], [], []
                for k in range(part.num_rows):
                    words = raw[at[k] : at[k + 1]].split()
                    hit, own, found = matcher.read(words)
                    names = {matcher.names[x] for x in found}
                    if not first:
                        own, names = _union(own, part.column("spans")[k].as_py(), names, part.column("items")[k].as_py())
                        hit = sum(b - a for a, b in own)
                    n_words.append(len(words))
                    n_hit.append(hit)
                    spans.append(own)
                    items.append(sorted(names))
                if finish:
                    yield finish(part, n_words, n_hit, spans)
                    continue
                spans = [[{"start": a, "end": b} for a, b in own] for own in spans]
                old = [part.column(f.name) for f in target][: len(target) - 4] if not first else list(part.columns)
                new = [pa.array(v, target.field(n).type) for n, v in (("n_words", n_words), ("n_hit", n_hit), ("spans", spans), ("items", items))]
                yield pa.RecordBatch.from_arrays(old + new, names=target.names)
        trim()

    return read


def _union(own: list, before: list, names: set, named: list) -> tuple[list, set]:
    out: list[tuple[int, int]] = []
    for a, b in sorted([*own, *((s["start"], s["end"]) for s in before)]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out, names | set(named)


def remove_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """Texts without the words that benchmark windows hit; rows of which more than `coverage` is hit go.

    A span goes from its first word's first character to its last word's last; separators
    stay. Rows that aren't hit keep their text as it is, nulls too. Columns stay.
    """
    # whole rows travel as one column, so that no name of theirs can meet another
    rows = docs.select(F.col("text"), F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"))
    schema = T.StructType([rows.schema["row"], T.StructField("left", T.StringType())])

    def cut(part, n_words: list[int], n_hit: list[int], spans: list[list[tuple[int, int]]]):
        import re

        import pyarrow as pa

        word, texts, new = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), part.column("text"), []
        kept = [k for k, (n, h) in enumerate(zip(n_words, n_hit, strict=True)) if h == 0 or h <= coverage * n]
        for k in kept:
            if not spans[k]:
                new.append(texts[k].as_py())
                continue
            raw = texts[k].as_py().encode()
            at = [m.span() for m in word.finditer(raw)]
            left, done = [], 0
            for a, b in spans[k]:
                left.append(raw[done : at[a][0]])
                done = at[b - 1][1]
            left.append(raw[done:])
            new.append(b"".join(left).decode())
        return pa.RecordBatch.from_arrays([part.column("row").take(pa.array(kept, pa.int64())), pa.array(new, pa.string())], names=["row", "left"])

    out = _read_items(rows, items, window, "text", "item_id", "text", BLOCK_BYTES, (schema, cut))
    return out.select(*(F.col("left").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = benchmark_spans(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS p FROM i WHERE len(w) > 0)
), dw AS (
  SELECT r, p, k, array_to_string(w[p : p + k - 1], ' ') AS s
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)
), m AS (SELECT r, p, dw.k, item FROM dw JOIN iw USING (k, s)),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM m) GROUP BY r),
n AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS l FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""
