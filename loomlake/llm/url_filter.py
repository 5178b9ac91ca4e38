"""URL filters: glob rules packed into the words of one Shift-And automaton."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import ascii_lower, table

#: A symbol above all code points parts host and path, so that no `*` before it can reach into the path.
CUT = 0x110000
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DEFAULT_VERDICT = "allow"


def host_glob(host: str, path: str) -> list[int | str]:
    """The glob `*.host CUT path*` over `.host CUT path`: the host, its subdomains, and paths that start so."""
    return ["*", *map(ord, f".{host.lower()}"), CUT, *map(ord, path), "*"]


@dataclass
class GlobAutomaton:
    """All globs at once: bit i of a glob's field says that its first i symbols have matched.

    A glob is a list of code points, "?" (one symbol) and "*" (any run). Fields lie one
    after another in 64-bit words; a shift carries from word to word, and no symbol ever
    sets the first bit of a field, so nothing leaks from one glob into the next.
    """

    globs: Sequence[Sequence[int | str]]
    symbols: np.ndarray = field(init=False)
    masks: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        plain = [[x for x in g if x != "*"] for g in self.globs]
        starts = np.cumsum([0, *(len(p) + 1 for p in plain)])
        self.words = max(1, -(-int(starts[-1]) // 64))
        self.symbols = np.array(sorted({x for p in plain for x in p if x != "?"}), np.int64)
        bits = lambda: np.zeros(self.words * 64, bool)
        rows, init, loop, self.final = [bits() for _ in range(len(self.symbols) + 1)], bits(), bits(), []
        index = {int(x): i for i, x in enumerate(self.symbols)}
        for g, p, s in zip(self.globs, plain, starts[:-1], strict=True):
            init[s] = True
            for i, x in enumerate(p):
                for row in rows if x == "?" else [rows[index[x]]]:
                    row[s + i + 1] = True
            seen = 0
            for x in g:
                if x == "*":
                    loop[s + seen] = True
                else:
                    seen += 1
            self.final.append(s + len(p))
        pack = lambda b: np.packbits(b, bitorder="little").view(np.uint64)
        self.masks, self.init, self.loop = np.array([pack(r) for r in rows]), pack(init), pack(loop)

    def match(self, texts: Sequence[np.ndarray]) -> np.ndarray:
        """For code-point arrays, a boolean matrix: text by glob."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in order])
        flat = np.concatenate([texts[i] for i in order]) if len(order) else np.zeros(0, np.int64)
        at = np.searchsorted(self.symbols, flat)
        known = np.append(self.symbols, -1)[at] == flat
        kind = np.where(known, at, len(self.symbols))
        first = np.cumsum(lengths) - lengths
        state = np.tile(self.init, (len(order), 1))
        for t in range(int(lengths[0]) if len(lengths) else 0):
            n = int(np.searchsorted(-lengths, -t, "left"))  # texts longer than t stand first
            d = state[:n]
            moved = d << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.masks[kind[first[:n] + t]]) | (d & self.loop)
        out = np.zeros((len(order), len(self.globs)), bool)
        for j, b in enumerate(self.final):
            out[order, j] = state[:, b // 64] >> np.uint64(b % 64) & np.uint64(1) != 0
        return out


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def filter_urls(urls: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = DEFAULT_VERDICT, column: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict for each row's url, by the longest rule that fits.

    rules: (verdict, host, path); a rule fits its host and all subdomains if the path
    starts with the rule's. Length is that of host and path together, ties go to the
    rule that stands first. No url, no `://`: host and path are empty, no rule fits, the
    verdict is `default`. All rows and columns stay; columns of the four names are
    replaced. No shuffle; the automaton (bits of all rules times distinct symbols) goes
    with the function to each task.
    """
    ship(urls.sparkSession)
    names = [f"{h}{p}" for _, h, p in rules]
    rank = np.argsort(np.argsort([-len(n) for n in names], kind="stable"), kind="stable")
    automaton = GlobAutomaton([host_glob(h, p) for _, h, p in rules])

    @F.pandas_udf("int")
    def chosen(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for host, path in parts:
            codes = [np.array([46, *map(ord, h), CUT, *map(ord, p)], np.int64) for h, p in zip(host, path, strict=True)]
            fits = automaton.match(codes)
            score = np.where(fits, rank, len(names)) if names else np.zeros((len(codes), 1), int)
            yield pd.Series(np.where(score.min(1) < len(names), score.argmin(1), -1).astype("int32"))

    keep = [c for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    out = urls.select(*(F.col(f"`{c}`") for c in keep), url_host(F.col(column)).alias("host"), url_path(F.col(column)).alias("path"))
    out = out.withColumn("_rule", chosen("host", "path"))
    pick = lambda values, other: F.when(F.col("_rule") >= 0, F.element_at(F.array(*map(F.lit, values)), F.col("_rule") + 1)).otherwise(F.lit(other)) if values else F.lit(other)
    return out.select(*(F.col(f"`{c}`") for c in keep), "host", "path", pick(names, None).cast("string").alias("rule"), pick([v for v, _, _ in rules], default).alias("verdict"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS r FROM pages
), parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rest
), rules(v, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""
