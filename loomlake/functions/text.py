"""Scalar functions on text, all within the JVM."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spread
from ..session import ship

# Words left out of keywords, words left out of lexical search, suffixes cut from its words, fillers left
# out of queries, titles before names.
KEYWORD_STOPS = """a an the and or but in on at to for of with by from as is was are were been be have has had do does
did will would could should may might must that this these those it its he she they them his her their we our you your i
me my what which who whom when where why how all each every both few more most other some such no not only own same so
than too very just can""".split()
SEARCH_STOPS = """a an and are as at be by for from has he in is it its of on that the to was were will with this but
they have had what when where who which why how all each every both few more most other some such no nor not only own
same so than too very just can should now i you we our your my me him her them their been being do does did doing would
could if then else or because until while am""".split()
SUFFIXES = "ing ed tion ness ment able ible ful less ly er est es s".split()
FILLERS = "um uh like basically actually literally honestly obviously clearly well so anyway really just very quite pretty rather".split()
HONORIFICS = r"mr\.|mrs\.|ms\.|dr\.|prof\.|sir |lord |lady "
#: Short forms and what they stand for, as patterns: the words listed are those that are expanded.
EXPANSIONS = (
    (r"\bwon't\b", "will not"), (r"\bcan't\b", "cannot"), (r"\blet's\b", "let us"), (r"\bi'm\b", "i am"),
    (r"\b(do|does|did|would|could|should|is|are|was|were|has|have|had)n't\b", "$1 not"),
    (r"\b(you|we|they)'re\b", "$1 are"), (r"\b(he|she|it|what|where|who|how|that|there)'s\b", "$1 is"),
    (r"\b(i|you|we|they)'ve\b", "$1 have"), (r"\b(i|you|he|she|we|they)'ll\b", "$1 will"), (r"\b(i|you|he|she|we|they)'d\b", "$1 would"),
)
#: Han, Kana and Hangul: scripts written without blanks between words.
CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}"


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length on lower case; equal is 1, one empty is 0."""
    x, y = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(x == y, 1.0).when((F.length(x) == 0) | (F.length(y) == 0), 0.0).otherwise(1 - F.levenshtein(x, y) / longest)


def normalise_name(name: Column) -> Column:
    """Lower case without the first title, runs of blanks as one, punctuation at both ends cut."""
    plain = F.regexp_replace(F.lower(name), f"^(?:{HONORIFICS})", "")
    plain = F.trim(F.regexp_replace(plain, r"\s+", " "))
    return F.trim(F.regexp_replace(plain, r"^[.,;:!?\"'()\[\]{}-]+|[.,;:!?\"'()\[\]{}-]+$", ""))


def _words_lit(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def keywords(text: Column, least: int = 3) -> Column:
    """Distinct ASCII words of `least` letters and more, in order of first use, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)\b([a-z]{{{least},}})\b"), 1))
    return F.array_except(found, _words_lit(KEYWORD_STOPS))


def _runs(text: Column) -> Column:
    """Runs of letters, numbers, marks and CJK characters, these not yet apart from the others: the quick class alone."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[a-z0-9\p{{L}}\p{{N}}\p{{M}}{CJK}]++"), 0)


def _cjk(word: Column, where: str = "^") -> Column:
    return (F.octet_length(word) > F.length(word)) & word.rlike(f"{where}[{CJK}]")


def _terms_of_run(run: Column) -> Column:
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))
    parts = F.regexp_extract_all(run, F.lit(rf"[{CJK}]+|[^{CJK}]+"), 0)
    return F.when(_cjk(run, ""), F.flatten(F.transform(parts, lambda w: F.when(_cjk(w), pairs(w)).otherwise(F.array(w))))).otherwise(F.array(run))


def words(text: Column) -> Column:
    """Runs of letters, numbers and marks in lower case; a run of CJK characters gives its pairs, a single one itself.

    Texts are taken to be in NFC: the JVM's functions don't compose characters.
    """
    return F.flatten(F.transform(_runs(text), _terms_of_run))


def stem(word: Column) -> Column:
    """The first suffix that the word ends in and that leaves over two letters goes."""
    out = word
    for suffix in reversed(SUFFIXES):
        n = len(suffix)
        out = F.when(word.endswith(suffix) & (F.length(word) > n + 2), F.substring(word, F.lit(1), F.length(word) - n)).otherwise(out)
    return out


def search_terms(text: Column) -> Column:
    """Terms of lexical search: stop words left out, words stemmed, those of over two letters kept; CJK pairs stay."""
    kept = F.filter(words(text), lambda w: ~F.array_contains(_words_lit(SEARCH_STOPS), w))
    return F.filter(F.transform(kept, lambda w: F.when(_cjk(w), w).otherwise(stem(w))), lambda w: _cjk(w) | (F.length(w) > 2))


def search_counts(rows: DataFrame, id: str, text: str) -> DataFrame:
    """(id, term, tf): how often each of the `search_terms` is in a text. Words come out as rows first, as Spark compiles no functions on arrays."""
    w, term = F.col("w"), F.col("term")
    found = rows.select(id, F.explode(_runs(F.col(text))).alias("w")).select(id, F.explode(_terms_of_run(w)).alias("w")).where(~w.isin(SEARCH_STOPS))
    found = found.select(id, _cjk(w).alias("cjk"), F.when(_cjk(w), w).otherwise(stem(w)).alias("term")).where(F.col("cjk") | (F.length(term) > 2))
    return spread.wide(found.select(id, "term"), id).groupBy(id, "term").agg(F.count("*").alias("tf"))


def email(address: Column) -> Column:
    return F.nullif(F.trim(F.lower(address)), F.lit(""))


def site(url: Column) -> Column:
    """A site's address in lower case without scheme, www. and slashes at its end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(F.lower(url)), "^https?://", ""), r"^www\.", ""), "/+$", "")


def fts_query(text: Column) -> Column:
    """Words in quotes, joined by OR; quotes within are left out."""
    found = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), 1)
    return F.array_join(F.transform(found, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")


def types_compatible(a: Column, b: Column) -> Column:
    return (a == b) | a.isin("CONCEPT", "CUSTOM") | b.isin("CONCEPT", "CUSTOM")


def type_penalty(hint: Column, kind: Column) -> Column:
    """1 for equal types or without a hint, 0.9 beside CONCEPT or CUSTOM, else 0.3."""
    return F.when(hint.isNull() | (hint == kind), 1.0).when(hint.isin("CONCEPT", "CUSTOM") | kind.isin("CONCEPT", "CUSTOM"), 0.9).otherwise(0.3)


def containment(a: Column, b: Column) -> Column:
    """How much of the longer text the shorter one is, if it lies within; else 0."""
    x, y = F.lower(a), F.lower(b)
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    return F.when((F.length(short) > 0) & F.contains(long, short), F.length(short) / F.length(long)).otherwise(0.0)


def token_overlap(a: Column, b: Column) -> Column:
    """Common distinct words over the greater number of distinct words."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")) for c in (a, b))
    most = F.greatest(F.size(x), F.size(y))
    return F.when(most > 0, F.size(F.array_intersect(x, y)) / most).otherwise(0.0)


@lru_cache(1 << 15)
def _jaro_winkler(s: str, t: str) -> float:
    if s == t:
        return 1.0
    reach, used, mine = max(0, max(len(s), len(t)) // 2 - 1), [False] * len(t), []
    for i, ch in enumerate(s):
        for j in range(max(0, i - reach), min(len(t), i + reach + 1)):
            if not used[j] and t[j] == ch:
                used[j] = True
                mine.append(ch)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [ch for ch, u in zip(t, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(s) + m / len(t) + (m - swaps) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(s[:4], t[:4], strict=False)) if x != y), min(4, len(s), len(t)))
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity, prefix weight 0.1, for a similarity of over 0.7. Spark has no such function: batches go to Python by Arrow; a worker keeps the last pairs' values."""
    def both(x, y):
        import pandas as pd

        return pd.Series([None if s is None or t is None else _jaro_winkler(s, t) for s, t in zip(x, y, strict=True)], dtype="float64")

    ship(SparkSession.active())
    return F.pandas_udf(both, "double", F.PandasUDFType.SCALAR)(a, b)


def domain(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^[a-z]+://(www\.)?", ""), r"[/?#].*$", "")


def strip_nul(text: Column) -> Column:
    return F.translate(text, "\0", "")


def safe_label(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), r"[^A-Z0-9_]", "_")


def normalise_query(text: Column) -> Column:
    """Lower case, short forms expanded, fillers left out, repeated ends of sentences and blanks as one."""
    out = F.trim(F.lower(text))
    for pattern, full in EXPANSIONS:
        out = F.regexp_replace(out, "(?U)" + pattern, full)
    kept = F.filter(F.split(out, r"\s+"), lambda w: (w != "") & ~F.array_contains(_words_lit(FILLERS), w))
    return F.trim(F.regexp_replace(F.array_join(kept, " "), r"([?!.]){2,}", "$1"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(a))


def clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
