"""The corpus operators against brute force and round trips, with nulls, empty and long texts, ties and clashing columns."""

import random
import re
import zlib

import numpy as np
import pytest

from loomlake.llm import bm25, common, decontaminate, line_dedup, near_dedup, pieces, quality, sharding, token_counts, toxicity, url_filter

DIR = "/root/testdata/sf0.001"
WORDS = "amber birch cedar delta ember fjord grove heron islet jetty knoll larch maple north ocean pearl quartz river stone thorn umbra vault willow xenon yarrow zephyr".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def fixture(seed=1):
    """Near copies, exact copies, repeats of whole rows, nulls, empties, one long text."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(1, 80)) for _ in range(40)]
    for k in range(0, 20):
        words = texts[k].split(" ")
        if len(words) > 10:
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [texts[3].upper(), texts[3], texts[3], "", None, " \t\n ", "one", "ONE", prose(rng, 4000), "zażółć gęślą jaźń 東京 東京", "\x00a b\x0bc"]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, texts[4]), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- near duplicates --------------------------------------------------------------------


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("words,block", [(4, 512), (5, 3)])
def test_near_duplicates(spark, words, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    rows = [r for r in fixture() if r[0] is not None]
    # a bucket of several blocks: neighbours of a chain are linked, others share registers without a link
    base = [f"w{k}" for k in range(120)]
    rows += [(200 + k, " ".join(base[:k] + [f"x{j}" for j in range(k)] + base[2 * k :])) for k in range(0, 40)]
    sets = [shingles(t, words) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(len(rows), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root[k]] = min(i, least.get(root[k], i))
    want = sorted((i, len(s), least[r] if s else i, i == (least[r] if s else i)) for (i, _), s, r in zip(rows, sets, root))
    got = near_dedup.near_duplicates(frame(spark, rows), words)
    assert sorted(map(tuple, got.collect())) == want
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = fixture()
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, mark int")
    sets = [shingles(t, 5) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(len(rows), links)
    groups = {}
    for k, r in enumerate(root):
        groups.setdefault(r, []).append(k)
    got = near_dedup.one_of_each(df, 5).collect()
    kept = {r.mark for r in got}
    assert len(kept) == len(got) == sum(1 if sets[g[0]] else len(g) for g in groups.values())
    for g in groups.values():
        assert len(kept & set(g)) == (1 if sets[g[0]] else len(g))
        least = min(g, key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
        assert not sets[g[0]] or {rows[k][0] for k in kept & set(g)} == {rows[least][0]}
    assert near_dedup.one_of_each(df.limit(0), 5).count() == 0


def test_set_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.unique(x[:2000]), np.unique(x[500:])
    ra, rb = near_dedup.registers(a), near_dedup.registers(b)
    assert (np.maximum(ra, rb) == near_dedup.registers(np.union1d(a, b))).all()
    j = near_dedup.likely_jaccard(ra[None], rb[None], np.array([2000.0]), np.array([2500.0]))[0]
    assert abs(j - 0.5) < 0.12


def test_cuts_give_free_memory_of_the_driver_back(spark, monkeypatch):
    said, trim = [], common.trim_jvm
    monkeypatch.setattr(common, "trim_jvm", lambda session: said.append(trim(session)))
    common.Workspace(spark, "trim").cut(spark.range(3), "rows")
    assert len(said) == 1 and "native heap" in said[0]


# ---- line dedup --------------------------------------------------------------------------


def char_runs(body):
    raw = body.encode("utf-16-be")
    n = max(1, len(body) - 7)
    return {raw[2 * p : 2 * p + 16] for p in range(n)}


def test_lines_match_brute_force(spark):
    rng = random.Random(5)
    lines = [prose(rng, rng.randrange(4, 60)) for _ in range(30)]
    lines += [x[:-3] + "end" for x in lines[:12]] + [x.upper() + "  " for x in lines[5:8]]
    rows = [(i, "\n".join(rng.sample(lines, rng.randrange(1, 6)) + ["", "  "])) for i in range(25)]
    rows += [(90, None), (91, ""), (92, "short\nshort\nother"), (None, "short"), rows[0]]
    got = line_dedup.mark_lines(spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, gone int")).collect()
    occurrences = {}
    for i, t in {r for r in rows if r[1] is not None}:
        for k, line in enumerate(t.split("\n")):
            if line.strip(" "):
                occurrences.setdefault(line.strip(" ").lower(), []).append(((i is not None, i or 0), k, t))
    bodies = list(occurrences)
    sets = [char_runs(b) for b in bodies]
    links = [(a, b) for a in range(len(bodies)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = roots(len(bodies), links)
    kept, total = {}, 0
    for k, b in enumerate(bodies):
        total += len(occurrences[b])
        kept[root[k]] = min([*occurrences[b], *([kept[root[k]]] if root[k] in kept else [])])
    firsts = {(i, t, n) for i, n, t in kept.values()}
    want = {}
    for b in bodies:
        for i, n, t in occurrences[b]:
            if (i, t, n) not in firsts:
                want.setdefault((i, t), set()).add(n)
    assert len(got) == len(rows)
    for r in got:
        assert set(r.gone) == want.get(((r.doc_id is not None, r.doc_id or 0), r.text), set()), r
    assert line_dedup.mark_lines(empty(spark)).count() == 0


def test_lines_of_one_bucket_are_all_compared(spark, monkeypatch):
    rng = random.Random(8)
    tails = [" ".join(rng.choice(WORDS) + str(rng.randrange(1000)) for _ in range(12)) for _ in range(40)]
    bodies = tails + [t[:-4] + "last" for t in tails[:15]]
    sets = [char_runs(b) for b in bodies]
    want = {(a, b) for a in range(len(bodies)) for b in range(a + 1, len(bodies)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(want) >= 10
    monkeypatch.setattr(line_dedup, "_signatures", lambda lines: lines.selectExpr("k", "7L AS key"))
    root = roots(len(bodies), want)
    least = {r: min(k for k, x in enumerate(root) if x == r) for r in root}
    for rows in (512, 9):
        monkeypatch.setattr(line_dedup, "BLOCK_ROWS", rows)
        got = line_dedup.mark_lines(frame(spark, list(enumerate(bodies)))).collect()
        assert {r.doc_id for r in got if r.gone} == {k for k, r in enumerate(root) if least[r] != k}


def test_only_lines_of_near_sketches_are_taken_apart(spark, monkeypatch):
    rng = random.Random(9)
    tails = [" ".join(rng.choice(WORDS) + str(rng.randrange(1000)) for _ in range(rng.randrange(2, 40))) for _ in range(60)]
    bodies = tails + [t[: len(t) - 1 - len(t) // c] + "z" * 4 for c in (30, 12, 8, 5) for t in tails[:20]] + ["ha " * 40, "ha " * 44, "東京" * 30, "東京" * 31, "x", "y"]
    sets = [char_runs(b) for b in bodies]
    pairs = [(a, b) for a in range(len(bodies)) for b in range(a)]
    want = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    lines = spark.createDataFrame([(k, k, k, b) for k, b in enumerate(bodies)], "h1 long, h2 long, k long, body string")
    sketches = line_dedup._sketches(lines, lines.select("k")).localCheckpoint()
    assert {r.k: r.n for r in sketches.collect()} == {k: len(s) for k, s in enumerate(sets)}
    at = lambda x: sketches.selectExpr(f"k AS {x}", f"n AS n_{x}", f"s AS s_{x}")
    near = {(r.a, r.b) for r in at("a").crossJoin(at("b")).where("a > b").where(line_dedup.may_be_similar(0.8)).select("a", "b").collect()}
    assert near >= set(want) and len(near) < 2 * len(want) < len(pairs) / 10

    asked, links = [], line_dedup._links
    monkeypatch.setattr(line_dedup, "_signatures", lambda lines: lines.selectExpr("k", "7L AS key"))
    monkeypatch.setattr(line_dedup, "_links", lambda lines, met, similarity: asked.append(met.count()) or links(lines, met, similarity))
    got = line_dedup.mark_lines(frame(spark, list(enumerate(bodies)))).collect()
    root = roots(len(bodies), want)
    least = {r: min(k for k, x in enumerate(root) if x == r) for r in root}
    assert {r.doc_id for r in got if r.gone} == {k for k, r in enumerate(root) if least[r] != k}
    assert len(asked) == 3 and sum(asked) < 2 * len(want)


def test_links_need_the_bodies_of_members_only(spark):
    rng = random.Random(12)
    bodies = [" ".join(rng.choice(WORDS) + str(rng.randrange(1000)) for _ in range(12)) for _ in range(12)]
    bodies += [t[:-4] + "last" for t in bodies[:6]] + ["ha " * 40, "ha " * 44, "東京" * 30, "東京" * 31, "x"]
    sets = [char_runs(b) for b in bodies]
    lines = spark.createDataFrame([(k, -k, k, b) for k, b in enumerate(bodies)], "h1 long, h2 long, k long, body string")
    members = [k for k in range(len(bodies)) if k % 5]
    own = line_dedup._own(lines, spark.createDataFrame([(key, k) for k in members for key in (1, 2)], "key long, k long")).localCheckpoint()
    assert sorted(map(tuple, own.collect())) == [(k, bodies[k]) for k in members]
    pairs = [(a, b) for a in members for b in members if a < b]
    want = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(want) >= 4
    assert {tuple(r) for r in line_dedup._links(own, spark.createDataFrame(pairs, "a long, b long"), 0.8).collect()} == want
    assert {r.k: r.n for r in line_dedup._sketches(own).collect()} == {k: len(sets[k]) for k in members}


def signed(spark, bodies):
    lines = spark.createDataFrame([(k, k, k, b) for k, b in enumerate(bodies)], "h1 long, h2 long, k long, body string")
    out = {k: set() for k in range(len(bodies))}
    for r in line_dedup._signatures(lines).collect():
        out[r.k].add(r.key)
    return [out[k] for k in range(len(bodies))]


def test_signatures_do_not_depend_on_the_stride(spark, monkeypatch):
    rng = random.Random(6)
    bodies = ["".join(rng.choice("abcdefgh 東") for _ in range(n)) for n in (*range(1, 24), 90, 301)]
    monkeypatch.setattr(line_dedup, "STRIDE", 2)
    want = signed(spark, bodies)
    assert all(want)
    for stride in (3, 4, 8):
        monkeypatch.setattr(line_dedup, "STRIDE", stride)
        assert signed(spark, bodies) == want


def test_long_lines_of_few_runs_are_signed(spark):
    bodies = [c * n for c in "=-_*#ab.~" for n in (200, 300)] + ["ha " * 90, "ha " * 91]
    keys = signed(spark, bodies)
    assert all(keys) and all(keys[k] == keys[k + 1] for k in range(0, len(keys), 2))
    got = line_dedup.mark_lines(frame(spark, list(enumerate(bodies)))).collect()
    assert {r.doc_id for r in got if r.gone} == set(range(1, len(bodies), 2))


def test_lines_of_equal_runs_are_linked_at_any_length(spark):
    rng = random.Random(4)
    period = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40))
    bodies = [period * 3, period * 9, "=" * 20, "=" * 100, "=" * 400, "lone line of another kind"]
    assert len({frozenset(char_runs(b)) for b in bodies}) == 3
    keys = signed(spark, bodies)
    assert keys[0] == keys[1] and keys[2] == keys[3] == keys[4]
    got = line_dedup.mark_lines(frame(spark, list(enumerate(bodies)))).collect()
    assert {r.doc_id for r in got if r.gone} == {1, 3, 4}


def test_dedup_lines_keeps_clean_rows(spark):
    df = spark.createDataFrame([(1, "a line that is here\nand one more", "x"), (2, "A line that is here", "y"), (3, None, "z"), (4, "", None)], "doc_id long, text string, line string")
    got = {r.doc_id: (r.text, r.line) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: ("a line that is here\nand one more", "x"), 3: (None, "z"), 4: ("", None)}


def test_lines_and_spans_keep_columns_of_any_name(spark):
    item = " ".join(WORDS[:12])
    df = spark.createDataFrame([(1, f"a line that is here\n{' '.join(WORDS)} more", "p", 5, 6, 7), (2, "A line that is here", "q", None, 6, 7), (3, None, None, 5, 6, 7)], "doc_id long, text string, r1 string, r2 int, row int, left int")
    got = {r.doc_id: tuple(r) for r in line_dedup.dedup_lines(df).collect()}
    assert got[1][2:] == ("p", 5, 6, 7) and got[3] == (3, None, None, 5, 6, 7) and 2 not in got
    assert {r.doc_id: (r.r1, r.row, len(r.gone)) for r in line_dedup.mark_lines(df).collect()} == {1: ("p", 6, 0), 2: ("q", 6, 1), 3: (None, 6, 0)}
    odd = df.toDF("doc_id", "text", "spans", "n_words", "items", "n_hit")
    got = {r.doc_id: tuple(r) for r in decontaminate.remove_spans(odd, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got[1][2:] == ("p", 5, 6, 7) and item not in got[1][1] and got[2][1:3] == ("A line that is here", "q") and got[3] == (3, None, None, 5, 6, 7)


# ---- sharding ----------------------------------------------------------------------------


def test_best_fit_decreasing_matches_plain_loop():
    rng = random.Random(2)
    for _ in range(30):
        sizes = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 60))]
        bins = []
        for s in sorted(sizes, reverse=True):
            fits = [(room, k) for k, room in enumerate(bins) if room >= s]
            if fits:
                bins[min(fits)[1]] -= s
            else:
                bins.append(50 - s)
        counted = sorted((s, sizes.count(s)) for s in set(sizes))
        runs, used = sharding.best_fit_decreasing(counted, 50)
        assert used == len(bins) and sum(k for *_, k in runs) == len(sizes)
        load = [0] * used
        for s, b, k in runs:
            load[b] += s * k
        assert sorted(50 - x for x in load) == sorted(bins)
    assert sharding.best_fit_decreasing([(51, 1)], 50) is None


def test_shards(spark):
    rows = [r for r in fixture() if len(r[1] or "") < 9000] + [(1000 + i, f"text {i} " * (i % 17 + 1)) for i in range(600)] + [(5000 + i, "the same hot text" * 9) for i in range(400)]
    got = sharding.pack_shards(frame(spark, rows), 8).collect()
    assert len(got) == len(rows)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.size, r.text_crc32) for r in got) == sorted(((i is None, i or 0), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert all(0 <= s < 8 for s in by) and all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
    loads = [sum(r.size for r in own) for own in by.values()]
    assert len(loads) == 8 and max(loads) <= 1.05 * sum(loads) / 8 + 8
    texts = dict(rows)
    where = {}
    for r in got:
        if r.doc_id is not None and not 5000 <= r.doc_id:
            where.setdefault(texts[r.doc_id] or "", set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    assert sharding.pack_shards(empty(spark)).count() == 0


# ---- search ------------------------------------------------------------------------------


def test_top_k_matches_brute_force(spark):
    rows = [(i, t) for i, t in fixture(3) if i is not None]
    docs = [(i, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))) for i, t in rows]
    docs = [d for d in docs if d[1]]
    n, mean = len(docs), sum(len(w) for _, w in docs) / len(docs)
    df = {}
    for _, w in docs:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    want = set()
    for q, t in rows:
        if q % 7:
            continue
        terms = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t)))
        scored = []
        for i, w in docs:
            s = sum(np.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in terms if x in df)
            if s > 0:
                scored.append((-round(float(s), 5), i))
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:6])}
    frame_ = frame(spark, rows)
    got = {(r.query_id, r["rank"], r.doc_id, r.score) for r in bm25.top_k(frame_, frame_.where("doc_id % 7 = 0"), 6).collect()}
    score = {(a, b): s for a, b, _, s in want}
    assert {(a, b) for a, b, *_ in got} == set(score) and all(abs(s - score[a, b]) < 1e-4 for a, b, _, s in got)
    assert bm25.top_k(empty(spark), frame_).count() == 0 and bm25.top_k(frame_, empty(spark)).count() == 0


def test_blocks_and_postings_are_skipped(monkeypatch):
    rng = random.Random(12)
    vocabulary = [rng.getrandbits(62) for _ in range(400)]
    docs = [sorted(rng.choices(vocabulary, [1 / (k + 1) for k in range(400)], k=rng.randrange(5, 60))) for _ in range(1500)]
    docs += [docs[7] + docs[7]] * 12
    sets = [np.unique(np.array(d, np.int64), return_counts=True) for d in docs]
    lengths, n = np.array([len(d) for d in docs]), len(docs)
    index = bm25.Index(np.arange(n), [t for t, _ in sets], [c for _, c in sets], lengths).open(float(lengths.mean()))
    df = dict(zip(index.terms.tolist(), np.diff(index.start).tolist()))
    for q in (7, 8, 900):
        idf = np.array([np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) for t in sets[q][0].tolist()])
        weight = dict(zip(sets[q][0].tolist(), idf))
        score = [sum(weight.get(t, 0) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * m / lengths.mean())) for t, c in zip(a.tolist(), b.tolist())) for (a, b), m in zip(sets, lengths)]
        want = sorted(((round(float(s), 6), i) for i, s in enumerate(score) if s > 0), key=lambda x: (-x[0], x[1]))[:10]
        for floor in (0.0, want[-1][0]):
            assert index.search(sets[q][0], idf, 10, floor) == want
    assert index.skipped > 0 and index.read > 0


def test_many_queries_at_once_find_the_same(monkeypatch):
    rng = random.Random(13)
    vocabulary = [rng.getrandbits(62) for _ in range(400)]
    docs = [rng.choices(vocabulary, [1 / (k + 1) for k in range(400)], k=rng.randrange(5, 60)) for _ in range(700)]
    docs += [docs[7] + docs[7]] * 12 + [[rng.getrandbits(62)] * 3]
    sets = [np.unique(np.array(d, np.int64), return_counts=True) for d in docs]
    lengths, n = np.array([len(d) for d in docs]), len(docs)
    index = bm25.Index(np.arange(n), [t for t, _ in sets], [c for _, c in sets], lengths).open(float(lengths.mean()))
    asked = [t for t, _ in sets[::9]] + [sets[-1][0], np.array([5, 6], np.int64)]
    terms, own = np.unique(np.concatenate(asked), return_inverse=True)
    idf = np.array([np.log1p((n - df + 0.5) / (df + 0.5)) for df in (sum(t in set(x.tolist()) for x, _ in sets) for t in terms.tolist())])
    bounds = np.cumsum([0, *map(len, asked)])
    want = [index.search(terms[own[a:b]], idf[own[a:b]], 10) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert len(want[-2]) == 1 and not want[-1]
    for batch, part, dense in ((256, 8, 0.05), (7, 3, 0.0), (5, 2, 2.0)):
        for name, x in (("BATCH", batch), ("PART", part), ("DENSE", dense)):
            monkeypatch.setattr(bm25, name, x)
        for floor in (np.zeros(len(asked)), np.array([w[-1][0] if w else 0.0 for w in want])):
            got = dict(index.search_all(bounds, own, terms, idf, 10, floor))
            assert [got.get(i, []) for i in range(len(asked))] == want


def test_shards_return_few_rows(spark, monkeypatch):
    rng = random.Random(14)
    rows = [(i, " ".join(rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(rng.randrange(20, 60)))) for i in range(1200)]
    docs = frame(spark, rows).repartition(30).cache()
    queries = docs.where("doc_id % 30 = 0")
    want = {tuple(r) for r in bm25.top_k(docs, queries, 5).collect()}
    made, cut = {}, common.Workspace.cut

    def counted(self, df, name):
        out = cut(self, df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(common.Workspace, "cut", counted)
    monkeypatch.setattr(bm25, "SHARD", 20)
    assert {tuple(r) for r in bm25.top_k(docs, queries, 5).collect()} == want
    # 1, 3, 12 and 14 shards in turn
    assert made["index"] == 30 and sum(n for name, n in made.items() if name.startswith("found")) < 10 * 5 * 40


# ---- decontamination ---------------------------------------------------------------------


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_benchmark_spans(spark, block_bytes):
    rng = random.Random(9)
    items = [(k, prose(rng, rng.choice([3, 9, 10, 14, 30]))) for k in range(12)] + [(12, None), (13, ""), (14, "..."), (2, "solo")]
    rows = [(i, f"{prose(rng, 5)} {t}") for i, (_, t) in enumerate(items)] + [(50, items[4][1].upper() + "! " + items[5][1]), (51, None), (52, ""), (53, " ".join(items[6][1].split()[:9])), (54, prose(rng, 3000) + " " + items[7][1])]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = {}
    for k, t in items:
        w = split(t)
        for p in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[p : p + min(10, len(w))]), set()).add(str(k))
    want = {}
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[p : p + size]))) is not None:
                    hit |= set(range(p, p + size))
                    found |= own
        want[i] = (len(w), len(hit), sorted(found))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.benchmark_spans(df, bench, block_bytes=block_bytes).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == want and len(got) == len(rows)
    assert decontaminate.benchmark_spans(df, bench.limit(0)).where("n_hit = 0").count() == len(rows)
    assert decontaminate.benchmark_spans(empty(spark), bench).count() == 0


def test_remove_spans(spark):
    item = " ".join(WORDS[:12])
    df = spark.createDataFrame([(1, f"{' '.join(WORDS[13:])} and, {item}. after"), (2, item), (3, None), (4, "clean text")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.remove_spans(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: f"{' '.join(WORDS[13:])} and, . after", 3: None, 4: "clean text"}


# ---- classifiers -------------------------------------------------------------------------


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def auc(pairs):
    good, bad = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / max(1, len(good) * len(bad))


@pytest.mark.parametrize("query,label,least", [(toxicity.op1_toxicity, "toxic", 0.85), (quality.op2_quality_classifier, "quality", 0.85)])
def test_classifiers_on_held_out_rows(spark, query, label, least):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = query(spark, d).collect()
    assert all(0 <= r.score <= 1 and r.held_out == held(r.doc_id) for r in got)
    assert auc([(r.score, labels[r.doc_id]) for r in got if r.held_out and labels.get(r.doc_id) in (0, 1)]) >= least


@pytest.mark.parametrize("module,fit,score", [(toxicity, "fit_toxicity", "score_toxicity"), (quality, "fit_quality", "score_quality")])
def test_classifiers_take_odd_tables(spark, module, fit, score):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in fixture()], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    model = getattr(module, fit)(spark, docs, labels)
    assert getattr(module, score)(docs, model).where("score between 0 and 1").count() == docs.count()
    assert getattr(module, score)(docs.limit(0), model).count() == 0


def test_long_tokens_are_decoded(spark):
    docs = spark.createDataFrame([("the stone river is a stupid idiot " * 50,)], "text string")
    restorer = toxicity.Restorer(toxicity.Decoder(toxicity.fit_characters(docs)))
    for n in (150, 250, 20_000):
        assert restorer.token(("st" + "u" * n + "p1d").encode()) == ("stupid",)
    assert restorer.token("1d10t".replace("d", "d" + "." * 300).encode()) == ("idiot",)


def test_network_in_blocks_matches_a_plain_forward_pass():
    rng = np.random.default_rng(3)
    f = quality.FILTERS
    net = quality.ByteNet(rng.normal(size=(quality.WIDTH, 256, f)).astype(np.float32), rng.normal(size=(quality.SPAN + 1, f)).astype(np.float32), rng.normal(size=f).astype(np.float32), 0.1)
    texts = [b"", b"short", bytes(rng.integers(97, 101, 255, dtype=np.uint8)), bytes(rng.integers(97, 122, 1900, dtype=np.uint8)), b"abcabcabc " * 90]

    def plain(text):
        n = -(-(len(text) + quality.GAP) // quality.BLOCK)
        data = text.ljust(n * quality.BLOCK, b"\0") + bytes(64)
        places = []
        for at in range(0, n * quality.BLOCK, quality.STRIDE):
            pair = lambda p: data[p : p + 2] if p >= 0 else bytes(2)[: 2 + min(0, p + 2)] + data[: max(0, p + 2)] if p > -2 else b"\0\0"
            best = 0 if data[at : at + 2] == b"\0\0" else max(sum(pair(at + 2 * k) == pair(at + 2 * k - lag) for k in range(quality.SPAN)) for lag in quality.LAGS)
            places.append(sum(net.bytes[j][data[at + j]] for j in range(quality.WIDTH)) + net.repeats[best])
        per = quality.BLOCK // quality.STRIDE
        chunks = [places] if n == 1 else [places[k * per : (k + 2) * per] for k in range(n - 1)]
        return np.mean([np.tanh(np.max(c, 0)) @ net.out + net.bias for c in chunks])

    raw, at = b"".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = net.logits(*quality.blocks_of(raw, at))
    assert np.allclose(got, [plain(t) for t in texts], atol=1e-3)


def test_spaced_words_of_any_letters_and_runs_of_any_length(spark):
    docs = spark.createDataFrame([("the stone river is a stupid idiot dümmling " * 50,)], "text string")
    restorer = toxicity.Restorer(toxicity.Decoder(toxicity.fit_characters(docs)))
    words = lambda text: [w for got in restorer.words(text.encode()) for w in got]
    assert "dümmling" in words("the " + " ".join("dümmling") + " river")
    for n in range(1, 60):
        # a run of single characters in which the word lies at all places
        assert any("idiot" in w for w in words(" ".join("stone" * n + "idiot" + "river" * 9))), n


def test_decoder_restores_disguises(spark):
    docs = spark.createDataFrame([("the stone river is a stupid idiot " * 50,)], "text string")
    decoder = toxicity.Decoder(toxicity.fit_characters(docs))
    assert decoder.restore("st0n3") == "stone" and decoder.restore("i d i o t") == "idiot" and decoder.restore("stuuuuupid") == "stupid"


def brute_viterbi(decoder, token):
    best = [(0.0, "", 0, 0)]
    for options in [*decoder.readings(token), [("\0\0", 0.0)]]:
        new = []
        for score, text, a, b in best:
            for read, cost in options:
                x, y, total = a, b, score + cost
                for ch in read:
                    k = toxicity._symbol(ch)
                    total, x, y = total + decoder.logp[x][y][k], y, k
                new.append((total, text + read, x, y))
        best = new
    return max(s for s, *_ in best)


def test_decoder_is_the_best_of_all_readings(spark):
    docs = spark.createDataFrame([("a tall silly goose sits in a boat " * 9,)], "text string")
    decoder = toxicity.Decoder(toxicity.fit_characters(docs))
    for token in ("g00se", "s1lly", "b0@t", "t@1l", "$!t$"):
        assert any(abs(brute_viterbi(decoder, token) - s) < 1e-6 for s in [_score(decoder, token, decoder.restore(token))])


def _score(decoder, token, want):
    best = [(0.0, "", 0, 0)]
    for options in [*decoder.readings(token), [("\0\0", 0.0)]]:
        best = [(s + c + sum(decoder.logp[([0, 0] + [a, b] + list(map(toxicity._symbol, r)))[2 + i]][([a, b] + list(map(toxicity._symbol, r)))[1 + i]][toxicity._symbol(ch)] for i, ch in enumerate(r)), t + r, *([a, b] + list(map(toxicity._symbol, r)))[-2:]) for s, t, a, b in best for r, c in options]
    return max(s for s, t, *_ in best if t.rstrip("\0") == want)


# ---- tokens and pieces -------------------------------------------------------------------


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, rule):
    ranks = token_counts.load_ranks(token_counts.VOCABULARY)
    rows = [(1, "one line\nanother   \n\n\nlast"), (2, None), (3, ""), (4, "\n"), (5, "東京\nzażółć"), (6, "a b " * 3000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int")
    import tiktoken

    plain = tiktoken.Encoding("x", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in token_counts.count_tokens(df, ranks, rule).collect():
        ids = plain.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids) and abs(sum(r.section_tokens) - len(ids)) < 1e-9
        assert plain.decode(ids) == (r.text or "")
        assert r.n_sections == len((r.text or "").splitlines()) or r.doc_id == 1
    with pytest.raises(ValueError):
        token_counts.count_tokens(df, ranks, "other")


def test_allocation_rules():
    bounds, cuts = np.array([0, 2, 7, 9]), np.array([0, 4, 9])
    assert token_counts.allocate(bounds, cuts, "start")[0].tolist() == [2, 1]
    assert token_counts.allocate(bounds, cuts, "majority")[0].tolist() == [1, 2]
    assert token_counts.allocate(bounds, cuts, "split")[0].tolist() == [1.4, 1.6]


def all_paths(p, s, at=0):
    lattice = p.lattice(s)

    def go(a):
        if a == len(s):
            yield 0.0
        else:
            for b, score, _ in lattice[a]:
                for rest in go(b):
                    yield score + rest

    return sorted(go(0), reverse=True)


def test_n_best_is_exact():
    p = pieces.Pieces(pieces.load_pieces(pieces.MODEL))
    for s in ("▁stone", "▁the", "▁żółw", "ab▁", "東"):
        want = all_paths(p, s)[:4]
        assert np.allclose([x for x, _ in p.nbest(s, 4)], want)
    for text in ("the stone river", "a  b", "x\ny z", "東京 ok", " lead"):
        whole = (" " + text).replace(" ", "▁")
        ids, scores = p.encode(text, 3)
        assert np.allclose(scores, [x for x, _ in p.nbest(whole, 3)])
        assert p.decode(ids) == text


def test_words_are_ranked_once_in_bounded_tables(monkeypatch):
    monkeypatch.setattr(pieces, "RANKED", 3)
    monkeypatch.setattr(pieces, "SIDE", 2)
    table = pieces.load_pieces(pieces.MODEL)
    p, asked = pieces.Pieces(table), []
    search = p.nbest
    monkeypatch.setattr(p, "nbest", lambda s, n: asked.append(s) or search(s, n))
    names = p.words("the stone river willow yarrow")
    p.learn([names])
    first = p.segmentations(names, 3)
    assert len(asked) == 2
    again = p.segmentations(names, 3)
    assert len(asked) == 2 and again[1] == first[1] and all((x == y).all() for x, y in zip(first[0], again[0], strict=True))
    for w in (*WORDS, "żółw", "東京 ok", *WORDS):
        names = p.words(f"the {w} river")
        p.learn([names])
        ids, scores = p.segmentations(names, 3)
        want = search((f" the {w} river").replace(" ", "▁"), 3)
        assert np.allclose(scores, [x for x, _ in want]) and all(p.decode(x) == f"the {w} river" for x in ids)
        assert len(p.ranked) <= 3 and len(p.ranked_before) <= 3


def test_n_best_ids_are_returned(spark):
    import hashlib

    table = pieces.load_pieces(pieces.MODEL)
    p = pieces.Pieces(table)
    texts = ["the stone river", "a  b", "x\ny z", "東京 ok", " lead", "willow yarrow zephyr the", "", None]
    df = frame(spark, list(enumerate(texts)))
    digests = {r.doc_id: r for r in pieces.piece_digest(df, table).collect()}
    for r in pieces.encode_pieces(df, table).collect():
        best = [np.array(x, "<u4") for x in r.n_best_ids]
        assert r.n_best_ids[0] == r.piece_ids and len(best) == len(r.n_best_scores) == len(set(map(tuple, r.n_best_ids)))
        assert all(p.decode(x) == (r.text or "") for x in best)
        assert digests[r.doc_id].n_best_sha256 == [hashlib.sha256(x.tobytes()).hexdigest() for x in best]
        if r.text:
            score = {i: x for i, (_, x, _) in enumerate(table)}
            whole = p.nbest((" " + r.text).replace(" ", "▁"), 3)
            assert np.allclose(r.n_best_scores, [x for x, _ in whole])
            if r.text.isascii() and "\n" not in r.text:
                assert np.allclose([sum(score[i] for i in x) for x in r.n_best_ids], r.n_best_scores)


def test_pieces_round_trip(spark):
    table = pieces.load_pieces(pieces.MODEL)
    df = frame(spark, fixture())
    got = pieces.encode_pieces(df, table).collect()
    assert len(got) == df.count() and all(r.decoded == (r.text or "") for r in got)
    assert all(r.n_best_scores == sorted(r.n_best_scores, reverse=True) for r in got)
    assert pieces.piece_digest(df, table).where("round_trip or doc_id is null or n_pieces = 0").count() == len(got)
    assert pieces.encode_pieces(empty(spark), table).count() == 0


# ---- url filters -------------------------------------------------------------------------


def test_urls(spark):
    urls = ["http://Example.org/es/a?x=1", "https://a.b.example.org/en/12#f", "ftp://notexample.org/es/", "x://com/fr/", "x://shop.com/de/q", "x://com?/de/", "no scheme", "", None, "a://b://c/d", "http://münchen.org/ß", "http://org", "http://org/" + "y" * 5000, "://com/de/"]

    def judge(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = lowered(re.match(r"[^/?#]*", rest)[0])
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = url_filter.filter_urls(df, url_filter.RULES).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [judge(u) for u in urls]
    assert url_filter.filter_urls(df.limit(0), url_filter.RULES).count() == 0
    assert url_filter.filter_urls(df, []).where("verdict = 'allow' and rule is null").count() == len(urls)


def test_glob_automaton_spans_words():
    import fnmatch

    rng = random.Random(4)
    globs = ["".join(rng.choice("ab?*") for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 14))) for _ in range(200)]
    automaton = url_filter.GlobAutomaton([[x if x in "?*" else ord(x) for x in g] for g in globs])
    assert automaton.words > 1
    got = automaton.match([np.array(list(map(ord, t)), np.int64) for t in texts])
    assert got.tolist() == [[fnmatch.fnmatchcase(t, g) for g in globs] for t in texts]
