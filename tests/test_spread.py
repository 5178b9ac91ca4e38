"""Steps that make many rows out of few: whole results, dealt over tasks."""

from pyspark.sql import functions as F

from loomlake.operators import resolution, spread


def test_names_are_scored_once_for_each_two_classes(spark, monkeypatch):
    monkeypatch.setattr(spread, "CLASS", 4)
    rows = [(i, "xy"[i % 7 == 0], ["red ring", "red rod", None][i % 3]) for i in range(60)] + [(60, None, "red rod")]
    df = spark.createDataFrame(rows, "id long, block string, name string")
    scored = spark.sparkContext.accumulator(0)
    def count(x):
        scored.add(1)
        return x
    out = resolution.name_pairs(df, ["block"], lambda x, y: [F.udf(count)(F.concat_ws("|", x, y)).alias("both")])
    got = sorted(tuple(r) for r in out.collect())
    text = lambda *names: "|".join(n for n in names if n is not None)
    want = sorted((a, b, text(x, y)) for a, s, x in rows for b, t, y in rows if a < b and s == t and s)
    assert got == want and scored.value < len(want)
    assert out.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_carried_columns_come_with_each_row_of_a_class(spark, monkeypatch):
    monkeypatch.setattr(spread, "CLASS", 3)
    rows = [(i, "x", "n", f"t{i % 4}" if i % 4 else None) for i in range(20)]
    got = resolution.name_pairs(spark.createDataFrame(rows, "id long, block string, name string, type string"), ["block"], lambda x, y: [(x == y).alias("same")], ("type",))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((a[0], b[0], True, a[3], b[3])) for a in rows for b in rows if a[0] < b[0])


def test_resolution_finds_a_name_once_for_all_its_rows(spark):
    names = ["Red Ring", "the red ring", "red rings", "blue bolt", "old gear"]
    new = spark.createDataFrame([(i, names[i % 5], "t") for i in range(300)], "id long, name string, type string")
    known = spark.createDataFrame([(900 - i, ["red ring", "red rod", "blue bolts"][i % 3], "t", ["old GEAR"] if i % 50 == 1 else []) for i in range(300)], "id long, name string, type string, aliases array<string>")
    out = resolution.resolve(new, known, 0.7)
    got = {r.id: (r.entity, r.kind, round(r.score, 3)) for r in out.collect()}
    assert len(got) == 300 and all(got[i] == got[i % 5] for i in got)
    assert got[0] == (603, "exact", 1.0) and got[4] == (649, "alias", 1.0) and got[1][:2] == (603, "fuzzy") and got[3][:2] == (601, "fuzzy")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "(type" in plan and not any("Join Inner" in x and "key" in x and "_deal" not in x for x in plan.splitlines())


def test_near_pairs_meet_in_blocks_and_come_once(spark, monkeypatch):
    import random

    from loomlake.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK", 7)
    dice = random.Random(3)
    rows = [(f"r{i}", [f"k{dice.randrange(3)}", f"m{dice.randrange(4)}", None], [dice.uniform(-1, 1) for _ in range(2 + (i % 9 == 0))]) for i in range(90)]
    rows += [("zero", ["k1"], [0.0, 0.0]), ("none", ["k1"], None), ("null", ["k1"], [1.0, None]), ("no keys", [], [1.0, 1.0]), ("least", ["k0"], [1e-3, 1e-3])]
    df = spark.createDataFrame(rows, "id string, keys array<string>, embedding array<double>")

    def want(unit, threshold):
        out = {}
        for a, ka, ea in rows:
            for b, kb, eb in rows:
                if a < b and set(ka) & set(kb) - {None} and ea and eb and len(ea) == len(eb) and None not in ea + eb:
                    n = (sum(x * x for x in ea) * sum(x * x for x in eb)) ** 0.5 if unit else 1.0
                    out[a, b] = sum(x * y for x, y in zip(ea, eb)) / n if n else 0.0
        return {k: round(v, 9) for k, v in out.items() if v >= threshold}

    for unit in (True, False):
        out = vectors.near_pairs(df, 0.4, unit)
        got = [((r.a, r.b), round(r.score, 9)) for r in out.collect()]
        assert len(got) == len(dict(got)) and dict(got) == want(unit, 0.4)
        assert "Join Inner" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and plan.count("Join Inner") == 1  # of the sizes alone


def test_conflicts_are_found_without_joining_all_with_all(spark):
    import random
    from datetime import datetime, timedelta

    from loomlake.operators import relations

    dice, day = random.Random(5), lambda k: None if k is None else datetime(2020, 1, 1) + timedelta(days=k)
    kind = "id long, src long, dst long, type string, valid_from timestamp_ntz, valid_until timestamp_ntz"
    make = lambda ids: [(i, dice.choice([1, 2, None]), 1, "t", day(f := dice.choice([*range(12), None])), day(dice.choice([None, None, (f or 0) + dice.randrange(-2, 6)]))) for i in ids]
    stored, new = make(range(80)), make([dice.randrange(120) for _ in range(60)])
    far = datetime(9999, 12, 31)
    want = {}
    for i, s, d, t, f, u in stored:
        hits = [nf for ni, ns, nd, nt, nf, nu in new if s and (s, d, t) == (ns, nd, nt) and f and nf and f < (nu or far) and (u or far) > nf and i != ni and f <= nf]
        want[i] = (min([x for x in (u, min(hits, default=None)) if x], default=None), bool(hits))
    out = relations.invalidate_conflicts(spark.createDataFrame(stored, kind), spark.createDataFrame(new, kind))
    assert {r.id: (r.valid_until, r.invalidated) for r in out.collect()} == want and out.count() == 80
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and not any("Join Inner" in x and "<=" in x for x in plan.splitlines())


def test_a_chunks_pairs_come_without_a_join(spark):
    from loomlake.operators import graph, relations

    rows = [(e, c) for c in range(9) for e in range(c % 4, 8)] * 2 + [(None, 1), (3, None), (4, None), (3, None)]
    m = spark.createDataFrame(rows, "entity long, chunk long")
    held = {c: sorted({e for e, k in rows if k == c and e is not None}) for c in range(9)}
    plan = lambda out: out._jdf.queryExecution().optimizedPlan().toString()
    for most in (3, 50):
        first = {c: ([None] * (c == 1) + es)[:most] for c, es in held.items()}
        want = {}
        for es in first.values():
            for pair in ((a, b) for a in es for b in es if a is not None and b is not None and a < b):
                want[pair] = want.get(pair, 0) + 1
        out = graph.co_occurrence(m, 2, most)
        assert {(r.a, r.b): r.n for r in out.collect()} == {k: n for k, n in want.items() if n >= 2} and "Join" not in plan(out)
        known = spark.createDataFrame([(5, 4), (6, 7)], "src long, dst long")
        assert {tuple(r)[:2] for r in relations.associations(m, known, most).collect()} == set(want) - {(4, 5), (6, 7)}
    assert out.sparkSession.range(10).transform(lambda x: spread.wide(x, "id")).rdd.getNumPartitions() >= 12
    s = spark.createDataFrame([(c % 2, c, 1.0) for c in range(9)], "query_id long, id long, score double")
    out = relations.narrative(s, m.where("entity % 7 = 0"))
    assert {r.id: round(r.score, 2) for r in out.collect()} == {c: {0: 1.4, 1: 1.2, 2: 1.2, 3: 1.2}[min(c % 4, 1)] for c in range(9)} and plan(out).count("Join") == 2


def test_search_counts_are_those_of_search_terms(spark):
    from loomlake.functions import text

    rows = [(1, "The RUNNING runs, ran 東京都庁 and 京 darkness nesses ab abc's"), (2, None), (3, ""), (4, "running " * 5 + "of"), (1, "Running 東京")]
    df = spark.createDataFrame(rows, "id long, text string")
    want = df.select("id", F.explode(text.search_terms(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    out = text.search_counts(df, "id", "text")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and {(r.id, r.term) for r in out.collect()} >= {(1, "京都"), (1, "京"), (4, "runn")}
    assert "Generate explode(flatten" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and plan.count("Generate") == 2


def test_coherence_counts_pairs_by_patterns(spark):
    import random

    from loomlake.operators import scoring

    dice = random.Random(2)
    some = ["the", "a", "in", "of", "is", "not", "theory", "inn", "x", "The", "of,", "house"]
    texts = [dice.choice(["", " "]) + dice.choice([" ", "  ", "\t", "\n "]).join(dice.choice(some) for _ in range(dice.randrange(12))) for _ in range(200)] + ["", " ", "the of the of the of", "a b c d e the"]

    def want(t):
        w = " ".join(t.lower().split()).split(" ")
        art, prep = scoring.ARTICLES, scoring.PREPOSITIONS
        judged = [(a, b) for a, b in zip(w, w[1:]) if a in art + prep]
        good = [b for a, b in judged if b not in (art + prep + scoring.LINKING if a in art else prep)]
        return len(good) / len(judged) if len(w) >= 6 and judged else 1.0

    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scoring.coherence(F.col("t")).alias("c"))
    assert all(abs(r.c - want(r.t)) < 1e-9 for r in out.collect())
    assert "array_contains" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_rings_and_small_groups_of_keywords_come_without_a_join(spark):
    from loomlake.operators import relations

    held = {"few": [5, 2, 9], "many": [7, 1, 4, 3, 8], "one": [6]}
    k = spark.createDataFrame([(w, c, float(len(w))) for w, cs in held.items() for c in cs], "keyword string, chunk long, idf double")
    ring = sorted(held["many"])
    want = [(a, b, "few") for a in held["few"] for b in held["few"] if a != b] + [p for a, b in zip(ring, ring[1:] + ring[:1]) for p in ((a, b, "many"), (b, a, "many"))]
    out = relations.co_keyword_edges(k, 3)
    assert sorted(tuple(r)[:3] for r in out.collect()) == sorted(want) and {r.weight for r in out.collect()} == {3.0, 4.0}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
