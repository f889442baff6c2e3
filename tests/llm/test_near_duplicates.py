import os
import random
import time

from corvath.llm import near_duplicates as nd


def brute(docs, threshold, size):
    sets = {}
    for i, t in docs:
        if i is not None and t is not None:
            w = nd.words_of(t)
            if len(w) >= size:
                sets[i] = set(zip(*[w[k:] for k in range(size)]))
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if nd.similarity(sets[a], sets[b]) >= threshold}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 300))]
        for c in range(rng.choice([1, 1, 2, 5])):
            own = list(base)
            for _ in range(int(len(own) * rng.choice([0, 0.01, 0.03, 0.1, 0.3]))):
                own[rng.randrange(len(own))] = rng.choice(words)
            docs.append((f"d{g:02d}-{c}", " ".join(own)))
    return docs


def test_all_pairs_of_brute_force(spark, monkeypatch):
    docs = corpus(3) + [("n", None), ("e", ""), ("two", "a b"), ("sp", " A  b\tC \n"), ("eq", "a b c"), (None, "a b c"), ("eq", "a b c")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "id string, raw_content string, keys int")
    expected = brute(docs, 0.6, 3)
    assert ("eq", "sp") in expected
    for salt, rows in ((512, 1000), (3, 0)):  # salted or not, broadcasts or joins
        monkeypatch.setattr(nd, "SALT_ROWS", salt)
        monkeypatch.setattr(nd, "BROADCAST_ROWS", rows)
        members, links = nd.near_duplicates(df, threshold=0.6, shingle=3)
        got = [tuple(r) for r in nd.all_pairs(members, links).collect()]
        assert len(got) == len(set(got)) and set(got) <= expected
        assert len(set(got)) >= 0.98 * len(expected)
    groups = {r.id: r for r in nd.groups(members, links).collect()}
    assert all(groups[a].group_id == groups[b].group_id for a, b in got)
    assert "n" not in groups and "two" not in groups and groups["eq"].class_id == "eq"


def test_pairs_that_eight_words_miss(spark):
    rng, docs, eight = random.Random(8), [], lambda t: set(nd.anchors_of(nd.min_hashes(nd.shingle_hashes(t.split(), 3))).tolist())
    while len(docs) < 8:
        a = [f"v{rng.randrange(10**6)}" for _ in range(120)]
        b = list(a)
        for at in rng.sample(range(2, 118, 4), 8):
            b[at] = f"u{rng.randrange(10**6)}"
        x, y = " ".join(a), " ".join(b)
        if not eight(x) & eight(y):
            docs += [(f"{len(docs)}", x), (f"{len(docs) + 1}", y)]
    expected = brute(docs, 0.6, 3)
    assert len(expected) == 4
    members, links = nd.near_duplicates(spark.createDataFrame(docs, "id string, raw_content string"), threshold=0.6, shingle=3)
    assert {tuple(r) for r in nd.all_pairs(members, links).collect()} == expected


def test_what_a_site_repeats_makes_no_candidates(spark, monkeypatch):
    rng, wrote, cut = random.Random(5), [], nd.cut_lineage
    shared = " ".join(f"s{i}" for i in range(40))
    docs = [(f"d{i:02d}", shared + " " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(60))) for i in range(40)]
    docs += [("e0", docs[0][1] + " more words"), ("e1", docs[1][1] + " other words")]
    monkeypatch.setattr(nd, "cut_lineage", lambda df: wrote.append(cut(df)) or wrote[-1])
    members, links = nd.near_duplicates(spark.createDataFrame(docs, "id string, raw_content string"), threshold=0.6, shingle=3)
    assert {tuple(r) for r in nd.all_pairs(members, links).collect()} == brute(docs, 0.6, 3) == {("d00", "e0"), ("d01", "e1")}
    assert [df.count() < 10 for df in wrote if df.columns == ["num_x", "num_y"]] == [True]


def test_sketches_keep_pairs_at_the_threshold(spark):
    rng, rows = random.Random(6), []
    for n in (3, 5, 8, 20, 60, 150, 400, 1500):
        for _ in range(25):
            common = -(-6 * n // 10)
            both, own = rng.sample(range(2**62), common), [rng.sample(range(2**62), k) for k in ((n - common) // 2, n - common - (n - common) // 2)]
            pair = [nd.np.unique(nd.np.array(both + o, dtype=nd.np.uint64) * nd.np.uint64(0xD6E8FEB86659FD93)) for o in own]
            rows.append([v for h in pair for sketch, filled in [nd.sketch_of(h)] for v in (len(h), filled, *sketch.tolist())])
    names = [f"{c}{v}" for c in "xy" for v in ("size", "filled", *nd._SKETCH)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} bigint" for n in names))
    both = df.select(*[nd.F.struct(*[nd.F.col(c + v).alias(v) for v in ("size", "filled", *nd._SKETCH)]).alias(c) for c in "xy"])
    assert both.where(nd.may_be_near(0.6)).count() == len(rows)


def test_shuffles_of_a_step_are_removed(spark):
    rng = random.Random(7)
    docs = [(f"{i}", " ".join(f"v{rng.randrange(10**6)}" for _ in range(20))) for i in range(800)]
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())

    def files():
        return {p: os.path.getsize(p) for d in dirs for at, _, names in os.walk(d.getPath()) for n in names if n.startswith("shuffle_") and os.path.exists(p := os.path.join(at, n))}

    before, end = files(), time.time() + 20
    kept = nd.near_duplicates(spark.createDataFrame(docs, "id string, raw_content string"), threshold=0.6, shingle=3)
    while (left := sum(n for p, n in files().items() if p not in before)) > 50_000 and time.time() < end:
        time.sleep(0.5)
    assert left <= 50_000 and kept[0].count() == 800


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}", 1.0) for i in range(60)] + [("x", "y", 1.0)], "x string, y string, similarity double")
    got = {r.rep: r.label for r in nd.components(links).collect()}
    assert got["060"] == "000" and got["y"] == "x"


def test_empty(spark):
    members, links = nd.near_duplicates(spark.createDataFrame([], "id string, raw_content string"))
    assert members.count() == 0 and links.count() == 0
    assert nd.groups(members, links).count() == 0


def test_fingerprints_that_differ_in_one_symbol_share_an_anchor():
    import numpy as np

    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 64).astype(np.uint64)
    b = a.copy()
    b[[2, 5, 11]] += np.uint64(7)
    shared = [len(set(x) & set(y)) for x, y in zip(nd.anchors_of(a).reshape(8, 4).tolist(), nd.anchors_of(b).reshape(8, 4).tolist())]
    assert shared == [1, 1, 1, 4, 4, 4, 4, 4]
    b[3] += np.uint64(9)
    assert not set(nd.anchors_of(a)[:4].tolist()) & set(nd.anchors_of(b)[:4].tolist())
