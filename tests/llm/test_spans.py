import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corvath.llm import spans


def brute(docs, least):
    where = {}
    for d, t in docs:
        for i in range(len(t or "") - least + 1):
            where.setdefault(t[i : i + least], set()).add((d, i))
    covered = {}
    for places in where.values():
        if len({d for d, _ in places}) > 1:
            for d, i in places:
                covered.setdefault(d, set()).update(range(i, i + least))
    return covered


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé漢🙂 ") for _ in range(rng.randint(1, 9)))
    make = lambda k: " ".join(word() for _ in range(k))
    parts = [make(rng.randint(8, 60)) for _ in range(12)]
    docs = []
    for i in range(n):
        own = make(rng.randint(0, 80))
        cut = rng.choice(parts)
        a = rng.randint(0, len(cut) // 3)
        docs.append((i, own + cut[a : len(cut) - rng.randint(0, 40)] + make(rng.randint(0, 50))))
    return docs


def covered_by(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    return out


def test_equal_to_brute_force(spark):
    docs = texts(1, 60) + [(100, "z" * 900), (101, "z" * 450 + "y"), (102, None), (103, ""), (104, "short"), (105, "ab" * 300), (106, "x" + "ab" * 200)]
    docs += [(110, docs[3][1]), (111, docs[3][1]), (112, docs[3][1] + "tail")]
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs] + [(110, docs[3][1], "clash"), (None, docs[3][1], "clash")], "doc_id bigint, text string, key string")
    expected = brute(docs, 80)
    assert expected
    for limit, ids in ((16, 1000), (2, 1000), (16, 0)):  # pairs and windows, broadcasts and shuffles give the same
        found = spans.shared_spans(df, min_length=80, pair_rows=limit, broadcast_ids=ids)
        assert covered_by(found.collect()) == expected
    merged = spans.merged(found)
    assert covered_by(merged.collect()) == expected
    report = {r.doc_id: r for r in spans.shares(df, found).collect()}
    assert report[102].share == 0 and report[103].n_chars == 0 and report[110].share == 1
    assert all(report[d].shared_chars == len(v) for d, v in expected.items())


def test_empty(spark):
    assert spans.shared_spans(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab🙂", min_size=0, max_size=400), st.integers(0, 60), st.integers(0, 60))
def test_a_shared_stretch_has_a_common_indexed_anchor(common, before, after):
    if len(common) < 160:
        common += "".join(chr(0x100 + (i * i) % 97) for i in range(160))
    keys = []
    for left, right in (("p" * before, "q"), ("r" * after + "s", "t" * before)):
        start, end, key, indexed, _, _ = spans.anchors(spans.code_points(left + common + right), 80)
        keys.append((set(key.tolist()), set(key[indexed].tolist())))
    assert keys[0][0] & keys[1][1] and keys[0][1] & keys[1][0]


def test_anchors_don_t_depend_on_segments(monkeypatch):
    rng = np.random.default_rng(1)
    codes = rng.integers(97, 101, 5000).astype(np.uint32)
    whole = spans.anchors(codes, 100)
    monkeypatch.setattr(spans, "SEGMENT", 700)
    cut = spans.anchors(codes, 100)
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut))


def test_a_phrase_of_a_third_of_all_rows(spark):
    rng = random.Random(5)
    phrase = "".join(chr(rng.randint(97, 122)) for _ in range(130))
    own = lambda n: "".join(chr(rng.randint(97, 122)) for _ in range(n))
    docs = [(i, own(rng.randint(0, 90)) + (phrase[: rng.randint(70, 130)] if i % 3 == 0 else "") + own(60)) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    found = spans.shared_spans(df, min_length=80, pair_rows=8)
    assert covered_by(found.collect()) == brute(docs, 80)


def test_no_task_holds_a_hot_key(spark):
    rows = list(spans._anchor_rows(40, 8)(spark.createDataFrame([(i, "the same text of every document, " * 4) for i in range(500)], "doc_id bigint, text string").toArrow().to_batches()))
    weights = [w for b in rows for w in b.column(3).to_pylist()]
    assert sum(w <= 1 for w in weights) < 0.05 * len(weights)  # what is counted by key alone
