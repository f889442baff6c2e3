import random

import pytest

from corvath.llm import splitting

LIMITS = [("small", 100, 15), ("large", 400, 40)]


def make_text(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(["word ", "é🙂 ", "line\n", "End. ", "\n\n", "x" * 30]) for _ in range(n))


@pytest.mark.parametrize("range_bytes, block_chars", [(64, 500), (1000, 500), (65536, 1 << 24)])
def test_pieces_cover_overlap_and_fit(spark, range_bytes, block_chars):
    texts = {"a": make_text(1, 300), "b": make_text(2, 40), "c": "z" * 950, "d": "", "e": None, "f": "k" * 100, "g": "k" * 101}
    df = spark.createDataFrame([(k, v, "clash") for k, v in texts.items()] + [("a", texts["a"], "clash")], "id string, text string, content string")
    got = splitting.pieces(df, "id", "text", LIMITS, range_bytes, block_chars).collect()
    for name, size, overlap in LIMITS:
        found = {r.record_id for r in got if r.limit_name == name}
        assert found == {k for k, v in texts.items() if v and len(v) > size}
        for k in found:
            text, own = texts[k], sorted((r for r in got if r.limit_name == name and r.record_id == k), key=lambda r: r.piece_no)
            assert [r.piece_no for r in own] == list(range(len(own)))
            assert own[0].char_start == 0 and own[-1].char_end == len(text)
            for r in own:
                assert 0 < r.char_end - r.char_start <= size
                assert r.line_start == 1 + text.count("\n", 0, r.char_start)
                assert r.line_end == 1 + text.count("\n", 0, r.char_end)
            for a, b in zip(own, own[1:]):
                assert b.char_start == max(0, a.char_end - overlap)


def test_content_natural_boundaries_and_carried_columns(spark):
    text = ("First sentence here. " * 8 + "\n\n") * 12
    df = spark.createDataFrame([("a", text, [1, 2])], "id string, text string, pages array<int>")
    got = sorted(splitting.split_records(df, "id", "text", LIMITS, "pages").where("limit_name = 'large'").collect(), key=lambda r: r.piece_no)
    assert all(r.content == text[r.char_start : r.char_end] for r in got)
    assert {r.boundary for r in got[:-1]} <= {"paragraph", "sentence"}
    assert got[0].pages == [1, 2]


def test_ranges_dont_matter(spark):
    df = spark.createDataFrame([("a", make_text(3, 900)), ("b", "漢é🙂x" * 300), (None, make_text(6, 90)), (None, make_text(7, 90))], "id string, text string")
    got = [sorted((r.record_id or "", r.limit_name, r.piece_no, r.char_start, r.char_end, r.line_start, r.boundary) for r in splitting.pieces(df, "id", "text", LIMITS, n, 2000).collect()) for n in (50, 333, 65536)]
    assert got[0] == got[1] == got[2] and sum(r[0] == "" and r[2] == 0 and r[1] == "small" for r in got[0]) == 2


def test_no_cut_inside_a_word_where_there_is_a_boundary(spark):
    rng = random.Random(8)
    for text in ("x" * 90 + " " + "y" * 95 + "\n\n" + "z" * 70 + " " + "w" * 99, "".join(rng.choice(["a" * 60, " ", "b" * 35 + "\n", "c" * 20]) for _ in range(200))):
        own = sorted(splitting.pieces(spark.createDataFrame([("a", text)], "id string, text string"), "id", "text", [("s", 100, 10)], 64).collect(), key=lambda r: r.piece_no)
        cut = 0
        for r in own[:-1]:
            if r.boundary == "none":
                assert not any(c.isspace() for c in text[cut : r.char_start + 99])
            cut = r.char_end


def test_content_of_small_ranges(spark):
    text = make_text(9, 700)
    df = spark.createDataFrame([("a", text), ("a", text)], "id string, text string")
    got = splitting.split_records(df, "id", "text", LIMITS, range_bytes=16, block_chars=1500).collect()
    assert len(got) == splitting.pieces(df, "id", "text", LIMITS, block_chars=1500).count() and all(r.content == text[r.char_start : r.char_end] for r in got)


def test_limits_are_checked(spark):
    table = spark.createDataFrame([("x", "f", "char", 10, 10)], "limit_name string, field_name string, unit string, max_size int, overlap int")
    with pytest.raises(ValueError):
        splitting.limits_of(table, "f")
    assert splitting.limits_of(table, "other") == []
    assert splitting.pieces(spark.createDataFrame([("a", "t" * 50)], "id string, text string"), "id", "text", []).count() == 0


def test_halos_decide_at_the_edges_of_ranges(spark, monkeypatch):
    df = spark.createDataFrame([("a", make_text(12, 900))], "id string, text string")
    places = lambda n: sorted((r.limit_name, r.char_start, r.char_end, r.boundary) for r in splitting.pieces(df, "id", "text", LIMITS, n).collect())
    whole = places(65536)
    assert places(32) == whole
    monkeypatch.setattr(splitting, "HALO", 0)
    assert places(32) != whole
