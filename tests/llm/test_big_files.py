import random

import pytest

from corvath.llm import big_files, splitting

from .test_splitting import make_text


@pytest.mark.parametrize("range_bytes", [700, 5000, 1 << 20])
def test_same_pieces_as_of_a_row(spark, tmp_path, range_bytes):
    texts = {"a": make_text(4, 900), "b": "é漢🙂" * 900, "c": "short\n", "d": ""}
    for k, t in texts.items():
        (tmp_path / k).write_text(t, encoding="utf-8", newline="")
    got = big_files.split_files(spark, [str(tmp_path / k) for k in texts], 200, 30, range_bytes).collect()
    rows = spark.createDataFrame(list(texts.items()), "id string, text string")
    of_rows = {(r.record_id, r.piece_no): (r.char_start, r.char_end, r.line_start, r.boundary) for r in splitting.pieces(rows, "id", "text", [("x", 200, 30)]).collect()}
    of_files = {(r.path[-1], r.piece_no): (r.char_start, r.char_end, r.line_start, r.boundary) for r in got if r.path[-1] in "ab"}
    assert of_files == of_rows
    assert all(r.content == texts[r.path[-1]][r.char_start : r.char_end] for r in got)
    assert [(r.piece_no, r.content) for r in got if r.path[-1] == "c"] == [(0, "short\n")] and not [r for r in got if r.path[-1] == "d"]


def test_limits(spark, tmp_path):
    with pytest.raises(ValueError):
        big_files.split_files(spark, [], 10, 10)
