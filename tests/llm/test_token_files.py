"""Flat token files are read by ranges, whatever their names, and counted without an index."""

from lexspark.llm import token_counts


def test_files_are_read_by_ranges(spark, tmp_path):
    (tmp_path / "a b%20.bin").write_bytes(b"\x01\x00\x09\x00\x02\x00\x02\x00\x09\x00")
    (tmp_path / "empty.bin").write_bytes(b"")
    got = token_counts.read_blocks(spark, str(tmp_path), 4)
    assert sorted((r.block, bytes(r.ids)) for r in got.collect()) == [(0, b"\x01\x00\x09\x00"), (1, b"\x02\x00\x02\x00"), (2, b"\x09\x00")]
    assert [(r.doc, r.n_tokens) for r in token_counts.count(got, 9).orderBy("doc").collect()] == [(0, 1), (1, 2)]


def test_wide_ids(spark, tmp_path):
    (tmp_path / "w.bin").write_bytes(b"".join(i.to_bytes(4, "little") for i in (70000, 9, 65536 + 9, 5, 9, 1)))
    got = token_counts.count(token_counts.read_blocks(spark, str(tmp_path), 8), 9, 4).orderBy("doc").collect()
    assert [(r.doc, r.n_tokens, r.ended) for r in got] == [(0, 1, True), (1, 2, True), (2, 1, False)]
