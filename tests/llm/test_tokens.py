import base64

import numpy as np
import pytest
import tiktoken

from evidentia.llm.shared import Scratch
from evidentia.llm import tokens
from evidentia.llm.tokens import PATTERN, VOCABULARY, count_file_tokens, scan, stitch, token_blocks, token_counts


def test_files_with_all_kinds_of_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCKS_PER_GROUP", 3)
    rng = np.random.default_rng(2)
    want = set()
    contents = [np.array(x, dtype=np.uint16) for x in ([], [9], [9, 9], [1, 2, 3], [1] * 40, [9] + [1] * 40 + [9])]
    contents += [rng.choice([1, 2, 9], p=[0.45, 0.45, 0.1], size=int(n)).astype(np.uint16) for n in rng.integers(1, 300, 12)]
    for k, tokens_of in enumerate(contents):
        (tmp_path / f"f{k:03d}.bin").write_bytes(tokens_of.tobytes())
        ends = [-1, *np.flatnonzero(tokens_of == 9).tolist()]
        want |= {(k, n, b - a - 1, True) for n, (a, b) in enumerate(zip(ends, ends[1:], strict=False))}
        if len(tokens_of) - 1 > ends[-1]:
            want.add((k, len(ends) - 1, len(tokens_of) - 1 - ends[-1], False))
    got = count_file_tokens(spark, str(tmp_path), separator=9, block_tokens=7).collect()
    assert {(int(r.shard[-7:-4]), r.ordinal, r.n_tokens, r.ended) for r in got} == want and len(got) == len(want)


def test_large_files_are_read_in_ranges(spark, tmp_path, monkeypatch):
    """A sparse file beyond the 2 GB that Spark reads as one value; zeros are tokens like any other."""
    n = (1 << 30) + 1000
    with open(tmp_path / "big.bin", "wb") as f:
        for place in (5, 1 << 29, n - 3):
            f.seek(2 * place)
            f.write(np.array([9], dtype=np.uint16).tobytes())
        f.truncate(2 * n)
    got = count_file_tokens(spark, str(tmp_path), separator=9, block_tokens=1 << 22).collect()
    assert sorted((r.ordinal, r.n_tokens, r.ended) for r in got) == [(0, 5, True), (1, (1 << 29) - 6, True), (2, n - 4 - (1 << 29), True), (3, 2, False)]
    monkeypatch.setattr(tokens, "_opens", lambda path: False)
    with pytest.raises(Exception, match="exceeds the max length allowed"):
        count_file_tokens(spark, str(tmp_path), separator=9).collect()


def test_files_that_only_spark_opens(spark, tmp_path, monkeypatch):
    np.array([1, 9, 2, 2], dtype=np.uint16).tofile(tmp_path / "a b.bin")
    want = sorted(map(tuple, count_file_tokens(spark, str(tmp_path), separator=9, block_tokens=3).collect()))
    assert [r[1:] for r in want] == [(0, 1, True), (1, 2, False)]
    monkeypatch.setattr(tokens, "_opens", lambda path: False)
    assert sorted(map(tuple, count_file_tokens(spark, str(tmp_path), separator=9, block_tokens=3).collect())) == want


def test_uint32_and_broken_files(spark, tmp_path):
    np.array([70000, 9, 70000, 70000], dtype=np.uint32).tofile(tmp_path / "a.bin")
    got = count_file_tokens(spark, str(tmp_path), dtype="uint32", separator=9).collect()
    assert sorted((r.ordinal, r.n_tokens, r.ended) for r in got) == [(0, 1, True), (1, 2, False)]
    (tmp_path / "b.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="not a whole number of tokens"):
        count_file_tokens(spark, str(tmp_path), dtype="uint32", separator=9).collect()


def test_counts_as_the_tokenizer_says(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|> is text"), (5, "long " * 20000), (6, "é 漢字 😀\n\n x"), (6, "é 漢字 😀\n\n x"), (None, "no id"), (7, "")]
    df = spark.createDataFrame([(i, t, "b", [1]) for i, t in rows], "doc_id long, text string, block string, labels array<int>")
    want = sorted(((i, len(plain.encode_ordinary(t or ""))) for i, t in rows), key=repr)
    for size in (3, 1 << 16):
        got = token_counts(df.repartition(3), block_tokens=size).collect()
        assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == want
    assert token_counts(df.limit(0)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    blocks = token_blocks(docs, block_tokens=1000)
    assert blocks.where("length(content) > 2000").count() == 0
    got = stitch(scan(blocks), Scratch(spark)).collect()
    assert len(got) == docs.count() and all(r.ended for r in got)
    assert sorted(r.doc_id for r in token_counts(docs, block_tokens=1000).collect()) == sorted(r.doc_id for r in docs.collect())
