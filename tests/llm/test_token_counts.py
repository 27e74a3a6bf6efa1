import random

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from phaseloom.llm import token_counts
from phaseloom.llm.common import shared_dir


def brute(raw, end, width):
    ids = np.frombuffer(raw, f"<u{width}")
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((start, i - start))
            start = i + 1
    if start < len(ids):
        out.append((start, len(ids) - start))
    return [(k, *x) for k, x in enumerate(out)]


def test_any_ranges(spark, tmp_path):
    rng = random.Random(4)
    want = []
    for width, end in ((2, 50256), (4, 50256), (2, 0x5050), (4, 0)):
        for f in range(4):
            odd = [int.from_bytes(end.to_bytes(width, "little")[1:] + b"\x07", "little"), int.from_bytes(b"\x09" + end.to_bytes(width, "little")[:-1], "little")]
            ids = [rng.choice([end, 1, 2, *odd]) if rng.random() < 0.5 else rng.randrange(1000) for _ in range(rng.choice([0, 1, 7, 400, 900]))]
            ids += [5] * (f % 2) + [end] * (f // 2)
            ids += [7] * 300 * (f == 3)
            d = tmp_path / f"{width}-{end}"
            d.mkdir(exist_ok=True)
            raw = np.array(ids, f"<u{width}").tobytes()
            (d / f"f{f}.bin").write_bytes(raw)
            want += [(width, end, f"f{f}.bin", *x) for x in brute(raw, end, width)]
    for size in ("61", "500", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = []
        for width, end in ((2, 50256), (4, 50256)):
            got += [(width, end, r.file.rsplit("/", 1)[1], r.doc_index, r.start_token, r.n_tokens) for r in token_counts.token_counts(spark, str(tmp_path / f"{width}-{end}"), end, width).collect()]
        assert sorted(got) == sorted(w for w in want if w[1] == 50256)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    for width, end in ((2, 0x5050), (4, 0)):  # bytes that overlap themselves
        with pytest.raises(ValueError, match="overlap"):
            token_counts.token_counts(spark, str(tmp_path / f"{width}-{end}"), end, width)


def test_empty_table_and_wide_ids(spark):
    path = shared_dir(spark, "tokens-test")
    docs = spark.createDataFrame([("one two",)], "text string")
    token_counts.write_tokens(docs.limit(0), path)
    assert token_counts.token_counts(spark, path).count() == 0
    with pytest.raises(ValueError, match="fit"):
        token_counts.write_tokens(docs, shared_dir(spark, "tokens-test"), end_id=70_000)
    with pytest.raises(Exception, match="does not fit"):
        token_counts.write_tokens(docs, shared_dir(spark, "tokens-test"), end_id=200, width=1)


def test_written_files(spark):
    texts = ["one two", "", None, "a <|endoftext|> b", "x" * 3000, "ñ é ü"]
    path = shared_dir(spark, "tokens-test")
    token_counts.write_tokens(spark.createDataFrame([(t, 1) for t in texts], "text string, ids int").repartition(2), path)
    oracle = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    oracle.encode_special_tokens = True
    got = sorted(r.n_tokens for r in token_counts.token_counts(spark, path).collect())
    assert got == sorted(len(oracle.encode(t or "", add_special_tokens=False).ids) for t in texts)
