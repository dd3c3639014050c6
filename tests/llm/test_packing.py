import zlib

import numpy as np
import pytest

from pointlens.llm import packing
from pointlens.llm.common import shared_dir
from pointlens.llm.queries import op13_packing, tokenizer_path


def ids_of(rows, end_id):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    return [library.encode(text or "", add_special_tokens=False).ids + ([] if end_id is None else [end_id]) for _, text in rows]


def padding(used, capacity):
    return 0 if used & (used - 1) == 0 else capacity - used


def check(found, rows, end_id=1, capacity=2048):
    """All pieces against the library: every id of every document lies in one piece, and every sequence is filled from 0 on."""
    sequences, mine = {}, {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        mine.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    wasted = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        wasted += padding(at, capacity)
    expected = {}
    for (i, _), ids in zip(rows, ids_of(rows, end_id)):
        expected.setdefault(i, []).append(ids)
    assert set(expected) >= set(mine) and sum(len(x) for v in expected.values() for x in v) == sum(p[1] for v in mine.values() for p in v)
    for i, all_ids in expected.items():
        if len(all_ids) == 1:
            at = 0
            for start, length, crc, tokens in sorted(mine.get(i, [])):
                assert start == at and tokens == len(all_ids[0])
                assert crc == zlib.crc32(np.array(all_ids[0][start : start + length], "<u4").tobytes())
                at += length
            assert at == len(all_ids[0])
    return wasted


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert check(op13_packing(spark, sf_dir).collect(), rows) == 0


@pytest.mark.parametrize("capacity", [7, 64])
def test_edges(spark, capacity):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "word " * 500), (None, "no id"), (5, "x"), (6, "x"), (7, " "), *[(100 + i, "same text of a third") for i in range(60)], (8, "twice"), (8, "twice")]
    docs = spark.createDataFrame([(*r, 0, "c") for r in rows], "doc_id long, text string, length int, ids string")
    tokenizer = tokenizer_path("byte_bpe_50k.json")
    assert check(packing.pack_digest(docs, tokenizer, shared_dir(spark), 1, capacity).collect(), rows, 1, capacity) == 0
    assert check(packing.pack_digest(docs, tokenizer, shared_dir(spark), None, capacity).collect(), rows, None, capacity) == 0
    assert packing.pack_digest(docs.limit(0), tokenizer, shared_dir(spark), 1, capacity).collect() == []


def test_packed_sequences_hold_the_ids(spark):
    rows = [(i, " ".join(["words"] * (i % 30 + 1))) for i in range(150)]
    docs, path = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shared_dir(spark)
    packing.write_pieces(docs, tokenizer_path("byte_bpe_50k.json"), path, 1, 32)
    found = packing.sequences(spark, path, 32).collect()
    assert all(0 < len(r.ids) <= 32 for r in found)
    assert sorted(i for r in found for i in r.ids) == sorted(i for ids in ids_of(rows, 1) for i in ids)
    ends = sum(r.ids[-1] == 1 for r in found)
    assert ends > len(found) / 2  # few documents are cut


def test_program_leaves_little_over():
    rng = np.random.default_rng(3)
    lengths, demand = np.unique(rng.integers(1, 128, 20_000), return_counts=True)
    patterns = packing.solve(lengths, demand, 128)
    used = np.zeros(129, np.int64)
    for p in patterns:
        assert p.lengths @ p.counts == 128 and p.times > 0
        used[p.lengths] += p.counts * p.times
    assert (used[lengths] <= demand).all() and used @ np.arange(129) > 0.95 * (demand @ lengths)
    # no pattern fits: all of it is stream
    assert packing.solve(np.array([100]), np.array([50]), 128) == []
    plan = packing.Plan.make(np.array([100]), np.array([50]), 128)
    got = plan.place(np.full(50, 100), np.arange(50))
    assert got["size"].sum() == 5000 and len(np.unique(got["sequence_id"])) == 39 + bin(5000 % 128).count("1")


def test_optimum_of_small_programs():
    # halves and quarters can all be used
    lengths, demand = np.array([2, 4, 6]), np.array([10, 5, 10])
    assert sum(p.times for p in packing.solve(lengths, demand, 8)) == (10 * 2 + 5 * 4 + 10 * 6) // 8
