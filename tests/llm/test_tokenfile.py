import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pointlens.llm import tokenfile
from pointlens.llm.queries import op10_token_files, tokenizer_path
from pointlens.llm.tokenfile import pack, read_documents, read_tokens, unpack, write_tokens

PATH = tokenizer_path("word_bpe_49k.json")
PARTS = ["a", "B", "  ", " ", "\n", "\t", "É", "é", "́", "ß", "ẞ", "中", "\x1c", "\x85", "\xa0", "1", "٣", "'s", "'LL", "'", "!!", "<|endoftext|>", "<|startoftext|>", "😀", "Σ", "ς", "the ", "ing", "İ", "ǅ", "ﬁ", "K", "‍", "　"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("bits", [1, 3, 9, 16, 17, 31])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint32)
    data = pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8) and (unpack(data, bits, 1001) == ids).all()
    assert (unpack(data, bits, 333, 17) == ids[17:350]).all() and len(unpack(data, bits, 0, 5)) == 0


def test_encodes_like_the_library(library):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(3000)]
    with open(PATH, encoding="utf-8") as f:
        found = tokenfile.WordEncoder(f.read()).encode(pa.array(texts, pa.large_string()))
    assert [f.tolist() for f in found] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def expected(rows, library, end=2):
    out, start = [], 0
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark, sf_dir, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    assert sorted(tuple(r) for r in op10_token_files(spark, sf_dir).collect()) == sorted(expected(rows, library))


def test_files(spark, tmp_path, library):
    rows = [(None, "null id"), (1, None), (2, ""), (3, "Some words, of a text!"), (4, "more " * 500), (9, "x")]
    docs = spark.createDataFrame([(*r, "clash") for r in random.Random(1).sample(rows, len(rows))], "doc_id long, text string, start string")
    path = str(tmp_path / "tokens")
    write_tokens(docs, PATH, path, end_id=2, block_tokens=100)
    want = expected(rows, library)
    assert sorted((tuple(r) for r in read_documents(spark, path).collect()), key=lambda r: r[1]) == want
    ids = np.concatenate([library.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows])
    for start, n in ((0, len(ids)), (3, 10), (90, 400), (len(ids) - 1, 1)):
        parts = sorted((r.place, r.ids) for r in read_tokens(spark, path, start, n).collect())
        assert sum((p for _, p in parts), []) == ids[start : start + n].tolist()


def test_repeated_rows_and_empty_table(spark, tmp_path, library):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (0, "c")], "doc_id long, text string")
    write_tokens(docs, PATH, str(tmp_path / "a"), end_id=2)
    found = sorted((tuple(r) for r in read_documents(spark, str(tmp_path / "a")).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [0, 1, 1, 1] and [r[1] for r in found] == [0, 2, 4, 6]
    write_tokens(docs.limit(0), PATH, str(tmp_path / "b"), end_id=2)
    assert read_documents(spark, str(tmp_path / "b")).collect() == []


def test_equal_rows_are_split(spark, tmp_path, library):
    """A third of the rows are equal; no part holds over twice the mean."""
    rows = [(i, f"text number {i}") for i in range(2000)] + [(700, "the same row")] * 1000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = str(tmp_path / "tokens")
    write_tokens(docs, PATH, path, end_id=2, block_tokens=64)
    sizes = [r.n for r in spark.read.parquet(path).selectExpr("part", "size(doc_ids) AS d").groupBy("part").agg({"d": "sum"}).withColumnRenamed("sum(d)", "n").collect()]
    assert sum(sizes) == 3000 and len(sizes) == 4 and max(sizes) <= 2 * 3000 / 4
    found = read_documents(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted(i for i, _ in rows)
