import json
import random
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pointlens.llm import bpe
from pointlens.llm.queries import op4_bpe, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
PARTS = ["a", "b", "  ", " ", "\n", "\t", "é", "ß", "中", "\x1c", "\x85", "1", "٣", "'s", "'ll", "'", "!!", "<|endoftext|>", "😀", "é", "the ", "ing", "\r\n", "===", "----", " ", "　", "E" * 40]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.BpeModel.load(PATH))


def encoded(encoder, texts):
    return encoder.encode(pa.array(texts, pa.large_string()))


def test_encodes_and_decodes_like_the_library(library, encoder):
    rng = random.Random(6)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(rng.choices("etaoinshrdlu ETAO", k=rng.randint(1, 60))) for _ in range(1500)] + ["ab" * 5000, " ", "  x", "x  ", ""]
    texts += ["".join(rng.choices("etaoinshrdlu", k=bpe.LONG_WORD + rng.randint(-5, 60))) for _ in range(100)]
    found = encoded(encoder, texts)
    for text, ids, decoded, id_text in zip(texts, found, encoder.decode(found), encoder.id_texts(found)):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == expected
        assert decoded.decode() == library.decode(expected, skip_special_tokens=False)
        assert bytes(id_text).decode() == ",".join(map(str, expected))
    assert 0 < encoder.merged < len(encoder.young)  # some words needed exact merging, not all


def test_code_table_finds_what_is_there():
    rng = np.random.default_rng(1)
    codes = rng.choice(1 << 40, 5000, replace=False)
    table = bpe.CodeTable(codes[:4000])
    assert table.find(codes).tolist() == [*range(4000), *[-1] * 1000]
    assert bpe.CodeTable(codes[:0]).find(codes).max() == -1


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": None}])
def test_refuses_other_tokenizers(tmp_path, change):
    spec = json.loads(open(PATH, encoding="utf-8").read()) | change
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="supported"):
        bpe.BpeModel.load(str(tmp_path / "other.json"))


def test_decodes_broken_bytes_like_the_library(library, encoder):
    rng = random.Random(7)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 6))]
        assert encoder.decode([np.array(ids, np.int64)])[0].decode() == library.decode(ids, skip_special_tokens=False)


def test_cache_refills(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    encoder = bpe.Encoder(bpe.BpeModel.load(PATH))
    for text in ("one two three four", "five six one two", "seven"):
        assert encoded(encoder, [text])[0].tolist() == library.encode(text).ids


def test_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op4_bpe(spark, sf_dir).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edges(spark):
    rows = [(None, "a b"), (1, None), (1, ""), (2, "x"), (2, "x")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")
    found = sorted(((r.doc_id, r.decoded) for r in bpe.encode(docs, PATH).collect()), key=repr)
    assert found == sorted([(i, t or "") for i, t in rows], key=repr)
    assert bpe.encode(docs.limit(0), PATH).collect() == []
