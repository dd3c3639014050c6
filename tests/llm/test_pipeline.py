from collections import Counter
from hashlib import sha256

import corpus_pipeline
from pointlens.llm.mixing import mix
from pointlens.llm.quality import QualityRules
from pointlens.llm.queries import tokenizer_path
from test_linededup import brute as brute_lines
from test_neardup import brute as brute_near
from test_quality import brute as brute_quality


def test_stages_equal_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    judged = brute_quality([(d.doc_id, d.text) for d in docs], good, QualityRules())
    kept = [d for d, j in zip(docs, judged) if j[-2]]
    texts = brute_lines([d.text for d in kept], 50)
    near = {i for i, _ in brute_near([(d.doc_id, t) for d, t in zip(kept, texts)])}
    single = [(d.doc_id, t, d.lang, d.source, len(t) if t != d.text else d.n_chars) for d, t in zip(kept, texts) if d.doc_id in near]
    mixed = mix(spark.createDataFrame(single, docs_schema(spark, sf_dir))).collect()  # op6 is held against SQL
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    expected = Counter()
    for r in mixed:
        ids = library.encode(r.text, add_special_tokens=False).ids
        expected[r.doc_id, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(r.text.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == expected


def docs_schema(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").schema


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), sf_dir)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert out.collect() == []


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near", "mixing", "tokens"]
