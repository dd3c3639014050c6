import math
import re
from collections import Counter

import pytest

from pointlens.llm import quality
from pointlens.llm.quality import QualityRules, count_ngrams
from pointlens.llm.queries import op1_quality_rules, trusted_labels


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), failed


def grams(text, buckets):
    b = bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode())
    shift = 32 - (buckets.bit_length() - 1)
    return [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x9E3779B1 % 2**32) >> shift for i in range(len(b) - 2)]


def brute(docs, good, rules):
    raw, target = Counter(), Counter()
    for i, text in docs:
        g = grams(text, rules.buckets)
        raw.update(g)
        if i in good:
            target.update(g)
    a, n, t = rules.smoothing * rules.buckets, sum(raw.values()), sum(target.values())
    out = []
    for i, text in docs:
        g = grams(text, rules.buckets)
        ratio = [math.log((target[x] + rules.smoothing) / (t + a)) - math.log((raw[x] + rules.smoothing) / (n + a)) for x in g] if t else []
        score = sum(ratio) / len(g) if ratio else 0.0
        figures = base(text)
        out.append((i, *figures, not figures[-1] and score >= rules.threshold, score))
    return out


def compare(found, expected):
    found, expected = sorted(map(tuple, found), key=repr), sorted(expected, key=repr)
    assert [x[:-1] for x in found] == [x[:-1] for x in expected]
    assert [x[-1] for x in found] == pytest.approx([x[-1] for x in expected], abs=1e-5)


def test_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    compare(op1_quality_rules(spark, sf_dir).collect(), brute(docs, good, QualityRules()))  # and against SQL in test_sql


def test_labelled_documents_are_told_apart(spark, sf_dir):
    found = op1_quality_rules(spark, sf_dir).where("NOT base_failed").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    assert all(r.kept == bool(r.quality) for r in found)


EDGES = [(1, None), (2, ""), (3, "ab"), (4, "a b c d e a b c d e x y z"), (4, "a b c d e a b c d e x y z"), (None, "one two three four five six seven eight nine ten"),
         (5, "é ß　中 " * 30), (6, "x\ty\x0bz\r\n\n \nx\ty\x0bz\r"), (7, "word " * 40000), (8, "*** %%% &&& ||| " * 8)]


def test_edges(spark):
    docs = spark.createDataFrame([(i, t, True, 0.5) for i, t in EDGES], "doc_id long, text string, kept boolean, score double")
    for trusted in ([1, 4, 5, None], []):
        labels = spark.createDataFrame([(t,) for t in trusted], "doc_id long")
        compare(quality.score_documents(docs, labels).collect(), brute(EDGES, set(trusted) - {None}, QualityRules()))
    labels = spark.createDataFrame([(4,)], "doc_id long")
    kept = quality.keep_good(docs, labels)
    assert kept.schema == docs.schema
    expected = [(e, True, 0.5) for e, row in zip(EDGES, brute(EDGES, {4}, QualityRules())) if row[-2]]
    assert sorted([tuple(r) for r in kept.collect()], key=repr) == sorted([(*e, k, s) for e, k, s in expected], key=repr)
    assert quality.score_documents(docs.limit(0), labels).collect() == []


def test_any_number_of_trusted_ids(spark, sf_dir):
    docs, trusted = spark.read.parquet(f"{sf_dir}/documents.parquet"), trusted_labels(spark, sf_dir)
    both = [sorted(map(tuple, count_ngrams(docs, trusted, QualityRules(), most_sent=n).collect())) for n in (0, 10**6)]
    assert both[0] == both[1] and any(target for _, _, target in both[0])
