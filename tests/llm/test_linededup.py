import random

import numpy as np
from pyspark.sql import functions as F

from pointlens.llm.linededup import dedup_lines, extend, fingerprints, winnow, winnowed
from pointlens.llm.queries import op3_line_dedup


def brute(docs, least):
    """docs: distinct (id, text) in order. Lines go that lie in a run of `least` words which equals a run at an earlier place."""
    laid = []
    for text in docs:
        laid.append([(n, line, len(line.split())) for n, line in enumerate((text or "").split("\n")) if line.split()])
    seen, gone = {}, [set() for _ in docs]
    spans = []
    for d, lines in enumerate(laid):
        for s in range(len(lines)):
            words = 0
            for e in range(s, len(lines)):
                words += lines[e][2]
                # windows of just enough words are enough: a longer run is made of them
                if words >= least and (words - lines[s][2] < least or words - lines[e][2] < least):
                    spans.append((d, s, e, tuple(x[1] for x in lines[s : e + 1])))
                if words - lines[s][2] >= least and words - lines[e][2] >= least:
                    break
    for d, s, e, run in spans:
        seen[run] = min(seen.get(run, (d, s)), (d, s))
    for d, s, e, run in spans:
        if seen[run] < (d, s):
            gone[d].update(range(laid[d][s][0], laid[d][e][0] + 1))
    return ["\n".join(x for n, x in enumerate(t.split("\n")) if n not in g) if t is not None and g else t for t, g in zip(docs, gone)]


def test_random_documents(spark):
    rng = random.Random(4)
    for least in (3, 8):
        texts = ["\n".join(rng.choice(["", "a b", "c", "d e f g", "h i", " ", "j k l", "m"]) for _ in range(rng.randint(0, 25))) for _ in range(60)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_removed", F.lit("clash")).repartition(3)
        for paired in (1, 8, 1000):  # all hashes crowded, some, none
            found = {r.doc_id: r.text for r in dedup_lines(docs, least, paired=paired).collect()}
            assert [found[i] for i in range(len(texts))] == brute(texts, least)


def test_fewer_fingerprints_than_windows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("_id"), F.lit(0).cast("long").alias("_hash"), F.col("text").alias("_text"))
    documents = winnowed(docs, 50).persist()
    n_windows = documents.agg(F.sum(F.size("digest"))).first()[0]
    assert 0 < fingerprints(documents).count() < n_windows
    short_lines = "\n".join(f"{i} of" for i in range(400)).encode()
    _, _, start, _, pick, _ = winnow(short_lines, 50)
    assert 5 * len(set(pick)) < len(start)  # windows of 25 lines share their minima


def test_matches_grow_both_ways_until_lines_differ():
    later, earlier = np.array([9, 1, 2, 3, 4, 8, 1, 2]), np.array([1, 2, 3, 4, 7, 1, 2, 3])
    assert extend(later, earlier, [(2, 1), (3, 2), (7, 1)]) == [(1, 4), (6, 7)]
    assert extend(later, earlier, [(1, 5)]) == [(1, 3)]


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    found = {r.doc_id: r.text for r in op3_line_dedup(spark, sf_dir).collect()}
    assert [found[d.doc_id] for d in docs] == brute([d.text for d in docs], 50)


def test_long_passages_go_and_clean_texts_stay(spark):
    passage = " ".join(f"w{i}" for i in range(55))
    split = "\n".join(" ".join(f"v{i}{j}" for j in range(11)) for i in range(5)) + "\nshort tail"
    rows = [(1, f"one\n{passage}\nhead\n{split}\nend"), (2, f"two\n{split}\nx"), (3, f"{passage}\nthree"), (4, "Short title\nonly here"), (5, "Short title\nand here"),
            (6, None), (7, ""), (8, passage), (9, passage), (9, passage), (None, passage), (10, "\n\n")]
    found = sorted(((r.doc_id, r.text, r.n_removed) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert found == sorted(
        [(1, rows[0][1], 0), (2, "two\nx", 6), (3, "three", 1), (4, rows[3][1], 0), (5, rows[4][1], 0), (6, None, 0), (7, "", 0), (8, "", 1), (9, "", 1), (9, "", 1), (None, "", 1), (10, "\n\n", 0)], key=repr
    )


def test_empty(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string, n int")).columns == ["doc_id", "text", "n", "n_removed"]
    assert dedup_lines(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, `a.b c` int")).columns == ["doc_id", "text", "a.b c", "n_removed"]
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
