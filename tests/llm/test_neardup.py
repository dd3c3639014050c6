import random
from itertools import combinations

import corpus_pipeline
from pyspark.sql import functions as F

from pointlens.llm import neardup, simhash


def slow_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """The kept (id, text) by comparing all pairs of texts; ids are distinct and not null."""
    sets = [slow_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if 5 * both >= 4 * len(sets[i] | sets[j]):
            top[root(i)] = root(j)
    best = {}
    for i, row in enumerate(rows):
        best[root(i)] = min(best.get(root(i), row), row, key=lambda r: r[0])
    return sorted(best.values(), key=repr)


def kept(spark, rows):
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_stage(spark, df, "").collect()), key=repr)


def varied(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**9)}"
    return out


def test_near_stage_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows, texts = [], [None, "", " \n", "one two", "One  TWO", "one two three", "a b c d e"]
    for _ in range(4):  # pairs on both sides of the bound
        base = rng.choices(vocabulary, k=rng.choice([30, 100, 400]))
        texts += [" ".join(varied(rng, base, n)) for n in (0, 1, 2, 4, 8)] + [" ".join(base + base[:7])]
    texts += [" ".join(passage + rng.choices(vocabulary, k=rng.choice([5, 12, 16, 60]))) for _ in range(20)]  # one passage in many
    crowd = rng.choices(vocabulary, k=120)
    texts += [" ".join(varied(rng, crowd, rng.choice([1, 2, 3]))) for _ in range(80)]  # crowded keys
    texts += texts[8:14]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    expected = brute(rows)
    assert kept(spark, rows) == expected
    assert len(expected) < len(rows)


def test_the_bound_is_inclusive(spark):
    words = [f"w{i}" for i in range(12)]  # 8 shingles; 9 and one of them new: 8 of 10
    both = [(1, " ".join([*words, "x"])), (2, " ".join(["y", *words]))]
    assert kept(spark, both) == [both[0]]
    less = [(1, " ".join([*words[:-1], "x"])), (2, " ".join(["y", *words[:-1]]))]  # 7 of 9
    assert kept(spark, less) == less


def test_documents_of_the_tables(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert kept(spark, rows) == brute(rows)


def test_sketches_never_differ_by_more_than_the_sets():
    rng = random.Random(6)
    for n in (1, 10, 300, 5000):
        words = [f"w{rng.randrange(300)}" for _ in range(n)]
        a, b = neardup.shingles(" ".join(words).encode()), neardup.shingles(" ".join(varied(rng, words, (n + 9) // 10)).encode())
        assert len(neardup.sketch(a)) == len(neardup.sketch(b)) >= len(a) / 64
        apart = sum(int(x).bit_count() for x in (neardup.sketch(a) ^ neardup.sketch(b)).view("uint64"))
        assert apart <= len(set(a.tolist()) ^ set(b.tolist()))


def test_similar_sets_on_both_sides_of_a_power_of_two(spark):
    rng = random.Random(11)
    words = [f"v{rng.randrange(10**6)}" for _ in range(560)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:510])), (3, " ".join(words[:480])), (4, " ".join(f"u{i}" for i in range(515)))]
    assert kept(spark, rows) == brute(rows) == [rows[0], rows[3]]


def test_texts_that_share_a_frame_do_not_meet(spark, monkeypatch):
    """2,000 texts of ten shingles, eight of them the same: all share a key, and no two are similar."""
    pairs, plain = [], neardup.candidate_pairs

    def counted(left):
        pairs.append(plain(left).count())
        return plain(left)

    monkeypatch.setattr(neardup, "candidate_pairs", counted)
    frame = [f"f{i}" for i in range(12)]  # eight shingles
    rows = [(i, " ".join([*frame, f"a{i}", f"b{i}"])) for i in range(2000)]
    assert len(kept(spark, rows)) == 2000
    assert pairs[0] <= 20 * 2000


def test_simhash_brings_candidates(spark, monkeypatch):
    """Fingerprints are SimHash's own, and sets that they link are compared, similar or not; only similar ones fall together."""
    text = b" ".join(b"w%d" % i for i in range(90))
    assert simhash.fingerprint(text, 5) == neardup.simhash_of(neardup.shingles(text)) % (1 << 64)
    asked, verified = [], neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda pairs, *a: asked.append({frozenset(r) for r in pairs.select("u", "v").collect()}) or verified(pairs, *a))
    plain = neardup.keyed_rows
    monkeypatch.setattr(neardup, "keyed_rows", lambda *a: plain(*a).withColumn("sim", F.lit(0).cast("long")))  # all linked, though no shingle is shared
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l"), (3, "m n o p q r")], "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.keep_one(docs).collect()) == [1, 2, 3]
    assert len(asked[0]) == 2
