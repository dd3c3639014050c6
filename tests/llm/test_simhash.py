import random
from collections import defaultdict

import xxhash

from pointlens.llm import simhash
from pointlens.llm.graph import connected_components
from pointlens.llm.queries import op5_simhash
from pointlens.llm.simhash import components, keep_one


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps):
    """Component (set of fingerprints) of each fingerprint by comparing all pairs."""
    left, out = set(fps), {}
    while left:
        todo, group = [left.pop()], set()
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 2}
            left -= near
            todo += near
        out.update(dict.fromkeys(group, frozenset(group)))
    return out


def brute(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    groups = brute_groups(fps)
    ids = defaultdict(list)
    for (i, _), f in zip(rows, fps):
        if i is not None:
            ids[groups[f]].append(i)
    return sorted([(i, f"{f:016x}", min(ids[groups[f]], default=None)) for (i, _), f in zip(rows, fps)], key=repr)


def run(df):
    return sorted((tuple(r) for r in components(df).collect()), key=repr)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op5_simhash(spark, sf_dir).collect()), key=repr) == brute(rows)


def test_edges(spark):
    long = "word other third " * 20000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (5, "one TWO"), (None, "one two"), (6, "É x y"), (7, "é x y"), (8, long), (9, long + "end"), (None, "alone in null")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component_id string")
    assert run(df) == brute(rows)
    assert run(df.limit(0)) == []
    kept = sorted((tuple(r) for r in keep_one(df).collect()), key=repr)
    assert kept == sorted([(1, None, "clash"), (4, "One two", "clash"), (6, "É x y", "clash"), (7, "é x y", "clash"), (8, long, "clash"), (None, "alone in null", "clash")], key=repr)


def test_keep_one_of_rows_that_share_id_and_text(spark):
    df = spark.createDataFrame([(1, "a b c d")] * 5 + [(2, "a b c d")], "doc_id long, text string")
    assert [tuple(r) for r in keep_one(df).collect()] == [(1, "a b c d")]


def test_links_hold_every_group_together(spark):
    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for centre in list(fps)[:8]:  # crowded: chains and clouds around a few
        for _ in range(60):
            centre ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            fps.add(centre)
    base = rng.getrandbits(64)
    fps |= {base ^ (1 << i) ^ (1 << j) for i in range(16) for j in range(16)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    expected = {signed(k): min(map(signed, g)) for k, g in brute_groups(fps).items()}
    table = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for limit in (4, 10_000):  # mostly the way of the crowded keys, and pairs only
        found = {r.node: r.component for r in connected_components(simhash.links(table, limit)).collect()}
        assert {f: found.get(f, f) for f in expected} == expected


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(300)] + [(500, 500), (1000, 2000), (2000, 1000)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**dict.fromkeys(range(301), 0), 1000: 1000, 2000: 1000}
