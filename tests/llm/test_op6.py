import re

import numpy as np
import xxhash

from sparkmarts.llm.graph import components, in_blocks
from sparkmarts.llm.op6_simhash import bit_planes, close_pairs, fingerprint, links, near_duplicates
from sparkmarts.llm.queries import op6_simhash
from tests.llm.helpers import ODD_ROWS, docs_frame


def plain(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]), 42)
              for i in range(max(1, len(words) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes_of(ids, pairs):
    root = {i: i for i in ids}
    find = lambda v: v if root[v] == v else find(root[v])
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(rows):
    fps = [plain(t) for _, t in rows]
    u = np.array(fps, np.uint64)
    pairs = []
    for i in range(len(rows)):
        near = np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 3)
        pairs += [(i, int(j)) for j in near]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0]))
    place = {i: k for k, i in enumerate(order)}
    of = classes_of(range(len(rows)), [(place[a], place[b]) for a, b in pairs])
    return sorted(((rows[i][0], f"{fps[i]:016x}", rows[order[of[place[i]]]][0])
                   for i in range(len(rows))), key=str)


def test_fingerprints_equal_the_definition():
    for text in ("a", "A b", "A B c", "é É\x0bx  y\tz\nw\xa0q ", "", " \n", "the cat " * 50):
        assert fingerprint(text, 3, 42) == plain(text)


def test_close_pairs_equal_brute_force():
    draw = np.random.default_rng(1)
    base = draw.integers(0, 2**63, 300).astype(np.uint64)
    fps = np.concatenate([base, base[:200] ^ (np.uint64(1) << draw.integers(0, 64, 200).astype(np.uint64)),
                          base[:90] ^ np.uint64(0b1111), base[:50] ^ np.uint64(0x8000000000000005)])
    for sizes in ([640], [300, 200, 100, 39, 1], [1] * 640):
        group = np.repeat(np.arange(len(sizes)), sizes)
        for radius in (1, 2, 3, 4):
            got = {(int(a), int(b)) for i, j in close_pairs(fps, group, radius) for a, b in zip(i, j)}
            want = {(a, b) for a in range(640) for b in range(a + 1, 640) if group[a] == group[b]
                    and int(fps[a] ^ fps[b]).bit_count() <= radius}
            assert got == want
    assert bit_planes(fps).shape == (64, 11)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(3, 3), (5, 9), (9, 5)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = {v for e in edges if e[0] != e[1] for v in e}
    want = classes_of(ids, [e for e in edges if e[0] != e[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blocks_bound_groups_and_keep_pairs(spark):
    from pyspark.sql import functions as F
    rows = spark.range(500).select((F.col("id") % 50 * F.when(F.col("id") < 300, 0).otherwise(1)).alias("key"), "id")
    got = in_blocks(rows, ["key"], F.xxhash64("id"), 40).collect()
    groups = {}
    for r in got:
        groups.setdefault((r.key, r.block_a, r.block_b), set()).add(r.id)
    assert max(map(len, groups.values())) < 150
    hot = sorted({r.id for r in got if r.key == 0})
    met = {(a, b) for g in groups.values() for a in g for b in g}
    assert all((a, b) in met for a in hot for b in hot)


def test_links_do_not_depend_on_blocks_or_key_length(spark):
    draw = np.random.default_rng(4)
    base = draw.integers(-2**62, 2**62, 60)
    fps = np.unique(np.concatenate([base ^ (1 << int(k)) ^ (1 << int(m)) for k, m in
                                    draw.integers(0, 63, (12, 2))] + [base, -base]))
    df = spark.createDataFrame([(int(f), k) for k, f in enumerate(fps)], "fp long, rep long")
    u = fps.astype(np.int64).view(np.uint64)
    want = classes_of(range(len(u)), [(i, int(j)) for i in range(len(u))
                                      for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 3)])
    for small, rows in ((64, 2048), (1 / 2**30, 10)):
        edges = [(r.a, r.b) for r in links(df, 3, small, rows).collect()]
        assert classes_of(range(len(u)), edges) == want


def test_odd_rows(spark):
    rows = [*ODD_ROWS, (30, "The CAT sat on  the mat"), (31, None)]
    got = near_duplicates(docs_frame(spark, rows)).drop("group_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert near_duplicates(docs_frame(spark, rows).limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = list(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    assert sorted(map(tuple, op6_simhash(spark, sf).collect()), key=str) == brute(rows)
