import random

import xxhash

from gridloom.llm import components, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, key int, component_id int"


def brute(rows, k=3, bits=2):
    prints = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[j : j + k]) for j in range(max(1, len(words) - k + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= bits and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return {i: (f"{prints[i]:016x}", root[i]) for i in prints}


def test_documents_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.digest(simhash.near_duplicates(docs)).collect()}
    assert got == brute(rows)


def test_links_keep_components_in_all_three_ways(spark):
    rnd = random.Random(5)
    centre = [rnd.getrandbits(64) for _ in range(20)]
    values = {c ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for c in centre for _ in range(12)} | set(centre) | {rnd.getrandbits(64) for _ in range(50)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")

    def roots(pairs):
        root = {v: v for v in values}
        for _ in values:
            before = dict(root)
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
            if root == before:
                return root

    expected = roots([(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2])
    for crowd in (1, 3, 256):
        for wide in (False, True):
            assert roots([tuple(r) for r in simhash.links(fps, 2, crowd, wide).select("a", "b").collect()]) == expected


def test_wide_variants_meet_at_any_two_bits(spark):
    rnd = random.Random(6)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    pairs = []
    for a in range(64):
        for b in range(a, 64):
            v = rnd.getrandbits(64)
            pairs.append((signed(v), signed(v ^ (1 << a) ^ (1 << b if b != a else 0))))
    fps = spark.createDataFrame([(v,) for p in pairs for v in p], "fp long")
    found = {frozenset((r.a, r.b)) for r in simhash.links(fps, 2, 256, True).collect()}
    assert found >= {frozenset(p) for p in pairs}


def test_nulls_empty_ties_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "ONE"), (None, "one"), (6, "a b c d " * 60_000)]
    df = spark.createDataFrame([(i, t, None, None, None, "x", 1, 2) for i, t in rows], SCHEMA)
    got = simhash.digest(simhash.near_duplicates(df)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert {by[i].component_id for i in (1, 2, 3)} == {1} and by[2].fingerprint == "0" * 16
    assert by[5].component_id == 4 and by[None].component_id == 4
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
