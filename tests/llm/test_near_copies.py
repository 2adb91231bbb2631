"""SimHash, embeddings, exact copies and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from ridemetrics.llm import exact_dedup as exact_dedup_module
from ridemetrics.llm.components import connected_components
from ridemetrics.llm.embedding_dedup import PER_BUCKET, bucket_codes, embedding_dedup, padded_width, shape_for, unit
from ridemetrics.llm.exact_dedup import exact_dedup
from ridemetrics.llm.simhash import first_of_groups, near_fingerprints, simhash_components


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_cycles(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)]
    edges += [(300, 301), (301, 302), (302, 300), (7, 7), (160, 5), (-3, 302), (-3, 302)]
    r.shuffle(edges)
    nodes = {n for e in edges for n in e} - {7}
    got = connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(5))
    assert {x.node: x.component for x in got.collect()} == components(nodes, [e for e in edges if 7 not in e])
    assert got.count() == len(nodes)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_rows():
    r = random.Random(2)
    vocabulary = [f"Wört{i}" for i in range(50)]
    rows = []
    for i in range(60):
        words = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 40, 400]))]
        rows.append((len(rows), " ".join(words), i))
        for _ in range(i % 3):
            words = list(words)
            words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append((len(rows), "\n".join(words).upper(), i))
    rows += [(900, None, 0), (901, "", 0), (902, " \t ", 0), (None, "only one", 0), (5, rows[5][1], 0)]
    r.shuffle(rows)
    return rows


def test_simhash_equals_brute_force(spark):
    rows = simhash_rows()
    got = simhash_components(spark.createDataFrame(rows, "doc_id long, text string, fp long")).collect()
    assert len(got) == len(rows)
    prints = {d: brute_fingerprint(t or "") for d, t, _ in rows if d is not None}
    links = [(a, b) for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3]
    want = components(prints, links)
    for r in got:
        if r.doc_id is not None:
            assert int(r.fingerprint, 16) == prints[r.doc_id]
            assert r.component_id == want[r.doc_id]
            assert len(r.fingerprint) == 16
    assert len(set(want.values())) < len(want) - 5


def test_trees_lose_no_link(spark):
    r = random.Random(4)
    seeds = [r.getrandbits(64) for _ in range(60)]
    values = set(seeds)
    for s in seeds:
        for _ in range(12):
            for bit in r.sample(range(64), r.randint(1, 4)):
                s ^= 1 << bit
            values.add(s)
    # Many that agree in one half, so that no sphere divides them there.
    values |= {(77 << 32) | r.getrandbits(10) for _ in range(200)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(4)
    want = components(signed, [(a, b) for a, x in zip(signed, values) for b, y in zip(signed, values) if (x ^ y).bit_count() <= 3])
    for shard in (8, 64, 100_000):
        edges = near_fingerprints(frame, 3, sample=512, shard=shard).collect()
        assert components(signed, [(e.src, e.dst) for e in edges]) == want


def test_one_document_of_each_group_stays(spark):
    rows = [(3, "a b c d", "x"), (1, "a b c d", "x"), (2, "quite another text here", "y"), (9, None, None), (8, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = first_of_groups(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 8]
    assert simhash_components(docs.limit(0)).count() == 0


def test_one_row_of_repeated_rows_and_of_copies_without_ids_stays(spark):
    rows = [(None, "a b c d")] * 3 + [(4, "a b c d")] + [(5, "quite another text here")] * 4
    rows += [(None, "three more words"), (6, "Three  more words"), (7, "on its own"), (7, "and this one too")]
    got = first_of_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [
        (0, "a b c d"), (0, "three more words"), (5, "quite another text here"), (7, "and this one too"), (7, "on its own"),
    ]


def vector_rows():
    r = np.random.default_rng(3)
    rows = []
    for i in range(40):
        x = r.normal(size=24)
        for k in range(int(r.integers(1, 6))):
            rows.append((len(rows), (x + 0.25 * k * r.normal(size=24) * np.linalg.norm(x) / 5).tolist()))
    rows += [(500, rows[0][1]), (501, rows[0][1]), (502, [3 * v for v in rows[0][1]])]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 0.0], [2.0, 0.0]]
    rows += [(600 + i, v) for i, v in enumerate(odd)]
    return rows


def vector_brute(rows, least=0.9):
    good = {i: unit(np.array([v]))[0] for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    links = [
        (a, b) for a in good for b in good if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= least
    ]
    count = {i: 0 for i, _ in rows}
    for a, _ in links:
        count[a] += 1
    return count, components([i for i, _ in rows], links)


def test_embeddings_equal_brute_force(spark):
    rows = vector_rows()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    count, component = vector_brute(rows)
    # block 3: most buckets are cut into blocks
    for block in (3, 4096):
        got = embedding_dedup(frame, block=block).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {
            i: (count[i], component[i], component[i] == i) for i, _ in rows
        }
    assert sum(count.values()) > 60


def test_embeddings_of_floats_nulls_and_nothing(spark):
    rows = [(None, [1.0, 0.0, 0.0]), (4, [1.0, 0.1, 0.0]), (4, [1.0, 0.1, 0.0]), (6, [0.0, 0.0, 1.0])]
    got = embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id or 0, r.n_links) for r in got) == [(0, 2), (4, 2), (4, 2), (6, 0)]
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize(("vectors", "least"), [(0, 0.995), (1_000_000, 0.98), (1_000_000_000, 0.98)])
def test_recall_at_the_bound(vectors, least):
    """Random pairs at exactly 0.9, with as many tables, probes and rotations as so many vectors get."""
    r = np.random.default_rng(0)
    x = unit(r.normal(size=(3000, 64)))
    side = r.normal(size=x.shape)
    side = unit(side - (side * x).sum(axis=1, keepdims=True) * x)
    y = 0.9 * x + np.sqrt(1 - 0.81) * side
    shape = shape_for(vectors, 64)
    a, b = bucket_codes(x, *shape), bucket_codes(y, *shape)
    met = (a == b[:, :, :1]).any(axis=(1, 2)) | (b == a[:, :, :1]).any(axis=(1, 2))
    assert met.mean() > least


def test_buckets_stay_small_however_many_vectors():
    for dims in (24, 64, 300, 1024):
        shapes = [shape_for(10**k, dims) for k in range(3, 12)]
        assert shapes == sorted(shapes)
        for k, (tables, probes, turns) in zip(range(3, 12), shapes):
            buckets = (2 * padded_width(dims)) ** turns
            # Buckets enough, or as many as codes can name.
            assert 10**k / buckets <= PER_BUCKET or buckets * 2 * padded_width(dims) > 1 << 40
            assert buckets <= 1 << 40 and tables < 256


def test_vectors_that_share_an_id_or_have_none_are_vectors_each(spark):
    schema = "vec_id long, embedding array<double>"
    for shared in (5, None):
        rows = [(shared, [1.0, 0.0, 0.0, 0.0]), (shared, [0.0, 1.0, 0.0, 0.0]), (6, [1.0, 0.01, 0.0, 0.0]), (7, [0.0, 1.0, 0.01, 0.0])]
        rows += [(8, [0.0, 0.0, 0.0, 1.0]), (8, [0.0, 0.0, 1.0, 0.0]), (8, [0.0, 0.0, 1.0, 0.0])]
        got = embedding_dedup(spark.createDataFrame(rows, schema).repartition(3)).collect()
        found = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got)
        own = shared or 0
        assert found == sorted([(own, 1, own), (own, 1, own), (6, 1, own), (7, 1, own), (8, 0, 8), (8, 1, 8), (8, 1, 8)])


def test_more_rotations_find_the_same(spark, monkeypatch):
    rows = vector_rows()
    count, component = vector_brute(rows)
    monkeypatch.setattr("ridemetrics.llm.embedding_dedup.PER_BUCKET", 1e-4)
    assert shape_for(len(rows), 24)[2] > 3
    for block in (5, 4096):
        got = embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=block).collect()
        close = sum(r.n_links for r in got) / sum(count.values())
        assert 0.97 <= close <= 1
        assert all(r.n_links <= count[r.vec_id] for r in got)


def test_exact_dedup(spark):
    texts = ["same", "same", "other", None, "", "x" * 50_000, "x" * 50_000, "x" * 49_999, "same"]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, "other", 0), (0, "same", 0)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, digest long")).collect()
    by_text = {}
    for d, t, _ in rows:
        by_text.setdefault(t or "", []).append(d)
    want = []
    for d, t, _ in rows:
        ids = by_text[t or ""]
        keep = max(i for i in ids if i is not None)
        want.append((d, keep, len(ids), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    assert sorted(((r.doc_id, r.keep_id, r.group_size, bool(r.kept), r.text_sha256) for r in got), key=key) == sorted(want, key=key)
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_exact_dedup_cuts_a_group_over_partitions(spark):
    rows = [(i, "copy" if i % 3 else f"own {i}") for i in range(3000)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    copies = got.filter("group_size > 1")
    assert copies.count() == 2000
    assert [r.doc_id for r in copies.filter("kept").collect()] == [2999]


@pytest.mark.parametrize("batch", [1, 2, 7, 1000])
def test_exact_dedup_whatever_the_batches(spark, batch):
    r = random.Random(batch)
    rows = [(i, f"text {r.choice([0, 0, 0, 1, 2, 3]) or r.randint(4, 60)}") for i in range(300)]
    # One group over several partitions, alone in some of them.
    rows += [(1000 + i, "copy") for i in range(900)] + [(None, "copy"), (None, "text 1"), (5, "text 1")]
    r.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = {}
    for d, t in rows:
        groups.setdefault(t, []).append(d)
    want = [(d or -1, max(i or -1 for i in groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows]
    assert sorted((r.doc_id or -1, r.keep_id, r.group_size, r.text_sha256) for r in got) == sorted(want)
    assert all(bool(r.kept) == (r.doc_id == r.keep_id) for r in got)


def test_exact_dedup_goes_by_neighbours_compared_whole(spark, monkeypatch):
    """Without the comparison of neighbours no copies are found; and no grouping of all rows finds them instead."""
    rows = [(i, "same") for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.group_size for r in exact_dedup(frame).collect()} == {6}
    original = exact_dedup_module._mark_runs

    def blind(batches):
        def numbered():
            for batch in batches:
                own = pa.array([f"{t}{i}" for i, t in enumerate(batch.column("text").to_pylist())])
                yield batch.set_column(batch.schema.get_field_index("text"), "text", own)

        return original(numbered())

    monkeypatch.setattr(exact_dedup_module, "_mark_runs", blind)
    assert max(r.group_size for r in exact_dedup(frame.repartition(1)).collect()) < 6
