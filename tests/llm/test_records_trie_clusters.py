"""Token records, the conversation trie and clustering against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ridemetrics.llm.lloyd import LARGEST, lloyd_clusters, scaled
from ridemetrics.llm.prefix_trie import end_hashes, prefix_trie
from ridemetrics.llm.token_records import END_BLOCK, frame, frames, read_index, read_shuffled, record_digests, write_records

PATH = public_tokenizers.path("word_bpe_49k.json")


def record_rows():
    r = random.Random(5)
    texts = [" ".join(r.choice(["tree", "Été", "42", "so-so", "日本"]) for _ in range(r.randint(0, 300))) for _ in range(60)]
    rows = [(i * 7 - 100, t, "clash") for i, t in enumerate(texts)]
    rows += [(900, None, "x"), (901, "", "x"), (902, " \n ", None), (None, "no id", "x"), (None, None, "x")]
    rows += [(7, "again and again", "x")] * 30 + [(903, "long " * 60_000, "x")]
    r.shuffle(rows)
    return rows


def encoded(rows):
    tokenizer = Tokenizer.from_file(PATH)
    return [
        (d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for d, t, _ in rows
    ]


def test_records_round_trip(spark, tmp_path):
    rows = record_rows()
    path = str(tmp_path / "records")
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(5)
    # Small blocks: several files per shard, several blocks per file.
    write_records(docs, path, PATH, block_bytes=2000, file_blocks=2)
    got = sorted(record_digests(spark, path).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    place = 0
    for r in got:
        assert r.start == place
        place += r.n_tokens
    want = collections.Counter((d, len(i), zlib.crc32(i.tobytes())) for d, i in encoded(rows))
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    index = read_index(spark, path)
    assert sorted(tuple(r) for r in index.select("start", "n_tokens").collect()) == [(r.start, r.n_tokens) for r in got]
    assert index.select("shard", "file").distinct().count() > 5


def test_shuffled_reads_follow_the_index(spark, tmp_path):
    rows = record_rows()
    path = str(tmp_path / "records")
    write_records(spark.createDataFrame(rows, "doc_id long, text string, x string"), path, PATH, block_bytes=5000)
    want = collections.Counter((d, i.tobytes()) for d, i in encoded(rows))

    def read(seed, part=0, parts=1):
        return [(r.doc_id, np.array(r.ids, "<u4").tobytes()) for r in read_shuffled(spark, path, seed, part, parts).collect()]

    once = read(1)
    assert collections.Counter(once) == want
    assert once == read(1) != read(2)
    assert [d for d, _ in once] != sorted((d for d, _ in once), key=lambda d: d or 0)
    parts = [read(1, k, 3) for k in range(3)]
    assert all(parts) and collections.Counter(sum(parts, [])) == want


def test_frames_and_damage():
    # The layout, written out once by hand.
    mask = lambda d: (((zlib.crc32(d) >> 15) | (zlib.crc32(d) << 17)) + 0xA282EAD8) & 0xFFFFFFFF
    length = (3).to_bytes(8, "little")
    assert frame(b"abc") == length + mask(length).to_bytes(4, "little") + b"abc" + mask(b"abc").to_bytes(4, "little")
    content = frame(b"one") + END_BLOCK + frame(b"three") + END_BLOCK
    assert [(at, bytes(p)) for at, p in frames(content, "f")] == [(0, b"one"), (35, b"three")]
    for at in range(len(content)):
        bad = bytearray(content)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            list(frames(bytes(bad), "f"))
    with pytest.raises(ValueError, match="cut short"):
        list(frames(content[:-5], "f"))


def test_records_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    write_records(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert record_digests(spark, path).count() == 0
    assert read_index(spark, path).count() == 0
    assert read_shuffled(spark, path, 1).count() == 0


def trie_brute(rows):
    """Every node from every prefix of every rebuilt conversation, as whole tuples."""
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[conv].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c > 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = collections.defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0d]+", p[-1][1])) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(path))))
        out.append((
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), children[path],
            sum(1 for p in below if not children[p]), saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def trie_rows(seed):
    r = random.Random(seed)
    rows = []
    stem = [("user", "one very common first turn"), ("assistant", "and \t its answer"), (None, None)]
    for c in [*range(-25, 70), 10**12, 400, 433]:
        turns = stem[: r.randint(0, 3)] + [(r.choice(["user", "tool"]), r.choice(["a b", "", "c"])) for _ in range(r.randint(0, 4))]
        for t, (role, text) in enumerate(turns):
            rows.append((c, t if r.random() < 0.95 else None, role, text))
    # Long ones that part late, one inside another, equal ones, and turns that tie.
    long = [("user", f"turn {i}") for i in range(40)]
    for c, turns in ((100, long), (120, long[:30] + [("user", "else")]), (140, long[:35]), (160, long), (180, long[:1])):
        rows += [(c, t, *x) for t, x in enumerate(turns)]
    rows += [(200, 3, "b", "x"), (200, 3, "a", "x"), (200, 3, "a", "x"), (None, 0, "user", "of no conversation")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    rows = trie_rows(seed)
    frame = spark.createDataFrame([(*row, 1, "x") for row in rows], "conv_id long, turn long, role string, text string, depth long, key string")
    got = prefix_trie(frame.repartition(5)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == trie_brute(rows)


def test_trie_of_turnless_and_no_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    # 13 takes at least one turn from conversation 0, which is not there.
    taken = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    got = prefix_trie(spark.createDataFrame([(taken, 0, "user", "gone")], schema)).collect()
    ends = hashlib.sha256(str(taken).encode()).hexdigest()
    assert [tuple(r) for r in got] == [(taken, 0, None, 1, 0, 1, 0, ends)]
    assert prefix_trie(spark.createDataFrame([], schema)).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 0, "user", "x")], schema)).count() == 0


def test_end_lists_longer_than_one_row(spark):
    rows = [(b"hot", i) for i in range(20_000)] + [(b"two", -5), (b"two", 3), (b"one", 9)]
    got = {bytes(r.key): r.ends_sha256 for r in end_hashes(spark.createDataFrame(rows, "key binary, conv_id long").repartition(7)).collect()}
    text = {b"hot": ",".join(map(str, range(20_000))), b"two": "-5,3", b"one": "9"}
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in text.items()}


def lloyd_brute(rows, dims, clusters=8, rounds=10):
    kept = [
        (i, [int(np.floor(1024 * float(x))) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and None not in v and np.isfinite(v).all()
    ]
    order = sorted(range(len(kept)), key=lambda k: (hashlib.sha256(f"3:{kept[k][0]}".encode()).hexdigest(), kept[k][1]))
    centroids = [kept[k][1] for k in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        for k, vs in groups.items():
            centroids[k] = [sum(column) // len(vs) for column in zip(*vs)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = collections.Counter()
    for _, k, d in found:
        inertia[k] += d
    return [
        (i, k, d, inertia[k], inertia.total(), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest())
        for i, k, d in found
    ]


def lloyd_rows(dims, n=120):
    r = np.random.default_rng(dims)
    centres = r.normal(size=(5, dims))
    rows = [(int(i) - 20, (centres[i % 5] + 0.4 * r.normal(size=dims)).tolist()) for i in range(n)]
    rows += [(500 + i, rows[0][1]) for i in range(40)]  # equal vectors
    rows += [(501, rows[1][1]), (501, rows[0][1])]  # an id with other vectors
    odd = [None, [], [0.0] * (dims - 1), [float("nan")] + [0.0] * (dims - 1), [float("-inf")] + [0.0] * (dims - 1)]
    odd += [[None] + [0.0] * (dims - 1), [0.0] * dims, [-0.5] * dims]
    return rows + [(900 + i, v) for i, v in enumerate(odd)]


@pytest.mark.parametrize(("dims", "block_dims"), [(64, 16), (10, 4)])
def test_clusters_equal_brute_force(spark, dims, block_dims):
    rows = lloyd_rows(dims)
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int")
    got = lloyd_clusters(frame.repartition(3), dims=dims, block_dims=block_dims)
    assert sorted(tuple(r) for r in got.collect()) == sorted(lloyd_brute(rows, dims))


def test_few_vectors_no_vectors_and_null_ids(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(4, [0.25, -0.3]), (None, [5.0, 5.0]), (4, [0.25, -0.3])]
    got = lloyd_clusters(spark.createDataFrame(rows, schema), dims=2).collect()
    assert sorted((r.vec_id or 0, r.distance) for r in got) == [(0, 0), (4, 0), (4, 0)]
    assert {r.inertia for r in got} == {0}
    # Equal centroids: the one with the smaller number wins.
    assert len({r.cluster for r in got if r.vec_id == 4}) == 1
    assert lloyd_clusters(spark.createDataFrame([], schema)).count() == 0
    assert lloyd_clusters(spark.createDataFrame([(1, None), (2, [1.0])], schema)).count() == 0


def test_components_beyond_exact_distances():
    assert scaled(np.array([LARGEST / 1024]))[0] == LARGEST
    with pytest.raises(ValueError, match="64 bits"):
        scaled(np.array([1e9]))
