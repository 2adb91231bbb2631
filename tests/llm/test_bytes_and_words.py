"""Removal of repeated bytes, words and lines against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ridemetrics.llm.anchors import by_bucket, repeated_places
from ridemetrics.llm.common import joined_utf8, keyed, spread_nulls, utf8_slices
from ridemetrics.llm.line_dedup import CHUNKINGS, UNION_EVERY, cover, deduped_documents, line_chunks, line_dedup
from ridemetrics.llm.substring_dedup import MATCH_SCHEMA, _extender, _find_seeds, by_name, substring_dedup
from ridemetrics.llm.suffix_array import sorted_suffixes
from ridemetrics.llm.suffix_dedup import suffix_dedup

SCHEMA = "doc_id long, text string, n_removed string"


def rows_of(seed=3):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(40)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    texts = []
    for _ in range(30):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 90))]
        if r.random() < 0.5:
            cut = r.randint(0, len(passage) // 2)
            words.insert(r.randint(0, len(words)), passage[cut : cut + r.randint(80, 300)])
        texts.append(r.choice([" ", "\n", "  "]).join(words))
    texts += [texts[0], texts[1][5:], "a" * 700, "ab " * 200, "", " \n\t ", None, "x " * 34, "x " * 36, "é" * 60]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    r.shuffle(rows)
    return rows


def suffix_brute(rows, length=100):
    seen, out = set(), {}
    for doc_id, text, _ in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[doc_id] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def substring_brute(rows, size=35):
    words = {d: re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()) for d, t, _ in rows}
    count = collections.Counter(tuple(w[i : i + size]) for w in words.values() for i in range(len(w) - size + 1))
    out = {}
    for doc_id, own in words.items():
        gone = [False] * len(own)
        for i in range(len(own) - size + 1):
            if count[tuple(own[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        kept = [w for w, g in zip(own, gone) if not g]
        out[doc_id] = (len(own), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def test_suffixes_are_in_order_with_common_prefixes():
    r = random.Random(5)
    for turn in range(60):
        letters = r.choice([b"a", b"ab", b"abc", bytes(range(256))])
        strings = [bytes(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 5))]
        strings += strings[: turn % 3]
        want, before = [], None
        for suffix, i, o in sorted((s[o:], i, o) for i, s in enumerate(strings) for o in range(len(s))):
            shared = 0
            while before is not None and shared < min(len(suffix), len(before), 9) and suffix[shared] == before[shared]:
                shared += 1
            want.append((i, o, shared))
            before = suffix
        for memory in (4, 1 << 20):  # 4: every lane spills to its file
            found = sorted_suffixes(strings, 9, memory)
            assert list(zip(*(x.tolist() for x in found))) == want


def test_suffix_dedup_equals_brute_force(spark):
    rows = rows_of()
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    want = suffix_brute(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in got)


def test_suffix_dedup_with_spilling_queues(spark):
    rows = rows_of(4)
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA), memory=50).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == suffix_brute(rows)


def test_substring_dedup_equals_brute_force(spark):
    rows = rows_of()
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == substring_brute(rows)


@pytest.mark.parametrize("operator", [suffix_dedup, substring_dedup, line_dedup])
def test_empty_table_and_null_and_repeated_rows(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    body = " ".join(f"w{i}" for i in range(80)) + "\nand\nsome\nlines\nmore\nof\nthem"
    rows = [(1, body), (1, body), (None, "short"), (2, None)]
    got = operator(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 1), (False, 2), (True, 0)]
    assert {r.n_removed for r in got} == {0}  # a row repeated whole is one document
    other = operator(spark.createDataFrame([*rows, (3, body)], "doc_id long, text string")).collect()
    assert sum(r.n_removed for r in other) > 0


def line_brute(rows):
    first, out = {}, {}
    for doc_id, text, _ in sorted(rows, key=lambda r: r[0]):
        gone = []
        for start, count, body in line_chunks(text or ""):
            if count >= 2 and first.setdefault(body, (doc_id, start)) != (doc_id, start):
                gone += range(start, start + count)
        lines = (text or "").split("\n")
        out[doc_id] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in set(gone)))
    return out


def line_rows():
    r = random.Random(9)
    block = [f"line {i} of the block" for i in range(12)]
    rows = []
    for i in range(40):
        lines = [f"own {i} {j} {r.random()}" for j in range(r.randint(1, 9))]
        if i % 2:
            at = r.randint(0, len(lines))
            lines[at:at] = block
        rows.append((i, "\n".join(lines), "clash"))
    return [*rows, (40, None, "x"), (41, "", "x"), (42, "\n\n\n\n\n\n", "x"), (43, "\n\n\n\n\n\n", "x")]


def test_line_dedup_equals_brute_force(spark):
    rows = line_rows()
    want = line_brute(rows)
    got = line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in got} == want
    assert sum(w[1] for w in want.values()) > 100


def test_chunks_are_the_text_and_shift_with_it():
    text = line_rows()[1][1]
    assert "\n".join(c[2] for c in line_chunks(text)) == text
    bodies = {c[2] for c in line_chunks(text)}
    shifted = {c[2] for c in line_chunks("one more line\n" + text)}
    assert len(bodies & shifted) >= len(bodies) - 2


def test_deduped_documents_keep_columns(spark):
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, cuts string")
    got = deduped_documents(docs)
    assert got.columns == docs.columns
    want = line_brute(rows)
    assert {r.doc_id: r.text or "" for r in got.collect()} == {d: w[2] for d, w in want.items()}


def test_union_of_chunkings_finds_repeated_runs(spark):
    r = random.Random(17)
    rows, planted = [], []
    for i in range(60):
        passage = [f"passage {i} {j}" for j in range(r.randint(2, 6))]
        for turn in range(2):
            own = [f"own {i} {turn} {j}" for j in range(r.randint(2, 8))]
            at = r.randint(0, len(own))
            rows.append((2 * i + turn, "\n".join(own[:at] + passage + own[at:]), "x"))
            planted.append((2 * i + turn, own, passage))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {x.doc_id: x for x in line_dedup(docs, every=UNION_EVERY, chunkings=CHUNKINGS).collect()}
    found = wanted = 0
    for doc_id, own, passage in planted:
        kept = got[doc_id].kept_text.split("\n")
        assert [x for x in kept if x.startswith("own")] == own
        gone = sum(x not in kept for x in passage)
        assert gone == (got[doc_id].n_removed if doc_id % 2 else 0)
        found += gone
        wanted += len(passage) * (doc_id % 2)
    assert found >= 0.95 * wanted
    assert sum(x.n_removed for x in line_dedup(docs).collect()) < 0.5 * wanted


def test_a_cover_holds_the_lines_of_all():
    r = random.Random(2)
    for _ in range(300):
        spans = [{"first_line": r.randint(0, 30), "n_lines": r.randint(2, 6)} for _ in range(r.randint(1, 12))]
        lines = [{i for s in part for i in range(s["first_line"], s["first_line"] + s["n_lines"])} for part in (spans, cover(spans))]
        assert lines[0] == lines[1]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_slices_hold_all_rows_and_their_bytes(kind):
    texts = ["ab", "", "é" * 20, "c", "", "dd" * 9, "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts, kind)], ["id", "text"])
    for limit in (1, 10, 25, 1000):
        seen = []
        for part in utf8_slices(iter([batch.slice(0, 0), batch]), limit=limit):
            data, offsets = joined_utf8(part.column("text"))
            cut = [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])]
            assert cut == part.column("text").to_pylist()
            assert sum(len(t.encode()) for t in cut) <= limit or len(cut) == 1
            seen += cut
        assert seen == texts


def test_a_hot_phrase_is_spread_over_buckets(spark):
    """A phrase in every document, longer than a seed and shorter than a window, with other words around it each time."""
    r = random.Random(7)
    phrase = " ".join(f"p{i}" for i in range(12))
    rows = []
    for i in range(300):
        around = [" ".join(f"w{r.randrange(10**6)}" for _ in range(30)) for _ in range(2)]
        rows.append((i, f"{around[0]} {phrase} {around[1]}", "x"))
    rows += [(1000, rows[3][1] + " more", "x"), (1001, "before " + rows[3][1], "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(frame).collect()}
    assert got == substring_brute(rows)
    # What meets in one bucket is a share of the windows at the phrase's seeds.
    keyed_rows = spread_nulls(keyed(frame, "doc_id", "text"))
    texts = by_bucket(keyed_rows, 17)
    asked = repeated_places(keyed_rows, _find_seeds(35, 8), 17)
    windows = texts.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_extender(35, 8, 17), MATCH_SCHEMA)
    sizes = [n // 8 for _, n in windows.groupBy("bucket").agg(F.sum(F.octet_length("names"))).collect()]
    assert sum(sizes) > 2000 and max(sizes) < 2 * sum(sizes) / 17


def test_names_are_told_apart_by_both_halves():
    names = np.array([5, 7, 5, 5, 7], np.uint64)
    checks = np.array([1, 2, 3, 1, 2], np.uint64)
    order, begin = by_name(names, checks)
    groups = [sorted(g.tolist()) for g in np.split(order, begin[1:])]
    assert sorted(groups) == [[0, 3], [1, 4], [2]]
    assert [len(x) for x in by_name(names[:0], checks[:0])] == [0, 0]


def test_documents_without_ids_are_spread(spark):
    rows = [(None, f"text {i} " + "same words again and again " * 10, "x") for i in range(60)] + [(-5, "same words again and again " * 10, "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    buckets = by_bucket(spread_nulls(keyed(frame, "doc_id", "text")), 17)
    assert buckets.select("bucket").distinct().count() > 10
    got = suffix_dedup(frame).collect()
    assert sorted(r.doc_id is None for r in got) == [False] + [True] * 60
    # All but one have their repeated part cut; the row with an id comes after those without.
    assert sum(r.n_removed > 150 for r in got) == 61 and [r.n_removed for r in got if r.doc_id == -5] == [270]
    words = substring_dedup(frame).collect()
    assert sum(r.doc_id is None for r in words) == 60 and all(r.n_removed >= 48 for r in words)
