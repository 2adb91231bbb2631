"""Quality classifier and language model: learning, held-out results, odd rows."""

import collections
import math
import random
import re
import zlib

import numpy as np

from ridemetrics.llm import lm_scoring, quality


def quality_rows(n=400):
    r = random.Random(1)
    vocabulary = ["".join(r.choice("aeinorst") for _ in range(r.randint(2, 8))) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(5, 400))]
        good = i % 4 != 0
        if not good:
            words = [w + r.choice(["$$$", "%%%", "***"]) for w in words]
        rows.append((i, " ".join(words), float(i)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_gradients_are_derivatives():
    texts = [b"some text of one", b"$$$ *** other " * 90, b""]
    layout = quality.Layout(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    model = {k: v.astype(np.float64) for k, v in quality.new_model(1).items()}
    model["out"] = np.random.default_rng(0).normal(size=model["out"].shape)
    target, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss(m):
        p = quality.probability(m, quality.pooled(m, layout)[0])
        return -(weight * np.log(np.where(target > 0, p, 1 - p))).sum() / weight.sum()

    grad = quality.gradients(model, layout, target, weight)
    r = np.random.default_rng(2)
    for name in model:
        for _ in range(6):
            at = tuple(r.integers(0, s) for s in model[name].shape)
            if name == "table":
                at = (int(r.choice([101, 36, 256, 32])), at[1])
            up = {k: v.copy() for k, v in model.items()}
            down = {k: v.copy() for k, v in model.items()}
            up[name][at] += 1e-4
            down[name][at] -= 1e-4
            assert abs((loss(up) - loss(down)) / 2e-4 - grad[name][at]) < 2e-3, (name, at)


def test_whole_text_counts():
    model = quality.train([b"plain words here " * 30, b"$$$ " * 100] * 20, np.array([1, 0] * 20), updates=60)
    score = lambda *t: quality.probability(
        model, quality.pooled(model, quality.Layout(np.frombuffer(b"".join(t), np.uint8), np.cumsum([0, *map(len, t)])))[0]
    )
    plain = b"plain words here " * 3000
    assert score(plain)[0] != score(plain + b"$$$ " * 300)[0]
    # A score does not depend on the texts beside it.
    assert np.allclose(score(plain, b"$$$ ", b"")[0], score(plain)[0], atol=1e-5)


def test_quality_learns_and_holds_out(spark):
    rows, labels = quality_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, marks, updates=120).collect()
    assert len(got) == len(rows)
    truth = {d: q for d, q, _ in labels}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    kept = quality.good_documents(docs, marks, updates=120)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}
    # Held-out labels do not matter.
    other = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, t) for d, q, t in labels]
    again = quality.quality_scores(docs, spark.createDataFrame(other, marks.schema), updates=120).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in got}


def test_quality_of_odd_rows(spark):
    rows = [(None, "text"), (1, None), (2, ""), (3, "x" * 300_000), (4, "y"), (4, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    got = quality.quality_scores(docs, marks, updates=3).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 2, 3, 4, 4]
    none = quality.quality_scores(docs, marks.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.quality_scores(docs.limit(0), marks, updates=3).count() == 0


def lm_rows():
    r = random.Random(3)
    vocabulary = ["".join(r.choice(["th", "er", "on", "st", "É"]) for _ in range(r.randint(1, 4))) for _ in range(150)]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 300))), 0.0) for i in range(200)]
    return [*rows, (900, None, 0.0), (901, " \t", 0.0), (902, "\x00 \x01 zz", 0.0), (None, "the end", 0.0), (7, rows[7][1], 0.0)]


def test_lm_base_and_score(spark):
    rows = lm_rows()
    got = lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string, score double")).collect()
    assert len(got) == len(rows)
    tokens = lambda t: [*(t or "").encode().lower().split(), "end"]
    learnt = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 != 0
    count = collections.Counter(w for d, t, _ in rows if learnt(d) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    text_of = {d: t for d, t, _ in rows}
    for r in got:
        own = tokens(text_of[r.doc_id])
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[w] > 0 for w in own), n)
        assert r.held_out == (not learnt(r.doc_id))
        assert r.score < 0
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in held) > 1.6 * sum(r.base_score for r in held)


def brute_bits(learnt, text, trees):
    """Bits of each word of a text, step by step, with contexts as they are and none hashed."""
    starts, lengths, nodes, bits = trees

    def steps(text):
        data = b"\n" * 5 + b" ".join(text.lower().split()) + b"\n"
        for i in range(5, len(data)):
            pair = data[i - 1] << 8 | data[i]
            word = re.search(rb"[^ \n]*$", data[:i])[0]
            for node, bit in zip(nodes[starts[pair] :][: lengths[pair]], bits[starts[pair] :]):
                yield i - 5, [(data[i - 3 : i], node), (data[i - 5 : i], node), (word, node)], int(bit)

    counts = [collections.defaultdict(lambda: [0, 0]) for _ in range(3)]
    for other in learnt:
        for _, contexts, bit in steps(other):
            for table, context in zip(counts, contexts):
                table[context][bit] += 1
    weights = lm_scoring.start_weights().astype(float)
    last = np.zeros(16)
    stretches = collections.defaultdict(list)
    for i, contexts, bit in steps(text):
        stretches[int(math.log2((i >> 6) + 1))].append((i, contexts, bit))
    out = collections.Counter()
    coded = b" ".join(text.lower().split()) + b"\n"
    for stretch in sorted(stretches):
        step_w, change, step_l, seen = np.zeros((16, 3)), np.full(16, 4.0), np.zeros(16), np.full(16, 20.0)
        for i, contexts, bit in stretches[stretch]:
            pairs = [table[context] for table, context in zip(counts, contexts)]
            x = np.array([np.clip(np.rint(4 * math.log((one + 0.4) / (zero + 0.4))), -32, 31) for zero, one in pairs])
            sure = [sum(zero + one > limit for limit in (0.5, 3.5, 30.5)) for zero, one in pairs]
            gate = 4 * sure[1] + sure[2]
            mixed = (weights[gate] * x).sum() / 4
            own = int(np.clip(mixed + 8.5, 0, 15))
            sign = 2 * bit - 1
            odds = math.exp(-np.clip(mixed + last[own], -11, 11) * sign)
            out[sum(coded[:i].count(c) for c in b" \n")] += math.log2(1 + odds)
            error = odds / (1 + odds)
            step_w[gate] += error * sign * x
            seen[gate] += 1
            step_l[own] += error * sign
            change[own] += error * (1 - error)
        weights += lm_scoring.RATE * step_w / (4 * np.sqrt(seen))[:, None]
        last += lm_scoring.RATE_LAST * step_l / change
    return np.array([out[k] for k in sorted(out)])


def brute_score(rows, text, trees):
    """log10 probability of a text by the model that learns from `rows`."""
    learnt = [(t or "").encode() for d, t, _ in rows if d is not None and zlib.crc32(str(d).encode()) % 10]
    count = collections.Counter(w for t in learnt for w in t.lower().split())
    total = sum(count.values()) + len(learnt)
    end = len(learnt) / total
    words = text.encode().lower().split()
    score = gain = 0.0
    for k, bits in enumerate(brute_bits(learnt, text.encode(), trees)):
        if words:
            c = count[words[k]]
            counted = c / (total - len(learnt)) * (end if k == len(words) - 1 else 1 - end)
            start = lm_scoring.WORD_START[sum(c > limit for limit in lm_scoring.WORD_STEPS)]
        else:
            counted, start = end, 0.5
        weight = 0.0
        if counted and start:
            weight = 1 / (1 + (1 / start - 1) * math.exp(-np.clip(lm_scoring.WORD_RATE * gain, -4, 4)))
            gain += math.log(counted) + bits * math.log(2)
        score += math.log10((1 - weight) * 2**-bits + weight * counted)
    return score


def test_lm_score_equals_brute_force(spark):
    rows = [(i, t[:200], x) for i, t, x in lm_rows()[:12]] + [(30, None, 0.0), (33, "Thon  thon\nÉ", 0.0)]
    got = {r.doc_id: r for r in lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string, x double")).collect()}
    pairs = np.zeros((256, 256), np.int64)
    for d, t, _ in rows:
        if zlib.crc32(str(d).encode()) % 10:
            data = b"\n" + b" ".join((t or "").encode().lower().split()) + b"\n"
            for a, b in zip(data, data[1:]):
                pairs[a, b] += 1
    trees = lm_scoring.code_trees(pairs)
    assert {r.held_out for r in got.values()} == {True, False}
    for d, t, _ in rows:
        assert abs(got[d].score - brute_score(rows, t or "", trees)) < 2e-3 * abs(got[d].score), d


def test_lm_is_a_probability():
    # Over all continuations of one step the odds add up: every byte has a path and paths share no end.
    pairs = np.random.default_rng(0).integers(0, 3, (256, 256)) ** 5
    starts, lengths, nodes, bits = trees = lm_scoring.code_trees(pairs)
    for before in (0, 10, 101, 255):
        own = [(s, n) for s, n in zip(starts[before << 8 :][:256].tolist(), lengths[before << 8 :][:256].tolist())]
        assert abs(sum(2.0**-n for _, n in own) - 1) < 1e-12
        assert len({tuple(zip(nodes[s : s + n].tolist(), bits[s : s + n].tolist())) for s, n in own}) == 256
    tables = [np.zeros(1 << w, np.uint8) for w in lm_scoring.TABLE_BITS]
    # With nothing learnt a text of one byte and the end costs its code's length.
    cost, doc = lm_scoring.bits_of([b"e", b"", b"e e"], tables, lm_scoring.Coder(trees))
    step = lambda a, b: lengths[ord(a) << 8 | ord(b)]
    assert np.allclose(cost, [
        step("\n", "e") + step("e", "\n"), step("\n", "\n"), step("\n", "e") + step("e", " "), step(" ", "e") + step("e", "\n"),
    ])
    assert doc.tolist() == [0, 1, 2, 2]


def test_lm_word_mix_is_a_probability():
    # Two words seen 6 and 2 times, 4 ends: word and end of text, or word and more, add up to what the bits leave.
    counts = np.array([6, 2, 6, 2])
    last = np.array([True, True, False, False])
    bits = np.full(4, 3.0)
    parts = 10 ** lm_scoring.mixed_words(bits, np.arange(4), counts, last, 12, 4)
    weight = lm_scoring.WORD_START[[3, 2, 3, 2]]
    assert np.allclose(parts, (1 - weight) / 8 + weight * [0.75 / 3, 0.25 / 3, 0.75 * 2 / 3, 0.25 * 2 / 3])
    # A word of any length has a finite score.
    assert np.isfinite(lm_scoring.mixed_words(np.array([1e6]), np.zeros(1, int), np.zeros(1, int), np.array([True]), 12, 4)).all()


def test_lm_scores_do_not_depend_on_neighbours():
    tables = [lm_scoring.quantise(np.random.default_rng(k).integers(0, 9, 2 << w)) for k, w in enumerate(lm_scoring.TABLE_BITS)]
    texts = [b"The first text of them", b"", b"another " * 400, b"q"]
    coder = lm_scoring.Coder(lm_scoring.code_trees(np.ones((256, 256), np.int64)))
    alone = [lm_scoring.bits_of([t], tables, coder)[0].sum() for t in texts]
    bits, doc = lm_scoring.bits_of(texts, tables, coder)
    assert np.allclose(np.bincount(doc, bits), alone, rtol=1e-4)


def test_lm_of_nothing(spark):
    assert lm_scoring.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    got = lm_scoring.lm_scores(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert {(r.train_tokens, r.n_known) for r in got} == {(0, 0)}


def test_steps_tell_the_byte_they_are_of():
    coder = lm_scoring.Coder(lm_scoring.code_trees(np.ones((256, 256), np.int64)))
    steps = lm_scoring.Steps([b"ab", b"", b"c" * 200], coder)
    # Bytes of the first stretches, each text's last one after the others.
    n = np.bincount(steps.of_byte)
    assert len(n) == 3 + 1 + 201 and n.min() > 0 and (np.diff(steps.of_byte) >= 0).all()
    assert len(steps.of_byte) == len(steps.bit) == steps.edges[-1]
    assert lm_scoring.picked(np.array([3, 5]), np.array([1, 0, 1])).tolist() == [5, 3, 5]
