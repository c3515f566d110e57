import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa

from corpusgraph.llm import quality as Q


def test_held_out_accuracy_and_labels_are_not_learnt_from(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in Q.op8_quality(spark, d).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    out = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert np.mean([p == y for p, y in out]) >= 0.97
    good = [p for p, y in out if y == 1]
    assert np.mean(good) >= 0.99


def test_a_step_gives_the_same_features_as_the_whole():
    texts = ["a b c", "", None, "OF!! THE!!", "x " * 5000, "one"]
    def by_text(column):
        out = {}
        for at, f in Q.features(column):
            for t, x in zip(at, f, strict=True):
                out.setdefault(int(t), []).append(int(x))
        return out

    whole = by_text(pa.array(texts))
    alone = {i: v for i, t in enumerate(texts) for v in [by_text(pa.array([t])).get(0)] if v}
    assert whole == alone


def test_dual_coordinate_descent_separates_and_odd_inputs(spark):
    texts = [np.array([1, 2]), np.array([1, 3]), np.array([4, 2]), np.array([4, 3])]
    w, b = Q.fit(texts, np.array([1, 1, 0, 0]))
    assert [w[t].sum() / np.sqrt(2) + b > 0 for t in texts] == [True, True, False, False]
    docs = spark.createDataFrame([(1, None, 9.0), (None, "x", 9.0), (2, "", 9.0), (2, "", 9.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id long, quality int")
    got = Q.judge_quality(docs, labels).collect()
    assert len(got) == 4 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    assert Q.judge_quality(docs.limit(0), labels.limit(0)).count() == 0


def feature_sets(*texts):
    import pyarrow as pa

    out = [set() for _ in texts]
    for at, f in Q.features(pa.array(texts, pa.string())):
        for i, x in zip(at.tolist(), f.tolist(), strict=True):
            out[i].add(x)
    return out


def test_every_byte_of_a_word_counts():
    x, y = "a" * 8 + "p" * 3000 + "b" * 8, "a" * 8 + "p" * 1500 + "q" + "p" * 1499 + "b" * 8
    a, b, c, d = feature_sets(x, y, "one two", "one twp")
    assert a != b and c != d
    chinese = "".join(chr(0x4E00 + i * 7 % 3000) for i in range(800))
    whole, half, none = feature_sets(chinese, chinese[:400], "")
    assert len(whole) > 1500 and half < whole | half and len(half - whole) < 10 and not none


def test_fit_against_a_second_solver():
    """The dual solved by projected gradient steps of a dense matrix."""
    rng = np.random.default_rng(1)
    y = np.where(rng.random(40) < 0.4, 1, 0)
    texts = [np.unique(np.concatenate([rng.integers(0, 60, 12), [100 + 7 * v, 200 + rng.integers(0, 9)]])) for v in y]
    w, bias = Q.fit(texts, y)
    n = 1 << Q.BITS
    sign = np.where(y == 1, 1.0, -1.0)
    count = {s: np.bincount(np.concatenate([t for t, c in zip(texts, sign, strict=True) if c == s]), minlength=n) + Q.SMOOTHING for s in (1.0, -1.0)}
    ratio = np.log(count[1.0] / count[1.0].sum()) - np.log(count[-1.0] / count[-1.0].sum())
    dense = np.zeros((len(y), n + 1))
    for i, t in enumerate(texts):
        dense[i, t], dense[i, n] = ratio[t] / np.sqrt(len(t)), 1.0
    gram = (dense * sign[:, None]) @ (dense * sign[:, None]).T
    most = Q.COST * len(y) / (2.0 * np.where(sign > 0, (sign > 0).sum(), (sign < 0).sum()))
    alpha = np.zeros(len(y))
    step = 1.0 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(200_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1.0), 0.0, most)
    want = (alpha * sign) @ dense
    assert np.abs(w - want[:n] * ratio).max() < 0.02 and abs(bias - want[n]) < 0.02


def test_bounds_of_the_sample_and_repeated_ids(spark):
    docs = spark.createDataFrame([(i, ("good plain words here " if i % 2 else "BAD!!! $$$ junk 123 ") * 3) for i in range(40)] + [(1, "other text")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    again = Q.train(docs, labels), Q.train(docs.repartition(7), labels)
    assert np.allclose(again[0][0], again[1][0]) and again[0][1] == again[1][1]
    w, bias = Q.train(docs, labels, most_features=0)
    assert not w.any() and bias == 0.0


M64 = (1 << 64) - 1


def word_hash(word):
    """As hash_words: eight bytes at a time, or BLAKE2 of a longer word."""
    if len(word) > 64:
        return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")

    def mix(x):
        x = ((x ^ x >> 32) * 0xD6E8FEB86659FD93) & M64
        x = ((x ^ x >> 29) * 0x9E3779B97F4A7C15) & M64
        return x ^ x >> 32

    h = mix(len(word) * 0x9E3779B97F4A7C15 & M64)
    for i in range(0, len(word), 8):
        h = mix((h ^ int.from_bytes(word[i : i + 8], "little")) * 0xD6E8FEB86659FD93 & M64)
    return h


def plain_features(text):
    """The features of one text, worked out word by word in whole numbers."""
    one, two = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

    def mix(x):
        x = ((x ^ x >> 29) * two) & M64
        return x ^ x >> 32

    def kind(c):
        return ord("a") if 0x61 <= c < 0x7B else ord("A") if 0x41 <= c < 0x5B else ord("0") if 0x30 <= c < 0x3A else 0x80 if c >= 0x80 else c

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    w = [word_hash(x) for x in words]
    s = []
    for i, x in enumerate(words):
        shape = kind(x[0]) | (i > 0 and w[i] == w[i - 1]) << 40
        for back in (1, 2, 3):
            shape |= kind(x[max(len(x) - back, 0)]) << 8 * back
        s.append(mix(shape * one & M64))
    pairs, threes = range(len(w) - 1), range(len(w) - 2)
    grams = [*w, *(mix(w[i] * one + w[i + 1] & M64) for i in pairs), *(x + 1 & M64 for x in s), *(mix(s[i] * one + s[i + 1] + 2 & M64) for i in pairs)]
    grams += [mix(mix(s[i] * one + s[i + 1] & M64) * one + s[i + 2] + 3 & M64) for i in threes]
    grams += [mix(int.from_bytes(x[i : i + 6], "little") * one + 4 & M64) for x in words if len(x) > 24 for i in range(len(x) - 5)]
    return {(g * two & M64) >> 46 for g in grams}


def test_features_and_scores_against_plain_python(spark):
    texts = ["The cat THE cat cat 42!", "", None, "a", "b b", "naïve Größe 東京東京東京東京東京東京", "x" * 30 + " " + "y" * 65, "\t tab\x0bsep\x85not ", "l" + "o" * 200 + "ng", "Wörter: ja, nein; ja."]
    assert feature_sets(*texts) == [plain_features(t) for t in texts]
    weights, bias = np.random.default_rng(4).normal(size=1 << Q.BITS).astype(np.float32), 0.25
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in Q.score_texts(docs, (weights, bias)).collect():
        own = sorted(plain_features(r.text))
        margin = float(np.sum(weights[own].astype(float))) / max(1, len(own)) ** 0.5 + bias
        assert abs(r.score - 1 / (1 + np.exp(-2 * margin))) < 1e-9
