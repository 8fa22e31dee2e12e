import hashlib
import random

import numpy as np
import pytest

from codeloom.llm import handwritten as H

WORDS = "alpha beta gamma delta order price total count index value items cache store queue frame".split()


def hand(rng):
    out = ["import os\n"]
    for _ in range(rng.randrange(2, 6)):
        a, b, c = (rng.choice(WORDS) for _ in range(3))
        out.append(f"def {a}_{b}({c}, limit={rng.randrange(4000)}):\n    \"\"\"{' '.join(rng.choices(WORDS, k=8))}\"\"\"\n    out = []\n    for v in {c}:\n        if v > limit:\n            out.append({b}(v))\n    return out\n")
    return "\n".join(out)


def generated(rng, header=True):
    head = rng.choice(["# Code generated by tool. DO NOT EDIT.\n", "# Machine-written, do not modify.\n"]) if header else ""
    return head + "class X(object):\n    __slots__ = ('_v',)\n" + "".join(f"    def get_{rng.choice(WORDS)}_{i}(self):\n        return self._v[{i}]\n" for i in range(rng.randrange(8, 30)))


def minified(rng):
    return "".join(f"function {rng.choice('abcdef')}{i}(e,t){{return e>t?e-{i}:t+{i}}}var {rng.choice('xyz')}{i}={{k:{i}}};" for i in range(60))


def data(rng):
    return "TABLE = [\n" + "".join(f"{rng.randrange(10**5)}, {rng.randrange(10**5)}, {rng.randrange(10**5)},\n" for _ in range(60)) + "]\n"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    release = [hand(random.Random(1000 + k)) for k in range(6)]
    rows, truth, symbols = [], {}, []
    for i in range(420):
        repo, kind = f"r{i % 23}", rng.choice(["hand"] * 6 + ["generated", "bare", "minified", "data", "vendored", "edited"])
        text = {"hand": hand, "generated": generated, "bare": lambda r: generated(r, False), "minified": minified, "data": data, "vendored": lambda r: r.choice(release), "edited": lambda r: r.choice(release).replace("import os", "import os  \nimport sys", 1)}[kind](rng)
        rows.append((i, repo, f"{repo}/src/{rng.choice(WORDS)}.{'js' if kind == 'minified' else 'py'}", text))
        truth[i] = kind != "hand"
        if kind == "hand":
            symbols.append((i,))
    odd = [(900, "r1", "r1/a.py", None), (901, "r1", None, ""), (902, "r2", "r2/vendor/generated.min.py", "# generated by hand, do not edit\n"), (903, None, "x.py", hand(rng) + "\n# DO NOT EDIT\n")]
    tree = spark.createDataFrame(rows + odd, "file_id long, repo string, path string, content string")
    packages = spark.createDataFrame([("p", "1", f"f{k}.py", "python", hashlib.sha256(t.encode()).hexdigest().upper()) for k, t in enumerate(release)] + [("p", "1", "x", "python", None)], "package string, version string, file_name string, language string, content_hash string")
    files = spark.createDataFrame([(r[0], hashlib.sha256(r[3].encode()).hexdigest() if r[3] is not None else None) for r in rows + odd], "id long, content_hash string")
    return tree, files, spark.createDataFrame(symbols, "file_id long"), packages, truth


def test_finds_all_kinds(spark, corpus):
    tree, files, symbols, packages, truth = corpus
    detector = H.learn(tree, files, symbols, packages)
    got = {r.file_id: r for r in detector.apply(tree, packages).collect()}
    assert len(got) == len(truth) + 4
    found = {i for i, r in got.items() if r.kind}
    want = {i for i, t in truth.items() if t}
    assert len(found & want) >= 0.97 * len(want) and len(found - want) <= 0.02 * len(truth)
    assert not {900, 901, 902} & found
    assert all(m.precision >= 0.9 and m.recall >= 0.9 for m in detector.machines.values())
    assert detector.machines["vendored"].gate_recall == 1


def test_empty_and_untrainable(spark, corpus):
    tree, files, symbols, packages, _ = corpus
    none = H.learn(tree.limit(0), files, symbols, packages).apply(tree.limit(0), packages)
    assert none.count() == 0
    few = H.learn(tree.where("file_id = 900"), files, symbols, packages.limit(0)).apply(tree.where("file_id < 3"), packages.limit(0))
    assert {r.kind for r in few.collect()} == {None}


def test_batch_scores_equal_single_scores():
    rng = random.Random(2)
    texts = ["", "a", "ab", "abcd", hand(rng), generated(rng), "é" * 9, minified(rng)]
    paths = [f"r/d/n{i}.py" for i in range(len(texts))]
    weights = np.random.default_rng(1).normal(size=(1 << H.BITS, 2)).astype(np.float32)
    got = H.score_files(paths, texts, weights)
    for i, (p, t) in enumerate(zip(paths, texts)):
        x, v = H.features(p, t)
        assert got[i] == pytest.approx(weights[x].T @ v, rel=1e-3, abs=1e-3)


def _sketched(spark, texts, first=0):
    rows = []
    for i, t in enumerate(texts):
        x = H.shingles(t)
        rows.append((first + i, hashlib.sha256(x.tobytes()).hexdigest() if len(x) else None, x.view(np.int64).tolist(), H.band_keys(x).tolist() if len(x) else None))
    return spark.createDataFrame(rows, "file_id long, text_id string, shingles array<long>, bands array<long>")


def test_similarity_equals_brute_force(spark):
    rng = random.Random(3)
    releases = [hand(rng) for _ in range(8)]
    texts = ["", *releases[:3], *releases[:1] * 5, hand(rng)]
    for t in releases * 4:  # edits of all sizes
        lines = t.split("\n")
        for _ in range(rng.randrange(1, 4)):
            lines.insert(rng.randrange(len(lines)), f"    {rng.choice(WORDS)}({rng.randrange(99)})")
        texts.append("\n".join(lines))
    got = {r.text_id: r.similarity for r in H.similarities(_sketched(spark, texts), _sketched(spark, releases * 2, 500)).collect()}
    sets, known = [H.shingles(t) for t in texts], [H.shingles(t) for t in releases]
    for x in sets:
        if len(x):
            want = max(len(np.intersect1d(x, y)) / len(np.union1d(x, y)) for y in known)
            have = got.get(hashlib.sha256(x.tobytes()).hexdigest(), 0.0)
            assert have == pytest.approx(want) or (want < 0.8 and have < 0.8)
    assert H.similarities(_sketched(spark, [""]), _sketched(spark, releases)).count() == 0


def test_bands_of_similar_texts_meet():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
        y = np.unique(np.concatenate([x[33:], rng.integers(0, 1 << 63, 33, dtype=np.uint64)]))  # similarity 0.8
        assert (H.band_keys(x) == H.band_keys(y)).any()
    assert (H.band_keys(x) == H.band_keys(x.copy())).all()


def test_long_lists_are_joined_by_shuffle(spark, corpus, monkeypatch):
    tree, files, symbols, packages, _ = corpus
    d = H.learn(tree, files, symbols, packages)
    one = {r.file_id: (r.kind, r.similarity) for r in d.apply(tree, packages).collect()}
    monkeypatch.setattr(H, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(H, "BROADCAST_TEXTS", 0)
    assert {r.file_id: (r.kind, r.similarity) for r in d.apply(tree, packages).collect()} == one


def test_headers_are_cut():
    assert H.split_header("# a\n#b\n\nx = 1 # c\n") == ("# a\n#b\n", "x = 1 # c\n")
    assert H.split_header("/* a\nb */\n// c\nint x;") == ("/* a\nb */\n// c", "int x;")
    assert H.split_header("#![allow(x)]\nfn f() {}")[1].startswith("#![")
