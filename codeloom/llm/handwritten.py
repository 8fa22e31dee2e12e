"""Generated, minified and vendored source files, and data saved as code (problem 2).

One linear support-vector machine per kind, trained here on hashed character
n-grams and path components.  Labels for training are weak and bounded in
number: files with indexed symbols are hand-written; giveaway headers, known
release hashes, line shapes and literal shares name the kinds.  The giveaways
are masked in the features (the leading comment block is cut), so the machines
learn from the code itself and find files that lack them.  Validation is split
by repository and sets each kind's threshold.

Two passes read texts: one over the ids of the training sample, one that scores
all files where they lie, with the weights broadcast (fixed size).  Files that
the vendored machine does not place clearly among the hand-written ones leave
that pass with a sketch, and those alone are compared with the known releases:
by equal bands of minima of hashed five-word shingles, then exactly.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import materialize, spread

BITS = 18
GRAMS = (4, 8)
#: Occurrences a path part counts for.
PATH_WEIGHT = 4
KINDS = ("generated", "minified", "vendored", "data")
#: Bounds of the training sample: files looked at, hand-written rows, rows per kind, copies of releases.
LOOK, HAND_ROWS, KIND_ROWS, RELEASE_ROWS = 40_000, 3_000, 800, 2_000
#: Copies of one release in the sample.
COPIES = 8
#: Score of the vendored machine above which a file is compared with the releases;
#: hand-written files lie around -1, the far side of the margin.
GATE = -0.75

# fixed values: words of headers that tools write
_TOOL = re.compile(r"(?i)do not (?:edit|modify)|(?:auto-?)?generated|machine-written|automati\w+ (?:produced|erzeugt)|nicht von hand")
_COMMENT = re.compile(r"\s*(?://|#(?!!?\[)|/\*|\*|<!--|--|;;)")
_LITERAL = re.compile(r'"[^"\n]*"|\'[^\'\n]*\'|[-+]?\b\d\w*(?:\.\d+)?|[,\s\[\]{}()]')
_STAMP = re.compile(r"\d{4}-\d\d-\d\d[ T]")


def split_header(text: str) -> tuple[str, str]:
    """(leading comment block, rest)."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿").split("\n")
    k, block = 0, False
    while k < len(lines):
        s = lines[k]
        if block:
            block = "*/" not in s
        elif s.strip() and not _COMMENT.match(s):
            break
        elif s.lstrip().startswith("/*") and "*/" not in s:
            block = True
        k += 1
    return "\n".join(lines[:k]), "\n".join(lines[k:])


def weak_kind(path: str, text: str, known: bool, indexed: bool) -> str | None:
    """Training label of a file, or None where nothing tells."""
    if known:
        return "vendored"
    if indexed:
        return "hand"
    head, body = split_header(text)
    if not body.strip():
        return "hand"
    lines = [s for s in body.split("\n") if s.strip()]
    literal = sum(len(m) for m in _LITERAL.findall(body)) / len(body)
    commas = {s.count(",") for s in lines}
    if literal > 0.85 or (len(lines) > 5 and len(commas) == 1 and min(commas) >= 2 and not lines[0].rstrip().endswith(";")):
        return "data"
    if sum(bool(_STAMP.match(s)) for s in lines) > 0.7 * len(lines):
        return "data"
    if body.lstrip()[:1] in "[{":
        try:
            json.loads(body)
            return "data"
        except ValueError:
            pass
    if re.match(r"\s*<(?:!doctype|html|\?xml)", body, re.I) or re.match(r"#!.*\bsh\b|# \w[^\n]*\n\s*\n\w", text):
        return "hand"  # pages, notes and shell scripts under a wrong extension
    if max(map(len, lines)) > 300 and sum(map(str.isspace, body)) < 0.2 * len(body):
        return "minified"
    if _TOOL.search(head):
        return "generated"
    return None


def _grams(body, bits: int = BITS) -> list:
    """(n, hashed n-grams) of a byte array, by doubling: 2-grams make 4-grams make 8-grams."""
    import numpy as np

    have, width, factor, out = body.astype(np.uint64), 1, 0x9E3779B97F4A7C15, []
    while width < max(GRAMS):
        if len(have) <= width:
            break
        have = have[:-width] * np.uint64(factor) + have[width:]
        width, factor = width * 2, (factor * factor + 2 * width) % (1 << 64) | 1
        if width in GRAMS:
            h = have ^ (have >> np.uint64(31))
            out.append((width, ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int32)))
    return out


def path_features(path: str, bits: int = BITS) -> list[int]:
    """Numbers of the path's components and the parts of the file name."""
    import xxhash

    *dirs, name = path.split("/")
    words = ["dir:" + d for d in dirs[1:]] + ["name:" + p for p in re.split(r"[._\-]", name)] + ["ext:" + ".".join(name.split(".")[1:])]
    return [xxhash.xxh64_intdigest(w) & ((1 << bits) - 1) for w in words]


def body_bytes(text: str):
    """The text without its leading comment block, as bytes."""
    import numpy as np

    return np.frombuffer(split_header(text)[1].encode("utf-8", "surrogatepass"), np.uint8)


def features(path: str, text: str, bits: int = BITS):
    """(numbers, values) of a file for training: how often each hashed n-gram and
    path part occurs, over the root of all occurrences."""
    import numpy as np

    parts = [h for _, h in _grams(body_bytes(text), bits)]
    grams = sum(map(len, parts))
    own = np.repeat(np.array(path_features(path, bits), np.int32), PATH_WEIGHT)
    x, n = np.unique(np.concatenate([*parts, own]), return_counts=True)
    return x.astype(np.int32), (n / max(1, grams + len(own)) ** 0.5).astype(np.float32)


def score_files(paths: list[str], texts: list[str], weights, bits: int = BITS):
    """Scores of many files at once, a row per file and a column per machine.

    All texts of a batch are hashed as one array and each n-gram's weights are
    summed per file, so nothing is sorted and no file costs Python loops.
    """
    import numpy as np

    bodies = [body_bytes(t) for t in texts]
    sizes = np.array([len(b) for b in bodies], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    total = np.zeros((len(texts), weights.shape[1]), np.float64)
    count = np.zeros(len(texts), np.float64)
    for n, h in _grams(np.concatenate([*bodies, np.zeros(1, np.uint8)]), bits):
        has = np.flatnonzero(sizes >= n)
        if not len(has):
            continue
        gathered = np.take(weights, h, axis=0, mode="clip")
        # pairs of (first, behind last) n-gram of each text; the odd sums fall between texts
        cuts = np.stack([starts[has], ends[has] - n + 1], 1).ravel()
        sums = np.add.reduceat(np.concatenate([gathered, np.zeros((1, gathered.shape[1]), gathered.dtype)]), np.minimum(cuts, len(gathered)), axis=0)
        total[has] += sums[::2]
        count[has] += sizes[has] - n + 1
    for i, path in enumerate(paths):
        own = path_features(path, bits)
        total[i] += PATH_WEIGHT * weights[own].sum(0)
        count[i] += PATH_WEIGHT * len(own)
    return total / np.maximum(1, count)[:, None] ** 0.5


@dataclass
class Machine:
    """Weights of one kind against hand-written; score > threshold is a case."""

    weights: object
    bias: float
    threshold: float = 0.0
    precision: float = 0.0
    recall: float = 0.0
    #: above this an exact check follows (vendored only), and the held-out cases that lie above it
    gate: float | None = None
    gate_recall: float | None = None

    def score(self, x) -> float:
        return float(self.weights[x[0]] @ x[1]) + self.bias


def train(xs: list, ys: list[int], epochs: int = 12, cost: float = 1.0, bits: int = BITS, seed: int = 5) -> Machine:
    """Linear support-vector machine with hinge loss, by dual coordinate descent.

    Every step solves one row's dual variable exactly, so there is no learning
    rate.  The rarer class costs more, up to four times; the bias is a constant
    feature.
    """
    import numpy as np

    w, bias = np.zeros(1 << bits, np.float64), 0.0
    rng = np.random.default_rng(seed)
    positive = max(1, sum(y > 0 for y in ys))
    upper = {1: cost * min(4.0, max(1.0, (len(ys) - positive) / positive)), -1: cost}
    alpha = np.zeros(len(xs))
    size = [float(v @ v) + 1.0 for _, v in xs]
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(xs)):
            (x, v), y = xs[i], ys[i]
            slope = y * (float(w[x] @ v) + bias) - 1.0
            new = min(max(alpha[i] - slope / size[i], 0.0), upper[y])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[x] += v * (step * y)
                bias += step * y
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return Machine(w.astype(np.float32), bias)


def fit(rows: list[tuple[str, str, object]], bits: int = BITS) -> dict[str, Machine]:
    """Machines from (repo, label, features).  A fifth of the repositories sets the
    thresholds; then each machine is fitted again on all rows."""
    import xxhash

    held = lambda repo: xxhash.xxh64_intdigest(repo or "") % 5 == 0
    out = {}
    for kind in KINDS:
        use = [(r, x, 1 if label == kind else -1) for r, label, x in rows if label in (kind, "hand")]
        if not any(y > 0 for _, _, y in use) or not any(y < 0 for _, _, y in use):
            continue
        # copies are written like other code: hardly any of them may be given up for a wider margin
        cost = 10.0 if kind == "vendored" else 1.0
        fitted = train([x for r, x, _ in use if not held(r)], [y for r, _, y in use if not held(r)], cost=cost, bits=bits)
        scored = sorted(((fitted.score(x), y) for r, x, y in use if held(r)), reverse=True)
        whole = train([x for _, x, _ in use], [y for _, _, y in use], cost=cost, bits=bits)
        positives = sum(y > 0 for _, y in scored)
        # (F1, cut, precision, recall) of the best cut
        best, hit = (-1.0, 0.0, 0.0, 0.0), 0
        for k, (s, y) in enumerate(scored if positives else []):
            hit += y > 0
            low = scored[k + 1][0] if k + 1 < len(scored) else s - 1
            # the middle of the gap; of equal cuts the one nearest to zero
            cut = min(max(0.0, low), s) if low <= 0 <= s else (low + s) / 2
            made = (2 * hit / (k + 1 + positives), cut, hit / (k + 1), hit / positives)
            best = max(best, made, key=lambda x: (x[0], -abs(x[1])))
        if positives:
            whole.threshold, whole.precision, whole.recall = best[1:]
        if kind == "vendored":
            # nothing to measure the gate by: every file is compared
            whole.gate = min(GATE, whole.threshold) if positives else float("-inf")
            whole.gate_recall = sum(y > 0 and s > whole.gate for s, y in scored) / positives if positives else None
        out[kind] = whole
    return out


SHINGLE, SIMILAR = 5, 0.8
#: Bands and minima per band; two texts of similarity 0.8 share a band in all but 5 of 10^8 cases.
BANDS, MINIMA = 32, 4

_WORDS = re.compile(r"\w+|[^\w\s]")
_word_hash: dict[str, int] = {}


def shingles(text: str):
    """Distinct hashed runs of five words of a text without its leading comment block."""
    import numpy as np
    import xxhash

    words = _WORDS.findall(split_header(text)[1])
    if len(_word_hash) > 200_000:
        _word_hash.clear()
    for w in set(words):
        if w not in _word_hash:
            _word_hash[w] = xxhash.xxh64_intdigest(w)
    h = np.array([_word_hash[w] for w in words], np.uint64)
    n = max(1, len(h) - SHINGLE + 1)
    run = np.zeros(n if len(h) else 0, np.uint64)
    for j in range(min(SHINGLE, len(h))):
        run = run * np.uint64(0x9E3779B97F4A7C15) + (h[j : j + n] ^ (h[j : j + n] >> np.uint64(29)))
    return np.unique(run)


def band_keys(x):
    """A key per band of a shingle set: equal sets have equal keys, similar ones likely an equal one."""
    import numpy as np

    rng = np.random.default_rng(11)
    factors = rng.integers(0, 1 << 63, (BANDS, MINIMA), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    keys = np.arange(BANDS, dtype=np.uint64)
    for j in range(MINIMA):
        minima = np.array([(x * f).min() for f in factors[:, j]], np.uint64)
        keys = (keys ^ (minima >> np.uint64(31)) ^ minima) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j)
    return keys.view(np.int64)


@dataclass
class Detector:
    """Fitted machines, applied to a table of files."""

    machines: dict[str, Machine] = field(default_factory=dict)
    bits: int = BITS

    def apply(self, tree: DataFrame, packages: DataFrame) -> DataFrame:
        """``file_id``, one ``<kind>_score`` per kind (score minus threshold, null
        where no machine could be trained), ``similarity`` to the closest known
        release (0 below 0.5 or so, null for files the vendored machine rules
        out) and ``kind``: ``vendored`` where the similarity is 0.8 or more,
        else the highest of the other scores above 0, or null.  Releases are
        the listed ones of which an exact copy is in the tree.  Null texts,
        empty ones and texts of comments alone have no kind.
        """
        marked = with_known(spread(tree.select("file_id", "path", "content")), packages).select("file_id", "path", "content", "release")
        scored = materialize(self._scored(marked), "scored")
        out = ["file_id", *[f"{k}_score" for k in KINDS], "similarity", "kind"]
        ruled_out = scored.where("near is null").withColumn("similarity", F.lit(None).cast("double")).withColumnRenamed("other", "kind")
        if "vendored" not in self.machines:
            return ruled_out.select(*out)
        same = scored.where("near = 1").withColumns({"similarity": F.lit(1.0), "kind": F.lit("vendored")})
        asked = scored.where("near = 0")
        found = asked.join(similarities(asked, scored.where("near = 1 and shingles is not null")), "text_id", "left").fillna(0.0, ["similarity"])
        found = found.withColumn("kind", F.when(F.col("similarity") >= SIMILAR, "vendored").otherwise(F.col("other")))
        return ruled_out.select(*out).unionByName(same.select(*out)).unionByName(found.select(*out))

    def _scored(self, marked: DataFrame) -> DataFrame:
        """Per file its scores, the best other kind, and ``near``: 1 for exact copies
        of a release, 0 for files to be compared, null for the rest; compared
        files and, once per task, releases carry their shingles and bands."""
        kinds, bits = list(KINDS), self.bits
        carried = marked.sparkSession.sparkContext.broadcast(self.machines)

        def go(batches: Iterator) -> Iterator:
            import hashlib

            import numpy as np
            import pyarrow as pa

            machines = carried.value
            names = list(machines)
            weights = np.stack([machines[k].weights for k in names], 1) if names else np.zeros((1 << bits, 1), np.float32)
            bias = np.array([machines[k].bias for k in names])
            gate = machines["vendored"].gate if "vendored" in machines else float("inf")
            shown: set = set()
            for b in batches:
                cols: dict[str, list] = {k: [] for k in kinds}
                rest: list[tuple] = []
                paths, texts, release = ([x or e for x in b.column(c).to_pylist()] for c, e in (("path", ""), ("content", ""), ("release", None)))
                scores: list = []
                for lo in range(0, len(texts), 256):  # bounds the arrays, not the work
                    scores.extend(score_files(paths[lo : lo + 256], texts[lo : lo + 256], weights, bits))
                for text, known, row in zip(texts, release, scores, strict=True):
                    raw = dict(zip(names, (row + bias).tolist(), strict=False)) if names else {}
                    got = {k: raw[k] - m.threshold for k, m in machines.items()}
                    for k in kinds:
                        cols[k].append(got.get(k))
                    top = max((k for k in got if k != "vendored"), key=got.get, default=None)
                    top = top if top and got[top] > 0 else None
                    near = 1 if known and "vendored" in raw else 0 if raw.get("vendored", float("-inf")) > gate else None
                    if (top or near is not None) and not split_header(text)[1].strip():
                        top = near = None  # nothing but comments: no code that a tool could have made
                    x = keys = name = None
                    if near == 0 or near == 1 and known not in shown:
                        x = shingles(text)
                        if len(x):
                            keys, name = band_keys(x), hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest()
                        shown.add(known)
                    rest.append((near, top, known, name, None if keys is None else x.view(np.int64), keys))
                ends = list(zip(*rest, strict=True)) or [[]] * 6
                types = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("file_id"), *[pa.array(cols[k], pa.float64()) for k in kinds], *[pa.array(c, t) for c, t in zip(ends, types, strict=True)]],
                    names=["file_id", *[f"{k}_score" for k in kinds], "near", "other", "release", "text_id", "shingles", "bands"],
                )

        schema = "file_id long, " + ", ".join(f"{k}_score double" for k in kinds) + ", near int, other string, release string, text_id string, shingles array<long>, bands array<long>"
        return marked.mapInArrow(go, schema)


#: Texts with a candidate release up to which their ids are sent to the sketches; beyond, both are shuffled.
BROADCAST_TEXTS = 500_000


def similarities(asked: DataFrame, releases: DataFrame) -> DataFrame:
    """``text_id, similarity``: the greatest similarity of each asked text to any release it shares a band with.

    Both have ``file_id, text_id, shingles, bands`` and are written tables.
    Equal texts are one text here, so copies never meet each other; texts meet
    releases by band, and only the shingles of texts that met one are fetched,
    to be compared once per pair.
    """
    keys = lambda df: df.where("text_id is not null").select("text_id", F.explode("bands").alias("band")).distinct()
    pairs = keys(asked).join(keys(releases).withColumnRenamed("text_id", "known_id"), "band").select("text_id", "known_id").distinct()
    pairs = materialize(pairs, "pairs")
    few = pairs.count() <= BROADCAST_TEXTS

    def sets(df: DataFrame, ids: DataFrame) -> DataFrame:
        """Shingles of one row per text in ``ids``."""
        ids = F.broadcast(ids) if few else ids
        one = df.select("text_id", "file_id").join(ids, "text_id", "left_semi").groupBy("text_id").agg(F.min("file_id").alias("file_id"))
        return df.select("text_id", "file_id", "shingles").join(F.broadcast(one) if few else one, ["text_id", "file_id"]).drop("file_id")

    texts = sets(asked, pairs.select("text_id").distinct())
    known = sets(releases, pairs.select(F.col("known_id").alias("text_id")).distinct()).select(F.col("text_id").alias("known_id"), F.col("shingles").alias("theirs"))
    both = pairs.join(texts, "text_id").join(known, "known_id")
    shared = F.size(F.array_intersect("shingles", "theirs"))
    return both.groupBy("text_id").agg(F.max(shared / (F.size("shingles") + F.size("theirs") - shared)).alias("similarity"))


#: A package list above this many rows is joined by shuffle, not broadcast.
BROADCAST_ROWS = 200_000


def _listed(packages: DataFrame) -> DataFrame:
    """Hashes of the listed releases, broadcast where the list is short."""
    hashes = packages.where("content_hash is not null").select(F.lower(F.trim("content_hash")).alias("_h")).distinct()
    return F.broadcast(hashes) if packages.count() <= BROADCAST_ROWS else hashes


def with_known(tree: DataFrame, packages: DataFrame) -> DataFrame:
    """Adds ``release``: the hash of the text if it is a listed release, byte for byte."""
    listed = _listed(packages).withColumn("release", F.col("_h"))
    return tree.withColumn("_h", F.sha2(F.col("content"), 256)).join(listed, "_h", "left").drop("_h")


def learn(
    tree: DataFrame, files: DataFrame, symbols: DataFrame, packages: DataFrame,
    look: int = LOOK, hand_rows: int = HAND_ROWS, kind_rows: int = KIND_ROWS, release_rows: int = RELEASE_ROWS, bits: int = BITS,
) -> Detector:
    """Fit on a bounded sample: about ``look`` files drawn by hash, of them at most
    ``hand_rows`` hand-written and ``kind_rows`` of each kind; besides, copies of
    the known releases, at most ``COPIES`` of each and ``release_rows`` in all,
    first ones first.  ``files`` says by its hashes which files are copies."""
    import numpy as np
    from pyspark.sql import Window

    spark = tree.sparkSession
    n = tree.count()
    if not n:
        return Detector({}, bits)
    share = min(1.0, look / n)
    draw = F.pmod(F.xxhash64("file_id", F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30))
    copies = files.select(F.col("id").alias("file_id"), F.lower(F.trim("content_hash")).alias("_h")).join(_listed(packages), "_h")
    # at most COPIES rows a release, however many copies it has
    few = copies.groupBy("_h", F.pmod(F.xxhash64("file_id"), F.lit(COPIES)).alias("_b")).agg(F.min("file_id").alias("file_id"))
    few = few.withColumn("_k", F.row_number().over(Window.partitionBy("_h").orderBy("file_id")))
    few = few.orderBy("_k", "_h").limit(release_rows).select("file_id", F.lit(True).alias("known"), F.lit(False).alias("indexed"))
    # ids only: those drawn, whether symbols are known of them, without the copies
    drawn = materialize(tree.where(draw).select("file_id").distinct(), "drawn")
    indexed = symbols.select("file_id").join(F.broadcast(drawn), "file_id", "left_semi").distinct().withColumn("indexed", F.lit(True))
    others = drawn.join(copies.select("file_id").join(F.broadcast(drawn), "file_id", "left_semi"), "file_id", "left_anti").join(indexed, "file_id", "left")
    wanted = materialize(few.unionByName(others.select("file_id", F.lit(False).alias("known"), F.coalesce("indexed", F.lit(False)).alias("indexed"))), "wanted")
    # about look + release_rows ids at most go to the texts
    sample = spread(tree.select("file_id", "repo", "path", "content")).join(F.broadcast(wanted), "file_id")
    # hand-written files are the many; thin them before features are made
    hand = min(1.0, 1.5 * hand_rows / max(1.0, share * n))

    def go(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for b in batches:
            out: list[tuple] = []
            for fid, repo, path, text, known, indexed in zip(*(b.column(c).to_pylist() for c in ("file_id", "repo", "path", "content", "known", "indexed")), strict=True):
                label = weak_kind(path or "", text or "", known, indexed)
                order = xxhash.xxh64_intdigest(str(fid), seed=3)
                if label is None or (label == "hand" and order >= hand * 2**64):
                    continue
                x, v = features(path or "", text or "", bits)
                out.append((repo, label, order >> 1, x.tobytes(), v.tobytes()))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["repo", "label", "rank", "x", "v"])

    made = materialize(sample.select("file_id", "repo", "path", "content", "known", "indexed").mapInArrow(go, "repo string, label string, rank long, x binary, v binary"), "training")
    # ranks first (numbers of a bounded sample), then the chosen rows, partition by partition
    ranks: dict[str, list[int]] = {}
    for label, rank in made.select("label", "rank").toLocalIterator():
        ranks.setdefault(label, []).append(rank)
    bounds = {"hand": hand_rows, "vendored": release_rows}
    cut = {label: sorted(found)[: bounds.get(label, kind_rows)][-1] for label, found in ranks.items()}
    rows = []
    if cut:
        chosen = F.lit(False)
        for label, rank in cut.items():
            chosen = chosen | ((F.col("label") == label) & (F.col("rank") <= rank))
        for r in made.where(chosen).toLocalIterator():
            rows.append((r[2], (r[0], r[1], (np.frombuffer(bytes(r[3]), np.int32), np.frombuffer(bytes(r[4]), np.float32)))))
    rows = [r for _, r in sorted(rows, key=lambda x: x[0])]
    return Detector(fit(rows, bits), bits)
