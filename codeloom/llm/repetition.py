"""Repetition inside a single document (problem 8).

``shares`` measures, per text, the part of its words that stands in repeated
phrases, sentences and paragraphs.  ``repetitive`` finds the texts over a
threshold with a short-circuit cascade: besides the exact phrase rule there are
cheaper rules that each *must* hold for a repetitive text, so failing one ends
the work on that text.  Cost and selectivity of every rule are measured on a
bounded sample and the rules are ordered by rejection per cost.  All of it is
one narrow pass: no shuffle, texts never leave their partition.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import spread

RUN, TIMES, LEAST = 10, 3, 0.5
#: Texts on which the rules' cost and selectivity are estimated, and their length at most.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 100_000

_WORD = re.compile(r"[^\W_]+")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str) -> list[str]:
    """Unbroken runs of letters and digits, in lower case."""
    if text.isascii():
        return _WORD.findall(text.lower())
    return [w.lower() for w in _WORD.findall(text)]


def _ids(words: list) -> "np.ndarray":
    import numpy as np

    number: dict = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def _pairs(a, b):
    """Numbers of the pairs (a[i], b[i]): equal exactly if both parts are."""
    import numpy as np

    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]


def gram_numbers(ids, k: int):
    """A number per k-gram, equal exactly for equal k-grams (doubling, no hashing)."""
    have, size = ids, 1
    rest, done = k, 0
    out = None
    while rest:
        if rest & 1:
            n = len(ids) - (done + size) + 1
            out = have[:n] if out is None else _pairs(out[:n], have[done : done + n])
            done += size
        rest >>= 1
        if rest:
            have = _pairs(have[:-size], have[size:])
            size *= 2
    return out


def covered(ids, k: int, times: int):
    """Mask of the words inside a k-gram that starts at ``times`` or more places."""
    import numpy as np

    mask = np.zeros(len(ids) + 1, np.int64)
    if len(ids) >= k + times - 1:
        grams = gram_numbers(ids, k)
        starts = np.flatnonzero(np.bincount(grams)[grams] >= times)
        np.add.at(mask, starts, 1)
        np.add.at(mask, starts + k, -1)
    return np.cumsum(mask)[:-1] > 0


class Text:
    """One text with what the rules share, made when first needed."""

    def __init__(self, text: str):
        self.text = text
        self._ids = None
        self._covered: dict = {}

    def copy(self) -> "Text":
        other = Text(self.text)
        other._ids, other._covered = self._ids, dict(self._covered)
        return other

    @property
    def ids(self):
        if self._ids is None:
            self._ids = _ids(words_of(self.text))
        return self._ids

    def covered(self, k: int, times: int) -> int:
        """Words inside repeated k-grams."""
        if (k, times) not in self._covered:
            self._covered[k, times] = int(covered(self.ids, k, times).sum())
        return self._covered[k, times]


def rules(run: int = RUN, times: int = TIMES, least: float = LEAST) -> dict:
    """Name -> test that every repetitive text passes; ``phrases`` alone decides.

    A word inside a run that starts at ``times`` places occurs at as many
    places itself, and so does every shorter run around it; hence the bounds
    over single words and over shorter runs.
    """
    import numpy as np

    def frequent(t: Text) -> bool:
        ids = t.ids
        return len(ids) > 0 and int((np.bincount(ids)[ids] >= times).sum()) >= least * len(ids)

    def short_runs(k: int):
        return lambda t: len(t.ids) > 0 and t.covered(k, times) >= least * len(t.ids)

    return {
        # run + times - 1 words with something between them
        "length": lambda t: len(t.text) >= 2 * (run + times - 1) - 1,
        "words": lambda t: len(t.ids) >= run + times - 1,
        "frequent_words": frequent,
        "pairs": short_runs(min(2, run)),
        "phrases": short_runs(run),
    }


DECIDES = "phrases"


def order_rules(sample: list[str], tests: dict) -> list[str]:
    """Rules by rejections per second on the sample, best first.

    Each place in the order goes to the rule that rejects most per second of
    what the rules before have let through, with the shared parts those have
    made.  Rules after the deciding one would be implied by it and are left out.
    """
    left, ordered = [Text(s) for s in sample], []
    while DECIDES not in ordered:
        score = {}
        for name in [n for n in tests if n not in ordered]:
            fresh = [t.copy() for t in left]
            began = time.perf_counter()
            rejected = sum(not tests[name](t) for t in fresh)
            score[name] = rejected / max(time.perf_counter() - began, 1e-9)
        # where nothing is rejected any more, only the deciding rule is of use
        best = max(score, key=lambda n: (score[n], n == DECIDES))
        ordered.append(best)
        left = [t for t in left if tests[best](t)]
    return ordered


def draw(docs: DataFrame, text: str, rows: int = SAMPLE_ROWS) -> list[str]:
    """At most ``rows`` texts, none very long, for the estimate (never for the result)."""
    n = docs.count()
    if not n:
        return []
    share = min(1.0, 2 * rows / n)
    got = docs.select(F.col(f"`{text}`").alias("t")).where(F.length("t") <= SAMPLE_CHARS).sample(False, share, 11).limit(rows)
    return [r[0] for r in got.collect()]


def repetitive(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, times: int = TIMES, least: float = LEAST) -> DataFrame:
    """``key, repeated_share`` of the texts of which at least ``least`` of the words
    stand in a run of ``run`` words that starts at ``times`` or more places.

    Null, empty and wordless texts are never repetitive.  Repeated rows give
    repeated rows.  Whole texts are used, however long.
    """
    ordered = order_rules(draw(docs, text), rules(run, times, least))

    def go(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tests = rules(run, times, least)
        chain = [tests[n] for n in ordered]
        for b in batches:
            at, share = [], []
            for i, s in enumerate(b.column("_text").to_pylist()):
                if not s:
                    continue
                t = Text(s)
                if all(test(t) for test in chain):
                    at.append(i)
                    share.append(t.covered(run, times) / len(t.ids))
            if at:
                yield pa.RecordBatch.from_arrays([b.column("_key").take(pa.array(at)), pa.array(share, pa.float64())], names=[key, "repeated_share"])

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))).mapInArrow(go, f"`{key}` {kind}, repeated_share double")


def measure(text: str, run: int = RUN, times: int = TIMES) -> tuple[int, float, float, float, float]:
    """Words; share in repeated phrases, sentences, paragraphs; share in any of them."""
    import numpy as np

    if not text:
        return 0, 0.0, 0.0, 0.0, 0.0
    words: list[str] = []
    seen: dict[str, dict] = {"s": {}, "p": {}}
    for para in _PARAGRAPH.split(text):
        first = len(words)
        for sentence in _SENTENCE.split(para):
            at = len(words)
            words += words_of(sentence)
            if len(words) > at:
                seen["s"].setdefault(tuple(words[at:]), []).append((at, len(words)))
        if len(words) > first:
            seen["p"].setdefault(tuple(words[first:]), []).append((first, len(words)))
    if not words:
        return 0, 0.0, 0.0, 0.0, 0.0
    masks = []
    for kind in ("s", "p"):
        m = np.zeros(len(words), bool)
        for spans in seen[kind].values():
            if len(spans) > 1:
                for a, b in spans:
                    m[a:b] = True
        masks.append(m)
    ph = covered(_ids(words), run, times)
    return len(words), float(ph.mean()), float(masks[0].mean()), float(masks[1].mean()), float((ph | masks[0] | masks[1]).mean())


def shares(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, times: int = TIMES) -> DataFrame:
    """Per row: ``key, n_words, phrase_share, sentence_share, paragraph_share, repeated_share``.

    A phrase is a run of ``run`` words that starts at ``times`` or more places;
    a sentence or paragraph counts as repeated if its words occur as a sentence
    or paragraph more than once.  Null and wordless texts have shares of 0.
    """

    def go(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            got = [measure(s, run, times) for s in b.column("_text").to_pylist()]
            cols = list(zip(*got, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("_key"), pa.array(cols[0], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[1:]]],
                names=[key, "n_words", "phrase_share", "sentence_share", "paragraph_share", "repeated_share"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))).mapInArrow(
        go, f"`{key}` {kind}, n_words long, phrase_share double, sentence_share double, paragraph_share double, repeated_share double"
    )
