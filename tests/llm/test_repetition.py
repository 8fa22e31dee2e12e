import random
import re

import pytest
from pyspark.sql import functions as F

from codeloom.llm.repetition import covered, gram_numbers, measure, order_rules, repetitive, rules, shares, words_of


def brute_share(text, run=10, times=3):
    w = [x.lower() for x in re.findall(r"[^\W_]+", text or "")]
    starts = {}
    for i in range(len(w) - run + 1):
        starts.setdefault(tuple(w[i : i + run]), []).append(i)
    hit = {j for at in starts.values() if len(at) >= times for i in at for j in range(i, i + run)}
    return len(hit) / len(w) if w else 0.0


def texts(n, seed=1):
    rng = random.Random(seed)
    out = [None, "", "   ", "__--__", "a " * 12, "a " * 11, "x" * 100_000, "Straße İstanbul " * 40, "one two " * 5]
    for _ in range(n):
        phrase = " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(8, 14)))
        parts = [phrase.upper() if rng.random() < 0.3 else phrase if rng.random() < 0.5 else " ".join(rng.choice("ijklmnopqrstuvw") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 25))) for _ in range(rng.randrange(1, 14))]
        out.append(rng.choice([". ", "\n", " _ "]).join(parts))
    return out


def test_grams_are_numbered_exactly():
    import numpy as np

    ids = np.array([0, 1, 0, 1, 0, 2, 0, 1])
    for k in (1, 2, 3, 5, 7):
        n = gram_numbers(ids, k)
        want = {}
        assert [want.setdefault(tuple(ids[i : i + k]), x) for i, x in enumerate(n)] == list(n) and len(set(n)) == len(want)


def test_share_equals_brute_force():
    import numpy as np

    for t in texts(200):
        n, phrase, *_ = measure(t)
        assert n == len(words_of(t or ""))
        assert phrase == pytest.approx(brute_share(t))
    assert not covered(np.array([], np.int64), 10, 3).any()


def test_every_rule_is_necessary():
    """No rule rejects a text that the deciding rule accepts, so the order can't change the result."""
    from codeloom.llm.repetition import Text

    for t in texts(300, 2):
        if t and brute_share(t) >= 0.5:
            for name, test in rules().items():
                assert test(Text(t)), name


def test_order_puts_cheap_rejection_first():
    sample = ["short"] * 50 + ["a b c d e f g h i j k l m n o p q r s t u v"] * 10
    ordered = order_rules(sample, rules())
    assert ordered[0] == "length" and ordered[-1] == "phrases"


def test_operator(spark):
    rows = list(enumerate(texts(150, 3))) + [(7, "a " * 30)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_text", F.lit("clash"))
    got = sorted(r.doc_id for r in repetitive(df).collect())
    assert got == sorted(i for i, t in rows if t and brute_share(t) >= 0.5)
    per = {r.doc_id: r for r in shares(df).collect()}
    assert per[0].n_words == 0 and per[0].repeated_share == 0.0
    assert repetitive(df.limit(0)).count() == 0 and shares(df.limit(0)).count() == 0


def test_sentences_and_paragraphs():
    n, phrase, sentence, paragraph, any_share = measure("Same one here. Other words. Same one here.\n\nBlock of text\n\nblock  of TEXT\n\nlone")
    assert (n, phrase) == (15, 0.0)
    assert sentence == pytest.approx(12 / 15) and paragraph == pytest.approx(6 / 15) and any_share == pytest.approx(12 / 15)
