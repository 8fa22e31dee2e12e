"""Mixing sources to target weights (problem 7).

Expected copies of a source are constant over its documents: a whole part that
every document gets, and a fraction.  The fraction is realised by balanced
sampling with the cube method: inclusion probabilities walk through the null
space of the balancing constraints (number of documents, number of tokens), so
both totals stay as planned while each step makes one probability 0 or 1.

A large source flies in blocks, with at most two undecided documents left per
block; what all blocks leave, and a reserve of documents that took no part, is
settled in one task per source.  A source of one block is settled whole.
Settling decides the documents from the largest size class down: a flight
within the class, a draw for the two it leaves, and the probabilities of all
smaller documents make good what the draw takes too much or too little.  The
landing problem that remains are the 16 smallest documents, solved exactly.

A document larger than all its source should give can't be part of a mix that
meets the share; it is left out, and the others are planned with more copies.
In a source of several blocks, documents that its smaller ones could not make
good in passing are decided first, by the same steps.  Where no choice for a
document can be made good by one copy more or none of each smaller one, these
get whole copies more or fewer, from none to the cap.  Where the total is still
missed, the few documents that outweigh all smaller ones are tried in every
combination of copies; the one that misses the total least is taken.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import materialize

EPS = 1e-9
#: Documents above this part of what the smaller ones of their source can make good are decided first.
SPARE = 0.02
#: Documents of a source that are kept from the flights of blocks, so that its last task has enough to choose from.
RESERVE = 256
#: Documents of the landing problem.
LANDING = 16
#: Combinations of copies of the large documents of a source that are tried.
TRIED = 1 << 16


def flight(p: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Flight phase: probabilities after the walk; at most two stay fractional.

    Keeps sum(p) and sum(p * size) as they are, up to rounding.
    """
    p = list(p)
    live: list[int] = []
    for k in range(len(p)):
        if EPS < p[k] < 1 - EPS:
            live.append(k)
        else:
            p[k] = float(p[k] >= 0.5)
        # three undecided with two constraints leave one free direction; two of equal size do as well
        while True:
            move = _direction(live, size)
            if not move:
                break
            up = min((1 - p[i]) / u if u > 0 else p[i] / -u for i, u in move)
            down = min(p[i] / u if u > 0 else (1 - p[i]) / -u for i, u in move)
            step = up if rng.random() * (up + down) < down else -down
            for i, u in move:
                p[i] += step * u
                if p[i] < EPS or p[i] > 1 - EPS:
                    p[i] = float(p[i] >= 0.5)
                    live.remove(i)
    return p


def _direction(live: list[int], size: list[float]) -> list[tuple[int, float]]:
    """A vector of the constraints' null space over the undecided, or none."""
    if len(live) == 2 and size[live[0]] == size[live[1]]:
        return [(live[0], 1.0), (live[1], -1.0)]
    if len(live) < 3:
        return []
    a, b, c = live[0], live[1], live[2]
    # a null vector of the rows (1, 1, 1) and (size a, size b, size c)
    move = [(a, size[b] - size[c]), (b, size[c] - size[a]), (c, size[a] - size[b])]
    top = max(abs(u) for _, u in move)
    if top == 0:
        return [(a, 1.0), (b, -1.0)]
    return [(i, u / top) for i, u in move if u]


def land(want: float, docs: float, size: list[float]) -> list[float]:
    """Landing: the 0/1 choices closest to ``want`` tokens, then to ``docs`` documents."""
    import numpy as np

    total, count = np.zeros(1), np.zeros(1, np.int64)
    for x in size:
        total, count = np.concatenate([total, total + x]), np.concatenate([count, count + 1])
    miss = np.abs(total - want)
    near = np.flatnonzero(miss <= miss.min() + EPS)
    best = int(near[np.argmin(np.abs(count[near] - docs))])
    return [float(best >> k & 1) for k in range(len(size))]


def settle(p: list[float], size: list[float], rng: random.Random, room: tuple[float, float] | None = None, spread: tuple[int, int] = (0, 1)) -> list[float]:
    """Decide all documents: p becomes a whole number everywhere, sum(p * size) stays as near as the sizes allow.

    ``room`` is what documents outside can still add and take away; with it the
    landing is theirs and every class is drawn.  ``spread`` are the least and
    most copies of a document; others than 0 and 1 are given only where those
    can't make good a larger document.
    """
    start, p, n = p, list(p), len(p)
    want = sum(x * s for x, s in zip(p, size))
    order = sorted(range(n), key=lambda i: (-math.frexp(size[i])[1] if size[i] > 0 else math.inf, i))
    sized = sorted((i for i in order if size[i] > 0), key=lambda i: (size[i], i))
    pool = set() if room else set(sized[:LANDING])
    levels: dict[int, list[int]] = {}
    for i in order:
        if i not in pool:
            levels.setdefault(math.frexp(size[i])[1] if size[i] > 0 else -1, []).append(i)
    later = sum(size)
    expected = want  # of what is undecided
    undecided = [i for level in levels.values() for i in level] + sorted(pool)
    add, take = room or (0.0, 0.0)
    base = 0  # copies that all of what is undecided get; want and p are beyond them
    for level in levels.values():
        if not room:
            step = _step(want, later, spread[0] - base, spread[1] - base)
            base, want = base + step, want - step * later
        if not room and abs(expected - want) > EPS * (1 + abs(want)):
            _shift(p, size, undecided, want, expected, later)
        undecided = undecided[len(level) :]
        planned = sum(p[i] * size[i] for i in level)
        for i, x in zip(level, flight([p[i] for i in level], [size[i] for i in level], rng), strict=True):
            p[i] = x
        later -= sum(size[i] for i in level)
        open_ = [i for i in level if EPS < p[i] < 1 - EPS]
        fixed = sum(p[i] * size[i] for i in level if i not in open_)
        # what the documents after this class may be asked for
        low, high = -take, later + add
        least, most = low + (spread[0] - base) * (high - low), high + (spread[1] - base - 1) * (high - low)
        spare = lambda m: want - fixed - sum(size[i] for k, i in enumerate(open_) if m >> k & 1)  # noqa: E731, B023
        miss = lambda m: max(0.0, low - spare(m), spare(m) - high)  # noqa: E731, B023
        lost = lambda m: max(0.0, least - spare(m), spare(m) - most)  # noqa: E731, B023
        drawn = _draw([p[i] for i in open_], rng.random())
        if any(miss(m) > 0 for m in range(1 << len(open_))):
            drawn = min(range(1 << len(open_)), key=lambda m: (lost(m), miss(m), abs(want - spare(m) - planned), m))
        for k, i in enumerate(open_):
            p[i] = float(drawn >> k & 1)
        want = spare(drawn)
        for i in level:
            p[i] += base
        expected = sum(p[i] * size[i] for i in undecided)
    last = sorted(pool)
    step = _step(want, later, spread[0] - base, spread[1] - base) if last else 0
    if step:
        base, want = base + step, want - step * later
        _shift(p, size, last, want, expected, later)
    for i, x in zip(last, land(want, sum(p[i] for i in last), [size[i] for i in last]), strict=True):
        p[i] = x + base
    return p if room else _heads(p, start, size, rng, spread)


def _heads(p: list[float], start: list[float], size: list[float], rng: random.Random, spread: tuple[int, int]) -> list[float]:
    """``p``, or what comes nearer with the best copies of the largest documents, from one that outweighs all smaller ones."""
    want = sum(x * s for x, s in zip(start, size))
    off = lambda q: abs(sum(x * s for x, s in zip(q, size)) - want)
    if off(p) < 1:
        return p
    order = sorted(range(len(size)), key=lambda i: (size[i], i))
    below = list(itertools.accumulate((size[i] for i in order), initial=0.0))
    most = int(math.log(TRIED, spread[1] - spread[0] + 1))
    at = next((k for k in range(max(0, len(order) - most), len(order)) if 0 < below[k] < size[order[k]]), None)
    if at is None:
        return p
    heads, others, rest = order[at:], sorted(order[:at]), below[at]
    left = lambda c: want - sum(x * size[i] for x, i in zip(c, heads))
    lost = lambda c: max(0.0, spread[0] * rest - left(c), left(c) - spread[1] * rest)
    best = min(itertools.product(range(spread[0], spread[1] + 1), repeat=len(heads)), key=lambda c: (lost(c), sum(abs(x - start[i]) * size[i] for x, i in zip(c, heads)), c))
    step = _step(left(best), rest, *spread)
    q, share = list(p), min(1.0, max(0.0, left(best) / rest - step))
    for x, i in zip(best, heads, strict=True):
        q[i] = float(x)
    for x, i in zip(settle([share] * len(others), [size[i] for i in others], rng, spread=(spread[0] - step, spread[1] - step)), others, strict=True):
        q[i] = x + step
    return q if off(q) < off(p) else p


def _step(want: float, total: float, least: int, most: int) -> int:
    """Copies more that each document gets, so that ``want`` of their ``total`` is left to between none and one of each."""
    near = EPS * (1 + total)
    if total <= 0 or -near <= want <= total + near:
        return 0
    return max(least, min(most - 1, math.floor(want / total)))


def _shift(p: list[float], size: list[float], which: list[int], want: float, have: float, total: float) -> None:
    """Move probabilities evenly towards 0 or 1 until they expect ``want``."""
    if want < have:
        # an excess that nothing makes good leaves nothing expected for the classes after
        scale = max(0.0, want / have) if have > 0 else 0.0
        for i in which:
            p[i] *= scale
    else:
        up = min(1.0, (want - have) / (total - have)) if total > have else 0.0
        for i in which:
            p[i] += (1 - p[i]) * up


def _draw(p: list[float], at: float) -> int:
    """Systematic draw: each is taken as often as its probability says; a bit each."""
    out, low = 0, 0.0
    for k, x in enumerate(p):
        if math.floor(low + x - at) > math.floor(low - at):
            out |= 1 << k
        low += x
    return out


def plan_copies(totals: dict[str, tuple[int, int]], targets: Iterable[tuple[str, float, int]], total_tokens: float | None = None, usable: dict[str, int] | None = None) -> dict[str, dict]:
    """Expected copies per source.

    ``totals``: source -> (documents, tokens); ``usable``: source -> tokens of
    the documents that may be taken, where not all.  Sources without target,
    weight, allowed repeats or tokens take no part, and the weights of the
    others are scaled to 1.  Without ``total_tokens`` the mix is the largest in
    which every share is met within the caps; with it, a capped source falls
    short and the report says so.
    """
    use = {s: (w, r) for s, w, r in targets if s is not None and w and w > 0 and r and r > 0 and totals.get(s, (0, 0))[1] > 0}
    weight = sum(w for w, _ in use.values())
    have = {s: (usable or {}).get(s, totals[s][1]) for s in use}
    size = total_tokens if total_tokens is not None else min((r * have[s] * weight / w for s, (w, r) in use.items() if have[s]), default=0.0)
    return {
        s: {"target": w / weight, "max_repeats": r, "goal": size * w / weight, "expected": min(float(r), size * w / weight / have[s]) if have[s] else 0.0}
        for s, (w, r) in use.items()
    }


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, block_rows: int = 20_000, seed: int = 7) -> tuple[DataFrame, dict[str, dict]]:
    """Copies of each document: ``doc_id, source, n_tokens, copies`` (> 0), and the plan.

    ``sizes``: ``doc_id`` (unique), ``source``, ``n_tokens``; a written table,
    as it is read several times.  ``targets``: ``source, weight, max_repeats``;
    repeated rows of a source add their weights and the smallest cap holds.
    Empty tables give no rows.  Null sizes count as 0.  A document larger than
    its source's goal (``goal`` in the plan) is left out.
    """
    spark = sizes.sparkSession
    goal = targets.where("source is not null").groupBy("source").agg(F.sum("weight").alias("weight"), F.min("max_repeats").alias("max_repeats"))
    base = sizes.select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    # one row per target source, both times
    wanted = [tuple(r) for r in goal.select("source", F.col("weight").cast("double"), F.col("max_repeats").cast("int")).collect()]
    figures = lambda df: {r[0]: tuple(map(int, r[1:])) for r in df.groupBy("source").agg(F.count(F.lit(1)), F.sum("n_tokens"), F.max("n_tokens")).collect()}
    have = figures(base.join(goal.select("source"), "source", "left_semi"))
    totals = {s: x[:2] for s, x in have.items()}
    plan = plan_copies(totals, wanted, total_tokens)
    schema = "doc_id long, source string, n_tokens long, copies int"
    if not plan:
        return spark.createDataFrame([], schema), plan
    by = lambda m: F.element_at(F.create_map(*[F.lit(v) for kv in m.items() for v in kv]), F.col("source"))
    # leaving a document out lowers what its source can give, which may lower all goals
    limit: dict[str, int] = {}
    while over := {s: int(plan[s]["goal"]) for s, x in have.items() if s in plan and x[2] > plan[s]["goal"]}:
        limit |= over
        fits = figures(base.where(F.col("source").isin(list(over)) & (F.col("n_tokens") <= by(over))))
        have |= {s: fits.get(s, (0, 0, 0)) for s in over}
        plan = plan_copies(totals, wanted, total_tokens, {s: x[1] for s, x in have.items()})
    base = base.where(F.col("source").isin(list(plan)))
    if limit:
        base = base.where(F.col("n_tokens") <= F.coalesce(by(limit), F.lit(2**62)))
    totals = {s: have[s][:2] for s in plan}
    whole, frac, blocks = {}, {}, {}
    for s, x in plan.items():
        near = round(x["expected"])
        whole[s] = near if abs(near - x["expected"]) < 1e-12 else math.floor(x["expected"])
        frac[s] = max(0.0, x["expected"] - whole[s])
        blocks[s] = max(1, -(-totals[s][0] // block_rows))
    docs = base.withColumns({"copies": by(whole).cast("int"), "p": by(frac).cast("double")})
    # block -1: goes straight to the settling task of its source
    kept = {s: 1.0 if blocks[s] == 1 else min(1.0, RESERVE / max(1, totals[s][0])) for s in plan}
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1 << 30)) < by(kept) * (1 << 30)
    docs = docs.withColumn("block", F.when(drawn, -1).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(seed)), by(blocks))).cast("int"))
    result = docs.where("p <= 0")
    small = docs.where("p > 0")
    width = max(blocks.values())
    caps = {s: x["max_repeats"] for s, x in plan.items()}
    if width > 1:
        # giants first: what their landing leaves over is made good by the many others
        tops = _giants(base.where(F.col("source").isin([s for s in plan if blocks[s] > 1])), frac)
        giant = F.col("n_tokens") > by({s: tops.get(s, 2**62) for s in plan})
        held = {r[0]: int(r[1]) for r in small.where(giant).groupBy("source").agg(F.sum("n_tokens")).collect()}
        if held:
            room = {s: ((1 - frac[s]) * (totals[s][1] - held.get(s, 0)), frac[s] * (totals[s][1] - held.get(s, 0))) for s in plan}
            big = materialize(_decide(small.where(giant), width, block_rows, seed, caps, room), "giants")
            got = {r[0]: int(r[1]) for r in big.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("p").cast("int"))).collect()}
            left = {s: totals[s][1] - held.get(s, 0) for s in plan}
            want = {s: frac[s] * totals[s][1] - got.get(s, 0) for s in plan}
            step = {s: _step(want[s], left[s], -whole[s], plan[s]["max_repeats"] - whole[s]) for s in plan}
            rest = {s: min(1.0, max(0.0, want[s] / left[s] - step[s])) if left[s] > 0 else frac[s] for s in plan}
            small = small.where(~giant).withColumns({"copies": (F.col("copies") + by(step)).cast("int"), "p": by(rest)})
            result = result.unionByName(big)
    result = result.unionByName(_decide(small, width, block_rows, seed, caps))
    result = result.select("doc_id", "source", "n_tokens", (F.col("copies") + F.col("p").cast("int")).alias("copies")).where("copies > 0")
    return result, plan


def _giants(sizes: DataFrame, frac: dict[str, float]) -> dict[str, int]:
    """source -> greatest size that is no giant, where there are giants.

    From a histogram by powers of two: a size class holds no giants where its
    greatest document is at most ``SPARE`` of what the others up to it can add
    and can take away.
    """
    level = F.length(F.conv(F.col("n_tokens").cast("string"), 10, 2))
    classes = sizes.where("n_tokens > 0").groupBy("source", level.alias("level")).agg(F.max("n_tokens").alias("top"), F.sum("n_tokens").alias("tokens"))
    found: dict[str, list[tuple[int, int, int]]] = {}
    for r in classes.collect():  # at most 63 rows a source
        found.setdefault(r[0], []).append((int(r[1]), int(r[2]), int(r[3])))
    out = {}
    for s, rows in found.items():
        below = sum(t for _, _, t in rows)
        for k, (_, top, tokens) in enumerate(sorted(rows, reverse=True)):
            if top <= SPARE * min(frac[s], 1 - frac[s]) * (below - top):
                if k:
                    out[s] = top
                break
            below -= tokens
    return out


def _decide(docs: DataFrame, width: int, block_rows: int, seed: int, caps: dict[str, int], room: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Flights over blocks, rounds over the leftovers, then one settling task per source."""

    def fly(last: bool):
        def go(key, pdf):
            # an order of its own per document, so the result does not hang on how rows arrive
            pdf = pdf.assign(_o=[random.Random(f"{seed}:{d}").random() for d in pdf["doc_id"]]).sort_values(["_o", "doc_id"])
            size, p, rng = pdf["n_tokens"].astype(float).tolist(), pdf["p"].tolist(), random.Random(f"{seed}:{key}")
            # copies are the same for all documents of a source here
            given = int(pdf["copies"].iloc[0])
            p = settle(p, size, rng, room[key[0]] if room else None, (-given, caps[key[0]] - given)) if last else flight(p, size, rng)
            return pdf.assign(p=p).drop(columns="_o")

        return go

    cols = "doc_id long, source string, n_tokens long, copies int, p double, block int"
    waiting, done = docs.where("block < 0"), []
    flying = docs.where("block >= 0")
    while width > 1:
        flown = materialize(flying.groupBy("source", "block").applyInPandas(fly(False), cols), "flight")
        done.append(flown.where("p = 0 or p = 1"))
        # two undecided at most from each block
        group = max(2, block_rows // 2)
        flying = flown.where("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / group).cast("int"))
        width = -(-width // group)
    last = waiting.unionByName(flying).withColumn("block", F.lit(0)) if done else waiting.withColumn("block", F.lit(0))
    result = last.groupBy("source", "block").applyInPandas(fly(True), cols)
    for x in done:
        result = result.unionByName(x)
    return result


def shares(mixed: DataFrame, plan: dict[str, dict]) -> DataFrame:
    """Reached shares: ``source, target_share, max_repeats, docs, tokens, most_copies, share``."""
    spark = mixed.sparkSession
    goal = spark.createDataFrame([(s, x["target"], x["max_repeats"]) for s, x in plan.items()], "source string, target_share double, max_repeats int")
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    from pyspark.sql import Window

    # one row per target source
    joined = F.broadcast(goal).join(got, "source", "left").fillna(0, ["docs", "tokens", "most_copies"])
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    return joined.withColumn("share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0))
