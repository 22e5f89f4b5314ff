import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from nestlake.llm import mixing, packing
from nestlake.llm.tokens import count_tokens


def padding(lengths, counts, bounds):
    return sum(n * (next(b for b in bounds if b >= x) - x) for x, n in zip(lengths, counts))


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(20):
        lengths = sorted(rng.sample(range(1, 60), 9))
        counts = [rng.randrange(1, 20) for _ in lengths]
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], 2))
        got = packing.boundaries(lengths, counts, 3)
        assert len(got) <= 3 and padding(lengths, counts, got) == best
    assert packing.boundaries([], []) == [] and packing.boundaries([5], [3]) == [5]


def test_boundaries_are_optimal_over_many_lengths():
    """Long, rare lengths are candidates too, however many lengths there are."""
    x = np.arange(1, 3001)
    n = np.where(x <= 2900, 1000, 1)
    n[-1] = 5000
    total, sums = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * x)])
    best = np.concatenate([[0], x * total[1:] - sums[1:]])  # padding with one bucket
    for _ in range(2):
        best = np.array([0, *[min(best[:e] + x[e - 1] * (total[e] - total[:e]) - (sums[e] - sums[:e])) for e in range(1, len(x) + 1)]])
    got = packing.boundaries(x.tolist(), n.tolist(), 3)
    up = np.array(got)[np.searchsorted(got, x)]
    assert len(got) <= 3 and int((n * (up - x)).sum()) == best[-1]


def test_pack_keeps_everything(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 100)
    rng = random.Random(3)
    sized = [(i, rng.choice([0, 1, 40, 64, 65, 200, rng.randrange(1, 150)])) for i in range(400)] + [(1000, 50), (1001, 50)]
    df = spark.createDataFrame(sized, "doc_id long, tokens int")
    caps = {"s": 64, "l": 256}
    rows = packing.pack(df, caps).collect()
    for name, cap in caps.items():
        own, load = [r for r in rows if r.container == name], defaultdict(int)
        for r in own:
            load[r.container_no] += r.tokens
        assert max(load.values()) <= cap
        pieces = defaultdict(list)
        for r in own:
            pieces[r.doc_id].append((r.first_token, r.tokens))
        for i, n in sized:
            p = sorted(pieces[i])
            assert sum(t for _, t in p) == n and len(p) == max(1, -(-n // cap))  # split only where longer than the capacity
            assert [a for a, _ in p] == [k * cap for k in range(len(p))]
        slots = {(r.container_no, r.slot) for r in own}
        assert len(slots) == len(own)
    full = {r.container: r.fill for r in packing.fill_report(packing.pack(df, caps), caps).collect()}
    plain = {r.container: r.fill for r in packing.fill_report(packing.pack(df, caps, top_up=False), caps).collect()}
    assert all(full[c] >= plain[c] for c in caps) and full["l"] > 0.9
    assert packing.pack(df.where("false"), caps).count() == 0
    with pytest.raises(ValueError):
        packing.pieces(df, {"x": 0})


def test_fill_is_within_capacity():
    sizes = np.array([5, 5, 4, 3, 3, 2, 1, 7])
    no = packing.fill(sizes, np.zeros(8, int), 10)
    assert np.bincount(no, sizes).max() <= 10 and len(set(no)) == 3


def test_boundaries_shape_the_containers():
    """Batches form inside their buckets: other boundaries, other containers; top-up adds to them and moves nothing."""
    sizes = np.array([13, 9, 9, 5, 2])
    buckets = [np.searchsorted(bounds, sizes) for bounds in ([13], [5, 13], [2, 9, 13])]
    made = {tuple(sorted(tuple(np.nonzero(no == c)[0]) for c in set(no))) for no in (packing.fill(sizes, b, 20) for b in buckets)}
    assert len(made) > 1
    for b in buckets:
        plain, full = packing.fill(sizes, b, 20, False), packing.fill(sizes, b, 20)
        longest = b == b.max()
        assert (plain[longest] == full[longest]).all() and np.bincount(full, sizes).max() <= 20
        assert all(len(set(b[plain == c])) == 1 for c in set(plain))


def test_tokens(spark):
    df = spark.createDataFrame([(1, "one two"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "a" * 20_000)], "i int, text string")
    n = {r.i: r.n for r in df.select("i", count_tokens("text").alias("n")).collect()}
    assert n[2] == n[3] == 0 and n[1] == 2 and n[4] > 1 and n[5] > 100




def test_route_meets_shares_and_caps():
    supply = {"a": 100, "b": 40, "a|b": 30, "x": 500}
    targets = {"a": (0.5, 2), "b": (0.5, 3), "z": (0.3, 2)}
    flows = mixing.route(supply, targets)
    got, used = defaultdict(int), defaultdict(int)
    for p, use, s, n in flows:
        assert s in p.split("|") and use <= targets[s][1]
        got[s] += n
        used[(p, use)] += n
    assert all(n <= supply[p] for (p, _), n in used.items())
    assert abs(got["a"] - got["b"]) <= 2 and 200 <= got["b"] <= 210  # b alone: 3 x 40, and up to 3 x 30 shared
    assert mixing.route({"x": 5}, targets) == [] and mixing.route({}, {}) == []
    small = mixing.route(supply, targets, 60)
    assert {use for _, use, _, _ in small} == {1}  # nothing is repeated while fresh text is left


def test_mix(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice(["a", "a", "a", "b", None, "other"]), f"t{i}", rng.randrange(1, 40)) for i in range(600)]
    docs += [(1000 + i, "b", f"t{i}", docs[i][3]) for i in range(20)] + [(2000, "a", "zero", 0)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text_key string, tokens int")
    targets = {"a": (0.3, 1), "b": (0.6, 3), "none": (0.1, 5)}
    rows = mixing.mix(df, targets).collect()
    total = defaultdict(int)
    by = {d[0]: d for d in docs}
    for r in rows:
        assert r.uses <= targets[r.source][1] and by[r.doc_id][1] == r.source and by[r.doc_id][3] == r.tokens
        total[r.source] += r.uses * r.tokens
    assert abs(total["b"] / sum(total.values()) - 2 / 3) < 0.01
    assert {(r.doc_id, r.uses) for r in mixing.mix(df, targets).collect()} == {(r.doc_id, r.uses) for r in rows}
    assert mixing.mix(df.where("false"), targets).count() == 0


def test_mix_uses_every_copy(spark, monkeypatch):
    """A third of a source is one text: all its documents are used, also where the group of copies is split."""
    docs = [(i, "a", "same" if i < 100 else f"t{i}", 10) for i in range(300)] + [(1000 + i, "b", "same" if i < 30 else f"u{i}", 10) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text_key string, tokens int")
    for copies in (10_000, 7):
        monkeypatch.setattr(mixing, "COPIES", copies)
        rows = mixing.mix(df, {"a": (0.5, 1), "b": (0.5, 1)}).collect()
        assert all(r.uses == 1 for r in rows) and len({r.doc_id for r in rows}) == len(rows)
        used = {x: [r for r in rows if r.source == x] for x in "ab"}
        assert len(used["a"]) >= 280 and len(used["b"]) >= 280 and len([r for r in used["a"] if r.doc_id < 100]) > 60
