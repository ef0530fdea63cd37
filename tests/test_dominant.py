"""The dominant key by decayed means, with keys in more than one group, against a plain fold over all keys."""

import random

import pytest

from nodelytics.operators import folds


def plain(rows, alpha=0.3, ratio=1.2, prune=1e-9):
    out = {}
    for scope in {r[0] for r in rows}:
        means, now, tenure, switches = {}, None, 0, 0
        for s in sorted({r[1] for r in rows if r[0] == scope}):
            seen = {k: v for n, t, k, v in rows if (n, t) == (scope, s)}
            if not any(v > 0 for v in seen.values()):
                means, now, tenure = {}, None, 0
                out[scope, s] = (None, None, None, 0, 0, switches)
                continue
            means = {k: v * (1 - alpha) for k, v in means.items()}
            for k, v in seen.items():
                means[k] = means.get(k, 0.0) + alpha * v
            means = {k: v for k, v in means.items() if v >= prune or k in seen and v >= 0}
            if not means:
                now, tenure = None, 0
                out[scope, s] = (None, None, None, 0, 0, switches)
                continue
            best = min(means, key=lambda k: (-means[k], k))
            if now is None or now not in means or means[best] > ratio * means[now]:
                switches += now is not None and now != best
                tenure = tenure if now == best else 0
                now = best
            tenure += 1
            others = [v for k, v in means.items() if k != now]
            out[scope, s] = (now, means[now] / sum(means.values()), max(others, default=0.0) / means[now], sum(v == means[best] for v in means.values()), tenure, switches)
    return out


@pytest.mark.parametrize("size", [3, 1000])
def test_groups_equal_a_plain_fold(spark, monkeypatch, size):
    monkeypatch.setattr(folds, "GROUP_KEYS", size)
    rng = random.Random(size)
    rows = []
    for scope in ("x", "y", None):
        for s in range(80):
            zeros = rng.random() < 0.05
            for k in rng.sample(range(30), rng.randint(1, 8)):
                rows.append((scope, s, f"k{k}", 0.0 if zeros else float(rng.choice([0, 1, 1, 2, 5, 9, -4, 1e-8]))))
    rows += [("z", i, "a", v) for i, v in enumerate([1.0, 1e-7])] + [("z", 70, "b", 1.0)]
    rows += [("z", i, "b", 1e-6) for i in range(2, 70)]
    got = {(r.n, r.s): tuple(r)[2:] for r in folds.ewma_dominant(spark.createDataFrame(rows, "n string, s int, k string, v double"), ["n"], "s", "k", "v").collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for at, w in want.items():
        assert got[at][0] == w[0] and got[at][3:] == w[3:], at
        assert w[0] is None or got[at][1:3] == pytest.approx(w[1:3], rel=1e-12), at


def test_a_task_holds_a_group_of_keys(spark, monkeypatch):
    monkeypatch.setattr(folds, "GROUP_KEYS", 50)
    rows = spark.range(4000).selectExpr("1 AS n", "cast(id % 4 AS int) AS s", "cast(id AS string) AS k", "1.0D AS v")
    seen = []
    whole = folds._decayed
    monkeypatch.setattr(folds, "_decayed", lambda marked, *a: seen.append(marked) or whole(marked, *a))
    got = folds.ewma_dominant(rows, ["n"], "s", "k", "v").orderBy("s").collect()
    assert [r.ties for r in got] == [1000] * 4
    assert max(r["count"] for r in seen[0].filter("not last").groupBy("g").count().collect()) < 200
