import random

import pytest

from turnlake.operators import heat

SCHEMA = "scope long, item long, at double, weight double"


def loop(accesses, half_life, now, cap):
    by = {}
    for scope, item, at, weight in accesses:
        if None not in (scope, item, at, weight) and at <= now:
            times = by.setdefault((scope, item), {})
            times[at] = times.get(at, 0.0) + weight
    found = {}
    for key, times in by.items():
        energy, last, tier = 0.0, None, "COLD"

        def step(e, tier):
            e = round(e, 9)
            if e >= 0.75 or (tier == "HOT" and e >= 0.65):
                return "HOT"
            return "COLD" if e < 0.25 or (tier == "COLD" and e < 0.35) else "WARM"

        for at in sorted(times):
            energy *= 0.5 ** ((at - last) / half_life) if last is not None else 1
            tier = step(step(energy, tier) and energy, step(energy, tier))
            energy += times[at]
            tier = step(energy, tier)
            last = at
        energy *= 0.5 ** ((now - last) / half_life)
        found[key] = [round(energy, 9), len(times), step(energy, tier)]
    for scope in {s for s, _ in found}:
        hot = sorted((-e, i) for (s, i), (e, _, t) in found.items() if s == scope and t == "HOT")
        for _, i in hot[cap:]:
            found[scope, i][2] = "WARM"
    return found


@pytest.mark.parametrize("seed,span", [(1, 50), (2, 500), (3, 100_000)])
def test_equal_to_a_loop(spark, seed, span):
    rng = random.Random(seed)
    rows = [(rng.randrange(3), rng.randrange(40), round(rng.uniform(-span, span), 1), rng.choice([0.2, 0.3, 0.5])) for _ in range(1500)]
    rows += [(1, i, float(span - 2 * i), 0.5) for i in range(30)] + [(1, i, float(span - 2 * i - 1), 0.5) for i in range(30)]
    rows += [(9, 1, 0.0, 0.5), (9, 1, 0.0, 0.3), (9, 2, None, 1.0), (9, 3, 1.0, None), (None, 4, 1.0, 1.0), (9, 5, span + 1.0, 1.0)]
    found = {(r["scope"], r["item"]): [r["energy"], r["n_accesses"], r["tier"]] for r in heat.tiers(spark.createDataFrame(rows, SCHEMA), 20.0, float(span), 5).collect()}
    want = loop(rows, 20.0, float(span), 5)
    assert found.keys() == want.keys()
    assert all(found[k][0] == pytest.approx(want[k][0], abs=2e-9) and found[k][1:] == want[k][1:] for k in want)
    assert len({t for _, _, t in found.values()}) >= 2


def test_nothing(spark):
    assert heat.tiers(spark.createDataFrame([], SCHEMA), 1.0, 0.0).count() == 0
