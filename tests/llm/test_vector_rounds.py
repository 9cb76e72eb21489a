"""Inverted multi-index, heap-ordered clustering and product codes against plain versions."""

import hashlib
import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.llm import centroid_heaps, code_bounds, inverted_multi_index
from turnlake.llm.rounds import Exact, whole

SCHEMA = "vec_id long, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


def frame(spark, ids, vectors, labels=None):
    return spark.createDataFrame([(int(i), [float(x) for x in v], labels[n] if labels else None) for n, (i, v) in enumerate(zip(ids, vectors, strict=True))], SCHEMA)


def clumped(seed, n=400, width=8, scale=1.0):
    """Vectors around a few centres; a third of all rows are equal."""
    rng = np.random.default_rng(seed)
    out = rng.normal(size=(6, width))[rng.integers(6, size=n)] + rng.normal(size=(n, width)) * 0.3
    out[: n // 3] = out[0]
    return out * scale


def plain_means(data, centres, rounds):
    """Rounds of assignment and floored means in integers of any size."""
    data, centres = [[int(x) for x in v] for v in data], [[int(x) for x in c] for c in centres]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    near = lambda v: min(range(len(centres)), key=lambda c: (far(v, centres[c]), c))
    for _ in range(rounds):
        own = [near(v) for v in data]
        for c in range(len(centres)):
            if held := [v for v, o in zip(data, own, strict=True) if o == c]:
                centres[c] = [sum(x) // len(held) for x in zip(*held, strict=True)]
    own = [near(v) for v in data]
    return own, [far(v, centres[o]) for v, o in zip(data, own, strict=True)], centres


@pytest.mark.parametrize("scale", [1, 50, 2**50])
def test_clusters_equal_plain_rounds(spark, scale):
    vectors = clumped(3, scale=scale)
    ids = np.random.default_rng(1).permutation(1000)[:400]
    found = {r["vec_id"]: r for r in centroid_heaps.clustered(frame(spark, ids, vectors), 5, 4, 16, 8).collect()}
    data = np.floor(vectors * 16).astype(object)
    first = sorted(range(400), key=lambda i: hashlib.sha256(f"1:{ids[i]}".encode()).hexdigest())[:5]
    own, far, centres = plain_means(data, data[first], 4)
    top = 2**63 - 1
    assert {i: (r["cluster"], r["distance"]) for i, r in found.items()} == {int(i): (o, min(d, top)) for i, o, d in zip(ids, own, far, strict=True)}
    assert {r["inertia"] for r in found.values()} == {min(top, sum(min(d, top) for d in far))}
    assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest() for r in found.values())
    assert all(r["cluster_inertia"] == min(top, sum(min(d, top) for d, o in zip(far, own, strict=True) if o == r["cluster"])) for r in found.values())


def test_few_vectors_are_rescanned(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(5, 8))[np.arange(1000) % 5] * 5 + rng.normal(size=(1000, 8)) * 0.2
    rows = whole(frame(spark, range(1000), vectors), 64)
    starts = np.array([r["vec"] for r in rows.where("vec_id < 5").orderBy("vec_id").collect()], object)
    found, _, scanned = centroid_heaps.cluster(rows, starts, 3, Exact(3000, 8))
    assert scanned[0] == 1000 and max(scanned[1:]) < 100
    assert {(r["vec_id"] % 5, r["cluster"]) for r in found.collect()} == {(i, i) for i in range(5)}


def test_expired_keys_are_popped():
    clusters, keys = np.array([0, 0, 1, -1, 1]), np.array([0.5, 2.0, 3.0, 9.0, 1.0])
    assert centroid_heaps.expired(clusters, keys, np.array([1.0, 1.5]), 0.0).tolist() == [0, 3, 4]


@pytest.mark.parametrize("scale", [1, 2**45])
def test_codes_equal_plain_rounds(spark, scale):
    vectors, labels = clumped(5, 300, 12, scale), [None if i % 4 == 0 else i % 3 for i in range(300)]
    ids = np.random.default_rng(2).permutation(900)[:300]
    found = {r["vec_id"]: r for r in code_bounds.coded(frame(spark, ids, vectors, labels), 4, 6, 5, 32).collect()}
    data = np.floor(vectors * 32).astype(object)
    first, codes, error, books = np.argsort(ids)[:6], [[] for _ in ids], [0] * 300, []
    for p in range(4):
        part = data[:, 3 * p : 3 * p + 3]
        own, far, centres = plain_means(part, part[first], 5)
        for i in range(300):
            codes[i].append(own[i])
            error[i] += far[i]
        books += [x for c in centres for x in c]
    top = 2**63 - 1
    error = [min(x, top) for x in error]
    of = {lab: min(top, sum(e for e, x in zip(error, labels, strict=True) if x == lab)) for lab in set(labels)}
    sha = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    want = {int(i): ("".join(f"{c:02x}" for c in codes[n]), error[n], of[labels[n]], sha) for n, i in enumerate(ids)}
    assert {i: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for i, r in found.items()} == want


def test_bounds_save_comparisons(spark):
    rows = whole(frame(spark, range(600), clumped(6, 600, 8), [0] * 600), 4096, "label")
    data = np.array([r["vec"] for r in rows.orderBy("vec_id").limit(600).collect()], object).reshape(600, 2, 4)
    starts = data[200:216].transpose(1, 0, 2)
    _, _, told = code_bounds.trained(rows, starts, 6, Exact(20_000, 4))
    whole_scans = [counts[-1] for _, counts in told]
    assert whole_scans[0] == 1200 and max(whole_scans[2:]) < 600 and told[-1][0] <= 8
    assert all(sum(counts) == 1200 for _, counts in told)


def brute(ids, vectors, asked, k):
    out = {}
    for q in asked:
        scores = [(-float((vectors[i] * vectors[q]).sum()), int(ids[i])) for i in range(len(ids)) if ids[i] != ids[q]]
        out[int(ids[q])] = [i for _, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("spread", [0.1, 1.0])
def test_multi_index_recall(spark, spread):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(40, 16))[rng.integers(40, size=3000)] + rng.normal(size=(3000, 16)) * spread
    vectors *= rng.uniform(0.5, 2, size=(3000, 1))
    rows = inverted_multi_index.usable(frame(spark, range(3000), vectors))
    found, most = inverted_multi_index.top_k(rows.where("vec_id % 20 = 0"), rows, 10, page=500, slice_=40)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    want = brute(np.arange(3000), vectors, range(0, 3000, 20), 10)
    assert got.keys() == want.keys() and all([r["rank"] for r in rs] == list(range(1, 11)) for rs in got.values())
    assert sum(len({r["vec_id"] for r in got[q]} & set(want[q])) for q in want) >= 0.9 * 1500
    assert all(r["score"] == pytest.approx(float((vectors[q] * vectors[r["vec_id"]]).sum()), abs=1e-9) for q, rs in got.items() for r in rs)
    if spread == 0.1:
        assert most < 600  # of 3000


def test_given_all_entries_the_multi_index_is_exact(spark):
    vectors = clumped(9, 300)
    rows = inverted_multi_index.usable(frame(spark, range(300), vectors))
    found, _ = inverted_multi_index.top_k(rows.where("vec_id % 20 = 0"), rows, 7, wanted=1.0, page=64, slice_=4)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == brute(np.arange(300), vectors, range(0, 300, 20), 7)


def test_pairs_are_traversed_by_summed_distance():
    rng = np.random.default_rng(3)
    cells = inverted_multi_index.Cells((2.0, 2.0), [rng.normal(size=(5, 4)), rng.normal(size=(4, 4))], 3).counted(np.arange(20) % 3)
    query = rng.normal(size=6)
    far = lambda x, book: ((book[:, :-1] - x) ** 2).sum(1) + book[:, -1] ** 2
    sums = (far(query[:3], cells.books[0])[:, None] + far(query[3:], cells.books[1])).ravel()
    order = [c for c in np.argsort(sums).tolist() if c % 3]
    assert list(cells.traversed(query)) == order
    held = cells.probed(query, 7)
    assert held == order[: len(held)] and sum(c % 3 for c in held) >= 7 > sum(c % 3 for c in held[:-1])
    assert heapq.nsmallest(1, sums)[0] == sums[order[0]] or order[0] != int(np.argmin(sums))


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (20, [0.5, 0.5], None), (1, None, 1), (2, [NAN, 1.0], 1), (3, [INF, 1.0], 1), (4, [None, 1.0], 1), (5, [1.0], 2), (6, [1.0, 0.0], 2), (7, [], 1), (None, [1.0, 1.0], 1), (8, [-0.5, 0.0], None), (9, [1.0, 0.0], 1), (9, [1.0, 0.0], 1)]
    odd = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], f"{SCHEMA}, vec string, cluster string, near string")
    use = inverted_multi_index.usable(odd)
    found = {}
    for r in inverted_multi_index.top_k(use.where("vec_id % 20 = 0"), use, 9)[0].orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found == {0: [(5, 1.0), (6, 1.0), (9, 1.0), (9, 1.0), (20, 0.5), (8, -0.5)], 20: [(0, 0.5), (5, 0.5), (6, 0.5), (9, 0.5), (9, 0.5), (8, -0.25)]}
    kept = [0, 6, 8, 9, 9, 20]
    assert sorted(r["vec_id"] for r in centroid_heaps.clustered(odd, width=2).collect()) == kept
    assert sorted(r["vec_id"] for r in code_bounds.coded(odd, 2, 3).collect()) == sorted([*kept, 5, 7])
    errors = {r["vec_id"]: (r["error"], r["label_error"]) for r in code_bounds.coded(odd, 2, 16).collect()}
    assert all(e == (0, 0) for e in errors.values())
    none = odd.where("false")
    assert centroid_heaps.clustered(none).count() == 0 and code_bounds.coded(none).count() == 0
    assert inverted_multi_index.top_k(use.where("false"), use.where("false"), 5)[0].count() == 0
    assert inverted_multi_index.top_k(use.where("false"), use, 5)[0].count() == 0 and inverted_multi_index.top_k(use, use.where("false"), 5)[0].count() == 0
    assert code_bounds.coded(odd.drop("label"), 2).select(F.countDistinct("label_error")).first()[0] == 1
