"""Near copies in the pipeline, and links that are easily lost, against all pairs."""

import random

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from turnlake.llm import token_groups

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, size):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def alike(a, b, size):
    a, b = shingles(a, size), shingles(b, size)
    return len(a & b) / max(1, len(a | b))


def least_linked(texts, size, need):
    """The smallest number of each text's group, by comparing all pairs."""
    least = dict.fromkeys(texts)
    for start in sorted(texts):
        stack = [start] if least[start] is None else []
        while stack:
            if least[at := stack.pop()] is None:
                least[at] = start
                stack += [x for x in texts if least[x] is None and 100 * alike(texts[at], texts[x], size) >= need]
    return least


@pytest.fixture(scope="module")
def copies():
    """Texts of 200 words and copies with a changed block of words or a few scattered ones."""
    rng, texts = random.Random(21), []
    for _ in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        texts.append(" ".join(base))
        for changed in (range(40, 54), range(100, 114), (20, 60, 100), range(10, 90)):
            texts.append(" ".join(f"e{rng.randrange(10**6)}" if i in changed else w for i, w in enumerate(base)))
    found = dict(enumerate(texts))
    between = [(a, b) for a in found for b in found if a < b and alike(found[a], found[b], 5) >= 0.8 and alike(found[a], found[b], 3) < 0.9]
    assert len(between) >= 12  # what 3 words and 90 of 100 do not find
    return found


def test_stage_keeps_one_of_each_group(spark, copies):
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in copies.items()], DOCS)
    left = {r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, rows, "").collect()}
    assert left == set(least_linked(copies, 5, 80).values())


def test_run_keeps_one_of_each_group(spark, copies, tmp_path):
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in copies.items()], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    left = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(left) == sorted(set(least_linked(copies, 5, 80).values()))  # one language and one source: the other stages drop no row


@pytest.mark.parametrize("step", [1, 3, 7, 60])
def test_runs_over_batches(step):
    sketch = np.full(token_groups.CLASSES, 3, np.uint8).tobytes()
    runs = [(1, 3), (2, 18), (3, 1), (4, 21), (5, 2), (6, 17)]
    rows = pd.DataFrame([(s, i, 12, sketch) for s, n in runs for i in range(100 * s, 100 * s + n)], columns=["signature", "node", "n", "sketch"])
    batches = (rows.iloc[i : i + step].reset_index(drop=True) for i in range(0, len(rows), step))
    found = {tuple(map(int, x)) for part in token_groups._possible(90, 100)(batches) for x in part.to_numpy()}
    groups = least = {n: n for _, n in ((s, i) for s, k in runs for i in range(100 * s, 100 * s + k))}
    for _ in range(25):
        for a, b in found:
            least[a] = least[b] = min(least[a], least[b])
    assert groups == {i: 100 * s for s, n in runs for i in range(100 * s, 100 * s + n)}


def test_crowded_signatures(spark, monkeypatch):
    monkeypatch.setattr(token_groups, "CROWD", 4)
    rng = np.random.default_rng(3)
    runs = [(1, 3), (2, 18), (3, 1), (4, 5), (5, 40), (6, 2), (7, 4)]
    rows = [(100 * s + i, 12, bytearray(rng.integers(0, 200, token_groups.CLASSES).astype(np.uint8).tobytes()), [(1, 0 if i < 30 else 1, [2 * s + 1, 2 * (1000 + 100 * s + i) + 1])]) for s, n in runs for i in range(n)]
    frame = spark.createDataFrame(rows, f"doc_id long, n_shingles long, sketch binary, signatures {token_groups.SIGNATURES}")
    found = {(r["node"], r["component"]) for r in token_groups.neighbourhoods(frame).collect()}
    # no two sketches are near: links come only from crowded runs, between those who cannot do without them
    assert found == {(100 * s + i, 100 * s) for s, n in runs if n > 4 for i in range(min(n, 30))}


def test_any_two_alike_share_enough_parts():
    """Sets as different as may be agree in more parts than they can do without."""
    rng = np.random.default_rng(5)
    for n in [*range(1, 40), 75, 200, 431]:
        for need in (80, 90):
            for _ in range(6):
                a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
                gone = int(rng.integers(0, len(a) // 4 + 1))
                b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**64, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)]))
                common = len(np.intersect1d(a, b))
                if 100 * common < need * (len(a) + len(b) - common):
                    continue
                mine, theirs = ({x["band"]: x for x in token_groups.signatures(s, need, 100)} for s in (a, b))
                assert any(len(np.intersect1d(mine[k]["parts"], theirs[k]["parts"])) > max(0, min(mine[k]["spare"], theirs[k]["spare"])) for k in mine.keys() & theirs.keys()), (n, need)


def test_repeated_rows(spark):
    base = [f"w{i}" for i in range(100)]
    near = " ".join(base[:50] + ["e"] + base[51:])
    rows = [(1, " ".join(base))] * 30 + [(2, near)] * 30 + [(2, "something else of a few words")] + [(3, "something else of a few words")]
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in token_groups.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == sorted([(1, 98, 1)] * 30 + [(2, 98, 1)] * 30 + [(2, 4, 1), (3, 4, 1)])


def test_copy_without_number_comes_first(spark):
    base = [f"w{i}" for i in range(100)]
    near = " ".join(base[:50] + ["e"] + base[51:])
    rows = spark.createDataFrame([(None, " ".join(base)), (2**62 + 1, " ".join(base)), (2**62 + 3, near), (None, near)], "doc_id long, text string").coalesce(1)
    found = sorted((r["doc_id"], r["component_id"]) for r in token_groups.join(rows).collect() if r["doc_id"] is not None)
    assert found == [(2**62 + 1, 2**62 + 1), (2**62 + 3, 2**62 + 1)]
