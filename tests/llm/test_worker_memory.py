"""What the stages of the pipeline ask of the Python workers of an executor: one for each task, and little memory."""

import random
import re
import tracemalloc

import pytest

from turnlake.llm import language_fusion, run_index, shingles


def test_a_task_judges_languages_with_one_python_worker(spark):
    rows = [(1, "the cat and the dog", "en", "a.com"), (2, "der Hund und die Katze", "de", "b.de"), (3, "a dog", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    judged = language_fusion.fuse(docs).where("lid.kept").select(*docs.columns)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("ArrowEvalPython", plan)) == 1
    assert {r["doc_id"] for r in judged.collect()} >= {1, 2}


@pytest.mark.parametrize("step", ["stretches", "index", "shingles"])
def test_a_step_holds_little_beside_its_texts(step):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(500)) for _ in range(500)]
    raws = [x.encode() for x in texts]
    run_index._powers.cache_clear()
    tracemalloc.start()
    if step == "stretches":
        counts, _ = run_index.stretches(raws, run_index.PASSAGE)
        assert min(counts) > 0
    elif step == "index":
        block = raws[: run_index.BLOCK // len(raws[0])]
        block[-1] = block[0]
        assert [bool(x) for x in run_index.RunIndex(block).repeated(run_index.PASSAGE)] == [True, *[False] * (len(block) - 2), True]
    else:
        assert sum(1 for _ in shingles.shingle_hashes(texts, 5)) == len(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print(step, peak)
    assert peak < 64e6
