"""What a Python worker keeps behind a task, which counts as the executor's memory in the next stage."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

pytest.importorskip("tallywood.llm")
import public_tokenizers

from tallywood.llm import bytepair, decontaminate, jaccard, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
REPO = Path(__file__).resolve().parents[2]
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture
def tasks(spark, monkeypatch):
    """(operator's columns, function) of all tasks in Arrow that are planned."""
    kind, found = type(spark.range(0)), []
    plan = kind.mapInArrow

    def noted(self, run, schema, *more):
        found.append((self.columns, run))
        return plan(self, run, schema, *more)

    monkeypatch.setattr(kind, "mapInArrow", noted)
    return found


def test_other_operators_drop_the_coders_tables(spark, tasks):
    docs = spark.createDataFrame([(1, "one two three four five six", "en", "s", 27), (2, "seven", "en", "s", 5)], DOCS)
    marks = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    rows = pa.table({"doc_id": [1, 2], "text": ["one two", "seven"], "n_chars": [7, 5], "mark": [3, 4]}).to_batches()[0]

    bytepair.round_trip(docs, RANKS, public_tokenizers.PATTERN)
    code = tasks[-1][1]
    sums = list(code(iter([rows])))
    assert len(bytepair._codecs) == 1
    kept = next(iter(bytepair._codecs.values()))
    assert list(code(iter([rows]))) == sums and next(iter(bytepair._codecs.values())) is kept  # tasks of its own keep them

    for plan in (lambda: quality.keep_quality(docs, marks), lambda: jaccard.classes(docs.select("doc_id", "text"), 5, 80, 100), lambda: decontaminate.keep_clean(docs, items)):
        list(code(iter([rows])))
        assert bytepair._codecs
        plan()
        list(tasks[-1][1](iter([rows])))
        assert not bytepair._codecs
    assert list(code(iter([rows]))) == sums


GROW = """
import re, sys
import pyarrow as pa
from tallywood.llm.common import tidy
last = []
def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024
def run(batches):
    for batch in batches:
        rows = [bytes(1000) + bytes([i % 251]) for i in range(60_000)]
        last.append(rows[-1])  # what lives on behind freed memory
        del rows
        yield pa.RecordBatch.from_arrays([pa.array([1])], ["n"])
task = tidy(run) if sys.argv[1] == "tidy" else run
list(run([])), pa.array([1])
before = held()
for _ in task(iter([pa.RecordBatch.from_arrays([pa.array([1])], ["n"])] * 3)):
    pass
print(held() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_task_gives_freed_memory_back():
    plain, tidied = (int(subprocess.run([sys.executable, "-c", GROW, how], capture_output=True, text=True, timeout=120, check=True, cwd=REPO).stdout) for how in ("plain", "tidy"))
    assert plain - tidied > 30, (plain, tidied)
