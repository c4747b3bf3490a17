"""What a Python worker holds between the operators of a pipeline."""

import os
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from urbanflow.llm import common, quality, simhash

FRAGMENTS = r"""
import re
from urbanflow.llm import common

def held():
    with open("/proc/self/smaps_rollup") as lines:
        return int(re.search(r"\nAnonymous:\s+(\d+)", lines.read())[1]) // 1024

def table():
    made = {n: bytes(1024) for n in range(150_000)}
    pins[:] = [made[n] for n in range(0, 150_000, 1000)] + [made[149_999]]
    return made

pins = []
common.kept("first", None, dict)
before = held()
common.kept("bpe", None, table)
full = held()
common.kept("quality", None, dict)
print(before, full, held())
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_tables_dropped_by_the_next_operator_go_back_to_the_system():
    """Pieces of the table that stay alive would keep all of it in the C library's heap."""
    found = subprocess.run([sys.executable, "-c", FRAGMENTS], capture_output=True, text=True, check=True,
                           env=os.environ | {"PYTHONPATH": os.pathsep.join(filter(None, sys.path))})
    before, full, after = map(int, re.findall(r"\d+", found.stdout))
    assert full - before > 140
    assert after - before < 40


class Rows:
    """One shard of training rows, with the steps of a DataFrame that a round takes."""

    def __init__(self, batch):
        self.batch = batch

    def repartitionByRange(self, *_):
        return self

    sortWithinPartitions = repartitionByRange

    def mapInArrow(self, run, _):
        self.batch = list(run(iter([self.batch])))
        return self

    def collect(self):
        return [row for batch in self.batch for row in batch.to_pylist()]


@pytest.fixture
def tables_of_bpe():
    common.kept("bpe", "tables", dict)
    yield
    common._KEPT.clear()


def test_training_drops_the_tables_of_the_last_operator(tables_of_bpe):
    rows = pa.RecordBatch.from_pydict({"shard": [0, 0], "turn": [1, 2], "label": [1, 0], "text": ["good one", None]})
    state = quality._one_round(Rows(rows), quality.Ftrl.fresh())
    assert np.count_nonzero(state.z) and "bpe" not in common._KEPT


def test_fingerprints_drop_the_tables_of_the_last_operator(tables_of_bpe, monkeypatch):
    made = []
    monkeypatch.setattr(simhash, "append_columns", lambda df, source, added, compute: made.append(compute))
    simhash.fingerprints(None)
    assert made[0](pa.array(["a b", None])) == [[simhash.fingerprint("a b"), 0]]
    assert "bpe" not in common._KEPT
