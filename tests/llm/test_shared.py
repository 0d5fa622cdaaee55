"""Memory that tasks give back."""

import re
from pathlib import Path

import pyarrow as pa
import pytest

from jobtrail.llm.shared import releasing, releasing_group


def held():
    """MB of this process's own memory."""
    return sum(map(int, re.findall(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


@pytest.mark.parametrize("form", ["batches", "group", "cogroup"])
def test_freed_memory_is_returned(form):
    """A word that outlives its task does not keep the pages of those freed below it."""
    kept, batch = [], pa.RecordBatch.from_pydict({"x": [1]})

    def work():
        words = [bytes(1000) for _ in range(100_000)]
        kept.append(bytes(1000))
        return len(words)

    def batches(rows):
        for row in rows:
            work()
            yield row

    before = held()
    if form == "batches":
        assert list(releasing(batches)(iter([batch]))) == [batch]
    else:
        table = pa.Table.from_batches([batch])
        function = {"group": lambda t: (work(), t)[1], "cogroup": lambda t, u: (work(), u)[1]}[form]
        assert releasing_group(function)(*[table] * (1 if form == "group" else 2)) is table
    assert kept and held() - before < 40
