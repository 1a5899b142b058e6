"""What a streamed fold does for a control row doesn't grow with the windows that are open."""

import pytest

from spanweave.operators import folds
from spanweave.streaming.windows import StreamWindow
from tests.fake_state import run

COLUMNS = ["pos", "op", "timestamp", "key", "value"]


@pytest.mark.parametrize("ordered", [False, True])
def test_open_windows_are_not_looked_at_again(ordered):
    keys, marks = 300, 200
    rows = [(n, "process", 400, f"k{n}", "v") for n in range(keys)]
    rows += [x for n in range(marks) for x in ((keys + 2 * n, "watermark", 500 + n, None, None), (keys + 2 * n + 1, "drain", None, None, None))]
    rows += [(keys + 2 * marks, "finish", None, None, None), *[(keys + 2 * marks + 1 + n, "drain", 7, None, None) for n in range(keys // 7 + 1)]]
    asked = []

    class Counted(StreamWindow):
        def _end(self, idx):
            asked.append(idx)
            return super()._end(idx)

    got = run(lambda: Counted(folds.FoldWindow(5_000), str, lambda a, x: a + x, ordered=ordered), rows, COLUMNS, 0, [keys + 50])
    assert [r[0] for r in got] == sorted(f"k{n}" for n in range(keys)) and all(r[4:6] == (1, '"v"') for r in got)
    assert len(asked) < 3 * len(rows)  # when each control row looked at all open windows, over 100,000
