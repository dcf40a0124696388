"""Keys of a bucket share its state: few calls to the state store, each key folded on its own, idle keys forgotten."""

import json
from types import SimpleNamespace

import pandas as pd
from pyspark.sql.types import StructType

from quillwright.streaming.ordered import OrderedFold


class Handle:
    """A state store that counts calls."""

    def __init__(self):
        self.calls, self.timers, self.lists = 0, set(), {}

    def getListState(self, name, schema):  # noqa: N802
        rows = self.lists.setdefault(name, [])

        def called(f):
            def run(*x):
                self.calls += 1
                return f(*x)

            return run

        def put(new):
            rows[:] = new

        return SimpleNamespace(get=called(lambda: iter(list(rows))), put=called(put), appendList=called(rows.extend), clear=called(rows.clear))

    def listTimers(self):  # noqa: N802
        self.calls += 1
        return list(self.timers)

    def registerTimer(self, ms):  # noqa: N802
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.calls += 1
        self.timers.discard(ms)


def test_few_calls_for_many_keys(spark):
    fold = OrderedFold(["id"], StructType.fromDDL("key_ string, us_ bigint, id bigint"), StructType.fromDDL("n bigint"), ["k", "ids"], lambda key, last, rows: (((last[0] if last else 0) + len(rows),), [(key[0], [i for _, i in rows])]), 1000)
    handle = Handle()
    fold.init(handle)
    rows = [(json.dumps({"k": f"k{i % 500}"}), (2000 - i) * 1000, i) for i in range(2000)]
    list(fold.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["key_", "us_", "id"])]), None))
    out = list(fold.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 1500), None))
    got = {r.k: r.ids for r in pd.concat(out).itertuples()}
    assert got == {f"k{k}": [i for i in range(1999, -1, -1) if i % 500 == k and 2000 - i <= 1500] for k in range(500)}
    assert handle.calls < 12 and len(handle.lists["waiting"]) == 500 and {r[2] for r in handle.lists["states"]} == {3}
    handle.timers.clear()
    list(fold.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 2100), None))
    assert not handle.lists["waiting"] and {r[2] for r in handle.lists["states"]} == {4} and min(handle.timers) > 2100
    list(fold.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 3600), None))
    assert not handle.lists["states"]
