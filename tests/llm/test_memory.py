"""What Python tasks hold."""

import pyarrow as pa

from featuremill.llm import common


def test_memory_goes_back_after_each_batch(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(len(seen)))
    seen = []
    for part in common.parts(iter([pa.record_batch({"x": list(range(n))}) for n in (5, 3, 0)]), 2):
        seen.append(part.num_rows)
    assert seen == [2, 2, 1, 2, 1] and given == [3, 5, 5]
    monkeypatch.undo()
    common.give_back()


def test_batches_are_small_unless_the_session_says_otherwise(spark):
    common.tidy(spark)
    assert spark.conf.get(common.BATCH_SETTING) == str(common.BATCH_ROWS)
