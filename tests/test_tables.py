"""Workspaces of threads that run side by side, and what of the session stays as it was chosen."""

import os
import threading

from duetframe.sources.tables import BATCH_ROWS, scratch, ship_code, shared_dir, stored, workspace


def there(df):
    return all(os.path.exists(f.removeprefix("file://")) for f in df.inputFiles())


def test_workspaces_of_two_threads(spark):
    """Each thread's tables go with its own workspace, whichever ends first."""
    stop, ready, out = threading.Event(), threading.Event(), {}

    def slow():
        with workspace(spark) as keep:
            inner = stored(spark.range(5))
            out["files"] = inner.inputFiles()
            ready.set()
            stop.wait(60)
            out["alive"] = there(inner) and inner.count() == 5
            out["kept"] = keep(inner.where("id > 2"))

    t = threading.Thread(target=slow)
    t.start()
    ready.wait(60)
    with workspace(spark) as keep:
        a = stored(spark.range(3))
        with workspace(spark) as keep_inner:
            b = keep_inner(stored(spark.range(4)).where("id > 0"))
        assert there(b) and b.count() == 3
        files = a.inputFiles() + b.inputFiles()
        c = keep(a)
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files) and there(c) and c.count() == 3
    stop.set()
    t.join()
    assert not any(os.path.exists(f.removeprefix("file://")) for f in out["files"])
    assert out["alive"] and there(out["kept"]) and out["kept"].count() == 2


def test_scratch_paths_are_never_shared(spark):
    paths = {scratch(spark) for _ in range(10)}
    assert len(paths) == 10 and all(p.startswith(shared_dir(spark)) for p in paths)


def test_a_chosen_batch_size_stays(spark):
    sc, before = spark.sparkContext, spark.conf.get(BATCH_ROWS[0])
    other = spark.newSession()
    try:
        sc._duetframe_shipped = False
        other.conf.set(BATCH_ROWS[0], "10000")
        ship_code(other)
        assert other.conf.get(BATCH_ROWS[0]) == "10000"
        sc._duetframe_shipped = False
        fresh = spark.newSession()
        ship_code(fresh)
        assert fresh.conf.get(BATCH_ROWS[0]) == BATCH_ROWS[1]
    finally:
        sc._duetframe_shipped = True
    assert spark.conf.get(BATCH_ROWS[0]) == before
