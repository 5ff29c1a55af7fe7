from hypothesis import given
from hypothesis import strategies as st

from spanloom.operators.compaction import MOST_SOURCES, Compactor, next_batch
from spanloom.sources.records import SPANS
from spanloom.sources.store import File, Store
from tests.spans import at, frame, names, span

MB = 1 << 20


def files(*sizes):
    return [File(f"/p/f{i:03d}.parquet", s) for i, s in enumerate(sizes)]


def test_batches():
    assert next_batch(files(1), True) == []
    assert len(next_batch(files(1, 1), True)) == 2 and next_batch(files(1, 1), False) == []
    assert len(next_batch(files(*[5] * 9), False)) == MOST_SOURCES
    # an open partition leaves its crumbs alone beside a large file, a closed one doesn't
    assert next_batch(files(1, 1, 1, 100 * MB), False) == [] and len(next_batch(files(1, 1, 1, 100 * MB), True)) == 4
    assert [f.size for f in next_batch(files(70 * MB, 60 * MB, 50 * MB), False)] == [50 * MB, 60 * MB]
    assert next_batch(files(200 * MB, 128 * MB), True) == []


@given(st.lists(st.integers(1, 200 * MB), max_size=20), st.booleans())
def test_batches_hold_their_bounds(sizes, closed):
    batch = next_batch(files(*sizes), closed)
    assert len(batch) != 1 and len(batch) <= MOST_SOURCES and sum(f.size for f in batch) <= 128 * MB
    assert all(f.size < 128 * MB for f in batch) and len(set(batch)) == len(batch)
    if batch and not closed:
        assert max(f.size for f in batch) <= 8 * min(f.size for f in batch)


def test_older_days_merge_into_one_file(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for i in range(7):
        store.write(SPANS, frame(spark, span(f"s{i}", f"t{6 - i}")))
    for i in range(2):
        store.write(SPANS, frame(spark, span(f"n{i}", received=at(18))))
    before = sorted(names(store.read(SPANS)))
    report = Compactor(store, SPANS).run()
    assert (report.before, report.after) == (9, 3) and sorted(names(store.read(SPANS))) == before
    assert len(store.all_files(SPANS, "2026-08-17T00:00:00Z")) == 1
    assert names(store.spark.read.schema(SPANS.read_schema).parquet(store.all_files(SPANS, "2026-08-17T00:00:00Z")[0].path)) == ["s6", "s5", "s4", "s3", "s2", "s1", "s0"]


def test_resent_rows_collapse_and_stale_files_go(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    day = "2026-08-17T00:00:00Z"
    store.write(SPANS, frame(spark, span("s1", received=at(17, 9))), lambda *_: "aaa.parquet")
    store.write(SPANS, frame(spark, span("s1", received=at(17, 10), ended_at=at(17, 10))), lambda *_: "bbb.parquet")
    compactor = Compactor(store, SPANS, keep_sources=True)
    compactor.partition(day, closed=True)
    assert len(store.all_files(SPANS, day)) == 3 and len(store.live_files(SPANS)) == 1  # hidden, not yet deleted
    assert store.read(SPANS).first()["ended_at"] is not None and store.read(SPANS).count() == 1
    compactor.partition(day, closed=True)
    assert len(store.all_files(SPANS, day)) == 1
    assert store.files.create_once(f"{store.table_path(SPANS)}/_locks/partition=2026-08-17T00%3A00%3A00Z")
    assert compactor.partition(day, closed=True) == 0  # another one holds the lock
