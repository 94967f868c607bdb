"""Passes over archives: how often they run, what they hold, and that parts of a result equal the same parts of the whole."""
import itertools
import tracemalloc

import pyarrow as pa
import pytest

from artscan.operators import classfile, detectors
from artscan.plans import archive_queries, samples
from artscan.sources import archive

SMALL = "/root/testdata/sf0.001"


def passes(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


def made(n: int, make) -> list[pa.RecordBatch]:
    rows = [{"k": k, "s": k % 50, "_path": f"/m/{k}.jar"} for k in range(1, n + 1)]
    return list(samples.archives(iter([pa.RecordBatch.from_pylist(rows)]), make))


def test_small_archives_share_batches():
    given = made(600, archive_queries.with_levels)
    out = list(archive.exploded(iter(given)))
    assert sum(b.num_rows for b in out) > 600 and len(out) <= 1 + sum(b.num_rows for b in out) // archive.HELD_ROWS
    assert len({r for b in out for r in b.column("artifact_id").to_pylist()}) == 600


def test_large_archives_are_split():
    given = made(40, lambda r: samples.jar({f"{i}": b"x" * (3 << 20) for i in range(3)}))
    assert max(b.nbytes for b in given) < 20 << 20
    assert max(b.nbytes for b in archive.exploded(iter(given))) < 12 << 20


def test_unwanted_entries_are_read_but_keep_their_bytes():
    whole = [r for b in archive.exploded(iter(made(60, archive_queries.with_levels))) for r in b.to_pylist()]
    some = [r for b in archive.exploded(iter(made(60, archive_queries.with_levels)), wanted=lambda n: n == "a.txt") for r in b.to_pylist()]
    assert some == [r if r["name"] == "a.txt" else r | {"data": None} for r in whole]
    assert {"entry", "skip", "broken", "error"} <= {r["kind"] for r in some}


def test_few_classes_are_held_as_objects():
    entries = list(archive.exploded(iter(made(3000, archive_queries.with_call_and_string))))
    size = sum(len(d) for b in entries for d in b.column("data").to_pylist())
    out = list(classfile.read(iter(entries)))
    assert sum(b.num_rows for b in out) == 3000 and size > 2 * classfile.READ_BYTES
    one = pa.Table.from_batches(entries).combine_chunks().to_batches()  # a batch of any number of rows is cut
    cut = list(classfile.read(iter(one)))
    assert len(cut) >= size // (classfile.READ_BYTES + 5000) > 1
    assert pa.Table.from_batches(out).equals(pa.Table.from_batches(cut))


@pytest.mark.parametrize("name", ["detector_d12_image", "detector_d12_chunk", "detector_d12_pack", "detector_d12_calls", "detector_d13_coremod", "detector_d14_class_path", "archive_entries"])
def test_archives_are_read_once(spark, name):
    assert passes(archive_queries.queries()[name](spark, SMALL)) == 1


@pytest.mark.parametrize("name", ["detector_d14_signature", "undeclared_archives"])
def test_archives_of_several_branches_are_written_once(spark, name):
    assert passes(archive_queries.queries()[name](spark, SMALL)) == 0


def test_detectors_worked_out_singly_give_the_same_rows(spark):
    """Each detector's rows alone equal its share of all rows, plain and hidden; nothing else is worked out, and classes are read once."""
    seen = set()
    for make in (archive_queries.with_call_and_string, archive_queries.with_shapes, archive_queries.with_mixin):
        classes = archive_queries.classes_of(spark, SMALL, make)
        whole = detectors.class_evidence(classes).drop("seq").collect()
        for d in {r["detector_id"] for r in whole} | {"class_analysis"}:
            own = detectors.class_evidence(classes, only=(d,))
            assert d == "class_analysis" or passes(own) == 1
            assert sorted(map(str, own.drop("seq").collect())) == sorted(str(r) for r in whole if r["detector_id"] == d)
            seen.add(d)
    assert {f"d{i:02}" for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13)} <= seen
    hidden = archive_queries._hidden(spark, SMALL, "aes_embedded_key")
    whole = detectors.class_evidence(hidden).filter("detector_id = 'd02'").drop("seq").collect()
    assert whole and sorted(map(str, whole)) == sorted(map(str, detectors.class_evidence(hidden, only=("d02",)).drop("seq").collect()))


@pytest.mark.parametrize("make", [archive_queries.with_reference, archive_queries.with_call_and_string, archive_queries.with_shapes])
def test_a_pass_holds_no_more_for_more_rows(make):
    """What the Python of detector_d10_references, detector_d03 and class_switches holds at most is the same for three times the rows."""

    def most(n: int) -> int:
        rows = ({"k": k, "s": k % 50, "_path": f"/m/{k}.jar"} for k in range(n))
        given = (pa.RecordBatch.from_pylist(list(some)) for some in iter(lambda: list(itertools.islice(rows, 500)), []))
        before, count, arrow = pa.total_allocated_bytes(), 0, 0
        tracemalloc.start()
        for b in classfile.read(archive.exploded(samples.archives(given, make))):
            count, arrow = count + b.num_rows, max(arrow, pa.total_allocated_bytes() - before)
        objects = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert count == n
        return objects + arrow

    most(100)
    few = most(2000)
    assert most(6000) < 1.2 * few < 64 << 20
