"""Recovery: the table of states, and a publish killed at each of its steps."""

import itertools

import pytest

from lectern.sources import publishing as P


def test_every_state_keeps_a_complete_copy():
    for live, reads, committed, staging, rows, marker, named in itertools.product([0, 1], [0, 1], [0, 1], [0, 1], [None, 3], [0, 1], [None, 3, 4]):
        if (reads or committed) and not live or rows and not staging or named and not marker:
            continue
        step = P.decide(P.State(bool(live), bool(reads), bool(committed), bool(staging), rows, bool(marker), named))
        if not staging:
            assert step == (P.FORGET if marker else P.NOTHING)
        elif marker:
            assert step == (P.PROMOTE if rows == 3 and named in (None, 3) else P.REFUSE)
        elif live and reads:
            assert step == P.DISCARD
        elif live and committed or rows is None:
            assert step == P.REFUSE
        else:
            assert step == P.PROMOTE


class Killed(BaseException):
    pass


@pytest.mark.parametrize("first", [True, False])
def test_a_publish_killed_at_any_step_is_finished_or_undone(spark, tmp_path, monkeypatch, first):
    old, new = spark.range(5), spark.range(100, 107)
    outcomes = set()
    for stop in range(1, 12):
        tables = P.Tables(spark, f"file://{tmp_path}/{stop}")
        if not first:
            tables.publish("t", old)
        steps = []

        def step(f, when):
            def run(*a):
                if when == "after":
                    f(*a)
                steps.append(f)
                if len(steps) == stop:
                    raise Killed
                if when == "before":
                    f(*a)

            return run

        with monkeypatch.context() as m:
            m.setattr(tables, "_write_marker", step(step(tables._write_marker, "before"), "after"))
            m.setattr(tables, "_delete", step(step(tables._delete, "before"), "after"))
            try:
                tables.publish("t", new)
                done = True
            except Killed:
                done = False
        again = P.Tables(spark, f"file://{tmp_path}/{stop}")
        before = again.readable("t")
        ids = {r.id for r in before.collect()}
        outcomes.add((again.recover("t"), len(ids)))
        after = {r.id for r in again.readable("t").collect()}
        assert after == ids and ids in ({*range(5)}, {*range(100, 107)}) and (not done or len(ids) == 7)
        assert again.state("t") == P.State(True, True, True, False, None, False, None)
        assert again.publish("t", new) == 7
        if done:
            break
    else:
        raise AssertionError("never done")
    assert (P.PROMOTE, 7) in outcomes and ((P.DISCARD, 5) in outcomes or first)


def test_nothing_is_deleted_when_no_copy_is_complete(spark, tmp_path):
    tables = P.Tables(spark, f"file://{tmp_path}/x")
    assert tables.recover("t") == P.NOTHING and tables.readable("t") is None
    tables.publish("t", spark.range(3))
    staged = tmp_path / "x/t.staging"
    staged.mkdir()
    (staged / "part-0.parquet").write_bytes(b"torn")
    assert tables.recover("t") == P.DISCARD and not staged.exists()
    for p in (tmp_path / "x/t").glob("*.parquet"):
        p.write_bytes(b"torn")
    spark.range(2).write.parquet(str(staged))
    with pytest.raises(P.RecoveryError):
        tables.publish("t", spark.range(3))  # committed, and cannot be read now
    assert staged.exists() and (tmp_path / "x/t/_SUCCESS").exists()
    (tmp_path / "x/t/_SUCCESS").unlink()
    assert tables.readable("t").count() == 2 and tables.recover("t") == P.PROMOTE and tables.readable("t").count() == 2
    (tmp_path / "x/.publish-t").write_text("torn")
    assert tables.recover("t") == P.FORGET and not (tmp_path / "x/.publish-t").exists()
    with pytest.raises(P.NoRows):
        tables.publish("t", spark.range(0))
    assert tables.readable("t").count() == 2
    spark.range(9).write.parquet(str(staged))
    tables._write_marker("t", 4)
    with pytest.raises(P.RecoveryError):
        tables.recover("t")
    assert tables.state("t").staged_rows == 9
