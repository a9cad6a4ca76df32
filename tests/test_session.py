from types import SimpleNamespace

import pytest

from coldkeep import session
from coldkeep.sources.fs import Files


class Conf(dict):
    def set(self, key, value):
        self[key] = value


def fake(master, **conf):
    return SimpleNamespace(conf=Conf(conf), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.workspace(fake("yarn"), "x")
    shared = session.workspace(fake("yarn", **{"spark.checkpoint.dir": "hdfs:/shared/"}), "x")
    assert shared.startswith("hdfs:/shared/coldkeep/x-")
    session._left.remove(shared)


def test_local_session_may_use_a_temporary_folder():
    spark = fake("local[2]")
    first, second = session.workspace(spark, "x"), session.workspace(spark, "x")
    assert first.startswith("file:/") and first != second
    assert first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
    for folder in (first, second):
        session._left.remove(folder)


def test_prepare_pins_settings():
    spark = fake("local[2]", **{"spark.sql.session.timeZone": "America/New_York"})
    session.prepare(spark)
    assert spark.conf["spark.sql.session.timeZone"] == "UTC" and spark.conf["spark.sql.ansi.enabled"] == "true"


def test_release_deletes_working_folders(spark):
    session.release(spark)
    kept = session.written(spark, spark.range(3), "x")
    [folder] = session._left
    assert kept.count() == 3 and Files(spark).exists(folder)
    assert session.release(spark) == 1 and not Files(spark).exists(folder)
    assert session.release(spark) == 0


def test_together_raises_after_all_have_finished(spark):
    done = []

    def fails():
        raise KeyError("first")

    with pytest.raises(KeyError):
        session.together(spark, [fails, lambda: done.append(spark.range(5).count())])
    assert done == [5]
    assert session.together(spark, [lambda: 1]) == [1]
    assert session.together(spark, [lambda n=n: n for n in range(6)]) == list(range(6))
