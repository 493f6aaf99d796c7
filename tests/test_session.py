import importlib
import os
import sys

import pytest

from yakinma import session


class Fake:
    """A session on a cluster without a shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError):
        session.shared_dir(Fake)


def test_the_submitter_wins(monkeypatch):
    set_there, made = {"spark.master": "yarn", "spark.sql.shuffle.partitions": "4000", "spark.sql.adaptive.enabled": "false"}, {}

    class Conf:
        def contains(self, key):
            return key in set_there

    class Builder:
        def appName(self, _):
            return self

        def config(self, k, v):
            made[k] = v
            return self

        def getOrCreate(self):
            return made

    class Session:
        builder = Builder()

    monkeypatch.setattr(session, "SparkSession", Session)
    monkeypatch.setattr(session, "_submitted", Conf)
    got = session.build_session()
    assert not set(got) & set(set_there) and got["spark.sql.session.timeZone"] == "UTC"


def test_intermediates_lie_in_the_folder_of_the_application(spark):
    path = session.work_dir(spark)
    assert path.endswith(spark.sparkContext.applicationId)
    assert session.materialise(spark.range(3)).count() == 3


def test_entry_without_the_optional_subpackage(monkeypatch):
    import __spark_entry__ as entry

    real = importlib.import_module

    def broken(name, *a):
        if name.startswith("yakinma.llm"):
            raise ModuleNotFoundError(name)
        return real(name, *a)

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    assert "category_summary" in entry.queries() and not any(n.startswith("p1_") for n in entry.queries())
    assert os.path.basename(sys.modules["__spark_entry__"].__file__) == "__spark_entry__.py"
