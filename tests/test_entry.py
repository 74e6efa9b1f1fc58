import importlib
import os
import sys

import pytest

FOLDER = "/root/testdata/sf0.001"


def test_every_query_has_a_plan(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="no data")
def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() >= 0


def test_queries_stand_without_the_subpackage(monkeypatch):
    entry = importlib.import_module("__spark_entry__")
    for name in [m for m in sys.modules if m.startswith("kinomill.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "kinomill.llm.queries", None)  # importing it raises ImportError
    names = entry.queries()
    assert "p2_found" in names and "p1_found" not in names


def test_a_cluster_must_name_its_shared_folder():
    lineage = importlib.import_module("kinomill.lineage")

    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

            class _jsc:  # noqa: N801
                @staticmethod
                def sc():
                    class Context:
                        @staticmethod
                        def getCheckpointDir():
                            class Option:
                                isEmpty = staticmethod(lambda: True)

                            return Option

                    return Context

    with pytest.raises(RuntimeError):
        lineage.shared_dir(Session)


def test_nothing_outside_imports_the_subpackage():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(here, "kinomill")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as source:
                    assert "kinomill.llm" not in source.read(), name
    assert sys.modules
