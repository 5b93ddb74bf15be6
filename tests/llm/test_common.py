"""What written tables leave behind, and when components are settled."""

from __future__ import annotations

from types import SimpleNamespace

from txnwatch.llm import common, components


def test_released_tables_leave_nothing_in_a_driver_that_fills(spark):
    asked = []
    for used, wanted in ((10, 0), (30, 1)):
        asked.clear()
        runtime = SimpleNamespace(totalMemory=lambda: 60, freeMemory=lambda used=used: 60 - used, maxMemory=lambda: 100)
        files = SimpleNamespace(delete=lambda path, deep: None)
        jvm = SimpleNamespace(
            org=SimpleNamespace(apache=SimpleNamespace(hadoop=SimpleNamespace(fs=SimpleNamespace(Path=lambda p: SimpleNamespace(getFileSystem=lambda c: files))))),
            java=SimpleNamespace(lang=SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda runtime=runtime: runtime))), System=SimpleNamespace(gc=lambda: asked.append(1)))
        context = SimpleNamespace(_jvm=jvm, _jsc=SimpleNamespace(hadoopConfiguration=lambda: None))
        common.release(SimpleNamespace(work_path="x", sparkSession=SimpleNamespace(sparkContext=context)))
        assert len(asked) == wanted


def test_settled_components_take_no_further_round(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(components, "materialize", lambda df, label, do=components.materialize: rounds.append(label) or do(df, label))

    def roots(edges):
        rounds.clear()
        return {(r["node"], r["root"]) for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots([(2, 1), (1, 3), (5, 4), (4, 4), (None, 7)]) == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)} and len(rounds) == 1
    assert roots([(1, 3), (2, 3)]) == {(1, 1), (2, 1), (3, 1)} and len(rounds) == 2
    assert roots([(i, i + 1) for i in range(40)]) == {(i, 0) for i in range(41)}
    assert roots([]) == set()
