import pytest

from tillcast.llm import quality, toxicity


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_only_the_sample_reaches_the_fit(spark, monkeypatch, module, label):
    """The fit's one task reads from an exchange, so scan and join before it stay parallel."""
    plans = []
    for name in ("toPandas", "collect"):
        def seen(self, *args, f=getattr(type(spark.range(1)), name)):
            plans.append(self._jdf.queryExecution().executedPlan().toString())
            return f(self, *args)
        monkeypatch.setattr(type(spark.range(1)), name, seen)
    rows = [(i, f"some words here number {i}", i % 2) for i in range(20)]
    module.train(spark.createDataFrame(rows, f"doc_id long, text string, {label} int").repartition(3, "doc_id"))
    fit = [p for p in plans if "MapInArrow" in p]
    assert fit and all("Coalesce" not in p and "SinglePartition" in p for p in fit)
