from yieldnorm.plans import flows, notebooks
from yieldnorm.sources import fixtures

from .conftest import SF0001


def test_training_notebook(spark):
    w, r, y = flows.fixture_inputs(spark, SF0001)
    out = notebooks.training(w, r, y, params={"maxIter": 3, "maxDepth": 2}, save_predictions_as="yn_pred_corn")
    assert out["predictions"].count() == 29
    assert out["largest_residuals"].count() == 29 and out["underperformers"].count() == 20
    assert spark.table("yn_pred_corn").count() == 29
    m = out["metrics"].first()
    assert m.n == 29 and m.rmse >= 0


def test_correlation_notebook(spark):
    w, r, y = flows.fixture_inputs(spark, SF0001)
    out = notebooks.correlation(w, r, y)
    crops = {row.commodity_name for row in out["pearson"].select("commodity_name").distinct().collect()}
    assert crops <= {" Corn", " Soybeans"} and crops
    assert out["pearson"].count() == 5 * len(crops)


def test_enrichment_notebook(spark):
    out = notebooks.enrichment(fixtures.flagged_anomalies(spark, SF0001), fixtures.county_summary(spark, SF0001),
                               fixtures.fips_master(spark, SF0001), save=True)
    assert out["anomalies_geo"].count() == 11
    assert out["summary_geo"].count() == 10
    assert spark.table("flagged_anomalies_geo").count() == 11
