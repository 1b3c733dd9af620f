"""The whole chain gives the same tables whether or not its keys are sliced."""

from __future__ import annotations

from faultline import schemas
from faultline.plans import domain, pipeline
from faultline.plans.oracle import RECOVERY_SECONDS
from faultline.plans.registry import _corpus_rows
from faultline.session import materialize


def test_decide_with_and_without_slices(spark, sf):
    corpus = materialize(pipeline.index_corpus(_corpus_rows(spark, sf)))

    def run(rows_per_slice):
        return pipeline.decide(
            domain.telemetry(spark, sf), domain.spec_versions(spark, sf), domain.registry(spark, sf),
            domain.crew_pings(spark, sf), corpus, crew_order=domain.CREW_ORDER,
            recovery_seconds=RECOVERY_SECONDS, rows_per_slice=rows_per_slice,
        )

    plain, sliced = run(None), run(16)
    contracts = {
        "incidents": schemas.INCIDENTS, "diagnosed": schemas.DIAGNOSED, "planned": schemas.PLANNED,
        "executed": schemas.EXECUTED, "control": schemas.CONTROL, "work_orders": schemas.WORK_ORDERS,
        "resolved": schemas.RESOLVED,
    }
    for name, contract in contracts.items():
        a, b = getattr(plain, name), getattr(sliced, name)
        assert [(f.name, f.dataType.simpleString()) for f in a.schema] == [(f.name, f.dataType.simpleString()) for f in contract], name
        keys = sorted(set(a.columns) - {"zscore"})
        assert a.count() > 0, name
        assert a.select(*keys).exceptAll(b.select(*keys)).isEmpty(), name
        assert a.count() == b.count(), name
