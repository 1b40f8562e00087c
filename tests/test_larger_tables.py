"""What larger tables would multiply: how often views are worked out and written, and what a task of a search holds at once."""

import re
import tracemalloc

import numpy as np
import pandas as pd

from strandlake.operators import association as A
from strandlake.plans import catalog

SF = "/root/testdata/sf0.001"


def plans_of(spark, run) -> list[str]:
    """The physical plans of everything that run executes."""
    told = spark._jsparkSession.sharedState().statusStore()
    done = lambda: spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    done()
    before = told.executionsCount()
    run()
    done()
    found = told.executionsList()
    plans = [found.apply(i).physicalPlanDescription() for i in range(before, found.size())]
    return [p for p in plans if "CreateViewCommand" not in p]


def test_tracts_work_out_haplotypes_once(spark):
    plans = plans_of(spark, lambda: catalog.QUERIES["d33_tract_summary"](spark, SF).collect())
    assert len([p for p in plans if "l_linenumber" in p]) == 1


def test_call_rates_move_rows_once(spark):
    plans = plans_of(spark, lambda: catalog.QUERIES["g26_call_rate"](spark, SF).collect())
    assert len([p for p in plans if "l_linenumber" in p]) == 1
    assert not any("InsertInto" in p for p in plans)


def test_nearest_holds_few_pairs_at_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    kept, frame = {}, type(spark.range(0))
    monkeypatch.setattr(frame, "mapInPandas", lambda self, f, schema, plain=frame.mapInPandas: (kept.update({f.__name__: f}), plain(self, f, schema))[1])
    refs = rng.normal(size=(2500, 3))
    df = spark.createDataFrame([(i, "x", v.tolist()) for i, v in enumerate(refs)], "id long, label string, v array<double>")
    A.nearest(df.limit(1).select("id", "v"), df, 15)

    def largest(f, batch) -> tuple[float, pd.DataFrame]:
        tracemalloc.start()
        out = list(f([batch]))
        top = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        return top, pd.concat(out)

    asked = rng.normal(size=(1000, 3))
    far = {"qaway": np.zeros(1000), "qbound": np.full(1000, np.inf), "raway": np.zeros(2500), "rlabel": np.full(2500, "x")}
    mb, got = largest(kept["measure"], pd.DataFrame([{"qid": np.arange(1000), "qv": asked.ravel(), "rid": np.arange(2500), "rv": refs.ravel(), **far}]))
    assert mb < 40  # 12; with all 2,500,000 pairs at once 140
    assert got["n"].sum() == 2_500_000
    for q in (0, 63, 64, 999):
        assert got[got["id"] == q].sort_values("d")["ref"].tolist() == np.argsort(((refs - asked[q]) ** 2).sum(1))[:15].tolist()
    mb, got = largest(kept["send"], pd.DataFrame({"id": np.arange(10_000), "v": [*np.tile(asked, (10, 1))]}))
    assert mb < 60  # 20; with the bounds of all queries at once 121
    assert got["id"].nunique() == 10_000


def test_labels_broadcast_no_vectors(spark):
    plans = plans_of(spark, lambda: catalog.QUERIES["h6_infer_labels"](spark, SF).collect())
    kinds = [kind for p in plans for kind in re.findall(r"\) (\w+Join)[^\n]*\nLeft keys \[2\]: \[cell#\d+, chunk#\d+\]", p)]
    assert set(kinds) == {"SortMergeJoin"}
