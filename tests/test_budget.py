"""The registered queries do the whole job: every candidate, fold and tree."""

import pytest

from spendsignals.plans import catalog  # noqa: F401
from spendsignals.plans import models as M
from spendsignals.plans import q_models as Q


class Stop(Exception):
    pass


@pytest.mark.parametrize("kind,space", [("forest", M.RF_SPACE), ("boosted", M.GBT_SPACE)])
def test_search_and_fit_are_whole(monkeypatch, kind, space):
    """40 candidates over five folds with all their trees; the winner is fitted with all of its trees."""
    seen = []
    monkeypatch.setattr(Q, "_KEPT", {})
    monkeypatch.setattr(M.trees, "search", lambda data, kind, candidates, folds: (seen.append((kind, candidates, folds)), ([0.5] * 7 + [0.9] + [0.5] * 32, 1))[1])
    c = Q.ModelCtx.__new__(Q.ModelCtx)
    c.__dict__.update(packed=None, sf="x", spark=type("S", (), {"sparkContext": type("C", (), {"applicationId": "a"})}))
    spec = c.tuned(kind)
    assert seen == [(kind, M.sample_space(space, 40), 5)]
    assert spec.params == seen[0][1][7] and spec.params["n_estimators"] >= 100


@pytest.mark.parametrize("query", [Q.m14b, Q.s05b, Q.m14])
def test_next_transaction_model_has_all_trees(spark, monkeypatch, query):
    """Fold check, bundle and the query itself train the model of 200 trees."""
    from spendsignals.operators import nexttxn
    from spendsignals import session

    made = []
    monkeypatch.setattr(session, "cut_lineage", lambda df: df)
    monkeypatch.setattr(nexttxn, "time_split", lambda *_: (None, None, None))
    monkeypatch.setattr(nexttxn, "block_folds", lambda df: df)
    monkeypatch.setattr(Q.I.Ctx, "next_dataset", type("D", (), {"na": type("N", (), {"fill": staticmethod(lambda *_: None)})})())
    monkeypatch.setattr(Q.ModelCtx, "fitted", lambda *_: None)
    monkeypatch.setattr(M, "save_model", lambda *_: None)
    monkeypatch.setattr(Q, "ensure_checkpoint_dir", lambda _: "")

    def fit(df, feats, estimator, **_):
        made.append(estimator.getMaxIter())
        raise Stop

    monkeypatch.setattr(M, "fit", fit)
    monkeypatch.setattr(M, "cross_validate", lambda df, feats, make, **_: fit(df, feats, make()))
    with pytest.raises(Stop):
        query(None, "x")
    assert made == [200]


def test_folds_of_few_rows_are_fitted_side_by_side(spark, monkeypatch):
    """Many small jobs of one fold leave cores idle: the folds' fits overlap, and give what they give one after another."""
    import threading

    rows = [(i, float(i % 7), float(i % 3), int(i * 37 % 11 < i % 7), i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "transaction_id long, a double, b double, impulse_label int, fold int")
    fit, meet, threads = M.fit, threading.Barrier(3, timeout=60), set()

    def together(*a, **k):
        threads.add(threading.get_ident())
        meet.wait()
        return fit(*a, **k)

    monkeypatch.setattr(M, "fit", together)
    got = sorted(M.cross_validate(df, ["a", "b"], M.logistic, folds=3).collect())
    assert len(threads) == 3
    monkeypatch.setattr(M, "fit", fit)
    monkeypatch.setattr(M, "SIDE_BY_SIDE", 0)
    assert got == sorted(M.cross_validate(df, ["a", "b"], M.logistic, folds=3).collect())
