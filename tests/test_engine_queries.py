"""The queries that fit hidden-Markov models: what they hand to the fits."""

import pytest

from tidemark.operators import features as feat
from tidemark.operators import hmm
from tidemark.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("engine, names, every", [("hmm", feat.GENERIC, 50), ("messina", feat.CURATED, 50), ("robust_hmm", feat.GENERIC, 100), ("fshmm", feat.GENERIC, 100)])
def test_engines_get_their_features_and_interval(spark, monkeypatch, engine, names, every):
    taken = []
    slices, schedule = hmm.training_slices, hmm.refit_schedule
    monkeypatch.setattr(hmm, "training_slices", lambda f, columns, refits, reverse=False: taken.append((columns, refits)) or slices(f, columns, refits, reverse))
    queries.QUERIES[f"{engine}_labels"](spark, SF)
    columns, refits = taken[0]
    assert columns == list(names) and len(set(columns)) == (19 if engine == "messina" else 49) and columns[0] == "log_ret"
    want = schedule(queries.rets(spark, SF), every, queries.MIN_TRAIN)
    assert sorted(refits.collect()) == sorted(want.collect())


def test_bic_tries_up_to_six_states(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(hmm, "training_slices", lambda f, columns, refits: taken.append(columns))
    monkeypatch.setattr(hmm, "fit_models", lambda slices, configs: taken.append(configs))
    monkeypatch.setattr(hmm, "select_states_bic", lambda models: None)
    queries.QUERIES["select_states_bic"](spark, SF)
    assert taken[0] == list(feat.GENERIC)
    rows = taken[1].collect()
    assert {k: len({r.seed for r in rows if r.n_states == k}) for k in {r.n_states for r in rows}} == dict.fromkeys(range(2, 7), 3)


def test_audit_covers_the_generic_features(spark):
    rows = queries.QUERIES["saliency_audit"](spark, SF).collect()
    symbols = queries.last_refit(queries.rets(spark, SF)).count()
    assert {r.feature for r in rows} == set(feat.GENERIC) and {r.n for r in rows} == {5 * symbols}
