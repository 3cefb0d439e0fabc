"""Classifier statistics on a hand-computed case with a foreign prediction."""

import pytest

from sigfolio.operators import evaluate as E


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(1, "A", "a"), (2, "a", "b"), (3, "b", "b"), (4, "b", "x"), (5, "c", "C")]
    return E.prepare(spark.createDataFrame(rows, "id int, t string, p string"), "t", "p")


def test_accuracy_and_per_class(scored):
    assert E.accuracy(scored, "t", "p").first()["accuracy"] == pytest.approx(0.6)
    pc = {r.label: (r.accuracy, r.support, r.predicted) for r in E.per_class_accuracy(scored, "t", "p").collect()}
    assert pc == {"a": (pytest.approx(0.8), 2, 1), "b": (pytest.approx(0.6), 2, 2), "c": (pytest.approx(1.0), 1, 1)}
    w = E.worst_class(scored, "t", "p", "id").first()
    assert (w.label, w.accuracy) == ("b", 0.6)


def test_confusion_matrix_labels_from_truth_only(scored):
    cm = {(r.true_label, r.pred_label): r.n for r in E.confusion_matrix(scored, "t", "p").collect()}
    assert len(cm) == 9
    assert cm[("a", "a")] == 1 and cm[("a", "b")] == 1 and cm[("b", "b")] == 1 and cm[("c", "c")] == 1
    assert sum(cm.values()) == 4  # the foreign prediction 'x' is not a column


def test_report_micro_average_with_foreign_prediction(scored):
    rep = {r.label: (r.precision, r.recall, r.f1_score, r.support) for r in
           E.classification_report(scored, "t", "p").collect()}
    assert rep["a"][:2] == (pytest.approx(1.0), pytest.approx(0.5))
    assert rep["b"][:2] == (pytest.approx(0.5), pytest.approx(0.5))
    assert "accuracy" not in rep and rep["micro avg"][:2] == (pytest.approx(0.75), pytest.approx(0.6))
    assert rep["macro avg"][3] == 5 and rep["weighted avg"][1] == pytest.approx(0.6)
