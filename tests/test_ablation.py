import math
import random

import numpy as np
import pytest

from phenoframe.plans import ablation


def rows(n=400, seed=1):
    rng = random.Random(seed)
    for i in range(n):
        y = rng.choice([0, 0, 0, 1, 2])
        yield i, y, rng.choice(["train", "train", "val", "test"]), rng.gauss(3 * y, 1), rng.gauss(-y, 2), rng.gauss(0, 1)


SCHEMA = "id int, y int, split string, a double, b double, c double"


def test_closed_form_equals_brute_force(spark):
    data = [*rows(), (900, 0, "test", None, 1.0, 0.0), (901, 1, "test", float("nan"), float("inf"), 0.0), (902, None, "test", 1.0, 1.0, 1.0)]
    configs = {"a": ["a"], "ab": ["a", "b"], "cb": ["c", "b"]}
    got = {r["config"]: r for r in ablation.gaussian_ablation(spark.createDataFrame(data, SCHEMA), configs, "y").collect()}
    names = {"a": 3, "b": 4, "c": 5}
    train = [r for r in data if r[2] == "train"]
    for config, features in configs.items():
        hits = {}
        for r in (r for r in data if r[2] == "test" and r[1] is not None):
            scores = []
            for k in (0, 1, 2):
                own = [t for t in train if t[1] == k]
                score = math.log(len(own))
                for f in features:
                    x = r[names[f]]
                    if x is not None and math.isfinite(x):
                        v = [t[names[f]] for t in own]
                        var = np.var(v) + 1e-6
                        score -= (x - np.mean(v)) ** 2 / (2 * var) + math.log(var) / 2
                scores.append(score)
            hits.setdefault(r[1], []).append(int(np.argmax(scores)) == r[1])
        flat = [h for v in hits.values() for h in v]
        assert got[config]["n_rows"] == len(flat)
        assert got[config]["accuracy"] == pytest.approx(np.mean(flat))
        assert got[config]["recall_macro"] == pytest.approx(np.mean([np.mean(v) for v in hits.values()]))


def test_rates_keep_their_best_epoch(spark):
    df = spark.createDataFrame(list(rows(300, 2)), SCHEMA)
    got = ablation.compare_rates(df, ["a", "b", "c"], "y", 3, ["id"], rates=(0.5, 500.0), epochs=5, patience=2).collect()
    assert [r["rate"] for r in got] == [0.5, 500.0]
    for r in got:
        assert 1 <= r["best_epoch"] <= r["epochs"] <= 5 and r["val_loss"] > 0
        assert r["epochs"] == 5 or r["epochs"] - r["best_epoch"] == 2
    assert got[0]["val_loss"] < math.log(3) * 1.2


def test_forest_rows_are_dealt_to_several_tasks(spark, monkeypatch):
    df = spark.createDataFrame(list(rows(90, 3)), SCHEMA).coalesce(1)
    fit, seen = ablation.RandomForestClassifier.fit, []

    def counted(self, data):
        seen.append((data.rdd.getNumPartitions(), data.count(), self.getNumTrees(), self.getMaxDepth()))
        return fit(self, data)

    monkeypatch.setattr(ablation.RandomForestClassifier, "fit", counted)
    for limit in (20, 90):
        got = ablation.importance(df, ["a", "b", "c"], "y", trees=5, depth=4, rows_per_task=limit).collect()
        assert [r["name"] for r in got] == ["a", "b", "c"] and sum(r["importance"] for r in got) == pytest.approx(1)
    assert seen == [(5, 90, 5, 4), (1, 90, 5, 4)]
    assert ablation.FOREST_ROWS < 100_000
