"""What the toxicity learner holds."""

from grove.llm import toxicity as X


def test_buckets_do_not_change_the_model(monkeypatch):
    positive = [f"vile{i % 3} awful{i % 5} word{i}" for i in range(60)]
    unlabelled = [f"calm{i % 7} fine{i % 4} word{i}" for i in range(90)]
    models = []
    for buckets in (1, 7, 1 << 20):
        monkeypatch.setattr(X, "BUCKETS", buckets)
        models.append(X.train(positive, unlabelled, 0.1, steps=20))
    assert models[0].weights and all((m.weights, m.bias) == (models[0].weights, models[0].bias) for m in models)
