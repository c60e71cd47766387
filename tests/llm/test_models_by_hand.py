"""The fused language posterior and the positive-unlabelled risk, each in plain Python over a hundred rows."""

import math
import random
from collections import Counter, defaultdict

import pytest

from wardline.llm import language, toxicity
from wardline.llm.text import plain_words


def softmax(logs):
    top = max(logs)
    weights = [math.exp(x - top) for x in logs]
    return [w / sum(weights) for w in weights]


def fused_by_hand(rows, n):
    shares = [[math.floor(x * 1_000_000 + 0.5) for x in softmax(r["likelihood"])] for r in rows]
    sums = {key: defaultdict(lambda: [0] * n) for key in ("host", "domain", "suffix", "declared")}
    for r, own in zip(rows, shares, strict=True):
        for key, table in sums.items():
            if r[key] is not None:
                table[r[key]] = [a + b for a, b in zip(table[r[key]], own, strict=True)]
    world = [sum(s[i] for s in shares) / 1_000_000 + 1 for i in range(n)]

    def prior(key, value, own, broader):
        seen = [max(0, a - b) / 1_000_000 for a, b in zip(sums[key][value], own, strict=True)] if value is not None else [0.0] * n
        return [(x + language.PULL * p) / (sum(seen) + language.PULL) for x, p in zip(seen, broader, strict=True)]

    def told(key, value):
        if value is None:
            return [0.0] * n
        outcomes = len([v for v in sums[key] if v is not None])
        return [math.log((x / 1_000_000 + language.EXTRA) / (t + language.EXTRA * (outcomes + 1))) for x, t in zip(sums[key][value], world, strict=True)]

    out = []
    for r, own in zip(rows, shares, strict=True):
        broad = prior("domain", r["domain"], own, [w / sum(world) for w in world])
        narrow = prior("host", r["host"], own, broad)
        logs = [a + b + c + math.log(p) for a, b, c, p in zip(r["likelihood"], told("declared", r["declared"]), told("suffix", r["suffix"]), narrow, strict=True)]
        out.append(softmax(logs))
    return out


def test_posterior_is_that_of_the_definition(spark):
    rng = random.Random(7)
    rows = []
    for i in range(120):
        domain = rng.choice(["a.org", "b.de", None])
        rows.append({
            "id": i, "host": domain and f"{rng.choice('xy')}.{domain}", "domain": domain, "suffix": domain and domain[2:],
            "declared": rng.choice([None, "en", "de", "xx"]), "likelihood": [rng.choice([0.0, -1.0, -20.0, rng.uniform(-5, 0)]) for _ in range(3)],
        })
    shape = "id bigint, host string, domain string, suffix string, declared string, likelihood array<double>"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], shape)
    got = {r["id"]: r for r in language.fuse(df, ["de", "en", "fr"]).collect()}
    for r, want in zip(rows, fused_by_hand(rows, 3), strict=True):
        assert got[r["id"]]["posterior"] == pytest.approx(want, rel=1e-6, abs=1e-9)
        assert got[r["id"]]["language"] == ["de", "en", "fr"][want.index(max(want))]


def risk(weights, bias, positives, unlabelled, prior):
    """Non-negative risk and which of its parts counts, from margins of the texts' features."""
    def probability(values):
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(weights[k] * v for k, v in values.items())))))

    p, u = [probability(x) for x in positives], [probability(x) for x in unlabelled]
    mean = lambda xs: sum(xs) / len(xs)
    rest = mean([-math.log(1 - x + 1e-12) for x in u]) - prior * mean([-math.log(1 - x + 1e-12) for x in p])
    return prior * mean([-math.log(x + 1e-12) for x in p]) + max(0.0, rest), rest, p, u


def test_fit_takes_the_steps_on_the_non_negative_risk_that_plain_python_takes():
    rng = random.Random(8)
    bad, good = [f"bad{i}" for i in range(6)], [f"good{i}" for i in range(30)]
    toxic = lambda: " ".join(rng.choices(good, k=20) + rng.choices(bad, k=4))
    clean = lambda: " ".join(rng.choices(good, k=24))
    positives, unlabelled = [toxic() for _ in range(40)], [toxic() if i < 12 else clean() for i in range(60)]
    prior, steps, rate, decay = 0.2, 40, 0.05, 1e-4
    names = toxicity.choose(positives, unlabelled)
    tell = lambda text: {k: float(toxicity.density(c, len(plain_words(text)))) for k, c in toxicity.features(text)[0].items() if k in names}
    sides = [[tell(t) for t in texts] for texts in (positives, unlabelled)]
    weights, bias = dict.fromkeys(names, 0.0), math.log(prior / (1 - prior))
    first, second = Counter(), Counter()
    for step in range(1, steps + 1):
        _, rest, p, u = risk(weights, bias, *sides, prior)
        slope = Counter()

        def add(texts, factors, scale):
            for values, f in zip(texts, factors, strict=True):
                for k, v in values.items():
                    slope[k] += scale * f * v / len(texts)
                slope[None] += scale * f / len(texts)

        sign = 1 if rest >= 0 else -1  # a negative rest is climbed back
        add(sides[1], u, sign), add(sides[0], p, -sign * prior)
        if rest >= 0:
            add(sides[0], [x - 1 for x in p], prior)
        for k in names:
            slope[k] += decay * weights[k]
        for k in [*names, None]:
            first[k] = 0.9 * first[k] + 0.1 * slope[k]
            second[k] = 0.999 * second[k] + 0.001 * slope[k] ** 2
            move = rate * (first[k] / (1 - 0.9**step)) / (math.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            if k is None:
                bias -= move
            else:
                weights[k] -= move
    model = toxicity.fit(positives, unlabelled, prior, steps=steps, rate=rate, decay=decay)
    assert model.bias == pytest.approx(bias, abs=1e-6)
    assert {k: model.weights.get(k, 0.0) for k in names} == pytest.approx(weights, abs=1e-6)
    for text in (*positives[:5], *unlabelled[:20]):
        want = 1 / (1 + math.exp(-(bias + sum(weights[k] * v for k, v in tell(text).items()))))
        assert model.score(text) == pytest.approx(want, abs=1e-6)
