"""Language, quality and mixing against plain versions that share no code with them."""

import itertools
import math
import random

import numpy as np
import pytest

from foldspan.llm import langid, quality
from foldspan.llm.mixing import min_cost_flow

WORD = 1 << 64


def sentences(n=50, seed=3):
    rng = random.Random(seed)
    vocab = {"en": "the cat sat on a mat with some other cats".split(), "de": "der Hund läuft über die Straße und bellt".split(), "zz": "ka ki ku ke ko 漢字 x".split()}
    rows = [(lang, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for _ in range(n // 3 + 1) for lang, words in vocab.items()]
    return rows[:n]


def plain_grams(text):
    chars, out = [ord(c) for c in f" {text.lower()} "], []
    steps = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
    for n in (1, 2, 3):
        for i in range(len(chars) - n + 1):
            h = n
            for k in range(n):
                h = (h ^ chars[i + k]) * steps[k] % WORD
            out.append(((h ^ (h >> 29)) * steps[1] % WORD) >> (64 - langid.BITS))
    return out


def test_language_scores_agree_with_plain_counts(spark):
    rows = sentences()
    df = spark.createDataFrame([(i, t, lang, "clash") for i, (lang, t) in enumerate(rows)] + [(90, None, "en", ""), (91, "text", None, "")], "doc_id bigint, text string, lang string, score string").repartition(3)
    model = langid.fit_languages(df)
    taught = [*(t for _, t in rows)]
    seen = {}
    for t in taught:
        for g in set(plain_grams(t)):
            seen[g] = seen.get(g, 0) + 1
    idf = lambda g: math.log((1 + len(taught)) / (1 + seen[g])) + 1 if g in seen else math.log1p(len(taught)) + 1
    asked = [(i, t) for i, (_, t) in enumerate(rows)] + [(60, "never seen WORDS 123"), (61, "12 34 !"), (62, ""), (63, None), (64, "the " * 40_000)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identified(spark.createDataFrame(asked, "doc_id bigint, text string"), model).collect()}
    assert model.names == ["de", "en", "zz"] and len(got) == len(asked)
    for i, t in asked:
        if not t or not any(c.isalpha() for c in t):
            assert got[i] == ("und", 0.0)
            continue
        count = {}
        for g in plain_grams(t):
            count[g] = count.get(g, 0) + 1
        x = {g: (1 + math.log(c)) * idf(g) for g, c in count.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        logits = [sum(model.w[k, g] * v for g, v in x.items()) / norm / model.divisor for k in range(3)]
        top = max(logits)
        p = [math.exp(z - top) for z in logits]
        assert got[i][0] == model.names[max(range(3), key=lambda k: p[k])] and got[i][1] == pytest.approx(max(p) / sum(p), rel=1e-9)


def plain_features(text, bits):
    k, m = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
    words = (text or "").split()
    chars, out = f" {' '.join(words)} ", []
    for n in (1, 2, 3, 4) if words else ():
        for i in range(len(chars) - n + 1):
            gram = chars[i : i + n]
            if " " in gram[1:-1] or gram == " ":
                continue
            h = n
            for c in gram:
                h = (h ^ ord(c)) * k % WORD
            out.append(h)
    codes = [sum(ord(c) * pow(m, i, WORD) for i, c in enumerate(w)) % WORD for w in words]
    out += [(c * k + 7) % WORD for c in codes] + [11 for a, b in itertools.pairwise(words) if a == b]
    return sorted((((h ^ (h >> 31)) * m % WORD) >> (64 - bits)) for h in out)


def test_quality_features_agree_with_plain_hashes():
    for _, t in [*sentences(), ("", ""), ("", "  "), ("", "a"), ("", "one one one  two\ttwo"), ("", "é 漢 \x00")]:
        assert sorted(quality.features(t, 14).tolist()) == plain_features(t, 14)
    assert len(quality.features(None)) == 0


def test_a_folded_quality_model_scores_as_its_layers_do():
    rng, rows = np.random.default_rng(1), sentences()
    examples = []
    for lang, t in rows:
        ids, counts = np.unique(quality.features(t), return_counts=True)
        examples.append((ids, (counts / counts.sum()).astype(np.float32), int(lang == "en")))
    e, w, b = quality.train_vectors(examples, 2, epochs=2)
    model = quality.QualityModel(e @ (w[1] - w[0]), b[1] - b[0])
    for _, t in rows:
        hidden = np.mean([e[f] for f in plain_features(t, quality.BITS)], axis=0)
        z = w @ hidden + b
        assert model.score(t) == pytest.approx(math.exp(z[1]) / (math.exp(z[0]) + math.exp(z[1])), abs=1e-5)
    logits, y = rng.normal(size=80) * 3, rng.integers(0, 2, 80).astype(float)
    weight = np.full(80, 1 / 80)
    loss = lambda a, c: float((weight * np.logaddexp(0, -(2 * y - 1) * (a * logits + c))).sum() + 0.005 * (a - 1) ** 2)
    a, c = quality._scale(logits, y, weight)
    assert a <= 1e-3 or all(loss(a, c) <= loss(a + da, c + dc) + 1e-6 for da in (-0.05, 0, 0.05) for dc in (-0.05, 0, 0.05))


@pytest.mark.parametrize("seed", range(12))
def test_flows_agree_with_enumeration_of_overlapping_sources(seed):
    rng = random.Random(seed)
    costs, patterns, sources = (0, 1, 3), rng.randint(1, 3), rng.randint(1, 3)
    supply = [rng.randint(0, 2) for _ in range(patterns)]
    members = [sorted(rng.sample(range(sources), rng.randint(1, sources))) for _ in range(patterns)]
    quotas = [rng.randint(0, 4) for _ in range(sources)]
    cost = lambda words, total: sum(c * max(0, min(words, (k + 1) * total) - k * total) for k, c in enumerate(costs))
    routes = [(p, s) for p in range(patterns) for s in members[p]]
    best = None
    for flow in itertools.product(*[range(min(3 * supply[p], quotas[s]) + 1) for p, s in routes]):
        given = [sum(f for f, (p, _) in zip(flow, routes, strict=True) if p == q) for q in range(patterns)]
        taken = [sum(f for f, (_, s) in zip(flow, routes, strict=True) if s == q) for q in range(sources)]
        if all(g <= 3 * n for g, n in zip(given, supply, strict=True)) and all(t <= q for t, q in zip(taken, quotas, strict=True)):
            now = (-sum(flow), sum(cost(g, n) for g, n in zip(given, supply, strict=True)))
            best = now if best is None else min(best, now)
    got = min_cost_flow(supply, members, quotas, costs)
    assert all(s in members[p] for p, f in enumerate(got) for s in f)
    assert all(sum(f.get(s, 0) for f in got) <= q for s, q in enumerate(quotas))
    assert (-sum(sum(f.values()) for f in got), sum(cost(sum(f.values()), n) for f, n in zip(got, supply, strict=True))) == best
