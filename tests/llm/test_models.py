"""Models against plain Python: character language model, severity, license coefficients."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from changeloom.llm import language, licenses, toxicity, words


def clean(text):
    """What the model reads: a border, then letters and single borders; the last one only if the text ends with something else than a letter."""
    return " " + re.sub(r"[\W\d_]+", " ", text.lower()).lstrip()


def kneser_ney(texts):
    """log P(c | a b) of one language from its texts, by dictionaries; a text begins with two borders."""
    three = Counter()
    for text in texts:
        s = "  " + clean(text)[1:]
        three.update(s[i : i + 3] for i in range(len(s) - 2))
    two = Counter(g[1:] for g in three)
    one = Counter(g[1] for g in two)
    tables = {1: one, 2: two, 3: three}
    cut = {}
    for k, t in tables.items():
        n = Counter(t.values())
        cut[k] = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    return tables, cut


def probability(model, size, gram):
    tables, cut = model
    one = tables[1]
    p = max((max(one[gram[2]] - cut[1], 0) + cut[1] * len(one) / (size + 1)) / max(sum(one.values()), 1), 1e-9)
    for k, g in ((2, gram[1:]), (3, gram)):
        after = {h: n for h, n in tables[k].items() if h[:-1] == g[:-1]}
        if after:
            p = (max(tables[k][g] - cut[k], 0) + cut[k] * len(after) * p) / sum(after.values())
    return p


def packed(gram):
    return sum((0 if c == " " else ord(c)) << (21 * (2 - k)) for k, c in enumerate(gram))


def test_language_model_against_dictionaries(docs):
    rng = random.Random(6)
    rows = [(k, " ".join("".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(12)), lang, None, None) for k in range(30) for lang, letters in [("xx", "abcdé") if k % 2 else ("yy", "cdefg")]]
    model = language.train(docs(rows), keys_in_file=16)  # many small files
    assert model.parts > 3
    known = {lang: kneser_ney([r[1] for r in rows if r[2] == lang]) for lang in ("xx", "yy")}
    size = len(set().union(*(t[1] for t, _ in known.values())))
    grams = sorted({"".join(rng.choices(" abcdéfgz", k=3)) for _ in range(300)}, key=packed)
    got = model.rows(np.array([packed(g) for g in grams], np.uint64))
    for i, g in enumerate(grams):
        for j, lang in enumerate(("xx", "yy")):
            assert got[i, j] == pytest.approx(math.log(max(probability(known[lang], size, g), 1e-12)), rel=1e-9), (g, lang)
    out = {r["doc_id"]: (r["lang_pred"], r["entropy"]) for r in language.predict(docs(rows), model).collect()}
    for k, text, *_ in rows:
        s = "  " + clean(text)[1:]
        own = [-sum(math.log(max(probability(known[lang], size, s[i : i + 3]), 1e-12)) for i in range(len(s) - 2)) / (len(s) - 2) for lang in ("xx", "yy")]
        assert out[k][1] == pytest.approx(min(own)) and out[k][0] == ("xx", "yy")[int(np.argmin(own))]


def test_language_limits_from_every_training_row(docs):
    rng, rare = random.Random(11), [chr(0x4E00 + k) for k in range(2000)]

    def text(letters, odd):
        return " ".join("".join(rng.choices(rare if rng.random() < odd else letters, k=4)) for _ in range(6))

    rows = [(k, text("abcde", rng.random() ** 20), "xx", None, None) for k in range(11_000)]
    rows += [(20_000 + k, text("fghij", rng.random() ** 20), "yy", None, None) for k in range(60)] + [(30_000 + k, text("klmno", 0), "zz", None, None) for k in range(5)]
    table = docs(rows)
    model = language.train(table)
    assert model.languages == ["xx", "yy", "zz"]
    seen = [r for r in language.predict(table, model).collect() if r["letters"] > 0 and r["lang_pred"] == r["lang_given"]]
    assert len(seen) > 10_900
    excess = {}
    for j, lang in enumerate(model.languages):
        own = [(r["entropy"], min(r["letters"], 400)) for r in seen if r["lang_pred"] == lang]
        mean = sum(h * n for h, n in own) / sum(n for _, n in own)
        assert model.mean[j] == pytest.approx(mean, rel=1e-9), lang
        excess[lang] = [(h - mean) * math.sqrt(n) for h, n in own]
    whole = [x for e in excess.values() for x in e]
    for j, lang in enumerate(model.languages):
        quantile = np.quantile(excess[lang] if len(excess[lang]) >= 20 else whole, 0.999)
        assert quantile > 1 and model.limit[j] == pytest.approx(language.REJECT * quantile, rel=1e-9), lang


def test_pipeline_keeps_languages_by_every_row(docs, spark):
    rng, rare = random.Random(12), [chr(0x4E00 + k) for k in range(2000)]

    def text(odd):
        return " ".join("".join(rng.choices(rare if rng.random() < odd else "abcde", k=4)) for _ in range(6))

    table = docs([(k, text(0 if k % 500 else k / 25_000), "xx", None, None) for k in range(11_000)] + [(20_000 + k, text(rng.random()), None, None, None) for k in range(3_000)])
    out = language.predict(table, language.train(table)).collect()
    own = [(r["entropy"], min(r["letters"], 400)) for r in out if r["lang_given"] and r["letters"] > 0]
    mean = sum(h * n for h, n in own) / sum(n for _, n in own)
    limit = language.REJECT * np.quantile([(h - mean) * math.sqrt(n) for h, n in own], 0.999)
    want = {r["doc_id"] for r in out if r["letters"] > 0 and (r["entropy"] - mean) * math.sqrt(min(r["letters"], 400)) <= limit}
    assert 0 < len(want) < 14_000
    assert {r["doc_id"] for r in corpus_pipeline.known_language(spark, table, "").select("doc_id").collect()} == want


def test_severity_against_its_words(docs, spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choices([f"w{i}" for i in range(30)], k=15)) + (" foul" if k % 2 else "") + (" vile" if k % 4 == 3 else "")) for k in range(400)]
    grades = spark.createDataFrame([(k, k % 2 + (k % 4 == 3)) for k in range(400)], "doc_id long, grade int")
    model = toxicity.train(docs(rows), grades)
    weight = {int(h): w for h, w in zip(model.words, model.weight, strict=True)}
    names = {w: words.word_hash(w.encode(), words.LOWER) for w in {x for _, t in rows for x in t.split()}}
    assert names["foul"] in weight and names["vile"] in weight
    rows += [(900, "FOUL foul, Vile!"), (901, ""), (902, None)]
    for r in toxicity.score(docs(rows), model).collect():
        text = dict(rows)[r["doc_id"]] or ""
        margin = sum(weight.get(names.get(w, -1), 0) for w in set(re.findall(r"[a-z0-9]+", text.lower())))
        above = [1 / (1 + math.exp(b - margin)) for b in model.bounds]
        assert r["severity"] == pytest.approx(sum(above)) and r["toxic"] == (above[-1] >= 0.5)


def test_licenses_against_all_templates(docs):
    rng = random.Random(9)
    names = [f"t{k}" for k in range(8)]
    templates = {n: (" ".join(rng.choices("abcdefgh", k=rng.randint(3, 25))), " ".join(rng.choices("abcdefgh", k=rng.randint(3, 12)))) for n in names}
    rows = []
    for k in range(150):
        parts = []
        for _ in range(rng.randint(1, 3)):
            w = rng.choice(templates[rng.choice(names)]).split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice("abcdefghz")
            parts.append(" ".join(rng.choices("yz", k=rng.randint(0, 4)) + w))
        rows.append((k, rng.choice(["\n", "\n\n", " "]).join(parts)))
    out = {r["doc_id"]: r for r in licenses.scan(docs(rows), templates).collect()}
    for k, text in rows:
        found = {}
        pieces = [*text.split("\n"), *re.split(r"\n[ \t\r]*\n", text), text]
        w = text.split()
        for name, texts in templates.items():
            for t in texts:
                own, n = licenses.bigrams(t), len(t.split())
                windows = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) > n else []
                found[name] = max([found.get(name, 0.0), *(licenses.dice(licenses.bigrams(p), own) for p in pieces + windows)])
        want = sorted(((d, n) for n, d in found.items() if d >= licenses.LEAST), key=lambda x: (-x[0], x[1]))
        assert out[k]["licenses"] == ",".join(n for _, n in want), (k, text)
        assert out[k]["dice"] == pytest.approx(want[0][0] if want else 0)
