"""What the quality classifier and language identification learn, against plain Python without arrays or shared tables."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
import zstandard

from corpusloom.llm import langid, quality


def slow_posteriors(patterns, rounds):
    """EM over single texts, one at a time."""
    prior = {"bad": 0.2, "good": 0.8}
    start = {"bad": {quality.BAD: 0.6, quality.NONE: 0.3, quality.GOOD: 0.1}, "good": {quality.BAD: 0.1, quality.NONE: 0.3, quality.GOOD: 0.6}}
    chance = {c: [dict(start[c]) for _ in patterns[0]] for c in prior}
    for _ in range(rounds):
        seen = []
        for p in patterns:
            like = {c: prior[c] * math.prod(chance[c][k][v] for k, v in enumerate(p)) for c in prior}
            total = sum(like.values())
            seen.append({c: x / total for c, x in like.items()})
        mass = {c: sum(s[c] for s in seen) for c in prior}
        prior = {c: (mass[c] + 1) / (sum(mass.values()) + 2) for c in prior}
        for c in prior:
            for k in range(len(patterns[0])):
                got = dict(start[c])
                for p, s in zip(patterns, seen, strict=True):
                    got[p[k]] += s[c]
                total = sum(got.values())
                chance[c][k] = {v: x / total for v, x in got.items()}
    return {p: s["good"] for p, s in zip(patterns, seen, strict=True)}


def test_posteriors_equal_em_over_single_texts():
    r = random.Random(3)
    votes = [quality.BAD, quality.NONE, quality.GOOD]
    patterns = ["".join(r.choices(votes, (1, 2, 6) if k % 5 else (6, 2, 1), k=quality.LABELLERS)) for k in range(60)] * 2
    slow = slow_posteriors(patterns, 30)
    fast = quality.posteriors(dict(Counter(patterns)), rounds=30)
    assert fast.keys() == slow.keys() and all(fast[p] == pytest.approx(slow[p], abs=1e-9) for p in slow)
    assert quality.posteriors({}) == {}


def slow_fit(rows, target, steps, rate, decay):
    n, dims = len(rows), len(rows[0])
    good, bad = max(sum(target), 1.0), max(sum(1 - t for t in target), 1.0)
    weight = [t / good + (1 - t) / bad for t in target]
    scale = n / sum(weight)
    w, m, v = [0.0] * dims, [0.0] * dims, [0.0] * dims
    for k in range(1, steps + 1):
        p = [1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, w, strict=True)))))) for x in rows]
        for j in range(dims):
            g = sum(x[j] * (q - t) * s * scale for x, q, t, s in zip(rows, p, target, weight, strict=True)) / n + decay * w[j]
            m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
        w = [w[j] - rate * (m[j] / (1 - 0.9**k)) / (math.sqrt(v[j] / (1 - 0.999**k)) + 1e-8) for j in range(dims)]
    return w


def test_the_scorer_equals_a_fit_without_arrays():
    r = random.Random(5)
    rows = [[r.random(), r.random() - 0.5, float(k % 3 == 0), 1.0] for k in range(40)]
    target = [min(1.0, max(0.0, x[0] * 0.7 + x[2] * 0.3)) for x in rows]
    assert quality.fit(np.array(rows, np.float32), np.array(target), 60) == pytest.approx(slow_fit(rows, target, 60, 0.05, 1e-4), abs=2e-3)


TEXTS = {"en": "the quick brown fox jumps over the lazy dog and then it sleeps beside a river ", "de": "der schnelle braune fuchs springt über den faulen hund und schläft am fluss ", "fr": "le renard brun saute par dessus le chien paresseux puis il dort près du fleuve "}


def test_languages_equal_sizes_of_compressed_texts(spark):
    r = random.Random(9)
    rows = []
    for k in range(60):
        lang = ["en", "de", "fr"][k % 3]
        words = TEXTS[lang].split() * 40
        r.shuffle(words)
        rows.append((k if k != 7 else None, " ".join(words[: r.randint(1, 400)]), lang if k % 10 else None))
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 !?", "en"), (103, "12 3", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    size = 4000
    taken = defaultdict(list)
    for d, text, lang in rows:
        for at, a in enumerate(range(0, len(text or "") if lang else 0, langid.PASSAGE)):
            first = xxhash.xxh64_intdigest(("null" if d is None else str(d)).encode(), seed=42)
            h = xxhash.xxh64_intdigest(at.to_bytes(4, "little"), seed=first)
            taken[lang].append((h - (1 << 64) if h >> 63 else h, text[a : a + langid.PASSAGE]))
    want = {}
    for lang, passages in taken.items():
        data = langid.prose("\n".join(t for _, t in sorted(sorted(passages)[: size // langid.PASSAGE + 1], reverse=True)))[-size:]
        if any(c.isalpha() for c in data.decode(errors="ignore")):
            want[lang] = data
    learned = langid.learn(docs, dictionary_bytes=size)
    assert learned == want and set(want) == {"en", "de", "fr"}

    def slow(text):
        if text is None or not any(c.isalpha() for c in text):
            return "und", 0.0
        packed = lambda lang: len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(want[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False).compress(langid.prose(text)))
        sizes = sorted((packed(lang), lang) for lang in want)
        return sizes[0][1], 1 - sizes[0][0] / sizes[1][0]

    found = langid.identify(docs, learned).collect()
    texts = {d: t for d, t, _ in rows}
    assert len(found) == len(rows)
    right = 0
    for x in found:
        lang, score = slow(texts[x["doc_id"]])
        assert x["lang_pred"] == lang and x["score"] == pytest.approx(score) and x["rejected"] == (score < langid.MARGIN)
        right += x["doc_id"] is not None and x["doc_id"] < 60 and lang == ["en", "de", "fr"][x["doc_id"] % 3]
    assert right >= 55
