"""The classifier and the language operator against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from veilmark.llm import language, ordinal

GRADES = {"rejected": 0, "pending": 1, "accepted": 2}


def labelled(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6))) for _ in range(rng.randrange(20, 60))]
        status = ("accepted", "accepted", "pending", "rejected")[i % 4]
        if status == "pending":
            words[3] = "vile"
        if status == "rejected":
            words = [w + "$$$" if rng.random() < 0.7 else w for w in words]
        rows.append((i, " ".join(words), status))
    return rows


def cost(weights, thresholds, table, grades, share):
    """The penalised likelihood that the fit minimises, row by row."""
    total = 0.5 * ordinal.PENALTY * float((weights**2).sum())
    for features, grade, part in zip(table, grades, share / share.sum()):
        score = sum(weights[k] * v for k, v in features.items())
        tail = [1.0, *(1 / (1 + np.exp(-(score - t))) for t in thresholds), 0.0]
        total -= part * np.log(max(tail[grade] - tail[grade + 1], 1e-9))
    return total


def test_no_neighbour_of_the_fit_is_better():
    rng = np.random.default_rng(3)
    n, width = 240, 6
    grades = rng.integers(0, 3, n)
    table = [{k: 1.0 for k in range(width) if rng.random() < (0.6 if k >= 3 else 0.2 + 0.25 * (2 - g))} for g in grades]
    owner = np.repeat(np.arange(n), [len(f) for f in table])
    index = np.concatenate([np.array(list(f), np.int64) for f in table])
    share = rng.uniform(0.5, 2.0, n)
    weights, thresholds = ordinal.fit_rows(index, np.ones(len(index)), owner, grades, share, np.ones(width))
    assert (weights <= 0).all() and (np.diff(thresholds) > 0).all() and weights[:3].max() < -0.2
    best = cost(weights, thresholds, table, grades, share)
    for _ in range(300):
        near = np.minimum(weights + rng.normal(0, 0.05, width), 0.0)
        assert cost(near, np.sort(thresholds + rng.normal(0, 0.05, 2)), table, grades, share) >= best - 2e-5


def test_contrast_by_plain_counting():
    rng = random.Random(7)
    grades = [rng.choice([0, 0, 1, 2, 2, 2]) for _ in range(400)]
    has = [{k for k in range(8) if rng.random() < (0.5 if k < 4 and g == 0 else 0.06 * (k + 1) - 0.05)} for g in grades]
    times = np.array([[sum(1 for f, g in zip(has, grades) if k in f and g == level) for level in range(3)] for k in range(8)])
    got = ordinal.contrast(times, np.array([grades.count(g) for g in range(3)]))
    for k in range(8):
        want, n = 0.0, len(grades)
        every = sum(1 for f in has if k in f)
        for level in (1, 2):
            above = sum(1 for g in grades if g >= level)
            high = sum(1 for f, g in zip(has, grades) if k in f and g >= level)
            low, below = every - high, n - above
            spread = (max(every * (1 - every / n) / n, 1e-12) * (1 / above + 1 / below)) ** 0.5
            if low / below - high / above >= ordinal.MIN_SIGMAS * spread:
                want = max(want, np.log((low + 0.5) / (below + 1)) - np.log((high + 0.5) / (above + 1)))
        assert got[k] == pytest.approx(want if every >= ordinal.MIN_TEXTS else 0.0)


def test_the_fit_over_spark_is_the_fit_in_memory(spark):
    """Counting and narrowing by Spark changes neither the features nor the weights."""
    rows = labelled(700, 1)
    frame = spark.createDataFrame(rows, "event_id long, extracted_text string, status string").repartition(7)
    (places, values), thresholds = ordinal.fit_ratings(frame, frame.select("event_id", "status"))
    weights, bounds = ordinal.fit(pa.array([r[1] for r in rows]), np.array([GRADES[r[2]] for r in rows]), np.ones(len(rows)))
    assert places.tolist() == np.flatnonzero(weights).tolist()
    assert np.allclose(values, weights[places], rtol=1e-3, atol=1e-4) and np.allclose(thresholds, bounds, atol=1e-4)


def test_scores_word_by_word():
    """One window: the features of a text are its distinct words and prefixes, and shares of endings and shapes."""
    text = "alpha beta alpha gamma"
    index, value, _ = ordinal.features(pa.array([text]))
    weights = np.random.default_rng(1).normal(size=ordinal.DIMENSIONS).astype(np.float32)
    assert ordinal.scores(pa.array([text]), weights)[0] == pytest.approx(float((weights[index] * value).sum()), abs=1e-4)
    long = " ".join(f"w{k}" for k in range(10 * ordinal.WINDOW_WORDS))
    words = long.split()
    each = sorted(
        ordinal.scores(pa.array([" ".join(words[i * ordinal.WINDOW_WORDS:(i + 1) * ordinal.WINDOW_WORDS])]), weights)[0] for i in range(10)
    )
    assert ordinal.scores(pa.array([long]), weights)[0] == pytest.approx(sum(each[:2]) / 2, abs=1e-3)


def test_languages_block_by_block(spark):
    rng = random.Random(9)
    parts = {"aa": ["kal", "mor", "tis"], "bb": ["ouai", "elle", "eaux"], "cc": ["ção", "lho", "nha"]}
    say = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(n))
    known = {lang: say(lang, 2000).encode() for lang in parts}
    texts = [say(rng.choice(list(parts)), rng.choice([1, 5, 60, 4000])) for _ in range(40)] + [None, "", "123", "É", say("aa", 40) + say("bb", 40)]
    got = language.recognise_languages(spark.createDataFrame(list(enumerate(texts)), "frame_idx long, composite string"), known).collect()
    for r, text in zip(sorted(got, key=lambda r: r["frame_idx"]), texts):
        if text is None or not re.search(r"[^\W\d_]", text):
            assert (r["lang_pred"], r["score"], r["narrow"]) == ("und", 0.0, True)
            continue
        body = text.lower().encode()
        n = max(1, -(-len(body) // language.BLOCK_BYTES))
        sizes = {}
        for lang, dictionary in known.items():
            raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[lang] = sum(
                len(zstandard.ZstdCompressor(dict_data=raw, level=language.LEVEL, write_content_size=False, write_checksum=False).compress(body[len(body) * i // n:len(body) * (i + 1) // n]))
                for i in range(n)
            )
        best = min(sorted(sizes), key=sizes.get)
        second = min(v for k, v in sizes.items() if k != best)
        assert r["lang_pred"] == best
        assert r["score"] == pytest.approx(1 / sum(2.0 ** (-8 * min(v - sizes[best], 100)) for v in sizes.values()))
        assert r["narrow"] == (second - sizes[best] < language.MIN_MARGIN * sizes[best])
