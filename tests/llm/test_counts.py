"""Token counts, filter audit and ranked search against the library and brute force."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import pytest

P = pytest.importorskip("public_tokenizers")

from veilmark.llm import filter_audit, ranked_search, token_counts  # noqa: E402

FRAMES = "video_id string, frame_idx long, composite string, n_tokens string, text_key int, term int"


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    rng = random.Random(3)
    some = ["it's", " we'll", "   ", "\n\n", "don't ", "<|endoftext|>", "é́", "日本語", "😀", "x" * 40, "12345 ", ", ", "<|endo", "\t", "\x00"]
    texts = [None, "", " ", "a <|endoftext|> b", "b" * 3000, " " * 3000 + "x", "<|endoftext|>" * 300, "'ll" * 700, "word " * 2000]
    texts += ["".join(rng.choice(some) for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    rows = [("v", i, t, "x", 1, 2) for i, t in enumerate(texts)] + [(None, None, "repeated " * 50, "", 0, 0)] * 2
    got = token_counts.frame_token_counts(spark.createDataFrame(rows, FRAMES), path, 100, chunk=60, overlap=16)
    assert got.columns == ["video_id", "frame_idx", "n_bytes", "n_tokens", "over_limit"]
    n = lambda t: len(whole.encode(t or "", add_special_tokens=False))
    want = [(r[0], r[1], len((r[2] or "").encode()), n(r[2]), n(r[2]) > 100) for r in rows]
    key = lambda r: (r[0] is None, r[1] or 0)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert token_counts.frame_token_counts(spark.createDataFrame([], FRAMES), path).count() == 0


def test_texts_of_vocabularies_without_proof_are_not_cut(spark):
    tool = token_counts.counter(P.path("word_bpe_49k.json"))
    assert not tool.cuttable and token_counts.counter(P.path("byte_bpe_50k.json")).cuttable
    frames = spark.createDataFrame([("v", 1, "some words, here " * 30)], "video_id string, frame_idx int, composite string")
    got = token_counts.frame_token_counts(frames, P.path("word_bpe_49k.json"), chunk=50, overlap=10).first()
    assert got["n_tokens"] == len(tool.tokenizer.encode("some words, here " * 30, add_special_tokens=False))
    with pytest.raises(ValueError):
        token_counts.frame_token_counts(frames, P.path("byte_bpe_50k.json"), chunk=50, overlap=25)


def brute_audit(findings, reviewed):
    fails, parts, lost = [], [], []
    for ident, part, text in findings:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = set()
        bad |= {"A"} if len(w) < 50 else set()
        bad |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        bad |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        bad |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        bad |= {"E"} if ident is not None and any(i is not None and i < ident and (u or "") == t for i, _, u in findings) else set()
        fails.append(bad)
        parts.append(part or "")
        lost.append([ident is not None and (ident, s) in reviewed for s in ("accepted", "rejected")])
    out = []
    for part in set(parts):
        own = [i for i, p in enumerate(parts) if p == part]
        removed_by = Counter()
        rows = []
        for order in permutations("ABCDE"):
            left = set(own)
            for k, letter in enumerate(order):
                gone = {i for i in left if letter in fails[i]}
                redundant = sum(1 for i in own if letter in fails[i] and i not in left)
                left -= gone
                removed_by[letter] += len(gone)
                rows.append((part, "".join(order), k + 1, len(left), len(gone), redundant, sum(1 for i in own if fails[i] == {letter}),
                             sum(lost[i][0] for i in gone), sum(lost[i][1] for i in gone), letter))
        out += [(*r[:-1], removed_by[r[-1]]) for r in rows]
    return sorted(out)


def test_audit_equals_brute_force(spark):
    rng = random.Random(5)
    plain = [" ".join("w%d" % rng.randrange(90) for _ in range(rng.choice([3, 49, 50, 80]))) for _ in range(30)]
    odd = [None, "", " ", "ABC", "a$b", "X " * 60, "ünï " * 50, " " * 60]
    rows = [(i, rng.choice(["p", "q", None, ""]), rng.choice(plain + odd)) for i in range(120)]
    rows += [(3, "p", "twice"), (3, "q", "twice"), (4, "r", "twice"), (None, "p", "twice"), (None, "p", ""), (500, "r", "x" * 200_000)]
    reviewed = [(i, s) for i in range(0, 130, 2) for s in rng.choice([["accepted"], ["rejected"], ["accepted", "rejected"], ["pending"]])]
    findings = spark.createDataFrame([(*r, 1, 2) for r in rows], "event_id long, project_id string, extracted_text string, h1 int, bits int")
    reviews = spark.createDataFrame([*reviewed, *reviewed[:5], (None, "accepted"), (2, None)], "event_id long, status string")
    got = filter_audit.audit_filters(findings, reviews)
    assert got.columns[:3] == ["project_id", "filter_order", "step"]
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, set(reviewed))
    assert filter_audit.audit_filters(findings.limit(0), reviews).count() == 0
    assert filter_audit.audit_filters(findings, reviews.limit(0)).agg({"accepted_lost": "sum"}).first()[0] == 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(findings, frames, top):
    counts = [Counter(terms(t)) for _, _, t in frames]
    n_frames, n_terms = sum(1 for c in counts if c), sum(sum(c.values()) for c in counts)
    df = Counter(w for c in counts for w in c)
    asked = {}
    for ident, text in findings:
        asked.setdefault(ident, set()).update(terms(text))
    out = []
    for ident, some in asked.items():
        rows = []
        for (video, frame, _), c in zip(frames, counts):
            n = sum(c.values())
            score = 0
            for w in some & set(c):
                weight = math.floor(1000 * math.log((2 * n_frames + 2) / (2 * df[w] + 1)))
                score += weight * ((1000000000 * c[w]) // (1000 * c[w] + 8 * (10 + (90 * n * n_frames) // n_terms)))
            if score > 0:
                rows.append((score, video, frame))
        rows.sort(key=lambda r: (-r[0], r[2] is None, r[2] or 0, r[1] is None, r[1] or ""))
        out += [(ident, k + 1, r[1], r[2], r[0]) for k, r in enumerate(rows[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_postings", [200_000, 20])
def test_search_equals_brute_force(spark, monkeypatch, block_postings):
    monkeypatch.setattr(ranked_search, "TEXT_BYTES", 200)
    rng = random.Random(8)
    word = lambda: rng.choice(["Alpha", "beta_x", "é1", "日本", "w%d" % rng.randrange(60), "A-B", "common"])
    text = lambda n: " ".join(word() for _ in range(rng.randrange(n)))
    frames = [(rng.choice(["v", "u", None]), rng.randrange(80), text(60)) for _ in range(150)]
    frames += [("v", 3, None), (None, None, "w1 w2"), ("v", 900, ""), ("v", 901, "-- !"), ("v", 902, "w5 " * 3000), *[("same", i, "tie tie") for i in range(30)]]
    findings = [(i, text(12)) for i in range(25)] + [(30, "tie"), (31, None), (32, "nothing-here"), (33, ""), (None, "w1"), (7, "w2 beta x"), (7, "W2")]
    left = spark.createDataFrame([(*r, 1) for r in findings], "event_id long, extracted_text string, score int")
    right = spark.createDataFrame([(*r, 1, 2) for r in frames], "video_id string, frame_idx long, composite string, score int, term int").repartition(5)
    got = ranked_search.rank_frames(left, right, 4, block_postings)
    assert got.columns == ["event_id", "rank", "video_id", "frame_idx", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(findings, frames, 4)
    assert ranked_search.rank_frames(left.limit(0), right).count() == 0
    assert ranked_search.rank_frames(left, right.limit(0)).count() == 0
