"""What the methods add beyond the contracts' plain columns, recomputed plainly or measured on planted cases."""

import collections
import itertools
import math
import random

import numpy as np
import pytest

from pitmart.llm import fingerprints, language_model, mixing, pii

SCHEMA = "doc_id long, text string, source string"


def frame(spark, rows, sources=("s",)):
    return spark.createDataFrame([(i, t, sources[i % len(sources)]) for i, t in enumerate(rows)], SCHEMA).repartition(3)


def test_digests_are_quartiles_of_triplet_counts():
    r = random.Random(1)
    rows = ["", "ab", "abc", "é" * 40, *("".join(r.choice("abcdefg é") for _ in range(r.randint(3, 900))) for _ in range(20))]
    codes, lengths = fingerprints.digests([t.encode() for t in rows])
    for i, t in enumerate(rows):
        b, counts = t.encode(), [0] * 256
        for x, y, z in zip(b, b[1:], b[2:]):  # noqa: B905
            h = (x * 0x9E3779B1 + y * 0x85EBCA6B + z * 0xC2B2AE35) % 2**32
            h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
            counts[h >> 24] += 1
        cuts = [sorted(counts)[q - 1] for q in (64, 128, 192)]
        assert codes[i].tolist() == [sum(c > cut for cut in cuts) for c in counts]
        assert lengths[i] == min(255, round(8 * math.log2(len(b) + 1)))
    far = fingerprints.likeness((codes, lengths), (codes[::-1], lengths[::-1]))
    for i, (a, b) in enumerate(zip(codes, codes[::-1], strict=True)):
        score = sum((0, 1, 2, 6)[abs(int(x) - int(y))] for x, y in zip(a, b, strict=True)) + 12 * min(8, abs(int(lengths[i]) - int(lengths[-1 - i])))
        assert far[i] == pytest.approx(1 - min(score, 320) / 320)


def test_scores_are_the_trained_models(spark):
    r = random.Random(2)
    words = ["".join(r.choice("aeiou") + r.choice("bdlnrst") for _ in range(r.randint(1, 4))) for _ in range(200)]
    df = frame(spark, [" ".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(150)]).select("doc_id", "text")
    m = language_model
    texts = m.materialize(m.dealt(df))
    v = m.build_vocabulary(m.materialize(m.count_tokens(texts)))
    coded = m.materialize(m.code(texts, v))
    w = m.train(coded, v.slots)
    got = {x["doc_id"]: x["score"] for x in m.score(coded, w, v.slots).collect()}
    assert np.abs(w).max() > 0.1
    for row in coded.limit(25).collect():
        classes, slots = list(row["classes"]), np.frombuffer(row["slots"], dtype=np.uint16).astype(int).tolist()
        total = row["fixed"]
        for t, own in enumerate(classes):
            before = [slots[t - k] if t >= k else v.slots - 1 for k in (1, 2)]
            pair = [classes[t - k] if t >= k else m.END for k in (1, 2)]
            z = [w[before[0], k] + w[v.slots + before[1], k] + w[2 * v.slots + pair[0] * m.CLASSES + pair[1], k] + w[-1, k] for k in range(m.CLASSES)]
            total += math.log10(math.exp(z[own]) / sum(math.exp(x) for x in z))
        assert got[row["doc_id"]] == pytest.approx(total, rel=1e-4)
    # given a class, its words' probabilities add up to 1
    mass = collections.Counter()
    for c, logp in {(x["h"], x["class"]): x["logp"] for x in v.words.collect() if x["class"] > m.END}.items():
        mass[c[1]] += 10**logp
    assert mass and all(x == pytest.approx(1, abs=1e-3) for x in mass.values())


def test_held_out_score_is_above_the_base_at_scale(spark):
    got = language_model.op3_language_model(spark, "/root/testdata/sf0.1").where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(base_score)"] < got["sum(score)"] < 0


def test_added_spans_on_planted_masked_data(spark):
    r = random.Random(3)
    name = lambda: "".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randint(3, 8)))
    tlds = ["de", "fr", "com", "org", "es"]
    plant = [
        lambda: ("email", f"{name()} (at) {name()} (dot) {r.choice(tlds)}"), lambda: ("email", f"{name()}[at]{name()}.{r.choice(tlds)}"),
        lambda: ("ip", ".".join(str(r.randint(1, 254)) for _ in range(4)).replace(".", "[.]")), lambda: ("phone", f"{r.randint(200, 989)} 555 {r.randint(1000, 9999)}"),
    ]
    cue = {"email": "mail", "ip": "server", "phone": "call"}
    rows, planted = [], {}
    for i in range(400):
        words = [name() for _ in range(30)]
        if i % 4 == 0:
            kind, masked = plant[i // 4 % len(plant)]()
            head = " ".join(words[:9]) + f" {cue[kind]} "
            planted[i] = f"{kind}:{len(head)}:{len(head) + len(masked)}"
            rows.append(head + masked + " , " + " ".join(words[9:]))
        elif i % 4 == 1:
            rows.append(" ".join(words[:9]) + f" write {name()}@{name()}.com or +1 (743) 555-38{r.randint(10, 99)} " + " ".join(words[9:]))
        else:
            rows.append(" ".join(words[:9]) + f" version 3.{i}.{r.randint(10, 99)} at home, page 1{r.randint(100, 999)} 12 " + " ".join(words[9:]))
    added = {x["doc_id"]: set(filter(None, x["spans"].split(","))) for x in pii.find_pii(frame(spark, rows).select("doc_id", "text")).collect()}
    base = {i: {f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in pii.base_spans(t)[0]} for i, t in enumerate(rows)}
    found = {(i, s) for i in added for s in added[i] - base[i]}
    right = {(i, s) for i, s in planted.items()}
    assert len(found & right) >= 0.9 * len(right) and len(found & right) >= 0.95 * len(found)


def test_candidates_that_overlap_base_spans_have_no_votes():
    text = "ring +1 (743) 555-3824 or (743) 555-3824 now"
    base, found = pii.candidates(text)
    assert base == [(3, 5, 22)] and [c[:3] for c in found] == [(3, 5, 22), (3, 26, 40)]
    r = random.Random(4)
    for _ in range(200):
        spans = [(0, s, s + r.randint(1, 9)) for s in (r.randrange(60) for _ in range(12))]
        taken = [(1, s, s + r.randint(1, 9)) for s in (r.randrange(60) for _ in range(r.randint(0, 5)))]
        assert pii.apart(spans, taken) == [c for c in spans if all(c[2] <= s or e <= c[1] for _, s, e in taken)]


def test_mixing_takes_each_document_its_rate_on_average_and_misses_by_half_a_document(spark):
    r = random.Random(5)
    rows = [" ".join(["w"] * r.randint(1, 40)) for i in range(900)]
    df = frame(spark, rows, ("a", "b", "c", "d"))
    copies = collections.defaultdict(list)
    for seed in range(4):
        missed = collections.defaultdict(float)
        for x in mixing.mix(df, seed=seed).collect():
            missed[x["source"]] += x["taken"]
            target, rate = x["target"], x["target"] / x["source_size"]
            copies[x["doc_id"]].append((x["copies"], rate))
            missed[x["source"], "target"] = target
            assert math.floor(rate) <= x["copies"] <= math.ceil(rate)
        for s in "abcd":
            assert abs(missed[s] - missed[s, "target"]) <= 20
    # each document is taken its rate on average
    every = list(itertools.chain(*copies.values()))
    assert sum(c for c, _ in every) == pytest.approx(sum(p for _, p in every), rel=0.02)
    assert len({tuple(c for c, _ in v) for v in copies.values()}) > 5
