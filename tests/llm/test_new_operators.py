"""The prefix trie, the filter audit and the embedding join against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from pitmart.llm import lattice, prefix_trie, survival

TURNS = "conv_id long, turn long, role string, text string, conv long, seq string, depth int, h string"


def brute_trie(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", prefix_name(role or "", text or ""), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - int(np.fmod(c, 5)), [])[:h] + own[c][h:])
    members = collections.defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = collections.defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in kids[p])
    ids = lambda p: ",".join(str(c) for c in sorted(c for c in members[p] if len(rebuilt[c]) == len(p)))
    return {(min(m), len(p)): (min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ids(p).encode()).hexdigest()) for p, m in members.items()}


def prefix_name(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def trie_of(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], TURNS).repartition(3)
    got = prefix_trie.trie(prefix_trie.rebuild(prefix_trie.sequences(df))).collect()
    found = {(r["conv_id"], r["depth"]): tuple(r[2:]) for r in got}
    assert len(found) == len(got)
    return found


def conversations(n, longest, seed, texts=4, step=1):
    r = random.Random(seed)
    rows = []
    for c in range(0, n * step, step):
        for t in range(r.choice([1, 2, 3, 5, longest])):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice([None, "", "é" * 3, "a long turn"][:texts])))
    return rows


@pytest.mark.parametrize("longest,texts,step", [(8, 4, 1), (37, 1, 1), (9, 2, 3)])
def test_trie(spark, longest, texts, step):
    rows = conversations(60, longest, longest, texts, step)
    assert trie_of(spark, rows) == brute_trie(rows)


def test_trie_of_nulls_ties_copies_and_long_texts(spark):
    rows = [(None, 0, "user", "nobody")] + [(c, None, "user", "first") for c in range(0, 200, 5)]
    rows += [(c, 1, "assistant", "same") for c in range(0, 200, 5)] * 2
    rows += [(c, t, None, None) for c in range(1, 40) for t in (3, 1, 1)]
    rows += [(7, 9, "user", "word " * 50_000), (1_001, 0, "user", "family is absent"), (-3, 0, "user", "negative")]
    assert trie_of(spark, rows) == brute_trie(rows)
    assert trie_of(spark, []) == {}


def test_ids_that_end_together_are_digested_across_tasks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_A_ROW", 7)
    rows = [(c, t, "user", "same") for c in range(300) for t in range(2)]
    assert trie_of(spark, rows) == brute_trie(rows)


# ---- filters


def brute_audit(rows, labels):
    docs = [(i, lang or "", text or "") for i, text, lang in rows]
    smallest = {}
    for i, _, text in docs:
        if i is not None:
            smallest[text] = min(smallest.get(text, i), i)
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    fails = []
    for i, _, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text))
        fails.append(f + "D" * bool(re.search(r"[#$%&*|]", text)) + "E" * (i is not None and i > smallest[text]))
    out = {}
    for part in {p for _, p, _ in docs}:
        own = [(i, f) for (i, p, _), f in zip(docs, fails, strict=True) if p == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                gone = [(i, f) for i, f in left if k in f]
                left = [(i, f) for i, f in left if k not in f]
                out[part, "".join(order), step] = [len(left), len(gone), sum(k in f for _, f in own) - len(gone), sum(f == k for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    total = collections.Counter()
    for (part, order, step), row in out.items():
        total[part, order[step - 1]] += row[1]
    return {key: (*row, total[key[0], key[1][key[2] - 1]]) for key, row in out.items()}


def audit_of(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], "doc_id long, text string, lang string, failed int, digest string, part int").repartition(3)
    got = survival.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in got}
    assert len(found) == len(got)
    return found


def test_audit(spark):
    r = random.Random(3)
    rows = []
    for i in range(120):
        words = [r.choice(["alpha", "Beta", "GAMMA", "é", "x#", f"w{r.randrange(400)}", f"v{r.randrange(4000)}"][r.choice([0, 5]) :]) for _ in range(r.choice([5, 90, 110, 130]))]
        rows.append((i if i % 17 else None, " ".join(words), r.choice(["en", "de", None, ""])))
    rows += [(500 + i, rows[i % 9][1], r.choice(["en", "fr"])) for i in range(40)]
    rows += [(700, None, "en"), (701, "", None), (702, " ".join("ab" * 200), "en"), (703, "word " * 300_000, "fr"), (3, rows[3][1], "en"), (3, rows[3][1], "en"), (704, "\x1c \x85 a", "en")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 160, 2)] + [(None, 1, 1), (4, 1, 1), (4, 0, 0)]
    assert audit_of(spark, rows, labels) == brute_audit(rows, labels)
    assert audit_of(spark, rows, []) == brute_audit(rows, [])
    assert audit_of(spark, [], []) == {}


def test_carry_save_counts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 100, 4099):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert survival.positional_counts(words).tolist() == [int((words >> np.uint32(k) & 1).sum()) for k in range(32)]


# ---- vectors


def brute_vectors(rows, least=0.98):
    sound = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n = len(rows)
    links = [[] for _ in rows]
    for i, j in itertools.combinations(range(n), 2):
        (_, a, la), (_, b, lb) = rows[i], rows[j]
        if la is not None and la == lb and sound(a) and sound(b) and len(a) == len(b):
            a, b = np.float32(a).astype(float), np.float32(b).astype(float)
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                links[i].append(j)
                links[j].append(i)
    out, component = [None] * n, {}
    for i in range(n):
        if i not in component:
            seen, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            least_id = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
            component |= dict.fromkeys(seen, least_id)
        c = component[i]
        out[i] = (rows[i][0], len(links[i]), c, c is None or rows[i][0] == c)
    return sorted(out, key=str)


def vectors_of(spark, rows, **options):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], label) for i, v, label in rows]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, node string, w int").repartition(3)
    return sorted((tuple(r) for r in lattice.near_vectors(df, **options).collect()), key=str)


def near(rng, base, cosine):
    base = base / np.linalg.norm(base)
    z = rng.normal(size=len(base))
    z -= (z @ base) * base
    return cosine * base + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


def clusters(rng, n, dim=64):
    rows = []
    for _ in range(n):
        centre, label = rng.normal(size=dim), int(rng.integers(3))
        for _ in range(rng.choice([1, 1, 2, 6, 30])):
            rows.append((len(rows), near(rng, centre, rng.choice([0.9999, 0.995, 0.99, 0.985, 0.97])), label))
    return rows


def test_vectors(spark):
    rng = np.random.default_rng(5)
    rows = clusters(rng, 60)
    rows += [(1000 + i, rows[i * 3][1] * (1 if i % 2 else 3), rows[i * 3][2]) for i in range(20)]
    one = rows[0][1]
    rows += [(2000, None, 1), (2001, [0.0] * 64, 1), (2002, [float("nan")] * 64, 1), (2003, [None, *one[1:]], rows[0][2]), (2004, one, None), (2005, [float("inf"), *one[1:]], rows[0][2]), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (None, one, rows[0][2]), (None, rng.normal(size=64), 1), (3, one, rows[0][2]), (2008, [], 1), (2009, one, 99)]
    assert vectors_of(spark, rows) == brute_vectors(rows)
    assert vectors_of(spark, []) == []


def test_a_chain_and_a_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 16)
    rng = np.random.default_rng(6)
    chain = [rng.normal(size=64)]
    for _ in range(40):
        chain.append(near(rng, chain[-1], 0.982))
    centre = rng.normal(size=64)
    group = [near(rng, centre, c) for c in [0.9999] * 60 + [0.995] * 90 + [0.98] * 20]
    rows = [(i, v, 1) for i, v in enumerate([*chain, *group, *[group[5]] * 50])]
    assert vectors_of(spark, rows) == brute_vectors(rows)


def test_lattice_points_are_the_nearest_and_pairs_at_the_threshold_meet():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 8)) * 2
    point = lattice.nearest_points(x)
    assert len(lattice.ROOTS) == 240 and np.allclose((lattice.ROOTS**2).sum(axis=1), 2)
    gap = ((x - point) ** 2).sum(axis=1)
    assert all((((x - point)[:, None, :] - lattice.ROOTS) ** 2).sum(axis=2).min(axis=1) >= gap - 1e-9)
    u = rng.normal(size=(4000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v = np.stack([near(rng, a, 0.98) for a in u])
    a, b = lattice.cells(u), lattice.cells(v)
    met = (a[:, :, :, None] == b[:, :, None, :]).any(axis=(2, 3))
    assert met.any(axis=1).all() and 0.65 < met.mean() < 0.75
    assert (a[:, :, :, None] == np.roll(a, 1, axis=0)[:, :, None, :]).any(axis=(1, 2, 3)).mean() < 0.01


def test_audit_agrees_with_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = duck.execute(survival.ORACLE_SQL)
    names = [d[0] for d in found.description]
    got = survival.op12_filter_audit(spark, sf).select(names).collect()
    assert sorted(map(tuple, found.fetchall())) == sorted(map(tuple, got)) and got
