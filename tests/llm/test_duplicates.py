"""Operators 1, 3 and 8 against brute force."""
import collections
import hashlib
import random
import re

import numpy as np
from llm_fixtures import EDGE, frame, local
from pyspark.sql import functions as F

from ledgerhawk.llm import content_sort, edit_embedding, groups, parity_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


def exact(rows, pick=max):
    by = collections.defaultdict(list)
    for d, t in rows:
        by[t or ""].append(d)
    return sorted((d, pick(by[t or ""]), len(by[t or ""]), d == pick(by[t or ""]), sha(t)) for d, t in rows)


def test_content_sort(spark, small):
    rows = list(local(small).itertuples(index=False, name=None))
    got = content_sort.exact_groups(small)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == exact(rows)
    got = content_sort.exact_groups(small, keep="min", normalise=F.lower)
    lowered = [(d, t.lower()) for d, t in rows]
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == exact(lowered, min)


def test_content_sort_groups_over_many_ranges(spark):
    rows = [(i, "hot " * 30 if i % 3 else f"text {i % 40}") for i in range(3000)] + [(5000 + i, "same beginning of all " + "ab"[i % 2]) for i in range(50)]
    df = frame(spark, rows).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = content_sort.exact_groups(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == exact(rows)


def test_content_sort_edges(edge, nothing):
    got = content_sort.exact_groups(edge).collect()
    assert len(got) == len(EDGE)
    kept = [r.text_sha256 for r in got if r.kept]
    assert sorted(kept) == sorted({sha(t) for _, t in EDGE})
    by = collections.Counter(sha(t) for _, t in EDGE)
    assert all(r.group_size == by[r.text_sha256] for r in got)
    assert {r.keep_id for r in got if r.text_sha256 == sha("")} == {3}  # of ids 2, 3 and null
    assert content_sort.exact_groups(nothing).collect() == []
    single = content_sort.deduplicate(edge)
    assert single.columns == edge.columns
    assert sorted((r.text or "") for r in single.collect()) == sorted({t or "" for _, t in EDGE})


def shingles(text, k=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near(rows):
    """(doc_id, n_shingles, smallest id reached) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = d if root(i) not in least else (d if least[root(i)] is None else min(x for x in (d, least[root(i)]) if x is not None) if d is not None else least[root(i)])
    return sorted(((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def got_near(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in parity_join.near_duplicates(df).collect()), key=str)


def test_parity_join_small(small):
    assert got_near(small) == near(list(local(small).itertuples(index=False, name=None)))


def test_parity_join_chains_borders_and_hot_groups(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, passage = [], " ".join(f"p{i}" for i in range(60))
    for n in (1, 2, 3, 4, 5, 6, 7, 9, 12, 15, 16, 17, 20, 21, 22, 30, 60, 64, 65, 80, 85, 86, 120, 250, 256, 300):
        words = [rng.choice(vocabulary) for _ in range(n + 4)]
        for step in range(6):  # a chain of texts, each one edit further
            rows.append(" ".join(words))
            words[rng.randrange(len(words))] = f"new{step}"
            if step % 2:
                words += [f"more{step}"] * max(1, n // 12)
    hot = [rng.choice(vocabulary) for _ in range(120)]
    for i in range(120):  # a large group of near copies, and a passage that many texts share
        copy = list(hot)
        copy[rng.randrange(120)] = f"x{i}"
        rows.append(" ".join(copy))
        rows.append(passage + " " + " ".join(rng.choice(vocabulary) + str(i) for _ in range(rng.randrange(10, 160))))
    rows = list(enumerate(rows))
    assert got_near(frame(spark, rows)) == near(rows)


def test_parity_join_sets_share_as_many_keys_as_promised():
    rng = np.random.default_rng(4)
    for n in [1, 2, 3, 4, 5, 7, 11, 16, 17, 40, 63, 64, 65, 200, 256, 257, 700]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            both = int(np.ceil(0.75 * n))
            b = np.unique(np.append(a[rng.permutation(n)[:both]], rng.integers(0, 2**64, max(0, both * 4 // 3 - n), dtype=np.uint64)))
            inter = len(np.intersect1d(a, b))
            if 100 * inter < 75 * (len(a) + len(b) - inter):
                continue
            ka = {e: (g, set(k.tolist())) for e, g, k in parity_join.keys(a)}
            kb = {e: (g, set(k.tolist())) for e, g, k in parity_join.keys(b)}
            pair = parity_join.band_of(max(len(a), len(b)))
            assert any(len(ka[e][1] & kb[e][1]) >= max(1, min(ka[e][0], kb[e][0])) for e in ka if e in kb and e % 100 == pair)
            if ka[pair][0] > 0 and kb[pair][0] > 0:
                assert len(ka[pair][1] & kb[pair][1]) >= max(ka[pair][0], kb[pair][0])


def test_parity_join_edges(edge, nothing):
    rows = [(d, t) for d, t in EDGE]
    assert got_near(edge) == near(rows)
    assert parity_join.near_duplicates(nothing).collect() == []
    one = parity_join.one_per_group(edge)
    assert one.columns == edge.columns
    assert sum(r.text == "twice the same" for r in one.collect()) == 1


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 60)] + [tuple(sorted(rng.sample(range(100, 300), 2))) for _ in range(150)]
    got = {r.node: r.comp for r in groups.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else root(parent[x])

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for x in list(parent)}
    early = groups.components(spark.createDataFrame(pairs[:90], "a long, b long"))
    got = {r.node: r.comp for r in groups.components(spark.createDataFrame(pairs[90:], "a long, b long"), early).collect()}
    assert got == {x: root(x) for x in list(parent)}


def test_a_link_is_read_once_for_components(spark, monkeypatch):
    """One group of 200 nodes in which equal parity links: every link, however
    late it is found, is joined with the components once."""
    read, original = [], groups.stored

    def counting(df, name):
        table = original(df, name)
        if name == "edges":
            read.append(table.count())
        return table

    monkeypatch.setattr(groups, "stored", counting)
    members = spark.createDataFrame([(7, i) for i in range(200)], "sig long, node long")
    labels, links = groups.linked(members, lambda pairs: pairs.where("(a + b) % 2 = 0").select("a", "b"))
    assert {r.node: r.comp for r in labels.collect()} == {i: i % 2 for i in range(200)}
    assert sum(read) <= links.count()


def follow(rows):
    """Expected fingerprint rows by id, ids distinct."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(t)
        edited = t[:n - n // 2] + after[:n // 2]
        f = [edit_embedding.Walk(x).fingerprint() for x in (t, edited, after)]
        out[d] = (n, sha(edited), f[0].hex(), f[1].hex(), edit_embedding.likeness(*f[:2]), edit_embedding.likeness(f[0], f[2]))
    return out


def test_fingerprints_small(spark, small):
    rows = list(local(small).itertuples(index=False, name=None))
    got = edit_embedding.fingerprints(small.repartition(5)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == follow(rows) and len(got) == len(rows)
    single = frame(spark, rows[:1])
    assert {r.doc_id: tuple(r)[1:] for r in edit_embedding.fingerprints(single).collect()} == follow(rows[:1])


def test_fingerprints_edges(edge, nothing):
    got = edit_embedding.fingerprints(edge).collect()
    assert sorted(r.n_chars for r in got) == sorted(len(t or "") for _, t in EDGE)
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id, r.n_chars].add(r.fingerprint)
    assert len(by[4, len(EDGE[3][1])]) == 1
    assert {r.fingerprint for r in got if not r.n_chars} == {"00" * edit_embedding.SAMPLES}
    assert edit_embedding.fingerprints(nothing).collect() == []


def slow_walk(text):
    """Steps one by one, as the definition has it."""
    moves, t, out = edit_embedding._moves(), 0, []
    walk = edit_embedding.Walk(text)
    kinds = [edit_embedding.mix(np.array([ord(c) + 77], np.uint64))[0] for c in text]
    for k in kinds:
        for _ in range(moves[int(k) % edit_embedding.CLASSES][t % edit_embedding.PERIOD]):
            out.append(int(k) >> 40 & 255)
            t += 1
    assert walk.length == t
    return out


def test_walk_sampling_and_embedding_distance():
    rng = random.Random(1)
    for _ in range(20):
        x = "".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(1, 300)))
        y = list(x)
        y[rng.randrange(len(y))] = "z"
        y = "".join(y)
        a, b, wa, wb = slow_walk(x), slow_walk(y), edit_embedding.Walk(x), edit_embedding.Walk(y)
        assert wa.at(np.arange(len(a))).tolist() == a
        same = sum(p == q for p, q in zip(a, b)) / max(len(a), len(b))
        assert abs(edit_embedding.embedding_likeness(wa, wb) - same) < 1e-12
        half = edit_embedding.Walk(x[len(x) // 2:], edit_embedding.Walk(x[:len(x) // 2]))
        assert half.fingerprint() == wa.fingerprint()


def test_near_texts_share_fingerprints_others_do_not():
    rng = random.Random(7)
    text = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 9))) for _ in range(n))
    near_, far = [], []
    for _ in range(30):
        x = text(150)
        cut = rng.randrange(len(x))
        y = x[:cut] + "q" + x[cut:]
        fx, fy, fz = (edit_embedding.Walk(t).fingerprint() for t in (x, y, text(150)))
        near_.append(edit_embedding.likeness(fx, fy))
        far.append(edit_embedding.likeness(fx, fz))
    assert np.mean(near_) > 0.85 and np.mean(far) < 0.2


def test_embedding_near_duplicates(spark, edge, nothing):
    rng = random.Random(9)
    rows = []
    for i in range(40):
        t = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(6)) for _ in range(60))
        rows += [(4 * i, t), (4 * i + 1, t), (4 * i + 2, t + " end")]
    got = {r.doc_id: r.component_id for r in edit_embedding.near_duplicates(frame(spark, rows)).collect()}
    assert got == {d: d - d % 4 for d, _ in rows}
    assert len(edit_embedding.near_duplicates(edge).collect()) == len(EDGE)
    assert edit_embedding.near_duplicates(nothing).collect() == []


def shared_keys(a, b):
    """(part, keys that both have, number sure of a, of b)."""
    of = [{part: (sure, set(k.tolist())) for part, sure, k in parity_join.keys(x)} for x in (a, b)]
    return [(p, len(of[0][p][1] & of[1][p][1]), of[0][p][0], of[1][p][0]) for p in of[0] if p in of[1]]


def test_tiny_sets_in_one_place_keep_their_link(spark):
    small, large = np.array([1, 2, 3], np.uint64), np.array([1, 2, 3, 4], np.uint64)  # all in place 0 of band 0
    assert any(n and n >= x and n >= y for _, n, x, y in shared_keys(small, large))
    rows = [(node, part, sure, k) for node, s in enumerate((small, large)) for part, sure, ks in parity_join.keys(s) for k in ks.view(np.int64).tolist()]
    members = spark.createDataFrame(rows, "node long, part int, sure int, sig long").select("sig", "node", "part", "sure")
    split = members.groupBy("sig").count().where("count > 1").select("sig")
    assert {r.node for r in groups.pruned(members.join(split, "sig")).select("node").distinct().collect()} == {0, 1}


def test_sure_keys_hold_for_the_smallest_partner():
    def spread(n):  # as many places as there can be
        return np.linspace(1, 2**64 - 2**12, n).astype(np.uint64)

    for n in (200, 300, 500, 1000, 1365, 5000):
        of_n = {part: sure for part, sure, _ in parity_join.keys(spread(n))}
        for m in {(3 * n + 3) // 4, n, 4 * n // 3}:
            for part, _, k in parity_join.keys(spread(m)):
                if part in of_n and part < 100:
                    assert of_n[part] <= len(k) - (m + min(4 * m // 3, parity_join.top_of(part))) // 7


def test_rarest_first_keys_share_as_many_as_promised():
    rng = np.random.default_rng(14)
    counts = rng.integers(0, 4, parity_join.BUCKETS).astype(np.uint8)
    for n in [1, 3, 7, 16, 40, 64, 200, 257, 700]:
        for _ in range(8):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            both = int(np.ceil(0.86 * n))  # then (2 - 0.86) sets in the union leave 0.75
            b = np.unique(np.append(a[rng.permutation(n)[:both]], rng.integers(0, 2**64, n - both, dtype=np.uint64)))
            if 100 * len(np.intersect1d(a, b)) < 75 * len(np.union1d(a, b)):
                continue
            ka, kb = ({e: (g, set(k.tolist())) for e, g, k in parity_join.keys(x, counts)} for x in (a, b))
            pair = parity_join.band_of(max(len(a), len(b)))
            assert any(len(ka[e][1] & kb[e][1]) >= max(1, min(ka[e][0], kb[e][0])) for e in ka if e in kb and e % 100 == pair)


def test_parity_bits_bound_the_difference_from_below():
    rng = np.random.default_rng(15)
    for n in [1, 2, 8, 9, 16, 17, 33, 100, 500, 2000]:
        for m in {max(1, n // 2), n, 2 * n}:
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            b = np.unique(np.append(a[:rng.integers(0, n + 1)], rng.integers(0, 2**64, m, dtype=np.uint64)))
            distance = parity_join.hamming(parity_join.parity_bits(a), parity_join.parity_bits(b))
            assert distance <= len(np.setxor1d(a, b))
            assert parity_join.hamming(parity_join.parity_bits(a), parity_join.parity_bits(a.copy())) == 0
    far = [np.unique(rng.integers(0, 2**64, 500, dtype=np.uint64)) for _ in range(2)]
    assert 7 * parity_join.hamming(*map(parity_join.parity_bits, far)) > 1000  # unrelated sets are rejected by their bits


def test_a_family_below_the_threshold_makes_few_pairs(spark, monkeypatch):
    """300 documents that share about half of their words, and no link."""
    rng, passage = random.Random(21), [f"p{i}" for i in range(400)]
    rows = []
    for i in range(300):
        keep = rng.randrange(180, 240)
        rows.append((i, " ".join(passage[:keep] + [f"own{i}x{j}" for j in range(440 - keep)])))
    tested = []
    original = groups.linked

    def counting(members, verify, **more):
        def verify_and_count(pairs):
            tested.append(pairs.count())
            return verify(pairs)
        return original(members, verify_and_count, **more)

    monkeypatch.setattr(parity_join, "linked", counting)
    assert got_near(frame(spark, rows)) == near(rows)
    assert sum(tested) < 10 * len(rows)
