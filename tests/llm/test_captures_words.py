"""Operators 11 to 13: archives and index, spelling variants, phrases."""

import base64
import gzip
import hashlib
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from ledgerhawk.llm import capture_index, phrase_graph, spelling_variants
from ledgerhawk.llm.common import new_path
from llm_fixtures import frame

PAGES = "page_id long, url string, html string"


# --- 11 ------------------------------------------------------------------------

def plain_captures(rows, min_bytes):
    first = {}
    for page_id, url, html in rows:
        t = (html or "").encode()
        key = (page_id is None, page_id or 0, url is not None, url or "")
        if t not in first or key < first[t][0]:
            first[t] = (key, page_id)
    out, taken = [], set()
    for page_id, url, html in rows:
        t = (html or "").encode()
        key = (page_id is None, page_id or 0, url is not None, url or "")
        response = len(t) < min_bytes or (first[t][0] == key and t not in taken)
        if len(t) >= min_bytes and response:
            taken.add(t)
        out.append((page_id, len(t), base64.b32encode(hashlib.sha1(t).digest()).decode(), "response" if response else "revisit",
                    None if response else first[t][1]))
    return Counter(out)


ROWS = [(3, "http://www.a.org/x", "<p>same</p>"), (1, "http://b.org/", "<p>same</p>"), (2, None, "<p>same</p>"),
        (4, "https://a.org:443/y?q=1", None), (5, "http://user@a.org:8080/\r\nEvil: 1", ""), (6, "no url", "é\r\n\r\n日本 WARC/1.1\r\n\r\n"),
        (None, "http://c.org/", "<p>same</p>"), (7, "http://c.org/", "x" * 300_000), (8, "http://c.org/", "x" * 300_000),
        (9, "http://d.org/", "twice"), (9, "http://d.org/", "twice"), (9, "http://c.org/", "twice"), (None, None, None)]


@pytest.mark.parametrize("min_bytes", [0, 6])
def test_round_trip_equals_plain(spark, min_bytes):
    pages = spark.createDataFrame(ROWS, PAGES).withColumn("key", F.lit(1)).withColumn("sha1", F.lit("x")).withColumn("slot", F.lit(None))
    got = Counter(map(tuple, capture_index.round_trip(pages.repartition(5), min_bytes).collect()))
    assert got == plain_captures(ROWS, min_bytes)


def test_round_trip_of_a_hot_payload(spark):
    rows = [(i, f"http://h{i % 7}.org/{i}", "hot" if i % 3 else f"own {i}") for i in range(3000)]
    got = Counter(map(tuple, capture_index.round_trip(spark.createDataFrame(rows, PAGES)).collect()))
    assert got == plain_captures(rows, 0)
    slots = spark.createDataFrame(rows, PAGES).where("html = 'hot'").select(F.pmod(F.xxhash64("page_id", "url"), F.lit(capture_index.SALTS)))
    assert slots.distinct().count() > 1000  # one payload, many slots


def test_round_trip_of_nothing(spark):
    assert capture_index.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_keys_reverse_the_host():
    key = capture_index.capture_key
    assert key("http://www.Example.com:80/a/b?q=1#f") == "com,example,www)/a/b?q=1"
    assert key("https://x.org:8443") == "org,x:8443)/"
    assert key("http://10.0.0.1/") == "10.0.0.1)/"
    assert key("http://[::1]:8080/a") == "[::1]:8080)/a"
    assert key(None) == "" and key("mailto:x") == "mailto:x"


def test_lookup_reads_only_the_blocks_it_needs(spark):
    rows = [(i, f"http://h{i % 50:02d}.org/p{i % 400}", f"page {i}") for i in range(4000)] + [(9000 + i, "http://hot.org/", "hot page") for i in range(900)]
    out = new_path(spark, "lookup")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several index files though the table is small
    try:
        capture_index.write_index(capture_index.write_archives(spark.createDataFrame(rows, PAGES), out), out, block=16)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    asked = ["http://h07.org/p7", "http://hot.org/", "http://nowhere.org/", "http://h49.org/p399", "http://H07.org/p7"]
    found = capture_index.lookup(spark, out, spark.createDataFrame([(u,) for u in asked], "url string"))
    want = Counter(r[0] for r in rows if r[1] in asked)
    assert Counter(r.page_id for r in found.collect()) == want
    read = capture_index.fetch(found).where("record_type = 'response'").collect()
    texts = {r[0]: r[2] for r in rows}
    assert read and all(r.payload.decode() == texts[r.page_id] for r in read)
    files = capture_index.index_files(spark, out).collect()
    blocks = [capture_index._directory(f) for f in files]
    assert all(b[-1][0] <= f.last_key for b, f in zip(blocks, files)) and sum(f.captures for f in files) == len(rows)
    assert sum(f.first_key <= "org,hot)/" <= f.last_key for f in files) > 1  # a hot url spans index files
    # what a search for one key touches: its file's directory and at most two blocks
    one = [d for f, d in zip(files, blocks) if f.first_key <= "org,h07)/p7" <= f.last_key]
    assert len(one) == 1 and len(one[0]) > 4


def test_records_are_gzip_members_of_their_own(spark):
    out = new_path(spark, "members")
    made = capture_index.write_archives(spark.createDataFrame(ROWS, PAGES).coalesce(1), out).collect()
    for c in made:
        with open(c.file, "rb") as f:
            f.seek(c.offset)
            assert gzip.decompress(f.read(c.length)).startswith(b"WARC/1.1\r\n")


def test_a_changed_payload_is_refused():
    raw = capture_index.record(1, "http://a.org/", "A" * 32, b"text", 4, 1, None)
    with pytest.raises(ValueError):
        capture_index.parse(raw)


# --- 12 ------------------------------------------------------------------------

def plain_vocabulary(rows, min_length=7, min_count=2, one_in=31):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if i is None else i}:{word}".encode())
            if h % one_in == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            n[word] += 1
    return {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def plain_variants(n, ratio=10):
    near = defaultdict(list)
    words = sorted(n)
    for i, a in enumerate(words):
        for b in words[i + 1:]:
            if abs(len(a) - len(b)) < 2 and one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def spelled(seed=5):
    rng, rows = random.Random(seed), []
    stems = ["".join(rng.choice("aabcdeéñxyz") for _ in range(rng.randint(6, 12))) for _ in range(25)]
    for i in range(400):
        words = []
        for _ in range(20):
            w = rng.choice(stems[:1 + int(rng.random() ** 3 * 25)])
            if rng.random() < 0.25:
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abÀÿZ") + w[at:], w[:at] + rng.choice("aZc") + w[at + 1:]])
            words.append(w)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("symbols", [2, 8])
def test_variants_equal_plain(spark, symbols):
    rows = spelled()
    words = spelling_variants.vocabulary(frame(spark, rows))
    n = plain_vocabulary(rows)
    assert {r.word: r.n for r in words.collect()} == n
    got = sorted(map(tuple, spelling_variants.group_variants(words, symbols=symbols).collect()))
    want = plain_variants(n)
    assert got == want and any(r[1] for r in want) and any(not r[1] for r in want)


def test_chains_and_ties(spark):
    n = {"abcdefg": 1, "abcdefh": 10, "abcdehh": 10, "abcdxfh": 100, "abzdxfh": 1000, "abzdxfhh": 10000, "zbcdefg": 10, "aaaaaaa": 2, "aaaaaaaa": 20, "aaaaaaaaa": 200}
    got = spelling_variants.group_variants(spark.createDataFrame(list(n.items()), "word string, n long"))
    rows = sorted(map(tuple, got.collect()))
    assert rows == plain_variants(n)
    assert [r for r in rows if r[0] == "abcdefg"][0][1:3] == ("abcdefh", "abzdxfhh")


def test_neighbours_of_runs_and_of_very_long_words(spark):
    long = "xy" * 30_000
    n = {long: 100, long[:-1]: 2, long + "z": 3, "q" * 50_000: 5, "q" * 50_001: 60, "q" * 50_003: 600}
    rows = spelling_variants.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    form = {r.word: r.form for r in rows}
    assert form[long[:-1]] == long and form[long + "z"] == long and form["q" * 50_000] == "q" * 50_001 and form["q" * 50_003] is None


def test_variants_of_edge_rows(spark, edge, nothing):
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    got = sorted(map(tuple, spelling_variants.variants(edge).collect()))
    assert got == plain_variants(plain_vocabulary(rows))
    assert spelling_variants.variants(nothing).collect() == []


def test_variants_of_a_table(spark, small):
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()]
    assert {r.word: r.n for r in spelling_variants.vocabulary(small).collect()} == plain_vocabulary(rows)


# --- 13 ------------------------------------------------------------------------

def plain_counts(rows, longest=5):
    f = defaultdict(Counter)
    for lang, text in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            for i in range(len(w)):
                for m in range(1, min(longest, len(w) - i) + 1):
                    f["und" if lang is None else lang][tuple(w[i:i + m])] += 1
    return f


def plain_collocations(rows, top, min_count):
    out = []
    for lang, f in plain_counts(rows).items():
        n = sum(a for g, a in f.items() if len(g) == 1)
        cand = {g: a for g, a in f.items() if len(g) > 1 and a >= min_count}
        dropped = {g[i:i + m] for g, a in cand.items() for m in range(2, len(g)) for i in range(len(g) - m + 1) if 100 * a >= 100 * f[g[i:i + m]]}
        scored = []
        for g, a in cand.items():
            if g not in dropped:
                score, _, left, right = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def prose(seed=3, n=250):
    rng, rows = random.Random(seed), []
    vocab = [f"w{i}" for i in range(60)] + ["é", "W1", "ñandú"]
    passages = [[rng.choice(vocab) for _ in range(k)] for k in (3, 6, 9, 30)] + [["ha"] * 12, ["a", "b"] * 6]
    for i in range(n):
        words = []
        for _ in range(30):
            words += rng.choice(passages) if rng.random() < 0.15 else [rng.choice(vocab[:1 + int(rng.random() ** 2 * 62)])]
            if rng.random() < 0.2:
                words[-1] += rng.choice([",", ".", "\n", "!", " \t "])
        rows.append((rng.choice(["en", "de", None, "und"]), rng.choice([" ", "\t"]).join(words)))
    return rows


def phrases(spark, rows, **options):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    return sorted(map(tuple, phrase_graph.collocations(docs, **options).collect()))


@pytest.mark.parametrize("min_count,top", [(2, 50), (8, 10_000), (40, 10_000)])
def test_collocations_equal_plain(spark, min_count, top):
    rows = prose()
    want = plain_collocations(rows, top, min_count)
    assert len(want) > 20 and phrases(spark, rows, min_count=min_count, top=top) == want


def test_flows_equal_plain_counts(spark):
    rows = prose(seed=4)
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = {(r.lang, r.phrase): r.a for r in phrase_graph.flows(phrase_graph.longest_grams(docs, 6), min_count=6).collect()}
    want = {(lang, " ".join(g)): a for lang, f in plain_counts(rows).items() for g, a in f.items() if len(g) == 1 or a >= 6}
    assert got == want


def test_a_filter_full_of_false_hits_changes_nothing(spark):
    rows = prose(seed=6, n=120)
    docs = spark.createDataFrame(rows, "lang string, text string")
    small = phrase_graph.flows(phrase_graph.longest_grams(docs, 5, bits=7), min_count=5)
    large = phrase_graph.flows(phrase_graph.longest_grams(docs, 5), min_count=5)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_paths_hold_every_edge_once(spark):
    rows = prose(seed=8)
    docs = spark.createDataFrame(rows, "lang string, text string")
    counts = phrase_graph.flows(phrase_graph.longest_grams(docs, 5), min_count=5)
    found = phrase_graph.paths(counts).collect()
    edges = Counter((r.lang, " ".join(r.words[i:i + 5]), r.a) for r in found for i in range(len(r.words) - 4))
    want = Counter((r.lang, r.phrase, r.a) for r in counts.where("size = 5").collect())
    assert edges == want and max(len(r.words) for r in found) > 12


def test_a_long_passage_is_one_path(spark):
    passage = " ".join(f"p{i}" for i in range(300))
    counts = phrase_graph.flows(phrase_graph.longest_grams(spark.createDataFrame([("en", passage)] * 3, "lang string, text string"), 3), min_count=3)
    assert [" ".join(r.words) for r in phrase_graph.paths(counts).collect()] == [passage]


def test_exact_scores_beyond_64_bits(spark):
    counts = spark.createDataFrame([(10**11, 10**14, 10**11, 10**11)], "a long, n long, l long, r long")
    wide = [F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r")]
    rows = counts.withColumn("over", F.lit(1000).cast("decimal(4,0)") * wide[0]).withColumn("under", wide[1] * wide[2])
    got = rows.selectExpr("cast(over * cast(n as decimal(15,0)) as decimal(38,0)) div under AS score").first().score
    assert got == 1000 * 10**11 * 10**14 // (10**11 * 10**11)


def test_collocations_of_edge_rows(spark, edge, nothing):
    rows = [tuple(r) for r in edge.select("lang", "text").collect()]
    got = sorted(map(tuple, phrase_graph.collocations(edge).collect()))
    assert got == plain_collocations(rows, 2000, 100) and got
    assert phrase_graph.collocations(nothing).collect() == []
