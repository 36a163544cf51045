"""Operators 6 and 9, and the pipeline, against plain versions."""
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
from llm_fixtures import EDGE, frame, local

import corpus_pipeline
from ledgerhawk.llm import licence_rules, sanitise, toxic_grammar
from test_duplicates import near
from test_tokens import BPE, bpe_ids, check_packing

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), KINDS.index(kind), m.end()))
    return sorted(out)


def spelled(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def check_base(rows, df):
    want = sorted(((d, *[sum(s[1] == k for s in base(t)) for k in range(4)], hashlib.sha256(spelled(base(t)).encode()).hexdigest()) for d, t in rows), key=str)
    got = sanitise.personal_data(df).collect()
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got), key=str) == want
    return got


def test_base_spans_on_random_text(spark):
    rng = random.Random(6)
    bits = ["a", "b.c", "@", ".", "-", " ", "  ", "+", "1", "23", "4111111111111111", "4111 1111 1111 1111", "10.0.0.1", "256.1.1.1", "1.2.3.4.5",
            "x@y.z", "q_w%e@a-b.co.uk", "+1 (555) 555-1234", "\n", "é", "\U0001f600", "..", "--", "007.08.9.1", "", ""]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 40)))) for i in range(1500)]
    rows += [(9000, "1 2" * 30_000), (9001, "a." * 40_000 + "@" + "b." * 40_000 + "c"), (9002, "+1" + " (" * 30_000), (9003, "9" * 60_000)]
    check_base(rows, frame(spark, rows))


def test_base_spans_small_and_edges(small, edge, nothing):
    check_base(list(local(small).itertuples(index=False, name=None)), small)
    check_base([(d, t) for d, t in EDGE], edge)
    assert sanitise.personal_data(nothing).collect() == []


def test_terms_follow_the_information_measure(spark):
    filler = ["alpha", "beta", "gamma", "delta", "the", "and"]
    rng = random.Random(3)
    rows = []
    for i in range(60):
        words = [rng.choice(filler) for _ in range(12)]
        if i < 3:  # one entity, always beside a word that occurs with it only
            words[6:6] = ["zanzibar", "me@host.example", "the"]
        elif i < 6:  # another, beside a word that is also common elsewhere
            words[6:6] = ["common", "you@host.example"]
        elif i < 40:
            words.insert(4, "common")
        rows.append((i, " ".join(words)))
    df = frame(spark, rows)
    got = {r.doc_id: r.spans for r in sanitise.personal_data(df).collect()}
    found = collections.defaultdict(set)
    for d, t in rows:
        for span in filter(None, got[d].split(",")):
            kind, a, b = span.split(":")
            found[kind].add(t[int(a):int(b)])
    assert found["email"] == {"me@host.example", "you@host.example"}
    assert "zanzibar" in found["term"] and not {"common", "the", "and"} & found["term"]
    n = len(rows)
    for term in found["term"]:  # each term meets the threshold for one of the entities
        has = lambda w: {d for d, t in rows if w in t.split()}
        assert any(len(has(term) & has(e)) >= 3 and math.log2(len(has(term) & has(e)) * n / (len(has(term)) * len(has(e)))) >= 0.6 * math.log2(n / len(has(e)))
                   for e in found["email"])
    clean = {r.doc_id: r.text for r in sanitise.sanitise(df).collect()}
    for d, t in rows:
        out, at = "", 0
        for span in filter(None, got[d].split(",")):
            kind, a, b = span.split(":")
            out, at = out + t[at:int(a)] + sanitise.REPLACED[kind], int(b)
        assert clean[d] == out + t[at:]


def test_terms_are_counted_and_replaced_in_whole_documents(spark):
    rng = random.Random(4)
    filler = ["alpha", "beta", "gamma", "delta", "the", "and"]
    far = lambda: " ".join(rng.choice(filler) for _ in range(60))
    rows = [(i, far()) for i in range(60)]
    for i in range(3):  # far from the entity, and spelled with hyphen, apostrophe or digit
        rows[i] = (i, f"Jean-Luc {far()} me@host.example {far()} (Zanzibar) {far()} o'brien, zanzibar. {far()} a320")
    rows[10] = (10, f"{far()} in ZANZIBAR/jean-luc {far()}")  # without the entity
    rows[11] = (11, f"{far()} zanzibars a3201 {far()} jean \ue002zanzibar\ue003")
    df = frame(spark, rows)
    found = collections.defaultdict(list)
    for r in sanitise.personal_data(df).collect():
        for span in filter(None, r.spans.split(",")):
            kind, a, b = span.split(":")
            if kind == "term":
                found[r.doc_id].append(rows[r.doc_id][1][int(a):int(b)])
        assert r.n_term == len(found[r.doc_id])
    assert {d: f for d, f in found.items() if f} == {**{i: ["Jean-Luc", "Zanzibar", "o'brien", "zanzibar", "a320"] for i in range(3)},
                                                    10: ["ZANZIBAR", "jean-luc"], 11: ["zanzibar"]}
    clean = {r.doc_id: r.text for r in sanitise.sanitise(df).collect()}
    assert clean[10] == rows[10][1].replace("ZANZIBAR", "[TERM]").replace("jean-luc", "[TERM]")
    assert not any(re.search("zanzibar\\b|jean-luc|o'brien|a320\\b|host", clean[d].lower()) for d in clean)


def test_overlapping_spans_are_replaced_as_one(spark):
    text = "call +1 10.200.30.40, bye"
    assert sanitise.sanitise(frame(spark, [(1, text)])).first().text == "call [PHONE], bye"


def test_sanitise_keeps_rows_and_columns(edge, nothing):
    got = sanitise.sanitise(edge)
    assert got.columns == edge.columns
    rows = got.collect()
    assert len(rows) == len(EDGE) and sum(r.text is None for r in rows) == sum(t is None for _, t in EDGE)
    assert any(r.text == "mail [EMAIL] and [IP]\nnext" for r in rows)
    assert not any(base(r.text) for r in rows)
    assert sanitise.sanitise(nothing).collect() == []


def scan(text):
    """Licence names, sentence by sentence."""
    if not re.search(licence_rules._HINT, text or ""):
        return (), ""
    ids, rules = licence_rules._table()
    ids = dict(ids)
    hits = set()
    for i, unit in enumerate(re.split(licence_rules._END, text)):
        lines = unit.split("\n")
        for j, form in enumerate([unit, *lines] if len(lines) > 1 else [unit]):
            if licence_rules.plain(form) in ids:
                hits.add((i, j, ids[licence_rules.plain(form)]))
    hits = sorted(hits)
    found = []
    for name, rule in rules:
        at = first = last = 0
        for i, _, k in hits:
            if k == rule[at] and (at == 0 or i - last <= licence_rules.GAP):
                first = i if at == 0 else first
                at, last = at + 1, i
            elif k == rule[0]:
                at, first, last = 1, i, i
            if at == len(rule):
                found.append((first, i, len(rule), name))
                at = 0
    names = {m[3] for m in found if not any(o[0] <= m[0] and o[1] >= m[1] and o[2] > m[2] for o in found)}
    return tuple(h[2] for h in hits), ",".join(sorted(names))


def test_licences(spark, small, edge, nothing):
    rows = list(local(small).itertuples(index=False, name=None))
    at = 10_000
    for name, sentences in licence_rules.RULES:  # whole, wrapped with comment marks, in wrong order, with a sentence missing
        words = " ".join(sentences).split()
        wrapped = "\n".join(" * " + " ".join(words[i:i + 9]) for i in range(0, len(words), 9))
        for text in ("Prose first.\n" + " ".join(sentences) + "\nMore.", wrapped, " ".join(reversed(sentences)), " ".join(sentences[1:]), "\n".join(sentences)):
            rows.append((at, text))
            at += 1
    got = {r.doc_id: (tuple(int(x) for x in r.sentence_ids.split(",") if x), r.licences) for r in licence_rules.scan(frame(spark, rows)).collect()}
    assert got == {d: scan(t) for d, t in rows}
    for k, (name, _) in enumerate(licence_rules.RULES):
        assert name in got[10_000 + 5 * k][1].split(",")
    assert got[10_000 + 5 * 3 + 3][1] == "" and got[10_000 + 5 * 3 + 2][1] == ""
    assert len(licence_rules.scan(edge).collect()) == len(EDGE) and licence_rules.scan(nothing).collect() == []


def test_longest_rule_wins_and_holders_may_have_any_name(spark):
    rules = {}
    for name, sentences in licence_rules.RULES:
        rules[name] = max(rules.get(name, ()), sentences, key=len)
    two, three = rules["BSD-2-Clause"], rules["BSD-3-Clause"]
    named = three[:2] + ("Neither the name of <organization> nor the names of its contributors may be used to endorse or promote products "
                         "derived from this software without specific prior written permission.",)
    mit = " ".join(rules["MIT"])
    rows = [" ".join(two), " ".join(three), "\n".join(f"{i}. {x}" for i, x in enumerate(named)), " ".join(three) + "\n" + mit,
            " ".join(three) + "\n\nAnother part. " + "Prose here. " * 9 + " ".join(two),
            "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
            "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
            "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."]
    got = {r.doc_id: r.licences for r in licence_rules.scan(frame(spark, list(enumerate(rows)))).collect()}
    assert [got[i] for i in range(len(rows))] == ["BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause", "BSD-3-Clause,MIT", "BSD-2-Clause,BSD-3-Clause",
                                                  "LGPL-2.1", "CC-BY-SA-4.0"]
    assert all(got[i] == scan(t)[1] for i, t in enumerate(rows))


def test_wrapped_licence_below_other_lines(spark):
    rows = []
    for name, sentences in licence_rules.RULES:
        words = " ".join(sentences).split()
        lines = [" ".join(words[i:i + 9]) for i in range(0, len(words), 9)]
        rows.append((name, "/*\n * Copyright (c) 2020 X\n *\n" + "\n".join(f" * {x}" for x in lines) + "\n */\ncode();"))
        rows.append((name, "Copyright (c) 2020 X\n" + "\n".join(lines)))
        rows.append((name, "// Copyright X\n// All rights reserved\n" + "\n".join(f"// {x}" for x in lines)))
    got = {r.doc_id: r.licences.split(",") for r in licence_rules.scan(frame(spark, list(enumerate(t for _, t in rows)))).collect()}
    assert [name for i, (name, _) in enumerate(rows) if name not in got[i]] == []


def test_base_spans_with_wide_separators(spark):
    rng = random.Random(8)
    rows = [(0, "+4 9 1 5 1 2 3 4 5 6"), (1, "+4  9  1  5  1  2  3  4  5  6"), (2, "a +4. 9. 1. 5. 1. 2. 3. 4. 5. 6 b")]
    rows += [(i, rng.choice(["", "call "]) + "+" + rng.choice(["  ", ". ", " - ", ") (", ""]).join(rng.choice("0123456789") for _ in range(rng.randrange(8, 18))))
             for i in range(3, 60)]
    got = check_base(rows, frame(spark, rows))
    assert {r.doc_id: r.n_phone for r in got if r.doc_id < 3} == {0: 1, 1: 1, 2: 1}


def test_pipeline_equals_a_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    toxic = {r.doc_id for r in toxic_grammar.scores(docs, labels).where("predicted = 1").collect()}
    rows = [(d, t) for d, t in local(docs).itertuples(index=False, name=None) if d not in toxic]
    last = {t: d for d, t in sorted(rows)}
    rows = [(d, t) for d, t in rows if last[t] == d]
    rows = [r for r in rows if dict((d, c) for d, _, c in near(rows))[r[0]] == r[0]]
    clean = {r.doc_id: r.text for r in sanitise.sanitise(frame(spark, rows)).collect()}
    ids = {d: [*i, 2] for d, i in zip(clean, bpe_ids(clean.values()))}
    got = corpus_pipeline.run(spark, sf).collect()
    check_packing(got, ids)
    assert {r.doc_id for r in got} == set(ids)
    for r in got:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert sum(r.length for r in got) == sum(map(len, ids.values()))


def test_pipeline_stages_on_edges(spark, edge, nothing):
    sf = "/root/testdata/sf0.001"
    for docs in (edge, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            rows = out.collect()
            if name != "packing":
                assert out.columns == docs.columns
            if docs is nothing:
                assert rows == []
    assert BPE


def plain_terms(rows, disclosure=0.6, certainty=0.5, support=3):
    """All terms of a corpus that disclose one of its addresses."""
    import regex
    mail = regex.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    word = regex.compile(r"[\p{L}\p{N}\p{M}](?:['\u2019-]?[\p{L}\p{N}\p{M}])*")
    n, terms, values = len(rows), collections.defaultdict(set), collections.defaultdict(set)
    for i, (_, t) in enumerate(rows):
        for m in mail.finditer(t):
            values[m[0].lower()].add(i)
        for m in word.finditer(mail.sub(lambda m: " " * len(m[0]), t)):
            if len(m[0]) >= 3:
                terms[m[0].lower()].add(i)
    out = set()
    for v, vs in values.items():
        if support <= len(vs) < n:
            for w, ws in terms.items():
                both = ws & vs
                if (len({rows[i][1] for i in both}) >= support and len(both) >= certainty * len(ws)
                        and math.log2(len(both) * n / (len(ws) * len(vs))) >= disclosure * math.log2(n / len(vs))):
                    out.add(w)
    return out


def test_every_disclosing_term_of_a_corpus_with_copies_is_found(spark):
    rng = random.Random(17)
    filler, names = [f"word{i}" for i in range(40)], [f"name{i}" for i in range(30)]
    rows = []
    for i in range(300):
        words = [rng.choice(filler) for _ in range(15)]
        if rng.random() < 0.4:
            e = rng.randrange(8)
            words.append(f"p{e}@host.example")
            words += [names[3 * e + j] for j in range(3) if rng.random() < 0.8]
        if rng.random() < 0.1:
            words.append(rng.choice(names))
        rows.append((i, " ".join(words)))
    for k in range(3):  # copies of one text that holds a word of its own: one piece of evidence
        rows.append((1000 + k, "copied onlyhere word1 word2 p1@host.example"))
    want = plain_terms(rows)
    found = set()
    for r in sanitise.personal_data(frame(spark, rows)).collect():
        text = dict(rows)[r.doc_id]
        found |= {text[int(a):int(b)].lower() for kind, a, b in (x.split(":") for x in filter(None, r.spans.split(","))) if kind == "term"}
    assert found == want and len(want) >= 8 and "onlyhere" not in want


def test_clean_rows_are_left_alone(small, spark):
    base = {r.doc_id: r.n_email + r.n_ip + r.n_card + r.n_phone for r in sanitise.personal_data(small).collect()}
    clean = {r.doc_id: r.text for r in sanitise.sanitise(small).collect()}
    was = {r.doc_id: r.text for r in small.select("doc_id", "text").collect()}
    left = [clean[d] == was[d] for d, n in base.items() if not n]
    assert sum(left) >= 0.95 * len(left)
