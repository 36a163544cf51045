"""Operators 2, 7 and 10 against the libraries."""
import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from llm_fixtures import EDGE, frame, local

from ledgerhawk.llm import chunk_table, common, orc_tokens, slack_packing, tokens

BPE, SP = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["a  b", " a", "a ", "a\n b", "a \n\n b", "　 x", "I'm    ok   yes\x85 z \x1c a", "▁", "a▁ b", "<|endoftext|> <|endoftext|>x",
       "hi <|endoftext|> there", "hi  <|endoftext|>  there", "a   <|endoftext|><|endoftext|>   b", " \n <|endoftext|> \n x",
       "  <|endoftext|>", "x <| y  <|endof  z", "a <|endoftext|>b  c <", " a   <",
       "don't  \t  x", "  ", " ", "\xa0 \xa0a   b", "x▁ ▁y", "\x00 \x7f"]


def bpe_ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(BPE)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def sp():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=SP)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def rows_of(pieces, texts):
    import pyarrow as pa
    flat, n = pieces.rows(*tokens.text_bytes(pa.array(texts)))
    return [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]


def test_pieces_equal_the_library_on_random_text():
    rng = random.Random(3)
    alphabet = [*"ab 'sZ9.\n\té日▁\xa0\x85!-  <|", "<|endoftext|>", "  "]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(600)]
    assert rows_of(tokens.byte_bpe(BPE), texts) == bpe_ids(texts)
    assert rows_of(tokens.marked_words(SP), [" " + t for t in texts]) == sp().encode(texts)


def test_pieces_forget_without_changing_ids():
    texts = [f"word{i} and number{i * 7} again" for i in range(300)]
    pieces = tokens.byte_bpe(BPE, limit=10)
    assert rows_of(pieces, texts[:150]) + rows_of(pieces, texts[150:]) == bpe_ids(texts)


def test_orc_round_trip_start_and_pruned_read(spark, small):
    path = common.new_path(spark, "orc")
    orc_tokens.write_ids(small, path, BPE)
    docs = local(small)
    ids = dict(zip(docs.doc_id, bpe_ids(docs.text)))
    rows = {r.doc_id: r.ids for r in orc_tokens.read_ids(spark, path).collect()}
    assert rows == {d: [*i, 2] for d, i in ids.items()}
    one = docs.doc_id.iloc[7]
    pruned = orc_tokens.read_ids(spark, path, [int(one)])
    assert [r.ids for r in pruned.collect()] == [[*ids[one], 2]]
    assert "PushedFilters: [In(doc_id" in pruned._jdf.queryExecution().toString() or "EqualTo(doc_id" in pruned._jdf.queryExecution().toString()
    start, want = 0, {}
    for d in docs.doc_id:
        want[d] = (start, len(ids[d]) + 1, crc([*ids[d], 2]))
        start += len(ids[d]) + 1
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in orc_tokens.digests(orc_tokens.read_ids(spark, path)).collect()}
    assert got == want


def test_orc_starts_follow_the_files(spark):
    df = frame(spark, [(1, "b " * n) for n in (4, 1, 19, 10, 7)] + [(0, "zero"), (2, "two")]).repartition(3)
    path = common.new_path(spark, "orc")
    orc_tokens.write_ids(df, path, BPE)
    files = [(r.doc_id, len(r.ids)) for r in orc_tokens.read_ids(spark, path).orderBy("doc_id", "tie").collect()]
    at, want = 0, []
    for d, n in files:
        want.append((d, at, n))
        at += n
    got = sorted((r.doc_id, r.start, r.n_tokens) for r in orc_tokens.digests(orc_tokens.read_ids(spark, path)).collect())
    assert got == sorted(want)


def test_orc_edges(spark, edge, nothing):
    for df, n in ((edge, len(EDGE)), (nothing, 0)):
        path = common.new_path(spark, "orc")
        orc_tokens.write_ids(df, path, BPE)
        rows = orc_tokens.digests(orc_tokens.read_ids(spark, path)).collect()
        assert len(rows) == n
        assert sum(r.n_tokens for r in rows) == sum(len(i) + 1 for i in bpe_ids([t for _, t in EDGE])) * (n > 0)
        ends = sorted((r.start, r.start + r.n_tokens) for r in rows)
        assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def check_packing(rows, ids, capacity=1024):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_small(spark, small):
    docs = local(small)
    ids = {d: [*i, 2] for d, i in zip(docs.doc_id, bpe_ids(docs.text))}
    rows = slack_packing.pack_documents(small, BPE, with_ids=True)
    got = rows.collect()
    n = check_packing(got, ids)
    pieces = collections.defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert crc(part) == r.ids_crc32 and list(r.ids) == part
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    for d, parts in pieces.items():
        parts.sort()
        assert sum(p[2] for p in parts) == len(ids[d]) and all(p[2] == 1024 for p in parts[1:])
        assert len(parts) == -(-len(ids[d]) // 1024) and parts[0][:2] == (0, 0)
    assert set(pieces) == set(ids)
    assert n <= 1.02 * -(-sum(map(len, ids.values())) // 1024) + 1
    made = slack_packing.sequences(rows).collect()
    assert len(made) == n and sum(len(r.ids) for r in made) == sum(map(len, ids.values()))


def test_packing_edges(edge, nothing):
    rows = slack_packing.pack_documents(edge, BPE).collect()
    assert sum(r.length for r in rows) == sum(len(i) + 1 for i in bpe_ids([t for _, t in EDGE]))
    check_packing(rows, None)
    assert slack_packing.pack_documents(nothing, BPE).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once_and_fills(seed):
    rng = random.Random(seed)
    counts = collections.Counter(min(1024, int(rng.expovariate(1 / 200)) + 1) for _ in range(3000))
    counts[1024] += 500
    places = set()
    for length, lo, hi, seq, per, offset in slack_packing.plan(dict(counts)):
        for r in range(lo, hi):
            s, o = seq + (r - lo) // per, offset + length * ((r - lo) % per)
            assert o + length <= 1024
            span = {(s, o + i) for i in range(length)}
            assert not span & places
            places |= span
    total = sum(l * c for l, c in counts.items())
    assert len(places) == total
    assert len({s for s, _ in places}) <= -(-total // 1024) + 2


def test_fullest_is_the_best_subset_sum():
    from itertools import product
    rng = random.Random(1)
    for _ in range(60):
        counts = {rng.randrange(1, 30): rng.randrange(1, 3) for _ in range(5)}
        first = max(counts)
        room = rng.randrange(0, 60)
        got = slack_packing.fullest(counts, first, room)
        left = dict(counts)
        left[first] -= 1
        best = max(s for s in (sum(l * k for l, k in zip(left, ks)) for ks in product(*(range(c + 1) for c in left.values()))) if s <= room)
        assert sum(l * m for l, m in got.items()) - first == best
        assert all(m <= counts[l] for l, m in got.items())


def test_sentencepiece_equals_the_library(spark, small):
    s, sha = sp(), lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = local(small)
    want = {}
    for d, t in zip(docs.doc_id, docs.text):
        i = s.encode(t or "", add_eos=True)
        want[d] = (len(i), sha(" ".join(map(str, i))), sha(s.decode(i)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in chunk_table.round_trip(small, SP).collect()}
    assert got == want
    tiny = chunk_table.round_trip(small, SP, table_size=0)  # all words beyond the table
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tiny.collect()} == want


def test_sentencepiece_edges_and_decode(spark, edge, nothing):
    s = sp()
    df = frame(spark, list(enumerate(ODD)))
    rows = chunk_table.encode(df, SP)
    assert {r.doc_id: list(r.ids) for r in rows.collect()} == {i: s.encode(t, add_eos=True) for i, t in enumerate(ODD)}
    assert {r.doc_id: r.text for r in chunk_table.decode(rows, SP).collect()} == {i: s.decode(s.encode(t)) for i, t in enumerate(ODD)}
    assert sorted(r.n_tokens for r in chunk_table.round_trip(edge, SP).collect()) == sorted(len(s.encode(t or "")) + 1 for _, t in EDGE)
    assert chunk_table.round_trip(nothing, SP).collect() == []
