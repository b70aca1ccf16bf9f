import base64
import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from mailposture.llm import arrays, byte_bpe, merging, queries, token_counts

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tiktokens():
    with open(BPE, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def piece_model():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def strange():
    rng = random.Random(1)
    alphabet = "ab'strevlmd  \n\t éß1٣漢字▁!?#😀\x1c\x00　AB"
    fixed = ["", " ", "\n", "  a", " \n a", "'s", "a's b're 'x ''s ' s", "it'sfoo's't", "!" * 40, "a" * 1000, " " * 33, " " * 100 + "x", "<s> <|endoftext|>", "▁", "\x00"]
    return fixed + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(3000)] + ["word and more " * 120_000, "▁ " * 3000]


def check(frame_rows, texts, coder):
    for r in frame_rows:
        ids = coder.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_bpe_as_the_library_does(docs, odd, tiktokens):
    texts = odd + strange()
    got = byte_bpe.round_trip(docs(texts), BPE).collect()
    assert len(got) == len(texts)
    check(got, texts, tiktokens)


def test_encode_offsets_and_decode(docs, odd, tiktokens):
    texts = odd + strange()[:400]
    encoded = byte_bpe.encode(docs(texts), BPE)
    rows = encoded.collect()
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.ids == tiktokens.encode_ordinary(text)
        pieces = [tiktokens.decode_single_token_bytes(i) for i in r.ids]
        assert list(np.cumsum([len(p) for p in pieces])) == r.ends
    assert {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(encoded, BPE).collect()} == {k: (t or "").encode() for k, t in enumerate(texts)}
    assert byte_bpe.encode(docs(["a"]).limit(0), BPE).count() == 0


def test_counts_as_the_library_does(docs, odd, piece_model):
    texts = odd + strange()
    got = token_counts.count_tokens(docs(texts), PIECES).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == [(k, len((t or "").encode()), len(piece_model.encode(t or ""))) for k, t in enumerate(texts)]
    assert token_counts.count_tokens(docs(["a"]).limit(0), PIECES).count() == 0


def test_merging_against_one_at_a_time():
    rng = random.Random(7)
    pairs = {(a, b): 3 + a * 3 + b for a in range(3) for b in range(3)} | {(3, 0): 20, (4, 1): 21, (20, 2): 22, (12, 12): 23}
    rank = np.array([rng.randrange(12) for _ in range(24)])
    left, right = map(np.array, zip(*pairs))
    table = merging.PairTable(left, right, np.array(list(pairs.values())), rank)

    def slow(symbols):
        symbols = list(symbols)
        while True:
            best = min(((rank[pairs[p]], k) for k, p in enumerate(zip(symbols, symbols[1:])) if p in pairs), default=None)
            if best is None:
                return symbols
            k = best[1]
            symbols[k : k + 2] = [pairs[symbols[k], symbols[k + 1]]]

    sequences = [[rng.randrange(3) for _ in range(rng.choice([0, 1, 2, 5, 9, 30, 300]))] for _ in range(500)]
    lengths = np.array([len(s) for s in sequences])
    got, sizes = merging.merge_all(np.array([x for s in sequences for x in s]), lengths, table)
    bounds = np.cumsum(sizes)
    for s, a, b in zip(sequences, bounds - sizes, bounds):
        assert got[a:b].tolist() == slow(s)


def test_slice_cache_survives_equal_hashes(monkeypatch):
    monkeypatch.setattr(arrays.SliceCache, "_hashes", lambda self, raw, starts, lengths: lengths.astype(np.uint64))
    cache = arrays.SliceCache(lambda slices: (np.array([s[0] for s in slices]), np.ones(len(slices), np.int64)), 4)
    assert cache.values(b"abcd", np.array([0, 2]))[0].tolist() == [97, 99]
    assert cache.values(b"xyab", np.array([0, 2]))[0].tolist() == [120, 97]


def test_queries(spark, tiktokens, piece_model):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(queries.RUN["op7_byte_bpe"](spark, SF).collect(), texts, tiktokens)
    counted = queries.RUN["op5_token_counts"](spark, SF).collect()
    assert len(counted) == len(texts)
    for r in counted:
        n = len(piece_model.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)
