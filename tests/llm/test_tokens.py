import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from spanwarden.llm.pieces import encoder
from spanwarden.llm.token_counts import token_counts
from spanwarden.llm.token_output import Shard, pack, token_output, unpack, write_shard

TEXTS = ["", "Hello world", "don't  stop\n\n42 <|endoftext|> x<|endoftext|>y", "café İSTANBUL ΣΑΣ é   z", "a" * 3000, "漢字 \U0001f600 ok", "tab\tand\x0bvt\x0cff\rcr ls\x85nel", "  lead and trail  ", "The the THE the, (the) 's 't", "\x1c\x1d\x1e\x1f a\x1cb"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_pieces_join_to_the_whole(name):
    enc = encoder(public_tokenizers.path(name))
    assert enc.mode != "whole"
    whole = [list(x) for x in enc.encode(TEXTS)]
    assert [x.tolist() for x in enc.ids(TEXTS)] == whole
    assert enc.lengths(TEXTS) == [len(x) for x in whole]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZ é'st,.\n\t Éİ Σ9<|>endoftx"), max_size=40), max_size=4), st.sampled_from(["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]))
def test_pieces_property(texts, name):
    enc = encoder(public_tokenizers.path(name))
    assert [x.tolist() for x in enc.ids(texts)] == [list(x) for x in enc.encode(texts)]


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 15, 16, 17, 31, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001, dtype=np.uint64).astype("<u4")
    assert len(pack(ids, bits)) == -(-1001 * bits // 8)
    assert (unpack(pack(ids, bits), 1001, bits) == ids).all()
    shard = Shard(write_shard([3, None, 9], [1000, 0, 1], ids, bits, block=48))
    assert (shard.document(0) == ids[:1000]).all() and len(shard.document(1)) == 0 and shard.document(2).tolist() == ids[1000:].tolist()
    assert (shard.ids(333, 777) == ids[333:777]).all()


def rows(spark):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(TEXTS)] + [(3, None, None, None), (3, "b", None, 1), (3, "b", None, 1), (None, "c d", None, 1)], "doc_id long, text string, id string, n_tokens long")


def test_token_counts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    enc = encoder(path)
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(rows(spark), path, 50).collect())
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), n := len(list(enc.encode([r["text"] or ""]))[0]), n > 50) for r in rows(spark).collect())
    assert got == want
    assert token_counts(rows(spark).limit(0), path).count() == 0


def test_token_output(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    enc = encoder(path)
    got = sorted(token_output(rows(spark), path).collect(), key=lambda r: r["start"])
    at = 0
    want = []
    for r in sorted(rows(spark).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")):
        ids = [*enc.encode([r["text"] or ""])[0], 1]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert token_output(rows(spark).limit(0), path).count() == 0
