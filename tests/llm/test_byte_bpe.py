import hashlib

import public_tokenizers
import tiktoken

from maskloom.llm import byte_bpe
from maskloom.llm.queries import op9_byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def reference():
    import base64
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_offsets_and_round_trip(spark):
    texts = [None, "", " ", "a\n\n b  c\t", "don't we'll  <|endoftext|>", "日本語 👩‍👩‍👧 café", "x" * 5000, "a b " * 3000,
             "١٢٣ \u0085  ñandú", "\x00\x01", "same", "same"]
    df = spark.createDataFrame([(i % 11, t, "clash", 1) for i, t in enumerate(texts)],
                               "region_id long, original_text string, token_ids string, decoded int")
    ranks = byte_bpe.read_ranks(PATH)
    got = byte_bpe.decode_tokens(byte_bpe.encode_texts(df, ranks, public_tokenizers.PATTERN, offsets=True), ranks).collect()
    enc = reference()
    want = sorted((i % 11, enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts))
    assert sorted((r.region_id, r.token_ids, bytes(r.decoded)) for r in got) == want
    for r in got:
        text = bytes(r.decoded).decode()
        for i, a, b in zip(r.token_ids, r.starts, r.ends):
            assert enc.decode_single_token_bytes(i) in text[a:b].encode()
        assert not text or (r.starts[0] == 0 and r.ends[-1] == len(text))


def test_no_rows(spark):
    df = spark.createDataFrame([], "region_id long, original_text string")
    ranks = byte_bpe.read_ranks(PATH)
    assert byte_bpe.decode_tokens(byte_bpe.encode_texts(df, ranks, public_tokenizers.PATTERN), ranks).count() == 0


def test_query_against_the_rank_library(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op9_byte_bpe(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    enc = reference()

    def digest(b):
        return hashlib.sha256(b).hexdigest()

    assert len(got) == len(rows)
    for r in rows:
        ids = enc.encode_ordinary(r.text or "")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (
            len(ids), digest(" ".join(map(str, ids)).encode()), digest((r.text or "").encode()))


def test_decoded_by_the_workers_that_encode(spark):
    """One step in Python, so that the workers of a task are not doubled; the bytes are those of ``decode_tokens``."""
    texts = ["", None, "naïve café 🙂 \x00 end", "a" * 300, "<|endoftext|> ́x"]
    df = spark.createDataFrame(list(enumerate(texts)), "region_id long, original_text string")
    ranks = byte_bpe.read_ranks(PATH)
    got = byte_bpe.encode_texts(df, ranks, public_tokenizers.PATTERN, offsets=True, decoded=True)
    apart = byte_bpe.decode_tokens(byte_bpe.encode_texts(df, ranks, public_tokenizers.PATTERN, offsets=True), ranks)
    assert got.schema == apart.schema and sorted(got.collect()) == sorted(apart.collect())
    assert {r.region_id: bytes(r.decoded).decode() for r in got.collect()} == {i: t or "" for i, t in enumerate(texts)}
