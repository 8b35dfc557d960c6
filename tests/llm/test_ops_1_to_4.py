"""Operators 1 to 4 against plain Python."""

import base64
import hashlib
import json
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from glosswork.llm import byte_bpe, media_columns, secret_scans, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, digest string"
TEXTS = [None, "", " ", "a", "Plain words, twice. Plain words, twice.", "é" * 97, "x" * 192, "tab\there\n\n  two  spaces \n end ", "日本語 テキスト and 한국어", "it's we'll I'd  they're", "\x1c\x1d x\x85y z   w", "Plain words, twice. Plain words, twice.", "word " * 30000, "ab" * 40000, "İstanbul Σίσυφος ΟΔΟΣ fiﬁ é", "<|endoftext|> 12345 3.14"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("docs")
    rows = [(i * 3 + 1, t, "en", "s", None if t is None else len(t), "k", "d") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{where}/documents.parquet")
    return str(where)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{where}/documents.parquet")
    return str(where)


def by_id(df):
    rows = [r.asDict() for r in df.collect()]
    assert len(rows) == len(TEXTS) == len({r["doc_id"] for r in rows})
    return [(TEXTS[(r["doc_id"] - 1) // 3] or "", r) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_empty_tables(spark, empty):
    for f in (media_columns.op1_media_columns, secret_scans.op2_secret_scans, byte_bpe.op3_byte_bpe, token_files.op4_token_files):
        assert f(spark, empty).collect() == []


def test_media(spark, folder):
    seen = {}
    for text, r in by_id(media_columns.op1_media_columns(spark, folder)):
        raw = text.encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        media = f"P6\n64 {len(payload) // 192}\n255\n".encode() + payload
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())
        assert r["caption"] == f"text of {len(raw)} bytes"
        assert seen.setdefault(text, r["feature"]) == r["feature"]


def test_sequence_order_and_captions(spark):
    html = '<head><title>t</title></head><p>one</p><figure><img src="media:sha256:aa" alt="x"><figcaption>cap</figcaption></figure><script>no</script>two<img src="media:sha256:bb" alt="y"/> three<img src="http://z/q.png">'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>only")], "page_id long, html string")
    store = spark.createDataFrame([("aa", b"1"), ("bb", b"2"), ("bb", b"2")], "digest string, payload binary")
    sequences = media_columns.interleave(pages, "page_id")
    assert {r.page_id: len(r.sequence) for r in sequences.collect()} == {1: 6, 2: 0, 3: 1}
    rows = sorted((r.asDict() for r in media_columns.resolve(sequences, "page_id", store).collect()), key=lambda r: (r["page_id"], r["position"]))
    assert [(r["kind"], r["text"], r["caption"], r["payload"] and bytes(r["payload"])) for r in rows] == [("text", "one", None, None), ("media", None, "cap", b"1"), ("text", "two", None, None), ("media", None, "y", b"2"), ("text", "three", None, None), ("media", "http://z/q.png", None, None), ("text", "only", None, None)]


def test_open_elements():
    seen = lambda html: [(x["kind"], x["text"] or x["digest"], x["caption"]) for x in media_columns.sequence_of(html)]
    img = '<img src="media:sha256:aa">'
    assert seen(f"<html><head><title>t</title><meta x><p>one</p>{img}") == [("text", "one", None), ("media", "aa", None)]
    assert seen(f"<head><title>t</title></head><body>one") == [("text", "one", None)]
    assert seen(f"<figure>{img}<figcaption>cap<p>two</p>three") == [("media", "aa", "cap"), ("text", "two", None), ("text", "three", None)]
    assert seen(f"<figure>{img}<figcaption>cap</figure>after") == [("media", "aa", "cap"), ("text", "after", None)]
    assert seen("<figure><figcaption>only words</figcaption></figure>x") == [("text", "only words", None), ("text", "x", None)]
    assert seen(f"<noscript>one {img}<p>two") == [("text", "one", None), ("media", "aa", None), ("text", "two", None)]
    assert seen("a<noscript>one</noscript>b<template>two</template>c") == [("text", "abc", None)]
    assert seen(f"<figure><figcaption><p>in</p>side</figcaption>{img}</figure>") == [("text", "inside", None), ("media", "aa", None)]


def test_store_with_clashing_names(spark):
    pages = spark.createDataFrame([(1, '<p>one</p><img src="media:sha256:aa" alt="cap">')], "page_id long, html string")
    store = spark.createDataFrame([("aa", "t", "c", "k", b"1")], "digest string, text string, caption string, kind string, payload binary")
    rows = media_columns.resolve(media_columns.interleave(pages, "page_id"), "page_id", store).orderBy("position").collect()
    assert [(r.kind, r.text, r.caption, r.payload and bytes(r.payload)) for r in rows] == [("text", "one", None, None), ("media", None, "cap", b"1")]


def rsa_like():
    def tlv(tag, body):
        n = len(body)
        size = bytes([n]) if n < 128 else (lambda b: bytes([0x80 | len(b)]) + b)(n.to_bytes((n.bit_length() + 7) // 8, "big"))
        return bytes([tag]) + size + body

    rng = random.Random(1)
    return tlv(0x30, b"".join(tlv(2, bytes([1]) + rng.randbytes(k)) for k in (0, 128, 2, 128, 64, 64, 64, 64, 64)))


def test_secrets(spark):
    der, ssh = rsa_like(), struct.pack(">I", 7) + b"ssh-rsa" + struct.pack(">I", 3) + b"\1\0\1" + struct.pack(">I", 64) + bytes(range(64))
    url = lambda x: base64.urlsafe_b64encode(x).rstrip(b"=").decode()
    token = f"{url(json.dumps({'alg': 'HS256'}).encode())}.{url(b'{}')}.{url(b'0' * 32)}"
    armour = "-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(der).decode() + "-----END RSA PRIVATE KEY-----"
    texts = [f"é {base64.b64encode(der).decode()} end", der.hex(), f"x {base64.b64encode(ssh).decode()}", f"Bearer {token}", armour, "A" * 80, "0123456789abcdef" * 4, "a.b." + "c" * 50, f"ey{'J' * 30}.aa.bb", "Password = 'abcdefghijkl' api_key:short secret: token=abcdefghijklmnop AKIA" + "Z" * 14 + " AKIA123", None, ""]
    rows = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in secret_scans.scan_secrets(rows).collect()}
    assert "der:2:" in got[0].spans and "der:0:" in got[1].spans and "ssh:2:" in got[2].spans and f"token:7:{7 + len(token)}" in got[3].spans and f"armour:0:{len(armour)}" in got[4].spans
    assert [got[i].n_confirmed for i in (5, 6, 7, 8, 10, 11)] == [0] * 6
    for i, t in enumerate(texts):
        t = t or ""
        assign = [m.span() for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 12]
        access = [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        hexes = [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        want = sorted((s, k, e) for k, found in enumerate((assign, access, hexes)) for s, e in found)
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in want)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex, got[i].base_sha256) == (len(assign), len(access), len(hexes), hashlib.sha256(text.encode()).hexdigest())


def test_keys_in_wrapped_and_joined_runs():
    der = rsa_like()
    body = base64.b64encode(der).decode()
    tlv = lambda tag, b: bytes([tag]) + (bytes([len(b)]) if len(b) < 128 else b"\x82" + len(b).to_bytes(2, "big")) + b
    locked = base64.b64encode(tlv(0x30, tlv(0x30, tlv(6, b"\x2a\x86\x48")) + tlv(4, bytes(300)))).decode()
    lines = [body[i:i + 64] for i in range(0, len(body), 64)]
    ssh = base64.b64encode(struct.pack(">I", 7) + b"ssh-rsa" + struct.pack(">I", 3) + b"\1\0\1" + struct.pack(">I", 64) + bytes(range(64))).decode()
    kinds = lambda t: [s[0] for s in secret_scans.spans_of(t) if s[0] in ("der", "ssh", "armour")]
    for text in ("\n".join(lines), "\r\n".join(lines), '"-----BEGIN PRIVATE KEY-----' + "".join("\\n" + x for x in lines) + '\\n-----END PRIVATE KEY-----"', locked, *(c + body for c in ("/", "-", "_", "ab_"))):
        assert kinds(text) == ["der"], text[:50]
    assert kinds("/" + ssh) == ["ssh"] and kinds("\n".join(["x" * 64] * 9)) == kinds("M" + "A" * 500) == []


def reference_encoding():
    ranks = byte_bpe.load_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_against_library(spark, folder):
    known = reference_encoding()
    for text, r in by_id(byte_bpe.op3_byte_bpe(spark, folder)):
        ids = known.encode_ordinary(text)
        assert r["n_tokens"] == len(ids), text[:40]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_on_odd_characters():
    known, memo = reference_encoding(), byte_bpe.Memo(byte_bpe.ByteBPE(byte_bpe.load_ranks(public_tokenizers.path(byte_bpe.VOCABULARY)), public_tokenizers.PATTERN))
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab 's \n\t\r\x0b\x1c\x85  　é1٣二Ⅷ!?\U0001f600́") for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += [f"a{chr(c)}b {chr(c)} " for c in [*range(0xD800), *range(0xE000, 0x3400)]]
    for text in texts:
        (ids, raw), = memo.encode_many([text])
        assert ids == ",".join(map(str, known.encode_ordinary(text))), ascii(text)
        assert memo.bpe.decode(np.frombuffer(raw, "<i4")) == text.encode()


def test_bpe_merges_one_at_a_time_where_ranks_do_not_rise():
    bpe = byte_bpe.ByteBPE({bytes([i]): i for i in range(256)} | {b"ab": 257, b"abab": 256, b"ba": 258}, r"[\s\S]+")
    assert not bpe.pairs.rising[257] and bpe.pairs.rising[258]
    known = tiktoken.Encoding("t", pat_str=r"[\s\S]+", mergeable_ranks=bpe.ranks, special_tokens={})
    for text in ("ababab", "aab", "bababab", "abababababab"):
        assert bpe.encode(text) == known.encode_ordinary(text)


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 16, 17, 24, 31, 32])
def test_packing(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 2**bits, n, dtype=np.uint64)
        data = token_files.pack(ids, bits)
        assert len(data) == -(-n * bits // 8)
        for a, b in ((0, n), (n // 3, n // 2), (n, n)):
            assert (token_files.unpack(data, bits, a, b) == ids[a:b]).all()


def test_token_files(spark, folder, monkeypatch):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    for text, r in by_id(token_files.op4_token_files(spark, folder)):
        ids = t.encode(text, add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text[:40]
        start += len(ids)


def test_token_stretches_match_whole_texts():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoder, rng = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json")), random.Random(5)
    texts = ["".join(rng.choice("ab 's \n\t\r\x0b\x1c\x85  é1٣二ΣσΟ!?\U0001f600́İ") for _ in range(rng.randrange(60))) for _ in range(400)]
    for text, got in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, ascii(text)


def test_random_access(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    token_files.write_tokens(docs, str(tmp_path / "t"))
    encoder = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for row in spark.read.parquet(str(tmp_path / "t")).collect():
        for k, doc_id in enumerate(row.doc_ids):
            want = encoder.encode([TEXTS[(doc_id - 1) // 3] or ""])[0]
            assert token_files.document_ids(row.asDict(), k).astype("<u4").tobytes() == want + b"\1\0\0\0"


def test_decoding_from_ids_alone():
    bpe = byte_bpe.ByteBPE(byte_bpe.load_ranks(public_tokenizers.path(byte_bpe.VOCABULARY)), public_tokenizers.PATTERN)
    ids = [np.random.default_rng(i).integers(0, len(bpe.tokens), n) for i, n in enumerate((0, 5, 0, 900, 1))]
    want = [b"".join(bpe.tokens[i] for i in x) for x in ids]
    assert bpe.decode_many(np.concatenate(ids), [len(x) for x in ids]) == want and bpe.decode(np.empty(0, np.int64)) == b""


def test_another_pattern_takes_texts_whole():
    ranks = byte_bpe.load_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    pattern = r"\S+\s+\S+|\s+|\S+"
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    memo = byte_bpe.loaded(public_tokenizers.path(byte_bpe.VOCABULARY), pattern)
    for text in ("some words stand here", "", " two  spaces"):
        assert memo.encode_many([text])[0][0] == ",".join(map(str, known.encode_ordinary(text)))


def test_a_long_match_without_a_break():
    rng, known = random.Random(8), reference_encoding()
    bpe = byte_bpe.ByteBPE(byte_bpe.load_ranks(public_tokenizers.path(byte_bpe.VOCABULARY)), public_tokenizers.PATTERN)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
    assert bpe.encode(text) == known.encode_ordinary(text)


def test_end_id_that_does_not_fit(spark, folder, tmp_path):
    with pytest.raises(Exception, match="end id"):
        token_files.write_tokens(spark.read.parquet(f"{folder}/documents.parquet"), str(tmp_path / "t"), end_id=1 << 20)


def test_rows_without_an_id_come_first(spark, tmp_path):
    rows = [(None, f"text {i:03d}") for i in range(60)] + [(1, "one"), (1, "another"), (0, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.start, r.doc_id, r.n_tokens) for r in token_files.op4_token_files(spark, str(tmp_path)).collect()))
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [x for _, x in rows[:60]] + ["", "another", "one"]
    assert [n for _, _, n in got] == [len(t.encode(x, add_special_tokens=False).ids) + 1 for x in texts]
    assert [d for _, d, _ in got] == [None] * 60 + [0, 1, 1]
