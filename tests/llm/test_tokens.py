"""Piece-cached encoding, window packing and bit-plane files against the library and exact round trips."""

import io
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from limnos.llm import bitplane, packing  # noqa: E402
from limnos.llm import tokens as T  # noqa: E402

ODD = ["", " ", "  ", "a", " a ", "a  b", "a \n b", "a\n\nb  ", "don't can't I'll we've X'S 'tis ''s !'s", "x's's 'start'",
       "<|endoftext|> hi", "日本語 text", "İstanbul", "é́ é", "\x00a", "a\tb\t\tc", "1234 5 67a8", "...!! ?? a..b",
       " 'S 'LL", "\xa0x", "a'", "'", "ab'd", "w" * 5000, "word " * 3000]


def random_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice("ab 'sS\n\tÉ9.<|!lLdDrRe  ") for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name, monkeypatch):
    enc = T.TextEncoder(T.read_tokenizer(P.path(name)))
    texts = ODD + random_texts(1500)
    for chunk in (1 << 20, 400):
        monkeypatch.setattr(T, "CHUNK", chunk)
        flat, counts = enc.encode(texts)
        want = [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(x) for x in want]
        assert flat.tolist() == [i for x in want for i in x]


def test_encoder_table_stays_bounded(monkeypatch):
    monkeypatch.setattr(T, "MAX_PIECES", 50)
    enc = T.TextEncoder(T.read_tokenizer(P.path("byte_bpe_50k.json")))
    for k in range(20):
        text = " ".join(f"w{k}x{j}" for j in range(10))
        assert enc.encode([text])[0].tolist() == enc.tok.encode(text, add_special_tokens=False).ids
        assert len(enc.keys) <= 100


def test_differencing_balances():
    r = np.random.default_rng(0)
    sizes = r.integers(1, 257, 600).tolist()
    where = packing.difference_partition(sizes, 80)
    fill = np.bincount(where, weights=sizes, minlength=80)
    assert fill.sum() == sum(sizes) and fill.max() - fill.min() <= 8
    where, windows = packing.fit_windows([700, 700, 700], 1024)
    assert windows == 3 and sorted(where.tolist()) == [0, 1, 2]


def check_pieces(rows, want, capacity=1024):
    """Every id of every document in exactly one piece; sequences gapless and not over capacity."""
    got, by_seq = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] > 0
        got.setdefault(r["doc_id"], []).append((r["start"], ids.tolist(), r["doc_tokens"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["sequence_length"]))
    for doc, ids in want.items():
        parts = sorted(got.pop(doc))
        assert [i for _, p, _ in parts for i in p] == ids
        assert [s for s, _, _ in parts] == np.cumsum([0, *(len(p) for _, p, _ in parts)])[:-1].tolist()
        assert {n for *_, n in parts} == {len(ids)}
    assert not got
    for parts in by_seq.values():
        parts.sort()
        ends = np.cumsum([n for _, n, _ in parts])
        assert [o for o, *_ in parts] == (ends - [n for _, n, _ in parts]).tolist()
        assert ends[-1] <= capacity and {f for *_, f in parts} == {ends[-1]}
    return sum(len(x) for x in want.values()) / (capacity * len(by_seq))


def test_pack(spark):
    path = P.path("byte_bpe_50k.json")
    texts = [None, "", "<|endoftext|>", "long words " * 4000] + random_texts(400, 2)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)],
                               "doc_id long, text string, start int, sequence_id string").repartition(2)
    rows = packing.pack(df, path).collect()
    enc = T.TextEncoder(T.read_tokenizer(path))
    want = {i: enc.tok.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    check_pieces(rows, want)
    assert packing.pack(df.limit(0), path).count() == 0
    same = spark.createDataFrame([(None, "a b"), (7, "c"), (7, "c")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.doc_tokens) for r in packing.pack(same, path).collect()) == [
        (False, 2), (False, 2), (True, 3)]


def test_planes_round_trip():
    r = np.random.default_rng(4)
    for n in (0, 1, 7, 8, 9, 1000):
        for top in (1, 2, 50000, 2**32):
            ids = r.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            assert (bitplane.join_planes(bitplane.split_planes(ids), n) == ids).all()


def test_file_round_trip():
    import pyarrow as pa

    r = np.random.default_rng(5)
    docs = [(k if k % 3 else None, r.integers(0, 49408, int(r.integers(0, 400))).astype(np.uint32)) for k in range(50)]
    out = io.BytesIO()
    writer = bitplane.PlaneWriter(out, block=64)
    for d, ids in docs:
        writer.add(d, ids)
    assert writer.close() == sum(len(x) for _, x in docs)
    reader = bitplane.PlaneReader(pa.BufferReader(out.getvalue()))
    assert reader.doc_ids == [d for d, _ in docs]
    for k in (49, 0, 20, 21, 3):
        assert (reader.ids(k) == docs[k][1]).all()
    with pytest.raises(ValueError):
        bitplane.PlaneReader(pa.BufferReader(b"x" * 100))


def test_token_files(spark, tmp_path):
    path = P.path("word_bpe_49k.json")
    texts = [None, "", "Again again", "Again again"] + random_texts(200, 3)
    rows = [(3 * i, t, 5) for i, t in enumerate(texts)] + [(6, "twice", 5), (6, "twice", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    manifest = bitplane.write_tokens(df, path, folder=f"file://{tmp_path}/tok", block=128)
    got = sorted(bitplane.read_tokens(spark, manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(r[0] for r in rows)
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    enc = T.TextEncoder(T.read_tokenizer(path))
    crc = sorted((d, zlib.crc32(np.array(enc.tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()))
                 for d, t, _ in rows)
    assert sorted((r["doc_id"], zlib.crc32(bytes(r["ids"]))) for r in got) == crc
    none = bitplane.write_tokens(df.limit(0), path, folder=f"file://{tmp_path}/none")
    assert bitplane.read_tokens(spark, none).count() == 0


def test_freed_memory_of_a_worker_goes_back():
    import ctypes
    import os

    import pytest
    from limnos.llm.runtime import release_memory

    if not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("not glibc")

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    held = [bytes(4000) for _ in range(25_000)]
    last = held[::5000]          # what is still in use keeps the memory around it with the process
    last.append(bytes(4000))
    held.clear()
    before = resident()
    release_memory()
    assert len(last) == 6 and before - resident() > 40_000_000
