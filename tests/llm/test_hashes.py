"""Hashes of spans: words that a polynomial modulo 2**64 confuses, places, lengths and collisions in the piece table."""

import numpy as np
import pyarrow as pa
import pytest

from limnos.llm import jaccard, substring_dedup
from limnos.llm import textops as T

SWAP = str.maketrans("ab", "ba")


def thue_morse():
    word = "a"
    for _ in range(10):
        word += word.translate(SWAP)
    return word, word.translate(SWAP)


def test_equal_spans_hash_alike_and_others_do_not():
    r = np.random.default_rng(0)
    words = [bytes(r.integers(97, 99, n).astype(np.uint8)) for n in [*range(1, 40), 511, 512, 513, 520, 4000] for _ in range(30)]
    words += [b"a" * n for n in range(1, 1200, 7)] + [b"a\x00", b"a", b"a\x00\x00"]
    data = np.frombuffer(b"-".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    ends = np.cumsum(size + 1) - 1
    for h in (T.byte_hashes(data, ends - size, ends), T.span_hashes(data.astype(np.uint64) + np.uint64(1), ends - size, ends)):
        named = {}
        for w, x in zip(words, h.tolist(), strict=True):
            assert named.setdefault(w, x) == x
        assert len(set(named.values())) == len(named)
    alone = [T.byte_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] for w in words[:50]]
    assert alone == T.byte_hashes(data, ends - size, ends)[:50].tolist()


def test_thue_morse_words_differ_everywhere(spark):
    a, b = thue_morse()
    x, y = (s for _, s in jaccard.shingle_sets(pa.array([a, b])))
    assert x.tolist() != y.tolist() and jaccard.set_id(x) != jaccard.set_id(y)
    df = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    spans = substring_dedup.repeated_units(df, "line", 1).collect()
    assert [(r.doc_id, r.kept_doc_id) for r in spans] == [(3, 1)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_thue_morse_pieces_and_foreign_pieces_in_the_table(name):
    P = pytest.importorskip("public_tokenizers")
    from limnos.llm import tokens

    a, b = thue_morse()
    enc = tokens.TextEncoder(tokens.read_tokenizer(P.path(name)))

    def right(texts):
        flat, counts = enc.encode(texts)
        want = [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
        return counts.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]
    assert right([a, b]) and right([b, a]) and right(["some words here", "other words"])
    enc.piece[:] = "another piece"      # as if every key had collided
    assert right(["some words here", "new ones", a, ""])


def test_table_of_pieces_grows_at_its_ends(monkeypatch):
    """Work on new pieces follows their number, not that of all pieces held: the places of held ones never move."""
    from limnos.llm import tokens
    from limnos.llm.queries import vocabulary

    enc = tokens.TextEncoder(tokens.read_tokenizer(vocabulary("byte_bpe_50k.json")))
    words = [f"w{k * 7919 % 99991} {'é' if k % 3 else 'b'}{k}x" for k in range(6000)]
    texts = [" ".join(words[k:k + 300]) for k in range(0, 6000, 300)]
    enc.encode(texts[:10])
    held = enc.piece[:len(enc.keys)].tolist()
    ids, counts = enc.encode(texts)
    assert enc.piece[:len(held)].tolist() == held and len(enc.keys) > len(held)
    whole = enc._plain(texts)
    assert counts.tolist() == [len(x) for x in whole] and ids.tolist() == [i for x in whole for i in x.tolist()]
    monkeypatch.setattr(tokens, "MAX_PIECES", 500)      # the table starts anew again and again
    ids, _ = enc.encode(texts)
    assert ids.tolist() == [i for x in whole for i in x.tolist()]
