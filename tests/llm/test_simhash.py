"""SimHash against a plain-Python vote, edited texts and near classes against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from limnos.llm import simhash as S
from limnos.llm.textops import LOWER, byte_hashes, splitmix


def word_hash(word: str) -> int:
    data = LOWER[np.frombuffer(word.encode(), np.uint8)]
    return int(byte_hashes(data, np.array([0]), np.array([len(data)]))[0])


def plain_print(text: str) -> str:
    lowered = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
    words = Counter(w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w)
    out = b""
    for salt in S._SALTS:
        votes = [0] * 64
        for w, n in words.items():
            bits = int(splitmix(np.array([word_hash(w)], np.uint64) ^ salt)[0])
            weight = round(8 * math.log2(1 + n)) * min(len(w.encode()), 8)
            raw = np.unpackbits(np.array([bits], np.uint64).view(np.uint8))
            votes = [v + weight * (1 if b else -1) for v, b in zip(votes, raw, strict=True)]
        out += np.packbits(np.array(votes) > 0).tobytes()
    return out.hex()


def gap(a: str, b: str) -> int:
    return (int(a, 16) ^ int(b, 16)).bit_count()


def test_fingerprints_are_weighted_votes():
    r = random.Random(1)
    vocabulary = ["the", "a", "É", "Ünder", *("w" * k + str(k) for k in range(30))]
    texts = [None, "", " \n", "one", "THE the tHe end", *(" ".join(r.choices(vocabulary, k=r.randint(1, 60)))
                                                        for _ in range(60))]
    got = S.hexes(S.signatures(pa.array(texts)))
    assert got == [plain_print(t) for t in texts]
    assert got[0] == got[1] == got[2] == "0" * 32


def test_text_without_spaces_follows_its_characters():
    r = random.Random(2)
    a = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(2000))
    b, c = a[:1900] + a[:100], "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(2000))
    x, y, z = S.hexes(S.signatures(pa.array([a, b, c])))
    assert gap(x, y) < 25 < gap(x, z)


def brute_edits(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, text) in enumerate(rows):
        text, behind = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text)
        edited = text[:n - n // 2] + behind[:n // 2]
        f, g, h = map(plain_print, (text, edited, behind))
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), f, g, round(1 - gap(f, g) / 128, 9),
                    round(1 - gap(f, h) / 128, 9)))
    return sorted(out, key=str)


def test_edits_follow_the_order_of_ids(spark):
    r = random.Random(3)
    rows = [(i * 7 - 100, " ".join(r.choices(["Ärger", "cat", "dog", "x", "日本"], k=r.randint(0, 30)))) for i in range(90)]
    rows += [(1000, None), (1001, ""), (1002, "z"), (None, "last one here"), (2 ** 62, "b " * 4000)]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, at string").repartition(5)
    for buckets in (1, 3, 64):
        got = S.edit_likeness(df, buckets=buckets).collect()
        assert sorted(((x.doc_id, x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint,
                        round(x.near_edited, 9), round(x.near_next, 9)) for x in got), key=str) == brute_edits(rows)
    alone = S.edit_likeness(df.where("doc_id = 1002")).collect()
    assert [(x.n_chars, x.near_next) for x in alone] == [(1, 1.0)]
    assert S.edit_likeness(df.limit(0)).count() == 0


def test_hot_and_null_ids_keep_every_row(spark):
    rows = [(5, f"t{k % 40} word") for k in range(300)] + [(None, f"n{k} word") for k in range(100)] + [(k, "q") for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.edit_likeness(df, buckets=16).collect()
    assert Counter((x.doc_id, x.n_chars) for x in got) == Counter((i, len(t)) for i, t in rows)
    placed = S._place(df, 16).select("doc_id", "_bucket").distinct().collect()
    assert len({x._bucket for x in placed if x.doc_id == 5}) > 3 and len({x._bucket for x in placed if x.doc_id is None}) > 2


def brute_classes(prints, radius):
    values = sorted({f for _, f in prints})
    label = {f: f for f in values}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for a in values:
        for b in values:
            if a < b and gap(a, b) <= radius:
                label[find(a)] = find(b)
    least = {}
    for i, f in prints:
        least.setdefault(find(f), []).append(i)
    return sorted(((i, min((x for x in least[find(f)] if x is not None), default=None)) for i, f in prints), key=str)


def test_classes_equal_all_pairs(spark):
    r = random.Random(4)
    prints = []
    for _ in range(12):
        center = r.getrandbits(128)
        for _ in range(r.randint(1, 14)):
            x = center
            for bit in r.sample(range(128), r.randint(0, 6)):
                x ^= 1 << bit
            prints.append(x)
    prints = [(k if k % 11 else None, f"{x:032x}") for k, x in enumerate(prints)] + [(500 + k, "0" * 32) for k in range(30)]
    df = spark.createDataFrame([(*x, 1) for x in prints], "doc_id long, fingerprint string, id int")
    for radius in (3, 5):
        for bucket in (S.BUCKET, 3):
            found = {x.fingerprint: x.near_id for x in S.near_classes(df, radius, bucket).collect()}
            assert sorted(((i, found[f]) for i, f in prints), key=str) == brute_classes(prints, radius)
    assert S.near_classes(df.limit(0)).count() == 0


def test_near_documents(spark):
    r = random.Random(5)
    base = " ".join(f"word{r.randrange(10**6)}" for _ in range(400))
    rows = [(3, base), (9, base), (7, base + " more"), (1, " ".join(f"word{r.randrange(10**6)}" for _ in range(400))), (2, None)]
    got = S.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.near_id for x in got} == {3: 3, 9: 3, 7: 3, 1: 1, 2: 2}
