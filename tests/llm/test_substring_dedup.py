"""Repeated passages against a brute force over the same units; cutting; odd rows."""

import random
import re

import pytest

from limnos.llm import substring_dedup as S

LOWER = {i: i + 32 for i in range(65, 91)}


def units(text, kind):
    """(start, end, words) of each unit, places in code points."""
    out, cur, before = [], [], None
    for m in re.finditer(r"[^\x20\x09-\x0d]+", text or ""):
        feeds = 0 if before is None else (text or "")[before:m.start()].count("\n")
        if cur and (feeds > 1 or (kind != "paragraph" and feeds)):
            out.append(cur)
            cur = []
        cur.append(m)
        before = m.end()
        if kind == "sentence" and m.group()[-1] in ".!?":
            out.append(cur)
            cur = []
    if cur:
        out.append(cur)
    return [(u[0].start(), u[-1].end(), tuple(m.group().translate(LOWER) for m in u)) for u in out]


def brute(rows, kind, least):
    """{(doc_id, start, end, kept id, kept start)} of distinct rows, in order of doc_id (NULL first)."""
    first, out = {}, set()
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        us = units(t, kind)
        for a in range(len(us)):
            b, words, size = a - 1, 0, 0
            while b + 1 < len(us) and words < least and size < S.BYTES_PER_WORD * least:
                b += 1
                words += len(us[b][2])
                size += sum(len(w.encode()) for w in us[b][2])
            if words < least and size < S.BYTES_PER_WORD * least:
                break
            key = tuple(u[2] for u in us[a:b + 1])
            behind = [u[2] for u in us[b + 1:b + 1 + (S.TAIL if least > 1 else 0)]]
            if key not in first:
                first[key] = d, us[a][0], behind
                continue
            more = 0
            for x, y in zip(behind, first[key][2]):
                if x != y:
                    break
                more += 1
            out.add((d, us[a][0], us[b + more][1], *first[key][:2]))
    return out


def corpus(seed=8):
    r = random.Random(seed)
    words = "ab cé Da fe gi 日本語 x".split()
    sentences = [" ".join(r.choice(words) for _ in range(r.randint(1, 9))) + r.choice([".", "!", "\n", "?\n\n"])
                 for _ in range(30)]
    runs = [" ".join(r.choices(sentences, k=r.randint(3, 8))) for _ in range(12)]
    docs = [(i, "".join(r.choice(sentences + runs) + r.choice([" ", "\n", "  ", "\n\n"]) for _ in range(r.randint(0, 6))))
            for i in range(90)]
    docs += [(500, None), (501, ""), (502, "a b c d e f.\nA B  c d e f."), (503, "same " * 20000), (504, "same " * 20000),
             (505, "漢" * 400 + "\n" + "字" * 300), (506, "漢" * 400 + "\n" + "字" * 300), (None, runs[0]), (12, "another text of 12.")]
    return docs + [docs[3], docs[40]]


@pytest.mark.parametrize("kind,least", [("sentence", 15), ("sentence", 4), ("line", 1), ("paragraph", 6)])
def test_equals_brute_force(spark, monkeypatch, kind, least):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, start int, hash string").repartition(3)
    want = brute(rows, kind, least)
    assert len(want) > 20
    for hot in (S.HOT, 1):              # the second sets repeated rows of a batch aside
        monkeypatch.setattr(S, "HOT", hot)
        found = S.repeated_units(df, kind, least).collect()
        assert {(x.doc_id, x.start, x.end, x.kept_doc_id, x.kept_start) for x in found} == want


def test_short_units_go_with_their_passage_only(spark):
    passage = "One fine sentence of this passage is here. Ha. And then another one follows it in full. The end."
    rows = [(1, passage), (2, "Start of text. " + passage + " More of it."), (3, "Ha. Nothing else. The end."), (4, "Ha.\nThe end.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = S.repeated_units(df, "sentence", 15)
    assert {x.doc_id for x in found.collect()} == {2}
    clean = {x.doc_id: x.text for x in S.remove_spans(df, found).collect()}
    assert clean == {1: passage, 2: "Start of text.  More of it.", 3: rows[2][1], 4: rows[3][1]}


def test_removal_keeps_columns_rows_and_other_rows_of_an_id(spark):
    same = " ".join(f"w{k}" for k in range(20)) + "."
    rows = [(None, same), (7, "Ä " + same), (7, "quite another text that shares nothing but the id of its row"), (8, None), (9, ""),
            (7, "Ä " + same)]
    df = spark.createDataFrame([(d, t, k, "x", 2) for k, (d, t) in enumerate(rows)],
                               "doc_id long, text string, n int, _cuts string, text_hash int").repartition(2)
    found = S.repeated_units(df, "line", 1).unionByName(S.repeated_units(df, "sentence", 15))
    out = S.remove_spans(df, S.repeated_units(df, "sentence", 3))
    assert out.columns == df.columns
    assert {x.n: x.text for x in out.collect()} == {0: same, 1: rows[1][1], 2: rows[2][1], 3: None, 4: "", 5: rows[1][1]}
    assert found.where("doc_id = 7").count() == 0
    assert S.repeated_units(df.limit(0)).count() == 0
    overlap = spark.createDataFrame([(7, 0, 4), (7, 2, 9), (7, 12, 13)], "doc_id long, start long, end long").selectExpr(
        "doc_id", f"xxhash64('{rows[2][1]}') as text_hash", "start", "end")
    cut = {x.n: x.text for x in S.remove_spans(df, overlap).collect()}
    assert cut[2] == rows[2][1][9:12] + rows[2][1][13:] and cut[1] == rows[1][1]
