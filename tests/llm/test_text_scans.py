"""Personal data, decontamination and repeated units against brute force."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from limnos.llm import decontaminate as D
from limnos.llm import pii

LOWER = {i: i + 32 for i in range(65, 91)}
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn_ok(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute_pii(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                    "card": 14 <= len(d) <= 19 and luhn_ok(d), "phone": 10 <= len(d) <= 15}[kind]
            if fine:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


TEXTS = [None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "call +1 (988) 555-2485 now", "4111 1111 1111 1111", "x" * 50000,
         "1" * 20000, "a@" * 5000, "1 " * 20000, "my ssn 078-05-1120 ok", "078-05-1120",
         "IBAN DE89 3704 0044 0532 0130 00 bank", "IBAN DE88 3704 0044 0532 0130 00 bank", "+" + "1 " * 9000,
         "😀é a@b.cd 10.0.0.1", "a@b.co " * 3000, "a@b.co1.2.3.4", "a\u0001b@c.de\u0002", "999.1.1.1 0256.1.1.1 007.1.1.1"]


def pii_texts():
    r = random.Random(3)
    return TEXTS + ["".join(r.choice("a@.1 2+-(3)4_%b.5@é6\u0001😀7\n") for _ in range(r.randint(0, 80))) for _ in range(800)] \
        + ["".join(r.choice("0123456789 -") for _ in range(r.randint(10, 120))) for _ in range(400)]


def test_pii_spans(spark):
    texts = pii_texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    found = pii.find_spans(df).select("doc_id", pii.joined(F.filter("pii", lambda x: x["rank"] < 4)).alias("base"),
                                      pii.joined(F.col("pii")).alias("spans"), "pii").collect()
    assert len(found) == len(texts)
    for r in found:
        assert r["base"] == brute_pii(texts[r["doc_id"]])
    spans = {r["doc_id"]: r for r in found}
    assert spans[10]["spans"] == "ssn:7:18" and spans[11]["spans"] == ""
    assert spans[12]["spans"] == "iban:5:32" and spans[13]["spans"] == ""
    assert spans[12]["pii"][0]["score"] == 1.0 and spans[10]["pii"][0]["score"] == 0.5
    assert pii.find_spans(df.limit(0)).count() == 0


def test_iban_ends_at_its_country_length(spark):
    texts = {"IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX": "iban:5:32", "GB82WEST12345698765432 EUR 50": "iban:0:22",
             "DE89370400440532013000 I will": "iban:0:22", "NO93 8601 1117 947 OK": "iban:0:18",
             "DE89370400440532013000 GB82WEST12345698765432 A": "iban:0:22,iban:23:45",
             "MT84MALT011000012345MTLCAST001S X": "iban:0:31", "QX12 DE89370400440532013000 A": "iban:5:27",
             "DE89370400440532013000A": "", "DE88370400440532013000 I will": "", "DE8937040044053201300": ""}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: r["s"] for r in pii.find_spans(df).select("text", pii.joined(F.filter(
        "pii", lambda x: x["kind"] == "iban")).alias("s")).collect()}
    assert got == texts
    assert pii.redact(df).where("text = '[IBAN] I will'").count() == 1


def test_redact_keeps_columns(spark):
    df = spark.createDataFrame([(1, None, 2), (2, "", 2), (3, "é a@b.co1.2.3.4 x", 2), (4, "a@b.co " * 300, 2)],
                               "doc_id long, text string, _pii_spans int")
    out = pii.redact(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {1: None, 2: "", 3: "é [EMAIL] x", 4: "[EMAIL] " * 300}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_scan(docs, items, n=10):
    out = []
    wins = {}
    for item, text in items:
        w = words(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            wins.setdefault(tuple(w[i:i + size]), set()).add("null" if item is None else str(item))
    sizes = {len(k) for k in wins}
    for doc, text in docs:
        w, hit, got = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in wins:
                    hit |= set(range(i, i + size))
                    got |= wins[tuple(w[i:i + size])]
        out.append((doc, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination(spark):
    r = random.Random(6)
    v = [f"w{i}" for i in range(12)] + ["Éa", "B2"]
    items = [(i, " ".join(r.choice(v) for _ in range(r.randint(10, 14)))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "only three words"), (None, "Solo"), (7, items[3][1])]
    docs = [(0, None), (1, ""), (2, "a, ONLY-three\nWords b"), (3, "solo"), (4, "x " * 3000 + items[2][1]), (None, items[1][1])]
    docs += [(10 + i, " ".join(r.choice(v) for _ in range(r.randint(0, 30))) + "; "
              + (items[i % 30][1].upper() if i % 3 == 0 else "")) for i in range(60)]
    docs.append(docs[10])
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    df = spark.createDataFrame([(d, t, 9) for d, t in docs], "doc_id long, text string, n_hit int").repartition(3)
    want = brute_scan(docs, items)
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for bound in (1_000_000, 50):
        got = D.scan(df, bench, max_windows=bound).select(cols).collect()
        assert sorted((tuple(x) for x in got), key=str) == want
    kept = D.remove_documents(df, bench)
    assert kept.columns == df.columns
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == sorted(str(x[0]) for x in want if not x[-1])
    assert D.scan(df, bench.limit(0)).where("contaminated").count() == 0
    assert D.scan(df.limit(0), bench).count() == 0


def test_clean_text(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    text = "é start, One two three four five six seven eight nine TEN eleven! end"
    row = D.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench, with_text=True).first()
    assert row["clean_text"] == "é start, ! end" and text[row["spans"][0]["start"]:row["spans"][0]["end"]].startswith("One")
