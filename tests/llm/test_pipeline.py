"""The corpus pipeline against its stages in plain Python, and the registered queries."""

import re

import pytest

pytest.importorskip("public_tokenizers")

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402

from test_groups import brute_components  # noqa: E402
from test_text_scans import BASE, brute_pii, brute_scan  # noqa: E402
from test_tokens import check_pieces  # noqa: E402


def test_registered():
    names = list(entry.queries())
    assert sorted(n.split("_")[0] for n in names if re.match(r"op\d+_", n)) == sorted(f"op{n}" for n in range(1, 14))
    assert "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "benchmark_decontamination",
                                                      "personal_data", "packing"]


def masked(text):
    spans = sorted((int(a), -rank, int(b), k) for rank, k in enumerate(reversed(list(BASE)))
                   for kind, a, b in (x.split(":") for x in brute_pii(text).split(",") if x) if kind == k)
    out, at = "", 0
    for a, _, b, kind in spans:
        if a >= at:
            out += text[at:a] + f"[{kind.upper()}]"
            at = b
    return out + text[at:]


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    def stage(name, df):
        stages[name](spark, df, sf).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    clean = stage("toxicity", docs)
    assert clean.columns == columns and clean.exceptAll(docs).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in clean.select("doc_id", "text").collect()]
    one = stage("ngram_jaccard", clean)
    assert one.columns == columns
    kept = {d for d, _, c in brute_components(rows) if d == c}
    assert {r["doc_id"] for r in one.collect()} == kept
    rows = [x for x in rows if x[0] in kept]
    away = stage("benchmark_decontamination", one)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {x[0] for x in brute_scan(rows, items) if x[-1]}
    assert away.columns == columns and {r["doc_id"] for r in away.collect()} == kept - hit
    hidden = stage("personal_data", away)
    assert hidden.columns == columns
    for r in hidden.collect():
        text = masked(dict(rows)[r["doc_id"]])
        assert r["text"] == text and r["n_chars"] == len(text)
    packed = stage("packing", hidden)
    from limnos.llm import tokens

    enc = tokens.TextEncoder(tokens.read_tokenizer(corpus_pipeline.vocabulary("byte_bpe_50k.json")))
    want = {r["doc_id"]: enc.tok.encode(r["text"], add_special_tokens=False).ids + [0] for r in hidden.collect()}
    check_pieces(packed.collect(), want)
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


def test_pipeline_on_odd_rows(spark, tmp_path):
    """NULL ids and texts, empty and very long texts, repeated rows, shared ids, empty tables, clashing extra columns."""
    r = __import__("random").Random(3)

    def prose(n):
        return " ".join(f"w{r.randrange(5000)}" for _ in range(n))

    long, copy = prose(60_000), prose(80)
    item = prose(30)
    rows = [(None, None), (None, None), (1, ""), (2, long), (3, copy), (3, copy), (4, copy + " end"), (None, copy), (5, prose(40)),
            (5, prose(50)), (6, prose(20) + " " + item + " tail"), (7, "mail me at a.b@example.org now " + prose(30))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id int, pii string, _row int, label int"
    docs = [(d, t, "en", "s", None if t is None else len(t), 1, "own", k, 2) for k, (d, t) in enumerate(rows)]

    def write(name, docs, items, labels):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        return folder

    folder = write("odd", docs, [(1, item), (2, None), (3, "")], [(5, 1, 0), (None, 1, 1), (7, 1, None)])
    frames, df = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, folder)
        if name != "packing":
            assert out.columns == df.columns
        out.write.parquet(f"{folder}/{name}")
        df = frames[name] = spark.read.parquet(f"{folder}/{name}")
    assert frames["toxicity"].count() == len(rows)
    kept = [(x.doc_id, x.text) for x in frames["ngram_jaccard"].collect()]
    assert len(kept) == 9 and kept.count((3, copy)) == 1 and kept.count((None, None)) == 2 and (5, rows[9][1]) in kept
    assert (4, copy + " end") not in kept and (None, copy) not in kept
    assert {x.doc_id for x in frames["benchmark_decontamination"].collect()} == {None, 1, 2, 3, 5, 7}
    hidden = {x._row: x for x in frames["personal_data"].collect()}
    assert "[EMAIL]" in hidden[11].text and hidden[11].pii == "own" and hidden[0].text is None and hidden[2].text == ""
    packed = frames["packing"]
    assert {x.doc_id for x in packed.select("doc_id").distinct().collect()} == {None, 1, 2, 3, 5, 7}
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
    empty = write("empty", [], [], [])
    assert corpus_pipeline.run(spark, empty).count() == 0
