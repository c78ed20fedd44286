"""Sharding and the Jaccard join against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np

from limnos.llm import components, jaccard, sharding

LOWER = {i: i + 32 for i in range(65, 91)}


def smallest(texts, shards):
    sizes = collections.Counter()
    for t in texts:
        sizes["" if t is None else hashlib.md5(t.encode()).hexdigest()] += len((t or "").encode()) + 8
    order = [sizes[k] for k in sorted(sizes)]

    def needed(cap):
        n, cur = 1, 0
        for s in order:
            if cur + s > cap:
                n, cur = n + 1, 0
            cur += s
        return n

    lo, hi = max(order), sum(order)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if needed(mid) <= shards else (mid + 1, hi)
    return lo


def test_shards(spark):
    r = random.Random(2)
    for n, hot, grid in ((300, 0, 16), (400, 200, 32), (5, 0, 8)):
        texts = [None, None, "", "", "é"] + ["x" * r.randint(0, 200) + str(i) for i in range(n)] + ["hot text"] * hot
        df = spark.createDataFrame([(i % 50 if i % 7 else None, t, "s") for i, t in enumerate(texts)],
                                   "doc_id long, text string, shard string")
        rows = sharding.shard_by_bytes(df, 24, grid=grid).collect()
        slots, size, of_crc = collections.defaultdict(list), collections.Counter(), collections.defaultdict(set)
        for x in rows:
            slots[x["shard"]].append(x["slot"])
            size[x["shard"]] += x["size"]
            of_crc[x["text_crc32"], x["size"] == 8].add(x["shard"])
        assert len(rows) == len(texts)
        assert sorted((x["size"], x["text_crc32"]) for x in rows) == sorted(
            (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert set(slots) <= set(range(24))
        assert max(size.values()) <= smallest(texts, 24)
        assert all(len(s) == 1 for (crc, empty), s in of_crc.items() if not empty)
    assert sharding.shard_by_bytes(df.limit(0), 24).count() == 0


def test_rows_that_repeat_whole_are_numbered_in_many_cells(spark, monkeypatch):
    seen = {}
    number = sharding.number_slots

    def watched(placed, shards):
        from pyspark.sql import functions as F
        seen["cells"] = placed.select(F.pmod(F.xxhash64("number"), F.lit(64))).distinct().count()
        return number(placed, shards)

    monkeypatch.setattr(sharding, "number_slots", watched)
    df = spark.createDataFrame([(7, "one text")] * 3000, "doc_id long, text string").repartition(3)
    rows = sharding.shard_by_bytes(df, 24).collect()
    assert seen["cells"] == 64 and len({r["shard"] for r in rows}) == 1
    assert sorted(r["slot"] for r in rows) == list(range(3000))


def test_capacity_is_minimal(spark):
    r = random.Random(4)
    texts = ["y" * r.randint(0, 300) + str(i) for i in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = sharding.cut_lineage(sharding.group_table(sharding.digest_rows(df)))
    for grid in (8, 64, 65536):
        assert sharding.minimax_cuts(groups, 24, grid)[0] == smallest(texts, 24)


def test_level_cuts_respect_capacity():
    edges, cap = [0, 10, 20, 90, 100], 70
    cuts = sharding.level_cuts(edges, cap, 3)
    assert cuts[-1] == 100 and max(b - a for a, b in zip([0, *cuts], cuts)) <= cap


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets, lists, parent = [shingles(t) for _, t in rows], collections.defaultdict(list), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, k in collections.Counter(j for g in s for j in lists[g]).items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                parent[find(i)] = find(j)
        for g in s:
            lists[g].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def near_copies():
    r = random.Random(5)
    v = [f"w{i}" for i in range(400)]
    rows = list(enumerate([None, "", "A b", "a B", "one two three four five", "ONE two three four five", "  ", "é É", "x " * 3000]))

    def edited(ws, k):
        ws = list(ws)
        for _ in range(k):
            ws[r.randrange(len(ws))] = r.choice(v)
        return " ".join(ws)

    for _ in range(40):
        base = [r.choice(v) for _ in range(r.randint(3, 120))]
        rows += [(len(rows) + k, edited(base, r.choice([0, 0, 1, 2, 4]))) for k in range(r.choice([1, 2, 3, 30]))]
    common = " ".join(r.choice(v) for _ in range(12))
    rows += [(len(rows) + k, common + " " + " ".join(r.choice(v) for _ in range(r.randint(1, 30)))) for k in range(60)]
    rows += [(3, rows[20][1]), (None, rows[21][1]), rows[30]]
    r.shuffle(rows)
    return rows


def test_jaccard_components(spark):
    rows = near_copies()
    df = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows],
                               "doc_id long, text string, sid int, label int, n int").repartition(3)
    want = brute_components(rows)
    for options in ({}, {"block": 1500, "hot_list": 3}, {"block": 1500, "exact": True}):    # cut groups, hot lists dealt
        got = jaccard.jaccard_components(df, **options).collect()
        assert sorted((tuple(x) for x in got), key=str) == want
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_keep_one(spark):
    rows = [(5, "a b c d e f g h i j k l m n o"), (3, "a b c d e f g h i j k l m n o"), (9, None), (8, ""), (None, "q r"), (1, "z z")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, _gone string")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == ["1", "3", "8", "9", "None"]


def test_rows_without_ids_or_with_one_id_stay_apart(spark, monkeypatch):
    r = random.Random(6)
    base = [f"w{r.randrange(900)}" for _ in range(120)]

    def near(k):
        ws = list(base)
        ws[k % 100] = f"e{k}"
        return " ".join(ws)

    rows = [(None, near(k)) for k in range(150)] + [(7, near(k)) for k in range(150, 300)]
    rows += [(7, " ".join(f"z{r.randrange(900)}" for _ in range(50))), (None, "other words"), (None, None), (None, None)]
    rows += [(None, near(3))] * 20 + [(8, "a b c d e f g")] * 30
    df = spark.createDataFrame([(d, t, k, "x") for k, (d, t) in enumerate(rows)],
                               "doc_id long, text string, hash int, _row string").repartition(4)
    written = {}
    keep = jaccard.cut_lineage

    def seen(frame):
        out = keep(frame)
        if out.columns == ["label", "sid", "n", "text"]:
            written["texts"] = out.count()
        return out

    monkeypatch.setattr(jaccard, "cut_lineage", seen)
    want = brute_components(rows)
    for options in ({}, {"block": 2000}, {"block": 2000, "exact": True}):
        got = jaccard.jaccard_components(df, **options).collect()
        assert sorted((tuple(x) for x in got), key=str) == want
        assert written["texts"] == 300
        kept = jaccard.keep_one(df, **options)
        assert kept.columns == df.columns
        kept = sorted(((x.doc_id, x.text) for x in kept.collect()), key=str)
        assert len(kept) == 6 and [x for x in kept if x[1] is None] == [(None, None)] * 2
        assert kept.count((8, "a b c d e f g")) == 1 and (None, "other words") in kept
        assert len([x for x in kept if x[0] == 7]) == 2


def test_blocks_of_sets_that_do_not_link(spark):
    """A group chained by one rare line: no two members link, sizes differ, and every link of the rest is found."""
    r = random.Random(8)
    line = "only these few words are shared by all of them here".split()
    rows = [(k, " ".join(line + [f"w{r.randrange(10**6)}" for _ in range(r.randint(5, 25))])) for k in range(120)]
    rows += [(500 + k, rows[k][1] + " end") for k in range(0, 120, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block, exact in ((200, True), (600, True), (200, False)):
        got = jaccard.jaccard_components(df, block=block, exact=exact).collect()
        assert sorted((tuple(x) for x in got), key=str) == brute_components(rows)


def test_search_paths_agree(monkeypatch):
    rows = [t for _, t in near_copies()]
    import pyarrow as pa

    sets = sorted((s for _, s in jaccard.shingle_sets(pa.array(rows, pa.string())) if len(s)), key=len)
    heap = jaccard.link_group(sets)
    monkeypatch.setattr(jaccard, "HEAP_ENTRIES", 0)
    assert jaccard.link_group(sets) == heap
    monkeypatch.setattr(jaccard, "HEAP_ENTRIES", 10**9)
    assert jaccard.link_group(sets) == heap
    assert jaccard.heap_merge_counts([[1, 2, 3], [2, 3], [3, 9]], 2) == {2: 2, 3: 3}


def test_words_over_slices(monkeypatch):
    import pyarrow as pa

    from limnos.llm import textops

    r = random.Random(1)
    texts = [None, "", "x" * 500] + [" ".join("ab" * r.randint(1, 9) for _ in range(r.randint(0, 60))) for _ in range(60)]
    col = pa.array(texts, pa.string())
    whole = [(k, s.tolist()) for k, s in jaccard.shingle_sets(col)]
    monkeypatch.setattr(textops, "SLICE", 64)
    assert [(k, s.tolist()) for k, s in jaccard.shingle_sets(col)] == whole
    assert [(k, s.tolist()) for k, s in jaccard.shingle_sets(col.slice(3, 20))] == [(k - 3, s) for k, s in whole[3:23]]


def test_components(spark, monkeypatch):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 200)]
    edges = spark.createDataFrame(chain, "a long, b long")
    want = {i: 0 for i in range(41)} | {100: 100, 200: 200, 201: 200}
    for task in (1_000_000, 12):           # all in one task; forests, then rounds
        monkeypatch.setattr(components, "TASK_EDGES", task)
        found = components.connected_components(edges).collect()
        assert len(found) == len(want) and {r["node"]: r["label"] for r in found} == want
    assert components.connected_components(edges.limit(0)).count() == 0
    a, b = np.array([5, 6, 9]), np.array([6, 7, 9])
    node, root = components.local_roots(a, b)
    assert dict(zip(node.tolist(), root.tolist())) == {5: 5, 6: 5, 7: 5, 9: 9}
