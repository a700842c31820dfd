import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tillroll.llm.kd_shards import METADATA, _points, kd_shards, op4_kd_tree_shards, write_shards
from tillroll.llm.radix import weighted_cuts


def brute(points, k):
    """The tree by sorting each node; points: (size, tie, x0, x1, ...)."""
    dims = range(2, len(points[0]))
    ranges = [max(1, max(p[i] for p in points) - min(p[i] for p in points)) for i in dims]
    leaf = {}

    def split(rows, lo, k):
        if k == 1:
            for r in rows:
                leaf[r] = lo
            return
        if not rows:
            return
        wide = [(max(p[i] for p in rows) - min(p[i] for p in rows)) / g for i, g in zip(dims, ranges)]
        dim = wide.index(max(wide)) + 2
        total, kl = sum(p[0] for p in rows), k // 2
        target = total // k * kl + total % k * kl // k
        keys = defaultdict(int)
        for p in rows:
            keys[(p[dim] << 32) + p[1]] += p[0]
        below, cut = 0, 2 ** 63 - 1
        for key in sorted(keys):
            if below + keys[key] > target:
                cut = key + (1 if target - below > below + keys[key] - target else 0)
                break
            below += keys[key]
        split([p for p in rows if (p[dim] << 32) + p[1] < cut], lo, kl)
        split([p for p in rows if (p[dim] << 32) + p[1] >= cut], lo + kl, k - kl)

    split(points, 0, k)
    return leaf


def test_cuts_against_sorting(spark):
    rows = [(g, (i * 2654435761) % 2 ** 42, i % 7) for g in range(3) for i in range(200)] + [(3, 5, 10)] * 4
    targets = [(0, 100), (1, 0), (2, 10 ** 6), (3, 15), (4, 3)]
    got = {r.g: r for r in weighted_cuts(spark.createDataFrame(rows, "g int, k long, w long"),
                                         spark.createDataFrame(targets, "g int, target long"), ["g"], F.col("k"),
                                         F.col("w"), 2).collect()}
    for g, target in targets:
        own, below, cut, at = Counter(), 0, 2 ** 63 - 1, 0
        for h, k, w in rows:
            if h == g:
                own[k] += w
        for k in sorted(own):
            if below + own[k] > target:
                cut, at = k, own[k]
                break
            below += own[k]
        assert (got[g].cut, got[g].below, got[g]["at"]) == (cut, below, at)


def test_tree_against_sorting(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    points = _points(docs, "doc_id", "text", METADATA).collect()
    key = lambda r: (r["size"], r.tie, r.x0, r.x1, r.x2)
    for k in (40, 7):
        want = brute([key(r) for r in points], k)
        got = {r.doc_id: r.shard for r in kd_shards(docs, shards=k).collect()}
        assert got == {r.doc_id: want[key(r)] for r in points}


def test_contract(spark, sf01):
    got = op4_kd_tree_shards(spark, sf01).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    assert len(got) == len(docs)
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        raw = docs[r.doc_id].encode()
        assert r["size"] == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert sorted(slots) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / 40
    assert max(sizes.values()) - min(sizes.values()) < max(len(t.encode()) for t in docs.values()) < mean


def test_target_bytes_and_odd_rows(odd_docs, no_docs, tmp_path, spark):
    got = kd_shards(odd_docs, target_bytes=50_000).collect()
    assert len(got) == odd_docs.count() and {r.shard for r in got} <= set(range(4))
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        if r.doc_id == 0:
            assert (r["size"], r.text_crc32) == (16, 0)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert kd_shards(no_docs, shards=5).count() == 0
    write_shards(odd_docs, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == odd_docs.count() and set(odd_docs.columns) <= set(back.columns)


def test_a_third_is_one_row(spark, tmp_path):
    """Rows that nothing tells apart, and rows without an id, are cut like any others."""
    rows = [(None, "the same text on every one of them", "hot", "en") if i % 3 == 0 else
            (i // 2, f"text {i} " + "w" * (i % 50), f"s{i % 4}", "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = kd_shards(docs, shards=40).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(got) == 3000 and sorted(slots) == list(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in got)
    again = kd_shards(docs.repartition(5), shards=40).collect()
    place = lambda found: sorted((r.doc_id is None, r.doc_id or 0, r.text_crc32, r.shard) for r in found)
    assert place(got) == place(again)
    write_shards(docs, str(tmp_path / "out"), shards=40)
    counts = Counter(r.shard for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert counts == Counter(r.shard for r in got)
