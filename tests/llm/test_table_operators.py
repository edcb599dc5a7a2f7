"""Operators 4, 5, 8 and 9 and the pipeline against brute force, exact round trips and laws."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexigrove.llm import mixing, mtree, sharding, toxicity, warc
from lexigrove.llm.common import work_path

DOC = "doc_id long, text string, lang string, source string, n_chars long"

# 4


def vectors(rng, n):
    out = []
    for i in range(n):
        v = [rng.gauss(0, 0.3) for _ in range(6)]
        if i % 11 == 0:
            v = [0.25, -0.5, 0.125, 0.0, 1.0, 0.5]  # ties
        out.append((i, v))
    return out + [(1000, None), (1001, [0.1, None, 0.2]), (1050, [float("nan")] * 6), (1002, [float("inf")] * 6), (1003, []), (1100, [0.5, 0.5]), (None, [1.0] * 6), (7, [9.0] * 6), (7, [9.0] * 6), (25, [0.5] * 6)]


LARGE = [(1004, [1e30] * 6), (1025, [-1e30, 1e30, 0.0, 0.0, 1.0, 1.0]), (1005, [3e5] * 6), (1075, [3e5, -3e5, 1.0, 0.0, 0.0, 2e5]), (1006, [1e7] * 6), (1150, [-4e6] * 6), (1007, [1.7e308, -1.7e308, 0.0, 0.0, 0.0, 0.0])]


def top_brute(rows, k, ask):
    rows = [(i, mtree.numbers(v)) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for r, (i, q) in enumerate(rows):
        if ask(i):
            scores = [(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, x)))), j) for s, (j, x) in enumerate(rows) if s != r]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("large", [False, True])
@pytest.mark.parametrize("sizes", [(32 << 20, 4096, 256), (40 * 48, 3, 4)])
def test_top_k(spark, monkeypatch, sizes, large):
    for name, v in zip(("PART_BYTES", "QUERY_ROWS", "LEAF"), sizes):
        monkeypatch.setattr(mtree, name, v)
    rows = vectors(random.Random(1), 300) + LARGE * large
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumns({c: F.lit(0) for c in ("score", "rid", "x", "norm", "pivot", "part", "id")})
    got = sorted(tuple(r) for r in mtree.top_k(df, lambda i: i % 25 == 0).collect())
    assert got == top_brute(rows, 5, lambda i: i % 25 == 0)


def test_numbers_are_exact():
    from fractions import Fraction

    for c in (0.0, -0.001, 0.001, 1 / 3, -7.7, 2.0**53 + 2, -3e17, 1e300, 5e-324):
        assert mtree.numbers([c]) == [math.floor(Fraction(c) * 256)]


def test_top_k_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert mtree.top_k(spark.createDataFrame([], schema), lambda i: i % 50 == 0).count() == 0
    got = [tuple(r) for r in mtree.top_k(spark.createDataFrame([(0, [1.0]), (3, [0.5])], schema), lambda i: i % 50 == 0).collect()]
    assert got == [(0, 1, 3, 256 * 128)]
    assert mtree.top_k(spark.createDataFrame([(0, [1.0])], schema), lambda i: i % 50 == 0).count() == 0


def test_tree_bounds_hold_and_spare_work():
    rng = np.random.default_rng(0)
    x = np.floor(256 * np.concatenate([c + 0.05 * rng.standard_normal((200, 4)) for c in rng.standard_normal((8, 4))]))
    tree = mtree.Tree(x, leaf=16)

    def below(at):
        _, leaf, rows, _, _, kids = tree.pages[at]
        return set(rows.tolist()) if leaf else set().union(*(below(k) for k in kids))

    assert below(0) == set(range(len(x)))
    for parent, leaf, rows, dist, radius, kids in tree.pages:
        if parent >= 0:
            assert np.allclose(dist, np.linalg.norm(x[rows] - x[parent], axis=1))
        for r, rad, kid in zip(rows, radius, kids):
            if not leaf:
                assert max(np.linalg.norm(x[sorted(below(kid))] - x[r], axis=1)) <= rad + 1e-9
    own = np.arange(0, len(x), 100)
    for wide in (False, True):
        at, score, found, computed = mtree.search(tree.pages, x, np.arange(len(x)), np.arange(len(x)), x[own], own, np.full(len(own), -(1 << 63)), 5, wide)
        for i, q in enumerate(own):
            assert sorted((-s, j) for a, s, j in zip(at, score, found) if a == i) == sorted((-(v @ x[q]), j) for j, v in enumerate(x) if j != q)[:5]
        assert computed < len(x) * len(own) / 2


# 5


def documents(rng, n=400):
    words = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))), "en", rng.choice(["a", "b", "b", "é", "Z"]), 1) for i in range(n)]
    return rows + [(n, None, None, None, None), (n + 1, "", "en", None, 0), (None, "x y", "en", "b", 3), (n + 2, "long " * 40_000, "en", "a", 1)] + [(3, "same row", "en", "b", 8)] * 90


@pytest.mark.parametrize("bucket_bytes", [1 << 24, 3000])
def test_shards(spark, monkeypatch, bucket_bytes):
    rows = documents(random.Random(2))
    clash = {c: F.lit("x") for c in ("slot", "_key", "key", "_tie", "tie", "_bucket", "bucket", "rank", "salt", "per", "part", "_cell")}
    df = spark.createDataFrame(rows, DOC).withColumns(clash).withColumn("map", F.create_map(F.lit(1), F.lit(2)))
    got = []
    for parts, tasks in ((3, 50_000), (7, 50_000), (1, 2)):  # whatever the partitions and tasks, the shards are the same
        monkeypatch.setattr(sharding, "TASKS", tasks)
        out = sharding.external_shuffle(df.repartition(parts), 8, bucket_bytes=bucket_bytes).collect()
        assert {(r._key, r.bucket, r.map[1]) for r in out} == {("x", "x", 2)}
        got.append([(r.shard, r.slot, r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in out])
    key = lambda r: (r[0], r[1])
    assert Counter(r[2:] for r in got[0]) == Counter(rows)  # all rows, whole
    sizes = Counter(r[0] for r in got[0])
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r[1] for r in got[0] if r[0] == s) == list(range(n))
    assert sorted(got[0], key=key) == sorted(got[1], key=key) == sorted(got[2], key=key)
    order = [r[2] for r in sorted(got[0], key=key) if r[2] not in (None, 3)]
    assert order != sorted(order) and abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.25


def test_shards_by_a_plain_list(spark):
    """The same sequence made by hand: the rows of each bucket in order of their hashes, shuffled by swaps, one bucket after another."""
    rows, seed, size, shards = [(i, f"text {i} " * (i % 5), "en", "s", i) for i in range(200)], 5, 2000, 3
    df = spark.createDataFrame(rows, DOC)
    hashed = df.select("doc_id", F.xxhash64(F.lit(seed), "doc_id", "text").alias("key"), (F.octet_length("text") + 64).alias("bytes"))
    held = hashed.agg(F.sum("bytes")).first()[0]
    n = -(-held // size)
    placed = hashed.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "key", F.lit(0).cast("long")), F.lit(n))).collect()
    sequence = []
    for b in range(n):
        own = [r.doc_id for r in sorted((r for r in placed if r.bucket == b), key=lambda r: r.key)]
        draw = np.random.default_rng([seed, b]).random(len(own))
        for i in range(len(own) - 1, 0, -1):
            j = int(draw[i] * (i + 1))
            own[i], own[j] = own[j], own[i]
        sequence += own
    ends = [67, 134, 200]
    want = {(k, i - ([0] + ends)[k]): d for i, d in enumerate(sequence) for k in [sum(i >= e for e in ends)]}
    assert {(r.shard, r.slot): r.doc_id for r in sharding.external_shuffle(df.repartition(4), shards, seed, bucket_bytes=size).collect()} == want


def test_shards_of_nothing(spark):
    out = sharding.external_shuffle(spark.createDataFrame([], DOC))
    assert out.count() == 0 and {"shard", "slot"} <= set(out.columns)


def test_shard_query(spark, tmp_path):
    rows = [(1, "é", "en", "a", 1), (2, None, "en", "a", 1)]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in sharding.op5_external_shuffle(spark, str(tmp_path)).collect()}
    assert (got[1]["size"], got[1].text_crc32) == (3, zlib.crc32("é".encode())) and (got[2]["size"], got[2].text_crc32) == (1, 0)
    assert {r.law for r in got.values()} == {"rows"} and {r.grown_shard for r in got.values()} == {None}


# 8


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_warc_round_trip(spark, monkeypatch, broadcast_rows):
    big = "".join(random.Random(3).choices("abcé\n\r", k=700_000))
    pages = [(1, "http://a/ b\r\nX: y", "x" * 99), (2, "u", "x" * 99), (5, "u", "y" * 100), (4, None, "y" * 100), (9, "http://é", "y" * 100), (6, "u", None), (7, "u", ""), (8, "u", big), (10, "u", big), (11, "u", "é" * 50), (12, "u", "\r\n\r\nWARC/1.1" + "z" * 90), (None, "u", "q" * 200), (None, "u", "y" * 100)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("page", "_page", "digest", "_digest", "payload", "refers_to", "copies", "n")}).repartition(2)
    path = work_path(spark, "warc")
    index = warc.write_warc(df, path, broadcast_rows=broadcast_rows)
    chunks = warc.read_warc(index, path).collect()
    text = {}
    for c in sorted(chunks, key=lambda c: (c.record_id or "", c.chunk_no)):
        if c.record_id is not None and c.record_type == "response":
            text[int(c.record_id)] = text.get(int(c.record_id), b"") + bytes(c.chunk)
            assert c.n_bytes == len(text[int(c.record_id)]) and c.sha256 == hashlib.sha256(text[int(c.record_id)]).hexdigest()
    by = {r.record_id and int(r.record_id): r for r in chunks if r.is_last and r.record_id}
    first = {4: 4, 5: 4, 9: 4, 8: 8, 10: 8}
    for i, _, html in pages:
        if i is None:
            continue
        body = (html or "").encode()
        r = by[i]
        assert (r.n_bytes, r.sha256) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", str(first[i])) if first.get(i, i) != i else ("response", None))
        if r.record_type == "response":
            assert text[i] == body
    assert sum(c.is_last for c in chunks) == len(pages)
    assert len([c for c in chunks if c.record_id == "8"]) > 2 and max(len(c.chunk) for c in chunks) <= warc.CHUNK
    assert by[1].target_uri == "http://a/%20b%0D%0AX:%20y" and by[4].target_uri is None
    assert warc.write_warc(df.limit(0), work_path(spark, "warc")).count() == 0


def test_a_damaged_archive_is_noticed(spark):
    from pyarrow import fs

    df = spark.createDataFrame([(1, "u", "payload " * 50)], "page_id long, url string, html string")
    path = work_path(spark, "warc")
    index = warc.write_warc(df, path)
    name = index.first().path
    system, _ = fs.FileSystem.from_uri(path)
    data = zlib.decompress(system.open_input_file(name).read(), 31).replace(b"payload payload", b"payload paylOad", 1)
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    data = pack.compress(data) + pack.flush()
    with system.open_output_stream(name, compression=None) as f:
        f.write(data)
    index = spark.createDataFrame([(name, 0, len(data))], "path string, offset long, length long")
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(index, path).collect()


# 9


def goals_brute(sizes, most=3.0):
    order = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            open_.remove(s)
            left -= target[s]
    return target


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(1, 300)), "en", s, 1) for i, s in enumerate(rng.choices(["a", "B", "tiny", "é", None], [60, 20, 1, 10, 9], k=1500))]
    rows += [(5000 + i, None, "en", "empty", 1) for i in range(3)] + [(6000, "  ", "en", "a", 1)] + [(7000 + i, "same size", "en", "copies", 1) for i in range(200)]
    out = mixing.mix(spark.createDataFrame(rows, DOC).repartition(4).withColumn("size", F.lit("x"))).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = goals_brute(sizes)
    taken = Counter()
    for r in out:
        assert r["size"] == len((rows[r.doc_id][1] if r.doc_id < 1500 else next(x[1] for x in rows if x[0] == r.doc_id) or "").split())
        assert 0 <= r.copies <= 3 and r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-12)
        taken[r.source] += r.copies * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 300, (s, taken[s], want[s])
    again = mixing.mix(spark.createDataFrame(rows, DOC)).collect()
    assert sorted((r.doc_id, r.copies) for r in out) == sorted((r.doc_id, r.copies) for r in again)


def test_mix_is_its_sql_for_large_sources(spark, tmp_path):
    docs = spark.range(60_000).selectExpr("id AS doc_id", "repeat('w ', int(pmod(xxhash64(id), 50))) AS text", "'en' AS lang", "CASE WHEN id % 10 < 8 THEN 'hot' WHEN id % 10 = 8 THEN 'b' END AS source", "1L AS n_chars")
    docs.repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(db.execute(mixing.SQL).fetchall())
    got = sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in mixing.op9_entropy_balancing(spark, str(tmp_path)).collect())
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(math.isclose(g[3], w[3], rel_tol=1e-12) for g, w in zip(got, want))


def test_numbers_do_not_depend_on_partitions(spark):
    from lexigrove.llm.common import numbered

    rows = [(random.Random(i).choice("abc") if i % 7 else None, i % 13, i) for i in range(700)]
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    number, seen = {}, Counter()
    for r in want:
        seen[r[0]] += 1
        number[r[2]] = seen[r[0]]
    for n in (1, 9):
        df = spark.createDataFrame(rows, "g string, k int, i int").repartition(n).withColumns({"part": F.lit(0), "first": F.lit(1)})
        assert {r.i: r.no for r in numbered(df, ["g", "k", "i"], "no", ("g",)).collect()} == number
        assert sorted(r.no for r in numbered(df, ["k", "i"], "no").collect()) == list(range(1, 701))
    assert numbered(df.limit(0), ["k"], "no").count() == 0


def test_goals_that_contradict_raise(spark):
    cells = spark.createDataFrame([("a", "en", 10.0), ("b", "fr", 10.0)], "source string, lang string, tokens double")
    goals = {"source": spark.createDataFrame([("a", 15.0), ("b", 5.0)], "source string, target double"), "lang": spark.createDataFrame([("en", 5.0), ("fr", 15.0)], "lang string, target double")}
    with pytest.raises(RuntimeError, match="contradict"):
        mixing.balance(cells, goals, max_rounds=5)


def test_expand_keeps_columns_of_any_name(spark):
    rows = [(i, "a b c", "en", "s", 1) for i in range(4)] + [(9, "x y", "en", "t", 1), (9, "x y", "fr", "t", 2), (None, None, None, None, None)]
    names = ("_copies", "_text", "copies", "rows", "mark", "number", "i", "s", "m", "rank", "tie", "size", "target")
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names}).withColumn("map", F.create_map(F.lit("k"), F.col("lang")))
    out = [mixing.expand(df.repartition(n)) for n in (1, 5)]
    assert out[0].columns == df.columns
    found = [sorted(map(str, o.collect())) for o in out]
    assert found[0] == found[1]
    assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in out[0].collect() for c in names)


def test_mix_of_nothing_and_of_repeats(spark):
    assert mixing.mix(spark.createDataFrame([], DOC)).count() == 0
    rows = [(1, "a b", "en", "s", 1)] * 3 + [(None, "a b c", "en", None, 1)]
    out = mixing.expand(spark.createDataFrame(rows, DOC))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert out.where("doc_id = 1").count() * 2 + out.where("doc_id IS NULL").count() * 3 == pytest.approx(9, abs=3)


def test_two_groups_of_constraints(spark):
    cells = spark.createDataFrame([("a", "en", 100.0), ("a", "fr", 50.0), ("b", "en", 30.0), ("b", "fr", 20.0)], "source string, lang string, tokens double")
    goals = {"source": spark.createDataFrame([("a", 80.0), ("b", 120.0)], "source string, target double"), "lang": spark.createDataFrame([("en", 100.0), ("fr", 100.0)], "lang string, target double")}
    out = mixing.balance(cells, goals, 1e-6).collect()
    held = Counter()
    for r in out:
        held[r.source] += r.tokens * r.rate
        held[r.lang] += r.tokens * r.rate
    assert all(math.isclose(held[k], v, rel_tol=1e-4) for k, v in {"a": 80, "b": 120, "en": 100, "fr": 100}.items())
    rate = {(r.source, r.lang): r.rate for r in out}  # an exponential tilt: rates factor
    assert math.isclose(rate["a", "en"] * rate["b", "fr"], rate["a", "fr"] * rate["b", "en"], rel_tol=1e-9)


# the pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(5)) for _ in range(2000)]

    def text(n):
        return ". ".join(" ".join(rng.choice(words) for _ in range(10)) for _ in range(n))

    docs = [(i, text(5), "en", rng.choice(["s1", "s2", "s3"]), 1) for i in range(400)]
    labels = []
    for i in range(0, 400, 5):
        docs[i] = (i, docs[i][1] + " vileword nastyone", *docs[i][2:])
    labels = [(i, 1, int(i % 5 == 0)) for i in range(400)]
    item = " ".join(rng.choice(words) for _ in range(20))
    docs[1] = (1, docs[1][1] + " " + item, *docs[1][2:])
    docs += [(500 + i, docs[i][1], "en", "s1", 1) for i in (2, 3, 3, 5)] + [(600, docs[4][1] + " more", "en", "s2", 1), (None, None, None, None, None), (601, None, "en", None, 0), (602, "", "en", "s1", 0)]
    spark.createDataFrame(docs, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item), (1, "short item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = frame.columns
    for name, step in corpus_pipeline.STAGES[:4]:
        frame = step(spark, frame, str(tmp_path))
        assert frame.columns == columns
        path = str(tmp_path / f"after-{name}")
        frame.write.parquet(path)
        frame = spark.read.parquet(path)
        ids.append([r.doc_id for r in frame.select("doc_id").collect()])
    toxic = {i for i in range(0, 400, 5)} | {505}
    everyone = [d[0] for d in docs]
    assert sorted(map(str, ids[0])) == sorted(str(i) for i in everyone if i not in toxic)
    assert Counter(ids[1]) == Counter(set(everyone) - toxic - {502, 503, 600})
    assert Counter(ids[2]) == Counter(set(everyone) - toxic - {502, 503, 600, 1})
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/after-decontamination/*.parquet'")
    want = {k: taken // size for k, size, _, _, taken in db.execute(mixing.SQL).fetchall() if size}
    got = Counter(ids[3])
    assert {k: got[k] for k in want} == want and max(got.values()) <= 3 and len(ids[3]) > 250
    last = corpus_pipeline.STAGES[4][1](spark, frame, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in last) == Counter(ids[3])
    sizes = Counter(r.shard for r in last)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 1


CLASH = ("score", "_score", "offending", "n_words", "_n_words", "n_hit", "items", "_items", "spans", "_text", "_copies", "copies", "mark", "key", "tie", "bucket", "rank", "id", "_id", "comp", "d", "t", "row", "size", "target")


def tables(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, "some words of an item that stands nowhere else at all"), (None, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(5)) for _ in range(500)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)) + ". " + ("vileword nastyone" if i % 5 == 0 else "fine"), "en", "s", i) for i in range(200)]
    rows += [(7, "another text of the same id", "en", "s", 7), (300, "long " * 60_000, "en", None, 300), (301, None, None, "s", None), (None, "", None, "s", None)]
    docs = spark.createDataFrame(rows, DOC).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASH}).withColumn("map", F.create_map(F.lit("k"), F.col("n_chars")))
    tables(spark, tmp_path, docs)
    for runs in range(2):
        frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
        columns = frame.columns
        for name, step in corpus_pipeline.STAGES:
            frame = step(spark, frame, str(tmp_path))
            assert sorted(frame.columns) == sorted(columns + ["shard", "slot"] * (name == "sharding"))
            frame.write.parquet(f"{tmp_path}/{runs}-{name}")
            frame = spark.read.parquet(f"{tmp_path}/{runs}-{name}")
        out = frame.collect()
        assert len({r.doc_id for r in out}) > 100
        for r in out:
            assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for c in CLASH) and r.map == {"k": r.n_chars}
        texts = {r.doc_id: r.text for r in out}
        assert texts.get(300) in (None, "long " * 60_000)
        found = sorted(map(str, out))
        assert not runs or found == before  # reruns agree
        before = found


def test_stages_on_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, spark.createDataFrame([], DOC))
    for _, step in corpus_pipeline.STAGES:
        out = step(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
        assert out.count() == 0 and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_pipeline_leaves_its_result_only(spark, tmp_path):
    from lexigrove.llm import common
    from lexigrove.sources.workdir import shared_dir

    base = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(base))
    tables(spark, tmp_path, spark.createDataFrame([(i, f"words of text {i} and {i * 7} or {i * 31} as well", "en", "s", i) for i in range(50)], DOC))
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = {n for n in set(os.listdir(base)) - before if "pipeline" in n or "lexigrove" in n}
    assert [n.split("-")[1:3] for n in left] == [["pipeline", "sharding"]] and out.count() > 0
    assert common._scratch[-1].endswith(next(n for n in left if "pipeline" in n))


def test_one_row_stands_for_all_in_every_run(spark):
    from lexigrove.llm.common import one_of

    rows = [(i % 4, i, {"a": i}) for i in range(40)] + [(None, None, None)] * 2
    for n in (1, 7):
        df = spark.createDataFrame(rows, "k int, v int, m map<string,int>").repartition(n)
        assert sorted((r.k is None, r.k or 0, r.v, r.m) for r in one_of(df, "k").collect()) == [(False, 0, 0, {"a": 0}), (False, 1, 1, {"a": 1}), (False, 2, 10, {"a": 10}), (False, 3, 11, {"a": 11}), (True, 0, None, None)]


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert toxicity.THRESHOLD == 0.3
