"""Near-duplicate classes by b-bit MinHash.

A document's set holds its distinct runs of SHINGLE words.  Documents with equal sets are one node;
nodes that share a band of minima are candidates; of each node only the low BITS bits of its minima
are kept, packed into longs, and the similarity that bit counts of two such signatures give,
corrected for the 2**-BITS chance of equal bits, rejects most candidates.  The rest are confirmed on
their whole sets.  Classes are the connected components of confirmed links.

A band holds ROWS minima: a link of similarity 0.7 shares none of the BANDS bands with probability
(1 - 0.7**3)**40 = 5e-8, and is rejected by bit counts (five standard deviations) with 3e-7.

Candidates are never all pairs of a band's group.  First each node meets the least node of its
group; links found so join nodes to classes.  Only in groups that still hold several classes, nodes of
different classes are compared, in blocks of at most 2 * BLOCK nodes, by signatures of FINE one-bit
minima; what leaves a task are the few pairs that these let through (0.7 is five standard deviations
above their limit).  That loses no link between classes, as links inside a class can't change it.

Nulls, empty texts: an empty set, linked with nothing.  Rows that repeat a doc_id are one node of
the graph, whatever their texts.  Rows without doc_id form no link: their component is null, kept true.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import SPACE_RE, likely, sql_fold, stage, table, work_path

SHINGLE, BANDS, ROWS, BITS = 5, 40, 3, 4
FINE, BLOCK = 1024, 256
MANY = 500  #: partners that a document's set is sent to at once


def _sets(data, offs, tabs, size):
    """Sorted distinct shingle hashes of each row of a chunk."""
    w = K.Words(data, offs, tabs)
    g = K.grams(w.hash, size)
    for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if z - a >= size:
            yield np.unique(g[a : z - size + 1])
        elif z > a:
            yield K.grams(w.hash[a:z], z - a)
        else:
            yield np.zeros(0, np.uint64)


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """(id, n, s1, s2: a digest of the set, bits: packed low bits of the minima, bands: a hash for each band)."""

    def f(batches):
        tabs = K.tables(K.SPACE)
        k = bands * rows
        rng = np.random.default_rng(7)
        times, plus = rng.integers(0, 2**64, k, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**64, k, dtype=np.uint64)
        seeds, per = rng.integers(0, 2**64, bands, dtype=np.uint64), 64 // bits
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for lo, hi, data, offs in K.chunks(column):
                sets = list(_sets(data, offs, tabs, size))
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n)
                x = np.concatenate(sets)
                first = np.concatenate(([0], np.cumsum(n)))[full].astype(np.int64)
                least = np.zeros((len(full), k), dtype=np.uint64)
                s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if len(full):
                    buf = np.empty_like(x)
                    for j in range(k):
                        np.multiply(x, times[j], out=buf)
                        np.add(buf, plus[j], out=buf)
                        least[:, j] = np.minimum.reduceat(buf, first)
                    s1[full] = np.add.reduceat(K.mix(x ^ np.uint64(0x5DEECE66D)), first)
                    s2[full] = np.bitwise_xor.reduceat(K.mix(x ^ np.uint64(0xB5297A4D)), first)
                low = least & np.uint64(2**bits - 1)
                packed = np.zeros((len(full), -(-k // per)), dtype=np.uint64)
                for j in range(k):
                    packed[:, j // per] |= low[:, j] << np.uint64(j % per * bits)
                mixed = K.mix(least)
                keys = np.zeros((len(full), bands), dtype=np.uint64)
                for j in range(rows):
                    keys = K.mix(keys ^ mixed[:, j::rows] ^ seeds)
                def lists(a):
                    width = a.shape[1]
                    at = np.zeros(len(n) + 1, dtype=np.int32)
                    at[1:] = np.cumsum(np.where(n > 0, width, 0))
                    return pa.ListArray.from_arrays(pa.array(at), pa.array(K.signed(np.ascontiguousarray(a).ravel())))

                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(K.signed(s1)), pa.array(K.signed(s2)), lists(packed), lists(keys)], ["id", "n", "s1", "s2", "bits", "bands"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(K.tidy(f), f"id {kind}, n long, s1 long, s2 long, bits array<long>, bands array<long>")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp): the least node reachable over edges (a, b), for every node of an edge.

    Each round takes the least label among a node's neighbours and then the label's own label, so
    paths halve; groups are pre-aggregated, and each round is written to the shared folder.
    """
    spark = edges.sparkSession
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("comp", "near").alias("next"), F.col("comp").alias("old"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        path = work_path(spark, "labels")
        step.join(jump, "next").select("node", F.least("next", "far").alias("comp"), "old").write.parquet(path)
        labels = spark.read.parquet(path)
        if labels.where("comp <> old").isEmpty():
            return labels.select("node", "comp")
        labels = labels.select("node", "comp")
    raise RuntimeError("components did not settle")


def _similar(x: str, y: str, bands: int, rows: int, bits: int, least: float):
    """Whether the similarity by bit counts may reach ``least``: it is within five standard deviations of it."""
    k, chance = bands * rows, 2.0**-bits
    equal = chance + (1 - chance) * least
    most = k * (1 - equal) + 5 * (k * equal * (1 - equal)) ** 0.5
    ones = sum(1 << i for i in range(0, 64, bits))
    ones -= 1 << 64 if ones >= 1 << 63 else 0
    other = None
    for i in range(-(-k // (64 // bits))):
        d = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        s = 1
        while s < bits:
            d = d.bitwiseOR(F.shiftrightunsigned(d, s))
            s *= 2
        d = F.bit_count(d.bitwiseAND(F.lit(ones)))
        other = d if other is None else other + d
    return other <= most


def _fine(docs: DataFrame, ids: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(id, sign): FINE one-bit minima, packed, of the texts of ids."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def f(batches):
        tabs = K.tables(K.SPACE)
        rng = np.random.default_rng(11)
        times, plus = rng.integers(0, 2**64, FINE, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**64, FINE, dtype=np.uint64)
        for batch in batches:
            for lo, hi, data, offs in K.chunks(batch.column(1)):
                sets = list(_sets(data, offs, tabs, size))
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n)
                bits = np.zeros((len(n), FINE), dtype=np.uint8)
                x = np.concatenate(sets)
                first = np.concatenate(([0], np.cumsum(n)))[full].astype(np.int64)
                for j in range(FINE if len(full) else 0):
                    # the top bits order the minima, so that the lowest one is independent of them
                    bits[full, j] = K.mix(np.minimum.reduceat(x * times[j] + plus[j], first)) & np.uint64(1)
                packed = np.packbits(bits, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([r.tobytes() for r in packed], pa.binary())], ["id", "sign"])

    return _texts(docs, ids, doc_id, text).mapInArrow(K.tidy(f), f"id {kind}, sign binary").dropDuplicates(["id"])


def _texts(docs: DataFrame, ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, text) of ids (id); texts of other rows are hardly shuffled."""
    narrow = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return narrow.where(likely(ids, "id")).join(ids, "id", "left_semi")


def _blocks(mixed: DataFrame, signs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of nodes of one band's group in mixed (band, id, comp, members), in different classes, that
    signatures let through.  A group is cut into blocks of about BLOCK nodes by hash; a task sees two of them."""
    kind = mixed.schema["id"].dataType.simpleString()
    parts = F.ceil(F.col("members") / BLOCK)
    own = F.pmod(F.xxhash64("id"), parts)
    rows = mixed.join(signs, "id").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    rows = rows.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own"), "id", "comp", "sign")
    rows = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    chance = 0.5 + 0.5 * least
    most = FINE * (1 - chance) + 5 * (FINE * chance * (1 - chance)) ** 0.5

    def pairs(t):
        own, comp = t.column("own").to_numpy(), t.column("comp").to_pylist()
        _, comp = np.unique(np.array(comp), return_inverse=True)
        sign = np.stack([np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("sign")])
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        out = []
        for r in left:
            to = right[comp[right] != comp[r]]
            if i == j:
                to = to[to > r]
            if len(to):
                to = to[np.bitwise_count(sign[to] ^ sign[r]).sum(axis=1) <= most]
                out.append((np.full(len(to), r), to))
        a, b = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int))
        ids = t.column("id")
        return pa.RecordBatch.from_arrays([ids.take(pa.array(a, pa.int64())), ids.take(pa.array(b, pa.int64()))], ["a", "b"])

    def f(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            t = t.combine_chunks()
            if not len(t):
                continue
            keys = [t.column(c).to_numpy() for c in ("band", "i", "j")]
            new = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1 if len(t) > 1 else np.zeros(0, int)
            ends = [0, *new.tolist(), len(t)]
            for a, z in zip(ends[:-2], ends[1:-1]):
                yield pairs(t.slice(a, z - a).combine_chunks().to_batches()[0])
            rest = t.slice(ends[-2])
        if rest is not None:
            yield pairs(rest.combine_chunks().to_batches()[0])

    out = rows.mapInArrow(K.tidy(f), f"a {kind}, b {kind}")
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _confirm(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach ``percent`` of their union.  Only the texts of the pairs are read again."""
    pairs = stage(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    kind = docs.schema[doc_id].dataType.simpleString()

    def f(batches):
        tabs = K.tables(K.SPACE)
        for batch in batches:
            for lo, hi, data, offs in K.chunks(batch.column(1)):
                sets = [s.tobytes() for s in _sets(data, offs, tabs, size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], ["id", "words"])

    sets = stage(_texts(docs, ids, doc_id, text).mapInArrow(K.tidy(f), f"id {kind}, words binary").distinct(), "sets")

    # the set of a, once for each MANY of its partners, and then theirs
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / MANY).alias("parts"))
    own = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    left = own.select("a", "part").distinct().join(sets.select(F.col("id").alias("a"), "words"), "a").select("a", "part", F.lit(0).alias("side"), F.lit(None).cast(kind).alias("b"), "words")
    right = own.join(sets.select(F.col("id").alias("b"), "words"), "b").select("a", "part", F.lit(1).alias("side"), "b", "words")
    both = left.union(right).repartition("a", "part").sortWithinPartitions("a", "part", "side")

    def g(batches):
        now, held = None, []
        for batch in batches:
            a, part, side, b, words = (batch.column(i) for i in range(5))
            keep = []
            for i, (key, first) in enumerate(zip(zip(a.to_pylist(), part.to_pylist()), side.to_pylist())):
                own = np.frombuffer(words[i].as_buffer(), np.uint64)
                if first == 0:
                    if key != now:
                        now, held = key, []
                    held.append(own)  # several, where an id has several texts
                    continue
                for p in held if key == now else ():
                    if min(len(p), len(own)) * 100 < percent * max(len(p), len(own)):
                        continue
                    both = len(np.intersect1d(p, own, assume_unique=True))
                    if 100 * both >= percent * (len(p) + len(own) - both) and both:
                        keep.append(i)
                        break
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(at), b.take(at)], ["a", "b"])

    return stage(both.mapInArrow(K.tidy(g), f"a {kind}, b {kind}").distinct(), "links")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 70, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, kept), a row for each row of docs.

    Links join sets with 100 * |intersection| >= percent * |union|.  n_links counts the confirmed
    links of the row's set to other sets that were needed to find the classes.
    """
    sig = stage(signatures(docs, doc_id, text, size, bands, rows, bits), "signatures")
    some = sig.where("n > 0 AND id IS NOT NULL")
    nodes = some.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    member = stage(some.select("id", "s1", "s2", "n").join(nodes, ["s1", "s2", "n"]).select("id", "rep", "copies"), "members")
    reps = some.join(nodes.select("s1", "s2", F.col("rep").alias("id")), ["s1", "s2", "id"], "left_semi")
    reps = reps.dropDuplicates(["s1", "s2"])

    groups = reps.select("id", F.explode("bands").alias("band"))
    least = groups.groupBy("band").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "a")
    groups = stage(groups.join(least, "band"), "groups")  # (band, id, a)

    low = reps.select("id", "bits")

    def alike(pairs: DataFrame) -> DataFrame:
        x = pairs.join(low.select(F.col("id").alias("b"), F.col("bits").alias("y")), "b")
        x = x.join(low.select(F.col("id").alias("a"), F.col("bits").alias("x")), "a")
        return x.where(_similar("x", "y", bands, rows, bits, percent / 100)).select("a", "b").distinct()

    star = stage(groups.where("id <> a").select("a", F.col("id").alias("b")).distinct(), "star")
    links = _confirm(alike(star), docs, doc_id, text, size, percent)
    comp = components(links)

    named = groups.join(comp.withColumnRenamed("node", "id"), "id", "left").select("band", "id", F.coalesce("comp", "id").alias("comp"))
    mixed = named.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members")).where("lo < hi").select("band", "members")
    mixed = stage(named.join(mixed, "band"), "mixed")
    signs = stage(_fine(docs, mixed.select("id").distinct(), doc_id, text, size), "signs")
    cross = _blocks(mixed, signs, percent / 100).join(star, ["a", "b"], "left_anti")
    more = _confirm(cross, docs, doc_id, text, size, percent)

    links = stage(links.union(more).distinct(), "links")
    again = member.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")  # a doc_id with several texts
    comp = components(links.union(again.select(F.col("lo").alias("a"), F.col("hi").alias("b"))).union(again.select(F.col("id").alias("a"), F.col("lo").alias("b")).where("a <> b")).distinct())
    degree = links.select(F.col("a").alias("rep")).union(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    found = member.join(comp.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    found = found.groupBy("id").agg(F.min(F.coalesce("comp", "rep")).alias("component_id"), F.max(F.coalesce("n_links", F.lit(0))).alias("n_links"))
    out = sig.select("id", "n").join(found, "id", "left")
    comp = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("id").eqNullSafe(comp).alias("kept"))


def op3_bbit_minhash(spark, sf_dir):
    """Classes of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


def brute(docs, percent: int = 70, size: int = SHINGLE):
    """The same by comparing all pairs, for tests: docs is a list of (id, text)."""
    import re

    sets = {}
    for key, text in docs:
        w = re.findall(SPACE_RE, (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
        sets[key] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    comp = {k: k for k in sets}

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    by = {}
    for k, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(k)
    seen = {(p, q) for v in by.values() for i, p in enumerate(v) for q in v[i + 1 :]}
    for p, q in seen:
        both = len(sets[p] & sets[q])
        if 100 * both >= percent * (len(sets[p]) + len(sets[q]) - both):
            p, q = root(p), root(q)
            comp[max(p, q)] = min(p, q)
    for k in sets:
        yield k, len(sets[k]), root(k), root(k) == k


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({sql_fold("coalesce(text, '')")}, '{SPACE_RE}') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(generate_series(1, greatest(1, len(w) - 4)), lambda i: list_slice(w, i, i + 4))) AS x FROM d WHERE len(w) > 0),
e AS (SELECT doc_id, hash(unnest(x)) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * n >= 70 * (len(sa.x) + len(sb.x) - n)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT u.a, r.c FROM r JOIN u ON u.b = r.doc_id WHERE r.c < u.a),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(s.x), 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d LEFT JOIN s USING (doc_id) JOIN m USING (doc_id)
"""
