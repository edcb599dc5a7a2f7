"""Queries over the driver's tables, and the SQL that each is held against."""

from __future__ import annotations

import copy
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import analyze as A
from .functions import sql as S
from .functions import text as X
from .operators import dynamic, facets, retrieve, score
from .operators.filters import condition
from .operators.highlight import highlight
from .operators.index import Index, build, clustered
from .plans import oracle as O
from .plans.engine import SearchEngine
from .sources.workdir import shared_dir, spread

PLAIN, TYPO, COMMON = "worthless disgusting trash", "wortless disgustin trsh", "the thand of"
PRODUCT = "small wigdet Brand#17"
BOOSTS = {"p_name": 3.0, "p_brand": 2.0, "p_type": 1.0}
LIMIT = 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


class _Stored(Index):
    """An index each part of which is written down when it is first asked for, from the documents as they were analysed."""

    def __init__(self, spark: SparkSession, base: str, make):
        def keep(df):
            df.write.parquet(f"{base}/analysed")
            return spark.read.schema(df.schema).parquet(f"{base}/analysed")

        lazy = make(keep)
        self.documents, self.forward, self.fields, self.seen = lazy.documents, lazy.forward, lazy.fields, {}
        parts: dict[str, DataFrame] = {}

        def part(name):
            if name not in parts:
                df = clustered(self.forward, self.dictionary) if name == "postings" else getattr(lazy, name)
                df.write.parquet(f"{base}/{name}")
                parts[name] = spark.read.schema(df.schema).parquet(f"{base}/{name}")
            return parts[name]

        self._part = part

    def __getattr__(self, name):
        if name not in ("postings", "dictionary", "stats"):
            raise AttributeError(name)
        return self._part(name)

    def with_tombstones(self, tombstones: DataFrame) -> Index:
        out = copy.copy(self)
        out.tombstones = tombstones
        return out


_written: dict[tuple[str, str, str], Index] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str) -> Index:
    """The index of a table, written down once for each application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        _written[key] = _Stored(spark, f"{shared_dir(spark)}/index-{name}-{uuid.uuid4().hex}", lambda keep: _BUILD[name](spark, sf_dir, keep))
    return _written[key]


def _documents(spark, sf_dir, keep):
    return build(_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), "doc_id", ["text"], keep)


def _products(spark, sf_dir, keep):
    part = _table(spark, sf_dir, "part")
    return build(part.withColumn("tags", F.split("p_name", " ")).withColumnRenamed("p_partkey", "doc_id"), keep=keep)


def _conversations(spark, sf_dir, keep):
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return build(turns, "conv_id", keep=keep)


def _events(spark, sf_dir, keep):
    return dynamic.build(_table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_type", F.parse_json("props").alias("props"))).alias("json")), "event_id", "json", keep)


_BUILD = {"documents": _documents, "products": _products, "conversations": _conversations, "events": _events}

_DOC = O.corpus("documents", "doc_id", ["text"])
_PART = O.corpus("part", "p_partkey", list(BOOSTS))
_DOC_FIELD = {"text": 1.0}
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


# text analysis and index

_add("normalize_documents", lambda s, d: _table(s, d, "documents").select("doc_id", X.normalize(F.col("text")).alias("normal")), f"SELECT doc_id, {S.normalize('text')} AS normal FROM documents")
_add("normalize_pages_html", lambda s, d: _table(s, d, "pages").select("page_id", X.normalize(F.col("html")).alias("normal")), f"SELECT page_id, {S.normalize('html')} AS normal FROM pages")
_REFERENCES = [0x41, 0xE9, 0xDF, 0x1AF, 0x152, 0xFB03, 0x301, 0x2D, 0x7F, 0xD800, 0x110000, 0x10FFFF, 0x3042, 9, 0]


def _referring(s, d):
    """Texts with a numeric reference in hexadecimal and in decimal, with as many leading zeros as the id says."""
    code = F.element_at(F.array(*map(F.lit, _REFERENCES)), (F.pmod("doc_id", F.lit(len(_REFERENCES))) + 1).cast("int"))
    zeros = F.repeat(F.lit("0"), F.pmod("doc_id", F.lit(13)).cast("int"))
    text = F.concat(F.lit("caf&#x"), zeros, F.hex(code), F.lit(";s &#"), zeros, code.cast("string"), F.lit("; &#12345678; &#xZZ; &#; "), F.coalesce(F.col("text"), F.lit("")))
    return _table(s, d, "documents").select("doc_id", X.normalize(text).alias("normal"))


_add(
    "normalize_numeric_references", _referring,
    f"""WITH c AS (SELECT doc_id, text, {_REFERENCES}[doc_id % {len(_REFERENCES)} + 1] AS code, repeat('0', (doc_id % 13)::INT) AS z FROM documents),
t AS (SELECT doc_id, 'caf&#x' || z || upper(to_hex(code)) || ';s &#' || z || code || '; &#12345678; &#xZZ; &#; ' || coalesce(text, '') AS x FROM c)
SELECT doc_id, {S.normalize('x', numeric=True)} AS normal FROM t""",
)
_add(
    "tokenize_documents", lambda s, d: _table(s, d, "documents").select("doc_id", F.array_join(F.sort_array(X.tokenize(F.col("text"))), " ").alias("trigrams")),
    f"WITH {_DOC} SELECT doc_id, array_to_string(list_sort(g), ' ') AS trigrams FROM d",
)
_add("doc_trigram_counts", lambda s, d: _stored(s, d, "documents").documents.select("doc_id", F.col("n_trigrams").cast("long").alias("n_trigrams")), f"WITH {_DOC} SELECT doc_id, dl::BIGINT AS n_trigrams FROM d")
_ORD = " + ".join(f"(instr('{A.ALPHABET}', substr(trigram, {i}, 1)) - 1) * {37 ** (3 - i)}" for i in (1, 2, 3))
_add("trigram_ordinals", lambda s, d: _stored(s, d, "documents").dictionary.select("trigram", X.ordinal(F.col("trigram")).cast("long").alias("ordinal")), f"WITH {_DOC} SELECT trigram, ({_ORD})::BIGINT AS ordinal FROM df")
_add("postings_build", lambda s, d: _stored(s, d, "documents").postings.select("trigram", "doc_id"), f"WITH {_DOC} SELECT trigram, doc_id FROM p")
_add("dictionary_df", lambda s, d: _stored(s, d, "documents").dictionary.select("trigram", "df"), f"WITH {_DOC} SELECT trigram, df FROM df")
_add(
    "corpus_stats", lambda s, d: _stored(s, d, "documents").stats.select("n", "trigram_sum", F.round(F.col("trigram_sum") / F.col("n"), 6).alias("avgdl")),
    f"WITH {_DOC} SELECT count(*) AS n, sum(dl)::BIGINT AS trigram_sum, round(sum(dl)::DOUBLE / count(*), 6) AS avgdl FROM d",
)


def _idf(s, d):
    i = _stored(s, d, "documents")
    return i.dictionary.crossJoin(F.broadcast(i.stats)).select("trigram", "df", F.round(score.idf(F.col("n").cast("double"), F.col("df")), 6).alias("idf"))


_add("trigram_idf", _idf, f"WITH {_DOC} SELECT trigram, df, round(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE), 6) AS idf FROM df, st")


def _terms(s, d):
    i = _stored(s, d, "documents")
    grams = A.tokenize(PLAIN)
    x = i.postings.where(F.col("trigram").isin(grams)).join(F.broadcast(i.dictionary.where(F.col("trigram").isin(grams))), "trigram").join(i.documents.select("doc_id", "n_trigrams"), "doc_id")
    x = x.crossJoin(F.broadcast(i.stats.select(F.col("n").cast("double").alias("n"), (F.col("trigram_sum") / F.col("n")).alias("avg"))))
    return x.select("doc_id", "trigram", F.round(score.term(score.idf(F.col("n"), F.col("df")), score.norm(F.col("n_trigrams"), F.col("avg"))), 6).alias("weight"))


_IN = ", ".join(f"'{t}'" for t in A.tokenize(PLAIN))
_add("bm25_terms", _terms, f"WITH {_DOC} SELECT doc_id, trigram, round({O._TERM.replace('LEN', 'dl')}, 6) AS weight FROM p JOIN d USING (doc_id) JOIN df USING (trigram), st WHERE trigram IN ({_IN})")

# retrieval


def _hits(query, keep):
    def run(s, d):
        i = _stored(s, d, "documents")
        grams = A.tokenize(query)
        entries = retrieve.probe(retrieve.query_table(s, {0: query}), i.dictionary.where(F.col("trigram").isin(grams)))
        return keep(retrieve.hits(i, entries, 5000, grams)).select("doc_id", F.col("hits").cast("long").alias("hits"), F.col("min_trank").cast("long").alias("min_trank"))

    return run


def _hits_sql(query, limit, where):
    return f"WITH {_DOC}, {O.candidates(query, limit)} SELECT doc_id, hits::BIGINT AS hits, min_trank::BIGINT AS min_trank FROM {where}"


_add("search_intersection", _hits(COMMON, retrieve.intersection), _hits_sql(COMMON, LIMIT, "ha WHERE hits = (SELECT max(k) FROM e)"))
_add("search_union", _hits(PLAIN, lambda x: x), _hits_sql(PLAIN, LIMIT, "ha"))
_add("search_adaptive", _hits(PLAIN, lambda x: retrieve.adaptive(x, LIMIT)), _hits_sql(PLAIN, LIMIT, "h"))


def _search(name, table, query, key, cte, limit=LIMIT, cap=5000, boosts=None, filters=None, where="TRUE", deleted=None, deleted_sql="FALSE", fields=None):
    def run(s, d):
        i = _stored(s, d, table)
        if deleted is not None:
            i = i.with_tombstones(i.documents.where(deleted()).select("doc_id"))
        return retrieve.search(i, query, limit, cap, boosts, filters).select("doc_id", "score", "hits")

    scored = O.boosted_score(fields, key) if boosts else O.global_score()
    _add(name, run, f"WITH {cte}, {O.candidates(query, limit, cap, deleted_sql)}, {O.kept(limit, key, where)}, {scored} {O.result()}")


_search("search_basic", "documents", PLAIN, "doc_id", _DOC)
_search("search_typo", "documents", TYPO, "doc_id", _DOC)
_search("search_bm25_global", "documents", COMMON, "doc_id", _DOC, limit=50)
_search("search_recency_cap", "documents", PLAIN, "doc_id", _DOC, cap=100)
_search("search_tombstones", "documents", PLAIN, "doc_id", _DOC, deleted=lambda: F.col("doc_id") % 7 == 3, deleted_sql="doc_id % 7 = 3")
_search("search_bm25_boosted", "products", PRODUCT, "p_partkey", _PART, boosts=BOOSTS, fields=BOOSTS)
_search("search_limit_changes_candidates", "products", PRODUCT, "p_partkey", _PART, limit=200)

_FILTERS = {
    "eq": ({"field": "p_type", "op": "=", "value": "ECONOMY"}, "p_type = 'ECONOMY'"),
    "ne": ({"field": "p_type", "op": "!=", "value": "ECONOMY"}, "p_type <> 'ECONOMY'"),
    "gt": ({"field": "p_size", "op": ">", "value": 30}, "p_size > 30"),
    "ge": ({"field": "p_size", "op": ">=", "value": 30}, "p_size >= 30"),
    "lt": ({"field": "p_retailprice", "op": "<", "value": 950.5}, "p_retailprice < 950.5"),
    "le": ({"field": "p_retailprice", "op": "<=", "value": "950.5"}, "p_retailprice <= 950.5"),
    "in": ({"field": "p_brand", "op": "in", "value": ["Brand#17", "Brand#4"]}, "p_brand IN ('Brand#17', 'Brand#4')"),
    "not_in": ({"field": "p_brand", "op": "not in", "value": ["Brand#17", "Brand#4"]}, "p_brand NOT IN ('Brand#17', 'Brand#4')"),
    "contains": ({"field": "tags", "op": "contains", "value": "widget"}, "list_contains(string_split(p_name, ' '), 'widget')"),
    "not_contains": ({"field": "tags", "op": "not contains", "value": "widget"}, "NOT list_contains(string_split(p_name, ' '), 'widget')"),
}
for _name, (_f, _where) in _FILTERS.items():
    _search(f"search_filter_{_name}", "products", PRODUCT, "p_partkey", _PART, limit=40, filters={"and": [_f]}, where=_where)
_search(
    "search_filter_and_or", "products", PRODUCT, "p_partkey", _PART, limit=60,
    filters={"and": [_FILTERS["gt"][0]], "or": [_FILTERS["eq"][0], _FILTERS["in"][0]]}, where="p_size > 30 AND (p_type = 'ECONOMY' OR p_brand IN ('Brand#17', 'Brand#4'))",
)


def _missing(s, d):
    rows = _table(s, d, "documents").select("doc_id").join(_table(s, d, "labels"), "doc_id", "left")
    return rows.where(condition({"and": [{"field": "quality", "op": "!=", "value": 0}], "or": [{"field": "toxic", "op": "=", "value": 1}, {"field": "nowhere", "op": "=", "value": 1}, {"field": "quality", "op": ">", "value": 0}]}, rows.schema)).select("doc_id")


_add("search_filter_missing_field", _missing, "SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE quality <> 0 AND (toxic = 1 OR quality > 0)")

# presentation

_GRAMS = "[" + _IN + "]"


def _marked(excerpt):
    def run(s, d):
        top = retrieve.search(_stored(s, d, "documents"), PLAIN, LIMIT)
        return top.select("doc_id", highlight(F.col("text"), A.tokenize(PLAIN), excerpt=excerpt).alias("marked"))

    hit = f"list_has_any({S.tokenize(S.normalize('w'))}, {_GRAMS})"
    words = "list_transform(ws, lambda w: CASE WHEN " + hit + " THEN '<mark>' || w || '</mark>' ELSE w END)"
    first = f"list_position(list_transform(ws, lambda w: {hit}), TRUE)"
    if excerpt:
        text = "CASE WHEN loc > 6 THEN '…' ELSE '' END || array_to_string(shown[greatest(1, loc - 5):least(len(ws), loc + 5)], ' ') || CASE WHEN loc + 5 < len(ws) THEN '…' ELSE '' END"
    else:
        text = "array_to_string(shown, ' ')"
    sql = f"""WITH {_DOC}, {O.candidates(PLAIN, LIMIT)}, {O.kept(LIMIT, "doc_id")},
w AS (SELECT k.doc_id, string_split_regex(trim(text, ' \t\n\r'), '\\s+') AS ws FROM k JOIN src ON src.doc_id = k.doc_id),
m AS (SELECT doc_id, ws, {words} AS shown, {first} AS loc FROM w)
SELECT doc_id, CASE WHEN loc > 0 THEN {text} END AS marked FROM m"""
    return run, sql


_add("highlight_full", *_marked(False))
_add("highlight_excerpt", *_marked(True))



def _highlighted(s, d):
    rows = retrieve.search(_stored(s, d, "products"), PRODUCT, LIMIT, boosts=BOOSTS, highlight=True, highlight_options={"excerpt": False, "tags": ("[", "]")})
    return rows.select("doc_id", F.explode("highlights").alias("field", "marked"))


def _highlighted_sql() -> str:
    grams = "[" + ", ".join(f"'{t}'" for t in A.tokenize(PRODUCT)) + "]"
    words = "string_split_regex(trim({f}, ' \t\n\r'), '\\s+')"
    hit = f"list_has_any({S.tokenize(S.normalize('w'))}, {grams})"
    one = "SELECT doc_id, '{f}' AS field, array_to_string(list_transform(ws, lambda w: CASE WHEN " + hit.replace("{", "{{").replace("}", "}}") + " THEN '[' || w || ']' ELSE w END), ' ') AS marked FROM (SELECT k.doc_id, " + words + " AS ws FROM k JOIN src ON p_partkey = k.doc_id WHERE {f} <> '') WHERE len(list_filter(ws, lambda w: " + hit.replace("{", "{{").replace("}", "}}") + ")) > 0"
    return f"WITH {_PART}, {O.candidates(PRODUCT, LIMIT)}, {O.kept(LIMIT, 'p_partkey')} " + " UNION ALL ".join(one.format(f=f) for f in BOOSTS)


_add("highlight_fields", _highlighted, _highlighted_sql())

# facets

_GIVEN = {
    "brand": [{"field": "p_brand", "op": "in", "value": ["Brand#17", "Brand#4", "Brand#9"]}],
    "type": [{"field": "p_type", "op": "=", "value": "ECONOMY"}],
    "price": [{"field": "p_retailprice", "op": ">=", "value": 910.0}],
}
_GIVEN_SQL = {"brand": "p_brand IN ('Brand#17', 'Brand#4', 'Brand#9')", "type": "p_type = 'ECONOMY'", "price": "p_retailprice >= 910.0"}
_ALWAYS = [{"field": "p_size", "op": ">", "value": 5}]


def _found(s, d, filters):
    return retrieve.search(_stored(s, d, "products"), PRODUCT, facets.FACET_LIMIT, boosts=BOOSTS, filters=filters)


def _kept_sql(without):
    where = " AND ".join(["p_size > 5", *(v for k, v in _GIVEN_SQL.items() if k != without)])
    return f"{_PART}, {O.candidates(PRODUCT, facets.FACET_LIMIT)}, {O.kept(facets.FACET_LIMIT, 'p_partkey', where)}"


_add("facet_counts", lambda s, d: facets.value_counts(_found(s, d, facets.build_filters(_ALWAYS, _GIVEN)), "p_brand"), f"WITH {_kept_sql('')} SELECT p_brand AS value, count(*) AS n FROM k JOIN src ON p_partkey = k.doc_id GROUP BY p_brand")


def _adaptive(s, d):
    rows = facets.adaptive(lambda f: _found(s, d, f), _GIVEN, _ALWAYS)
    parts = [facets.value_counts(rows[n], c, False).select(F.lit(n).alias("facet"), "value", "n") for n, c in (("brand", "p_brand"), ("type", "p_type"))]
    return parts[0].union(parts[1])


_SUB = "SELECT '{0}' AS facet, {1} AS value, count(*) AS n FROM (WITH {2} SELECT {1} FROM k JOIN src ON p_partkey = k.doc_id) GROUP BY {1}"
_add("facet_adaptive", _adaptive, " UNION ALL ".join(_SUB.format(n, c, _kept_sql(n)) for n, c in (("brand", "p_brand"), ("type", "p_type"))))
_add(
    "facet_price_range", lambda s, d: facets.value_range(facets.adaptive(lambda f: _found(s, d, f), _GIVEN, _ALWAYS)["price"], "p_retailprice"),
    f"WITH {_kept_sql('price')} SELECT coalesce(round(min(p_retailprice), 2), 0) AS min, coalesce(round(max(p_retailprice), 2), 0) AS max FROM k JOIN src ON p_partkey = k.doc_id",
)
_add(
    "facet_membership_split", lambda s, d: facets.split_counts(_found(s, d, None), "p_size", [1, 2, 3, 4, 5]),
    f"WITH {_PART}, {O.candidates(PRODUCT, facets.FACET_LIMIT)}, {O.kept(facets.FACET_LIMIT, 'p_partkey')} SELECT count(*) FILTER (p_size IN (1, 2, 3, 4, 5)) AS n_in, count(*) FILTER (p_size NOT IN (1, 2, 3, 4, 5)) AS n_rest FROM k JOIN src ON p_partkey = k.doc_id",
)

SHOP = "p_partkey AS doc_id, p_name AS name, p_type AS category, p_brand AS brand, CASE WHEN p_size % 3 = 0 THEN 'f' WHEN p_size % 3 = 1 THEN 'm' END AS gender, CAST(CASE WHEN p_size % 7 < 6 THEN -10 * (p_size % 7) END AS INT) AS promo, p_retailprice AS price, p_size - 2 AS stock, p_partkey % 5 <> 0 AS active"
_FORM = {"category": ["ECONOMY", "SMALL"], "brand": [], "promo": True, "price_min": 905.0}


def _shop(spark, sf_dir, keep):
    return build(_table(spark, sf_dir, "part").selectExpr(*[c.strip() for c in SHOP.split(", ")]), keep=keep)


_BUILD["shop"] = _shop


def _page(s, d):
    """A product search page as rows: its results, and each facet's values, each under all filters but its own."""
    page = facets.response(lambda f, n: retrieve.search(_stored(s, d, "shop"), "small wigdet", n, filters=f), facets.product_filters(**_FORM), LIMIT)
    rows = [("total", "", float(page["total"])), *(("result", str(r["doc_id"]), float(r["hits"])) for r in page["results"])]
    for facet, values in page["facets"].items():
        rows += [(facet, k, float(v)) for k, v in values.items()]
    return s.createDataFrame(rows, "facet string, value string, n double")


def _page_sql() -> str:
    always, own = "active AND stock > 0", {"category": "category IN ('ECONOMY', 'SMALL')", "promo": "promo IN (-10, -20, -30, -40, -50)", "price": "price >= 905.0"}
    cte = O.corpus(f"(SELECT {SHOP} FROM part) x", "doc_id", ["name", "category", "brand", "gender"])
    parts = [f"{cte}, {O.candidates('small wigdet', LIMIT)}, {O.kept(LIMIT, 'doc_id', ' AND '.join([always, *own.values()]))}"]
    found = {}
    for name in ("category", "brand", "gender", "promo", "price"):
        where = " AND ".join([always, *(v for k, v in own.items() if k != name)])
        full = O.candidates("small wigdet", facets.FACET_LIMIT).split("h AS (")[1].rsplit(")", 1)[0]
        found[name] = f"(SELECT src.* FROM (SELECT h.doc_id, h.hits, h.min_trank FROM ({full}) h JOIN src ON src.doc_id = h.doc_id WHERE {where} ORDER BY hits DESC, min_trank, h.doc_id LIMIT {facets.FACET_LIMIT}) k JOIN src ON src.doc_id = k.doc_id)"
    rows = ["SELECT 'total' AS facet, '' AS value, count(*)::DOUBLE AS n FROM k", "SELECT 'result', doc_id::VARCHAR, hits::DOUBLE FROM k"]
    rows += [f"SELECT '{n}', {n}, count(*)::DOUBLE FROM {found[n]} WHERE {n} IS NOT NULL GROUP BY {n}" for n in ("category", "brand", "gender")]
    sale = own["promo"]
    rows += [f"SELECT 'promo', 'on_sale', (count(*) FILTER ({sale}))::DOUBLE FROM {found['promo']}", f"SELECT 'promo', 'full_price', (count(*) FILTER (NOT coalesce({sale}, FALSE)))::DOUBLE FROM {found['promo']}"]
    rows += [f"SELECT 'price', '{f}', coalesce(round({f}(coalesce(price, 0)), 2), 0)::DOUBLE FROM {found['price']}" for f in ("min", "max")]
    return f"WITH {parts[0]} " + " UNION ALL ".join(rows)


_add("facet_response", _page, _page_sql())

# lifecycle


def _engine(s, d) -> SearchEngine:
    """An engine over the documents with every seventh deleted, and one of these written again."""
    docs = _table(s, d, "documents").select("doc_id", "text").orderBy("doc_id").select(F.col("doc_id").alias("key"), "text")
    path = f"{shared_dir(s)}/engine-{uuid.uuid4().hex}"
    engine = SearchEngine(s).open(path, "key long, text string")
    ids = engine.insert_bulk(docs, ["key"])
    engine.delete(ids.where("doc_id % 7 = 3"))
    engine.update(0, {"key": 0, "text": PLAIN})
    return engine


def _lifecycle(step):
    return lambda s, d: step(s, _engine(s, d))


def _compacted(s, engine):
    engine.compact()
    return engine.search(PLAIN, LIMIT).select("key", "score", "hits")


_BOTH = f"SELECT doc_id AS key, text, doc_id, (doc_id % 7 = 3 OR doc_id = 0) AS gone FROM documents UNION ALL SELECT 0, '{PLAIN}', (SELECT count(*) FROM documents), FALSE"
_LIVE = "(" + _BOTH + ") x"


def _engine_sql(compacted: bool) -> str:
    where = "NOT gone" if compacted else "TRUE"
    gone = "FALSE" if compacted else "doc_id IN (SELECT doc_id FROM src WHERE gone)"
    cte = O.corpus(_LIVE, "doc_id", ["text"], where=where)
    return f"WITH {cte}, {O.candidates(PLAIN, LIMIT, deleted=gone)}, {O.kept(LIMIT, 'doc_id')}, {O.global_score()} SELECT key, r.score, r.hits FROM ({O.result()}) r JOIN src ON src.doc_id = r.doc_id"


_add("engine_delete_update", _lifecycle(lambda s, e: e.search(PLAIN, LIMIT).select("key", "score", "hits")), _engine_sql(False))
_add("engine_compact", _lifecycle(_compacted), _engine_sql(True))
_add("engine_count", _lifecycle(lambda s, e: s.createDataFrame([(e.count(),)], "n long")), f"SELECT count(*) AS n FROM {_LIVE} WHERE NOT gone")
_add("engine_fragmentation", _lifecycle(lambda s, e: s.createDataFrame([(e.fragmentation_rate(),)], "percent long")), f"SELECT round(100.0 * count(*) FILTER (gone) / count(*))::BIGINT AS percent FROM {_LIVE}")



def _reopened(s, engine):
    """Closed, opened again by another engine beside what a crash left, and written to."""
    path = engine.store.files.base
    s.range(3).write.parquet(f"{path}/segment-dead")
    engine.close()
    again = SearchEngine(s).open(path)
    new = again.insert({"key": -1, "text": PLAIN})
    own = again.get(new).select("key", F.col("text"), F.lit(new).cast("long").alias("id"), F.lit(again.count()).cast("long").alias("n"))
    return own.withColumn("swept", F.lit(not again.store.files.exists("segment-dead")))


def _emptied(s, engine):
    """Reset, with nothing left to find, and filled again from the first id on."""
    before = engine.count()
    engine.reset()
    found, zero = engine.search(PLAIN).count(), engine.fragmentation_rate()
    ids = engine.insert_bulk([{"key": 5, "text": COMMON}, {"key": 6, "text": ""}, {"key": None, "text": None}])
    one = engine.search(COMMON, 1).first()
    return s.createDataFrame([(before, engine.count(), found, zero, ids[-1], one["key"], one["score"])], "before long, n long, found long, fragmentation long, last_id long, best long, score double")


_LIVE_N = f"(SELECT count(*) FROM {_LIVE} WHERE NOT gone)"
_add("engine_reopen_insert_get", _lifecycle(_reopened), f"SELECT -1::BIGINT AS key, '{PLAIN}' AS text, (SELECT count(*) + 1 FROM documents) AS id, {_LIVE_N} + 1 AS n, TRUE AS swept")
_K = len(A.tokenize(COMMON))
_add(
    "engine_reset", _lifecycle(_emptied),
    f"""SELECT {_LIVE_N} AS before, 3::BIGINT AS n, 0::BIGINT AS found, 0::BIGINT AS fragmentation, 2::BIGINT AS last_id, 5::BIGINT AS best,
round(least({_K} * ln((3 - 1 + 0.5::DOUBLE) / 1.5::DOUBLE + 1) * 2.5::DOUBLE / (1 + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * 3)) / (ln(3.5::DOUBLE / 0.5::DOUBLE + 1) * 2.5::DOUBLE) * 100, 100), 2) AS score""",
)


def _one_by_one(s, d):
    """A writer that is locked out, an unknown operator, and documents that come in bulk and singly."""
    engine = SearchEngine(s).open(f"{shared_dir(s)}/engine-{uuid.uuid4().hex}", "name string")
    rows = [r["r_name"] for r in _table(s, d, "region").orderBy("r_regionkey").collect()]  # five
    engine.insert_bulk([{"name": x} for x in rows])
    engine.insert_bulk([])
    said = []
    with engine.store.lock:
        try:
            SearchEngine(s).open(engine.store.files.base, lock_timeout=0.1).insert({"name": "late"})
        except TimeoutError:
            said.append("locked")
    try:
        engine.search("x", filters={"and": [{"field": "name", "op": "~", "value": 1}]})
    except ValueError:
        said.append("unknown")
    for x in rows:
        engine.insert({"name": x.lower()})
    return engine.store.index().documents.select("doc_id", F.col("name"), F.lit(",".join(said)).alias("refused"))


_add("engine_single_inserts", _one_by_one, "SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS doc_id, r_name AS name, 'locked,unknown' AS refused FROM region UNION ALL SELECT row_number() OVER (ORDER BY r_regionkey) - 1 + (SELECT count(*) FROM region), lower(r_name), 'locked,unknown' FROM region")

# nested and schemaless documents, and many queries

_CONV = "(SELECT conv_id, string_agg(role || ' ' || text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id) x"
_CONV_CTE = O.corpus(_CONV, "conv_id", ["text"])
_search("search_nested_fields", "conversations", COMMON, "conv_id", _CONV_CTE, limit=30)
_EVENT_CTE = O.corpus("events", "event_id", ["event_type"])
_search("search_json_docs", "events", "purchas", "event_id", _EVENT_CTE, limit=50)


def _json_filter(s, d):
    docs = _stored(s, d, "events").documents
    return docs.where(dynamic.condition({"and": [{"field": "event_type", "op": "in", "value": ["error", "click"]}]})).select("doc_id")


_add("filter_json_docs", _json_filter, "SELECT event_id AS doc_id FROM events WHERE event_type IN ('error', 'click')")


def _deep(s, d):
    """Events within twelve levels of objects and lists."""
    events = _table(s, d, "events").select("event_id", F.concat(F.lit('{"a":[' * 6), F.to_json(F.struct("event_type")), F.lit("]}" * 6)).alias("json"))
    index = dynamic.build(events, "event_id", "json")
    return index.documents.select("doc_id", F.col("n_trigrams").cast("long").alias("n_trigrams"))


_add("json_deep_strings", _deep, f"WITH {_EVENT_CTE} SELECT doc_id, dl::BIGINT AS n_trigrams FROM d")


def _many(s, d):
    queries = _table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieve.search_many(_stored(s, d, "documents"), queries, 5).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score", F.col("hits").cast("long").alias("hits"))


_add(
    "search_many", _many,
    f"""WITH {_DOC}, bn AS (SELECT item_id, {S.normalize('text')} AS nq FROM benchmark),
q AS (SELECT item_id AS query_id, trigram, min(pos) AS pos FROM (SELECT item_id, unnest({S.trigrams('nq')}) AS trigram, generate_subscripts({S.trigrams('nq')}, 1) AS pos FROM bn) GROUP BY ALL),
e AS (SELECT query_id, trigram, df, row_number() OVER (PARTITION BY query_id ORDER BY df, pos) AS trank, count(*) OVER (PARTITION BY query_id) AS k FROM q JOIN df USING (trigram)),
pc AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY trigram ORDER BY doc_id DESC) <= 5000),
ha AS (SELECT query_id, doc_id, count(*) AS hits, min(trank) AS min_trank, max(k) AS k FROM pc JOIN e USING (trigram) GROUP BY query_id, doc_id),
h AS (SELECT * FROM ha QUALIFY sum(CASE WHEN hits = k THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) < 5 OR hits = k),
k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, min_trank, doc_id) <= 5),
s AS (SELECT k.query_id, k.doc_id, round(least(sum({O._TERM.replace("LEN", "d.dl")}) / max({O._MAX}) * 100, 100), 2) AS score
      FROM k JOIN d ON d.doc_id = k.doc_id JOIN p ON p.doc_id = k.doc_id JOIN e ON e.trigram = p.trigram AND e.query_id = k.query_id, st GROUP BY k.query_id, k.doc_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hits DESC, min_trank, doc_id) AS rank, doc_id, score, hits FROM k JOIN s USING (query_id, doc_id)""",
)


def flagship(spark, sf_dir):
    """A boosted and filtered search over products."""
    return retrieve.search(_stored(spark, sf_dir, "products"), PRODUCT, LIMIT, boosts=BOOSTS, filters={"and": [_FILTERS["gt"][0]]})
