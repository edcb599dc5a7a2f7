"""DuckDB SQL of the search plan, to hold queries against; built from the same parts."""

from ..functions import analyze as A
from ..functions import sql as X
from ..operators.score import B, K1


def corpus(table: str, key: str, fields: list[str], html: bool = True, where: str = "TRUE") -> str:
    """CTEs src (the rows), d (doc_id, g: trigrams, dl), p (postings), df and st (n, avgdl) of a table's fields."""
    parts = [X.tokenize("n" + str(i)) for i in range(len(fields))]
    grams = parts[0] if len(parts) == 1 else f"list_distinct(flatten([{', '.join(parts)}]))"
    normal = ", ".join(f"{X.normalize(f'coalesce({f}, {chr(39)}{chr(39)})', html)} AS n{i}" for i, f in enumerate(fields))
    return f"""
src AS (SELECT * FROM {table} WHERE {where}),
nm AS MATERIALIZED (SELECT {key}::BIGINT AS doc_id, {normal} FROM src),
d AS MATERIALIZED (SELECT doc_id, g, len(g) AS dl FROM (SELECT doc_id, {grams} AS g FROM nm)),
p AS MATERIALIZED (SELECT unnest(g) AS trigram, doc_id FROM d),
df AS (SELECT trigram, count(*) AS df FROM p GROUP BY trigram),
st AS (SELECT greatest(1, count(*))::DOUBLE AS n, coalesce(sum(dl)::DOUBLE / count(*), 0) AS avgdl FROM d)"""


def candidates(query: str, limit: int, cap: int | None = 5000, deleted: str = "FALSE") -> str:
    """CTEs e (known trigrams) and h (doc_id, hits, min_trank) that the adaptive step keeps.  deleted: a condition on doc_id."""
    rows = ", ".join(f"('{t}', {i})" for i, t in enumerate(A.tokenize(query)))
    capped = "SELECT trigram, doc_id, trank FROM p JOIN e USING (trigram)"
    if cap is not None:
        capped += f" QUALIFY row_number() OVER (PARTITION BY trigram ORDER BY doc_id DESC) <= {cap}"
    return f"""
q(trigram, pos) AS (VALUES {rows}),
e AS (SELECT trigram, df, row_number() OVER (ORDER BY df, pos) AS trank, count(*) OVER () AS k FROM q JOIN df USING (trigram)),
c AS ({capped}),
ha AS (SELECT doc_id, count(*) AS hits, min(trank) AS min_trank FROM c WHERE NOT ({deleted}) GROUP BY doc_id),
h AS (SELECT * FROM ha WHERE (SELECT count(*) FROM ha WHERE hits = (SELECT max(k) FROM e)) < {limit} OR hits = (SELECT max(k) FROM e))"""


def kept(limit: int, key: str, condition: str = "TRUE") -> str:
    """CTE k: the first ``limit`` candidates whose row in src meets the condition."""
    return f"k AS (SELECT h.* FROM h JOIN src ON src.{key} = h.doc_id WHERE {condition} ORDER BY hits DESC, min_trank, h.doc_id LIMIT {limit})"


_TERM = f"ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * {K1 + 1}::DOUBLE / (1.0::DOUBLE + {K1}::DOUBLE * (CASE WHEN avgdl > 0 THEN {1 - B}::DOUBLE + {B}::DOUBLE * LEN / avgdl ELSE 1 END))"
_MAX = f"(ln((n + 0.5::DOUBLE) / 0.5::DOUBLE + 1.0::DOUBLE) * {K1 + 1}::DOUBLE)"


def global_score() -> str:
    """CTE s (doc_id, score) of the kept documents."""
    return f"""s AS (SELECT k.doc_id, round(least(sum({_TERM.replace("LEN", "d.dl")}) / max({_MAX}) * 100, 100), 2) AS score
FROM k JOIN d ON d.doc_id = k.doc_id JOIN p ON p.doc_id = k.doc_id JOIN e ON e.trigram = p.trigram, st GROUP BY k.doc_id)"""


def boosted_score(fields: dict[str, float], key: str, html: bool = True) -> str:
    """CTE s (doc_id, score); fields: each indexed string field, in the order of corpus(), and its boost."""
    one = []
    for i, (_, boost) in enumerate(fields.items()):
        one.append(f"SELECT k.doc_id, {boost}::DOUBLE AS boost, {X.tokenize(f'n{i}')} AS g FROM k JOIN nm ON nm.doc_id = k.doc_id")
    return f"""fl AS (SELECT *, row_number() OVER () AS f FROM ({" UNION ALL ".join(one)}) WHERE len(g) > 0),
fs AS (SELECT fl.doc_id, fl.f, any_value(boost) AS boost, coalesce(sum(CASE WHEN e.df IS NOT NULL THEN {_TERM.replace("LEN", "len(fl.g)")} END), 0) / max({_MAX}) AS share
FROM (SELECT doc_id, f, boost, g, unnest(g) AS trigram FROM fl) fl LEFT JOIN e ON e.trigram = fl.trigram, st GROUP BY fl.doc_id, fl.f),
s AS (SELECT doc_id, round(least(sum(share * boost) / sum(boost) * 100, 100), 2) AS score FROM fs GROUP BY doc_id)"""


def result(extra: str = "") -> str:
    return f"SELECT k.doc_id, coalesce(s.score, 0.0) AS score, k.hits{extra} FROM k LEFT JOIN s ON s.doc_id = k.doc_id"
