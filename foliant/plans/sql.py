"""Common parts of the SQL against which queries are checked."""

from __future__ import annotations

from foliant.functions import text as T
from foliant.operators.rank import WEIGHTS


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def analysed(text: str) -> str:
    """The analyser as a list expression."""
    clean = f"translate(lower(regexp_replace({text}, {quote(T.ADDRESS)}, '', 'g')), {quote(T.PUNCTUATION)}, '')"
    return f"list_filter(string_split_regex({clean}, '[ \\t\\r\\n]+'), lambda w: w <> '')"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[ \\t\\r\\n]+'), lambda w: w <> '')"


def pairs(tokens: str) -> str:
    """Successive elements of a list, joined by a blank."""
    return f"list_transform(list_zip({tokens}[:-2], {tokens}[2:]), lambda p: p[1] || ' ' || p[2])"


def whole(cell: str) -> str:
    """Digits as a number, anything else 0."""
    return f"CASE WHEN regexp_matches(trim(coalesce({cell}, '')), '^[0-9]+$') THEN coalesce(TRY_CAST(trim({cell}) AS BIGINT), 0) ELSE 0 END"


def number(cell: str) -> str:
    """A decimal number, anything else 0.0."""
    return f"CASE WHEN regexp_matches(trim(coalesce({cell}, '')), {quote(T.NUMBER)}) THEN CAST(trim({cell}) AS DOUBLE) ELSE 0.0 END"


BOOKS = "books AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY bookid ORDER BY loaded_at DESC, coalesce(avg_rating, '') DESC) AS rn FROM books_csv WHERE bookid IS NOT NULL) WHERE rn = 1)"
STOP = f"stop AS (SELECT DISTINCT word AS term FROM stopwords WHERE word IS NOT NULL UNION SELECT unnest([{', '.join(map(quote, T.STOP_WORDS))}]))"
CORPUS = """corpus AS (
  SELECT bookid AS doc_id, 'description' AS field, coalesce(description, '') AS text FROM books
  UNION ALL SELECT bookid, 'genres', replace(coalesce(genres, ''), ',', ' ') FROM books
  UNION ALL SELECT bookid, 'characters', replace(coalesce(characters, ''), ',', ' ') FROM books)"""
TOKENS = f"tok AS (SELECT doc_id, field, unnest({analysed('text')}) AS term FROM corpus)"
POSTINGS = "postings AS (SELECT field, term, doc_id, count(*)::BIGINT AS tf FROM tok ANTI JOIN stop USING (term) GROUP BY ALL)"
LENGTHS = "lengths AS (SELECT field, doc_id, sum(tf)::BIGINT AS dl FROM postings GROUP BY ALL)"
NDOCS = "nd AS (SELECT count(DISTINCT bookid)::BIGINT AS n FROM books)"
STATS = "stats AS (SELECT field, sum(dl) / max(n) AS avg_all, sum(dl) / count(*) AS avg_having, max(n) AS n_docs FROM lengths, nd GROUP BY field)"
QUERIES = f"""queries AS (SELECT bookid AS query_id, title AS text FROM books WHERE CAST(substr(bookid, 3) AS BIGINT) % 20 = 0 AND title IS NOT NULL),
qt AS (SELECT query_id, term, count(*)::BIGINT AS qtf FROM (SELECT query_id, unnest({analysed('text')}) AS term FROM queries) ANTI JOIN stop USING (term) GROUP BY ALL)"""
INDEX = ",\n".join([BOOKS, STOP, CORPUS, TOKENS, POSTINGS, LENGTHS, NDOCS])
RANKING = ",\n".join([INDEX, STATS, QUERIES])
TIERS = f"""quality AS (SELECT bookid AS doc_id, {number('avg_rating')} AS quality FROM books),
tiers AS (SELECT field, term, doc_id, tf, CASE WHEN r <= CASE field WHEN 'characters' THEN 3 WHEN 'description' THEN 10 ELSE 1 END THEN 1
  WHEN r <= CASE field WHEN 'characters' THEN 5 WHEN 'description' THEN 15 ELSE 1 END THEN 2 ELSE 3 END::BIGINT AS tier
  FROM (SELECT p.*, row_number() OVER (PARTITION BY field, term ORDER BY tf * quality DESC, doc_id) AS r FROM postings p JOIN quality USING (doc_id)))"""


def scores(method: str, part: str = "field", source: str = "postings", alpha: float = 0.5, lamda: float = 0.5) -> str:
    """CTEs that end in ``scored (query_id, <part>, doc_id, score)``."""
    terms = f"terms AS (SELECT {part}, term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM {source} GROUP BY ALL)"
    on = " AND ".join(f"p.{c} = t.{c}" for c in part.split(", "))
    columns = ", ".join(f"p.{c}" for c in part.split(", "))
    hits = f"FROM {source} p JOIN terms t ON p.term = t.term AND {on} JOIN qt q ON q.term = p.term CROSS JOIN nd"
    if method == "ltn.lnn":
        return f"{terms}, scored AS (SELECT query_id, {columns}, p.doc_id, sum((1 + ln(tf)) * ln(n / df) * (1 + ln(qtf))) AS score {hits} GROUP BY ALL)"
    if method == "ltc.lnc":
        raw = f"raw AS (SELECT query_id, {columns}, p.doc_id, sum((1 + ln(tf)) * ln(n / df) * (1 + ln(qtf))) AS s {hits} GROUP BY ALL)"
        norms = f"norms AS (SELECT {columns}, p.doc_id, sqrt(sum(pow((1 + ln(tf)) * ln(n / df), 2))) AS dn FROM {source} p JOIN terms t ON p.term = t.term AND {on} CROSS JOIN nd GROUP BY ALL)"
        qn = "qn AS (SELECT query_id, sqrt(sum(pow(1 + ln(qtf), 2))) AS qn FROM qt GROUP BY 1)"
        return f"{terms}, {raw}, {norms}, {qn}, scored AS (SELECT query_id, {part}, doc_id, CASE WHEN dn * qn = 0 THEN 0.0 ELSE s / (dn * qn) END AS score FROM raw JOIN norms USING ({part}, doc_id) JOIN qn USING (query_id))"
    if method == "bm25":
        avdl = "CASE WHEN p.field = 'description' THEN avg_having ELSE avg_all END"
        return f"{terms}, scored AS (SELECT query_id, {columns}, p.doc_id, sum(qtf * ln(n / df) * 2.2 * tf / (1.2 * (0.25 + 0.75 * dl / ({avdl})) + tf)) AS score {hits} JOIN lengths l ON l.field = p.field AND l.doc_id = p.doc_id JOIN stats s ON s.field = p.field GROUP BY ALL)"
    # language models, by definition: every candidate against every query term, absent ones with tf 0
    probability = {"lm_naive": "coalesce(tf, 0) / dl", "lm_bayes": f"(coalesce(tf, 0) + {alpha} * coalesce(cf, 0) / c) / (dl + {alpha})", "lm_mixture": f"{lamda} * coalesce(tf, 0) / dl + {1 - lamda} * coalesce(cf, 0) / c"}[method]
    return f"""{terms}, total AS (SELECT {part}, sum(tf)::BIGINT AS c FROM {source} GROUP BY ALL),
cand AS (SELECT DISTINCT query_id, {columns}, p.doc_id FROM {source} p JOIN qt q ON q.term = p.term),
prob AS (SELECT k.query_id, {', '.join('k.' + c for c in part.split(', '))}, k.doc_id, q.qtf, {probability} AS pr FROM cand k JOIN qt q ON q.query_id = k.query_id
  JOIN lengths l ON l.field = k.field AND l.doc_id = k.doc_id JOIN total o ON {' AND '.join(f'o.{c} = k.{c}' for c in part.split(', '))}
  LEFT JOIN terms t ON t.term = q.term AND {' AND '.join(f't.{c} = k.{c}' for c in part.split(', '))} LEFT JOIN {source} p ON p.term = q.term AND p.doc_id = k.doc_id AND {' AND '.join(f'p.{c} = k.{c}' for c in part.split(', '))}),
scored AS (SELECT query_id, {part}, doc_id, CASE WHEN min(pr) <= 0 THEN '-inf'::DOUBLE ELSE sum(qtf * ln(CASE WHEN pr <= 0 THEN 1 ELSE pr END)) END AS score FROM prob GROUP BY ALL)"""


WEIGHT = "CASE field " + " ".join(f"WHEN '{f}' THEN {w}" for f, w in WEIGHTS.items()) + " END"
FUSED = f"fused AS (SELECT query_id, doc_id, sum({WEIGHT} * score) AS score FROM scored GROUP BY ALL)"


def top(source: str, k: int = 10) -> str:
    return f"SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id)::BIGINT AS rank FROM {source}) WHERE rank <= {k}"


def tiered_search(method: str, k: int = 10) -> str:
    return f"""WITH {RANKING}, {TIERS}, {scores(method, 'field, tier', 'tiers')},
fst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, field, doc_id ORDER BY tier) = 1),
seen AS (SELECT query_id, doc_id, min(tier) AS t FROM fst GROUP BY ALL),
stop_at AS (SELECT query_id, CASE WHEN count(*) FILTER (t <= 1) >= {k} THEN 1 WHEN count(*) FILTER (t <= 2) >= {k} THEN 2 ELSE 3 END AS s FROM seen GROUP BY 1),
fused AS (SELECT query_id, doc_id, sum({WEIGHT} * score) AS score FROM fst JOIN stop_at USING (query_id) WHERE tier <= s GROUP BY ALL)
{top('fused', k)}"""
