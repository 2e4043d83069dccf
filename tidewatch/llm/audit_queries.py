"""Queries of phrases, source audits and fingerprints, each over the whole documents table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import collocation, divergence, fingerprint
from tidewatch.llm.queries import LOWER, UPPER, table
from tidewatch.llm.registry import query

SQL11 = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words FROM documents),
grams AS (SELECT lang, k, words[i:i + k - 1] AS words FROM (
    SELECT lang, k, words, unnest(range(1, len(words) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS k) WHERE len(words) >= k)),
total AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
often AS (SELECT lang, k, words, count(*) AS n FROM grams GROUP BY lang, k, words HAVING count(*) >= 100),
parts AS (SELECT lang, words[i:i + j - 1] AS words, n FROM (SELECT lang, words, k, n, j, unnest(range(1, k - j + 2)) AS i
    FROM often, (SELECT unnest(range(2, 5)) AS j) WHERE j < k)),
around AS (SELECT lang, words, max(n) AS most FROM parts GROUP BY lang, words),
kept AS (SELECT o.lang, o.k, o.words, o.n AS a FROM often o LEFT JOIN around x ON o.lang = x.lang AND o.words = x.words
    WHERE o.k > 1 AND (x.most IS NULL OR 100 * x.most < 100 * o.n)),
cuts AS (SELECT lang, k, words, a, c, words[1:c] AS head, words[c + 1:k] AS rest FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)),
scored AS (SELECT cuts.lang, array_to_string(cuts.words, ' ') AS phrase, a, c, p.n AS l, q.n AS r, total.n AS n,
    (1000::HUGEINT * a * total.n) // (p.n::HUGEINT * q.n) AS score
    FROM cuts JOIN total USING (lang) JOIN often p ON p.lang = cuts.lang AND p.words = head JOIN often q ON q.lang = cuts.lang AND q.words = rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) WHERE rank <= 2000
"""


@query("op11_collocations", SQL11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))


SQL12 = rf"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
words AS (SELECT doc_id, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 30),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n AS in_lang FROM groups g JOIN kept k USING (lang)
    LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL) c USING (lang, source, term)),
shares AS (SELECT lang, source, term, n,
    1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p,
    1 + (1000000000 * (in_lang + 5)) // (sum(in_lang) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS q FROM cells),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= 50
"""


@query("op12_divergence", SQL12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def _mark_sql(text: str) -> str:
    """The fingerprint of a text column: SHA-256 over leaves, paragraphs, sections and the whole."""
    lines = f"list_transform(list_filter(regexp_extract_all({text}, '{fingerprint.SECTION}'), lambda x: x <> ''), lambda x: string_split(x, chr(10)))"
    leaves = f"list_transform({lines}, lambda s: list_transform(s, lambda p: list_transform(regexp_extract_all(p, '{fingerprint.LEAF}'), lambda w: sha256('l' || w))))"
    return f"list_transform([{leaves}], lambda t: {_ROOT} || ':' || {_BODY})[1]"


_ROOT = """sha256('r' || array_to_string(list_transform(t, lambda s: sha256('s' || array_to_string(
    list_transform(s, lambda p: sha256('p' || array_to_string(p, ''))), ''))), ''))"""
_BODY = """translate(array_to_string(list_transform(t, lambda s: array_to_string(list_transform(s, lambda p: array_to_string(
    list_transform(p, lambda h: to_base64(unhex(substr(h, 1, 6)))), '')), '.')), ';'), '+/', '-_')"""


def _near_sql(a: str, b: str) -> str:
    leaves = "list_distinct(regexp_extract_all(substr({}, 66), '[A-Za-z0-9_-]{{4}}'))"
    x, y = leaves.format(a), leaves.format(b)
    return (f"CASE WHEN left({a}, 64) = left({b}, 64) THEN 1.0::DOUBLE WHEN len({x}) + len({y}) = 0 THEN 0.0::DOUBLE "
            f"ELSE 2.0::DOUBLE * len(list_intersect({x}, {y}))::DOUBLE / (len({x}) + len({y}))::DOUBLE END")


SQL13 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
near AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM d WINDOW w AS (ORDER BY doc_id DESC)),
edits AS (SELECT doc_id, text, n, next_text, left(text, n - n // 2) || left(next_text, n // 2) AS edited FROM near),
marks AS (SELECT doc_id, n, sha256(edited) AS edited_sha256, {_mark_sql('text')} AS fingerprint, {_mark_sql('edited')} AS edited_fingerprint,
    {_mark_sql('next_text')} AS next_fingerprint FROM edits)
SELECT doc_id, n::BIGINT AS n_chars, edited_sha256, fingerprint, edited_fingerprint,
    {_near_sql('fingerprint', 'edited_fingerprint')} AS near_edited, {_near_sql('fingerprint', 'next_fingerprint')} AS near_next
FROM marks
"""


@query("op13_fingerprint", SQL13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.edit_check(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
