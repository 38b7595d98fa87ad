"""DuckDB SQL for the queries that SQL can express. The others are tested against brute force in tests/llm."""

from __future__ import annotations

from . import quality_rules as q
from .common import WORD

_WORDS = f"regexp_extract_all(text, '{WORD}')"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _jensen_shannon(shares: list[str], reference: list[float]) -> str:
    parts = []
    for p, r in zip(shares, reference):
        r_ = f"{r!r}::DOUBLE"
        own = f"CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {r_}) / 2)) ELSE 0 END"
        parts.append(own + (f" + {r_} * log2({r_} / (({p} + {r_}) / 2))" if r > 0 else ""))
    return f"sqrt(greatest(0.0, ({' + '.join(parts)}) / 2))"


def _quality() -> str:
    bins = q.word_bins(q.WORD_REFERENCES)
    forms = ", ".join(map(_quote, q.spellings(bins)))
    counts = ", ".join(f"len(list_filter(common, lambda x: x = {_quote(w)})) AS b{i}" for i, w in enumerate(bins))
    count = lambda rx: f"len(regexp_extract_all(t, {_quote(rx)}))"
    shares = ["up / len", "(len - word_chars) / len", "pt / len", "n_symbols / len", "(word_chars - up - pt - n_symbols) / len"]
    langs = []
    for words in q.WORD_REFERENCES.values():
        cs = [f"b{bins.index(w)}" for w in words]
        langs.append(_jensen_shannon([*(f"{c} / n_words" for c in cs), f"(n_words - ({' + '.join(cs)})) / n_words"], [*words.values(), 1 - sum(words.values())]))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines,
  length(t)::DOUBLE AS len, {count(q.UPPER)} AS up, {count(q.POINT)} AS pt, {count(q.SYMBOL)}::BIGINT AS n_symbols FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM a WHERE len(w) >= 3)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
b AS (SELECT a.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len, up, pt,
  list_transform(list_filter(w, lambda x: x IN ({forms})), lambda x: lower(rtrim(x, {_quote(q.MARKS)}))) AS common
  FROM a LEFT JOIN c ON a.doc_id = c.doc_id),
e AS (SELECT * EXCLUDE (common), {counts}, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM b),
f AS (SELECT *, CASE WHEN len >= {q.MIN_CHARS} THEN {_jensen_shannon(shares, list(q.CLASS_REFERENCE))} END AS cd,
  CASE WHEN n_words >= {q.MIN_WORDS} THEN least({', '.join(langs)}) END AS wd FROM e)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND coalesce(cd, 0) <= {q.MAX_CLASS_DISTANCE} AND coalesce(wd, 0) <= {q.MAX_WORD_DISTANCE}) AS kept FROM f"""


ORACLES: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, url, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, coalesce(url, '') AS url FROM f""",
    "op3_quality_rules": _quality(),
    "op7_mixing": f"""
WITH d AS (SELECT doc_id, source, coalesce(len({_WORDS}), 0)::BIGINT AS size, md5('0:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * n / w, source NULLS LAST) AS k FROM s WHERE n > 0),
u AS (SELECT *, (sum(n) OVER () - coalesce(sum(3 * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS unit FROM o),
v AS (SELECT unit FROM u WHERE unit * w <= 3 * n ORDER BY k LIMIT 1),
t AS (SELECT source, n, CASE WHEN n = 0 THEN 0.0 ELSE least(3.0 * n, w * (SELECT unit FROM v)) END::DOUBLE AS target FROM s),
p AS (SELECT d.doc_id, size, n AS source_size, round(target, 6) AS target, floor(target + 0.5) AS quota,
  sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size + size / 2.0 AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * ((middle < quota)::INT + (source_size + middle < quota)::INT + (2 * source_size + middle < quota)::INT))::BIGINT AS taken FROM p""",
}
