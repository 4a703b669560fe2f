"""DuckDB twins of the operators that SQL can express beside their own modules."""

from __future__ import annotations

from . import quality, secrets


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _spans(kind: int, pattern: str, keep: str = "true") -> str:
    """Matches with code-point offsets: gaps and matches of one pattern alternate."""
    re = _quoted(pattern)
    return f"""
SELECT r, {kind} AS kind, s AS start, s + length(m) AS stop, m FROM (
  SELECT r, m, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT r, found, gaps, unnest(found) AS m, generate_subscripts(found, 1) AS i
        FROM (SELECT r, regexp_extract_all(t, {re}) AS found, regexp_split_to_array(t, {re}) AS gaps FROM docs WHERE regexp_matches(t, {re}))))
WHERE {keep}"""


def op3_sql() -> str:
    allow = " OR ".join(f"regexp_matches(m, {_quoted(p)})" for p in secrets.ALLOW)
    w = secrets.WINDOW
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_spans(0, secrets.ASSIGN, f"length(regexp_extract(m, {_quoted(secrets.ASSIGN)}, 2)) >= {secrets.ASSIGN_LEAST}")}
  UNION ALL {_spans(1, secrets.ACCESS, f"length(m) >= {secrets.ACCESS_LEAST}")}
  UNION ALL {_spans(2, secrets.HEX)}),
runs AS ({_spans(3, "[A-Za-z0-9+/_=-]{20,}", "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')")}),
free AS (SELECT * FROM runs c WHERE NOT ({allow})
         AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = c.r AND b.start < c.stop AND c.start < b.stop)),
windows AS (SELECT r, start, i, unnest(string_split(substr(m, i, {w}), '')) AS c
            FROM (SELECT *, unnest(range(1, length(m) - {w - 2})) AS i FROM free)),
bits AS (SELECT r, start, max(h) AS h FROM (
  SELECT r, start, i, log2({w}) - sum(n * log2(n)) / {w} AS h
  FROM (SELECT r, start, i, c, count(*) AS n FROM windows GROUP BY ALL) GROUP BY ALL) GROUP BY ALL),
added AS (SELECT f.r, f.kind, f.start, f.stop, f.m FROM free f JOIN bits b ON b.r = f.r AND b.start = f.start
          WHERE b.h > CASE WHEN regexp_matches(m, '^([0-9a-f]+|[0-9A-F]+)$') THEN {secrets.HEX_BITS}
                           WHEN regexp_matches(m, '^[A-Za-z0-9]+$') THEN {secrets.ALNUM_BITS} ELSE {secrets.TOKEN_BITS} END),
named AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || start || ':' || stop AS s
          FROM (SELECT * FROM base UNION ALL SELECT * FROM added)),
summed AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS k, count(*) FILTER (WHERE kind = 2) AS h,
                  coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (WHERE kind < 3), '') AS base, string_agg(s, ',' ORDER BY start, kind) AS spans
           FROM named GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN summed USING (r)"""


def op8_sql() -> str:
    k = quality.REPEAT_WINDOW
    rules = {"failed_base": f"n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words",
             "failed_symbols": f"100 * n_symbols > {quality.SYMBOL_PERCENT} * word_chars",
             "failed_lines": f"100 * n_dup_lines > {quality.LINE_PERCENT} * n_lines"}
    per_host = ", ".join(f"sum(cast({r} AS int)) AS {r}" for r in rules)
    prior = ", ".join(f"avg({r} / n) AS {r}_m, var_pop({r} / n) AS {r}_v" for r in rules)

    def shrunk(r: str) -> str:
        strength = f"CASE WHEN {r}_v > 0 THEN least(greatest({r}_m * (1 - {r}_m) / {r}_v - 1, 1.0), 1e6) ELSE 1e6 END"
        return f"({r} + {r}_m * ({strength})) / (n + ({strength}))"

    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
split AS (SELECT r, doc_id, source, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM docs),
grams AS (SELECT r, i, array_to_string(list_slice(w, i, i + {k - 1}), ' ') AS g
          FROM (SELECT r, w, unnest(range(1, len(w) - {k - 2})) AS i FROM split WHERE len(w) >= {k})),
again AS (SELECT r, g FROM grams GROUP BY r, g HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + {k})) AS j FROM grams SEMI JOIN again USING (r, g)) GROUP BY r),
counted AS (SELECT r, doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                   (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l) AS n_lines,
                   (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
            FROM split LEFT JOIN covered c USING (r)),
judged AS (SELECT *, {', '.join(f'{test} AS {r}' for r, test in rules.items())} FROM counted),
hosts AS (SELECT source, count(*) AS n, {per_host} FROM judged WHERE source IS NOT NULL GROUP BY source),
prior AS (SELECT {prior} FROM hosts),
verdicts AS (SELECT source, greatest({', '.join(shrunk(r) for r in rules)}) >= {quality.HOST_LIMIT} AS rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_base AS base_failed,
       NOT failed_base AND NOT coalesce(rejected, false) AS kept, coalesce(rejected, false) AS host_rejected
FROM judged LEFT JOIN verdicts USING (source)"""
