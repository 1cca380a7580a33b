"""SQL equivalents of the operators that SQL can express."""

from __future__ import annotations

from seasonloom.llm import rules

_WORD = "[^\\x20\\x09-\\x0D]+"

_LEDGER = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, p, w, lead(w, 1) OVER d AS w1, lead(w, 2) OVER d AS w2
  FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p
        FROM (SELECT doc_id, regexp_extract_all(t, '{_WORD}') AS ws FROM d))
  WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
g AS (
  SELECT *, (w2 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w1, w2) > 1)::int AS r FROM w),
c AS (
  SELECT doc_id, w, greatest(r, coalesce(lag(r, 1) OVER d, 0), coalesce(lag(r, 2) OVER d, 0)) AS hit
  FROM g WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
words AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, sum(hit) AS n_repeat_words FROM c GROUP BY 1),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
measured AS (
  SELECT doc_id, coalesce(n_words, 0)::bigint AS n_words, coalesce(word_chars, 0)::bigint AS word_chars,
    length(regexp_replace(t, '[^{rules.SYMBOLS}]', '', 'g'))::bigint AS n_symbols,
    length(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint AS n_upper,
    coalesce(n_lines, 0)::bigint AS n_lines, coalesce(n_dup_lines, 0)::bigint AS n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint AS n_repeat_words
  FROM d LEFT JOIN words USING (doc_id) LEFT JOIN lines USING (doc_id)),
ledger AS (
  SELECT *, ({" + ".join(f"CASE WHEN {r} THEN {1 << k} ELSE 0 END" for k, r in enumerate(rules.RULES.values()))})::bigint
    AS fail_bits FROM measured)
"""

QUALITY_RULES = f"""{_LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & {rules.mask(rules.BASE)}) <> 0 AS base_failed,
  (fail_bits & {rules.mask(rules.POLICIES["v2"])}) = 0 AS kept, fail_bits
FROM ledger"""

_POLICY_ROWS = ", ".join(
    f"('{p}', '{r}', {rules.mask(names)}, {rules.mask([r])})" for p, names in rules.POLICIES.items() for r in names
)

RULE_ABLATIONS = f"""{_LEDGER}, p(policy, rule, all_bits, bit) AS (VALUES {_POLICY_ROWS})
SELECT policy, rule, count(*)::bigint AS n_docs,
  count(*) FILTER (fail_bits & all_bits = 0)::bigint AS n_kept,
  count(*) FILTER (fail_bits & all_bits & ~bit = 0)::bigint AS n_kept_without,
  count(*) FILTER (fail_bits & all_bits = bit)::bigint AS n_only
FROM ledger, p GROUP BY 1, 2"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SHARE = "1 + (1000000000::hugeint * ({n} + 1)) // greatest({total} + v, 1)"

SOURCE_DIVERGENCE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
l AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY 1),
g AS (
  SELECT lang, source, coalesce(max(v), 0) AS v, coalesce(max(lang_total), 0) AS lang_total, coalesce(sum(n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN l USING (lang) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, {_SHARE.format(n="coalesce(n, 0)", total="total")} AS p,
    {_SHARE.format(n="lang_n", total="lang_total")} AS q
  FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(sum((a.p - b.p) * (a.p - b.p) // b.p), 0)::bigint AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN p a ON a.lang = g.lang AND a.source = g.source
  LEFT JOIN p b ON b.lang = h.lang AND b.source = h.source AND b.term = a.term
  WHERE a.term IS NULL OR b.term IS NOT NULL GROUP BY 1, 2, 4),
term AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::bigint AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::int AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
      FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
WHERE part = 'pair' OR rank <= 200"""


def statements() -> dict[str, str]:
    return {
        "op2_quality_rules": QUALITY_RULES,
        "rule_ablations": RULE_ABLATIONS,
        "op13_source_divergence": SOURCE_DIVERGENCE,
    }
