"""DuckDB SQL of the corpus operators whose results plain SQL can express, written apart from their method:
order statistics instead of sketches, units as text instead of digests, windows instead of suffix arrays."""

from __future__ import annotations

from refrank.llm.lines import MARKS, WIDE_MARKS
from refrank.llm.lines import MIN_CHARS as LINE_CHARS
from refrank.llm.lines import MIN_WORDS as LINE_WORDS
from refrank.llm.rules import MAX_REPEAT_PERCENT, MIN_ROWS, MIN_WORDS, RATES, REACH
from refrank.llm.suffixes import LENGTH

# White space of the line operator, word and symbol classes of the rules.
BLANKS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

LINES = rf"""
WITH docs AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT 'l' AS kind, doc_id, text, string_split(regexp_replace(text, '(\n)', '\1' || chr(1), 'g'), chr(1)) AS parts FROM docs
        UNION ALL SELECT 'c', doc_id, text, string_split(regexp_replace(text,
          '([{MARKS}]+{BLANKS}|[{WIDE_MARKS}]+{BLANKS.rstrip("+")}*)', '\1' || chr(1), 'g'), chr(1)) FROM docs),
nth AS (SELECT kind, doc_id, text, parts, unnest(range(1, len(parts) + 1)) AS k FROM cut),
placed AS (SELECT kind, doc_id, text, k, (sum(length(parts[k])) OVER (PARTITION BY kind, doc_id, text ORDER BY k))::BIGINT - length(parts[k]) AS start,
                trim(regexp_replace(lower(parts[k]), '{BLANKS}', ' ', 'g'), ' ') AS p FROM nth),
piece AS (SELECT kind, doc_id, text, start, p, row_number() OVER own AS i, coalesce(lead(start) OVER own, length(text)) AS stop,
                 sum(len(string_split(p, ' '))) OVER own AS words, sum(length(p)) OVER own AS chars,
                 len(string_split(p, ' ')) AS w, length(p) AS c
          FROM placed WHERE p <> '' WINDOW own AS (PARTITION BY kind, doc_id, text ORDER BY k)),
reach AS (SELECT a.kind, a.doc_id, a.text, a.i, a.start, min(b.i) AS j
          FROM piece a JOIN piece b ON a.kind = b.kind AND a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.text = b.text
            AND b.i BETWEEN a.i AND a.i + {LINE_WORDS}
          WHERE b.words - a.words + a.w >= {LINE_WORDS} OR b.chars - a.chars + a.c >= {LINE_CHARS}
          GROUP BY a.kind, a.doc_id, a.text, a.i, a.start),
unit AS (SELECT r.kind, r.doc_id, r.text, r.start, max(b.stop) AS stop, string_agg(b.p, ' ' ORDER BY b.i) AS unit
         FROM reach r JOIN piece b ON r.kind = b.kind AND r.doc_id IS NOT DISTINCT FROM b.doc_id AND r.text = b.text
           AND b.i BETWEEN r.i AND r.j GROUP BY r.kind, r.doc_id, r.text, r.i, r.start),
judged AS (SELECT *, row_number() OVER (PARTITION BY kind, unit
                     ORDER BY doc_id NULLS LAST, md5(coalesce(doc_id::VARCHAR, 'null') || ':' || text), start) > 1 AS gone FROM unit),
spans AS (SELECT *, max(stop) OVER (PARTITION BY doc_id, text ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
          FROM judged WHERE gone),
islands AS (SELECT *, sum(CASE WHEN before >= start THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, text ORDER BY start, stop) AS n FROM spans),
merged AS (SELECT doc_id, text, n, min(start) AS start, max(stop) AS stop FROM islands GROUP BY doc_id, text, n),
kept AS (SELECT *, substr(text, coalesce(lag(stop) OVER own, 0) + 1, start - coalesce(lag(stop) OVER own, 0)) AS rest,
                lead(start) OVER own IS NULL AS last FROM merged WINDOW own AS (PARTITION BY doc_id, text ORDER BY start)),
done AS (SELECT doc_id, text, sum(stop - start) AS n_removed, count(*) AS n_spans,
                list({{'start': start::INTEGER, 'stop': stop::INTEGER}} ORDER BY start) AS removed,
                string_agg(rest || CASE WHEN last THEN substr(text, stop + 1) ELSE '' END, '' ORDER BY start) AS rest
         FROM kept GROUP BY doc_id, text)
SELECT d.doc_id, length(coalesce(d.text, '')) AS n_chars, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       coalesce(to_json(removed)::VARCHAR, '[]') AS removed, coalesce(rest, d.text, '') AS text
FROM documents d LEFT JOIN done ON d.doc_id IS NOT DISTINCT FROM done.doc_id AND coalesce(d.text, '') = done.text
"""

SUFFIXES = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS body FROM documents),
block AS (SELECT r, doc_id, regexp_extract_all(hex(body), '.{{1,{2 * LENGTH}}}') AS parts FROM docs),
pair AS (SELECT r, doc_id, k, parts[k + 1] AS own, parts[k + 1] || coalesce(parts[k + 2], '') AS wide
         FROM (SELECT r, doc_id, parts, unnest(range(len(parts))) AS k FROM block)),
spot AS (SELECT r, doc_id, k * {LENGTH} + j AS pos, substr(wide, 2 * j + 1, 2) AS byte, substr(wide, 2 * j + 1, {2 * LENGTH}) AS w
       FROM (SELECT *, unnest(range(length(own) // 2)) AS j FROM pair)),
first AS (SELECT w, min(doc_id) AS least FROM spot WHERE length(w) = {2 * LENGTH} GROUP BY w),
starts AS (SELECT r, pos, byte, coalesce(least < doc_id, false) AS again FROM spot LEFT JOIN first USING (w)),
covered AS (SELECT r, pos, byte, coalesce(max(CASE WHEN again THEN pos END) OVER (PARTITION BY r ORDER BY pos) > pos - {LENGTH}, false) AS gone
            FROM starts),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY pos), false) AS opens FROM covered),
done AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
                string_agg(byte, '' ORDER BY pos) FILTER (NOT gone) AS rest FROM runs GROUP BY r)
SELECT doc_id, octet_length(body)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(rest, ''))) AS kept_sha256
FROM docs LEFT JOIN done USING (r)
"""


# A-Z and their lower case, for engines that lower-case more than those.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD = rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id,
       regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
gram AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM docs),
size AS (SELECT r, count(*) AS n FROM gram GROUP BY r),
sized AS (SELECT r, s, n FROM gram JOIN size USING (r)),
pair AS (SELECT a.r AS a, b.r AS b, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS common
         FROM sized a JOIN sized b ON a.s = b.s AND a.r < b.r AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.r, b.r),
link AS (SELECT a, b FROM pair WHERE 100 * common >= 90 * (m + n - common)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(r, other) AS (SELECT r, r FROM docs UNION SELECT reach.r, b FROM reach JOIN both_ways ON other = a),
least AS (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN docs ON docs.r = other GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM docs JOIN least USING (r) LEFT JOIN size USING (r)
"""

NEGATIVES = """
WITH part AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                     list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
              FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
score AS (SELECT a.vec_id AS anchor_id, r.vec_id AS other, a.label = r.label AS same, list_inner_product(a.q, r.q)::BIGINT AS s
          FROM part a JOIN part r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positive AS (SELECT anchor_id, other AS positive_id, s AS positive_score FROM score WHERE same
             QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, other)::INTEGER AS rank,
       other AS negative_id, positive_score, s AS negative_score
FROM positive JOIN score USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * s AND 100 * s <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, other) <= 5
"""

RANKED = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id,
       regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]+') AS t FROM documents),
item AS (SELECT row_number() OVER () AS i, item_id,
       regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]+') AS t FROM benchmark),
whole AS (SELECT count(*) AS total, sum(len(t))::BIGINT AS length FROM docs WHERE len(t) > 0),
held AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM docs) GROUP BY r, term),
weight AS (SELECT term, floor(1000 * ln((2 * total + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held, whole GROUP BY term, total),
sized AS (SELECT r, doc_id, 100 - 25 + ((25 * len(t)::BIGINT * total) // length) AS m FROM docs, whole WHERE len(t) > 0),
asked AS (SELECT i, unnest(t) AS term FROM item),
score AS (SELECT i, r, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
          FROM asked JOIN weight USING (term) JOIN held USING (term) JOIN sized USING (r) GROUP BY i, r),
best AS (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS rank
         FROM score JOIN sized USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM best JOIN item USING (i) WHERE rank <= 20
"""


def _rules() -> str:
    fences = "\n".join(
        f"""{r}_own AS (SELECT lang, source, count(*) AS total, {_quartiles(r)} FROM good GROUP BY lang, source),
{r}_lang AS (SELECT lang, count(*) AS total, {_quartiles(r)} FROM good GROUP BY lang),
{r}_all AS (SELECT {_quartiles(r)} FROM good),
{r}_q AS (SELECT o.lang, o.source, CASE WHEN o.total >= {MIN_ROWS} THEN [o.q1, o.q3] WHEN l.total >= {MIN_ROWS} THEN [l.q1, l.q3] ELSE [e.q1, e.q3] END AS q
  FROM {r}_own o JOIN {r}_lang l ON o.lang IS NOT DISTINCT FROM l.lang CROSS JOIN {r}_all e),
{r}_fence AS (SELECT lang, source, {"q[1] - " + _spread(r) if r == "word_length" else "0"} AS low, q[2] + {_spread(r)} AS high FROM {r}_q),"""
        for r in RATES
    )
    joins = "\n".join(
        f"LEFT JOIN {r}_fence {r}_f ON s.lang IS NOT DISTINCT FROM {r}_f.lang AND s.source IS NOT DISTINCT FROM {r}_f.source"
        for r in RATES
    )
    inside = " AND ".join(f"coalesce(s.{r} BETWEEN {r}_f.low AND {r}_f.high, true)" for r in RATES)
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
parts AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM docs),
word AS (SELECT r, words[i] AS a, i FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM parts)),
three AS (SELECT r, i, a, lead(a, 1) OVER p AS b, lead(a, 2) OVER p AS c FROM word WINDOW p AS (PARTITION BY r ORDER BY i)),
often AS (SELECT r, i, c IS NOT NULL AND count(*) OVER (PARTITION BY r, a, b, c) > 1 AS again FROM three),
inside AS (SELECT r, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS within FROM often),
repeated AS (SELECT r, count(*) FILTER (within) AS n_repeat_words FROM inside GROUP BY r),
counts AS (SELECT r, doc_id, lang, source, len(words)::BIGINT AS n_words,
                  coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
                  len(regexp_extract_all(text, '{SYMBOL}'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
                  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
           FROM parts LEFT JOIN repeated USING (r)),
stats AS (SELECT *, least(1000 * n_symbols // greatest(n_words, 1), 1000) AS symbol_rate,
                 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_rate,
                 1000 * n_repeat_words // greatest(n_words, 1) AS repeat_rate,
                 least(100 * word_chars // greatest(n_words, 1), 5000) AS word_length,
                 n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts),
good AS (SELECT * FROM stats WHERE NOT base_failed),
{fences.rstrip(",")}
SELECT s.doc_id, s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, s.base_failed,
       NOT s.base_failed AND {inside} AS kept, {", ".join("s." + r for r in RATES)}
FROM stats s
{joins}
"""


def _quartiles(rate: str) -> str:
    return ", ".join(f"list_sort(list({rate}))[(count(*) * {q} + 3) // 4] AS q{q}" for q in (1, 3))


def _spread(rate: str) -> str:
    return f"{REACH} * greatest(q[2] - q[1], {RATES[rate][1]})"


ORACLE = {
    "op3_lines": LINES,
    "op6_suffixes": SUFFIXES,
    "op8_rules": _rules(),
    "op11_jaccard": JACCARD,
    "op12_negatives": NEGATIVES,
    "op13_ranked": RANKED,
}
