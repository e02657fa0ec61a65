"""SQL with the same result, for queries on documents that SQL can express.

Written from the meaning of each query, not from its Spark plan. Learned models and
crc32 are not in the engine's SQL, so the queries that rest on them have none here;
their tests compare them with brute force.
"""

from __future__ import annotations

from tidepath.llm import divergence as rules

_SPACES = r"\x20\x09-\x0D"


def _many(text: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"length({text}) - length(regexp_replace({text}, '{quoted}', '', 'g'))"


def _classes(text: str) -> str:
    marked = [_many(text, p) for p in (rules.UPPER, rules.DIGITS, rules.MARKS, rules.SYMBOLS)]
    inner = _many(text, f"[^{_SPACES}]")
    rest = f"{inner} - " + " - ".join(f"({m})" for m in marked)
    cells = [*marked, rest, f"strlen({text}) - length({text})"]
    return ", ".join(f"{cell} AS c{i}" for i, cell in enumerate(cells))


_CELLS = range(rules.CLASSES)
_TERM = "CASE WHEN {x} > 0 THEN {x} * log2({x} / (({x} + {y}) / 2)) ELSE 0 END"


def _divergence(p: str, q: str) -> str:
    return f"({_TERM.format(x=p, y=q)} + {_TERM.format(x=q, y=p)}) / 2"


def _char_distance() -> str:
    own = "nullif(" + " + ".join(f"m.c{i}" for i in _CELLS) + ", 0)"
    other = "nullif(" + " + ".join(f"r.c{i}" for i in _CELLS) + ", 0)"
    parts = [_divergence(f"(m.c{i} / {own})", f"(r.c{i} / {other})") for i in _CELLS]
    return f"sqrt(greatest(0, {' + '.join(parts)}))"


QUALITY = f"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents
), m AS MATERIALIZED (
    SELECT *, regexp_extract_all(t, '[^{_SPACES}]+') AS words, {_classes("t")} FROM d
), n AS MATERIALIZED (SELECT *, len(words) AS n FROM m),
each AS MATERIALIZED (SELECT rid, lang, n, unnest(words) AS word FROM n),
counted AS MATERIALIZED (
    SELECT lang, word, count(*) AS n FROM each GROUP BY lang, word
), sized AS (
    SELECT lang, sum(n) AS n FROM counted GROUP BY lang HAVING sum(n) >= {rules.LEAST_REFERENCE_WORDS}
), named AS MATERIALIZED (
    SELECT lang, word, n, TRUE AS own FROM counted
    WHERE EXISTS (SELECT 1 FROM sized WHERE sized.lang IS NOT DISTINCT FROM counted.lang)
    UNION ALL SELECT NULL, word, sum(n), FALSE FROM counted GROUP BY word
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY own, lang ORDER BY n DESC, word) AS place FROM named
), chars AS MATERIALIZED (
    SELECT own, lang, sum(n) AS n, {", ".join(f"sum(n * c{i}) AS c{i}" for i in _CELLS)}
    FROM (SELECT own, lang, n, {_classes("word")} FROM named) GROUP BY own, lang
), top AS MATERIALIZED (
    SELECT own, lang, word, n FROM ranked WHERE place <= {rules.COMMON_WORDS}
), used AS MATERIALIZED (
    SELECT n.rid, n.n, n.lang IS NOT DISTINCT FROM s.lang AND s.n IS NOT NULL AS own,
           CASE WHEN s.n IS NOT NULL THEN n.lang END AS lang
    FROM n LEFT JOIN sized AS s ON s.lang IS NOT DISTINCT FROM n.lang
), docwords AS MATERIALIZED (SELECT rid, word, count(*) AS k FROM each GROUP BY rid, word),
cells AS MATERIALIZED (
    SELECT u.rid, u.n, coalesce(w.k, 0) AS k, top.n AS r
    FROM used AS u
    JOIN top ON top.own = u.own AND top.lang IS NOT DISTINCT FROM u.lang
    LEFT JOIN docwords AS w ON w.rid = u.rid AND w.word = top.word
), allcells AS (
    SELECT rid, n, k, r FROM cells
    UNION ALL
    SELECT c.rid, any_value(c.n), any_value(c.n) - sum(c.k), any_value(h.n) - sum(c.r)
    FROM cells AS c JOIN used AS u ON u.rid = c.rid
    JOIN chars AS h ON h.own = u.own AND h.lang IS NOT DISTINCT FROM u.lang
    GROUP BY c.rid
), shares AS (
    SELECT rid, k / n AS p, r / sum(r) OVER (PARTITION BY rid) AS q FROM allcells WHERE n > 0
), by_words AS MATERIALIZED (
    SELECT rid, sqrt(greatest(0, sum({_divergence("p", "q")}))) AS far, count(*) AS cells
    FROM shares GROUP BY rid
), by_chars AS MATERIALIZED (
    SELECT u.rid, {_char_distance()} AS far
    FROM used AS u JOIN n AS m ON m.rid = u.rid
    JOIN chars AS r ON r.own = u.own AND r.lang IS NOT DISTINCT FROM u.lang
), windows AS (
    SELECT rid, place, array_to_string(words[place:place + {rules.WINDOW - 1}], ' ') AS w
    FROM (SELECT rid, words, unnest(range(1, n - {rules.WINDOW - 2})) AS place FROM n)
), twice AS (
    SELECT rid, place, count(*) OVER (PARTITION BY rid, w) AS k FROM windows
), repeats AS MATERIALIZED (
    SELECT rid, count(DISTINCT word) AS k
    FROM (SELECT rid, unnest(range(place, place + {rules.WINDOW})) AS word FROM twice WHERE k > 1)
    GROUP BY rid
), measured AS (
    SELECT n.rid, n.doc_id, n.n AS n_words, length(array_to_string(words, '')) AS word_chars,
           n.c3 AS n_symbols,
           len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_SPACES}]')))
           - len(list_distinct(list_filter(string_split(t, chr(10)),
                                           lambda x: regexp_matches(x, '[^{_SPACES}]')))) AS n_dup_lines,
           coalesce(repeats.k, 0) AS n_repeat_words
    FROM n LEFT JOIN repeats ON repeats.rid = n.rid
), judged AS (
    SELECT measured.*,
           n_words < {rules.FEWEST_WORDS}
           OR 100 * n_repeat_words > {rules.MOST_REPEATED_PERCENT} * n_words AS base_failed,
           coalesce(word_chars >= {rules.LEAST_CHARS} AND c.far > {rules.FARTHEST_CHARS}
                    + sqrt({rules.CLASSES} / (8 * ln(2) * nullif(n_words, 0))), FALSE)
           OR coalesce(n_words >= {rules.LEAST_WORDS} AND w.far > {rules.FARTHEST_WORDS}
                       + sqrt(w.cells / (8 * ln(2) * nullif(n_words, 0))), FALSE) AS far
    FROM measured LEFT JOIN by_chars AS c ON c.rid = measured.rid
    LEFT JOIN by_words AS w ON w.rid = measured.rid
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR far) AS kept
FROM judged
"""

REPEATS = rf"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS turn,
           regexp_extract_all(coalesce(text, ''), '[^{_SPACES}]+') AS words
    FROM documents
), windows AS MATERIALIZED (
    SELECT rid, turn, place, array_to_string(words[place : place + 12], ' ') AS passage
    FROM (SELECT rid, turn, words, unnest(range(1, len(words) - 11)) AS place FROM d)
), firsts AS (
    SELECT passage, min(turn) AS first_turn FROM windows GROUP BY passage
), covered AS MATERIALIZED (
    SELECT DISTINCT rid, unnest(range(place, place + 13)) AS place
    FROM windows JOIN firsts USING (passage) WHERE turn > first_turn
), each AS (
    SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM d
), kept AS (
    SELECT rid, string_agg(word, ' ' ORDER BY place) AS words, count(*) AS n
    FROM each ANTI JOIN covered USING (rid, place) GROUP BY rid
)
SELECT doc_id, CAST(len(d.words) AS BIGINT) AS n_words,
       CAST(len(d.words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CONTAMINATION = f"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, doc_id,
           regexp_extract_all({_LOWER.format("text")}, '{_ALNUM}') AS words
    FROM documents
), items AS MATERIALIZED (
    SELECT item_id, words, least(len(words), 10) AS n FROM (
        SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '{_ALNUM}') AS words FROM benchmark
    ) WHERE len(words) > 0
), wanted AS MATERIALIZED (
    SELECT DISTINCT item_id, n, array_to_string(words[place : place + n - 1], ' ') AS passage
    FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS place FROM items)
), sizes AS (SELECT DISTINCT n FROM wanted),
starts AS (
    SELECT rid, words, n, unnest(range(1, len(words) - n + 2)) AS place
    FROM d JOIN sizes ON len(words) >= n
), windows AS (
    SELECT rid, n, place, array_to_string(words[place : place + n - 1], ' ') AS passage FROM starts
), found AS MATERIALIZED (
    SELECT rid, n, place, item_id FROM windows JOIN wanted USING (n, passage)
), hits AS (
    SELECT rid, count(DISTINCT place) AS n_hit
    FROM (SELECT rid, unnest(range(place, place + n)) AS place FROM found) GROUP BY rid
), owners AS (
    SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN owners USING (rid)
"""

ORACLE: dict[str, str] = {
    "op5_substring_dedup": REPEATS,
    "op10_decontamination": CONTAMINATION,
    "op13_quality_rules": QUALITY,
}
