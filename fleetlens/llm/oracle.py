"""DuckDB counterparts of the queries that SQL can express over whole tables."""

from __future__ import annotations

from fleetlens.llm.quality_rules import MEASURES, MIN_DOCS, REACH, WINDOW

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _bucket(value: str) -> str:
    drop = f"greatest(length(ltrim(bin({value}), '0')) - 8, 0)"
    return f"(({value}) >> ({drop})) << ({drop})"


def _quartiles(keys: str) -> str:
    group = f"{keys}, measure" if keys else "measure"
    by = f"{group}, part"
    return f"""
    SELECT {group}, max(total) AS n,
           min(CASE WHEN up_to * 4 >= total AND part = 'value' THEN bucket END) AS q1,
           min(CASE WHEN up_to * 4 >= total * 3 AND part = 'value' THEN bucket END) AS q3,
           min(CASE WHEN up_to * 4 >= total * 2 AND part = 'step' THEN bucket END) AS step
    FROM (SELECT {by}, bucket, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS up_to,
                 sum(n) OVER (PARTITION BY {by}) AS total
          FROM (SELECT {by}, bucket, sum(n) AS n FROM sketch GROUP BY {by}, bucket))
    GROUP BY {group}"""


_VALUES = {
    "word_length": (
        "word_chars * 1000 // greatest(n_words, 1)",
        "floor(sqrt(word_chars) * 1000 / greatest(n_words, 1))::BIGINT",
    ),
    "symbol_share": ("n_symbols * 1000 // greatest(word_chars, 1)", "1000 // greatest(word_chars, 1)"),
    "line_repeats": ("n_dup_lines * 1000 // greatest(n_lines, 1)", "1000 // greatest(n_lines, 1)"),
    "word_repeats": (
        "n_repeat_words * 1000 // greatest(n_words, 1)",
        f"{2 * WINDOW * 1000} // greatest(n_words, 1)",
    ),
}
_SIDES = ", ".join(f"('{name}', {str(low).lower()})" for name, low in MEASURES.items())


def _picked(name: str) -> str:
    return (
        f"CASE WHEN o.n >= {MIN_DOCS} THEN o.{name} WHEN p.n >= {MIN_DOCS} THEN p.{name} "
        f"ELSE q.{name} END"
    )


QUALITY = rf"""
WITH split AS MATERIALIZED (
    SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)),
                       lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM documents),
windows AS MATERIALIZED (
    SELECT doc_id, i, md5(array_to_string(w[i:i + 7], ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM split WHERE len(w) > 8)),
repeated AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
    FROM (SELECT doc_id, i FROM windows
          QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1), range(0, 8) r(k)
    GROUP BY doc_id),
counted AS MATERIALIZED (
    SELECT s.doc_id, lang, source, len(w)::BIGINT AS n_words,
           length(array_to_string(w, ''))::BIGINT AS word_chars,
           (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           len(l)::BIGINT AS n_lines,
           (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
           coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM split s LEFT JOIN repeated r ON s.doc_id = r.doc_id),
measured AS MATERIALIZED (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted),
long_form AS (
    {" UNION ALL ".join(
        f"SELECT doc_id, lang, source, base_failed, '{name}' AS measure, {value} AS value, "
        f"{step} AS step FROM measured" for name, (value, step) in _VALUES.items())}),
sketch AS MATERIALIZED (
    SELECT lang, source, measure, part, {_bucket("v")} AS bucket, count(*) AS n
    FROM (SELECT lang, source, measure, 'value' AS part, value AS v
          FROM long_form WHERE NOT base_failed
          UNION ALL
          SELECT lang, source, measure, 'step', step FROM long_form WHERE NOT base_failed)
    GROUP BY ALL),
own AS ({_quartiles("lang, source")}),
of_lang AS ({_quartiles("lang")}),
of_all AS ({_quartiles("")}),
chosen AS (
    SELECT o.lang, o.source, o.measure,
           {_picked("q1")} AS q1, {_picked("q3")} AS q3,
           greatest({_picked("step")}, 1)::DOUBLE AS step
    FROM own o
    JOIN of_lang p ON o.measure = p.measure AND o.lang IS NOT DISTINCT FROM p.lang
    JOIN of_all q ON o.measure = q.measure),
limits AS (
    SELECT c.*, CASE WHEN low THEN q1 - greatest(q3 - q1, step) * {REACH} ELSE 0 END AS lo,
           q3 + greatest(q3 - q1, step) * {REACH} AS hi
    FROM chosen c JOIN (VALUES {_SIDES}) s(measure, low) ON c.measure = s.measure),
failed AS (
    SELECT doc_id, string_agg(f.measure, ',' ORDER BY f.measure) AS failed_measures
    FROM long_form f JOIN limits t ON f.measure = t.measure
         AND f.lang IS NOT DISTINCT FROM t.lang AND f.source IS NOT DISTINCT FROM t.source
    WHERE f.value < lo OR f.value > hi GROUP BY doc_id)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_measures IS NULL AS kept,
       coalesce(failed_measures, '') AS failed_measures
FROM measured m LEFT JOIN failed f ON m.doc_id = f.doc_id"""

TOP_K = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id, score
FROM scored QUALIFY rank <= 20"""

MIXING = rf"""
WITH sized AS MATERIALIZED (
    SELECT doc_id, source, len({WORDS})::BIGINT AS size,
           md5('mix-1:' || doc_id || ':' || md5(coalesce(text, ''))) AS key
    FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
    SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
           source_size * 2.0::DOUBLE AS room, sum(source_size) OVER () * 1.5::DOUBLE AS budget
    FROM totals),
marked AS (
    SELECT *, room * sum(weight) OVER later <=
              weight * (budget - coalesce(sum(room) OVER before, 0)) AS filled
    FROM weighted
    WINDOW before AS (ORDER BY room / weight, source NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           later AS (ORDER BY room / weight, source NULLS LAST
                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
aims AS (
    SELECT source, source_size,
           CASE WHEN filled THEN room ELSE
                weight * (budget - sum(CASE WHEN filled THEN room ELSE 0 END) OVER ())
                / sum(CASE WHEN filled THEN 0 ELSE weight END) OVER () END::DOUBLE AS target
    FROM marked),
epochs AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS e
    FROM aims),
placed AS (
    SELECT s.*, t.source_size, t.target, e, round(target - e * t.source_size)::BIGINT AS rest,
           coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM sized s JOIN epochs t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       (e * size + least(greatest(rest - before, 0), size))::BIGINT AS taken
FROM placed"""

JACCARD = rf"""
WITH RECURSIVE words AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents),
shingled AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
          FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
links AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n
    HAVING count(*) * 10 >= 8 * (x.n + y.n - count(*))),
reached(a, b) AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
classes AS (SELECT a, min(b) AS least FROM reached GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(c.least, d.doc_id)) AS class_id,
       (SELECT count(*) FROM links l WHERE l.a = d.doc_id)::BIGINT AS n_links
FROM documents d LEFT JOIN classes c ON c.a = d.doc_id"""

ORACLE: dict[str, str] = {
    "op1_quality_rules": QUALITY,
    "op2_topk_search": TOP_K,
    "op8_mixing": MIXING,
    "op9_jaccard_join": JACCARD,
}
