"""DuckDB SQL that must give the rows of the registered queries."""

from __future__ import annotations

from topictide.llm import quality_rules as rules

WORD = r"[^\x20\x09-\x0D]+"


def _text(pattern: str) -> str:
    return pattern.replace("'", "''")


OP1 = f"""
WITH lines AS (
  SELECT doc_id, i, list_extract(parts, i) AS line FROM (
    SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), measured AS (
  SELECT *, len(regexp_extract_all(line, '{WORD}')) AS n,
    length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars,
    len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
    len(regexp_extract_all(line, '[|»›>·•→]')) AS seps,
    len(regexp_extract_all(line, '{rules.EXCITED.pattern}')) AS excited
  FROM lines
), judged AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again,
    (n <= {rules.BOILERPLATE_MAX_WORDS} AND regexp_matches(line, '(?i){_text(rules.BOILERPLATE.pattern)}'))
    OR (seps >= 2 AND 3 * seps >= n) OR 4 * symbols > n OR 4 * excited > n
    OR NOT regexp_matches(line, '{_text(rules.SENTENCE_END.pattern)}') AS failed
  FROM measured WHERE n > 0
), by_doc AS (
  SELECT doc_id, sum(again::INT)::BIGINT AS n_dup_lines, count(*) AS n_lines, sum(failed::INT)::BIGINT AS n_failed_lines,
    sum(CASE WHEN failed THEN 0 ELSE chars END)::BIGINT AS kept_chars
  FROM judged GROUP BY doc_id
), words AS (
  SELECT doc_id, words, len(words) AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols
  FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents)
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS times
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM words)
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM windows WHERE times > 1) GROUP BY doc_id
), joined AS (
  SELECT w.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(kept_chars, 0) AS kept_chars
  FROM words w LEFT JOIN by_doc USING (doc_id) LEFT JOIN repeated USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * kept_chars >= {rules.KEPT_PERCENT} * word_chars AS kept
FROM joined
"""

OP5 = f"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents
), sets AS (
  SELECT n, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM words
), grams AS (
  SELECT n, len(s) AS size, unnest(s) AS g FROM sets
), shared_grams AS (
  SELECT a.n AS a, b.n AS b, a.size + b.size - count(*) AS whole, count(*) AS shared
  FROM grams a JOIN grams b ON a.g = b.g AND a.n < b.n GROUP BY a.n, b.n, a.size, b.size
), edges AS (
  SELECT a, b FROM shared_grams WHERE 100 * shared >= 90 * whole UNION SELECT b, a FROM shared_grams WHERE 100 * shared >= 90 * whole
), reach AS (
  SELECT n AS a, n AS b FROM sets UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.component_id
FROM sets s JOIN (SELECT r.a, min(t.doc_id) AS component_id FROM reach r JOIN sets t ON r.b = t.n GROUP BY r.a) m ON s.n = m.a
"""

OP6 = """
WITH placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM conversations
), whole AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY place) AS turns, count(*) AS n_turns FROM placed GROUP BY conv_id
), prefixes AS (
  SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM whole)
), maximal AS (
  SELECT min(conv_id) AS conv_id, n_turns, turns FROM whole
  WHERE turns NOT IN (SELECT turns FROM prefixes) GROUP BY n_turns, turns
), rendered AS (
  SELECT p.conv_id, (floor((place - 1) / 256))::INT AS part, n_turns, place,
    '<|' || coalesce(role, 'user') || '|>' || chr(10) || trim(coalesce(text, ''), ' ') || '<|end|>' || chr(10) AS line
  FROM placed p JOIN maximal m ON p.conv_id IS NOT DISTINCT FROM m.conv_id
)
SELECT conv_id, part, n_turns::BIGINT AS n_turns, string_agg(line, '' ORDER BY place) AS text
FROM rendered GROUP BY conv_id, part, n_turns
"""

OP7 = """
WITH RECURSIVE sizes AS (
  SELECT source, count(*) AS size, pow(count(*)::DOUBLE, 0.5) AS wish FROM documents GROUP BY source
), rates AS (
  SELECT source, wish / (SELECT sum(wish) FROM sizes) * (SELECT sum(size) FROM sizes) / size AS rate FROM sizes
), steps AS (
  SELECT source, rate, 0 AS k, -rate AS log, exp(-rate) AS total,
    ceil(rate + 9 * sqrt(rate) + 40)::INT AS last FROM rates
  UNION ALL
  SELECT source, rate, k + 1, log + ln(rate) - ln((k + 1)::DOUBLE), total + exp(log + ln(rate) - ln((k + 1)::DOUBLE)), last
  FROM steps WHERE k < last
), tables AS (
  SELECT source, list(total ORDER BY k) AS cdf FROM steps GROUP BY source
), drawn AS (
  SELECT d.*, cdf, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT *, len(list_filter(cdf, lambda c: c <= u))::BIGINT AS n_copies FROM drawn
)
SELECT doc_id, source, lang, n_chars, text, unnest(range(0, n_copies)) AS copy, n_copies FROM counted WHERE n_copies > 0
"""

OP9 = """
WITH vectors AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.n, q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.v, v.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors v ON q.n <> v.n AND len(q.v) = len(v.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored
) WHERE rank <= 5
"""

#: CRC-32 of a list of bytes: the table by its polynomial, then one step for each byte.
CRC_TABLE = """crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
)"""


def crc32_of(octets: str) -> str:
    return f"xor(list_reduce([4294967295::BIGINT] || {octets}, lambda c, b: xor(c >> 8, steps[((xor(c, b) & 255) + 1)])), 4294967295)"


#: UTF-8 bytes of letters up to U+00FF that are ASCII or at U+00C0 and beyond.
OCTETS = "flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x) - 64] END))"

OP11 = f"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents
), marked AS (
  SELECT run, {crc32_of(OCTETS.format("doc_id::VARCHAR || ':' || run"))} AS h FROM runs, crc WHERE length(run) >= 7
), words AS (
  SELECT word, count(*) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM marked
  ) WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), skipped AS (
  SELECT word, n, i, left(word, i) AS a, substr(word, i + 2) AS b FROM (SELECT *, unnest(range(0, length(word)))::INT AS i FROM words)
), pairs AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM skipped x JOIN skipped y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM skipped x JOIN words y ON x.a || x.b = y.word
  UNION SELECT y.word, x.word, x.n FROM skipped x JOIN words y ON x.a || x.b = y.word
), best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS best_n,
    first(near ORDER BY near_n DESC, near) AS near FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN near END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), ways AS (
  SELECT word, word AS root FROM forms UNION SELECT s.word, f.form FROM ways s JOIN forms f ON s.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, form, s.root, n, n_near, form_n FROM forms f
JOIN (SELECT s.word, s.root FROM ways s JOIN forms f ON s.root = f.word WHERE f.form IS NULL) s ON s.word = f.word
"""

OP12 = """
WITH RECURSIVE sound AS (
  SELECT row_number() OVER () AS n, vec_id, embedding::DOUBLE[] AS v FROM embeddings
), fit AS (
  SELECT * FROM sound WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), edges AS (
  SELECT a.n AS a, b.n AS b FROM fit a JOIN fit b ON a.n <> b.n AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)) >= 0.95
), reach AS (
  SELECT n AS a, n AS b FROM sound UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), parts AS (
  SELECT r.a, min(s.vec_id) AS component_id FROM reach r JOIN sound s ON r.b = s.n GROUP BY r.a
), degrees AS (
  SELECT a, count(*) AS n_links FROM edges GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM sound s JOIN parts p ON s.n = p.a LEFT JOIN degrees d ON s.n = d.a
"""

#: Levels of a tree that the SQL has; 16 to this power leaves of one source.
LEVELS = 6


def _tree(name: str, leaves: str) -> str:
    """Nodes of all levels of the trees of a table of tree, i, size and hash: n0, n1, ..."""
    parts = [f"{name}0 AS ({leaves})"]
    for level in range(LEVELS):
        parts.append(f"""{name}{level + 1} AS (
  SELECT tree, i // 16 AS i, any_value(size) AS size, sha256(string_agg(hash, '' ORDER BY i)) AS hash FROM {name}{level}
  WHERE size > {16**level} GROUP BY tree, i // 16)""")
    return ",\n".join(parts)


def _ends(name: str) -> str:
    return " UNION ALL ".join(f"SELECT tree, hash FROM {name}{level} WHERE size <= {16**level}" for level in range(LEVELS + 1))


def _ways(name: str, start: str) -> str:
    """proof (hex of siblings) and folded, level by level, of rows with tree, i, size, folded and proof."""
    parts = [f"{name}w0 AS ({start})"]
    for level in range(LEVELS):
        around = "coalesce((SELECT string_agg(hash, '' ORDER BY n.i) FROM {0}{1} n WHERE n.tree = w.tree AND n.i // 16 = w.i // 16 AND n.i {2} w.i), '')"
        before, after = around.format(name, level, "<"), around.format(name, level, ">")
        parts.append(f"""{name}w{level + 1} AS (
  SELECT w.* EXCLUDE (bef, aft) REPLACE (i // 16 AS i, CASE WHEN size > {16**level} THEN proof || bef || aft ELSE proof END AS proof,
    CASE WHEN size > {16**level} THEN sha256(bef || folded || aft) ELSE folded END AS folded)
  FROM (SELECT w.*, {before} AS bef, {after} AS aft FROM {name}w{level} w) w)""")
    return ",\n".join(parts)


def _leaf(text: str) -> str:
    parts = [f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
    return f"sha256({' || '.join(parts)})"


OP13 = f"""
WITH {CRC_TABLE}, docs AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf("text")} AS leaf,
    CASE WHEN {crc32_of("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 5 = 0
      THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered
  FROM documents, crc
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY tree) AS size FROM docs
), {_tree("n", "SELECT tree, i, size, leaf AS hash FROM leaves")},
subroots AS ({_ends("n")}),
{_tree("t", "SELECT 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS size, hash, tree AS source FROM subroots")},
{_ways("n", "SELECT doc_id, leaf, tree, i, size, coalesce(tampered, leaf) AS folded, '' AS proof FROM leaves")},
{_ways("t", f"SELECT w.doc_id, w.leaf, t.hash AS subroot, t.tree, t.i, t.size, w.folded, w.proof FROM nw{LEVELS} w JOIN t0 t ON t.source = w.tree")},
root AS ({_ends("t")})
SELECT doc_id, leaf, subroot, hash AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = hash AS verified
FROM tw{LEVELS}, root
"""

ORACLES = {
    "op1_quality_rules": OP1, "op5_ngram_jaccard_join": OP5, "op9_exact_search": OP9, "op6_chat_formatting": OP6, "op7_mixing_sources": OP7,
    "op11_spelling_variants": OP11, "op12_vector_near_dedup": OP12, "op13_merkle_manifest": OP13,
}
