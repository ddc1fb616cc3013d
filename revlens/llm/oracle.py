"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRING = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)
), windows AS (
  SELECT doc_id, pos, array_to_string(list(word) OVER ahead, ' ') AS words, count(*) OVER ahead AS n
  FROM w WINDOW ahead AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), later AS (
  SELECT doc_id, pos FROM windows WHERE n = 20
  QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, pos) > 1
), gone AS (
  SELECT DISTINCT doc_id, pos + unnest(range(20)) AS pos FROM later
), judged AS (
  SELECT w.doc_id, w.pos, w.word, g.pos IS NOT NULL AS removed FROM w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.pos = w.pos
), totals AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE removed) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT removed) AS kept
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN totals t ON t.doc_id = d.doc_id
"""

#: What each template's words are (sorted by name) and how many of its distinct words must be there.
_NOTICES = """
  ('apache', 'licensed under the apache license version 2 0'),
  ('bsd', 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met'),
  ('cc-by-nc', 'licensed under cc by nc 4 0'),
  ('cc-by-sa', 'licensed under cc by sa 4 0'),
  ('gpl', 'this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation'),
  ('isc', 'permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted'),
  ('mit', 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files'),
  ('mpl', 'this source code form is subject to the terms of the mozilla public license v 2 0'),
  ('unlicense', 'this is free and unencumbered software released into the public domain')
"""

LICENSES = (
    r"""
WITH low AS (SELECT doc_id, """
    + LOWER
    + r""" AS t FROM documents
), w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos
  FROM (SELECT doc_id, regexp_extract_all(t, '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM low)
), ahead AS (
  SELECT doc_id, pos, word, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2, lead(word, 3) OVER o AS w3
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), places AS (
  SELECT doc_id, pos, 'gpl' AS label FROM ahead WHERE word = 'gnu' AND w1 = 'general' AND w2 = 'public' AND w3 = 'license'
  UNION ALL SELECT doc_id, pos, 'apache' FROM ahead WHERE word = 'apache' AND w1 = 'license'
  UNION ALL SELECT doc_id, pos, 'cc-by' FROM ahead WHERE word = 'cc' AND w1 = 'by'
  UNION ALL SELECT doc_id, pos, 'mit' FROM ahead WHERE word = 'mit' AND w1 = 'license'
), base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places GROUP BY doc_id
), blocks AS (
  SELECT doc_id, list_distinct(regexp_extract_all(b, '[0-9a-z\x{80}-\x{10FFFF}]+')) AS words
  FROM (SELECT doc_id, unnest(regexp_split_to_array(t, '\n|[.!?;][ \t\n\x0B\f\r]')) AS b FROM low)
), templates AS (
  SELECT label, list_distinct(string_split(notice, ' ')) AS words FROM (VALUES """
    + _NOTICES
    + r""") AS v(label, notice)
), found AS (
  SELECT doc_id, label, len(list_intersect(t.words, b.words)) / len(t.words)::DOUBLE AS share
  FROM blocks b JOIN templates t ON len(list_intersect(t.words, b.words)) >= ceil(0.9 * len(t.words))
), labelled AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM found) GROUP BY doc_id
), best AS (SELECT doc_id, max(share) AS share FROM found GROUP BY doc_id
), sizes AS (SELECT doc_id, count(*) AS n_words FROM w GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n_words, 0) AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best.share, 0.0) END::DOUBLE AS score
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN base ON base.doc_id = d.doc_id
LEFT JOIN labelled l ON l.doc_id = d.doc_id LEFT JOIN best ON best.doc_id = d.doc_id
"""
)

JACCARD = (
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, len(ws) AS total
  FROM (SELECT doc_id, regexp_extract_all("""
    + LOWER
    + r""", '[^\x20\x09-\x0D]+') AS ws FROM documents)
), runs AS (
  SELECT doc_id, total, array_to_string(list(word) OVER ahead, ' ') AS shingle, count(*) OVER ahead AS n
  FROM w WINDOW ahead AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
), sets AS (
  SELECT DISTINCT doc_id, shingle FROM runs WHERE n = least(total, 5)
), sizes AS (
  SELECT doc_id, count(*) AS size FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 75 * (x.size + y.size - common)
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS seen FROM documents
  UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.seen
)
SELECT d.doc_id, coalesce(size, 0) AS n_shingles, (SELECT min(seen) FROM reach r WHERE r.doc_id = d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
)

DECONTAMINATE = (
    r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all("""
    + LOWER
    + r""", '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents)
), bw AS (
  SELECT item_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, len(ws) AS total
  FROM (SELECT item_id, regexp_extract_all("""
    + LOWER
    + r""", '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark)
), bwin AS (
  SELECT item_id, total, array_to_string(list(word) OVER ahead, ' ') AS words, count(*) OVER ahead AS n
  FROM bw WINDOW ahead AS (PARTITION BY item_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)
), items AS (
  SELECT DISTINCT item_id, words, n FROM bwin WHERE n = least(total, 10)
), lengths AS (SELECT DISTINCT n FROM items
), starts AS (
  SELECT doc_id, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten FROM w
), hits AS (
  SELECT s.doc_id, s.pos, i.item_id, i.n
  FROM (SELECT doc_id, pos, l.n, array_to_string(ten[1:l.n], ' ') AS words FROM starts JOIN lengths l ON len(ten) >= l.n) s
  JOIN items i ON i.words = s.words AND i.n = s.n
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, pos + unnest(range(n)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
), sizes AS (SELECT doc_id, count(*) AS n_words FROM w GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN hit_words h ON h.doc_id = d.doc_id LEFT JOIN hit_items i ON i.doc_id = d.doc_id
"""
)

ROTATE = r"""
WITH said AS (
  SELECT conv_id, turn, CASE WHEN role <> '' THEN role ELSE 'unknown' END AS speaker, coalesce(text, '') AS text FROM conversations
), people AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker NOT IN ('system', 'unknown')
), views AS (
  SELECT s.conv_id, p.perspective, s.turn, s.speaker, s.text,
    CASE WHEN s.speaker = p.perspective THEN 'assistant' WHEN s.speaker = 'system' THEN 'system' ELSE 'user' END AS role
  FROM said s JOIN people p ON p.conv_id IS NOT DISTINCT FROM s.conv_id
), headed AS (
  SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS header FROM views
), pieces AS (
  SELECT *, header || text || '<|im_end|>' || chr(10) AS rendered FROM headed
), placed AS (
  SELECT *, sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING) AS upto FROM pieces
)
SELECT conv_id, perspective, turn, speaker, role, rendered, (upto - length(rendered))::BIGINT AS start_char, upto::BIGINT AS end_char,
  CASE WHEN role = 'assistant' THEN upto - length(rendered) + length(header) END::BIGINT AS mask_start,
  CASE WHEN role = 'assistant' THEN upto - 1 END::BIGINT AS mask_end
FROM placed
"""

WARC = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS size, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (SELECT *, CASE WHEN size >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS least FROM p
), u AS (
  SELECT *, regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM f
), h AS (
  SELECT *, lower(regexp_extract(bare, '^(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, regexp_extract(bare, '^(?:[^/?#@]*@)?[^/?#:]*(?::([0-9]+))?', 1) AS port,
    lower(regexp_extract(bare, '^(?:[^/?#@]*@)?[^/?#:]*(?::[0-9]+)?([^#]*)', 1)) AS rest FROM u
)
SELECT page_id, size::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > least THEN least END AS refers_to,
  CASE WHEN host = '' AND rest = '' THEN '' ELSE
    array_to_string(list_reverse(string_split(regexp_replace(host, '^www\.', ''), '.')), ',') ||
    CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END END AS urlkey,
  strftime(TIMESTAMP '2020-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS ts
FROM h
"""


def _vector_codes(rounds: int = 4, entries: int = 256, parts: int = 4) -> str:
    """Rounds of assignment and means, each a step of its own, every distance computed."""
    nearest = """(SELECT x.vec_id, x.label, x.part, x.y, b.e,
      list_inner_product(x.y, x.y) + list_inner_product(b.c, b.c) - 2 * list_inner_product(x.y, b.c) AS d
    FROM x JOIN b{r} b ON b.part = x.part
    QUALIFY row_number() OVER (PARTITION BY x.part, x.vec_id ORDER BY d, b.e) = 1)"""
    steps = [f"""WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda z: floor(1024 * z::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0
), x AS (
  SELECT vec_id, label, p AS part, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS y FROM kept, range({parts}) AS parts(p)
), b0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, y AS c FROM x QUALIFY e < {entries}
)"""]
    for r in range(rounds):
        steps.append(f""", a{r} AS {nearest.format(r=r)}, m{r} AS (
  SELECT part, e, i, floor(sum(y[i]) / count(*)) AS m FROM (SELECT part, e, y, unnest(range(1, len(y) + 1)) AS i FROM a{r}) GROUP BY part, e, i
), b{r + 1} AS (
  SELECT b.part, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN (SELECT part, e, list(m ORDER BY i) AS c FROM m{r} GROUP BY part, e) m ON m.part = b.part AND m.e = b.e
)""")
    steps.append(f""", coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM {nearest.format(r=rounds)} GROUP BY vec_id
), book AS (
  SELECT sha256(string_agg(z::BIGINT::VARCHAR, ',' ORDER BY part, e, i)) AS sha FROM (SELECT part, e, unnest(c) AS z, generate_subscripts(c, 1) AS i FROM b{rounds})
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM coded, book""")
    return "".join(steps)


DIVERGENCE = (
    r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all("""
    + LOWER
    + r""", '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), t AS (SELECT r, lang, source, unnest(terms) AS term FROM d
), k AS (SELECT lang, term, count(*) AS of_lang FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), v AS (SELECT lang, count(*) AS v, sum(of_lang)::HUGEINT AS lang_total FROM k GROUP BY lang
), g AS (SELECT DISTINCT lang, source FROM d
), c AS (SELECT t.lang, source, t.term, count(*) AS n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL
), tot AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(tot.total, 0) + v.v) AS p,
    1 + (1000000000::HUGEINT * (k.of_lang + 1)) // (v.lang_total + v.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN tot ON tot.lang = g.lang AND tot.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), summed AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""
)

ORACLE = {
    "op2_substring_dedup": SUBSTRING,
    "op5_license_scan": LICENSES,
    "op6_jaccard_join": JACCARD,
    "op7_decontaminate": DECONTAMINATE,
    "op9_perspective_rotation": ROTATE,
    "op10_warc": WARC,
    "op11_vector_codes": _vector_codes(),
    "op12_source_divergence": DIVERGENCE,
}
