"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import byte_bpe, divergence, html_extract, langid, licenses, mixing, nn_descent, ogg, packing, quality, simhash, spelling, substring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1_mixing,
    "op2_packing": packing.op2_packing,
    "op3_langid": langid.op3_langid,
    "op4_nn_descent": nn_descent.op4_nn_descent,
    "op5_substring": substring.op5_substring,
    "op6_ogg": ogg.op6_ogg,
    "op7_simhash": simhash.op7_simhash,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_html": html_extract.op9_html,
    "op10_licenses": licenses.op10_licenses,
    "op11_quality": quality.op11_quality,
    "op12_spelling": spelling.op12_spelling,
    "op13_divergence": divergence.op13_divergence,
}

ORACLES: dict[str, str] = {
    "op4_nn_descent": """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
   AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93 - 1e-12),
 reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
 c AS (SELECT a, min(b) AS root FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op5_substring": r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13), g AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 12), ' ')) AS h FROM s),
 f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h), late AS (SELECT doc_id, i FROM g JOIN f USING (h) WHERE first < doc_id),
 gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM late) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed, sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id)""",
    "op11_quality": r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, chr(0)) AS lang, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS s FROM d),
 c1 AS (SELECT *, regexp_replace(s, '[a-z]+', '', 'g') AS s1 FROM w), c2 AS (SELECT *, regexp_replace(s1, '[A-Z]+', '', 'g') AS s2 FROM c1), c3 AS (SELECT *, regexp_replace(s2, '\p{L}+', '', 'g') AS s3 FROM c2),
 c4 AS (SELECT *, regexp_replace(s3, '[.,;:''!?()\x22-]+', '', 'g') AS s4 FROM c3), c5 AS (SELECT *, regexp_replace(s4, '[0-9]+', '', 'g') AS s5 FROM c4),
 k AS (SELECT r, doc_id, lang, t, w, s, length(s) AS chars, len(w) AS n, [length(s) - length(s1), length(s1) - length(s2), length(s2) - length(s3), length(s3) - length(s4), length(s4) - length(s5), length(s5)] AS c FROM c5),
 lines AS (SELECT r, unnest(string_split(t, chr(10))) AS x FROM k), dup AS (SELECT r, count(*) - count(DISTINCT x) AS n_dup FROM lines WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
 g AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + 7), ' ')) AS h FROM (SELECT r, w, unnest(range(1, n - 6)) AS i FROM k WHERE n >= 8)),
 twice AS (SELECT r, i FROM g JOIN (SELECT r, h FROM g GROUP BY ALL HAVING count(*) > 1) USING (r, h)), rep AS (SELECT r, count(DISTINCT p) AS n_rep FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
 lw AS (SELECT r, lang, lower(unnest(w)) AS word FROM k), lang_n AS (SELECT lang, count(*) AS total FROM lw GROUP BY lang),
 common AS (SELECT lang, word, n::DOUBLE / total AS q FROM (SELECT lang, word, count(*) AS n FROM lw GROUP BY lang, word) JOIN lang_n USING (lang) WHERE n * 400 >= total),
 rest AS (SELECT lang, 1 - sum(q) AS rest_q FROM common GROUP BY lang),
 sums AS (SELECT lang, b, sum(x) AS x FROM (SELECT lang, unnest(c) AS x, generate_subscripts(c, 1) AS b FROM k) GROUP BY lang, b),
 ref AS (SELECT lang, b, x::DOUBLE / greatest(sum(x) OVER (PARTITION BY lang), 1) AS q FROM sums),
 dc AS (SELECT r, lang, b, x::DOUBLE / chars AS p FROM (SELECT r, lang, chars, unnest(c) AS x, generate_subscripts(c, 1) AS b FROM k WHERE chars >= 200) WHERE x > 0),
 cd AS (SELECT r, sqrt(greatest(sum(p * log2(p / ((p + q) / 2)) + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) + greatest(1 - sum(q), 0), 0) / 2) AS d FROM dc JOIN ref USING (lang, b) GROUP BY r),
 dw AS (SELECT r, sum(m) AS found, sum(p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) AS d, sum(q) AS q FROM
   (SELECT r, lang, k.n, m, m::DOUBLE / k.n AS p, q FROM (SELECT r, lang, word, count(*) AS m FROM lw GROUP BY r, lang, word) JOIN common USING (lang, word) JOIN k USING (r, lang) WHERE k.n >= 50) GROUP BY r),
 o AS (SELECT k.r, coalesce(d, 0) AS d, coalesce(dw.q, 0) AS q, (k.n - coalesce(found, 0))::DOUBLE / k.n AS p0, rest_q AS q0 FROM k JOIN rest USING (lang) LEFT JOIN dw USING (r) WHERE k.n >= 50),
 wd AS (SELECT r, sqrt(greatest(d + CASE WHEN p0 > 0 THEN p0 * log2(p0 / ((p0 + q0) / 2)) ELSE 0 END + CASE WHEN q0 > 0 THEN q0 * log2(q0 / ((p0 + q0) / 2)) ELSE 0 END + greatest(1 - q0 - q, 0), 0) / 2) AS d FROM o),
 f AS (SELECT k.r, doc_id, lang, n AS n_words, chars AS word_chars, length(s) - length(regexp_replace(s, '[#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_rep, 0) AS n_repeat_words
   FROM k LEFT JOIN dup USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
 NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (coalesce(total, 0) >= 1000 AND (coalesce(cd.d, 0) > 0.3 OR coalesce(wd.d, 0) > 0.52)) AS kept
FROM f LEFT JOIN lang_n USING (lang) LEFT JOIN cd USING (r) LEFT JOIN wd USING (r)""",
    "op13_divergence": r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 w AS (SELECT lang, source, r, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 k AS (SELECT lang, term, count(*) AS uses FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3), l AS (SELECT lang, count(*) AS v, sum(uses) AS n FROM k GROUP BY lang),
 c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL), s AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
 g AS (SELECT lang, source, coalesce(l.v, 0) AS v, coalesce(s.n, 0) AS n, coalesce(l.n, 0) AS ln FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN l USING (lang) LEFT JOIN s USING (lang, source)),
 p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (g.n + g.v) AS p, 1 + (1000000000::HUGEINT * (k.uses + 1)) // (g.ln + g.v) AS q
   FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
   UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE c > 0 AND p > q),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200""",
}
