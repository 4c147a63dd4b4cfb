"""Registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from siftweb.llm.collocations import op13_collocations
from siftweb.llm.exact_dedup import op3_exact_dedup
from siftweb.llm.fingerprints import op10_fingerprints
from siftweb.llm.importance import op11_importance
from siftweb.llm.mixing import op6_mixing
from siftweb.llm.near_dedup import op7_near_dedup
from siftweb.llm.packing import op9_packing
from siftweb.llm.pii import op4_pii
from siftweb.llm.quality import op5_quality
from siftweb.llm.secret_scan import op8_secret_scan
from siftweb.llm.token_counts import op12_token_counts
from siftweb.llm.token_store import op2_token_store
from siftweb.llm.url_rules import op1_url_rules

QUERIES = {q.__name__: q for q in (op1_url_rules, op2_token_store, op3_exact_dedup, op4_pii, op5_quality, op6_mixing, op7_near_dedup, op8_secret_scan, op9_packing, op10_fingerprints, op11_importance, op12_token_counts, op13_collocations)}

SQL: dict[str, str] = {
    "op3_exact_dedup": r"""
WITH normal AS (
    SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body
    FROM documents),
ranked AS (
    SELECT doc_id, first_value(doc_id) OVER (PARTITION BY body ORDER BY size DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY body) AS group_size, sha256(body) AS text_sha256
    FROM normal)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked""",
    "op11_importance": r"""
WITH crc_table AS (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS steps
    FROM (SELECT unnest(range(256)) AS i)),
texts AS (SELECT doc_id, text, TRUE AS own FROM documents UNION ALL SELECT item_id, text, FALSE FROM benchmark),
worded AS (
    SELECT doc_id, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM texts),
spelled AS (SELECT DISTINCT unnest(words) AS word FROM worded),
coded AS (
    SELECT word, hex(encode(word)) AS digits FROM spelled),
hashed AS (
    SELECT word, xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(range(length(digits) // 2), lambda i:
            CAST(16 * (instr('0123456789ABCDEF', substr(digits, 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(digits, 2 * i + 2, 1)) - 1 AS BIGINT))),
        lambda c, b: xor(c // 256, steps[xor(c % 256, b) + 1]))) % 10000 AS bucket
    FROM coded, crc_table),
counted AS (SELECT w.own, h.bucket, count(*) AS n FROM (SELECT own, unnest(words) AS word FROM worded) w JOIN hashed h USING (word) GROUP BY ALL),
totals AS (SELECT coalesce(sum(n) FILTER (own), 0) AS s_all, coalesce(sum(n) FILTER (NOT own), 0) AS t_all FROM counted),
gains AS (
    SELECT b.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((coalesce(s.n, 0) + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain
    FROM (SELECT unnest(range(10000)) AS bucket) b CROSS JOIN totals
    LEFT JOIN counted s ON s.bucket = b.bucket AND s.own LEFT JOIN counted t ON t.bucket = b.bucket AND NOT t.own),
weighted AS (
    SELECT w.doc_id, count(h.bucket) AS n_features, coalesce(floor(sum(g.gain)::DOUBLE / count(g.gain))::BIGINT, 0) AS weight
    FROM (SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [NULL] ELSE words END) AS word FROM worded WHERE own) w
    LEFT JOIN hashed h ON h.word = w.word LEFT JOIN gains g ON g.bucket = h.bucket GROUP BY w.doc_id),
scored AS (
    SELECT doc_id, n_features, weight,
           weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM weighted),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS rank FROM placed""",
    "op13_collocations": r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM worded GROUP BY lang),
runs AS (
    SELECT lang, size, words, unnest(range(1, len(words) - size + 2)) AS first_word
    FROM worded CROSS JOIN (SELECT unnest(range(1, 6)) AS size) WHERE len(words) >= size),
counted AS (
    SELECT lang, size, array_to_string(words[first_word:first_word + size - 1], ' ') AS phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 100),
longer AS (
    SELECT lang, part, max(f) AS f
    FROM (SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:size - 1], ' '), array_to_string(string_split(phrase, ' ')[2:size], ' ')]) AS part
          FROM counted WHERE size > 2) GROUP BY ALL),
candidates AS (
    SELECT c.lang, c.size, c.phrase, c.f AS a FROM counted c LEFT JOIN longer o ON o.lang = c.lang AND o.part = c.phrase
    WHERE c.size > 1 AND NOT coalesce(100 * o.f >= 100 * c.f, FALSE)),
cuts AS (
    SELECT lang, phrase, a, cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') AS first_part, array_to_string(string_split(phrase, ' ')[cut + 1:size], ' ') AS rest
    FROM (SELECT *, unnest(range(1, size)) AS cut FROM candidates)),
scored AS (
    SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, t.n, c.cut, ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.first_part JOIN counted y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""",
}
