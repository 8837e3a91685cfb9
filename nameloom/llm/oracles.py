"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from nameloom.llm.chat_prefix_tree import CONTROL

WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"


def _escaped(c: str) -> str:
    """Length of a text after escaping: one more for each backslash and each control string."""
    return f"(length({c}) + length({c}) - length(replace({c}, '\\', ''))" + "".join(f" + (length({c}) - length(replace({c}, '{x}', ''))) // {len(x)}" for x in CONTROL) + ")"


CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(17 + {_escaped('role')} + length(role) - length(replace(role, chr(10), '')) + {_escaped('text')})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""

MIX = f"""WITH s AS (SELECT doc_id, source, len({WORDS.format('text')})::BIGINT AS size, ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '\\N')), 1, 15))::BIGINT AS k FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM s GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((rn - 1) % 3 + 1)::INT]::DOUBLE AS w, (source_size * 2)::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS total FROM src),
l AS (SELECT *, (total - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN cap > w * level THEN w * max(CASE WHEN cap > w * level THEN level END) OVER () ELSE cap END AS target FROM l),
p AS (SELECT doc_id, size, source_size, target, round(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole,
  coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (whole * size + least(greatest(budget - whole * source_size - before, 0), size))::BIGINT AS taken FROM p"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS l FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(l) < 4 THEN l ELSE l[i:i + 3] END, ' ') AS g FROM d, UNNEST(generate_series(1, greatest(len(l) - 3, CASE WHEN len(l) > 0 THEN 1 ELSE 0 END))) AS u(i)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r AS (SELECT DISTINCT a AS v, a AS w FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.w = e.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT v AS doc_id, min(w) AS m FROM r GROUP BY v) USING (doc_id)"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {1 + 5 * i}, 5))::BIGINT >> {15 - 5 * j}) & 31)::INT + 1, 1)" for i in range(8) for j in range(4))

WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f"""

QUALITY = r"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
win AS (SELECT doc_id, i, l[i:i + 4] AS w FROM d, UNNEST(generate_series(1, len(l) - 4)) AS u(i)),
twice AS (SELECT doc_id, w FROM win GROUP BY 1, 2 HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM win JOIN twice USING (doc_id, w), UNNEST([0, 1, 2, 3, 4]) AS v(j) GROUP BY doc_id),
ln AS (SELECT doc_id, source, md5(text) AS t, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
nl AS (SELECT *, regexp_replace(regexp_replace(trim(lower(line), ' '), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g') AS norm FROM ln),
host AS (SELECT source, count(DISTINCT md5(text)) AS texts FROM d GROUP BY source),
bad AS (SELECT nl.source, norm FROM nl JOIN host ON nl.source IS NOT DISTINCT FROM host.source GROUP BY nl.source, norm, texts HAVING count(DISTINCT t) > 10 AND count(DISTINCT t) > 0.05 * texts),
per AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, sum(CASE WHEN b.norm IS NULL THEN nw ELSE 0 END) AS rest FROM nl LEFT JOIN bad b ON nl.norm = b.norm AND nl.source IS NOT DISTINCT FROM b.source GROUP BY doc_id),
f AS (SELECT doc_id, len(l)::BIGINT AS n_words, length(array_to_string(l, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(rest, 0) AS rest FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN per USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND rest >= 10 AND rest >= 0.5 * n_words AS kept FROM f"""

REPEATS = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(l[i:i + 49], ' ')) AS w FROM d, UNNEST(generate_series(1, len(l) - 49)) AS u(i)),
first AS (SELECT w, min(doc_id) AS f FROM win GROUP BY w),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN first USING (w), UNNEST(generate_series(0, 49)) AS v(j) WHERE f < doc_id),
g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS s FROM (SELECT doc_id, unnest(l) AS x, unnest(generate_series(1, len(l))) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)"""

ORACLES = {
    "op1_chat_prefix_tree": CHAT,
    "op3_source_mix": MIX,
    "op5_ngram_jaccard": JACCARD,
    "op6_warc_index": WARC,
    "op8_quality_lines": QUALITY,
    "op9_phrase_automata": REPEATS,
}
