"""The queries of this subpackage, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from tabulark.llm.byte_bpe import round_trip
from tabulark.llm.common import table
from tabulark.llm.factorisation import quality_scores
from tabulark.llm.filter_audit import audit_filters
from tabulark.llm.fingerprints import fingerprint_documents
from tabulark.llm.html_text import extract_pages
from tabulark.llm.interpolated_lm import interpolated_scores
from tabulark.llm.line_dedup import dedup_lines
from tabulark.llm.merkle import document_manifest
from tabulark.llm.mixing import mixing_rates
from tabulark.llm.near_dedup import near_duplicate_classes
from tabulark.llm.packing import ROOMY, pack_documents
from tabulark.llm.quality_rules import weak_supervision
from tabulark.llm.sharding import shard_documents


def op1_html_extraction(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark, sf_dir):
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_minhash_near_dedup(spark, sf_dir):
    found = near_duplicate_classes(table(spark, sf_dir, "documents"), size=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_lm_scoring(spark, sf_dir):
    return interpolated_scores(table(spark, sf_dir, "documents"))


def op6_sharding(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"))


def op7_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), room=ROOMY)  # no other stage is at work


def op8_line_dedup(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark, sf_dir):
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark, sf_dir):
    return weak_supervision(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark, sf_dir):
    return document_manifest(table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark, sf_dir):
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_quality_classifier, op3_mixing, op4_minhash_near_dedup, op5_lm_scoring, op6_sharding, op7_packing, op8_line_dedup, op9_fingerprints, op10_quality_rules, op11_merkle_manifest, op12_byte_bpe, op13_filter_audit)}
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: 52 bits of an md5, as the rendezvous draw takes them.
DRAW = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT)"

#: A checksum's table follows from its polynomial; `crc` is that of a text's bytes.
POLYNOMIAL = "polynomial AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
BYTES = "list_transform(regexp_extract_all(hex(encode({})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
CRC = "xor(list_reduce(list_prepend(4294967295, {}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"
FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
LEAF = "sha256(" + " || ".join(FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {})"

ORACLES: dict[str, str] = {
    # All pairs that share a shingle, verified; then everything reachable over links.
    "op4_minhash_near_dedup": rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words)),
sizes AS (SELECT d.doc_id, count(s.s) AS n FROM documents d LEFT JOIN shingles s ON d.doc_id = s.doc_id GROUP BY d.doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS d, doc_id AS r FROM sizes UNION SELECT d, b FROM reach JOIN links ON r = a)
SELECT d AS doc_id, any_value(n) AS n_shingles, min(r) AS component_id, d = min(r) AS kept FROM reach JOIN sizes ON doc_id = d GROUP BY d""",
    "op6_sharding": f"""
WITH {POLYNOMIAL},
bytes AS (SELECT doc_id, coalesce(text, '') AS text, {BYTES.format("coalesce(text, '')")} AS b FROM documents),
sized AS (SELECT doc_id, CAST(len(b) + 1 AS BIGINT) AS size, {CRC.format("b")} AS text_crc32 FROM bytes, polynomial),
drawn AS (SELECT doc_id, arg_max(s, (h, -s)) FILTER (WHERE s < 16) AS shard, arg_max(s, (h, -s)) AS grown FROM (SELECT doc_id, s, {DRAW.format("doc_id || '|' || s")} AS h FROM (SELECT DISTINCT doc_id FROM documents), range(17) AS r(s)) GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY {DRAW.format("doc_id || '|' || text_crc32 || '|' || size || '|slot'")}, doc_id, text_crc32, size) - 1 AS slot, CAST(grown AS INT) AS grown_shard
FROM sized JOIN drawn USING (doc_id)""",
    "op8_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
repeated AS (SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.*, r.key IS NOT NULL AND l.doc_id <> r.last AS gone FROM lines l LEFT JOIN repeated r ON l.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    # Nodes by level and position, first in each source, then over the sources; a row's rungs are its runs on the way up.
    "op11_merkle_manifest": f"""
WITH RECURSIVE {POLYNOMIAL},
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n
  FROM (SELECT doc_id, coalesce('+' || source, '') AS g, {LEAF.format(FIELD.format("text"))} AS leaf,
    CASE WHEN {CRC.format(BYTES.format("CAST(doc_id AS VARCHAR)"))} % 5 = 0 THEN {LEAF.format(FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))} END AS changed
  FROM documents, polynomial)),
nodes AS (
  SELECT g, 0 AS lvl, pos, leaf AS h, n FROM leaves
  UNION ALL SELECT g, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 15) // 16) FROM nodes WHERE n > 1 GROUP BY g, lvl, pos // 16),
sub AS (SELECT g, h, lvl AS depth, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
over_nodes AS (
  SELECT 0 AS lvl, pos, h, n FROM sub
  UNION ALL SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 15) // 16) FROM over_nodes WHERE n > 1 GROUP BY lvl, pos // 16),
rungs AS (
  SELECT d.g, d.pos AS leaf_pos, s.lvl AS step, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos < d.pos >> (4 * s.lvl)), '') AS l, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos > d.pos >> (4 * s.lvl)), '') AS r
  FROM leaves d JOIN nodes s ON s.g = d.g AND s.n > 1 AND s.pos // 16 = (d.pos >> (4 * s.lvl)) // 16 GROUP BY ALL
  UNION ALL
  SELECT d.g, d.pos, u.depth + s.lvl, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos < u.pos >> (4 * s.lvl)), ''), coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos > u.pos >> (4 * s.lvl)), '')
  FROM leaves d JOIN sub u ON u.g = d.g JOIN over_nodes s ON s.n > 1 AND s.pos // 16 = (u.pos >> (4 * s.lvl)) // 16 GROUP BY ALL),
fold AS (
  SELECT g, pos, 0 AS step, coalesce(changed, leaf) AS h FROM leaves
  UNION ALL SELECT f.g, f.pos, f.step + 1, sha256(l || f.h || r) FROM fold f JOIN rungs ON rungs.g = f.g AND leaf_pos = f.pos AND rungs.step = f.step),
proven AS (SELECT g, leaf_pos AS pos, string_agg(l || r, '' ORDER BY step) AS proof FROM rungs GROUP BY ALL),
ends AS (SELECT g, pos, arg_max(h, step) AS folded FROM fold GROUP BY ALL)
SELECT d.doc_id, d.leaf, u.h AS subroot, o.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, e.folded AS folded_root, e.folded = o.h AS verified
FROM leaves d JOIN sub u ON u.g = d.g JOIN (SELECT h FROM over_nodes WHERE n = 1) o ON true LEFT JOIN proven p ON p.g = d.g AND p.pos = d.pos JOIN ends e ON e.g = d.g AND e.pos = d.pos""",
    "op13_filter_audit": r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM texts),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS bad
  FROM worded LEFT JOIN known USING (doc_id)),
letters AS (SELECT unnest(range(1, 6)) AS i),
orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
met AS (SELECT *, coalesce(nullif(list_position(list_transform(o, lambda i: bad[i]), true), 0), 6) AS out_at FROM judged, orders),
steps AS (SELECT met.*, s.i AS step, bad[o[s.i]] AS fails, len(list_filter(bad, lambda b: b)) AS n_bad FROM met, letters AS s),
counted AS (
  SELECT part, array_to_string(list_transform(o, lambda i: chr(CAST(64 + i AS INT))), '') AS filter_order, CAST(step AS INT) AS step,
    count(*) FILTER (WHERE out_at > step) AS kept, count(*) FILTER (WHERE out_at = step) AS removed, count(*) FILTER (WHERE fails AND out_at < step) AS redundant,
    count(*) FILTER (WHERE fails AND n_bad = 1) AS unique_fails, count(*) FILTER (WHERE out_at = step AND good = 1) AS good_lost, count(*) FILTER (WHERE out_at = step AND toxic = 1) AS toxic_lost
  FROM steps GROUP BY ALL)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM counted""",
}
