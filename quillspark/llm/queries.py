"""The registered queries of the corpus operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from .op01_language import op1_language_id
from .op02_suffix_dedup import op2_suffix_dedup
from .op03_token_store import op3_token_store
from .op04_quality import op4_quality_resampling
from .op05_mixing import op5_source_mixing
from .op06_decontaminate import op6_decontaminate
from .op07_token_counts import op7_token_counts
from .op08_secret_scan import op8_secret_scan
from .op09_minhash import op9_minhash_dedup
from .op10_fingerprint import op10_fingerprints
from .op11_toxicity import op11_toxicity
from .op12_alignment import op12_alignment
from .op13_periodic import op13_periodic_runs

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_token_store": op3_token_store,
    "op4_quality_resampling": op4_quality_resampling,
    "op5_source_mixing": op5_source_mixing,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_counts": op7_token_counts,
    "op8_secret_scan": op8_secret_scan,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_fingerprints": op10_fingerprints,
    "op11_toxicity": op11_toxicity,
    "op12_alignment": op12_alignment,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op2_suffix_dedup": r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, p, array_slice(b, p, p + 99) AS s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS p FROM d WHERE octet_length(b) >= 100)),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM w) WHERE n > 1),
isl AS (SELECT doc_id, min(p) AS a, max(p) + 99 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (
  SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM rep)) GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a AS z_next, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS s FROM isl
  UNION ALL SELECT d.doc_id, octet_length(d.b) + 1, coalesce(max(i.z), 0) + 1 FROM d LEFT JOIN isl i USING (doc_id) GROUP BY d.doc_id, octet_length(d.b)),
kept AS (SELECT g.doc_id, string_agg(CASE WHEN z_next > s THEN hex(array_slice(d.b, s, z_next - 1)) ELSE '' END, '' ORDER BY s) AS h FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, octet_length(d.b) AS n_bytes, coalesce(r.n, 0)::BIGINT AS n_removed, coalesce(r.k, 0)::BIGINT AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(z - a + 1) AS n, count(*) AS k FROM isl GROUP BY doc_id) r USING (doc_id)""",
    "op6_decontaminate": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT item_id, w, least(10, len(w)) AS m FROM bw WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT m FROM win),
pos AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, sizes WHERE len(w) >= m)),
occ AS (SELECT doc_id, item_id, m, i FROM pos JOIN win USING (m, s)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(it.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op9_minhash_dedup": r"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
comp AS (SELECT a AS doc_id, min(least(a, b)) AS c FROM reach GROUP BY a)
SELECT dw.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.c, dw.doc_id) AS component_id, coalesce(comp.c, dw.doc_id) = dw.doc_id AS kept
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)""",
}
