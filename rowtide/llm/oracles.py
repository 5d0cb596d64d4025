"""DuckDB SQL of the queries that SQL can express."""

from rowtide.llm.sharding import FIRST, PRIME, SECOND, SEED, round_keys

NORMALIZED = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

OP5 = f"""
WITH hashed AS (SELECT doc_id, sha256({NORMALIZED}) AS text_sha256 FROM documents),
     grouped AS (
       SELECT doc_id, text_sha256,
              min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
              count(*) OVER (PARTITION BY text_sha256) AS group_size
       FROM hashed)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM grouped
"""

# Turn lists up to the last reply, the exchanged reply, the common prefix counted turn by turn.
OP10 = r"""
WITH turns AS (
       SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
              row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS i
       FROM conversations WHERE conv_id IS NOT NULL),
     last AS (SELECT conv_id, max(i) AS n FROM turns WHERE role = 'assistant' GROUP BY conv_id),
     paired AS (
       SELECT conv_id, n, nullif(coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()), conv_id) AS other
       FROM last),
     chosen AS (SELECT t.conv_id, t.i, t.role, t.text FROM turns t JOIN last l ON t.conv_id = l.conv_id AND t.i <= l.n),
     rejected AS (
       SELECT c.conv_id, c.i, c.role, c.text FROM chosen c JOIN last l USING (conv_id) WHERE c.i < l.n
       UNION ALL
       SELECT a.conv_id, a.n, t.role, t.text FROM paired a JOIN last b ON b.conv_id = a.other
       JOIN turns t ON t.conv_id = b.conv_id AND t.i = b.n),
     sides AS (
       SELECT coalesce(c.conv_id, r.conv_id) AS pair_id, coalesce(c.i, r.i) AS i,
              c.role IS NOT NULL AND r.role IS NOT NULL AND c.role = r.role AND c.text = r.text AS same
       FROM chosen c FULL JOIN rejected r ON c.conv_id = r.conv_id AND c.i = r.i),
     prefix AS (SELECT pair_id, coalesce(min(i) FILTER (WHERE NOT same), max(i) + 1) - 1 AS k FROM sides GROUP BY pair_id),
     drawn AS (
       SELECT 'c' AS side, conv_id AS pair_id, i, role, text FROM chosen
       UNION ALL SELECT 'r', conv_id, i, role, text FROM rejected),
     placed AS (
       SELECT d.side, d.pair_id, d.i, d.role, d.i <= p.k AS common,
              '<|im_start|>' || d.role || chr(10) || d.text || '<|im_end|>' || chr(10) AS shown,
              sum(length(d.role) + length(d.text) + 24) OVER (PARTITION BY d.side, d.pair_id ORDER BY d.i) AS past
       FROM drawn d JOIN prefix p USING (pair_id))
SELECT p.pair_id, CAST(p.k AS INTEGER) AS n_prompt_turns,
       coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE common AND side = 'c'), '') AS prompt,
       coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE NOT common AND side = 'c'), '') AS chosen,
       coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE NOT common AND side = 'r'), '') AS rejected,
       coalesce(string_agg((past - length(shown) + length(role) + 13) || ':' || (past - 1), ',' ORDER BY i)
                FILTER (WHERE NOT common AND side = 'c' AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg((past - length(shown) + length(role) + 13) || ':' || (past - 1), ',' ORDER BY i)
                FILTER (WHERE NOT common AND side = 'r' AND role = 'assistant'), '') AS rejected_spans
FROM prefix p JOIN placed USING (pair_id) GROUP BY p.pair_id, p.k
"""


def _crc32(data: str) -> str:
    """Checksum of a blob, byte by byte through the list ``t`` of ``crc_table``."""
    step = "xor(c >> 8, t[(xor(c, ('0x' || b)::BIGINT) & 255) + 1])"
    return f"xor(list_reduce(regexp_extract_all(hex({data}), '..'), lambda c, b: {step}, 4294967295::BIGINT), 4294967295)"


CRC_TABLE = """
crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), i) ORDER BY i) AS t FROM range(256) r(i))
"""


def _sized(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def merkle_sql(levels: int = 8) -> str:
    """Trees of up to 16**levels leaves: every level as a list of digests a run, then one step a level and leaf."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    head = " || ".join(_sized(c) for c in ("doc_id", "source", "lang", "n_chars"))
    parts = [
        CRC_TABLE,
        f"""
leaves AS (
  SELECT doc_id, source, sha256({head} || {_sized("text")}) AS h,
         CASE WHEN {_crc32("encode(doc_id::VARCHAR)")} % 5 = 0
              THEN sha256({head} || {_sized(f"translate(text, '{upper}', '{lower}')")}) END AS forged
  FROM documents, crc_table)""",
        """
g0 AS (
  SELECT source, doc_id, forged, h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i,
         count(*) OVER (PARTITION BY source) AS n
  FROM leaves)""",
    ]

    def climb(name: str, key: str) -> None:
        for level in range(levels):
            parts.append(
                f"""
{name}{level}_runs AS (
  SELECT {key}, i // 16 AS i, list(h ORDER BY i) AS hs, max(n) AS n FROM {name}{level} GROUP BY {key}, i // 16),
{name}{level + 1} AS (
  SELECT {key}, i, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h, (n + 15) // 16 AS n
  FROM {name}{level}_runs)"""
            )

    climb("g", "source")
    parts.append(
        f"""
t0 AS (
  SELECT 0 AS top, source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n
  FROM g{levels})"""
    )
    climb("t", "top")
    parts.append(
        f"""
w0 AS (
  SELECT g0.doc_id, g0.source, g0.i AS gi, t0.i AS ti, g0.h AS leaf, coalesce(g0.forged, g0.h) AS held, t0.h AS subroot,
         (SELECT h FROM t{levels}) AS root, '' AS shown
  FROM g0 JOIN t0 ON g0.source IS NOT DISTINCT FROM t0.source)"""
    )
    steps = [("g", k, "r.source IS NOT DISTINCT FROM w.source", "w.gi") for k in range(levels)]
    steps += [("t", k, "true", "w.ti") for k in range(levels)]
    for at, (name, level, same, place) in enumerate(steps):
        i = f"{place} // {16**level}"
        parts.append(
            f"""
w{at + 1} AS (
  SELECT doc_id, source, gi, ti, leaf, subroot, root,
         CASE WHEN n > 1 THEN sha256(before || held || behind) ELSE held END AS held,
         CASE WHEN n > 1 THEN shown || before || behind ELSE shown END AS shown
  FROM (SELECT w.*, r.n, array_to_string(r.hs[1:({i}) % 16], '') AS before, array_to_string(r.hs[({i}) % 16 + 2:], '') AS behind
        FROM w{at} w JOIN {name}{level}_runs r ON {same} AND r.i = ({i}) // 16))"""
        )
    return "WITH " + ",".join(parts) + f"""
SELECT doc_id, leaf, subroot, root, sha256(shown) AS proof_sha256, held AS folded_root, held = root AS verified
FROM w{len(steps)}"""


def shards_sql(shards: int = 8, seed: int = SEED) -> str:
    """Rows numbered by id, every round of the permutation a subquery, places outside the range walked on."""

    def permuted(source: str, value: str) -> str:
        rows = f"(SELECT *, ({value}) // b AS l, ({value}) % b AS r FROM {source})"
        for at, key in enumerate(round_keys(seed)):
            half, side, grid = ("r", "l", "a") if at % 2 == 0 else ("l", "r", "b")
            rows = f"(SELECT * REPLACE (((({half} + {key}) % {PRIME}) * {FIRST}) % {PRIME} AS m) FROM (SELECT *, 0::BIGINT AS m FROM {rows}))"
            rows = f"(SELECT * EXCLUDE (m) REPLACE (({side} + (xor(m, m >> 13) * {SECOND}) % {PRIME}) % {grid} AS {side}) FROM {rows})"
        return f"SELECT doc_id, size, text_crc32, n, a, b, l * b + r AS y FROM {rows}"

    return f"""
WITH RECURSIVE {CRC_TABLE},
     sized AS (
       SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce({_crc32("encode(coalesce(text, ''))")}, 0) AS text_crc32
       FROM documents, crc_table),
     numbered AS (
       SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS y, count(*) OVER () AS n FROM sized),
     sides AS (SELECT *, greatest(ceil(sqrt(n)), 1)::BIGINT AS a FROM numbered),
     grid AS (SELECT *, (n + a - 1) // a AS b FROM sides),
     walk AS ({permuted("grid", "y")}
              UNION ALL
              {permuted("(SELECT * FROM walk WHERE y >= n)", "y")})
SELECT doc_id, size, text_crc32, 'rows' AS law, (y % {shards})::INTEGER AS shard, y // {shards} AS slot, NULL::INTEGER AS grown_shard
FROM walk WHERE y < n
"""


OP13 = r"""
WITH drawn AS (
       SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^
]*
|[^
]+') AS units,
              sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d
       FROM documents),
     numbers AS (
       SELECT *, len(units) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2,
              ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4
       FROM drawn),
     cut AS (
       SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS k1, greatest(h1 % (n + 1), h2 % (n + 1)) AS k2,
              CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
                   THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
       FROM numbers),
     parts AS (
       SELECT *, array_to_string(units[1:k1], '') AS p, array_to_string(units[k1 + 1:k2], '') AS m,
              array_to_string(units[k2 + 1:], '') AS s
       FROM cut),
     made AS (
       SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                 ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output
       FROM parts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
              WHEN 'psm' THEN split_part(substr(output, 4), '<S>', 1) || split_part(output, '<M>', 2)
                              || split_part(split_part(output, '<S>', 2), '<M>', 1)
              ELSE split_part(split_part(output, '<P>', 2), '<M>', 1) || split_part(output, '<M>', 2)
                   || split_part(substr(output, 4), '<P>', 1) END) AS restored_sha256
FROM made
"""

ORACLES = {
    "op5_exact_dedup": OP5,
    "op10_preference_pairs": OP10,
    "op11_merkle_manifest": merkle_sql(),
    "op12_feistel_shards": shards_sql(),
    "op13_fill_in_middle": OP13,
}
