"""DuckDB SQL for those queries of the training-data operators that SQL can express.

The others (personal data, quality, packing, HTML, quotation linking, approximate search, the
pipeline) hold trees, a tokenizer, a parser or hashes; ``tests/llm`` compares them with brute force.
"""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Checksums by a table of 256 entries that the first step makes from its rule.
CRC32 = """t AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, length(h) // 2 AS bytes, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, length(h) // 2), lambda i: ((instr('0123456789ABCDEF', substr(h, (2 * i + 1)::BIGINT, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, (2 * i + 2)::BIGINT, 1)) - 1)::UBIGINT)), lambda a, b: xor(a >> 8, tab[((xor(a, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS crc FROM h, t)"""

JUMP = """j AS (SELECT doc_id, n, doc_id::HUGEINT AS key, -1::BIGINT AS b, 0::BIGINT AS pos FROM documents, (SELECT unnest([40, 41]) AS n)
UNION ALL SELECT doc_id, n, k, pos, floor((pos + 1) * (2147483648.0::DOUBLE / ((k // 8589934592) + 1)::DOUBLE))::BIGINT FROM (SELECT doc_id, n, (key * 2862933555777941757 + 1) % 18446744073709551616 AS k, pos FROM j WHERE pos < n)),
s AS (SELECT doc_id, max(b) FILTER (n = 40) AS shard, max(b) FILTER (n = 41) AS grown_shard FROM j WHERE pos >= n GROUP BY 1)"""

SHARDS = f"""WITH RECURSIVE {CRC32}, {JUMP}
SELECT doc_id, (bytes + 16)::BIGINT AS size, crc AS text_crc32, 'key' AS law, shard::INT AS shard, (row_number() OVER (PARTITION BY shard ORDER BY md5(doc_id || ':' || (bytes + 16) || ':' || crc), doc_id) - 1)::BIGINT AS slot, grown_shard::INT AS grown_shard FROM c JOIN s USING (doc_id)"""

VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.9),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON r.vec_id = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = r.vec_id) AS n_links, min(c) AS component_id, vec_id = min(c) AS kept FROM r GROUP BY vec_id"""

ARCHIVES = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

MIX = f"""WITH RECURSIVE d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS h, len({WORDS}) AS size FROM documents),
z AS (SELECT source, sum(size)::BIGINT AS total, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, count(*) OVER () AS n FROM d GROUP BY 1),
r AS (SELECT 0 AS i, source, total, w, n, false AS fixed, NULL::DOUBLE AS target FROM z
UNION ALL SELECT i + 1, source, total, w, n, fixed OR share > 3 * total, CASE WHEN fixed THEN target WHEN share > 3 * total THEN (3 * total)::DOUBLE ELSE share END
FROM (SELECT *, (sum(total) OVER () - coalesce(sum(CASE WHEN fixed THEN target END) OVER (), 0)) * w / sum(CASE WHEN NOT fixed THEN w END) OVER () AS share FROM r) WHERE i <= n),
g AS (SELECT source, total, target, floor(target + 0.5)::BIGINT AS flow FROM r WHERE i = n + 1),
o AS (SELECT d.doc_id, d.size, g.total, g.target, CASE WHEN g.total > 0 THEN g.flow // g.total ELSE 0 END AS base, CASE WHEN g.total > 0 THEN g.flow % g.total ELSE 0 END AS rest,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix-1:' || d.doc_id || ':' || d.h), d.doc_id) - d.size AS pos FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, total AS source_size, target, (size * (base + CASE WHEN size > 0 THEN greatest(0, least(1, floor((rest - pos) / size + 0.5))) ELSE 0 END))::BIGINT AS taken FROM o"""

JACCARD = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
n AS (SELECT w.doc_id, count(s) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON r.doc_id = l.a)
SELECT doc_id, n AS n_shingles, min(c) AS component_id FROM r JOIN n USING (doc_id) GROUP BY 1, 2"""

#: Rows whose vector is whole, with integer components.
WHOLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def codes(parts: int = 4, width: int = 16, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Lloyd rounds as a chain of tables: books b0, assignments a0, books b1 and so on."""
    steps = [
        f"v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS x FROM embeddings WHERE {WHOLE})",
        f"p AS MATERIALIZED (SELECT vec_id, part, x[part * {width} + 1:(part + 1) * {width}] AS x FROM v, range({parts}) t(part))",
        f"b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS e FROM p QUALIFY entry < {entries})",
    ]
    for i in range(rounds + 1):
        distance = "list_inner_product(x, x) - 2 * list_inner_product(x, e) + list_inner_product(e, e)"
        steps.append(f"a{i} AS MATERIALIZED (SELECT p.vec_id, p.part, arg_min(b.entry, ({distance}) * {entries} + b.entry) AS entry, min({distance}) AS d FROM p JOIN b{i} b ON b.part = p.part GROUP BY 1, 2)")
        if i < rounds:
            steps.append(f"m{i} AS (SELECT part, entry, list(m ORDER BY place) AS e FROM (SELECT part, entry, place, floor(sum(x[place]) / count(*)) AS m FROM a{i} JOIN p USING (vec_id, part), range(1, {width + 1}) t(place) GROUP BY 1, 2, 3) GROUP BY 1, 2)")
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.e, b.e) AS e FROM b{i} b LEFT JOIN m{i} m USING (part, entry))")
    return f"""WITH {", ".join(steps)},
c AS (SELECT vec_id, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY 1),
s AS (SELECT sha256(string_agg(array_to_string(list_transform(e, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN v USING (vec_id), s"""


NEGATIVES = f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings WHERE label IS NOT NULL AND {WHOLE}),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b AS p, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT a AS anchor_id, p AS positive_id, (row_number() OVER w)::INT AS rank, b AS negative_id, ps AS positive_score, score AS negative_score FROM p JOIN s USING (a) WHERE NOT same AND 30 * ps <= 100 * score AND 100 * score <= 90 * ps
WINDOW w AS (PARTITION BY a, p ORDER BY score DESC, b) QUALIFY row_number() OVER w <= 10"""

ORACLES: dict[str, str] = {"op2_sharding": SHARDS, "op4_vectors": VECTORS, "op5_warc": ARCHIVES, "op7_mixing": MIX, "op9_shingle_join": JACCARD, "op11_codes": codes(), "op12_hard_negatives": NEGATIVES}
