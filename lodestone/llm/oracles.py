"""DuckDB SQL for the corpus operators that SQL can express. Tokens, fingerprints and classifiers have none and are tested against brute force."""

from __future__ import annotations

import re

from lodestone.llm import compaction as compact, licenses, mixing as mix, sharding as shards

CRC32 = """crc_table AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS n)))"""


def crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, a byte at a time over the table of crc_table."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {data}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


def _pick(key: str, level: str, nodes: dict[int, float]) -> str:
    if len(nodes) == 1:
        return str(next(iter(nodes)))
    straw = "-ln((CAST(CAST('0x' || substr(md5({k} || ':{l}:{n}'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE) / {w}::DOUBLE"
    draws = ", ".join(f"{{'straw': {straw.format(k=key, l=level, n=n, w=w)}, 'node': {n}}}" for n, w in sorted(nodes.items()))
    return f"list_min([{draws}]).node"


def _descent(tree: list[shards.Leaf], tag: str, source: str) -> str:
    regions: dict[int, float] = {}
    racks: dict[int, dict[int, float]] = {}
    leaves: dict[int, dict[int, float]] = {}
    for x in tree:
        regions[x.region] = regions.get(x.region, 0) + x.weight
        racks.setdefault(x.region, {})[x.rack] = racks.get(x.region, {}).get(x.rack, 0) + x.weight
        leaves.setdefault(x.rack, {})[x.shard] = x.weight
    case = lambda col, level, table: f"CASE {col} " + " ".join(f"WHEN {p} THEN {_pick('k', level, nodes)}" for p, nodes in sorted(table.items())) + " END"
    return f"""{tag}a AS (SELECT *, {_pick('k', 'region', regions)} AS region FROM {source}), {tag}b AS (SELECT *, {case('region', 'rack', racks)} AS rack FROM {tag}a),
{tag} AS (SELECT * EXCLUDE (region, rack), CAST({case('rack', 'shard', leaves)} AS INT) AS {tag} FROM {tag}b)"""


def sharding(n: int) -> str:
    """Slots number a shard's rows by cell, a hash of the id, and then by id, size and checksum."""
    tree = shards.topology(n)
    return f"""WITH {CRC32}, d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, strlen(coalesce(text, '')) + 1 AS size, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE {crc32('text')} END AS text_crc32 FROM documents, crc_table),
{_descent(tree, 'shard', 'd')}, {_descent(shards.grown(tree), 'grown_shard', 'shard')}
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5('slot:' || k || ':' || size || ':' || text_crc32), 1, 6) AS BIGINT) % 1024, doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM grown_shard"""


def vector_links(threshold: float) -> str:
    good = "label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
    return f"""WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e, {good} AS good FROM embeddings),
l AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE a.good AND b.good
  AND list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= {threshold}),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
part AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a), deg AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN part USING (r) LEFT JOIN deg USING (r)"""


def top_k(every: int, k: int, scale: float) -> str:
    return f"""WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor({scale}::DOUBLE * x)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM (SELECT DISTINCT * FROM v WHERE vec_id % {every} = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e))
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s) WHERE rank <= {k}"""


def license_scan() -> str:
    rows = []
    for base, k, texts in ((True, licenses.SHORT, [(v, p) for p, v in licenses.PHRASES.items()]), (False, licenses.LONG, list(licenses.NOTICES.items()))):
        for label, text in texts:
            w = re.findall(r"[0-9a-z]+", text.lower())
            rows += [f"('{' '.join(w[i : i + k])}', '{label}', {i}, {len(w) - k + 1}, {len(w)}, {base})" for i in range(len(w) - k + 1)]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    grams = " UNION ALL ".join(
        f"SELECT r, i AS pos, {' || chr(32) || '.join(f'w[i + {j + 1}]' for j in range(k))} AS gram, {base} AS base FROM (SELECT r, w, unnest(range(0, greatest(n - {k - 1}, 0))) AS i FROM d)" for k, base in ((licenses.SHORT, True), (licenses.LONG, False))
    )
    return f"""WITH t(gram, label, spot, need, size, base) AS (VALUES {', '.join(rows)}),
c AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents), d AS (SELECT *, len(w) AS n FROM c),
h AS (SELECT g.r, t.*, g.pos, g.pos - t.spot AS diagonal FROM ({grams}) g JOIN t USING (gram, base)),
v AS (SELECT r, label, base, need, size, diagonal, count(*) AS votes, list(spot) AS spots, min(spot) AS lo, max(spot) AS hi, min(pos) AS f, max(pos) AS z FROM h GROUP BY ALL),
u AS (SELECT *, lag({{'d': diagonal, 'lo': lo, 'hi': hi, 'f': f, 'z': z}}) OVER (PARTITION BY r, label, base, need, size ORDER BY diagonal) AS w FROM v),
m AS (SELECT *, CASE WHEN NOT base AND diagonal - w.d <= {licenses.NEAR} AND (lo - w.hi >= {licenses.LONG} AND f - w.z >= {licenses.LONG} OR w.lo - hi >= {licenses.LONG} AND w.f - z >= {licenses.LONG}) THEN 0 ELSE 1 END AS fresh FROM u),
p AS (SELECT *, sum(fresh) OVER (PARTITION BY r, label, base, need, size ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM m),
s AS (SELECT r, label, base, need, size, span, sum(votes) AS votes, min(f) AS f, max(z) AS z, len(list_distinct(flatten(list(spots)))) / need::DOUBLE AS coverage FROM p GROUP BY r, label, base, need, size, span),
k AS (SELECT * FROM s WHERE CASE WHEN base THEN votes = need ELSE coverage >= {licenses.LEAST} END)
SELECT doc_id, CAST(any_value(n) AS BIGINT) AS n_words, count(*) FILTER (base) AS n_base, CAST(min(f) FILTER (base) AS BIGINT) AS first_word, CAST(max(f) FILTER (base) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(coverage), 0) AS score FROM d LEFT JOIN k USING (r) GROUP BY r, doc_id"""


def mixing() -> str:
    weights = ", ".join(f"{w}::DOUBLE" for w in mix.WEIGHTS)
    return f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, CAST('0x' || substr(md5(concat_ws(':', 'mix', CAST(doc_id AS VARCHAR), text)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw FROM documents),
s AS (SELECT source, sum(size) AS source_size, ([{weights}])[(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(mix.WEIGHTS)} + 1] AS w, row_number() OVER (ORDER BY source ASC NULLS LAST) AS n FROM d GROUP BY source),
c AS (SELECT *, source_size * {mix.MOST}::DOUBLE AS cap, sum(source_size) OVER () * {mix.SHARE}::DOUBLE AS goal FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS caps, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS remaining FROM c WINDOW b AS (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, row_number() OVER (ORDER BY cap / w, n) AS k, (goal - caps) / remaining AS level FROM o), f AS (SELECT min(k) AS k, arg_min(level, k) AS level FROM z WHERE level * w <= cap),
t AS (SELECT source, source_size, CASE WHEN f.k IS NULL OR z.k < f.k THEN cap ELSE f.level * w END AS target FROM z, f)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target, CAST(CASE WHEN source_size > 0 THEN size * (floor(target / source_size) + CASE WHEN draw < target / source_size - floor(target / source_size) THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source"""


def warc() -> str:
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> {s}) & 31) + 1, 1)"
    four = " || ".join(letter.format(s=s) for s in (15, 10, 5, 0))
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, strlen(h) AS payload_bytes, list_aggregate(list_transform(list_transform(range(8), lambda g: CAST('0x' || substr(sha1(h), 5 * g + 1, 5) AS BIGINT)), lambda x: {four}), 'string_agg', '') AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS latest FROM q)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN latest IS NOT NULL AND page_id IS DISTINCT FROM latest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN latest IS NOT NULL AND page_id IS DISTINCT FROM latest THEN latest END AS refers_to FROM r"""


def ball_kmeans(dim: int, k: int, rounds: int, scale: float, seed: str) -> str:
    apart = "list_inner_product(v.e, v.e) - 2 * list_inner_product(v.e, x.e) + list_inner_product(x.e, x.e)"
    near = lambda t: f"SELECT r, min({{'d': {apart}, 'c': c}}) AS b FROM v, c{t} x GROUP BY r"
    turns = "".join(
        f""", a{t} AS ({near(t)}), s{t} AS (SELECT c, i, sum(CAST(e[i] AS HUGEINT)) AS s, count(*) AS n FROM (SELECT b.c AS c, e, unnest(range(1, {dim + 1})) AS i FROM v JOIN a{t} USING (r)) GROUP BY c, i),
m{t} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS e FROM s{t} GROUP BY c), c{t + 1} AS (SELECT c{t}.c, coalesce(m{t}.e, c{t}.e) AS e FROM c{t} LEFT JOIN m{t} USING (c))"""
        for t in range(rounds)
    )
    return f"""WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor({scale}::DOUBLE * x)) AS e FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INT) AS c, e FROM (SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS h, e FROM v ORDER BY h LIMIT {k})){turns}, z AS ({near(rounds)})
SELECT vec_id, b.c AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c{rounds}.e, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM z JOIN v USING (r) JOIN c{rounds} ON c{rounds}.c = z.b.c"""


def compaction(r: compact.Rules) -> str:
    """Next-fit as a recursion along each source: a file's group is the one before unless that would overflow."""
    return f"""WITH RECURSIVE {CRC32}, d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text, CASE WHEN doc_id IS NULL THEN 0 ELSE {crc32('CAST(doc_id AS VARCHAR)')} END AS h, (doc_id - ((doc_id % {r.block_ids}) + {r.block_ids}) % {r.block_ids}) // {r.block_ids} AS block FROM documents, crc_table),
e AS (SELECT *, least(h % {r.slots}, (h // {r.slots}) % {r.slots}) AS slot FROM d), x AS (SELECT *, (h // {r.slots**2}) % 100 >= {r.kill} * ((((slot + coalesce(block, 0)) % {r.slots}) + {r.slots}) % {r.slots}) AS live FROM e),
f AS (SELECT source, block, slot, count(*) AS n, count(*) FILTER (live) AS live_rows, sum(strlen(text)) AS bytes, coalesce(sum(strlen(text)) FILTER (live), 0) AS live_bytes FROM x GROUP BY ALL),
c AS (SELECT *, 100 * (n - live_rows) >= {r.dirty} * n AS dirty, row_number() OVER (PARTITION BY source ORDER BY block NULLS FIRST, slot) AS i FROM f WHERE 100 * (n - live_rows) >= {r.dirty} * n OR bytes < {r.small} * {r.target}),
w AS (SELECT source, i, live_bytes AS held, i AS start FROM c WHERE i = 1 UNION ALL SELECT c.source, c.i, CASE WHEN w.held + c.live_bytes > {r.target} THEN c.live_bytes ELSE w.held + c.live_bytes END, CASE WHEN w.held + c.live_bytes > {r.target} THEN c.i ELSE w.start END FROM w JOIN c ON c.source = w.source AND c.i = w.i + 1),
g AS (SELECT source, start, arg_min({{'b': block, 's': slot}}, i) AS o, count(*) AS n_files, sum(live_rows) AS live_rows, sum(bytes) AS bytes, sum(live_bytes) AS live_bytes, bool_or(dirty) AS dirty FROM c JOIN w USING (source, i) GROUP BY source, start),
q AS (SELECT *, sum(bytes) OVER () AS whole, sum(bytes) OVER b AS upto, row_number() OVER b - 1 AS place FROM g WHERE n_files >= 2 OR dirty WINDOW b AS (ORDER BY n_files DESC, bytes, source, o.b NULLS FIRST, o.s ROWS UNBOUNDED PRECEDING)),
k AS (SELECT * FROM q WHERE 100 * upto <= {r.share} * whole), m AS (SELECT c.source, c.block, c.slot, k.o, k.n_files, k.bytes, k.live_bytes, k.place, k.live_rows FROM c JOIN w USING (source, i) JOIN k USING (source, start)),
p AS (SELECT f.source, f.block, f.slot, m.place IS NOT NULL AS moved, CASE WHEN m.place IS NULL THEN f.block ELSE m.o.b END AS ob, CASE WHEN m.place IS NULL THEN f.slot ELSE m.o.s END AS os, coalesce(m.n_files, 1) AS n_files, coalesce(m.live_rows, f.live_rows) AS live_rows, CASE WHEN m.place IS NULL THEN f.bytes ELSE m.bytes END AS bytes, m.live_bytes, m.place
  FROM f LEFT JOIN m ON f.source = m.source AND f.block IS NOT DISTINCT FROM m.block AND f.slot = m.slot)
SELECT p.source, ob AS block, os AS slot, CAST(any_value(n_files) AS BIGINT) AS n_files, CAST(any_value(p.live_rows) AS BIGINT) AS live_rows, CAST(any_value(bytes) AS BIGINT) AS bytes, CAST(any_value(CASE WHEN moved THEN bytes + live_bytes + {r.file_cost} * n_files END) AS BIGINT) AS cost, CAST(any_value(place // {r.wave}) AS BIGINT) AS wave,
  sha256(coalesce(string_agg(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text || chr(10), '' ORDER BY doc_id NULLS FIRST, text) FILTER (live), '')) AS live_sha256
FROM p JOIN x ON p.source = x.source AND p.block IS NOT DISTINCT FROM x.block AND p.slot = x.slot GROUP BY p.source, ob, os"""
