"""DuckDB SQL for the queries, written from their definitions rather than from the Spark plans."""

from __future__ import annotations

EDGES = """
edges AS (
  SELECT DISTINCT 'c:' || o.o_custkey AS src, 'p:' || l.l_partkey AS dst, 'uses' AS kind FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  UNION SELECT 'p:' || l_partkey, 's:' || l_suppkey, 'uses' FROM lineitem
  UNION SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'extends' FROM supplier
  UNION SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'extends' FROM nation
)"""
NODES = """
nodes AS (
  SELECT 'p:' || p_partkey AS id, p_type AS layer, CASE WHEN p_size % 5 = 0 THEN 'private' ELSE 'public' END AS visibility, p_brand AS super, CAST(NULL AS VARCHAR) AS ref, 'class' AS kind FROM part
  UNION ALL SELECT 'c:' || c_custkey, c_mktsegment, 'public', NULL, 'Brand#' || (c_custkey % 25 + 1), 'function' FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'supply', 'public', NULL, NULL, 'function' FROM supplier
  UNION ALL SELECT 'n:' || n_nationkey, 'uncategorized', 'public', NULL, NULL, 'function' FROM nation
  UNION ALL SELECT 'r:' || r_regionkey, 'uncategorized', 'public', NULL, NULL, 'function' FROM region
)"""
DEGREES = """
ins AS (SELECT dst AS id, count(*) AS n FROM edges GROUP BY dst),
outs AS (SELECT src AS id, count(*) AS n FROM edges GROUP BY src),
degrees AS (
  SELECT nodes.*, CAST(coalesce(ins.n, 0) AS BIGINT) AS in_degree, CAST(coalesce(outs.n, 0) AS BIGINT) AS out_degree
  FROM nodes LEFT JOIN ins USING (id) LEFT JOIN outs USING (id)
)"""
SCORED = """
scored AS (
  SELECT *, round((CAST(0.7 AS DOUBLE) * in_degree / greatest(max(in_degree) OVER (), 1) + CAST(0.2 AS DOUBLE) * out_degree / greatest(max(out_degree) OVER (), 1))
    * CASE WHEN visibility = 'private' THEN CAST(0.3 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END, 6) AS importance
  FROM degrees
)"""
HUBS = """
hubs AS (
  SELECT id, in_degree FROM (SELECT id, in_degree, row_number() OVER (ORDER BY in_degree DESC, id) AS r, count(*) OVER () AS n FROM degrees WHERE in_degree > 0)
  WHERE r <= floor(n * CAST(0.05 AS DOUBLE))
)"""
DISPATCH = """
impls AS (
  SELECT super AS key, id AS impl, importance, count(*) OVER (PARTITION BY super) AS n, row_number() OVER (PARTITION BY super ORDER BY importance DESC, id) AS r
  FROM scored WHERE super IS NOT NULL
)"""
G = f"{EDGES},{NODES},{DEGREES}"
PATHS = """paths AS (SELECT page_id, url, html, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '[?#].*$', '') AS path FROM pages)"""
PART_SETS = """
sets AS (SELECT l_orderkey AS o, list_sort(list(DISTINCT l_partkey)) AS nodes FROM lineitem GROUP BY l_orderkey)"""

SPECIFIERS = f"""
{PATHS},
wanted AS (
  SELECT DISTINCT path, CASE n % 3 WHEN 0 THEN './' || (n + 1) WHEN 1 THEN '@/en/' || n ELSE 'lib' || (n % 10) END AS source
  FROM (SELECT path, TRY_CAST(regexp_extract(path, '([0-9]+)$', 1) AS INTEGER) AS n FROM paths) WHERE n IS NOT NULL
),
files AS (SELECT DISTINCT path || CASE WHEN page_id % 2 = 0 THEN '.ts' ELSE '/index.js' END AS f FROM paths),
base AS (
  SELECT *, CASE WHEN source LIKE './%' THEN regexp_replace(path, '(^|/)[^/]*$', '') || source[2:] WHEN source LIKE '@/%' THEN source[3:] WHEN source = 'lib1' THEN 'en/1' END AS b,
    CASE WHEN source LIKE './%' THEN 'relative' WHEN source LIKE '@/%' OR source = 'lib1' THEN 'alias' END AS kind
  FROM wanted
),
tries AS (
  SELECT path, source, kind, b || e AS f, p FROM base,
    (VALUES ('.ts', 1), ('.tsx', 2), ('.js', 3), ('.jsx', 4), ('.mjs', 5), ('.cjs', 6), ('', 7), ('/index.ts', 8), ('/index.tsx', 9), ('/index.js', 10), ('/index.jsx', 11), ('/index.mjs', 12), ('/index.cjs', 13)) AS t(e, p)
  WHERE b IS NOT NULL
),
hit AS (SELECT path, source, arg_min(f, p) AS file, any_value(kind) AS kind FROM tries JOIN files USING (f) GROUP BY path, source),
resolved AS (
  SELECT base.path, base.source, hit.file, CASE WHEN hit.file IS NOT NULL THEN hit.kind WHEN base.kind IS NOT NULL THEN 'unresolved' ELSE 'external' END AS via
  FROM base LEFT JOIN hit ON hit.path = base.path AND hit.source = base.source
)"""

LAYERED = f"""
{PATHS},
rules AS (SELECT * FROM (VALUES ('en', 'english', 0), ('fr', 'romance', 1), ('es', 'romance', 1), ('de', 'german', 2)) AS t(seg, layer, pos)),
segs AS (SELECT page_id, lower(s) AS seg, n FROM (SELECT page_id, unnest(string_split(path, '/')) AS s, generate_subscripts(string_split(path, '/'), 1) AS n FROM paths)),
first AS (SELECT page_id, arg_min(layer, -n * 100 + pos) AS layer FROM segs JOIN rules USING (seg) GROUP BY page_id),
layered AS (
  SELECT page_id, coalesce(first.layer, CASE WHEN path LIKE '%html' THEN 'english' WHEN path LIKE '%1' OR path LIKE '%3' THEN 'romance' WHEN path LIKE '%5' OR path LIKE '%7' THEN 'german' ELSE 'uncategorized' END) AS layer
  FROM paths LEFT JOIN first USING (page_id)
)"""

TEMPLATES = f"""
{PATHS},
dirs AS (SELECT DISTINCT d FROM (SELECT array_to_string(list_slice(string_split(path, '/'), 1, k), '/') AS d FROM paths, range(1, 10) AS r(k) WHERE k < len(string_split(path, '/'))) WHERE d <> ''),
names AS (SELECT string_split(path, '/')[-1] AS name FROM paths),
n AS (SELECT
  (SELECT count(*) FROM dirs WHERE d = 'en' OR d LIKE '%/en') AS en, (SELECT count(*) FROM dirs WHERE d = 'fr' OR d LIKE '%/fr') AS fr, (SELECT count(*) FROM dirs WHERE d = 'de' OR d LIKE '%/de') AS de,
  (SELECT count(*) FROM dirs WHERE d = 'none' OR d LIKE '%/none') AS nn, (SELECT count(*) FROM pages WHERE contains(html, 'track(1)')) AS tr, (SELECT count(*) FROM pages WHERE contains(html, 'charset')) AS ch,
  (SELECT count(*) FROM names WHERE regexp_matches(name, '^1[^/]$')) AS f1, (SELECT count(*) FROM names WHERE regexp_matches(name, '^[^/]*7$')) AS f7),
scores AS (
  SELECT 'clean-architecture' AS template, CAST(least(en, 3) * 2 + CASE WHEN tr > 0 THEN 1 ELSE 0 END AS BIGINT) AS score FROM n
  UNION ALL SELECT 'layered', CAST(least(fr, 3) * 3 + CASE WHEN ch > 0 THEN 2 ELSE 0 END AS BIGINT) FROM n
  UNION ALL SELECT 'mvc', CAST(least(de, 3) + f1 AS BIGINT) FROM n UNION ALL SELECT 'pipeline', CAST(least(nn, 3) * 5 + f7 AS BIGINT) FROM n
)"""

TOKENS = "regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')"

#: Labels over parts: context catalog.type.brand.kN; groups by name.
LABELS = """
p AS (SELECT p_partkey, p_name AS name, ['catalog', p_type, p_brand, 'k' || (p_partkey % 40)] AS segs, 'part ' || p_size AS sig FROM part),
g AS (
  SELECT name, count(*) AS n, CASE WHEN count(DISTINCT segs[1]) > 1 THEN 0 WHEN count(DISTINCT segs[2]) > 1 THEN 1 WHEN count(DISTINCT segs[3]) > 1 THEN 2 WHEN count(DISTINCT segs[4]) > 1 THEN 3 ELSE 4 END AS pre,
    CASE WHEN count(DISTINCT segs[4]) > 1 THEN 0 WHEN count(DISTINCT segs[3]) > 1 THEN 1 WHEN count(DISTINCT segs[2]) > 1 THEN 2 WHEN count(DISTINCT segs[1]) > 1 THEN 3 ELSE 4 END AS suf,
    count(DISTINCT segs[4]) = count(*) AS u1, count(DISTINCT segs[3:4]) = count(*) AS u2, count(DISTINCT segs[2:4]) = count(*) AS u3
  FROM p GROUP BY name
),
mids AS (SELECT p.*, g.n, u1, u2, u3, CASE WHEN pre + least(suf, 4 - pre) >= 4 THEN segs[4:4] ELSE segs[pre + 1 : 4 - least(suf, 4 - pre)] END AS mid FROM p JOIN g USING (name)),
dist AS (
  SELECT *, CASE WHEN len(mid) > 2 AND u1 THEN segs[4] WHEN len(mid) > 2 AND u2 THEN array_to_string(segs[3:4], '/') WHEN len(mid) > 2 AND u3 THEN array_to_string(segs[2:4], '/') ELSE array_to_string(mid, '/') END AS d FROM mids
),
l1 AS (SELECT *, CASE WHEN n = 1 THEN name ELSE d || ':' || name END AS label FROM dist),
l2 AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN array_to_string(segs, '.') || '.' || name ELSE label END AS label2 FROM l1),
l4 AS (SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY label2) > 1 THEN array_to_string(segs, '.') || '.' || name || ' ' || sig ELSE label2 END AS label FROM l2)"""

ORACLES: dict[str, str] = {
    "graph_edges": f"WITH {EDGES} SELECT src, dst, kind FROM edges",
    "node_degrees": f"WITH {G} SELECT id, in_degree, out_degree FROM degrees",
    "importance": f"WITH {G},{SCORED} SELECT id, importance FROM scored",
    "hub_topk": f"WITH {G},{HUBS} SELECT id, in_degree FROM hubs",
    "core_per_layer": f"""WITH {G},{SCORED},
      ranked AS (SELECT layer, id, importance, row_number() OVER (PARTITION BY layer ORDER BY importance DESC, id) AS r, count(*) OVER (PARTITION BY layer) AS n FROM scored)
      SELECT layer, id, r <= greatest(least(greatest(1, floor(n * CAST(0.3 AS DOUBLE))), 40), least(4, n)) AND importance > 0 AS core FROM ranked""",
    "dispatch_index": f"WITH {G},{SCORED},{DISPATCH} SELECT key, impl, CAST(r AS BIGINT) AS rank, CAST(greatest(n - 8, 0) AS BIGINT) AS omitted FROM impls WHERE n >= 2 AND r <= 8",
    "flow_seeds": f"""WITH {G},{SCORED},{HUBS},
      lead AS (SELECT id FROM scored WHERE visibility <> 'private' AND out_degree >= 2 AND id NOT IN (SELECT id FROM hubs) ORDER BY out_degree DESC, importance DESC, id LIMIT 12),
      best AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY layer ORDER BY importance DESC, id) AS r FROM scored WHERE visibility <> 'private' AND layer <> 'uncategorized') WHERE r = 1)
      SELECT id, 'public-orchestrator' AS seed_kind FROM lead UNION ALL SELECT id, 'subsystem' FROM best WHERE id NOT IN (SELECT id FROM lead)""",
    "flow_reach": f"""WITH RECURSIVE {G},{HUBS},
      walk AS (
        SELECT 'c:' || c_custkey AS flow, 'c:' || c_custkey AS id, 0 AS depth FROM customer
        UNION SELECT w.flow, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.id WHERE w.depth < 8 AND (w.id = w.flow OR w.id NOT IN (SELECT id FROM hubs))
      ) SELECT flow, id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY flow, id""",
    "dispatch_flows": f"""WITH {G},{SCORED},{HUBS},{DISPATCH},
      roots AS (SELECT ref AS key, id AS root, out_degree, row_number() OVER (PARTITION BY ref ORDER BY out_degree DESC, importance DESC, id) AS r FROM scored WHERE ref IS NOT NULL),
      sizes AS (SELECT DISTINCT key, n FROM impls WHERE n >= 2),
      chosen AS (SELECT s.key, s.n, root FROM sizes s JOIN roots ON roots.key = s.key AND roots.r = 1 ORDER BY s.n DESC, roots.out_degree DESC, s.key LIMIT 10),
      fan AS (SELECT c.key, c.n, c.root, i.impl FROM chosen c JOIN impls i ON i.key = c.key WHERE i.r <= 8),
      near AS (
        SELECT f.*, e.dst, row_number() OVER (PARTITION BY f.key, f.impl ORDER BY s.importance DESC, s.id) AS c
        FROM fan f JOIN edges e ON e.src = f.impl AND e.kind = 'uses' JOIN scored s ON s.id = e.dst WHERE e.dst <> f.root AND e.dst NOT IN (SELECT id FROM hubs)
      )
      SELECT key, root, root AS src, impl AS dst, 'dispatch' AS kind, CAST(greatest(n - 8, 0) AS BIGINT) AS omitted FROM fan
      UNION ALL SELECT key, root, impl, dst, 'uses', CAST(greatest(n - 8, 0) AS BIGINT) FROM near WHERE c <= 3""",
    "flow_subset_suppress": """WITH items AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), sizes AS (SELECT o, count(*) AS n FROM items GROUP BY o),
      shared AS (SELECT a.o AS a, b.o AS b, count(*) AS k FROM items a JOIN items b ON a.p = b.p AND a.o <> b.o GROUP BY a.o, b.o),
      gone AS (SELECT DISTINCT a FROM shared JOIN sizes x ON x.o = a JOIN sizes y ON y.o = b WHERE k = x.n AND (y.n > x.n OR b < a))
      SELECT o AS o_orderkey FROM sizes WHERE o NOT IN (SELECT a FROM gone)""",
    "layer_assign": f"WITH {LAYERED} SELECT page_id, layer FROM layered",
    "layer_fit": f"""WITH {LAYERED}, c AS (SELECT layer, count(*) AS n FROM layered GROUP BY layer),
      l AS (SELECT t.layer, coalesce(c.n, 0) AS n FROM (VALUES ('english'), ('romance'), ('german'), ('unused')) AS t(layer) LEFT JOIN c ON c.layer = t.layer),
      s AS (SELECT (SELECT count(*) FROM layered) AS total, count(*) AS total_layers, count(*) FILTER (n = 0) AS empty_layers, max(n) AS largest, (SELECT count(*) FROM layered WHERE layer = 'uncategorized') AS uncat FROM l),
      r AS (SELECT total, total_layers, empty_layers, round(uncat / total, 3) AS uncategorized_pct, round(largest / total, 3) AS largest_layer_pct FROM s)
      SELECT *, NOT (total >= 20 AND (uncategorized_pct >= 0.25 OR (empty_layers >= 2 AND largest_layer_pct >= 0.6))) AS fits FROM r""",
    "group_order": """WITH k AS (SELECT n_name, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS j, count(*) OVER (PARTITION BY n_regionkey) AS m FROM nation)
      SELECT n_name AS id, round(CAST(r_regionkey AS DOUBLE) + CASE WHEN r_regionkey % 2 = 1 THEN j / (m + 1) ELSE 0 END, 6) AS layer_order, r_name AS grp FROM k JOIN region ON r_regionkey = n_regionkey
      UNION ALL SELECT r_name, NULL, NULL FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation)""",
    "template_score": f"WITH {TEMPLATES} SELECT template, score FROM scores",
    "template_choice": f"WITH {TEMPLATES} SELECT template, score FROM scores ORDER BY score DESC, CASE WHEN template = 'clean-architecture' THEN 0 ELSE 1 END, template LIMIT 1",
    "language_histogram": "SELECT lang AS language, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents WHERE lang <> ''), 3) AS share FROM documents WHERE lang <> '' GROUP BY lang",
    "namespace_histogram": "SELECT CASE WHEN p_size > 45 THEN '(none)' ELSE 'catalog.' || p_type || '.' || p_brand END AS namespace, count(*) AS n FROM part GROUP BY 1",
    "vendored_dirs": """WITH f AS (SELECT source AS dir, lang, doc_id, lang NOT IN ('fr', 'en') AS fo FROM documents),
      c AS (SELECT dir, lang, count(*) AS c, min(doc_id) AS m FROM f WHERE fo GROUP BY dir, lang), t AS (SELECT dir, lang, row_number() OVER (PARTITION BY dir ORDER BY c DESC, m) AS r FROM c)
      SELECT f.dir, count(*) AS n, count(*) FILTER (fo) AS "foreign", any_value(t.lang) AS root FROM f JOIN t ON t.dir = f.dir AND t.r = 1 GROUP BY f.dir HAVING count(*) >= 5 AND count(*) FILTER (fo) / count(*) >= 0.1""",
    "dominant_unsupported": """WITH c AS (SELECT CASE lang WHEN 'es' THEN 'iberian' ELSE 'germanic' END AS language, count(*) AS files FROM documents WHERE lang IN ('de', 'en', 'es') GROUP BY 1)
      SELECT * FROM (SELECT language, files FROM c ORDER BY files DESC, language LIMIT 1) WHERE files > (SELECT count(*) FROM documents WHERE lang = 'fr')""",
    "token_mentions": f"SELECT token, count(*) AS n_docs FROM (SELECT DISTINCT doc_id, unnest({TOKENS}) AS token FROM documents) GROUP BY token",
    "false_edge_guard": f"""WITH items AS (SELECT item_id, {TOKENS}[1] AS token FROM benchmark), said AS (SELECT DISTINCT doc_id, unnest({TOKENS}) AS token FROM documents)
      SELECT doc_id, item_id FROM said JOIN items USING (token)""",
    "name_functions": """SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN p_name ELSE 'catalog.' || p_type || '.' || p_brand || '.' || p_name END AS qname, string_split(p_name, ' ')[-1] AS short,
        CASE WHEN p_size % 7 = 0 THEN replace(p_name, ' ', '_') ELSE p_brand END AS module, CASE WHEN p_size % 7 = 0 THEN '' ELSE 'catalog.' || p_type END AS root,
        'src/' || replace(p_name, ' ', '_') || '.py' AS changed, p_brand || '__' || replace(p_name, ' ', '-') AS repo, p_name IN ('MainActivity', 'Application', 'main', 'Main', 'App') AS entry FROM part""",
    "import_edges": """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS place FROM pages),
      n AS (SELECT *, lower(regexp_extract(href, '[^/.]*$')) AS local FROM l) SELECT page_id, local, arg_min(href, place) AS href FROM n GROUP BY page_id, local""",
    "specifier_resolve": f"WITH {SPECIFIERS} SELECT path, source, file, via FROM resolved",
    "resolution_coverage": f"""WITH {SPECIFIERS}, c AS (SELECT count(file) AS edges_resolved, count(*) FILTER (via IN ('external', 'unresolved')) AS edges_unresolved, count(*) FILTER (via = 'barrel') AS barrels_expanded, count(*) FILTER (via = 'alias') AS aliases_resolved FROM resolved)
      SELECT *, CASE WHEN edges_resolved + edges_unresolved = 0 THEN 1.0 ELSE round_even(edges_resolved / (edges_resolved + edges_unresolved), 3) END AS coverage FROM c""",
    "export_closure": """SELECT 's:' || s_suppkey AS path, s_name AS name, 's:' || s_suppkey AS id FROM supplier
      UNION ALL SELECT 'n:' || s_nationkey, s_name, 's:' || s_suppkey FROM supplier
      UNION ALL SELECT 'r:' || n_regionkey, s_name, 's:' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "display_names": f"WITH {LABELS} SELECT p_partkey, label FROM l4",
    "overload_labels": """WITH p AS (SELECT p_partkey, replace(p_brand, '#', '_') AS name, p_type, count(*) OVER (PARTITION BY p_brand) AS n FROM part), d AS (SELECT name, count(DISTINCT p_type) AS t FROM p GROUP BY name)
      SELECT p_partkey, CASE WHEN n = 1 THEN name WHEN d.t = n THEN name || ' → ' || p_type ELSE name || '(size: Int, key: K' || p_partkey || ')' END AS label FROM p JOIN d USING (name)""",
    "incremental_plan": """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'no-prior-build' WHEN event_id % 5 <> 0 AND event_id % 13 = 0 THEN 'extract-version-changed' WHEN event_id % 17 = 0 THEN 'refine-version-changed'
        WHEN event_id % 19 = 0 THEN 'no-anchor-commit' WHEN event_id % 23 = 0 THEN 'no-architecture-yml' WHEN event_id % 29 = 0 THEN 'not-a-git-repo' WHEN event_id % 31 = 0 THEN 'root-not-repo-toplevel'
        WHEN event_id % 37 = 0 THEN 'base-unreachable' WHEN event_id % 41 = 0 THEN 'git-diff-failed' WHEN user_id % 60 > 40 THEN 'too-many-changes' ELSE 'incremental' END AS reason FROM events""",
    "incremental_merge": """WITH j AS (SELECT d.doc_id, d.lang, d.doc_id % 3 = 0 AS core, l.doc_id IS NOT NULL AND CAST(regexp_extract(d.source, '([0-9]+)$', 1) AS INTEGER) % 2 = 0 AS reuse, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
      k AS (SELECT doc_id, CASE WHEN reuse AND toxic = 0 THEN 'fr' ELSE lang END AS layer, core OR (reuse AND quality = 1) AS core, CAST(CASE WHEN reuse THEN 1 ELSE 0 END AS BIGINT) AS n_tags, CASE WHEN reuse AND toxic = 0 THEN 'text' END AS description FROM j)
      SELECT *, core AND description IS NULL AS stale FROM k""",
    "flow_merge": """WITH dirty AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'),
      hit AS (SELECT DISTINCT conv_id FROM conversations WHERE (conv_id * 7 + turn * 13) % 200 IN (SELECT user_id FROM dirty))
      SELECT conv_id, CASE WHEN s THEN 'previous' ELSE 'fresh' END AS origin, NOT s OR conv_id IN (SELECT conv_id FROM hit) AS needs_review FROM (SELECT conv_id, bool_or(role = 'system') AS s FROM conversations GROUP BY conv_id)""",
    "overlay_reconcile": """WITH e AS (SELECT event_id, event_type, CASE event_id % 3 WHEN 0 THEN 'inactive' ELSE 'active' END AS status, user_id * 40 IN (SELECT c_custkey FROM customer) AS d, event_id % 30 IN (SELECT n_nationkey FROM nation) AS l,
        user_id IN (SELECT c_custkey FROM customer) AND user_id * 30 IN (SELECT c_custkey FROM customer) AS f FROM events),
      a AS (SELECT event_id, status, CASE event_type WHEN 'click' THEN d AND l WHEN 'view' THEN d WHEN 'purchase' THEN f ELSE false END AS alive FROM e)
      SELECT event_id, CASE WHEN alive THEN 'active' ELSE 'inactive' END AS status, CASE WHEN alive AND status = 'inactive' THEN 'reactivated' WHEN NOT alive AND status = 'active' THEN 'suspended' ELSE 'none' END AS change FROM a""",
    "overlay_layer_moves": """WITH m AS (SELECT user_id, arg_max(event_type, event_id) AS l, bool_or(value > 20) AS c FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id)
      SELECT p_partkey, CASE WHEN m.l IS NOT NULL AND p_size % 10 <> 0 THEN m.l ELSE p_type END AS layer, p_size > 40 OR (m.l IS NOT NULL AND p_size % 10 <> 0 AND m.c) AS core FROM part LEFT JOIN m ON m.user_id = p_partkey""",
    "overlay_descriptions": """WITH z AS (SELECT user_id, arg_max(event_type, event_id) AS v FROM events WHERE event_id % 2 = 0 GROUP BY user_id), n AS (SELECT user_id, arg_max(event_type, event_id) AS v FROM events WHERE event_id % 5 = 0 GROUP BY user_id)
      SELECT c_custkey, coalesce(z.v, 'old') AS description_zh, n.v AS description_en FROM customer LEFT JOIN z ON z.user_id = c_custkey LEFT JOIN n ON n.user_id = c_custkey""",
    "overlay_flows": f"""WITH {PART_SETS}, i AS (SELECT o, unnest(nodes) AS p, len(nodes) AS n FROM sets),
      u AS (SELECT o_orderkey AS o, 'u' || o_custkey AS id, nodes[1 : greatest(len(nodes) - 1, 1)] AS n FROM orders JOIN sets ON sets.o = o_orderkey WHERE o_orderpriority = '1-URGENT'),
      ui AS (SELECT o, unnest(n) AS p, len(n) AS n FROM u),
      sim AS (SELECT i.o FROM i JOIN ui ON ui.p = i.p GROUP BY i.o, ui.o, i.n, ui.n HAVING count(*) / (i.n + ui.n - count(*)) >= 0.6),
      own AS (SELECT x.o FROM u x JOIN u y ON y.id = x.id AND y.o > x.o UNION SELECT x.o FROM ui x JOIN ui y ON y.p = x.p AND y.o > x.o GROUP BY x.o, y.o, x.n, y.n HAVING count(*) / (x.n + y.n - count(*)) >= 0.6)
      SELECT CAST(o AS VARCHAR) AS id, false AS by_user, CAST(len(nodes) AS BIGINT) AS n_nodes FROM sets WHERE o NOT IN (SELECT o FROM sim) UNION ALL SELECT id, true, CAST(len(n) AS BIGINT) FROM u WHERE o NOT IN (SELECT o FROM own)""",
    "jaccard_suppress": """WITH i AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), s AS (SELECT o, count(*) AS n FROM i GROUP BY o),
      k AS (SELECT a.o AS a, b.o AS b, count(*) AS c FROM i a JOIN i b ON a.p = b.p AND a.o < b.o GROUP BY a.o, b.o)
      SELECT a, b, round(c / (x.n + y.n - c), 6) AS similarity FROM k JOIN s x ON x.o = a JOIN s y ON y.o = b WHERE c / (x.n + y.n - c) >= 0.6""",
    "inv1_duplicates": "SELECT p_type AS layer, p_name AS label, count(*) AS n, min(p_partkey) AS first_id FROM part WHERE p_size > 10 GROUP BY 1, 2 HAVING count(*) > 1",
    "inv_label_width": """WITH d AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 9 = 0 THEN '漢字' ELSE '' END AS s FROM documents),
      u AS (SELECT doc_id, CAST(length(s) + CASE WHEN doc_id % 9 = 0 THEN 2 ELSE 0 END AS BIGINT) AS units FROM d) SELECT doc_id, units, round(units * 7.0::DOUBLE) + 16.0 AS needed FROM u WHERE 1500 < round(units * 7.0::DOUBLE) + 16 - 1""",
    "inv_bilingual": """SELECT doc_id, CASE WHEN quality = 1 THEN 'missing-en' WHEN toxic = 0 THEN 'missing-zh' ELSE 'missing-both' END AS state FROM labels
      WHERE (quality = 1 AND toxic = 1) OR (quality = 0 AND toxic = 0) OR (quality = 0 AND toxic = 1 AND doc_id % 2 = 0)""",
    "sequence_validate": """WITH c AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations), r AS (SELECT DISTINCT conv_id, role FROM conversations),
      e AS (
        SELECT conv_id, 'participant-id' AS rule FROM r WHERE conv_id % 10 = 0 UNION ALL SELECT conv_id, 'participant-name' FROM r WHERE conv_id % 7 = 0
        UNION ALL SELECT conv_id, 'participant-kind' FROM r WHERE role = 'system' UNION ALL SELECT conv_id, 'step-to' FROM c WHERE nxt IS NULL
        UNION ALL SELECT conv_id, 'step-label' FROM c WHERE trim(text) = '' OR text IS NULL UNION ALL SELECT conv_id, 'self-step' FROM c WHERE turn % 5 = 4 AND role IS DISTINCT FROM coalesce(nxt, 'nobody')
        UNION ALL SELECT conv_id, 'few-participants' FROM r GROUP BY conv_id HAVING count(*) < 2
      ) SELECT conv_id, rule, count(*) AS n FROM e GROUP BY conv_id, rule""",
    "pipeline_validate": """WITH li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) AS nth FROM lineitem),
      f AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 5), s AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
      e AS (
        SELECT l_orderkey, 'stage-name' AS rule FROM s WHERE l_linenumber = 3
        UNION ALL SELECT li.l_orderkey, 'node-not-in-flow' FROM li LEFT JOIN f ON f.l_orderkey = li.l_orderkey AND f.l_partkey = li.l_partkey WHERE f.l_partkey IS NULL
        UNION ALL SELECT l_orderkey, 'node-unknown' FROM li LEFT JOIN part ON p_partkey = l_partkey AND p_size > 3 WHERE p_partkey IS NULL
        UNION ALL SELECT l_orderkey, 'node-twice' FROM li WHERE nth > 1
        UNION ALL SELECT li.l_orderkey, 'link-to' FROM li LEFT JOIN s ON s.l_orderkey = li.l_orderkey AND s.l_linenumber = li.l_linenumber + 1 WHERE s.l_orderkey IS NULL
        UNION ALL SELECT l_orderkey, 'link-kind' FROM li WHERE l_returnflag = 'R'
        UNION ALL SELECT o_orderkey, r FROM orders, (VALUES ('no-stages'), ('no-links')) AS t(r) WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
      ) SELECT l_orderkey AS o_orderkey, rule, count(*) AS n FROM e GROUP BY 1, 2""",
    "neighbors": f"WITH {EDGES} SELECT dst AS id, 'out' AS direction, kind FROM edges WHERE src = 'p:1' UNION SELECT src, 'in', kind FROM edges WHERE dst = 'p:1'",
    "file_walk_dedup": f"""WITH {PATHS}, k AS (SELECT page_id, path AS realpath, CASE WHEN page_id % 5 = 0 THEN 'build/' ELSE '' END || path AS path FROM paths WHERE page_id % 5 <> 0 AND NOT ('/' || path) LIKE '%/de/%')
      SELECT min(page_id) AS page_id, arg_min(path, page_id) AS path FROM k GROUP BY realpath""",
    "changed_files": "SELECT DISTINCT 'src/u' || user_id || '.py' AS path FROM events WHERE event_type IN ('click', 'error')",
    "golden_diff": """SELECT p_partkey, p_brand, round(p_retailprice, 6) AS price, 'removed' AS side FROM part WHERE p_partkey % 97 = 0 OR p_partkey % 89 = 0
      UNION ALL SELECT p_partkey, p_brand, round(p_retailprice + 1, 6), 'added' FROM part WHERE p_partkey % 89 = 0 AND p_partkey % 97 <> 0""",
    "type_function_counts": f"WITH {NODES} SELECT layer, count(*) FILTER (kind = 'class') AS types, count(*) FILTER (kind <> 'class') AS functions FROM nodes GROUP BY layer",
    "structure_json": "SELECT p_type AS layer, sha256('[' || string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) || ']') AS digest FROM part GROUP BY p_type",
    "kind_rollup": f"WITH {NODES} SELECT left(id, 1) AS language, layer, kind, count(*) AS n FROM nodes GROUP BY ROLLUP (left(id, 1), layer, kind)",
    "mermaid_text": """WITH c AS (SELECT conv_id, turn, role, regexp_replace(replace(coalesce(text, ''), '"', '#quot;'), '[\\r\\n]+', ' ', 'g') AS label, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
      p AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) - 1 AS a FROM conversations GROUP BY conv_id, role),
      h AS (SELECT conv_id, string_agg('  participant a' || a || ' as ' || role, chr(10) ORDER BY a) AS t FROM p GROUP BY conv_id),
      s AS (SELECT c.conv_id, string_agg('  a' || x.a || '->>a' || y.a || ': ' || i || '. ' || replace(label, ';', '،'), chr(10) ORDER BY i) AS t FROM c JOIN p x ON x.conv_id = c.conv_id AND x.role = c.role JOIN p y ON y.conv_id = c.conv_id AND y.role = coalesce(c.nxt, c.role) GROUP BY c.conv_id)
      SELECT h.conv_id, 'sequenceDiagram' || chr(10) || h.t || chr(10) || s.t AS text FROM h JOIN s USING (conv_id)""",
}
