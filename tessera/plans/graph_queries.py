"""Queries of the code plane: references, names, resolution, listings, line search, snapshots, validation, parsing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.operators import graph, index, parsers, snapshot, stored_graph, vfs, write_path
from tessera.plans.registry import query
from tessera.plans.retrieval_queries import r6
from tessera.sources import adapters as A
from tessera.sources.shared import checkpoint_dir
from tessera.sources.store import Lease, Store
from tessera.sources.tables import table

_NODES = """nodes AS (
SELECT 'c' || c_custkey AS id, 'class' AS kind, c_name AS name, 'src/' || lower(replace(n_name, ' ', '_')) || '.rs' AS file_path, 1 AS start_line FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'o' || o_orderkey, 'method', 'order' || o_orderkey, 'src/' || lower(replace(n_name, ' ', '_')) || '.rs', 2 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'p' || p_partkey, 'function', p_name, 'parts/' || lower(regexp_replace(p_brand, '[# ]', '_', 'g')) || '.rs', p_size FROM part
UNION ALL SELECT 's' || s_suppkey, 'trait', s_name, 'supply.rs', 1 FROM supplier)"""
_EDGES = """edges AS (
SELECT 'c' || o_custkey AS source, 'o' || o_orderkey AS target, 'contains' AS kind, 1 AS line FROM orders
UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'calls', l_linenumber FROM lineitem
UNION ALL SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey, 'references', 1 FROM lineitem)"""
_GRAPH = f"{_NODES}, {_EDGES}"


def _asked(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.filter(F.col("kind") == kind).select(F.col("id").alias("asked"))


@query(f"WITH {_GRAPH} SELECT e.target AS asked, n.id, e.kind, CAST(e.line AS BIGINT) AS line FROM edges e JOIN nodes n ON n.id = e.source WHERE e.kind IN ('calls', 'references', 'implements') AND e.target LIKE 'p%'")
def ref_in(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = A.graph(spark, d)
    return graph.references(edges, nodes, _asked(nodes, "function"), True).withColumn("line", F.col("line").cast("long"))


@query(f"WITH {_GRAPH} SELECT e.source AS asked, n.id, e.kind, CAST(e.line AS BIGINT) AS line FROM edges e JOIN nodes n ON n.id = e.target WHERE e.kind IN ('calls', 'references', 'implements') AND e.source LIKE 'o%'")
def ref_out(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = A.graph(spark, d)
    return graph.references(edges, nodes, _asked(nodes, "method"), False).withColumn("line", F.col("line").cast("long"))


@query(f"WITH {_GRAPH} SELECT id, name FROM nodes n WHERE kind IN ('function', 'method') AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.target = n.id AND e.kind = 'calls')")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = A.graph(spark, d)
    return graph.orphans(nodes, edges).select("id", "name")


@query(f"""WITH {_GRAPH}, a AS (SELECT id AS asked, file_path FROM nodes WHERE kind IN ('class', 'trait')),
i AS (SELECT DISTINCT asked, n.id FROM a JOIN edges e ON e.source = a.asked AND e.kind = 'contains' JOIN nodes n ON n.id = e.target)
SELECT asked, id FROM i UNION ALL SELECT a.asked, n.id FROM a JOIN nodes n USING (file_path) WHERE a.asked NOT IN (SELECT asked FROM i)""")
def members(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = A.graph(spark, d)
    return graph.members(nodes, edges, _asked(nodes, "class").union(_asked(nodes, "trait")))


@query("SELECT DISTINCT 'p' || l_partkey AS id FROM lineitem")
def implementors(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose references to suppliers are taken as implementations."""
    nodes, edges = A.graph(spark, d)
    edges = edges.withColumn("kind", F.when(F.col("kind") == "references", "implements").otherwise(F.col("kind")))
    return graph.implementors(nodes, edges, _asked(nodes, "trait")).select("id")


@query(f"WITH {_GRAPH} SELECT DISTINCT n.id, n.kind FROM nodes a JOIN edges e ON e.target = a.id JOIN nodes n ON n.id = e.source WHERE a.kind IN ('trait', 'function') AND e.kind IN ('calls', 'references')")
def neighbors_batch(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = A.graph(spark, d)
    return graph.neighbours(edges, nodes, _asked(nodes, "trait").union(_asked(nodes, "function")), True).select("id", "kind")


@query(f"WITH {_GRAPH} SELECT count(DISTINCT file_path) AS files, count(*) AS nodes, (SELECT count(*) FROM edges) AS edges FROM nodes")
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = A.graph(spark, d)
    return nodes.agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))


_SYMBOLS = """s AS (SELECT 'p' || p_partkey AS id, ['function', 'struct', 'method', 'trait', 'enum'][p_size % 5 + 1] AS kind, p_name AS name,
lower(regexp_replace(p_brand, '[# ]', '_', 'g')) || '/' || lower(split_part(p_type, ' ', 1)) || '.rs' AS file_path, p_size AS start_line FROM part)"""
_PRIORITY = "CASE WHEN kind IN ('struct', 'class', 'trait', 'enum', 'type_alias') THEN 0.10 WHEN kind = 'function' THEN 0.06 WHEN kind = 'method' THEN 0.04 ELSE 0.02 END"


@query(f"""WITH {_SYMBOLS}, q AS (SELECT DISTINCT split_part(upper(p_name), ' ', 1) AS query FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part),
f AS (SELECT query AS qid, id, name, CASE WHEN name = query THEN 0 WHEN lower(name) = lower(query) THEN 1 WHEN starts_with(lower(name), lower(query)) THEN 2 ELSE 3 END AS tier,
      {_PRIORITY} AS pr, file_path, start_line FROM s JOIN q ON contains(lower(name), lower(query))),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tier, pr DESC, strlen(name), file_path, start_line, id) AS rank, count(*) OVER (PARTITION BY qid) AS total_matches FROM f)
SELECT qid, id, name, CAST(tier AS BIGINT) AS tier, CAST(rank AS BIGINT) AS rank, total_matches FROM r WHERE rank <= 20""")
def find_tiers(spark: SparkSession, d: str) -> DataFrame:
    first = F.split_part("name", F.lit(" "), F.lit(1))
    s = A.parts_as_symbols(spark, d)
    asked = s.select(F.upper(first).alias("query")).union(s.select(first)).distinct().select("query", F.col("query").alias("qid"))
    found = graph.find(s, asked)
    return found.select("qid", "id", "name", F.col("tier").cast("long").alias("tier"), F.col("rank").cast("long").alias("rank"), "total_matches")


@query(f"""WITH {_SYMBOLS}, q AS (SELECT name, name || '|' || h AS qid, CASE h WHEN 1 THEN 'Brand_1' WHEN 3 THEN 'nowhere' END AS file, CASE WHEN h = 2 THEN 'TRAIT' END AS kh, CASE WHEN h = 1 THEN 'brand_11' END AS scope FROM (SELECT DISTINCT name FROM s), (SELECT unnest([0, 1, 2, 3]) AS h)),
x AS (SELECT qid, id, file_path, file, kh, scope, kind, coalesce(contains(file_path, lower(file)), false) AS ff, coalesce(lower(kind) = lower(kh), false) AS kf, coalesce(file_path = scope OR starts_with(file_path, scope || '/'), false) AS sf FROM s JOIN q USING (name)),
y AS (SELECT *, least(1.0, 0.5 + CASE WHEN ff THEN 0.4 ELSE 0 END + CASE WHEN kh IS NULL THEN {_PRIORITY} WHEN kf THEN 0.2 ELSE 0 END + CASE WHEN sf THEN 0.1 ELSE 0 END) AS score,
      (file IS NULL OR ff) AND (kh IS NULL OR kf) AND (scope IS NULL OR sf) AS m, file IS NOT NULL OR kh IS NOT NULL OR scope IS NOT NULL AS hinted FROM x),
z AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n, CASE WHEN hinted THEN count(*) FILTER (WHERE m) OVER (PARTITION BY qid) ELSE 0 END AS nf FROM y),
w AS (SELECT * FROM z WHERE n = 1 OR nf = 0 OR m),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, strlen(file_path), id) AS rank, count(*) OVER (PARTITION BY qid) AS total FROM w)
SELECT qid, id, CASE WHEN n = 1 OR nf = 1 THEN 'ok' ELSE 'ambiguous' END AS status, CAST(round(score, 6) AS DOUBLE) AS score, CAST(rank AS BIGINT) AS rank, total FROM r WHERE rank <= 20""")
def ambiguous_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every name without hints, with file and scope, with a kind, and with a file that is nowhere."""
    s = A.parts_as_symbols(spark, d)
    asked = s.select("name").distinct().withColumn("h", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    file = F.when(F.col("h") == 1, "Brand_1").when(F.col("h") == 3, "nowhere")
    asked = asked.select("name", F.concat_ws("|", "name", F.col("h").cast("string")).alias("qid"), file.alias("file"), F.when(F.col("h") == 2, "TRAIT").alias("kind_hint"), F.when(F.col("h") == 1, "brand_11").alias("scope"))
    return graph.pick(s, asked).select("qid", "id", "status", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"), "total")


_PLACE = "place AS (SELECT s_suppkey, 'r' || n_regionkey || '/n' || n_nationkey || '/' || CASE WHEN s_suppkey % 7 = 0 THEN 'tests/' WHEN s_suppkey % 11 = 0 THEN 'examples/' ELSE '' END || 'S' || s_suppkey || '.rs' AS f FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@query(f"""WITH {_PLACE}, pairs AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
refs AS (SELECT l_partkey || '-' || l_suppkey AS ref_id, p_name AS name, f, l_suppkey % 2 = 0 AS calls, CASE WHEN l_suppkey % 3 = 0 THEN p_name END AS q FROM pairs JOIN part ON p_partkey = l_partkey JOIN place ON s_suppkey = l_suppkey),
cands AS (SELECT 'p' || p_partkey AS id, p_name AS name, ['function', 'struct', 'method', 'trait', 'enum'][p_size % 5 + 1] AS kind, f AS path
          FROM part JOIN (SELECT l_partkey, min(l_suppkey) AS s FROM pairs GROUP BY 1) ON l_partkey = p_partkey JOIN place ON s_suppkey = s),
x AS (SELECT ref_id, id, f, path, split_part(path, '/', 1) AS top, (kind IN ('function', 'method')) = calls AS pref,
      CASE WHEN f = path THEN 100 WHEN regexp_extract(f, '^(.*)/[^/]*$', 1) = regexp_extract(path, '^(.*)/[^/]*$', 1) THEN 50 WHEN split_part(f, '/', 1) = split_part(path, '/', 1) THEN 20 ELSE 0 END
      + CASE WHEN (kind IN ('function', 'method')) = calls THEN 15 ELSE 0 END
      + CASE WHEN EXISTS (SELECT 1 FROM cands t WHERE t.name = q AND t.path = cands.path AND t.kind NOT IN ('function', 'method')) THEN 40 ELSE 0 END
      - CASE WHEN (contains(path, '/tests/') OR starts_with(path, 'tests/') OR contains(path, '/test/')) AND path <> f THEN 40 ELSE 0 END
      - CASE WHEN contains(path, 'examples/') AND NOT contains(f, 'examples/') THEN 20 ELSE 0 END AS score FROM refs JOIN cands USING (name)),
b AS (SELECT * FROM (SELECT *, count(*) OVER w AS n, max(score) OVER w AS best FROM x WINDOW w AS (PARTITION BY ref_id)) WHERE n = 1 OR (score = best AND best >= 0)),
c AS (SELECT *, count(*) OVER w AS nb, bool_and(path = f) OVER w AS here, count(*) FILTER (WHERE pref) OVER w AS np, row_number() OVER (PARTITION BY ref_id ORDER BY id) AS nth FROM b WINDOW w AS (PARTITION BY ref_id)),
p AS (SELECT *, np = 0 OR pref AS pool FROM c),
e AS (SELECT *, count(*) OVER w AS npool, min(top) OVER w = max(top) OVER w AS one FROM p WINDOW w AS (PARTITION BY ref_id, pool))
SELECT ref_id, id, CAST(score AS BIGINT) AS score FROM e
WHERE n = 1 OR nb = 1 OR CASE WHEN here THEN nth <= 8 ELSE pool AND (np = 1 OR npool = 2 OR (npool <= 4 AND one)) END""")
def resolve_refs(spark: SparkSession, d: str) -> DataFrame:
    refs, candidates = A.references(spark, d)
    return graph.resolve(refs, candidates).withColumn("score", F.col("score").cast("long"))


@query(f"""WITH {_GRAPH}, own AS (SELECT id, file_path AS anchor, CASE WHEN name IN (SELECT name FROM nodes WHERE kind = 'function' AND contains(name, 'red')) THEN 2.0 ELSE 1.0 END AS w FROM nodes WHERE kind <> 'file' AND starts_with(file_path, 'parts/')),
k AS (SELECT * FROM edges WHERE kind IN ('calls', 'references', 'implements')),
o AS (SELECT anchor, w, target AS id FROM k JOIN own ON own.id = source UNION ALL SELECT anchor, w, source FROM k JOIN own ON own.id = target),
f AS (SELECT anchor, file_path, sum(w) AS score FROM o JOIN nodes USING (id) WHERE file_path <> anchor GROUP BY 1, 2)
SELECT anchor, file_path, CAST(score AS DOUBLE) AS score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, file_path) AS rank FROM f) WHERE rank <= 20""")
def neighbor_files_rank(spark: SparkSession, d: str) -> DataFrame:
    """Anchors: the files of parts; their change mentions, as whole words, the names that have red in them."""
    nodes, edges = A.graph(spark, d)
    parts = nodes.filter(F.startswith("file_path", F.lit("parts/")))
    changes = parts.groupBy(F.col("file_path").alias("anchor")).agg(F.array_join(F.collect_set(F.when(F.contains("name", F.lit("red")), F.col("name"))), "; ").alias("diff"))
    anchors = graph.changed_names(parts, changes)
    found = graph.neighbour_files(edges, nodes, anchors)
    return found.select("anchor", "file_path", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_GRAPH}, p AS (SELECT DISTINCT a.file_path AS a, b.file_path AS b FROM edges e JOIN nodes a ON a.id = source JOIN nodes b ON b.id = target WHERE e.kind IN ('calls', 'references')),
h1 AS (SELECT a, b FROM p WHERE a <> b UNION SELECT b, a FROM p WHERE a <> b),
h2 AS (SELECT x.a, y.b FROM h1 x JOIN h1 y ON x.b = y.a WHERE x.a <> y.b UNION SELECT a, b FROM h1)
SELECT f.file_path, CAST((SELECT count(*) FROM h1 WHERE a = f.file_path) AS BIGINT) AS hop1, CAST((SELECT count(*) FROM h2 WHERE a = f.file_path) AS BIGINT) AS hop2 FROM (SELECT DISTINCT file_path FROM nodes) f""")
def reach_2hop(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = A.graph(spark, d)
    return graph.reach(edges, nodes)


_PATHS = "paths AS (SELECT regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '') AS path FROM pages)"


@query(f"""WITH {_PATHS}, p AS (SELECT string_split(path, '/') AS p FROM paths), e AS (SELECT p, unnest(range(0, len(p))) AS i FROM p),
r AS (SELECT array_to_string(p[1:i], '/') AS dir, p[i + 1] AS name, CASE WHEN i + 1 < len(p) THEN 'dir' ELSE 'file' END AS kind FROM e)
SELECT dir, name, kind, count(*) AS n_files FROM r WHERE name <> '' GROUP BY ALL""")
def ls_dir(spark: SparkSession, d: str) -> DataFrame:
    return vfs.children(A.page_paths(spark, d))


@query(f"""WITH {_PATHS}, p AS (SELECT DISTINCT path FROM paths), s AS (SELECT DISTINCT split_part(path, '/', 1) AS prefix FROM paths UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM paths WHERE path LIKE '%/fr/%'),
b AS (SELECT p.path, max_by(prefix, length(prefix)) AS prefix FROM p LEFT JOIN s ON p.path = s.prefix OR starts_with(p.path, s.prefix || '/') GROUP BY 1)
SELECT path, coalesce(prefix, '') AS prefix, CASE WHEN prefix IS NULL THEN path ELSE substr(path, length(prefix) + 2) END AS rest FROM b""")
def route_prefix(spark: SparkSession, d: str) -> DataFrame:
    paths = A.page_paths(spark, d).distinct()
    host, second = F.split_part("path", F.lit("/"), F.lit(1)), F.split_part("path", F.lit("/"), F.lit(2))
    shards = paths.select(host.alias("prefix")).union(paths.filter("path like '%/fr/%'").select(F.concat_ws("/", host, second))).distinct()
    return vfs.route(paths, shards)


@query(f"""WITH {_SYMBOLS} SELECT file_path, file_path || chr(10) || string_agg('  ' || name || '  ' || kind || '  ' || start_line || '-' || (start_line + 5), chr(10) ORDER BY start_line, id) AS text FROM s GROUP BY file_path""")
def outline(spark: SparkSession, d: str) -> DataFrame:
    return vfs.outline(A.parts_as_symbols(spark, d))


_LINES = """files AS (SELECT source || '/d' || doc_id || '.txt' AS file_path, text FROM documents), asked AS (SELECT unnest(['password', 'the', 'ñ']) AS qid),
ln AS (SELECT file_path, unnest(string_split_regex(text, '\\r?\\n')) AS l, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS line, len(string_split_regex(text, '\\r?\\n')) AS n FROM files),
hits AS (SELECT qid, file_path, line, l FROM ln, asked WHERE contains(l, qid) AND NOT (line = n AND l = '')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY file_path, line) AS rank, count(*) OVER (PARTITION BY qid) AS total FROM hits)"""


def _needles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q, q) for q in ("password", "the", "ñ")], "qid string, query string")


@query(f"WITH {_LINES} SELECT qid, file_path, CAST(line AS BIGINT) AS line, CASE WHEN length(l) > 300 THEN substr(l, 1, 297) || '…' ELSE l END AS text, CAST(rank AS BIGINT) AS rank, total FROM ranked")
def grep_lines(spark: SparkSession, d: str) -> DataFrame:
    g = vfs.grep(A.document_files(spark, d), _needles(spark))
    return g.select("qid", "file_path", F.col("line").cast("long").alias("line"), "text", F.col("rank").cast("long").alias("rank"), "total")


@query(f"""WITH {_LINES} SELECT qid, file_path, CAST(line AS BIGINT) AS line, CAST(rank AS BIGINT) AS rank, total,
CASE WHEN len(string_split(text, chr(10))) <= 1 THEN file_path || ':all' ELSE file_path || ':' || CAST((line - 1) // 2 AS BIGINT) END AS symbol
FROM ranked JOIN files USING (file_path) WHERE rank <= 20""")
def grep_symbol(spark: SparkSession, d: str) -> DataFrame:
    files = A.document_files(spark, d)
    g = vfs.grep_symbols(files, _needles(spark), A.spans(files))
    return g.select("qid", "file_path", F.col("line").cast("long").alias("line"), F.col("rank").cast("long").alias("rank"), "total", "symbol")


_STATUS = "SELECT 'd' || doc_id AS path, CASE doc_id % 10 WHEN 0 THEN 'modified' WHEN 1 THEN 'removed' WHEN 2 THEN 'touched' WHEN 3 THEN 'added' WHEN 4 THEN 'skipped' ELSE 'unchanged' END AS status FROM documents"


@query(_STATUS)
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.diff(*A.snapshots(spark, d))


@query(f"""SELECT count(*) FILTER (WHERE status <> 'removed') AS checked, count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'modified') AS modified, count(*) FILTER (WHERE status = 'touched') AS touched,
count(*) FILTER (WHERE status = 'removed') AS removed, count(*) FILTER (WHERE status IN ('added', 'modified')) AS parsed, count(*) FILTER (WHERE status = 'skipped') AS skipped FROM ({_STATUS})""")
def sync_report(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.report(snapshot.diff(*A.snapshots(spark, d)))


@query("""WITH t AS (SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 10 NOT IN (1))
SELECT w AS word, count(DISTINCT path) AS files FROM (SELECT path, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS w FROM t) GROUP BY w""")
def incremental_vs_full(spark: SparkSession, d: str) -> DataFrame:
    """A word index kept by replacing the rows of changed files; SQL builds it from the new snapshot in one go."""
    from tessera.functions import text as T

    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "text")

    def index(rows: DataFrame) -> DataFrame:
        return rows.select("path", F.explode(F.array_distinct(T.split_words("text"))).alias("word"))

    status = snapshot.diff(*A.snapshots(spark, d))
    old = index(docs.filter("doc_id % 10 <> 3"))
    new_text = docs.withColumn("text", F.when(F.pmod("doc_id", F.lit(10)) == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    fresh = index(new_text.join(status.filter("status in ('added', 'modified')").select("path"), "path", "left_semi"))
    kept = snapshot.replaced(old, fresh, status.filter("status = 'removed'").select("path"), "path")
    return kept.groupBy("word").agg(F.count("*").alias("files"))


@query(f"""WITH {_SYMBOLS}, changed AS (SELECT DISTINCT file_path FROM s WHERE starts_with(file_path, 'brand_11/')), names AS (SELECT DISTINCT name FROM s WHERE file_path IN (SELECT file_path FROM changed))
SELECT file_path FROM changed UNION SELECT DISTINCT file_path FROM s WHERE name IN (SELECT name FROM names)
UNION SELECT DISTINCT 'impl/' || file_path FROM s WHERE name IN (SELECT name FROM names)
UNION SELECT DISTINCT 'by/' || file_path FROM s WHERE start_line % 2 = 0 AND name IN (SELECT name FROM names)""")
def affected_files(spark: SparkSession, d: str) -> DataFrame:
    """A change of one brand's files: files that use a name they define (here: define the same name) are affected."""
    s = A.parts_as_symbols(spark, d)
    changed = s.filter(F.startswith("file_path", F.lit("brand_11/"))).select("file_path").distinct()
    refs = s.select("file_path", F.col("name").alias("target_name"), F.when(F.col("start_line") % 2 == 0, F.lower("id")).alias("qualifier"))
    impls = s.select(F.concat(F.lit("impl/"), "file_path").alias("file_path"), F.when(F.col("start_line") % 3 > 0, F.col("name")).alias("type_name"), F.when(F.col("start_line") % 3 == 0, F.col("name")).alias("trait_name"))
    refs = refs.union(s.select(F.concat(F.lit("by/"), "file_path"), F.lit("other"), F.when(F.col("start_line") % 2 == 0, F.col("name"))))
    return graph.affected_files(changed, s.join(changed, "file_path", "left_semi").select("name"), refs, impls)


@query(f"""WITH {_GRAPH}, x AS (SELECT source, target, CASE kind WHEN 'contains' THEN 'contains' ELSE kind END AS kind, line FROM edges)
SELECT kind, count(*) AS n FROM (
  SELECT DISTINCT source, target, kind, line FROM x
  UNION SELECT 'p' || l_partkey, 's' || l_suppkey, 'implements', 1 FROM lineitem
  UNION SELECT 'file:' || file_path, id, 'contains', start_line FROM nodes
  UNION SELECT 'p' || l_partkey, 'o' || l_orderkey, 'contains', 7 FROM lineitem WHERE l_linenumber = 1
  UNION SELECT 'o' || l_orderkey, 'p' || l_partkey, 'references', 7 FROM lineitem WHERE l_linenumber = 1
  UNION SELECT 'o' || l_orderkey, 's' || l_suppkey, 'references', 7 FROM lineitem WHERE l_linenumber = 1) GROUP BY kind""")
def edge_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Files that contain their symbols, references, and parts whose suppliers are traits: blocks, and orders as methods."""
    nodes, edges = A.graph(spark, d)
    files = nodes.select(F.concat(F.lit("file:"), "file_path").alias("id"), F.lit("file").alias("kind"), F.col("file_path").alias("name"), "file_path", F.lit(1).alias("start_line"), F.lit(1).alias("end_line")).distinct()
    nodes = files.union(nodes)
    calls = table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("type_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("trait_id"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("method_id"), F.lit(1).alias("line"), F.lit(7).alias("method_line"))
    pairs = table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("type_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("trait_id"))
    impls = pairs.select("type_id", "trait_id", F.lit(None).cast("string").alias("method_id"), F.lit(1).alias("line"), F.lit(None).cast("int").alias("method_line"))
    return graph.built_edges(nodes, edges, impls.union(calls)).groupBy("kind").agg(F.count("*").alias("n"))


_FAULTS = """WITH d AS (SELECT conv_id AS batch, turn AS i, conv_id * 100 + turn AS id, CASE WHEN turn % 5 = 4 THEN '' ELSE text END AS body, CASE WHEN conv_id % 7 = 0 AND turn = 1 THEN 'при ' || role ELSE role END AS summary, conv_id, turn FROM conversations),
e AS (SELECT batch, i, 'body' AS field, 'empty' AS error FROM d WHERE trim(body) = ''
UNION SELECT batch, i, 'summary', 'script' FROM d WHERE regexp_matches(summary, '[^\\p{Latin}\\p{Common}\\P{L}]')
UNION SELECT batch, i, 'supersedes', 'self' FROM d WHERE conv_id % 11 = 0 AND turn = 0
UNION SELECT batch, i, 'parent', 'range' FROM d WHERE conv_id % 13 = 0 AND turn = 0
UNION SELECT batch, i, 'links', 'missing' FROM d WHERE conv_id % 3 = 0 AND turn = 1
UNION SELECT batch, i, 'supersedes', 'taken' FROM d WHERE conv_id % 11 <> 0 AND conv_id % 17 = 0 AND turn = 0)"""


@query(f"{_FAULTS} SELECT batch, CAST(i AS BIGINT) AS i, field, error FROM e")
def write_validation(spark: SparkSession, d: str) -> DataFrame:
    """Turns as drafts that supersede the one before, with planted faults, against a store of two records."""
    stored = spark.createDataFrame([("old", None), ("new", "old")], "id string, supersedes_id string")
    return write_path.errors(_drafts(spark, d), stored)


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    own = (F.col("conv_id") * 100 + F.col("turn")).cast("string")
    before = F.concat(F.lit("#"), (F.col("turn") - 1).cast("string"))
    supersedes = F.when(F.col("turn") > 0, before).when(F.col("conv_id") % 11 == 0, F.lit("#0")).when(F.col("conv_id") % 17 == 0, F.lit("old")).when(F.col("conv_id") == 1, F.lit("new"))
    links = F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") == 1), F.array(F.lit("#0"), F.lit("old"), F.lit("gone")))
    links = links.when((F.col("conv_id") % 3 == 1) & (F.col("turn") == 2), F.array(F.lit("#0"), F.lit("old"), F.lit("#0"))).otherwise(F.array().cast("array<string>"))
    return c.select(
        F.col("conv_id").alias("batch"),
        F.col("turn").alias("i"),
        own.alias("id"),
        F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 1), F.concat(F.lit("при "), F.col("role"))).otherwise(F.col("role")).alias("summary"),
        F.when(F.col("turn") % 5 == 4, "").otherwise(F.col("text")).alias("body"),
        F.when((F.col("conv_id") % 13 == 0) & (F.col("turn") == 0), "#99").alias("parent"),
        supersedes.alias("supersedes"),
        links.alias("links"),
    )


@query(f"""{_FAULTS}, good AS (SELECT * FROM d WHERE batch NOT IN (SELECT batch FROM e))
SELECT CAST(id AS VARCHAR) AS id, CASE WHEN turn > 0 THEN CAST(id - 1 AS VARCHAR) WHEN conv_id = 1 THEN 'new' END AS supersedes_id, summary, CAST(CASE WHEN conv_id % 3 = 1 AND turn = 2 THEN 2 ELSE 0 END AS BIGINT) AS n_links FROM good
UNION ALL VALUES ('old', NULL, 'o', CAST(0 AS BIGINT)), ('new', 'old', 'n', CAST(0 AS BIGINT))""")
def batches_written(spark: SparkSession, d: str) -> DataFrame:
    """The records of a store, with the links of each, after two commits of many batches; the second one is tried twice."""
    store = Store(spark, f"{checkpoint_dir(spark).rstrip('/')}/batches-{uuid.uuid4().hex}")
    store.commit(append={"records": spark.createDataFrame([("old", None, None, "o"), ("new", None, "old", "n")], "id string, parent_id string, supersedes_id string, summary string")})
    drafts = _drafts(spark, d)
    with Lease(spark, store.path, "batches_written") as lease:
        for number in (0, 1, 1):
            write_path.write_batches(drafts.filter(F.pmod("batch", F.lit(2)) == number), store, A.NOW, {"drafts": number}, lease)
    links = store.table("links").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n_links"))
    return store.table("records").join(links, "id", "left").select("id", "supersedes_id", "summary", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


@query(f"""WITH {_SYMBOLS}, q AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS query FROM part),
f AS (SELECT query AS qid, id, name, CASE WHEN name = query THEN 0 WHEN lower(name) = lower(query) THEN 1 WHEN starts_with(lower(name), lower(query)) THEN 2 ELSE 3 END AS tier,
      {_PRIORITY} AS pr, file_path, start_line FROM s JOIN q ON contains(lower(name), lower(query)) WHERE kind = 'trait' AND contains(file_path, 'brand_1')),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tier, pr DESC, strlen(name), file_path, start_line, id) AS rank, count(*) OVER (PARTITION BY qid) AS total_matches FROM f)
SELECT qid, id, CAST(tier AS BIGINT) AS tier, CAST(rank AS BIGINT) AS rank, total_matches FROM r WHERE rank <= 20""")
def find_hinted(spark: SparkSession, d: str) -> DataFrame:
    """find with a kind and a part of the path, both of which must fit."""
    s = A.parts_as_symbols(spark, d)
    first = F.split_part("name", F.lit(" "), F.lit(1))
    asked = s.select(first.alias("query")).distinct().select("query", F.col("query").alias("qid"), F.lit("/Brand_1").alias("file"), F.lit(" Trait").alias("kind_hint"))
    found = graph.find(s, asked)
    return found.select("qid", "id", F.col("tier").cast("long").alias("tier"), F.col("rank").cast("long").alias("rank"), "total_matches")


@query(f"""WITH {_GRAPH}, named AS (SELECT n.id, n.name, n.file_path, count(*) OVER (PARTITION BY name) AS total FROM nodes n),
asked AS (SELECT 'c' || c_custkey AS qid, c_name AS symbol FROM customer UNION ALL SELECT 'p' || p_partkey, p_name FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT 'gone', 'no such name'),
m AS (SELECT qid, id, total FROM asked JOIN named ON symbol = name),
amb AS (SELECT qid, 'ambiguous' AS status, id AS symbol_id, NULL AS id, NULL AS kind, NULL AS line FROM (SELECT m.*, row_number() OVER (PARTITION BY qid ORDER BY strlen(n.file_path), m.id) AS rn FROM m JOIN nodes n USING (id) WHERE total > 1) WHERE rn <= 20),
hit AS (SELECT m.qid, m.id AS symbol_id, e.source AS id, e.kind, e.line FROM m JOIN edges e ON e.target = m.id JOIN nodes n ON n.id = e.source WHERE total = 1 AND e.kind IN ('calls', 'references', 'implements'))
SELECT qid, status, symbol_id, id, kind, CAST(line AS BIGINT) AS line FROM amb
UNION ALL SELECT m.qid, 'ok', m.id, h.id, h.kind, h.line FROM m LEFT JOIN hit h USING (qid) WHERE total = 1
UNION ALL SELECT qid, 'not_found', NULL, NULL, NULL, NULL FROM asked WHERE qid NOT IN (SELECT qid FROM m)""")
def ref_symbols(spark: SparkSession, d: str) -> DataFrame:
    """ref by name: customers (one of each name), some parts (names shared by many), and a name that nothing has."""
    nodes, edges = A.graph(spark, d)
    named = nodes.filter("kind = 'class'").select(F.col("id").alias("qid"), F.col("name").alias("symbol"))
    part = table(spark, d, "part").filter("p_partkey % 50 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), "p_name")
    none = spark.createDataFrame([("gone", "no such name")], "qid string, symbol string")
    hint = F.lit(None).cast("string")
    asked = named.union(part).union(none).select("qid", "symbol", F.lit(True).alias("incoming"), *[hint.alias(h) for h in graph.HINTS])
    return graph.ref(nodes, edges, asked).withColumn("line", F.col("line").cast("long"))


@query("""WITH k AS (SELECT p_partkey AS k FROM part WHERE p_partkey <> 3), b AS (SELECT k, k % 7 IN (SELECT k FROM k) AS has_base, k % 5 IN (SELECT k FROM k) AS has_callee FROM k),
n AS (SELECT 'contains' AS kind, 4 * count(*) AS n FROM b UNION ALL SELECT 'calls', count(*) FILTER (WHERE has_callee) FROM b UNION ALL SELECT 'implements', count(*) FILTER (WHERE has_base AND k >= 7) FROM b
      UNION ALL SELECT 'references', sum(CASE WHEN NOT has_base THEN 1 WHEN k < 7 THEN 2 ELSE 4 END) FROM b)
SELECT how, kind, CAST(n AS BIGINT) AS n FROM n, (VALUES ('full'), ('synced'), ('stored')) h(how)""")
def graph_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """A graph of generated sources, one file for each part: (how, kind, n) of its edges when indexed as a whole after a
    change, when brought up to date, and when kept in a store to which only the changed paths are told.

    Part k extends part k % 7 (if there is one, and it is another) and calls the function of part k % 5; 3 is removed.
    """
    name = F.concat(F.lit("Part"), F.col("p_partkey").cast("string"))
    other = F.concat(F.lit("Part"), (F.col("p_partkey") % 7).cast("string"))
    text = F.format_string("class %s(%s):\n    def run(self):\n        return make_%s(%s.size(self))\n\ndef make_%s(x):\n    return x\n", name, other, F.col("p_partkey") % 5, other, F.col("p_partkey"))
    sources = table(spark, d, "part").select(F.concat(F.lit("s"), (F.col("p_partkey") % 4).cast("string"), F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), text.alias("text"), "p_partkey")

    def files(rows: DataFrame) -> DataFrame:
        return rows.select("path", F.length("text").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"), F.sha2("text", 256).alias("hash"), F.lit("python").alias("language"), "text")

    after = sources.filter("p_partkey <> 3").withColumn("text", F.when(F.col("p_partkey") == 2, F.concat(F.lit("\n\n"), "text")).otherwise(F.col("text")))
    store = Store(spark, f"{checkpoint_dir(spark).rstrip('/')}/graph-{uuid.uuid4().hex}")
    stored_graph.sync(store, files(sources))
    before = stored_graph.read(store)
    told = sources.filter("p_partkey in (2, 3)").select("path")
    for _ in range(2):  # the batch comes again after a restart
        stored_graph.sync(store, files(after).join(told, "path", "left_semi"), told, {"watch": 0})
    found = {"full": index.full(files(after)), "synced": index.synced(before, files(after))[0], "stored": stored_graph.read(store)}
    counted = [g.edges.groupBy(F.lit(how).alias("how"), "kind").agg(F.count("*").alias("n")) for how, g in found.items()]
    return counted[0].union(counted[1]).union(counted[2])


@query()
def parse_defs(spark: SparkSession, d: str) -> DataFrame:
    """Definitions, calls and bases of one generated Python file per part: a class, a method that calls the brand."""
    name, brand = F.regexp_replace("p_name", "[^A-Za-z0-9]", "_"), F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_"))
    text = F.format_string("class C_%s(Base):\n    def run(self):\n        return %s(self)\n\ndef %s(x):\n    return x\n", name, brand, brand)
    files = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("file_path"), text.alias("text"))
    return parsers.parsed(files.withColumn("language", P.language(F.col("file_path"))))
