"""The engine's operators on the driver's tables, each with SQL that says the same.

The graph is that of suppliers that follow each other within an order; modules are
nations; functions, classes and intervals are parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codehealth.functions import paths as P
from codehealth.functions.globs import glob_regex
from codehealth.operators import deadcode, graph, links, resolve, rules, stats
from codehealth.operators.ordering import placed
from codehealth.operators.stage import line_counts
from codehealth.session import cut, kept, together
from codehealth.sources import languages
from codehealth.sources.rulefile import Boundary, Layer, Rules, parse_rules
from codehealth.sources.tree import skip_reason

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Inputs that several queries share.

PATHS = [
    "main.py", "src/main.zig", "src/core/types.zig", "src/core/mod.zig", "src/a/b/c/d.rs", "lib/util.js", "lib/index.ts", "pkg/app.py", "app.py", "cmd/tool/main.go",
    "src/bin/run.rs", "tests/test_main.py", "src/foo_test.go", "web/button.spec.tsx", "web/__tests__/x.js", "docs/readme.md", "Makefile", "src/Dockerfile", ".env", "a/.hidden/b.c",
    "build.zig", "build.zig.zon", "data.tar.gz", "noext", "src/test.d/x.h", "src/parser/mod.rs", "py/pkg/__init__.py", "x.R", "deep/er/and/deeper/file.cpp", "weird.name.test.js",
]
VALUES_PATHS = ", ".join(f"('{p}')" for p in PATHS)
PAGE_PATH = "regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)"
PATHS_SQL = f"paths AS (SELECT path FROM (VALUES {VALUES_PATHS}) v(path) UNION SELECT DISTINCT {PAGE_PATH} FROM pages)"
HOPS_SQL = """hops AS (SELECT l_suppkey AS src, dst FROM (SELECT *, lead(l_suppkey) OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS dst FROM lineitem) WHERE dst IS NOT NULL AND l_suppkey <> dst),
    links AS (SELECT DISTINCT src, dst FROM hops)"""
REACH_SQL = "reach(a, b) AS (SELECT src, dst FROM links UNION SELECT r.a, l.dst FROM reach r JOIN links l ON r.b = l.src)"
SCC_SQL = f"""WITH RECURSIVE {HOPS_SQL}, {REACH_SQL},
    scc AS (SELECT x.a AS id, max(x.b) AS scc FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(*) > 1)"""
UP_SQL = f"{HOPS_SQL}, up AS (SELECT src, dst FROM links WHERE src < dst)"
HEIGHT_SQL = f"""WITH RECURSIVE {UP_SQL}, climb(id, h) AS (SELECT src, 0 FROM up UNION SELECT dst, 0 FROM up UNION SELECT u.src, c.h + 1 FROM climb c JOIN up u ON u.dst = c.id),
    height AS (SELECT id, max(h) AS height FROM climb GROUP BY id)"""


def all_paths(spark: SparkSession, d: str) -> DataFrame:
    page = t(spark, d, "pages").select(F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1).alias("path"))
    return spark.createDataFrame([(p,) for p in PATHS], "path string").unionAll(page).distinct()


def hops(spark: SparkSession, d: str) -> DataFrame:
    # Lines that only ship date and price tell apart have one supplier, so their order changes no hop and both stay behind.
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = Window.partitionBy("l_orderkey").orderBy(*[F.asc_nulls_last(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")])
    rows = lines.withColumn("dst", F.lead("l_suppkey").over(order))
    return rows.where("dst IS NOT NULL AND l_suppkey <> dst").select(F.col("l_suppkey").alias("src"), "dst")


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("ord"), F.col("s_nationkey").alias("module"), "s_acctbal")


# Scans and scalar functions.


@query(
    r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents),
    k AS (SELECT doc_id, CASE WHEN x[len(x)] = '' THEN x[1:len(x) - 1] ELSE x END AS x FROM l),
    b AS (SELECT doc_id, list_transform(x, lambda v: trim(v, ' ' || chr(9) || chr(13))) AS x FROM k),
    n AS (SELECT doc_id, len(x) AS total, len(list_filter(x, lambda v: v = '')) AS blanks,
          len(list_filter(x, lambda v: regexp_matches(v, '^(//|#|--|;|%|''''''|["]["]["]|/[*]|<!--|[{]-)'))) AS comments FROM b)
    SELECT doc_id, total, total - comments - blanks AS code, comments, blanks FROM n"""
)
def line_count(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", line_counts(F.col("text")).alias("n"))
    return docs.select("doc_id", *[F.col(f"n.{c}").cast("long").alias(c) for c in ("total", "code", "comments", "blanks")])


@query(
    "SELECT CASE WHEN n_chars > 8000 THEN 'file_too_large' WHEN n_chars > 2000 THEN 'parse_too_large' ELSE 'read' END AS reason, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1"
)
def size_skip(spark: SparkSession, d: str) -> DataFrame:
    reason = F.coalesce(skip_reason(F.col("n_chars"), F.lit(True), 8000, 2000), F.lit("read"))
    return t(spark, d, "documents").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


_NAMES = ", ".join(f"('{k}', '{v}')" for k, v in languages.FILE_NAMES.items())
_EXTS = ", ".join(f"('{k}', '{v}')" for k, v in languages.EXTENSIONS.items())


@query(
    f"""WITH {PATHS_SQL}, n AS (SELECT path, regexp_extract(path, '[^/]*$') AS name FROM paths)
    SELECT path, coalesce(a.lang, b.lang, 'unknown') AS lang FROM n LEFT JOIN (VALUES {_NAMES}) a(key, lang) ON n.name = a.key
    LEFT JOIN (VALUES {_EXTS}) b(key, lang) ON b.key = CASE WHEN contains(name, '.') THEN string_split(name, '.')[-1] END"""
)
def lang_detect(spark: SparkSession, d: str) -> DataFrame:
    return all_paths(spark, d).select("path", languages.language_col(F.col("path")).alias("lang"))


@query(
    f"""WITH {PATHS_SQL}, p AS (SELECT path, string_split(path, '/') AS c FROM paths), n AS (SELECT path, c, c[-1] AS name, len(c) AS k FROM p),
    e AS (SELECT *, CASE WHEN contains(name, '.') THEN string_split(name, '.')[-1] ELSE '' END AS ext FROM n),
    s AS (SELECT *, CASE WHEN contains(name, '.') THEN path[1:length(path) - length(ext) - 1] ELSE path END AS stem FROM e)
    SELECT path, name, CASE WHEN k > 1 THEN array_to_string(c[1:k - 1], '/') END AS parent, stem, ext, k - 1 AS depth,
      CASE WHEN k = 1 OR k = 2 AND c[1] IN ('src', 'lib', 'app', 'pkg', 'cmd', 'bin', 'internal') THEN stem ELSE array_to_string(c[1:least(3, k - 1)], '/') END AS module
    FROM s"""
)
def path_algebra(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return all_paths(spark, d).select(
        p, P.name_col(p).alias("name"), P.parent_col(p).alias("parent"), P.strip_extension_col(p).alias("stem"), P.extension_col(p).alias("ext"),
        P.depth_col(p).cast("long").alias("depth"), P.module_col(p).alias("module"),
    )


@query(
    f"""WITH {PATHS_SQL}, p AS (SELECT path, string_split(path, '/') AS c FROM paths), n AS (SELECT *, c[-1] AS name FROM p),
    parts AS (SELECT path, unnest(c) AS part FROM p),
    tests AS (SELECT path, bool_or(part IN ('test', 'tests', '__tests__') OR list_has_any(string_split(part, '.')[2:], ['test', 'spec'])
       OR string_split(part, '.')[1] IN ('test', 'tests', '__tests__', 'spec') OR starts_with(string_split(part, '.')[1], 'test_') OR starts_with(string_split(part, '.')[1], 'test-')
       OR ends_with(string_split(part, '.')[1], '_test') OR ends_with(string_split(part, '.')[1], '_tests') OR ends_with(string_split(part, '.')[1], '_spec')) AS is_test FROM parts GROUP BY path)
    SELECT path, is_test, name IN ('mod.rs', '__init__.py', 'index.js', 'index.ts', 'lib.rs', 'mod.zig') AS is_index,
      name IN ('main.go', 'main.rs', 'main.zig', 'main.py', 'main.c', 'main.cpp', 'index.js', 'index.ts', '__main__.py', 'build.zig')
      OR len(c) > 1 AND (name = 'app.py' OR len(c) > 2 AND c[-3:-2] = ['src', 'bin'] AND regexp_matches(name, '[.](rs|zig)$')) AS is_entry
    FROM n JOIN tests USING (path)"""
)
def path_kinds(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return all_paths(spark, d).select(p, P.is_test_col(p).alias("is_test"), P.is_index_col(p).alias("is_index"), P.is_entry_col(p).alias("is_entry"))


@query(f"WITH {PATHS_SQL} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS place FROM paths")
def walk_order(spark: SparkSession, d: str) -> DataFrame:
    return placed(all_paths(spark, d), [P.walk_order(F.col("path"))])


# Edges.


@query(f"WITH {HOPS_SQL} SELECT DISTINCT src, dst FROM hops")
def edge_dedup(spark: SparkSession, d: str) -> DataFrame:
    edges = hops(spark, d).withColumn("seq", F.struct("src", "dst"))
    return resolve.first_seen(edges, ["src", "dst"]).select("src", "dst")


@query(f"WITH {HOPS_SQL}, u AS (SELECT * FROM hops UNION ALL SELECT DISTINCT dst, src FROM hops) SELECT src, dst, count(*) AS n FROM u GROUP BY ALL")
def edge_union(spark: SparkSession, d: str) -> DataFrame:
    e = hops(spark, d)
    return graph.edge_bag(e, e.select("dst", "src").distinct()).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {HOPS_SQL} SELECT DISTINCT id FROM (SELECT src AS id FROM hops UNION SELECT dst FROM hops) WHERE id NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)")
def endpoint_check(spark: SparkSession, d: str) -> DataFrame:
    return graph.dangling(suppliers(spark, d).where("module < 20").select("id"), hops(spark, d))


_DEGREES = f"""{HOPS_SQL}, e AS (SELECT a.s_nationkey AS ma, b.s_nationkey AS mb FROM hops JOIN supplier a ON src = a.s_suppkey JOIN supplier b ON dst = b.s_suppkey),
    g AS (SELECT module, sum(o)::BIGINT AS k_out, sum(i)::BIGINT AS k_in, sum(x)::BIGINT AS intra FROM
      (SELECT ma AS module, 1 AS o, 0 AS i, (ma = mb)::INT AS x FROM e UNION ALL SELECT mb, 0, 1, 0 FROM e) GROUP BY module)"""
_Q = "(sum(intra) - sum(k_out::DOUBLE * k_in) / sum(k_out)) / sum(k_out)"


@query(f"WITH {_DEGREES} SELECT * FROM g")
def degree_by_module(spark: SparkSession, d: str) -> DataFrame:
    return graph.module_degrees(suppliers(spark, d), hops(spark, d))


@query(f"WITH {_DEGREES} SELECT sum(k_out)::BIGINT AS m, round({_Q}, 6) AS q FROM g")
def modularity_q(spark: SparkSession, d: str) -> DataFrame:
    return graph.modularity(suppliers(spark, d), hops(spark, d)).select("m", F.round("q", 6).alias("q"))


@query(
    f"""WITH {HOPS_SQL}, free AS (SELECT s_suppkey AS id FROM supplier WHERE NOT EXISTS (SELECT 1 FROM links WHERE dst = s_suppkey))
    SELECT id FROM free UNION ALL SELECT min(s_suppkey) FROM supplier WHERE NOT EXISTS (SELECT 1 FROM free)"""
)
def entry_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = suppliers(spark, d).withColumn("named", F.lit(False))
    return graph.entries(nodes, hops(spark, d)).select("id")


@query(f"{SCC_SQL} SELECT id, scc FROM scc")
def scc_members(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(hops(spark, d))


@query(f"{SCC_SQL} SELECT count(DISTINCT scc) AS cycles FROM scc")
def cycle_count(spark: SparkSession, d: str) -> DataFrame:
    return cycles_of(hops(spark, d))


def cycles_of(edges: DataFrame, stored: bool = False) -> DataFrame:
    return graph.components(edges, stored=stored).agg(F.count_distinct("scc").alias("cycles"))


def upward(spark: SparkSession, d: str) -> DataFrame:
    return hops(spark, d).where("src < dst").distinct().withColumn("seq", F.col("dst"))


@query(f"{HEIGHT_SQL} SELECT id, height FROM height")
def node_heights(spark: SparkSession, d: str) -> DataFrame:
    return graph.heights(upward(spark, d))


@query(
    f"""{HEIGHT_SQL}, walk(place, id, height) AS ((SELECT 0, id, height FROM height ORDER BY height DESC, id LIMIT 1)
    UNION ALL SELECT place + 1, (SELECT min(dst) FROM up JOIN height h ON h.id = dst WHERE src = walk.id AND h.height = walk.height - 1), walk.height - 1 FROM walk WHERE walk.height > 0)
    SELECT place, id FROM walk"""
)
def longest_path(spark: SparkSession, d: str) -> DataFrame:
    depth, path = graph.longest_path(suppliers(spark, d), upward(spark, d), True)
    return spark.createDataFrame(list(enumerate(path)), "place long, id long")


@query(f"{HEIGHT_SQL} SELECT max(height) AS max_depth FROM height")
def max_depth(spark: SparkSession, d: str) -> DataFrame:
    return graph.heights(upward(spark, d)).agg(F.max("height").alias("max_depth"))


_REACHED = f"WITH RECURSIVE {HOPS_SQL}, r(id) AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000 UNION SELECT dst FROM r JOIN links ON src = id)"


@query(f"{_REACHED} SELECT id FROM r")
def reachable(spark: SparkSession, d: str) -> DataFrame:
    return graph.reached(suppliers(spark, d).where("s_acctbal > 9000"), hops(spark, d).distinct()).select("id")


@query(f"{_REACHED} SELECT s_suppkey AS id FROM supplier WHERE s_suppkey NOT IN (SELECT id FROM r)")
def dead_nodes(spark: SparkSession, d: str) -> DataFrame:
    return suppliers(spark, d).join(reachable(spark, d), "id", "left_anti").select("id")


# Statistics.

_GINI = "CASE WHEN count(*) <= 1 OR sum(x) = 0 THEN 0.0 ELSE round(greatest(0.0, least(1.0, sum((2.0 * k - n - 1) * x) / (any_value(n) * sum(x)))), 6) END AS gini"


@query(f"SELECT l_returnflag, {_GINI} FROM (SELECT l_returnflag, l_quantity AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) GROUP BY 1")
def gini_by_flag(spark: SparkSession, d: str) -> DataFrame:
    return stats.gini(t(spark, d, "lineitem"), "l_quantity", ["l_returnflag"]).withColumn("gini", F.round("gini", 6))


_GINI_SIZE = f"SELECT {_GINI} FROM (SELECT n_chars::DOUBLE AS x, row_number() OVER (ORDER BY n_chars) AS k, count(*) OVER () AS n FROM documents)"


@query(_GINI_SIZE)
def gini_file_size(spark: SparkSession, d: str) -> DataFrame:
    return stats.gini(t(spark, d, "documents"), "n_chars").withColumn("gini", F.round("gini", 6))


_BODY = "trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))"
_DUPLICATES = f"SELECT doc_id, row_number() OVER (PARTITION BY {_BODY} ORDER BY doc_id) > 1 AS duplicate FROM documents WHERE strlen({_BODY}) >= 20"


def document_bodies(spark: SparkSession, d: str) -> DataFrame:
    body = F.btrim(F.regexp_replace("text", r"[ \t\r\n]+", " "), F.lit(" "))
    return t(spark, d, "documents").select("doc_id", body.alias("body")).where(F.octet_length("body") >= 20)


@query(f"SELECT doc_id FROM ({_DUPLICATES}) WHERE duplicate")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    # Grouped by digest, so that the bodies are sorted and shuffled as 32 bytes.
    rows = document_bodies(spark, d).select("doc_id", F.unhex(F.sha2("body", 256)).alias("digest"))
    return deadcode.duplicates(rows, ["doc_id"], "digest").where("duplicate").select("doc_id")


@query(f"SELECT count(*) AS duplicates FROM ({_DUPLICATES}) WHERE duplicate")
def dup_count(spark: SparkSession, d: str) -> DataFrame:
    return exact_duplicates(spark, d).agg(F.count(F.lit(1)).alias("duplicates"))


_FLAGS = f"""f AS (SELECT doc_id, source <> 'src3' AS production, source <> 'src3' AND n_chars < 100 AS dead, source <> 'src3' AND coalesce(duplicate, false) AS duplicate
    FROM documents LEFT JOIN ({_DUPLICATES}) USING (doc_id))"""
_RATIO = "CASE WHEN count(*) FILTER (WHERE production) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE dead OR duplicate) / count(*) FILTER (WHERE production) END"


def flagged(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", "source", "n_chars")
    twice = exact_duplicates(spark, d).withColumn("twice", F.lit(True))
    production = F.col("source") != "src3"
    return docs.join(twice, "doc_id", "left").select(
        production.alias("production"), (production & (F.col("n_chars") < 100)).alias("dead"), (production & F.coalesce("twice", F.lit(False))).alias("duplicate")
    )


@query(
    f"""WITH {_FLAGS} SELECT count(*) AS total_functions, count(*) FILTER (WHERE production) AS production_functions, count(*) FILTER (WHERE dead) AS dead_functions,
    count(*) FILTER (WHERE duplicate) AS duplicate_functions, round({_RATIO}, 6) AS ratio FROM f"""
)
def redundancy_ratio(spark: SparkSession, d: str) -> DataFrame:
    return deadcode.redundancy(flagged(spark, d)).drop("dead_ratio", "duplication_ratio").withColumn("ratio", F.round("ratio", 6))


_SCORES = """s AS (SELECT *, (q + 0.5) / 1.5 AS modularity, 1.0 / (1 + cycles) AS acyclicity, 1.0 / (1 + max_depth / 8.0) AS depth, 1 - gini AS equality, 1 - ratio AS redundancy FROM raw),
    z AS (SELECT *, pow(greatest(0.01, modularity) * greatest(0.01, acyclicity) * greatest(0.01, depth) * greatest(0.01, equality) * greatest(0.01, redundancy), 0.2) AS quality_signal,
      CASE least(modularity, acyclicity, depth, equality, redundancy) WHEN modularity THEN 'modularity' WHEN acyclicity THEN 'acyclicity' WHEN depth THEN 'depth' WHEN equality THEN 'equality' ELSE 'redundancy' END AS bottleneck FROM s)"""
RAW = [(1, 1.0, 0, 0, 0.0, 0.0), (2, 0.7, 0, 0, 0.7, 0.05), (3, -0.5, 40, 8, 1.0, 1.0), (4, 0.25, 1, 8, 0.5, 0.5), (5, 0.0, 3, 100, 0.25, 0.1)]
_RAW_VALUES = ", ".join(map(str, RAW))


@query(
    f"""WITH raw AS (SELECT id, q::DOUBLE AS q, cycles, max_depth, gini::DOUBLE AS gini, ratio::DOUBLE AS ratio FROM (VALUES {_RAW_VALUES}) v(id, q, cycles, max_depth, gini, ratio)), {_SCORES}
    SELECT id, round(modularity, 6) AS modularity, round(acyclicity, 6) AS acyclicity, round(depth, 6) AS depth, round(equality, 6) AS equality, round(redundancy, 6) AS redundancy,
      round(quality_signal, 6) AS quality_signal, bottleneck, floor(greatest(0.0, least(1.0, equality)) * 10000)::INT AS equality_int FROM z"""
)
def root_cause_scores(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.createDataFrame(RAW, "id int, q double, cycles long, max_depth long, gini double, ratio double")
    out = stats.scored(raw)
    return out.select("id", *[F.round(c, 6).alias(c) for c in (*stats.CAUSES, "quality_signal")], "bottleneck", stats.score_int(F.col("equality")).alias("equality_int"))


def health(spark: SparkSession, d: str, edges: DataFrame | None = None) -> DataFrame:
    """The supplier graph's health: one row with all measures, scores and the bottleneck. ``edges``: ``hops``, if there already."""
    edges = kept(hops(spark, d), "hops") if edges is None else edges

    def depth_of() -> int:
        up = kept(edges.where("src < dst"), "links")
        return graph.heights(up, stored=True).agg(F.max("height")).first()[0] or 0

    depth, cycles, q, size, waste = together(
        spark,
        depth_of,
        lambda: cycles_of(edges, stored=True).first()["cycles"],
        lambda: graph.modularity(suppliers(spark, d), edges).first()["q"],
        lambda: stats.gini(t(spark, d, "documents"), "n_chars").first()["gini"],
        lambda: deadcode.redundancy(flagged(spark, d)).select("ratio", "dead_functions", "duplicate_functions").first(),
    )
    raw = spark.createDataFrame([(q, cycles, depth, size, *waste)], "q double, cycles long, max_depth long, gini double, ratio double, dead_functions long, duplicate_functions long")
    return stats.scored(raw.coalesce(1))


_HEALTH_RAW = f"""raw AS (SELECT (WITH {_DEGREES} SELECT {_Q} FROM g) AS q, ({SCC_SQL} SELECT count(DISTINCT scc) FROM scc) AS cycles, ({HEIGHT_SQL} SELECT max(height) FROM height) AS max_depth,
    ({_GINI_SIZE.replace("round(greatest(0.0, least(1.0, sum((2.0 * k - n - 1) * x) / (any_value(n) * sum(x)))), 6)", "greatest(0.0, least(1.0, sum((2.0 * k - n - 1) * x) / (any_value(n) * sum(x))))")}) AS gini,
    (WITH {_FLAGS} SELECT {_RATIO} FROM f) AS ratio)"""
_HEALTH_COLUMNS = ("q", "gini", "ratio", *stats.CAUSES, "quality_signal")


@query(f"WITH {_HEALTH_RAW}, {_SCORES} SELECT cycles, max_depth::BIGINT AS max_depth, bottleneck, {', '.join(f'round({c}, 6) AS {c}' for c in _HEALTH_COLUMNS)} FROM z")
def health_report(spark: SparkSession, d: str) -> DataFrame:
    return health(spark, d).select("cycles", "max_depth", "bottleneck", *[F.round(c, 6).alias(c) for c in _HEALTH_COLUMNS])


@query("SELECT p_partkey, p_name AS name, p_size * 1000000 + (p_partkey % 89) * 1000 + (p_partkey % 50 + 1) AS score FROM part ORDER BY score DESC, p_partkey LIMIT 10")
def hotspots(spark: SparkSession, d: str) -> DataFrame:
    parts = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("cyclomatic"), (F.col("p_partkey") % 89).alias("cognitive"), (F.col("p_partkey") % 50 + 1).alias("line_count"))
    return stats.hotspots(parts, ["p_partkey"]).select("p_partkey", "name", "score")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k <= 20")
def call_budget(spark: SparkSession, d: str) -> DataFrame:
    return links.within_budget(t(spark, d, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], ["event_id"], 20).select("event_id")


# Name resolution.


@query(
    f"""WITH {PATHS_SQL}, p AS (SELECT path, string_split(path, '/') AS c FROM paths), n AS (SELECT *, c[-1] AS name FROM p),
    s AS (SELECT path, name, CASE WHEN contains(name, '.') THEN path[1:length(path) - length(string_split(name, '.')[-1]) - 1] ELSE path END AS stem, CASE WHEN len(c) > 1 THEN array_to_string(c[1:len(c) - 1], '/') END AS up FROM n),
    u AS (SELECT path, CASE WHEN contains(string_split(up, '/')[-1], '.') THEN up[1:length(up) - length(string_split(string_split(up, '/')[-1], '.')[-1]) - 1] ELSE up END AS stem FROM s
       WHERE up IS NOT NULL AND name IN ('mod.rs', '__init__.py', 'index.js', 'index.ts', 'lib.rs', 'mod.zig')),
    a AS (SELECT path, string_split(stem, '/') AS x FROM s UNION ALL SELECT path, string_split(stem, '/') FROM u),
    k AS (SELECT path, array_to_string(x[i:], '/') AS key FROM (SELECT path, x, unnest(range(1, len(x) + 1)) AS i FROM a))
    SELECT key, min(path) AS target FROM k GROUP BY key HAVING count(DISTINCT path) = 1"""
)
def suffix_index(spark: SparkSession, d: str) -> DataFrame:
    return resolve.suffix_index(all_paths(spark, d)).select("key", "target")


# Files are brands, numbered from 1; each imports the two of twice its number and one more, as far as there are such.
_NAMED = """fns AS (SELECT p_brand AS file, p_name || ' ' || p_size AS name, p_size > 40 AS public, p_partkey AS place FROM part),
    brands AS (SELECT DISTINCT p_brand, substr(p_brand, 7)::INT AS n FROM part),
    imp AS (SELECT a.p_brand AS from_file, b.p_brand AS to_file FROM brands a JOIN brands b ON b.n IN (a.n * 2, a.n * 2 + 1)),
    firsts AS (SELECT l_orderkey, arg_min(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS p_partkey FROM lineitem GROUP BY 1),
    sites AS (SELECT o_orderkey AS site, 'Brand#' || (o_custkey % 25 + 1) AS from_file, o_orderpriority AS from_func, p_name || ' ' || p_size AS callee, o_orderstatus = 'F' AS qualified
      FROM orders JOIN firsts ON l_orderkey = o_orderkey JOIN part USING (p_partkey))"""
_RESOLVED = f"""{_NAMED}, foreign_ AS (SELECT * FROM sites s WHERE NOT EXISTS (SELECT 1 FROM fns WHERE file = s.from_file AND name = s.callee)),
    near AS (SELECT site, coalesce(arg_min(file, place) FILTER (WHERE public), arg_max(file, place)) AS to_file FROM foreign_ s JOIN imp USING (from_file) JOIN fns ON file = to_file AND name = callee GROUP BY site),
    sole AS (SELECT name, min(file) AS file FROM fns WHERE public GROUP BY name HAVING count(*) = 1),
    res AS (SELECT s.*, coalesce(near.to_file, CASE WHEN NOT qualified THEN sole.file END) AS to_file FROM foreign_ s LEFT JOIN near USING (site) LEFT JOIN sole ON name = callee)"""


def part_name():
    return F.concat("p_name", F.lit(" "), "p_size")


def brand_imports(spark: SparkSession, d: str) -> DataFrame:
    brands = t(spark, d, "part").select("p_brand", F.substring("p_brand", 7, 9).cast("int").alias("n")).distinct()
    wanted = brands.select(F.col("p_brand").alias("from_file"), F.explode(F.array(F.col("n") * 2, F.col("n") * 2 + 1)).alias("n"))
    return wanted.join(brands.withColumnRenamed("p_brand", "to_file"), "n").select("from_file", "to_file")


def named_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = t(spark, d, "part")
    fns = part.select(F.col("p_brand").alias("file"), part_name().alias("name"), (F.col("p_size") > 40).alias("public"), F.col("p_partkey").alias("place"))
    firsts = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("p_partkey"))
    orders = t(spark, d, "orders").join(firsts, F.col("o_orderkey") == F.col("l_orderkey"))
    sites = orders.join(part.select("p_partkey", part_name().alias("callee")), "p_partkey").select(
        F.col("o_orderkey").alias("site"), F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("from_file"), F.col("o_orderpriority").alias("from_func"),
        "callee", (F.col("o_orderstatus") == "F").alias("qualified"), F.col("o_orderkey").alias("seq"),
    )
    return fns, brand_imports(spark, d), sites


@query(f"WITH {_RESOLVED} SELECT site, callee, to_file FROM res WHERE to_file IS NOT NULL")
def ranked_resolve(spark: SparkSession, d: str) -> DataFrame:
    fns, imports, sites = named_inputs(spark, d)
    return links.ranked_targets(sites, fns, imports).select("site", "callee", "to_file")


@query(
    f"""WITH {_RESOLVED.replace("FROM sites s WHERE", "FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY from_file, from_func ORDER BY site) AS k FROM sites) WHERE k <= 20) s WHERE")}
    SELECT from_file, from_func, to_file, callee AS to_func, min(site) AS seq FROM res WHERE to_file IS NOT NULL GROUP BY ALL"""
)
def call_edges(spark: SparkSession, d: str) -> DataFrame:
    fns, imports, sites = named_inputs(spark, d)
    return links.call_edges(sites.drop("site"), fns, imports)


_CLASSES = """cls AS (SELECT a.p_brand AS file, substr(a.p_brand, 7)::INT AS file_ord, a.p_name || ' ' || a.p_size AS name, b.p_name || ' ' || b.p_size AS base, a.p_partkey AS seq FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
    brands AS (SELECT DISTINCT file, file_ord FROM cls),
    imp AS (SELECT a.file AS child_file, b.file AS parent_file FROM brands a JOIN brands b ON b.file_ord IN (a.file_ord * 2, a.file_ord * 2 + 1)),
    def AS (SELECT name AS base, file AS parent_file, min(file_ord) AS file_ord FROM cls GROUP BY ALL)"""


@query(
    f"""WITH {_CLASSES}, near AS (SELECT c.file, c.name, c.base, arg_min(def.parent_file, def.file_ord) AS parent_file FROM cls c JOIN imp ON imp.child_file = c.file
      JOIN def ON def.base = c.base AND def.parent_file = imp.parent_file WHERE def.parent_file <> c.file GROUP BY c.file, c.name, c.base),
    far AS (SELECT c.file, c.name, c.base, def.parent_file FROM cls c JOIN def USING (base) WHERE def.parent_file <> c.file AND c.file NOT IN (SELECT child_file FROM imp)
      AND (SELECT count(*) FROM def e WHERE e.base = c.base) = 1)
    SELECT DISTINCT file AS child_file, name AS child_class, parent_file, base AS parent_class FROM (SELECT * FROM near UNION ALL SELECT * FROM far)"""
)
def inherit_resolve(spark: SparkSession, d: str) -> DataFrame:
    part = t(spark, d, "part")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), part_name().alias("base"))
    classes = part.join(after, "p_partkey").select(F.col("p_brand").alias("file"), F.substring("p_brand", 7, 9).cast("int").alias("file_ord"), part_name().alias("name"), F.array("base").alias("bases"), F.col("p_partkey").alias("seq"))
    return links.inherit_edges(classes, brand_imports(spark, d)).drop("seq")


_SPANS = "iv AS (SELECT p_brand, p_partkey AS place, p_partkey % 500 AS low, p_partkey % 500 + p_size AS high FROM part)"


def intervals(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_brand", F.col("p_partkey").alias("place"), (F.col("p_partkey") % 500).alias("low"), (F.col("p_partkey") % 500 + F.col("p_size")).alias("high"))


@query(
    f"""WITH {_SPANS}, pt AS (SELECT p_partkey, p_brand, p_partkey * 7 % 600 AS point FROM part),
    hit AS (SELECT p_partkey, place, high - low AS size FROM pt JOIN iv USING (p_brand) WHERE point BETWEEN low AND high)
    SELECT pt.p_partkey, coalesce(arg_min(place, size * 10000000 + place), -1) AS smallest, coalesce(min(place), -1) AS first FROM pt LEFT JOIN hit USING (p_partkey) GROUP BY 1"""
)
def interval_enclosing(spark: SparkSession, d: str) -> DataFrame:
    points = t(spark, d, "part").select("p_partkey", "p_brand", (F.col("p_partkey") * 7 % 600).alias("point"))
    spans = intervals(spark, d)
    for name, smallest in (("smallest", True), ("first", False)):
        points = links.enclosing(points, spans, ["p_brand"], smallest).withColumn(name, F.coalesce("inside", F.lit(-1)).cast("long")).drop("inside")
    return points.select("p_partkey", "smallest", "first")


@query(f"WITH {_SPANS} SELECT place, EXISTS (SELECT 1 FROM iv b WHERE b.p_brand = a.p_brand AND b.place <> a.place AND b.low <= a.high AND a.low <= b.high) AS overlaps FROM iv a")
def overlap_flags(spark: SparkSession, d: str) -> DataFrame:
    return links.overlapping(intervals(spark, d), ["p_brand"]).select("place", "overlaps")


# Rules and the gate.

LAYERS = (Layer("low", ("AFRICA/**", "AMERICA/**"), 0), Layer("middle", ("ASIA/*.c",), 1), Layer("high", ("EUROPE/**", "MIDDLE EAST/**"), 2))
BOUNDARIES = (Boundary("ASIA/**", "EUROPE/*", "trade"), Boundary("A*/**", "MIDDLE EAST", ""), Boundary("**", "NATION_1?.c", "late"))
_NATION_EDGES = f"""{HOPS_SQL}, home AS (SELECT s_suppkey, r_name || '/' || n_name || '.c' AS path FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
    e AS (SELECT DISTINCT a.path AS f, b.path AS t FROM hops JOIN home a ON a.s_suppkey = src JOIN home b ON b.s_suppkey = dst)"""


def nation_edges(spark: SparkSession, d: str, edges: DataFrame | None = None) -> DataFrame:
    place = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = place.select("n_nationkey", F.concat("r_name", F.lit("/"), "n_name", F.lit(".c")).alias("path"))
    # Pairs of nations first, so that edges meet two numbers each and only pairs get paths.
    home = t(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    e = (hops(spark, d) if edges is None else edges).join(home.toDF("src", "a"), "src").join(home.toDF("dst", "b"), "dst").select("a", "b").distinct()
    return e.join(place.toDF("a", "from"), "a").join(place.toDF("b", "to"), "b").select("from", "to").distinct()


_LAYER_CASE = "CASE WHEN {0} LIKE 'AFRICA/%' OR {0} LIKE 'AMERICA/%' THEN 0 WHEN {0} LIKE 'ASIA/%' THEN 1 WHEN {0} LIKE 'EUROPE/%' OR {0} LIKE 'MIDDLE EAST/%' THEN 2 END"
_LAYER_SQL = f"""SELECT 'layer_order' AS rule, f, t, 'layer ''' || ['low', 'middle', 'high'][a + 1] || ''' (order ' || a || ') imports ''' || ['low', 'middle', 'high'][b + 1] || ''' (order ' || b || ')' AS message
    FROM (SELECT f, t, {_LAYER_CASE.format("f")} AS a, {_LAYER_CASE.format("t")} AS b FROM e) WHERE a > b"""
_BOUNDARY_SQL = """SELECT 'boundary' AS rule, f, t, f || ' must not import ' || t || ' — trade' AS message FROM e WHERE f LIKE 'ASIA/%' AND regexp_matches(t, '^EUROPE/[^/]*$')
    UNION ALL SELECT 'boundary', f, t, f || ' must not import ' || t FROM e WHERE regexp_matches(f, '^A[^/]*/') AND t = 'MIDDLE EAST'
    UNION ALL SELECT 'boundary', f, t, f || ' must not import ' || t || ' — late' FROM e WHERE regexp_matches(t, '(^|/)NATION_1[^/][.]c$')"""


@query(f"WITH {_NATION_EDGES} {_LAYER_SQL}")
def layer_violations(spark: SparkSession, d: str) -> DataFrame:
    e = nation_edges(spark, d)
    found = rules.layer_violations(e, e.select(F.col("from").alias("path")), LAYERS)
    return found.select("rule", F.col("files")[0].alias("f"), F.col("files")[1].alias("t"), "message")


@query(f"WITH {_NATION_EDGES} {_BOUNDARY_SQL}")
def boundary_violations(spark: SparkSession, d: str) -> DataFrame:
    found = rules.boundary_violations(nation_edges(spark, d), BOUNDARIES)
    return found.select("rule", F.col("files")[0].alias("f"), F.col("files")[1].alias("t"), "message")


@query(f"WITH {_NATION_EDGES}, v AS (SELECT DISTINCT * FROM ({_LAYER_SQL} UNION ALL {_BOUNDARY_SQL})) SELECT row_number() OVER (ORDER BY rule, f, t, message) AS place, rule, f, t, message FROM v")
def violation_order(spark: SparkSession, d: str) -> DataFrame:
    e = nation_edges(spark, d)
    found = rules.layer_violations(e, e.select(F.col("from").alias("path")), LAYERS).unionAll(rules.boundary_violations(e, BOUNDARIES))
    rows = rules.ordered(found.unionAll(found)).select("rule", F.col("files")[0].alias("f"), F.col("files")[1].alias("t"), "message")
    return placed(rows, ["rule", "f", "t", "message"])


GLOBS = ("src/**", "**/*.py", "*.rs", "src/core", "lib/?til.js", "src/*/types.zig", "**", "cmd/**/main.go", "docs/readme.md", "*/mod.*")


@query(
    f"""WITH {PATHS_SQL}, g(pattern, re) AS (VALUES ('src/**', '^src(/.*)?$'), ('**/*.py', '^(.*/)?[^/]*[.]py$'), ('*.rs', '^(.*/)?[^/]*[.]rs$'), ('src/core', '^src/core(/.*)?$'), ('lib/?til.js', '^lib/[^/]til[.]js$'),
    ('src/*/types.zig', '^src/[^/]*/types[.]zig$'), ('**', '^.*$'), ('cmd/**/main.go', '^cmd/(.*/)?main[.]go$'), ('docs/readme.md', '^docs/readme[.]md(/.*)?$'), ('*/mod.*', '^[^/]*/mod[.][^/]*$'))
    SELECT pattern, path FROM paths JOIN g ON regexp_matches(path, re)"""
)
def glob_matches(spark: SparkSession, d: str) -> DataFrame:
    hits = F.array_compact(F.array(*[F.when(F.col("path").rlike(glob_regex(g)), F.lit(g)) for g in GLOBS]))
    return all_paths(spark, d).select(F.explode(hits).alias("pattern"), "path")


CHECKED = Rules({"min_quality": 0.9, "min_acyclicity": 0.99, "min_equality": 0.01}, {"max_cycles": 0, "max_file_lines": 100, "max_fn_lines": 10_000_000, "max_cyclomatic": 47}, LAYERS, BOUNDARIES)


def checked_health(spark: SparkSession, d: str, edges: DataFrame | None = None) -> DataFrame:
    return health(spark, d, edges).withColumn("cycle_count", F.col("cycles")).withColumns(largest(spark, d))


def largest(spark: SparkSession, d: str) -> dict:
    """The longest document and the longest function."""
    return {"max_file_lines": F.lit(t(spark, d, "documents").agg(F.max("n_chars")).first()[0]), "max_fn_lines": F.lit(50)}


@query(
    f"""WITH {_HEALTH_RAW}, {_SCORES} SELECT 'min_quality' AS rule, 'quality ' || printf('%.3f', quality_signal) || ' < required 0.900' AS message FROM z WHERE quality_signal < 0.9
    UNION ALL SELECT 'min_acyclicity', 'acyclicity ' || printf('%.3f', acyclicity) || ' < required 0.990 (' || cycles || ' cycles)' FROM z WHERE acyclicity < 0.99
    UNION ALL SELECT 'min_equality', 'equality ' || printf('%.3f', equality) || ' < required 0.010' FROM z WHERE equality < 0.01"""
)
def score_floors(spark: SparkSession, d: str) -> DataFrame:
    return rules.score_floors(checked_health(spark, d), CHECKED.floors).select("rule", "message")


@query(
    f"""SELECT 'max_cycles' AS rule, c || ' cycles > allowed 0' AS message FROM ({SCC_SQL} SELECT count(DISTINCT scc) AS c FROM scc) WHERE c > 0
    UNION ALL SELECT 'max_file_lines', 'largest file has ' || n || ' lines > allowed 100' FROM (SELECT max(n_chars) AS n FROM documents) WHERE n > 100"""
)
def ceilings(spark: SparkSession, d: str) -> DataFrame:
    # No ceiling asks for the scores.
    totals = cycles_of(hops(spark, d)).withColumnRenamed("cycles", "cycle_count").withColumns(largest(spark, d))
    return rules.ceilings(cut(totals), CHECKED.ceilings).select("rule", "message")


@query("SELECT 'max_cyclomatic' AS rule, p_brand AS file, p_name AS subject, p_partkey AS line, p_brand || ':' || p_partkey || ': ' || p_name || ' has cyclomatic complexity ' || p_size || ' > allowed 47' AS message FROM part WHERE p_size > 47")
def per_item_ceiling(spark: SparkSession, d: str) -> DataFrame:
    parts = t(spark, d, "part").select(F.col("p_brand").alias("file"), F.col("p_name").alias("name"), F.col("p_partkey").cast("int").alias("start_line"), F.col("p_size").alias("cyclomatic"), F.lit(0).alias("cognitive"))
    found = rules.complexity_ceilings(parts, CHECKED.ceilings)
    return found.select("rule", F.col("files")[0].alias("file"), "subject", F.col("line").cast("long").alias("line"), "message")


RULES_TEXT = """# what a release must keep
[constraints]
min_quality = 0.9
min_acyclicity = 0.99 # nearly no cycles
max_cycles = 0
max_cyclomatic = 47
[[layers]]
name = "low"
paths = ["AFRICA/**", "AMERICA/**"]
order = 0
[[layers]]
name = "high"
paths = ["EUROPE/**", "MIDDLE EAST/**"]
order = 1
[[boundaries]]
from = "ASIA/**"
to = "EUROPE/*"
[[boundaries]]
from = "**"
to = "NATION_1?.c"
reason = "late"
"""


@query(
    f"""WITH lines AS (SELECT unnest(string_split('{RULES_TEXT}', chr(10))) AS line)
    SELECT count(*) FILTER (WHERE regexp_matches(line, '^(min|max)_')) + (count(*) FILTER (WHERE line = '[[layers]]') >= 2)::INT + count(*) FILTER (WHERE line = '[[boundaries]]') AS n FROM lines"""
)
def rules_checked(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(rules.rules_checked(parse_rules(RULES_TEXT)),)], "n long")


_LOW_HIGH = "CASE WHEN {0} LIKE 'AFRICA/%' OR {0} LIKE 'AMERICA/%' THEN 0 WHEN {0} LIKE 'EUROPE/%' OR {0} LIKE 'MIDDLE EAST/%' THEN 1 END"


@query(
    f"""WITH {_HEALTH_RAW}, {_SCORES}, {_NATION_EDGES.removeprefix(HOPS_SQL + ", ").replace("hops", f"(WITH {HOPS_SQL} SELECT * FROM hops)")}
    SELECT 'min_quality' AS rule, 'quality ' || printf('%.3f', quality_signal) || ' < required 0.900' AS message, NULL AS file, NULL::INT AS line FROM z WHERE quality_signal < 0.9
    UNION ALL SELECT 'min_acyclicity', 'acyclicity ' || printf('%.3f', acyclicity) || ' < required 0.990 (' || cycles || ' cycles)', NULL, NULL FROM z WHERE acyclicity < 0.99
    UNION ALL SELECT 'max_cycles', cycles || ' cycles > allowed 0', NULL, NULL FROM z WHERE cycles > 0
    UNION ALL SELECT 'max_cyclomatic', p_brand || ':' || p_partkey || ': ' || p_name || ' has cyclomatic complexity ' || p_size || ' > allowed 47', p_brand, p_partkey FROM part WHERE p_size > 47
    UNION ALL SELECT 'layer_order', 'layer ''high'' (order 1) imports ''low'' (order 0)', f, NULL FROM e WHERE {_LOW_HIGH.format("f")} > {_LOW_HIGH.format("t")}
    UNION ALL SELECT 'boundary', f || ' must not import ' || t, f, NULL FROM e WHERE f LIKE 'ASIA/%' AND regexp_matches(t, '^EUROPE/[^/]*$')
    UNION ALL SELECT 'boundary', f || ' must not import ' || t || ' — late', f, NULL FROM e WHERE regexp_matches(t, '(^|/)NATION_1[^/][.]c$')"""
)
def rules_check(spark: SparkSession, d: str) -> DataFrame:
    """The whole check of a rule file's text."""
    edges = kept(hops(spark, d), "hops")
    e = cut(nation_edges(spark, d, edges))
    parts = t(spark, d, "part").select(F.col("p_brand").alias("file"), F.col("p_name").alias("name"), F.col("p_partkey").cast("int").alias("start_line"), F.col("p_size").alias("cyclomatic"), F.lit(0).alias("cognitive"))
    found = rules.check(parse_rules(RULES_TEXT), checked_health(spark, d, edges), parts, e, e.select(F.col("from").alias("path")))
    return found.select("rule", "message", F.get("files", F.lit(0)).alias("file"), "line")


ODD_PATHS = ["/rooted", "C:/x", "a//b", "a/../b", "./a", "a/.", "a\\b", "", "..", "a/", "ok/..a", "ok/a b", "c:", "aC:/x"]


@query(
    f"""WITH {PATHS_SQL}, p AS (SELECT path FROM paths UNION ALL SELECT * FROM (VALUES {", ".join(f"('{p}')" for p in ODD_PATHS)}) v(path))
    SELECT path FROM p WHERE path = '' OR starts_with(path, '/') OR contains(path, chr(92)) OR regexp_matches(path, '^[A-Za-z]:') OR list_has_any(string_split(path, '/'), ['', '.', '..'])"""
)
def bad_input_paths(spark: SparkSession, d: str) -> DataFrame:
    paths = all_paths(spark, d).unionAll(spark.createDataFrame([(p,) for p in ODD_PATHS], "path string"))
    return rules.bad_paths(paths)


BEFORE = {"quality_signal": 0.99, "cycle_count": 0, "max_depth": 1, "dead_functions": 1_000_000, "duplicate_functions": 0}


@query(
    f"""WITH {_HEALTH_RAW}, {_SCORES}, n AS (SELECT quality_signal, cycles, max_depth, (WITH {_FLAGS} SELECT count(*) FILTER (WHERE dead) FROM f) AS dead, (WITH {_FLAGS} SELECT count(*) FILTER (WHERE duplicate) FROM f) AS dup FROM z)
    SELECT 0 AS place, 'Quality signal dropped: 0.990 -> ' || printf('%.3f', quality_signal) AS message FROM n WHERE quality_signal < 0.97
    UNION ALL SELECT 1, 'Cycle count increased: 0 -> ' || cycles FROM n WHERE cycles > 0
    UNION ALL SELECT 2, 'Max depth increased: 1 -> ' || max_depth FROM n WHERE max_depth > 1
    UNION ALL SELECT 3, 'Dead functions increased: 1000000 -> ' || dead FROM n WHERE dead > 1000000
    UNION ALL SELECT 4, 'Duplicated functions increased: 0 -> ' || dup FROM n WHERE dup > 0"""
)
def gate_diff(spark: SparkSession, d: str) -> DataFrame:
    now = health(spark, d).select("quality_signal", F.col("cycles").alias("cycle_count"), "max_depth", "dead_functions", "duplicate_functions")
    return rules.regressions(spark.createDataFrame([BEFORE]).coalesce(1), now)


# Mentions.

_WORDS = """w AS (SELECT source AS file, doc_id, unnest(string_split(text, ' ')) AS name FROM documents),
    m AS (SELECT file, name, min(doc_id) % 4 = 0 AS first_in_test, bool_or(doc_id % 4 <> 0) AS in_production, bool_or(doc_id % 4 = 0) AS in_test FROM w WHERE name <> '' GROUP BY ALL),
    f AS (SELECT DISTINCT source AS file, substr(source, 4)::INT AS file_ord, string_split(text, ' ')[1] AS name FROM documents WHERE string_split(text, ' ')[1] <> ''),
    u AS (SELECT f.name, count(DISTINCT f.file) AS defining_files, arg_min(f.file, file_ord) AS defining_file FROM f GROUP BY 1),
    c AS (SELECT name, count(*) AS mentioning_files FROM m WHERE NOT first_in_test GROUP BY 1)"""


def word_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = t(spark, d, "documents")
    words = docs.select(F.col("source").alias("file"), "doc_id", F.explode(F.split("text", " ")).alias("name")).where("name <> ''")
    mentions = words.groupBy("file", "name").agg((F.min("doc_id") % 4 == 0).alias("first_in_test"), F.bool_or(F.col("doc_id") % 4 != 0).alias("in_production"), F.bool_or(F.col("doc_id") % 4 == 0).alias("in_test"))
    first = F.split("text", " ", 2)[0]
    functions = docs.select(F.col("source").alias("file"), F.substring("source", 4, 9).cast("int").alias("file_ord"), first.alias("name")).where("name <> ''").distinct()
    return functions.withColumn("fn", F.concat("file", F.lit(":"), "name")), mentions


@query(f"WITH {_WORDS} SELECT name, defining_files, defining_file, coalesce(mentioning_files, 0) AS mentioning_files FROM u LEFT JOIN c USING (name)")
def usage_table(spark: SparkSession, d: str) -> DataFrame:
    functions, mentions = word_inputs(spark, d)
    return deadcode.usage(functions, mentions).where("defining_files > 0")


@query(
    f"""WITH {_WORDS} SELECT f.file, f.name FROM f JOIN u USING (name) LEFT JOIN c USING (name) LEFT JOIN m ON m.file = f.file AND m.name = f.name
    WHERE m.name IS NOT NULL OR defining_files = 1 AND coalesce(mentioning_files, 0) - coalesce(m.in_production, false)::INT > 0"""
)
def cross_file_ref(spark: SparkSession, d: str) -> DataFrame:
    functions, mentions = word_inputs(spark, d)
    return functions.join(deadcode.live_by_mention(functions, mentions), "fn").select("file", "name")


@query(f"WITH {_WORDS} SELECT f.file, f.name FROM f JOIN m ON m.file = f.file AND m.name = f.name WHERE in_test AND NOT in_production AND f.name NOT IN (SELECT name FROM c)")
def test_only_names(spark: SparkSession, d: str) -> DataFrame:
    functions, mentions = word_inputs(spark, d)
    found = deadcode.test_only(functions, mentions)
    return functions.join(found, "fn").select("file", "name")
