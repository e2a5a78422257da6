"""Groups: shared members, dominant values, name patterns, outliers, samples, caps, registries, collapse."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lodestone.config import PROFILES, profiles_frame
from lodestone.operators import directories, registry, scans, wiring
from lodestone.plans import connectors
from lodestone.queries import query

_COMMON = """
ev AS (SELECT event_id, user_id % 10 AS dir, user_id AS file, event_type || '_' || CAST(CAST(floor(value / 40) AS INTEGER) AS VARCHAR) AS method FROM events),
pairs AS (SELECT DISTINCT dir, file, method FROM ev),
sizes AS (SELECT dir, count(DISTINCT file) AS n FROM pairs GROUP BY dir),
common AS (SELECT dir, method, count(*) AS n_items FROM pairs JOIN sizes USING (dir) GROUP BY dir, method, n HAVING count(*) >= 0.6::DOUBLE * n)
"""


def _method():
    """An event's type and its value's band: some are common to most users, others rare."""
    return F.concat("event_type", F.lit("_"), F.floor(F.col("value") / 40).cast("int"))


def _methods(t):
    return t("events").select((F.col("user_id") % 10).alias("dir"), F.col("user_id").alias("file"), _method().alias("method"), "event_id")


@query(f"WITH {_COMMON} SELECT dir, method, n_items FROM common")
def common_methods(spark, t):
    return directories.common_members(_methods(t), "dir", "file", "method")


@query(
    f"""WITH {_COMMON}, c AS (SELECT dir, count(*) AS n_common FROM common GROUP BY dir), m AS (SELECT dir, count(*) AS n_methods, count(DISTINCT file) AS n_files FROM pairs GROUP BY dir)
SELECT dir, round(n_methods / n_files::DOUBLE, 6) AS mean_methods, round(coalesce(n_common, 0) / (n_methods / n_files::DOUBLE), 6) AS coverage FROM m LEFT JOIN c USING (dir)"""
)
def method_coverage(spark, t):
    rows = _methods(t).select("dir", "file", "method").distinct()
    common = directories.common_members(rows, "dir", "file", "method").groupBy("dir").agg(F.count("*").alias("n_common"))
    mean = rows.groupBy("dir").agg((F.count("*") / F.count_distinct("file")).alias("mean"))
    return mean.join(common, "dir", "left").select("dir", F.round("mean", 6).alias("mean_methods"), F.round(F.try_divide(F.coalesce("n_common", F.lit(0)), "mean"), 6).alias("coverage"))


@query(
    f"""WITH {_COMMON}, rest AS (SELECT ev.* FROM ev LEFT JOIN common c ON ev.dir = c.dir AND ev.method = c.method WHERE c.dir IS NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY dir, file ORDER BY event_id) AS rn FROM rest), f AS (SELECT dir, file, string_agg(method, ', ' ORDER BY event_id) AS members FROM n WHERE rn <= 5 GROUP BY dir, file),
k AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY file) AS fn FROM f)
SELECT dir, file, members FROM k WHERE fn <= 5"""
)
def outliers(spark, t):
    m = _methods(t)
    common = directories.common_members(m, "dir", "file", "method")
    return directories.outliers(m, common, "dir", "file", "method", ["event_id"]).withColumn("members", F.array_join("members", ", "))


@query(
    """WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY source, lang), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS rn FROM c)
SELECT source, lang, n FROM r WHERE rn = 1"""
)
def dominant_lang(spark, t):
    return directories.dominant(t("documents"), "source", "lang", "doc_id")


def _pattern_sql(names: str) -> str:
    """The longest affix, suffixes first, of names (g, name, o)."""
    return f"""WITH names AS ({names}), n AS (SELECT g, greatest(2, CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT)) AS least FROM names GROUP BY g HAVING count(*) >= 2),
k AS (SELECT g, name, o, unnest(range(3, 13)) AS k FROM names), c AS (
  SELECT g, 0 AS side, k, right(name, k) AS affix, count(*) AS total, min(o) AS f FROM k WHERE length(name) >= k GROUP BY ALL
  UNION ALL SELECT g, 1 AS side, k, left(name, k) AS affix, count(*) AS total, min(o) AS f FROM k WHERE length(name) >= k GROUP BY ALL),
r AS (SELECT c.*, row_number() OVER (PARTITION BY c.g ORDER BY side, k DESC, f) AS rn FROM c JOIN n ON c.g = n.g WHERE total >= least AND (side = 1 OR regexp_matches(affix, '^[A-Z]')))
SELECT g, CASE WHEN side = 0 THEN '*' || affix ELSE affix || '*' END AS pattern, total FROM r WHERE rn = 1"""


@query(_pattern_sql("SELECT split_part(p_name, ' ', 2) AS g, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') AS name, p_partkey AS o FROM part"))
def name_suffix(spark, t):
    words = F.split("p_name", " ")
    names = t("part").select(words[1].alias("g"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")).alias("name"), F.col("p_partkey").alias("o"))
    return directories.name_pattern(names, "g", "name", "o").drop("examples")


@query(_pattern_sql("SELECT c_mktsegment AS g, c_name AS name, c_custkey AS o FROM customer"))
def name_prefix(spark, t):
    names = t("customer").select(F.col("c_mktsegment").alias("g"), F.col("c_name").alias("name"), F.col("c_custkey").alias("o"))
    return directories.name_pattern(names, "g", "name", "o").drop("examples")


@query(
    """SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS n_true, count(*) FILTER (WHERE quality = 1) / count(*)::DOUBLE >= 0.8::DOUBLE AS holds, count(*) FILTER (WHERE quality = 1) = count(*) AS all_true
FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY source"""
)
def dto_share(spark, t):
    d = t("documents").select("doc_id", "source").join(t("labels"), "doc_id", "left").filter("quality IS NOT NULL")
    return directories.share_at_least(d, "source", F.col("quality") == 1, directories.METHODLESS)


@query(
    """WITH n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS index, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id, CAST(index AS INTEGER) AS index, n FROM n WHERE index IN (0, n // 2, n - 1)"""
)
def samples(spark, t):
    return directories.samples(t("documents"), "source", "doc_id", "doc_id")


@query(
    """WITH n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)
SELECT source, doc_id, CAST(NULL AS BIGINT) AS remaining FROM n WHERE rn <= 8 UNION ALL SELECT source, NULL, count(*) - 8 FROM documents GROUP BY source HAVING count(*) > 8"""
)
def overflow(spark, t):
    first, more = directories.overflow(t("documents").select("source", "doc_id"), "source", "doc_id", 8)
    return first.unionByName(more, allowMissingColumns=True)


@query(
    """SELECT role AS directory, count(*) AS file_count, CAST(sum(length(text) % 7) AS BIGINT) AS test_function_count, string_agg(DISTINCT 'l' || CAST(conv_id % 3 AS VARCHAR), ', ' ORDER BY 'l' || CAST(conv_id % 3 AS VARCHAR)) AS languages,
  string_agg(lpad(CAST(conv_id AS VARCHAR), 6, '0') || '/' || CAST(turn AS VARCHAR), ', ' ORDER BY lpad(CAST(conv_id AS VARCHAR), 6, '0') || '/' || CAST(turn AS VARCHAR)) AS files FROM conversations GROUP BY role"""
)
def test_summary(spark, t):
    c = t("conversations").select("role", F.concat(F.lpad(F.col("conv_id").cast("string"), 6, "0"), F.lit("/"), "turn").alias("file"), (F.length("text") % 7).alias("n"), F.concat(F.lit("l"), F.col("conv_id") % 3).alias("language"))
    out = directories.test_summary(c, "role", "file", "n", "language").withColumnRenamed("role", "directory")
    return out.withColumn("languages", F.array_join("languages", ", ")).withColumn("files", F.array_join("files", ", "))


@query(
    """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth, count(*) OVER (PARTITION BY user_id) AS total FROM events),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN total > 8 AND nth > 1 THEN 1 ELSE 0 END, event_id) AS pick FROM e)
SELECT user_id, event_type, event_id, CAST(pick AS INTEGER) AS pick, total FROM p WHERE pick <= 8"""
)
def cap_routes(spark, t):
    return wiring.cap_routes(t("events").select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id", 8)


@query("WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS total FROM events) SELECT user_id, event_id, total FROM e WHERE rn <= 5")
def cap_groups(spark, t):
    return wiring.first_k(t("events").select("user_id", "event_id"), "user_id", "event_id", 5)


_REGISTRY = "r AS (SELECT props, count(*) AS n, min(event_id) AS f FROM events GROUP BY props HAVING count(*) >= 90), k AS (SELECT 'm' || CAST(row_number() OVER (ORDER BY n DESC, f) - 1 AS VARCHAR) AS key, props, n FROM r)"


@query(f"WITH {_REGISTRY} SELECT key, props, n FROM k")
def registry_keys(spark, t):
    return registry.registry(t("events"), "props", "event_id", least=90)


@query(f"WITH {_REGISTRY} SELECT event_id, coalesce(key, e.props) AS props FROM events e LEFT JOIN k ON e.props = k.props")
def registry_rewrite(spark, t):
    e = t("events").select("event_id", "props")
    return registry.rewrite(e, registry.registry(e, "props", "event_id", least=90), "props")


@query("SELECT DISTINCT lang AS language FROM documents")
def distinct_languages(spark, t):
    return t("documents").select(F.col("lang").alias("language")).distinct()


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def first_seen(spark, t):
    return scans.first_seen(t("orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query(
    "SELECT DISTINCT c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'claude' WHEN c_custkey % 3 = 1 THEN 'cursor' END AS agent_id, CASE WHEN c_custkey % 3 = 0 THEN 'CLAUDE.md' WHEN c_custkey % 3 = 1 THEN '.cursorrules' END AS file_path FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Claude Desktop ' WHEN 1 THEN 'my-CURSOR ' ELSE 'other ' END || c_name AS c_name FROM customer) WHERE c_custkey % 3 < 2"
)
def connector_match(spark, t):
    name = F.concat(F.when(F.col("c_custkey") % 3 == 0, "Claude Desktop ").when(F.col("c_custkey") % 3 == 1, "my-CURSOR ").otherwise("other "), "c_name")
    return connectors.match(t("customer").select(name.alias("name")), connectors.frame(spark))


@query("SELECT * FROM (VALUES ('small', 30, 40, 20, 15, 30, 15, 15, 4, 'medium'), ('medium', 12, 20, 10, 8, 15, 8, 8, 3, 'medium'), ('large', 8, 10, 5, 5, 10, 5, 5, 2, 'high')) AS p(name, max_methods_per_symbol, max_symbols_per_file, dir_aggregation_threshold, max_files_per_layer, max_route_controllers, max_routes_per_controller, max_go_handlers, max_dir_depth, impact_filter)")
def size_profiles(spark, t):
    return profiles_frame(spark)


#: Entries of files: directories are sources, methods are event types, languages are documents'.
_COLLAPSE = """
WITH m AS (SELECT DISTINCT user_id AS d, event_type || '_' || CAST(CAST(floor(value / 40) AS INTEGER) AS VARCHAR) AS method FROM events),
e AS (SELECT source, lang, doc_id, source || '/f' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS file FROM documents WHERE lang IS NOT NULL),
c AS (SELECT source, lang, count(*) AS n, min(file) AS f FROM e GROUP BY source, lang), lead AS (SELECT source, arg_min(lang, (-n, f)) AS lang, max(n) AS n FROM c GROUP BY source),
mm AS (SELECT e.source, e.file, m.method FROM e JOIN lead l ON e.source = l.source AND e.lang = l.lang AND l.n >= 20 JOIN m ON m.d = e.doc_id),
common AS (SELECT mm.source, method FROM mm JOIN lead l ON mm.source = l.source GROUP BY mm.source, method, l.n HAVING count(DISTINCT file) >= 0.6::DOUBLE * l.n),
cn AS (SELECT source, count(*) AS k FROM common GROUP BY source), nm AS (SELECT source, count(*) AS k FROM mm GROUP BY source)
"""


@query(
    _COLLAPSE
    + """, few AS (SELECT e.source, e.file, row_number() OVER (PARTITION BY e.source ORDER BY e.file) AS rn FROM e JOIN lead l ON e.source = l.source AND l.n < 20)
SELECT file, CAST(NULL AS VARCHAR) AS directory, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS INTEGER) AS n, CAST(NULL AS VARCHAR) AS note FROM few WHERE rn <= 15
UNION ALL SELECT NULL, source || '/', 'overflow', CAST(count(*) - 15 AS INTEGER), NULL FROM few GROUP BY source HAVING count(*) > 15
UNION ALL SELECT e.file, NULL, NULL, NULL, NULL FROM e JOIN lead l ON e.source = l.source AND l.n >= 20 AND e.lang <> l.lang
UNION ALL SELECT NULL, l.source || '/', 'directory_summary', CAST(l.n AS INTEGER), CASE WHEN coalesce(cn.k, 0) >= 2 AND cn.k / (nm.k / l.n::DOUBLE) >= 0.4::DOUBLE THEN NULL ELSE 'No common method pattern detected' END
  FROM lead l LEFT JOIN cn ON l.source = cn.source LEFT JOIN nm ON l.source = nm.source WHERE l.n >= 20"""
)
def dir_collapse(spark, t):
    methods = t("events").select(F.col("user_id").alias("doc_id"), _method().alias("method")).distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list("method")).alias("methods"))
    d = t("documents").filter("lang IS NOT NULL").select("doc_id", "source", "lang").join(methods, "doc_id", "left")
    none = F.array().cast("array<string>")
    symbol = F.struct(
        F.concat(F.lit("T"), F.col("doc_id")).alias("name"), F.lit("interface").alias("kind"), F.lit("").alias("signature"), none.alias("implements"), none.alias("constructor_deps"),
        F.coalesce("methods", none).alias("methods"), F.lit(None).cast("int").alias("total_methods"), F.lit(None).cast("boolean").alias("is_dto"), none.alias("decorators"),
    )
    entries = d.select(
        F.concat("source", F.lit("/f"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("file"), F.col("lang").alias("language"), F.lit(None).cast("string").alias("kind"),
        F.lit(None).cast("boolean").alias("is_dto"), F.lit(None).cast("int").alias("symbols_count"), F.lit(None).cast("int").alias("total_symbols"), F.array(symbol).alias("symbols"),
    )
    out = directories.collapse(entries, replace(PROFILES["small"]))
    return out.select("file", "directory", "kind", F.coalesce("file_count", "remaining_files").alias("n"), "note")
