"""Queries from dump files to policy-filtered matches, the TSV tables between the stages, and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import graph, matching, policy, statistics, surfaces
from lexweave.plans import adapters as A
from lexweave.plans.registry import query
from lexweave.session import spread, table
from lexweave.sources import dumps, tsv, vault
from lexweave.staging import shared_path, stage

DATE = "20240101"


def _insert(name: str, *values: Column) -> Column:
    """A line that inserts one tuple; texts come quoted and escaped."""
    row = F.concat_ws(",", *[v.cast("string") for v in values])
    return F.concat(F.lit(f"INSERT INTO `{name}` VALUES ("), row, F.lit(");"))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def _write(lines: DataFrame, path: str, codec: str, before: str = "-- a dump") -> None:
    noise = F.array(F.lit(before), F.col("line"), F.lit(""))
    lines.select(F.explode(noise).alias("value")).write.option("compression", codec).text(path)


def dump_files(spark: SparkSession, titles: DataFrame, redirects: DataFrame, claims: DataFrame) -> str:
    """Write dumps of (wiki, page_id, namespace, title, propname, value), (wiki, source_page_id, target_title) and entity JSON lines; the folder."""
    root = shared_path(spark, "dumps")
    for wiki in ("zh", "en"):
        own = F.col("wiki") == wiki
        pages = titles.filter(own)
        _write(pages.select(_insert("page", F.col("page_id"), F.col("namespace"), _quoted(F.col("title")), F.lit("''"), F.lit("NULL")).alias("line")), dumps.dump_path(root, wiki, DATE, "page"), "gzip")
        _write(pages.orderBy("page_id").select(_insert("page_props", F.col("page_id"), _quoted(F.col("propname")), _quoted(F.col("value")), F.lit("NULL")).alias("line")), dumps.dump_path(root, wiki, DATE, "page_props"), "gzip")
        _write(redirects.filter(own).select(_insert("redirect", F.col("source_page_id"), F.lit(0), _quoted(F.col("target_title"))).alias("line")), dumps.dump_path(root, wiki, DATE, "redirect"), "gzip")
    _write(claims.select(F.concat("line", F.lit(",")).alias("line")).filter(F.length("line") > 1), dumps.entity_dump_path(root, DATE), "bzip2", "[")
    return root


def part_claims(spark: SparkSession, d: str) -> DataFrame:
    """Entity JSON lines: a third of the entities point at one of the anchors, all at others of their kind."""
    k = F.col("p_partkey")
    anchor = F.get(F.array(*[F.lit(q) for q in policy.ANCHOR_QIDS]), (k % 27).cast("int"))
    one = lambda n: F.array(F.struct(F.struct(F.struct(F.struct(F.concat(F.lit("Q"), n.cast("string")).alias("id")).alias("value")).alias("datavalue")).alias("mainsnak")))
    body = F.struct(F.concat(F.lit("Q"), k).alias("id"), F.struct(one(F.when(k % 3 == 0, anchor).otherwise((k * 7) % 97 + 1)).alias("P31"), one(F.floor(k / 2) + 1).alias("P279")).alias("claims"))
    return spread(table(spark, d, "part").select("p_partkey"), "p_partkey").select(F.to_json(body).alias("line"))


def reported(spark: SparkSession, root: str, candidates: DataFrame) -> DataFrame:
    """(qid, report) of every entity of a preprocess run: edges, distances to all anchors, cards and the policy."""
    claims = dumps.entity_claims(dumps.entity_lines(spark, dumps.entity_dump_path(root, DATE)))
    return surfaces.entity_reports(claims, candidates, policy.anchors(spark))


def _listed(lists: DataFrame) -> DataFrame:
    return lists.select(F.explode("qids").alias("name")).select(T.qid_number(F.col("name")).alias("qid")).distinct()


def _part_dumps(spark: SparkSession, d: str) -> str:
    part, k = spread(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey"), F.col("p_partkey")
    wiki, title = F.when(k % 2 == 0, "zh").otherwise("en").alias("wiki"), F.replace("p_name", F.lit(" "), F.lit("_"))
    titles = part.select(wiki, k.alias("page_id"), F.when(k % 11 == 0, 4).otherwise(0).alias("namespace"), title.alias("title"), F.when(k % 7 != 0, "wikibase_item").otherwise("other").alias("propname"), F.concat(F.lit("Q"), k % 97 + 1).alias("value"))
    target = part.select((k - 1).alias("k"), title.alias("target_title"))
    redirects = part.filter(k % 3 == 0).select(wiki, k.alias("source_page_id"), F.floor(k / 3).alias("k")).join(target.hint("merge"), "k").drop("k")
    return dump_files(spark, titles, redirects, part_claims(spark, d))


def _part_lists(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    root = _part_dumps(spark, d)
    return root, surfaces.surface_qids(surfaces.surface_sources(*dumps.wiki_tables(spark, root, ["zh", "en"], DATE)))


_ANCHORS = ", ".join(f"({i}, {q})" for i, q in enumerate(policy.ANCHOR_QIDS))
_WEIGHTS = " ".join(f"WHEN {a} THEN {w}" for a, w in policy.WEIGHTS.items())
REPORT_SQL = f"""
anchor AS (SELECT * FROM (VALUES {_ANCHORS}) AS t(anchor_id, qid)),
entity AS (
  SELECT p_partkey AS qid, CASE WHEN p_partkey % 3 = 0 THEN (SELECT qid FROM anchor WHERE anchor_id = p_partkey % 27) ELSE (p_partkey * 7) % 97 + 1 END AS kind, p_partkey // 2 + 1 AS class FROM part
), edge AS (
  SELECT qid AS source, kind AS target FROM entity UNION SELECT qid, class FROM entity
), reached AS (
  SELECT anchor_id, qid AS node, 0 AS distance FROM anchor
  UNION
  SELECT r.anchor_id, e.source, r.distance + 1 FROM reached r JOIN edge e ON e.target = r.node WHERE r.distance < 6
), nearest AS (
  SELECT anchor_id, node, min(distance) AS distance FROM reached GROUP BY anchor_id, node
), weighed AS (
  SELECT node, anchor_id, distance, (CASE anchor_id {_WEIGHTS} ELSE 0 END)::DOUBLE
         * (CASE WHEN distance = 0 THEN 1.5 WHEN distance <= 1 THEN 1.0 WHEN distance <= 2 THEN 0.7 WHEN distance <= 4 THEN 0.35 ELSE 0.15 END)::DOUBLE AS s
  FROM nearest
), folded AS (
  SELECT node AS qid, list_reduce(list_prepend(0.0::DOUBLE, list(s ORDER BY anchor_id, distance)), lambda x, y: x + y) AS total,
         bool_or(anchor_id IN ({", ".join(map(str, policy.VETOES))}) AND distance <= {policy.VETO_DISTANCE}) AS veto FROM weighed GROUP BY node
), good AS (
  SELECT 'Q' || qid AS qid FROM folded WHERE total > 0 AND NOT veto AND qid NOT IN (SELECT qid FROM entity WHERE 4167410 IN (kind, class))
)"""


@query(f"""WITH RECURSIVE {A.SOURCES_SQL}, {REPORT_SQL}
SELECT surface_key, string_agg(q, '|' ORDER BY q) AS qids FROM (SELECT surface_key, unnest(qids) AS q FROM lists) WHERE q IN (SELECT qid FROM good) GROUP BY surface_key""")
def dump_candidates(spark, d):
    root, lists = _part_lists(spark, d)
    names = _listed(lists)
    found = policy.filter_candidates(lists, reported(spark, root, names).withColumn("qid", F.concat(F.lit("Q"), "qid")))
    return found.withColumn("qids", F.array_join("qids", "|"))


@query(f"""WITH RECURSIVE {A.MATCHES_SQL}, {REPORT_SQL}
SELECT note_id, start, "end", surface, 'Q' || (surface_id % 97 + 1) AS qids FROM matches WHERE surface_id % 10 <> 9 AND 'Q' || (surface_id % 97 + 1) IN (SELECT qid FROM good)""")
def dump_note_matches(spark, d):
    """The whole chain: dump files, candidate lists, graph, policy, a dictionary of the surfaces left, and matches in texts."""
    words, k = A.dictionary(spark, d), F.col("surface_id")
    wiki = F.when(k % 2 == 0, "zh").otherwise("en").alias("wiki")
    titles = words.select(wiki, (k + 1).alias("page_id"), F.when(k % 10 == 9, 4).otherwise(0).alias("namespace"), F.col("pattern").alias("title"), F.lit("wikibase_item").alias("propname"), F.concat(F.lit("Q"), k % 97 + 1).alias("value"))
    none = titles.limit(0).select("wiki", F.col("page_id").alias("source_page_id"), F.col("title").alias("target_title"))
    root = dump_files(spark, titles, none, part_claims(spark, d))
    lists = surfaces.surface_qids(surfaces.surface_sources(*dumps.wiki_tables(spark, root, ["zh", "en"], DATE)))
    names = _listed(lists)
    report = reported(spark, root, names).withColumn("qid", F.concat(F.lit("Q"), "qid"))
    documents = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    found = matching.match_surfaces(documents, lists, report, "doc_id", "text")
    return found.select("note_id", "start", "end", "surface", F.array_join("qids", "|").alias("qids"))


@query("""SELECT 'Q' || (p_partkey % 97 + 1) AS qid, min((p_partkey % 97)::BIGINT) AS eid_id FROM part GROUP BY 1""")
def qid_lookup(spark, d):
    """Every QID of the part pages by its dense number; an unknown one would be an error."""
    qids = table(spark, d, "part").select((F.col("p_partkey") % 97 + 1).alias("qid"))
    return surfaces.eid_lookup(qids.distinct(), surfaces.dense_ids(qids.distinct(), "qid", "eid_id")).select(F.concat(F.lit("Q"), "qid").alias("qid"), "eid_id")


@query(f"""WITH RECURSIVE {REPORT_SQL}
SELECT (row_number() OVER (ORDER BY e.qid) - 1)::BIGINT AS eid_id, e.qid, (CASE WHEN 4167410 IN (kind, class) THEN 1 ELSE 0 END)::INT AS flags, coalesce(c.colors, '') AS colors
FROM entity e LEFT JOIN (SELECT node, string_agg(anchor_id || ':' || distance, ' ' ORDER BY anchor_id, distance) AS colors FROM nearest GROUP BY node) c ON c.node = e.qid""")
def entity_table(spark, d):
    """Entities with their dense number, flags and cards for all anchors."""
    claims = stage(dumps.entity_claims(part_claims(spark, d).withColumnRenamed("line", "value")), "claims")
    found = surfaces.entity_cards(claims, claims.select(T.qid_number(F.col("qid")).alias("qid")), policy.anchors(spark))
    shown = F.array_join(F.transform("colors", lambda c: F.concat_ws(":", c["anchor_id"].cast("string"), c["distance"].cast("string"))), " ")
    return surfaces.dense_ids(stage(found.select("qid", "flags", shown.alias("colors")), "cards"), "qid", "eid_id")


@query(f"WITH {A.SOURCES_SQL} SELECT surface_key, array_to_string(qids, '|') AS qids, len(qids)::INT AS qid_count FROM lists")
def surface_tsv(spark, d):
    """Candidate lists written as TSV files and read again."""
    path = shared_path(spark, "surface-qids")
    tsv.write_lines(tsv.qid_lines(surfaces.surface_qids(A.sources(spark, d))), path, tsv.QIDS)
    rows = tsv.read_qids(spark, path)
    return rows.select("surface_key", F.array_join(F.transform("qids", lambda q: F.concat(F.lit("Q"), q)), "|").alias("qids"), "qid_count")


@query("""WITH t AS (SELECT p_partkey AS qid, list_sort(list_distinct([p_partkey % 13 + 1, p_size + 1000])) AS targets FROM part WHERE p_partkey % 50 <> 0
UNION ALL SELECT p_partkey, list_sort(list_distinct([p_partkey % 13 + 1, p_size + 1000, 4167410])) FROM part WHERE p_partkey % 50 = 0)
SELECT qid::BIGINT AS qid, (CASE WHEN list_contains(targets, 4167410) THEN 1 ELSE 0 END)::INT AS flags, array_to_string(targets, '|') AS targets FROM t""")
def type_edge_tsv(spark, d):
    """Type edges written as TSV files and read again."""
    path = shared_path(spark, "type-edges")
    edges = surfaces.type_edges(A.claims(spark, d), spark.createDataFrame([], "qid long"))
    tsv.write_lines(tsv.edge_lines(edges), path, tsv.EDGES)
    return tsv.read_edges(spark, path).withColumn("targets", F.array_join(F.col("targets").cast("array<string>"), "|"))


@query(f"""WITH {A.SOURCES_SQL}, p AS (SELECT wiki, count(*) AS pages, count(qid) AS with_qid FROM pages GROUP BY wiki), s AS (SELECT wiki, count(*) FILTER (source = 'redirect') AS redirects, count(*) AS sources FROM (SELECT DISTINCT * FROM sources) GROUP BY wiki)
SELECT wiki, pages, with_qid, redirects, sources FROM p JOIN s USING (wiki)""")
def preprocess_summary(spark, d):
    return statistics.preprocess_summary(A.part_pages(spark, d)[0], A.sources(spark, d))


@query("""WITH t AS (SELECT p_partkey AS qid, len(list_distinct(list_filter([p_partkey % 13 + 1, p_size + 1000, CASE WHEN p_partkey % 50 = 0 THEN 4167410 END], lambda x: x IS NOT NULL))) AS n, p_partkey % 50 = 0 AS flagged FROM part)
SELECT count(*) AS handled, count(*) FILTER (qid % 1000 = 0 AND qid // 1000 IN (SELECT n_nationkey FROM nation)) AS candidate_hits, count(*) AS retained, count(*) FILTER (n > 0) AS with_targets, sum(n)::BIGINT AS targets, count(*) FILTER (flagged) AS disambiguations FROM t""")
def scan_statistics(spark, d):
    candidates = table(spark, d, "nation").select((F.col("n_nationkey") * 1000).cast("bigint").alias("qid"))
    return statistics.scan_statistics(surfaces.type_edges(A.claims(spark, d), spark.createDataFrame([], "qid long")), candidates)


@query(f"WITH {A.SOURCES_SQL}, one AS (SELECT surface_key, substring(unnest(qids), 2)::BIGINT AS q FROM lists) SELECT count(DISTINCT surface_key) AS surfaces, count(*) AS listed, count(DISTINCT q) AS eids, max(q) AS max_qid FROM one")
def runtime_statistics(spark, d):
    lists = surfaces.surface_qids(A.sources(spark, d))
    return statistics.runtime_statistics(lists.withColumn("qids", F.transform("qids", T.qid_number)))


@query("WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-zà-ÿ]+')) AS p FROM benchmark) SELECT count(*) AS patterns, sum(strlen(p))::BIGINT AS bytes FROM w WHERE length(p) >= 4")
def pattern_statistics(spark, d):
    return statistics.pattern_statistics(A.dictionary(spark, d))


@query("""SELECT c AS component, w AS wiki, 'https://dumps.wikimedia.org/' || w || '/20240101/' || w || '-20240101-' || c || '.sql.gz' AS url, 'out/' || w || '/20240101/' || w || '-20240101-' || c || '.sql.gz' AS path
FROM (VALUES ('page'), ('redirect'), ('page_props')) a(c), (VALUES ('zhwiki'), ('enwiki')) b(w)
UNION ALL SELECT 'wikidata_entities', NULL, 'https://dumps.wikimedia.org/wikidatawiki/entities/20240101/wikidata-20240101-all.json.bz2', 'out/wikidatawiki/20240101/wikidata-20240101-all.json.bz2'""")
def download_plan(spark, d):
    return vault.download_plan(spark, ["zhwiki", "enwiki"], ["page", "redirect", "page_props", "wikidata_entities"], DATE, "out")
