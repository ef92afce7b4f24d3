"""The registry of queries and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import tables
from lexweave.functions import text as T
from lexweave.operators import graph, matching, mentions, notes, passes, policy, sharded, store, surfaces
from lexweave.plans import adapters as A
from lexweave.plans import dump_queries, interval_queries, store_queries  # noqa: F401 - they register themselves
from lexweave.plans.registry import oracle_sql, queries, query  # noqa: F401
from lexweave.session import table
from lexweave.sources import dumps
from lexweave.staging import shared_path
from lexweave.streaming import chunks

FLAGSHIP = "dict_match_counts"


@query(f"WITH {A.SOURCES_SQL} SELECT DISTINCT * FROM sources")
def surface_sources(spark, d):
    return A.sources(spark, d)


@query(f"WITH {A.SOURCES_SQL} SELECT surface_key, array_to_string(qids, '|') AS qids, len(qids)::INT AS qid_count FROM lists")
def surface_qid_lists(spark, d):
    return surfaces.surface_qids(A.sources(spark, d)).withColumn("qids", F.array_join("qids", "|"))


@query(f"WITH {A.SOURCES_SQL} SELECT surface_key, (row_number() OVER (ORDER BY surface_key) - 1)::BIGINT AS surface_id FROM lists")
def surface_ids(spark, d):
    return surfaces.dense_ids(A.sources(spark, d).select("surface_key").distinct(), "surface_key", "surface_id")


@query(f"WITH {A.SOURCES_SQL} SELECT qid, (row_number() OVER (ORDER BY qid) - 1)::BIGINT AS eid_id FROM (SELECT DISTINCT substring(qid, 2)::BIGINT AS qid FROM sources)")
def eid_ids(spark, d):
    return surfaces.dense_ids(A.sources(spark, d).select(T.qid_number(F.col("qid")).alias("qid")).distinct(), "qid", "eid_id")


@query(f"""WITH {A.SOURCES_SQL}, n AS (SELECT row_number() OVER (ORDER BY surface_key) - 1 AS surface_id, len(qids) AS length FROM lists)
SELECT surface_id::BIGINT AS surface_id, coalesce(sum(length) OVER (ORDER BY surface_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", length::BIGINT AS length FROM n""")
def surface_eid_index(spark, d):
    lists = surfaces.dense_ids(surfaces.surface_qids(A.sources(spark, d)), "surface_key", "surface_id")
    return surfaces.list_offsets(lists, "surface_id", F.col("qid_count"))


@query(f"""WITH {A.SOURCES_SQL}
SELECT wiki, count(*) AS "rows", count(*) FILTER (source = 'redirect') AS redirects, count(DISTINCT surface_key) AS surfaces, 0::BIGINT AS ambiguous FROM sources GROUP BY wiki
UNION ALL SELECT '*', (SELECT count(*) FROM sources), (SELECT count(*) FROM sources WHERE source = 'redirect'), count(*), count(*) FILTER (len(qids) > 1) FROM lists""")
def ambiguous_surface_summary(spark, d):
    return surfaces.ambiguity_summary(A.sources(spark, d))


@query("""WITH t AS (
  SELECT p_partkey AS qid, list_sort(list_distinct(list_filter([p_partkey % 13 + 1, p_size + 1000, CASE WHEN p_partkey % 50 = 0 THEN 4167410 END], lambda x: x IS NOT NULL))) AS targets FROM part
), m AS (
  SELECT coalesce(t.qid, n.n_nationkey * 1000) AS qid, targets FROM t FULL JOIN nation n ON n.n_nationkey * 1000 = t.qid
) SELECT qid::BIGINT AS qid, (CASE WHEN list_contains(targets, 4167410) THEN 1 ELSE 0 END)::INT AS flags, coalesce(array_to_string(targets, '|'), '') AS targets FROM m""")
def entity_type_edges(spark, d):
    candidates = table(spark, d, "nation").select((F.col("n_nationkey") * 1000).cast("bigint").alias("qid"))
    return surfaces.type_edges(A.claims(spark, d), candidates).withColumn("targets", F.array_join(F.col("targets").cast("array<string>"), "|"))


@query(f"WITH RECURSIVE {A.EDGES_SQL} SELECT DISTINCT target, source FROM edges")
def reverse_adjacency(spark, d):
    return graph.reverse_adjacency(A.graph_edges(spark, d))


def _distances(spark, d):
    anchors = spark.range(3).select(F.col("id").cast("int").alias("anchor_id"), (F.col("id") + 1).alias("qid"))
    return graph.anchor_distances(A.graph_edges(spark, d), anchors)


@query(f"WITH RECURSIVE {A.EDGES_SQL} SELECT anchor_id::INT AS anchor_id, node, distance::INT AS distance FROM best")
def entity_color_distance(spark, d):
    return _distances(spark, d)


@query(f"""WITH RECURSIVE {A.EDGES_SQL}
SELECT node, string_agg(anchor_id || ':' || distance, ' ' ORDER BY anchor_id, distance) AS colors FROM best WHERE node % 3 <> 0 GROUP BY node""")
def entity_color_cards(spark, d):
    nodes = A.graph_edges(spark, d).select(F.explode(F.array("source", "target")).alias("node")).filter("node % 3 <> 0")
    found = graph.cards(_distances(spark, d), nodes)
    return found.select("node", F.array_join(F.transform("colors", lambda c: F.concat_ws(":", c["anchor_id"].cast("string"), c["distance"].cast("string"))), " ").alias("colors"))


@query(f"WITH {A.POLICY_SQL} SELECT qid, report FROM report")
def entity_policy_report(spark, d):
    return A.policy_cards(spark, d).select("qid", policy.should_report(F.col("flags"), F.col("colors")).alias("report"))


@query(f"""WITH {A.SOURCES_SQL}, {A.POLICY_SQL}
SELECT surface_key, string_agg(q, '|' ORDER BY q) AS qids FROM (SELECT surface_key, unnest(qids) AS q FROM lists) JOIN report ON report.qid = q AND report GROUP BY surface_key""")
def policy_filtered_candidates(spark, d):
    found = policy.filter_candidates(surfaces.surface_qids(A.sources(spark, d)), entity_policy_report(spark, d))
    return found.withColumn("qids", F.array_join("qids", "|"))


def _matches(spark, d, kind):
    return matching.match_dictionary(table(spark, d, "documents"), A.dictionary_words(spark, d), "doc_id", "text", kind)


@query(f"WITH {A.MATCHES_SQL} SELECT * FROM matches")
def dict_matches_overlapping(spark, d):
    return _matches(spark, d, "overlapping")


@query(f"WITH {A.MATCHES_SQL} SELECT * FROM matches")
def dict_matches_sharded(spark, d):
    return sharded.match_sharded(table(spark, d, "documents"), A.dictionary(spark, d), "doc_id", "text")


@query(A.greedy_sql('start, "end" DESC, surface_id'))
def dict_matches_sharded_leftmost_longest(spark, d):
    return sharded.match_sharded(table(spark, d, "documents"), A.dictionary(spark, d), "doc_id", "text", "leftmost_longest")


@query(f"WITH {A.MATCHES_SQL} SELECT surface, count(*) AS n, count(DISTINCT note_id) AS notes FROM matches GROUP BY surface")
def dict_match_counts(spark, d):
    return matching.count_matches(table(spark, d, "documents"), A.dictionary(spark, d), "doc_id", "text")


@query(f"""WITH {A.MATCHES_SQL} SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY note_id, "end" ORDER BY "end" - start DESC, surface_id) = 1""")
def dict_matches_longest_per_end(spark, d):
    return _matches(spark, d, "longest_per_end")


@query(A.greedy_sql('"end", start, surface_id'))
def dict_matches_nonoverlap(spark, d):
    return _matches(spark, d, "nonoverlap")


@query(A.greedy_sql('start, "end" DESC, surface_id'))
def dict_matches_leftmost_longest(spark, d):
    return _matches(spark, d, "leftmost_longest")


@query(A.greedy_sql('start, surface_id'))
def dict_matches_leftmost_first(spark, d):
    return _matches(spark, d, "leftmost_first")


@query("""SELECT (count(DISTINCT p) + 1)::BIGINT AS num_states FROM (SELECT unnest(list_transform(range(1, length(p_name) + 1), lambda k: p_name[1:k])) AS p FROM part)""")
def automaton_num_states(spark, d):
    return matching.num_states(table(spark, d, "part"), "p_name")


@query("""WITH c AS (SELECT unnest(string_split(p_name, '')) AS ch FROM part), n AS (SELECT ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ch)
SELECT ch, n, (row_number() OVER (ORDER BY n DESC, ch) - 1)::INT AS code FROM n""")
def char_code_map(spark, d):
    from pyspark.sql import Window as W

    counts = table(spark, d, "part").select(F.explode(F.split("p_name", "")).alias("ch")).filter("ch <> ''").groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("code", F.row_number().over(W.orderBy(F.desc("n"), "ch")) - 1)  # one row a character of the alphabet


@query("SELECT doc_id, length(text)::BIGINT AS code_points, strlen(text)::BIGINT AS bytes, length(text)::BIGINT AS utf16 FROM documents")
def offset_units(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("bigint").alias("code_points"), F.octet_length("text").cast("bigint").alias("bytes"), T.utf16_length(F.col("text")).alias("utf16"))


@query(f"WITH {A.INTERVALS_SQL} SELECT * FROM clustered")
def match_clusters(spark, d):
    return mentions.clusters(A.intervals(spark, d))


@query(f"""WITH {A.INTERVALS_SQL} SELECT note_id, cluster_no, min(start) AS start, max("end") AS "end", count(*) AS n_matches, max(n_qids) AS n_qids,
CASE WHEN count(*) = 1 AND max(n_qids) = 1 THEN 'mention' ELSE 'conflict' END AS kind FROM clustered GROUP BY note_id, cluster_no""")
def mention_classification(spark, d):
    return mentions.classify(mentions.clusters(A.intervals(spark, d)))


@query("""SELECT l_orderkey AS note_id, (l_linenumber % 2)::INT AS section, l_suppkey % 5 AS eid, l_partkey * 10 + l_linenumber AS start FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2, l_suppkey % 5 ORDER BY l_partkey * 10 + l_linenumber) = 1""")
def section_first_link(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("note_id"), (F.col("l_linenumber") % 2).cast("int").alias("section"), (F.col("l_suppkey") % 5).alias("eid"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("start"))
    return mentions.first_links(li)


@query("""SELECT 'Q' || s_suppkey AS eid, ((SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND (l_returnflag <> 'R' OR l_linestatus = 'F'))
+ (SELECT count(*) FROM orders WHERE o_orderkey % 4 = 0 AND o_custkey % 120 = s_suppkey))::BIGINT AS ref_count FROM supplier""")
def entity_ref_counts(spark, d):
    return store.reference_counts(*A.store(spark, d))


@query("""WITH s AS (SELECT l_partkey % 50 AS k, arg_max('Q' || (l_suppkey % 9), l_orderkey * 10 + l_linenumber) AS e FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1)
SELECT l_orderkey AS note_id, l_linenumber AS line, CASE WHEN l_linenumber = 1 THEN 'Q1' WHEN e IN ('Q' || (l_suppkey % 9), 'Q' || (l_partkey % 9)) THEN e END AS resolved_eid FROM lineitem LEFT JOIN s ON s.k = l_partkey % 50""")
def decision_inheritance(spark, d):
    li = table(spark, d, "lineitem")
    key = {"hash": (F.col("l_partkey") % 50).cast("string"), "surface": F.lit("s"), "surface_id": F.lit(1), "start": F.lit(0), "end": F.lit(2)}
    q = lambda c: F.concat(F.lit("Q"), (F.col(c) % 9).cast("string"))
    matches = li.select(F.col("l_orderkey").alias("note_id"), F.col("l_linenumber").alias("line"), *[c.alias(n) for n, c in key.items()], F.array(q("l_suppkey"), q("l_partkey")).alias("eids"), F.when(F.col("l_linenumber") == 1, "Q1").alias("resolved_eid"))
    stored = li.filter("l_linenumber <= 2").select(*[c.alias(n) for n, c in key.items()], q("l_suppkey").alias("resolved_eid"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return store.inherit_decisions(matches, stored).select("note_id", "line", "resolved_eid")


@query("""SELECT DISTINCT 'Q' || k AS eid, k < 20 AS old FROM (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey < 20 UNION SELECT c_custkey % 150 FROM customer)
WHERE k >= 20 OR k IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 20) OR k NOT IN (SELECT s_suppkey FROM supplier)""")
def entity_upsert(spark, d):
    eid = lambda c: F.concat(F.lit("Q"), c.cast("string")).alias("eid")
    old = table(spark, d, "supplier").filter("s_suppkey < 20").select(eid(F.col("s_suppkey")), F.lit(True).alias("old"))
    new = table(spark, d, "customer").select(eid(F.col("c_custkey") % 150), (F.col("c_custkey") % 150 < 20).alias("old"))
    return store.merge_new(old, new, "eid")


@query("SELECT c_custkey AS note_id, CASE WHEN o.k IS NOT NULL THEN 'synced' ELSE 'modified' END AS status, coalesce(o.m, 1)::BIGINT AS mtime, coalesce(o.s, 2)::BIGINT AS size, coalesce(o.h, 'h') AS hash FROM customer LEFT JOIN (SELECT o_custkey AS k, max(o_orderkey) AS m, count(*) AS s, 'h' || count(*) AS h FROM orders GROUP BY 1) o ON o.k = c_custkey")
def note_mark_synced(spark, d):
    notes = table(spark, d, "customer").select(F.col("c_custkey").alias("note_id"), F.lit("modified").alias("status"), F.lit(1).cast("bigint").alias("mtime"), F.lit(2).cast("bigint").alias("size"), F.lit("h").alias("hash"))
    n = F.count(F.lit(1))
    seen = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("note_id")).agg(F.max("o_orderkey").alias("mtime"), n.alias("size"), F.concat(F.lit("h"), n).alias("hash"))
    return store.mark_synced(notes, seen)


@query("SELECT l_orderkey AS note_id, l_linenumber AS line FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def cascade_delete(spark, d):
    notes = table(spark, d, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("note_id"))
    return store.cascade_delete(notes, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("note_id"), F.col("l_linenumber").alias("line")), "note_id")


@query("""SELECT 'mention_range' AS rule, count(*) AS n FROM lineitem WHERE NOT (l_partkey % 10 - 1 >= 0 AND l_linenumber > l_partkey % 10 - 1)
UNION ALL SELECT 'mention_note', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0)""")
def constraint_violations(spark, d):
    _, found, _ = A.store(spark, d)
    return store.violations(found, table(spark, d, "orders").filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("note_id")))


@query("""WITH n AS (SELECT c_custkey AS path, c_custkey % 5 AS mtime, c_nationkey AS hash FROM customer WHERE c_custkey % 7 <> 0), s AS (SELECT c_custkey AS path, c_custkey % 4 AS mtime, c_custkey % 25 AS hash FROM customer WHERE c_custkey % 6 <> 0)
SELECT coalesce(n.path, s.path) AS path, CASE WHEN n.hash IS NULL THEN 'new' WHEN s.hash IS NULL THEN 'missing' WHEN n.mtime = s.mtime OR n.hash = s.hash THEN 'unchanged' ELSE 'modified' END AS status FROM n FULL JOIN s ON s.path = n.path""")
def note_status_transition(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    notes = c.filter("c_custkey % 7 <> 0").select(k.alias("path"), (k % 5).alias("mtime"), F.col("c_nationkey").alias("hash"))
    scan = c.filter("c_custkey % 6 <> 0").select(k.alias("path"), (k % 4).alias("mtime"), (k % 25).alias("hash"))
    return store.status_changes(notes, scan)


@query("SELECT eid FROM (SELECT 'Q' || l_suppkey AS eid FROM lineitem WHERE l_returnflag <> 'R' OR l_linestatus = 'F' UNION SELECT 'Q' || (o_custkey % 120) FROM orders WHERE o_orderkey % 4 = 0)")
def collected_mention_eids(spark, d):
    _, found, won = A.store(spark, d)
    return found.filter(store.effective(F.col("suspect"), F.col("resolved"))).select("eid").union(won.filter("resolved_eid IS NOT NULL")).distinct()


@query(r"SELECT doc_id, replace(replace(replace(replace(text, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r') AS escaped, true AS same FROM documents")
def tsv_escape(spark, d):
    coded = table(spark, d, "documents").withColumn("escaped", T.escape_tsv(F.col("text")))
    return coded.select("doc_id", "escaped", (T.unescape_tsv(F.col("escaped")) == F.col("text")).alias("same"))


@query("SELECT p_partkey, 'wiki/Q' || p_partkey AS target, CASE WHEN p_partkey > 0 THEN 'Q' || p_partkey END AS eid FROM part")
def link_target_paths(spark, d):
    raw = table(spark, d, "part").select("p_partkey", T.link_target(F.concat(F.lit(" /wiki\\Q"), F.col("p_partkey").cast("string"), F.lit("#part"))).alias("target"))
    return raw.withColumn("target", F.regexp_replace("target", "^/", "")).withColumn("eid", T.entity_id_of_path(F.concat("target", F.lit(".md"))))


@query("SELECT 'Q' || p_partkey AS qid, 'Q' || p_size || '|Q' || (p_partkey % 13) AS targets FROM part")
def json_claims(spark, d):
    one = lambda n: F.concat(F.lit('[{"mainsnak":{"datavalue":{"value":{"id":"Q'), n.cast("string"), F.lit('"}}}}]'))
    line = F.concat(F.lit('{"id":"Q'), F.col("p_partkey").cast("string"), F.lit('","claims":{"P31":'), one(F.col("p_size")), F.lit(',"P2":[],"P279":'), one(F.col("p_partkey") % 13), F.lit("}},"))
    lines = table(spark, d, "part").select(F.explode(F.array(F.lit("["), line, F.lit(""), F.lit("]"))).alias("value"))
    return dumps.entity_claims(lines).withColumn("targets", F.array_join("targets", "|"))


@query("SELECT p_partkey AS page_id, 0::INT AS namespace, p_name || '''s' AS title FROM part WHERE p_partkey % 5 <> 0")
def dump_tuples(spark, d):
    return dumps.pages(dumps.insert_rows(_page_lines(spark, d), "page"))


def _page_lines(spark, d):
    p = F.col("p_partkey")
    row = F.concat(F.lit("("), p.cast("string"), F.lit(","), F.when(p % 5 == 0, "4").otherwise("0"), F.lit(",'"), F.col("p_name"), F.lit("\\'s',NULL)"))
    return table(spark, d, "part").select(F.concat(F.lit("INSERT INTO `page` VALUES "), row, F.lit(";")).alias("value"))


@query(oracle_sql()["dump_tuples"])
def sql_dump_rows(spark, d):
    """The same by a table function in SQL text."""
    tables.register(spark)
    return spark.sql("SELECT p.* FROM {lines}, LATERAL dump_rows(value, 'page_id BIGINT, namespace INT, title STRING') AS p WHERE value LIKE 'INSERT INTO `page` %' AND namespace = 0", lines=_page_lines(spark, d))


@query(f"""WITH {A.NOTES_SQL}, p AS (SELECT note_id, unnest([
  (0, 'link', 'Velm Tor', 0, 20, 'Q' || e, 'wiki/Q' || e || '.md'), (1, 'text', seen, 20, 34 + n, NULL, NULL),
  (2, 'markdown_emphasis', '*', 34 + n, 35 + n, NULL, NULL), (3, 'text', 'x', 35 + n, 36 + n, NULL, NULL),
  (4, 'markdown_emphasis', '*', 36 + n, 37 + n, NULL, NULL), (5, 'text', chr(10), 37 + n, 38 + n, NULL, NULL)]) AS p FROM notes)
SELECT note_id, p[1]::INT AS piece_no, p[2] AS syntax, p[3] AS text, p[4]::INT AS start, p[5]::INT AS "end", p[6] AS eid, p[7] AS path FROM p""")
def note_pieces(spark, d):
    return notes.note_pieces(A.part_notes(spark, d)[0])


@query(oracle_sql()["note_pieces"])
def sql_note_pieces(spark, d):
    """The same by a table function in SQL text."""
    tables.register(spark)
    return spark.sql("SELECT n.note_id, p.* FROM {notes} AS n, LATERAL markdown_pieces(n.text, 'wiki') AS p", notes=A.part_notes(spark, d)[0])


_SYNTAX = ", ".join(f"({i}, '{s}', '{a}', '{b}', '{c}')" for i, (s, a, b, c) in enumerate(A.SYNTAX_NOTES)).replace("\n", "' || chr(10) || '")


@query(f"""WITH t AS (SELECT * FROM (VALUES {_SYNTAX}) AS t(case_no, syntax, ahead, body, behind))
SELECT p_partkey AS note_id, case_no::INT AS case_no, syntax, replace(body, 'NAME', p_name) AS text, length(replace(ahead, 'NAME', p_name))::INT AS start,
(length(replace(ahead, 'NAME', p_name)) + length(replace(body, 'NAME', p_name)))::INT AS "end" FROM part, t""")
def note_syntax_pieces(spark, d):
    """Each rule of Markdown that matches must not cross, in a note of its own: what it takes, and where."""
    found = notes.note_pieces(A.syntax_notes(spark, d))
    shown = found.filter(~F.col("syntax").isin("text", "link"))
    return shown.select(F.floor(F.col("note_id") / 100).alias("note_id"), (F.col("note_id") % 100).cast("int").alias("case_no"), "syntax", "text", "start", "end")


@query(f"WITH {A.MATCHES_SQL} SELECT note_id, start::BIGINT AS start, \"end\"::BIGINT AS \"end\", surface_id, surface FROM matches")
def chunked_scan(spark, d):
    """Documents that arrive as a stream of chunks, matched across the chunks."""
    return _chunked(spark, d, "overlapping")


def _chunked(spark, d, kind):
    found = chunks.scan_files(A.chunk_files(spark, d), A.dictionary_words(spark, d), shared_path(spark, "chunk-matches"), kind)
    return found.select("note_id", "start", "end", "surface_id", "surface")


@query(A.greedy_sql('start, "end" DESC, surface_id').replace("SELECT note_id, start, \"end\", surface_id, surface FROM step", "SELECT note_id, start::BIGINT AS start, \"end\"::BIGINT AS \"end\", surface_id, surface FROM step"))
def chunked_leftmost_longest(spark, d):
    """A match kind that carries state from chunk to chunk."""
    return _chunked(spark, d, "leftmost_longest")


@query("WITH mixed AS (SELECT doc_id, '😀 北京é ' || replace(text, 'e ', 'é 😀北 ') AS text FROM documents), " + A.MATCHES_SQL.replace("FROM documents", "FROM mixed") + """, prefixes AS (
  SELECT m.*, substring(text, 1, start) AS a, substring(text, 1, "end") AS b FROM matches AS m JOIN mixed ON doc_id = note_id
) SELECT note_id, start, "end", surface_id, surface, strlen(a)::BIGINT AS start_byte, strlen(b)::BIGINT AS end_byte,
         (length(a) + length(regexp_replace(a, '[^😀]', '', 'g')))::BIGINT AS start_utf16, (length(b) + length(regexp_replace(b, '[^😀]', '', 'g')))::BIGINT AS end_utf16 FROM prefixes""")
def match_positions(spark, d):
    """Matches of documents with emoji and Han in code points, bytes and UTF-16 units."""
    mixed = table(spark, d, "documents").select("doc_id", F.concat(F.lit("😀 北京é "), F.replace("text", F.lit("e "), F.lit("é 😀北 "))).alias("text"))
    return matching.match_dictionary(mixed, A.dictionary_words(spark, d), "doc_id", "text", units=True)


def _note_groups(spark, d):
    rows, candidates = A.part_notes(spark, d)
    return rows, notes.note_groups(rows, A.NOTE_WORDS, candidates)


@query(f"""WITH {A.NOTES_SQL} SELECT note_id, 0::INT AS segment_no, 2::INT AS cluster_no, 'Ask' AS text, 'Q5' AS eid, 0::INT AS surface_id,
(30 + n)::INT AS source_start, (33 + n)::INT AS source_end, false AS suspect, false AS resolved FROM notes""")
def note_mentions(spark, d):
    return notes.mentions_of(_note_groups(spark, d)[1])


@query(f"""WITH {A.NOTES_SQL} SELECT note_id, 'Velm Tor' AS text, 0::INT AS source_start, 20::INT AS source_end, '' AS left_context, right_context,
sha256('{{"version":"mention-conflict-v1","leftContext":"","text":"Velm Tor","rightContext":"' || right_context
|| '","matches":[{{"text":"Velm Tor","surfaceId":2,"eids":["Q2","Q3"]}},{{"text":"Tor","surfaceId":1,"eids":["Q4"]}}]}}') AS hash FROM around""")
def note_conflicts(spark, d):
    return notes.conflicts_of(_note_groups(spark, d)[1]).select("note_id", "text", "source_start", "source_end", "left_context", "right_context", "hash")


@query(f"""WITH {A.NOTES_SQL} SELECT note_id, CASE WHEN e IN (2, 3) THEN '[[wiki/Q' || e || '|Velm Tor]]' WHEN e = 4 THEN '[[wiki/Q4|Tor]]' ELSE 'Velm Tor' END
|| ' met ' || name || ' and [[wiki/Q5|Ask]] *x*' || chr(10) AS text, true AS changed FROM notes""")
def note_rewriting(spark, d):
    rows, groups = _note_groups(spark, d)
    wanted = notes.replacements(notes.mentions_of(groups), notes.conflict_matches_of(notes.conflicts_of(groups)))
    return notes.render_notes(rows, wanted)


@query(f"""WITH {A.NOTES_SQL} SELECT note_id, CASE note_id % 3 WHEN 0 THEN '[[wiki/Q5|Ask]] ' || name || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '[[wiki/Q5|Ask]]'
WHEN 1 THEN '[[wiki/Q5|Ask]] ' || name ELSE name END AS text, note_id % 3 <> 2 AS changed, (CASE note_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END)::INT AS passes FROM notes""")
def settled_notes(spark, d):
    """Repeated passes: an old link that gives way to `---` makes a section of its own, so that a third pass has something to do."""
    old = F.concat(F.lit("Ask "), "p_name", F.lit("\n\n[[wiki/Q7|---]]\n\nAsk"))
    text = F.when(F.col("p_partkey") % 3 == 0, old).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Ask "), "p_name")).otherwise(F.col("p_name"))
    made = table(spark, d, "part").select(F.col("p_partkey").alias("note_id"), text.alias("text"))
    return passes.settle(made, A.NOTE_WORDS, A.part_notes(spark, d)[1]).texts


def _document_groups(spark, d, *kinds, contexts=True):
    rows, candidates = A.document_notes(spark, d)
    return rows, notes.note_groups(rows, A.dictionary_words(spark, d), candidates, kinds=kinds, contexts=contexts)


# Over whole documents as notes; Markdown is beyond SQL, so tests hold these against brute force.
@query()
def document_mentions(spark, d):
    return notes.mentions_of(_document_groups(spark, d, "mention")[1])


@query()
def document_conflicts(spark, d):
    found = notes.conflicts_of(_document_groups(spark, d, "conflict")[1])
    return found.select("note_id", "segment_no", "cluster_no", "text", "source_start", "source_end", "left_context", "right_context", "hash", F.array_join("hits.surface", "|").alias("surfaces"))


@query()
def document_rewriting(spark, d):
    rows, groups = _document_groups(spark, d, *notes.KINDS, contexts=False)
    return notes.render_notes(rows, notes.linked(groups))
