"""The library's inputs, made from the test tables; the same definitions in SQL stand beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import matching, surfaces
from lexweave.session import spread, table
from lexweave.staging import shared_path


def part_pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, their properties, and redirects."""
    part = table(spark, d, "part")
    wiki = F.when(F.col("p_partkey") % 2 == 0, "zh").otherwise("en")
    pages = part.select(wiki.alias("wiki"), F.col("p_partkey").alias("page_id"), F.when(F.col("p_partkey") % 11 == 0, 4).otherwise(0).alias("namespace"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("title"))
    props = part.select(F.col("p_partkey").alias("page_id"), F.when(F.col("p_partkey") % 7 != 0, "wikibase_item").otherwise("other").alias("propname"), F.concat(F.lit("Q"), F.col("p_partkey") % 97 + 1).alias("value"), F.col("p_partkey").alias("seq"))
    target = part.select((F.col("p_partkey") - 1).alias("k"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("target_title"))
    redirects = part.filter(F.col("p_partkey") % 3 == 0).withColumn("k", F.floor(F.col("p_partkey") / 3)).join(target, "k").select(wiki.alias("wiki"), F.col("p_partkey").alias("source_page_id"), F.lit(0).alias("namespace"), "target_title")
    return surfaces.attach_qids(pages, props), props, redirects


def sources(spark: SparkSession, d: str) -> DataFrame:
    pages, _, redirects = part_pages(spark, d)
    return surfaces.surface_sources(pages, redirects)


SOURCES_SQL = """
pages AS (
  SELECT CASE WHEN p_partkey % 2 = 0 THEN 'zh' ELSE 'en' END AS wiki, p_partkey AS page_id, replace(p_name, ' ', '_') AS title,
         CASE WHEN p_partkey % 7 <> 0 THEN 'Q' || (p_partkey % 97 + 1) END AS qid
  FROM part WHERE p_partkey % 11 <> 0
), redirects AS (
  SELECT CASE WHEN a.p_partkey % 2 = 0 THEN 'zh' ELSE 'en' END AS wiki, a.p_partkey AS source_page_id, replace(b.p_name, ' ', '_') AS target_title
  FROM part a JOIN part b ON b.p_partkey = a.p_partkey // 3 + 1 WHERE a.p_partkey % 3 = 0
), target AS (
  SELECT wiki, title, min(page_id) AS page_id FROM pages GROUP BY wiki, title
), sources AS (
  SELECT wiki, replace(title, '_', ' ') AS surface_key, replace(title, '_', ' ') AS surface_text, qid, 'page_title' AS source, page_id, page_id AS target_page_id
  FROM pages WHERE qid IS NOT NULL
  UNION ALL
  SELECT r.wiki, replace(p.title, '_', ' '), replace(p.title, '_', ' '), q.qid, 'redirect', r.source_page_id, t.page_id
  FROM redirects r JOIN pages p ON p.wiki = r.wiki AND p.page_id = r.source_page_id
  JOIN target t ON t.wiki = r.wiki AND t.title = r.target_title JOIN pages q ON q.wiki = t.wiki AND q.page_id = t.page_id
  WHERE q.qid IS NOT NULL
), lists AS (
  SELECT surface_key, list_sort(list(DISTINCT qid)) AS qids FROM sources GROUP BY surface_key
)"""


def claims(spark: SparkSession, d: str) -> DataFrame:
    q = lambda n: F.concat(F.lit("Q"), n.cast("string"))
    k = F.col("p_partkey")
    return table(spark, d, "part").select(q(k).alias("qid"), F.array_compact(F.array(q(k % 13 + 1), q(F.col("p_size") + 1000), F.when(k % 50 == 0, "Q4167410"), F.when(k % 9 == 0, "bad"))).alias("targets"))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    part = table(spark, d, "part").filter("p_partkey > 0")
    return part.select(k.alias("source"), F.floor(k / 2).alias("target")).unionByName(part.select(k.alias("source"), ((k * 7) % 1999 + 1).alias("target")))


EDGES_SQL = """
edges AS (
  SELECT p_partkey AS source, p_partkey // 2 AS target FROM part WHERE p_partkey > 0
  UNION ALL SELECT p_partkey, (p_partkey * 7) % 1999 + 1 FROM part WHERE p_partkey > 0
), reach AS (
  SELECT a AS anchor_id, a + 1 AS node, 0 AS distance FROM range(0, 3) t(a)
  UNION
  SELECT r.anchor_id, e.source, r.distance + 1 FROM reach r JOIN edges e ON e.target = r.node WHERE r.distance < 6
), best AS (
  SELECT anchor_id, node, min(distance) AS distance FROM reach GROUP BY anchor_id, node
)"""


def policy_cards(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    color = lambda a, b: F.struct((a % 27).cast("int").alias("anchor_id"), (b % 7).cast("int").alias("distance"))
    colors = F.array_sort(F.array(color(k, k), color(k * 5 + 1, F.floor(k / 7)), color(k * 11 + 2, k % 3)))
    return table(spark, d, "part").select(F.concat(F.lit("Q"), k).alias("qid"), F.when(k % 20 == 0, 1).otherwise(0).alias("flags"), colors.alias("colors"))


POLICY_SQL = """
cards AS (
  SELECT 'Q' || p_partkey AS qid, CASE WHEN p_partkey % 20 = 0 THEN 1 ELSE 0 END AS flags,
         unnest([(p_partkey % 27, p_partkey % 7), ((p_partkey * 5 + 1) % 27, (p_partkey // 7) % 7), ((p_partkey * 11 + 2) % 27, p_partkey % 3 % 7)]) AS c
  FROM part
), scored AS (
  SELECT qid, flags, c[1] AS a, c[2] AS d,
         (CASE c[1] WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 5 WHEN 5 THEN 6 WHEN 6 THEN 5 WHEN 7 THEN 1 WHEN 8 THEN 3 WHEN 9 THEN 6
               WHEN 10 THEN 2 WHEN 11 THEN 1 WHEN 12 THEN 4 WHEN 13 THEN 2 WHEN 14 THEN 5 WHEN 18 THEN -4 WHEN 19 THEN -5 WHEN 20 THEN -4 WHEN 22 THEN -3
               WHEN 23 THEN -3 WHEN 24 THEN -3 WHEN 25 THEN -3 WHEN 26 THEN -3 ELSE 0 END)::DOUBLE
         * (CASE WHEN c[2] = 0 THEN 1.5 WHEN c[2] <= 1 THEN 1.0 WHEN c[2] <= 2 THEN 0.7 WHEN c[2] <= 4 THEN 0.35 ELSE 0.15 END)::DOUBLE AS s
  FROM cards
), folded AS (
  SELECT qid, flags, list(s ORDER BY a, d) AS s, bool_or(a IN (15, 16, 17, 21) AND d <= 2) AS veto FROM scored GROUP BY qid, flags
), report AS (
  SELECT qid, flags = 0 AND NOT veto AND (0.0::DOUBLE + s[1]) + s[2] + s[3] > 0 AS report FROM folded
)"""


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    """surface_id and pattern: the distinct words of four letters and more in `benchmark`, in order."""
    words = table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-zà-ÿ]+")).alias("pattern")).filter(F.length("pattern") >= 4).distinct()
    return surfaces.dense_ids(words, "pattern", "surface_id", 4)


def dictionary_words(spark: SparkSession, d: str) -> list[str]:
    return matching.collect_patterns(dictionary(spark, d))


MATCHES_SQL = """
words AS (
  SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-zà-ÿ]+')) AS pattern FROM benchmark
), dict AS (
  SELECT pattern, (row_number() OVER (ORDER BY pattern) - 1)::INT AS surface_id, length(pattern) AS n FROM words WHERE length(pattern) >= 4
), token AS (
  SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS k FROM documents
), placed AS (
  SELECT doc_id, w, coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS base FROM token
), lengths AS (
  SELECT DISTINCT n FROM dict
), cut AS (
  SELECT doc_id, base, base + i - 1 AS start, n, substring(w, i, n) AS s
  FROM (SELECT doc_id, w, base, unnest(range(1, length(w) + 1))::INT AS i FROM placed WHERE length(w) >= 4), lengths WHERE i + n - 1 <= length(w)
), matches AS (
  SELECT doc_id AS note_id, start::INT AS start, (start + c.n)::INT AS "end", surface_id, pattern AS surface FROM cut c JOIN dict ON dict.pattern = c.s
)"""


def greedy_sql(order: str) -> str:
    """Of the matches in each blank-separated token (none crosses one) the first in `order`, then the first that begins at its end or later, and so on."""
    based = MATCHES_SQL.replace("SELECT doc_id AS note_id, start", "SELECT doc_id AS note_id, base, start")
    return f"""WITH RECURSIVE {based}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY note_id, base ORDER BY {order}) AS r FROM matches
), step AS (
  SELECT * FROM ranked WHERE r = 1
  UNION ALL
  SELECT * FROM (SELECT ranked.* FROM step JOIN ranked ON ranked.note_id = step.note_id AND ranked.base = step.base AND ranked.start >= step."end" AND ranked.r > step.r
                 QUALIFY row_number() OVER (PARTITION BY ranked.note_id, ranked.base ORDER BY ranked.r) = 1) AS t
) SELECT note_id, start, "end", surface_id, surface FROM step"""


def intervals(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    start = (F.col("l_partkey") % 40).cast("int")
    return li.select(F.col("l_orderkey").alias("note_id"), start.alias("start"), (start + 1 + F.col("l_linenumber") * 2).cast("int").alias("end"), F.col("l_linenumber").alias("surface_id"), (F.col("l_suppkey") % 2 + 1).cast("int").alias("n_qids"))


INTERVALS_SQL = """
iv AS (
  SELECT l_orderkey AS note_id, (l_partkey % 40)::INT AS start, (l_partkey % 40 + 1 + l_linenumber * 2)::INT AS "end", l_linenumber AS surface_id, (l_suppkey % 2 + 1)::INT AS n_qids FROM lineitem
), flagged AS (
  SELECT *, CASE WHEN coalesce(start >= max("end") OVER (PARTITION BY note_id ORDER BY start, "end", surface_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN 1 ELSE 0 END AS f FROM iv
), clustered AS (
  SELECT note_id, start, "end", surface_id, n_qids, (sum(f) OVER (PARTITION BY note_id ORDER BY start, "end", surface_id ROWS UNBOUNDED PRECEDING))::INT AS cluster_no FROM flagged
)"""


def store(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, mentions and conflict matches of a note store."""
    entities = table(spark, d, "supplier").select(F.concat(F.lit("Q"), "s_suppkey").alias("eid"))
    li = table(spark, d, "lineitem")
    mentions = li.select(F.col("l_orderkey").alias("note_id"), F.concat(F.lit("Q"), "l_suppkey").alias("eid"), (F.col("l_returnflag") == "R").alias("suspect"), (F.col("l_linestatus") == "F").alias("resolved"), (F.col("l_partkey") % 10 - 1).cast("int").alias("start"), F.col("l_linenumber").cast("int").alias("end"))
    won = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("Q"), F.col("o_custkey") % 120)).alias("resolved_eid"))
    return entities, mentions, won


NOTE_WORDS = ["Ask", "Tor", "Velm Tor"]


def part_notes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Notes with an old link, and the candidates of NOTE_WORDS."""
    old = F.concat(F.lit("[[wiki/Q"), (F.col("p_partkey") % 5 + 1).cast("string"), F.lit("|Velm Tor]] met "))
    part = spread(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")
    notes = part.select(F.col("p_partkey").alias("note_id"), F.concat(old, "p_name", F.lit(" and Ask *x*\n")).alias("text"))
    return notes, spark.createDataFrame([(0, ["Q5"]), (1, ["Q4"]), (2, ["Q2", "Q3"])], "surface_id int, eids array<string>")


NOTES_SQL = """
notes AS (
  SELECT p_partkey AS note_id, p_partkey % 5 + 1 AS e, p_name AS name, length(p_name) AS n, ' met ' || p_name || ' and Ask ' AS seen FROM part
), around AS (
  SELECT *, CASE WHEN substring(seen, 30, 1) = ' ' THEN seen[:31] ELSE seen[:30] END AS right_context FROM notes
)"""


def document_notes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every document as a Markdown note with front matter and an old link in a quote, and the candidates of `dictionary`."""
    lead = F.regexp_extract(F.lower("text"), "[a-zà-ÿ]{4,}", 0)
    head = F.format_string("---\nlang: %s\n---\n> kept as it is\n\n[[wiki/Q%d|%s]] in **short**:\n\n", F.coalesce("lang", F.lit("")), F.col("doc_id") % 50 + 1, lead)
    documents = spread(table(spark, d, "documents").select("doc_id", "text", "lang"), "doc_id")
    notes = documents.select(F.col("doc_id").alias("note_id"), F.concat(head, "text", F.lit("\n\n***\n`code` of "), lead).alias("text"))
    eid = lambda n: F.concat(F.lit("Q"), (n % 50 + 1).cast("string"))
    other = F.when(F.col("surface_id") % 4 == 0, F.array(eid(F.col("surface_id") + 7))).otherwise(F.array().cast("array<string>"))
    return notes, dictionary(spark, d).select(F.col("surface_id").cast("int").alias("surface_id"), F.concat(F.array(eid(F.col("surface_id"))), other).alias("eids"))


# (syntax, text before, the piece, text behind); NAME stands for a part's name.
SYNTAX_NOTES = [
    ("frontmatter", "", "---\ntitle: NAME\n---\n", "text"),
    ("blockquote", "one\n", "> NAME\n> more\n", "two"),
    ("markdown_table", "", "| a | b |\n| --- | --- |\n| NAME | x |\n", "\nend"),
    ("thematic_break", "NAME\n\n", "---\n", "x"),
    ("fenced_code", "NAME\n", "```\nNAME\n```\n", "x"),
    ("html_comment", "a ", "<!-- NAME -->", " b"),
    ("html", "a ", "<b>NAME</b>", " b"),
    ("wikilink", "a ", "[[other/NAME|x]]", " b"),
    ("markdown_link", "a ", "[NAME](http://x.y)", " b"),
    ("markdown_image", "a ", "![NAME](pic.png)", " b"),
    ("footnote_def", "a\n", "[^1]: ", "NAME"),
    ("footnote_ref", "NAME", "[^n1]", " b"),
    ("inline_code", "a ", "`NAME`", " b"),
    ("obsidian_tag", "NAME ", "#tag", " b"),
    ("markdown_emphasis", "NAME ", "**", " b"),
]


def syntax_notes(spark: SparkSession, d: str) -> DataFrame:
    """(note_id, text): a note for each part and rule; its id is 100 times the part's and the rule's number."""
    cases = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a + b + c).alias("text")) for i, (_, a, b, c) in enumerate(SYNTAX_NOTES)])).alias("c")
    made = spread(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey").select("p_partkey", "p_name", cases)
    return made.select((F.col("p_partkey") * 100 + F.col("c.i")).alias("note_id"), F.replace("c.text", F.lit("NAME"), F.col("p_name")).alias("text"))


def chunk_files(spark: SparkSession, d: str, size: int = 700) -> str:
    """A folder of (note_id, chunk_no, text, last): every document in chunks of `size` characters."""
    n = F.greatest(F.ceil(F.length("text") / size), F.lit(1))
    cut = table(spark, d, "documents").select(F.col("doc_id").alias("note_id"), "text", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("chunk_no")).withColumn("last", F.col("chunk_no") == F.greatest(F.ceil(F.length("text") / size), F.lit(1)) - 1)
    path = shared_path(spark, "chunks")
    cut.select("note_id", "chunk_no", F.substr("text", (F.col("chunk_no") * size + 1).cast("int"), F.lit(size)).alias("text"), "last").write.parquet(path)
    return path
