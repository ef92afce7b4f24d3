"""Stages as commands: download-plan, preprocess, postprocess, match and sync."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import qid_number, split_csv
from lexweave.operators import matching, policy, statistics, surfaces, syncing
from lexweave.session import get_spark
from lexweave.sources import dumps, publish, tsv, vault
from lexweave.staging import stage


def preprocess(spark: SparkSession, root: str, wikis: list[str], date: str, out: str, limit: int | None = None) -> None:
    """Dumps to the three TSV tables, with a manifest of their counts.

    Dumps and claims are read once: what the manifest says of them is observed while they are staged.
    """
    watched = statistics.Watch()
    by_wiki = lambda rows, wiki: watched(rows, f"pages of {wiki}", "page_id", with_qid=F.count("qid"))
    pages, redirects = dumps.wiki_tables(spark, root, wikis, date, limit, by_wiki)
    pages = stage(pages, "pages")
    each = {f"{name} {w}": F.count_if((F.col("wiki") == w) & some) for w in wikis for name, some in (("redirects", F.col("source") == "redirect"), ("sources", F.lit(True)))}
    sources = stage(watched(surfaces.surface_sources(pages, redirects), "surface sources", None, **each), "sources")
    lists = stage(watched(surfaces.surface_qids(sources), "surfaces", None), "lists")
    names = lists.select(F.explode("qids").alias("name")).select(qid_number(F.col("name")).alias("qid")).distinct()
    claims = dumps.entity_claims(dumps.entity_lines(spark, dumps.entity_dump_path(root, date)))
    claims = watched(claims, "entities", qid_number(F.col("qid")))
    edges = stage(surfaces.type_edges(claims, names), "edges")

    def build(folder: str) -> None:
        tsv.write_lines(tsv.source_lines(sources), f"{folder}/surface_sources", tsv.SOURCES)
        tsv.write_lines(tsv.qid_lines(lists), f"{folder}/surface_qids", tsv.QIDS)
        tsv.write_lines(tsv.edge_lines(edges), f"{folder}/entity_type_edges", tsv.EDGES)
        phases = watched.phases()
        made = phases["surface sources"]
        counts = {w: {"wiki": w, "pages": phases[f"pages of {w}"]["rows"], "with_qid": phases[f"pages of {w}"]["with_qid"], **{name: made.pop(f"{name} {w}") for name in ("redirects", "sources")}} for w in wikis}
        publish.write_manifest(spark, folder, {"stage": "preprocess", "date": date, "wikis": counts, "entities": statistics.scan_statistics(edges, names).first().asDict(), "surfaces": phases["surfaces"]["rows"], "phases": phases})

    publish.publish(spark, out, build)


def postprocess(spark: SparkSession, tables: str, out: str) -> None:
    """TSV tables to candidate lists, entities with flags and cards, and the policy's report, as Parquet."""
    lists, edges = stage(tsv.read_qids(spark, f"{tables}/surface_qids"), "lists"), tsv.read_edges(spark, f"{tables}/entity_type_edges")
    names = lists.select(F.explode("qids").alias("qid")).distinct()
    claims = edges.select(F.concat(F.lit("Q"), "qid").alias("qid"), F.transform("targets", lambda t: F.concat(F.lit("Q"), t)).alias("targets"))

    def build(folder: str) -> None:
        entities = surfaces.dense_ids(surfaces.entity_cards(claims, names, policy.anchors(spark)), "qid", "eid_id")
        entities.withColumn("report", policy.should_report(F.col("flags"), F.col("colors"))).write.parquet(f"{folder}/entities")
        surfaces.dense_ids(lists.select("surface_key", "qids"), "surface_key", "surface_id").write.parquet(f"{folder}/surfaces")
        publish.write_manifest(spark, folder, {"stage": "postprocess", **statistics.runtime_statistics(lists).first().asDict()})

    publish.publish(spark, out, build)


def match(spark: SparkSession, tables: str, notes: str, out: str, entity_dir: str = "wiki", policy_enabled: bool = True, window: int | None = 4096) -> None:
    """Note files to matches with the candidates that the policy leaves."""
    report = spark.read.parquet(f"{tables}/entities").select("qid", "report") if policy_enabled else None
    rows = vault.note_files(spark, notes, entity_dir)
    numbered = surfaces.dense_ids(rows, "path", "note_id")
    found = matching.match_surfaces(numbered, spark.read.parquet(f"{tables}/surfaces"), report, "note_id", "text", window=window)
    publish.publish(spark, out, lambda folder: found.join(numbered.select("note_id", "path"), "note_id").write.parquet(folder))


def sync(spark: SparkSession, tables: str, notes: str, store: str, out: str, entity_dir: str = "wiki", lang: str = "zh", policy_enabled: bool = True) -> None:
    """Note files to rewritten notes and entity notes under `out`, and a new version of the store."""
    report = spark.read.parquet(f"{tables}/entities").select("qid", "report") if policy_enabled else None
    publish.publish(spark, out, lambda folder: syncing.sync_folder(spark, spark.read.parquet(f"{tables}/surfaces"), report, notes, store, folder, entity_dir, lang))


def parser() -> argparse.ArgumentParser:
    own = argparse.ArgumentParser(prog="lexweave")
    stages = own.add_subparsers(dest="stage", required=True)
    for name in ("download-plan", "preprocess"):
        sub = stages.add_parser(name)
        sub.add_argument("--wikis", type=split_csv, required=True)
        sub.add_argument("--date", type=dumps.check_date, default="latest")
        sub.add_argument("--out", required=True)
    stages.choices["download-plan"].add_argument("--components", type=split_csv, default=[*vault.SQL_COMPONENTS, vault.ENTITIES])
    stages.choices["preprocess"].add_argument("--dumps", required=True)
    stages.choices["preprocess"].add_argument("--limit", type=int)
    sub = stages.add_parser("postprocess")
    sub.add_argument("--tables", required=True)
    sub.add_argument("--out", required=True)
    sub = stages.add_parser("match")
    for option in ("--tables", "--notes", "--out"):
        sub.add_argument(option, required=True)
    sub.add_argument("--entity-dir", default="wiki")
    sub.add_argument("--no-policy", action="store_true")
    sub.add_argument("--window", type=int, default=4096)
    sub = stages.add_parser("sync")
    for option in ("--tables", "--notes", "--store", "--out"):
        sub.add_argument(option, required=True)
    sub.add_argument("--entity-dir", default="wiki")
    sub.add_argument("--lang", default="zh")
    sub.add_argument("--no-policy", action="store_true")
    return own


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or get_spark()
    if a.stage == "download-plan":
        vault.download_plan(spark, a.wikis, a.components, a.date, a.out).show(1000, truncate=False)
    elif a.stage == "preprocess":
        preprocess(spark, a.dumps, a.wikis, a.date, a.out, a.limit)
    elif a.stage == "postprocess":
        postprocess(spark, a.tables, a.out)
    elif a.stage == "sync":
        sync(spark, a.tables, a.notes, a.store, a.out, a.entity_dir, a.lang, not a.no_policy)
    else:
        match(spark, a.tables, a.notes, a.out, a.entity_dir, not a.no_policy, a.window)


if __name__ == "__main__":
    main()
