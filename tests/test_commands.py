import gzip
import json

import pytest

from lexweave.__main__ import main
from lexweave.operators import store
from lexweave.sources import dumps, publish, tsv, vault


def test_from_dumps_to_matches(spark, tmp_path):
    """Two pages, a redirect and an entity that the policy rejects, through all commands."""
    root = tmp_path / "dumps"
    tables = {
        "page": r"INSERT INTO `page` VALUES (1,0,'Oak_Hill','',NULL),(2,4,'Talk','',NULL),(3,0,'Rue\'s','',NULL),(4,0,'The_Hill','',NULL);",
        "page_props": "INSERT INTO `page_props` VALUES (1,'wikibase_item','Q70',NULL),(1,'other','x',NULL),(3,'wikibase_item','Q71',NULL);",
        "redirect": "INSERT INTO `redirect` VALUES (4,0,'Oak_Hill'),(2,1,'Oak_Hill');",
    }
    for name, line in tables.items():
        path = root / f"enwiki/20240101/enwiki-20240101-{name}.sql.gz"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(gzip.compress(f"-- made up\n{line}\n".encode()))
    claim = lambda q, kind: json.dumps({"id": q, "claims": {"P31": [{"mainsnak": {"datavalue": {"value": {"id": kind}}}}], "P9": []}})
    entities = root / "wikidatawiki/20240101"
    entities.mkdir(parents=True)
    import bz2

    (entities / "wikidata-20240101-all.json.bz2").write_bytes(bz2.compress(f"[\n{claim('Q70', 'Q5')},\n{claim('Q71', 'Q4167410')}\n]\n".encode()))
    notes = tmp_path / "notes"
    (notes / "wiki").mkdir(parents=True)
    (notes / "a.md").write_text("From Oak Hill to The Hill, by Rue's")
    (notes / "wiki/Q70.md").write_text("Oak Hill")
    out = str(tmp_path / "pre")
    main(["preprocess", "--dumps", str(root), "--wikis", "enwiki", "--date", "20240101", "--out", out], spark)
    manifest = publish.read_manifest(spark, out)
    assert manifest["surfaces"] == 3 and manifest["wikis"]["enwiki"] == {"wiki": "enwiki", "pages": 3, "with_qid": 2, "redirects": 1, "sources": 3}
    assert manifest["entities"]["disambiguations"] == 1 and manifest["entities"]["candidate_hits"] == 2
    assert manifest["phases"] == {"pages of enwiki": {"rows": 3, "last_id": 4, "with_qid": 2}, "surface sources": {"rows": 3}, "surfaces": {"rows": 3}, "entities": {"rows": 2, "last_id": 71}}
    main(["postprocess", "--tables", out, "--out", str(tmp_path / "post")], spark)
    assert {r["qid"]: r["report"] for r in spark.read.parquet(str(tmp_path / "post/entities")).collect()} == {70: True, 71: False}
    main(["match", "--tables", str(tmp_path / "post"), "--notes", str(notes), "--out", str(tmp_path / "matches")], spark)
    got = {(r["path"], r["start"], r["end"], r["surface"], tuple(r["qids"])) for r in spark.read.parquet(str(tmp_path / "matches")).collect()}
    assert got == {("a.md", 5, 13, "Oak Hill", (70,)), ("a.md", 17, 25, "The Hill", (70,))}
    main(["match", "--tables", str(tmp_path / "post"), "--notes", str(notes), "--out", str(tmp_path / "all"), "--no-policy", "--window", "5"], spark)
    assert {(r["surface"], tuple(r["qids"])) for r in spark.read.parquet(str(tmp_path / "all")).collect()} == {(None, (70,)), ("Rue's", (71,))}


def test_tsv_errors_and_legacy_targets(spark, tmp_path):
    lines = lambda *rows: spark.createDataFrame([(r,) for r in rows], "value string")
    got = tsv.parse_edges(lines("Q1\t1\tP31=Q5|Q6\t2", "Q2\t0\t\t0")).collect()
    assert {(r["qid"], r["flags"], tuple(r["targets"])) for r in got} == {(1, 1, (5, 6)), (2, 0, ())}
    for bad in ("Q1\t1\tQ5\t2", "Q1\t1", "X1\t0\t\t0"):
        with pytest.raises(Exception):
            tsv.parse_edges(lines(bad)).collect()
    with pytest.raises(Exception):
        tsv.parse_qids(lines("\tQ1\t1")).collect()
    assert tsv.read_edges(spark, str(tmp_path / "none")).collect() == []
    tsv.write_lines(lines("a\tQ1\t1"), str(tmp_path / "t"), tsv.QIDS)
    assert [tuple(r) for r in tsv.read_qids(spark, str(tmp_path / "t")).collect()] == [("a", [1], 1)]
    with pytest.raises(ValueError):
        tsv.read_lines(spark, str(tmp_path / "t"), tsv.EDGES)


def test_publish_keeps_the_old_on_failure(spark, tmp_path):
    out = str(tmp_path / "out")
    publish.publish(spark, out, lambda f: publish.write_manifest(spark, f, {"n": 1}))

    def broken(folder):
        publish.write_manifest(spark, folder, {"n": 2})
        raise RuntimeError

    with pytest.raises(RuntimeError):
        publish.publish(spark, out, broken)
    assert publish.read_manifest(spark, out) == {"n": 1}


def test_plan_and_store(spark, tmp_path):
    with pytest.raises(ValueError):
        vault.download_plan(spark, [" "], ["page"], "latest", "o")
    with pytest.raises(ValueError):
        dumps.check_date("2024-01-01")
    assert vault.download_plan(spark, [], ["wikidata_entities"], "latest", "o").first()["path"] == "o/wikidatawiki/latest/latest-all.json.bz2"
    store.create_store(spark, str(tmp_path))
    store.create_store(spark, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/model_meta").collect()[0]["value"] == store.SCHEMA_VERSION
    assert all(spark.read.parquet(f"{tmp_path}/{t}").isEmpty() for t in store.TABLES if t != "model_meta")
