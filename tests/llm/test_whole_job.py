"""Cases in which parts of the job were once left out."""

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lexweave.llm import ann, linededup, pii, secretscan


def test_ann_repeated_rows_do_not_take_places(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((40, 8))
    rows = [(i, (x[i] + 1e-6 * c * (c % 2)).tolist()) for i in range(40) for c in range(10)]  # half of them exact copies
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(v, F.col("vec_id") == 0).toPandas().sort_values("rank")
    d = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    d[0] = np.inf
    assert list(got["rank"]) == list(range(1, 11)) and list(got.vec_id) == np.argsort(d)[:10].tolist()


def test_secret_lexer_takes_wide_blanks_types_and_long_sums():
    found = lambda code: [code[a:b] for a, b, _ in secretscan.literal_spans(code)]
    key = "hV7/kQ2x9Lm4Zp1s"
    for code in (f'aws_secret_access_key{" " * 9}= "{key}"', f"client_secret:{' ' * 12}{key}", f'const apiKey: string = "{key}";', f'password: str = "{key}"', f'password: str="{key}"', f'api_key: Optional[Dict[str, str]] = "{key}"', f'let token: string | null = "{key}"', f"const SECRET: &'static str = \"{key}\";", f'var apiKey string = "{key}"'):
        assert found(code) == [key], code
    assert found("token: QWxhZGRpbjpvcGVuU2Vz=\n") == ["QWxhZGRpbjpvcGVuU2Vz="]
    assert found(f"password: {key.replace('/', '')} = x") == [key.replace("/", "")]
    parts = [f"p{i}Xq" for i in range(40)]
    assert found("secret = " + " + ".join(f'"{p}"' for p in parts)) == parts
    assert found('key = ""\n' + "".join(f'key = key + "{p}"\n' for p in parts) + "secret_token = key\n") == parts
    assert found("secret = " + " +\n  ".join(f'"{p}"' for p in parts)) == parts
    assert found("secret = " + "\n  + ".join(f'"{p}"' for p in parts)) == parts
    assert found(f'label = "x"\n+password = "{key}"\n') == [key]
    assert found('password = "hV7/kQ2x" + "9Lm exam" + "ple4Zp1s"') == []  # a placeholder across a seam
    assert len(found('a = "hV7/kQ2x9Lm4Zp1s"\n' + "a = a + a\n" * 20000 + "password = a\n")) == 1


def test_pii_cues_in_ordinary_wording():
    found = lambda text: [(k, text[a:b]) for k, a, b in pii.find_spans(text) if k in pii.MORE_KINDS]
    plain, wide = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    for text, want in (
        (f"IBAN number: {plain}", plain), (f"account no. {plain}", plain), (f"The account of the firm is {wide}.", wide), (f"Iban:\n{plain}", plain), (f"IBAN{plain}", plain),
        (f"IBAN: {wide} BIC: COBADEFF", wide), (f"IBAN {plain} EUR 500", plain), (f"iBaN {wide} Eur", wide), (f"İ IBAN {plain}", plain),
        (f"IBAN of AB12 {wide}", wide), (f"IBAN check DE00370400440532013000, then {plain}", plain),
    ):
        assert found(text) == [("iban", want)], text
    assert found(f"IBAN: {plain}1") == found("account DE88370400440532013000") == found(f"my account\nand {plain} on the next line") == []
    for text in ("Social security number: 078-05-1120", "sOcial Security number of the insured person: 078-05-1120"):
        assert found(text) == [("ssn", "078-05-1120")]
    token = "x" * 300
    assert found(f"see https://user:{token}@host/ and ftp://{token}:p@h") == [("url_user", f"user:{token}"), ("url_user", f"{token}:p")]


def test_ann_recall_counts_ids_not_their_copies(spark):
    """Each of 2,000 ids has ten rows, half exact copies and half moved by 1e-6."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((2000, 16))
    rows = pd.DataFrame([(i, (x[i] + 1e-6 * (c % 2) * rng.standard_normal(16)).tolist()) for i in range(2000) for c in range(10)], columns=["vec_id", "embedding"])
    v = spark.createDataFrame(rows).repartition(4)
    got = ann.nearest(v, F.col("vec_id") % 100 == 0).toPandas()
    d = np.sqrt(((x[:, None, :] - x[None, ::100, :]) ** 2).sum(axis=2))
    d[np.arange(0, 2000, 100), np.arange(20)] = np.inf
    hits = sum(len(set(got[got.query_id == 100 * q].vec_id) & set(np.argsort(d[:, q])[:10].tolist())) for q in range(20))
    assert len(got) == 200 and hits >= 180
    assert abs(ann.recall(v, spark.createDataFrame(got)) - hits / 200) < 0.02


def test_ann_recall_of_wrong_results(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    got = spark.createDataFrame([(0, r, 40 - r, float(40 - r)) for r in range(1, 11)], "query_id long, rank int, vec_id long, score double")
    assert ann.recall(v, got) == 0.0 and ann.recall(v, got.limit(0)) == 1.0


def test_line_dedup_is_linear_in_the_lines_of_a_text(spark):
    """Six equal texts of 200,000 lines; every second line is boilerplate of six sites."""
    lines = [f"line number {i} of a long text" if i % 2 else f"short {i}" for i in range(200_000)]
    docs = spark.createDataFrame([(i, "\n".join(lines), f"site{i}") for i in range(6)], "doc_id long, text string, source string").repartition(4)
    began = time.time()
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    assert time.time() - began < 60
    assert got[0]["text"] == "\n".join(lines) and got[0]["n_removed_lines"] == 0
    for i in range(1, 6):
        assert got[i]["text"] == "\n".join(lines[::2]) and (got[i]["n_lines"], got[i]["n_removed_lines"]) == (200_000, 100_000)


def test_line_dedup_joins_hot_lines_apart(spark):
    """One line is a third of all; the first and the last line of a text, neighbours and whole texts go."""
    hot = "this line is on every site there is"
    rows = [(i, "\n".join([hot, f"own words of document number {i}", hot, hot, "tail"]), f"s{i % 9}") for i in range(300)] + [(900, hot, "s1"), (901, f"{hot}\n", None)]
    got = {r["doc_id"]: (r["text"], r["n_removed_lines"]) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == (f"{hot}\nown words of document number 0\ntail", 2) and got[7] == ("own words of document number 7\ntail", 3)
    assert got[900] == ("", 1) and got[901] == ("", 1)
