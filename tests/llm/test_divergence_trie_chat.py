"""Source divergence, prefix tries and chat formatting against brute force, and on edge rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexweave.llm import chat, divergence, trie

DOCS = "text string, lang string, source string, p string, item string, rank int, n long"
TURNS = "conv_id long, turn long, role string, text string, depth string, n string, place string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def divergence_by_hand(rows, min_docs, top=50):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))) for text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        spread = Counter(t for _, _, terms in mine for t in set(terms))
        kept = sorted(t for t, n in spread.items() if n >= min_docs)
        counts = {s: Counter(t for _, x, terms in mine if x == s for t in terms if spread[t] >= min_docs) for s in {d[1] for d in mine}}
        total = sum(counts.values(), Counter())
        rate = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for s, c in counts.items():
            pairs = [(-sum(abs(rate(c, t) - rate(o, t)) for t in kept), x) for x, o in counts.items() if x != s]
            terms = [(rate(total, t) - rate(c, t), t) for t in kept if c[t] and rate(c, t) > rate(total, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda f: (f[0], f[1].encode()))
                out += [(lang, s, part, item, -v, k) for k, (v, item) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def test_divergence_equals_brute_force(spark):
    rnd = random.Random(5)
    words = ["Alpha", "beta", "ÉTÉ", "été", "x", "straße", "中文", "w\x00z", "don't", "b2b", "Ω"]
    rows = [(None, None, None), ("", "en", "quiet"), ("Alpha", None, "a"), ("only one", "xx", "a"), ("only one", "xx", "b")]
    rows += [(" ".join(rnd.choices(words[: rnd.randint(3, 11)], k=rnd.randint(0, 12))), rnd.choice(["en", "de", ""]), rnd.choice(["a", "b", "c", "É", None])) for _ in range(300)]
    rows += [rows[-1]] * 40 + [("Alpha beta " * 20000, "en", "a")]
    rows = [r + ("clash", "clash", 1, 2) for r in rows]
    df = spark.createDataFrame(rows, DOCS)
    for min_docs, top in ((30, 50), (1, 3), (10**6, 50)):
        got = sorted(tuple(r) for r in divergence.divergence(df, min_docs=min_docs, top=top).collect())
        assert got == divergence_by_hand(rows, min_docs, top)
    assert divergence.divergence(spark.createDataFrame([], DOCS)).collect() == []


def test_divergence_sends_sums_more_than_once(spark, monkeypatch):
    """Partial sums leave a partition whenever enough are held, and texts are read in slices."""
    batches = spark.createDataFrame([(f"t{i % 7} t{i % 5}", "en", str(i % 2)) for i in range(200)], "text string, lang string, source string").coalesce(1).toArrow().to_batches()
    monkeypatch.setattr(divergence, "ROWS_HELD", 3)
    monkeypatch.setattr(divergence, "BYTES_AT_ONCE", 50)
    found = Counter()
    for part in divergence._count(batches):
        for row in part.to_pylist():
            found[row["lang"], row["source"], row["term"]] += row["n"]
    assert sum(found.values()) == 400 and found["en", "0", "t"] == 200


def chain(c):
    return c - (abs(c) % 5) * (1 if c >= 0 else -1)


def trie_by_hand(rows, rebuilt):
    told = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            told[c].append((turn is not None, turn or 0, key, role, text))
    told = {c: [t[3:] for t in sorted(ts)] for c, ts in told.items()}
    new = dict(told)
    if rebuilt:
        for c, own in told.items():
            h = zlib.crc32(str(c).encode()) % 9
            new[c] = told.get(chain(c), [])[:h] + own[h:]
    members, below = defaultdict(list), defaultdict(list)
    for c, ts in new.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    out, sums = [], {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        sums[node] = own + sum(sums[k][0] for k in below[node]), (not below[node]) + sum(sums[k][1] for k in below[node])
        ends = ",".join(str(c) for c in sorted(members[node]) if len(new[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(below[node]), sums[node][1], sums[node][0], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(df):
    return sorted((tuple(None if x != x else x for x in r) for r in df.collect()), key=str)


def conversations():
    rnd = random.Random(9)
    rows = [(None, 0, "user", "x"), (7, None, None, None), (7, None, "user", "é😀"), (7, 3, "a", ""), (7, 3, "a", ""), (-3, 1, "user", "hi"), (-7, 0, "user", "hi"), (2**63 - 1, 0, "u", "last"), (-(2**63), 0, "u", "first")]
    for c in range(40, 90):
        rows += [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(["a", "b", "long text " * 30])) for t in range(rnd.randint(1, 12))]
    return [r + ("clash", "clash", "clash") for r in rows]


@pytest.mark.parametrize("block", [4096, 3])
def test_trie_equals_brute_force(spark, monkeypatch, block):
    """With blocks of three turns and ids, every running value and list of ends is made of several."""
    monkeypatch.setattr(trie, "BLOCK", block)
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    assert nodes(trie.prefix_trie(df)) == trie_by_hand(rows, False)
    assert nodes(trie.rebuilt_trie(df)) == trie_by_hand(rows, True)


def test_trie_of_a_comb_and_of_many_copies(spark, monkeypatch):
    """Conversations that leave one another step by step make a path tree as high as the trie; a third of all are one conversation."""
    monkeypatch.setattr(trie, "BLOCK", 16)
    rows = [(c, t, "user", "same" if t < c else f"own {c}") for c in range(20) for t in range(c + 1)]
    rows += [(1000 + c, t, "assistant", f"copy {t}") for c in range(60) for t in range(3)]
    df = spark.createDataFrame([r + (None, None, None) for r in rows], TURNS)
    assert nodes(trie.prefix_trie(df)) == trie_by_hand(rows, False)
    assert trie.rebuilt_trie(spark.createDataFrame([], TURNS)).collect() == []


TOLD = ["", "a", "\n", "</s>", "[INST]", "[\\INST]", "[\\\\/INST]", "[/ROLE]", "[", "<", "[TURN]", "[INST", "s>", "\\", "é😀", "$1", "[BODY]x", "<s>", "]"]


def chats_by_hand(rows):
    told = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        told[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode(), role or "", text or ""))
    out = []
    for c, turns in told.items():
        turns = [t[4:] for t in sorted(turns)]
        loss = "".join(text for role, text in turns if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for role, text in turns)
        out.append((c, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def test_chats_read_back_as_they_were(spark):
    rnd = random.Random(4)
    rows = [(None, 0, "user", "no id"), (1, None, None, None), (1, 0, "assistant", None), (1, 0, "assistant", None), (2, 0, "assistant", "long " * 300000)]
    rows += [(c, rnd.choice([None, 0, 1, 2, 3]), rnd.choice(["user", "assistant", "assistant", "system", "tool", "[BODY]", None, "[ROLE]"]), "".join(rnd.choices(TOLD, k=rnd.randint(0, 6)))) for c in range(10, 200) for _ in range(rnd.randint(1, 9))]
    df = spark.createDataFrame([r + ("clash", "clash", "clash") for r in rows], TURNS)
    chats = chat.format_chats(df)
    got = chat.digests(chats).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == chats_by_hand(rows)
    formatted = {r["conv_id"]: r["formatted"] for r in chats.collect()}
    assert {r["conv_id"]: r["formatted_chars"] for r in got} == {c: len(f) for c, f in formatted.items()}
    assert chat.digests(chat.format_chats(spark.createDataFrame([], TURNS))).collect() == []


def test_chat_format_and_mask(spark):
    rows = [(1, 0, "user", "one"), (1, 1, "user", "two [/INST]"), (1, 2, "assistant", "é"), (1, 3, "assistant", "</s>"), (1, 4, "tool", "t")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert got["formatted"] == "<s>[INST]one[TURN]two [\\/INST][/INST][ANS]é[TURN]<\\/s></s>[ROLE]tool[BODY]t[/ROLE]"
    assert [got["formatted"].encode()[s["start"] : s["start"] + s["size"]].decode() for s in got["mask"]] == ["é", "<\\/s>"]


def test_chat_formatting_stays_in_the_jvm(spark, sf):
    plan = chat.digests(chat.format_chats(spark.read.parquet(f"{sf}/conversations.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
