"""Language identification by a byte convolutional network.

Fixed-length byte windows go through filters of several widths, max pooling and a softmax layer. Training is
plain numpy on windows of a bounded sample of labelled documents (`docs_per_lang` documents a language,
fewer where the languages would take more than `most_docs`, and `windows_per_doc` windows each), chosen by hash. With one-hot bytes a filter
of width w is a sum of w table rows, so prediction gathers rows of small tables. Every window of every text
is scored, in bounded batches; a document's probabilities are the mean over its windows, weighted by their
letters.

Defined results: a null text, or one without a letter (Unicode category L), is `und` with score 0. Without any labelled document
every text is `und`. Repeated rows repeat their result. An empty table gives an empty table. Extra columns
are not read; language, source and id are no inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.textmap import map_texts
from lexweave.session import ship
from lexweave.staging import stage

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Case is folded, digits and control characters become blanks.
FOLD = np.array([b + 32 if 65 <= b <= 90 else 32 if b < 33 or 48 <= b <= 57 else b for b in range(256)], np.uint8)
IS_LETTER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])


@dataclass
class ByteNet:
    """Tables by width (width x 256 x filters), their biases, and the softmax layer."""

    langs: list[str]
    tables: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Rectified maxima (n x widths * filters), and where they lie."""
        values, places = [], []
        for w, table, bias in zip(WIDTHS, self.tables, self.bias, strict=True):
            n = WINDOW - w + 1
            total = table[0][windows[:, :n]]
            for k in range(1, w):
                total += table[k][windows[:, k : k + n]]
            places.append(total.argmax(axis=1))
            values.append(np.maximum(np.take_along_axis(total, places[-1][:, None], 1)[:, 0] + bias, 0))
        return np.concatenate(values, 1), places

    def maxima(self, windows: np.ndarray) -> np.ndarray:
        values = []
        for w, table, bias in zip(WIDTHS, self.tables, self.bias, strict=True):
            n = WINDOW - w + 1
            total = np.take(table[0], windows[:, :n], axis=0)
            for k in range(1, w):
                total += np.take(table[k], windows[:, k : k + n], axis=0)
            values.append(np.maximum(total.max(axis=1) + bias, 0))
        return np.concatenate(values, 1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        scores = self.maxima(windows) @ self.out + self.out_bias
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)


def train(langs: list[str], windows: np.ndarray, labels: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.003, seed: int = 3) -> ByteNet:
    """Fit by Adam on cross-entropy; the gradient of max pooling goes to the byte rows at the maxima."""
    rng = np.random.default_rng(seed)
    small = lambda *shape: (0.1 * rng.standard_normal(shape)).astype(np.float32)
    zero = lambda n: np.zeros(n, np.float32)
    net = ByteNet(langs, [small(w, 256, FILTERS) for w in WIDTHS], [zero(FILTERS) for _ in WIDTHS], small(len(WIDTHS) * FILTERS, len(langs)), zero(len(langs)))
    params = [*net.tables, *net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // batch)):
            x, y = windows[at], labels[at]
            hidden, places = net.pooled(x)
            scores = hidden @ net.out + net.out_bias
            p = np.exp(scores - scores.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ net.out.T) * (hidden > 0)
            grads = []
            for i, (w, place) in enumerate(zip(WIDTHS, places, strict=True)):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                rows = np.zeros((w, 256, FILTERS), np.float32)
                for k in range(w):
                    np.add.at(rows[k], (x[np.arange(len(x))[:, None], place + k], np.arange(FILTERS)[None]), g)
                grads.append(rows)
            grads += [back[:, i * FILTERS : (i + 1) * FILTERS].sum(0) for i in range(len(WIDTHS))]
            grads += [hidden.T @ p, p.sum(0)]
            step += 1
            for param, grad, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def cut_windows(text: str) -> np.ndarray:
    """The whole text as folded byte windows, the last one filled up with blanks."""
    raw = np.frombuffer(text.encode(), np.uint8)
    padded = np.full(-(-max(len(raw), 1) // WINDOW) * WINDOW, 32, np.uint8)
    padded[: len(raw)] = FOLD[raw]
    return padded.reshape(-1, WINDOW)


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_lang: int = 400, windows_per_doc: int = 8, most_docs: int = 50_000, seed: int = 9) -> ByteNet | None:
    """A net trained on a bounded, hash-chosen sample of the labelled documents that aren't held out."""
    ship(docs.sparkSession)
    usable = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~F.coalesce(held_out(id_col), F.lit(False))).select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = stage(usable.groupBy("lang").count(), "languages")
    langs = [r["lang"] for r in counts.orderBy("lang").select("lang").collect()]  # the classes of the net, one row each
    if not langs:
        return None
    per_lang = max(1, min(docs_per_lang, most_docs // len(langs)))
    draw = F.pmod(F.xxhash64("id", F.xxhash64("text"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    drawn = usable.join(counts, "lang").filter(draw < per_lang / F.col("count")).select("text", "lang")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t, name in zip(batch["text"], batch["lang"], strict=True):
                cut = cut_windows(t)
                cut = cut[IS_LETTER[cut].sum(axis=1) >= min(16, WINDOW // 2)] if len(cut) > 1 else cut
                cut = cut[:: -(-len(cut) // windows_per_doc)] if len(cut) else cut
                yield pd.DataFrame({"w": [bytes(w) for w in cut], "lang": name})

    # repeated rows fall together, so a language has per_lang * windows_per_doc windows on average, and twice that at most in all
    rows = drawn.mapInPandas(windows, "w binary, lang string").distinct().orderBy(F.xxhash64("w"), "lang", "w").limit(2 * per_lang * windows_per_doc * len(langs))
    rows = sorted((r["lang"], bytes(r["w"])) for r in rows.collect())
    if not rows:
        return None
    number = {name: i for i, name in enumerate(langs)}
    return train(langs, np.stack([np.frombuffer(w, np.uint8) for _, w in rows]), np.array([number[name] for name, _ in rows]))


def predict(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text: str = "text", windows_at_once: int = 1024) -> DataFrame:
    """doc_id, held_out, lang_pred and score a document."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batch: pd.Series) -> pd.DataFrame:
        net = shared.value
        langs, scores = ["und"] * len(batch), [0.0] * len(batch)
        pending, size = [], 0

        def score() -> None:
            cuts = [cut for _, cut in pending]
            flat = np.concatenate(cuts)
            probs = np.concatenate([net.probabilities(flat[at : at + windows_at_once]) for at in range(0, len(flat), windows_at_once)])
            weight = IS_LETTER[flat].sum(axis=1) + 1e-3
            starts = np.cumsum([0, *map(len, cuts[:-1])])
            total = np.add.reduceat(probs * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
            for (i, _), p in zip(pending, total, strict=True):
                langs[i], scores[i] = net.langs[int(p.argmax())], float(min(1.0, p.max()))

        for i, t in enumerate(batch.array):
            if net is None or not t or not any(map(str.isalpha, t)):
                continue
            pending.append((i, cut_windows(t)))
            size += len(pending[-1][1])
            if size >= 16 * windows_at_once:
                score()
                pending, size = [], 0
        if pending:
            score()
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return map_texts(docs, id_col, text, run, "lang_pred string, score double", {"held_out": F.coalesce(held_out(id_col), F.lit(False))})
