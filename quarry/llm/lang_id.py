"""Language ID by a bidirectional gated recurrent network over bytes, trained here by backpropagation through time.

The network reads runs of letter bytes (ASCII letters, lower-cased, and all bytes from 0x80), of at most PIECE
bytes each, in both directions, and gives every byte position a probability for each language. A document's
prediction pools all positions of its whole text: the language with the largest sum of log probabilities; its
score is the mean probability of that language over the positions. Runs are read independently, so equal runs
are labelled once and counted as often as they occur.

Training uses a sample of at most about DOCS_A_LANG documents a language (chosen by a hash of the id) and
WORDS_A_DOC runs of each, spread over the whole text; prediction covers every row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, small_batches

PIECE = 32
HIDDEN = 16
DOCS_A_LANG = 300
WORDS_A_DOC = 120
EPOCHS = 3
BATCH = 512
RATE = 0.01
MEMO_PIECES = 400_000
BATCH_BYTES = 1 << 21
UNKNOWN = "und"

# ASCII letters to lower case, other ASCII to a space, the rest as it is.
TO_RUNS = bytes(c if c >= 128 else (c | 32) if chr(c).isalpha() else 32 for c in range(256))


def runs(text: str) -> list[bytes]:
    """Letter runs of a text in pieces of at most PIECE bytes; together they hold every letter byte."""
    found = text.encode("utf-8", "replace").translate(TO_RUNS).split()
    if max(map(len, found), default=0) <= PIECE:
        return found
    return [w[i:i + PIECE] for w in found for i in range(0, len(w), PIECE)]


def has_letter(text: str, pieces: list[bytes]) -> bool:
    return any(p[0] < 128 or p[-1] < 128 for p in pieces) or any(map(str.isalpha, text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


@dataclass
class Network:
    """Weights: for each direction an input table (256, 3H) and recurrences (H, 3H); an output layer (2H, C)."""

    langs: list[str]
    w: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, langs: list[str], seed: int = 0) -> Network:
        rng, h = np.random.default_rng(seed), HIDDEN
        w = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * h))
            w[f"u{d}"] = rng.normal(0, h ** -0.5, (h, 3 * h))
        w["o"], w["c"] = rng.normal(0, 0.3, (2 * h, len(langs))), np.zeros(len(langs))
        return cls(langs, {k: v.astype(np.float32) for k, v in w.items()})

    def _direction(self, d: str, x: np.ndarray, keep: bool):
        """States (T, n, H) over columns of x (n, T); with keep, what the way back needs."""
        h = HIDDEN
        table, u = self.w[f"x{d}"], self.w[f"u{d}"]
        n, steps = x.shape
        state, states, saved = np.zeros((n, h), u.dtype), np.empty((steps, n, h), u.dtype), []
        for t in range(steps):
            a, b = table[x[:, t]], state @ u
            gates = _sigmoid(a[:, :2 * h] + b[:, :2 * h])
            z, r = gates[:, :h], gates[:, h:]
            cand = np.tanh(a[:, 2 * h:] + r * b[:, 2 * h:])
            new = cand + z * (state - cand)
            if keep:
                saved.append((state, z, r, cand, b[:, 2 * h:]))
            states[t] = state = new
        return states, saved

    def log_probs(self, x: np.ndarray, keep: bool = False):
        """Log probabilities (T, n, C) of every position of byte rows x (n, T)."""
        fwd, sf = self._direction("f", x, keep)
        bwd, sb = self._direction("b", x[:, ::-1], keep)
        both = np.concatenate([fwd, bwd[::-1]], axis=2)
        y = both @ self.w["o"] + self.w["c"]
        y -= y.max(axis=2, keepdims=True)
        y -= np.log(np.exp(y).sum(axis=2, keepdims=True))
        return (y, both, sf, sb) if keep else y

    def _back(self, d: str, x: np.ndarray, grad: np.ndarray, saved: list, out: dict) -> None:
        """Gradients of one direction from grad (T, n, H) of its states."""
        h, u = HIDDEN, self.w[f"u{d}"]
        table, gu = np.zeros_like(self.w[f"x{d}"]), np.zeros_like(u)
        carry = np.zeros_like(grad[0])
        for t in reversed(range(x.shape[1])):
            state, z, r, cand, bn = saved[t]
            g = grad[t] + carry
            dn = g * (1 - z) * (1 - cand * cand)
            dz = g * (state - cand) * z * (1 - z)
            dr = dn * bn * r * (1 - r)
            da = np.concatenate([dz, dr, dn], axis=1)
            db = np.concatenate([dz, dr, dn * r], axis=1)
            gu += state.T @ db
            np.add.at(table, x[:, t], da)
            carry = g * z + db @ u.T
        out[f"x{d}"], out[f"u{d}"] = table, gu

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        y, both, sf, sb = self.log_probs(x, keep=True)
        n, steps = x.shape
        rows = np.arange(n)
        loss = float(-y[:, rows, label].mean())
        dy = np.exp(y)
        dy[:, rows, label] -= 1
        dy /= n * steps
        out = {"o": np.tensordot(both, dy, axes=([0, 1], [0, 1])), "c": dy.sum(axis=(0, 1))}
        g = dy @ self.w["o"].T
        self._back("f", x, g[:, :, :HIDDEN], sf, out)
        self._back("b", x[:, ::-1], g[::-1, :, HIDDEN:], sb, out)
        return loss, out

    def label(self, pieces: list[bytes]) -> np.ndarray:
        """(len(pieces), 2C + 1): sums over positions of log probabilities and of probabilities, and positions."""
        c = len(self.langs)
        out = np.empty((len(pieces), 2 * c + 1), np.float32)
        by_len = defaultdict(list)
        for i, p in enumerate(pieces):
            by_len[len(p)].append(i)
        for n, at in by_len.items():
            for s in range(0, len(at), 4096):
                rows = at[s:s + 4096]
                x = np.frombuffer(b"".join([pieces[i] for i in rows]), np.uint8).reshape(-1, n)
                y = self.log_probs(x)
                out[rows, :c], out[rows, c:2 * c], out[rows, 2 * c] = y.sum(axis=0), np.exp(y).sum(axis=0), n
        return out


def train(words: dict[str, list[bytes]], seed: int = 0) -> Network:
    """Fit the network to runs of each language by Adam; batches hold runs of equal length."""
    langs = sorted(words)
    net, rng = Network.fresh(langs, seed), np.random.default_rng(seed)
    by_len: dict[int, list] = defaultdict(list)
    for i, lang in enumerate(langs):
        for w in words[lang]:
            by_len[len(w)].append((w, i))
    sets = {n: (np.frombuffer(b"".join(w for w, _ in v), np.uint8).reshape(-1, n), np.array([i for _, i in v])) for n, v in by_len.items()}
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.w.items()}
    total, step = EPOCHS * sum(-(-len(y) // BATCH) for _, y in sets.values()), 0
    for _ in range(EPOCHS):
        batches = []
        for n, (_, y) in sets.items():
            order = rng.permutation(len(y))
            batches += [(n, order[s:s + BATCH]) for s in range(0, len(y), BATCH)]
        for b in rng.permutation(len(batches)):
            n, rows = batches[b]
            x, y = sets[n]
            _, g = net.gradients(x[rows], y[rows])
            step += 1
            rate = RATE * (1 - step / (total + 1)) * np.sqrt(len(rows) * n / (BATCH * 6)).clip(0.1, 1)
            for k, d in g.items():
                m[k] += 0.1 * (d - m[k])
                v2[k] += 0.01 * (d * d - v2[k])
                net.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample_words(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, list[bytes]]:
    """Runs of a bounded sample of labelled documents that are not held out."""
    known = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[lang_col]: r["n"] for r in known.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    scale = 1_000_000
    shares = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, -(-scale * min(n, DOCS_A_LANG) // n))])
    share = F.element_at(shares, F.col(lang_col))
    chosen = known.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(scale)) < share)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [runs(t.as_py()) for t in b.column("text")]
            few = [b" ".join(w[::-(-len(w) // WORDS_A_DOC) or 1]) for w in words]
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(few, pa.binary())], ["lang", "words"])

    out: dict[str, list[bytes]] = {lang: [] for lang in sorted(sizes)}
    rows = chosen.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(lean(pick), "lang string, words binary").collect()
    for r in sorted(rows, key=lambda r: (r["lang"], bytes(r["words"]))):
        out[r["lang"]] += bytes(r["words"]).split()
    return out


def predict(spark: SparkSession, docs: DataFrame, net: Network | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with the prediction and its score added, by names that docs must not have."""
    small_batches(spark)
    kept = docs.columns
    shared = spark.sparkContext.broadcast(net)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        c = len(net.langs) if net else 0
        place: dict[bytes, int] = {}
        table = np.zeros((0, 2 * c + 1), np.float32)
        for batch in batches:
            texts = batch.column(text_col)
            pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            waiting, held = [], 0

            def flush():
                nonlocal table
                if len(place) > MEMO_PIECES:
                    place.clear()
                    table = table[:0]
                new = [p for p in set().union(*[w for _, w in waiting]) if p not in place]
                if new:
                    place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
                    table = np.concatenate([table, net.label(new)])
                for i, w in waiting:
                    at = np.fromiter(map(place.__getitem__, w), np.int64, len(w))
                    total = table[at].sum(axis=0, dtype=np.float64)
                    best = int(total[:c].argmax())
                    pred[i], score[i] = net.langs[best], float(min(1.0, total[c + best] / total[2 * c]))
                waiting.clear()

            for i, text in enumerate(texts):
                text = text.as_py()
                w = runs(text) if text and net else []
                if w and has_letter(text, w):
                    waiting.append((i, w))
                    held += len(text)
                    if held > BATCH_BYTES:
                        flush()
                        held = 0
            if waiting:
                flush()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*kept, lang_out, score_out])

    return docs.mapInArrow(lean(run), f"{fields}, `{lang_out}` string, `{score_out}` double")


def lettered(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has a letter, by the test that predict() applies."""
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(text_col)]
            yield b.filter(pa.array([bool(t and (w := runs(t)) and has_letter(t, w)) for t in texts], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def identify(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) for each row of docs.

    Learns from text and non-null lang of rows that are not held out. lang_pred is a learned language, or `und`
    with score 0 if the text is null or has no letter, or if there is nothing to learn from. Repeated rows and
    null ids stay; an empty table gives no rows; other columns are ignored.
    """
    words = sample_words(docs, id_col, text_col, lang_col)
    net = train(words) if any(words.values()) else None
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # The text must not come back from Python: predict on rows, then keep what is asked for.
    return predict(spark, rows, net).select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
