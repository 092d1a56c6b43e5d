"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices
from .textbytes import BITS3, BITS5, features, lowered, pieces

ship(__name__)

BUCKETS = (1 << BITS3) + (1 << BITS5)


@dataclass
class Model:
    gain: np.ndarray  # per bucket: its embedding times the difference of the softmax's two rows
    bias: float
    window: int
    floor: float  # the score of a text without words


def sample(docs: DataFrame, labels: DataFrame, per_class: int = 1200, max_chars: int = 8_000) -> list[tuple[int, str]]:
    """A bounded, repeatable sample of labelled texts: of each class the rows whose digest falls under a rate that
    leaves about ``per_class``. Texts over ``max_chars`` don't train. Bound on the driver: 2 x per_class x max_chars code points."""
    truth = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = truth.groupBy("toxic").count()
    digest = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(3)), F.lit(1_000_000))
    picked = truth.join(F.broadcast(n.select("toxic", (F.lit(per_class) / F.col("count")).alias("rate"))), "toxic").where(digest < F.col("rate") * 1_000_000).select("doc_id", "toxic")
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    return [(r.toxic, r.text) for r in texts.join(F.broadcast(picked), "doc_id").select("toxic", "text").orderBy("toxic", "doc_id", "text").collect()]


def windows(batch, window: int):
    """Of pieces: bucket pairs of each letter, each word's first letter, each window's first word, each window's piece."""
    i3, i5, starts, piece, _ = features(batch)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return i3, i5, starts, z, z
    new = np.append(True, piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    place = np.arange(len(piece)) - first[np.cumsum(new) - 1]
    cut_at = np.flatnonzero(place % window == 0)
    return i3, i5, starts, cut_at, piece[cut_at]


def fit(rows: list[tuple[int, str]], dim: int = 4, window: int = 8, min_texts: int = 5, epochs: int = 40, passes: int = 3, rate: float = 2.0, decay: float = 1e-6, seed: int = 5) -> Model:
    """Embeddings and softmax rows together, by gradient descent over word-level counts.

    A word's vector is the mean of its subword vectors, a window's the mean of its words', and the softmax is
    over the window. Labels are of whole texts, so a text trains by the window that scores highest, found anew in each pass
    (the first takes all windows); texts of class 0 train by all their windows.
    """
    if not rows or len({y for y, _ in rows}) < 2 or not any(t and lowered(t).strip() for _, t in rows):
        share = float(np.mean([y for y, _ in rows])) if rows else 0.0
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))), window, share)
    labels = np.array([y for y, _ in rows])
    vocab: dict[bytes, int] = {}
    word_ids, win_starts, win_docs = [], [], []
    at, done = 0, 0
    spell: list[np.ndarray] = []
    for batch in pieces([t for _, t in rows]):
        i3, i5, starts, cut_at, win_piece = windows(batch, window)
        if not len(starts):
            continue
        ends = np.append(starts[1:], len(i3))
        own = np.empty(len(starts), np.int64)
        for k, (x, y) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            key = i5[x:y].tobytes()
            got = vocab.get(key)
            if got is None:
                got = vocab[key] = len(vocab)
                spell.append(np.concatenate([i3[x:y], i5[x:y] + (1 << BITS3)]))
            own[k] = got
        word_ids.append(own)
        win_starts.append(cut_at + at)
        win_docs.append(np.array([r for r, _ in batch])[win_piece])
        at += len(starts)
        done += len(batch)
    words, wins, docs_of = np.concatenate(word_ids), np.concatenate(win_starts), np.concatenate(win_docs)
    win_n = np.diff(np.append(wins, len(words)))
    # subwords of fewer than min_texts texts say little about others: they weigh nothing
    flat = np.concatenate(spell)
    sub_starts = np.concatenate([[0], np.cumsum([len(s) for s in spell])[:-1]])
    sub_n = np.diff(np.append(sub_starts, len(flat)))
    pair = np.unique(words * len(rows) + np.repeat(docs_of, win_n))
    of_word, of_text = pair // len(rows), pair % len(rows)
    n_each = sub_n[of_word]
    at_each = np.repeat(sub_starts[of_word], n_each) + np.arange(n_each.sum()) - np.repeat(np.cumsum(n_each) - n_each, n_each)
    seen = np.unique(flat[at_each] * len(rows) + np.repeat(of_text, n_each)) // len(rows)
    texts_with = np.bincount(seen, minlength=BUCKETS)
    live = texts_with[flat] >= min_texts
    used, compact = np.unique(flat[live], return_inverse=True)
    word_idx = np.repeat(np.arange(len(spell)), sub_n)[live]
    heads = np.flatnonzero(np.append(True, word_idx[1:] != word_idx[:-1])) if len(word_idx) else np.zeros(0, np.int64)
    filled = word_idx[heads]
    if not len(used):
        share = float(labels.mean())
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))), window, share)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.05, (dim, len(used))).astype(np.float32)
    soft = rng.normal(0, 1, dim).astype(np.float32)  # the difference of the two softmax rows
    bias = np.float32(0)
    y = labels[docs_of].astype(np.float32)
    weight = np.ones(len(wins), np.float32)
    order = np.argsort(compact, kind="stable")
    seg = np.flatnonzero(np.append(True, compact[order][1:] != compact[order][:-1]))
    word_of = word_idx[order]
    w_order = np.argsort(words, kind="stable")
    w_seg = np.flatnonzero(np.append(True, words[w_order][1:] != words[w_order][:-1]))
    win_of = np.repeat(np.arange(len(wins)), win_n)[w_order]
    per_sub, per_win = (1 / sub_n).astype(np.float32), (1 / win_n).astype(np.float32)

    def forward():
        wv = np.zeros((dim, len(spell)), np.float32)
        wv[:, filled] = np.add.reduceat(emb[:, compact], heads, axis=1)
        v = np.add.reduceat((wv * per_sub)[:, words], wins, axis=1) * per_win
        return v, soft @ v + bias

    pull_emb, pull_soft, pull_bias = np.zeros_like(emb), np.zeros_like(soft), 0.0
    for turn in range(passes):
        if turn:
            _, z = forward()
            weight[:] = 1
            best: dict[int, int] = {}
            for k in np.flatnonzero(y == 1):
                d = docs_of[k]
                if d not in best or z[k] > z[best[d]]:
                    best[d] = k
            weight[y == 1] = 0
            weight[list(best.values())] = 1
        pos, neg = weight[y == 1].sum(), weight[y == 0].sum()
        balance = weight * np.where(y == 1, 1.0 / pos, 3.0 / neg).astype(np.float32)
        balance /= balance.sum()
        for epoch in range(epochs):
            v, z = forward()
            g = (balance * ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - y)).astype(np.float32)
            g_soft = v @ g + decay * soft
            g_win = soft[:, None] * (g * per_win)
            g_word = np.add.reduceat(g_win[:, win_of], w_seg, axis=1) * per_sub
            g_emb = np.add.reduceat(g_word[:, word_of], seg, axis=1) + decay * emb
            # one step length for all subwords, so what many texts share moves first and chance moves little
            pace = rate * (1 - 0.9 * epoch / epochs)
            pull_emb = 0.8 * pull_emb + g_emb / (np.abs(g_emb).max() + 1e-12)
            pull_soft = 0.8 * pull_soft + g_soft / (np.abs(g_soft).max() + 1e-12)
            pull_bias = 0.8 * pull_bias + float(np.clip(4 * g.sum(), -1, 1))
            emb -= np.float32(pace) * pull_emb
            soft -= np.float32(0.1 * pace) * pull_soft
            bias -= np.float32(pace * pull_bias)
    gain = np.zeros(BUCKETS, np.float32)
    gain[used] = soft @ emb
    return Model(gain, float(bias), window, 0.0)


def train(rows: list[tuple[int, str]], **options) -> Model:
    """Fit on three quarters of the sample, set the threshold on the rest."""
    held = rows[::4]
    model = fit([r for k, r in enumerate(rows) if k % 4], **options)
    calibrate(model, held if {y for y, _ in held} == {0, 1} else rows)
    return model


def raw_scores(m: Model, texts: list) -> np.ndarray:
    """Per text, the highest window's log odds; -inf without words."""
    out = np.full(len(texts), -np.inf)
    g3, g5 = m.gain[: 1 << BITS3], m.gain[1 << BITS3 :]
    for batch in pieces(texts):
        i3, i5, starts, cut_at, piece = windows(batch, m.window)
        if not len(starts):
            continue
        letters = np.diff(np.append(starts, len(i3)))
        per_word = np.add.reduceat(g3[i3] + g5[i5], starts) / (2 * letters)
        z = np.add.reduceat(per_word, cut_at) / np.diff(np.append(cut_at, len(starts))) + m.bias
        np.maximum.at(out, np.array([r for r, _ in batch])[piece], z)
    return out


def calibrate(m: Model, rows: list[tuple[int, str]]) -> None:
    """Shift the bias so that a score of 0.3 is the sample's threshold with the best F1."""
    y = np.array([a for a, _ in rows], np.int64)
    z = raw_scores(m, [t for _, t in rows])
    keep = np.isfinite(z)
    y, z = y[keep], z[keep]
    if not y.any() or y.all():
        return
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    nxt = z[order][k + 1] if k + 1 < len(z) else z[order][k] - 1
    threshold = (z[order][k] + nxt) / 2
    m.bias -= float(threshold) - float(np.log(0.3 / 0.7))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs without text + score (0 to 1, the highest window's) and predicted (1 from 0.3 on).

    Null, empty or letterless text: the floor score, not toxic. Whole texts count, in windows of words; pieces
    of 128 KB bound the memory. Empty table: no rows. Repeated rows each get a score. Clashing columns are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(astuple(model))
    cols = [c for c in docs.columns if c not in ("text", "score", "predicted")]

    def run(batches):
        m = Model(*held.value)
        for b in slices(batches):
            z = raw_scores(m, b.column("text").to_pylist())
            p = np.where(np.isfinite(z), 1 / (1 + np.exp(-np.clip(z, -30, 30))), min(m.floor, 0.29))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(p, pa.float64()), pa.array((p >= 0.3).astype(np.int32))], names=[*cols, "score", "predicted"])

    return docs.select(*cols, "text").mapInArrow(run, docs.select(cols).schema.add("score", "double").add("predicted", "integer"))
