"""Language ID: scripts narrow the candidates, Viterbi over per-word scores labels the spans."""

from __future__ import annotations

from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, slices
from .textbytes import BITS3, BITS5, features, pieces

ship(__name__)

UND = "und"


def _script_table() -> np.ndarray:
    """Script number by a word's first UTF-8 byte, from ranges of lead bytes."""
    t = np.zeros(256, np.int64)  # 0: other
    ranges = [(0x61, 0x7A, 1), (0xC3, 0xC9, 1), (0xCE, 0xCF, 2), (0xD0, 0xD4, 3), (0xD6, 0xD7, 4), (0xD8, 0xDB, 5), (0xE0, 0xE0, 6), (0xE3, 0xE3, 7), (0xE4, 0xE9, 8), (0xEA, 0xED, 9)]
    for lo, hi, n in ranges:  # Latin, Greek, Cyrillic, Hebrew, Arabic, Indic and Thai, kana, Han, Hangul
        t[lo : hi + 1] = n
    return t


SCRIPT = _script_table()
SCRIPTS = 10


@dataclass
class Model:
    langs: list[str]
    w3: np.ndarray  # buckets x langs, centred log likelihoods
    w5: np.ndarray
    allowed: np.ndarray  # scripts x langs
    prior: int  # the commonest language


def sample(docs: DataFrame, per_lang: int = 600, max_chars: int = 20_000, max_langs: int = 400) -> list[tuple[str, str]]:
    """A bounded, repeatable sample of labelled texts: of each language the rows whose digest falls
    under a rate that leaves about ``per_lang`` of them. Texts over ``max_chars`` don't train.
    Bound on the driver: max_langs (the commonest) x per_lang x max_chars code points."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= max_chars))
    n = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs)
    digest = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(7)), F.lit(1_000_000))
    picked = rows.join(F.broadcast(n.select("lang", (F.lit(per_lang) / F.col("count")).alias("rate"))), "lang").where(digest < F.col("rate") * 1_000_000)
    return [(r.lang, r.text) for r in picked.select("lang", "text").orderBy("lang", "doc_id", "text").collect()]


def fit(rows: list[tuple[str, str]], alpha: float = 0.3, langs_of_script: float = 0.01) -> Model:
    langs = sorted({a for a, _ in rows})
    n = len(langs)
    c3, c5 = np.zeros((n, 1 << BITS3)), np.zeros((n, 1 << BITS5))
    scripts = np.zeros((SCRIPTS, n))
    for k, lang in enumerate(langs):
        for batch in pieces([t for a, t in rows if a == lang]):
            i3, i5, _, _, first = features(batch)
            c3[k] += np.bincount(i3, minlength=1 << BITS3)
            c5[k] += np.bincount(i5, minlength=1 << BITS5)
            scripts[:, k] += np.bincount(SCRIPT[first], minlength=SCRIPTS)

    def weights(c: np.ndarray) -> np.ndarray:
        if not n:
            return np.zeros((c.shape[1], 0), np.float32)
        # a bucket nobody saw weighs nothing for any language
        p = np.log((c + alpha) / (c.sum(1, keepdims=True) + alpha * 4096))
        return np.where(c.sum(0) > 0, p - p.mean(0), 0).T.astype(np.float32).copy()

    share = scripts / np.maximum(scripts.sum(0, keepdims=True), 1)
    allowed = share >= langs_of_script
    allowed[~allowed.any(1)] = True  # a script nobody has narrows nothing
    most = max(range(n), key=lambda k: (sum(a == langs[k] for a, _ in rows), -k)) if n else 0
    return Model(langs, weights(c3), weights(c5), allowed, most)


def word_scores(m: Model, batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: scores by language, piece, letters."""
    i3, i5, starts, piece, first = features(batch)
    if not len(starts):
        return np.zeros((0, len(m.langs)), np.float32), piece, starts
    e = np.add.reduceat(m.w3[i3] + m.w5[i5], starts, axis=0) * np.float32(0.5)
    e[~m.allowed[SCRIPT[first]]] -= np.float32(50)
    return e, piece, np.diff(np.append(starts, len(i3)))


def _mixed(e: np.ndarray, penalty: float) -> tuple[int, bool]:
    """The best single language of a text, and whether a path with switches can be better: not, if no
    stretch gains more than one penalty in another language (each such stretch pays one or two)."""
    best = int(e.sum(0).argmax())
    gain = np.cumsum(e - e[:, best : best + 1], axis=0)
    low = np.minimum.accumulate(np.vstack([np.zeros((1, e.shape[1]), gain.dtype), gain[:-1]]), axis=0)
    return best, bool((gain - low).max() > penalty)


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best label paths of several texts at once, step by step over the longest."""
    order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
    if not order:
        return []
    n, steps, langs = len(order), len(scores[order[0]]), scores[0].shape[1]
    lengths = np.array([len(scores[k]) for k in order])
    flat = np.concatenate([scores[k] for k in order])
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")
    d = flat[at].astype(np.float64)
    back = np.zeros((len(flat), langs), np.int8 if langs < 128 else np.int32)
    own = np.arange(langs)
    for t in range(1, steps):
        k = active[t]
        top = d[:k].argmax(1)
        switch = d[np.arange(k), top] - penalty
        stay = d[:k] >= switch[:, None]
        back[at[:k] + t] = np.where(stay, own, top[:, None])
        d[:k] = np.where(stay, d[:k], switch[:, None]) + flat[at[:k] + t]
    out: list = [None] * n
    state = d.argmax(1)
    labels = np.zeros(len(flat), np.int64)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        labels[at[:k] + t] = state[:k]
        state[:k] = back[at[:k] + t, state[:k]] if t else state[:k]
    for j, k in enumerate(order):
        out[k] = labels[at[j] : at[j] + lengths[j]]
    return out


def predict(m: Model, texts: list, penalty: float = 12.0, held: int = 1 << 20) -> list[tuple[str, float, list]]:
    """(language, score, spans) of each text; spans: (first word, end word, language), words as
    stretches of letters. The language has most letters; the score is its share of them times how
    sure its words are, by the margin per word over the next language.

    The scores of mixed texts wait for one Viterbi over several, but at most ``held`` numbers (and one text more)."""
    langs = m.langs
    parts: list[list] = [[] for _ in texts]
    waiting: list[tuple[int, int, np.ndarray]] = []

    def label() -> None:
        for (row, k, _), path in zip(waiting, viterbi([w[2] for w in waiting], penalty), strict=True):
            parts[row][k][3] = path
        waiting.clear()

    size_held = 0
    for batch in pieces(texts, max(1 << 12, (1 << 21) // max(16, len(langs)))):
        e, piece, letters = word_scores(m, batch)
        cuts = np.searchsorted(piece, np.arange(len(batch) + 1))
        for k, (row, _) in enumerate(batch):
            own, size = e[cuts[k] : cuts[k + 1]], letters[cuts[k] : cuts[k + 1]]
            if len(own):
                best, mixed = _mixed(own, penalty) if len(langs) > 1 else (0, False)
                part = [own.sum(0), len(own), size, np.full(len(own), best) if not mixed else None]
                parts[row].append(part)
                if mixed:
                    waiting.append((row, len(parts[row]) - 1, own.copy()))  # not a view that keeps the whole piece
                    size_held += own.size
                    if size_held > held:
                        label()
                        size_held = 0
    label()
    out = []
    for text, own in zip(texts, parts, strict=True):
        if not text or not langs:
            out.append((UND, 0.0, []))
            continue
        if not own:  # letters, if any, without a trained feature
            out.append((langs[m.prior], 0.0, []))
            continue
        weight, path = np.concatenate([p[2] for p in own]), np.concatenate([p[3] for p in own])
        share = np.bincount(path, weights=weight, minlength=len(langs)) / weight.sum()
        best = int(share.argmax())
        total = sum(p[0] for p in own)
        rest = np.delete(total, best)
        margin = float(total[best] - rest.max()) if len(rest) else 10.0
        sure = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) if share[best] > 0.999 else 1.0
        ends = np.flatnonzero(np.append(path[1:] != path[:-1], True)) + 1
        first = np.concatenate([[0], ends[:-1]])
        out.append((langs[best], float(share[best] * sure), [(int(x), int(y), langs[path[x]]) for x, y in zip(first, ends, strict=True)]))
    return out


def detect(docs: DataFrame, model: Model, penalty: float = 12.0, keep_text: bool = False) -> DataFrame:
    """docs + lang_pred, score and spans (array of first word, end word, language).

    Null or letterless text: ``und``, score 0, no spans. Every other text gets a learned language;
    text in no learned script gets the likeliest by score. Empty table: no rows. Columns of docs
    that clash with the new ones are replaced. Texts of any length are read whole, in pieces of
    128 KB (less with many languages) that each start a path of their own; a batch goes in slices of a few rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(astuple(model))
    cols = [c for c in docs.columns if c not in ("lang_pred", "score", "spans")]
    if "text" not in cols:
        raise ValueError("docs has no column text")
    out_cols = [c for c in cols if keep_text or c != "text"]
    schema = docs.select(out_cols).schema
    span = T.StructType().add("first", T.IntegerType()).add("end", T.IntegerType()).add("lang", T.StringType())
    schema = schema.add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("spans", T.ArrayType(span))
    spans_type = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        m = Model(*held.value)
        for b in slices(batches):
            text = b.column("text")
            has = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_pylist()
            got = predict(m, [t if ok else None for t, ok in zip(text.to_pylist(), has, strict=True)], penalty)
            arrays = [b.column(c) for c in out_cols]
            arrays.append(pa.array([g[0] for g in got], pa.string()))
            arrays.append(pa.array([g[1] for g in got], pa.float64()))
            arrays.append(pa.array([[{"first": x, "end": y, "lang": lang} for x, y, lang in g[2]] for g in got], spans_type))
            yield pa.RecordBatch.from_arrays(arrays, names=[*out_cols, "lang_pred", "score", "spans"])

    return docs.select(cols).mapInArrow(run, schema)
