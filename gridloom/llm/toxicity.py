"""Toxicity by a bidirectional gated recurrent network with attention pooling over character and word inputs."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import trimmed
from gridloom.llm.nets import Adam, Params, gru, gru_back, normal, sigmoid, turned

#: Words are runs of letters, digits and _, lower-cased; longer runs go on as further words.
TOKEN = re.compile(r"\w{1,20}")
#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 96, 72
CHARS = 192
#: Words with a vector of their own; all others share one.
WORDS = 4096
CHAR_SIZE, WORD_SIZE, SIZE = 8, 8, 8
#: Words whose gates a scorer remembers, and words whose gates are made at once.
KNOWN, FRESH = 1 << 17, 1024
#: Windows that are scored at once.
BATCH = 256
#: Characters of the texts that are scored at once, and words of a piece of a longer text.
GROUP, PIECE = 1 << 19, 1024 * STRIDE


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def windows(n: int) -> list[tuple[int, int]]:
    """Overlapping windows of n words; they cover all, and no text has none."""
    return [(s, min(n, s + WINDOW)) for s in range(0, max(0, n - WINDOW) + STRIDE, STRIDE) if s == 0 or s < n]


def pieces(text: str) -> Iterator[list[str]]:
    """The text's words in pieces whose windows together are those of the whole; only one piece is in memory."""
    if len(text) <= GROUP:
        yield tokens(text)
        return
    held: list[str] = []
    for m in TOKEN.finditer(text.lower()):
        if len(held) == PIECE + WINDOW - STRIDE:
            yield held
            held = held[PIECE:]
        held.append(m[0])
    yield held


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character numbers (steps, words) and the words' lengths."""
    lengths = np.array([len(w) for w in words], int)
    line = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    line = np.where(line < 128, line, 128 + line % (CHARS - 128))
    out = np.zeros((max(1, lengths.max(initial=1)), len(words)), np.int64)
    at = np.repeat(np.arange(len(words)), lengths)
    out[np.arange(len(line)) - np.repeat(np.cumsum(lengths) - lengths, lengths), at] = line
    return out, lengths


class Net:
    def __init__(self, vocabulary: dict[str, int], params: Params):
        self.vocabulary, self.p = vocabulary, params

    @classmethod
    def fresh(cls, vocabulary: list[str], seed: int) -> Net:
        rng, h, c = np.random.default_rng(seed), SIZE, CHAR_SIZE
        return cls({w: i + 1 for i, w in enumerate(vocabulary)}, {
            "chars": normal(rng, CHARS, c, scale=0.5), "char_w": normal(rng, 2, c, 3 * c), "char_b": np.zeros((2, 1, 3 * c), np.float32),
            "char_u": normal(rng, 2, c, 3 * c), "char_c": np.zeros((2, 1, c), np.float32),
            "words": normal(rng, len(vocabulary) + 1, WORD_SIZE, scale=0.1), "w": normal(rng, 2, WORD_SIZE + 2 * c, 3 * h), "b": np.zeros((2, 1, 3 * h), np.float32),
            "u": normal(rng, 2, h, 3 * h), "c": np.zeros((2, 1, h), np.float32),
            "att": normal(rng, 2 * h, h), "att_v": normal(rng, h, 1), "out": normal(rng, 2 * h, 1), "bias": np.zeros(1, np.float32),
        })

    def word_gates(self, words: list[str], keep: bool = False):
        """Input gates (2, words, 3 SIZE) of distinct words, longest first: the word's vector beside both ends of the character network."""
        p = self.p
        ids, lengths = letters(words)
        back = np.take_along_axis(ids, turned(lengths, len(ids)), axis=0)
        both = np.stack([ids, back], axis=1)
        x = p["chars"][both]
        states, kept = gru(np.matmul(x, p["char_w"]) + p["char_b"], lengths, p["char_u"], p["char_c"], keep)
        number = np.array([self.vocabulary.get(w, 0) for w in words], int)
        joint = np.concatenate([p["words"][number], states[-1, 0], states[-1, 1]], axis=1)
        gates = np.matmul(joint, p["w"]) + p["b"]
        return (gates, (both, x, lengths, states, kept, number, joint)) if keep else gates

    def pooled(self, gates: np.ndarray, ids: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Logits of windows. gates: of distinct words; ids: (steps, windows) word numbers."""
        p, steps = self.p, len(ids)
        way = turned(lengths, steps)
        both = np.stack([ids, np.take_along_axis(ids, way, axis=0)], axis=1)
        g = np.stack([gates[0][both[:, 0]], gates[1][both[:, 1]]], axis=1)
        states, kept = gru(g, lengths, p["u"], p["c"], keep)
        h = np.concatenate([states[:, 0], np.take_along_axis(states[:, 1], way[..., None], axis=0)], axis=-1)
        a = np.tanh(h @ p["att"])
        live = np.arange(steps)[:, None] < lengths
        s = np.where(live, (a @ p["att_v"])[..., 0], -1e9)
        e = np.exp(s - s.max(axis=0)) * live
        share = e / np.maximum(e.sum(axis=0), 1e-9)
        pool = (share[..., None] * h).sum(axis=0)
        logit = (pool @ p["out"])[:, 0] + p["bias"][0]
        return (logit, (both, way, kept, h, a, share, pool)) if keep else logit

    def grads(self, words: list[str], ids: np.ndarray, lengths: np.ndarray, doc: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
        """Loss and gradients of documents whose logit is the log-sum-exp of their windows' logits."""
        p, n = self.p, len(y)
        gates, (c_both, c_x, c_len, c_states, c_kept, number, joint) = self.word_gates(words, True)
        logit, (both, way, kept, h, a, share, pool) = self.pooled(gates, ids, lengths, True)
        top = np.full(n, -1e9)
        np.maximum.at(top, doc, logit)
        e = np.exp(logit - top[doc])
        total = np.bincount(doc, e, n)
        whole = top + np.log(total)
        q = sigmoid(whole)
        loss = float(np.mean(np.logaddexp(0, whole) - y * whole))
        d_logit = ((q - y)[doc] / n * e / total[doc]).astype(np.float32)
        g: Params = {"out": pool.T @ d_logit[:, None], "bias": np.array([d_logit.sum()], np.float32)}
        d_pool = d_logit[:, None] * p["out"][:, 0]
        d_share = (h * d_pool).sum(axis=-1)
        d_s = share * (d_share - (share * d_share).sum(axis=0))
        d_a = d_s[..., None] * p["att_v"][:, 0] * (1 - a * a)
        g["att_v"] = (a * d_s[..., None]).sum(axis=(0, 1))[:, None]
        g["att"] = h.reshape(-1, h.shape[-1]).T @ d_a.reshape(-1, a.shape[-1])
        d_h = share[..., None] * d_pool + d_a @ p["att"].T
        back = np.zeros_like(d_h[..., SIZE:])
        np.put_along_axis(back, np.broadcast_to(way[..., None], back.shape), d_h[..., SIZE:], axis=0)
        d_gates, g["u"], g["c"] = gru_back(np.stack([d_h[..., :SIZE], back], axis=1), kept, lengths, p["u"])
        d_word = np.zeros_like(gates)
        for k in (0, 1):
            d_word[k] = _summed(both[:, k].ravel(), d_gates[:, k].reshape(-1, 3 * SIZE), gates.shape[1])
        g["w"] = joint.T @ d_word
        g["b"] = d_word.sum(axis=1, keepdims=True)
        d_joint = (d_word @ p["w"].transpose(0, 2, 1)).sum(axis=0)
        g["words"] = _summed(number, d_joint[:, :WORD_SIZE], len(p["words"]))
        d_state = np.zeros_like(c_states)
        d_state[-1, 0], d_state[-1, 1] = d_joint[:, WORD_SIZE : WORD_SIZE + CHAR_SIZE], d_joint[:, WORD_SIZE + CHAR_SIZE :]
        d_cg, g["char_u"], g["char_c"] = gru_back(d_state, c_kept, c_len, p["char_u"])
        flat_x, flat_d = (z.transpose(1, 0, 2, 3).reshape(2, -1, z.shape[-1]) for z in (c_x, d_cg))
        g["char_w"] = flat_x.transpose(0, 2, 1) @ flat_d
        g["char_b"] = flat_d.sum(axis=1, keepdims=True)
        d_x = flat_d @ p["char_w"].transpose(0, 2, 1)
        g["chars"] = _summed(c_both.transpose(1, 0, 2).ravel(), d_x.reshape(-1, CHAR_SIZE), CHARS)
        return loss, g


def _summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, rows.shape[1]), np.float32)
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
    if len(at):
        out[at[order[first]]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def _fit(net: Net, split: list[list[str]], toxic: np.ndarray, rng: np.random.Generator, epochs: int, batch: int, rate: float) -> None:
    adam = Adam(net.p, rate)
    for epoch in range(epochs):
        adam.rate = rate * (1 - 0.9 * epoch / epochs)
        order = rng.permutation(len(split))
        for s in range(0, len(order), batch):
            mine = order[s : s + batch]
            spans = sorted(((k, i, a, b) for k, i in enumerate(mine) for a, b in windows(len(split[i]))), key=lambda x: x[2] - x[3])
            words = sorted({w for i in mine for w in split[i]}, key=lambda w: (-len(w), w)) or [""]
            number = {w: n for n, w in enumerate(words)}
            lengths = np.array([b - a for *_, a, b in spans])
            ids = np.zeros((max(1, lengths[0]), len(spans)), np.int64)
            for w, (_, i, a, b) in enumerate(spans):
                ids[: b - a, w] = [number[x] for x in split[i][a:b]]
            _, g = net.grads(words, ids, lengths, np.array([x[0] for x in spans]), toxic[mine])
            adam.step(g)


def train(texts: list[str], toxic: np.ndarray, seed: int = 3, each: int = 600, chars: int = 2500, epochs: int = 5, batch: int = 48, rate: float = 0.01) -> Net | float:
    """A trained network, or where only one label occurs the share of label 1.

    A first round learns from `each` texts of a label, of up to `chars` characters where there are any. A second one adds the windows that the
    network misjudges: of texts of label 0 those that it takes for toxic, of long texts of label 1 the best one.
    """
    toxic = np.asarray(toxic, float)
    if not len(texts) or toxic.min() == toxic.max():
        return float(toxic.mean()) if len(texts) else 0.0
    split, rng, first = [tokens(t) for t in texts], np.random.default_rng(seed), []
    for y in (0, 1):
        own = [i for i in range(len(texts)) if toxic[i] == y]
        first += [i for i in own if len(texts[i]) <= chars][:each] or sorted(own, key=lambda i: len(texts[i]))[:20]
    first.sort()
    seen = Counter(w for i in first for w in sorted(set(split[i])))
    net = Net.fresh([w for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:WORDS] if n > 1], seed)
    epochs = min(40, max(epochs, 9000 // len(first)))  # few rows are seen more often
    start, marks = [split[i] for i in first], toxic[first]
    _fit(net, start, marks, rng, epochs, batch, rate)
    scorer, hard, best, used = Scorer(net), [], [], set(first)
    for i, x in enumerate(split):
        logits = scorer.window_logits([x])[1]
        if not toxic[i]:
            hard += [(q, x[a:b]) for q, (a, b) in zip(logits, windows(len(x))) if q > -3]
        elif i not in used and logits.max() > 0:
            a, b = windows(len(x))[int(logits.argmax())]
            best.append(x[a:b])
    hard = [x for _, x in sorted(hard, key=lambda x: -x[0])[: len(first)]]
    _fit(net, start + best + hard, np.r_[marks, np.ones(len(best)), np.zeros(len(hard))], rng, epochs // 2, batch, rate / 2)
    return net


class Scorer:
    """Scores whole texts: the sigmoid of the highest logit of all windows. Memory is bounded by KNOWN, GROUP and BATCH."""

    def __init__(self, net: Net | float):
        self.net, self.known = net, {}
        self.gates = np.zeros((2, KNOWN if isinstance(net, Net) else 0, 3 * SIZE), np.float32)

    def numbers(self, split: list[list[str]]) -> list[np.ndarray]:
        """Word numbers of texts, after gates of new words are made."""
        here = dict.fromkeys(w for words in split for w in words)
        new = [w for w in here if w not in self.known]
        if len(self.known) + len(new) > self.gates.shape[1]:
            self.known, new = {}, list(here)
            if len(new) > self.gates.shape[1]:
                self.gates = np.zeros((2, len(new), 3 * SIZE), np.float32)
        new.sort(key=len, reverse=True)
        for s in range(0, len(new), FRESH):
            part, at = new[s : s + FRESH], len(self.known)
            self.gates[:, at : at + len(part)] = self.net.word_gates(part)
            self.known.update(zip(part, range(at, at + len(part))))
        return [np.fromiter((self.known[w] for w in words), np.int64, len(words)) for words in split]

    def window_logits(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Text number and logit of every window, in order."""
        ids = self.numbers(split)
        spans = [(i, a, b) for i, x in enumerate(ids) for a, b in windows(len(x))]
        order = sorted(range(len(spans)), key=lambda w: spans[w][1] - spans[w][2])  # longest first
        logits = np.empty(len(spans))
        for s in range(0, len(spans), BATCH):
            part = order[s : s + BATCH]
            lengths = np.array([spans[w][2] - spans[w][1] for w in part])
            line = np.zeros((len(part), max(1, lengths[0])), np.int64)
            for k, w in enumerate(part):
                i, a, b = spans[w]
                line[k, : b - a] = ids[i][a:b]
            logits[part] = self.net.pooled(self.gates, line.T, lengths)
        return np.array([i for i, *_ in spans], int), logits

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not isinstance(self.net, Net):
            return np.full(len(texts), self.net)
        best, rows, group, size = np.full(len(texts), -np.inf), [], [], 0
        for i, t in enumerate(texts):
            for words in pieces(t or ""):
                rows.append(i)
                group.append(words)
                size += 8 * len(words)
                if size >= GROUP:
                    self._raise(best, rows, group)
                    rows, group, size = [], [], 0
        self._raise(best, rows, group)
        return sigmoid(best)

    def _raise(self, best: np.ndarray, rows: list[int], group: list[list[str]]) -> None:
        if group:
            at, logits = self.window_logits(group)
            np.maximum.at(best, np.array(rows)[at], logits)


def held_out(id_col: str):
    """Rows that never train: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, each: int, chars: int, more: int, seed: int, id_col: str, text_col: str) -> pd.DataFrame:
    """Training rows (text, toxic): of the smallest id hashes of either label `each` ids at most, and `more` further ones of label 0.

    An id has one row, whatever its copies. A text of more than 8 times `chars` characters gives a stretch of that size, at a place by its hash.
    """
    known = labels.where(f"{id_col} is not null and toxic is not null").groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(id_col)).withColumn("turn", F.xxhash64(id_col, F.lit(seed)))
    # labels may name ids that documents lack, so more are asked for; a bounded table, so a safe broadcast
    asked = {0: 2 * each + more, 1: 2 * each}
    picked = [known.where(F.col("toxic") == y).orderBy("turn", id_col).limit(n) for y, n in asked.items()]
    picked = picked[0].union(picked[1]).withColumnRenamed(id_col, "_id")
    h, text, most = F.xxhash64(text_col), F.col(text_col), 8 * chars
    cut = F.when(F.length(text) > most, F.substring(text, (F.pmod(h, F.length(text) - most) + 1).cast("int"), F.lit(most))).otherwise(text)
    rows = docs.where(text.isNotNull()).select(F.col(id_col).alias("_own"), cut.alias("text"), h.alias("h"))
    rows = rows.join(F.broadcast(picked), F.col("_own") == F.col("_id"))
    rows = rows.groupBy("_id", "toxic", "turn").agg(F.min(F.struct("h", "text")).alias("first"))  # of an id's copies one, before any is collected
    found = rows.select("toxic", "turn", "_id", F.col("first.text").alias("text")).toPandas().sort_values(["turn", "_id"], ignore_index=True)
    kept = [found[found["toxic"] == y].head(n) for y, n in ((0, each + more), (1, each))]
    return pd.concat(kept).sort_index()


def score(
    docs: DataFrame,
    labels: DataFrame,
    *,
    threshold: float = 0.7,
    each: int = 600,
    chars: int = 2500,
    more: int = 1000,
    seed: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    net: Net | float | None = None,
) -> DataFrame:
    """docs with held_out, score, predicted; score is the sigmoid of the highest window's logit.

    The network is trained on `each` ids of either label and `more` further ones of label 0 at most (see sample() and
    train(); ids outside of the held-out third); disagreeing labels of an id count as toxic, and with one label only the score is its
    share. Every text is scored whole, in overlapping windows; only the text is an input.

    Null and empty texts have one window without words, which scores by the bias alone. Rows that repeat an id
    or a text score alike. A null id is not held out. An empty table gives no rows. All columns are carried; those named
    held_out, score or predicted are replaced.
    """
    if net is None:
        rows = sample(docs, labels, each, chars, more, seed, id_col, text_col)
        net = train(list(rows["text"]), rows["toxic"].to_numpy(), seed, each, chars)

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from trimmed(partial(_judged, net))(batches)

    scored = docs.withColumn("held_out", held_out(id_col)).withColumn("score", judge(F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _judged(net: Net | float, batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    scorer = Scorer(net)
    for x in batches:
        yield pd.Series(scorer.scores(x))
