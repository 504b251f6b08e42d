"""Personal data: exact base patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import trimmed
from gridloom.llm.nets import Adam, Params, crf_marginals, lstm, lstm_back, normal, turned, viterbi

# The kinds in order, and the base patterns. Starts are tied to where a leftmost match can begin,
# so that no long run is tried from each of its characters.
KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Every kind holds one of these.
TRIGGER = re.compile(r"[0-9@]")
DIGIT = re.compile(r"[0-9]")

#: Characters of a window, and from one window's start to the next.
WINDOW, STRIDE = 128, 64
CHARS, CHAR_SIZE, SIZE = 160, 10, 12
#: Windows that are decoded at once, and characters of the texts that are read at once.
BATCH, GROUP = 256, 1 << 19
#: Characters of the text around made-up spans in training.
PIECE = 64
#: Tags: outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
#: Least mean probability of an added span's characters.
SURE = 0.9

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @: the local part is the run before it that no earlier match has taken."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.fullmatch(text, max(end, start - 64), start) and start - 64 > end:
            start -= 64
        low = max(end, start - 64)
        start = next((i + 1 for i in range(start - 1, low - 1, -1) if not LOCAL.match(text, i, i + 1)), low)
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    out: list[Span] = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if octets(m[0])]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def plausible(kind: int, text: str) -> bool:
    """What an added span must have besides the network's word."""
    digits = "".join(DIGIT.findall(text))
    if kind == 0:
        return "@" in text and "." in text.partition("@")[2]
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and octets(".".join(parts))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


def char_ids(text: str) -> np.ndarray:
    line = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where(line < 128, line, 128 + line % (CHARS - 128))


class Tagger:
    def __init__(self, params: Params):
        self.p = params

    @classmethod
    def fresh(cls, seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        b = np.zeros((2, 1, 4 * SIZE), np.float32)
        b[..., SIZE : 2 * SIZE] = 1
        # characters of one class start alike; tags start with the moves that spans allow
        kind = np.array([0 if chr(c).isdigit() and c < 128 else 1 if chr(c).islower() and c < 128 else 2 if chr(c).isupper() and c < 128 else 3 if c >= 128 else 4 + c for c in range(CHARS)])
        chars = normal(rng, CHARS + 4, CHAR_SIZE, scale=0.8)[kind] + normal(rng, CHARS, CHAR_SIZE, scale=0.1)
        trans, start, bias = (np.zeros(n, np.float32) for n in ((TAGS, TAGS), TAGS, TAGS))
        trans[:, 2::2], start[2::2], bias[0] = -4, -4, 1
        for k in range(1, TAGS, 2):
            trans[k : k + 2, k + 1] = 1
        return cls({
            "chars": chars, "w": normal(rng, 2, CHAR_SIZE, 4 * SIZE), "b": b, "u": normal(rng, 2, SIZE, 4 * SIZE),
            "out": normal(rng, 2 * SIZE, TAGS), "bias": bias, "trans": trans, "start": start,
        })

    def emit(self, ids: np.ndarray, lengths: np.ndarray, keep: bool = False):
        p = self.p
        way = turned(lengths, len(ids))
        both = np.stack([ids, np.take_along_axis(ids, way, axis=0)], axis=1)
        table = np.matmul(p["chars"], p["w"]) + p["b"]
        gates = np.stack([table[0][both[:, 0]], table[1][both[:, 1]]], axis=1)
        states, kept = lstm(gates, lengths, p["u"], keep)
        h = np.concatenate([states[:, 0], np.take_along_axis(states[:, 1], way[..., None], axis=0)], axis=-1)
        emit = h @ p["out"] + p["bias"]
        return (emit, (both, way, kept, h)) if keep else emit

    def grads(self, ids: np.ndarray, lengths: np.ndarray, tags: np.ndarray) -> tuple[float, Params]:
        p, (steps, batch) = self.p, ids.shape
        emit, (both, way, kept, h) = self.emit(ids, lengths, True)
        z, mass, pairs = crf_marginals(emit, lengths, p["trans"], p["start"])
        live = np.arange(steps)[:, None] < lengths
        gold = np.eye(TAGS, dtype=np.float32)[tags] * live[..., None]
        count = np.zeros_like(p["trans"])
        np.add.at(count, (tags[:-1][live[1:]], tags[1:][live[1:]]), 1)
        score = (emit * gold).sum() + (p["trans"] * count).sum() + (p["start"] * gold[0]).sum()
        scale = np.float32(1 / max(1, live.sum()))
        d_emit = (mass - gold) * scale
        g: Params = {"trans": (pairs - count) * scale, "start": d_emit[0].sum(axis=0), "bias": d_emit.sum(axis=(0, 1))}
        g["out"] = h.reshape(-1, 2 * SIZE).T @ d_emit.reshape(-1, TAGS)
        d_h = d_emit @ p["out"].T
        back = np.zeros_like(d_h[..., SIZE:])
        np.put_along_axis(back, np.broadcast_to(way[..., None], back.shape), d_h[..., SIZE:], axis=0)
        d_gates, g["u"] = lstm_back(np.stack([d_h[..., :SIZE], back], axis=1), kept, lengths, p["u"])
        d_table = np.stack([np.eye(CHARS, dtype=np.float32)[both[:, k].ravel()].T @ d_gates[:, k].reshape(-1, 4 * SIZE) for k in (0, 1)])
        g["w"] = p["chars"].T @ d_table
        g["b"] = d_table.sum(axis=1, keepdims=True)
        g["chars"] = (d_table @ p["w"].transpose(0, 2, 1)).sum(axis=0)
        return float((z.sum() - score) * scale), g

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (steps, batch), and each one's probability."""
        emit = self.emit(ids, lengths)
        tags = viterbi(emit, lengths, self.p["trans"], self.p["start"])
        _, mass, _ = crf_marginals(emit, lengths, self.p["trans"], self.p["start"])
        return tags, np.take_along_axis(mass, tags[..., None], axis=2)[..., 0]


def tag_line(n: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for kind, a, b in spans:
        out[a:b] = 2 + 2 * kind
        out[a : a + 1] = 1 + 2 * kind
    return out


def made_up(rng: np.random.Generator) -> tuple[int | None, str]:
    """A labelled span of some kind, in forms that the base patterns have and that they lack; or a number of no kind."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    pick = lambda *x: x[rng.integers(len(x))]
    kind = int(rng.integers(0, 6))
    if kind == 0:
        return 0, f"{word(rng.integers(3, 9))}{pick('.', '_', '')}{digits(rng.integers(0, 3))}{pick('@', '@', ' @ ')}{word(rng.integers(3, 8))}.{pick('example.com', 'com', 'org', 'net')}"
    if kind == 1:
        return 1, pick(".", ".", " . ").join(str(x) for x in rng.integers(1, 256, 4))
    if kind == 2:
        n = pick(15, 16, 16, 16)
        head = digits(n - 1)
        number = next(head + str(d) for d in range(10) if luhn(head + str(d)))
        sep = pick("", "", " ", "-", ".")
        return 2, sep.join(number[i : i + 4] for i in range(0, n, 4))
    if kind == 3:
        area, a, b = digits(3), digits(3), digits(4)
        return 3, pick(f"+1 ({area}) {a}-{b}", f"+{digits(2)} {area} {a} {b}", f"({area}) {a}-{b}", f"+1-{area}-{a}-{b}")
    return None, pick(digits(4), f"{digits(1)}.{digits(2)}", f"{digits(3)},{digits(3)}", "password=" + "".join(rng.choice(list("0123456789abcdef"), 18)), f"{digits(4)}-{digits(2)}-{digits(2)}", f"Version {digits(1)}.{digits(1)}.", f"@{word(6)}", digits(rng.integers(5, 8)), f"http://{word(6)}.com/{digits(5)}")


def train(pieces: list[str], seed: int = 4, epochs: int = 12, batch: int = 40, rate: float = 0.03, least: int = 1200) -> Tagger:
    """A tagger from windows of text: their base spans are labelled, and made-up spans are put between their words."""
    rng = np.random.default_rng(seed)
    plain = [p for p in pieces if p.strip()] or ["a few words of plain text without any numbers in them"]
    rows = []
    for k in range(max(least, len(plain))):
        text, spans = plain[k % len(plain)][:PIECE], []
        for _ in range(int(rng.integers(0, 3))):
            kind, new = made_up(rng)
            gaps = [i for i, c in enumerate(text) if c == " " and not any(a <= i < b for _, a, b in spans)]
            at = int(rng.choice(gaps)) if gaps else len(text)
            new = f" {new} " if gaps else f" {new}"
            text = text[:at] + new + text[at + 1 :]
            spans = [(s, a + len(new) - 1, b + len(new) - 1) if a >= at else (s, a, b) for s, a, b in spans]
            if kind is not None:
                spans.append((kind, at + 1, at + len(new.rstrip())))
        spans += [s for s in base_spans(text) if not any(s[1] < b and a < s[2] for _, a, b in spans)]
        rows.append((char_ids(text), tag_line(len(text), spans)))
    rows.sort(key=lambda r: len(r[0]))
    tagger = Tagger.fresh(seed)
    adam = Adam(tagger.p, rate)
    starts = np.arange(0, len(rows), batch)
    for epoch in range(epochs):
        adam.rate = rate * (1 - 0.9 * epoch / epochs)
        for s in rng.permutation(starts):
            part = rows[s : s + batch]
            lengths = np.array([len(x) for x, _ in part])
            ids, tags = (np.zeros((lengths.max(), len(part)), np.int64) for _ in range(2))
            for k, (x, y) in enumerate(part):
                ids[: len(x), k], tags[: len(x), k] = x, y
            adam.step(tagger.grads(ids, lengths, tags)[1])
    return tagger


def places(text: str) -> list[int]:
    """Starts of the windows of the text's fixed grid that hold a digit or an @; no kind can lie in the others."""
    out, at = [], -1
    while m := TRIGGER.search(text, at + 1):
        first = max(0, (m.start() - WINDOW) // STRIDE + 1)
        out += [k * STRIDE for k in range(first, m.start() // STRIDE + 1) if not out or k * STRIDE > out[-1]]
        at = m.start()
        # on to the next character that none of these windows holds in full
        nxt = (m.start() // STRIDE + 1) * STRIDE
        if nxt - 1 > at:
            at = nxt - 1
    return out


class Finder:
    def __init__(self, tagger: Tagger):
        self.tagger = tagger

    def spans(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """Base spans of each text, and all: base ones and those that the network adds clear of them."""
        todo = [(i, s) for i, t in enumerate(texts) for s in places(t)]
        runs: dict[int, list] = {}
        for k in range(0, len(todo), BATCH):
            part = todo[k : k + BATCH]
            lines = [char_ids(texts[i][s : s + WINDOW]) for i, s in part]
            lengths = np.array([len(x) for x in lines])
            ids = np.zeros((lengths.max(), len(part)), np.int64)
            for w, x in enumerate(lines):
                ids[: len(x), w] = x
            tags, sure = self.tagger.decode(ids, lengths)
            for w, (i, s) in enumerate(part):
                if tags[: lengths[w], w].any():
                    runs.setdefault(i, []).append((s, tags[: lengths[w], w], sure[: lengths[w], w]))
        out = []
        for i, text in enumerate(texts):
            base = base_spans(text)
            more = [s for s in reconciled(text, runs.get(i, [])) if not any(s[1] < b and a < s[2] for _, a, b in base)]
            out.append((sorted(base), sorted(base + more)))
        return out


def reconciled(text: str, windows: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[Span]:
    """One reading of overlapping windows: each character takes the tag of the window in which it is farthest from an edge."""
    best: dict[int, tuple[int, int, float]] = {}
    for s, tags, sure in windows:
        n, end = len(tags), s + len(tags) == len(text)
        for k in np.flatnonzero(tags):
            room = min(k if s else WINDOW, WINDOW if end else n - 1 - k)
            if room > best.get(s + k, (-1,))[0]:
                best[s + k] = (room, int(tags[k]), float(sure[k]))
    run: list[int] = []
    for at in [*sorted(best), -1]:
        if run and (at != run[-1] + 1 or (best[at][1] - 1) // 2 != (best[run[0]][1] - 1) // 2 or best[at][1] % 2):
            kind = (best[run[0]][1] - 1) // 2
            a, b = run[0], run[-1] + 1
            trimmed = text[a:b].strip(" \t\r\n,;:.")
            a += text[a:b].find(trimmed)
            b = a + len(trimmed)
            if trimmed and np.mean([best[x][2] for x in run]) >= SURE and plausible(kind, trimmed):
                yield kind, a, b
            run = []
        run.append(at)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def sample(docs: DataFrame, n_docs: int, seed: int, id_col: str, text_col: str) -> list[str]:
    """Windows of text from n_docs documents at most, the smallest id hashes among those with a digit or an @: four of each."""
    able = docs.where(F.col(text_col).rlike("[0-9@]") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_own"), F.col(text_col).alias("text"))
    ids = able.select(F.col("_own").alias("_id"), F.xxhash64("_own", F.lit(seed)).alias("turn")).distinct().orderBy("turn", "_id").limit(n_docs)
    rows = able.join(F.broadcast(ids), F.col("_own") == F.col("_id"))
    rows = rows.groupBy("_id", "turn").agg(F.min("text").alias("text"))  # of an id's copies one

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for turn, text in zip(x["turn"], x["text"]):
                at = [m.start() for m in TRIGGER.finditer(text)]
                starts = [max(0, at[0] - 30), max(0, at[len(at) // 2] - 15), max(0, at[-1] - 45), len(text) // 2]
                out += [(turn, k, text[s : s + PIECE]) for k, s in enumerate(starts)]
            yield pd.DataFrame(out, columns=["turn", "k", "piece"])

    found = rows.mapInPandas(cut, "turn long, k long, piece string").toPandas()
    return list(found.sort_values(["turn", "k", "piece"])["piece"])


FOUND = "struct<n_email:long,n_ip:long,n_card:long,n_phone:long,base_sha256:string,spans:string,redacted:string>"


def detect(docs: DataFrame, *, n_docs: int = 400, seed: int = 4, id_col: str = "doc_id", text_col: str = "text", redact: bool = False, tagger: Tagger | None = None) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans - and redacted, the text with each span replaced by its [KIND].

    Base spans are exact and stay; the network, trained on labelled spans in windows of n_docs documents at most, adds spans of
    which it is sure (SURE), that are plausible for their kind and clear of base spans. Texts are read whole,
    in overlapping windows on a fixed grid. Offsets are code points.

    Null and empty texts have no spans (redacted: as the text is). Repeated rows and null ids each get their result. An
    empty table gives no rows. All columns are carried; those of the result's names are replaced.
    """
    tagger = tagger or train(sample(docs, n_docs, seed, id_col, text_col), seed)

    @F.pandas_udf(FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from trimmed(partial(_found, tagger, redact))(batches)

    found = docs.withColumn("_found", find(F.col(text_col)))
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", *["redacted"] * redact]
    return found.withColumns({n: F.col(f"_found.{n}") for n in names}).drop("_found")


def _found(tagger: Tagger, redact: bool, batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    finder = Finder(tagger)
    for x in batches:
        rows, group, size = [], [], 0
        for i, text in enumerate(x):
            group.append(text)
            size += len(text or "")
            if size < GROUP and i < len(x) - 1:
                continue
            for own, (base, every) in zip(group, finder.spans([t or "" for t in group])):
                counts = [sum(k == kind for kind, *_ in base) for k in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), _redacted(own, every) if redact else None))
            group, size = [], 0
        yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted"])


def _redacted(text: str | None, spans: list[Span]) -> str | None:
    if not spans or text is None:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
