"""Document operators against brute force, exact round trips and held-out rows; nulls, ties, repeats, empty tables."""

import datetime
import hashlib
import math
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import licenses, mixing, nets, packing, pii, toxicity, urlfilter, warc

WORD = re.compile("[^\x20\x09-\x0d]+")


def documents(spark, rows):
    return spark.createDataFrame([(*r, "en", len(r[1] or "")) for r in rows], "doc_id long, text string, source string, lang string, n_chars long")


def mixed_rows():
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 40))), rng.choice(["b", "b", "b", "a", "é", None, ""])) for i in range(300)]
    return rows + [(7, None, "b"), (None, "x y", "b"), (None, None, None), (8, rows[8][1], rows[8][2]), (400, "", "empty"), (401, "z " * 5000, "a")]


def filled(sizes, weights):
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    total = 1.5 * sum(sizes.values())
    while open_:
        level = (total - sum(2 * sizes[s] for s in sizes if s not in open_)) / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] >= 2 * sizes[s]}
        if not over:
            break
        open_ -= over
    return {s: level * weights[s] if s in open_ else 2.0 * sizes[s] for s in target}


def test_mixing_meets_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    rows = mixed_rows()
    docs = documents(spark, rows).withColumn("key", F.lit(1)).withColumn("size", F.lit("clash")).repartition(5)
    quality = spark.createDataFrame([(i, 0.5 + (i % 3)) for i in range(0, 300, 2)], "doc_id long, quality double")
    got = mixing.mix(docs, quality=quality).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = filled(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] >= r["epochs"] * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    # within a source, parts follow the keys
    rate = {i: 0.5 + i % 3 for i in range(0, 300, 2)}
    u = lambda i: (int(hashlib.md5(f"17:{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    for s in sizes:
        mine = sorted((r for r in got if r["source"] == s), key=lambda r: (-np.log(u(r["doc_id"])) / rate.get(r["doc_id"], 1.0), -1 if r["doc_id"] is None else r["doc_id"], r["size"]))
        left = round(want[s] - mine[0]["epochs"] * sizes[s])
        for r in mine:
            part = max(0, min(r["size"], left))
            assert r["part"] == part
            left -= part
    again = mixing.mix(docs.repartition(3), quality=quality).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixed_rows_are_whole_copies(spark):
    rows = mixed_rows()
    clash = {c: F.col("n_chars") * 2 for c in ("_n", "_i", "_c", "_z", "_row", "_copy", "_size", "_rows")}
    docs = documents(spark, rows).withColumns(clash)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    copies = {}
    for r in out.collect():
        assert all(r[c] == 2 * r["n_chars"] for c in clash)
        copies[r["doc_id"], r["source"], r["text"]] = copies.get((r["doc_id"], r["source"], r["text"]), 0) + 1
    want = {}
    for r in mixing.mix(docs).collect():
        key = r["doc_id"], r["source"], r["size"]
        want[key] = want.get(key, 0) + r["epochs"] + (r["part"] > 0 and 2 * r["part"] >= r["size"])
    seen = {}
    for (i, s, t), n in copies.items():
        key = i, s, len(WORD.findall(t or ""))
        seen[key] = seen.get(key, 0) + n
    assert seen == {k: n for k, n in want.items() if n}


def test_boundaries_are_optimal():
    rng = random.Random(0)
    cost = lambda h, tops: sum(min(t for t in tops if t >= x) * n - s for x, n, s in h)
    for _ in range(150):
        h = [(x, n, x * n) for x, n in ((x, rng.randint(1, 9)) for x in sorted(rng.sample(range(60), rng.randint(1, 7))))]
        k = rng.randint(1, 4)
        found = packing.boundaries(h, k)
        best = min(cost(h, [*(h[i][0] for i in c), h[-1][0]]) for n in range(k) for c in itertools.combinations(range(len(h) - 1), min(n, len(h) - 1)))
        assert len(found) <= k and cost(h, found) == best
    assert packing.boundaries([], 3) == []


def test_packing_fills_batches(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 8)
    docs = documents(spark, mixed_rows()).withColumn("turn", F.lit(1)).withColumn("_b", F.lit(1)).repartition(6)
    got = packing.pack(docs, buckets=4, max_tokens=100).collect()
    assert len(got) == docs.count() and len({r["bucket"] for r in got}) == 4
    batches = {}
    for r in got:
        assert 0 <= r["n_tokens"] <= r["bucket"] and r["padding"] == r["bucket"] - r["n_tokens"]
        batches.setdefault((r["batch"], r["bucket"]), []).append(r["slot"])
    assert len({b for b, _ in batches}) == len(batches)
    per = {}
    for (b, bucket), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) * bucket <= max(100, bucket)
        per.setdefault(bucket, []).append(len(slots))
    assert all(sum(n < max(1, 100 // max(1, bucket)) for n in sizes) <= 1 for bucket, sizes in per.items())
    h = {}
    for r in got:
        h[r["n_tokens"]] = h.get(r["n_tokens"], 0) + 1
    tops = packing.boundaries(sorted((x, n, x * n) for x, n in h.items()), 4)
    assert sorted({r["bucket"] for r in got}) == tops
    assert packing.pack(docs.limit(0)).count() == 0
    long = spark.createDataFrame([(1, 9000), (2, 9001), (3, 123_456_789), (4, None)], "doc_id long, n long")
    assert {r["doc_id"]: r["n_tokens"] for r in packing.pack(long, length_col="n").collect()} == {1: 9000, 2: 9001, 3: 123_456_789, 4: 0}


def test_url_filters_equal_brute_force(spark):
    rng, day = random.Random(3), lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(k)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "hot.net"]
    urls = [f"https://u@{h.upper()}:80/p?q=http://a.com" for h in hosts] + [None, "", "mailto:x", "http:///none", "http://hot.net./"]
    caps = [(i, rng.choice(urls + [urls[4]] * 20), day(rng.randrange(30)) if rng.random() > 0.05 else None) for i in range(400)] + [(3, urls[0], day(3))] * 2 + [(None, urls[1], day(9))]
    entries = [(rng.choice([*hosts, "A.com", "com"]), rng.choice(["block", "allow", "remove"]), day(rng.randrange(30))) for _ in range(30)] + [(None, "block", day(1)), ("a.com", None, day(1)), ("a.com", "block", None)]
    got = urlfilter.filter_urls(spark.createDataFrame(caps, "page_id long, url string, day date").withColumn("pattern", F.lit(1)).withColumn("host", F.lit(1)), spark.createDataFrame(entries, "pattern string, action string, day date")).collect()
    spans = {}
    for p, a, d in entries:
        if p and a and d:
            spans.setdefault(p.lower(), {})
            spans[p.lower()][d] = max(a, spans[p.lower()].get(d, ""))

    def judge(url, d):
        m = re.match(r"[a-z]+://(?:[^/?#@]*@)?([^/?#:]+)", url or "", re.I)
        host = m[1].lower().rstrip(".") if m else None
        parts = host.split(".") if host and d else []
        for k in range(len(parts)):
            p = ".".join(parts[k:])
            days = [x for x in spans.get(p, {}) if x <= d]
            if days and spans[p][max(days)] != "remove":
                return host, p, spans[p][max(days)], max(days)
        return host, None, None, None

    want = sorted(str((i, *(j := judge(u, d)), j[2] != "block")) for i, u, d in caps)
    assert sorted(str((r["page_id"], r["host"], r["pattern"], r["action"], r["valid_from"], r["kept"])) for r in got) == want
    assert urlfilter.filter_urls(spark.createDataFrame([], "page_id long, url string, day date"), spark.createDataFrame([], "pattern string, action string, day date")).count() == 0


def test_warc_round_trip(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdé\r\n\x00") for _ in range(90_000))
    html = ["x" * 999, "y" * 1000, "é" * 500, None, "", long, "z" * 40_000, "WARC/1.1\r\n\r\n" * 100]
    rows = [(i, f"http://h/{i} \r\nx", html[i % len(html)]) for i in range(60)] + [(None, None, "y" * 1000), (3, "u", None), (59, "v", html[59 % len(html)])]
    rows += [(None, None, "w" * 30_000)] * 3 + [(70, "u", "q" * 30_000)] * 4  # in segments, all of one record id
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    got = warc.round_trip(pages, segment=5000, file_bytes=20_000).collect()
    keeper = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            keeper[b] = max(keeper.get(b, -1), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        k = keeper.get(b)
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), *(("response", None) if k in (None, i) else ("revisit", k))))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert warc.unchunked(warc.chunked(b"abc" * 5000, 7)) == b"abc" * 5000
    with pytest.raises(Exception, match="broken|substring|invalid"):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_lost_segments_are_noticed(spark):
    block = warc.HTTP + warc.chunked(b"q" * 3000)
    rows = [("o", 1, "response", None, hashlib.sha1(b"q" * 3000).hexdigest(), 1, None, None, None, block[:1000]), ("o", None, "continuation", None, None, 3, len(block), None, None, block[2000:])]
    assert len(block) > 2000
    with pytest.raises(Exception, match="not whole"):
        warc.reassemble(spark.createDataFrame(rows, warc.RECORD)).collect()


def test_base_licenses_equal_brute_force(spark):
    rng = random.Random(6)
    bits = ["GNU", "General", "Public", "License", "Apache", "MIT", "CC", "BY", "by", "é", "x", "license,", "Licence", "gnu-general", "BY-NC"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None, "", "Apache License " * 30_000, "MIT\nLicense", "mit`license", "amit license", "mit licensé"]
    texts += ["Licensed under the Apache Licens3, Version 2.0", "permision is hereby granted, free of charge", "GNU Genral Public License"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        hits = [(k, v) for p, v in licenses.PHRASES.items() for n in [p.split()] for k in range(len(w) - len(n) + 1) if w[k : k + len(n)] == n]
        at = [k for k, _ in hits]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({v for _, v in hits})))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert [got[len(texts) - k]["labels"] for k in (3, 2, 1)] == ["apache", "mit", "gpl"]
    s = got[len(texts) - 1]["spans"][0]
    assert (s["first_word"], s["last_word"], s["errors"]) == (0, 3, 1) and 0 < got[len(texts) - 1]["score"] < 1
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_notices_before_a_better_one_are_reported():
    for text, want in (
        ("gnu genral public license gnu general public license", [(0, 3, 1), (4, 7, 0)]),
        ("all rights reserve all rights reserved", [(0, 2, 1), (3, 5, 0)]),
        ("x all rights reserve y all rights reserved all right reserved z", [(1, 3, 1), (5, 7, 0), (8, 10, 1)]),
    ):
        label = "gpl" if "gnu" in text else "all-rights-reserved"
        spans = [(s["first_word"], s["last_word"], s["errors"]) for s in licenses.Scanner().scan(text)["spans"] if s["label"] == label]
        assert spans == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        was, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(was[j] + 1, row[-1] + 1, was[j - 1] + (x != y)))
    return row[-1]


def test_notices_equal_a_search_of_every_place():
    rng = random.Random(6)
    notices = {k: licenses.NOTICES[k] for k in ("gnu general public license", "mozilla public license", "all rights reserved", "apache license version 2 0")}
    scanner = licenses.Scanner({}, notices)
    for _ in range(40):
        line = []
        for _ in range(rng.randint(1, 4)):
            chars = list(rng.choice(list(notices)))
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(chars))
                chars[at] = rng.choice(["", "q", chars[at] + "z", chars[at]])
            line += "".join(chars).split() + rng.choice([[], [], ["x", "public"], ["license"]])
        found = {n: [] for n in notices}
        for s in scanner.scan(" ".join(line))["spans"]:
            part = " ".join(line[s["first_word"] : s["last_word"] + 1])
            assert edits(part, s["notice"]) == s["errors"] <= len(s["notice"]) // licenses.EDIT
            found[s["notice"]].append((s["first_word"], s["last_word"], s["errors"]))
        for n in notices:  # whatever is within the bound meets a span that is no worse
            for a in range(len(line)):
                for b in range(a, min(len(line), a + 8)):
                    part = " ".join(line[a : b + 1])
                    if abs(len(part) - len(n)) <= len(n) // licenses.EDIT and (e := edits(part, n)) <= len(n) // licenses.EDIT:
                        assert any(x <= b and a <= y and least <= e for x, y, least in found[n]), (line, n, part)


def test_pigeonhole_pieces_find_every_bounded_edit():
    scanner, rng = licenses.Scanner(), random.Random(7)
    for notice, label in licenses.NOTICES.items():
        for _ in range(20):
            t = list(notice)
            for _ in range(rng.randint(0, len(notice) // licenses.EDIT)):
                k = rng.randrange(1, len(t) - 1)
                rng.choice([lambda: t.__setitem__(k, "q"), lambda: t.insert(k, "q"), lambda: t.pop(k) if t[k] != " " else None])()
            assert label in scanner.scan("some text " + "".join(t) + " more").get("labels").split(",")


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in EMAIL.finditer(t)] + [(1, *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(1)
    for k in range(20_000):
        t = "".join(rng.choice("a1.@-+ %(0é") for _ in range(rng.randint(0, 40)))
        t += "b" * rng.randint(50, 200) + "@c.d" + t if k % 5 == 0 else ""
        assert sorted(plain_spans(t)) == sorted(pii.base_spans(t))
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(1, 0, 5006)]
    assert pii.base_spans("a" * 300_000 + "@b.c") == [(0, 0, 300_004)]


def test_windows_cover_every_trigger():
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("a" * 40 + "1@") for _ in range(rng.randint(0, 700)))
        assert pii.places(t) == [s for s in range(0, len(t), pii.STRIDE) if pii.TRIGGER.search(t[s : s + pii.WINDOW])]


def numeric(f, x, at, e=1e-5):
    was = x[at]
    x[at] = was + e
    a = f()
    x[at] = was - e
    b = f()
    x[at] = was
    return (a - b) / (2 * e)


def test_gradients():
    rng = np.random.default_rng(0)
    tagger = pii.Tagger.fresh(1)
    tagger.p = {k: v.astype(float) for k, v in tagger.p.items()}
    ids, lengths, tags = rng.integers(40, 60, (7, 3)), np.array([7, 5, 2]), rng.integers(0, 9, (7, 3))
    tags[5:, 1], tags[2:, 2] = 0, 0
    g = tagger.grads(ids, lengths, tags)[1]
    net = toxicity.Net.fresh(["the", "idiot"], 1)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    args = ["idiot", "élan", "the", "x"], np.array([[0, 1, 2], [1, 2, 0], [3, 0, 0]]), np.array([3, 2, 0]), np.array([0, 0, 1]), np.array([1.0, 0.0])
    h = net.grads(*args)[1]
    for p, grads, f in ((tagger.p, g, lambda: tagger.grads(ids, lengths, tags)[0]), (net.p, h, lambda: net.grads(*args)[0])):
        for k in p:
            at = tuple(rng.integers(0, s) for s in p[k].shape)
            assert grads[k][at] == pytest.approx(numeric(f, p[k], at), abs=1e-6), k


def test_viterbi_and_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    emit, trans, start = rng.standard_normal((4, 1, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3)
    score = {w: start[w[0]] + sum(emit[t, 0, k] for t, k in enumerate(w)) + sum(trans[a, b] for a, b in zip(w, w[1:])) for w in itertools.product(range(3), repeat=4)}
    z, mass, pairs = nets.crf_marginals(emit, np.array([4]), trans, start)
    total = np.log(sum(np.exp(list(score.values()))))
    assert z[0] == pytest.approx(total) and pairs.sum() == pytest.approx(3)
    assert mass[2, 0, 1] == pytest.approx(sum(np.exp(v - total) for w, v in score.items() if w[2] == 1))
    assert tuple(nets.viterbi(emit, np.array([4]), trans, start)[:, 0]) == max(score, key=score.get)


@pytest.fixture(scope="module")
def tagger():
    rng = random.Random(0)
    plain = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(20)) for _ in range(300)]
    return pii.train(plain)


def test_network_adds_spans_and_keeps_base_ones(spark, tagger):
    base = "write to bob.4@mail.example.com or +1 (988) 555-2485, from 70.123.182.155 with 4111 1111 1111 1111 today"
    more = ["you may call us on (988) 555-2485 at any hour", "send it to bob.42 @ mail.org and wait there", "the card 4111.1111.1111.1111 is his own card"]
    clean = ["in 2024 it was 12.50 or so", "nothing here at all", "version 2.0 and 1,000 more"]
    rows = list(enumerate([base, None, "", *more, *clean, ("word " * 400 + base + " ") * 20]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("old"))
    got = {r["doc_id"]: r for r in pii.detect(docs, tagger=tagger, redact=True).collect()}
    for i, t in rows:
        want = sorted(plain_spans(t or ""))
        assert got[i]["base_sha256"] == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert set(filter(None, pii.joined(want).split(","))) <= set(got[i]["spans"].split(","))
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == n for s in want) for n in range(4)]
    assert sum(bool(got[i]["spans"]) for i in (3, 4, 5)) >= 2 and not any(got[i]["spans"] for i in (6, 7, 8))
    assert got[0]["redacted"] == "write to [EMAIL] or [PHONE], from [IP] with [CARD] today" and got[1]["redacted"] is None
    assert pii.detect(docs.limit(0), tagger=tagger).count() == 0


def toxic_rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["an", "th", "er", "in", "ou"]) for _ in range(rng.randint(1, 4)))
    rows, marks = [], []
    for i in range(700):
        w = [word() for _ in range(rng.randint(3, 260))]
        bad = i % 3 == 0
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "vequ" + word(), "scum."]))
        rows.append((i, " ".join(w), "s"))
        marks.append((i, 1, int(bad)))
    return rows, marks


def test_toxicity_on_held_out_rows(spark):
    rows, marks = toxic_rows()
    rows += [(1000, None, "s"), (1001, "", None), (None, "a b", "s"), (1002, "ou " * 30_000 + "scum. " + "an " * 30_000, "s"), (1003, "an" * 50_000, "s")]
    labels = spark.createDataFrame([*marks, (5, None, None), (None, 1, 1), marks[0]], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows).withColumn("score", F.lit("old")).withColumn("toxic", F.lit(0)).withColumn("turn", F.lit(0))
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels, each=250, more=50).collect()}
    assert len(got) == len(rows)
    for i in got:
        assert got[i]["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == int(got[i]["score"] >= 0.7)
    held = [(i, bad) for i, _, bad in marks if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == bad for i, bad in held) >= 0.95 * len(held)
    assert got[1002]["predicted"] == 1 and got[1000]["score"] == got[1001]["score"]
    assert toxicity.score(docs, labels.where("toxic = 1")).select(F.avg("score")).first()[0] == 1.0
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert toxicity.score(docs.limit(5), labels.limit(0)).select(F.max("score")).first()[0] == 0.0


def slow_score(net, text):
    """The highest window's score, one number at a time."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    sig = lambda v: 1 / (1 + math.exp(-v))

    def unit(xs, u, c):
        h, out = [0.0] * len(u), []
        for x in xs:
            g = [sum(h[i] * u[i][j] for i in range(len(u))) for j in range(3 * len(u))]
            k, new = len(u), []
            for j in range(k):
                z, r = sig(x[j] + g[j]), sig(x[k + j] + g[k + j])
                new.append((1 - z) * math.tanh(x[2 * k + j] + r * (g[2 * k + j] + c[0][j])) + z * h[j])
            h = new
            out.append(h)
        return out

    def inputs(v, w, b):
        return [sum(v[i] * w[i][j] for i in range(len(v))) + b[0][j] for j in range(len(b[0]))]

    def word(w, way):
        ids = [ord(c) if ord(c) < 128 else 128 + ord(c) % (toxicity.CHARS - 128) for c in w]
        ends = [unit([inputs(p["chars"][i], p["char_w"][d], p["char_b"][d]) for i in (ids, ids[::-1])[d]], p["char_u"][d], p["char_c"][d])[-1] for d in (0, 1)]
        return inputs([*p["words"][net.vocabulary.get(w, 0)], *ends[0], *ends[1]], p["w"][way], p["b"][way])

    words, best = toxicity.tokens(text), -1e9
    for a, b in toxicity.windows(len(words)):
        part = words[a:b]
        if not part:
            best = max(best, p["bias"][0])
            continue
        there = unit([word(w, 0) for w in part], p["u"][0], p["c"][0])
        back = unit([word(w, 1) for w in part[::-1]], p["u"][1], p["c"][1])[::-1]
        h = [x + y for x, y in zip(there, back)]
        s = [sum(math.tanh(sum(v[i] * p["att"][i][j] for i in range(len(v)))) * p["att_v"][j][0] for j in range(p["att"].shape[1])) for v in h]
        e = [math.exp(v - max(s)) for v in s]
        pool = [sum(e[t] / sum(e) * h[t][i] for t in range(len(h))) for i in range(len(h[0]))]
        best = max(best, sum(pool[i] * p["out"][i][0] for i in range(len(pool))) + p["bias"][0])
    return sig(best)


def test_scores_equal_a_network_of_plain_loops(monkeypatch):
    rng = random.Random(4)
    net = toxicity.Net.fresh(["ab", "cd", "é"], 5)
    for k in net.p:
        net.p[k] = net.p[k] + np.random.default_rng(len(k)).standard_normal(net.p[k].shape).astype(np.float32) * 0.2
    texts = ["", None, "ab", "Cd é x" * 3, *(" ".join(rng.choice(["ab", "cd", "zz", "éa", "q" * 25]) for _ in range(n)) for n in (5, 96, 97, 200))]
    want = [slow_score(net, t) for t in texts]
    assert np.allclose(toxicity.Scorer(net).scores(texts), want, atol=1e-5)
    monkeypatch.setattr(toxicity, "GROUP", 40)  # every longer text in pieces, the known words forgotten again and again
    monkeypatch.setattr(toxicity, "PIECE", toxicity.STRIDE)
    monkeypatch.setattr(toxicity, "KNOWN", 3)
    assert np.allclose(toxicity.Scorer(net).scores(texts), want, atol=1e-5)


def test_pieces_have_the_windows_of_the_whole(monkeypatch):
    monkeypatch.setattr(toxicity, "GROUP", 0)
    monkeypatch.setattr(toxicity, "PIECE", 2 * toxicity.STRIDE)
    for n in range(0, 700, 3):
        words = [f"w{i}" for i in range(n)]
        want = {tuple(words[a:b]) for a, b in toxicity.windows(n)}
        assert {tuple(x[a:b]) for x in toxicity.pieces(" ".join(words)) for a, b in toxicity.windows(len(x))} == want


def test_toxic_windows_cover_all_words():
    for n in range(0, 400):
        w = toxicity.windows(n)
        assert {k for a, b in w for k in range(a, b)} == set(range(n)) and all(b - a <= toxicity.WINDOW for a, b in w)
        assert all(b2 > b1 and a2 < b1 for (_, b1), (a2, b2) in zip(w, w[1:]))


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows, marks = toxic_rows()
    rows = rows[:200] + [(2000 + i, rows[1][1].upper(), "t") for i in range(5)] + [(2100, "mail bob@x.com now", "t"), (None, None, None), (2101, "", "t")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks[:200], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES][0] == "toxicity" and len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        if name == "near_duplicates":
            assert out.where("doc_id >= 2000 and doc_id < 2100").count() == 0 and out.where("doc_id = 1").count() == 1
            docs = out
        if name == "personal_data":
            assert out.where("doc_id = 2100").first()["text"] == "mail [EMAIL] now" and out.count() == docs.count()
    assert {"doc_id", "batch", "slot"} <= set(out.columns) and out.count() == docs.count()


def test_stages_keep_clashing_columns_and_take_empty_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows, marks = toxic_rows()
    rows = [*rows[:120], rows[1], rows[1], (None, None, None), (None, None, None), (900, "", "t"), (901, "call +1 (988) 555-2485 now", "t")]
    spark.createDataFrame(marks[:120], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ["score", "predicted", "held_out", "n_email", "spans", "redacted", "_row", "_found", "_n", "_i", "_copy", "_k", "key", "row", "node", "turn", "_b", "toxic", "quality", "_id"]
    docs = documents(spark, rows).withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in names})
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        found = out.collect()
        assert found and all(r[c] == f"{c}:{'none' if r['doc_id'] is None else r['doc_id']}" for r in found for c in names), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if name == "personal_data":
            assert len(found) == len(rows) and [r["text"] for r in found if r["doc_id"] == 901] == ["call [PHONE] now"] and [r["text"] for r in found if r["doc_id"] is None] == [None, None]
            assert len({(r["text"], r["n_chars"]) for r in found if r["doc_id"] == 1}) == 1
    packed = pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.count() == len(rows) and pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_repeated_rows_and_ids_each_have_their_result(spark, tagger):
    rows = [(1, "mit license a@b.com"), (1, "mit license a@b.com"), (1, "cc by"), (None, "mit license a@b.com"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"] or 0, r["n_email"], r["spans"]) for r in pii.detect(docs, tagger=tagger).collect())
    assert found == [(0, 0, ""), (0, 1, "email:12:19"), (1, 0, ""), (1, 1, "email:12:19"), (1, 1, "email:12:19")]
    notices = sorted((r["doc_id"] or 0, r["n_words"], r["base_labels"]) for r in licenses.scan_licenses(docs).collect())
    assert notices == [(0, 0, ""), (0, 5, "mit"), (1, 2, "cc-by"), (1, 5, "mit"), (1, 5, "mit")]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
