"""The training-data operators: defined results on odd inputs, and brute force, round trips or held-out accuracy."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat_format, decontam, exact_dedup, lang_id, license_scan, mixing, near_dedup, queries, tokens, training_order, url_filter
from quarry.llm.common import Scratch, connected_components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, n string, rep int, keys int, digest int, words int, tokens int, part int, slot int, block int"


def docs_of(spark, rows):
    """rows: (doc_id, text, lang, source); other columns clash with names inside the operators."""
    return spark.createDataFrame([(*r, None, 7, "x", 1, 2, 3, 4, 5, 6, 7, 8) for r in rows], DOCS)


def words_text(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "one", "en", None), (4, "one", "en", None), (5, "12 34 !!", "en", "b"),
       (6, "x" * 200_000, "en", "b"), (7, "Éa ÉA \u0301 語" * 3, "fr", "b"), (None, "no id here at all", "en", "c")]


# Token counts ---------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return tokens.JsonCodec(queries.tokenizer_path("word_bpe_49k.json"))


def plain_count(library, text):
    return len(library.library.encode(text or "", add_special_tokens=False).ids)


def test_token_counts_odd(spark, library):
    got = tokens.count_tokens(docs_of(spark, ODD), queries.tokenizer_path("word_bpe_49k.json"), limit=10).collect()
    want = [(i, len((t or "").encode()), plain_count(library, t), plain_count(library, t) > 10) for i, t, *_ in ODD]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    empty = docs_of(spark, ODD).where("false")
    assert tokens.count_tokens(empty, queries.tokenizer_path("word_bpe_49k.json")).collect() == []


def test_long_texts_are_spliced_exactly(library):
    rng = random.Random(1)
    pieces = ["a", "Bc", "é", "ß", " ", "  ", "\n", "\t", "'s", "12", "<|endoftext|>", "!!", "語", "\u0301", "\u00a0", "xyz" * 20, "Σ", "İ", " the"]
    byte = tokens.ByteCodec(*queries.byte_codec())
    for _ in range(120):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(300)))
        size = {"chunk": rng.choice([7, 16, 40]), "overlap": rng.choice([3, 8, 20])}
        assert tokens.encode_long(library, text, **size).tolist() == library.library.encode(text, add_special_tokens=False).ids
        assert tokens.encode_long(byte, text, **size).tolist() == byte.library.encode_ordinary(text)
    text = words_text(rng, 30_000) + "y" * 50_000 + words_text(rng, 9_000)
    assert tokens.count_texts(library, [text, None, ""]) == [plain_count(library, text), 0, 0]


# Near duplicates ------------------------------------------------------------------------------------------------

def brute_components(rows, words, percent):
    sets, up = {}, {}
    for i, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j:j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
        up[i] = i

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def near_rows(seed=3):
    rng = random.Random(seed)
    rows, k = [], 0
    for family in range(12):
        base = words_text(rng, rng.choice([3, 8, 20, 60, 150]), 5000).split()
        for _ in range(rng.choice([1, 2, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            rows.append((k, "  ".join(w).upper() if k % 5 == 0 else " ".join(w), "en", f"s{family}"))
            k += 1
    return rows + [(k, None, None, None), (k + 1, "", None, None), (k + 2, " \n", None, None), (k + 3, "One two", None, None), (k + 4, "one  TWO", None, None)]


@pytest.mark.parametrize("block", [512, 4])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = near_rows()
    for words, percent in ((3, 85), (5, 80)):
        got = {r[0]: tuple(r)[1:] for r in near_dedup.near_duplicates(spark, docs_of(spark, rows), words, percent).collect()}
        assert got == brute_components(rows, words, percent)


def test_near_duplicates_odd(spark):
    got = near_dedup.near_duplicates(spark, docs_of(spark, ODD), 3, 85).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].kept and by[None].component_id is None
    assert near_dedup.near_duplicates(spark, docs_of(spark, ODD).where("false"), 3, 85).collect() == []


def test_registers_and_estimate():
    rng = np.random.default_rng(0)
    for n in (1, 5, 40, 3000):
        a = np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False))
        assert (near_dedup.registers(a) == near_dedup.registers(a.copy())).all()
    a = np.unique(rng.integers(0, 1 << 63, 4000, np.uint64) * np.uint64(2))
    b = np.concatenate([a[:3600], np.unique(rng.integers(0, 1 << 63, 400, np.uint64) * np.uint64(2) + np.uint64(1))])
    b.sort()
    est = near_dedup.estimate(near_dedup.registers(a), near_dedup.registers(b)[None])[0]
    assert abs(est - 3600 / (len(a) + len(b) - 3600)) < 0.12
    rows, bands = near_dedup.banding(0.85)
    assert (1 - 0.85**rows) ** bands <= near_dedup.MISS and rows * bands <= near_dedup.REGISTERS


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (7, 100), (200, 201), (201, 200), (300, 300)]
    got = {r.v: r.component for r in connected_components(spark, spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t")).collect()}
    assert set(got.values()) == {0, 200} and got[102] == 0 and got[201] == 200 and 300 not in got


# URL filter -----------------------------------------------------------------------------------------------------

URLS = [(1, None), (2, ""), (3, "no scheme.com/en/"), (4, "HTTP://Example.COM/en/7?x"), (5, "http://a.b.example.com/en/12"), (6, "http://xexample.com/en/7"),
        (7, "ftp://example.net/de/81#t"), (8, "http://net/de/"), (9, "http://m.net/de"), (10, "http://x.org"), (11, "http://x.org/es/a?b://c"), (12, "://com/en/"),
        (13, "http://com?/en/"), (13, "http://com?/en/"), (None, "http://q.com/en/" + "p" * 100_000), (14, "http://" + "a." * 3000 + "com/en/")]


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.key), r.key), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


def test_url_filter(spark):
    df = spark.createDataFrame([(*u, "junk", 1) for u in URLS], "page_id bigint, url string, host string, key int")
    got = sorted(map(tuple, url_filter.filter_urls(spark, df, queries.URL_RULES).collect()), key=repr)
    assert got == sorted(((i, *brute_url(u, queries.URL_RULES)) for i, u in URLS), key=repr)
    assert url_filter.filter_urls(spark, df.where("false"), queries.URL_RULES).collect() == []
    assert {r.verdict for r in url_filter.filter_urls(spark, df, []).collect()} == {"allow"}


def test_cascade_is_exact_with_many_keys(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = [f"k{i}" for i in range(0, 4000, 40)] + ["absent"]
    levels = url_filter.build_cascade(spark, listed, universe, 4000)
    got = {r.key for r in universe.where(url_filter.member(F.col("key"), levels)).collect()}
    assert got == set(listed) - {"absent"} and len(levels) >= 2


# Chat formatting ------------------------------------------------------------------------------------------------

def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "a [INST] ~1 </s> < ]"), (1, 1, "assistant", "x\ny~0"), (1, 2, "tool]x", "t"), (1, None, None, None), (2, 0, "assistant", ""),
             (None, 1, "system", "s"), (3, 5, "assistant", "same"), (3, 5, "assistant", "same"), (3, 5, "user", "b" * 100_000)]
    turns += [(9, i, "assistant" if i % 2 else "user", f"turn {i} é") for i in range(300)]
    df = spark.createDataFrame([(*t, 1, 2) for t in turns], "conv_id bigint, turn bigint, role string, text string, block int, conv int")
    typed = df.withColumn("parts", chat_format.text_parts(F.col("text")))
    chats = chat_format.format_chats(typed)
    got = {r.conv_id: r for r in chat_format.digests(chats).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in turns:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    for c, ts in by.items():
        ts.sort()
        loss = "".join(x for *_, r, x in ts if r == "assistant")
        assert got[c].n_turns == len(ts) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in ts).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for r in chats.collect():
        assert sum(m.n_chars for m in r.loss_mask) == len(r.formatted)
        at, said = 0, ""
        for m in r.loss_mask:
            said += r.formatted[at:at + m.n_chars] if m.loss else ""
            at += m.n_chars
        for raw, code in reversed(chat_format.ESCAPES):
            said = said.replace(code, raw)
        assert hashlib.sha256(said.encode()).hexdigest() == got[r.conv_id].loss_sha256
    assert chat_format.format_chats(typed.where("false")).collect() == []


def test_chat_attachments(spark):
    part = lambda k, text=None, ref=None, n=None: (k, text, ref, n)
    rows = [(1, 0, "user", [part("text", "see "), part("image", None, "u1", 10), part("text", " [x"), part("audio", None, "u2", None)]),
            (1, 1, "assistant", [part("document", None, "u3", 5), part(None, "plain")]), (2, 0, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat_format.PART}>")
    got = {r.conv_id: r for r in chat_format.format_chats(df).collect()}
    assert got[1].formatted == "[INST] see [image 0] ~1x[audio 1] [/INST][ASST] [document 2]plain</s>"
    assert [(a.place, a.turn, a.kind, a.ref, a.tokens) for a in got[1].attachments] == [
        (0, 0, "image", "u1", 10), (1, 0, "audio", "u2", 750), (2, 1, "document", "u3", 5)]
    assert got[1].expanded_tokens == 765 and got[2].formatted == "[INST]  [/INST]" and got[2].attachments == []


# Exact dedup ----------------------------------------------------------------------------------------------------

def test_exact_dedup(spark):
    rng = random.Random(5)
    rows = ODD + [(100 + i, rng.choice(["a b", "ab", "a\tb ", "c", f"u{i}", "ab\u00a0"]), "en", "s") for i in range(300)]
    got = exact_dedup.dedup_exact(spark, docs_of(spark, rows)).collect()
    groups = collections.defaultdict(list)
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    for i, t, *_ in rows:
        groups[norm(t)].append((-len(t or ""), i))
    order = lambda x: (x[0], x[1] is not None, x[1] or 0)
    want = []
    for i, t, *_ in rows:
        keep = min(groups[norm(t)], key=order)[1]
        want.append((i, keep, len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert exact_dedup.dedup_exact(spark, docs_of(spark, rows).where("false")).collect() == []


# Mixing ---------------------------------------------------------------------------------------------------------

def test_mixing_meets_its_targets(spark):
    rng = random.Random(2)
    sizes = {"a": 500, "b": 120, "c": 30, None: 10}
    rows, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((k, words_text(rng, rng.randrange(5, 30)), "en", s))
            k += 1
    rows.append((k, None, "en", "empty"))
    df = docs_of(spark, rows)
    t = collections.Counter()
    for _, x, _, s in rows:
        t[s] += len((x or "").split())
    total = sum(t.values())
    shares = {s: n / total for s, n in t.items() if n}
    entropy = lambda w: -sum(x * math.log(x) for x in w.values())
    plan, _ = mixing.plan_mix(spark, df, entropy_gain=0.6, repetitions=None)
    w = {s: p**plan.exponent for s, p in shares.items()}
    w = {s: x / sum(w.values()) for s, x in w.items()}
    target = entropy(shares) + 0.6 * (math.log(len(shares)) - entropy(shares))
    assert abs(entropy(w) - target) < 1e-6
    got = mixing.mix(spark, df, entropy_gain=0.6, repetitions=None).collect()
    assert len(got) == len(rows)
    used = collections.Counter()
    for r in got:
        used[r.source] += r.tokens * r.copies
    for s in shares:
        assert 0 <= w[s] * total - used[s] < 31
        passes = int(w[s] * total // t[s])
        assert {r.copies for r in got if r.source == s} <= {passes, passes + 1}
    limited, _ = mixing.plan_mix(spark, df, entropy_gain=1.0, repetitions=2.0)
    z = sum(p**limited.exponent for p in shares.values())
    assert max(p ** (limited.exponent - 1) / z for p in shares.values()) <= 2.0 + 1e-6
    taken = collections.Counter(r.doc_id for r in limited.realise(df).collect())
    again = {r.doc_id: r.copies for r in mixing.mix(spark, df, entropy_gain=1.0, repetitions=2.0).collect() if r.copies}
    assert taken == again and limited.realise(df).columns == df.columns


def test_mixing_odd(spark):
    got = mixing.mix(spark, docs_of(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert mixing.mix(spark, docs_of(spark, ODD).where("false")).collect() == []
    assert {r.copies for r in mixing.mix(spark, docs_of(spark, [(1, None, "en", "a")])).collect()} == {0}


# License scans --------------------------------------------------------------------------------------------------

def test_license_scan(spark):
    mit = license_scan.TEMPLATES["MIT-text"]
    bent = mit.replace("free of charge", "at no charge")
    rows = [(1, "Some text.\nReleased under the MIT License. More words here.", "en", "a"), (2, "licensed under cc by-nc 4.0", "en", "a"), (3, f"Intro\n{mit}\nend", "en", "a"),
            (4, bent, "en", "a"), (5, "A license to kill and a copyright on nothing, with permission.", "en", "a"), (6, "clean text", "en", "a"),
            (7, "word " * 40_000 + "Licensed under the Apache License, Version 2.0." + " word" * 40_000, "en", "a"), *[(r[0] and r[0] + 50, *r[1:]) for r in ODD]]
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs_of(spark, rows)).collect()}
    assert {i: r.license for i, r in got.items()} == {1: "MIT", 2: "CC-BY-NC-4.0", 3: "MIT-text", 4: "MIT-text", 7: "Apache-2.0"}
    assert got[1].n_diff == got[3].n_diff == 0 and got[4].n_diff > 0 and "free" in got[4].differences
    assert rows[0][1][got[1].start_char:got[1].end_char] == "Released under the MIT License"
    assert license_scan.scan_licenses(docs_of(spark, rows).where("false")).collect() == []


# Decontamination ------------------------------------------------------------------------------------------------

def brute_contamination(rows, items):
    words = lambda t: [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())]
    grams = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[s:s + n])].add(i)
    sizes = {len(g) for g in grams}
    out = []
    for i, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (ids := grams.get(tuple(w[s:s + n]))):
                    hit.update(range(s, s + n))
                    found |= ids
        out.append((i, len(w), len(hit), len(found), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(8)
    items = [(k, words_text(rng, n, 60)) for k, n in enumerate((5, 1, 13, 14, 40, 40))] + [(6, None), (7, "..!"), (8, "W1 w1 W1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1"), (8, "w2 w3")]
    rows = []
    for k in range(60):
        w = words_text(rng, rng.randrange(0, 200), 60).split()
        for _ in range(rng.randrange(3)):
            src = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(src) + 1)
            at = rng.randrange(len(w) + 1)
            w[at:at] = src[a:a + rng.choice([12, 13, 20, 60])]
        rows.append((k, ("," if k % 3 == 0 else "") + " - ".join(w) + ("!" if k % 2 else ""), "en", "s"))
    rows += [(100, None, None, None), (101, "", None, None), (102, "...", None, None), (103, "w1 " * 40, None, None), (104, "word " * 60_000 + (items[4][1] or ""), None, None)]
    tests = spark.createDataFrame([(*x, 1, "y") for x in items], "item_id bigint, text string, term int, words string")
    got = decontam.decontaminate(spark, docs_of(spark, rows), tests).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, sorted(r["items"] or []), r.contaminated) for r in got), key=repr) == brute_contamination(rows, items)
    none = decontam.decontaminate(spark, docs_of(spark, rows), tests.where("false")).collect()
    assert len(none) == len(rows) and not any(r.contaminated for r in none)
    assert decontam.decontaminate(spark, docs_of(spark, rows).where("false"), tests).collect() == []


def test_proximity(spark):
    rows = [(1, "a b c d e", None, None), (2, "a x b y c", None, None), (3, "c b a", None, None), (4, "a b", None, None)]
    phrases = spark.createDataFrame([("p", ["a", "b", "c"])], "phrase string, words array<string>")
    index = decontam.PositionalIndex.build(spark, docs_of(spark, rows), phrases.select(F.explode("words").alias("word")).distinct(), "doc_id", "text")
    found = lambda slop: {(r.doc, r.start) for r in decontam.proximity_matches(index, phrases, slop).collect()}
    assert found(0) == {(1, 0)} and {d for d, _ in found(1)} == {1, 2} and {d for d, _ in found(2)} == {1, 2, 3}


# Language ID ----------------------------------------------------------------------------------------------------

def test_gradients():
    net = lang_id.Network.fresh(["a", "b", "c"], 1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x = np.random.default_rng(0).integers(97, 123, (5, 4)).astype(np.uint8)
    y = np.array([0, 1, 2, 0, 1])

    def loss():
        p = net.log_probs(x)
        return float(-p[:, np.arange(5), y].mean())

    _, g = net.gradients(x, y)
    rng = np.random.default_rng(1)
    for k in net.w:
        for at in [np.abs(g[k]).argmax(), *rng.integers(g[k].size, size=5)]:
            at = np.unravel_index(at, g[k].shape)
            old = net.w[k][at]
            net.w[k][at] = old + 1e-6
            up = loss()
            net.w[k][at] = old - 1e-6
            down = loss()
            net.w[k][at] = old
            assert abs((up - down) / 2e-6 - g[k][at]) < 1e-6


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lang_id.identify(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_odd(spark):
    rows = ODD + [(20 + i, "le chat est la et les chiens" if i % 2 else "the dog and the cats are here", "fr" if i % 2 else "en", "s") for i in range(40)]
    got = lang_id.identify(spark, docs_of(spark, rows)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 5)) and by[6].lang_pred in ("en", "fr")
    nothing = lang_id.identify(spark, docs_of(spark, [(1, "abc", None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]
    assert lang_id.identify(spark, docs_of(spark, rows).where("false")).collect() == []


# Training order -------------------------------------------------------------------------------------------------

def test_permutation():
    for n in (1, 2, 3, 100, 1000, 4097):
        p = training_order.permute(np.arange(n), n, 7)
        assert sorted(p.tolist()) == list(range(n)) and (training_order.permute(p, n, 7, back=True) == np.arange(n)).all()
    assert (training_order.permute(np.arange(1000), 1000, 7) != training_order.permute(np.arange(1000), 1000, 8)).any()


def test_shards_round_trip(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, words_text(rng, rng.randrange(300)), "en", "s") for i in range(100, 300)] + [r for r in ODD if r[0] != 4]
    out = f"file://{tmp_path}/shards"
    index = sorted(training_order.materialise(spark, docs_of(spark, rows), out, queries.byte_codec(), 64, 50).collect(), key=lambda r: r.slot)
    assert [r.slot for r in index] == list(range(len(index)))
    codec = tokens.ByteCodec(*queries.byte_codec())
    parts = collections.defaultdict(dict)
    for r, seq in zip(index, training_order.read_slots(out, 0, len(index), 64, 50), strict=True):
        assert hashlib.sha256(seq[:r.n_tokens].tobytes()).hexdigest() == r.ids_sha256 and (seq[r.n_tokens:] == codec.eot).all()
        assert (r.shard, r.row, r.byte_offset) == (r.slot // 50, r.slot % 50, r.slot % 50 * 128)
        for s in r.spans:
            parts[s.doc_id][s.doc_from] = seq[s.seq_from:s.seq_from + s.n].tolist()
    for i, text, *_ in rows:
        ids = [x for _, run in sorted(parts[i].items()) for x in run]
        assert ids == [*codec.library.encode_ordinary(text or ""), codec.eot]
    resumed = next(training_order.read_slots(out, 60, 1, 64, 50))
    assert hashlib.sha256(resumed[:index[60].n_tokens].tobytes()).hexdigest() == index[60].ids_sha256
    empty = training_order.materialise(spark, docs_of(spark, rows).where("false"), f"{out}-none", queries.byte_codec(), 64, 50)
    assert empty.collect() == []
