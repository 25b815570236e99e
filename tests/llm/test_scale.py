"""Texts, groups and tables that blow up what is not bounded, and stages of the pipeline, each against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import chat_format, common, decontam, exact_dedup, lang_id, license_scan, mixing, near_dedup, queries, tokens, training_order

CLASH = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, n int, id int, lang_pred string, score double, mix_blocks int, mix_source string, perhaps int, bloom_hash int"


def clashing(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns are named like what stages add."""
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "x", 0.5, 5, "y", 6, 7) for r in rows], CLASH)


# Decontamination --------------------------------------------------------------------------------------------------

def words_of(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]


def brute_hits(docs, items):
    grams = collections.defaultdict(set)
    for i, t in items:
        w = words_of(t)
        k = min(13, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            grams[tuple(w[s:s + k])].add(i)
    sizes = {len(g) for g in grams}
    out = []
    for d, t in docs:
        w, hit, met = words_of(t), set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                got = grams.get(tuple(w[s:s + k]))
                if got:
                    hit |= set(range(s, s + k))
                    met |= got
        out.append((d, len(w), len(hit), len(met), sorted(met), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_decontamination_of_texts_that_repeat(spark):
    long14 = " ".join(f"q{i}" for i in range(14))
    shared = " ".join(f"s{i}" for i in range(15))
    items = [(10, "aa bb"), (11, long14), (12, "AA bb, cc"), (13, " ".join(long14.split()[:13])), (14, "x " * 13), (15, None), (16, "--"), (17, "solo")]
    items += [(100 + i, f"{shared} t{i} u{i}") for i in range(300)]  # a passage that many items share
    rng = random.Random(1)
    docs = [(1, "aa bb " * 20_000), (2, "aa bb cc " * 3_000), (3, (long14 + " ") * 1_500), (4, "x " * 5_000), (5, None), (6, ""), (7, "!!"), (None, "aa bb"), (7, "solo act"),
            (8, f"p {shared} " * 400), (9, f"{shared} t7 u7"), (20, f"{shared} t8")]
    docs += [(50 + k, " ".join(rng.choice(["aa", "bb", "cc", "x", "solo", *long14.split()]) for _ in range(400))) for k in range(20)]
    got = decontam.decontaminate(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"] or [], r.contaminated) for r in got.collect()), key=repr) == brute_hits(docs, items)


# Chat formatting --------------------------------------------------------------------------------------------------

def test_attachments_by_the_thousands(spark):
    kinds, n = ("image", "audio", "document"), 20_000
    rows = [(1, 0, "user", [("text", "a[b]~9<c", None, None), *[(kinds[i % 3], None, f"r{i}", None) for i in range(n)], ("text", "z ", None, None)]),
            (1, 1, "assistant", [("text", "see [image 0] </s>", None, None), ("image", None, "last", 5)])]
    rows += [(2, i, "user", [("text", f"t{i}", None, None), ("image", None, f"u{i}", 7)]) for i in range(3_000)]
    rows += [(3, 0, "sys]~9[", None), (3, 0, "system", [("other", "k", None, None)]), (3, None, None, [])]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat_format.PART}>")
    got = {r.conv_id: r for r in chat_format.format_chats(df).select("*", chat_format.parse_chats(F.col("formatted")).alias("back")).collect()}
    first = "a[b]~9<c" + "".join(f"[{kinds[i % 3]} {i}]" for i in range(n)) + "z "
    assert [tuple(b) for b in got[1].back] == [("user", first), ("assistant", f"see [image 0] </s>[image {n}]")]
    assert [(a.place, a.kind, a.ref) for a in got[1].attachments] == [(i, kinds[i % 3], f"r{i}") for i in range(n)] + [(n, "image", "last")]
    assert [b.body for b in got[2].back] == [f"t{i}[image {i}]" for i in range(3_000)] and got[2].expanded_tokens == 21_000
    assert [tuple(b) for b in got[3].back] == [("", ""), ("sys]~9[", ""), ("system", "k")]
    for r in got.values():
        assert sum(m.n_chars for m in r.loss_mask) == len(r.formatted) and r.n_turns == len(r.back)
    at, loss = 0, ""
    for m in got[1].loss_mask:
        loss += got[1].formatted[at:at + m.n_chars] if m.loss else ""
        at += m.n_chars
    assert loss == f"see ~1image 0~3 ~2/s>[image {n}]"


# Exact dedup ------------------------------------------------------------------------------------------------------

def test_exact_dedup_in_ranges_with_a_hot_text(spark):
    rng = random.Random(3)
    rows = [(i, "hot text " + " " * rng.randrange(5) if i % 3 == 0 else f"t{rng.randrange(9000)} x" + " " * rng.randrange(3)) for i in range(12_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t.replace(" ", "")].append((-len(t), i))
    want = [(i, min(groups[t.replace(" ", "")])[1], len(groups[t.replace(" ", "")])) for i, t in rows]
    for bits in (1 << 29, 1 << 16):
        assert sorted(tuple(r)[:3] for r in exact_dedup.dedup_exact(spark, df, range_bits=bits).collect()) == want


# Near duplicates --------------------------------------------------------------------------------------------------

def test_near_dedup_misses_no_pair_at_the_threshold():
    """Pairs from 0.85 to 0.87 on, of sets of many sizes: bands that meet, and estimates that are not set aside."""
    rng = np.random.default_rng(8)
    rows, bands = near_dedup.banding(0.85)
    floor = 0.85 - near_dedup.MARGIN * (0.85 * 0.15 / near_dedup.REGISTERS) ** 0.5
    missed = aside = 0
    for k in range(1500):
        size = int(rng.choice([20, 48, 100, 300, 1000, 4000]))
        both = rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2) + rng.integers(0, 2, size).astype(np.uint64)
        apart = int(size * 0.15 / 0.85 * 0.98)
        one, two = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, n, np.uint64)])) for n in (apart // 2, apart - apart // 2))
        a, b = near_dedup.registers(one), near_dedup.registers(two)
        missed += not (near_dedup.band_keys(a, rows, bands) == near_dedup.band_keys(b, rows, bands)).any()
        aside += min(len(one), len(two)) >= near_dedup.SURE and float(near_dedup.estimate(a, b[None, :])[0]) < floor
    assert (missed, aside) == (0, 0)


def components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = frozenset(tuple(w[j:j + words]) for j in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = root(a), root(b)
            c = len(sets[a] & sets[b])
            if x != y and c and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def near_rows():
    rng = random.Random(5)
    vary = lambda b, k: [f"v{rng.randrange(10**6)}" if j in at else w for at in [set(rng.sample(range(len(b)), k))] for j, w in enumerate(b)]
    base = [f"b{i}" for i in range(200)]
    other = vary(base, 30)
    rows = [(i, " ".join(vary(base, rng.choice([1, 4, 6, 8])))) for i in range(10, 260)] + [(900, " ".join(base))]
    rows += [(i, " ".join(vary(other, rng.choice([2, 8])))) for i in range(300, 360)]
    return rows + [(i, " ".join(f"x{rng.randrange(300)}" for _ in range(40))) for i in range(400, 440)] + [(i, " ".join(base)) for i in range(500, 560)]


@pytest.mark.parametrize("sizes", [(128, 512), (16, 32)])
def test_near_dedup_of_a_large_family(spark, monkeypatch, sizes):
    """Variants that are linked to one text but not to each other, over many blocks, with copies."""
    monkeypatch.setattr(near_dedup, "BLOCK", sizes[0])
    monkeypatch.setattr(near_dedup, "ACROSS", sizes[1])
    rows = near_rows()
    got = near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85)
    assert {r.doc_id: r.component_id for r in got.collect()} == components(rows, 3, 85)


# Shared helpers ---------------------------------------------------------------------------------------------------

def test_rows_without_keys(spark, monkeypatch):
    rows = spark.range(5_000).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("k"), F.lit(1).alias("perhaps"), F.lit(2).alias("bloom_bits"))
    keys = spark.range(0, 5_000, 3).select(F.col("id").alias("k"))
    want = sorted((r.k for r in rows.collect() if r.k is None or r.k % 3), key=repr)
    for most in (200_000, 10):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        out = common.without_keys(rows, "k", keys, 1_667)
        assert out.columns == rows.columns and sorted((r.k for r in out.collect()), key=repr) == want
    few = {r.k for r in common.semi_rows(rows, "k", keys, 1_667).collect()}
    assert few >= {k for k in range(0, 5_000, 3) if k % 7} and len(few) < 2_500


def test_hot_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "COLD_ROWS", 5)
    rows = spark.range(300).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40)).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("m"))
    got = common.join_sized(rows, groups, "k", "m", 300)
    assert sorted((r.id, r.m) for r in got.collect()) == sorted((r.id, r.m) for r in rows.join(groups, "k").collect())


def test_rows_of_files_are_numbered_by_their_places(spark, tmp_path):
    spark.range(0, 1000, 1, 7).select("id", F.lit("x y").alias("file no"), F.lit(1).alias("file_path")).write.parquet(f"{tmp_path}/a b.parquet")
    read = spark.read.parquet(f"{tmp_path}/a b.parquet")
    one = common.number_rows(spark, read.select("id", "file no", "file_path"), "n")
    got = {r.id: r.n for r in one.collect()}
    assert one.columns == ["id", "file no", "file_path", "n"] and len(set(got.values())) == len(got) == 1000
    assert {r.id: r.n for r in common.number_rows(spark, read.where("id % 3 = 0"), "n").collect()} == {k: v for k, v in got.items() if k % 3 == 0}
    # Where rows are multiplied a place is no number any more.
    twice = read.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    for df, n in ((twice, 2000), (read.union(read), 2000), (read.join(read.select("id"), "id"), 1000), (read.where("false"), 0)):
        assert len({r.n for r in common.number_rows(spark, df, "n").collect()}) == n


# Token counts and output ------------------------------------------------------------------------------------------

def test_a_pre_tokeniser_that_keeps_text_together_is_found_out():
    assert tokens.JsonCodec(queries.tokenizer_path("word_bpe_49k.json")).cuttable
    assert tokens.ByteCodec(*queries.byte_codec()).cuttable
    assert not tokens.parts_at_white(lambda t: [(0, len(t))])
    whole = tokens.JsonCodec(queries.tokenizer_path("word_bpe_49k.json"))
    whole.cuttable = False
    assert len(tokens.encode_long(whole, "a b " * 5_000)) == 10_000


def test_a_shard_of_an_earlier_attempt_does_not_stop_a_later_one(tmp_path):
    store, top = training_order.open_store(f"file://{tmp_path}")

    class Stubborn:
        def __getattr__(self, name):
            return getattr(store, name)

        def move(self, a, b):
            raise OSError("the target exists")

    (tmp_path / "tmp").write_bytes(b"x")
    with pytest.raises(OSError):
        training_order.put_in_place(Stubborn(), f"{top}/tmp", f"{top}/shard")
    (tmp_path / "shard").write_bytes(b"x")
    training_order.put_in_place(Stubborn(), f"{top}/tmp", f"{top}/shard")
    assert not (tmp_path / "tmp").exists() and (tmp_path / "shard").exists()


# Mixing -----------------------------------------------------------------------------------------------------------

def brute_mix(spark, plan, sized):
    """Copies of every row with words, by putting each source's blocks and documents in order."""
    rows = sized.select("id", "source", "tokens", mixing._hash(F.col("id"), plan.key).alias("h")).collect()
    sources = {r.source: r for r in plan.sources.collect()}
    pairs = {(r.source, r.h % sources[r.source].blocks) for r in rows if r.source in sources}
    order = {(r.s, r.b): r.x for r in spark.createDataFrame(sorted(pairs, key=repr), "s string, b bigint").select(
        "s", "b", mixing._block_hash(F.col("s"), F.col("b"), plan.key).alias("x")).collect()}
    out = []
    for name, q in sources.items():
        mine = [r for r in rows if r.source == name and r.tokens]
        passes, left = divmod(q.quota, sum(r.tokens for r in mine))
        blocks = collections.defaultdict(lambda: collections.defaultdict(int))
        for r in mine:
            blocks[order[name, r.h % q.blocks]][r.h] += r.tokens
        taken = set()
        for _, docs in sorted(blocks.items()):
            if sum(docs.values()) <= left:
                left -= sum(docs.values())
                taken |= set(docs)
                continue
            for h, n in sorted(docs.items()):
                if n > left:
                    break
                left -= n
                taken.add(h)
            break
        out += [(r.id, name, r.tokens, passes + (r.h in taken)) for r in mine]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "digit"), [(100_000, 12), (60, 2), (25, 3)])
def test_mixing_takes_blocks_in_order(spark, monkeypatch, block, digit):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", block)
    monkeypatch.setattr(mixing, "DIGIT", digit)
    rng = random.Random(4)
    rows = [(i if i % 11 else 7, "w " * rng.randrange(12) if i % 9 else None, "en", None if i % 13 == 0 else "hot" if i % 3 else f"s{i % 5}") for i in range(600)]
    plan, sized = mixing.plan_mix(spark, clashing(spark, rows))
    plan.id_col, plan.source_col = "id", "source"
    got = sorted(((r.id, r.source, r.tokens, r.copies) for r in plan.copies(sized, "copies").collect() if r.tokens), key=repr)
    assert got == brute_mix(spark, plan, sized)


# License scans ----------------------------------------------------------------------------------------------------

def test_many_notices_in_one_text():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    found = scanner.scan("Released under the MIT License. and more text here. " * 3_000)
    assert len(found) == 3_000 and {m.license for m in found} == {"MIT"}


# Stages -----------------------------------------------------------------------------------------------------------

def stage_rows():
    long14 = " ".join(f"q{i}" for i in range(20))
    texts = [(i, t, "en", "s") for i, t in near_rows()[:80]]
    texts += [(1000, None, "en", "s"), (1001, "", None, None), (1002, "12 !!", "en", "s"), (None, "a null id with words here", "en", "s"), (None, "a null id with words here", "en", "s"),
              (1003, long14, "en", "t"), (1004, long14 + " and then a good many other words " * 40, "en", "t"), (1004, "same id other text entirely", "en", "t"), (10, texts[0][1], "en", "u")]
    return texts


@pytest.fixture
def benchmark_dir(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(20)))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def plain(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stage_near_duplicates(spark, benchmark_dir):
    rows = stage_rows()
    df = clashing(spark, rows)
    out = corpus_pipeline.near_duplicates(spark, df, benchmark_dir)
    comp = components(list(enumerate(r[1] for r in rows)), 5, 80)
    first = {}
    for i, r in enumerate(rows):
        first.setdefault(comp[i], []).append((r[0] is None, r[0] or 0, i))
    keep = {min(v)[2] for v in first.values()}
    kept = [rows[i] for i in range(len(rows)) if i in keep]
    assert out.columns == df.columns and sorted(t for _, t in plain(out) if t) == sorted(r[1] for r in kept if r[1])
    assert len(plain(out)) == len(kept)


def test_stage_decontamination(spark, benchmark_dir):
    rows = stage_rows()
    df = clashing(spark, rows)
    out = corpus_pipeline.decontamination(spark, df, benchmark_dir)
    judged = [brute_hits([(0, r[1])], [(1, " ".join(f"q{i}" for i in range(20)))])[0][5] for r in rows]
    assert out.columns == df.columns and plain(out) == sorted(((r[0], r[1]) for r, bad in zip(rows, judged, strict=True) if not bad), key=repr)


def test_stage_language_and_mixing_with_clashing_names(spark, benchmark_dir):
    rows = stage_rows()
    df = clashing(spark, rows)
    out = corpus_pipeline.language(spark, df, benchmark_dir)
    assert out.columns == df.columns and plain(out) == sorted(((r[0], r[1]) for r in rows if r[1] and any(c.isalpha() for c in r[1])), key=repr)
    mixed = corpus_pipeline.mixing_to_weights(spark, df, benchmark_dir)
    plan, sized = mixing.plan_mix(spark, df)
    plan.id_col, plan.source_col = "id", "source"
    want = collections.Counter()
    for i, s, n, c in brute_mix(spark, plan, sized):
        want[i, s, n] += c
    got = collections.Counter((r.doc_id, r.source, len(r.text.split())) for r in mixed.collect() if r.text and r.text.split())
    assert mixed.columns == df.columns and +got == +want


def test_stages_on_an_empty_table(spark, benchmark_dir):
    df = clashing(spark, stage_rows()).where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, benchmark_dir)
        assert out.count() == 0 and (name == "token_output" or out.columns == df.columns), name


def test_token_output_round_trip(spark, benchmark_dir):
    rows = stage_rows()
    out = training_order.materialise(spark, clashing(spark, rows), f"file://{benchmark_dir}/shards", queries.byte_codec(), seq_len=64, rows_per_shard=8).collect()
    slots = list(training_order.read_slots(f"file://{benchmark_dir}/shards", 0, len(out), 64, 8))
    assert sorted(r.slot for r in out) == list(range(len(out))) == list(range(len(slots)))
    for r in out:
        assert hashlib.sha256(slots[r.slot][:r.n_tokens].astype("<u2").tobytes()).hexdigest() == r.ids_sha256
    codec = tokens.ByteCodec(*queries.byte_codec())
    want = collections.Counter(len(codec.library.encode_ordinary(t or "")) + 1 for _, t, *_ in rows)
    assert sum(r.n_tokens for r in out) == sum(k * v for k, v in want.items())
    assert lang_id.UNKNOWN == "und"
