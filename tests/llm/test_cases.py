"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import distance, near_components
from pyspark.sql import functions as F
from test_corpus_queries import check_pieces
from tokenizers import Tokenizer

import corpus_pipeline
from tallyhouse.llm import bitslice, hnsw, idfiles, language, licences, lines, mixing, neardup, packing, tokens, toxicity
from tallyhouse.llm.queries import BYTE_TOKENIZER, WORD_TOKENIZER, fold
from tallyhouse.session import scratch

NAMES = "doc_id long, text string, lang string, source string, n_chars long, n long, size long, name string, id long, component string, p double, value string"
LINE = "the quick brown fox jumps over the lazy dog and runs far away"
LONG = " ".join(f"word{i % 977} of{i}" for i in range(60_000))
ROWS = [
    (1, "Released under the MIT License.\n" + LINE, "en", "a"),
    (2, None, "en", "a"),
    (3, "", "fr", None),
    (4, "  \n\t", None, "b"),
    (5, LINE + " today", "en", "b"),
    (6, LINE + " today", "en", "b"),
    (6, LINE + " today", "en", "b"),
    (None, LINE + " to-day", "en", None),
    (7, LONG, "en", "c"),
    (8, LONG + " end", "en", "c"),
    (9, "12345 !!!", "en", "a"),
    (10, "LICENSED under CC BY-NC 4.0, cc by nc", "de", "a"),
    (11, "stupid idiot", "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, 1, 2, "x", 3, "y", 0.5, "z") for r in ROWS], NAMES)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def test_language(odd, empty):
    model = language.fit(odd)
    rows = language.identify(odd, model, {"doc_id": F.col("doc_id")}).collect()
    assert len(rows) == len(ROWS)
    none = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert none == {2, 3, 4, 9} and all(r.score == 0 and not r.accepted for r in rows if r.doc_id in none)
    assert language.identify(odd, language.fit(empty), {"doc_id": F.col("doc_id")}).where("lang_pred <> 'und'").count() == 0
    assert language.identify(empty, model, {"doc_id": F.col("doc_id")}).count() == 0


def test_long_texts_are_counted_whole():
    text = "".join(random.Random(1).choices("abc é.", k=600_000))
    parts = language.counts(text)
    language_chunk, language._CHUNK = language._CHUNK, 1 << 30
    try:
        assert (parts == language.counts(text)).all()
    finally:
        language._CHUNK = language_chunk


def test_near_duplicates(spark, odd, empty):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark, odd).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(near_components([r[:2] for r in ROWS], 5, 80), key=key)
    assert neardup.near_duplicates(spark, empty).count() == 0


def test_family_of_copies(spark):
    """Copies with edits of their own, near the source or too far from it; and a shared passage."""
    rng = random.Random(5)
    source = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(source))]
    for i in range(1, 120):
        copy = source.copy()
        for k in rng.sample(range(300), rng.choice([2, 4, 6, 12, 14])):
            copy[k] = f"e{i}x{k}" if i % 3 else f"f{k}"
        rows.append((i, " ".join(copy)))
    passage = [f"p{i}" for i in range(200)]
    rows += [(200 + i, " ".join(passage + [f"q{i}r{k}" for k in range(100)])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark, df, 3, 85).collect()]
    assert sorted(got) == sorted(near_components(rows, 3, 85))


@pytest.mark.parametrize(("short", "percent"), [(32, 85), (3, 85), (3, 80)])
def test_edited_copies_about_the_threshold(spark, monkeypatch, short, percent):
    """Long lists: changes, gaps and insertions, some shared by several copies, links by chance only."""
    monkeypatch.setattr(neardup, "SHORT", short)
    rng = random.Random(short + percent)
    rows = []
    for g in range(2):
        source = [f"g{g}w{i}" for i in range(150)]
        for i in range(110):
            copy = source.copy()
            for _ in range(rng.choice([1, 3, 4, 5, 6])):
                k = rng.randrange(len(copy))
                own = f"e{i}x{k}" if rng.random() < 0.5 else f"f{rng.randrange(4)}"
                copy[k : k + rng.choice([0, 1, 1, 2])] = [own] * rng.choice([0, 1, 1])
            rows.append((1000 * g + i, " ".join(copy + [f"t{i}n{k}" for k in range(rng.choice([0, 0, 8]))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark, df, 3, percent).collect()]
    want = near_components(rows, 3, percent)
    assert 4 < len({w[2] for w in want}) < len(rows)
    assert sorted(got) == sorted(want)


def test_common_runs_are_counted_by_stretch(spark, monkeypatch):
    """Rows made are as many as stretches, not as runs of nodes, and what most nodes have is found in any of them."""
    monkeypatch.setattr(neardup, "STRETCH", 900)
    rows = [(h, np.array([*range(100 * h, 100 * h + 60), *range(10_000 * h + 9 * i, 10_000 * h + 9 * i + 9)], np.int64).tobytes(), (i,)) for h in (1, 2) for i in range(50)]
    stretches = list(neardup._common_runs(iter([pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows]) for k in (0, 1)], names=["hub", "whole"])])))
    assert sum(p.column("nodes")[0].as_py() for p in stretches) == 100 and len(stretches) <= 10
    assert all(len(p.column("runs")[0]) == 60 for p in stretches)
    long = spark.createDataFrame(rows, "hub long, whole binary, node struct<id: long>").repartition(7)
    found = {r.hub: sorted(r.most_have) for r in neardup._most_have(long).collect()}
    assert found == {h: list(range(100 * h, 100 * h + 60)) for h in (1, 2)}
    # a run that half of the nodes have, no more, is not among them
    few = spark.createDataFrame([(1, np.array(x, np.int64).tobytes(), (i,)) for i, x in enumerate(([1, 2], [1, 3]))], long.schema)
    monkeypatch.setattr(neardup, "STRETCH", 1000)
    assert [r.most_have for r in neardup._most_have(few.coalesce(1)).collect()] in ([[1]], [])


def test_packing(spark, odd, empty):
    tokenizer = Tokenizer.from_file(WORD_TOKENIZER)
    once = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    ids = {r.doc_id: np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1], dtype="<u4") for r in once.collect()}
    check_pieces(packing.pack(spark, once, WORD_TOKENIZER).collect(), ids)
    total = packing.pack(spark, odd, WORD_TOKENIZER).agg(F.sum("length")).first()[0]
    assert total == sum(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ROWS)
    assert packing.pack(spark, empty, WORD_TOKENIZER).count() == 0


def test_plan_fits_and_leaves_none_out():
    rng = np.random.default_rng(2)
    histogram = np.bincount(rng.integers(1, 64, 4000), minlength=65)
    histogram[[0, 64]] = 0
    histogram[20] += 3000
    plan = packing.plan(histogram, 7, 64)
    used = {}
    for n in range(1, 64):
        for rank in range(histogram[n]):
            for sequence, offset, length in plan.place(n, rank):
                used.setdefault(sequence, []).append((offset, length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(used) == list(range(7, 7 + len(used)))
    assert 64 * len(used) - int((histogram * np.arange(65)).sum()) <= 64 + 9 * len(used)


def test_licences(odd, empty):
    rows = {r.doc_id: r for r in licences.summary(licences.licences(odd)).collect()}
    assert (rows[1].n_base, rows[1].first_word, rows[1].base_labels, rows[1].score) == (1, 1, "mit", 1.0)
    assert (rows[10].n_base, rows[10].first_word, rows[10].last_word, rows[10].labels) == (2, 2, 7, "cc-by-nc")
    assert (rows[2].n_words, rows[2].n_base, rows[2].first_word, rows[2].labels, rows[2].score) == (0, 0, None, "", 0.0)
    assert licences.summary(licences.licences(empty)).count() == 0


def test_licence_notices_are_found_however_lines_end(spark):
    notice = dict((label, text) for text, label in licences.TEMPLATES)
    soup = [f"w{i}" for i in range(6000)]
    soup[10], soup[3000], soup[5900] = "all", "rights", "reserved"
    texts = {
        1: "Text before.\n" + notice["gpl"].replace(" ", "\n"),  # a word a line
        2: notice["mit"][:40],  # a part only
        3: " ".join(soup),  # all words of a template, far apart
        4: "All (c) rights reserved",  # a word between
        5: "all one two rights reserved",  # two words between
        6: " ".join([*soup[:9], "this is free and unencumbered software\r\n * released in the public domain", *soup[20:40]]),
        7: "\n".join([notice["bsd"]] * 500),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r for r in licences.licences(docs).collect()}
    labels = {i: {b.label for b in r.blocks} for i, r in found.items()}
    assert labels == {1: {"gpl"}, 2: set(), 3: set(), 4: {"proprietary"}, 5: set(), 6: {"unlicense"}, 7: {"bsd"}}
    assert [(b.first_word, b.score) for b in found[6].blocks][:1] == [(9, 10 / 11)]
    assert len(found[7].blocks) >= 500


def test_licence_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    templates = (("a b c d e f g h i j", "ten"), ("a b a c", "twice"), ("x y", "pair"), ("z", "one"), ("a x n1 n2 n3 a2 a3 a4", "rare"))
    words = np.array([*"abcdefghijxyz", "n1", "n2", "n3", "a2", "a3", "a4", "else", "other"])
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 90)))) for _ in range(60)]
    texts += [" ".join(rng.permutation("a b c d e f g h i j".split())) + " " + " ".join(rng.choice(words, 8)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for containment, spread in ((0.9, 1.25), (0.6, 1.0), (0.5, 2.0)):
        expected = set()
        for i, text in enumerate(texts):
            seen = text.split()
            for template, label in templates:
                own = {*template.split()}
                for start, w in enumerate(seen):
                    common = len(own & {*seen[start : start + licences.width(template, spread)]})
                    if w in own and common >= licences.needed(template, containment):
                        expected.add((i, label, start, round(common / len(own), 9)))
        rows = licences.licences(docs, templates=templates, containment=containment, spread=spread).collect()
        got = [(r.doc_id, b.label, b.first_word, round(b.score, 9)) for r in rows for b in r.blocks]
        assert len(got) == len(set(got)) and set(got) == expected and expected


def _vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)], i) for i in range(300)]
    rows += [(i, rows[7][1], 0) for i in range(300, 360)]  # one vector under many ids
    rows += [(400, None, 0), (450, [0.0] * 6, 0), (500, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (550, [float("nan")] * 6, 0), (None, [1.0] * 6, 0), (600, [1.0], 0)]
    rows += [(7, rows[7][1], 1), (100, rows[100][1], 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, block int").withColumn("shard", F.lit("x"))


def _expected(rows, score, skip_zero):
    use = []
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (any(v) or not skip_zero):
            use.append((i, np.array([*v, *[0.0] * (6 - len(v))])))
    out = []
    for q in sorted({i for i, _ in use if i % 50 == 0}):
        own = next(v for i, v in use if i == q)
        best = sorted((-score(own, v), i) for i, v in use if i != q)[:5]
        out += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    return out


def test_bit_sliced(spark):
    rows, df = _vectors(spark)
    whole = lambda v: np.floor(256 * v).astype(int)
    want = _expected(rows, lambda a, b: int(whole(a) @ whole(b)), False)
    for block in (1 << 16, 64):
        got = [tuple(r) for r in bitslice.top_k(spark, df, block=block, queries=3).collect()]
        assert sorted(got) == want
    assert bitslice.top_k(spark, df.limit(0)).count() == 0


def test_nearest(spark):
    rows, df = _vectors(spark)
    cosine = lambda a, b: float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))
    got = [tuple(r) for r in hnsw.nearest(spark, df, shard=128).collect()]
    # rows repeated under one id with one vector are one candidate
    seen, once = set(), []
    for r in rows:
        if r[:1] + (str(r[1]),) not in seen:
            seen.add(r[:1] + (str(r[1]),))
            once.append(r)
    want = _expected(once, cosine, True)
    assert len(got) == len(want)
    assert len({g[:1] + g[2:3] for g in got} & {w[:1] + w[2:3] for w in want}) >= 0.9 * len(want)
    assert hnsw.nearest(spark, df.limit(0)).count() == 0


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(3000):
        a = bytes(rng.choices(b"ab", k=rng.randint(0, 8)))
        b = bytes(rng.choices(b"ab", k=max(0, len(a) + rng.randint(-3, 3))))
        for most in (0, 1, 2, 3):
            assert lines.edit_distance(a, b, most) == min(distance(a, b), most + 1)


def test_lines(spark, odd, empty):
    found = lines.line_classes(spark, odd).collect()
    at = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.n_links, r.kept) for r in found}
    assert at[1, 0] == (1, 0, 0, True) and (2, 0) not in at and (3, 0) not in at
    assert at[5, 0][:3] == at[6, 0][:3] == at[None, 0][:3] == (None, 0, 1)
    rest = {r.doc_id: r.text for r in lines.without_repeats(spark, odd).collect()}
    assert rest[5] == "" and rest[2] is None and rest[7] == LONG and rest[1] == ROWS[0][1]
    assert lines.without_repeats(spark, odd).columns == odd.columns
    assert lines.line_classes(spark, empty).count() == 0 and lines.without_repeats(spark, empty).count() == 0


def test_mix(spark, odd, empty):
    rows = mixing.mix(spark, odd).collect()
    assert len(rows) == len(ROWS) and all(r.taken <= 2 * r.size for r in rows)
    mixed = mixing.mixed_rows(spark, odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix(spark, empty).count() == 0 and mixing.mixed_rows(spark, empty).count() == 0


def test_targets():
    goal = mixing.targets([("b", 100), ("a", 1000), (None, 10), ("c", 0)])
    assert goal["a"] == pytest.approx(1665 - 200 - 0 - goal[None]) and goal["b"] <= 200 and goal[None] <= 20 and goal["c"] == 0
    assert sum(goal.values()) == pytest.approx(1665)


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(1)
    size, p = rng.integers(0, 5000, 700).astype(float), np.full(700, 0.37)
    out = mixing.flight(p, size, 9, False)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum(), abs=1e-6) and out @ size == pytest.approx(p @ size, abs=1e-3)
    landed = mixing.flight(p, size, 9, True)
    assert set(landed) <= {0.0, 1.0} and abs(landed @ size - p @ size) <= 5000


def test_values_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 1000):
        values = (2.0 ** rng.uniform(0, 32, n)).astype(np.uint32)
        control, data = idfiles.pack_values(values)
        assert len(control) == -(-n // 4) and (idfiles.unpack_values(control, data, n) == values).all()


def test_id_files(spark, odd, empty):
    path = scratch(spark, "id-files")
    ranks = idfiles.write_ids(spark, odd, path, BYTE_TOKENIZER)
    rows = idfiles.read_ids(spark, path, ranks).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(BYTE_TOKENIZER)
    want = sorted(((-1 if r[0] is None else r[0]), tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in ROWS)
    assert [((-1 if r.doc_id is None else r.doc_id), r.ids) for r in rows] == want
    assert [r.start for r in rows] == np.cumsum([0, *(len(x) for _, x in want)])[:-1].tolist()
    path = scratch(spark, "id-files")
    assert idfiles.read_checksums(spark, path, idfiles.write_ids(spark, empty, path, BYTE_TOKENIZER)).count() == 0


def test_id_files_of_one_id(spark):
    rows = spark.range(8000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one text under one id").alias("text")).repartition(4)
    path = scratch(spark, "id-files")
    idfiles.write_ids(spark, rows, path, BYTE_TOKENIZER)
    assert spark.read.parquet(f"{path}/files").select("part").distinct().count() > 1
    found = idfiles.read_ids(spark, path).orderBy("start").collect()  # the ranks from beside the files
    want = Tokenizer.from_file(BYTE_TOKENIZER).encode("one text under one id", add_special_tokens=False).ids + [2]
    assert len(found) == 8000 and all(r.ids == want and r.start == k * len(want) for k, r in enumerate(found))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_library(name):
    rng = random.Random(7)
    signs = [*"aBc  \n\n\t'sdrt12.,!|é×÷ß–中", "́", " ", "\x0b", "<|endoftext|>", "'re", " don't", "\r\n", "İ", "Σ", " word"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(3000)] + [None, "", " ", "x" * 3000, LONG * 4]
    encoder = tokens.Encoder(public_tokenizers.path(name))
    want = Tokenizer.from_file(public_tokenizers.path(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert all(a.tolist() == b.ids for a, b in zip(encoder.encode(pa.array(texts)), want, strict=True))


def test_toxicity(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0, None), (11, 1, 1), (5, 0, 0), (6, None, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    rows = {r.doc_id: r for r in toxicity.score(spark, odd, labels, fold(4, 2)).collect()}
    assert rows[11].score > rows[5].score == rows[2].score and rows[5].predicted == 0
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert toxicity.score(spark, odd, labels.limit(0), fold(4, 2)).count() == len(ROWS)
    assert toxicity.score(spark, empty, labels, fold(4, 2)).count() == 0


def test_folds(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), fold(4, 2).alias("f")).collect()
    assert all(r.f == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_pipeline_takes_odd_rows(spark, odd, empty):
    for table in (odd, empty):
        now = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = spark.createDataFrame(stage(spark, now, "").collect(), odd.schema)
            assert now.columns == odd.columns
        pieces = corpus_pipeline.STAGES[-1][1](spark, now, "").count()
        assert (pieces > 0) == (table is odd)
