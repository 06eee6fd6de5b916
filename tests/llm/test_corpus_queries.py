"""Every corpus query against SQL or brute force, on the smallest tables."""

import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from brute import WORD, line_classes, near_components, without_repeats
from compare import difference
from conftest import SF
from tokenizers import Tokenizer

import corpus_pipeline
from tallyhouse.llm import lines, mixing
from tallyhouse.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, text, lang, source FROM documents").fetchall()


def answer(spark, name):
    return QUERIES[name](spark, SF).collect()


def test_all_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF), duck, ORACLES[name]) is None


def test_language(spark, docs):
    rows = {r.doc_id: r for r in answer(spark, "op1_language_id")}
    assert len(rows) == len(docs)
    right = [rows[d].lang_pred == lang for d, _, lang, _ in docs if rows[d].held_out]
    assert sum(right) >= 0.95 * len(right)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 for d, r in rows.items())


def test_near_duplicates(spark, docs):
    want = near_components([(d, t) for d, t, _, _ in docs], 3, 85)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in answer(spark, "op2_near_duplicates")]
    assert sorted(got) == sorted(want)


def _encoded(name, docs, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return {d: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [end], dtype="<u4") for d, t, _, _ in docs}


def check_pieces(pieces, ids, window=2048):
    covered, sequences = {}, {}
    for p in pieces:
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own)
        assert p.ids_crc32 == zlib.crc32(own[p.start : p.start + p.length].tobytes())
        covered.setdefault(p.doc_id, []).append((p.start, p.length))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for found, sizes in ((covered, {d: len(x) for d, x in ids.items()}), (sequences, None)):
        for key, parts in found.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == sizes[key] if sizes else at <= window
    assert covered.keys() == ids.keys()
    used = [sum(n for _, n in parts) for parts in sequences.values()]
    return sum(n if n & (n - 1) == 0 else window for n in used) - sum(used)


def test_packing(spark, docs):
    ids = _encoded("word_bpe_49k.json", docs, 1)
    padding = check_pieces(answer(spark, "op3_packing"), ids)
    assert padding <= 0.02 * sum(map(len, ids.values())) + 2048


def test_nearest(spark, duck):
    table = duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    ids, x = np.array([i for i, _ in table]), np.array([v for _, v in table], dtype=float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = answer(spark, "op6_nearest_neighbours")
    hit = 0
    for q in (i for i in ids.tolist() if i % 50 == 0):
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        near = unit @ unit[ids == q][0]
        near[ids == q] = -2
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert all(math.isclose(r.score, near[ids == r.vec_id][0], abs_tol=1e-12) for r in own)
        hit += len({r.vec_id for r in own} & set(ids[np.lexsort((ids, -near))][:5].tolist()))
    assert hit >= 0.9 * len(rows)


def test_lines(spark, docs):
    texts = [(d, t) for d, t, _, _ in docs]
    want = line_classes(texts, lines.EDITS, lines.SHORTEST)
    table = spark.createDataFrame(texts, "doc_id long, text string")
    rows = lines.line_classes(spark, table).collect()
    assert {(r.doc_id, r.line_no): (r.n_links, (r.class_doc_id, r.class_line_no)) for r in rows} == want
    assert len(rows) == len(want)
    # the query looks at every line that is not empty, shorter ones by equality, and at the links that join a class
    seen = {}
    for d, t in sorted(texts):
        for k, line in enumerate((t or "").split("\n")):
            if (line := line.strip(" \t\r\x0b\x0c")) and (d, k) not in want:
                want[d, k] = (0, seen.setdefault(line, (d, k)))
    rows = answer(spark, "op7_line_dedup")
    assert {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in rows} == {p: head for p, (_, head) in want.items()}
    assert len(rows) == len(want)
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.class_doc_id, r.class_line_no)) for r in rows)


def test_mix(spark, docs):
    size = {d: len(WORD.findall(t or "")) for d, t, _, _ in docs}
    total = {}
    for d, _, _, s in docs:
        total[s] = total.get(s, 0) + size[d]
    goal, taken = mixing.targets(list(total.items())), dict.fromkeys(total, 0)
    rows, source = answer(spark, "op8_source_mix"), {d: s for d, _, _, s in docs}
    assert sorted(r.doc_id for r in rows) == sorted(size)
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], total[s])
        assert math.isclose(r.target, goal[s]) and r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        taken[s] += r.taken
    assert all(abs(taken[s] - goal[s]) <= max(0.05 * goal[s], 1) for s in goal)
    assert sorted(rows) == sorted(answer(spark, "op8_source_mix"))


def test_id_files(spark, docs):
    ids, at = _encoded("byte_bpe_50k.json", docs, 2), 0
    rows = {r.doc_id: r for r in answer(spark, "op9_token_id_files")}
    assert rows.keys() == ids.keys()
    for d in sorted(ids):
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (at, len(ids[d]), zlib.crc32(ids[d].tobytes()))
        at += len(ids[d])


def test_toxicity(spark, duck):
    sf = SF.replace("0.001", "0.1")  # labels enough to learn from
    rows = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, sf).collect()}
    labels = duck.execute(f"SELECT doc_id, toxic FROM read_parquet('{sf}/labels.parquet') WHERE toxic IS NOT NULL").fetchall()
    held = [(rows[d], t) for d, t in labels if rows[d].held_out]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for d, r in rows.items())
    caught = [r.predicted for r, t in held if t]
    wrong = [r.predicted for r, t in held if not t]
    assert sum(caught) >= 0.75 * len(caught) and sum(wrong) <= 0.02 * len(wrong)


def test_pipeline_stages(spark, docs):
    """Every stage on its predecessor's rows, against brute force."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    names, now = table.columns, table
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "mix", "pack"]
    for name in ("language", "lines", "near_duplicates", "mix"):
        before = [(r.doc_id, r.text) for r in now.collect()]
        now = stages[name](spark, now, SF).cache()
        assert now.columns == names
        after = [(r.doc_id, r.text) for r in now.collect()]
        if name == "language":
            assert set(after) <= set(before) and len(after) >= 0.98 * len(before)
        elif name == "lines":
            assert after != before and sorted(d for d, _ in after) == sorted(d for d, _ in before)
            assert dict(after) == without_repeats(before, lines.EDITS, lines.SHORTEST)
        elif name == "near_duplicates":
            assert sorted(d for d, _ in after) == sorted(d for d, _, c in near_components(before, 5, 80) if d == c)
        else:
            assert set(after) <= set(before)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    mixed = now.collect()
    pieces = stages["pack"](spark, now, SF).collect()
    assert sum(p.length for p in pieces) == sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed)
    now.unpersist()
