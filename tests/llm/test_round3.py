"""Byte repeats, token alignment and whitening against plain Python over small tables."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from conftest import SF
from pyspark.sql import functions as F
from test_cases import NAMES, ROWS
from tokenizers import Tokenizer

from tallyhouse.llm import alignment, suffixes, whitening
from tallyhouse.llm.queries import BYTE_TOKENIZER, PIECE_TOKENIZER, QUERIES

ODD = [(*r, len(r[1]) if r[1] else None, 1, 2, "x", 3, "y", 0.5, "z") for r in ROWS]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def removed(rows, length):
    """(id, bytes, removed, spans, digest of the rest) by counting every string."""
    raws = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(r[i : i + length] for _, r in raws for i in range(len(r) - length + 1))
    out = []
    for d, r in raws:
        gone, reach = [], 0
        for i in range(len(r)):
            if i + length <= len(r) and seen[r[i : i + length]] > 1:
                reach = i + length
            gone.append(i < reach)
        opens = sum(g and not before for g, before in zip(gone, [False, *gone], strict=False))
        out.append((d, len(r), sum(gone), opens, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return order(out)


def digest(found):
    return order((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in found.collect())


def pieces(seed, signs, n=120):
    rng = random.Random(seed)
    base = ["".join(rng.choices(signs, k=rng.randint(0, 300))) for _ in range(20)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            source = rng.choice(base)
            at = rng.randint(0, len(source))
            parts += [source[at : at + rng.randint(0, 100)], "".join(rng.choices(signs, k=rng.randint(0, 30)))]
        rows.append((i, "".join(parts) if rng.random() > 0.05 else None))
    return rows + [(1000 + i, rows[i][1]) for i in range(6)]


@pytest.mark.parametrize(
    ("signs", "length", "in_a_task", "hot"),
    [("ab", 20, 50, 3), ("abcdefgh", 20, 32_768, 1024), ("ab é", 33, 7, 2), ("a", 12, 9, 1)],
)
def test_repeated_strings(spark, monkeypatch, signs, length, in_a_task, hot):
    """Many tasks and frequent seeds, so that groups go on across boundaries and are cut into parts."""
    monkeypatch.setattr(suffixes, "SORTED", in_a_task)
    monkeypatch.setattr(suffixes, "HOT", hot)
    rows = pieces(len(signs), signs)
    found = suffixes.without_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), length, with_kept=True)
    want = removed(rows, length)
    assert digest(found) == want and any(w[2] for w in want)
    text = {d: (t or "").encode() for d, t in rows}
    for r in found.collect():
        left = bytearray()
        at = 0
        for s in r.spans:
            left += text[r.doc_id][at : s.start]
            at = s.end
        assert bytes(r.kept) == bytes(left + text[r.doc_id][at:])


def test_passage_in_many_contexts(spark, monkeypatch):
    """One passage in all documents, another of less than the length."""
    monkeypatch.setattr(suffixes, "HOT", 20)
    monkeypatch.setattr(suffixes, "SORTED", 60)
    rng = random.Random(4)
    noise = lambda: "".join(rng.choices("abcdefghijklmnop ", k=rng.randint(60, 260)))
    passage, short = "".join(rng.choices("qrstuvwxyz", k=330)), "".join(rng.choices("QRSTUVWXYZ", k=180))
    rows = [(i, noise() + passage + noise() + short + noise()) for i in range(150)]
    want = removed(rows, 200)
    assert digest(suffixes.without_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"))) == want
    assert all(w[2] >= 330 for w in want)


def test_repeats_of_odd_rows(spark):
    odd = spark.createDataFrame(ODD, NAMES)
    assert digest(suffixes.without_repeats(spark, odd, 50)) == removed([r[:2] for r in ROWS], 50)
    assert suffixes.without_repeats(spark, odd.limit(0)).count() == 0


def test_long_texts_overlap_between_blocks(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(suffixes, "BLOCK", 1000)
    body = "".join(rng.choices("abcdefgh", k=7000))
    rows = [(1, body + "x" + body[900:1500]), (2, body[3000:3300])]
    assert digest(suffixes.without_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"))) == removed(rows, 200)


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    rows = [rng.integers(97, 99, n).astype(np.uint8) for n in rng.integers(0, 40, 300)]
    order_, common = suffixes.suffix_order(suffixes._words(rows, 40))
    padded = [bytes(r).ljust(40, b"\0") for r in rows]
    assert [padded[i] for i in order_] == sorted(padded)
    for a, b, n in zip(order_, order_[1:], common[1:], strict=False):
        same = next((k for k in range(40) if padded[a][k] != padded[b][k]), 40)
        assert n == same


def test_query_removes_the_same(spark, duck):
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    found = QUERIES["op11_suffix_dedup"](spark, SF)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert order(tuple(r) for r in found.collect()) == removed(rows, 200)


def alignment_of(rows):
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) token by token."""
    a_side, b_side = Tokenizer.from_file(BYTE_TOKENIZER), sentencepiece.SentencePieceProcessor(model_file=PIECE_TOKENIZER)
    a_side.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}

    def placed(ids, raw):
        at, out = 0, []
        for i, r in zip(ids, raw, strict=True):
            out.append((at, at + len(r), i))
            at += len(r)
        return out

    found, total = [], Counter()
    for d, text in rows:
        groups, links, a, b = [], [], [], []
        if text:
            ids = a_side.encode(" " + text, add_special_tokens=False).ids
            own = b_side.encode(text)
            raw_a = [bytes(back[c] for c in a_side.id_to_token(i)) for i in ids]
            raw_b = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in own]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                a, b = placed(ids, raw_a), placed(own, raw_b)
        i = j = 0
        for end in sorted({x[1] for x in a} & {x[1] for x in b}):
            ga = [x for x in a[i:] if x[1] <= end] if len(a) < 4000 else a[i : next((k for k in range(i, len(a)) if a[k][1] > end), len(a))]
            gb = [x for x in b[j:] if x[1] <= end] if len(b) < 4000 else b[j : next((k for k in range(j, len(b)) if b[k][1] > end), len(b))]
            i, j = i + len(ga), j + len(gb)
            groups.append(",".join(str(x[2]) for x in ga) + "|" + ",".join(str(x[2]) for x in gb))
            links += [(x[2], y[2]) for x in ga for y in gb if x[0] < y[1] and y[0] < x[1]]
        total.update(links)
        found.append(((d, len(a), len(b), len(groups), len(links)), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = {}
    for (_, b), n in total.items():
        best[b] = max(best.get(b, 0), n)
    return order((*head, sum(total[x] == best[x[1]] for x in links), sum(total[x] for x in links), sha) for head, links, sha in found)


def test_alignment(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 1 << 14)
    monkeypatch.setattr(alignment, "STRETCH", 500)
    texts = [
        "plain <|endoftext|> and </s> <s> <0x41> text", "tabs\tand\r\nline\n\n ends ", "  two  spaces   three ", "a ▁ sign", "日本語のテキスト 🙂🙂 é́", "\x00nul ", "x" * 3000,
        "naïve façade — “quotes” 12345678 $%^&*()", "\n\n\n", " ", "Ünïcödé" * 200,
    ]
    rows = [r[:2] for r in ROWS] + [(100 + i, t) for i, t in enumerate(texts)] + [(None, texts[0])]
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, pair int, chunk int, n int")
    got = alignment.align(spark, table, BYTE_TOKENIZER, PIECE_TOKENIZER)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = alignment_of(rows)
    assert order(tuple(r) for r in got.select(names).collect()) == want
    assert sum(w[-1] == "" for w in want) >= 3
    assert alignment.align(spark, table.limit(0), BYTE_TOKENIZER, PIECE_TOKENIZER).count() == 0
    groups = alignment.groups(BYTE_TOKENIZER, PIECE_TOKENIZER, texts[0])
    text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    assert hashlib.sha256(text.encode()).hexdigest() in {w[-1] for w in want}


def test_alignment_query(spark, duck):
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    found = QUERIES["op12_token_alignment"](spark, SF).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert order(tuple(r) for r in found.collect()) == alignment_of(rows)


def test_galloping_is_the_rank():
    rng = np.random.default_rng(2)
    for _ in range(60):
        x, y = (np.unique(rng.integers(0, 400, rng.integers(0, 120))) for _ in range(2))
        assert (alignment.gallop(x, y) == np.searchsorted(y, x)).all()


def test_pieces_are_those_of_the_library():
    rng = random.Random(8)
    signs = "aeiou tnsr.,;'\n\t-()ABC0123éüß日本🙂—“”#@/\\ " + chr(0x2581)
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 300))) for _ in range(400)]
    own = alignment.PieceEncoder(PIECE_TOKENIZER)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_TOKENIZER)
    assert own._cuts
    found = own.encode([(" " + t).encode() for t in texts])
    assert all(f.tolist() == library.encode(t) for f, t in zip(found, texts, strict=True))


def test_whitening(spark, duck):
    table = duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    rows = QUERIES["op13_embedding_whitening"](spark, SF).collect()
    assert len(rows) == 4 * len(table)
    x = np.floor(256 * np.array([v for _, v in table], dtype=float)).astype(int)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    by_id = {i: row for (i, _), row in zip(table, x, strict=True)}
    sign = {}
    for r in rows:
        own, k = by_id[r.vec_id], r.component
        assert r.n == n and r.deviation == sum(int(d) ** 2 for d in n * own - sums)
        assert abs(r.explained - values[-k] / values.sum()) < 1e-9 and r.identity_error < 1e-9
        want = (own - sums / n) @ vectors[:, -k] / np.sqrt(values[-k])
        sign.setdefault(k, np.sign(want * r.whitened))
        assert abs(sign[k] * want - r.whitened) < 1e-6


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 0.0]), (None, [0.5]), (1, [1.0, 2.0]), (6, [3.0, -1.0]), (7, [])]
    table = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, n int, whitened double")
    found = whitening.whiten(spark, table).collect()
    assert sorted((r.vec_id is None, r.vec_id) for r in found) == [(False, 1), (False, 1), (False, 6), (False, 7), (True, None)]
    assert all(r.n == 4 and len(r.whitened) == 2 and r.identity_error < 1e-9 for r in found)
    one = whitening.whiten(spark, table.where("vec_id = 1")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, 0, [None, None], [None, None])] * 2
    assert whitening.whiten(spark, table.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["plain", "equal", "half", "two"])
def test_leading_eigenvalues(kind):
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 9, 40):
        q, _ = np.linalg.qr(rng.normal(size=(size, size)))
        values = rng.random(size) * 100
        if kind == "equal":
            values[:] = 7
        elif kind == "half":
            values[: size // 2 + 1] = values.max()
        elif kind == "two":
            values[2:] = 0
        a = q * values @ q.T
        a = (a + a.T) / 2
        found, vectors = whitening.leading(a, 4)
        assert np.allclose(found, np.sort(np.linalg.eigvalsh(a))[::-1][:4], atol=1e-9)
        assert np.allclose(vectors @ vectors.T, np.eye(len(found)), atol=1e-9) and np.allclose(a @ vectors.T, vectors.T * found, atol=1e-7)
        for shift in (-1.0, 0.5 * values.max(), 200.0):
            assert whitening.above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()


def test_equal_vectors_are_fitted_once(spark):
    rows = [(i, [float(i % 5), float(i % 3), 0.25]) for i in range(30)]
    once = {tuple(v) for _, v in rows}
    found = whitening.whiten(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).agg(F.min("n"), F.max("n")).first()
    assert tuple(found) == (len(once), len(once))


def test_an_alignment_worker_keeps_little():
    own = alignment.Aligner(BYTE_TOKENIZER, PIECE_TOKENIZER)
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdeé中", k=rng.randint(1, 7))) for _ in range(3000)) for _ in range(40)]
    docs = own.encoded(pa.array(texts, pa.large_string()))
    tracemalloc.start()
    rows, pairs = own.documents(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(c) for _, c, _ in pairs) > 10_000
    assert sum(p.nbytes for part in pairs for p in part) <= 12 * sum(len(c) for _, c, _ in pairs) and peak < 45e6


def test_pieces_are_forgotten_and_learnt_again(monkeypatch):
    texts = [f" {t}".encode() for _, t in pieces(3, "ab c\n", 60) if t]
    own = alignment.PieceEncoder(PIECE_TOKENIZER)
    want = [x.tolist() for x in own.encode(texts)]
    monkeypatch.setattr(alignment, "PIECES", 5)
    monkeypatch.setattr(alignment, "BLOCK", 400)
    small = alignment.PieceEncoder(PIECE_TOKENIZER)
    assert [x.tolist() for t in texts for x in small.encode([t])] == want
